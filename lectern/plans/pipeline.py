"""The whole run as one plan: affinity, search, enrichment, ranking, sections, chunks, retrieval, script, checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import affinity, chunks, compose, discover, providers, retrieve, sections
from lectern.sources import files


@dataclass(frozen=True)
class Providers:
    """What a run may call outside; without them it uses the native fallbacks.

    ``writers`` are (label, prompt -> text) in order of preference, ``embed`` gives vectors of a
    batch of texts, ``fetch`` a document's bytes and ``parse`` the text of its pages, ``speakers``
    are (label, script -> audio), and ``voice`` is the label that episodes carry.
    """

    writers: list[tuple[str, Callable[[str], str]]] = field(default_factory=list)
    embed: Callable[[list[str]], list[list[float]]] | None = None
    fetch: Callable[[str], bytes | None] | None = None
    parse: Callable[[bytes], list[str]] | None = None
    speakers: list[tuple[str, Callable[[str], bytes]]] = field(default_factory=list)
    voice: str = "demo"


@dataclass(frozen=True)
class Run:
    topics: list[str]
    episodes: int = 3
    window_days: int = 7
    chunk_limit: int = 10
    use_vectors: bool = True

    @property
    def terms(self) -> list[str]:
        """Distinct topic terms, in order."""
        import re

        found = [t for topic in self.topics for t in re.split(r"[^a-zA-Z0-9]+", topic.lower()) if len(t) >= 3]
        return list(dict.fromkeys(found)) or discover.DEFAULT_TERMS

    @property
    def search_terms(self) -> list[str]:
        phrases = [t.strip().lower() for t in self.topics if t.strip()]
        return list(dict.fromkeys([*(self.terms if self.topics else []), *phrases]))


def ranked(candidates: DataFrame, scores: DataFrame | None, run: Run, now: Column) -> DataFrame:
    """The run's best candidates (arxiv_id, title, abstract, categories, published, sections, citation_count, citation_velocity, ord)."""
    hay = F.concat_ws(" ", "title", "abstract", F.array_join("categories", " "))
    deep = F.concat_ws(" ", hay, F.array_join(F.map_values("sections"), " "))
    found = discover.searched(candidates, run.search_terms, deep, "ord", max(6, 2 * run.episodes))
    found = found.withColumn("citation_velocity", discover.enriched_velocity(F.col("citation_velocity"), F.col("citation_count")))
    boost = None
    if scores is not None:
        found = found.withColumn("_hay", hay)
        found = found.join(affinity.boosts(found, "arxiv_id", "_hay", scores), "arxiv_id").drop("_hay")
        boost = F.col("boost")
    score = discover.rank_score(F.col("published"), F.col("citation_velocity"), hay, now, run.terms, run.window_days, boost)
    return discover.ranked(found, score, "ord", run.episodes)


def with_sections(top: DataFrame, using: Providers) -> DataFrame:
    """``top`` with ``sections`` of the cascade: given ones if long enough, else those of the fetched document, else the abstract."""
    none = F.create_map().cast("map<string,string>")
    given = F.coalesce("sections", none)
    if using.fetch is None:
        return top.withColumn("sections", sections.extracted(given, none, F.col("abstract")))
    missing = top.where(~sections.has_sections(F.map_values(given)) & (F.coalesce("pdf_url", F.lit("")) != ""))
    held = files.fetched(missing, "arxiv_id", "pdf_url", using.fetch).where("content is not null")
    paged = files.text_lines(held, "arxiv_id", "content", using.parse)
    lines = paged.select("arxiv_id", F.struct("page", "line_no").alias("ln"), text.strip(F.col("line")).alias("line")).where("line <> ''")
    found = sections.section_texts(sections.labelled(lines, "arxiv_id"), "arxiv_id")
    maps = found.groupBy("arxiv_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "text"))).alias("_found"))
    joined = top.join(maps, "arxiv_id", "left")
    return joined.withColumn("sections", sections.extracted(given, F.coalesce("_found", none), F.col("abstract"))).drop("_found")


def run_tables(candidates: DataFrame, scores: DataFrame | None, run: Run, now: Column, using: Providers | None = None) -> dict[str, DataFrame]:
    """Papers, chunks and episodes of a run, in the schemas of the store.  Ids are hashes of keys."""
    using = using or Providers()
    optional = lambda df, name, kind, default: df if name in df.columns else df.withColumn(name, default.cast(kind))
    top = ranked(candidates, scores, run, now)
    for name, kind, default in (("authors", "array<string>", F.array()), ("published_at", "string", F.col("published")), ("pdf_url", "string", F.lit(""))):
        top = optional(top, name, kind, default)
    top = with_sections(top, using).withColumn("paper", F.sha2("arxiv_id", 256))
    parts = top.select("paper", F.explode("sections").alias("section", "body"))
    made = chunks.chunked(parts, "paper", "body", "section")
    asked = top.select("paper", F.concat_ws(" ", "title", "abstract").alias("question"))
    if run.use_vectors:
        held = providers.embedded(made, "content", using.embed)
        asked = providers.embedded(asked, "question", using.embed).withColumnRenamed("embedding", "vector")
    else:
        empty = F.array().cast("array<double>")
        held, asked = made.withColumn("embedding", empty), asked.withColumn("vector", empty)
    held = held.withColumn("c", F.concat_ws("#", "section", F.lpad(F.col("chunk_index").cast("string"), 6, "0")))
    best = retrieve.retrieved(held.select("paper", "c", "section", "content", "embedding"), asked, run.chunk_limit)
    listed = best.groupBy("paper").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section", "content"))), lambda x: F.struct(x["section"].alias("section"), x["content"].alias("content"))).alias("chunks"))
    picked = compose.last_content(best, "paper")
    rows = top.join(picked, "paper", "left").join(listed, "paper", "left")
    topics = F.array(*map(F.lit, run.topics)) if run.topics else F.array().cast("array<string>")
    none = F.create_map().cast("map<string,string>")
    template = compose.script(F.col("title"), F.col("abstract"), F.coalesce("retrieved", none), F.col("sections"), topics)
    asked_for = compose.prompt(F.col("title"), F.coalesce("authors", F.array().cast("array<string>")), F.col("categories"), topics, F.col("abstract"), F.coalesce("chunks", F.array().cast("array<struct<section:string,content:string>>")))
    drafts = rows.select("paper", "title", "categories", "score", template.alias("template"), *([asked_for.alias("prompt")] if using.writers else []))
    scripts = providers.written(drafts, "prompt", "template", using.writers).withColumnRenamed("text", "script")
    checked = compose.grounded(scripts.select("paper", "script"), made.select("paper", "content"), "paper")
    at = now.cast("string")
    made_episodes = scripts.join(checked, "paper").select(
        F.sha2(F.concat_ws("#", "paper", at), 256).alias("id"), F.col("paper").alias("paper_id"), F.concat("title", F.lit(": Audio Brief")).alias("title"),
        text.description(F.col("script")).alias("description"), text.topic_of(topics, F.col("categories")).alias("topic"), F.round("score", 4).alias("score"),
        "script", "qa_status", "qa_notes", text.duration_secs(F.col("script")).alias("duration_secs"), F.lit(using.voice).alias("tts_provider"), at.alias("created_at"),
    )
    papers = top.select(
        F.col("paper").alias("id"), "arxiv_id", "title", F.col("authors").cast("array<string>").alias("authors"), "abstract", "categories", F.col("published_at").cast("string").alias("published_at"),
        F.col("pdf_url").cast("string").alias("pdf_url"), F.col("citation_count").cast("int").alias("citation_count"), F.round("score", 4).alias("score"),
    )
    stored = held.select("id", F.col("paper").alias("paper_id"), "section", "chunk_index", "content", "token_count", "embedding")
    return {"papers": papers, "chunks": stored, "episodes": made_episodes}


def spoken(episodes: DataFrame, using: Providers | None = None) -> DataFrame:
    """(id, audio, content_type, provider, error) of episodes (id, script, title): spoken, else the preview tone; loudness and fades applied."""
    using = using or Providers()
    return files.post_processed(providers.spoken(episodes, "id", "script", "title", using.speakers), "id")


def episodes(candidates: DataFrame, scores: DataFrame | None, run: Run, now: Column) -> DataFrame:
    """Episodes of a run, with the key of their paper."""
    made = run_tables(candidates, scores, run, now)
    keys = made["papers"].select(F.col("id").alias("paper_id"), "arxiv_id")
    return made["episodes"].join(keys, "paper_id")


def episodes_from_tables(spark: SparkSession, d: str) -> DataFrame:
    """The run over the test tables: documents are papers, their text is one section."""
    from lectern.plans import domain

    p = domain.papers(spark, d)
    body = domain.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    rows = p.join(body, "id").select(
        F.col("id").cast("string").alias("arxiv_id"), "title", "abstract", "categories", "published", F.create_map(F.lit("results"), F.col("body")).alias("sections"),
        F.col("citations").alias("citation_count"), F.col("velocity").alias("citation_velocity"), F.col("id").alias("ord"),
    )
    topics = p.select(F.col("id").alias("episode_id"), F.col("title").alias("topic"))
    scores = affinity.scores(domain.events(spark, d), topics, domain.now())
    return episodes(rows, scores, Run(domain.TOPICS), domain.now())
