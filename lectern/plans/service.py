"""The application's requests as calls: listing, lookup, questions, topics, feed, feedback, status, runs."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lectern.functions.text import cache_key, excerpt
from lectern.functions.times import parsed_iso
from lectern.operators import affinity, feed, listing, providers, retrieve, status
from lectern.plans.pipeline import Providers, Run, run_tables, spoken
from lectern.sources.config import Settings, check_event, check_question, check_range
from lectern.sources.files import AudioCache
from lectern.sources.store import Store

ANSWER_CHUNKS, WINDOWS = 4, (1, 365)


class Service:
    """Requests against a ``Store``.  ``discover`` gives candidates (as ``ranked`` reads them) for topics and a window."""

    def __init__(self, store: Store, settings: Settings, discover, base: str = "http://localhost", using: Providers | None = None, cache: AudioCache | None = None):
        self.store, self.settings, self.discover, self.base = store, settings, discover, base.rstrip("/")
        self.using, self.cache = using or Providers(), cache or AudioCache(store.spark, f"{store.root}/audio")
        self.runs: dict = {"running": False, "started_at": None, "completed_at": None, "error": None, "last_error": None, "last_count": 0, "window_days": None}

    # reading

    def health(self, now: dt.datetime | None = None) -> dict[str, str]:
        return {"status": "ok", "timestamp": (now or dt.datetime.now(dt.UTC)).isoformat()}

    def state(self) -> dict:
        """State of the runs of this service."""
        return dict(self.runs)

    def _listed(self) -> DataFrame:
        papers = self.store.read("papers").withColumnRenamed("id", "paper_id").drop("score", "title")
        return listing.with_papers(self.store.read("episodes"), papers)

    def episodes(self, topic: str | None = None, limit: int = listing.ROUTE_LIMIT) -> DataFrame:
        """(id, json) of the newest episodes on a topic, with their papers."""
        check_range(limit, 1, 50)
        rows = self._listed().where(listing.on_topic(F.col("topic"), F.col("categories"), topic))
        fields = {c: F.col(c) for c in ("title", "description", "topic", "duration_secs", "tts_provider", "qa_status", "created_at", "script")} | {"score": F.round("score", 4)}
        paper = F.struct("paper_id", "arxiv_id", "authors", "abstract", "categories", "published_at", "pdf_url", "citation_count")
        return listing.newest(rows, "created_at", "id").limit(limit).select("id", listing.api_row(self.base, F.col("id"), fields, paper).alias("json"))

    def episode(self, key: str) -> Row | None:
        return listing.by_id(self._listed(), "id", key).first()

    def paper(self, episode: str) -> Row | None:
        found = listing.by_id(self.store.read("episodes"), "id", episode).select("paper_id")
        return self.store.read("papers").join(found, F.col("id") == F.col("paper_id"), "left_semi").first()

    def ask(self, episode: str, question: str) -> dict | None:
        """Answer and citations from the episode's paper; None if the episode or its chunks are unknown."""
        check_question(question)
        found = self.episode(episode)
        if found is None:
            return None
        chunks = listing.by_id(self.store.read("chunks"), "paper_id", found["paper_id"])
        rows = chunks.select(F.col("paper_id").alias("paper"), F.struct("section", "chunk_index").alias("c"), "section", "content", "embedding")
        asked = self.store.spark.range(1).select(F.lit(found["paper_id"]).alias("paper"), F.lit(question).alias("question"))
        asked = providers.embedded(asked, "question", self.using.embed).withColumnRenamed("embedding", "vector")
        best = retrieve.retrieved(rows, asked, ANSWER_CHUNKS)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "section", "content"))), lambda x: F.struct(x["section"].alias("section"), x["content"].alias("content")))
        cited = F.transform("chunks", lambda x: F.struct(x["section"].alias("section"), excerpt(x["content"]).alias("excerpt")))
        answer = retrieve.answer(F.lit(found["title"]), F.col("chunks"), F.lit(question))
        row = best.agg(ordered.alias("chunks")).where(F.size("chunks") > 0).select(answer.alias("answer"), cited.alias("citations")).first()
        return None if row is None else {"answer": row["answer"], "citations": [c.asDict() for c in row["citations"]]}

    def audio(self, episode: str, at: dt.datetime | None = None) -> Row | None:
        """(key, content_type, audio) of an episode: from the cache, else spoken, mastered and cached; None if it is unknown."""
        rows = listing.by_id(self.store.read("episodes"), "id", episode).select("id", "script", "title", cache_key(F.lit(self.using.voice), F.col("script")).alias("key"))
        found = rows.first()
        if found is None:
            return None
        held = self.cache.get(found["key"], at).first()
        if held is None:
            made = self.store.staged(spoken(rows.select("id", "script", "title"), self.using).select(F.lit(found["key"]).alias("key"), "content_type", "audio"))
            self.cache.put(made.withColumn("mtime", F.current_timestamp() if at is None else F.lit(at)))
            held = made.first()
            self.store.unstage(made)
        return held

    def topics(self) -> list[str]:
        return [r["topic"] for r in self.store.read("topics").orderBy("ord").collect()]

    def feed(self, slug: str) -> str:
        rows = self._listed().withColumn("created_at", parsed_iso(F.col("created_at"))).withColumn("order", F.xxhash64("id"))
        return feed.document(rows.select("id", "title", "description", "created_at", "order"), self.base, slug, "order").first()["rss"]

    def status(self, calls: DataFrame | None = None) -> dict:
        """Chosen providers and, from a log of calls, their latest outcomes."""
        has = {p: F.lit(self.settings.has(p)) for p in ("anthropic", "openai", "elevenlabs")}
        llm, tts = status.chosen_llm(has["anthropic"], has["openai"]), status.chosen_tts(F.lit(self.settings.tts), has["elevenlabs"], has["openai"])
        chosen = self.store.spark.range(1).select(llm.alias("llm"), tts.alias("tts"), status.chosen_embedder(has["openai"], F.lit(self.settings.embedder)).alias("embedder"), status.live(llm, tts).alias("live")).first()
        outcomes = [] if calls is None else [r.asDict() for r in status.latest(calls).collect()]
        return {"providers": chosen.asDict(), "outcomes": outcomes, "state": dict(self.runs)}

    # writing

    def set_topics(self, topics: list[str]) -> list[str]:
        return self.store.set_topics(topics)

    def feedback(self, key: str, episode: str, kind: str, position: int, at: dt.datetime) -> int | None:
        """Append an event; the number of all events, or None for an unknown episode."""
        check_event(kind)
        if listing.by_id(self.store.read("episodes"), "id", episode).isEmpty():
            return None
        event = self.store.spark.createDataFrame([(key, episode, kind, position, at.isoformat())], self.store.read("feedback").schema)
        return self.store.add_feedback(event)

    def run(self, now: dt.datetime, window_days: int | None = None) -> int:
        """Discover, rank and write; the number of new episodes.  Affinity comes from all feedback so far.

        Candidates are asked for once and staged, and so is each table, so that all fit together.
        """
        days = check_range(window_days or self.settings.window_days, *WINDOWS)
        topics = self.topics() or self.settings.topics
        self.runs |= {"running": True, "started_at": now.isoformat(), "error": None, "window_days": days}
        try:
            events = self.store.read("feedback").select("episode_id", "event_type", parsed_iso(F.col("created_at")).cast("timestamp_ntz").alias("ts"))
            known = self.store.read("episodes").select(F.col("id").alias("episode_id"), "topic")
            at = F.lit(now).cast("timestamp_ntz")
            scores = None if events.isEmpty() else affinity.scores(events, known, at)
            candidates = self.store.staged(self.discover(topics, days))
            made = run_tables(candidates, scores, replace(Run(topics), episodes=self.settings.episodes, window_days=days), at, self.using)
            held = {name: self.store.staged(rows) for name, rows in made.items()}
            count = held["episodes"].count()
            for name, rows in held.items():
                self.store.upsert(name, rows)
            self.store.unstage(candidates, *held.values())
            self.runs |= {"last_count": count, "last_error": None}
            return count
        except Exception as e:
            self.runs |= {"error": str(e)[: status.ERROR_CLIP], "last_error": str(e)[: status.ERROR_CLIP]}
            raise
        finally:
            self.runs |= {"running": False, "completed_at": dt.datetime.now(dt.UTC).isoformat()}

    def trigger(self, now: dt.datetime, window_days: int | None = None) -> dict:
        """A run unless one is under way: whether it was started, and the state."""
        if self.runs["running"]:
            return {"queued": False, "running": True, "state": self.state()}
        self.run(now, window_days)
        return {"queued": True, "running": False, "state": self.state()}
