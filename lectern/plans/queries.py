"""One query an operator, with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import audio, text, times, vectors
from lectern.functions.shared import shared_dir
from lectern.operators import affinity, ann, cache, chunks, compose, contains, dense, discover, feed, listing, retrieve, sections, sparse, status, upsert
from lectern.plans.domain import CHUNKS, EPISODES, EVENTS, LINES, NOW, PAPERS, TERMS, TOPICS, episodes, events, headed_lines, now, papers, table
from lectern.sources import catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def docs(s, d):
    return table(s, d, "documents")


_TERMS = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


# ---- text -----------------------------------------------------------------


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9]+'), lambda t: length(t) >= 3))), ' ') AS terms FROM documents""")
def terms_topic(s, d):
    return docs(s, d).select("doc_id", F.array_join(F.array_sort(text.topic_terms(F.col("text"))), " ").alias("terms"))


@query(rf"""WITH {PAPERS} SELECT id, array_to_string(list_sort(list_distinct(list_append(list_filter(string_split_regex(lower(title), '[^a-zA-Z0-9]+'), lambda t: length(t) >= 3), lower(title)))), '|') AS terms FROM papers WHERE title <> ''""")
def terms_search(s, d):
    return papers(s, d).where("title <> ''").select("id", F.array_join(F.array_sort(text.search_terms(F.col("title"))), "|").alias("terms"))


@query(r"""SELECT doc_id, len(t)::BIGINT AS tokens, len(list_distinct(t))::BIGINT AS kinds FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)""")
def tokens_embed(s, d):
    t = docs(s, d).select("doc_id", text.embed_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("kinds"))


@query(r"""SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: length(t) > 2)) AS token FROM documents) GROUP BY ALL""")
def tokens_sparse(s, d):
    return retrieve.term_counts(docs(s, d), "doc_id", "text")


@query(rf"SELECT doc_id, len({_WORDS})::BIGINT AS n FROM documents")
def words_count(s, d):
    return docs(s, d).select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("n"))


@query(rf"SELECT doc_id, {_STRIP.format('string_split(' + _STRIP.format('text') + chr(44) + chr(39) + '.' + chr(39) + ')[1]')} || '.' AS sentence FROM documents")
def first_sentence(s, d):
    return docs(s, d).select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query(rf"""WITH {PAPERS} SELECT id, left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug, coalesce(nullif(left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), ''), 'demo') AS saved FROM papers""")
def slugify(s, d):
    return papers(s, d).select("id", text.slug(F.col("title")).alias("slug"), text.slug(F.col("title"), "demo").alias("saved"))


@query(rf"SELECT doc_id, {_STRIP.format('left(text, 240)')} AS excerpt, left(text, 80) AS clip FROM documents")
def clip_excerpt(s, d):
    return docs(s, d).select("doc_id", text.excerpt(F.col("text")).alias("excerpt"), text.clip(F.col("text"), 80).alias("clip"))


@query(rf"""SELECT doc_id, CASE WHEN t LIKE '%.' THEN t ELSE t || '...' END AS description FROM (SELECT doc_id, array_to_string({_WORDS}[1:40], ' ') AS t FROM documents)""")
def description_40(s, d):
    return docs(s, d).select("doc_id", text.description(F.col("text")).alias("description"))


@query(rf"SELECT doc_id, greatest(trunc(len({_WORDS})::DOUBLE / 155::DOUBLE * 60)::BIGINT, 60) AS secs FROM documents")
def duration_secs(s, d):
    return docs(s, d).select("doc_id", text.duration_secs(F.col("text")).cast("long").alias("secs"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '-\s+', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents")
def dehyphenate(s, d):
    return docs(s, d).select("doc_id", text.joined_lines(F.col("text")).alias("text"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, string_split(url, '/')[-1] AS segment FROM pages")
def xml_escape_items(s, d):
    return table(s, d, "pages").select("page_id", text.xml_escape(F.col("html")).alias("escaped"), text.last_segment(F.col("url")).alias("segment"))


@query(rf"""WITH {PAPERS}, a AS (SELECT id, string_split(title, ' ') AS w, title FROM papers) SELECT id, array_to_string(w[1:3], ', ') || CASE WHEN len(w) > 3 THEN ' et al.' ELSE '' END AS authors, regexp_replace(title || ': Audio Brief', ': audio brief$', '', 'i') AS title FROM a""")
def author_display(s, d):
    p = papers(s, d)
    return p.select("id", text.authors_display(F.split("title", " ")).alias("authors"), text.title_clean(F.concat("title", F.lit(": Audio Brief"))).alias("title"))


@query("""SELECT doc_id, sha1('demo:v2:' || text) AS cache_key, sha256(text) AS content_key FROM documents""")
def cache_key_sha1(s, d):
    return docs(s, d).select("doc_id", text.cache_key(F.lit("demo"), F.col("text")).alias("cache_key"), F.sha2("text", 256).alias("content_key"))


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k, 'https://x.test/episodes/' || user_id || '/audio' AS url FROM events""")
def json_props_extract(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), text.audio_url(F.lit("https://x.test"), F.col("user_id")).alias("url"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(lang || ' , ,' || source || ',  x ', ','), lambda v: trim(v)), lambda v: v <> ''), '|') AS topics FROM documents""")
def topics_parse(s, d):
    return docs(s, d).select("doc_id", F.array_join(text.parsed_list(F.concat("lang", F.lit(" , ,"), "source", F.lit(",  x "))), "|").alias("topics"))


@query(rf"""WITH {PAPERS} SELECT id, printf('%.3f', velocity / 7) AS shown, greatest(1, floor(citations::DOUBLE / 60 + 0.5))::BIGINT AS minutes, replace(replace(replace(url_encode(title), '%20', '+'), '%2A', '*'), '~', '%7E') AS encoded FROM papers""")
def score_display(s, d):
    p = papers(s, d)
    return p.select("id", text.score_display(F.col("velocity") / 7).alias("shown"), text.minutes(F.col("citations")).cast("long").alias("minutes"), F.url_encode("title").alias("encoded"))


@query(
    rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n{{2,}}'), lambda p: {_STRIP.format("p")}), lambda p: p <> '') AS held,
  list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS sent FROM documents),
g AS (SELECT *, CASE WHEN len(sent) <= 4 THEN greatest(len(sent), 1) ELSE greatest(3, ceil(len(sent) / 4.0)) END::INT AS k FROM s),
p AS (SELECT doc_id, CASE WHEN len(held) > 1 THEN held ELSE list_transform(range(greatest(ceil(len(sent) / k::DOUBLE)::INT, 1)), lambda i: array_to_string(sent[i * k + 1 : (i + 1) * k], ' ')) END AS ps FROM g)
SELECT doc_id, (unnest(range(len(ps))))::BIGINT AS n, unnest(ps) AS paragraph FROM p"""
)
def paragraph_groups(s, d):
    return docs(s, d).select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("n", "paragraph")).withColumn("n", F.col("n").cast("long"))


@query(f"WITH {LINES} SELECT doc_id, ln, marker AS label FROM lines")
def header_classify(s, d):
    return headed_lines(s, d).select("doc_id", F.col("ln").cast("long").alias("ln"), text.header_label(F.col("line")).alias("label"))


# ---- time -----------------------------------------------------------------


@query(f"""SELECT event_id, CASE WHEN a < 5 THEN 'just now' ELSE CASE WHEN a < 60 THEN a || 's' WHEN a < 3600 THEN floor(a / 60 + 0.5)::BIGINT || 'm' WHEN a < 86400 THEN floor(a / 3600 + 0.5)::BIGINT || 'h' WHEN a < 604800 THEN floor(a / 86400 + 0.5)::BIGINT || 'd'
WHEN a < 2629800 THEN floor(a / 604800 + 0.5)::BIGINT || 'w' WHEN a < 31557600 THEN floor(a / 2629800 + 0.5)::BIGINT || 'mo' ELSE floor(a / 31557600 + 0.5)::BIGINT || 'y' END || CASE WHEN q >= 0 THEN ' ago' ELSE ' from now' END END AS shown
FROM (SELECT event_id, q, abs(q) AS a FROM (SELECT event_id, floor(date_diff('microsecond', ts, TIMESTAMP '2024-01-20 12:00:00') / 1000000::DOUBLE + 0.5)::BIGINT AS q FROM events))""")
def relative_time(s, d):
    at = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return table(s, d, "events").select("event_id", times.relative_time(F.col("ts"), at).alias("shown"))


@query("""SELECT doc_id, CASE WHEN m < 60 THEN m || 'm' WHEN m % 60 = 0 THEN m // 60 || 'h' ELSE m // 60 || 'h' || m % 60 || 'm' END AS shown, n_chars // 60 || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') AS clock
FROM (SELECT doc_id, n_chars, floor(n_chars / 60::DOUBLE + 0.5)::BIGINT AS m FROM documents) WHERE n_chars > 0""")
def format_duration(s, d):
    return docs(s, d).where("n_chars > 0").select("doc_id", times.duration_display(F.col("n_chars")).alias("shown"), times.clock_display(F.col("n_chars")).alias("clock"))


@query("SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS shown, strftime(ts, '%Y%m%d%H%M') AS compact FROM events")
def rfc2822(s, d):
    return table(s, d, "events").select("event_id", times.rfc2822(F.col("ts")).alias("shown"), times.compact(F.col("ts")).alias("compact"))


@query(f"""WITH {PAPERS} SELECT id, published FROM papers WHERE published >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND published <= TIMESTAMP '{NOW}'""")
def search_window(s, d):
    return papers(s, d).where(times.in_window(F.col("published"), now(), 7)).select("id", "published")


@query(f"""SELECT doc_id, 'submittedDate:[' || strftime(TIMESTAMP '{NOW}' - to_days(greatest(doc_id % 30, 1)::INT), '%Y%m%d%H%M') || ' TO 202401310000]' AS clause FROM documents""")
def date_clause(s, d):
    return docs(s, d).select("doc_id", times.submitted_clause(now(), (F.col("doc_id") % 30).cast("int")).alias("clause"))


# ---- discovery and ranking ------------------------------------------------


@query(f"""WITH {PAPERS} SELECT id, round(CASE WHEN velocity <= 0 THEN greatest(citations / 5::DOUBLE, 0.1::DOUBLE) ELSE velocity END, 4) AS velocity FROM papers""")
def enrich_velocity(s, d):
    return papers(s, d).select("id", F.round(discover.enriched_velocity(F.col("velocity"), F.col("citations")), 4).alias("velocity"))


_HAY = "lower(title || ' ' || abstract || ' ' || array_to_string(categories, ' '))"


@query(f"""WITH {PAPERS} SELECT id, row_number() OVER (ORDER BY hit DESC, id) AS place FROM (SELECT id, contains({_HAY}, 'que') OR contains({_HAY}, 'src1') AS hit FROM papers) ORDER BY hit DESC, id LIMIT 50""")
def demo_search_order(s, d):
    p = papers(s, d)
    found = discover.searched(p, ["que", "src1"], F.concat_ws(" ", "title", "abstract", F.array_join("categories", " ")), "id", 50)
    ids = found.agg(F.sort_array(F.collect_list(F.struct((~F.col("hit")).alias("miss"), "id"))).alias("x"))
    return ids.select(F.posexplode("x").alias("place", "x")).select("x.id", (F.col("place") + 1).cast("long").alias("place"))


_VELOCITY = "CASE WHEN velocity <= 0 THEN greatest(citations / 5::DOUBLE, 0.1::DOUBLE) ELSE velocity END"
_HITS = f"len(list_filter({_TERMS}, lambda t: contains({_HAY}, t)))"
_SCORE = f"0.45::DOUBLE * exp(-greatest(date_diff('microsecond', published, TIMESTAMP '{NOW}') / 86400000000::DOUBLE, 0) / 3.5::DOUBLE) + 0.35::DOUBLE * least({_VELOCITY} / 10::DOUBLE, 1) + 0.20::DOUBLE * "


def _scored(p, boost=None):
    hay = F.concat_ws(" ", "title", "abstract", F.array_join("categories", " "))
    velocity = discover.enriched_velocity(F.col("velocity"), F.col("citations"))
    return discover.rank_score(F.col("published"), velocity, hay, now(), TERMS, 7, boost)


@query(f"""WITH {PAPERS}, r AS (SELECT id, {_SCORE} ({_HITS} / 6::DOUBLE) AS score FROM papers) SELECT id, round(score, 4) AS score FROM r ORDER BY round(score, 9) DESC, id LIMIT 10""")
def rank_topk(s, d):
    top = discover.ranked(papers(s, d), F.round(_scored(None), 9), "id", 10)
    return top.select("id", F.round("score", 4).alias("score"))


@query(f"""WITH {PAPERS} SELECT id, {_HITS}::BIGINT AS hits, round({_HITS} / 6::DOUBLE, 4) AS share FROM papers""")
def term_hits_theta(s, d):
    hay = F.concat_ws(" ", "title", "abstract", F.array_join("categories", " "))
    p = papers(s, d).select("id", discover.term_hits(hay, TERMS).cast("long").alias("hits"))
    return p.select("id", "hits", F.round(F.col("hits") / 6.0, 4).alias("share"))


@query(r"""WITH terms AS (SELECT DISTINCT lower(unnest(string_split_regex(text, '\s+'))) AS term FROM benchmark), hits AS (SELECT doc_id, term FROM documents JOIN terms ON term <> '' AND contains(lower(text), term))
SELECT doc_id, count(*) AS hits, md5(string_agg(term, ' ' ORDER BY term)) AS terms FROM hits GROUP BY doc_id""")
def term_containment(s, d):
    """All words of ``benchmark`` against all ``documents``."""
    terms = table(s, d, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("term"))
    hits = contains.lists(docs(s, d), "doc_id", "text", terms, "term")
    return hits.groupBy(F.col("key").alias("doc_id")).agg(F.sum(F.size("terms")).alias("hits"), F.md5(F.array_join(F.sort_array(F.flatten(F.collect_list("terms"))), " ")).alias("terms"))


_WEIGHT = "CASE event_type WHEN 'complete' THEN 1.0::DOUBLE WHEN 'play' THEN 0.5::DOUBLE WHEN 'skip' THEN -0.4::DOUBLE ELSE 0::DOUBLE END"
_AFFINITY = f"""{EVENTS}, {PAPERS}, live AS (
  SELECT e.episode_id, p.title, {_WEIGHT} * exp(-greatest(date_diff('microsecond', ts, TIMESTAMP '{NOW}') / 86400000000::DOUBLE, 0) / 7::DOUBLE) AS w
  FROM events_ e JOIN papers p ON p.id = e.episode_id WHERE {_WEIGHT} <> 0 AND p.title <> ''),
affinity AS (SELECT term, sum(w) AS score FROM (SELECT w, unnest(list_distinct(list_filter(string_split_regex(lower(title), '[^a-zA-Z0-9]+'), lambda t: length(t) >= 3))) AS term FROM live) GROUP BY term)"""


def _scores(s, d):
    topics = papers(s, d).select(F.col("id").alias("episode_id"), F.col("title").alias("topic"))
    return affinity.scores(events(s, d), topics, now())


@query(f"WITH {_AFFINITY} SELECT term, round(score, 4) AS score FROM affinity")
def affinity_decay(s, d):
    return _scores(s, d).select("term", F.round("score", 4).alias("score"))


_BOOST = f"""{_AFFINITY}, raw AS (SELECT id, sum(coalesce(score, 0)) AS raw FROM (SELECT id, unnest(list_distinct(list_filter(string_split_regex(lower(abstract), '[^a-zA-Z0-9]+'), lambda t: length(t) >= 3))) AS term FROM papers) LEFT JOIN affinity USING (term) GROUP BY id),
boosts AS (SELECT papers.id, CASE WHEN coalesce(raw, 0) <= 0 THEN 0 ELSE least(raw / 4, 1) END AS boost FROM papers LEFT JOIN raw USING (id))"""


@query(f"WITH {_BOOST} SELECT id, round(boost, 4) AS boost FROM boosts")
def affinity_boost(s, d):
    return affinity.boosts(papers(s, d), "id", "abstract", _scores(s, d)).select("id", F.round("boost", 4).alias("boost"))


@query(f"""WITH {_BOOST}, r AS (SELECT id, {_SCORE} least({_HITS} / 6::DOUBLE + boost, 1) AS score FROM papers JOIN boosts USING (id)) SELECT id, round(score, 4) AS score FROM r ORDER BY round(score, 6) DESC, id LIMIT 10""")
def rank_with_affinity(s, d):
    p = papers(s, d)
    rows = p.join(affinity.boosts(p, "id", "abstract", _scores(s, d)), "id")
    return discover.ranked(rows, F.round(_scored(None, F.col("boost")), 6), "id", 10).select("id", F.round("score", 4).alias("score"))


@query(f"WITH {EVENTS} SELECT event_type, count(*) AS n, round(sum({_WEIGHT}), 4) AS weight FROM events_ WHERE {_WEIGHT} <> 0 GROUP BY event_type")
def event_weight_filter(s, d):
    e = events(s, d).withColumn("w", affinity.weight(F.col("event_type"))).where("w <> 0")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("weight"))


# ---- sections and chunks --------------------------------------------------

_LABEL = "last_value(marker IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _labelled(s, d):
    return sections.labelled(headed_lines(s, d), "doc_id")


@query(f"WITH {LINES} SELECT doc_id, ln, {_LABEL} AS label FROM lines")
def section_label_ffill(s, d):
    return _labelled(s, d).select("doc_id", F.col("ln").cast("long").alias("ln"), "label")


_TEXTS = rf"""{LINES}, lab AS (SELECT *, {_LABEL} AS label FROM lines), sec AS (
  SELECT doc_id, label, trim(regexp_replace(regexp_replace(string_agg(line, ' ' ORDER BY ln), '-\s+', '', 'g'), '\s+', ' ', 'g')) AS text FROM lab WHERE marker IS NULL AND label <> '' GROUP BY doc_id, label)"""


@query(f"WITH {_TEXTS} SELECT doc_id, label, left(text, 8000) AS text FROM sec WHERE length(text) > 120")
def section_text_agg(s, d):
    return sections.section_texts(_labelled(s, d), "doc_id")


@query(f"WITH {_TEXTS}, g AS (SELECT doc_id, bool_or(length(text) > 200) AS present, sum(length(text)) > 600 AS enough FROM sec GROUP BY doc_id) SELECT * FROM g")
def section_guards(s, d):
    t = sections.section_texts(_labelled(s, d), "doc_id", -1)
    full = F.sum(F.length("text")) > sections.ENOUGH
    return t.groupBy("doc_id").agg(F.bool_or(F.length("text") > sections.PRESENT).alias("present"), full.alias("enough"))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index::BIGINT AS chunk_index, array_to_string(w, ' ') AS content, len(w)::BIGINT AS token_count FROM chunks")
def chunk_windows(s, d):
    c = chunks.chunked(docs(s, d), "doc_id", "text")
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content", F.col("token_count").cast("long").alias("token_count"))


@query(f"WITH {CHUNKS} SELECT chunk_index::BIGINT AS chunk_index, len(w)::BIGINT AS token_count FROM chunks WHERE doc_id = 5")
def chunk_lookup(s, d):
    c = chunks.chunked(listing.by_id(docs(s, d), "doc_id", 5), "doc_id", "text")
    return c.select(F.col("chunk_index").cast("long").alias("chunk_index"), F.col("token_count").cast("long").alias("token_count"))


# ---- vectors and retrieval ------------------------------------------------

_TOKENS = "SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents"
_BUCKETS = f"buckets AS (SELECT id, ('0x' || left(sha256(t), 8))::BIGINT % 48 AS bucket, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL)"


@query(f"WITH {_BUCKETS} SELECT * FROM buckets")
def hash_embed_buckets(s, d):
    t = docs(s, d).select(F.col("doc_id").alias("id"), F.explode(text.embed_tokens(F.col("text"))).alias("t"))
    return t.groupBy("id", text.hash_bucket(F.col("t")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {_BUCKETS} SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 4) AS value FROM buckets")
def hash_embed_norm(s, d):
    v = docs(s, d).select(F.col("doc_id").alias("id"), F.posexplode(vectors.hash_embedding(F.col("text"))).alias("bucket", "value"))
    return v.where("value > 0").select("id", F.col("bucket").cast("long").alias("bucket"), F.round("value", 4).alias("value"))


_COS = "list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)))"


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS q, c.vec_id AS c, {_COS} AS s FROM e q, e c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 6) DESC, c) AS rank FROM p) SELECT q, c, rank, round(s, 4) AS similarity FROM r WHERE rank <= 5""")
def dense_cosine_topk(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    top = dense.dense_topk(e, e.where("vec_id % 20 = 0"), 5)
    return top.withColumn("similarity", F.round("similarity", 4))


@query(None)
def ann_topk(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    fitted, asked = ann.centroids(e), e.where("vec_id % 20 = 0")
    index = ann.indexed(e, fitted)
    top = ann.search(index, asked, fitted, 5, ann.probes_for(e, index, asked, fitted, 5))
    return top.withColumn("similarity", F.round("similarity", 4))


_TF = r"""tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: length(t) > 2)) AS token FROM documents) GROUP BY ALL),
qtf AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: length(t) > 2)) AS token FROM benchmark) GROUP BY ALL),
sim AS (SELECT q.item_id AS q, c.doc_id AS c, sum(q.tf * c.tf) / (any_value(ql.l) * any_value(cl.l)) AS s FROM qtf q JOIN tf c USING (token)
  JOIN (SELECT item_id, sqrt(sum(tf * tf)) AS l FROM qtf GROUP BY 1) ql USING (item_id) JOIN (SELECT doc_id, sqrt(sum(tf * tf)) AS l FROM tf GROUP BY 1) cl USING (doc_id) GROUP BY q.item_id, c.doc_id)"""


def _similar(s, d, k, extra=None):
    return sparse.sparse_topk(docs(s, d), table(s, d, "benchmark"), k, "doc_id", "text", "item_id", "text", extra)


@query(f"WITH {_TF}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 6) DESC, c) AS rank FROM sim) SELECT q, c, rank, round(s, 4) AS similarity FROM r WHERE rank <= 4")
def sparse_cosine_topk(s, d):
    return _similar(s, d, 4).select("q", "c", "rank", F.round("score", 4).alias("similarity"))


@query(f"WITH {_TF}, b AS (SELECT q, c, s + CASE c % 4 WHEN 0 THEN 0.18::DOUBLE WHEN 1 THEN 0.16::DOUBLE WHEN 2 THEN 0.08::DOUBLE ELSE 0::DOUBLE END AS score FROM sim), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, c) AS rank FROM b) SELECT q, c, rank, round(score, 4) AS score FROM r WHERE rank <= 5")
def section_bonus_topk(s, d):
    kind = F.col("doc_id") % 4
    section = F.when(kind == 0, "abstract").when(kind == 1, "results").when(kind == 2, "methods").otherwise("background")
    return _similar(s, d, 5, retrieve.bonus(section)).select("q", "c", "rank", F.round("score", 4).alias("score"))


_RETRIEVE = rf"""lines AS (SELECT doc_id AS paper, ln AS c, line AS content, CASE ln % 3 WHEN 0 THEN 'abstract' WHEN 1 THEN 'results' ELSE 'background' END AS section
    FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
  tk AS (SELECT paper, c, token, count(*) AS tf FROM (SELECT paper, c, unnest(list_filter(string_split_regex(lower(content), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 2)) AS token FROM lines) GROUP BY ALL),
  qk AS (SELECT paper, token, count(*) AS tf FROM (SELECT id AS paper, unnest(list_filter(string_split_regex(lower(title), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 2)) AS token FROM papers) GROUP BY ALL),
  sp AS (SELECT tk.paper, tk.c, sum(tk.tf * qk.tf) / (any_value(ql.l) * any_value(cl.l)) AS s FROM tk JOIN qk USING (paper, token)
    JOIN (SELECT paper, sqrt(sum(tf * tf)) AS l FROM qk GROUP BY 1) ql USING (paper) JOIN (SELECT paper, c, sqrt(sum(tf * tf)) AS l FROM tk GROUP BY 1, 2) cl USING (paper, c) GROUP BY tk.paper, tk.c)"""


def _paper_lines(s, d):
    rows = docs(s, d).select(F.col("doc_id").alias("paper"), F.posexplode(F.split("text", "\n")).alias("c", "content"))
    kind = F.col("c") % 3
    return rows.withColumn("section", F.when(kind == 0, "abstract").when(kind == 1, "results").otherwise("background"))


@query(rf"""WITH {PAPERS}, {_RETRIEVE},
tb AS (SELECT paper, c, ('0x' || left(sha256(t), 8))::BIGINT % 48 AS b, count(*) AS n FROM (SELECT paper, c, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS t FROM lines) GROUP BY ALL),
qb AS (SELECT paper, ('0x' || left(sha256(t), 8))::BIGINT % 48 AS b, count(*) AS n FROM (SELECT id AS paper, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t FROM papers) GROUP BY ALL),
dn AS (SELECT tb.paper, tb.c, sum(tb.n * qb.n) / (any_value(ql.l) * any_value(cl.l)) AS s FROM tb JOIN qb USING (paper, b)
    JOIN (SELECT paper, sqrt(sum(n * n)) AS l FROM qb GROUP BY 1) ql USING (paper) JOIN (SELECT paper, c, sqrt(sum(n * n)) AS l FROM tb GROUP BY 1, 2) cl USING (paper, c) GROUP BY tb.paper, tb.c),
sc AS (SELECT l.paper, l.c, coalesce(CASE WHEN l.paper % 2 = 0 THEN dn.s ELSE sp.s END, 0) + CASE l.section WHEN 'abstract' THEN 0.18::DOUBLE WHEN 'results' THEN 0.16::DOUBLE ELSE 0::DOUBLE END AS score
    FROM lines l LEFT JOIN sp USING (paper, c) LEFT JOIN dn USING (paper, c)),
r AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY round(score, 6) DESC, c) AS rank FROM sc) SELECT paper, c::BIGINT AS c, rank, round(score, 4) AS score FROM r WHERE rank <= 5""")
def retrieve_mode_switch(s, d):
    """Odd papers have one chunk without a vector: all their chunks are compared sparsely."""
    lines = _paper_lines(s, d)
    missing = (F.col("paper") % 2 == 1) & (F.col("c") == 0)
    held = lines.withColumn("embedding", F.when(missing, F.array().cast("array<double>")).otherwise(vectors.hash_embedding(F.col("content"))))
    asked = papers(s, d).select(F.col("id").alias("paper"), F.col("title").alias("question"), vectors.hash_embedding(F.col("title")).alias("vector"))
    top = _rounded_top(held, asked, 5, ~missing)
    return top.select("paper", F.col("c").cast("long").alias("c"), F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


def _rounded_top(chunks_, asked, k, present=None):
    scored = retrieve.scored(chunks_, asked, present).withColumn("key", F.round("score", 6))
    return retrieve.top_k(scored, "paper", "key", "c", k)


@query(rf"""WITH {PAPERS}, {_RETRIEVE}, sc AS (SELECT l.paper, l.c, l.section, l.content, round(coalesce(sp.s, 0) + CASE l.section WHEN 'abstract' THEN 0.18::DOUBLE WHEN 'results' THEN 0.16::DOUBLE ELSE 0::DOUBLE END, 6) AS score FROM lines l LEFT JOIN sp USING (paper, c)),
r AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY score DESC, c) AS rank FROM sc),
a AS (SELECT paper, rank, section, {_STRIP.format("string_split(" + _STRIP.format("content") + ", '.')[1]")} || '.' AS sentence FROM r WHERE rank <= 4)
SELECT paper, 'Based on ' || any_value(title) || ', the clearest answer is that ' || max(sentence) FILTER (rank = 1) || ' ' || coalesce(string_agg('In the ' || section || ' section, the paper adds that ' || sentence, ' ' ORDER BY rank) FILTER (rank > 1), '') || ' This response is grounded in the paper sections most related to: ' || any_value(title) || '.' AS answer
FROM a JOIN papers ON papers.id = a.paper GROUP BY paper""")
def extractive_answer(s, d):
    p = papers(s, d).select(F.col("id").alias("paper"), F.col("title").alias("question"), F.lit(None).cast("array<double>").alias("vector"))
    held = _paper_lines(s, d).withColumn("embedding", F.array().cast("array<double>"))
    top = _rounded_top(held, p, 4)
    lists = top.groupBy("paper", "question").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section", "content"))), lambda x: F.struct(x["section"].alias("section"), x["content"].alias("content"))).alias("chunks"))
    return lists.select("paper", retrieve.answer(F.col("question"), F.col("chunks"), F.col("question")).alias("answer"))


# ---- grounding and text ---------------------------------------------------

@query(rf"""WITH o AS (SELECT a.doc_id, len(list_intersect(x, y)) / greatest(len(x), 1)::DOUBLE AS o FROM
 (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 4)) AS x FROM documents) a JOIN
 (SELECT doc_id - 1 AS doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 4)) AS y FROM documents) b USING (doc_id))
SELECT doc_id, round(o, 4) AS overlap, CASE WHEN o >= 0.3::DOUBLE THEN 'verified' ELSE 'flagged' END AS qa_status FROM o""")
def qa_overlap(s, d):
    """Grounding of each document in the next one."""
    r = docs(s, d)
    source = r.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("content"))
    scripts = r.select("doc_id", F.col("text").alias("script")).join(source.select("doc_id"), "doc_id", "left_semi")
    return compose.grounded(scripts, source, "doc_id").select("doc_id", F.round("overlap", 4).alias("overlap"), "qa_status")


def _sentence(x: str) -> str:
    return _STRIP.format(f"string_split({_STRIP.format(x)}, '.')[1]") + " || '.'"


@query(rf"""WITH {PAPERS}, {_TEXTS}, m AS (SELECT doc_id, max(text) FILTER (label = 'results') AS results FROM sec WHERE length(text) > 120 GROUP BY doc_id)
SELECT id, 'If you care about the entre, ment que, src1 and, today''s paper is interesting because ' || {_sentence('abstract')} || ' The paper, titled ' || title || ', focuses on a practical bottleneck in modern AI systems. ' || {_sentence('abstract')} ||
' The main takeaway is that ' || {_sentence('coalesce(left(results, 8000), abstract)')} || ' Under the hood, the authors use a relatively simple idea: ' || {_sentence('abstract')} || ' What makes it worth watching next is the broader implication. ' || {_sentence('abstract')} ||
' For a daily podcast format, that means the work is both technically credible and easy to map to where the field may move next.' AS script FROM papers LEFT JOIN m ON m.doc_id = papers.id""")
def script_template(s, d):
    t = sections.section_texts(_labelled(s, d), "doc_id").where("label = 'results'")
    held = t.groupBy(F.col("doc_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("label", "text"))).alias("given"))
    none = F.create_map().cast("map<string,string>")
    rows = papers(s, d).join(held, "id", "left").withColumn("given", F.coalesce("given", none))
    return rows.select("id", compose.script(F.col("title"), F.col("abstract"), none, F.col("given"), F.array(*map(F.lit, TOPICS))).alias("script"))


@query(rf"""WITH {PAPERS}, {CHUNKS}, k AS (SELECT doc_id, string_agg('[body]' || chr(10) || array_to_string(w, ' '), chr(10) || chr(10) ORDER BY chunk_index) AS body FROM chunks WHERE chunk_index < 14 GROUP BY doc_id)
SELECT id, 'PAPER: ' || title || chr(10) || 'AUTHORS: A, B' || chr(10) || 'CATEGORIES: ' || array_to_string(categories, ', ') || chr(10) || 'AUDIENCE TOPICS: the entre, ment que, src1 and' || chr(10) || chr(10) || 'PAPER ABSTRACT:' || chr(10) || abstract || chr(10) || chr(10) || 'RETRIEVED PAPER SECTIONS:' || chr(10) || body || chr(10) || chr(10) || 'Write the 6-9 minute narration now. 800-1200 words. Pure spoken prose.' AS prompt FROM papers JOIN k ON k.doc_id = id""")
def prompt_assembly(s, d):
    c = chunks.chunked(docs(s, d), "doc_id", "text").groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.lit("body").alias("section"), "content"))).alias("c"))
    rows = papers(s, d).join(c, "id")
    return rows.select("id", compose.prompt(F.col("title"), F.array(F.lit("A"), F.lit("B")), F.col("categories"), F.array(*map(F.lit, TOPICS)), F.col("abstract"), F.col("c")).alias("prompt"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'the entre' WHEN doc_id % 3 = 1 THEN lang ELSE 'general AI' END AS topic FROM documents""")
def topic_derivation(s, d):
    kind = F.col("doc_id") % 3
    none = F.array().cast("array<string>")
    topics, categories = F.when(kind == 0, F.array(*map(F.lit, TOPICS))).otherwise(none), F.when(kind < 2, F.array("lang", "source")).otherwise(none)
    return docs(s, d).select("doc_id", text.topic_of(topics, categories).alias("topic"))


# ---- listings and storage -------------------------------------------------


def _with_papers(s, d):
    p = papers(s, d).select(F.col("id").alias("paper_id"), "abstract", "categories", "citations")
    return listing.with_papers(episodes(s, d), p)


_LISTED = f"WITH {EPISODES}, {PAPERS}, listed AS (SELECT e.*, p.abstract, p.categories, p.citations FROM episodes_ e JOIN papers p ON p.id = e.paper_id)"


@query(f"{_LISTED} SELECT id, paper_id, topic, citations FROM listed")
def episodes_inner_join(s, d):
    return _with_papers(s, d).select("id", "paper_id", "topic", "citations")


@query(f"{_LISTED} SELECT id, created_at FROM listed WHERE contains(lower(topic), 'src1') OR len(list_filter(categories, lambda c: contains(lower(c), 'src1'))) > 0 ORDER BY created_at DESC, id LIMIT 20")
def list_by_topic(s, d):
    e = _with_papers(s, d).where(listing.on_topic(F.col("topic"), F.col("categories"), "SRC1"))
    return listing.newest(e, "created_at", "id").limit(listing.LIST_LIMIT).select("id", "created_at")


_HIT = "contains(lower(title), 'que') OR contains(lower(abstract), 'que') OR contains(lower(categories[1]), 'que')"


@query(f"""{_LISTED}, hit AS (SELECT * FROM listed WHERE {_HIT}) SELECT sort, place, id FROM (
  SELECT 'citations' AS sort, id, row_number() OVER (ORDER BY citations DESC, id) AS place FROM hit UNION ALL SELECT 'score', id, row_number() OVER (ORDER BY score DESC, id) FROM hit
  UNION ALL SELECT 'duration', id, row_number() OVER (ORDER BY duration_secs DESC, id) FROM hit UNION ALL SELECT 'recent', id, row_number() OVER (ORDER BY created_at DESC, id) FROM hit) WHERE place <= 24""")
def explore_search_sort(s, d):
    e = _with_papers(s, d).withColumnRenamed("citations", "citation_count")
    hit = e.where(listing.matches_text(" Que ", [F.col("title"), F.col("abstract")], F.slice("categories", 1, 1)))
    out = None
    for name, column in listing.SORTS.items():
        top = listing.listed(hit, name, "id", listing.ROUTE_LIMIT).select(F.lit(name).alias("sort"), "id", F.col(column).alias("by"))
        placed = top.select("sort", "id", F.row_number().over(Window.partitionBy("sort").orderBy(F.col("by").desc(), "id")).cast("long").alias("place"))
        out = placed if out is None else out.unionByName(placed)
    return out


@query(f"{_LISTED} SELECT id, title, score, abstract FROM listed WHERE id = 7")
def episode_lookup(s, d):
    return listing.by_id(_with_papers(s, d), "id", 7).select("id", "title", "score", "abstract")


@query(f"""{_LISTED} SELECT id, '{{"id":' || id || ',"score":' || score || ',"audio_url":"https://x.test/episodes/' || id || '/audio","paper":{{"paper_id":' || paper_id || ',"citations":' || citations || '}}}}' AS json FROM listed""")
def api_rows(s, d):
    e = _with_papers(s, d)
    return e.select("id", listing.api_row("https://x.test", F.col("id"), {"score": F.col("score")}, F.struct("paper_id", "citations")).alias("json"))


@query(f"WITH {EPISODES} SELECT count(*) AS episodes, floor(sum(duration_secs) / 60::DOUBLE + 0.5)::BIGINT AS total_minutes, count(*) FILTER (qa_status = 'verified') AS verified, 3::BIGINT AS topics FROM episodes_")
def dashboard_stats(s, d):
    return listing.dashboard(episodes(s, d), len(TOPICS))


@query(f"WITH {EPISODES}, {PAPERS} SELECT id, paper_id FROM episodes_ WHERE paper_id NOT IN (SELECT id FROM papers)")
def orphan_episodes(s, d):
    return upsert.orphans(episodes(s, d), papers(s, d).select(F.col("id").alias("paper_id")), "paper_id").select("id", "paper_id")


@query("""WITH b AS (SELECT 0 AS batch, o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 1, o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O'),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY batch DESC, o_orderkey DESC) AS n, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY batch, o_orderkey) AS first_seen FROM b)
SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, first_seen FROM r WHERE n = 1""")
def upsert_latest(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    found = upsert.upserted([o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'")], "o_custkey", "o_orderkey")
    return found.select("o_custkey", "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), F.col("position.o_orderkey").alias("first_seen"))


@query("""SELECT key, size FROM (SELECT o_orderkey AS key, size, sum(size) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS size FROM orders)) WHERE rest > 50000000000""")
def lru_evict(s, d):
    files = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"), F.col("o_orderdate").alias("mtime"))
    return cache.evicted(files, 50_000_000_000).select("key", "size")


@query("SELECT sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS bytes FROM orders")
def cache_total(s, d):
    return cache.total_bytes(table(s, d, "orders").select(F.round(F.col("o_totalprice") * 100).cast("long").alias("size")))


@query("""SELECT user_id AS provider, arg_max(event_type <> 'error', (ts, event_id)) AS ok, max(ts) AS at, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def provider_latest(s, d):
    calls = table(s, d, "events").select(F.col("user_id").alias("provider"), F.col("ts").alias("at"), "event_id", (F.col("event_type") != "error").alias("ok"))
    return status.latest(calls).select("provider", "ok", "at", "event_id")


@query("SELECT event_id, left('failed: ' || props || repeat('x', 90), 80) AS error FROM events WHERE event_type = 'error'")
def failed_providers(s, d):
    calls = table(s, d, "events").select("event_id", (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("failed: "), "props", F.lit("x" * 90)).alias("error"))
    return status.failed(calls).select("event_id", "error")


@query("""SELECT doc_id, CASE WHEN a THEN 'anthropic' WHEN o THEN 'openai' ELSE 'demo' END AS llm, CASE WHEN e AND p IN ('elevenlabs', 'auto') THEN 'elevenlabs' WHEN o AND p IN ('openai', 'auto') THEN 'openai' ELSE 'demo' END AS tts, CASE WHEN o AND p <> 'demo' THEN 'openai' ELSE 'demo' END AS embedder,
(a OR o) AND ((e AND p IN ('elevenlabs', 'auto')) OR (o AND p IN ('openai', 'auto'))) AS live
FROM (SELECT doc_id, doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS o, doc_id % 5 = 0 AS e, ['auto', 'openai', 'elevenlabs', 'demo'][doc_id % 4 + 1] AS p FROM documents)""")
def provider_choice(s, d):
    doc = F.col("doc_id")
    a, o, e = doc % 2 == 0, doc % 3 == 0, doc % 5 == 0
    p = F.element_at(F.array(*map(F.lit, ["auto", "openai", "elevenlabs", "demo"])), (doc % 4 + 1).cast("int"))
    rows = docs(s, d).select("doc_id", status.chosen_llm(a, o).alias("llm"), status.chosen_tts(p, e, o).alias("tts"), status.chosen_embedder(o, p).alias("embedder"))
    return rows.withColumn("live", status.live(F.col("llm"), F.col("tts")))


@query("""SELECT source AS topic FROM (SELECT DISTINCT source FROM documents) WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE lang = 'es' AND doc_id % 2 = 0)""")
def suggestions_anti(s, d):
    r = docs(s, d).select(F.col("source").alias("topic"), "lang", "doc_id")
    return listing.not_taken(r, r.where("lang = 'es' and doc_id % 2 = 0"), "topic")


@query(rf"""WITH {PAPERS}, t AS (SELECT id, string_split(lower(title), ' ') AS a, string_split(lower(abstract), ' ') AS b FROM papers)
SELECT id, array_to_string(list_sort(list_intersect(a, b)), ' ') AS common, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), ' ') AS rest, array_to_string(list_filter(a, lambda x: x <> 'the'), ' ') AS removed, len(list_distinct(a))::BIGINT AS kinds FROM t""")
def topic_set_ops(s, d):
    t = papers(s, d).select("id", F.split(F.lower("title"), " ").alias("a"), F.split(F.lower("abstract"), " ").alias("b"))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    return t.select("id", joined(F.array_intersect("a", "b")).alias("common"), joined(F.array_except("b", "a")).alias("rest"), F.array_join(F.array_remove("a", "the"), " ").alias("removed"), F.size(F.array_distinct("a")).cast("long").alias("kinds"))


@query(rf"""WITH {PAPERS}, a AS (SELECT id, title, id % 3 AS g FROM papers WHERE contains(lower(title), 'the')) SELECT ['navigation', 'actions', 'episodes'][g + 1] AS kind, count(*) AS n, min(id) AS first_id FROM a GROUP BY g""")
def palette_groups(s, d):
    kind = F.element_at(F.array(*map(F.lit, ["navigation", "actions", "episodes"])), (F.col("id") % 3 + 1).cast("int"))
    return listing.grouped_commands(papers(s, d).withColumn("kind", kind), " The ", "title", "kind", "id").withColumnRenamed("first", "first_id")


@query("SELECT doc_id, lang, (row_number() OVER (ORDER BY lang, doc_id) - 1)::BIGINT AS index FROM documents")
def palette_index(s, d):
    return listing.running_index(docs(s, d).select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "lang", F.col("index").cast("long").alias("index"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS state, (props->>'$.k')::BIGINT AS k FROM events""")
def state_merge(s, d):
    pair = lambda k, v: F.create_map(F.lit(k), v)
    k = F.get_json_object("props", "$.k")
    new = F.when(F.col("event_id") % 2 == 0, pair("state", F.lit("new"))).otherwise(pair("other", F.lit("x")))
    both = status.merged(F.map_concat(pair("state", F.lit("old")), pair("k", k)), new)
    return table(s, d, "events").select("event_id", both.alias("m")).select("event_id", F.col("m")["state"].alias("state"), F.col("m")["k"].cast("long").alias("k"))


@query(rf"""WITH {EPISODES}, t AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM episodes_) SELECT rank, '<item><title>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title><link>https://x.test/episodes/' || id || '</link><guid>' || id || '</guid><description>' || replace(replace(replace(topic, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') ||
'</description><pubDate>' || strftime(strptime(created_at, '%Y-%m-%dT%H:%M:%SZ'), '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate><enclosure url="https://x.test/episodes/' || id || '/audio" type="audio/wav" length="0" /></item>' AS item FROM t WHERE rank <= 25""")
def feed_latest25(s, d):
    e = episodes(s, d).select("id", "title", F.col("topic").alias("description"), times.parsed_iso(F.col("created_at")).alias("created_at"))
    return feed.items(e, "https://x.test").select(F.col("rank").cast("long").alias("rank"), "item")


@query(f"WITH {EVENTS} SELECT count(*) AS total, count(*) FILTER (event_type = 'complete') AS completed FROM events_")
def feedback_total(s, d):
    return events(s, d).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "complete").alias("completed"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS at, count(*) AS runs FROM events GROUP BY user_id""")
def run_state_merge(s, d):
    return status.run_states(table(s, d, "events"), "user_id", "event_type", "ts", "event_id")


@query("""SELECT conv_id, turn, length(trim(text)) >= 3 AS ok, CASE WHEN turn % 2 = 0 THEN trim(text) ELSE 'answer ' || turn END AS shown FROM conversations""")
def question_guard(s, d):
    c = table(s, d, "conversations")
    answers = c.where("turn % 2 = 1").select("conv_id", "turn", F.concat(F.lit("answer "), F.col("turn").cast("string")).alias("answer"))
    rows = compose.patched_turns(c, answers, ["conv_id", "turn"], "text", "answer")
    return rows.select("conv_id", "turn", compose.asks(F.col("text")).alias("ok"), "shown")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '.pdf' ELSE url END AS link FROM pages""")
def pdf_links(s, d):
    link = lambda title, href: F.struct(F.lit(title).alias("title"), href.alias("href"))
    even = F.array(link("html", F.col("url")), link("pdf", F.concat("url", F.lit(".pdf"))))
    links = F.when(F.col("page_id") % 2 == 0, even).otherwise(F.array(link("html", F.col("url"))))
    return table(s, d, "pages").select("page_id", text.pdf_link(links, F.col("url")).alias("link"))


# ---- audio ----------------------------------------------------------------


@query(rf"""WITH {PAPERS}, t AS (SELECT id, least(greatest(len(string_split(abstract, ' ')) / 90::DOUBLE, 2.5::DOUBLE), 7::DOUBLE) AS secs, 440 + (length(title) % 5) * 35 AS pitch, 3000 / 22050::DOUBLE AS t FROM papers WHERE abstract <> '')
SELECT id, round(secs, 4) AS secs, pitch::BIGINT AS pitch, trunc(9000 * greatest(least(t / 0.35::DOUBLE, 1) * least((secs - t) / 0.45::DOUBLE, 1), 0) * (sin(2 * pi() * pitch * t) + 0.45::DOUBLE * sin(2 * pi() * pitch * 1.25::DOUBLE * t)) / 1.45::DOUBLE)::BIGINT AS sample FROM t""")
def tone_samples(s, d):
    p = papers(s, d).where("abstract <> ''")
    secs, pitch = audio.clip_seconds(F.col("abstract")), audio.base_pitch(F.col("title"))
    return p.select("id", F.round(secs, 4).alias("secs"), pitch.cast("long").alias("pitch"), audio.sample_at(F.lit(3000), secs, pitch).cast("long").alias("sample"))


_SAMPLES = rf"list_transform({_WORDS}, lambda w: length(w) * 211 * (doc_id % 30 + 1) - 900)"


@query(f"""WITH w AS (SELECT doc_id, {_SAMPLES} AS x FROM documents), r AS (SELECT doc_id, x, 20 * log10(sqrt(list_sum(list_transform(x, lambda v: least(greatest(v, -32768), 32767)::DOUBLE * least(greatest(v, -32768), 32767))) / len(x)) / 32768::DOUBLE) AS db FROM w WHERE len(x) > 0)
SELECT doc_id, round(db, 4) AS loudness, round(greatest(least(-16 - db, 8), -8), 4) AS gain FROM r""")
def loudness_gain(s, d):
    """The words' lengths as the samples of a clip."""
    x = F.transform(text.words(F.col("text")), lambda w: F.greatest(F.least(F.length(w) * 211 * (F.col("doc_id") % 30 + 1) - 900, F.lit(32767)), F.lit(-32768)).cast("smallint"))
    rows = docs(s, d).select("doc_id", x.alias("x")).where(F.size("x") > 0).select("doc_id", audio.dbfs(F.col("x")).alias("db"))
    return rows.select("doc_id", F.round("db", 4).alias("loudness"), F.round(audio.gain(F.col("db")), 4).alias("gain"))


_SEARCH = "[" + ", ".join(f"'{t}'" for t in [*TERMS, *TOPICS]) + "]"
_RUN_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"
_LONG = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda w: length(w) > 4))"


@query(
    rf"""WITH {_AFFINITY}, {CHUNKS},
cand AS (SELECT p.*, d.text AS body, len(list_filter({_SEARCH}, lambda t: contains(lower(title || ' ' || abstract || ' ' || array_to_string(categories, ' ') || ' ' || d.text), t))) > 0 AS hit FROM papers p JOIN documents d ON d.doc_id = p.id ORDER BY hit DESC, id LIMIT 6),
raw AS (SELECT id, sum(coalesce(score, 0)) AS raw FROM (SELECT id, unnest(list_distinct(list_filter(string_split_regex({_HAY}, '[^a-zA-Z0-9]+'), lambda t: length(t) >= 3))) AS term FROM cand) LEFT JOIN affinity USING (term) GROUP BY id),
top AS (SELECT cand.*, {_SCORE} least({_HITS} / 6::DOUBLE + CASE WHEN raw <= 0 THEN 0 ELSE least(raw / 4, 1) END, 1) AS score FROM cand JOIN raw USING (id) ORDER BY score DESC, id LIMIT 3),
ch AS (SELECT doc_id AS id, chunk_index AS c, array_to_string(w, ' ') AS content FROM chunks WHERE doc_id IN (SELECT id FROM top)),
tb AS (SELECT id, c, ('0x' || left(sha256(t), 8))::BIGINT % 48 AS b, count(*) AS n FROM (SELECT id, c, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS t FROM ch) GROUP BY ALL),
qb AS (SELECT id, ('0x' || left(sha256(t), 8))::BIGINT % 48 AS b, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(title || ' ' || abstract), '[a-z0-9]+')) AS t FROM top) GROUP BY ALL),
dn AS (SELECT id, c, sum(tb.n * qb.n) / (any_value(ql.l) * any_value(cl.l)) AS s FROM tb JOIN qb USING (id, b) JOIN (SELECT id, sqrt(sum(n * n)) AS l FROM qb GROUP BY 1) ql USING (id) JOIN (SELECT id, c, sqrt(sum(n * n)) AS l FROM tb GROUP BY 1, 2) cl USING (id, c) GROUP BY id, c),
rk AS (SELECT ch.*, row_number() OVER (PARTITION BY id ORDER BY coalesce(s, 0) + 0.16::DOUBLE DESC, c) AS rank FROM ch LEFT JOIN dn USING (id, c)),
last AS (SELECT id, arg_max(content, rank) AS results FROM rk WHERE rank <= 10 GROUP BY id),
said AS (SELECT top.*, 'If you care about the entre, ment que, src1 and, today''s paper is interesting because ' || {_sentence('abstract')} || ' The paper, titled ' || title || ', focuses on a practical bottleneck in modern AI systems. ' || {_sentence('abstract')} ||
  ' The main takeaway is that ' || {_sentence('results')} || ' Under the hood, the authors use a relatively simple idea: ' || {_sentence('abstract')} || ' What makes it worth watching next is the broader implication. ' || {_sentence('abstract')} ||
  ' For a daily podcast format, that means the work is both technically credible and easy to map to where the field may move next.' AS script FROM top JOIN last USING (id)),
held AS (SELECT id, {_LONG.format("string_agg(content, ' ')")} AS y FROM ch GROUP BY id),
qa AS (SELECT said.*, len(list_intersect({_LONG.format("script")}, y)) / greatest(len({_LONG.format("script")}), 1)::DOUBLE >= 0.3::DOUBLE AS ok, {_RUN_WORDS.format("script")} AS ws, sha256(id::VARCHAR) AS paper FROM said JOIN held USING (id))
SELECT sha256(paper || '#{NOW}') AS id, paper AS paper_id, title || ': Audio Brief' AS title, CASE WHEN array_to_string(ws[1:40], ' ') LIKE '%.' THEN array_to_string(ws[1:40], ' ') ELSE array_to_string(ws[1:40], ' ') || '...' END AS description,
  'the entre' AS topic, round(score, 4) AS score, script, CASE WHEN ok THEN 'verified' ELSE 'flagged' END AS qa_status,
  CASE WHEN ok THEN '{compose.NOTES["verified"]}' ELSE '{compose.NOTES["flagged"]}' END AS qa_notes, greatest(trunc(len(ws)::DOUBLE / 155::DOUBLE * 60)::INT, 60)::INT AS duration_secs, 'demo' AS tts_provider, '{NOW}' AS created_at, id::VARCHAR AS arxiv_id FROM qa"""
)
def pipeline_end_to_end(s, d):
    """The whole run, with native fallbacks for every provider."""
    from lectern.plans.pipeline import episodes_from_tables

    return episodes_from_tables(s, d)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{key}', {len(sections) + 1}::INT, {sum(len(x.split()) for x in [abstract, *sections.values()])}::BIGINT, {count}::INT, {velocity}::DOUBLE, '{at}')" for key, _, _, _, at, count, velocity, abstract, sections in catalog.PAPERS) + ") AS t(arxiv_id, sections, n_words, citation_count, citation_velocity, published_at)")
def catalog_scan(s, d):
    rows = catalog.catalog(s)
    words = F.aggregate(F.transform(F.map_values("sections"), lambda x: F.size(text.words(x))), F.lit(0), lambda a, n: a + n)
    return rows.select("arxiv_id", F.size("sections").alias("sections"), words.cast("long").alias("n_words"), "citation_count", "citation_velocity", "published_at")


@query("""WITH first AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), second AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT o_custkey::VARCHAR AS arxiv_id, coalesce(second.k, first.k)::VARCHAR AS title, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS feedback FROM first FULL JOIN second USING (o_custkey)""")
def store_round_trip(s, d):
    """Two upserts and two appends through a store, read back."""
    from lectern.sources.schema import PAPERS as LAYOUT
    from lectern.sources.store import Store

    store = Store(s, shared_dir(s))
    o = table(s, d, "orders")
    empty = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in LAYOUT.split(", ")}
    for rows in (o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'")):
        latest = rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
        made = empty | {"id": F.col("k").cast("string"), "arxiv_id": F.col("o_custkey").cast("string"), "title": F.col("k").cast("string")}
        store.upsert("papers", latest.select(*[c.alias(n) for n, c in made.items()]))
    events = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("e").alias("episode_id"), F.lit("play").alias("event_type"), F.lit(0).alias("position_secs"), F.lit("2024").alias("created_at"))
    for odd in (0, 1):
        total = store.add_feedback(events.where(F.col("id").cast("long") % 2 == odd))
    return store.read("papers").select("arxiv_id", "title", F.lit(total).cast("long").alias("feedback"))


@query("""WITH changed AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS status, round(o_totalprice * 100)::BIGINT + CASE WHEN o_orderstatus = 'P' THEN 100 ELSE 0 END AS cents, o_orderdate, o_orderstatus FROM orders)
SELECT o_orderkey AS key, status, cents FROM changed WHERE NOT (o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1998-01-01')""")
def keyed_deltas(s, d):
    """All orders, an upsert of some, a write that fails before its commit, deletions, a compaction and one more upsert."""
    from lectern.sources.deltas import KeyedTable

    held = KeyedTable(s, shared_dir(s), "key long, status string, cents long", "key")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderdate")
    held.upsert(o)
    held.upsert(o.where("status = 'P'").withColumn("cents", F.col("cents") + 100))
    held._written(o.where("status = 'F'").select("key", F.lit("lost").alias("status"), "cents", F.lit(False).alias("_gone")), 16)
    held.upsert(o.where("status = 'O' and o_orderdate >= timestamp '1998-01-01'"), gone=F.lit(True))
    held.compact()
    held.upsert(held.read().where("status = 'P'").withColumn("status", F.lit("X")))
    return held.read()


def _fed(rows: DataFrame, folder: str, parts: int) -> None:
    """Add rows to a stream's folder as ``parts`` files by time."""
    rows.repartitionByRange(parts, "ts").write.mode("append").parquet(folder)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def feedback_exactly_once(s, d):
    """Events as a stream in two runs, a third of them sent again in the second, and a batch that is run twice."""
    from lectern.streaming import feedback

    at, rows = shared_dir(s), table(s, d, "events").select("event_id", "ts", "user_id", "event_type")
    ddl = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    sent = [rows.where("ts < timestamp_ntz '2024-01-16'"), rows.where("ts >= timestamp_ntz '2024-01-16'"), rows.where("ts between timestamp_ntz '2024-01-10' and timestamp_ntz '2024-01-20'")]
    for part in (sent[:1], sent[1:]):
        for x in part:
            _fed(x, f"{at}/in", 2)
        stream = s.readStream.schema(ddl).option("maxFilesPerTrigger", 3).parquet(f"{at}/in")
        feedback.recorded(stream, f"{at}/log", f"{at}/state", late="60 days").awaitTermination()
    feedback.append_batch(sent[0], f"{at}/log", 0)
    return feedback.log(s, f"{at}/log", ddl).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"WITH {_AFFINITY} SELECT term, round(score, 4) AS score FROM affinity")
def affinity_stream(s, d):
    """The scores of ``affinity_decay`` from a stream in several triggers and two runs, by a table of states."""
    import datetime as dt

    from lectern.sources.deltas import KeyedTable
    from lectern.streaming import affinity as streaming

    at, origin, until = shared_dir(s), dt.datetime(2024, 1, 1), dt.datetime.fromisoformat(NOW)
    rows = events(s, d).select("episode_id", "event_type", "ts")
    topics = papers(s, d).select(F.col("id").alias("episode_id"), F.col("title").alias("topic"))
    held = KeyedTable(s, f"{at}/states", streaming.STATE, "term")
    for part in (rows.where("ts < timestamp_ntz '2024-01-16'"), rows.where("ts >= timestamp_ntz '2024-01-16'")):
        _fed(part, f"{at}/in", 2)
        stream = s.readStream.schema(", ".join(f"{c} {t}" for c, t in rows.dtypes)).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        streaming.accumulated(stream, topics, origin, held, f"{at}/checkpoint", until).awaitTermination()
    return streaming.read_at(held.read(), origin, until).select("term", F.round("score", 4).alias("score"))
