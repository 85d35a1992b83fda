"""The domain tables as views of the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import HEADER_LIMIT, SECTION_HEADERS, STOP_HEADERS

NOW = "2024-01-31 00:00:00"
TOPICS = ["the entre", "ment que", "src1 and"]
#: Terms of TOPICS.
TERMS = ["the", "entre", "ment", "que", "src1", "and"]


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def head_words(text: Column, n: int) -> Column:
    """First ``n`` words, without cutting the rest of the text."""
    return F.slice(F.filter(F.split(text, r"\s+", n + 2), lambda w: w != ""), 1, n)


def papers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.array_join(head_words(F.col("text"), 8), " ").alias("title"),
        F.array_join(head_words(F.col("text"), 40), " ").alias("abstract"),
        F.array("lang", "source").alias("categories"),
        (F.col("doc_id") % 130 / F.lit(10.0)).alias("velocity"),
        (F.col("n_chars") % 60).alias("citations"),
        (now() - F.make_dt_interval((F.col("doc_id") % 30).cast("int"))).alias("published"),
    )


PAPERS = rf"""papers AS (
  SELECT doc_id AS id, array_to_string(ws[1:8], ' ') AS title, array_to_string(ws[1:40], ' ') AS abstract,
         [lang, source] AS categories, (doc_id % 130)::DOUBLE / 10::DOUBLE AS velocity, n_chars % 60 AS citations,
         TIMESTAMP '{NOW}' - to_days((doc_id % 30)::INT) AS published
  FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM documents))"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """Feedback: episode_id is the user, kinds are mapped from event types."""
    kind = F.col("event_type")
    mapped = F.when(kind == "purchase", "complete").when(kind == "click", "play").when(kind == "error", "skip").when(kind == "view", "pause").otherwise("unknown")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("episode_id"), mapped.alias("event_type"), "ts", "props")


EVENTS = """events_ AS (
  SELECT event_id, user_id AS episode_id, ts, props,
         CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'play' WHEN 'error' THEN 'skip' WHEN 'view' THEN 'pause' ELSE 'unknown' END AS event_type
  FROM events)"""


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """An episode a document; every seventeenth points to a paper that is gone."""
    rows = table(spark, d, "documents")
    doc = F.col("doc_id")
    return rows.select(
        doc.alias("id"),
        F.when(doc % 17 == 0, -doc - 1).otherwise(doc).alias("paper_id"),
        F.array_join(head_words(F.col("text"), 8), " ").alias("title"),
        F.col("source").alias("topic"),
        F.round(F.col("n_chars") % 1000 / 1000.0, 4).alias("score"),
        F.when(doc % 3 == 0, "flagged").otherwise("verified").alias("qa_status"),
        (F.col("n_chars") % 600 + 60).alias("duration_secs"),
        F.date_format(now() - F.make_dt_interval((doc % 30).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )


EPISODES = rf"""episodes_ AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN -doc_id - 1 ELSE doc_id END AS paper_id,
         array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:8], ' ') AS title, source AS topic,
         round((n_chars % 1000)::DOUBLE / 1000::DOUBLE, 4) AS score, CASE WHEN doc_id % 3 = 0 THEN 'flagged' ELSE 'verified' END AS qa_status,
         n_chars % 600 + 60 AS duration_secs, strftime(TIMESTAMP '{NOW}' - to_days((doc_id % 30)::INT), '%Y-%m-%dT%H:%M:%SZ') AS created_at
  FROM documents)"""


#: Header lines, good and bad, that stand in for some lines of a text, as the prose has none.
HEADERS = [
    "Abstract", "1. Introduction", "1introduction", "2 introduction", "2. Related Work", "background", "PRIOR WORK", "3 Methods", "Approach", "12. methodology", "Model", "4. Experiments", "setup", "Evaluation",
    "5 Results", "3. Findings", "result", "Discussion", "6. analysis", "Limitations", "7 limitation", "Conclusions", "8. Summary", "conclusion", "References", "acknowledgement", "Acknowledgements", "Bibliography",
    "Appendix", "appendix B", "Appendix 2", "Results and more", "the methods", "   Results   ", "9.9 results", "7                                                               results",
]


def headed_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ln, line): all lines of all texts, every fifth one in place of a header."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    header = F.element_at(F.array(*map(F.lit, HEADERS)), ((F.col("doc_id") * 7 + F.col("ln")) % len(HEADERS) + 1).cast("int"))
    return rows.withColumn("line", F.when(F.col("ln") % 5 == 0, header).otherwise(F.col("line")))


def _marker() -> str:
    tests = [f"WHEN regexp_matches(line, '{p}') THEN ''" for p in STOP_HEADERS]
    tests += [f"WHEN length(line) <= {HEADER_LIMIT} AND regexp_matches(line, '{p}') THEN '{label}'" for label, p in SECTION_HEADERS]
    return "CASE " + " ".join(tests) + " END"


LINES = rf"""lines AS (
  SELECT doc_id, ln, line, {_marker()} AS marker
  FROM (SELECT doc_id, ln, CASE WHEN ln % 5 = 0 THEN [{", ".join(f"'{h}'" for h in HEADERS)}][(doc_id * 7 + ln) % {len(HEADERS)} + 1] ELSE line END AS line
    FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))"""

CHUNKS = r"""chunks AS (
  SELECT doc_id, i AS chunk_index, ws[i * 86 + 1 : i * 86 + 110] AS w
  FROM (SELECT doc_id, ws, unnest(range(CASE WHEN len(ws) <= 110 THEN 1 ELSE 1 + ceil((len(ws) - 110) / 86.0)::INT END)) AS i
        FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM documents)))"""
