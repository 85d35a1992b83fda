"""Quality rules: figures of each text, and cross-document line frequency.  DataFrame functions only.

A line is normalised (lower case, single blanks) and hashed.  For every host (``source``) the
distinct documents that hold a line are counted; equal texts are copies and count once.  A line is
over the limit if more than max(MIN_DOCS, SHARE of the host's distinct documents) of them hold it.
Such lines are removed; a document that loses over half of its words, or keeps fewer than half of
MIN_WORDS, is depleted and rejected.

Cases: a null text has no words and fails; null hosts form one host; rows of equal text count
once and get one verdict, rows of one doc_id and different texts each their own; an empty table
gives no rows; columns of other names in the input are kept apart and never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BLANKS, hot_join, let, packed, session, staged, table, unpacked, words

MIN_WORDS, REPEAT_PERCENT = 50, 50
MIN_DOCS, SHARE = 10, 0.001


def repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array ``ws``."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def starts(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        found = let(let(pairs, starts), total)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(found)

    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]))
    return F.when(F.size(ws) < 3, 0).otherwise(let(hashes, covered))


def _figures(text: Column) -> Column:
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    base = let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            (F.length(full) - F.length(F.regexp_replace(full, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(ws).cast("long").alias("n_repeat_words"),
        ),
    )
    return base


def line_key(line: Column) -> Column:
    """64-bit hash of the normalised line."""
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), r"[\x20\x09-\x0D]+", " ")))


def _lines(text: Column) -> Column:
    """Of each line with a word: its key and its number of words."""
    held = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return F.transform(held, lambda x: F.struct(line_key(x).alias("key"), F.size(words(x)).alias("n")))


def _identity(doc_id: Column, source: Column, text: Column) -> list[Column]:
    """doc_id, host and whole: rows that agree in all three get the same verdict."""
    host = F.coalesce(source.cast("string"), F.lit(""))
    return [doc_id.alias("doc_id"), host.alias("host"), F.md5(F.coalesce(text.cast("string"), F.lit(""))).alias("whole")]


def measured(docs: DataFrame) -> DataFrame:
    """Staged: doc_id, host, whole (the text's hash), the base figures and the keys and lengths of the lines."""
    session(docs)
    text = F.col("text").cast("string")
    picked = docs.select(*_identity(F.col("doc_id"), F.col("source"), text), _figures(text).alias("base"), _lines(text).alias("lines"))
    return staged(picked).select("doc_id", "host", "whole", "base.*", "lines")


def excess_lines(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, key, docs, pairs) of the lines above the limit of their host, from ``measured`` rows.

    ``docs`` are distinct documents, ``pairs`` the rows that hold the line.
    """
    once = rows.groupBy("host", "whole").agg(F.first(F.array_distinct(F.col("lines.key"))).alias("keys"), F.count("*").alias("copies"))
    keyed = once.select("host", "copies", F.explode(F.concat(F.array(F.lit(None).cast("long")), "keys")).alias("key"))  # a null key counts the documents themselves
    counts = keyed.groupBy("host", "key").agg(F.count("*").alias("docs"), F.sum("copies").alias("pairs")).where(F.col("key").isNull() | (F.col("docs") > min_docs))
    counts = staged(counts)
    hosts = counts.where("key is null").select("host", F.col("docs").alias("host_docs"))
    often = counts.where("key is not null").join(hosts, "host")
    return often.where(F.col("docs") > F.col("host_docs") * share).select("host", "key", "docs", "pairs")


def _held(rows: DataFrame, excess: DataFrame) -> DataFrame:
    """(doc_id, host, whole, excess): the line keys of each document that are among ``excess``."""
    total = excess.agg(F.sum("pairs")).first()[0] or 0
    pairs = rows.select("doc_id", "host", "whole", F.explode(F.array_distinct(F.col("lines.key"))).alias("key"))
    found = hot_join(pairs, excess.select("host", "key", F.col("pairs").alias("n")), ["host", "key"], total)
    return found.groupBy("doc_id", "host", "whole").agg(F.collect_set("key").alias("excess"))


def judged(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """Per row: doc_id, host, whole, base figures, base_failed, removed_lines, removed_words, kept, excess (line keys)."""
    rows = measured(docs)
    lists = _held(rows, staged(excess_lines(rows, min_docs, share))).select(F.col("doc_id").alias("_doc"), F.col("host").alias("_host"), F.col("whole").alias("_whole"), "excess")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("host") == F.col("_host")) & (F.col("whole") == F.col("_whole"))
    joined = rows.join(lists, same, "left")
    excess = F.coalesce("excess", F.array().cast("array<bigint>"))
    gone = F.filter("lines", lambda x: F.array_contains(excess, x["key"]))
    out = joined.select("*", F.size(gone).cast("long").alias("removed_lines"), F.aggregate(gone, F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((2 * F.col("removed_words") > F.col("n_words")) | (2 * left < MIN_WORDS))
    return out.select(
        "doc_id", "host", "whole", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "removed_lines", "removed_words", (~failed & ~depleted).alias("kept"), excess.alias("excess"),
    )


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """``docs`` without rejected rows and without their lines above the limits; n_chars follows the text.

    Verdicts come back to rows by doc_id, host and text, so that of rows with one doc_id each has its own.
    """
    verdicts = judged(docs, min_docs, share).where("kept").select(F.col("doc_id").alias("_doc"), F.col("host").alias("_host"), F.col("whole").alias("_whole"), "excess")
    kept = verdicts.dropDuplicates(["_doc", "_host", "_whole"])
    rows = packed(docs)
    doc, host, whole = _identity(rows["doc_id"], rows["source"], rows["text"])
    joined = rows.select("r", "text", doc, host, whole).join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("host") == F.col("_host")) & (F.col("whole") == F.col("_whole")))
    fewer = F.array_join(F.filter(F.split("text", "\n"), lambda x: (F.btrim(x, F.lit(BLANKS)) == "") | ~F.array_contains("excess", line_key(x))), "\n")
    new = joined.withColumn("new", F.when(F.size("excess") == 0, F.col("text")).otherwise(fewer))
    return unpacked(new, docs.columns, F.col("new"))


def query(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("host", "whole", "excess")


_W = r"'[^\x20\x09-\x0D]+'"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, md5(coalesce(text, '')) AS whole,
         regexp_extract_all(coalesce(text, ''), {_W}) AS ws
  FROM documents),
tri AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS times
  FROM (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3))),
rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, i + unnest([0, 1, 2]) AS p FROM tri WHERE times > 1) GROUP BY rid),
raw AS (
  SELECT rid, host, whole, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (
  SELECT rid, host, whole, line, len(regexp_extract_all(line, {_W})) AS n,
         lower(array_to_string(regexp_extract_all(line, {_W}), ' ')) AS key
  FROM raw WHERE regexp_matches(line, {_W})),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY rid),
once AS (SELECT DISTINCT host, key, whole FROM ln),
often AS (SELECT host, key, count(*) AS docs FROM once GROUP BY host, key),
hosts AS (SELECT host, count(DISTINCT whole) AS host_docs FROM d GROUP BY host),
bad AS (
  SELECT host, key FROM often JOIN hosts USING (host)
  WHERE docs > {MIN_DOCS} AND docs > host_docs * {SHARE}::DOUBLE),
gone AS (
  SELECT rid, count(*) AS removed_lines, sum(n) AS removed_words
  FROM ln JOIN bad USING (host, key) GROUP BY rid),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(removed_lines, 0)::BIGINT AS removed_lines, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       removed_lines, removed_words,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
       AND NOT (removed_words > 0 AND (2 * removed_words > n_words OR 2 * (n_words - removed_words) < {MIN_WORDS})) AS kept
FROM f"""
