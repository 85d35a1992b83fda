"""Removal of repeated word windows by level-wise doubling.

A window of LENGTH = 20 words goes if the same words also start earlier, by (doc_id, start).  The
levels are 5, 10 and 20 words; each level's hashes are made by pairing those of the level below,
and only what is repeated at one level is looked at on the next:

* 5 words: of each window the least hashed 5-word run is its anchor (leftmost of equals).  Equal
  windows have equal anchors, so a window whose anchor occurs once in the corpus is settled.
  About one word in nine is an anchor; only those are shuffled.  Whole texts are compared on this
  level, too: a later copy of a text is removed whole and goes no further.
* 10 words: both 10-word runs that hold a repeated anchor.
* 20 words: windows whose 10-word runs are all repeated, by 128-bit hashes.  The first of equal
  windows stays, the others are removed.

Positions are numbered through the corpus in order of (doc_id, start), so that "earlier" is one
comparison.  A level sends back to a document what is settled (runs that occur once, first
windows): lists no longer than the text, whatever a run's number of copies.  Groups of equal runs
are only ever counted and minimised, with partial sums before the shuffle; nothing is paired.
Texts are written once, bucketed by document, and every level joins them where they lie.  Buckets
are as many as their bytes ask for, so that what a task holds of a level does not grow with the
corpus; beyond FILES buckets, which is near what a table can have, the levels meet in joins that
sort and spill.  The table and the levels' files are dropped when the result is written, or when it fails.

Cases: null texts have no words; texts below 20 words lose none; rows of one doc_id are parts of
one document, ordered by their text's hash; rows without a doc_id come first, in the order of their
texts' hashes, each a document of its own (ids below -2**62 are refused); an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import release, remove, session, shared_dir, staged, table

LENGTH, RUN = 20, 5
SEGMENT = 1 << 20
_INDEX = 24
_NO_ID, _LEAST_ID = -(1 << 63), -(1 << 62)
#: Characters of text in a bucket.
BUCKET = 64 << 20
#: Buckets of the table of texts at most.
FILES = 20_000


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def word_hashes(words: list[bytes]):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def paired(a, b, lane: int):
    """Hash of two runs' hashes, element by element."""
    import numpy as np

    x = a * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[lane]) + (b ^ (b >> np.uint64(32))) * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[lane])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def run_hashes(w, length: int, lane: int = 0):
    """Hashes of all runs of ``length`` words: 5 words, then doubled as often as needed."""
    one = w
    two = paired(one[:-1], one[1:], lane)
    four = paired(two[:-2], two[2:], lane)
    h, n = paired(four[:-1], one[4:], lane), RUN
    while n < length:
        h, n = paired(h[:-n], h[n:], lane), 2 * n
    return h


def window_anchors(h5):
    """Of every window, the index of the least of its 16 5-word runs; leftmost of equals."""
    import numpy as np

    out = []
    span = LENGTH - RUN + 1
    for at in range(0, len(h5) - span + 1, SEGMENT):
        part = h5[at : at + SEGMENT + span - 1]
        least = part >> np.uint64(_INDEX) << np.uint64(_INDEX) | np.arange(len(part), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        out.append((least & np.uint64((1 << _INDEX) - 1)).astype(np.int64) + at)
    return np.concatenate(out)


def whole_hash(w) -> tuple[int, int]:
    """128-bit hash of a sequence of word hashes."""
    import xxhash

    x = xxhash.xxh3_128_intdigest(w.tobytes())
    return x >> 64, x & (1 << 64) - 1


def _signed(xs):
    import numpy as np

    return np.asarray(xs, np.uint64).view(np.int64)


def _emit(batches, of_doc, with_facts: bool):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        texts, docs, starts = (batch.column(n).to_pylist() for n in ("text", "doc", "start"))
        facts = zip(*(batch.column(n) for n in ("held", "settled")), strict=True) if with_facts else [(None, None)] * len(texts)
        cols: list[list] = [[], [], [], []]
        for text, doc, start, (held, settled) in zip(texts, docs, starts, facts, strict=True):
            for h1, h2, g in of_doc(text, start, _numbers(held), _numbers(settled)):
                for c, x in zip(cols, (_signed(h1), _signed(h2), g, np.full(len(g), doc, np.int64)), strict=True):
                    c.append(x)
        arrays = [pa.array(np.concatenate(c) if c else np.array([], np.int64), pa.int64()) for c in cols]
        yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "g", "doc"])


def _numbers(scalar):
    import numpy as np

    values = None if scalar is None else scalar.values
    return np.array([], np.int64) if values is None else values.to_numpy(zero_copy_only=False)


def _own(values, start: int, n: int):
    """What of ``values`` lies in the text at ``start``, as positions in it."""
    return values[(values >= start) & (values <= start + n)] - start


def level_five(text, start, held, settled):
    """Anchors, and one row for the whole text with g = -start - 1."""
    import numpy as np

    w = word_hashes(word_list(text))
    if len(w) < LENGTH:
        return
    h5 = run_hashes(w, RUN)
    anchors = np.unique(window_anchors(h5))
    yield h5[anchors], np.zeros(len(anchors), np.uint64), anchors + start
    h1, h2 = whole_hash(w)
    yield np.array([h1], np.uint64), np.array([h2 | 1], np.uint64), np.array([-start - 1])


def level_ten(text, start, held, settled):
    """10-word runs around the anchors that are not settled; one row with g < 0 for a later copy of a text."""
    import numpy as np

    words = word_list(text)
    if len(words) < LENGTH:
        return
    if not (settled == -start - 1).any():
        yield np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.array([-start - 1])
        return
    w = word_hashes(words)
    anchors = np.unique(window_anchors(run_hashes(w, RUN)))
    open_ = np.setdiff1d(anchors, _own(settled, start, len(w)), assume_unique=True)
    at = np.unique(np.concatenate([open_ - RUN, open_]))
    at = at[(at >= 0) & (at <= len(w) - 2 * RUN)]
    if len(at):
        yield run_hashes(w, 2 * RUN)[at], np.zeros(len(at), np.uint64), at + start


def open_windows(w, start: int, held, settled):
    """Starts of the windows whose 10-word runs around the anchor are all repeated."""
    import numpy as np

    live = np.zeros(len(w) + LENGTH, bool)
    live[_own(held, start, len(w))] = True
    live[_own(settled, start, len(w))] = False
    if not live.any():
        return np.array([], np.int64)
    anchors = window_anchors(run_hashes(w, RUN))
    p = np.arange(len(anchors))
    left, right = anchors - RUN >= p, anchors + 2 * RUN <= p + LENGTH
    return p[(~left | live[np.maximum(anchors - RUN, 0)]) & (~right | live[anchors])]


def level_twenty(text, start, held, settled):
    if not (held >= 0).any():
        return
    w = word_hashes(word_list(text))
    p = open_windows(w, start, held, settled)
    if len(p):
        yield run_hashes(w, LENGTH)[p], run_hashes(w, LENGTH, 1)[p], p + start


def kept_words(text, start, held, settled, first) -> tuple[int, list[bytes]]:
    """Number of words of the text, and those that stay."""
    import numpy as np

    words = word_list(text)
    if len(words) < LENGTH or not len(held):
        return len(words), words
    if (held == -start - 1).any():
        return len(words), []
    p = open_windows(word_hashes(words), start, held, settled)
    p = np.setdiff1d(p, _own(first, start, len(words)), assume_unique=True)
    if not len(p):
        return len(words), words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, p, 1)
    np.add.at(edge, p + LENGTH, -1)
    return len(words), [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


_ROWS = "h1 long, h2 long, g long, doc long"


def _level(rows: DataFrame, of_doc) -> DataFrame:
    with_facts = "held" in rows.columns
    return rows.mapInArrow(lambda batches: _emit(batches, of_doc, with_facts), _ROWS)


def numbered(docs: DataFrame, path: str) -> tuple[str, str]:
    """Name of a table of texts (doc_id, doc, start, text), bucketed by doc, and how to join it; start counts characters before the text, and one a text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    own = F.when(F.col("doc_id") >= _LEAST_ID, F.col("doc_id")).otherwise(F.raise_error(F.lit("a doc_id below -2**62")).cast("long"))
    spread = F.shiftrightunsigned(tie, 2) + F.lit(_NO_ID)
    keyed = rows.select("doc_id", F.when(F.col("doc_id").isNull(), spread).otherwise(own).alias("doc"), "text", tie.alias("tie"))
    order = Window.partitionBy("doc").orderBy("tie")
    sizes = keyed.select("doc", "tie", (F.length("text") + 1).cast("long").alias("size")).withColumn("part_no", F.row_number().over(order))
    ranged = sizes.repartitionByRange(F.col("doc"), F.col("part_no")).sortWithinPartitions("doc", "part_no").withColumn("range", F.spark_partition_id())

    def running(batches):
        import itertools

        import pyarrow as pa

        total = 0
        for batch in batches:
            sums = list(itertools.accumulate(batch.column("size").to_pylist(), initial=total))
            total = sums.pop()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc", "part_no", "range", "size")], pa.array(sums, pa.int64())], ["doc", "part_no", "range", "size", "local"])

    local = staged(ranged.mapInArrow(running, "doc long, part_no int, range int, size long, local long"), f"{path}/starts")
    base, rows_ = 0, []
    for r in local.groupBy("range").agg(F.sum("size").alias("size")).orderBy("range").collect():  # one row a range
        rows_.append((r["range"], base))
        base += r["size"]
    bases = spark.createDataFrame(rows_, "range int, base long")
    starts = local.join(F.broadcast(bases), "range").select("doc", "part_no", (F.col("base") + F.col("local")).alias("start"))
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base // BUCKET))
    n = min(wanted, FILES)
    texts = keyed.repartition(n, "doc").withColumn("part_no", F.row_number().over(order)).join(starts, ["doc", "part_no"])
    name = f"lectern_{uuid.uuid4().hex}"
    out = texts.select("doc_id", "doc", "start", "text")
    out.write.mode("overwrite").option("path", f"{path}/texts").option("compression", "zstd").bucketBy(n, "doc").format("parquet").saveAsTable(name)
    return name, "shuffle_hash" if wanted <= FILES else "merge"


def _lists(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("doc").agg(F.collect_list("g").alias(name))


def deduplicated(docs: DataFrame, with_words: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): ``kept`` are the words that stay, joined by blanks (if ``with_words``)."""
    spark = session(docs)
    path = shared_dir(spark)
    name, how = numbered(docs, path)
    try:
        return _deduplicated(spark.table(name), how, path, with_words)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def _deduplicated(texts: DataFrame, how: str, path: str, with_words: bool) -> DataFrame:
    """``deduplicated`` of the table of texts, whose joins have the hint ``how``."""
    spark = texts.sparkSession
    release(spark)

    counted = lambda rows: rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("g").alias("g"), F.max("g").alias("top"), F.min("doc").alias("doc"))
    groups = counted(_level(texts, level_five))
    first_text = F.when((F.col("h2") != 0) & (F.col("top") < 0), F.col("top"))
    settled = groups.select("doc", F.when(first_text.isNotNull(), first_text).when(F.col("n") == 1, F.col("g")).alias("g")).where("g is not null")
    five = staged(_lists(settled, "settled"), f"{path}/five")
    release(spark)

    none = F.array().cast("array<long>").alias("held")
    rows = staged(_level(texts.join(five.hint(how), "doc", "left").select("doc", "start", "text", none, "settled"), level_ten), f"{path}/ten")
    once = counted(rows.where("g >= 0")).where("n = 1").select("doc", "g")
    marked = rows.select("doc", "g", F.lit(0).alias("k")).union(once.select("doc", "g", F.lit(1).alias("k")))
    of = lambda k: F.collect_list(F.when(F.col("k") == k, F.col("g")))
    ten = staged(marked.groupBy("doc").agg(of(0).alias("held"), of(1).alias("settled")), f"{path}/lists")
    remove(spark, f"{path}/five")
    release(spark)

    facts = texts.join(ten.hint(how), "doc", "left").select("doc_id", "doc", "start", "text", "held", "settled")
    firsts = counted(_level(facts, level_twenty)).select("doc", "g")
    twenty = staged(_lists(firsts, "first"), f"{path}/twenty")
    release(spark)

    def finish(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            lists = zip(*(batch.column(n) for n in ("held", "settled", "first")), strict=True)
            for doc_id, text, start, (held, settled, first) in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "start")), lists, strict=True):
                n, words = kept_words(text, start, _numbers(held), _numbers(settled), _numbers(first))
                joined = b" ".join(words)
                out.append((doc_id, n, n - len(words), hashlib.sha256(joined).hexdigest(), joined.decode()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    full = facts.join(twenty.hint(how), "doc", "left").select("doc_id", "start", "text", "held", "settled", "first")
    out = full.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    out = staged(out if with_words else out.drop("kept"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), with_words=False)


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(ws[i : i + {LENGTH - 1}], ' ') AS run
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {LENGTH - 2})) AS i FROM d WHERE len(ws) >= {LENGTH})),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM again, (SELECT unnest(range({LENGTH})) AS k)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
