"""Removal of repeated byte strings by blockwise suffix sorting with difference covers.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else.  Suffixes matter
to that depth only, and they are sorted in levels, one bucket at a time:

* The first cover sample: a suffix is in it if its place modulo 133 is in a perfect difference set.
  For any two places there is one shift below 133 that takes both into the sample.  So if two windows
  of LENGTH bytes are equal, then so are two sample suffixes in their first 133 places, for
  LENGTH - 132 bytes.  Sample suffixes (12 in 133) are sorted by those bytes; one that meets an equal
  one has a rank that it shares, and a window without such a sample is settled.
* The second cover sample, modulo 31, for LENGTH - 30 bytes: of these suffixes (6 in 31) only those that can lie in
  a window that is not settled.
* Suffixes that are left, about as many as there are repeated bytes, are sorted to depth LENGTH.  One that
  stands beside an equal one is repeated.

A bucket is what shares the first bits of a fingerprint, and has about BUCKET suffixes whatever the
corpus' size; its task sorts one bucket, answers, and forgets it.  In a bucket's task there is no text to
go on comparing, so a suffix brings a fingerprint of all bytes that it is sorted by: 47 bits and
the bucket's for the samples, which only select, and 71 bits and the bucket's for the windows.
That is where this departs from blockwise sorting in one memory, in which a long tie is resolved by looking up the
ranks of the sample suffixes at the tie's common shift: that shift differs from pair to pair, and a
suffix would have to bring all 12 ranks.  Here ranks decide which suffixes can tie at all.

Equal texts are one text, that of the first, which goes whole and still stands for its strings.  Texts are
packed to blocks of about BLOCK bytes, written once and bucketed, so that no text is shuffled again.  A
block sends a string that it holds several times once, marked so; a bucket answers only strings that their
block holds once.  So a string, however frequent, is at most one entry a block, and a bucket that grows is
merged as it is read: equal entries become one.

Cases: null texts are empty; texts below LENGTH bytes lose nothing; rows of one doc_id are texts of
their own, each answered; rows without an id, too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import hot_join, release, remove, session, shared_dir, staged, table

LENGTH = 200
#: Of each level the period and a perfect difference set modulo it (every shift but 0 is
#: the difference of one pair); the last level has all places.
LEVELS = (
    (133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)),
    (31, (1, 5, 11, 24, 25, 27)),
    (1, (0,)),
)
#: Bytes of a block, suffixes of a bucket, suffixes that a task merges at once.
BLOCK, BUCKET, MERGE = 4 << 20, 1 << 18, 1 << 22
#: Places hashed at once, and suffixes of a block that are compared with each other; files of the blocks' table at most.
SEGMENT, GROUP, FILES = (133 * 31) << 6, 1 << 20, 20_000
SEED = 42


class Fingerprints:
    """Rolling fingerprints of byte strings, in two lanes: sums of a value for each byte times odd powers, modulo 2 ** 64."""

    def __init__(self):
        import numpy as np

        rng = np.random.default_rng(SEED)
        self.values = rng.integers(0, 1 << 64, (2, 256), np.uint64)
        size, self.powers, self.inverses = SEGMENT + LENGTH, [], []
        for _ in range(2):
            base = int(rng.integers(0, 1 << 61)) * 8 + 5
            for held, factor in ((self.powers, base), (self.inverses, pow(base, -1, 1 << 64))):
                line = np.full(size, factor, np.uint64)
                line[0] = 1
                held.append(np.cumprod(line))
        self.covers = [np.flatnonzero(np.isin(np.arange(SEGMENT) % period, cover)) for period, cover in LEVELS]

    def of(self, data, length: int, at, lane: int):
        """Fingerprints of the strings of ``length`` bytes at the places ``at``."""
        import numpy as np

        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.values[lane][data] * self.powers[lane][: len(data)], out=sums[1:])
        x = (sums[at + length] - sums[at]) * self.inverses[lane][at]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class Block:
    """Texts that stand together."""

    def __init__(self, prints: Fingerprints, data: bytes, ends: list[int]):
        import numpy as np

        self.prints, self.ends = prints, ends
        self.data = np.frombuffer(data, np.uint8)

    def _slices(self):
        """(start, stop, end of the text): places start to stop of one text, SEGMENT at most."""
        start = 0
        for end in self.ends:
            for a in range(start, end, SEGMENT):
                yield a, min(a + SEGMENT, end), end
            start = end

    def _groups(self, length: int, places, lanes: int):
        """(places, fingerprints of each lane) of the strings of ``length`` at ``places(start, n)``, GROUP at a time.

        ``places`` tells which of the n places from start on are asked for, counted from start.
        """
        import numpy as np

        held, size = [], 0
        for a, b, end in self._slices():
            n = min(b, end - length + 1) - a
            at = places(a, n) if n > 0 else ()
            if len(at):
                view = self.data[a : min(b + length - 1, end)]
                held.append((at + a, *[self.prints.of(view, length, at, lane) for lane in range(lanes)]))
                size += len(at)
            if size >= GROUP:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size = [], 0
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def suffixes(self, level: int, ranked):
        """Groups of the places that a level sorts.  ``ranked`` are the places of the level before that share
        their rank; those are asked for that one of these can lie beside in a window."""
        import numpy as np

        period, cover = LEVELS[level][0], self.prints.covers[level]
        if level:
            near = period - 1 + LEVELS[level - 1][0] - 1
            marks = np.zeros(len(self.data) + near + 1, np.int8)
            marks[ranked + (period - 1)] = 1

        def places(a: int, n: int):
            at = cover[: np.searchsorted(cover, n)]
            if not level:
                return at
            held = marks[a : a + n + near]
            sums = np.cumsum(held, dtype=np.int32)
            return at[sums[at + near] - sums[at] + held[at] > 0]

        return self._groups(LENGTH - period + 1, places, 2 if period == 1 else 1)


def told_apart(prints: list):
    """(first, several, twice): places in the group of the first of equal strings, whether the group
    holds each several times, and the places of all strings that it does."""
    import numpy as np

    order = np.argsort(prints[0])
    new = np.ones(len(order), bool)
    new[1:] = prints[0][order[1:]] != prints[0][order[:-1]]
    if len(prints) > 1:
        new[1:] |= prints[1][order[1:]] != prints[1][order[:-1]]
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(order)))
    return order[heads], sizes > 1, order[np.repeat(sizes > 1, sizes)]


def _gaps(places) -> bytes:
    """Rising places: the first, and the differences as their low bytes and, deflated, their high bytes."""
    import zlib

    import numpy as np

    if not len(places):
        return b""
    gaps = np.diff(places)
    low, high = gaps.astype(np.uint8), (gaps >> 8).astype(np.uint64 if gaps.max(initial=0) >= 1 << 16 else np.uint8)
    return len(places).to_bytes(8, "little") + int(places[0]).to_bytes(8, "little") + low.tobytes() + zlib.compress(high.tobytes(), 1)


def _places(blob: bytes):
    import zlib

    import numpy as np

    if not blob:
        return np.empty(0, np.int64)
    n = int.from_bytes(blob[:8], "little") - 1
    places = np.empty(n + 1, np.int64)
    places[0] = int.from_bytes(blob[8:16], "little")
    high = zlib.decompress(blob[16 + n :])
    gaps = np.frombuffer(high, np.uint8 if len(high) == n else np.uint64).astype(np.int64) << 8
    np.cumsum(gaps + np.frombuffer(blob, np.uint8, n, 16), out=places[1:])
    places[1:] += places[0]
    return places


def _sent(block: int, places, prints: list, several, bits: int):
    """Rows (bucket, block, places, head, tail) of a group's strings: 47 bits of one lane, or 63 of one and 8 of the other."""
    import numpy as np

    one, top = np.uint64(1), np.uint64(64 - bits)
    bucket = (prints[-1] >> top).astype(np.int64) if bits else np.zeros(len(places), np.int64)
    order = np.argsort(bucket << 40 | places)
    bucket, places = bucket[order], places[order]
    word = prints[0][order] << one | several[order]
    if len(prints) == 1:
        head, tail = (word & np.uint64(0xFFFFFFFF)).astype(np.uint32), (word >> np.uint64(32)).astype(np.uint16)
    else:
        head, tail = word, prints[1][order].astype(np.uint8)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
        yield int(bucket[a]), block, _gaps(places[a:b]), head[a:b].tobytes(), tail[a:b].tobytes()


def _batch(rows: list, names: str, kinds: list):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names.split())


def _blocks(batch):
    """(block, Block, row) of every row of a batch."""
    prints = _fingerprints()
    for row in batch.to_pylist():
        yield row["block"], Block(prints, row["data"], row["ends"]), row


_HELD: list[Fingerprints] = []


def _fingerprints() -> Fingerprints:
    if not _HELD:
        _HELD.append(Fingerprints())
    return _HELD[0]


_SENT = "bucket long, block long, places binary, head binary, tail binary"


def _send(rows: DataFrame, bits: int, level: int) -> DataFrame:
    """What each block sends to the buckets of a level, and the places that it can answer itself (without head and tail)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for block, held, row in _blocks(batch):
                ranked = np.concatenate([np.empty(0, np.int64), *map(_places, row["ranks"] or ())]) if level else None
                for places, *prints in held.suffixes(level, ranked):
                    first, several, twice = told_apart(prints)
                    out = list(_sent(block, places[first], [p[first] for p in prints], several, bits))
                    own = [(block & ((1 << bits) - 1), block, _gaps(np.sort(places[twice])), None, None)] if len(twice) else []
                    yield _batch(out + own, "bucket block places head tail", kinds)

    return rows.mapInArrow(run, _SENT)


class Bucket:
    """The suffixes of one bucket, merged whenever there are many."""

    def __init__(self):
        self.parts, self.size, self.most = [], 0, MERGE

    def add(self, row: dict) -> None:
        import numpy as np

        tail = np.frombuffer(row["tail"], np.uint8)
        if len(row["head"]) == 2 * len(tail):
            tail = tail.view(np.uint16)
            word, tail = np.frombuffer(row["head"], np.uint32).astype(np.uint64) | tail.astype(np.uint64) << np.uint64(32), np.zeros(len(tail), np.uint8)
        else:
            word = np.frombuffer(row["head"], np.uint64)
        places = _places(row["places"])
        self.parts.append((word >> np.uint64(1), tail, (word & np.uint64(1)).astype(bool), np.full(len(places), row["block"]), places))
        self.size += len(places)

    def answers(self):
        """(block, place) arrays of the suffixes found again; each of them is told once."""
        import numpy as np

        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        word, tail, several, block, places = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(word)
        word, tail, several, block, places = (x[order] for x in (word, tail, several, block, places))
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (tail[1:] != tail[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(word)))
        again = (sizes > 1) | np.logical_or.reduceat(several, heads)
        open_ = np.repeat(again, sizes) & ~several
        several[heads] |= again
        self.parts = [(word[heads], tail[heads], several[heads], block[heads], places[heads])]
        self.size = len(heads)
        self.most = max(MERGE, 2 * self.size)
        return block[open_], places[open_]


def _by_block(found: list):
    """(block, places) of pairs of arrays."""
    import numpy as np

    block, places = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((places, block))
    block, places = block[order], places[order]
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    return [(int(block[a]), _gaps(places[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(block)), strict=True)] if len(cuts) else []


def sorted_buckets(sent: DataFrame) -> DataFrame:
    """(block, places): what the buckets answer to the blocks, in pieces of several buckets."""

    def run(batches):
        import pyarrow as pa

        kinds, at, held, found, size = [pa.int64(), pa.binary()], None, Bucket(), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["head"] is None:
                    yield _batch([(row["block"], row["places"])], "block places", kinds)
                    continue
                if row["bucket"] != at or held.size >= held.most:
                    found.append(held.answers())
                    size += len(found[-1][0])
                    held = Bucket() if row["bucket"] != at else held
                    at = row["bucket"]
                if size >= MERGE:
                    yield _batch(_by_block(found), "block places", kinds)
                    found, size = [], 0
                held.add(row)
        yield _batch(_by_block([*found, held.answers()]), "block places", kinds)

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, places binary")


def _ranks(rows: DataFrame, bits: int, level: int, path: str) -> DataFrame:
    """(block, ranks): the places of a level that share their rank, as pieces."""
    return staged(sorted_buckets(_send(rows, bits, level)).groupBy("block").agg(F.collect_list("places").alias("ranks")), path)


def packed(docs: DataFrame, path: str) -> tuple[str, str, int]:
    """Name of a table of blocks (block, data, ends, t1, t2, n), bucketed by block, how to join it, and the bytes of all texts.

    The texts are the distinct ones of LENGTH bytes or more; n is the number of their copies.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("size") >= LENGTH).select("t1", "t2", F.col("text").cast("binary").alias("data"))
    total = docs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(1, total // BLOCK)
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 16)
    files = min(wanted, FILES)

    def distinct(batches):
        """A task's texts once each, and the number of further copies at its end."""
        import pyarrow as pa

        seen: dict[tuple[int, int], int] = {}
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            kept = []
            for i, key in enumerate(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), strict=True)):
                if key not in seen:
                    kept.append(i)
                seen[key] = seen.get(key, 0) + 1
            part = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([1] * len(kept), pa.int64())], ["t1", "t2", "data", "n"])
        yield _batch([(*k, None, n - 1) for k, n in seen.items() if n > 1], "t1 t2 data n", kinds)

    def pack(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = "block data ends t1 t2 n"

        def row():
            ends, total = [], 0
            for x in texts:
                total += len(x)
                ends.append(total)
            return _batch([(at, b"".join(texts), ends, [k[0] for k in keys], [k[1] for k in keys], counts)], names, kinds)

        at, texts, keys, counts = None, [], [], []
        for batch in batches:
            for block, t1, t2, data, n in zip(*(batch.column(c).to_pylist() for c in ("block", "t1", "t2", "data", "n")), strict=True):
                if block != at:
                    if texts:
                        yield row()
                    at, texts, keys, counts = block, [], [], []
                if not keys or keys[-1] != (t1, t2):
                    keys.append((t1, t2))
                    counts.append(0)
                    texts.append(data)
                counts[-1] += n
        if texts:
            yield row()

    once = rows.mapInArrow(distinct, "t1 long, t2 long, data binary, n long").withColumn("block", F.pmod("t1", F.lit(blocks)))
    dealt = once.repartition(files, "block").sortWithinPartitions("block", "t1", "t2", F.col("data").isNull())
    made = dealt.mapInArrow(pack, "block long, data binary, ends array<long>, t1 array<long>, t2 array<long>, n array<long>")
    name = f"lectern_{uuid.uuid4().hex}"
    small = {"compression": "zstd", "parquet.block.size": str(BLOCK << 2), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    made.write.mode("overwrite").options(path=f"{path}/blocks", **small).bucketBy(files, "block").format("parquet").saveAsTable(name)
    return name, "shuffle_hash" if wanted <= FILES else "merge", total


def removed(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the bytes that stay (their lower-case SHA-256 with ``with_bytes`` false)."""
    spark = session(docs)
    path = shared_dir(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns(
        {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text"), "size": F.octet_length("text").cast("long")}
    )
    name, how, total = packed(rows, path)
    try:
        blocks = spark.table(name)
        release(spark)
        period, cover = LEVELS[0]
        bits = max(0, (total // BUCKET * len(cover) // period).bit_length())
        ranked = blocks
        for level in range(len(LEVELS)):
            ranked = blocks.join(_ranks(ranked, bits, level, f"{path}/ranks{level}").hint(how), "block", "left")
            release(spark)
        kind = "binary" if with_bytes else "string"

        def finish(batches):
            import hashlib

            import numpy as np
            import pyarrow as pa

            kinds = [pa.int64()] * 6 + [pa.binary() if with_bytes else pa.string()]
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    data = np.frombuffer(row["data"], np.uint8)
                    again = np.zeros(len(data), np.int8)
                    for blob in row["ranks"] or ():
                        again[_places(blob)] = 1
                    edge = np.append(again, 0)
                    edge[LENGTH:] -= again[: 1 - LENGTH]
                    gone, start = np.cumsum(edge, dtype=np.int32) > 0, 0
                    for end, t1, t2, n in zip(row["ends"], row["t1"], row["t2"], row["n"], strict=True):
                        here = np.ones(end - start, bool) if n > 1 else gone[start:end]
                        spans = int(np.count_nonzero(here[1:] & ~here[:-1])) + int(here[0])
                        kept = data[start:end][~here].tobytes()
                        out.append((t1, t2, n, end - start, int(here.sum()), spans, kept if with_bytes else hashlib.sha256(kept).hexdigest()))
                        start = end
                yield _batch(out, "t1 t2 n size n_removed n_spans kept", kinds)

        found = staged(ranked.mapInArrow(finish, f"t1 long, t2 long, n long, size long, n_removed long, n_spans long, kept {kind}").drop("size"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)
    whole = F.col("text").cast("binary")
    short = rows.where(F.col("size") < LENGTH).select("doc_id", F.col("size").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), (whole if with_bytes else F.sha2(whole, 256)).alias("kept"))
    long_ = rows.where(F.col("size") >= LENGTH).select("doc_id", F.col("size").alias("n_bytes"), "t1", "t2")
    return hot_join(long_, found, ["t1", "t2"], long_.count()).select(*short.columns).unionByName(short)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"), with_bytes=False).withColumnRenamed("kept", "kept_sha256")


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, k, substr(x, 2 * k + 1, {2 * (256 + LENGTH - 1)}) AS x FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {LENGTH - 1}, 256)) AS k FROM d WHERE length(x) >= {2 * LENGTH})),
w AS (SELECT doc_id, k + j AS i, md5(substr(x, 2 * j + 1, {2 * LENGTH})) AS h FROM (SELECT doc_id, k, x, unnest(range(0, least(256, length(x) // 2 - {LENGTH - 1}))) AS j FROM c)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
marked AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{LENGTH + 1}) > {LENGTH} AS new FROM again),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM marked) GROUP BY doc_id, s),
sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS n_spans FROM spans GROUP BY doc_id),
cuts AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, length(x) // 2, NULL FROM d),
parts AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b NULLS LAST), 0) AS z FROM cuts),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a, z) AS x FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(sums.n, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)"""
