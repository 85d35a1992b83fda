"""Near-duplicate groups by SimHash fingerprints and covering locality-sensitive hashing.

Every bit position gets a non-zero vector of radius + 1 bits.  A table belongs to each non-zero
vector v and keeps the positions whose vector has odd inner product with v.  The at most
``radius`` positions where two fingerprints differ span a proper subspace, so some v is
orthogonal to all of them and the pair meets in that table: no pair is missed.

A radius above RADIUS is covered in halves: of the positions where two fingerprints differ, one half
of all positions holds at most half, so tables over each half at half the radius miss no pair (7 bits: 30 tables).

A bucket of over ``split_above`` fingerprints is dealt out again by a second family over the
positions its table left out.  Two levels fix all but about 15 of 64 bits, so that no group
can grow with the corpus.  Copies are joined to one fingerprint before any table is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import hot_join, session, staged
from lectern.llm.components import components

BITS, SEED, SHINGLE, RADIUS, SPLIT_ABOVE = 64, 42, 3, 3, 4096


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over ``positions`` (2 ** (radius + 1) - 1 of them), as unsigned integers."""
    space = (1 << (radius + 1)) - 1
    return [
        sum(1 << p for k, p in enumerate(positions) if ((k % space + 1) & v).bit_count() % 2)
        for v in range(1, space + 1)
    ]


def tables(positions: list[int], radius: int) -> list[int]:
    """Masks that cover ``radius``, in halves of the positions above RADIUS."""
    if radius <= RADIUS:
        return covering_masks(positions, radius)
    half = len(positions) // 2
    return [m for part in (positions[:half], positions[half:]) for m in tables(part, radius // 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned SimHash of a text: lower-cased A-Z, words, shingles with repeats, XXH64."""
    import numpy as np
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest, n = xxhash.xxh64_intdigest, len(found) - size + 1
        spans = zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    return of_hashes(hashes)


def of_hashes(hashes) -> int:
    """SimHash of an array of unsigned 64-bit hashes, with repeats: a bit is set if over half have it."""
    import numpy as np

    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 8192):
        block = hashes[k : k + 8192].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; null texts and texts without words have fingerprint 0."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [signed(fingerprint(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    session(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def linked(fps, radius: int):
    """For an array of distinct fingerprints: index of the root of each one's component."""
    import numpy as np

    n = len(fps)
    root = np.arange(n)
    if n == 2:
        root[1] = 0 if int(fps[0] ^ fps[1]).bit_count() <= radius else 1
        return root
    left = np.arange(n)
    while len(left):
        start, left = left[0], left[1:]
        queue = [start]
        while queue and len(left):
            near = np.bitwise_count(fps[left] ^ fps[queue.pop()]) <= radius
            if near.any():
                hit = left[near]
                root[hit] = start
                queue.extend(hit.tolist())
                left = left[~near]
    return root


def _bucket_edges(radius: int, split_above: int):
    """Reads rows sorted by bucket; gives star edges, or the rows of a bucket that is too large."""

    def flush(held, deferred, out):
        import numpy as np

        if deferred:
            return
        fps = np.unique(np.concatenate(held)) if len(held) > 1 else np.unique(held[0])
        if len(fps) < 2:
            return
        root = linked(fps, radius)
        for i in np.flatnonzero(root != np.arange(len(fps))).tolist():
            out.append((0, -1, 0, int(fps[root[i]]), int(fps[i])))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def packed(rows):
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            wrap = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64) if len(xs) else [], pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), wrap(cols[3]), wrap(cols[4])],
                ["kind", "t", "bucket", "a", "b"],
            )

        key, held, size, deferred = None, [], 0, False
        for batch in batches:
            t, bucket = batch.column("t").to_numpy(), batch.column("bucket").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            if not len(t):
                continue
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            out: list[tuple] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(t)], strict=True):
                now = (int(t[lo]), int(bucket[lo]))
                if now != key:
                    if size > 1:
                        flush(held, deferred, out)
                    key, held, size, deferred = now, [], 0, False
                held.append(fps[lo:hi].copy())
                size += hi - lo
                if size > split_above:
                    deferred = True
                    for part in held:
                        out.extend((1, now[0], now[1], x, 0) for x in part.tolist())
                    held = []
            yield packed(out)
        out = []
        if size > 1:
            flush(held, deferred, out)
        yield packed(out)

    return run


_EDGES = "kind int, t int, bucket long, a long, b long"


def links(reps: DataFrame, radius: int = RADIUS, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (distinct ``fp``) linked within ``radius``."""
    spark = reps.sparkSession
    first = tables(list(range(BITS)), radius)
    keyed = reps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bucket")) for k, m in enumerate(first)])).alias("x"))
    dealt = keyed.select("fp", "x.t", "x.bucket").repartition("t", "bucket").sortWithinPartitions("t", "bucket")
    found = staged(dealt.mapInArrow(_bucket_edges(radius, split_above), _EDGES))
    edges = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1")
    if large.isEmpty():
        return edges
    finer = []
    for k, m in enumerate(first):
        rest = tables([p for p in range(BITS) if not m >> p & 1], radius)
        finer.append(F.array(*[F.struct(F.lit(k * 1000 + j).alias("t2"), F.col("a").bitwiseAND(F.lit(signed(m | r))).alias("b2")) for j, r in enumerate(rest)]))
    again = large.select(F.col("a").alias("fp"), F.explode(F.element_at(F.array(*finer), F.col("t") + 1)).alias("x"))
    dealt = again.select("fp", F.col("x.t2").alias("t"), F.col("x.b2").alias("bucket")).repartition("t", "bucket").sortWithinPartitions("t", "bucket")
    return edges.union(staged(dealt.mapInArrow(_bucket_edges(radius, 1 << BITS), _EDGES)).select("a", "b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of ``radius`` bits or fewer.

    Null and blank texts share fingerprint 0 and are linked like any other.  Rows repeated under
    one doc_id are given once each.  A null doc_id gets its group's id.  An empty table gives no
    rows.  Columns other than doc_id and text are not read.
    """
    session(docs)
    prints = staged(with_fingerprints(docs))
    reps = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    roots = components(staged(links(reps, radius).distinct()))
    grouped = staged(reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = grouped.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    named = hot_join(grouped.select("fp", "root", F.col("n").alias("rows")), ids, ["root"], grouped.count())
    rows = reps.agg(F.sum("n")).first()[0] or 0
    return hot_join(prints, staged(named.select("fp", "component_id", F.col("rows").alias("n"))), ["fp"], rows).select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    from lectern.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
