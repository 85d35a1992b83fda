"""Dense top-k of a stated set of queries against all rows, in blocks.

Rows and queries are packed into blocks of vectors.  Every block of rows meets every block of
queries once, as one row; a task multiplies the two and keeps the best ``k`` a query of that block, so that
what leaves it is k rows a query and a block, and never a pair a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.shared import bounded
from lectern.operators.retrieve import top_k

#: Vectors in a block.
BLOCK = 2048
#: Queries of a block that are compared at once, and rows and bytes of an Arrow batch: they bound a worker's memory, whatever the input's size.
STRIP, ROWS, BYTES = 256, 500, 8 << 20
#: Similarities are compared at so many decimals; ties go to the smaller id.
DECIMALS = 6
_PACKED = "list int, ids array<bigint>, size int, vectors binary"


def packed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(list, ids, size, vectors): blocks of rows (list, vec_id, v) of one list; vectors of unit length, row by row.

    Rows must lie sorted by list in their partitions, or all be of one list.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(name, ids, vectors):
            x = np.array(vectors, float)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["list", "ids", "size", "vectors"])

        name, ids, vectors = None, [], []
        for batch in batches:
            for n, i, v in zip(*(batch.column(c).to_pylist() for c in ("list", "vec_id", "v")), strict=True):
                if ids and (n != name or len(ids) >= block or len(v) != len(vectors[0])):
                    yield out(name, ids, vectors)
                    ids, vectors = [], []
                name = n
                ids.append(i)
                vectors.append(v)
        if ids:
            yield out(name, ids, vectors)

    bounded(rows.sparkSession, ROWS, BYTES)
    return rows.select(F.col("list").cast("int").alias("list"), F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, _PACKED)


def best_of(met: DataFrame, k: int) -> DataFrame:
    """(q, c, s) of rows (ids, size, vectors, q_ids, q_size, q_vectors): the best ``k`` of each block for each of its queries."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(c) for c in ("ids", "size", "vectors", "q_ids", "q_size", "q_vectors")]
            for i in range(len(batch)):  # one pair of blocks at a time, read where it lies
                ids, size, body, q_ids, q_size, q_body = (c[i] for c in columns)
                ids, q_ids = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, q_ids))
                order = np.argsort(ids, kind="stable")
                fits = size.as_py() == q_size.as_py()
                if fits:
                    x, q = (np.frombuffer(v.as_buffer()).reshape(len(n), -1) for v, n in ((body, ids), (q_body, q_ids)))
                    x = x[order]
                for at in range(0, len(q_ids), STRIP):
                    scores = q[at : at + STRIP] @ x.T if fits else np.zeros((len(q_ids[at : at + STRIP]), len(ids)))
                    keys = np.where(np.isnan(scores), -np.inf, np.round(scores, DECIMALS))
                    if k < len(ids):  # all that are no worse than the k-th best, in order of their ids
                        least = np.partition(keys, len(ids) - k, axis=1)[:, len(ids) - k, None]
                        rows, cols = np.nonzero(keys >= least)
                    else:
                        rows, cols = (x_.ravel() for x_ in np.indices(keys.shape))
                    by = np.lexsort((cols, -keys[rows, cols], rows))
                    rows, cols = rows[by], cols[by]
                    near = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
                    rows, cols = rows[near], cols[near]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at + rows]), pa.array(ids[order][cols]), pa.array(scores[rows, cols])], ["q", "c", "s"])

    bounded(met.sparkSession, ROWS, BYTES)
    return met.select("ids", "size", "vectors", "q_ids", "q_size", "q_vectors").mapInArrow(run, "q long, c long, s double")


def _asked(queries: DataFrame, block: int) -> DataFrame:
    return packed(queries, block).select("list", F.col("ids").alias("q_ids"), F.col("size").alias("q_size"), F.col("vectors").alias("q_vectors"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(q, c, rank, similarity): the best ``k`` of the blocks' best."""
    top = top_k(found.withColumn("key", F.round("s", DECIMALS)), "q", "key", "c", k)
    return top.select("q", "c", F.col("rank").cast("long").alias("rank"), F.col("s").alias("similarity"))


def dense_topk(rows: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(q, c, rank, similarity): best ``k`` rows by cosine for each of a stated set of queries, all (vec_id, v)."""
    one = F.lit(0).alias("list")
    here = packed(rows.select(one, "vec_id", "v"), block).drop("list")
    return ranked(best_of(here.crossJoin(_asked(queries.select(one, "vec_id", "v"), block).drop("list")), k), k)  # blocks against blocks


def listed_topk(index: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """As ``dense_topk`` where rows and queries (list, vec_id, v) meet only in their lists."""
    gathered = lambda df: df.select("list", "vec_id", "v").repartition("list").sortWithinPartitions("list")
    return ranked(best_of(packed(gathered(index), block).join(_asked(gathered(queries), block), "list"), k), k)
