"""Sparse top-k of a stated set of queries against all rows, in blocks with bounds.

A row's text becomes the array of its tokens' 64-bit hashes in the scan, and rows are packed into
blocks in the partition they lie in: no token and no pair is shuffled.  Every block of rows meets
every block of queries once, as one row.  The task cuts a block into slices of rows of like length;
a slice has the greatest weight of each token, and these bound what any of its rows can score for a
query.  A slice whose bound lies below the query's k-th score so far in this task is left out, which loses
nothing; k rows a query and a block leave the task.

Two tokens with one hash count as one token: for a billion distinct tokens and 10,000 in the queries
the chance of any such pair is under one in a million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import sparse_tokens

#: Rows and tokens in a block, queries in a block, rows in a slice.
ROWS, TOKENS, QUERIES, SLICE = 4096, 1 << 20, 256, 64
#: Scores are compared at so many decimals; ties go to the smaller id.
DECIMALS = 6
_PACKED = "ids array<bigint>, extra array<double>, sizes array<int>, tokens binary, counts binary, total array<double>"


def packed(rows: DataFrame, most: int, slices: int, tokens: int = TOKENS) -> DataFrame:
    """Blocks of rows (id, extra, hashes): distinct hashes and their counts row by row, by number of distinct hashes.

    ``sizes`` are distinct hashes a row, ``total`` are lengths.  A row of more tokens than a block is a block of its own.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(held):
            held = sorted(held, key=lambda r: (len(r[2]), r[0])) if slices else held
            arrays = [
                pa.array([[r[0] for r in held]], pa.list_(pa.int64())), pa.array([[r[1] for r in held]], pa.list_(pa.float64())), pa.array([[len(r[2]) for r in held]], pa.list_(pa.int32())),
                pa.array([np.concatenate([r[2] for r in held]).tobytes()], pa.binary()), pa.array([np.concatenate([r[3] for r in held]).tobytes()], pa.binary()),
                pa.array([[float(np.sqrt((r[3] * r[3]).sum())) for r in held]], pa.list_(pa.float64())),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["ids", "extra", "sizes", "tokens", "counts", "total"])

        held, size = [], 0
        for batch in batches:
            lists, ids, extra = batch.column("hashes"), batch.column("id").to_pylist(), batch.column("extra").to_pylist()
            for i in range(len(ids)):
                token, count = np.unique(np.asarray(lists[i].values, np.int64), return_counts=True)
                if held and (len(held) >= most or size + len(token) > tokens):
                    yield out(held)
                    held, size = [], 0
                held.append((ids[i], extra[i], token, count.astype(float)))
                size += len(token)
        if held:
            yield out(held)

    return rows.mapInArrow(run, _PACKED)


def _hashed(rows: DataFrame, key: str, text: str, extra: Column) -> DataFrame:
    hashes = F.transform(sparse_tokens(F.col(text)), lambda t: F.xxhash64(t))
    return rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(extra.cast("double"), F.lit(0.0)).alias("extra"), hashes.alias("hashes")).where(F.size("hashes") > 0)


def _best(met: DataFrame, k: int, slices: int) -> DataFrame:
    """(q, c, s, scored): the best ``k`` a query of each pair of blocks; ``scored`` has, on a query's first row, the pairs scored there."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bests: dict[tuple, np.ndarray] = {}  # a query's k best scores so far in this task
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, ids, extra = np.array(r["q_ids"], np.int64), np.array(r["ids"], np.int64), np.array(r["extra"])
                q_of, of = np.repeat(np.arange(len(q_ids)), r["q_sizes"]), np.repeat(np.arange(len(ids)), r["sizes"])
                names, token = np.frombuffer(r["q_tokens"], np.int64), np.frombuffer(r["tokens"], np.int64)
                vocabulary = np.intersect1d(names, token)
                if not len(vocabulary):
                    continue
                place = lambda x: np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
                at_q, at = place(names), place(token)
                in_q, inside = vocabulary[at_q] == names, vocabulary[at] == token
                asked = np.zeros((len(q_ids), len(vocabulary)))
                asked[q_of[in_q], at_q[in_q]] = np.frombuffer(r["q_counts"])[in_q]
                of, at, count = of[inside], at[inside], np.frombuffer(r["counts"])[inside]
                length, q_length = np.array(r["total"]), np.array(r["q_total"])
                best = bests.setdefault((len(q_ids), *r["q_ids"]), np.full((len(q_ids), k), -np.inf))
                scored, found = np.zeros(len(q_ids), np.int64), []
                for first in range(0, len(ids), slices):
                    a, b = np.searchsorted(of, [first, first + slices])
                    cols = np.unique(at[a:b])
                    if not len(cols):
                        continue
                    n = min(slices, len(ids) - first)
                    part = np.zeros((n, len(cols)))
                    part[of[a:b] - first, np.searchsorted(cols, at[a:b])] = count[a:b]
                    here, here_length = asked[:, cols], length[first : first + n]
                    most = here @ (part / here_length[:, None]).max(axis=0) / q_length
                    chosen = np.flatnonzero((most > 0) & (most + extra[first : first + n].max() >= best[:, 0] - 10.0**-DECIMALS))
                    scored[chosen] += n
                    dots = here[chosen] @ part.T  # sums of whole numbers
                    s = np.where(dots > 0, dots / (q_length[chosen, None] * here_length) + extra[first : first + n], -np.inf)
                    q, c = np.nonzero(np.isfinite(s) & (s >= best[chosen, :1] - 10.0**-DECIMALS))
                    found.append((chosen[q], first + c, s[q, c]))
                    best[chosen] = np.sort(np.concatenate([best[chosen], s], axis=1), axis=1)[:, -k:]
                if not found:
                    continue
                q, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((ids[c], -np.round(s, DECIMALS), q))
                q, c, s = q[order], c[order], s[order]
                starts = np.searchsorted(q, q, "left")
                kept = np.arange(len(q)) - starts < k
                q, c, s, starts = q[kept], c[kept], s[kept], (np.arange(len(order)) == starts)[kept]
                arrays = [q_ids[q], ids[c], s, np.where(starts, scored[q], 0)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["q", "c", "s", "scored"])

    return met.mapInArrow(run, "q long, c long, s double, scored long")


def sparse_topk(rows: DataFrame, queries: DataFrame, k: int, key: str, text: str, q_key: str, q_text: str, extra: Column | None = None, slices: int = SLICE) -> DataFrame:
    """(q, c, rank, score, scored): the best ``k`` rows for each query by the cosine of token counts, plus ``extra`` of the row.

    Rows without a token in common with the query are no answers; null keys, null and blank texts give none;
    repeated rows each count; ids of queries are distinct.  ``scored`` is how many pairs were scored for the query.
    """
    nothing = F.lit(0.0)
    here = packed(_hashed(rows, key, text, nothing if extra is None else extra), ROWS, slices)
    asked = packed(_hashed(queries, q_key, q_text, nothing), QUERIES, 0)
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "sizes", "tokens", "counts", "total")])
    found = _best(here.crossJoin(asked), k, slices)  # blocks against blocks
    by_q = Window.partitionBy("q")
    best = by_q.orderBy(F.round("s", DECIMALS).desc(), "c")
    top = found.withColumn("scored", F.sum("scored").over(by_q)).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
    return top.select("q", "c", "rank", F.col("s").alias("score"), "scored")
