"""Approximate nearest neighbours: an inverted file over centroids.

There are about as many lists as the square root of the rows (at most MOST_LISTS), so that lists
grow as slowly as their number.  Centroids are fitted on a bounded sample drawn by hash; every row
is indexed under its nearest one.  A query looks into the lists of its nearest centroids; how many
is set by recall, measured against all rows for a bounded set of queries.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.dense import dense_topk, listed_topk

MOST_LISTS, SAMPLE, ROUNDS, QUERIES, RECALL = 4096, 20_000, 8, 200, 0.95


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows by the hash of their id; never more than twice as many."""
    total = rows.count()
    u = F.shiftrightunsigned(F.xxhash64("vec_id"), 11) * F.lit(2.0**-53)
    return rows.where(u * F.lit(float(max(total, 1))) < most).limit(2 * most)


def centroids(rows: DataFrame, lists: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> list[list[float]]:
    """Unit centroids of a sample of vectors (vec_id, v), by rounds of spherical k-means."""
    import numpy as np

    lists = lists or min(MOST_LISTS, max(1, math.ceil(math.sqrt(rows.count()))))
    held = sorted((r["vec_id"], r["v"]) for r in _drawn(rows, sample).select("vec_id", "v").collect())  # at most twice the sample
    x = np.array([v for _, v in held], float)
    if not len(x):
        return []
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[np.random.default_rng(0).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.bincount(near, minlength=len(c))[:, None] > 0, sums, c)
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.tolist()


def placed(rows: DataFrame, fitted: list[list[float]], n: int) -> DataFrame:
    """(list, vec_id, v): each row under its ``n`` nearest centroids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = np.array(fitted, np.float32)
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch.column("v").to_pylist(), np.float32)
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n]
            at = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), batch.column("vec_id").take(at), batch.column("v").take(at)], ["list", "vec_id", "v"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "list int, vec_id long, v array<double>")


def indexed(rows: DataFrame, fitted: list[list[float]]) -> DataFrame:
    """(list, vec_id, v)."""
    return placed(rows, fitted, 1)


def search(index: DataFrame, queries: DataFrame, fitted: list[list[float]], k: int, probes: int) -> DataFrame:
    """(q, c, rank, similarity): the best ``k`` rows of the probed lists for each query (vec_id, v)."""
    return listed_topk(index, placed(queries, fitted, probes), k)


def probes_for(rows: DataFrame, index: DataFrame, queries: DataFrame, fitted: list[list[float]], k: int, recall: float = RECALL, sample: int = QUERIES) -> int:
    """The least number of probes, doubled from 1, that finds ``recall`` of the true best ``k`` of a sample of the queries."""
    some = _drawn(queries, sample)
    true = dense_topk(rows, some, k).select("q", "c").persist()
    whole, probes = true.count(), 1
    while probes < len(fitted) and search(index, some, fitted, k, probes).join(true, ["q", "c"], "left_semi").count() < recall * whole:
        probes *= 2
    true.unpersist()
    return min(probes, max(len(fitted), 1))
