"""Least-recently-used eviction as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.prefix import running

CAP = 500 * 1024 * 1024
STEPS, FEW = 1024, 20_000


def evicted(files: DataFrame, cap: int = CAP, order: str = "mtime", key: str = "key") -> DataFrame:
    """Files (key, size, mtime) to delete: oldest first, while the rest exceeds ``cap``; ties go by key.

    A file goes if it and all newer files exceed the cap.  That is all files before some moment,
    which is narrowed down by sums over STEPS equal spans of time, a pass each: only partial sums are
    shuffled, and a row a span goes to the driver.  Running sums (``prefix``) are made for the last span alone,
    which has at most FEW files, or those of one microsecond, however many.
    """
    at = F.unix_micros(F.col(order).cast("timestamp"))
    rows = files.withColumn("_at", F.coalesce(at, F.lit(0).cast("long")))
    edge = rows.agg(F.min("_at"), F.max("_at"), F.count("*")).first()
    if not edge[2]:
        return files.limit(0)
    (low, high, n), newer = edge, 0
    while n > FEW and high > low:
        width = -(-(high - low + 1) // STEPS)
        span = F.floor((F.col("_at") - low) / width).cast("int").alias("span")
        sums = rows.where(F.col("_at").between(low, high)).groupBy(span).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()  # a row a span
        for r in sorted(sums, key=lambda r: -r["span"]):
            if newer + r["s"] > cap:
                low, high, n = low + r["span"] * width, min(high, low + (r["span"] + 1) * width - 1), r["n"]
                break
            newer += r["s"]
        else:
            return rows.where(F.col("_at") < low).select(*files.columns)
    edge = rows.where(F.col("_at").between(low, high)).withColumnRenamed("_at", "at_")
    last = running(edge, [], [F.col("at_").desc(), F.col(key).desc()], {"rest_": F.col("size")}).where(F.col("rest_") + newer > cap)
    return rows.where(F.col("_at") < low).select(*files.columns).union(last.select(*files.columns))


def total_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
