"""Keyed upsert over plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(batches: list[DataFrame], key: str, order: str) -> DataFrame:
    """The last row of every key over ``batches`` (oldest first), at the key's first position.

    Columns of the batches and ``position`` (batch, order), the place where the key was first seen.
    """
    marked = [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)]
    rows = reduce(DataFrame.unionByName, marked)
    names = [c for c in rows.columns if c != "_batch"]
    place = F.struct("_batch", order)
    found = rows.groupBy(key).agg(F.max_by(F.struct(*names), place).alias("_row"), F.min(place).alias("position"))
    return found.select("_row.*", "position")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents, key, "left_anti")
