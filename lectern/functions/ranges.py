"""Place of a value among sorted bounds, as a column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_index(bounds: list, value: Column) -> Column:
    """Number of ``bounds`` (sorted) at or below ``value``; compares with about two square roots of them."""
    if not bounds:
        return F.lit(0)
    step = math.ceil(math.sqrt(len(bounds)))
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= value))
    marks = bounds[step - 1 :: step]
    coarse = below(F.array(*map(F.lit, marks)))
    return coarse * step + below(F.slice(F.array(*map(F.lit, bounds)), coarse * step + 1, step))


#: Bounds that a plan holds at most; finer ranges divide these evenly.
MOST_BOUNDS = 256


def spread(rows: DataFrame, value: Column, parts: int) -> Column:
    """About ``parts`` ranges of a whole-number column, in its order and of like sizes; null is -1.

    Quantiles give up to MOST_BOUNDS bounds, and each range between two of them is divided into
    equal widths: one pass over the column, whatever the number of ranges.
    """
    coarse = max(1, min(MOST_BOUNDS, parts))
    fine = math.ceil(parts / coarse)
    found = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.percentile_approx(value, [i / coarse for i in range(1, coarse)] or [0.5], 10 * coarse).alias("cuts")).first()
    if found["low"] is None:
        return F.lit(-1)
    cuts = sorted({c for c in found["cuts"] if c > found["low"]})
    edges = [float(x) for x in (found["low"], *cuts, found["high"])]
    index = range_index(cuts, value)
    if fine == 1:
        return F.when(value.isNull(), -1).otherwise(index)
    at = F.array(*map(F.lit, edges))
    low, high = F.get(at, index), F.get(at, index + 1)
    inside = F.floor((value.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * fine)
    return F.when(value.isNull(), -1).otherwise(index * fine + F.least(inside, F.lit(fine - 1)).cast("int"))
