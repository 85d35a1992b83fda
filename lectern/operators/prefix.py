"""Prefix sums over ordered groups, in two levels, with no window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.shared import staged


def running(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None, path: str | None = None) -> DataFrame:
    """``rows`` with a column for each of ``sums`` and ``xors``: the sum, or the exclusive or, of that
    value over the rows of the group up to and with this one.

    ``order`` should be total; rows that it cannot tell apart come in any order.  Null values count
    as 0, a null key is a group of its own, no rows give no rows; ``rows`` has no columns that begin with ``_``.

    Rows are dealt out by ranges of (group, order), so that a group of any size, and equal times
    without end, spread over as many ranges as they need.  Windows run inside a range; a range has one
    row a group with its totals, and these are summed over a group's ranges and joined back.  The
    dealt rows are written to ``path``, by default in the shared folder, which fixes their ranges.
    """
    sums, xors = sums or {}, xors or {}
    names = [*sums, *xors]
    kinds = [F.sum] * len(sums) + [F.bit_xor] * len(xors)
    values = [F.coalesce(v, F.lit(0)).alias(f"_v{i}") for i, v in enumerate([*sums.values(), *xors.values()])]
    dealt = rows.select("*", *values).repartitionByRange(*map(F.col, group), *order)
    ranged = staged(dealt.withColumn("_range", F.spark_partition_id()), path)

    within = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[kind(f"_v{i}").over(within).alias(f"_l{i}") for i, kind in enumerate(kinds)])
    totals = ranged.groupBy("_range", *group).agg(*[kind(f"_v{i}").alias(f"_t{i}") for i, kind in enumerate(kinds)])
    bases = totals.select(
        F.col("_range").alias("_of"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], *[kind(f"_t{i}").over(before).alias(f"_b{i}") for i, kind in enumerate(kinds)]
    ).where("_b0 is not null")
    same = F.col("_range") == F.col("_of")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    base = [F.coalesce(F.col(f"_b{i}"), F.lit(0)) for i in range(len(names))]
    out = [(F.col(f"_l{i}") + base[i] if kind is F.sum else F.col(f"_l{i}").bitwiseXOR(base[i])).alias(names[i]) for i, kind in enumerate(kinds)]
    return local.join(bases, same, "left").select(*rows.columns, *out)
