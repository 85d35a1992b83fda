"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import remove, shared_dir, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(down: DataFrame) -> DataFrame:
    """Of edges with a > b, repeats included; its result has none."""
    met = down.join(down.groupBy("a").agg(F.min("b").alias("m")), "a")
    ends = F.explode(F.array(F.col("a"), F.col("b")))
    return met.select(ends.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _crossed(edges: DataFrame) -> bool:
    """Whether edges with a > b are no stars yet: a node has two lesser ones, or is both a leaf and a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("leaf")))
    seen = ends.groupBy("node").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("least"))
    return seen.where("n > 1 or (n = 1 and least = 0)").agg(F.count("*")).first()[0] > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the least node reachable.

    No edges give no rows.  The hub of a large star is a hot key of the joins; the side of the minima has one row
    a key, so that adaptive execution can deal a hub's edges out to many tasks.  Every round reads and writes only the edge table, in five
    exchanges and one for the test of its result, as a run on few edges costs as much as it has tasks; nothing goes to the driver but a count.
    """
    spark, path, current = edges.sparkSession, None, edges.select("a", "b").where("a <> b")
    while True:
        after = shared_dir(spark)
        current = staged(_small_star(_large_star(current)), after)
        if path:
            remove(spark, path)
        path = after
        if not _crossed(current):
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
