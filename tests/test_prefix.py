"""Two-level prefix sums against a plain loop."""

import random

from pyspark.sql import functions as F

from lectern.operators import prefix


def plain(rows):
    total, seen, out = {}, {}, {}
    for g, at, key, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        total[g] = total.get(g, 0) + (v or 0)
        seen[g] = seen.get(g, 0) ^ (v or 0)
        out[key] = (total[g], seen[g])
    return out


def test_groups_and_ties(spark):
    r = random.Random(3)
    hot = [("hot", 5, k, r.randrange(100)) for k in range(3000)]  # one group, all times equal
    rows = hot + [(r.choice(["a", "b", None]), r.randrange(9), 3000 + k, r.choice([None, 1, 2, 70])) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, at int, key int, v long").repartition(5)
    got = prefix.running(df, ["g"], [F.col("at"), F.col("key")], {"total": F.col("v")}, {"mark": F.col("v")})
    assert got.columns == ["g", "at", "key", "v", "total", "mark"]
    found = {x["key"]: (x["total"], x["mark"]) for x in got.collect()}
    assert found == plain(rows)


def test_one_group_descending_and_no_rows(spark):
    df = spark.range(0, 5000, 1, 7)
    got = prefix.running(df, [], [F.col("id").desc()], {"n": F.lit(1)}).collect()
    assert {x["id"]: x["n"] for x in got} == {i: 5000 - i for i in range(5000)}
    assert prefix.running(df.limit(0), [], [F.col("id")], {"n": F.lit(1)}).collect() == []


def test_a_group_is_spread_over_many_tasks(spark, tmp_path):
    rows = spark.range(20_000).select(F.lit(1).alias("g"), F.lit(0).alias("at"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        prefix.running(rows, ["g"], [F.col("at"), F.col("id")], {"n": F.lit(1)}, path=f"file://{tmp_path}/p").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [x["count"] for x in spark.read.parquet(f"file://{tmp_path}/p").groupBy("_range").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 5000


def test_eviction_of_files_of_one_moment(spark):
    import datetime as dt

    from lectern.operators import cache

    at = dt.datetime(2024, 1, 1)
    files = spark.range(30_000).select(F.format_string("%06d", "id").alias("key"), F.lit(10).cast("long").alias("size"), F.lit(at).alias("mtime"))
    gone = cache.evicted(files, 1000)
    assert {x["key"] for x in gone.collect()} == {f"{i:06d}" for i in range(29_900)}


def test_index_runs_over_groups(spark):
    from lectern.operators import listing

    rows = spark.createDataFrame([("b", 2), ("a", 9), ("b", 1), (None, 7), ("a", 3)], "g string, k int")
    assert [(x["g"], x["k"], x["index"]) for x in listing.running_index(rows, "g", "k").orderBy("index").collect()] == [(None, 7, 0), ("a", 3, 1), ("a", 9, 2), ("b", 1, 3), ("b", 2, 4)]
