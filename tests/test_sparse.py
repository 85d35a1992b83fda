"""Bounded sparse top-k against the join of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import retrieve, sparse


def joined(rows, queries, k):
    q = retrieve.term_counts(queries, "q", "t").select("q", "token", "tf")
    c = retrieve.term_counts(rows, "c", "t").select("c", "token", "tf")
    top = retrieve.top_k(retrieve.sparse_cosine(q, c).withColumn("key", F.round("similarity", 6)), "q", "key", "c", k)
    return sorted((r["q"], r["rank"], r["c"], round(r["similarity"], 6)) for r in top.collect())


@pytest.mark.parametrize(("most", "slices", "tokens"), [(4096, 64, 1 << 20), (7, 2, 1 << 20), (50, 5, 12)])
def test_equals_the_join(spark, monkeypatch, most, slices, tokens):
    monkeypatch.setattr(sparse, "ROWS", most)
    monkeypatch.setattr(sparse, "QUERIES", 3)
    monkeypatch.setattr(sparse.packed, "__defaults__", (tokens,))
    r = random.Random(most)
    words = [f"w{i:03}" for i in range(60)]
    text = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    rows = [(i, text(r.choice([0, 1, 3, 20, 200]))) for i in range(300)] + [(300, None), (301, ""), (None, "w000 w001")] + [(400 + i, "w010 w011 w012") for i in range(9)]
    queries = [(i, text(6)) for i in range(10)] + [(10, None), (11, "w010 w011 w012"), (12, "unseen words")]
    docs, asked = spark.createDataFrame(rows, "c long, t string").repartition(3), spark.createDataFrame(queries, "q long, t string")
    top = sparse.sparse_topk(docs, asked, 5, "c", "t", "q", "t", slices=slices).collect()
    got = sorted((x["q"], x["rank"], x["c"], round(x["score"], 6)) for x in top)
    assert got == joined(docs.where("c is not null"), asked, 5)
    assert all(0 < x["scored"] <= 309 for x in top)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "c long, t string"), spark.createDataFrame([(1, "some words")], "c long, t string")
    for rows, queries in ((none, one), (one, none), (none, none)):
        assert sparse.sparse_topk(rows, queries, 3, "c", "t", "c", "t").count() == 0


def test_no_shuffle_of_pairs(spark, data):
    from lectern.plans.queries import QUERIES

    plan = QUERIES["sparse_cosine_topk"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") <= 1 and "Generate" not in plan


def test_few_pairs_are_scored_where_texts_differ(spark):
    rows = [(i, " ".join(f"word{j}" for j in range(10 * (i // 64), 10 * (i // 64) + 8 + i // 640))) for i in range(6400)]
    docs = spark.createDataFrame(rows, "c long, t string").coalesce(1)
    asked = docs.where("c % 640 = 0").selectExpr("c as q", "t")
    top = sparse.sparse_topk(docs, asked, 4, "c", "t", "q", "t")
    assert top.groupBy("q").agg(F.max("scored").alias("n")).agg(F.sum("n")).first()[0] < 6400
