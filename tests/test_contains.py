"""Containment by grams against ``in``."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import contains


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_substring_search(spark, block):
    r = random.Random(block)
    some = lambda n: "".join(r.choices("abc é𝄞.", k=n))
    texts = [(i, some(r.randrange(40))) for i in range(150)] + [(150, None), (151, ""), (None, "abc"), (152, "Abc ABC"), (152, "Abc ABC"), (153, "a" * 50_000)]
    terms = [some(n) for n in (1, 2, 3, 3, 4, 4, 5, 6, 8) for _ in range(4)] + [None, "", "ABC", "abc", "zzz", "a" * 60]
    got = contains.contained(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([(t,) for t in terms], "w string"), "w", block)
    want = sorted((i, w) for i, t in texts if i is not None and t for w in {w.lower() for w in terms if w} if w in t.lower())
    assert sorted((x["id"], x["term"]) for x in got.collect()) == want


def test_empty_tables_and_clashing_names(spark):
    rows, none = spark.createDataFrame([(1, "some text", 2)], "key long, term string, gram long"), spark.createDataFrame([], "key long, term string, gram long")
    assert contains.contained(rows, "key", "term", none, "term").count() == contains.contained(none, "key", "term", rows, "term").count() == 0
    assert [tuple(x) for x in contains.contained(rows, "key", "term", rows, "term").collect()] == [(1, "some text")]


def test_plan_has_no_nested_loop(spark, data):
    from lectern.plans.queries import QUERIES

    df = QUERIES["term_containment"](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert df.agg(F.sum("hits")).first()[0] > 0


def test_texts_are_not_shuffled(spark, data):
    """What is exchanged are terms and lists of found terms, by text: no text, no gram, no pair."""
    from lectern.plans.queries import docs

    terms = spark.createDataFrame([("the",), ("ment",), ("e",)], "t string")
    found = contains.contained(docs(spark, data), "doc_id", "text", terms, "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanged = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert "SortMergeJoin" not in plan and len(exchanged) == 1 and "key" not in exchanged[0]  # the blocks of terms


def test_terms_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(contains, "PASS", 2)
    rows = spark.createDataFrame([(i, f"x{i} y{i % 7} z") for i in range(50)], "id long, t string")
    terms = [f"{c}{i}" for c in "xy" for i in range(10)]
    got = contains.contained(rows, "id", "t", spark.createDataFrame([(t,) for t in terms], "w string"), "w", 4)
    assert sorted((x["id"], x["term"]) for x in got.collect()) == sorted((i, t) for i in range(50) for t in terms if t in f"x{i} y{i % 7} z")
