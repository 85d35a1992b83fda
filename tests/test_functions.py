"""Hand-computed values and edge cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import audio, text, times, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(s):
    return F.lit(s).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "function, given, expected",
    [
        (text.topic_terms, "Éa été_ab the THE x1y", ["the", "x1y"]),
        (text.topic_terms, None, []),
        (text.search_terms, "  Big data ", ["big", "data", "big data"]),
        (text.embed_tokens, "A b-2 b", ["a", "b", "2", "b"]),
        (text.sparse_tokens, "Été no foo_bar été", ["été", "foo", "bar", "été"]),
        (text.words, "a b  c", ["a", "b", "c"]),
        (text.words, "", []),
        (text.first_sentence, "  Hello there. Next.", "Hello there."),
        (text.first_sentence, ".x", "."),
        (text.slug, "My Feed!", "my-feed"),
        (text.slug, "--A__b--", "a-b"),
        (text.slug, "!!!", ""),
        (text.joined_lines, "re-\nturn  to", "return to"),
        (text.description, "one two.", "one two."),
        (text.description, "one two", "one two..."),
        (text.parsed_list, " a, ,b,b ", ["a", "b", "b"]),
        (text.title_clean, "Deep: AUDIO brief", "Deep"),
        (text.xml_escape, "<a & b>", "&lt;a &amp; b&gt;"),
        (text.header_label, "1introduction", "introduction"),
        (text.header_label, "MODEL", "methods"),
        (text.header_label, "References", ""),
        (text.header_label, "Appendix B", ""),
        (text.header_label, "2 introduction", None),
        (text.header_label, "results" + " " * 60, None),
        (text.paragraphs, "", []),
        (text.paragraphs, "a\n\nb", ["a", "b"]),
        (text.paragraphs, "One. Two! Three? Four.", ["One. Two! Three? Four."]),
        (text.paragraphs, "A. B. C. D. E.", ["A. B. C.", "D. E."]),
    ],
)
def test_text(spark, function, given, expected):
    assert value(spark, function(F.lit(given).cast("string"))) == expected


def test_duration_secs(spark):
    for n, secs in ((0, 60), (10, 60), (155, 60), (310, 120)):
        assert value(spark, text.duration_secs(F.lit("w " * n))) == secs


def test_slug_default(spark):
    assert value(spark, text.slug(F.lit("!!!"), "demo")) == "demo"


def test_topic_of(spark):
    none = F.array().cast("array<string>")
    assert value(spark, text.topic_of(none, none)) == "general AI"
    assert value(spark, text.topic_of(none, F.array(F.lit("cs")))) == "cs"


@pytest.mark.parametrize("secs, shown", [(4, "just now"), (59, "59s ago"), (3599, "60m ago"), (-120, "2m from now"), (86400 * 8, "1w ago"), (86400 * 400, "1y ago")])
def test_relative_time(spark, secs, shown):
    assert value(spark, times.relative_time(at("2024-01-01 00:00:00") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(secs))), at("2024-01-01 00:00:00"))) == shown


@pytest.mark.parametrize("secs, shown", [(0, "0m"), (90, "2m"), (3600, "1h"), (3720, "1h2m")])
def test_duration_display(spark, secs, shown):
    assert value(spark, times.duration_display(F.lit(secs))) == shown


def test_times(spark):
    assert value(spark, times.clock_display(F.lit(65))) == "1:05"
    assert value(spark, times.rfc2822(at("2024-03-05 06:07:08"))) == "Tue, 05 Mar 2024 06:07:08 +0000"
    assert value(spark, times.parsed_iso(F.lit("nonsense"))) is None
    assert value(spark, times.parsed_iso(F.lit("2024-01-01T00:00:00Z")) == times.parsed_iso(F.lit("2024-01-01T00:00:00+00:00")))
    assert value(spark, times.age_days(at("2024-01-02 00:00:00"), at("2024-01-01 00:00:00"))) == 0.0
    assert value(spark, times.submitted_clause(at("2024-01-31 00:00:00"), F.lit(0))) == "submittedDate:[202401300000 TO 202401310000]"


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<double>")
    assert value(spark, vectors.cosine(v(1.0, 0.0), v(1.0, 1.0))) == pytest.approx(0.7071, abs=1e-4)
    for a, b in ((v(), v()), (v(1.0), v(1.0, 2.0)), (v(0.0), v(1.0))):
        assert value(spark, vectors.cosine(a, b)) == 0.0


def test_hash_embedding(spark):
    import hashlib
    import math

    expected = [0.0] * 48
    for t in ("a", "b", "a"):
        expected[int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % 48] += 1
    n = math.sqrt(sum(x * x for x in expected))
    assert value(spark, vectors.hash_embedding(F.lit("A b, a"))) == [x / n for x in expected]
    assert value(spark, vectors.hash_embedding(F.lit("")))== [0.0] * 48


def test_audio(spark):
    samples = value(spark, audio.tone(F.lit("w " * 10), F.lit("abcde")))
    assert len(samples) == int(2.5 * 22_050) and samples[0] == 0
    assert value(spark, audio.gain(F.lit(-40.0))) == 8.0
    assert value(spark, audio.gain(F.lit(float("-inf")))) == 0.0
    assert value(spark, audio.faded(F.array(F.lit(1000).cast("smallint"), F.lit(1000).cast("smallint"))))[0] == 0


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 37])
def test_range_index(spark, n):
    from bisect import bisect_right

    from lectern.functions.ranges import range_index

    bounds = [3 * i for i in range(n)]
    got = spark.range(-2, 120).select("id", range_index(bounds, F.col("id")).alias("x")).collect()
    assert all(r["x"] == bisect_right(bounds, r["id"]) for r in got)


@pytest.mark.parametrize("parts", [1, 5, 256, 3000])
def test_spread(spark, parts):
    import random

    from lectern.functions.ranges import spread

    r = random.Random(1)
    ids = [int(10 ** r.uniform(0, 15)) for _ in range(3000)] + [-5, None]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {x["id"]: x["r"] for x in rows.select("id", spread(rows, F.col("id"), parts).alias("r")).collect()}
    assert got.pop(None) == -1
    order = [got[i] for i in sorted(got)]
    assert order == sorted(order) and order[0] >= 0
    assert max(map(order.count, set(order))) <= max(3000 * 6 / parts, 40)
    assert spark.range(1).select(spread(rows.limit(0), F.lit(1), 3).alias("r")).first()["r"] == -1


def test_hash_embedding_is_made_once_a_chunk(spark, data):
    """One evaluation for the chunks and one for the questions: none for the flag that every chunk has a vector."""
    from lectern.plans.queries import QUERIES

    plan = QUERIES["retrieve_mode_switch"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "é ?", "A b, a", "K \u0130x " + "word " * 3000])], "i int, t string")
    sizes = [(r["i"], round(sum(x * x for x in r["v"]), 9)) for r in rows.select("i", vectors.hash_embedding(F.col("t")).alias("v")).collect()]
    assert sorted(sizes) == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 1.0), (4, 1.0)]
