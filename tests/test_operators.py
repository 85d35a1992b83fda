"""Fixtures, edge cases and properties of the operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import affinity, cache, chunks, compose, discover, feed, listing, retrieve, sections, status, upsert
from lectern.plans.pipeline import Run, episodes, ranked
from lectern.sources.catalog import catalog

NOW = dt.datetime(2026, 4, 21)


def now():
    return F.lit("2026-04-21 00:00:00").cast("timestamp_ntz")


def candidates(spark):
    return catalog(spark).withColumn("published", F.col("published_at").cast("timestamp").cast("timestamp_ntz")).withColumn("ord", F.monotonically_increasing_id())


@pytest.mark.parametrize("n, counts", [(0, [0]), (110, [110]), (111, [110, 25]), (196, [110, 110]), (197, [110, 110, 25]), (282, [110, 110, 110])])
def test_chunk_counts(spark, n, counts):
    rows = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "id int, text string")
    got = chunks.chunked(rows, "id", "text").orderBy("chunk_index").collect()
    assert [r["token_count"] for r in got] == counts
    words = got[0]["content"].split() + [w for r in got[1:] for w in r["content"].split()[24:]]
    assert words == [f"w{i}" for i in range(n)]


def test_chunks_with_large_overlap(spark):
    rows = spark.createDataFrame([(1, "a b c d")], "id int, text string")
    got = chunks.chunked(rows, "id", "text", size=2, overlap=5).orderBy("chunk_index").collect()
    assert [r["content"] for r in got] == ["a b", "b c", "c d"]


def test_affinity(spark):
    events = spark.createDataFrame(
        [("e1", "complete", NOW), ("e1", "play", NOW - dt.timedelta(days=7)), ("e1", "skip", NOW - dt.timedelta(days=14)), ("e1", "pause", NOW), ("e2", "complete", NOW + dt.timedelta(days=3)), ("gone", "complete", NOW), ("e3", "complete", NOW), ("e1", "odd", NOW), ("e1", "play", None)],
        "episode_id string, event_type string, ts timestamp_ntz",
    )
    topics = spark.createDataFrame([("e1", "robot robot AI"), ("e2", "future"), ("e3", "")], "episode_id string, topic string")
    got = {r["term"]: r["score"] for r in affinity.scores(events, topics, now()).collect()}
    assert got == {"robot": pytest.approx(1 + 0.5 * math.exp(-1) - 0.4 * math.exp(-2)), "future": pytest.approx(1.0)}
    assert affinity.scores(events.limit(0), topics, now()).count() == 0


def test_boost(spark):
    scores = spark.createDataFrame([("two", 2.0), ("eight", 8.0), ("bad", -1.0)], "term string, score double")
    rows = spark.createDataFrame([(1, "two two"), (2, "eight"), (3, "bad"), (4, "")], "id int, text string")
    got = {r["id"]: r["boost"] for r in affinity.boosts(rows, "id", "text", scores).collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 0.0, 4: 0.0}


def test_enrich(spark):
    got = spark.sql("select * from values (0D, 0), (0D, 10), (4.8D, 7) t(v, c)").select(discover.enriched_velocity(F.col("v"), F.col("c")).alias("x")).collect()
    assert [r["x"] for r in got] == [0.1, 2.0, 4.8]


@pytest.mark.parametrize("age_days, velocity, hits, score", [(2 / 3, 8.4, 1, 0.6993), (2.5, 9.1, 2, 0.6055), (1.3125, 6.3, 1, 0.5631)])
def test_rank_score(spark, age_days, velocity, hits, score):
    published = (now() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(age_days * 86400)))
    terms = ["t1", "t2", "t3", "t4", "t5", "t6"]
    got = spark.range(1).select(discover.rank_score(published, F.lit(velocity), F.lit(" ".join(terms[:hits])), now(), terms, 7).alias("x")).first()["x"]
    assert got == pytest.approx(score, abs=1e-4)


def test_rank_ties_and_empty_topics(spark):
    rows = spark.range(5).select(F.col("id").alias("ord"), F.lit(1.0).alias("s"))
    assert [r["ord"] for r in discover.ranked(rows, F.col("s"), "ord", 3).collect()] == [0, 1, 2]
    assert ranked(candidates(spark), None, Run([]), now()).count() == 3


def test_search_order(spark):
    got = discover.searched(candidates(spark), ["robot"], F.col("title"), "ord", 2).collect()
    assert [r["arxiv_id"] for r in got] == ["2510.31003", "2510.31001"]


def test_sections(spark):
    body = "x" * 61
    lines = ["before", "Abstract", body, "hyphen-", "ated", "References", "dropped", "Results", "r" * 120, "1. Introduction", "i" * 121]
    rows = spark.createDataFrame([(1, "\n".join(lines) + "\nABSTRACT\n" + "y" * 60)], "id int, text string")
    labelled = sections.labelled(sections.lines(rows, "id", "text"), "id")
    got = {r["label"]: r["text"] for r in sections.section_texts(labelled, "id").collect()}
    assert got == {"abstract": f"{body} hyphenated {'y' * 60}", "introduction": "i" * 121}


def test_section_cascade(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in p]) if k else F.create_map().cast("map<string,string>")
    got = lambda given, found: spark.range(1).select(sections.extracted(given, found, F.lit("abs")).alias("x")).first()["x"]
    assert got(m(intro="a" * 201), m(results="b" * 700)) == {"intro": "a" * 201}
    assert got(m(intro="a"), m(results="b" * 700)) == {"results": "b" * 700, "abstract": "abs"}
    assert got(m(intro="a"), m()) == {"intro": "a"}
    assert got(m(), m()) == {"abstract": "abs"}


def test_retrieval_modes(spark):
    rows = spark.createDataFrame(
        [("p", 0, "background", "zzz yyy", [1.0, 0.0]), ("p", 1, "results", "apple pie", [0.0, 1.0]), ("q", 0, "other", "apple apple", []), ("q", 1, "other", "pear", [1.0, 0.0]), ("r", 0, "other", "aaa", [0.0, 0.0]), ("r", 1, "other", "bbb", [1.0])],
        "paper string, c int, section string, content string, embedding array<double>",
    )
    asked = spark.createDataFrame([(p, "apple", [1.0, 0.0]) for p in "pqrz"], "paper string, question string, vector array<double>")
    got = {(r["paper"], r["c"]): (r["rank"], r["dense"], round(r["score"], 4)) for r in retrieve.retrieved(rows, asked, 5).collect()}
    assert got[("p", 0)] == (1, True, 1.0) and got[("p", 1)] == (2, True, 0.16)
    assert got[("q", 0)] == (1, False, 1.0) and got[("q", 1)] == (2, False, 0.0)
    assert got[("r", 0)] == (1, True, 0.0) and got[("r", 1)] == (2, True, 0.0)
    assert len(got) == 6


def test_answer(spark):
    pair = lambda s, c: F.struct(F.lit(s).alias("section"), F.lit(c).alias("content"))
    get = lambda chunks_: spark.range(1).select(retrieve.answer(F.lit("T"), chunks_, F.lit(" why? ")).alias("x")).first()["x"]
    one = get(F.array(pair("abstract", "A b. C.")))
    assert one == "Based on T, the clearest answer is that A b.  This response is grounded in the paper sections most related to: why?."
    assert "In the results section, the paper adds that D." in get(F.array(pair("abstract", "A."), pair("results", "D. E")))
    assert get(F.array().cast("array<struct<section:string,content:string>>")) == "The paper T does not have indexed chunks yet."


def test_grounding(spark):
    words = [f"wordy{i}" for i in range(10)]
    scripts = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (3, "")], "id int, script string")
    source = spark.createDataFrame([(1, " ".join(words[:3])), (2, " ".join(words[:2])), (3, "anything")], "id int, content string")
    got = {r["id"]: r["qa_status"] for r in compose.grounded(scripts, source, "id").collect()}
    assert got == {1: "verified", 2: "flagged", 3: "flagged"}


def test_script_prefers_the_lowest_ranked_chunk(spark):
    rows = spark.createDataFrame([("p", "results", "first", 1), ("p", "results", "second", 2)], "paper string, section string, content string, rank int")
    assert compose.last_content(rows, "paper").first()["retrieved"] == {"results": "second"}


@pytest.mark.parametrize("sizes, kept", [([4, 4, 4, 4], 2), ([5, 5], 2), ([11], 0), ([], 0)])
def test_lru(spark, sizes, kept):
    files = spark.createDataFrame([(str(i), s, dt.datetime(2024, 1, 1 + i)) for i, s in enumerate(sizes)], "key string, size long, mtime timestamp")
    gone = [r["key"] for r in cache.evicted(files, 10).orderBy("key").collect()]
    assert gone == [str(i) for i in range(len(sizes) - kept)]


def test_lru_property(spark):
    r = random.Random(5)
    sizes = [r.randint(1, 50) for _ in range(300)]
    files = spark.createDataFrame([(i, s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i, s in enumerate(sizes)], "key int, size long, mtime timestamp")
    gone = {x["key"] for x in cache.evicted(files, 2000).collect()}
    total, expected = sum(sizes), set()
    for i, s in enumerate(sizes):
        if total > 2000:
            expected.add(i)
            total -= s
    assert gone == expected and total <= 2000


def test_upsert(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 3), ("z", 4)], "k string, v int")
    got = {r["k"]: (r["v"], r["position"]["_batch"]) for r in upsert.upserted([a, b], "k", "v").collect()}
    assert got == {"x": (3, 0), "y": (2, 0), "z": (4, 1)}
    again = upsert.upserted([a, b, b], "k", "v").drop("position").collect()
    assert {(r["k"], r["v"]) for r in again} == {(k, v[0]) for k, v in got.items()}
    assert upsert.upserted([a, b.limit(0)], "k", "v").count() == 2


def test_listing(spark):
    rows = spark.createDataFrame([("Robots", ["cs.RO"]), ("x", ["CS.cl"]), ("x", [])], "topic string, categories array<string>")
    count = lambda wanted: rows.where(listing.on_topic(F.col("topic"), F.col("categories"), wanted)).count()
    assert (count("robot"), count("cs."), count(""), count(None)) == (1, 2, 3, 3)


def test_feed(spark):
    rows = spark.createDataFrame([(i, "a & <b>", "d", dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(30)], "id int, title string, description string, created_at timestamp")
    got = feed.items(rows, "https://x").orderBy("rank").collect()
    assert len(got) == 25 and "<guid>29</guid>" in got[0]["item"] and "a &amp; &lt;b&gt;" in got[0]["item"]
    whole = feed.document(rows, "https://x", "me").first()["rss"]
    assert whole.count("<item>") == 25
    assert "<item>" not in feed.document(rows.limit(0), "https://x", "me").first()["rss"]


def test_status(spark):
    calls = spark.createDataFrame([("a", 1, True, None), ("a", 2, False, "e" * 100), ("b", 1, True, None)], "provider string, at int, ok boolean, error string")
    got = status.latest(calls)
    assert {r["provider"]: r["ok"] for r in got.collect()} == {"a": False, "b": True}
    assert [len(r["error"]) for r in status.failed(got).collect()] == [80]


def test_whole_run(spark):
    run = Run(["language models", "retrieval augmented generation", "robotics"], episodes=3)
    got = episodes(candidates(spark), None, run, now()).collect()
    assert len(got) == 3 and {r["topic"] for r in got} == {"language models"}
    assert all(r["title"].endswith(": Audio Brief") and r["qa_status"] in ("verified", "flagged") and r["duration_secs"] >= 60 for r in got)
    assert {r["arxiv_id"] for r in got} <= {r["arxiv_id"] for r in candidates(spark).collect()}
    assert episodes(candidates(spark).limit(0), None, run, now()).count() == 0


def test_dense_topk_in_strips_with_bounded_batches(spark, monkeypatch):
    """Few queries are compared at once and Arrow batches hold few blocks; ties go to the smaller ids as before."""
    import numpy as np

    from lectern.operators import dense

    monkeypatch.setattr(dense, "STRIP", 3)
    r = np.random.default_rng(3)
    x = r.integers(-1, 2, (60, 3)).astype(float) + 0.0
    held = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(r.permutation(60), x, strict=True)], "vec_id long, v array<double>")
    rows = {i["vec_id"]: np.array(i["v"]) for i in held.collect()}
    unit = {i: v / np.linalg.norm(v) if v.any() else v for i, v in rows.items()}
    for k in (4, 100):
        got = {(t["q"], t["rank"]): t["c"] for t in dense.dense_topk(held, held.where("vec_id % 5 = 0"), k, 16).collect()}
        for q in range(0, 60, 5):
            best = sorted(rows, key=lambda c, q=q: (-round(float(unit[q] @ unit[c]), 6) + 0.0, c))[:k]
            assert [got[q, n + 1] for n in range(len(best))] == best
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= dense.BYTES
