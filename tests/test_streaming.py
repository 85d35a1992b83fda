"""Streaming affinity equals the batch operator."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import affinity
from lectern.streaming import affinity as streaming


def test_stream_equals_batch(spark, tmp_path):
    r, origin, now = random.Random(2), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)
    schema = "episode_id long, event_type string, ts timestamp_ntz"
    rows = [(r.randint(0, 9), r.choice(["complete", "play", "skip", "pause", "odd"]), origin + dt.timedelta(minutes=r.randint(0, 40_000))) for _ in range(400)]
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).write.parquet(str(tmp_path / "in"), mode="append")
    topics = spark.createDataFrame([(i, f"topic{i % 4} shared") for i in range(9)], "episode_id long, topic string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = streaming.started(stream, topics, origin, "state", str(tmp_path / "ck"), latest=now)
    q.awaitTermination()
    got = {x["term"]: x["score"] for x in streaming.read_at(spark.table("state"), origin, now).collect()}
    batch = affinity.scores(spark.createDataFrame(rows, schema), topics, F.lit(now).cast("timestamp_ntz"))
    expected = {x["term"]: x["score"] for x in batch.collect()}
    assert got == {k: pytest.approx(v) for k, v in expected.items()}


def test_appended_feedback(spark, tmp_path):
    schema = "id string, episode_id string, event_type string, position_secs int, created_at string"
    spark.createDataFrame([("1", "e", "play", 0, None)], schema).write.parquet(str(tmp_path / "in"))
    q = streaming.appended(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["created_at"]


EVENTS = "event_id long, ts timestamp_ntz, kind string"


def test_a_log_of_events_sent_again(spark, tmp_path):
    from lectern.streaming import feedback

    at, start = str(tmp_path), dt.datetime(2024, 1, 1)
    send = lambda ids: spark.createDataFrame([(i, start + dt.timedelta(minutes=i), "k") for i in ids], EVENTS).coalesce(1).write.mode("append").parquet(f"{at}/in")
    run = lambda: feedback.recorded(spark.readStream.schema(EVENTS).parquet(f"{at}/in"), f"{at}/log", f"{at}/ck", late="2 hours").awaitTermination()
    ids = lambda: sorted(x["event_id"] for x in feedback.log(spark, f"{at}/log", EVENTS).collect())
    assert ids() == []
    send([*range(50), *range(20)])
    run()
    send([*range(30, 90), 49])  # a restart; some come again
    run()
    assert ids() == list(range(90))
    rows = spark.createDataFrame([(999, start, "k")], EVENTS)
    assert not feedback.append_batch(rows, f"{at}/log", 0) and ids() == list(range(90))
    last = next(n for n in range(9) if (tmp_path / "log" / f"batch={n}").exists() and spark.read.parquet(f"{at}/log/batch={n}").where("event_id = 89").count())
    (tmp_path / "log" / f"batch={last}" / "_SUCCESS").unlink()  # as a batch that was cut short
    assert len(ids()) < 90 and feedback.append_batch(rows, f"{at}/log", last) and 999 in ids()


def test_states_outlive_the_query(spark, tmp_path):
    from lectern.sources.deltas import KeyedTable

    r, origin, now = random.Random(4), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)
    schema = "episode_id long, event_type string, ts timestamp_ntz"
    rows = [(r.randint(0, 9), r.choice(["complete", "play", "skip"]), origin + dt.timedelta(minutes=r.randint(0, 40_000))) for _ in range(200)]
    rows += [(9, "play", origin)]  # the only one of its topic
    rows = [x for x in rows if x[0] != 9 or x[2] == origin]
    topics = spark.createDataFrame([(i, f"topic{i % 4} shared" if i < 9 else "alone") for i in range(10)], "episode_id long, topic string")
    held = KeyedTable(spark, f"{tmp_path}/t", streaming.STATE, "term", 4)
    for half in (rows[::2], rows[1::2]):
        spark.createDataFrame(half, schema).repartition(2).write.parquet(str(tmp_path / "in"), mode="append")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streaming.accumulated(stream, topics, origin, held, str(tmp_path / "ck"), now).awaitTermination()
    expected = {x["term"]: x["score"] for x in affinity.scores(spark.createDataFrame(rows, schema), topics, F.lit(now).cast("timestamp_ntz")).collect()}
    scores = lambda: {x["term"]: x["score"] for x in streaming.read_at(held.read(), origin, now).collect()}
    assert scores() == {k: pytest.approx(v) for k, v in expected.items()}
    assert streaming.faded(held, origin, now, 0.02) and "alone" not in scores() and len(scores()) == len(expected) - 1
