"""The keyed table: what is written, read, compacted and left by writes that fail."""

import pathlib

import pytest
from pyspark.sql import functions as F

from lectern.sources import deltas
from lectern.sources.manifest import Manifest, Taken
from lectern.sources.store import Store

SCHEMA = "k long, v string, n long"


def made(spark, path, buckets=8):
    held = deltas.KeyedTable(spark, str(path), SCHEMA, "k", buckets)
    held.upsert(spark.range(10_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).cast("long").alias("n")))
    return held


def content(held):
    return {x["k"]: x["n"] for x in held.read().collect()}


def size(path):
    return sum(f.stat().st_size for f in pathlib.Path(path).rglob("*.parquet"))


def change(spark, a, b, n):
    return spark.range(a, b).select(F.col("id").alias("k"), F.lit("new").alias("v"), F.lit(n).cast("long").alias("n"))


def test_an_upsert_writes_what_changes(spark, tmp_path):
    held = made(spark, tmp_path)
    before = size(tmp_path)
    held.upsert(change(spark, 50, 150, 1))
    assert size(tmp_path) - before < 0.05 * before
    assert content(held) == {k: int(50 <= k < 150) for k in range(10_000)}
    assert held.lookup([49, 50, -1]).count() == 2 and {x["n"] for x in held.lookup([50, 149]).collect()} == {1}


def test_order_deletion_nulls_and_times(spark, tmp_path):
    held = made(spark, tmp_path)
    first = held.state()[0]
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (1, "c", 6), (None, "x", 1), (None, "y", 2)], SCHEMA)
    held.upsert(rows, order="n")
    assert content(held)[1] == 7 and content(held)[None] == 2 and held.lookup([None]).count() == 1
    held.upsert(change(spark, 0, 5000, 0), gone=F.lit(True))
    assert set(content(held)) == {None, *range(5000, 10_000)}
    assert held.upsert(change(spark, 0, 0, 0)) is False
    assert held.manifest.value(first) is None or held.read(first).count() == 10_000


def test_a_failed_write_is_not_seen(spark, tmp_path, monkeypatch):
    held = made(spark, tmp_path)
    steps = {"_written": deltas.KeyedTable._written, "_commit": deltas.KeyedTable._commit}
    for name, real in steps.items():
        for after in (False, True):

            def broken(self, *args, real=real, after=after):
                out = real(self, *args) if after else None
                raise OSError("lost")
                return out

            now = content(held)
            monkeypatch.setattr(deltas.KeyedTable, name, broken)
            with pytest.raises(OSError):
                held.upsert(change(spark, 0, 10, 3))
            monkeypatch.setattr(deltas.KeyedTable, name, real)
            committed = name == "_commit" and after
            assert content(held) == ({**now, **dict.fromkeys(range(10), 3)} if committed else now)
    assert len(held.vacuum()) == 2  # of the writes that got as far as their files
    assert content(held)[3] == 3


def test_a_manifest_cut_short_is_passed_over(spark, tmp_path):
    m = Manifest(spark, f"{tmp_path}/m")
    one = m.commit({"x": 1})
    (tmp_path / "m" / f"{one + 1:012d}").write_text('{"x": 2')
    assert m.latest() == (one, {"x": 1})
    two = m.commit({"x": 3}, after=one)
    assert two == one + 2 and m.latest() == (two, {"x": 3})
    with pytest.raises(Taken):
        m.commit({"x": 4}, after=one)
    assert m.forget(1) == [{"x": 1}] and m.numbers() == [two]


def test_two_writers(spark, tmp_path):
    held = made(spark, tmp_path)
    other = deltas.KeyedTable(spark, str(tmp_path), SCHEMA, "k", 8)
    number, state = other.state()
    held.upsert(change(spark, 0, 5, 9))
    with pytest.raises(Taken):
        other._commit(number, state)
    assert content(held)[4] == 9


def test_compaction_rewrites_touched_buckets(spark, tmp_path):
    held = made(spark, tmp_path, 16)
    for n in range(1, 4):
        held.upsert(change(spark, 7, 8, n))
    before = size(tmp_path)
    bucket = held.lookup([7]).select(held.bucket(16)).first()[0]
    assert held.compact(2) == {bucket} and held.compact(0) == set()
    assert size(tmp_path) - before < 0.2 * before
    assert content(held) == {k: 3 if k == 7 else 0 for k in range(10_000)}
    for n in range(deltas.MOST_DELTAS + 2):
        held.upsert(change(spark, 7, 8, 10 + n))
    assert max(sum(b in p["buckets"] for p in held.state()[1]["parts"]) for b in range(16)) <= deltas.MOST_DELTAS + 1
    assert content(held)[7] == 10 + deltas.MOST_DELTAS + 1


def test_a_batch_counts_once(spark, tmp_path):
    held = made(spark, tmp_path)
    assert held.upsert(change(spark, 0, 2, 1), source="s", batch=0)
    assert not held.upsert(change(spark, 0, 2, 2), source="s", batch=0)
    assert held.upsert(change(spark, 0, 0, 2), source="s", batch=1) and held.state()[1]["done"] == {"s": 1}
    assert content(held)[1] == 1


def test_a_store_that_lost_its_manifest_says_so(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    event = spark.createDataFrame([("1", "e", "play", 0, "2024")], "id string, episode_id string, event_type string, position_secs int, created_at string")
    assert [s.add_feedback(event) for _ in range(3)] == [1, 2, 3]
    for f in (tmp_path / "feedback.manifest").iterdir():
        f.unlink()
    with pytest.raises(RuntimeError):
        s.add_feedback(event)
