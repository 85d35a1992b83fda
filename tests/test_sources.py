"""Stores, feeds, files and settings."""

import datetime as dt
import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import audio
from lectern.sources import atom, config, files, store
from lectern.sources.catalog import catalog

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x.org/abs/2604.1</id><title> A title </title><summary> About it. </summary>
<published>2026-04-20T08:00:00Z</published><author><name>Ann</name></author><author><name>Bob</name></author><category term="cs.CL"/>
<link href="http://x.org/abs/2604.1"/><link title="pdf" href="http://x.org/pdf/2604.1"/></entry></feed>"""


def test_atom_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    r = atom.candidates(atom.entries(spark, str(tmp_path / "a.xml"))).first()
    assert (r["arxiv_id"], r["title"], r["authors"], r["categories"], r["pdf_url"]) == ("2604.1", "A title", ["Ann", "Bob"], ["cs.CL"], "http://x.org/pdf/2604.1")
    assert r["sections"] == {"abstract": "About it."}


def test_atom_data_source_pushes_the_topic(spark):
    body = ATOM.encode()

    class Fixed(atom.AtomSource):
        fetch = staticmethod(lambda url: body)

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(atom)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Fixed)
    rows = spark.read.format("atom").options(base="http://x.org/q", window="w", topics="a,b").load()
    assert rows.count() == 1  # one request for all topics
    found = rows.where("topic = 'robots'")
    assert [(r["topic"], r["id"]) for r in found.collect()] == [("robots", "http://x.org/abs/2604.1")]
    one = atom.candidates(found).first()
    assert (one["arxiv_id"], one["authors"], one["categories"], one["pdf_url"]) == ("2604.1", ["Ann", "Bob"], ["cs.CL"], "http://x.org/pdf/2604.1")


def test_request():
    url = atom.request(list("abcdefg"), "w", 6, "http://x")
    assert url.count("all%3A") == 5 and "max_results=6" in url


def test_live_or_demo(spark):
    demo = catalog(spark)

    def broken():
        raise OSError

    assert atom.live_or_demo(broken, demo, ["t"]) is demo
    assert atom.live_or_demo(lambda: demo.limit(0), demo, ["t"]) is demo
    assert atom.live_or_demo(lambda: demo.limit(1), demo, []) is demo
    assert atom.live_or_demo(lambda: demo.limit(1), demo, ["t"]).count() == 1


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    paper = lambda key, title: [(f"id-{title}", key, title, [], "", [], "", "", 0, 0.0)]
    frame = lambda rows: spark.createDataFrame(rows, store.TABLES["papers"])
    assert s.read("papers").count() == 0
    s.upsert("papers", frame(paper("k1", "old") + paper("k2", "other")))
    s.upsert("papers", frame(paper("k1", "new")))
    assert {(r["arxiv_id"], r["title"]) for r in s.read("papers").collect()} == {("k1", "new"), ("k2", "other")}
    event = spark.createDataFrame([("e", "x", "play", 0, "2024")], store.TABLES["feedback"])
    assert s.add_feedback(event) == 1 and s.add_feedback(event) == 2
    assert s.set_topics([" a ", "", "b", "a"]) == ["a", "b", "a"]
    episode = spark.createDataFrame([("e", "p", "t", "d", "x", 0.1, "s", "verified", "", 60, "demo", "2024")], store.TABLES["episodes"])
    assert s.seed({"episodes": episode}) and not s.seed({"episodes": episode})
    s.reset({"episodes": episode})
    assert s.read("feedback").count() == 0 and s.read("episodes").count() == 1


def test_json_store(spark, tmp_path):
    path = tmp_path / "s.json"
    empty = store.read_json(spark, str(path))
    assert empty["papers"].count() == 0
    path.write_text(json.dumps({"topics": ["a", "b"], "papers": [{"id": "1", "arxiv_id": "k", "title": "t"}], "chunks": [], "episodes": [], "feedback": [], "meta": {"seeded_at": "x"}}))
    got = store.read_json(spark, str(path))
    assert got["papers"].first()["title"] == "t" and got["topics"].count() == 2 and got["meta"].first()["value"] == "x"
    assert json.loads(store.to_json({"papers": got["papers"]}).first()["value"])["arxiv_id"] == "k"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\fthree")
    (tmp_path / "b.txt").write_bytes(b"x" * 100)
    held = files.blobs(spark, str(tmp_path), 50)
    rows = files.text_lines(held, "path", "content").orderBy("page", "line_no").collect()
    assert [(r["page"], r["line_no"], r["line"]) for r in rows] == [(0, 0, "one"), (0, 1, "two"), (1, 0, "three")]
    parsed = files.text_lines(held, "path", "content", lambda b: [b.decode().upper()])
    assert {r["line"] for r in parsed.collect()} == {"ONE", "TWO\fTHREE"}


def test_wav(spark):
    rows = spark.createDataFrame([(1, "w " * 300, "abc")], "id int, script string, title string")
    with wave.open(io.BytesIO(bytes(files.wav(rows, "id", "script", "title").first()["audio"]))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 2, 22_050)
        assert w.getnframes() == int(300 / 90 * 22_050)


def test_audio_cache(spark, tmp_path):
    c = files.AudioCache(spark, str(tmp_path / "c"), cap=14)
    row = lambda key, n, day: spark.createDataFrame([(key, "audio/wav", bytearray(n), dt.datetime(2024, 1, day))], files.AudioCache.SCHEMA)
    assert c.get("a").count() == 0
    c.put(row("a", 6, 1))
    c.put(row("b", 6, 2))
    assert len(c.get("a", dt.datetime(2024, 1, 3)).first()["audio"]) == 6  # a use: now b is the oldest
    c.put(row("d", 7, 4))
    assert {r["key"] for r in c._blobs().collect()} == {"a", "d"}
    assert not [p for p in (tmp_path / "c" / "blobs").iterdir() if p.name == "key=b"]
    c.put(row("a", 3, 5))
    assert len(c.get("a").first()["audio"]) == 3 and c._blobs().count() == 2


def test_old_versions_go(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    frame = lambda key: spark.createDataFrame([("i", key, "t", [], "", [], "", "", 0, 0.0)], store.TABLES["papers"])
    for i in range(4):
        s.write("papers", frame(str(i)))
    assert s.read("papers").first()["arxiv_id"] == "3" and len([p for p in (tmp_path / "papers").iterdir() if p.name.startswith("part-")]) == 2
    event = spark.createDataFrame([("e", "x", "play", 0, "2024")], store.TABLES["feedback"])
    s.add_feedback(event)
    at = s._current("feedback")
    assert s.add_feedback(event) == 2 and s._current("feedback") == at


def test_fetched(spark):
    rows = spark.createDataFrame([(1, "short"), (2, "long"), (3, "fails"), (4, None)], "k int, url string")

    def get(url):
        if url == "fails":
            raise OSError
        return b"x" * (5 if url == "short" else 50)

    assert {r["k"]: r["content"] and len(r["content"]) for r in files.fetched(rows, "k", "url", get, 20).collect()} == {1: 5, 2: None, 3: None, 4: None}


def test_download(tmp_path):
    (tmp_path / "f").write_bytes(b"y" * 30)
    url = (tmp_path / "f").as_uri()
    assert files.download(url) == b"y" * 30 and files.download(url, 29) is None


def test_mastering(spark):
    t = np.arange(22_050) / 22_050
    quiet, loud = (a * np.sin(2 * np.pi * 440 * t) for a in (3000, 20_000))
    rows = spark.createDataFrame([(0, quiet.astype(int).tolist()), (1, loud.astype(int).tolist()), (2, [0] * 500), (3, [])], "k int, s array<smallint>")
    got = {r["k"]: r for r in rows.select("k", audio.dbfs(F.col("s")).alias("db"), audio.mastered(F.col("s")).alias("m")).collect()}
    for k, x in ((0, quiet), (1, loud)):
        db = 20 * np.log10(np.sqrt(np.mean(x.astype(int).astype(float) ** 2)) / 32768)
        assert got[k]["db"] == pytest.approx(db)
        middle = x.astype(int)[6000:7000] * 10 ** (np.clip(-16 - db, -8, 8) / 20)
        assert np.abs(np.array(got[k]["m"])[6000:7000] - middle).max() <= 1.5
        assert got[k]["m"][0] == 0 and got[k]["m"][-1] == 0
    assert got[2]["m"] == [0] * 500 and got[3]["m"] == [] and got[3]["db"] is None


def test_catalog_of_our_own(spark):
    rows = {r["arxiv_id"]: r for r in catalog(spark).collect()}
    assert len({r["sections"]["abstract"] for r in rows.values()}) == 5
    assert all(any(len(t) > 200 for t in r["sections"].values()) and r["abstract"] == r["sections"]["abstract"] for r in rows.values())


def test_settings():
    env = {"LECTERN_TOPICS": " a, ,b", "OPENAI_API_KEY": "k", "ON": "on", "OFF": "0"}
    s = config.settings(env)
    assert s.topics == ["a", "b"] and s.has("openai") and not s.has("anthropic") and s.window_days == 7
    assert config.flag("ON", False, env) and not config.flag("OFF", True, env) and config.flag("NONE", True, env)
    assert config.settings({}).topics == config.Settings().topics
    for bad in (lambda: config.check_question("ab"), lambda: config.check_event("jump"), lambda: config.check_range(0, 1, 50)):
        with pytest.raises(ValueError):
            bad()


def test_catalog(spark):
    rows = catalog(spark)
    assert rows.count() == 5
    assert rows.select(F.min(F.size("sections"))).first()[0] == 5
    assert rows.select("arxiv_id").distinct().count() == 5
