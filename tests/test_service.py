"""The application's requests end to end on a store."""

import datetime as dt
import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.plans.job import demo, main, scheduled
from lectern.plans.pipeline import Providers
from lectern.plans.service import Service
from lectern.sources.catalog import catalog
from lectern.sources.config import Settings
from lectern.sources.store import Store

NOW = dt.datetime(2025, 10, 16)


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    rows = catalog(spark).withColumn("published", F.col("published_at").cast("timestamp").cast("timestamp_ntz")).withColumn("ord", F.monotonically_increasing_id())
    s = Service(Store(spark, str(tmp_path_factory.mktemp("store"))), Settings(), lambda topics, days: rows, "https://x.test")
    assert s.run(NOW) == 3
    return s


def test_run_again_replaces_papers(spark, service):
    before = service.store.read("papers").count()
    assert service.run(NOW + dt.timedelta(days=1)) == 3
    assert service.store.read("papers").count() == before == 3
    assert service.store.read("episodes").count() == 6
    state = service.status()["state"]
    assert (state["running"], state["last_count"], state["error"], state["window_days"]) == (False, 3, None, 7) and state == service.state()


def test_listing_and_lookup(service):
    rows = service.episodes("language", 2).collect()
    one = json.loads(rows[0]["json"])
    assert len(rows) == 2 and one["audio_url"] == f"https://x.test/episodes/{rows[0]['id']}/audio" and one["paper"]["categories"]
    assert service.episodes("no such topic").count() == 0
    assert service.paper(rows[0]["id"])["arxiv_id"] == one["paper"]["arxiv_id"]
    assert service.episode("unknown") is None and service.paper("unknown") is None
    with pytest.raises(ValueError):
        service.episodes(limit=51)


def test_ask(service):
    key = service.episodes().first()["id"]
    got = service.ask(key, "what are the results on public tasks?")
    assert got["answer"].startswith("Based on ") and len(got["citations"]) == 4
    assert all(len(c["excerpt"]) <= 240 for c in got["citations"])
    assert service.ask("unknown", "why is that?") is None
    with pytest.raises(ValueError):
        service.ask(key, "x")


def test_candidates_are_asked_for_once(spark, tmp_path):
    asked = []
    rows = demo(spark)([], 0)
    s = Service(Store(spark, str(tmp_path)), Settings(), lambda topics, days: asked.append(topics) or rows)
    assert s.trigger(NOW)["queued"] and len(asked) == 1
    papers, chunks, episodes = (s.store.read(n) for n in ("papers", "chunks", "episodes"))
    assert {r["id"] for r in papers.collect()} == {r["paper_id"] for r in episodes.collect()} == {r["paper_id"] for r in chunks.select("paper_id").distinct().collect()}
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith("staged") and any(p.iterdir())]
    s.runs["running"] = True
    assert not s.trigger(NOW)["queued"] and len(asked) == 1 and s.health()["status"] == "ok"


def test_a_run_with_providers(spark, tmp_path):
    """Sections of a fetched document, vectors, scripts and speech by providers, in one run."""
    paper = "Title\n\n1. Introduction\n" + "The opening line of it. " * 20 + "\nResults\n" + "We found what we sought. " * 20 + "\nReferences\nOld books " * 3
    rows = demo(spark)([], 0).withColumn("sections", F.create_map(F.lit("abstract"), F.lit("short")))
    using = Providers(
        writers=[("broken", lambda prompt: 1 / 0), ("mine", lambda prompt: "Said of " + prompt.split("\n")[0])], embed=lambda texts: [[float(len(t)), 1.0] for t in texts],
        fetch=lambda url: paper.encode(), speakers=[("voice", lambda script: b"ID3" + script.encode())], voice="voice",
    )
    s = Service(Store(spark, str(tmp_path)), Settings(), lambda topics, days: rows, using=using)
    s.run(NOW)
    assert {r["section"] for r in s.store.read("chunks").collect()} == {"introduction", "results", "abstract"}
    assert {len(r["embedding"]) for r in s.store.read("chunks").collect()} == {2}
    episode = s.store.read("episodes").first()
    assert episode["script"].startswith("Said of PAPER: ") and episode["tts_provider"] == "voice"
    assert s.ask(episode["id"], "what was found?")["citations"]
    got = s.audio(episode["id"])
    assert got["content_type"] == "audio/mpeg" and bytes(got["audio"]).startswith(b"ID3Said of")


def test_audio_is_made_once(spark, service):
    key = service.episodes().first()["id"]
    first = service.audio(key, NOW)
    with wave.open(io.BytesIO(bytes(first["audio"]))) as w:
        samples = np.frombuffer(w.readframes(w.getnframes()), "<i2")
    assert first["content_type"] == "audio/wav" and samples[0] == 0 and abs(int(samples[-1])) < 40
    assert bytes(service.audio(key, NOW + dt.timedelta(hours=1))["audio"]) == bytes(first["audio"]) and service.cache._blobs().count() == 1
    assert service.cache.evictable().count() == 0 and service.audio("unknown") is None


def test_job(spark, tmp_path, capsys):
    main(["--store", str(tmp_path), "--topics", "robotics, , databases", "--num-episodes", "2"], spark)
    out = capsys.readouterr().out
    assert "Run complete." in out and out.count("\n- ") == 2
    assert Store(spark, str(tmp_path)).read("topics").count() == 2


def test_schedule():
    times = [NOW + dt.timedelta(hours=h) for h in (0, 1, 23, 24, 25, 48)]
    seen, clock = [], iter(times)

    def run(now):
        seen.append(now)
        if now == times[3]:
            raise OSError("no network")

    assert scheduled(run, 24, lambda: next(clock), lambda s: None, len(times)) == 2 and seen == [times[0], times[3], times[5]]


def test_topics_feed_and_feedback(service):
    assert service.set_topics([" robotics ", ""]) == ["robotics"] == service.topics()
    assert service.feed("me").count("<item>") == service.store.read("episodes").count()
    key = service.episodes().first()["id"]
    assert service.feedback("f1", key, "complete", 10, NOW) == 1
    assert service.feedback("f2", "unknown", "play", 0, NOW) is None
    with pytest.raises(ValueError):
        service.feedback("f3", key, "jump", 0, NOW)
    assert service.run(NOW) == 3
    assert service.status()["providers"] == {"llm": "demo", "tts": "demo", "embedder": "demo", "live": False}
