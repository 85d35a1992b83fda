"""Texts far above one Arrow batch, one without any blank, in every operator, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import public_tokenizers as vocabularies
from lectern.llm import chat, language, mixing, multiset, nearcopies, pieces, private, quality, simhash, substrings, tokenstore
from lectern.llm.common import shared_dir

from .test_duplicates import brute_fingerprint, brute_kept
from .test_fingerprints import plain_fingerprint, plain_text
from .test_rules_and_models import brute_base, brute_repeats
from .test_store_chat_pieces import expected_store


@pytest.fixture(scope="module")
def texts(documents):
    r = random.Random(31)
    words = [w for x in documents.limit(30).collect() for w in (x["text"] or "").split()]
    prose = "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(3500))
    numbers = " ".join(r.choice(["10.0.0.1", "a.b@c.org", "call 12", "x"]) for _ in range(20_000))
    return {1: prose, 2: "z" * 300_000, 3: numbers, 4: prose + " end", 5: "short text", 6: "\n" * 100_000}


@pytest.fixture(scope="module")
def long(spark, texts):
    """Rows of up to 300 kB where a batch is to hold 50 kB."""
    before = {c: spark.conf.get(f"spark.sql.execution.arrow.{c}", None) for c in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "50000")
    yield spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    for c, v in before.items():
        spark.conf.unset(f"spark.sql.execution.arrow.{c}") if v is None else spark.conf.set(f"spark.sql.execution.arrow.{c}", v)


def test_batches_stay_small(spark, long):
    simhash.near_duplicates(long).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "50000"


def test_quality(long, texts):
    got = {r["doc_id"]: r for r in quality.judged(long).collect()}
    for d, t in texts.items():
        assert (got[d]["n_words"], got[d]["n_repeat_words"]) == (len(t.split()), brute_repeats(t.split()))


def test_language(long):
    model = language.trained(long.where("doc_id = 1"))
    assert {r["doc_id"]: r["lang_pred"] for r in language.predicted(long, model).collect()} == {1: "en", 2: "en", 3: "en", 4: "en", 5: "en", 6: "und"}


def test_private(long, texts):
    for r in private.found_spans(long).collect():
        base = brute_base(texts[r["doc_id"]])
        assert [(s["s"], s["k"], s["e"]) for s in r["base"]] == base and set(base) <= {(s["s"], s["k"], s["e"]) for s in r["spans"]}
    clean = {r["doc_id"]: r["text"] for r in private.cleaned(long).collect()}
    assert "10.0.0.1" not in clean[3] and clean[6] == texts[6]


def test_near_copies(long, texts):
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.near_duplicates(long).collect()} == {d: brute_fingerprint(t) for d, t in texts.items()}
    assert sorted(r["doc_id"] for r in nearcopies.survivors(long).collect()) == [1, 2, 3, 5, 6]


def test_mixture(long, texts):
    terms = mixing.Terms(*mixing.vocabulary())
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.mixed(long, mixing.vocabulary()).collect()} == {d: len(terms.encode(t)) for d, t in texts.items()}


def test_store(spark, long, texts):
    from tokenizers import Tokenizer

    path, root = vocabularies.path(tokenstore.VOCABULARY), shared_dir(spark)
    tokenstore.write_store(long, root, path)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenstore.verified(spark, root).collect())
    assert got == expected_store(list(texts.items()), Tokenizer.from_file(path))


def test_chat(spark, long, texts):
    path = vocabularies.path(tokenstore.VOCABULARY)
    turns = long.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text")
    got = chat.digests(chat.formatted(turns, path), path).first()
    assert got["n_turns"] == len(texts) and got["loss_chars"] == sum(map(len, texts.values()))


def test_pieces(long, texts):
    path = vocabularies.path(pieces.MODEL)
    codec = pieces.Codec(path)
    assert {r["doc_id"]: r["ids"] for r in pieces.encoded(long, path).collect()} == {d: codec.encode([t])[0] for d, t in texts.items()}


def test_substrings(long, texts):
    got = {r["doc_id"]: [(r["n_words"], r["n_removed"], r["kept_sha256"])] for r in substrings.deduplicated(long).collect()}
    assert got == brute_kept(list(texts.items()))


def test_fingerprints(long, texts):
    prints = multiset.fingerprints(long.select(F.col("doc_id").alias("k"), F.col("text").alias("t")), ["t"], "k")
    assert {r["k"]: r["x"] for r in prints.select("k", multiset.as_text(F.col("t_fp")).alias("x")).collect()} == {d: plain_text(plain_fingerprint(t)) for d, t in texts.items()}
