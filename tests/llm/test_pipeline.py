"""The pipeline's five stages, and the added spans of personal data, in plain Python without calling the stages."""

import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers as vocabularies
from lectern.llm import boosting, mixing, pieces, private, quality

from .test_nearcopies import brute_survivors
from .test_private_recall import HELD, plain_selection
from .test_rules_and_models import brute_base, brute_probabilities, brute_repeats, luhn

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(rows):
    """(id, text) of the rows that stay, without the lines above the limits; rows are (id, text, source)."""
    key = lambda x: " ".join(WORD.findall(x)).lower()
    holders, texts = {}, {}
    for _, text, source in rows:
        texts.setdefault(source, set()).add(text)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders.setdefault((source, key(line)), set()).add(text)
    bad = {k for k, held in holders.items() if len(held) > max(quality.MIN_DOCS, quality.SHARE * len(texts[k[0]]))}
    out = []
    for doc, text, source in rows:
        words, lines = WORD.findall(text or ""), (text or "").split("\n")
        gone = [x for x in lines if WORD.search(x) and (source, key(x)) in bad]
        lost = sum(len(WORD.findall(x)) for x in gone)
        failed = len(words) < 50 or 100 * brute_repeats(words) > 50 * len(words)
        depleted = lost and (2 * lost > len(words) or 2 * (len(words) - lost) < 50)
        if not failed and not depleted:
            out.append((doc, "\n".join(x for x in lines if not WORD.search(x) or (source, key(x)) not in bad) if gone else text, source))
    return out


def plain_features(kind, m, before, after):
    count = lambda p: float(len(m) - len(regex.sub(p, "", m)))
    has = lambda p, s=m: float(bool(regex.search(p, s)))
    turns = len(regex.sub("(?<=[a-z])(?=[A-Z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[a-z0-9])", "~", m)) - len(m)
    digits = regex.sub("[^0-9]", "", m)
    return [
        *[float(kind == k) for k in private.KINDS], float(len(m)), count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count("[ ]"), count("[-./_:]"), count(r"[()\[\]{}]"),
        count("[0-9a-f]") / len(m), float(len(set(m))), float(len(digits) > 11 and luhn(digits)), has(private._DOMAINS), has(r"[(\[{]at[)\]}]"), has("@"), has(r" dot |[(\[{]dot[)\]}]"),
        has(r"\. [A-Z]"), has(private._CUES[kind], before), has(private._AGAINST, before), has(r"[0-9] ?$", before), has(r"^ ?[0-9%]", after), has(r"[=:\"'] ?$", before),
        has(r"^(?:19|20)[0-9]{2}[-./]"), has(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), turns / len(m), count("[0-9]") / len(m), count("[AEIOUaeiou]") / len(m), count("[/+=]"), has("::"), has("[a-z]{7,}|[A-Z]{2,}[a-z]{5,}"),
        has(r"^(?:eyJ|[a-z]{2,5}_|AKIA|AIza|xox|sk-|pk-|-----BEGIN)"), has(r"://|^www\.|^/|\.(?:com|org|net|html?|pdf|py|txt|js|md|jpe?g|png|csv|json|xml|gz|zip)\b"),
        has("(?i)(?:" + private._CUED + ")[\"']? ?[:=] ?[\"']?$", before), has("[^A-Za-z0-9_/+=.-]"), float(bool(regex.search("[A-Z]", m) and regex.search("[a-z]", m) and regex.search("[0-9]", m))), count("[.]"),
    ]


def plain_spans(text, trees, limits):
    """(start, kind, end) of the spans that stay: base spans, generators, trees and the greedy choice, one by one."""
    found = [(s, e, k, 2.0) for s, k, e in brute_base(text)]
    for kind, pattern, needs in private.GENERATORS:
        if not regex.search(needs, text):
            continue
        last = 0
        held = list(regex.finditer(pattern, text))
        for i, m in enumerate(held):
            after = text[m.end() : held[i + 1].start() if i + 1 < len(held) else len(text)]
            x = plain_features(kind, m[0], text[last : m.start()][-24:], after[:8])
            p = float(boosting.predict(trees, np.array([x]))[0])
            if p >= limits[kind]:
                found.append((m.start(), m.end(), private.KINDS.index(kind), p))
            last = m.end()
    return plain_selection(found)


def redacted(text, spans):
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{private.KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def fitted(spark):
    return private._fitted(spark)


def test_added_spans_equal_plain_python(spark, documents, fitted):
    r = random.Random(14)
    texts = [t.replace("«", "").replace("»", "") for _, t in HELD] + [x["text"] or "" for x in documents.collect()]
    texts += [" ".join(r.sample(texts[: len(HELD)], 6)) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: [(s["s"], s["k"], s["e"]) for s in x["spans"]] for x in private.found_spans(rows).collect()}
    assert got == {i: plain_spans(t, *fitted) for i, t in enumerate(texts)}


def test_stages_equal_plain_python(spark, documents, fitted):
    """Templates, near copies and personal data planted in real rows; every stage changes something and all of it is repeated."""
    r = random.Random(21)
    base = [(x["doc_id"], x["text"], x["lang"], x["source"]) for x in documents.collect()]
    secrets = [t.replace("«", "").replace("»", "") for _, t in HELD]
    notice = ["Share this page with friends and colleagues", "Terms  of use and PRIVACY apply", "terms of use and privacy apply"]
    rows = []
    for i, (d, text, lang, source) in enumerate(base):
        rows.append((d, text, lang, source))
        if text and 400 < len(text) < 6000 and i % 3 == 0:
            page = "\n".join([notice[0], text + f" tail{d}", notice[1 + i % 2], secrets[i % len(secrets)]])
            rows.append((10_000 + d, page, lang, "site"))
            words = page.split(" ")
            words[len(words) // 2] = f"changed{r.random()}"
            rows.append((20_000 + d, " ".join(words), lang, "site"))
    schema = documents.schema
    docs = spark.createDataFrame([(d, t, lg, s, len(t or "")) for d, t, lg, s in rows], schema)
    lang = {d: lg for d, _, lg, _ in rows}

    staged, results = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        staged = stage(spark, staged, "")
        results[name] = {x["doc_id"]: x for x in staged.collect()}

    kept = plain_quality([(d, t, s) for d, t, _, s in rows])
    texts, source = {d: t for d, t, _ in kept}, {d: s for d, _, s in kept}
    assert {d: x["text"] for d, x in results["quality_rules"].items()} == texts
    assert any(len(t) < len(dict((d, t) for d, t, _, _ in rows)[k]) for k, t in texts.items()) and len(texts) < len(rows)

    stay = brute_survivors(list(texts.items()))
    assert sorted(results["near_duplicates"]) == stay and len(stay) < len(texts)

    clean = {d: redacted(texts[d], plain_spans(texts[d], *fitted)) for d in stay}
    assert {d: x["text"] for d, x in results["personal_data"].items()} == clean and any(f"[{k.upper()}]" in t for k in private.KINDS for t in clean.values())

    codec, library = pieces.Codec(vocabularies.path(pieces.MODEL)), Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    tokens = {d: library.encode(t, add_special_tokens=False).ids for d, t in clean.items()}
    frame = spark.createDataFrame([(d, t, lang[d], source[d], len(t)) for d, t in clean.items()], schema)
    model, terms = mixing.topic_model(frame, mixing.vocabulary()), mixing.Terms(*mixing.vocabulary())

    def topic(d):
        counts = np.bincount(terms.buckets[tokens[d]], minlength=mixing.WIDTH + 1)[: mixing.WIDTH]
        if lang[d] not in model:
            return f"{lang[d]}/0"
        idf, centres = model[lang[d]]
        return f"{lang[d]}/{max(range(len(centres)), key=lambda k: (round(float(centres[k] @ (np.log1p(counts) * idf)), 9), -k))}"

    order = sorted(clean)
    chance, _ = brute_probabilities([source[d] for d in order], [topic(d) for d in order], [len(tokens[d]) for d in order], corpus_pipeline.MIXTURE_KEEP)
    whole = spark.createDataFrame([(d, hashlib.md5(clean[d].encode()).hexdigest()) for d in order], "doc_id long, whole string")
    u = {x["doc_id"]: x["u"] for x in whole.select("doc_id", (F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id", "whole"), 11) * F.lit(2.0**-53)).alias("u")).collect()}
    sampled = [d for d, p in zip(order, chance, strict=True) if u[d] < p]
    assert sorted(results["mixture"]) == sampled and len(sampled) < len(order)
    assert {d: x["ids"] for d, x in results["encoding"].items()} == {d: codec.encode([clean[d]])[0] for d in sampled}


def test_run_is_its_stages(spark, data, documents):
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, data).collect()}
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert got == {r["doc_id"]: r["ids"] for r in docs.collect()} and 0 < len(got) < documents.count()
