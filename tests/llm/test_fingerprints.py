"""Fingerprints and likeness of documents in plain Python."""

import hashlib

import numpy as np
import pytest
import regex
import xxhash

from lectern.llm import multiset
from lectern.llm.common import BLANKS


def hash_of(text, seed=None):
    """Spark's xxhash64 of a string, or of a whole number and a string."""
    start = 42 if seed is None else xxhash.xxh64_intdigest(np.int32(seed).tobytes(), 42)
    return xxhash.xxh64_intdigest(text.encode(), start)


def plain_fingerprint(text):
    text = text or ""
    lines = [x.strip(BLANKS) for x in text.split("\n") if x.strip(BLANKS)]
    cut = regex.split(r"\n+|(?<=[^bdfhjlnprtvxzBDFHJLNPRTVXZ])[ \t]+(?=[^aeiouAEIOU])", text)
    phrases = [x.strip(BLANKS) for x in cut if x.strip(BLANKS)]
    hashes = [hash_of(p) for p in phrases]
    lanes = [sum(h >> i & 1 for h in hashes) % (1 << 16) for i in range(64)]
    strong = []
    for seed in (1, 2):
        held = [hash_of(x, seed) for x in lines]
        strong += [sum(h & 0xFFFFFFFF for h in held) % (1 << 32), sum(h >> 32 for h in held) % (1 << 32)]
    return lanes, strong, len(phrases), len(lines)


def plain_text(fp):
    lanes, strong, n, lines = fp
    return "".join(f"{x:04x}" for x in lanes) + "".join(f"{x:08x}" for x in [*strong, n, lines])


def plain_likeness(a, b):
    wrap = lambda x: (x + (1 << 15)) % (1 << 16) - (1 << 15)
    u, v = ([wrap(2 * x - f[2]) for x in f[0]] for f in (a, b))
    gap, both = sum(wrap(x - y) ** 2 for x, y in zip(u, v, strict=True)), sum(x * x for x in u) + sum(y * y for y in v)
    return 1.0 if both == 0 else min(1.0, max(0.0, 1 - gap / both))


def test_query_equals_plain_python(spark, data, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    got = {r["doc_id"]: r for r in multiset.query(spark, data).collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        own, follower = texts[d], texts[after[d]]
        half = len(own) // 2
        edited = own[: len(own) - half] + follower[:half]
        a, b, c = map(plain_fingerprint, (own, edited, follower))
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_text(a), plain_text(b))
        assert r["near_edited"] == pytest.approx(plain_likeness(a, b), abs=1e-9) and r["near_next"] == pytest.approx(plain_likeness(a, c), abs=1e-9)
