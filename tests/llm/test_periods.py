"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lectern.llm import periods

from .conftest import ODD


def brute(words, least=12):
    """(start, length, period) of every run, by comparing the words q apart for each q."""
    ids = np.array(periods.numbered(words), np.int64)
    found = {}
    for q in range(1, len(ids) // 2 + 1):
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]])
        flips = np.flatnonzero(np.diff(same))
        for a, b in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True):
            if b - a + q >= max(2 * q, least):
                found.setdefault((a, b - a + q), q)  # the least period of a stretch
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def test_random_words():
    r = random.Random(11)
    for _ in range(3000):
        k, n = r.choice([1, 2, 2, 3, 4, 9]), r.randrange(90)
        words = [b"%d" % r.randrange(k) for _ in range(n)]
        for _ in range(r.randrange(3) if n > 5 else 0):
            a = r.randrange(n)
            p = 1 + r.randrange(max(1, (n - a) // 2))
            words[a:] = [words[a + i % p] for i in range(n - a)]
            words[r.randrange(n)] = b"x"
        assert periods.runs(words) == brute(words)


def test_long_and_regular_texts():
    a, b = [b"0"], [b"0", b"1"]
    while len(b) < 1500:
        a, b = b, b + a
    r = random.Random(2)
    noise = [b"%d" % r.randrange(10**6) for _ in range(4000)]
    for words in (b, [b"w"] * 3000, noise + noise, noise + [b"|"] + noise, noise[:700] * 5 + noise[:13], [b"a", b"b"] * 900 + [b"a", b"a"] * 30):
        assert periods.runs(words) == brute(words)
    assert len(periods.runs([b"w"] * 200_000)) == 1


def test_hashes_that_lie_are_found_out(monkeypatch):
    monkeypatch.setattr(periods.Extensions, "_equal", lambda self, i, j, size: True)
    r = random.Random(4)
    for _ in range(200):
        words = [b"%d" % r.randrange(2) for _ in range(80)]
        assert periods.runs(words) == brute(words)


def expected(doc, text):
    words = [w for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc).encode()) & 0xFFFFFFFF, len(words)
    if doc is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    exponent = 1000 * best[1] // best[2] if found else None
    return (doc, len(found), *best, exponent, sha(lines.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark, data, documents):
    rows = {x["doc_id"]: tuple(x[c] for c in COLUMNS) for x in periods.query(spark, data).collect()}
    texts = {x["doc_id"]: x["text"] for x in documents.collect()}
    assert rows == {d: expected(d, t) for d, t in texts.items()}
    assert sum(x[1] > 0 for x in rows.values()) > 10


@pytest.mark.parametrize("n", [0, len(ODD)])
def test_odd_rows(odd, n):
    got = periods.periodic(odd.limit(n)).collect()
    assert len(got) == n
    for x in got if n else []:
        assert x["n_words"] == 0 or x["kept"]
    if n:
        assert {(tuple(r), x["kept"]) for x in got if x["doc_id"] == 11 for r in x["runs"]} == {((0, 3000, 1), "long")}
        assert sum(x["doc_id"] == 8 for x in got) == 2


def test_query_on_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x[c] for c in COLUMNS) for x in periods.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(d, t) for d, t, *_ in ODD), key=str)
