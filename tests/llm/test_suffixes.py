"""Removal of repeated byte strings against a dictionary of all windows."""

import collections
import random

import pytest

from lectern.llm import suffixes

from .conftest import ODD

LENGTH = suffixes.LENGTH


def brute(texts):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    seen = collections.Counter(t[i : i + LENGTH] for t in texts for i in range(len(t) - LENGTH + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - LENGTH + 1):
            if seen[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\x01" * LENGTH
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def found(df):
    return sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in suffixes.removed(df).collect())


def expected(rows):
    return sorted((r[0], *x) for r, x in zip(rows, brute([(r[1] or "").encode() for r in rows]), strict=True))


def prose(r, n):
    return "".join(r.choice("abcdefgh é ") for _ in range(n))


def planted(r):
    """Passages at every shift, at the edges and of lengths about LENGTH; copies; a text that repeats itself; touching spans."""
    passages = [prose(r, n) for n in (150, 170, 190, 195, 198, 230, 400, 900)] + ["x" * 199, "y" * 200, "z" * 201, "q" * 1500]
    rows = []
    for k in range(150):
        parts = [prose(r, r.randrange(0, 300))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(passages), prose(r, r.choice([0, 1, 7, 133, 140]))]
        rows.append((k, "".join(parts)))
    twice = prose(r, 700)
    rows += [(200 + k, rows[k][1]) for k in range(20)] + [(300, twice + twice), (301, twice[:350]), (302, twice[350:] + twice[:350])]
    rows += [(400, "w" * 199), (401, "v" * 200), (402, "u" * 201), (403, prose(r, 30_000) + twice[100:400] + passages[7])]
    return rows


@pytest.mark.parametrize("period, cover", suffixes.LEVELS)
def test_any_two_places_share_a_shift(period, cover):
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


@pytest.mark.parametrize("small", [False, True])
def test_planted_passages(frame, monkeypatch, small):
    if small:  # many blocks, slices, groups and buckets, and buckets merged as they are read
        for name, value in (("BLOCK", 3000), ("BUCKET", 200), ("MERGE", 300), ("SEGMENT", 133 * 31), ("GROUP", 700), ("FILES", 4)):
            monkeypatch.setattr(suffixes, name, value)
    rows = planted(random.Random(7))
    got = found(frame(rows).repartition(4))
    assert got == expected(rows)
    assert sum(0 < x[2] < x[1] for x in got) > 50


def test_odd_rows(odd):
    rows = [(x[0] if x[0] is not None else -1, *x[1:]) for x in ODD]
    got = sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in suffixes.removed(odd).collect())
    assert got == expected(rows)


def test_no_rows(odd):
    assert suffixes.removed(odd.limit(0)).collect() == []
    assert [x["n_bytes"] for x in suffixes.removed(odd.where("doc_id = 4")).collect()] == [3]


def test_query(spark, data, same):
    same(suffixes.query(spark, data), suffixes.ORACLE)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lectern_")]
