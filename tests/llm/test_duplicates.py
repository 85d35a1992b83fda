"""SimHash groups, components, substring removal and multiset fingerprints against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from lectern.llm import components, multiset, simhash, substrings

from .conftest import ODD


def brute_fingerprint(text):
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, linked):
    up = {x: x for x in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(items, 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {x: find(x) for x in items}


def brute_groups(rows):
    prints = {}
    for doc, text in rows:
        prints.setdefault(brute_fingerprint(text), []).append(doc)
    root = roots(list(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for fp, ids in prints.items():
        for d in ids:
            if d is not None:
                least[root[fp]] = min(least.get(root[fp], d), d)
    return {(d, fp): least.get(root[fp]) for fp, ids in prints.items() for d in ids}


def test_covering_guarantee():
    for positions in (list(range(64)), list(range(5, 37))):
        masks = simhash.covering_masks(positions, 3)
        assert len(masks) == 15
        for bits in itertools.combinations(positions[::3] + positions[:4], 3):
            changed = sum(1 << b for b in set(bits))
            assert any(not m & changed for m in masks)


def test_near_duplicates(frame):
    rows = [(r[0], r[1]) for r in ODD]
    base = "the quick brown fox jumps over the lazy dog while seven other animals watch from the hill " * 6
    words = base.split()
    r = random.Random(7)
    for i in range(40):
        w = list(words)
        w[r.randrange(len(w))] = f"edit{i}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, " ".join(r.choice("abcdefghij") * 3 for _ in range(60))) for i in range(40)]
    got = {(x["doc_id"], simhash.signed(brute) % (1 << 64)): x["component_id"] for x in simhash.near_duplicates(frame(rows)).collect() for brute in [x["fp"]]}
    assert got == brute_groups(rows)
    assert len({c for (d, _), c in got.items() if d and 100 <= d < 140}) < 40


def test_split_buckets_lose_no_link(spark):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(30)}
    for x in list(fps):
        for _ in range(6):
            y = x
            for _ in range(r.randint(1, 4)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
    expected = roots(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    table = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    for limit in (1, 4096):
        found = {x["node"] % (1 << 64): x["root"] % (1 << 64) for x in components.components(simhash.links(table, split_above=limit)).collect()}
        groups = {}
        for x in fps:
            groups.setdefault(found.get(x, x), set()).add(expected[x])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected.values()))


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_documents(frame):
    assert simhash.near_duplicates(frame([])).count() == 0


def test_hot_fingerprints(frame, monkeypatch):
    """A third of the rows without a word, a third of one text: the hot keys are joined as the others."""
    from lectern.llm import common

    r = random.Random(3)
    rows = [(i, None) for i in range(60)] + [(100 + i, "the same words in every row") for i in range(60)] + [(200 + i, " ".join(r.choice("abcdefgh") * 3 for _ in range(9))) for i in range(60)]
    for hot in (0, 4, common.HOT):
        monkeypatch.setattr(common, "HOT", hot)
        got = {(x["doc_id"], x["fp"] % (1 << 64)): x["component_id"] for x in simhash.near_duplicates(frame(rows)).collect()}
        assert got == brute_groups(rows)


def test_simhash_query(spark, data, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in simhash.query(spark, data).collect()}
    assert got == brute_groups(rows)


def brute_kept(rows):
    seen, out = set(), {}
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.setdefault(doc, []).append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(frame):
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    passages = [prose(r.randint(18, 70)) for _ in range(6)]
    rows = []
    for i in range(60):
        body = []
        for _ in range(r.randint(0, 4)):
            body += prose(r.randint(0, 40)) + (r.choice(passages) if r.random() < 0.7 else [])
        rows.append((i, " ".join(body)))
    rows += [(70 + i, rows[3][1]) for i in range(3)] + [(80, "a " * 500), (81, "a " * 100), (82, "x y " * 30), (83, None), (84, " ".join(passages[0][:19]))]
    got = {x["doc_id"]: [(x["n_words"], x["n_removed"], x["kept_sha256"])] for x in substrings.deduplicated(frame(rows)).collect()}
    assert got == brute_kept(rows)


def test_substring_cases(frame):
    got = substrings.deduplicated(frame(ODD))
    assert got.count() == len(ODD)
    assert {r["n_removed"] for r in got.where("doc_id = 4 or doc_id is null").collect()} == {0}
    assert got.where("doc_id = 11").first()["n_removed"] == 2999  # its first window stays, and one word after it
    twice = " ".join(f"v{i}" for i in range(30))
    same = substrings.deduplicated(frame([(1, twice), (1, twice)])).collect()
    assert sorted(r["n_removed"] for r in same) == [0, 30]
    assert substrings.deduplicated(frame([])).count() == 0


def test_substring_query(spark, data, documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    got = {x["doc_id"]: [(x["n_words"], x["n_removed"], x["kept_sha256"])] for x in substrings.query(spark, data).collect()}
    assert got == brute_kept(rows)


def test_window_anchors_across_segments(monkeypatch):
    h = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    whole = substrings.window_anchors(h)
    monkeypatch.setattr(substrings, "SEGMENT", 37)
    assert (substrings.window_anchors(h) == whole).all()
    assert all(h[p : p + 16].min() == h[a] for p, a in enumerate(whole))


def prints(frame, texts):
    from pyspark.sql import functions as F

    rows = frame(list(enumerate(texts)))
    out = multiset.fingerprints(rows.select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("t")), ["t"], "k")
    return out.select("k", F.col("t_fp").alias("fp"))


def test_multiset_laws(frame):
    from pyspark.sql import functions as F

    got = prints(frame, ["a line here\nother line", "other line\na line here", "a line here", "other line", "", None, "a line here\nother line\nother line"])
    text = {r["k"]: r["x"] for r in got.select("k", multiset.as_text(F.col("fp")).alias("x")).collect()}
    assert text[0] == text[1] and len({text[i] for i in (0, 2, 3, 4, 6)}) == 5 and text[4] == text[5]
    pair = got.where("k = 2").select(F.col("fp").alias("a")).join(got.where("k = 3").select(F.col("fp").alias("b")))
    both = pair.select(multiset.as_text(multiset.combined(F.col("a"), F.col("b"))).alias("x"), multiset.as_text(multiset.combined(multiset.combined(F.col("a"), F.col("b")), F.col("b"), -1)).alias("y")).first()
    assert both["x"] == text[0] and both["y"] == text[2]
    like = pair.select(multiset.likeness(F.col("a"), F.col("a")).alias("x")).first()["x"]
    assert like == 1.0


def test_multiset_query(spark, data, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    ids = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in multiset.query(spark, data).collect()}
    assert len(got) == len(texts)
    for doc, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n = texts[doc], texts[after]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[doc]["n_chars"] == len(t)
        assert 0 <= got[doc]["near_next"] <= 1 and 0 <= got[doc]["near_edited"] <= 1
    by_text = {}
    for doc in ids:
        by_text.setdefault(texts[doc], set()).add(got[doc]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len({next(iter(x)) for x in by_text.values()}) == len(by_text)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def test_next_text(frame):
    rows = multiset.with_next(frame([(1, "a"), (3, "c"), (2, None), (None, "n"), (3, "c")])).collect()
    assert sorted((r["text"], r["next_text"]) for r in rows) == sorted([("c", "c"), ("c", ""), ("", "a"), ("a", "n"), ("n", "c")])
    assert multiset.with_next(frame([(1, "a")])).first()["next_text"] == "a"
    assert multiset.with_next(frame([])).count() == 0


def test_odd_multisets(odd):
    assert multiset.with_next(odd).count() == len(ODD)


def test_simhash_of_odd(odd):
    assert {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in simhash.near_duplicates(odd).collect()} == brute_groups([(r[0], r[1]) for r in ODD])


@pytest.mark.parametrize("n", [1, 2, 3, 17])
def test_linked_chain(n):
    fps = np.array([(1 << 3 * i) - 1 for i in range(n)], np.uint64)
    assert set(simhash.linked(fps, 3).tolist()) == {0}


def test_substrings_equal_sql(spark, data, same):
    same(substrings.query(spark, data), substrings.ORACLE)


def test_substrings_beyond_the_most_buckets(frame, monkeypatch):
    """More buckets asked for than a table can have: fewer, joined by sorting; the table goes when the work fails, too."""
    r = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join([*[f"w{r.randrange(10**6)}" for _ in range(40)], passage if i % 3 else "", "end"])) for i in range(60)]
    df = frame(rows)
    read = lambda: sorted(map(tuple, substrings.deduplicated(df).collect()))
    whole = read()
    monkeypatch.setattr(substrings, "BUCKET", 1)
    monkeypatch.setattr(substrings, "FILES", 5)
    assert read() == whole and sum(x[2] for x in whole) > 0
    monkeypatch.setattr(substrings, "_level", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        read()
    assert not [t.name for t in df.sparkSession.catalog.listTables() if t.name.startswith("lectern_")]
