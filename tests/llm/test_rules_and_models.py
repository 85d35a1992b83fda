"""Quality rules, languages, personal data, mixtures and the pipeline."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers as vocabularies
from lectern.llm import boosting, common, language, mixing, private, quality

from .conftest import ODD

WORDS = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su", "ne") for b in ("na", "ko", "ri", "le", "pa")]


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def brute_repeats(w):
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({p + k for at in seen.values() if len(at) > 1 for p in at for k in range(3)})


def test_quality_equals_sql(spark, data, same):
    same(quality.query(spark, data), quality.ORACLE)


def test_quality_figures(frame):
    texts = [None, "", "a b a b a b", "x\n x\nx\n\n  \nx", "#1 <tag> 100%", "a b c a b c d\na b", "é à é à é à é"]
    got = {r["doc_id"]: r for r in quality.judged(frame(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if x.strip()]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), brute_repeats(w))
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == expected
        assert got[i]["base_failed"] and not got[i]["kept"]


def test_quality_verdicts(frame):
    r = random.Random(1)
    notice = "Copyright notice of this site, all pages are subject to it and it is rather long " * 4
    rows = [(i, f"{prose(r, 120)}\n{notice}\n{prose(r, 30)}") for i in range(30)]
    rows += [(100 + i, f"{prose(r, 8)}\n{notice}\n{prose(r, 9)}") for i in range(5)]
    copy = "\n".join(prose(r, 20) for _ in range(6))
    rows += [(200 + i, copy) for i in range(40)]
    got = {x["doc_id"]: x for x in quality.judged(frame(rows)).collect()}
    assert all(got[i]["kept"] and got[i]["removed_lines"] == 1 for i in range(30))
    assert not any(got[100 + i]["kept"] for i in range(5))
    assert all(got[200 + i]["kept"] and got[200 + i]["removed_lines"] == 0 for i in range(40))
    clean = quality.cleaned(frame(rows))
    assert clean.columns == frame([]).columns and clean.count() == 70
    one = clean.where("doc_id = 3").first()
    assert notice.strip() not in one["text"] and one["n_chars"] == len(one["text"]) and one["excess"] == 2 and one["r"] == "q"


def test_shared_lines_go_however_many_there_are(frame):
    """Templates of 1 to 20 lines, several draws of each: every shared line is removed from every page."""
    rows, hosts = [], {}
    for shared in (1, 2, 4, 8, 12, 20):
        for draw in range(3):
            r = random.Random(1000 * shared + draw)
            template = [f"{prose(r, 5)} template" for _ in range(shared)]
            for i in range(30):
                own = [prose(r, 40) for _ in range(6)]
                rows.append((len(rows), "\n".join([*template[: shared // 2], *own, *template[shared // 2 :]]), "en", f"h{shared}.{draw}"))
            hosts[f"h{shared}.{draw}"] = shared
    got = quality.judged(frame(rows)).collect()
    assert len(got) == len(rows) and all(x["removed_lines"] == hosts[x["host"]] and x["kept"] for x in got)


def test_lines_that_spread_by_copies_stay(frame):
    r = random.Random(4)
    notice, page = prose(r, 12), "\n".join(prose(r, 20) for _ in range(6))
    rows = [(i, f"{notice}\n{page}") for i in range(500)] + [(1000 + i, f"{notice}\n{prose(r, 90)}") for i in range(quality.MIN_DOCS - 1)]
    assert {x["removed_lines"] for x in quality.judged(frame(rows)).collect()} == {0}
    rows.append((2000, f"{notice}\n{prose(r, 90)}"))
    got = quality.judged(frame(rows)).collect()
    assert {x["removed_lines"] for x in got} == {1} and all(x["kept"] for x in got)


def test_hot_and_other_lines_are_joined_alike(frame, monkeypatch):
    r = random.Random(6)
    lines = [prose(r, 6) for _ in range(9)]
    rows = [(i, "\n".join([lines[0], *r.sample(lines[1:], 4), prose(r, 80)])) for i in range(60)]
    results = []
    for hot in (0, 5, common.HOT):
        monkeypatch.setattr(common, "HOT", hot)
        results.append(sorted((x["doc_id"], sorted(x["excess"])) for x in quality.judged(frame(rows)).collect()))
    assert results[0] == results[1] == results[2] and all(len(x) == 5 for _, x in results[0])


def test_rows_of_one_id_have_their_own_verdicts(frame):
    r = random.Random(8)
    good, other = prose(r, 80), prose(r, 90)
    rows = [(1, good), (1, "too short"), (None, other), (None, "x"), (None, other), (2, good)]
    clean = quality.cleaned(frame(rows))
    assert sorted((str(x["doc_id"]), x["text"]) for x in clean.collect()) == sorted([("1", good), ("None", other), ("None", other), ("2", good)])  # a repeated row stays a row


def test_quality_cases(odd, frame):
    assert quality.judged(odd).count() == len(ODD)
    assert quality.judged(frame([])).count() == 0 and quality.cleaned(frame([])).count() == 0


def test_language_held_out(spark, data, documents):
    langs = {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [r for r in language.query(spark, data).collect() if r["held_out"]]
    assert len(held) > 20 and np.mean([langs[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_language_mixture(spark, documents):
    model = language.trained(documents)
    by = {r["lang"]: r["text"] for r in documents.where("length(text) between 1500 and 4000").collect()}
    mixed = by["en"][:1400] + " " + by["de"][:1400]
    rows = spark.createDataFrame([(1, mixed), (2, by["fr"]), (3, None), (4, "12 34 !"), (5, ""), (None, by["es"])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predicted(rows, model).collect()}
    assert set(got[1]["mixture"]) == {"en", "de"} and got[1]["mixture"]["en"] == pytest.approx(0.5, abs=0.12)
    assert (got[2]["lang_pred"], set(got[2]["mixture"])) == ("fr", {"fr"}) and got[None]["lang_pred"] == "es"
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (3, 4, 5))


def test_language_cases(spark, frame, odd):
    empty = language.trained(frame([]))
    assert empty[0] == [] and {r["lang_pred"] for r in language.predicted(odd, empty).collect()} == {"und"}
    assert language.predicted(frame([]), empty).count() == 0
    assert language.trained(odd)[0] == ["en"]


def test_em_finds_proportions():
    r = np.random.default_rng(0)
    p = r.dirichlet(np.full(language.BUCKETS, 0.02), 3) + 1e-9
    p /= p.sum(axis=1, keepdims=True)
    found = np.concatenate([r.choice(language.BUCKETS, 1500, p=p[0] / p[0].sum()), r.choice(language.BUCKETS, 500, p=p[2] / p[2].sum())])
    shares = language.mixture(found, p)
    assert set(shares) == {0, 2} and shares[0] == pytest.approx(0.75, abs=0.03)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(t):
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if ok[k](m[0]))


def test_base_spans_equal_brute_force(spark):
    r = random.Random(9)
    signs = ["1", "2.3.4.5", "255.", "256", "a@b.c", "@", ".", "-", " ", "+1 (017) 555-7713", "+", "(", "4111 1111 1111 1111", "4111-1111-1111-1111", "x", "_", "é", "😀", "%", "a.b+c@d-e.f.g", "000"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(400)] + ["1." * 3000, "a" * 20_000, "1" * 20_000, "+1" + " " * 5000, "a.b" * 3000 + "@c.d" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {x["i"]: [(s["s"], s["k"], s["e"]) for s in x["b"]] for x in rows.select("i", private.base_spans(F.col("text")).alias("b")).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def test_private_query(spark, data, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in private.query(spark, data).collect():
        base = brute_base(texts[r["doc_id"]])
        shown = ",".join(f"{private.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(b[1] == k for b in base) for k in range(4)]
        assert set(filter(None, shown.split(","))) <= set(r["spans"].split(","))


def test_private_candidates(frame):
    rows = [
        (1, "please mail jane.doe (at) example (dot) com for it"), (2, "call (017) 555-7713 today"), (3, 'api token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ok'),
        (4, "we met at noon. Then we left at six. And so on"), (5, "on 2024-05-06 version 1.2.3 of page 12 34 56 was read"), (6, "the account DE12 3456 7890 1234 5678 is open"), (7, None), (8, "my ssn 123-45-6789 is here"),
    ]
    got = {r["doc_id"]: {private.KINDS[s["k"]] for s in r["spans"]} for r in private.found_spans(frame(rows)).collect()}
    assert got == {1: {"email"}, 2: {"phone"}, 3: {"secret"}, 4: set(), 5: set(), 6: {"id"}, 7: set(), 8: {"id"}}


def test_redaction(spark, frame):
    long = "word " * 700 + "a@b.cd" + " é😀" * 700 + "x@y.zz"
    out = {r["doc_id"]: r for r in private.cleaned(frame([(1, long), (2, "none here"), (3, None), (4, "")])).collect()}
    assert out[1]["text"] == long.replace("a@b.cd", "[EMAIL]").replace("x@y.zz", "[EMAIL]") and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "none here" and out[3]["text"] is None and out[4]["text"] == "" and out[2]["base"] == "b"
    spans = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(k).alias("k"), F.lit(e).alias("e")) for s, k, e in [(0, 0, 4), (2, 1, 3), (3, 2, 6), (6, 3, 8)]])
    assert spark.range(1).select(private.redacted(F.lit("abcdefghij"), spans).alias("x")).first()["x"] == "[EMAIL][PHONE]ij"
    assert private.cleaned(frame([])).count() == 0


def test_private_cases(odd):
    assert private.found_spans(odd).count() == len(ODD)


def test_running_sums(spark):
    r = random.Random(2)
    for n in (1, 63, 64, 65, 300):
        xs = [r.randint(0, 9) for _ in range(n)]
        got = spark.range(1).select(private._sums(F.array(*map(F.lit, xs))).alias("x")).first()["x"]
        assert got == [0, *itertools.accumulate(xs)][:-1]


def test_boosting(spark):
    r = np.random.default_rng(1)
    x = r.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    trees = boosting.fit(x[:400], y[:400])
    scores = boosting.predict(trees, x[400:])
    assert np.mean((scores > 0.5) == y[400:]) > 0.93
    rows = spark.createDataFrame([tuple(map(float, v)) for v in x[400:430]], "a double, b double, c double")
    got = [v["s"] for v in rows.select(boosting.expression(trees, [F.col(c) for c in "abc"]).alias("s")).collect()]
    assert got == pytest.approx(scores[:30].tolist())
    assert boosting.threshold(np.array([0.9, 0.8, 0.7, 0.6]), np.array([1, 1, 0, 1]), 0.99) == pytest.approx(0.8)
    assert boosting.threshold(np.array([0.9]), np.array([0]), 0.99) > 1


TOKENS = mixing.vocabulary()


def brute_raking(n, goals, axes, sweeps=3000):
    """Weights of the array ``n`` by plain sweeps; ``axes`` lists which axes stay in each margin."""
    w = n.copy()
    for _ in range(sweeps):
        for goal, keep in zip(goals, axes, strict=True):
            sums = w.sum(axis=tuple(a for a in range(w.ndim) if a not in keep), keepdims=True)
            w = w * np.divide(goal.reshape(sums.shape), sums, out=np.zeros_like(sums), where=sums > 0)
    return w


def brute_factor(rates, n, keep):
    """The factor at which sum(n * min(1, factor * rate)) is keep * sum(n), by bisection."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (n * np.minimum(1, mid * rates)).sum() < keep * n.sum() else (low, mid)
    return high


def test_raking_equals_brute_force(spark):
    r = np.random.default_rng(5)
    n = r.integers(1, 50, (3, 2, 4)).astype(float)
    source, topic = r.dirichlet(np.ones(3)), r.dirichlet(np.ones(8)).reshape(2, 4)
    w = brute_raking(n, [source, topic.sum(axis=1), topic], [(0,), (1,), (1, 2)])
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"l{j}/{k}", int(n[i, j, k])) for i, j, k in np.ndindex(*n.shape)], "source string, lang string, topic string, n long")
    frame_ = lambda pairs: spark.createDataFrame([(v, float(x)) for v, x in pairs], "value string, share double")
    frames = {"source": frame_((f"s{i}", x) for i, x in enumerate(source)), "lang": frame_((f"l{j}", x) for j, x in enumerate(topic.sum(axis=1))), "topic": frame_((f"l{j}/{k}", topic[j, k]) for j, k in np.ndindex(2, 4))}
    found, gap = mixing.fitted(cells, frames)
    got = {(x["source"], x["topic"]): x["w"] for x in found.collect()}
    assert gap <= mixing.ENOUGH and len(got) == n.size
    for i, j, k in np.ndindex(*n.shape):
        assert got[f"s{i}", f"l{j}/{k}"] == pytest.approx(w[i, j, k], rel=1e-3)
    prob = mixing.calibrated(found, 0.6).collect()
    assert sum(x["n"] * x["probability"] for x in prob) == pytest.approx(0.6 * n.sum()) and max(x["probability"] for x in prob) <= 1


def test_targets_that_cannot_hold(spark):
    cells = spark.createDataFrame([("a", "x", "x/0", 10), ("b", "y", "y/0", 10)], "source string, lang string, topic string, n long")
    share = lambda *pairs: spark.createDataFrame(list(pairs), "value string, share double")
    targets = {"source": share(("a", 0.9), ("b", 0.1)), "lang": share(("x", 0.1), ("y", 0.9)), "topic": share(("x/0", 0.1), ("y/0", 0.9))}
    with pytest.raises(ValueError, match="off by 0.8"):
        mixing.fitted(cells, targets, sweeps=20)
    assert mixing.fitted(cells, targets, sweeps=20, strict=False)[1] == pytest.approx(0.8)


def test_topics_follow_the_texts(spark):
    """Texts of three vocabularies (and common words) fall into clusters that each hold one vocabulary."""
    r = random.Random(2)
    own = ["ship harbour sailor anchor ocean captain vessel island storm wind".split(), "kitchen butter sugar oven recipe flour pepper onion cheese bread".split(), "planet telescope galaxy orbit comet eclipse asteroid gravity moon star".split()]
    common_words = "people found many other years around again before while their".split()
    rows = [(i, " ".join(r.choice(own[i % 3] if r.random() < 0.6 else common_words) for _ in range(80)), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, terms = mixing.topic_model(docs, TOKENS), mixing.Terms(*TOKENS)
    found = list(zip(mixing.nearest(terms.read([t for _, t, _ in rows])[1], model["en"]), (i % 3 for i, _, _ in rows), strict=True))
    by = {}
    for topic, label in found:
        by.setdefault(topic, []).append(label)
    pure = sum(max(labels.count(k) for k in range(3)) for labels in by.values())
    assert len(by) >= 3 and pure >= 0.95 * len(rows)
    assert mixing.topic_model(docs, TOKENS)["en"][1].tolist() == model["en"][1].tolist()


def test_topics_are_fitted_on_all_documents(spark):
    """Inverse document frequencies are those of all 6,000 texts, centres a fixed point over all, however the rows are dealt."""
    r = random.Random(4)
    some = "ship harbour sailor kitchen butter sugar planet telescope galaxy orbit".split()
    texts = [" ".join(r.choices(some, k=4)) for _ in range(6000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(9000 + i, t, "fr") for i, t in enumerate(texts[:39])], "doc_id long, text string, lang string")
    model, other = mixing.topic_model(docs.repartition(5), TOKENS), mixing.topic_model(docs.coalesce(1), TOKENS)
    assert list(model) == ["en"] and model["en"][1].tolist() == other["en"][1].tolist()
    counts = mixing.Terms(*TOKENS).read(texts)[1]
    idf, centres = model["en"]
    assert idf.tolist() == pytest.approx(np.log(6001 / (1 + (counts > 0).sum(axis=0))).tolist())
    x = mixing.unit(np.log1p(counts) * idf)
    near = np.argmax(np.round(x @ centres.T, 9), axis=1)
    moved = np.array([mixing.unit(x[near == k].sum(axis=0)) for k in range(len(centres))])
    assert len(centres) == mixing.TOPICS and (moved * centres).sum(axis=1).min() > 0.98


def brute_probabilities(source, topic, n_tokens, keep=mixing.KEEP):
    """(probability of each row, gaps of the sweeps): cells in arrays, plain sweeps, a factor by bisection."""
    sources, topics = sorted(set(source)), sorted(set(topic))
    langs = sorted({t.rsplit("/", 1)[0] for t in topics})
    n = np.zeros((len(sources), len(topics)))
    for s, t, k in zip(source, topic, n_tokens, strict=True):
        n[sources.index(s), topics.index(t)] += k
    power = lambda x, p: np.where(x > 0, x, 0) ** p * (x > 0) / (x[x > 0] ** p).sum()
    of = np.array([langs.index(t.rsplit("/", 1)[0]) for t in topics])
    lang_share = power(np.bincount(of, n.sum(axis=0)), 0.7)
    held = n.sum(axis=0) > 0
    topic_share = np.where(held, lang_share[of] / np.bincount(of, held)[of], 0)
    w, gaps = n.copy(), []
    while True:
        sums = w.sum(axis=1)
        w = w * np.divide(power(n.sum(axis=1), 0.7), sums, out=np.zeros_like(sums), where=sums > 0)[:, None]
        gaps.append(max(np.abs(w.sum(axis=0) - topic_share).max(), np.abs(np.bincount(of, w.sum(axis=0)) - lang_share).max()))
        if gaps[-1] <= 1e-6 or (len(gaps) > 10 and gaps[-1] > 0.9 * gaps[-11]):
            break
        for at, goal in ((of, lang_share), (np.arange(len(topics)), topic_share)):
            sums = np.bincount(at, w.sum(axis=0), len(goal))
            w = w * np.divide(goal, sums, out=np.zeros_like(sums), where=sums > 0)[at]
    rates = np.divide(w * n.sum(), n, out=np.zeros_like(n), where=n > 0)
    factor = brute_factor(rates, n, keep)
    cells = [(sources.index(s), topics.index(t)) for s, t in zip(source, topic, strict=True)]
    return [min(1, factor * rates[c]) if n[c] else keep for c in cells], gaps


def test_mixture_query_equals_brute_force(spark, data, documents):
    """Tokens from another library with the same vocabulary, cells in arrays, plain sweeps, a factor by bisection, draws row by row."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    docs = {r["doc_id"]: r for r in documents.collect()}
    rows = mixing.query(spark, data).toPandas()
    assert len(rows) == len(docs)
    assert all(n == len(library.encode(docs[d]["text"] or "", add_special_tokens=False)) for d, n in zip(rows.doc_id, rows.n_tokens, strict=True))
    assert all((s, lg) == (docs[d]["source"] or "", docs[d]["lang"] or "") for d, s, lg in zip(rows.doc_id, rows.source, rows.lang, strict=True))
    model, terms = mixing.topic_model(documents, TOKENS), mixing.Terms(*TOKENS)
    assert all(t == f"{lg}/{mixing.nearest(terms.read([docs[d]['text'] or ''])[1], model.get(lg))[0]}" for d, t, lg in zip(rows.doc_id, rows.topic, rows.lang, strict=True))

    draw = documents.select("doc_id", (F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id", F.md5(F.coalesce("text", F.lit("")))), 11) * F.lit(2.0**-53)).alias("u")).collect()
    probability, gaps = brute_probabilities(rows.source, rows.topic, rows.n_tokens)
    assert rows.probability.tolist() == pytest.approx(probability, rel=1e-3)
    u = {r["doc_id"]: r["u"] for r in draw}
    assert rows.sampled.tolist() == [u[d] < p for d, p in zip(rows.doc_id, rows.probability, strict=True)]
    assert rows.gap.tolist() == pytest.approx([gaps[-1]] * len(rows), rel=1e-6)  # few documents: not all of the default targets can hold
    assert (rows.n_tokens * rows.probability).sum() / rows.n_tokens.sum() == pytest.approx(mixing.KEEP, abs=1e-4)


def test_tokens_around_long_blanks():
    from tokenizers import Tokenizer

    library, terms = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json")), mixing.Terms(*TOKENS)
    library.encode_special_tokens = True
    for run in (" " * 12_000, "\n" * 12_000, " \t" * 6000, "\u3000" * 10_000):
        for text in (f"one{run}two", f"one{run}", f"{run}two <|endoftext|>", run, f"a{run}.b{run}c", f"x{run}\u3000y"):
            assert terms.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(terms.encode(" " * 3_000_000 + "a")) > 1


def test_mixture_cases(odd, frame):
    rows = mixing.mixed(odd, TOKENS).collect()
    assert len(rows) == len(ODD) and all(0 < r["probability"] <= 1 for r in rows)
    assert len({r["sampled"] for r in rows if r["doc_id"] == 8}) == 1
    assert mixing.mixed(frame([]), TOKENS).count() == 0 and mixing.sample(frame([]), TOKENS).count() == 0
    assert {r["probability"] for r in mixing.mixed(frame([(1, None), (2, "")]), TOKENS).collect()} == {mixing.KEEP}
    assert mixing.sample(odd, TOKENS).columns == odd.columns


def test_sample_tells_rows_of_one_id_apart(frame):
    rows = [(None, f"text number {i} of the rows without an id") for i in range(60)] + [(5, f"another {i}") for i in range(60)]
    kept = mixing.sample(frame(rows), TOKENS, 0.5).collect()
    assert 30 <= len(kept) <= 90 and len({r["text"] for r in kept}) == len(kept)


def test_stages_alone(spark, odd, frame, data):
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd, data), stage(spark, frame([]), data)
        assert none.count() == 0 and out.count() <= len(ODD), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns
