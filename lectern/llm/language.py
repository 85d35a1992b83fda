"""Language identification as inference of multilingual mixtures.

Training counts hashed letter trigrams of every labelled document by language (BUCKETS counts a
language, whatever the corpus' size) and smooths them to likelihoods.  A document is a mixture:
its trigrams come from languages with unknown proportions, which expectation-maximisation
estimates.  The set of languages grows from the most likely one, by the language whose likelihood
ratio promises most, as long as the gain in log-likelihood exceeds PENALTY * log(trigrams) / 2.

Cases: a text that is null or has no letter is ``und`` with score 0, and so are all texts if
nothing is labelled; rows with a null language are not learned from; ties go to the language that
sorts first; repeated rows count each time; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import session, table

BUCKETS, SMOOTHING, PENALTY, ROUNDS, ENOUGH = 1 << 15, 0.5, 2.0, 40, 1e-4
UNKNOWN = "und"


def trigrams(text: str | None):
    """Buckets of the letter trigrams, words set apart by blanks; None without a letter."""
    import re

    import numpy as np

    joined = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
    if not any(map(str.isalpha, joined)):
        return None
    c = np.frombuffer(f" {joined} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def trained(labelled: DataFrame):
    """(languages, log-likelihood-ready probabilities as an array of languages x BUCKETS) from rows (text, lang)."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found = trigrams(text)
                if found is not None:
                    held = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    held += np.bincount(found, minlength=BUCKETS)
        for lang, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(held[at])], ["lang", "bucket", "n"])

    session(labelled)
    counts = labelled.where("lang is not null").select("text", "lang").mapInArrow(run, "lang string, bucket long, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows a language
    langs = sorted({r["lang"] for r in rows})
    index = {lang: i for i, lang in enumerate(langs)}
    table_ = np.full((len(langs), BUCKETS), SMOOTHING)
    for r in rows:
        table_[index[r["lang"]], r["bucket"]] += r["n"]
    return langs, (table_ / table_.sum(axis=1, keepdims=True) if langs else table_)


def mixture(found, probabilities) -> dict[int, float]:
    """Proportions of the selected languages (by index) in a document's trigrams."""
    import numpy as np

    counts = np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    c = counts[at].astype(float)
    p, n = probabilities[:, at], c.sum()
    single = np.log(p) @ c
    chosen = [int(np.argmax(single))]
    share, likelihood, blend = np.ones(1), float(single[chosen[0]]), p[chosen[0]]
    while len(chosen) < len(p):
        promise = p @ (c / blend) / n
        promise[chosen] = 0
        best = int(np.argmax(promise))
        if promise[best] <= 1:
            break
        trial = [*chosen, best]
        q, theta = p[trial], np.append(share * 0.9, 0.1)
        for _ in range(ROUNDS):
            new = theta * (q @ (c / (theta @ q))) / n
            moved, theta = np.abs(new - theta).max(), new
            if moved < ENOUGH:
                break
        reached = float(np.log(theta @ q) @ c)
        if reached - likelihood <= PENALTY * np.log(n) / 2:
            break
        chosen, share, likelihood, blend = trial, theta, reached, theta @ q
    return dict(zip(chosen, share.tolist(), strict=True))


def predicted(docs: DataFrame, model) -> DataFrame:
    """(doc_id, lang_pred, score, mixture map) of every row; the score is the language's proportion."""
    langs, probabilities = model

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = trigrams(text) if langs else None
                if found is None:
                    out.append((UNKNOWN, 0.0, []))
                    continue
                shares = sorted(((langs[i], x) for i, x in mixture(found, probabilities).items()), key=lambda x: (-x[1], x[0]))
                out.append((shares[0][0], min(1.0, shares[0][1]), shares))
            names, scores, shares = zip(*out, strict=True) if out else ([], [], [])
            arrays = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "mixture"])

    session(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    found = predicted(docs, trained(docs.where(fold != 2)))
    shares = F.array_join(F.transform(F.map_entries("mixture"), lambda e: F.format_string("%s:%.3f", e["key"], e["value"])), ",")
    held_out = F.coalesce(fold == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", shares.alias("proportions"))
