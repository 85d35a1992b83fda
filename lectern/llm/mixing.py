"""Mixing sources to target weights by iterative proportional fitting.

Tokens of all documents (of a byte-level vocabulary, given as the path of its ranks and its pattern)
are summed by cell (source, language, topic).  Raking scales the cells' weights to one marginal after the other until all targets hold; a
cell's rate is its weight over its tokens.  Inclusion probabilities are min(1, factor * rate) with
the factor that makes the expected number of tokens KEEP times the tokens there are, and a document
is in the sample if a hash of its id and text lies below its probability.

Topics come from the texts: term vectors (tokens of three letters or more, hashed
to WIDTH buckets; logarithmic counts times inverse document frequency) are clustered by spherical k-means over all
documents, TOPICS clusters in each language with LEAST documents and one in MOST_LANGS of all (another has one topic).
A round is one pass that sums the vectors by cluster; every document is then given the nearest
cluster.  A topic is named ``language/number``, so that a language's topics share out its weight.

Raking has one form for any number of sources: a cell's weight is tokens * a[source] * f[topic].
Each sweep is one pass over the sources, which gives the sums by topic under the sources' own
scaling; the factors of languages and topics, of which there are at most MOST_TOPICS, are kept on
the driver.  Targets that are given must be met within ENOUGH, or ``fitted`` raises an error that
names what is left.  The default targets are tempered marginals (a value's share is its share of
tokens to the power of TEMPERING, normalised; a language's topics share equally): where cells are
too sparse for all of them to hold, the largest gap that remains comes back in the column ``gap``.

Cases: null sources and languages are values of their own (``''``); a null or blank text has topic
0 and the probability of its cell; cells without tokens have probability KEEP; a text as near to
two clusters has the first; rows of equal id and text fall together; an empty table gives no rows;
input columns named like ours are not read beyond doc_id, text, source and lang.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import hot_join, session, staged, table

MODEL = "byte_bpe_50k.tiktoken"
#: A run of white space this long is set apart, as the library's pattern cannot pass it.
BLANK_RUN = 10_000
TOPICS, WIDTH, LEAST, MOST_LANGS, ROUNDS, BITS = 8, 1024, 40, 100, 15, 24
TEMPERING, KEEP, SEED = {"source": 0.7, "lang": 0.7, "topic": 0.0}, 0.8, 7
SWEEPS, ENOUGH, STALL, MOST_TOPICS = 200, 1e-6, 10, 1_000_000
MARGINS = ("source", "lang", "topic")


def vocabulary(name: str = MODEL) -> tuple[str, str]:
    """(path of the ranks, pattern) of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


class Terms:
    """Tokens of texts, and term counts from them."""

    def __init__(self, path: str, pattern: str):
        import base64
        import re

        import numpy as np
        import tiktoken
        import xxhash

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.library = tiktoken.Encoding("mixture", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.buckets = np.full(max(ranks.values()) + 1, WIDTH)
        for token, rank in ranks.items():
            word = token.decode("utf-8", "replace").strip().lower()
            if len(re.findall(r"[^\W\d_]", word)) >= 3:
                self.buckets[rank] = xxhash.xxh32_intdigest(word) % WIDTH
        self.blanks = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % BLANK_RUN)

    def encode(self, text: str) -> list[int]:
        """Ids of a text.  A long run of blanks is one piece by itself, but for a last blank before a word."""
        if len(text) < BLANK_RUN:
            return self.library.encode_ordinary(text)
        out, at = [], 0
        for run in self.blanks.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.library.encode_ordinary(text[at : run.start()])
            out += self.library._encode_single_piece(text[run.start() : end])
            at = end
        return out + self.library.encode_ordinary(text[at:])

    def read(self, texts: list[str]):
        """(number of tokens of each text, counts of its WIDTH term buckets as rows)."""
        import itertools

        import numpy as np

        ids = [self.encode(t) for t in texts]
        sizes = np.array(list(map(len, ids)), np.int64)
        at = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))
        rows = np.repeat(np.arange(len(ids)) * (WIDTH + 1), sizes)
        counts = np.bincount(rows + self.buckets[at], minlength=len(ids) * (WIDTH + 1)).reshape(len(ids), WIDTH + 1)
        return sizes, counts[:, :WIDTH]


def unit(x):
    """Rows of length one; rows of zeros stay."""
    import numpy as np

    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class Sparse:
    """Rows of term counts, each as bytes of its buckets (two a term) and then their counts (four a term)."""

    def __init__(self, rows: list[bytes]):
        import numpy as np

        sizes = np.fromiter((len(r) // 6 for r in rows), np.int64, len(rows))
        self.n, self.rows = len(rows), np.repeat(np.arange(len(rows)), sizes)
        self.buckets = np.frombuffer(b"".join(r[: len(r) // 3] for r in rows), "<u2").astype(np.int64)
        self.logs = np.log1p(np.frombuffer(b"".join(r[len(r) // 3 :] for r in rows), "<u4"))

    @staticmethod
    def packed(counts) -> list[bytes]:
        import numpy as np

        at = [np.flatnonzero(row) for row in counts]
        return [b.astype("<u2").tobytes() + row[b].astype("<u4").tobytes() for b, row in zip(at, counts, strict=True)]

    def weighted(self, idf):
        """(weights of the terms, length of each row)."""
        import numpy as np

        w = self.logs * idf[self.buckets]
        return w, np.sqrt(np.bincount(self.rows, w * w, self.n))

    def scores(self, w, centres):
        """Dot product of each row with each centre; a row's sums do not depend on the rows beside it."""
        import numpy as np

        return np.stack([np.bincount(self.rows, w * c[self.buckets], self.n) for c in centres], axis=1)


def _named(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


def topic_model(docs: DataFrame, tokens: tuple[str, str], seed: int = SEED) -> dict:
    """language -> (inverse document frequencies, centres), fitted on all documents."""
    return clustered(staged(read(docs.select("doc_id", "text", "lang", F.lit("").alias("source")), tokens)), seed)


def _blocks(rows: DataFrame, idf: dict) -> DataFrame:
    """(lang, sizes, draws, buckets, weights): rows of one language of an Arrow batch each, without those that have no terms.

    Weights are those of vectors of length one, times 2 ** BITS and rounded, so that sums of them are whole numbers.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            langs, terms, draws = np.array(batch.column("lang").to_pylist(), object), batch.column("terms").to_pylist(), batch.column("draw").to_numpy()
            for lang in sorted(set(langs.tolist()) & set(idf)):
                at = np.flatnonzero(langs == lang)
                some = Sparse([terms[i] for i in at])
                w, length = some.weighted(idf[lang])
                live = length > 0
                held = live[some.rows]
                w = np.rint(w[held] / length[some.rows[held]] * 2.0**BITS)
                sizes = np.bincount(some.rows[held], minlength=some.n)[live]
                body = [sizes.astype("<i4"), draws[at[live]].astype("<i8"), some.buckets[held].astype("<u2"), w.astype("<i4")]
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *(pa.array([x.tobytes()], pa.binary()) for x in body)], ["lang", "sizes", "draws", "buckets", "weights"])

    return rows.select("lang", "terms", F.xxhash64("doc_id", "whole").alias("draw")).mapInArrow(run, "lang string, sizes binary, draws binary, buckets binary, weights binary")


def _read_blocks(batches, langs):
    """(language, draws, matrix of rows) of each block of ``_blocks`` of one of ``langs``."""
    import numpy as np

    for batch in batches:
        for lang, sizes, draws, buckets, weights in zip(*(batch.column(c) for c in ("lang", "sizes", "draws", "buckets", "weights")), strict=True):
            if (lang := lang.as_py()) in langs:
                sizes, draws = np.frombuffer(sizes.as_buffer(), "<i4"), np.frombuffer(draws.as_buffer(), "<u8")
                x = np.zeros((len(sizes), WIDTH))
                x[np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(buckets.as_buffer(), "<u2")] = np.frombuffer(weights.as_buffer(), "<i4")
                yield lang, draws, x


def _summed(parts):
    """For mapInArrow: arrays (kinds, WIDTH) of whole numbers by language, added up in a task."""
    import numpy as np
    import pyarrow as pa

    held: dict = {}
    for lang, here in parts:
        held[lang] = held[lang] + here if lang in held else here
    for lang, sums in held.items():
        k, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(sums[k, at], pa.int64())], ["lang", "k", "at", "n"])


def _collected(rows: DataFrame, run, langs) -> dict:
    """language -> array (TOPICS, WIDTH): what ``run`` (``_summed``) makes of ``rows``, over all tasks."""
    import numpy as np

    made = rows.mapInArrow(run, "lang string, k int, at int, n long").groupBy("lang", "k", "at").agg(F.sum("n").alias("n")).toArrow()  # a row a centre and bucket
    out = {lang: np.zeros((TOPICS, WIDTH), np.int64) for lang in langs}
    for lang, k, at, n in zip(*(made.column(c).to_pylist() for c in ("lang", "k", "at", "n")), strict=True):
        out[lang][k, at] = n
    return out


def _frequencies(rows: DataFrame, sizes: dict) -> dict:
    """language -> inverse document frequencies over all rows of each language of ``sizes`` (language -> rows)."""
    import numpy as np

    def run(batches):
        def parts():
            for batch in batches:
                langs, terms = np.array(batch.column("lang").to_pylist(), object), batch.column("terms").to_pylist()
                for lang in set(langs.tolist()) & set(sizes):
                    yield lang, np.bincount(Sparse([terms[i] for i in np.flatnonzero(langs == lang)]).buckets, minlength=WIDTH)[None, :]

        yield from _summed(parts())

    held = _collected(rows.select("lang", "terms"), run, sizes)
    return {lang: np.log((1 + sizes[lang]) / (1 + df[0])) for lang, df in held.items()}


def _drawn(blocks: DataFrame, centres: dict, seed: int) -> dict:
    """language -> vector of one row, drawn from all by the squared distance to the nearest of the centres there are.

    Each row draws an exponential time whose rate is its weight, from a hash of its id and text; the first one is the draw.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        best: dict[str, tuple] = {}
        for lang, draws, x in _read_blocks(batches, centres):
            near = (x @ centres[lang].T).max(axis=1) / 2.0**BITS if len(centres[lang]) else np.zeros(len(draws))
            weight = np.round(np.clip(1 - near, 0, None), 6) ** 2
            live = np.flatnonzero(weight > 0)
            mixed_ = (draws[live] ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            u = (((mixed_ ^ (mixed_ >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(11)) + np.uint64(1)) * 2.0**-53
            times = -np.log(u) / weight[live]
            for i in live[times == times.min()] if len(live) else []:
                row = x[i].astype("<i4").tobytes()
                best[lang] = min(best.get(lang, (np.inf, b"")), (float(times.min()), row))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array([t for t, _ in best.values()], pa.float64()), pa.array([r for _, r in best.values()], pa.binary())], ["lang", "time", "row"])

    import numpy as np

    made = blocks.mapInArrow(run, "lang string, time double, row binary").groupBy("lang").agg(F.min(F.struct("time", "row")).alias("x"))
    return {r["lang"]: unit(np.frombuffer(r["x"]["row"], "<i4").astype(float)) for r in made.collect()}  # a row a language


def clustered(rows: DataFrame, seed: int = SEED) -> dict:
    """language -> (inverse document frequencies, unit centres) by spherical k-means over all of ``rows`` (as of ``read``).

    Every count, draw and sum is over all rows, and does not depend on how they are dealt out.
    """
    import numpy as np

    total = rows.count()
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().where(F.col("count") >= max(LEAST, total / MOST_LANGS)).collect()}  # at most MOST_LANGS rows
    if not sizes:
        return {}
    idf = _frequencies(rows, sizes)
    blocks = staged(_blocks(rows, idf))
    centres = {lang: np.empty((0, WIDTH)) for lang in sizes}
    open_ = dict(centres)
    for k in range(TOPICS):
        for lang, row in (drawn := _drawn(blocks, open_, seed + k)).items():
            centres[lang] = np.vstack([centres[lang], row])
        open_ = {lang: centres[lang] for lang in drawn}
        if not open_:
            break
    moving = {lang: c for lang, c in centres.items() if len(c)}
    for _ in range(ROUNDS):
        if not moving:
            break

        def run(batches, at=dict(moving)):
            def parts():
                for lang, _, x in _read_blocks(batches, at):
                    near = np.argmax(np.round(x @ at[lang].T / 2.0**BITS, 9), axis=1)
                    yield lang, ((np.arange(TOPICS)[:, None] == near).astype(float) @ x).astype(np.int64)  # whole numbers below 2 ** 53: exact

            yield from _summed(parts())

        for lang, sums in _collected(blocks, run, moving).items():
            sums = sums[: len(centres[lang])].astype(float)
            new = np.where(sums.any(axis=1, keepdims=True), unit(sums), centres[lang])
            same = np.allclose(new, centres[lang])
            centres[lang] = moving[lang] = new
            if same:
                del moving[lang]
    return {lang: (idf[lang], c) for lang, c in sorted(centres.items()) if len(c)}


def nearest(counts, model):
    """Number of the nearest cluster of each row of counts, the first of equals; 0 without a model or without terms."""
    import numpy as np

    if model is None:
        return np.zeros(len(counts), np.int64)
    idf, centres = model
    return np.argmax(np.round((np.log1p(counts) * idf) @ centres.T, 9), axis=1)


def _identity(docs: DataFrame) -> list[Column]:
    """What decides a row's fate: id, source, language and text."""
    return [docs["doc_id"].alias("doc_id"), _named("source"), _named("lang"), F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("whole")]


def read(docs: DataFrame, tokens: tuple[str, str]) -> DataFrame:
    """(doc_id, source, lang, whole, n_tokens, terms) of every row; ``terms`` are as ``Sparse`` reads them."""

    def run(batches):
        import pyarrow as pa

        terms = Terms(*tokens)
        for batch in batches:
            coded = batch.column("text").dictionary_encode()  # equal texts are read once
            sizes, counts = terms.read(coded.dictionary.to_pylist())
            at = coded.indices.to_numpy(zero_copy_only=False)
            held = pa.array(Sparse.packed(counts), pa.binary()).take(coded.indices)
            cols = [batch.column(c) for c in ("doc_id", "source", "lang", "whole")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes[at], pa.int64()), held], ["doc_id", "source", "lang", "whole", "n_tokens", "terms"])

    session(docs)
    doc, source, lang, whole = _identity(docs)
    rows = docs.select(doc.cast("long").alias("doc_id"), source, lang, whole, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, whole string, n_tokens long, terms binary")


def keyed(rows: DataFrame, model: dict) -> DataFrame:
    """(doc_id, source, lang, whole, topic, n_tokens) of every row of ``read``: topics are the nearest clusters, as of ``nearest``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            langs, terms = np.array(batch.column("lang").to_pylist(), object), batch.column("terms").to_pylist()
            topics = np.empty(len(langs), object)
            for lang in set(langs.tolist()):
                mine, near = np.flatnonzero(langs == lang), None
                if lang in model:
                    idf, centres = model[lang]
                    some = Sparse([terms[i] for i in mine])
                    near = np.argmax(np.round(some.scores(some.weighted(idf)[0], centres), 9), axis=1)
                topics[mine] = [f"{lang}/{k}" for k in (np.zeros(len(mine), np.int64) if near is None else near)]
            cols = [batch.column(c) for c in ("doc_id", "source", "lang", "whole")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(topics, pa.string()), batch.column("n_tokens")], ["doc_id", "source", "lang", "whole", "topic", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, source string, lang string, whole string, topic string, n_tokens long")


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(value, share) of a margin."""
    sums = cells.where("n > 0").groupBy(F.col(margin).alias("value")).agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum(F.pow("n", F.lit(power)))).first()[0] or 1.0
    return sums.select("value", (F.pow("n", F.lit(power)) / total).alias("share"))


def default_targets(cells: DataFrame) -> dict[str, DataFrame]:
    """Tempered margins of sources and languages; a language's topics share its weight by their tempered tokens."""
    langs = tempered(cells, "lang", TEMPERING["lang"])
    topics = cells.where("n > 0").groupBy("lang", "topic").agg(F.pow(F.sum("n"), F.lit(TEMPERING["topic"])).alias("p"))
    sums = topics.groupBy("lang").agg(F.sum("p").alias("all"))
    shares = topics.join(sums, "lang").join(langs.withColumnRenamed("value", "lang"), "lang")
    return {"source": tempered(cells, "source", TEMPERING["source"]), "lang": langs, "topic": shares.select(F.col("topic").alias("value"), (F.col("share") * F.col("p") / F.col("all")).alias("share"))}


def _swept(by_source: DataFrame, f, last: bool):
    """One pass over the sources under the factors ``f``: sums by topic, or (``last``) the cells' weights."""
    n_topics = len(f)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.zeros(n_topics)
        for batch in batches:
            names, at, n = [], [], []
            for source, share, cells in zip(*(batch.column(c).to_pylist() for c in ("source", "share", "cells")), strict=True):
                t, k = np.array([c["t"] for c in cells]), np.array([c["n"] for c in cells], float)
                whole = (k * f[t]).sum()
                w = k * (share / whole if whole > 0 else 0.0)
                if last:
                    names += [source] * len(t)
                    at.append(t)
                    n.append(w * f[t])
                else:
                    np.add.at(sums, t, w)
            if last and names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(n))], ["source", "t", "w"])
        if not last:
            held = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([""] * len(held), pa.string()), pa.array(held, pa.int32()), pa.array(sums[held])], ["source", "t", "w"])

    return by_source.mapInArrow(run, "source string, t int, w double")


def fitted(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, enough: float = ENOUGH, strict: bool = True) -> tuple[DataFrame, float]:
    """((source, lang, topic, n, w) of the cells with tokens, largest gap): weights w sum to 1 and meet ``targets``.

    A value without a target gets no weight.  Sweeps end when the targets hold, or when the last
    STALL of them took less than a tenth off the gap.  With ``strict``, a gap above ``enough`` is an error.
    """
    import numpy as np

    spark = cells.sparkSession
    live = cells.where("n > 0")
    pairs = [tuple(r) for r in live.select("topic", "lang").distinct().orderBy("topic", "lang").limit(MOST_TOPICS + 1).collect()]
    if len(pairs) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} pairs of language and topic")
    if not pairs:
        return live.withColumn("w", F.lit(0.0)), 0.0
    named = F.broadcast(spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "topic string, lang string, t int"))  # at most MOST_TOPICS rows
    placed = live.join(named, ["topic", "lang"]).groupBy("source").agg(F.collect_list(F.struct("t", "n")).alias("cells"))
    goals = targets["source"].select(F.col("value").alias("source"), "share")
    by_source = staged(placed.join(goals, "source", "left").withColumn("share", F.coalesce("share", F.lit(0.0))).select("source", "share", "cells"))

    margins = []
    for k, name in ((1, "lang"), (0, "topic")):
        values = sorted({p[k] for p in pairs})
        index = {v: i for i, v in enumerate(values)}
        here = spark.createDataFrame([(v,) for v in values], "value string")
        shares = {r["value"]: r["share"] for r in targets[name].withColumn("value", F.col("value").cast("string")).join(F.broadcast(here), "value", "left_semi").collect()}
        margins.append((np.array([index[p[k]] for p in pairs]), np.array([shares.get(v, 0.0) for v in values])))
    f, gaps = np.ones(len(pairs)), []
    while True:
        w = np.zeros(len(pairs))
        for r in _swept(by_source, f, False).groupBy("t").agg(F.sum("w").alias("w")).collect():  # a row a topic
            w[r["t"]] = r["w"] * f[r["t"]]
        gaps.append(max(float(np.abs(np.bincount(at, w, len(share)) - share).max()) for at, share in margins))
        if gaps[-1] <= enough or len(gaps) == sweeps or (len(gaps) > STALL and gaps[-1] > 0.9 * gaps[-1 - STALL]):
            break
        for at, share in margins:
            sums = np.bincount(at, w, len(share))
            scale = np.divide(share, sums, out=np.zeros_like(sums), where=sums > 0)[at]
            w, f = w * scale, f * scale
    if strict and gaps[-1] > enough:
        raise ValueError(f"the targets cannot all hold: after {len(gaps)} sweeps a share is off by {gaps[-1]:.6f}")
    weights = _swept(by_source, f, True).join(named, "t").select("source", "lang", "topic", "w")
    return staged(live.join(weights, list(MARGINS))), gaps[-1]


def calibrated(weights: DataFrame, keep: float = KEEP) -> DataFrame:
    """Cells with ``rate`` (weight over share of tokens) and ``probability``: expected tokens are ``keep`` of all."""
    total = weights.agg(F.sum("n")).first()[0]
    if not total:
        return weights.withColumn("rate", F.lit(1.0)).withColumn("probability", F.lit(keep))
    rated = weights.withColumn("rate", F.col("w") * total / F.col("n"))
    factor, capped = keep, -1
    while True:
        full = F.col("rate") * factor >= 1
        sums = rated.agg(F.sum(F.when(full, F.col("n")).otherwise(0)).alias("full"), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("rate") * F.col("n"))).alias("open")).first()
        if sums["full"] == capped or not sums["open"]:
            break
        capped = sums["full"]
        factor = max(factor, (keep * total - capped) / sums["open"])
    return rated.withColumn("probability", F.least(F.lit(1.0), F.col("rate") * factor))


def mixed(docs: DataFrame, tokens: tuple[str, str], targets: dict[str, DataFrame] | None = None, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, lang, whole, topic, n_tokens, rate, probability, sampled, gap) of every row."""
    spread = staged(read(docs, tokens))
    rows = staged(keyed(spread, clustered(spread, seed)))
    sums = staged(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")))
    cells = sums.select(*MARGINS, "n")
    weights, gap = fitted(cells, targets or default_targets(cells), strict=targets is not None)
    rated = calibrated(weights, keep).select(*MARGINS, "rate", "probability")
    rated = sums.select(*MARGINS, F.col("docs").alias("n")).join(rated, list(MARGINS), "left")
    total = sums.agg(F.sum("docs")).first()[0] or 0
    joined = hot_join(rows, rated.select(*MARGINS, "n", F.coalesce("rate", F.lit(1.0)).alias("rate"), F.coalesce("probability", F.lit(keep)).alias("probability")), list(MARGINS), total)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "whole"), 11) * F.lit(2.0**-53)
    return joined.select("doc_id", "source", "lang", "whole", "topic", "n_tokens", "rate", "probability", (drawn < F.col("probability")).alias("sampled"), F.lit(gap).alias("gap"))


def sample(docs: DataFrame, tokens: tuple[str, str], keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` in the sample, with their columns."""
    keys = ["doc_id", "source", "lang", "whole"]
    kept = mixed(docs, tokens, keep=keep).where("sampled").select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), *_identity(docs))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("source") == F.col("_source")) & (F.col("lang") == F.col("_lang")) & (F.col("whole") == F.col("_whole"))
    return rows.join(kept, same, "left_semi").select(*[F.col("r")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), vocabulary()).drop("whole")
