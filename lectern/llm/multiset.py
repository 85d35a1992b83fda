"""Document fingerprints by a homomorphic multiset hash.  DataFrame functions only.

A text is a multiset of paragraphs (its lines), and each paragraph one of phrases.  Paragraphs and
phrases are hashed to wide vectors, and a text's fingerprint is the sum of these vectors modulo
powers of two.  Sums do not depend on order, and a paragraph is inserted or deleted by adding or
taking away its vector (``combined``).  The vector has three parts:

* 4 lanes modulo 2**32 of uniform values hashed from the paragraph, and the number of paragraphs:
  they decide equality.
* 64 lanes modulo 2**16 of hash bits of its phrases.  Bits as signs make a tug-of-war sketch: the
  mean squared difference of two fingerprints, against their mean squares, estimates how much of
  the multisets is common, also where a paragraph was edited in part.
* the number of phrases modulo 2**32.

Cases: null is the empty text, whose fingerprint is zero; likeness of two empty texts is 1;
repeated rows stand next to each other in the order; an empty table gives no rows; a single
document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.ranges import spread
from lectern.llm.common import BLANKS, session, table

LANES = 64
_PAIR = (1 << 32) + 1
_LOW = (1 << 32) - 1


def paragraphs(text: Column) -> Column:
    held = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.filter(held, lambda x: x != "")


def phrases(text: Column) -> Column:
    """Runs of about four words, cut where the letters at a blank say so: insertions shift no other cut."""
    cut = F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[^bdfhjlnprtvxzBDFHJLNPRTVXZ])[ \t]+(?=[^aeiouAEIOU])")
    return F.filter(F.transform(cut, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def fingerprints(rows: DataFrame, texts: list[str], key: str) -> DataFrame:
    """Per value of ``key`` a column <text>_fp, struct of lanes, strong, n and lines, for each column in ``texts``.

    ``key`` must tell rows apart.  The sums are made where the text is read; only they are shuffled.
    """

    def marks(i: int, text: str) -> Column:
        mark = lambda kind: lambda x: F.struct(F.lit(i).alias("w"), F.lit(kind).alias("kind"), x.alias("p"))
        empty = F.array(mark(0)(F.lit("")))
        return F.concat(empty, F.transform(paragraphs(F.col(text)), mark(1)), F.transform(phrases(F.col(text)), mark(2)))

    marked = F.flatten(F.array(*[marks(i, t) for i, t in enumerate(texts)]))
    exploded = rows.select(key, F.explode(marked).alias("x")).select(key, "x.w", "x.kind", "x.p")
    of = lambda kind, value: F.when(F.col("kind") == kind, value).otherwise(F.lit(0).cast("long"))
    hashed = exploded.select(
        key, "w", of(2, F.lit(1).cast("long")).alias("one"), of(1, F.lit(1).cast("long")).alias("line"), of(2, F.xxhash64("p")).alias("h0"),
        *[of(1, F.xxhash64(F.lit(seed), "p")).alias(f"h{seed}") for seed in (1, 2)],
    )
    pairs = [F.sum(F.shiftrightunsigned("h0", i).bitwiseAND(F.lit(_PAIR))).alias(f"s{i}") for i in range(32)]
    strong = [F.sum(part).alias(f"u{k}") for k, part in enumerate(x for h in ("h1", "h2") for x in (F.col(h).bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32)))]
    sums = hashed.groupBy(key, "w").agg(*pairs, *strong, F.sum("one").alias("n"), F.sum("line").alias("lines"))
    lanes = F.array(*[F.col(f"s{i}").bitwiseAND(F.lit(0xFFFF)) for i in range(32)], *[F.shiftrightunsigned(f"s{i}", 32).bitwiseAND(F.lit(0xFFFF)) for i in range(32)])
    uniform = F.array(*[F.col(f"u{k}").bitwiseAND(F.lit(_LOW)) for k in range(4)])
    print_ = F.struct(lanes.alias("lanes"), uniform.alias("strong"), F.col("n").bitwiseAND(F.lit(_LOW)).alias("n"), F.col("lines").bitwiseAND(F.lit(_LOW)).alias("lines"))
    each = sums.select(key, "w", print_.alias("fp"))
    return each.groupBy(key).agg(*[F.max(F.when(F.col("w") == i, F.col("fp"))).alias(f"{t}_fp") for i, t in enumerate(texts)])


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the texts of ``a`` and ``b`` together (sign 1), or of ``a`` without ``b`` (sign -1)."""
    add = lambda x, y, m: F.pmod(x + sign * y, F.lit(m))
    return F.struct(
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: add(x, y, 1 << 16)).alias("lanes"),
        F.zip_with(a["strong"], b["strong"], lambda x, y: add(x, y, 1 << 32)).alias("strong"),
        add(a["n"], b["n"], 1 << 32).alias("n"),
        add(a["lines"], b["lines"], 1 << 32).alias("lines"),
    )


def as_text(fp: Column) -> Column:
    lane = lambda width: lambda x: F.lpad(F.lower(F.hex(x)), width, "0")
    return F.concat(F.array_join(F.transform(fp["lanes"], lane(4)), ""), F.array_join(F.transform(fp["strong"], lane(8)), ""), lane(8)(fp["n"]), lane(8)(fp["lines"]))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, near 0 for texts without a common phrase: 1 - |a - b|^2 / (|a|^2 + |b|^2)."""
    half = 1 << 15
    wrapped = lambda x: F.pmod(x + half, F.lit(1 << 16)) - half
    signs = lambda f: F.transform(f["lanes"], lambda x: wrapped(2 * x - f["n"]))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    gap = square(F.zip_with(signs(a), signs(b), lambda x, y: wrapped(x - y)))
    both = square(signs(a)) + square(signs(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - gap / both)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by descending doc_id; after the last, the first.

    Rows are dealt by ranges of doc_id; every range also gets the rows that follow it, of one doc_id.
    Only a row a range goes to the driver and back; there are three ranges a shuffle partition.
    """
    spark = session(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("r", spread(rows, F.col("doc_id"), parts))
    firsts = sorted(ranged.groupBy("r").agg(F.max("doc_id")).collect(), reverse=True)  # a row a range
    if not firsts:
        return rows.select("*", F.lit("").alias("next_text"))
    hosts = [(first, host) for (host, _), (_, first) in zip(firsts, [*firsts[1:], firsts[0]], strict=True)]
    guests = F.broadcast(spark.createDataFrame(hosts, "id long, r int"))
    visiting = rows.join(guests, rows["doc_id"].eqNullSafe(guests["id"])).select("doc_id", "text", "r", F.lit(1).alias("guest"))
    order = Window.partitionBy("r").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    both = ranged.select("doc_id", "text", "r", F.lit(0).alias("guest")).union(visiting)
    return both.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def query(spark, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    full = rows.withColumn("edited_text", edited).withColumn("k", F.struct("doc_id", F.monotonically_increasing_id().alias("row"), n.cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("sha")))
    prints = fingerprints(full, ["text", "edited_text", "next_text"], "k")
    own, new, after = F.col("text_fp"), F.col("edited_text_fp"), F.col("next_text_fp")
    return prints.select(
        "k.doc_id", "k.n_chars", F.col("k.sha").alias("edited_sha256"), as_text(own).alias("fingerprint"), as_text(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"), likeness(own, after).alias("near_next"),
    )
