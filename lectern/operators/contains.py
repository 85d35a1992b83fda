"""Which terms of a table occur in which texts, as substrings: blocks of texts against automata of blocks of terms.

Texts are packed into blocks in the partition they lie in, and every block of texts meets every block of
terms as one row: an automaton of the terms decides in one pass over the texts, whatever the terms'
number.  No text, gram or pair is shuffled or written; what leaves a task is each text's list of terms.

A block of terms is bounded by BLOCK terms and CHARS characters, and at most PASS blocks are broadcast at
once; a table of more terms is taken in several passes over the texts.  So tasks hold a block of each
side, and terms in the thousands, or tens of thousands, cost one reading of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.shared import bounded, staged

#: Terms of a block, about (they are dealt by hash), and characters of a block of terms or texts; blocks broadcast at once.
BLOCK, CHARS, PASS = 1 << 16, 1 << 20, 64


def _packed(texts: DataFrame) -> DataFrame:
    """(keys, texts): arrays of about CHARS bytes of texts (key, _text)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not len(batch):
                continue
            at = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy()) // CHARS
            ends = pa.array([0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(batch)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("key", "_text")], ["keys", "texts"])

    return texts.mapInArrow(run, f"keys array<{texts.schema['key'].dataType.simpleString()}>, texts array<string>")


def _found(met: DataFrame, kind: str) -> DataFrame:
    """(key, terms) of rows (_b, keys, texts, _terms): one pass of the block's automaton over each text; texts without a term are left out."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        at, machine = None, None
        for batch in batches:
            for i, b in enumerate(batch.column("_b").to_pylist()):
                if b != at:
                    at, machine = b, ahocorasick.Automaton()
                    for t in batch.column("_terms")[i].as_py():
                        machine.add_word(t, t)
                    machine.make_automaton()
                hits = [list({t for _, t in machine.iter(text)}) for text in batch.column("texts")[i].as_py()]
                rows = [k for k, h in enumerate(hits) if h]
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values.take(pa.array(rows)), pa.array([hits[k] for k in rows], pa.list_(pa.string()))], ["key", "terms"])

    return met.select("_b", "keys", "texts", "_terms").mapInArrow(run, f"key {kind}, terms array<string>")


def lists(rows: DataFrame, key: str, text: str, terms: DataFrame, term: str, block: int = BLOCK) -> DataFrame:
    """(key, terms): as ``contained``, with an array of terms for each row and block of terms it has some of."""
    spark = bounded(rows.sparkSession)
    texts = rows.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("_text")).where("key is not null and _text <> ''")
    kind = texts.schema["key"].dataType.simpleString()
    held = staged(terms.select(F.lower(F.col(term)).alias("term")).where("term <> ''").distinct())
    n, size = held.agg(F.count("*"), F.sum(F.length("term"))).first()
    blocks = max(-(-n // block), -(-(size or 0) // CHARS))
    if not blocks:
        return spark.createDataFrame([], f"key {kind}, terms array<string>")
    wanted = held.groupBy(F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("_b")).agg(F.collect_list("term").alias("_terms"))
    found, packs = None, _packed(texts)
    for first in range(0, blocks, PASS):
        last = min(first + PASS, blocks) - 1
        asked = packs.select(F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("_b"), "keys", "texts")
        some = _found(asked.join(F.broadcast(wanted.where(F.col("_b").between(first, last))), "_b"), kind)
        found = some if found is None else found.union(some)
    return found


def contained(rows: DataFrame, key: str, text: str, terms: DataFrame, term: str, block: int = BLOCK) -> DataFrame:
    """(key, term): the distinct terms, in lower case, that occur in each row's lower-case text.

    Null and empty terms, null texts and null keys give nothing; a repeated row gives its terms again.
    """
    return lists(rows, key, text, terms, term, block).select(F.col("key").alias(key), F.explode("terms").alias("term"))
