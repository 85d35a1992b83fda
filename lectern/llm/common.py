"""Shared folder, staged tables and small column helpers of the corpus operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.binding import let  # noqa: F401  for the other modules
from lectern.functions.shared import bounded, remove, shared_dir, staged  # noqa: F401

#: Fixed value: the characters between words (blank, tab, newline, VT, FF, CR).
BLANKS = " \t\n\x0b\f\r"

#: Rows and bytes in one Arrow batch; they bound a Python worker's memory with long texts.
ARROW_ROWS, ARROW_BYTES = 500, 16 << 20


#: Most keys whose rows ``hot_join`` broadcasts.
HOT = 10_000


def session(docs: DataFrame, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> SparkSession:
    """The session, with bounds of Arrow batches; a session that sets its own tighter ones keeps them."""
    return bounded(docs.sparkSession, rows, size)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files whose plans are out of use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join on keys that are unique in ``right``, whose ``n`` is the number of rows of ``left`` under a key.

    A key is hot if it holds more than one in HOT of all ``total`` rows of ``left``.  Fewer than HOT
    keys can be hot, whatever the input's size, and theirs are the rows that are broadcast.  No
    other key has more than that share, so the rest meets in a shuffle that no key dominates.
    """
    hot, values = F.col("n") * HOT > total, [c for c in right.columns if c not in (*keys, "n")]
    few = right.where(hot).select(*keys, F.struct(F.lit(True).alias("_"), *values).alias("_hot"))
    marked = left.join(F.broadcast(few), keys, "left")
    met = marked.where("_hot is not null").select(*left.columns, *[F.col("_hot")[c].alias(c) for c in values])
    rest = marked.where("_hot is null").drop("_hot").join(right.where(~hot).drop("n"), keys)
    return met.unionByName(rest.select(*left.columns, *values))


def words(text: Column) -> Column:
    """Array of the runs of non-blank characters; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def packed(docs: DataFrame) -> DataFrame:
    """(r, doc_id, text, source): all columns in a struct, so that no name of theirs clashes with ours."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["source"].alias("source"))


def unpacked(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of ``r`` again, with a new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("r")[c].alias(c) for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
