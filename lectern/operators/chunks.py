"""Overlapping word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.functions.text import words

WINDOW, OVERLAP = 110, 24


def windows(ws: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Array of windows (arrays of words); one window, maybe empty, if all words fit."""
    stride = max(size - overlap, 1)
    last = F.when(F.size(ws) <= size, 0).otherwise(F.ceil((F.size(ws) - size) / float(stride)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(ws, i * stride + 1, size))


def chunked(rows: DataFrame, key: str, text: str, section: str | None = None, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(key, [section,] chunk_index, content, token_count, id): ids are hashes of the position."""
    keep = [key] + ([section] if section else [])
    made = rows.select(*keep, F.posexplode(let(words(F.col(text)), lambda ws: windows(ws, size, overlap))).alias("chunk_index", "_w"))
    name = F.sha2(F.concat_ws("#", *[F.col(c).cast("string") for c in keep], F.col("chunk_index").cast("string")), 256)
    return made.select(*keep, "chunk_index", F.array_join("_w", " ").alias("content"), F.size("_w").alias("token_count"), name.alias("id"))
