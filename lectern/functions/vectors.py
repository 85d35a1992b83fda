"""Dense vectors as arrays of doubles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    size = F.size(a)
    fits = (size > 0) & (size == F.size(b))
    return F.coalesce(F.when(fits, F.try_divide(dot(a, b), norm(a) * norm(b))), F.lit(0.0))


def hash_embedding(text: Column, size: int = 48) -> Column:
    """Counts of hashed tokens, scaled to length one; all zeros without tokens.

    A batch of texts is counted at once in a task's Python; a token's bucket (as of ``hash_bucket``) is kept for the next time it comes.
    """
    if not 0 < size <= 80:
        raise ValueError("an embedding has 1 to 80 buckets")

    @F.arrow_udf("array<double>")
    def embedded(lower: pa.Array) -> pa.Array:
        import functools
        import hashlib
        import re

        import numpy as np

        bucket = functools.lru_cache(1 << 16)(lambda token: int(hashlib.sha256(token.encode()).hexdigest()[:8], 16) % size)
        tokens = re.compile("[a-z0-9]+").findall
        at = [[bucket(t) for t in tokens(x)] for x in lower.to_pylist()]
        n = np.fromiter(map(len, at), np.int64, len(at))
        places = np.repeat(np.arange(len(at)) * size, n) + np.fromiter((b for row in at for b in row), np.int64, int(n.sum()))
        counts = np.bincount(places, minlength=len(at) * size).reshape(-1, size).astype(float)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = np.divide(counts, length, out=np.zeros_like(counts), where=length > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * size, pa.int32()), pa.array(unit.ravel()))

    return embedded(F.lower(F.coalesce(text, F.lit(""))))
