"""Values bound once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas.

    The optimizer merges projections into the lambdas of those above, where they would run for every element.
    """
    return F.transform(F.array(value), lambda x: body(x))[0]
