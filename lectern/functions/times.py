"""Time functions as Spark columns; ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def parsed_iso(x: Column) -> Column:
    """Timestamp of an ISO text, with Z or an offset; null if it cannot be read."""
    return F.try_to_timestamp(F.regexp_replace(x, "Z$", "+00:00"))


def age_days(ts: Column, now: Column) -> Column:
    """Days before ``now``, never below zero."""
    return F.greatest(F.timestamp_diff("MICROSECOND", ts, now) / F.lit(float(DAY_MICROS)), F.lit(0.0))


def decay(age: Column, days: float | Column) -> Column:
    """exp(-age / days): an e-folding time, not a half-life."""
    return F.exp(-age / days)


def relative_time(ts: Column, now: Column) -> Column:
    secs = F.floor(F.timestamp_diff("MICROSECOND", ts, now) / 1e6 + 0.5)
    a = F.abs(secs)
    steps = [(60, 1, "s"), (3600, 60, "m"), (86400, 3600, "h"), (604800, 86400, "d"), (2629800, 604800, "w"), (31557600, 2629800, "mo")]
    shown = lambda unit, name: F.concat(F.floor(a / unit + 0.5).cast("string"), F.lit(name))
    text = None
    for limit, unit, name in steps:
        text = F.when(a < limit, shown(unit, name)) if text is None else text.when(a < limit, shown(unit, name))
    text = text.otherwise(shown(31557600, "y"))
    return F.when(a < 5, "just now").otherwise(F.concat(text, F.when(secs >= 0, " ago").otherwise(" from now")))


def duration_display(secs: Column) -> Column:
    m = F.floor(secs / 60 + 0.5)
    hours = F.concat(F.floor(m / 60).cast("string"), F.lit("h"))
    rest = F.when(m % 60 == 0, "").otherwise(F.concat((m % 60).cast("string"), F.lit("m")))
    return F.when(secs.isNull() | (secs <= 0), "0m").when(m < 60, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.concat(hours, rest))


def clock_display(secs: Column) -> Column:
    whole = F.floor(F.greatest(secs, F.lit(0)))
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def rfc2822(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def compact(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmm")


def submitted_clause(now: Column, days: Column) -> Column:
    start = F.timestamp_add("DAY", -F.greatest(days, F.lit(1)), now)
    return F.concat(F.lit("submittedDate:["), compact(start), F.lit(" TO "), compact(now), F.lit("]"))


def in_window(ts: Column, now: Column, days: int) -> Column:
    return (ts >= F.timestamp_add("DAY", F.lit(-max(days, 1)), now)) & (ts <= now)
