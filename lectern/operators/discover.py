"""Discovery: search order, enrichment, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.functions.times import age_days, decay

#: Weights of the rank score.
RECENCY, TRENDING, AFFINITY = 0.45, 0.35, 0.20
DEFAULT_TERMS = ["research"]


def literal_terms(terms: list[str]) -> Column:
    return F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")


def searched(rows: DataFrame, terms: list[str], haystack: Column, order: str, limit: int) -> DataFrame:
    """Rows with any term first, the rest after them, each in ``order``; then the limit."""
    hit = let(F.lower(haystack), lambda h: F.exists(literal_terms(terms), lambda t: F.contains(h, t))) if terms else F.lit(False)
    return rows.withColumn("hit", hit).orderBy(F.col("hit").desc(), order).limit(limit)


def enriched_velocity(velocity: Column, citations: Column) -> Column:
    return F.when(velocity <= 0, F.greatest(citations / 5.0, F.lit(0.1))).otherwise(velocity)


def term_hits(text: Column, terms: list[str]) -> Column:
    """Number of terms contained in the text."""
    return let(F.lower(text), lambda x: F.size(F.filter(literal_terms([t.lower() for t in terms]), lambda t: F.contains(x, t))))


def rank_score(published: Column, velocity: Column, text: Column, now: Column, terms: list[str], window_days: int, boost: Column | None = None) -> Column:
    """Weighted recency, trend and topic affinity; ``boost`` (0 to 1) adds to the affinity, capped at 1."""
    terms = terms or DEFAULT_TERMS
    recency = decay(age_days(published, now), max(window_days / 2, 1.0))
    trending = F.least(velocity / 10.0, F.lit(1.0))
    affinity = term_hits(text, terms) / F.lit(float(max(len(terms), 1)))
    if boost is not None:
        affinity = F.least(affinity + boost, F.lit(1.0))
    return RECENCY * recency + TRENDING * trending + AFFINITY * affinity


def ranked(rows: DataFrame, score: Column, order: str, k: int) -> DataFrame:
    """Top ``k`` by score; ties keep ``order``."""
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), order).limit(k)
