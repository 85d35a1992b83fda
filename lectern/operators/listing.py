"""Listings of episodes with their papers: join, filters, orders, lookups, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import audio_url, contains_fold
from lectern.operators.prefix import running

LIST_LIMIT, ROUTE_LIMIT, FEED_LIMIT = 20, 24, 25
#: Orders of the explore view; all descending.
SORTS = {"citations": "citation_count", "score": "score", "duration": "duration_secs", "recent": "created_at"}


def with_papers(episodes: DataFrame, papers: DataFrame, nested: bool = False) -> DataFrame:
    """Episodes with their paper; an episode without one is dropped.  ``nested`` puts it in a struct ``paper``."""
    if not nested:
        return episodes.join(papers, "paper_id")
    packed = papers.select("paper_id", F.struct(*papers.columns).alias("paper"))
    return episodes.join(packed, "paper_id")


def on_topic(topic: Column, categories: Column, wanted: str | None) -> Column:
    """Case-insensitive: the topic or any category contains ``wanted``; nothing wanted is always true."""
    if not wanted:
        return F.lit(True)
    return contains_fold(topic, F.lit(wanted)) | F.exists(categories, lambda c: contains_fold(c, F.lit(wanted)))


def matches_text(query: str | None, columns: list[Column], authors: Column) -> Column:
    q = (query or "").strip()
    if not q:
        return F.lit(True)
    hit = F.exists(authors, lambda a: contains_fold(a, F.lit(q)))
    for c in columns:
        hit = contains_fold(c, F.lit(q)) | hit
    return hit


def listed(rows: DataFrame, sort: str, order: str, limit: int) -> DataFrame:
    return rows.orderBy(F.col(SORTS.get(sort, "citation_count")).desc(), order).limit(limit)


def newest(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Descending by text, as stored; ties keep ``order``."""
    return rows.orderBy(F.col(column).desc(), order)


def by_id(rows: DataFrame, column: str, value) -> DataFrame:
    return rows.where(F.col(column) == value)


def api_row(base: str, key: Column, fields: dict[str, Column], paper: Column) -> Column:
    """JSON of one episode with its audio address and paper."""
    return F.to_json(F.struct(key.alias("id"), *[c.alias(n) for n, c in fields.items()], audio_url(F.lit(base), key).alias("audio_url"), paper.alias("paper")))


def dashboard(episodes: DataFrame, topics: int) -> DataFrame:
    """(episodes, total_minutes, verified, topics)."""
    return episodes.agg(
        F.count("*").alias("episodes"),
        F.floor(F.coalesce(F.sum("duration_secs"), F.lit(0)) / 60 + 0.5).cast("long").alias("total_minutes"),
        F.count_if(F.col("qa_status") == "verified").alias("verified"),
        F.lit(topics).cast("long").alias("topics"),
    )


def running_index(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` with ``index`` from 0, running on from group to group; rows without a group come first."""
    numbered = running(rows, [], [F.col(group), F.col(order)], {"index": F.lit(1).cast("long")})
    return numbered.withColumn("index", F.col("index") - 1)


def grouped_commands(rows: DataFrame, wanted: str, title: str, kind: str, order: str) -> DataFrame:
    """(kind, n, first): the groups of the commands whose title contains the trimmed words, without regard to case."""
    hit = rows.where(contains_fold(F.col(title), F.trim(F.lit(wanted))))
    return hit.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def not_taken(offered: DataFrame, taken: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``offered`` that ``taken`` has not."""
    return offered.select(column).distinct().join(taken.select(column).distinct(), column, "left_anti")
