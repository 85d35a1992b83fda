"""Affinity to topics from feedback events, with decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import topic_terms
from lectern.functions.times import age_days, decay

#: Weight of each event type, and the decay in days.
WEIGHTS = {"complete": 1.0, "play": 0.5, "skip": -0.4, "pause": 0.0}
DECAY_DAYS = 7.0


def weight(event_type: Column) -> Column:
    out = F.lit(0.0)
    for name, w in WEIGHTS.items():
        out = F.when(event_type == name, F.lit(w)).otherwise(out)
    return out


def weighted(events: DataFrame, topics: DataFrame) -> DataFrame:
    """Events (episode_id, event_type, ts) that count, with the topic of their episode (episode_id, topic)."""
    live = events.withColumn("weight", weight(F.col("event_type"))).where((F.col("weight") != 0) & F.col("ts").isNotNull())
    return live.join(topics.where("topic <> ''"), "episode_id")


def scores(events: DataFrame, topics: DataFrame, now: Column) -> DataFrame:
    """(term, score): sum over events of weight * exp(-age / 7 days); a term counts once an event.

    Decayed weights are summed by topic before terms are exploded: the shuffle carries a row a topic.
    """
    by_topic = weighted(events, topics).groupBy("topic").agg(F.sum(F.col("weight") * decay(age_days(F.col("ts"), now), DECAY_DAYS)).alias("s"))
    return by_topic.select(F.explode(topic_terms(F.col("topic"))).alias("term"), "s").groupBy("term").agg(F.sum("s").alias("score"))


def boosts(rows: DataFrame, key: str, text: str, affinity: DataFrame) -> DataFrame:
    """(key, boost): min(sum of the scores of a text's distinct terms / 4, 1), 0 if the sum is not positive."""
    terms = rows.select(key, F.explode_outer(topic_terms(F.col(text))).alias("term"))
    sums = terms.join(affinity, "term", "left").groupBy(key).agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("raw"))
    return sums.select(key, F.when(F.col("raw") <= 0, 0.0).otherwise(F.least(F.col("raw") / 4, F.lit(1.0))).alias("boost"))
