"""Decayed affinity over a stream of feedback events.

exp(-(now - t) / d) = exp(-(now - t0) / d) * exp((t - t0) / d): per term the state is a plain sum
of weight * exp((t - t0) / d), which scales to any ``now`` at read time.  Events after ``now`` would
have to count as of now; they are held to ``latest`` when they arrive.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import topic_terms
from lectern.operators.affinity import DECAY_DAYS, weight
from lectern.sources.deltas import KeyedTable


def factored(events: DataFrame, topics: DataFrame, origin: dt.datetime, latest: dt.datetime | None = None) -> DataFrame:
    """(term, state) of events (episode_id, event_type, ts), streaming or not, joined with the static topics."""
    ts = F.col("ts") if latest is None else F.least("ts", F.lit(latest))
    live = events.withColumn("weight", weight(F.col("event_type"))).where((F.col("weight") != 0) & F.col("ts").isNotNull())
    met = live.join(topics.where("topic <> ''"), "episode_id")
    days = F.timestamp_diff("MICROSECOND", F.lit(origin), ts) / 86_400e6
    terms = met.select(F.explode(topic_terms(F.col("topic"))).alias("term"), (F.col("weight") * F.exp(days / DECAY_DAYS)).alias("part"))
    return terms.groupBy("term").agg(F.sum("part").alias("state"))


def read_at(state: DataFrame, origin: dt.datetime, now: dt.datetime) -> DataFrame:
    """(term, score) at ``now``."""
    days = (now - origin).total_seconds() / 86_400
    return state.select("term", (F.col("state") * F.exp(F.lit(-days / DECAY_DAYS))).alias("score"))


def started(events: DataFrame, topics: DataFrame, origin: dt.datetime, name: str, checkpoint: str, latest: dt.datetime | None = None, **trigger) -> StreamingQuery:
    """Keep the state as the in-memory table ``name``; ``trigger`` as in ``DataStreamWriter.trigger``."""
    writer = factored(events, topics, origin, latest).writeStream.outputMode("complete").format("memory").queryName(name)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Columns of a table of states.
STATE = "term string, state double"


def accumulated(events: DataFrame, topics: DataFrame, origin: dt.datetime, held: KeyedTable, checkpoint: str, latest: dt.datetime | None = None, **trigger) -> StreamingQuery:
    """Add the stream to the states in ``held`` (STATE, by term): a batch writes the terms that it has, and its number with them.

    The table outlives the query; a batch that is run again after its commit changes nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        fresh = factored(batch, topics, origin, latest)
        old = held.read().withColumnRenamed("state", "before")
        summed = fresh.join(old, "term", "left").select("term", (F.col("state") + F.coalesce("before", F.lit(0.0))).alias("state"))
        held.upsert(summed, source="affinity", batch=number)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def faded(held: KeyedTable, origin: dt.datetime, now: dt.datetime, least: float) -> bool:
    """Delete the terms whose score at ``now`` is below ``least`` either way; whether there were any."""
    gone = read_at(held.read(), origin, now).where(F.abs("score") < least).select("term", F.lit(None).cast("double").alias("state"))
    return held.upsert(gone, gone=F.lit(True))


def appended(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append-only feedback log, stamped on arrival where no time is given."""
    stamped = events.withColumn("created_at", F.coalesce("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")))
    return stamped.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
