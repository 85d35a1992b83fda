"""Provider outcomes and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_CLIP, SHOWN_CLIP = 240, 80


def latest(calls: DataFrame, order: str = "at") -> DataFrame:
    """The last outcome of each provider (provider, ok, at, ...); ties go to the larger row."""
    rest = [c for c in calls.columns if c not in ("provider", order)]
    last = F.max(F.struct(order, *rest)).alias("x")
    return calls.groupBy("provider").agg(last).select("provider", "x.*")


def failed(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(~F.col("ok")).withColumn("error", F.left("error", F.lit(SHOWN_CLIP)))


def chosen_llm(anthropic: Column, openai: Column) -> Column:
    return F.when(anthropic, "anthropic").when(openai, "openai").otherwise("demo")


def chosen_tts(preferred: Column, elevenlabs: Column, openai: Column) -> Column:
    eleven = elevenlabs & preferred.isin("elevenlabs", "auto")
    return F.when(eleven, "elevenlabs").when(openai & preferred.isin("openai", "auto"), "openai").otherwise("demo")


def chosen_embedder(openai: Column, preference: Column) -> Column:
    return F.when(openai & (F.lower(preference) != "demo"), "openai").otherwise("demo")


def live(llm: Column, tts: Column) -> Column:
    return (llm != "demo") & (tts != "demo")


def merged(old: Column, new: Column) -> Column:
    """Maps merged; the new value of a key wins."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def run_states(events: DataFrame, key: str, state: str, at: str, tie: str) -> DataFrame:
    """(key, state, at, runs): the last state of each run, by time and then ``tie``, and the number of its events."""
    last = F.max_by(state, F.struct(at, tie))
    return events.groupBy(key).agg(last.alias("state"), F.max(at).alias("at"), F.count("*").alias("runs"))
