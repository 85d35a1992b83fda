"""Sections of a text: labels carried forward from header lines, text by label, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import header_label, joined_lines, strip

SHORTEST, CLIP, PRESENT, ENOUGH = 120, 8000, 200, 600


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ln, line) of the lines that are not blank."""
    held = rows.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("ln", "line"))
    return held.withColumn("line", strip(F.col("line"))).where("line <> ''")


def labelled(rows: DataFrame, key: str, marker: Column | None = None) -> DataFrame:
    """``rows`` (key, ln, line) with ``marker`` and the ``label`` carried forward; a stop line has the marker ``''``."""
    order = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("marker", header_label(F.col("line")) if marker is None else marker)
    return marked.withColumn("label", F.last("marker", ignorenulls=True).over(order))


def section_texts(rows: DataFrame, key: str, shortest: int = SHORTEST) -> DataFrame:
    """(key, label, text) from ``labelled`` rows: lines in order, joined, cleaned, long enough, clipped."""
    body = rows.where("marker is null and label <> ''")
    held = body.groupBy(key, "label").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("x"))
    text = joined_lines(F.array_join(F.transform("x", lambda s: s["line"]), " "))
    return held.select(key, "label", text.alias("text")).where(F.length("text") > shortest).withColumn("text", F.substring("text", 1, CLIP))


def has_sections(texts: Column) -> Column:
    """Whether any given section is long enough to skip extraction."""
    return F.exists(texts, lambda t: F.length(t) > PRESENT)


def extracted(existing: Column, found: Column, abstract: Column) -> Column:
    """Cascade over maps label -> text: given sections, found ones if there is enough, given or the abstract."""
    total = F.aggregate(F.map_values(found), F.lit(0), lambda a, t: a + F.length(t))
    with_abstract = lambda m: F.when(F.map_contains_key(m, "abstract"), m).otherwise(F.map_concat(m, F.create_map(F.lit("abstract"), abstract)))
    fallback = F.when(F.size(existing) > 0, existing).otherwise(F.create_map(F.lit("abstract"), abstract))
    return F.when(has_sections(F.map_values(existing)), existing).when(total > ENOUGH, with_abstract(found)).otherwise(fallback)
