"""RSS feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import audio_url, filled, xml_escape
from lectern.functions.times import rfc2822
from lectern.operators.listing import FEED_LIMIT


#: An item, and the channel's description.
ITEM = (
    "<item><title>{title}</title><link>{page}</link><guid>{key}</guid><description>{description}</description>"
    '<pubDate>{date}</pubDate><enclosure url="{audio}" type="{kind}" length="0" /></item>'
)
ABOUT = "Daily research papers, distilled into audio."


def item(base: str, key: Column, title: Column, description: Column, created: Column, audio_type: str = "audio/wav") -> Column:
    name = key.cast("string")
    return filled(
        ITEM, title=xml_escape(title), page=F.concat(F.lit(f"{base}/episodes/"), name), key=name, description=xml_escape(description),
        date=rfc2822(created), audio=audio_url(F.lit(base), key), kind=F.lit(audio_type),
    )


def items(episodes: DataFrame, base: str, order: str = "id", limit: int = FEED_LIMIT) -> DataFrame:
    """(rank, item) of the newest episodes (id, title, description, created_at)."""
    top = episodes.orderBy(F.col("created_at").desc(), order).limit(limit)
    text = item(base, F.col("id"), F.col("title"), F.col("description"), F.col("created_at"))
    ranks = F.transform(F.sort_array(F.collect_list(F.struct(F.col("created_at").alias("c"), (-F.col(order)).alias("o"), text.alias("item"))), asc=False), lambda x, i: F.struct((i + 1).alias("rank"), x["item"].alias("item")))
    return top.agg(ranks.alias("x")).select(F.inline("x"))


def document(episodes: DataFrame, base: str, title: str, order: str = "id") -> DataFrame:
    """One row (rss): the whole feed; at most FEED_LIMIT items meet in it."""
    held = items(episodes, base, order).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), "").alias("x"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'), xml_escape(F.lit(title)), F.lit(f"</title><link>{base}</link>"))
    return held.select(F.concat(head, F.lit(f"<description>{ABOUT}</description>"), F.coalesce("x", F.lit("")), F.lit("</channel></rss>")).alias("rss"))
