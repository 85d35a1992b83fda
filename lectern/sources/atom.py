"""Atom feeds of papers: entries of landed XML, and a data source that asks the service."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from lectern.functions.text import last_segment, pdf_link, strip
from lectern.sources.schema import ENTRY

MOST_TOPICS, TIMEOUT = 5, 30


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Raw entries of Atom files."""
    return spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)


def candidates(raw: DataFrame) -> DataFrame:
    """Candidates of raw entries; the abstract is their one section."""
    abstract = F.coalesce(strip(F.col("summary")), F.lit(""))
    return raw.select(
        last_segment(F.col("id")).alias("arxiv_id"), strip(F.col("title")).alias("title"), abstract.alias("abstract"),
        F.coalesce(F.col("author.name"), F.array().cast("array<string>")).alias("authors"), F.coalesce(F.col("category._term"), F.array().cast("array<string>")).alias("categories"),
        F.col("published").alias("published_at"),
        pdf_link(F.transform("link", lambda x: F.struct(x["_title"].alias("title"), x["_href"].alias("href"))), F.col("id")).alias("pdf_url"),
        F.create_map(F.lit("abstract"), abstract).alias("sections"), F.lit(0).alias("citation_count"), F.lit(0.0).alias("citation_velocity"),
    )


def request(topics: list[str], window: str, limit: int, base: str) -> str:
    """Address of a search: at most five topics, newest first."""
    clause = " OR ".join(f'all:"{t}"' for t in topics[:MOST_TOPICS])
    return f"{base}?" + urlencode({"search_query": f"({clause}) AND {window}", "sortBy": "submittedDate", "sortOrder": "descending", "max_results": limit})


def _fetch(url: str) -> bytes:
    import urllib.request

    with urllib.request.urlopen(url, timeout=TIMEOUT) as r:
        return r.read()


class AtomSource(DataSource):
    """``spark.read.format("atom").options(base=..., topics="a,b", window=..., limit=...).load()``.

    One request, as the service takes it: any of at most five topics, newest first, one limit for
    all.  Rows are raw entries, as ``candidates`` reads them, with the topics asked for; a filter
    ``topic = '...'`` replaces these in the request.
    """

    fetch: Callable[[str], bytes] = staticmethod(_fetch)

    @classmethod
    def name(cls) -> str:
        return "atom"

    def schema(self) -> str:
        return f"topic string, {ENTRY}"

    def reader(self, schema) -> DataSourceReader:
        return AtomReader(self.options, type(self).fetch)


class AtomReader(DataSourceReader):
    def __init__(self, options, fetch: Callable[[str], bytes]):
        self.options, self.fetch = options, fetch
        self.topics = [t.strip() for t in options.get("topics", "").split(",") if t.strip()]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("topic",):
                self.topics = [f.value]
            yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(tuple(self.topics[:MOST_TOPICS]))] if self.topics else []

    def read(self, partition: InputPartition):
        import xml.etree.ElementTree as tree

        atom = "{http://www.w3.org/2005/Atom}"
        url = request(list(partition.value), self.options.get("window", ""), int(self.options.get("limit", "10")), self.options["base"])
        for e in tree.fromstring(self.fetch(url)).iter(f"{atom}entry"):
            text = [e.findtext(f"{atom}{n}") or "" for n in ("id", "title", "summary", "published")]
            authors = [((a.findtext(f"{atom}name") or "").strip(),) for a in e.iter(f"{atom}author")]
            categories = [(c.get("term"),) for c in e.iter(f"{atom}category")]
            links = [(x.get("title"), x.get("href")) for x in e.iter(f"{atom}link")]
            yield (",".join(partition.value), *text, authors, categories, links)


def live_or_demo(live: Callable[[], DataFrame] | None, demo: DataFrame, topics: list[str]) -> DataFrame:
    """The live search if enabled, topics are given and it gives rows without failing; else the demo catalogue."""
    if live is None or not topics:
        return demo
    try:
        rows = live()
        return demo if rows.isEmpty() else rows
    except Exception:  # whatever the service does, there is a catalogue
        return demo
