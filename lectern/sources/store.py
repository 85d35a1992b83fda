"""The library of papers, chunks, episodes and feedback as parquet tables, and its JSON form.

Keyed tables are ``deltas.KeyedTable``: an upsert adds what it changes.  The others are written whole
to a new folder that a numbered manifest names; feedback is only appended to.  Nothing that a reader
may be using is overwritten, and a write that fails half-way is not seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.shared import remove as delete
from lectern.functions.text import cleaned_topics
from lectern.sources.deltas import KeyedTable
from lectern.sources.manifest import Manifest
from lectern.sources.schema import STORE, TABLES

#: Key of each table; others are append-only.
KEYS = {"papers": "arxiv_id", "chunks": "id", "episodes": "id"}


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a JSON document with one member a table; a missing file gives empty tables."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    whole = spark.read.schema(STORE).json(path, multiLine=True, mode="FAILFAST") if there else spark.createDataFrame([], STORE)
    out = {name: whole.select(F.inline(name)) for name in TABLES}
    return out | {"topics": whole.select(F.posexplode("topics").alias("ord", "topic")), "meta": whole.select(F.explode("meta").alias("key", "value"))}


def to_json(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, value): every row as JSON."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


class Store:
    """Parquet tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self, name: str) -> Manifest:
        return Manifest(self.spark, f"{self.root}/{name}.manifest")

    def keyed(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/{name}", TABLES[name], KEYS[name])

    def _current(self, name: str) -> str | None:
        """Folder of a table without keys; an error if there are folders and no manifest that names one."""
        found = self._manifest(name).latest()
        if found:
            return found[1]["folder"]
        at, files = self._manifest(name)._at(self.root)
        if files.exists(at) and any(x.getPath().getName().startswith(f"{name}-") for x in files.listStatus(at)):
            raise RuntimeError(f"{self.root} has data of {name} and no complete manifest for it")
        return None

    def read(self, name: str) -> DataFrame:
        if name in KEYS:
            return self.keyed(name).read()
        at = self._current(name)
        schema = TABLES.get(name, "ord int, topic string" if name == "topics" else "key string, value string")
        return self.spark.createDataFrame([], schema) if at is None else self.spark.read.schema(schema).parquet(at)

    def write(self, name: str, df: DataFrame) -> None:
        if name in KEYS:
            return self.keyed(name).replace(df)
        manifest, at = self._manifest(name), f"{self.root}/{name}-{uuid.uuid4().hex}"
        now = manifest.latest()
        number = now[0] if now else manifest.commit({"folder": None})  # so that data without a manifest is a manifest that was lost
        df.write.parquet(at)
        manifest.commit({"folder": at}, after=number)
        for old in manifest.forget(2):
            if old["folder"]:
                delete(self.spark, old["folder"])

    def upsert(self, name: str, new: DataFrame) -> None:
        """Replace rows by key, or add them where the key is new."""
        self.keyed(name).upsert(new)

    def add_feedback(self, events: DataFrame) -> int:
        """Append; the number of all events, which the files' footers give."""
        at = self._current("feedback")
        if at is None:
            self.write("feedback", events)
        else:
            events.write.mode("append").parquet(at)
        return self.read("feedback").count()

    def staged(self, df: DataFrame) -> DataFrame:
        """``df`` written to a folder of the store and read again: evaluated once, whatever its source."""
        at = f"{self.root}/staged-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def unstage(self, *held: DataFrame) -> None:
        for df in held:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                delete(self.spark, folder)

    def set_topics(self, topics: list[str]) -> list[str]:
        kept = self.spark.range(1).select(F.posexplode(cleaned_topics(F.array(*map(F.lit, topics)) if topics else F.array().cast("array<string>"))).alias("ord", "topic"))
        self.write("topics", kept)
        return [r["topic"] for r in self.read("topics").orderBy("ord").collect()]

    def seed(self, tables: dict[str, DataFrame]) -> bool:
        """Write ``tables`` if there are no episodes; whether it did."""
        if not self.read("episodes").isEmpty():
            return False
        for name, df in tables.items():
            self.write(name, df)
        return True

    def reset(self, tables: dict[str, DataFrame]) -> None:
        """Write ``tables`` over all that is there; tables not given become empty."""
        for name, schema in TABLES.items():
            self.write(name, tables.get(name, self.spark.createDataFrame([], schema)))
