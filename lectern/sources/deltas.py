"""A keyed table in hash buckets: upserts add small delta files, reads merge, compaction rewrites touched buckets.

Rows lie in buckets by the hash of their key.  A part is a folder of parquet files, one folder a bucket;
the first part of a bucket is its base, later ones are deltas, and the greatest part that has a
key gives its row.  An upsert writes its own rows and nothing else, so what it writes grows with the
change and not with the table.  A read takes buckets without deltas as they are; in the others, base rows
whose key a delta has are left out by an anti-join with the deltas' keys, which are few.  Compaction
writes the buckets that have many deltas anew.  The manifest says which parts a bucket has; it is
committed last (``manifest``), so that a write that ends half-way is never seen.

Cases: a null key is a key like any other; several rows of a key in one upsert: the greatest by ``order``, ties by
the other columns; an upsert without rows adds no part; a table never written is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.shared import remove
from lectern.sources.manifest import Manifest

#: Deltas of a bucket at which ``upsert`` compacts it, and manifests (and what they refer to) that are kept.
MOST_DELTAS, KEEP = 8, 2


class KeyedTable:
    """A table with columns ``schema`` (DDL) under ``root``, whose rows are told apart by ``key``."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = 16):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.manifest = Manifest(spark, f"{self.root}/manifest")
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]
        self._new = {"buckets": buckets, "next": 0, "parts": [], "done": {}}

    def state(self) -> tuple[int | None, dict]:
        return self.manifest.latest() or (None, self._new)

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _part(self, part: dict, buckets: set[int]) -> DataFrame | None:
        """Rows of a part's ``buckets``, with its order and whether they are gone."""
        wanted = sorted(buckets & set(part["buckets"]))
        if not wanted:
            return None
        rows = self.spark.read.schema(f"{self.schema}, _gone boolean").parquet(*[f"{self.root}/{part['folder']}/_bucket={b}" for b in wanted])
        return rows.withColumn("_order", F.lit(part["order"]))

    def _union(self, frames: list[DataFrame | None]) -> DataFrame | None:
        out = None
        for df in frames:
            out = df if out is None else out if df is None else out.unionByName(df)
        return out

    def _merged(self, state: dict, buckets: set[int]) -> DataFrame | None:
        """The rows of ``buckets``, with those marked gone; None where no part has any."""
        held = {b: [p["order"] for p in state["parts"] if b in p["buckets"]] for b in buckets}
        base = {b: min(orders) for b, orders in held.items() if orders}
        touched = {b for b, orders in held.items() if len(orders) > 1}
        parts = state["parts"]
        plain = self._union([self._part(p, {b for b in base if base[b] == p["order"]} - touched) for p in parts])
        if not touched:
            return plain
        first = self._union([self._part(p, {b for b in touched if base[b] == p["order"]}) for p in parts])
        later = self._union([self._part(p, {b for b in touched if base[b] != p["order"]}) for p in parts])
        newest = later.groupBy(self.key).agg(F.max_by(F.struct(*self.columns, "_gone", "_order"), "_order").alias("r")).select("r.*")
        keys = later.select(F.col(self.key).alias("_key")).distinct()
        kept = first.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
        return self._union([plain, kept, newest])

    def read(self, at: int | None = None) -> DataFrame:
        """The table now, or as it was at manifest ``at``."""
        _, state = self.state() if at is None else (at, self.manifest.value(at))
        rows = self._merged(state, set(range(state["buckets"])))
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        return rows.where("not _gone").select(*self.columns)

    def lookup(self, keys: list) -> DataFrame:
        """The rows of ``keys``, from their buckets alone."""
        _, state = self.state()
        kind = self.spark.createDataFrame([], self.schema).schema[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], f"{self.key} {kind.simpleString()}")
        buckets = {r[0] for r in asked.select(self.bucket(state["buckets"])).collect()}  # a row a key asked for
        rows = self._merged(state, buckets)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        found = rows.join(F.broadcast(asked.distinct()), self.key, "left_semi") if None not in keys else rows.where(F.col(self.key).isNull() | F.col(self.key).isin([k for k in keys if k is not None]))
        return found.where("not _gone").select(*self.columns)

    def _written(self, rows: DataFrame, buckets: int) -> dict | None:
        """A part with ``rows`` (the columns and _gone); None without rows."""
        folder = f"part-{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self.bucket(buckets)).repartition("_bucket").sortWithinPartitions("_bucket", self.key)
        dealt.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        at, files = self.manifest._at(f"{self.root}/{folder}")
        found = sorted(int(x.getPath().getName().split("=")[1]) for x in files.listStatus(at) if "=" in x.getPath().getName())
        return {"folder": folder, "buckets": found} if found else None

    def _commit(self, number: int | None, state: dict) -> None:
        self.manifest.commit(state, after=number)
        gone = {p["folder"] for old in self.manifest.forget(KEEP) for p in old["parts"]}
        held = {p["folder"] for n in self.manifest.numbers() for p in (self.manifest.value(n) or self._new)["parts"]}
        for folder in sorted(gone - held):
            remove(self.spark, f"{self.root}/{folder}")

    def upsert(self, rows: DataFrame, order: str | None = None, gone: Column | None = None, source: str | None = None, batch: int | None = None) -> bool:
        """Replace rows by key, or add them; whether anything was committed.

        ``gone`` marks rows whose key is to be deleted.  With ``source`` and ``batch`` the batch's number is
        committed with the rows, and a batch that was committed before changes nothing.
        """
        number, state = self.state()
        if source is not None and state["done"].get(source, -1) >= batch:
            return False
        picked = rows.select(*self.columns, (F.lit(False) if gone is None else gone).alias("_gone"), (F.col(order) if order else F.lit(0)).alias("_o"))
        one = picked.groupBy(self.key).agg(F.max_by(F.struct(*self.columns, "_gone"), F.struct("_o", F.xxhash64(*self.columns))).alias("r")).select("r.*")
        part = self._written(one, state["buckets"])
        if part is None and source is None:
            return False
        parts = [*state["parts"], *([{**part, "order": state["next"]}] if part else [])]
        done = {**state["done"], source: batch} if source is not None else state["done"]
        self._commit(number, {**state, "next": state["next"] + 1, "parts": parts, "done": done})
        self.compact(MOST_DELTAS)
        return True

    def replace(self, rows: DataFrame) -> None:
        """Write ``rows`` over all that is there."""
        number, state = self.state()
        part = self._written(rows.select(*self.columns, F.lit(False).alias("_gone")), state["buckets"])
        self._commit(number, {**state, "next": state["next"] + 1, "parts": [{**part, "order": state["next"]}] if part else []})

    def compact(self, most: int = 0) -> set[int]:
        """Rewrite the buckets with more than ``most`` deltas; which these were."""
        number, state = self.state()
        counts = {b: sum(b in p["buckets"] for p in state["parts"]) for b in range(state["buckets"])}
        chosen = {b for b, n in counts.items() if n > most + 1}
        if not chosen:
            return chosen
        part = self._written(self._merged(state, chosen).where("not _gone").select(*self.columns, "_gone"), state["buckets"])
        rest = [{**p, "buckets": [b for b in p["buckets"] if b not in chosen]} for p in state["parts"]]
        made = [{**part, "order": state["next"]}] if part else []
        self._commit(number, {**state, "next": state["next"] + 1, "parts": [p for p in rest if p["buckets"]] + made})
        return chosen

    def vacuum(self) -> list[str]:
        """Delete folders that no manifest has, which writes that failed have left; no writer may be at work."""
        held = {p["folder"] for n in self.manifest.numbers() for p in (self.manifest.value(n) or self._new)["parts"]}
        at, files = self.manifest._at(self.root)
        names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
        stray = [n for n in names if n.startswith("part-") and n not in held]
        for n in stray:
            remove(self.spark, f"{self.root}/{n}")
        return stray
