"""Binary files: text lines of documents, the audio cache, WAV previews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.audio import RATE, mastered, tone
from lectern.operators.cache import CAP, evicted
from lectern.functions.shared import remove as delete

MOST_BYTES, TIMEOUT = 12_000_000, 25


def blobs(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, modificationTime, length, content) of files within the size cap; the cap prunes before content is read."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most)


def text_lines(rows: DataFrame, key: str, content: str, parse: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(key, page, line_no, line).  ``parse`` gives a document's pages (default: UTF-8, form feeds between pages)."""
    if parse is None:
        pages = rows.select(key, F.posexplode(F.split(F.col(content).cast("string"), "\f")).alias("page", "text"))
    else:

        def run(batches):
            for pdf in batches:
                pdf["pages"] = [parse(bytes(b)) for b in pdf[content]]
                yield pdf[[key, "pages"]]

        kind = rows.schema[key].dataType.simpleString()
        pages = rows.select(key, content).mapInPandas(run, f"{key} {kind}, pages array<string>").select(key, F.posexplode("pages").alias("page", "text"))
    return pages.select(key, "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def samples_of(wavs: DataFrame, key: str, audio: str = "audio") -> DataFrame:
    """(key, samples array<smallint>) of mono 16-bit WAV bytes."""
    kind = wavs.schema[key].dataType.simpleString()

    def unpack(batches):
        import io
        import wave

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for body in batch.column(audio).to_pylist():
                with wave.open(io.BytesIO(body)) as w:
                    out.append(np.frombuffer(w.readframes(w.getnframes()), "<i2"))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.int16()))], [key, "samples"])

    return wavs.select(key, audio).mapInArrow(unpack, f"{key} {kind}, samples array<smallint>")


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """(key, audio binary) of rows (key, samples): mono 16-bit WAV."""
    kind = rows.schema[key].dataType.simpleString()

    def pack(batches):
        import io
        import wave

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for samples in batch.column("samples"):
                held = io.BytesIO()
                with wave.open(held, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(RATE)
                    w.writeframes(np.asarray(samples.values, "<i2").tobytes())
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.binary())], [key, "audio"])

    return rows.select(key, "samples").mapInArrow(pack, f"{key} {kind}, audio binary")


def wav(rows: DataFrame, key: str, script: str, title: str) -> DataFrame:
    """(key, audio binary): mono 16-bit preview clips; samples are made natively, the container in Arrow batches."""
    return _packed(rows.select(key, tone(F.col(script), F.col(title)).alias("samples")), key)


def post_processed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, audio, content_type, ...) with WAV audio at the target loudness and faded; other audio, which only
    an outside decoder could read, and silence are passed through."""
    plain = F.col("content_type") == "audio/wav"
    levelled = _packed(samples_of(rows.where(plain), key).select(key, mastered(F.col("samples")).alias("samples")), key)
    return rows.join(levelled.withColumnRenamed("audio", "_new"), key, "left").withColumn("audio", F.coalesce("_new", "audio")).drop("_new")


def download(url: str, most: int = MOST_BYTES, timeout: int = TIMEOUT) -> bytes | None:
    """The body at ``url``; None if its declared or its actual length is above ``most``."""
    import urllib.request

    with urllib.request.urlopen(url, timeout=timeout) as r:
        if int(r.headers.get("Content-Length") or 0) > most:
            return None
        body = r.read(most + 1)
    return body if len(body) <= most else None


def fetched(rows: DataFrame, key: str, url: str, get: Callable[[str], bytes | None] = download, most: int = MOST_BYTES) -> DataFrame:
    """(key, content) of the addresses in ``url``, on executors; null where the fetch fails or the body is too long."""
    kind = rows.schema[key].dataType.simpleString()

    def one(address):
        try:
            body = get(address)
        except Exception:  # noqa: BLE001  a document that cannot be had is one without content
            return None
        return body if body is not None and len(body) <= most else None

    def run(batches):
        for pdf in batches:
            pdf["content"] = [one(a) if a else None for a in pdf[url]]
            yield pdf[[key, "content"]]

    return rows.select(key, url).mapInPandas(run, f"{key} {kind}, content binary")


class AudioCache:
    """Blobs by key, a folder each, and an append-only log of uses; eviction is the LRU query over sizes and last uses."""

    SCHEMA = "key string, content_type string, audio binary, mtime timestamp"

    def __init__(self, spark: SparkSession, root: str, cap: int = CAP):
        self.spark, self.root, self.cap = spark, root.rstrip("/"), cap

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:  # nothing cached yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _blobs(self) -> DataFrame:
        return self._table("blobs", "content_type string, audio binary, size long, key string")

    def _touch(self, rows: DataFrame) -> None:
        rows.select("key", F.col("mtime").cast("timestamp").alias("mtime")).write.mode("append").parquet(f"{self.root}/uses")

    def put(self, rows: DataFrame) -> None:
        """Write rows (key, content_type, audio, mtime), each in place of its key's; then evict what exceeds the cap."""
        out = rows.select("content_type", "audio", F.length("audio").cast("long").alias("size"), "key")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(f"{self.root}/blobs")
        self._touch(rows)
        for r in self.evictable().select("key").toLocalIterator():  # what the new rows have pushed out
            delete(self.spark, f"{self.root}/blobs/key={r['key']}")

    def get(self, key: str, at=None) -> DataFrame:
        """(key, content_type, audio) under ``key``, from its folder alone; a hit counts as a use ``at`` a time (default: now)."""
        found = self._blobs().where(F.col("key") == key).select("key", "content_type", "audio")
        if not found.isEmpty():
            self._touch(self.spark.range(1).select(F.lit(key).alias("key"), (F.current_timestamp() if at is None else F.lit(at)).alias("mtime")))
        return found

    def evictable(self) -> DataFrame:
        """(key, size, mtime) of the least recently used blobs above the cap; sizes are read without the blobs."""
        uses = self._table("uses", "key string, mtime timestamp").groupBy("key").agg(F.max("mtime").alias("mtime"))
        return evicted(self._blobs().select("key", "size").join(uses, "key"), self.cap)
