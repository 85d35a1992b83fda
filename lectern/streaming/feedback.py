"""A log of feedback in which every event stands once, however often it was sent or a batch was run.

Repeats are left out by event id within a watermark, and events that come later than that are left
out too.  A batch is a folder named by its number: a batch that Spark runs again after a failure finds its
folder complete and adds nothing, or writes it anew if it was cut short.  Readers take complete folders alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, folder: str) -> bool:
    at, files = _files(spark, f"{folder}/_SUCCESS")
    return files.exists(at)


def append_batch(rows: DataFrame, path: str, number: int) -> bool:
    """Add batch ``number`` to the log at ``path``; whether it was not there yet."""
    folder = f"{path}/batch={number}"
    if _complete(rows.sparkSession, folder):
        return False
    rows.write.mode("overwrite").parquet(folder)
    return True


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of all complete batches; none where nothing was written."""
    at, files = _files(spark, path)
    found = [str(x.getPath().toString()) for x in files.listStatus(at)] if files.exists(at) else []
    whole = [f for f in found if "/batch=" in f and _complete(spark, f)]
    return spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)


def recorded(events: DataFrame, path: str, checkpoint: str, key: str = "event_id", at: str = "ts", late: str = "1 day", **trigger) -> StreamingQuery:
    """Write the stream ``events`` to the log at ``path``, each ``key`` once; repeats and events may come up to ``late`` behind."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))  # a watermark needs a time with a zone
    once = timed.withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")
    writer = once.writeStream.foreachBatch(lambda rows, n: append_batch(rows, path, n) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
