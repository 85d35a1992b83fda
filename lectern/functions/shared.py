"""Files in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def bounded(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> SparkSession:
    """The session, with bounds of Arrow batches; a session that sets its own tighter ones keeps them."""
    for name, bound in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        held = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not held or not held.isdigit() or not 0 < int(held) <= bound:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(bound))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder.

    Where none is set, a session of one machine (``local``) uses its warehouse; any other is an
    error, as executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lectern-files"
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    schema = df.schema
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
