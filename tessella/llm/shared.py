"""What the operators share: tables in the cluster's folder, checked broadcasts, batch bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch. A batch holds whole texts, so these bound a worker's memory; one row may be larger.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
#: Rows up to which a table of a few fixed-width columns may be broadcast.
BROADCAST_ROWS = 1_000_000


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batches to `rows` and BATCH_BYTES; smaller settings stay.

    Spark reads both when a plan runs, which may be long after this call, so they
    are not set back.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, str(2**31 - 1))
        if not (now.isdigit() and 1 <= int(now) <= most):
            spark.conf.set(key, str(most))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and the master is a single machine is a local one used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, executors may be lost."""
    spark = df.sparkSession
    path = f"{new_folder(spark, name)}/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Delete the files behind a table made by kept(), once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows; else df, to be shuffled.

    Meant for tables made by kept(), whose count is read from Parquet footers.
    """
    return F.broadcast(df) if df.count() <= rows else df
