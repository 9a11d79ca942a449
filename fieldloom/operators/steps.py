"""Written steps: tables in the folder that the driver and all executors see, and Arrow batches of bounded bytes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that one Arrow batch is to hold.
BATCH_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where driver and executors are one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: what is dear to make is made once, and a lost executor costs tasks only."""
    path = f"{shared_folder(df.sparkSession)}/fieldloom-steps/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles() if "/fieldloom-steps/" in file}:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of plans that nothing refers to any more, which it otherwise does when its driver happens to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def batches_of(spark: SparkSession, row_bytes: int) -> Iterator[None]:
    """While this holds, Arrow batches have as many rows of that size as fit BATCH_BYTES; for jobs started inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(1, min(int(before), BATCH_BYTES // max(1, row_bytes)))))
    try:
        yield
    finally:
        spark.conf.set(key, before)
