"""Stream of event files into a keyed table: each micro-batch is validated and replaces its matches' rows.

The table is partitioned by a bucket of the match id, and a batch rewrites the buckets that it touches (dynamic partition
overwrite), from a checkpoint in the shared folder, so that a batch which runs again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.events import EVENT_DDL
from fieldloom.operators.quality import validate_events, verdict
from fieldloom.operators.tables import last_per_key, replace_children

BUCKETS = 64


def upsert_batch(batch: DataFrame, table: str) -> None:
    """batch: (path, modified, value), one row per file. Of several files of a match the latest counts; invalid matches are left out."""
    spark = batch.sparkSession
    files = last_per_key(batch.withColumn("match_id", F.regexp_extract("path", r"(\d+)\.json$", 1).cast("bigint")).filter("match_id is not null"), ["match_id"], F.desc("modified"), F.desc("path"))
    rows = files.select("match_id", F.posexplode(F.from_json("value", f"ARRAY<STRUCT<{EVENT_DDL}>>")).alias("pos", "r")).select("match_id", "pos", "r.*")
    rows = rows.join(verdict(rows, validate_events(rows)).filter("ok"), "match_id", "left_semi").withColumn("bucket", F.pmod(F.xxhash64("match_id"), F.lit(BUCKETS)))
    rows = rows.checkpoint()
    old = read_table(spark, table)
    if old is not None:
        touched = old.join(rows.select("bucket").distinct(), "bucket", "left_semi")
        rows = replace_children(touched, rows, ["match_id"]).checkpoint()
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)


def read_table(spark: SparkSession, table: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"match_id BIGINT, pos INT, {EVENT_DDL}, bucket BIGINT").parquet(table)


def stream_ingest(spark: SparkSession, source: str, table: str, checkpoint: str):
    """Takes what has arrived and stops; run again it takes only what is new. Returns the finished query."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{checkpoint}-steps")
    files = spark.readStream.schema("value STRING").option("wholetext", True).text(source).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    q = files.writeStream.foreachBatch(lambda df, _: upsert_batch(df, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
