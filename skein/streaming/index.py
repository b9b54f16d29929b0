"""Incremental indexing: new source tables in a folder become facts, the latest version of a file winning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.extract import facts
from ..operators.store import read_facts
from ..schema import SOURCES
from ..sources import scan


def read_drops(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of sources tables (Parquet) dropped into a folder."""
    return spark.readStream.schema(SOURCES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def latest(rows: DataFrame) -> DataFrame:
    """One version per (repo, path), the newest."""
    order = Window.partitionBy("repo", "path").orderBy(F.desc("mtime_ns"))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def extract_batch(batch: DataFrame, batch_id: int, store: str) -> None:
    """Facts of a batch go to a folder of the batch's own number: a repeated batch replaces itself."""
    own = scan.supported(latest(batch))
    rows = facts(own).join(own.select("repo", "path", "mtime_ns"), ["repo", "path"])
    rows.write.mode("overwrite").partitionBy("repo").parquet(f"{store}/batch={batch_id}")


def start(spark: SparkSession, drops: str, store: str, checkpoint: str, once: bool = False):
    """Starts the query; once=True handles what is there and stops."""
    writer = read_drops(spark, drops).writeStream.foreachBatch(lambda b, i: extract_batch(b, i, store)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_facts(spark: SparkSession, store: str) -> DataFrame:
    """Facts of the latest version of every file over all batches."""
    rows = read_facts(spark, store)
    newest = rows.groupBy("repo", "path").agg(F.max(F.struct("mtime_ns", "batch")).alias("v")).select("repo", "path", "v.mtime_ns", "v.batch")
    return rows.join(newest, ["repo", "path", "mtime_ns", "batch"], "left_semi").drop("batch")
