"""The fact store: extracted facts kept as Parquet by repo, keyed by path, time, size and extractor version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .extract import VERSION, facts

KEY = ["repo", "path", "mtime_ns", "size", "version"]


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts partitioned by repo. Repository keys stay text, also those that look like numbers."""
    schema = spark.read.parquet(path).schema
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name == "repo" else f for f in schema.fields])).parquet(path)


def split_hits(files: DataFrame, stored: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """(stored facts of files that haven't changed, files to extract). Facts of files that are gone drop out too."""
    keyed = files.withColumn("version", F.lit(VERSION))
    if stored is None:
        return None, files
    hits = stored.join(keyed.select(*KEY), KEY, "left_semi")
    return hits, keyed.join(stored.select(*KEY).distinct(), KEY, "left_anti").drop("version")


def update(spark: SparkSession, files: DataFrame, old_path: str | None, new_path: str) -> DataFrame:
    """Facts of all files: kept ones from old_path, fresh ones for the rest; written to new_path. Files without facts
    leave a marker row, so that they count as known."""
    stored = read_facts(spark, old_path) if old_path else None
    hits, misses = split_hits(files, stored)
    keys = misses.select("repo", "path", "lang", "mtime_ns", "size", F.lit(VERSION).alias("version"))
    fresh = keys.join(facts(misses).drop("lang"), ["repo", "path"], "left").withColumn("fact", F.coalesce("fact", F.lit("none")))
    out = fresh if hits is None else hits.unionByName(fresh)
    out.repartition("repo").write.partitionBy("repo").parquet(new_path)
    return read_facts(spark, new_path)
