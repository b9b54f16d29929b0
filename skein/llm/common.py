"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and the master is local."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="skein-")
    return _own_dir


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def save_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Like save() of tables of one schema, written one after the other into one folder."""
    path = None
    for df in parts:
        path = path or f"{shared_dir(df.sparkSession)}/skein/{name}-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by save() that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df._skein_path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int, mb: int = 16):
    """Arrow batches of at most so many rows and about so many bytes while eager work runs inside: rows that carry whole sets are large."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": mb << 20}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, most in wanted.items():
        now = int(before[key].removesuffix("b"))
        spark.conf.set(key, str(min(most, now) if now > 0 else most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: What a Python worker keeps from task to task, by name: how to forget it. Workers outlive their stage.
_kept: dict[str, Callable[[], None]] = {}


def keeps(name: str, forget: Callable[[], None]) -> None:
    """Tells this worker how to forget what it keeps under a name."""
    _kept[name] = forget


def lean(run: Callable, keep: str | None = None) -> Callable:
    """For mapInArrow: forgets what other operators' tasks have left in the worker but `keep`, and gives freed memory back at the end."""

    def task(batches):
        for name in [n for n in _kept if n != keep]:
            _kept.pop(name)()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def text_slices(batch, at: int, most: int):
    """(first row, texts) of slices of an Arrow batch that end where their texts reach so many bytes; only one slice's texts are Python strings at a time."""
    import numpy as np
    import pyarrow.compute as pc

    column = batch.column(at)
    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        base = int(ends[start - 1]) if start else 0
        stop = min(len(column), int(np.searchsorted(ends, base + most)) + 1)
        yield start, column.slice(start, stop - start).to_pylist()
        start = stop


def _give_back() -> None:
    import contextlib
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own ways
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, col: str, parts: int) -> list[int]:
    """At most parts - 1 ascending cut points that split the column's values about evenly (one bounded row reaches the driver)."""
    qs = [i / parts for i in range(1, parts)]
    got = df.select(F.percentile_approx(col, qs, 20_000).alias("q")).first()
    return sorted(set(got["q"] or []))


def range_bucket(col: Column, bounds: list[int], fan: int = 32) -> Column:
    """How many cut points are <= the value; 0 for null. Two short array scans instead of one long one."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    firsts = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    rows = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    coarse = F.size(F.filter(firsts, lambda x: x <= col))
    fine = F.size(F.filter(F.element_at(rows, F.greatest(coarse, F.lit(1))), lambda x: x <= col))
    return F.when(col.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * fan + fine)
