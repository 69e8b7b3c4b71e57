"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import inspect
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import checkpoint_dir, ship_package


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, shared by all executors. The
    driver removes it when the session ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/upshot-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`materialise` that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str, *partition_by: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: later steps
    start from the files, whatever executors are lost."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def open_file(path: str, write: bool = False):
    """A file of the shared folder, in whatever store it is."""
    from pyarrow import fs
    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if write:
        store.create_dir(at.rpartition("/")[0], recursive=True)
    return store.open_output_stream(at) if write else store.open_input_file(at)


def release() -> None:
    """Give freed memory of this process back to the system."""
    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow. Spark uses Python workers again: what a task has freed goes back to the system at
    its end, else it adds to the memory of the next step's tasks."""

    @functools.wraps(run)
    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def lean_group(run: Callable) -> Callable:
    """:func:`lean` for the groups of applyInArrow."""

    @functools.wraps(run)
    def tidy(*tables):
        try:
            return run(*tables)
        finally:
            release()

    tidy.__signature__ = inspect.signature(run)  # Spark looks at the number of arguments
    return tidy


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(df: DataFrame, key: str, order: list[str], out: str, rows_per_part: int = 50_000,
                 rows: int | None = None) -> DataFrame:
    """Number the rows of each ``key`` (without nulls) 0, 1, 2 … without bringing a key into one
    task: rows are ranked within (key, part), parts dealt by a hash of ``order``,
    and the counts of the parts before are added."""
    rows = df.count() if rows is None else rows
    parts = max(1, -(-rows // rows_per_part))
    d = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = d.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(
        Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = d.withColumn("_local", F.row_number().over(
        Window.partitionBy(key, "_part").orderBy(*order)) - 1)
    before = before.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), "_before")
    joined = ranked.join(before, (F.col(key) == F.col("_k")) & (F.col("_part") == F.col("_p")))
    return (joined.withColumn(out, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long"))
            .drop("_k", "_p", "_part", "_local", "_before"))


LONG, INT, DOUBLE, STRING, BINARY, BOOL = (T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(),
                                           T.BinaryType(), T.BooleanType())


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
