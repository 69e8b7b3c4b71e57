"""File and database sources and result sinks (S-1, S-2, S-5, S-6)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             date_cols=(), timestamp_cols=(), date_format: str | None = None) -> DataFrame:
    """CSV scan with a declared schema (S-1).

    Date and timestamp columns are declared as strings in ``schema`` and parsed
    with ``try_to_timestamp`` so unparsable values become null instead of
    failing the job, like a lenient loader.
    """
    df = (spark.read.option("header", True).option("mode", "PERMISSIVE")
          .schema(schema).csv(path))
    fmt = F.lit(date_format) if date_format else None
    for c in date_cols:
        ts = F.try_to_timestamp(F.col(c), fmt) if fmt is not None else F.try_to_timestamp(F.col(c))
        df = df.withColumn(c, ts.cast("date"))
    for c in timestamp_cols:
        ts = F.try_to_timestamp(F.col(c), fmt) if fmt is not None else F.try_to_timestamp(F.col(c))
        df = df.withColumn(c, ts)
    return df


def read_source(spark: SparkSession, fmt: str, path: str | None = None,
                schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Generic scan (S-2): parquet/orc/json/csv files, a catalog table, or a
    JDBC query (``fmt='jdbc'``, ``query=...``, ``url=...``).

    An empty result is an empty DataFrame with the source schema.
    """
    if fmt == "table":
        return spark.table(path)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path) if path is not None else reader.load()


def write_result(df: DataFrame, path: str, fmt: str = "parquet",
                 partition_by=(), single_file: bool = False) -> None:
    """Result sink (S-5). ``single_file`` is for report-sized tables only."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def replace_table(df: DataFrame, name: str, bucket_by: str, buckets: int, path: str | None = None) -> None:
    """Persisted, bucketed table (S-6), replaced at one stroke: the rows are written as a table of a new name, bucketed and
    sorted by ``bucket_by``, and the view ``name`` then points to it; readers see the old table or the new one, never half
    of either. Older versions are dropped afterwards. Joins and aggregations on ``bucket_by`` read it without a
    shuffle. With ``path``, the files are kept below it."""
    spark = df.sparkSession
    version = f"{name}_v{uuid.uuid4().hex}"
    w = df.write.format("parquet").bucketBy(buckets, bucket_by).sortBy(bucket_by)
    if path:
        w = w.option("path", f"{path.rstrip('/')}/{version}")
    w.saveAsTable(version)
    spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS SELECT * FROM `{version}`")
    for t in spark.catalog.listTables():
        if t.name.startswith(f"{name.lower()}_v") and t.name != version.lower() and not t.isTemporary:
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")


def save_table(df: DataFrame, name: str, partition_by=(), bucket_by: tuple | None = None) -> None:
    """Persisted analysis table (S-6): replace-on-write catalog table,
    optionally partitioned (e.g. by ``group_type``) or bucketed by a join key
    so later joins on that key co-locate without a shuffle."""
    w = df.write.mode("overwrite").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        n, *cols = bucket_by
        w = w.bucketBy(n, *cols).sortBy(*cols)
    w.saveAsTable(name)
