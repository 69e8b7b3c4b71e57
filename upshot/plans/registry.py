"""Registry of named queries: a Spark builder plus its DuckDB oracle SQL.

Outputs are normalised the same way on both sides so results compare
exactly: double columns are rounded to a fixed number of decimals and cast to
DECIMAL(38, k); date and timestamp columns become ISO text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: dict[str, int] = field(default_factory=dict)
    texts: tuple[str, ...] = ()
    doc: str = ""


REGISTRY: dict[str, Query] = {}

# Decimals kept beyond the declared ones in a first rounding, on both sides. Means of
# fixed-point data can sit on a rounding tie, where summation noise in the last bit
# would decide; the first rounding removes that noise, and the second is done on a decimal, so that a tie
# goes the same way on both sides. The first moves a value by less than 10^-(k + GUARD) and leaves large sums as they are.
GUARD = 5


def finalize(df: DataFrame, doubles: dict[str, int], texts=()) -> DataFrame:
    """Round declared doubles to DECIMAL(38,k); dates/timestamps to text.

    Any double column without a declared scale is an error, so the Spark
    output and the oracle SQL cannot silently drift apart."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wrong = [c for c in doubles if c in kinds and not isinstance(
        kinds[c], (T.DoubleType, T.FloatType, T.DecimalType))]
    if wrong:
        raise ValueError(f"declared scales on non-double columns: {wrong}")
    cols = []
    for f in df.schema.fields:
        n = f.name
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            if n not in doubles:
                raise ValueError(f"double column {n!r} has no declared scale")
            k = doubles[n]
            if isinstance(f.dataType, T.DecimalType):
                cols.append(F.round(F.col(n), k).cast(T.DecimalType(38, k)).alias(n))
            else:
                cols.append(F.round(F.round(F.col(n).cast("double"), k + GUARD).cast(T.DecimalType(38, k + GUARD)), k).cast(T.DecimalType(38, k)).alias(n))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)) or n in texts:
            cols.append(F.col(n).cast("string").alias(n))
        else:
            cols.append(F.col(n))
    return df.select(*cols)


def sql_finalize(inner: str, doubles: dict[str, int], texts=()) -> str:
    parts = [f"CAST(round(CAST(round(CAST({c} AS DOUBLE), {k + GUARD}) AS DECIMAL(38,{k + GUARD})), {k}) AS DECIMAL(38,{k})) AS {c}"
             for c, k in doubles.items()]
    parts += [f"CAST({c} AS VARCHAR) AS {c}" for c in texts]
    if not parts:
        return inner
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{inner}\n) AS q"


def register(name: str, sql: str | None = None, doubles: dict[str, int] | None = None,
             texts=()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    doubles = dict(doubles or {})
    texts = tuple(texts)

    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return finalize(fn(spark, sf_dir), doubles, texts)
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        full_sql = sql_finalize(sql, doubles, texts) if sql is not None else None
        REGISTRY[name] = Query(name, build, full_sql, doubles, texts, fn.__doc__ or "")
        return fn
    return deco
