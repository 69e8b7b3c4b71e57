"""Panel cleaning: coercion, category filling, outlier removal (P-1, P-2, C-1, C-2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_category, to_number
from ..session import cut_lineage
from .quantiles import exact_quantiles, small_side


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P-1 for several columns: unparsable/null -> 0.0."""
    return df.withColumns({c: to_number(c) for c in cols if c in df.columns})


def fill_categories(df: DataFrame, cols: Sequence[str], keep_raw: Sequence[str] = ()) -> DataFrame:
    """P-2 for several columns. Columns in ``keep_raw`` keep their nullable
    original as ``<col>_raw`` so "has a real value" tests stay possible."""
    for c in keep_raw:
        if c in df.columns:
            df = df.withColumn(f"{c}_raw", F.col(c))
    return df.withColumns({c: clean_category(c) for c in cols if c in df.columns})


def remove_outliers_iqr(df: DataFrame, columns: Sequence[str], segment: str,
                        factor: float = 2.5, min_n: int = 10) -> DataFrame:
    """C-1: per segment, drop rows outside [Q1 - f*IQR, Q3 + f*IQR].

    Columns are processed in order, each on the rows left by the previous
    one. A segment is only trimmed when it has more than ``min_n`` rows and a
    positive IQR; rows with a null segment are never removed. Quartiles are
    exact at any size (linear interpolation, :mod:`.quantiles`)."""
    cols = [c for c in columns if c in df.columns]
    out = df.withColumns({c: to_number(c) for c in cols})
    if not cols:
        return out
    # the quartiles of a column read only the segment and the columns: written once, and trimmed as they come
    live = cut_lineage(out.select(F.col(segment).alias("__key"), *[F.col(c).alias(f"__x{i}") for i, c in enumerate(cols)])
                       .where(F.col("__key").isNotNull()))
    for i, c in enumerate(cols):
        q = F.col("q")
        stats = (exact_quantiles(live, f"__x{i}", (0.25, 0.75), ["__key"])
                 .where((F.col("n") > min_n) & ((q[1] - q[0]) > 0))
                 .select(F.col("__key").alias("__seg"),
                         (q[0] - factor * (q[1] - q[0])).alias("__lo"),
                         (q[1] + factor * (q[1] - q[0])).alias("__hi")))
        bounds = small_side(cut_lineage(stats))
        live = _inside(live, F.col("__key"), F.col(f"__x{i}"), bounds)
        out = _inside(out, F.col(segment), F.col(c), bounds)
    return out


def _inside(df: DataFrame, segment: Column, value: Column, bounds: DataFrame) -> DataFrame:
    """Rows within the bounds of their segment, and those of a segment without."""
    return (df.join(bounds, segment == F.col("__seg"), "left")
            .where(F.col("__lo").isNull() | ((value >= F.col("__lo")) & (value <= F.col("__hi"))))
            .drop("__seg", "__lo", "__hi"))


def remove_outliers_zscore(df: DataFrame, columns: Sequence[str], z: float = 3.0) -> DataFrame:
    """C-2: keep rows with |x - mean| / sd < z for every column. The global
    moments are one aggregation whose scalars become literals of the filter."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m{i}"),
                 F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}")]
    mom = df.agg(*aggs).first()
    cond = F.lit(True)
    for i, c in enumerate(columns):
        m, s = mom[f"m{i}"], mom[f"s{i}"]
        if m is None or not s:
            continue
        cond = cond & (F.abs(F.col(c).cast("double") - F.lit(m)) / F.lit(s) < z)
    return df.where(cond)
