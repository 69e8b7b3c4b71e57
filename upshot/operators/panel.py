"""Unit-level and unit x period aggregation (A-1, A-2, A-13 .. A-16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def first_by(value: str, order: Column | str) -> Column:
    """First non-null value in ``order`` (a total order): pandas ``first``."""
    v = F.col(value)
    o = F.col(order) if isinstance(order, str) else order
    return F.min_by(v, F.when(v.isNotNull(), o))


def cross_section(df: DataFrame, unit: str, means: Sequence[str], firsts: Sequence[str],
                  order: str) -> DataFrame:
    """A-1: one row per unit with the mean of each outcome and the first
    non-null value of each attribute in ``order``."""
    aggs = [F.avg(F.col(m).cast("double")).alias(m) for m in means]
    aggs += [first_by(a, order).alias(a) for a in firsts]
    return df.groupBy(unit).agg(*aggs)


def unit_period(df: DataFrame, unit: str, period: str, outcomes: Sequence[str],
                flag: str) -> DataFrame:
    """A-2: customer x time panel: mean outcome per cell, the unit's flag."""
    aggs = [F.avg(F.col(o).cast("double")).alias(o) for o in outcomes]
    aggs.append(F.max(flag).alias(flag))
    return df.groupBy(unit, period).agg(*aggs)


def median_time(df: DataFrame, col: str):
    """A-13: median of a date/timestamp column, linear interpolation, as a timestamp value
    (None without any). Dates have few different values, so one aggregation counts them; timestamps
    may have as many as rows and go through the distributed quantiles."""
    secs = F.unix_micros(F.col(col).cast("timestamp")).cast("double") / 1e6
    if dict(df.dtypes)[col] == "date":
        return df.agg(F.timestamp_seconds(F.percentile(secs, 0.5)).alias("m")).first()["m"]
    found = exact_quantiles(df.select(secs.alias("__s")), "__s", (0.5,)).select(F.timestamp_seconds(F.col("q")[0]).alias("m")).first()
    return found["m"] if found else None


def quartiles(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """A-14: Q1 and Q3 per segment, exact at any size (linear interpolation)."""
    g = exact_quantiles(df, value, (0.25, 0.75), by)
    return (g.withColumn("q1", F.col("q")[0]).withColumn("q3", F.col("q")[1])
            .withColumn("iqr", F.col("q3") - F.col("q1")).drop("q"))


def profile(df: DataFrame, unit: str, arm: str, numeric: Sequence[str]) -> DataFrame:
    """A-15: one-row data profile: rows, units, arm units, min/max/mean."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.countDistinct(unit).alias("units"),
            F.countDistinct(F.when(F.col(arm) == 1, F.col(unit))).alias("treated_units"),
            F.countDistinct(F.when(F.col(arm) == 0, F.col(unit))).alias("control_units")]
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.avg(x).alias(f"{c}_mean")]
    return df.agg(*aggs)


def arm_period_moments(df: DataFrame, arm: str, post: str, value: str) -> DataFrame:
    """A-16: n, mean and sample sd per (arm, post) cell."""
    v = F.col(value).cast("double")
    return df.groupBy(arm, post).agg(F.count(v).alias("n"), F.avg(v).alias("mean"),
                                     F.stddev_samp(v).alias("sd"))
