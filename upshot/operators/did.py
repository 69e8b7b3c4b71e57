"""Difference-in-differences and within-unit change (E-13 .. E-15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from .panel import unit_period
from .effects import unpivot_structs

CELLS = (("treat_pre", 1, 0), ("treat_post", 1, 1), ("control_pre", 0, 0), ("control_post", 0, 1))


def did(panel: DataFrame, unit: str, period: str, arm: str, outcomes: Sequence[str],
        split: Column | None = None, with_p: bool = True) -> DataFrame:
    """E-13: 2 x 2 difference in differences per outcome.

    The panel is first reduced to one row per (unit, period) (mean outcome,
    the unit's flag; A-2). ``split`` is the post indicator; by default rows
    at or after the median period (over the input rows, A-13) are post.
    SE = sqrt(sum over cells of s^2 / n); t = estimate / SE (0 when SE = 0, null
    when a cell is too small for an SE).
    ``p_value`` is the two-sided normal tail; ``p_value_simplified`` keeps the
    legacy formula 2(1 - |t|) for |t| <= 1, else 0.05 (it can exceed 1)."""
    if split is None:
        med = panel.agg(F.percentile(F.unix_date(F.col(period).cast("date")).cast("double"), 0.5)
                        .alias("m")).first()["m"]
        split = F.unix_date(F.col(period).cast("date")) >= F.lit(med)
    cell = unit_period(panel, unit, period, outcomes, arm).withColumn("__post", split.cast("int"))
    aggs = []
    for i, o in enumerate(outcomes):
        for name, a, p in CELLS:
            v = F.when((F.col(arm) == a) & (F.col("__post") == p), F.col(o))
            aggs += [F.avg(v).alias(f"{name}_{i}"), F.stddev_samp(v).alias(f"{name}_sd_{i}"),
                     F.count(v).alias(f"{name}_n_{i}")]
    g = cell.agg(*aggs)
    per = {o: F.struct(*[F.col(f"{name}{suf}_{i}").alias(f"{name}{suf}")
                         for name, _, _ in CELLS for suf in ("", "_sd", "_n")])
           for i, o in enumerate(outcomes)}
    long = unpivot_structs(g, [], per, "outcome")
    est = (F.col("treat_post") - F.col("treat_pre")) - (F.col("control_post") - F.col("control_pre"))
    se = F.sqrt(sum((F.try_divide(F.pow(F.col(f"{n}_sd"), 2), F.col(f"{n}_n")) for n, _, _ in CELLS), F.lit(0.0)))
    long = (long.withColumn("did_estimate", est).withColumn("standard_error", se)
            .withColumn("t_statistic", F.when(F.col("standard_error") > 0, F.col("did_estimate") / F.col("standard_error"))
                        .when(F.col("standard_error").isNotNull(), 0.0))
            .withColumn("p_value_simplified", F.when(F.abs("t_statistic") <= 1,
                                                     2 * (1 - F.abs("t_statistic")))
                        .when(F.col("t_statistic").isNotNull(), 0.05)))
    if with_p:
        long = long.withColumn("p_value", F.when(F.col("t_statistic").isNotNull(), D.z_pvalue(F.col("t_statistic"))))
    return long


def did_cluster_se(panel: DataFrame, unit: str, period: str, arm: str, outcome: str,
                   split: Column) -> DataFrame:
    """E-14: DiD as the saturated 2 x 2 regression with unit-clustered SE.

    The interaction coefficient equals the 2 x 2 estimate; it is the linear
    contrast sum_i a_i y_i with a_i = c_cell / n_cell, so its cluster-robust
    variance is sum over units of (sum_i a_i e_i)^2 with e_i the residual
    from the cell mean (CR1 factor G/(G-1) * (N-1)/(N-4)). Two aggregations."""
    y = F.col(outcome).cast("double")
    df = panel.select(unit, y.alias("__y"), F.col(arm).alias("__a"), split.cast("int").alias("__p"))
    cells = df.groupBy("__a", "__p").agg(F.avg("__y").alias("__m"), F.count(F.lit(1)).alias("__n"))
    j = df.join(F.broadcast(cells), ["__a", "__p"], "inner")
    sign = F.when(F.col("__a") == F.col("__p"), 1.0).otherwise(-1.0)
    contrib = sign / F.col("__n") * (F.col("__y") - F.col("__m"))
    per_unit = j.groupBy(unit).agg(F.sum(contrib).alias("__s"), F.count(F.lit(1)).alias("__k"),
                                   F.sum(sign / F.col("__n") * F.col("__y")).alias("__b"))
    g = per_unit.agg(F.sum("__b").alias("did_estimate"), F.sum(F.col("__s") ** 2).alias("__v"),
                     F.count(F.lit(1)).alias("clusters"), F.sum("__k").alias("n_obs"))
    fac = F.try_divide(F.col("clusters"), F.col("clusters") - 1.0) * F.try_divide(F.col("n_obs") - 1.0, F.col("n_obs") - 4.0)
    return (g.withColumn("se_cluster", F.sqrt(F.col("__v") * fac))
            .withColumn("t_cluster", F.try_divide(F.col("did_estimate"), F.nullif(F.col("se_cluster"), F.lit(0.0))))
            .drop("__v"))


def prepost_change(panel: DataFrame, unit: str, period: str, event: str,
                   outcomes: Sequence[str]) -> DataFrame:
    """E-15: per treated unit and outcome, mean before and from its own event
    date, the difference and percent change (units with both sides)."""
    e, p = F.col(event), F.col(period)
    aggs = []
    for i, o in enumerate(outcomes):
        v = F.col(o).cast("double")
        aggs += [F.avg(F.when(p < e, v)).alias(f"pre_{i}"), F.avg(F.when(p >= e, v)).alias(f"post_{i}")]
    g = panel.where(e.isNotNull()).groupBy(unit).agg(*aggs)
    per = {o: F.struct(F.col(f"pre_{i}").alias("pre_mean"), F.col(f"post_{i}").alias("post_mean"))
           for i, o in enumerate(outcomes)}
    long = unpivot_structs(g, [unit], per, "outcome")
    return (long.where(F.col("pre_mean").isNotNull() & F.col("post_mean").isNotNull())
            .withColumn("change", F.col("post_mean") - F.col("pre_mean"))
            .withColumn("pct_change", F.try_divide(F.col("change"), F.nullif(F.col("pre_mean"), F.lit(0.0))) * 100.0))
