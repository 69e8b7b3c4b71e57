"""Compound monthly growth rates around an event date (G-1 .. G-7, C-6, C-7).

Everything is one conditional aggregation per unit: window membership is a
predicate on (period, event date), the first / last positive value of a
window are ``min_by`` / ``max_by`` over the period, so no per-unit loop and no
window function is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .effects import add_t_pvalue, one_sample_t, pooled_t, unpivot_structs
from .panel import median_time


def cmgr(first: Column, last: Column, k: Column) -> Column:
    """G-1: (last / first)^(1 / (k - 1)) - 1 over the k positive observations;
    null with fewer than two."""
    return F.when(k >= 2, F.pow(last / first, F.lit(1.0) / (k - 1)) - 1.0)


def growth_per_unit(panel: DataFrame, unit: str, period: str, event: Column | str,
                    metrics: Sequence[str], pre_months: int = 6, post_months: int = 6,
                    min_rows: int = 12) -> DataFrame:
    """G-2 / G-3 / W-1 / W-2: per (unit, metric) growth in [e - pre, e) and
    [e, e + post), kept when the unit has ``min_rows`` rows and both rates
    exist. ``pre_months`` / ``post_months`` output columns count every row of
    the window, zeros and negatives included."""
    e = F.col(event) if isinstance(event, str) else event
    p = F.col(period)
    pre = (p >= F.add_months(e, -pre_months)) & (p < e)
    post = (p >= e) & (p < F.add_months(e, post_months))
    aggs = [F.count(F.lit(1)).alias("rows"), F.min(e).alias("event_date")]
    per = {}
    for i, m in enumerate(metrics):
        v = F.col(m).cast("double")
        fields = []
        for tag, cond in (("pre", pre), ("post", post)):
            pos = cond & (v > 0)
            aggs += [F.count_if(cond).alias(f"{tag}_n_{i}"), F.count_if(pos).alias(f"{tag}_k_{i}"),
                     F.min_by(v, F.when(pos, p)).alias(f"{tag}_first_{i}"),
                     F.max_by(v, F.when(pos, p)).alias(f"{tag}_last_{i}")]
            fields += [F.col(f"{tag}_n_{i}").alias(f"{tag}_months"),
                       cmgr(F.col(f"{tag}_first_{i}"), F.col(f"{tag}_last_{i}"),
                            F.col(f"{tag}_k_{i}")).alias(f"{tag}_cmgr")]
        per[m] = F.struct(*fields)
    g = panel.groupBy(unit).agg(*aggs)
    long = unpivot_structs(g, [unit, "rows", "event_date"], per)
    return (long.where((F.col("rows") >= min_rows) & F.col("pre_cmgr").isNotNull()
                       & F.col("post_cmgr").isNotNull())
            .withColumn("cmgr_acceleration", F.col("post_cmgr") - F.col("pre_cmgr"))
            .select(unit, "metric", "event_date", "pre_cmgr", "post_cmgr", "cmgr_acceleration",
                    "pre_months", "post_months"))


def eligibility(panel: DataFrame, unit: str, period: str, event: Column | str,
                min_pre: int = 6, min_post: int = 6, min_rows: int = 0) -> DataFrame:
    """C-6 / C-7: per unit total rows and rows before / from the event date;
    ``suitable`` when both sides and the total reach their minimums."""
    e = F.col(event) if isinstance(event, str) else event
    g = panel.groupBy(unit).agg(F.min(e).alias("event_date"),
                                F.count(F.lit(1)).alias("total_months"),
                                F.count_if(F.col(period) < e).alias("pre_months"),
                                F.count_if(F.col(period) >= e).alias("post_months"))
    return g.withColumn("suitable", (F.col("pre_months") >= min_pre) & (F.col("post_months") >= min_post)
                        & (F.col("total_months") >= min_rows))


def eligibility_summary(elig: DataFrame) -> DataFrame:
    """C-6 summary: units, suitable units, average total / pre / post months."""
    return elig.agg(F.count(F.lit(1)).alias("units"), F.count_if("suitable").alias("suitable_units"),
                    F.avg("total_months").alias("avg_total_months"),
                    F.avg("pre_months").alias("avg_pre_months"),
                    F.avg("post_months").alias("avg_post_months"))


def pseudo_event_date(panel: DataFrame, event: str) -> object:
    """C-7: the control arm's pseudo event date = median treated event date
    over panel rows (a scalar from one aggregation)."""
    return median_time(panel.where(F.col(event).isNotNull()), event)


def growth_comparison(treated: DataFrame, control: DataFrame | None, with_p: bool = False) -> DataFrame:
    """G-5: per metric, mean pre / post / acceleration per arm, net impact,
    its annualised value and the test on accelerations (two-sample when
    controls exist, else one-sample against zero)."""
    def arm(df, tag):
        return df.groupBy("metric").agg(
            F.count(F.lit(1)).alias(f"n_{tag}"), F.avg("pre_cmgr").alias(f"pre_{tag}"),
            F.avg("post_cmgr").alias(f"post_{tag}"), F.avg("cmgr_acceleration").alias(f"mean_{tag}"),
            F.var_samp("cmgr_acceleration").alias(f"var_{tag}"))
    t = arm(treated, "t")
    if control is None:
        one = one_sample_t(treated, "cmgr_acceleration", ["metric"], with_p=with_p)
        out = t.join(one.select("metric", "t_stat", "df", *(["p_value"] if with_p else [])), "metric")
        out = out.withColumn("net_impact", F.col("mean_t"))
    else:
        c = arm(control, "c")
        j = t.join(c, "metric", "left").na.fill(0, ["n_c"])
        out = pooled_t(j).drop("sd_t", "sd_c", "diff", "lift_pct")
        out = add_t_pvalue(out) if with_p else out
        out = out.withColumn("net_impact", F.col("mean_t") - F.coalesce(F.col("mean_c"), F.lit(0.0)))
    return out.withColumn("net_impact_annual", F.pow(1.0 + F.col("net_impact"), 12.0) - 1.0)
