"""Two-sample and one-sample effect estimation (E-1 .. E-4, E-17, E-19, E-20).

One shape for every effect table: one row per (segment keys, metric) with the
per-arm moments, the difference, the percent lift and the test statistic.
All metrics are measured in a single aggregation (conditional moments per
arm), so adding metrics adds columns, not passes over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.columns import lift_pct

Z_975 = 1.959963984540054   # standard normal quantile at 0.975 (fixed value)
Z_80 = 0.8416212335729143   # standard normal quantile at 0.80 (fixed value)


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def unpivot_structs(wide: DataFrame, keys: Sequence[str], per_metric: dict[str, Column],
                    metric_col: str = "metric") -> DataFrame:
    """Turn one struct column per metric into long rows (keys, metric, fields)."""
    names = list(per_metric)
    tmp = wide.select(*keys, *[per_metric[m].alias(f"__m_{i}") for i, m in enumerate(names)])
    stacked = tmp.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias(metric_col), F.col(f"__m_{i}").alias("s"))
        for i, m in enumerate(names)])).alias("__x"))
    return stacked.select(*keys, F.col(f"__x.{metric_col}").alias(metric_col), "__x.s.*")


def arm_moments(df: DataFrame, arm: str, metrics: Sequence[str],
                by: Sequence[str] = (), treated_value=1) -> DataFrame:
    """Per (by, metric): n, mean and sample variance for treated and control
    arms, from one grouped aggregation (map-side partial aggregation)."""
    aggs = []
    is_t = F.col(arm) == treated_value
    is_c = (F.col(arm) != treated_value) & F.col(arm).isNotNull()
    for i, m in enumerate(metrics):
        vt = F.when(is_t, _c(m).cast("double"))
        vc = F.when(is_c, _c(m).cast("double"))
        aggs += [F.count(vt).alias(f"n_t_{i}"), F.avg(vt).alias(f"mean_t_{i}"),
                 F.var_samp(vt).alias(f"var_t_{i}"), F.count(vc).alias(f"n_c_{i}"),
                 F.avg(vc).alias(f"mean_c_{i}"), F.var_samp(vc).alias(f"var_c_{i}")]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    per = {m: F.struct(*[F.col(f"{f}_{i}").alias(f) for f in
                         ("n_t", "mean_t", "var_t", "n_c", "mean_c", "var_c")])
           for i, m in enumerate(metrics)}
    return unpivot_structs(wide, list(by), per)


def pooled_t(m: DataFrame) -> DataFrame:
    """Equal-variance two-sample t on a moments table (columns n_t, n_c,
    mean_t, mean_c, var_t, var_c). Adds sd_*, diff, lift_pct, t_stat, df.

    A one-row arm contributes zero to the pooled sum of squares; a zero pooled
    standard error gives a null statistic (no test possible)."""
    nt, nc = F.col("n_t"), F.col("n_c")
    ss = ((nt - 1) * F.coalesce(F.col("var_t"), F.lit(0.0))
          + (nc - 1) * F.coalesce(F.col("var_c"), F.lit(0.0)))
    dof = nt + nc - 2
    sp2 = F.try_divide(ss, F.nullif(dof, F.lit(0)).cast("double"))
    se = F.sqrt(sp2 * (F.try_divide(F.lit(1.0), nt) + F.try_divide(F.lit(1.0), nc)))
    return (m.withColumn("sd_t", F.sqrt("var_t")).withColumn("sd_c", F.sqrt("var_c"))
            .withColumn("diff", F.col("mean_t") - F.col("mean_c"))
            .withColumn("lift_pct", lift_pct("mean_t", "mean_c"))
            .withColumn("t_stat", F.try_divide(F.col("diff"), F.nullif(se, F.lit(0.0))))
            .withColumn("df", dof.cast("long")))


def add_t_pvalue(df: DataFrame, stat: str = "t_stat", dof: str = "df",
                 out: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Two-sided p-value and significance flag (pandas UDF on a small table)."""
    return (df.withColumn(out, F.when(F.col(stat).isNotNull(),
                                      D.t_pvalue(F.col(stat), F.col(dof).cast("double"))))
            .withColumn("significant", F.coalesce(F.col(out) < alpha, F.lit(False))))


def two_sample_t(df: DataFrame, arm: str, metrics: Sequence[str], by: Sequence[str] = (),
                 min_n: int | None = None, with_p: bool = True) -> DataFrame:
    """E-1 / E-3: treated-vs-control t test for every metric in every segment.

    ``min_n`` keeps segments with at least that many rows in both arms
    (count matrix + minimum size filter, A-11); a missing arm counts as 0."""
    m = pooled_t(arm_moments(df, arm, metrics, by))
    if min_n is not None:
        m = m.where((F.col("n_t") >= min_n) & (F.col("n_c") >= min_n))
    return add_t_pvalue(m) if with_p else m


def lift_vs_common_control(df: DataFrame, arm: str, type_col: str, metrics: Sequence[str],
                           min_n: int = 5, require_positive_control: bool = True,
                           with_p: bool = True) -> DataFrame:
    """E-4 / E-9 shape: each treatment type against the pooled control arm.

    Types come from treated rows with a real (non-null) type only. Control
    moments are one row per metric and are joined to every type row (a
    metric-keyed join of a table whose size is the number of metrics)."""
    treated = df.where((F.col(arm) == 1) & F.col(type_col).isNotNull())
    t_mom = arm_moments(treated.withColumn("__one", F.lit(1)), "__one", metrics, [type_col])
    t_mom = t_mom.select(type_col, "metric", "n_t", "mean_t", "var_t")
    c_rows = df.where(F.col(arm) == 0).withColumn("__zero", F.lit(1))
    c_mom = (arm_moments(c_rows, "__zero", metrics)
             .select("metric", F.col("n_t").alias("n_c"), F.col("mean_t").alias("mean_c"),
                     F.col("var_t").alias("var_c")))
    j = t_mom.join(F.broadcast(c_mom), "metric", "inner").where(F.col("n_t") >= min_n)
    if require_positive_control:
        j = j.where(F.col("mean_c") > 0)
    r = pooled_t(j)
    return add_t_pvalue(r) if with_p else r


def one_sample_t(df: DataFrame, value: str, by: Sequence[str] = (), mu: float = 0.0,
                 with_p: bool = True) -> DataFrame:
    """E-2: one-sample t test of the mean against ``mu``."""
    v = _c(value).cast("double")
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    g = (g.withColumn("t_stat", F.try_divide(F.col("mean") - F.lit(mu), F.nullif(se, F.lit(0.0))))
         .withColumn("df", (F.col("n") - 1).cast("long")))
    return add_t_pvalue(g) if with_p else g


def cohens_d(m: DataFrame) -> DataFrame:
    """E-17: standardised difference with pooled SD, and its size label."""
    nt, nc = F.col("n_t"), F.col("n_c")
    pooled = F.sqrt(F.try_divide(
        (nt - 1) * F.coalesce(F.col("var_t"), F.lit(0.0)) + (nc - 1) * F.coalesce(F.col("var_c"), F.lit(0.0)),
        F.nullif(nt + nc - 2, F.lit(0)).cast("double")))
    d = F.try_divide(F.col("mean_t") - F.col("mean_c"), F.nullif(pooled, F.lit(0.0)))
    a = F.abs(d)
    label = (F.when(d.isNull(), None).when(a < 0.2, "negligible").when(a < 0.5, "small")
             .when(a < 0.8, "medium").otherwise("large"))
    return m.withColumn("cohens_d", d).withColumn("effect_label", label)


def required_n(effect: Column | str, alpha_z: float = Z_975, power_z: float = Z_80) -> Column:
    """E-20: n per group for a two-sample test, ceil(2((z_a + z_b)/d)^2)."""
    d = F.abs(_c(effect))
    return F.ceil(F.try_divide(F.lit(2.0 * (alpha_z + power_z) ** 2), F.nullif(d * d, F.lit(0.0))))


def add_power(m: DataFrame, effect: str = "cohens_d", alpha_z: float = Z_975) -> DataFrame:
    """E-19: power of a two-sided two-sample test (normal approximation)
    for the observed sizes and effect, as a column on any effect table."""
    nt, nc = F.col("n_t").cast("double"), F.col("n_c").cast("double")
    ncp = F.abs(F.col(effect)) * F.sqrt(F.try_divide(nt * nc, nt + nc))
    return (m.withColumn("power", D.norm_cdf(ncp - F.lit(alpha_z)) + D.norm_cdf(-ncp - F.lit(alpha_z)))
            .withColumn("required_n", required_n(effect, alpha_z)))
