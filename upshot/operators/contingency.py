"""Contingency-table tests (E-6, M-6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def chi2_2x2(a, b, c, d) -> Column:
    """Chi-square statistic of [[a, b], [c, d]] with the continuity
    correction used at one degree of freedom: each |O - E| is reduced by
    min(0.5, |O - E|). Null when any margin is zero (no test possible)."""
    a, b, c, d = (_c(x).cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    r1, r2, c1, c2 = a + b, c + d, a + c, b + d
    ea = r1 * c1 / n
    adj = F.greatest(F.abs(a - ea) - 0.5, F.lit(0.0))
    inv = 1.0 / (r1 * c1 / n) + 1.0 / (r1 * c2 / n) + 1.0 / (r2 * c1 / n) + 1.0 / (r2 * c2 / n)
    ok = (r1 > 0) & (r2 > 0) & (c1 > 0) & (c2 > 0)
    return F.when(ok, adj * adj * inv)


def with_chi2_p(df: DataFrame, stat: str = "chi2", dof: int | str = 1,
                out: str = "p_value") -> DataFrame:
    k = F.lit(float(dof)) if isinstance(dof, int) else F.col(dof).cast("double")
    return df.withColumn(out, F.when(F.col(stat).isNotNull(), D.chi2_pvalue(F.col(stat), k)))


def chi2_independence(df: DataFrame, row: str, col: str, by: Sequence[str] = (),
                      with_p: bool = True) -> DataFrame:
    """M-6: r x c chi-square test of independence per group.

    Uses sum over non-empty cells of O^2 / E - N, so empty cells never need
    to be materialised; with one degree of freedom the 2 x 2 continuity
    correction applies (cells ordered by the smallest row / column label)."""
    by = list(by)
    single = not by
    if single:
        df = df.withColumn("__g", F.lit(0))
        by = ["__g"]
    cells = df.groupBy(*by, row, col).count()
    wr, wc, wg = Window.partitionBy(*by, row), Window.partitionBy(*by, col), Window.partitionBy(*by)
    cells = (cells.withColumn("__r", F.sum("count").over(wr))
             .withColumn("__c", F.sum("count").over(wc))
             .withColumn("__is_r", F.col(row) == F.min(row).over(wg))
             .withColumn("__is_c", F.col(col) == F.min(col).over(wg)))
    cnt = F.col("count")
    g = cells.groupBy(*by).agg(
        F.sum(cnt).alias("n"),
        F.sum(cnt.cast("double") ** 2 / (F.col("__r") * F.col("__c"))).alias("__s"),
        F.countDistinct(row).alias("n_rows"), F.countDistinct(col).alias("n_cols"),
        F.sum(F.when(F.col("__is_r") & F.col("__is_c"), cnt).otherwise(0)).alias("__a"),
        F.sum(F.when(F.col("__is_r") & ~F.col("__is_c"), cnt).otherwise(0)).alias("__b"),
        F.sum(F.when(~F.col("__is_r") & F.col("__is_c"), cnt).otherwise(0)).alias("__cc"),
        F.sum(F.when(~F.col("__is_r") & ~F.col("__is_c"), cnt).otherwise(0)).alias("__d"))
    dof = ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).cast("long")
    g = (g.withColumn("dof", dof)
         .withColumn("chi2", F.when(F.col("dof") == 1, chi2_2x2("__a", "__b", "__cc", "__d"))
                     .when(F.col("dof") > 1, F.col("n") * F.col("__s") - F.col("n")))
         .drop("__s", "__a", "__b", "__cc", "__d"))
    if with_p:
        g = g.withColumn("p_value", F.when(F.col("chi2").isNotNull(),
                                           D.chi2_pvalue(F.col("chi2"), F.col("dof").cast("double"))))
    return g.drop("__g") if single else g
