"""Opportunity-grain analyses on the analysis table
(A-3 .. A-12, E-7 .. E-11).

The analysis table repeats an opportunity once per engagement and product
line, so every money sum first reduces to one row per opportunity. Win rate is
won / closed among closed opportunities, 0 when none closed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import engagement_category, lift_pct, product_category
from .contingency import chi2_2x2
from .ranks import mann_whitney, mann_whitney_vs_pool

OPP_ATTRS = ("opp_id", "account_id", "group_type", "organization", "opp_arr",
             "is_closed", "is_won")


def money_sum(amount: Column | str) -> Column:
    """Sum of amounts in whole cents, added as decimals: exact whatever the order."""
    x = F.col(amount) if isinstance(amount, str) else amount
    return F.sum(x.cast("decimal(20,2)")).cast("double")


def win_rate(closed: Column, won: Column, cap: bool = True) -> Column:
    """A-6: won / closed, 0 when nothing closed; optionally capped at 1."""
    r = F.coalesce(F.try_divide(won.cast("double"), F.nullif(closed, F.lit(0)).cast("double")),
                   F.lit(0.0))
    return F.least(r, F.lit(1.0)) if cap else r


def opportunity_grain(table: DataFrame, cols: Sequence[str] = OPP_ATTRS) -> DataFrame:
    """D-1 for attributes that depend on the opportunity only: one row per
    opportunity (the first row and any row are the same row)."""
    return table.where(F.col("opp_id").isNotNull()).select(*cols).distinct()


def account_arr_metrics(table: DataFrame, account_cols: Sequence[str]) -> DataFrame:
    """A-3: per account ARR = sum over distinct opportunities, opportunity,
    won and closed counts, and win rate won / max(closed, 1)."""
    opp = (table.select(*account_cols, "opp_id", "opp_arr", "is_won", "is_closed")
           .distinct())
    g = opp.groupBy(*account_cols).agg(
        F.coalesce(money_sum("opp_arr"), F.lit(0.0)).alias("real_total_arr"),
        F.count("opp_id").alias("total_opportunities"),
        F.count_if(F.col("is_won")).alias("won_opportunities"),
        F.count_if(F.col("is_closed")).alias("closed_opportunities"))
    return g.withColumn("real_win_rate", F.col("won_opportunities").cast("double")
                        / F.greatest(F.col("closed_opportunities"), F.lit(1)))


def distinct_counts(table: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """A-4: distinct counts of several keys per group."""
    return table.groupBy(*by).agg(*[F.countDistinct(k).alias(f"n_{k}") for k in keys])


LG_K = 12  # of the sketches: relative standard error 1.04 / sqrt(2 ** LG_K), 1.6 %


def distinct_sketches(table: DataFrame, by: Sequence[str], keys: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """A-4 option: a mergeable sketch of each key's values per finest cell (``sketch_<key>``, binary). The table can be kept and
    merged over any roll-up later, without the rows."""
    return table.groupBy(*by).agg(*[F.hll_sketch_agg(k, F.lit(lg_k)).alias(f"sketch_{k}") for k in keys])


def merged_distinct(sketches: DataFrame, sets: Sequence[Sequence[str]], by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """A-17 over sketches: estimated distinct counts ``approx_<key>`` for each grouping set of ``by``; a dimension left out of a set is null."""
    return sketches.groupingSets([list(s) for s in sets], *by).agg(
        *[F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{k}")).alias(f"approx_{k}") for k in keys])


def type_kpis(table: DataFrame, region: str | None = None) -> DataFrame:
    """A-5: KPIs per engagement type over treated line rows: accounts,
    opportunities, total and mean line ARR, closed / won rows, win rate."""
    t = table.where((F.col("group_type") == "Treatment") & F.col("engagement_type").isNotNull()
                    & F.col("opp_id").isNotNull())
    if region is not None:
        t = t.where(F.col("region") == region)
    arr = F.col("service_arr").cast("double")
    closed = F.count_if(F.col("is_closed"))
    won = F.count_if(F.col("is_closed") & F.col("is_won"))
    return t.groupBy("engagement_type").agg(
        F.countDistinct("account_id").alias("accounts"),
        F.countDistinct("opp_id").alias("opportunities"),
        money_sum(arr).alias("total_arr"), F.avg(arr).alias("avg_arr_per_opp"),
        closed.alias("closed_opps"), won.alias("won_opps"),
        win_rate(closed, won).alias("win_rate"))


def product_matrix(table: DataFrame, key: Sequence[str], product: str,
                   products: Sequence[str]) -> DataFrame:
    """A-8: 0/1 presence of each product per key, from every line (not only
    the first line of an opportunity). ``products`` fixes the output columns
    (the reporting form); the long form is :func:`product_presence`."""
    long = product_presence(table, key, product)
    return (long.groupBy(*key).pivot(product, list(products)).agg(F.max("present"))
            .na.fill(0, subset=list(products)))


def product_presence(table: DataFrame, key: Sequence[str], product: str) -> DataFrame:
    """Long / sparse form of A-8: one row per (key, product) present."""
    return (table.where(F.col(product).isNotNull()).select(*key, product).distinct()
            .withColumn("present", F.lit(1)))


def family_flags(table: DataFrame, key: Sequence[str], families: dict[str, Column]) -> DataFrame:
    """A-9 / A-10: per key, OR of each family condition over its lines and the
    number of distinct products (diversity)."""
    aggs = [F.max(cond.cast("int")).alias(f"has_{name}") for name, cond in families.items()]
    aggs.append(F.countDistinct("product_name").alias("product_diversity"))
    return table.groupBy(*key).agg(*aggs)


def category_mode(df: DataFrame, by: Sequence[str], cat: str, out: str) -> DataFrame:
    """A-12: most frequent category per group, ties to the smallest value."""
    c = df.groupBy(*by, cat).count()
    return c.groupBy(*by).agg(F.min_by(cat, F.struct(-F.col("count"), F.col(cat))).alias(out))


def direct_vs_attributed(table: DataFrame, region: str | None = None) -> DataFrame:
    """E-7: Direct vs Attributed engagement rows: accounts, rows, won, win
    rate, ARR; chi-square on won vs not-won rows when every cell is filled
    and both totals are at least 5 (else null)."""
    t = table.where((F.col("group_type") == "Treatment") & F.col("opp_id").isNotNull()
                    & ((F.col("is_direct") == 1) | (F.col("is_attributed") == 1)))
    if region is not None:
        t = t.where(F.col("region") == region)
    t = t.withColumn("engagement_category", engagement_category("is_direct", "is_attributed"))
    arr = F.col("service_arr").cast("double")
    closed = F.count_if(F.col("is_closed"))
    won_closed = F.count_if(F.col("is_closed") & F.col("is_won"))
    g = t.groupBy("engagement_category").agg(
        F.countDistinct("account_id").alias("accounts"),
        F.count(F.lit(1)).alias("total_opportunities"),
        won_closed.alias("won_opportunities"),
        win_rate(closed, won_closed).alias("win_rate"),
        F.avg(arr).alias("avg_arr_per_opp"), money_sum(arr).alias("total_arr"),
        F.count_if(F.col("is_won")).alias("__wins"))
    # the chi-square uses four counts of a table with at most three rows: fetch them
    cnt = {r["engagement_category"]: (r["__wins"], r["total_opportunities"])
           for r in g.select("engagement_category", "__wins", "total_opportunities").collect()}
    dw, dt = cnt.get("Direct", (0, 0))
    aw, at = cnt.get("Attributed", (0, 0))
    ok = dw > 0 and dt > dw and aw > 0 and at > aw and dt >= 5 and at >= 5
    stat = (chi2_2x2(F.lit(dw), F.lit(dt - dw), F.lit(aw), F.lit(at - aw)) if ok
            else F.lit(None).cast("double"))
    from .contingency import with_chi2_p
    return (g.drop("__wins").withColumn("chi2", stat).transform(lambda d: with_chi2_p(d, "chi2", 1))
            .withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False))))


def segment_pipeline_lift(table: DataFrame, segment: str, min_opps: int = 5,
                          lo: float = 0.0, hi: float = 5.0e7, with_p: bool = True) -> DataFrame:
    """E-8: per segment, treated vs control opportunities (deduplicated,
    0 < ARR < 50M, more than ``min_opps`` in each arm): ARR per account and its
    lift, win rates and their lift, Mann-Whitney on opportunity ARR and
    chi-square on closed won / lost."""
    opp = (table.where(F.col("opp_id").isNotNull() & (F.col("opp_arr") > lo) & (F.col("opp_arr") < hi)
                       & F.col(segment).isNotNull())
           .select(segment, "opp_id", "account_id", "group_type", "opp_arr", "is_closed", "is_won")
           .distinct().withColumn("__t", (F.col("group_type") == "Treatment").cast("int")))
    return _arm_compare(opp, [segment], min_opps, with_p)


def _arm_compare(opp: DataFrame, by: Sequence[str], min_opps: int, with_p: bool) -> DataFrame:
    t, c = F.col("__t") == 1, F.col("__t") == 0
    g = opp.groupBy(*by).agg(
        F.count_if(t).alias("treatment_opps"), F.count_if(c).alias("control_opps"),
        money_sum(F.when(t, F.col("opp_arr"))).alias("treatment_arr"),
        money_sum(F.when(c, F.col("opp_arr"))).alias("control_arr"),
        F.countDistinct(F.when(t, F.col("account_id"))).alias("treatment_accounts"),
        F.countDistinct(F.when(c, F.col("account_id"))).alias("control_accounts"),
        F.count_if(t & F.col("is_closed")).alias("t_closed"),
        F.count_if(t & F.col("is_closed") & F.col("is_won")).alias("t_won"),
        F.count_if(c & F.col("is_closed")).alias("c_closed"),
        F.count_if(c & F.col("is_closed") & F.col("is_won")).alias("c_won"))
    g = g.where((F.col("treatment_opps") > min_opps) & (F.col("control_opps") > min_opps))
    t_apa = F.col("treatment_arr") / F.col("treatment_accounts")
    c_apa = F.try_divide(F.col("control_arr"), F.nullif(F.col("control_accounts"), F.lit(0)))
    g = (g.withColumn("arr_lift_pct", F.when((F.col("control_accounts") > 0) & (F.col("control_arr") > 0),
                                            (t_apa - c_apa) / c_apa * 100.0).otherwise(0.0))
         .withColumn("treatment_win_rate", win_rate(F.col("t_closed"), F.col("t_won"), cap=False))
         .withColumn("control_win_rate", win_rate(F.col("c_closed"), F.col("c_won"), cap=False))
         .withColumn("win_rate_lift_pct", lift_pct("treatment_win_rate", "control_win_rate"))
         .withColumn("win_rate_chi2", F.when((F.col("t_closed") > 0) & (F.col("c_closed") > 0),
                                             chi2_2x2("t_won", F.col("t_closed") - F.col("t_won"),
                                                      "c_won", F.col("c_closed") - F.col("c_won")))))
    mw = mann_whitney(opp.join(g.select(*by), list(by), "left_semi"), "__t", "opp_arr", by,
                      with_p=with_p)
    keep = [*by, "u_stat", "z"] + (["p_value"] if with_p else [])
    out = g.join(mw.select(*keep), list(by), "left")
    if with_p:
        from .contingency import with_chi2_p
        out = (out.withColumnRenamed("p_value", "arr_p_value")
               .transform(lambda d: with_chi2_p(d, "win_rate_chi2", 1, "win_rate_p_value"))
               .withColumn("win_rate_p_value", F.when(F.col("win_rate_chi2").isNull()
                                                      & ((F.col("t_closed") == 0) | (F.col("c_closed") == 0)),
                                                      F.lit(1.0)).otherwise(F.col("win_rate_p_value")))
               .transform(_flags))
    return out


def _flags(d: DataFrame) -> DataFrame:
    return d.withColumns({f"{k}_significant": F.coalesce(F.col(f"{k}_p_value") < 0.05, F.lit(False)) for k in ("arr", "win_rate")})


def type_pipeline_lift(table: DataFrame, min_opps: int = 5, lo: float = 0.0, hi: float = 5.0e7,
                       with_p: bool = True) -> DataFrame:
    """E-9: each engagement type's treated opportunities (deduplicated per
    type, more than ``min_opps``) against the pooled control opportunities:
    ARR per account and lift, win rates and lift, Mann-Whitney on ARR and
    chi-square on closed won / lost. Control figures are one aggregation
    (scalars); control rows are never repeated per type."""
    base = table.where(F.col("opp_id").isNotNull() & (F.col("opp_arr") > lo) & (F.col("opp_arr") < hi))
    cols = ["opp_id", "account_id", "opp_arr", "is_closed", "is_won"]
    treated = (base.where((F.col("group_type") == "Treatment") & F.col("engagement_type").isNotNull())
               .select("engagement_type", *cols).distinct())
    control = base.where(F.col("group_type") == "Control").select(*cols).distinct()
    c = control.agg(F.count(F.lit(1)).alias("opps"), money_sum("opp_arr").alias("arr"),
                    F.countDistinct("account_id").alias("accounts"),
                    F.count_if(F.col("is_closed")).alias("closed"),
                    F.count_if(F.col("is_closed") & F.col("is_won")).alias("won")).first()
    c_apa = (c["arr"] / c["accounts"]) if c["accounts"] else 0.0
    c_wr = (c["won"] / c["closed"]) if c["closed"] else 0.0
    g = treated.groupBy("engagement_type").agg(
        F.countDistinct("account_id").alias("accounts"),
        F.count(F.lit(1)).alias("opportunities"),
        money_sum("opp_arr").alias("__arr"),
        F.count_if(F.col("is_closed")).alias("t_closed"),
        F.count_if(F.col("is_closed") & F.col("is_won")).alias("t_won"))
    g = g.where(F.col("opportunities") > min_opps)
    apa = F.col("__arr") / F.col("accounts")
    g = (g.withColumn("arr_per_account", apa)
         .withColumn("control_arr_per_account", F.lit(float(c_apa)))
         .withColumn("arr_lift_pct", lift_pct(apa, F.lit(float(c_apa))) if c_apa > 0 else F.lit(0.0))
         .withColumn("win_rate", win_rate(F.col("t_closed"), F.col("t_won"), cap=False))
         .withColumn("control_win_rate", F.lit(float(c_wr)))
         .withColumn("win_rate_lift_pct", lift_pct("win_rate", F.lit(float(c_wr))) if c_wr > 0 else F.lit(0.0))
         .withColumn("win_rate_chi2", F.when((F.col("t_closed") > 0) & F.lit(c["closed"] > 0),
                                             chi2_2x2("t_won", F.col("t_closed") - F.col("t_won"),
                                                      F.lit(c["won"]), F.lit(c["closed"] - c["won"]))))
         .drop("__arr"))
    mw = mann_whitney_vs_pool(treated.join(g.select("engagement_type"), "engagement_type", "left_semi"),
                              control, "opp_arr", ["engagement_type"], with_p=with_p)
    keep = ["engagement_type", "u_stat", "z"] + (["p_value"] if with_p else [])
    out = g.join(mw.select(*keep), "engagement_type", "left")
    if with_p:
        from .contingency import with_chi2_p
        out = (out.withColumnRenamed("p_value", "arr_p_value")
               .transform(lambda d: with_chi2_p(d, "win_rate_chi2", 1, "win_rate_p_value"))
               .withColumn("win_rate_p_value", F.coalesce("win_rate_p_value", F.lit(1.0))).transform(_flags))
    return out


def effectiveness(table: DataFrame, region: str | None = None) -> DataFrame:
    """E-11: per engagement type, and per type x product category
    (Security / Resiliency), rows, win rate, mean and total line ARR, in one
    grouping-sets pass. ``level`` is 'type' or 'type_category'."""
    t = table.where((F.col("group_type") == "Treatment") & F.col("opp_id").isNotNull()
                    & F.col("engagement_type").isNotNull())
    if region is not None:
        t = t.where(F.col("region") == region)
    t = t.withColumn("product_category", product_category("is_security", "is_resiliency"))
    arr = F.col("service_arr").cast("double")
    closed = F.count_if(F.col("is_closed"))
    won = F.count_if(F.col("is_closed") & F.col("is_won"))
    g = (t.groupingSets([["engagement_type"], ["engagement_type", "product_category"]],
                        "engagement_type", "product_category")
         .agg(F.countDistinct("account_id").alias("accounts"),
              F.count(F.lit(1)).alias("opportunities"), closed.alias("closed_opps"),
              win_rate(closed, won).alias("win_rate"), F.avg(arr).alias("avg_arr"),
              money_sum(arr).alias("total_arr"), F.grouping_id().alias("__gid")))
    g = g.withColumn("level", F.when(F.col("__gid") == 0, "type_category").otherwise("type")).drop("__gid")
    return g.where((F.col("level") == "type") | F.col("product_category").isin("Security", "Resiliency"))
