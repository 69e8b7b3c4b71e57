"""Cohorts, observation windows and the analysis-table builder
(C-3, C-4, C-5, C-8, C-10, J-3 .. J-6, D-1 .. D-7, S-4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (attribution_flag, default_text, either_flag, money,
                                 size_bucket, uniform)
from ..session import cut_lineage


# ---- cohorts ---------------------------------------------------------------------

def treatment_cohort(details: DataFrame, key: str = "account_id",
                     engagement: str = "engagement_id") -> DataFrame:
    """C-3: distinct accounts with at least one engagement."""
    return details.where(F.col(engagement).isNotNull()).select(key).distinct()


def control_cohort(details: DataFrame, flags: Sequence[str], key: str = "account_id",
                   engagement: str = "engagement_id") -> DataFrame:
    """C-3: distinct accounts without an engagement that meet every flag, and
    are not in the treatment cohort (anti join: an account with both kinds of
    rows belongs to treatment only)."""
    cond = F.col(engagement).isNull()
    for f in flags:
        cond = cond & F.coalesce(F.col(f).cast("boolean"), F.lit(False))
    ctl = details.where(cond).select(key).distinct()
    return ctl.join(treatment_cohort(details, key, engagement), key, "left_anti")


def labelled_cohorts(treatment: DataFrame, control: DataFrame, key: str = "account_id",
                     label: str = "group_type") -> DataFrame:
    """J-3: one row per account with its group; Treatment wins over Control."""
    t = treatment.select(key).withColumn("__p", F.lit(0))
    c = control.select(key).withColumn("__p", F.lit(1))
    u = t.unionByName(c)
    return (u.groupBy(key).agg(F.min("__p").alias("__p"))
            .select(key, F.when(F.col("__p") == 0, "Treatment").otherwise("Control").alias(label)))


def date_window(events: DataFrame, date_col: str, months_after: int = 6) -> tuple:
    """C-4: [min event date, max event date + months] as two scalars (one
    aggregation; the bounds become literals of the downstream filter)."""
    r = events.agg(F.min(date_col).alias("lo"),
                   F.add_months(F.max(date_col), months_after).alias("hi")).first()
    return r["lo"], r["hi"]


def in_window(col: str, lo, hi) -> Column:
    """J-4: inclusive window predicate on pre-computed bounds."""
    return (F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi))


def team_flag(team: DataFrame, users: DataFrame, roster: DataFrame, key: str = "opp_id") -> DataFrame:
    """J-6: opportunities with a live team member who is on the roster,
    flag = 1 (existence semi join instead of join-then-group)."""
    live = team.where(F.col("delete_flag") == "N").join(users, "user_id", "inner")
    on_roster = live.join(roster, "alias", "left_semi")
    return on_roster.select(key).distinct().withColumn("on_team_flag", F.lit(1))


# ---- deduplication ---------------------------------------------------------------------

def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """D-1 / D-2 / D-3: first row per key in a total order (ascending, nulls
    first). An aggregate (``min_by`` over the row) rather than a window, so a
    key holding a large share of the rows is reduced map-side instead of being
    sorted by one task."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    # nulls first, like an ascending sort: order on (value is not null, value)
    okey = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), okey).alias("__r"))
    return g.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, key: str, order: Sequence[str], mode: str = "first") -> DataFrame:
    """D-3: ``mode='first'`` keeps the first row per key (aggregate, see
    :func:`keep_first`), ``'all'`` keeps every row and adds the ordinal
    ``event_rank`` (a per-key window)."""
    if mode == "first":
        return keep_first(df, [key], order).withColumn("event_rank", F.lit(1))
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("event_rank", F.row_number().over(w))


def ordered_limit(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """D-7: deterministic LIMIT (an explicit order before the limit)."""
    return df.orderBy(*order).limit(n)


# ---- analysis table (C-5) ---------------------------------------------------------------

def opportunity_lines(opps: DataFrame, lines: DataFrame, cohorts: DataFrame,
                      lo, hi, key: str = "account_id") -> DataFrame:
    """All opportunity lines of cohort accounts created inside the window,
    labelled with the account's group (J-2, J-3, J-4)."""
    o = opps.where(in_window("created_date", lo, hi))
    ol = o.join(lines, "opp_id", "inner")
    return ol.join(cohorts, key, "inner")


def analysis_table(accounts: DataFrame, engagements: DataFrame, details: DataFrame,
                   opps: DataFrame, lines: DataFrame, account_revenue: DataFrame,
                   flags: Sequence[str], months_after: int = 6) -> DataFrame:
    """C-5: treated accounts x their engagements x security/resiliency
    opportunity lines, UNION ALL control accounts x their lines (D-5).

    The treated branch keeps the template's grain (one row per engagement and
    line), so money must be summed after :func:`keep_first` on the
    opportunity (the builder does not hide that fan-out).

    The details, the cohorts and the accounts' attributes are written once, some rows an account: every join
    here is by account, and a task would otherwise sort the tables behind each use of them at once."""
    details = cut_lineage(details)
    cohorts = cut_lineage(labelled_cohorts(treatment_cohort(details), control_cohort(details, flags)))
    treat, ctl = (cohorts.where(F.col("group_type") == g).select("account_id") for g in ("Treatment", "Control"))
    lo, hi = date_window(engagements, "engagement_date", months_after)
    ol = opportunity_lines(opps, lines, cohorts, lo, hi)
    sec_res = ol.where((F.col("is_security") == 1) | (F.col("is_resiliency") == 1))
    o_cols = ["opp_id", "created_date", "stage_name", "probability", "is_closed", "is_won",
              "opp_arr", "line_no", "functional_area", "product_name",
              money("line_price").alias("total_price"),
              (money("line_price") * (1 - money("discount"))).cast("decimal(18,2)").alias("service_arr"),
              "is_security", "is_resiliency"]
    acc = cut_lineage(accounts.join(account_revenue, "account_id", "left")
                      .select("account_id", "account_name", "segment", "phase",
                              size_bucket("account_revenue").alias("revenue_bucket"),
                              F.col("region").alias("industry"),
                              default_text("support_level", "Basic").alias("support_level"),
                              "region", "organization"))
    # treated branch: engagement rows of treated accounts (J-5: ON group_type)
    te = engagements.join(treat, "account_id", "inner")
    t_o = sec_res.where(F.col("group_type") == "Treatment").select("account_id", *o_cols)
    tb = (te.join(acc, "account_id", "left").join(t_o, "account_id", "left")
          .select(*_acc_cols(), F.lit("Treatment").alias("group_type"),
                  F.col("engagement_id").alias("activity_id"), "engagement_type",
                  "is_direct",
                  attribution_flag("is_attributed", "is_direct", "engagement_id").alias("is_attributed"),
                  *_opp_cols()))
    c_o = sec_res.where(F.col("group_type") == "Control").select("account_id", *o_cols)
    cb = (acc.join(ctl, "account_id", "inner").join(c_o, "account_id", "left")
          .select(*_acc_cols(), F.lit("Control").alias("group_type"),
                  F.lit(None).cast("long").alias("activity_id"),
                  F.lit(None).cast("string").alias("engagement_type"),
                  F.lit(0).alias("is_direct"), F.lit(0).alias("is_attributed"), *_opp_cols()))
    out = tb.unionByName(cb)
    return out.withColumn("is_sec_res", either_flag("is_security", "is_resiliency"))


def _acc_cols():
    return ["account_id", "account_name", "segment", "phase", "revenue_bucket", "industry",
            "support_level", "region", "organization"]


def _opp_cols():
    return ["opp_id", "created_date", "stage_name", "probability", "is_closed", "is_won",
            "opp_arr", "line_no", "functional_area", "product_name", "total_price",
            "service_arr", "is_security", "is_resiliency"]


def group_extract(table: DataFrame, groups: Sequence[str], cols: Sequence[str],
                  group_col: str = "group_type") -> DataFrame:
    """S-4 / D-6: distinct rows of the requested groups (the UNION of the
    per-group DISTINCT selects is one scan + filter + distinct)."""
    return table.where(F.col(group_col).isin(list(groups))).select(*cols).distinct()


# ---- sampling and assignment -------------------------------------------------------------

def _positions(df: DataFrame, key: str, strata: Sequence[str], seed, buckets: int) -> DataFrame:
    """Add ``__pos`` (1-based position in md5(seed|key) order within the
    stratum) and ``__n`` (stratum size) without sorting a stratum in one task:
    units are spread over hash buckets, bucket sizes give offsets, and ranks
    are taken inside (stratum, bucket) windows."""
    strata = list(strata)
    u = df.withColumn("__u", uniform(seed, key))
    u = u.withColumn("__b", F.floor(F.col("__u") * buckets).cast("int"))
    sizes = u.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    part = strata if strata else [F.lit(0)]
    w = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = (sizes.withColumn("__off", F.coalesce(F.sum("__bn").over(w), F.lit(0)))
            .withColumn("__n", F.sum("__bn").over(Window.partitionBy(*part))).drop("__bn"))
    wr = Window.partitionBy(*strata, "__b").orderBy("__u", key)
    j = u.join(F.broadcast(offs) if not strata else offs, strata + ["__b"], "inner")
    return j.withColumn("__pos", F.col("__off") + F.row_number().over(wr)).drop("__u", "__b", "__off")


def seeded_sample(df: DataFrame, key: str, k: int, seed=42, buckets: int = 1024) -> DataFrame:
    """C-8: k units without replacement, smallest md5(seed|key) first.

    Exact and distributed (see :func:`_positions`); the bucket-offset table
    has ``buckets`` rows and is broadcast."""
    return _positions(df, key, (), seed, buckets).where(F.col("__pos") <= k).drop("__pos", "__n")


def stratified_assignment(df: DataFrame, key: str, strata: Sequence[str],
                          p: float = 0.5, seed=42, out: str = "assigned",
                          buckets: int = 1024) -> DataFrame:
    """C-10: in each stratum the first floor(n * p) units in md5 order are
    assigned to treatment (1), the rest to control (0)."""
    pos = _positions(df, key, strata, seed, buckets)
    return (pos.withColumn(out, (F.col("__pos") <= F.floor(F.col("__n") * p)).cast("int"))
            .drop("__pos", "__n"))
