"""Persisted tables, staging views, flags, sketches and sparse features as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as P
from ..functions.columns import uniform_sql
from ..operators import cohort as C
from ..operators import match as M
from ..operators import opportunity as O
from ..operators import sparse as S
from ..session import checkpoint_dir, cut_lineage
from ..sources.files import replace_table
from ..sources.tables import register_views
from .domain import with_domain
from .lift_queries import CATS, NUM, XS_SQL, customer_xs
from .opportunity_queries import analysis, q
from .registry import register

SEED = 42
BUCKETS = 16


@register("s6_bucketed_analysis",
          sql=q("", "SELECT account_id, count(*) AS rows, count(opp_id) AS lines, count(DISTINCT opp_id) AS opportunities FROM analysis GROUP BY account_id"))
def q_bucketed(spark, d):
    """S-6: the analysis table written once, bucketed by account and replaced at one stroke, and a per-account summary that reads
    it without a shuffle."""
    name = "upshot_analysis_" + uuid.uuid5(uuid.NAMESPACE_URL, d).hex
    replace_table(analysis(spark, d), name, "account_id", BUCKETS, checkpoint_dir(spark))
    return spark.table(name).groupBy("account_id").agg(F.count(F.lit(1)).alias("rows"), F.count("opp_id").alias("lines"),
                                                       F.size(F.collect_set("opp_id")).cast("long").alias("opportunities"))


_STAGED = """SELECT n.n_name AS organization, c.c_mktsegment AS segment, count(*) AS orders, count(DISTINCT o.o_custkey) AS accounts
FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey
WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY n.n_name, c.c_mktsegment"""
_STAGES = ("customer", "orders", "nation")


@register("s7_staging_views", sql=_STAGED.format(**{t: t for t in _STAGES}))
def q_staged(spark, d):
    """S-7: source tables as staging views, read by plain SQL."""
    register_views(spark, d, _STAGES, prefix="stage_")
    return spark.sql(_STAGED.format(**{t: f"stage_{t}" for t in _STAGES}))


TOP = 200


@register("d7_ordered_limit",
          sql=q("", f"SELECT DISTINCT account_id, group_type, opp_id, product_name FROM analysis ORDER BY account_id, opp_id NULLS FIRST, product_name NULLS FIRST, group_type LIMIT {TOP}"))
def q_ordered_limit(spark, d):
    """D-7: the first rows of the group extract in a total order."""
    rows = C.group_extract(analysis(spark, d), ["Treatment", "Control"], ["account_id", "group_type", "opp_id", "product_name"])
    return C.ordered_limit(rows, ["account_id", "opp_id", "product_name", "group_type"], TOP)


STAGES, WORDS, ARR = ("1-URGENT", "3-MEDIUM"), ("ECON", "ARD"), (50_000.0, 200_000.0)


@register("p3_p11_flags",
          sql=q("", "SELECT opp_id, line_no, activity_id, CAST(group_type = 'Treatment' AS INTEGER) AS treated, is_won AS won, "
                    f"coalesce(CAST(stage_name IN {STAGES!r} AS INTEGER), 0) AS in_stage, CAST(coalesce(product_name LIKE '%ECON%' OR product_name LIKE '%ARD%', FALSE) AS INTEGER) AS in_family, "
                    f"opp_arr > {ARR[0]} AND opp_arr < {ARR[1]} AS in_bounds, CAST(engagement_type IS NOT NULL AS INTEGER) AS engaged FROM analysis"))
def q_flags(spark, d):
    """P-3/P-4/P-5/P-7/P-8/P-11: flags of the analysis rows from text, presence, label, list, bounds and substrings."""
    t = analysis(spark, d)
    text = F.when(F.col("is_won"), "t").when(~F.col("is_won"), "f")
    return t.select("opp_id", "line_no", "activity_id", P.flag_from_label("group_type").alias("treated"), P.to_flag(text).alias("won"),
                    P.in_list("stage_name", STAGES).alias("in_stage"), P.contains_any("product_name", WORDS).alias("in_family"),
                    P.in_range("opp_arr", *ARR).alias("in_bounds"), P.flag_from_date("engagement_type").alias("engaged"))


_DIMS = ("group_type", "segment", "region")
_SETS = (("group_type",), ("group_type", "segment"), ("region",), ())
WITHIN = 0.05  # three standard errors of the sketches


@register("a4_distinct_sketches",
          sql=q("", "SELECT group_type, segment, region, count(DISTINCT account_id) AS accounts, count(DISTINCT opp_id) AS opportunities, TRUE AS close "
                    "FROM analysis GROUP BY GROUPING SETS (" + ", ".join("(" + ", ".join(s) + ")" for s in _SETS) + ")"))
def q_sketches(spark, d):
    """A-4/A-17: distinct accounts and opportunities of several roll-ups from sketches kept per finest cell, next to the exact
    counts; ``close`` tells that every estimate lies within three standard errors."""
    t = analysis(spark, d)
    kept = cut_lineage(O.distinct_sketches(t, _DIMS, ["account_id", "opp_id"]))
    near = O.merged_distinct(kept, _SETS, _DIMS, ["account_id", "opp_id"])
    exact = t.groupingSets([list(s) for s in _SETS], *_DIMS).agg(F.countDistinct("account_id").alias("accounts"), F.countDistinct("opp_id").alias("opportunities"))
    names = near.select(*[F.col(c).alias(f"__{c}") for c in _DIMS], "approx_account_id", "approx_opp_id")
    j = exact.join(names, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _DIMS])
    close = (F.abs(F.col("approx_account_id") - F.col("accounts")) <= F.col("accounts") * WITHIN + 1) & (
        F.abs(F.col("approx_opp_id") - F.col("opportunities")) <= F.col("opportunities") * WITHIN + 1)
    return j.select(*_DIMS, "accounts", "opportunities", close.alias("close"))


_KEY = ["account_id", "group_type"]


@register("a8_product_quantiles",
          sql=q("ak AS (SELECT DISTINCT account_id, group_type FROM analysis),\n"
                "pn AS (SELECT DISTINCT product_name FROM analysis WHERE product_name IS NOT NULL),\n"
                "am AS (SELECT account_id, group_type, product_name, sum(CAST(total_price AS DOUBLE)) AS v FROM analysis WHERE product_name IS NOT NULL GROUP BY ALL),\n"
                "fl AS (SELECT pn.product_name, coalesce(am.v, 0.0) AS v FROM ak CROSS JOIN pn LEFT JOIN am "
                "ON am.account_id = ak.account_id AND am.group_type = ak.group_type AND am.product_name = pn.product_name)",
                "SELECT product_name, CAST(row_number() OVER (ORDER BY product_name) - 1 AS INTEGER) AS index, count(*) AS n, quantile_cont(v, 0.25) AS q1, "
                "quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, count(*) FILTER (WHERE v <> 0) AS present FROM fl GROUP BY product_name"),
          doubles={"q1": 2, "median": 2, "q3": 2})
def q_product_quantiles(spark, d):
    """A-8/K-1/K-3 in sparse form: products numbered from the data, quartiles of the amount per product over all accounts, those without it as zeros."""
    t = analysis(spark, d)
    long = cut_lineage(S.product_amounts(t, _KEY, amount=F.col("total_price")))
    rows = t.select(*_KEY).distinct().count()
    stats = S.sparse_quantiles(long, rows, (0.25, 0.5, 0.75))
    present = long.groupBy("product_name").agg(F.count(F.lit(1)).alias("present"))
    return (stats.join(S.product_index(long), "product_name").join(present, "product_name")
            .select("product_name", "index", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "present"))


@register("m7_boosted_scores", doubles={"gbt_score": 6})
def q_boosted(spark, d):
    """M-7: out-of-fold boosted-tree propensity (100 trees of depth 3, five folds) of every customer."""
    return M.cross_fitted_scores(customer_xs(spark, d), "account_id", "treated", NUM, CATS)


@register("m7_auc_by_fold",
          sql=with_domain(XS_SQL + f",\nf AS (SELECT CAST(floor({uniform_sql(SEED, 'account_id')} * 5) AS INTEGER) AS fold, treated, round(adoption_score, 6) AS s FROM xs),\n"
                          "rk AS (SELECT fold, treated, rank() OVER (PARTITION BY fold ORDER BY s) + (count(*) OVER (PARTITION BY fold, s) - 1) / 2.0 AS r FROM f),\n"
                          "g AS (SELECT fold, count(*) FILTER (WHERE treated = 1) AS n_t, count(*) FILTER (WHERE treated = 0) AS n_c, sum(r) FILTER (WHERE treated = 1) AS rs FROM rk GROUP BY fold)",
                          "SELECT fold, n_t, n_c, (rs - n_t * (n_t + 1) / 2.0) / (CAST(n_t AS DOUBLE) * n_c) AS auc FROM g"),
          doubles={"auc": 6})
def q_auc(spark, d):
    """M-7/W-4: AUC of a score for the treatment in each md5 fold, from one ranked histogram (the adoption score, which SQL can rank too)."""
    xs = customer_xs(spark, d).withColumn("fold", F.floor(P.uniform(SEED, "account_id") * 5).cast("int"))
    return M.auc_by_group(xs.withColumn("s", F.round("adoption_score", 6)), "treated", "s", ["fold"])
