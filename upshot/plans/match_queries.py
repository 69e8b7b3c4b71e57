"""Matching, resampling, effect-size, placebo and roll-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import in_range, stars, uniform_sql
from ..operators import cohort as C
from ..operators import did as DD
from ..operators import match as M
from ..operators import opportunity as O
from ..operators import resample as B
from ..operators.contingency import chi2_independence
from ..operators.effects import (Z_80, Z_975, add_power, add_t_pvalue, arm_moments, cohens_d, pooled_t,
                                 two_sample_t, unpivot_structs)
from ..operators.iv import iv_estimate
from ..operators.panel import cross_section
from ..operators.ranks import average_ranks, mann_whitney
from .domain import OUTCOMES, Domain, with_domain
from .lift_queries import CATS, METRICS, NUM, XS_SQL, clean_panel, customer_xs, panel_xs, prepared_panel, trimmed
from .opportunity_queries import analysis, q
from .registry import register
from ..session import cut_lineage
from .sqlgen import chi2_p_sql, moments_sql, pooled_t_cols, t_p_sql, with_p_sql, z_p_sql

PS_NUM = NUM
PS_CAT = CATS
CALIPER = 0.1
SEED = 42


def scored(xs):
    return M.propensity_scores(xs, "treated", PS_NUM, PS_CAT)


def scored_xs(spark, d, factor=2.5):
    return scored(customer_xs(spark, d, factor))


def matched(spark, d, caliper=CALIPER):
    xs = cut_lineage(scored_xs(spark, d))
    pairs = M.match_nearest(xs, "account_id", "treated", "propensity_score", caliper=caliper)
    return xs, pairs


@register("m1_propensity_scores", doubles={"propensity_score": 6})
def q_propensity(spark, d):
    """M-1: logistic propensity score per customer (dummies, population scaling, C = 1)."""
    return scored_xs(spark, d).select("account_id", "treated", "propensity_score")


@register("m2_caliper_matching", doubles={"distance": 6})
def q_matching(spark, d):
    """M-2/J-9/J-10: 1:1 nearest matching without replacement within an absolute caliper of 0.1."""
    return matched(spark, d)[1]


@register("m2_score_order_matching", doubles={"distance": 6})
def q_matching_in_order(spark, d):
    """M-2/J-10 in the order of the surveyed analysis: treated by ascending score, each with its nearest free control
    within an absolute caliper of 0.1."""
    xs = cut_lineage(scored_xs(spark, d).select("account_id", "treated", "propensity_score"))
    return M.match_nearest(xs, "account_id", "treated", "propensity_score", caliper=CALIPER, rule="score_order").drop("round")


SCORE_STEP = 25000.0
EXACT = ["segment", "region"]
EXACT_SQL = (XS_SQL + f""",
ex AS (SELECT *, floor(revenue / {SCORE_STEP}) AS score FROM xs),
rk AS (SELECT *, row_number() OVER (PARTITION BY segment, region, score, treated ORDER BY account_id) AS r FROM ex),
pr AS (SELECT t.segment, t.region, t.account_id AS treatment_id, c.account_id AS control_id FROM rk t JOIN rk c
       ON t.segment = c.segment AND t.region = c.region AND t.score = c.score AND t.r = c.r WHERE t.treated = 1 AND c.treated = 0),
mu AS (SELECT * FROM ex WHERE account_id IN (SELECT treatment_id FROM pr UNION ALL SELECT control_id FROM pr))""")


def exact_matched(spark, d):
    """Customers with a coarse score, and their pairs of equal score within segment and region."""
    xs = cut_lineage(customer_xs(spark, d).withColumn("score", F.floor(F.col("revenue") / SCORE_STEP).cast("double")))
    return xs, cut_lineage(M.match_nearest(xs, "account_id", "treated", "score", caliper=0.0, by=EXACT))


@register("m2_exact_matching", sql=with_domain(EXACT_SQL, "SELECT * FROM pr"))
def q_exact(spark, d):
    """M-2/J-10 within strata: customers of equal segment, region and coarse revenue, paired by rank of id."""
    return exact_matched(spark, d)[1].select(*EXACT, "treatment_id", "control_id")


@register("m4_exact_report",
          sql=with_domain(EXACT_SQL, "SELECT (SELECT count(*) FROM pr) AS matched, count(*) FILTER (WHERE treated = 1) AS treated_units, "
                          "(SELECT count(*) FROM pr) / nullif(count(*) FILTER (WHERE treated = 1), 0) AS match_rate, "
                          "0.0 AS mean_distance, 0.0 AS max_distance FROM ex"),
          doubles={"match_rate": 6, "mean_distance": 6, "max_distance": 6})
def q_exact_report(spark, d):
    """M-4: matched count, match rate and distances of the exact pairs."""
    xs, pairs = exact_matched(spark, d)
    return M.match_report(pairs, xs, "treated").drop("rounds")


@register("m5_exact_balance",
          sql=with_domain(EXACT_SQL + ",\nm AS (" + moments_sql("mu", "treated", ["revenue", "security_revenue", "adoption_score"]) + ")",
                          "SELECT metric, n_t, n_c, mean_t, mean_c, t_stat, p_value, p_value >= 0.05 AS balanced FROM ("
                          + with_p_sql(f"SELECT metric, n_t, n_c, mean_t, mean_c, {pooled_t_cols()} FROM m", t_p_sql()) + ") AS b"),
          doubles={"mean_t": 4, "mean_c": 4, "t_stat": 6, "p_value": 6})
def q_exact_balance(spark, d):
    """M-5/D-9: t test per covariate on the exactly matched sample."""
    xs, pairs = exact_matched(spark, d)
    r = two_sample_t(M.matched_units(pairs, xs, "account_id"), "treated", ["revenue", "security_revenue", "adoption_score"])
    return (r.withColumn("balanced", F.col("p_value") >= 0.05)
            .select("metric", "n_t", "n_c", "mean_t", "mean_c", "t_stat", "p_value", "balanced"))


def _balance_sql() -> str:
    body = EXACT_SQL + ",\ncv AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS covariate, CAST({c} AS VARCHAR) AS value, treated FROM mu" for c in ("phase", "support_level", "organization")) + "),\n" + (
        "cells AS (SELECT covariate, value, treated, count(*) AS o FROM cv GROUP BY covariate, value, treated),\n"
        "rs AS (SELECT covariate, value, sum(o) AS r FROM cells GROUP BY covariate, value),\n"
        "cs AS (SELECT covariate, treated, sum(o) AS c FROM cells GROUP BY covariate, treated),\n"
        "st AS (SELECT cells.covariate, CAST(sum(o) AS BIGINT) AS n, CAST((count(DISTINCT cells.value) - 1) * (count(DISTINCT cells.treated) - 1) AS BIGINT) AS dof, "
        "sum(o) * sum(CAST(o AS DOUBLE) * o / (r * c)) - sum(o) AS chi2 FROM cells JOIN rs ON rs.covariate = cells.covariate AND rs.value = cells.value "
        "JOIN cs ON cs.covariate = cells.covariate AND cs.treated = cells.treated GROUP BY cells.covariate)")
    return with_domain(body, f"SELECT covariate, n, dof, chi2, {chi2_p_sql()} AS p_value FROM st")


@register("m6_exact_balance", sql=_balance_sql(), doubles={"chi2": 6, "p_value": 6})
def q_exact_balance_cat(spark, d):
    """M-6: chi-square of other categorical covariates against the arm on the exactly matched sample."""
    xs, pairs = exact_matched(spark, d)
    m = M.matched_units(pairs, xs, "account_id")
    per = {c: F.struct(F.col(c).alias("value")) for c in ("phase", "support_level", "organization")}
    return chi2_independence(unpivot_structs(m, ["treated"], per, "covariate"), "value", "treated", ["covariate"]).select(
        "covariate", "n", "dof", "chi2", "p_value")


@register("r1_exact_results",
          sql=with_domain(EXACT_SQL + ",\nm AS (" + moments_sql("mu", "treated", METRICS) + ")",
                          "SELECT metric, 'Exact Matching' AS method, mean_t AS treatment_mean, mean_c AS control_mean, lift_pct AS effect_size_pct, p_value, "
                          "significant, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS stars, "
                          "n_t AS sample_size FROM ("
                          + with_p_sql(f"SELECT metric, n_t, n_c, mean_t, mean_c, {pooled_t_cols()} FROM m", t_p_sql()) + ") AS b"),
          doubles={"treatment_mean": 4, "control_mean": 4, "effect_size_pct": 6, "p_value": 6})
def q_exact_results(spark, d):
    """R-1/E-1/P-19: effect per outcome on the exactly matched sample, with p-value and stars."""
    xs, pairs = exact_matched(spark, d)
    return _result_rows(two_sample_t(M.matched_units(pairs, xs, "account_id"), "treated", METRICS), "Exact Matching")


def _result_rows(r, method: str):
    return r.select("metric", F.lit(method).alias("method"),
                    F.col("mean_t").alias("treatment_mean"), F.col("mean_c").alias("control_mean"),
                    F.col("lift_pct").alias("effect_size_pct"), "p_value", "significant",
                    stars("p_value").alias("stars"), F.col("n_t").alias("sample_size"))


@register("m4_match_report", doubles={"mean_distance": 6, "max_distance": 6, "match_rate": 6})
def q_match_report(spark, d):
    """M-4: matched count, match rate and distances."""
    xs, pairs = matched(spark, d)
    return M.match_report(pairs, xs, "treated")


@register("m5_balance_numeric", doubles={"mean_t": 4, "mean_c": 4, "t_stat": 6, "p_value": 6})
def q_balance(spark, d):
    """M-5/D-9: t test per covariate on the matched sample; balanced when p >= 0.05."""
    xs, pairs = matched(spark, d)
    m = M.matched_units(pairs, xs, "account_id")
    r = two_sample_t(m, "treated", ["revenue", "security_revenue", "propensity_score"])
    return (r.withColumn("balanced", F.col("p_value") >= 0.05)
            .select("metric", "n_t", "n_c", "mean_t", "mean_c", "t_stat", "p_value", "balanced"))


@register("m6_balance_categorical", doubles={"chi2": 6, "p_value": 6})
def q_balance_cat(spark, d):
    """M-6: chi-square of each categorical covariate against the arm on the matched sample."""
    xs, pairs = matched(spark, d)
    m = M.matched_units(pairs, xs, "account_id")
    per = {c: F.struct(F.col(c).alias("value")) for c in ("segment", "phase", "region")}
    long = unpivot_structs(m, ["treated"], per, "covariate")
    return chi2_independence(long, "value", "treated", ["covariate"]).select(
        "covariate", "n", "dof", "chi2", "p_value")


@register("r1_matched_results", doubles={"treatment_mean": 4, "control_mean": 4, "effect_size_pct": 6,
                                         "p_value": 6})
def q_matched_results(spark, d):
    """R-1/E-1/P-19: matched-sample effect per outcome with p-value and stars."""
    xs, pairs = matched(spark, d)
    m = M.matched_units(pairs, xs, "account_id")
    return _result_rows(two_sample_t(m, "treated", METRICS), "Propensity Score Matching")


@register("m8_matched_did", doubles={k: 4 for k in (
    "treat_pre", "treat_post", "control_pre", "control_post", "did_estimate", "standard_error")}
    | {"t_statistic": 6, "p_value": 6, "p_value_simplified": 6})
def q_matched_did(spark, d):
    """M-8/E-13: DiD on the panel rows of matched customers."""
    xs, pairs = matched(spark, d)
    rows = M.matched_rows(prepared_panel(spark, d), pairs, "account_id")
    r = DD.did(rows, "account_id", "period", "treated", METRICS)
    return r.select("outcome", "treat_pre", "treat_post", "control_pre", "control_post", "did_estimate",
                    "standard_error", "t_statistic", "p_value", "p_value_simplified")


def account_level(spark, d):
    t = analysis(spark, d)
    acc = O.account_arr_metrics(t, ["account_id", "group_type"])
    return acc.withColumn("treated", (F.col("group_type") == "Treatment").cast("int"))


ARR_BOUNDS = (0.0, 5.0e7)  # open, as surveyed


@register("e10_matched_arr", doubles={"treatment_mean": 2, "control_mean": 2, "difference": 2,
                                      "pct_difference": 6, "u_stat": 2, "z": 6, "p_value": 6})
def q_matched_arr(spark, d, bounds=ARR_BOUNDS):
    """E-10/M-3/P-8/E-5: accounts with an ARR inside ``bounds`` matched 1:1 on ARR / sd (no caliper),
    Mann-Whitney on matched ARR."""
    acc = account_level(spark, d).where(in_range("real_total_arr", *bounds))
    sd = acc.agg(F.stddev_samp("real_total_arr")).first()[0] or 1.0
    units = cut_lineage(acc.withColumn("score", F.col("real_total_arr") / F.lit(sd if sd > 0 else 1.0)))
    pairs = M.match_nearest(units, "account_id", "treated", "score", caliper=None)
    m = M.matched_units(pairs, units, "account_id")
    mw = mann_whitney(m, "treated", "real_total_arr")
    est = m.agg(F.avg(F.when(F.col("treated") == 1, F.col("real_total_arr"))).alias("treatment_mean"),
                F.avg(F.when(F.col("treated") == 0, F.col("real_total_arr"))).alias("control_mean"))
    n_pairs = pairs.count()
    # the rank test is one row: attach its values to the one-row estimate
    t = mw.first()
    out = est.select("*", F.lit(t["u_stat"]).cast("double").alias("u_stat"),
                     F.lit(t["z"]).cast("double").alias("z"), F.lit(t["p_value"]).cast("double").alias("p_value"),
                     F.lit(t["n_t"]).cast("long").alias("treatment_n"),
                     F.lit(t["n_c"]).cast("long").alias("control_n"))
    return (out.withColumn("difference", F.col("treatment_mean") - F.col("control_mean"))
            .withColumn("pct_difference", F.when(F.col("control_mean") != 0,
                                                 F.col("difference") / F.col("control_mean") * 100).otherwise(0.0))
            .withColumn("matched_pairs", F.lit(n_pairs).cast("long"))
            .withColumn("significant", F.col("p_value") < 0.05))


REPLICATES = 1000


def _replicates_sql(src: str, key: str, values: dict[str, str], keys: str) -> str:
    """CTE ``rep``: weighted means of each (keys, replicate), from a relation ``src``."""
    means = ", ".join(f"sum(w * {x}) FILTER (WHERE {x} IS NOT NULL) / nullif(sum(w) FILTER (WHERE {x} IS NOT NULL), 0) AS {name}"
                      for name, x in values.items())
    return (f"wr AS (SELECT *, CAST({B.weight_sql(SEED, key)} AS DOUBLE) AS w FROM (SELECT *, unnest(range({REPLICATES})) AS r FROM {src}) AS x),\n"
            f"rep AS (SELECT {keys}, r, {means} FROM wr GROUP BY {keys}, r)")


def _account_sql() -> str:
    return ("opp_acc AS (SELECT DISTINCT account_id, group_type, opp_id, opp_arr, is_won, is_closed FROM analysis),\n"
            "acc0 AS (SELECT account_id, CAST(group_type = 'Treatment' AS INTEGER) AS treated, CAST(coalesce(sum(opp_arr), 0.0) AS DOUBLE) AS arr, "
            "count(*) FILTER (WHERE is_won) / greatest(count(*) FILTER (WHERE is_closed), 1) AS win_rate FROM opp_acc GROUP BY account_id, group_type)")


def _ate_sql() -> str:
    body = _account_sql() + ",\n" + _replicates_sql("acc0", "account_id", {"arr": "arr", "win_rate": "win_rate"}, "treated")
    parts = []
    for m in ("arr", "win_rate"):
        parts.append(
            f"SELECT '{m}' AS measure, avg({m}) FILTER (WHERE treated = 1) AS mean_t, avg({m}) FILTER (WHERE treated = 0) AS mean_c, "
            "count(*) FILTER (WHERE treated = 1) AS n_t, count(*) FILTER (WHERE treated = 0) AS n_c, "
            f"(SELECT quantile_cont(t.{m} - c.{m}, [0.025, 0.975]) FROM rep t JOIN rep c ON t.r = c.r WHERE t.treated = 1 AND c.treated = 0) AS ci, "
            f"(SELECT count(t.{m} - c.{m}) FROM rep t JOIN rep c ON t.r = c.r WHERE t.treated = 1 AND c.treated = 0) AS replicates FROM acc0")
    union = " UNION ALL ".join(parts)
    return q(body, "SELECT measure, mean_t, mean_c, n_t, n_c, ci[1] AS ci_lower, ci[2] AS ci_upper, replicates, mean_t - mean_c AS estimate, "
                   "NOT (ci[1] <= 0 AND ci[2] >= 0) AS significant, CASE WHEN mean_c > 0 THEN (mean_t - mean_c) / mean_c * 100.0 ELSE 0.0 END AS pct_effect "
                   f"FROM ({union}) AS u")


@register("e12_ate_bootstrap", sql=_ate_sql(), doubles={"mean_t": 4, "mean_c": 4, "ci_lower": 4, "ci_upper": 4,
                                                        "estimate": 4, "pct_effect": 6})
def q_ate(spark, d):
    """E-12/B-1: average treatment effect on account ARR and win rate with 1000-replicate bootstrap CIs, one pass for both."""
    acc = account_level(spark, d).select("account_id", "treated", F.col("real_total_arr").cast("double").alias("arr"),
                                         F.col("real_win_rate").alias("win_rate"))
    return B.average_treatment_effect(cut_lineage(acc), ["arr", "win_rate"], "account_id", "treated", REPLICATES, SEED)


_CLOSED_SQL = ("closed AS (SELECT engagement_type, concat_ws('|', activity_id, opp_id, line_no) AS k, CAST(is_won AS INTEGER) AS won FROM analysis "
               "WHERE group_type = 'Treatment' AND opp_id IS NOT NULL AND engagement_type IS NOT NULL AND is_closed)")


@register("b2_win_rate_ci",
          sql=q(_CLOSED_SQL + ",\n" + _replicates_sql("closed", "k", {"rate": "won"}, "engagement_type") + ",\n"
                "ci AS (SELECT engagement_type, quantile_cont(rate, [0.025, 0.975]) AS ci FROM rep GROUP BY engagement_type),\n"
                "g AS (SELECT engagement_type, count(*) AS closed_opps, avg(won) AS win_rate FROM closed GROUP BY engagement_type)",
                "SELECT g.engagement_type, g.closed_opps, g.win_rate, CASE WHEN closed_opps > 10 THEN ci[1] ELSE win_rate END AS ci_lower, "
                "CASE WHEN closed_opps > 10 THEN ci[2] ELSE win_rate END AS ci_upper FROM g LEFT JOIN ci ON ci.engagement_type = g.engagement_type"),
          doubles={"win_rate": 6, "ci_lower": 6, "ci_upper": 6})
def q_win_rate_ci(spark, d):
    """B-2/E-11: bootstrap CI of the win rate per engagement type over closed rows (when more than 10)."""
    t = analysis(spark, d).where((F.col("group_type") == "Treatment") & F.col("opp_id").isNotNull()
                                 & F.col("engagement_type").isNotNull() & F.col("is_closed"))
    t = t.select("engagement_type", F.concat_ws("|", "activity_id", "opp_id", "line_no").alias("__key"), F.col("is_won").cast("double").alias("won"))
    g = t.groupBy("engagement_type").agg(F.count(F.lit(1)).alias("closed_opps"),
                                         F.avg("won").alias("win_rate"))
    ci = B.bootstrap_mean_ci(t, "won", "__key", ["engagement_type"], REPLICATES, SEED)
    j = g.join(ci, "engagement_type", "left")
    big = F.col("closed_opps") > 10
    return j.select("engagement_type", "closed_opps", "win_rate",
                    F.when(big, F.col("ci_lower")).otherwise(F.col("win_rate")).alias("ci_lower"),
                    F.when(big, F.col("ci_upper")).otherwise(F.col("win_rate")).alias("ci_upper"))


@register("b3_relative_effect_ci",
          sql=with_domain(XS_SQL + ",\n" + _replicates_sql("xs", "account_id", {"m": "revenue"}, "treated") + ",\n"
                          "s AS (SELECT (t.m - c.m) / nullif(c.m, 0) AS v FROM rep t JOIN rep c ON t.r = c.r WHERE t.treated = 1 AND c.treated = 0)",
                          "SELECT quantile_cont(v, 0.025) AS ci_lower, quantile_cont(v, 0.975) AS ci_upper, count(v) AS replicates FROM s"),
          doubles={"ci_lower": 6, "ci_upper": 6})
def q_relative_ci(spark, d):
    """B-3: bootstrap CI of the relative revenue effect (mt - mc) / mc on the customer cross-section."""
    xs = customer_xs(spark, d)
    return B.bootstrap_diff_ci(xs, "revenue", "account_id", "treated", (), REPLICATES, SEED, relative=True)


_ES_D = {"mean_t": 4, "mean_c": 4, "cohens_d": 6}


@register("e17_e20_effect_sizes",
          sql=with_domain(XS_SQL + ",\nm AS (" + moments_sql("xs", "treated", METRICS) + "),\n"
                          "es AS (SELECT metric, n_t, n_c, mean_t, mean_c, (mean_t - mean_c) / nullif(sqrt(((n_t - 1) * "
                          "coalesce(var_t, 0.0) + (n_c - 1) * coalesce(var_c, 0.0)) / nullif(n_t + n_c - 2, 0)), 0.0) AS cohens_d FROM m)",
                          "SELECT *, CASE WHEN cohens_d IS NULL THEN NULL WHEN abs(cohens_d) < 0.2 THEN 'negligible' "
                          "WHEN abs(cohens_d) < 0.5 THEN 'small' WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END "
                          f"AS effect_label, CAST(ceil(2.0 * pow({Z_975!r} + {Z_80!r}, 2) / nullif(cohens_d * cohens_d, 0.0)) "
                          "AS BIGINT) AS required_n FROM es"),
          doubles=_ES_D)
def q_effect_sizes(spark, d):
    """E-17/E-20: Cohen's d with its label and the n per group needed for 80 % power at alpha 0.05."""
    m = cohens_d(arm_moments(customer_xs(spark, d), "treated", METRICS))
    from ..operators.effects import required_n
    return m.select("metric", "n_t", "n_c", "mean_t", "mean_c", "cohens_d", "effect_label",
                    required_n("cohens_d").cast("long").alias("required_n"))


def _power_sql() -> str:
    def cdf(x: str) -> str:
        return f"(CASE WHEN {x} >= 0 THEN 1.0 - ({z_p_sql('(' + x + ')')}) / 2.0 ELSE ({z_p_sql('(' + x + ')')}) / 2.0 END)"

    body = (XS_SQL + ",\nm AS (" + moments_sql("xs", "treated", METRICS, ["organization"]) + "),\n"
            "es AS (SELECT organization, metric, n_t, n_c, (mean_t - mean_c) / nullif(sqrt(((n_t - 1) * coalesce(var_t, 0.0) + (n_c - 1) * coalesce(var_c, 0.0)) "
            "/ nullif(n_t + n_c - 2, 0)), 0.0) AS cohens_d FROM m),\n"
            "nc AS (SELECT *, abs(cohens_d) * sqrt(n_t * n_c / nullif(n_t + n_c, 0)) AS ncp FROM es)")
    return with_domain(body, "SELECT organization, metric, n_t, n_c, cohens_d, "
                       f"CASE WHEN ncp IS NULL THEN NULL ELSE {cdf(f'ncp - {Z_975!r}')} + {cdf(f'-ncp - {Z_975!r}')} END AS power, "
                       f"CAST(ceil(2.0 * pow({Z_975!r} + {Z_80!r}, 2) / nullif(cohens_d * cohens_d, 0.0)) AS BIGINT) AS required_n FROM nc")


@register("e19_power", sql=_power_sql(), doubles={"cohens_d": 6, "power": 6})
def q_power(spark, d):
    """E-19: power of the two-sample test at the observed sizes and effect, per metric and organization."""
    m = cohens_d(arm_moments(customer_xs(spark, d), "treated", METRICS, ["organization"]))
    return add_power(m).select("organization", "metric", "n_t", "n_c", "cohens_d", "power",
                               F.col("required_n").cast("long").alias("required_n"))


@register("c10_stratified_assignment",
          sql=with_domain("sa AS (SELECT account_id, segment, row_number() OVER (PARTITION BY segment ORDER BY "
                          f"{uniform_sql(SEED, 'account_id')}, account_id) AS pos, count(*) OVER (PARTITION BY segment) AS n "
                          "FROM accounts)",
                          "SELECT account_id, segment, CAST(pos <= floor(n * 0.5) AS INTEGER) AS assigned FROM sa"))
def q_stratified(spark, d):
    """C-10: stratified random assignment (floor(n p) per segment, md5 order)."""
    acc = Domain(spark, d).accounts().select("account_id", "segment")
    return C.stratified_assignment(acc, "account_id", ["segment"], 0.5, SEED)


PLACEBO_SHARE = 0.25  # of the units, drawn as placebo treated


def _placebo_sql() -> str:
    body = (XS_SQL.replace("xs AS (", "xs_unused AS (") + ",\n"
            "pm AS (SELECT quantile_cont(CAST(period AS TIMESTAMP), 0.5) AS m FROM clean),\n"
            "pre AS (SELECT c.* FROM clean c CROSS JOIN pm WHERE c.period < pm.m),\n"
            "pu AS (SELECT DISTINCT account_id FROM pre),\n"
            f"pk AS (SELECT CAST(floor((SELECT count(*) FROM pu) * {PLACEBO_SHARE}) AS BIGINT) AS k),\n"
            f"pick AS (SELECT account_id FROM (SELECT account_id, row_number() OVER (ORDER BY {uniform_sql(SEED, 'account_id')}, "
            "account_id) AS pos FROM pu) WHERE pos <= (SELECT k FROM pk)),\n"
            "pxs AS (SELECT account_id, CAST(account_id IN (SELECT account_id FROM pick) AS INTEGER) AS placebo, "
            "avg(revenue) AS revenue, avg(security_revenue) AS security_revenue FROM pre GROUP BY account_id),\n"
            "m AS (" + moments_sql("pxs", "placebo", ["revenue", "security_revenue"]) + ")")
    tested = with_p_sql(f"SELECT metric, n_t, n_c, mean_t, mean_c, {pooled_t_cols()} FROM m", t_p_sql(), flag=False)
    return with_domain(body, f"SELECT *, CASE WHEN p_value IS NULL THEN NULL WHEN p_value >= 0.05 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({tested}) AS v")


@register("c11_e22_placebo", sql=_placebo_sql(),
          doubles={"mean_t": 4, "mean_c": 4, "sd_t": 4, "sd_c": 4, "diff": 4, "lift_pct": 6, "t_stat": 6, "p_value": 6})
def q_placebo(spark, d):
    """C-11/E-22: placebo test on pre-median rows with a seeded share of the units as placebo
    treated; PASS if the difference isn't significant."""
    p = prepared_panel(spark, d)
    from ..operators.panel import median_time
    med = median_time(p, "period")
    pre = p.where(F.col("period").cast("timestamp") < F.lit(med))
    units = pre.select("account_id").distinct()
    k = int(units.count() * PLACEBO_SHARE)
    pick = C.seeded_sample(units, "account_id", k, SEED).withColumn("placebo", F.lit(1))
    xs = cross_section(pre, "account_id", ["revenue", "security_revenue"], [], "period")
    xs = xs.join(pick, "account_id", "left").withColumn("placebo", F.coalesce("placebo", F.lit(0)))
    r = add_t_pvalue(pooled_t(arm_moments(xs, "placebo", ["revenue", "security_revenue"])))
    verdict = F.when(F.col("p_value").isNotNull(), F.when(F.col("p_value") >= 0.05, "PASS").otherwise("FAIL"))
    return r.select("metric", "n_t", "n_c", "mean_t", "mean_c", "sd_t", "sd_c", "diff", "lift_pct",
                    "t_stat", "df", "p_value", verdict.alias("verdict"))


def _iv_sql(instrument: str, source: str, first: str, k: int) -> str:
    """2SLS of revenue on treated from a relation ``r`` (treated, revenue, z) with everything taken off its controls."""
    stats = ("st AS (SELECT count(*) AS n, covar_samp(z, y) / covar_samp(z, t) AS b, covar_samp(z, y) AS zy, covar_samp(z, t) AS zt, var_samp(z) AS zz, "
             "var_samp(y) AS yy, var_samp(t) AS tt, covar_samp(t, y) AS ty FROM r),\n"
             f"se AS (SELECT *, n - {k} AS df, sqrt((yy - 2 * b * ty + b * b * tt) * (n - 1) / (n - {k}) / (zt * zt / zz * (n - 1))) AS standard_error FROM st)")
    return with_domain(XS_SQL + ",\n" + source + ",\n" + stats,
                       with_p_sql(f"SELECT b AS iv_estimate, standard_error, b / standard_error AS t_stat, df, n, {first} FROM se", t_p_sql()))


@register("e21_instrumental_variable",
          sql=_iv_sql("adoption_score", "r AS (SELECT treated AS t, revenue AS y, adoption_score AS z FROM xs)",
                      "zy AS reduced_form, zt AS first_stage", 2),
          doubles={"iv_estimate": 3, "standard_error": 3, "t_stat": 6, "p_value": 6, "reduced_form": 4, "first_stage": 8})
def q_iv(spark, d):
    """E-21: instrumental-variable (Wald / 2SLS without controls) effect of treatment on revenue with its standard error,
    adoption score as the instrument."""
    return iv_estimate(customer_xs(spark, d), "adoption_score", "treated", "revenue")


@register("e21_iv_with_control",
          sql=_iv_sql("adoption_score",
                      "cf AS (SELECT covar_samp(adoption_score, security_count) / var_samp(security_count) AS bz, covar_samp(treated, security_count) / var_samp(security_count) AS bt, "
                      "covar_samp(revenue, security_count) / var_samp(security_count) AS yb FROM xs),\n"
                      "r AS (SELECT treated - bt * security_count AS t, revenue - yb * security_count AS y, adoption_score - bz * security_count AS z FROM xs CROSS JOIN cf)",
                      "zt / zz AS first_stage", 3),
          doubles={"iv_estimate": 3, "standard_error": 3, "t_stat": 6, "p_value": 6, "first_stage": 8})
def q_iv_control(spark, d):
    """E-21: two-stage least squares with a control (security products) and its standard error, adoption score as the instrument."""
    return iv_estimate(customer_xs(spark, d), "adoption_score", "treated", "revenue", ["security_count"])


COST_PER_ENGAGEMENT = 10000.0


@register("e24_reach_kpis",
          sql=with_domain(XS_SQL, "SELECT count(*) FILTER (WHERE treated = 1) AS engaged_units, count(*) AS units, "
                                  "count(*) FILTER (WHERE treated = 1) / count(*) AS engaged_share, "
                                  "(avg(revenue) FILTER (WHERE treated = 1) - avg(revenue) FILTER (WHERE treated = 0)) "
                                  "* 12 * count(*) FILTER (WHERE treated = 1) AS annual_impact, "
                                  "(avg(revenue) FILTER (WHERE treated = 1) - avg(revenue) FILTER (WHERE treated = 0)) "
                                  f"* 12 / {COST_PER_ENGAGEMENT!r} AS return_per_cost FROM xs"),
          doubles={"engaged_share": 6, "annual_impact": 2, "return_per_cost": 6})
def q_kpis(spark, d):
    """E-24: engaged share, annual revenue impact (monthly lift x 12 x engaged units), return per cost."""
    xs = customer_xs(spark, d)
    t, c = F.col("treated") == 1, F.col("treated") == 0
    g = xs.agg(F.count_if(t).alias("engaged_units"), F.count(F.lit(1)).alias("units"),
               (F.avg(F.when(t, F.col("revenue"))) - F.avg(F.when(c, F.col("revenue")))).alias("__lift"))
    return g.select("engaged_units", "units",
                    (F.col("engaged_units") / F.col("units")).alias("engaged_share"),
                    (F.col("__lift") * 12 * F.col("engaged_units")).alias("annual_impact"),
                    (F.col("__lift") * 12 / F.lit(COST_PER_ENGAGEMENT)).alias("return_per_cost"))


_DIMS = ("segment", "region", "organization", "phase")


def _rollup_sql() -> str:
    sets = ", ".join(f"({c})" for c in _DIMS) + ", ()"
    label = " ".join(f"WHEN GROUPING({c}) = 0 THEN '{c}'" for c in _DIMS)
    value = "coalesce(" + ", ".join(_DIMS) + ", 'ALL')"
    body = (XS_SQL + ",\nm AS (SELECT CASE " + label + " ELSE 'all' END AS dimension, " + value + " AS value, "
            "count(revenue) FILTER (WHERE treated = 1) AS n_t, avg(revenue) FILTER (WHERE treated = 1) AS mean_t, "
            "var_samp(revenue) FILTER (WHERE treated = 1) AS var_t, count(revenue) FILTER (WHERE treated = 0) AS n_c, "
            "avg(revenue) FILTER (WHERE treated = 0) AS mean_c, var_samp(revenue) FILTER (WHERE treated = 0) AS var_c "
            f"FROM xs GROUP BY GROUPING SETS ({sets}))")
    return with_domain(body, with_p_sql(f"SELECT dimension, value, n_t, n_c, mean_t, mean_c, {pooled_t_cols()} FROM m", t_p_sql()))


@register("a17_segment_rollup", sql=_rollup_sql(),
          doubles={"mean_t": 4, "mean_c": 4, "sd_t": 4, "sd_c": 4, "diff": 4, "lift_pct": 6, "t_stat": 6, "p_value": 6})
def q_rollup(spark, d):
    """A-17/E-3: revenue lift for every value of several dimensions and overall, one grouping-sets pass."""
    xs = customer_xs(spark, d)
    t, c = F.col("treated") == 1, F.col("treated") == 0
    v = F.col("revenue")
    gid = F.grouping_id(*_DIMS)
    g = xs.groupingSets([[x] for x in _DIMS] + [[]], *_DIMS).agg(
        F.count(F.when(t, v)).alias("n_t"), F.avg(F.when(t, v)).alias("mean_t"),
        F.var_samp(F.when(t, v)).alias("var_t"), F.count(F.when(c, v)).alias("n_c"),
        F.avg(F.when(c, v)).alias("mean_c"), F.var_samp(F.when(c, v)).alias("var_c"), gid.alias("__gid"))
    n = len(_DIMS)
    label = F.lit("all")
    for i, dim in enumerate(_DIMS):
        bit = 1 << (n - 1 - i)
        label = F.when(F.col("__gid") == ((1 << n) - 1) - bit, dim).otherwise(label)
    g = (g.withColumn("dimension", label)
         .withColumn("value", F.coalesce(*[F.col(x) for x in _DIMS], F.lit("ALL"))))
    return add_t_pvalue(pooled_t(g)).select("dimension", "value", "n_t", "n_c", "mean_t", "mean_c", "sd_t", "sd_c",
                                            "diff", "lift_pct", "t_stat", "df", "p_value", "significant")


@register("e5_mann_whitney_by_segment",
          sql=with_domain(XS_SQL + ",\n"
                          "xr AS (SELECT segment, treated, round(revenue, 6) AS v FROM xs),\n"
                          "rk AS (SELECT segment, treated, rank() OVER (PARTITION BY segment ORDER BY v) "
                          "+ (count(*) OVER (PARTITION BY segment, v) - 1) / 2.0 AS r, "
                          "count(*) OVER (PARTITION BY segment, v) AS tc FROM xr),\n"
                          "s AS (SELECT segment, count(*) FILTER (WHERE treated = 1) AS n_t, count(*) FILTER (WHERE treated = 0) AS n_c, "
                          "sum(r) FILTER (WHERE treated = 1) AS rank_sum_t, sum(CAST(tc AS DOUBLE) * tc - 1) AS tie FROM rk GROUP BY segment)",
                          with_p_sql("SELECT segment, n_t, n_c, rank_sum_t, rank_sum_t - n_t * (n_t + 1) / 2.0 AS u_stat, "
                          "(greatest(rank_sum_t - n_t * (n_t + 1) / 2.0, n_t * n_c - (rank_sum_t - n_t * (n_t + 1) / 2.0)) "
                          "- n_t * n_c / 2.0 - 0.5) / nullif(sqrt(n_t * n_c / 12.0 * ((n_t + n_c + 1) - tie / "
                          "((n_t + n_c) * (n_t + n_c - 1.0)))), 0.0) AS z FROM s", z_p_sql(), flag=False)),
          doubles={"rank_sum_t": 1, "u_stat": 1, "z": 6, "p_value": 6})
def q_mw_segment(spark, d):
    """E-5/W-4: Mann-Whitney U of customer revenue, treated vs control, per segment."""
    xs = customer_xs(spark, d).withColumn("revenue", F.round("revenue", 6))
    return mann_whitney(xs, "treated", "revenue", ["segment"]).select(
        "segment", "n_t", "n_c", "rank_sum_t", "u_stat", "z", "p_value")


@register("w4_average_ranks",
          sql=with_domain("o AS (SELECT organization, opp_arr FROM opps JOIN accounts USING (account_id)),\n"
                          "h AS (SELECT organization, opp_arr, count(*) AS n FROM o GROUP BY organization, opp_arr)",
                          "SELECT organization, opp_arr, n, sum(n) OVER (PARTITION BY organization ORDER BY opp_arr "
                          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n + (n + 1) / 2.0 AS rank FROM h"),
          doubles={"opp_arr": 2, "rank": 1})
def q_ranks(spark, d):
    """W-4: average ranks with ties of opportunity ARR within each organization (value histogram)."""
    dm = Domain(spark, d)
    o = dm.opportunities().join(dm.accounts().select("account_id", "organization"), "account_id")
    h = o.groupBy("organization", "opp_arr").agg(F.count(F.lit(1)).alias("n"))
    return average_ranks(h, ["organization"], "opp_arr", "n")


@register("e6_chi2_segment_by_arm",
          sql=with_domain(XS_SQL + ",\n"
                          "cells AS (SELECT segment, treated, count(*) AS o FROM xs GROUP BY segment, treated),\n"
                          "rs AS (SELECT segment, sum(o) AS r FROM cells GROUP BY segment),\n"
                          "cs AS (SELECT treated, sum(o) AS c FROM cells GROUP BY treated)",
                          "SELECT sum(o) AS n, CAST((count(DISTINCT cells.segment) - 1) * (count(DISTINCT cells.treated) - 1) AS BIGINT) AS dof, "
                          "sum(o) * sum(CAST(o AS DOUBLE) * o / (r * c)) - sum(o) AS chi2 "
                          "FROM cells JOIN rs USING (segment) JOIN cs USING (treated)"),
          doubles={"chi2": 6})
def q_chi2(spark, d):
    """E-6/M-6: chi-square test of independence between segment and arm over customers."""
    return chi2_independence(customer_xs(spark, d), "segment", "treated", with_p=False).select(
        "n", "dof", "chi2")


FACTORS, CALIPERS = (2.0, 2.5, 3.0), (0.05, 0.1, 0.2)
GRID = ["outlier_factor", "caliper"]


@register("e23_sensitivity", doubles={"effect_size_pct": 6, "t_stat": 6, "p_value": 6})
def q_sensitivity(spark, d):
    """E-23: matched revenue effect on the grid of outlier factors (2.0, 2.5, 3.0) and
    calipers (0.05, 0.1, 0.2): one panel for all factors, all cells matched in the same passes, one table."""
    panel = clean_panel(spark, d)
    units = None
    for factor in FACTORS:
        xs = scored(panel_xs(trimmed(panel, factor))).select("account_id", "treated", "revenue", "propensity_score", F.lit(str(factor)).alias("outlier_factor"))
        units = xs if units is None else units.unionByName(xs)
    cells = F.explode(F.array(*[F.struct(F.lit(str(c)).alias("caliper"), F.lit(c).alias("width")) for c in CALIPERS]))
    # a row per unit and factor is written, not one per cell
    units = cut_lineage(units).withColumn("__c", cells).select("*", "__c.*").drop("__c")
    pairs = M.match_nearest(units, "account_id", "treated", "propensity_score", caliper="width", by=GRID)
    ids = pairs.select(*GRID, F.explode(F.array("treatment_id", "control_id")).alias("account_id"))
    matched_rows = units.join(ids, [*GRID, "account_id"], "left_semi")
    r = two_sample_t(matched_rows, "treated", ["revenue"], by=GRID)
    return r.select(*GRID, F.col("n_t").alias("pairs"), F.col("lift_pct").alias("effect_size_pct"), "t_stat", "p_value")
