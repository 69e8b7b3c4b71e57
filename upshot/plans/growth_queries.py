"""Growth-rate family (CMGR around the first engagement) and panel DiD queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import uniform_sql
from ..operators import cohort as C
from ..operators import did as DD
from ..operators import growth as G
from ..operators.clean import coerce_numeric, remove_outliers_zscore
from ..operators.effects import one_sample_t
from ..operators.panel import arm_period_moments, median_time, profile, quartiles
from ..operators.ranks import wilcoxon_signed_rank
from ..session import cut_lineage
from .domain import OUTCOMES, Domain, with_domain
from .lift_queries import PREP_SQL, prepared_panel
from .registry import register
from .sqlgen import growth_sql, t_p_sql, with_p_sql, z_p_sql

# Query parameters. The driver tables have about ten active months per
# account spread over several years, so windows are 24 months and the row
# minimums are lower than the monthly-revenue defaults (6 / 6 / 12).
REV = ("revenue", "security_revenue", "resiliency_revenue")
PRE, POST, MIN_ROWS, MIN_PRE, MIN_POST = 24, 24, 4, 2, 2
HORIZONS = (6, 12, 18, 24)
SEED = 42


def growth_panel(spark, d):
    return coerce_numeric(Domain(spark, d).panel(), REV)


def _suitable(panel):
    t = panel.where(F.col("event_date").isNotNull())
    e = G.eligibility(t, "account_id", "period", "event_date", MIN_PRE, MIN_POST)
    return e


def treated_growth(spark, d, post=POST, panel=None):
    panel = panel if panel is not None else growth_panel(spark, d)
    ok = _suitable(panel).where("suitable").select("account_id")
    t = panel.join(ok, "account_id", "left_semi")
    return G.growth_per_unit(t, "account_id", "period", "event_date", REV, PRE, post, MIN_ROWS)


def control_arm(spark, d):
    # eligibility, pseudo date, counts, sample and both arms read the panel: written once
    panel = cut_lineage(growth_panel(spark, d).select("account_id", "period", "event_date", *REV))
    ok = _suitable(panel).where("suitable").select("account_id")
    treated_rows = panel.join(ok, "account_id", "left_semi")
    pseudo = G.pseudo_event_date(treated_rows, "event_date")
    pseudo_d = F.lit(pseudo).cast("date")
    ctl_panel = panel.where(F.col("event_date").isNull())
    elig = cut_lineage(G.eligibility(ctl_panel, "account_id", "period", pseudo_d, MIN_PRE, MIN_POST, MIN_ROWS))
    tg = cut_lineage(treated_growth(spark, d, panel=panel))
    n_t = tg.select("account_id").distinct().count()
    n_c = elig.where("suitable").count()
    sample = C.seeded_sample(elig.where("suitable").select("account_id"), "account_id", min(n_t, n_c), SEED)
    return panel, pseudo_d, elig, sample, tg


# ---- SQL side -------------------------------------------------------------------
_GP = "gp AS (SELECT * REPLACE (" + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in REV) + ") FROM panel)"
_ELIG_T = (f"elig_t AS (SELECT account_id, CAST(min(event_date) AS DATE) AS event_date, count(*) AS total_months, "
           "count(*) FILTER (WHERE period < event_date) AS pre_months, "
           "count(*) FILTER (WHERE period >= event_date) AS post_months FROM gp WHERE event_date IS NOT NULL "
           "GROUP BY account_id)")
_SUIT = (f"suit AS (SELECT account_id FROM elig_t WHERE pre_months >= {MIN_PRE} AND post_months >= {MIN_POST})")
_TG = ("tp AS (SELECT * FROM gp WHERE account_id IN (SELECT account_id FROM suit)),\n"
       f"tg AS ({growth_sql('tp', 'account_id', 'event_date', REV, PRE, POST, MIN_ROWS)})")
_PSEUDO = ("pseudo AS (SELECT CAST(quantile_cont(CAST(event_date AS TIMESTAMP), 0.5) AS DATE) AS pd FROM tp)")
_CELIG = ("cp AS (SELECT gp.*, pseudo.pd FROM gp CROSS JOIN pseudo WHERE gp.event_date IS NULL),\n"
          "celig AS (SELECT account_id, min(pd) AS event_date, count(*) AS total_months, "
          "count(*) FILTER (WHERE period < pd) AS pre_months, count(*) FILTER (WHERE period >= pd) AS post_months "
          f"FROM cp GROUP BY account_id),\n"
          f"cok AS (SELECT account_id FROM celig WHERE pre_months >= {MIN_PRE} AND post_months >= {MIN_POST} "
          f"AND total_months >= {MIN_ROWS}),\n"
          "kk AS (SELECT least((SELECT count(DISTINCT account_id) FROM tg), (SELECT count(*) FROM cok)) AS k),\n"
          f"csample AS (SELECT account_id FROM (SELECT account_id, row_number() OVER (ORDER BY "
          f"{uniform_sql(SEED, 'account_id')}, account_id) AS pos FROM cok) WHERE pos <= (SELECT k FROM kk)),\n"
          "csp AS (SELECT * FROM cp WHERE account_id IN (SELECT account_id FROM csample)),\n"
          f"cg AS ({growth_sql('csp', 'account_id', 'pd', REV, PRE, POST, MIN_ROWS)})")
GROWTH_SQL = ",\n".join([_GP, _ELIG_T, _SUIT, _TG, _PSEUDO, _CELIG])

_GD = {"pre_cmgr": 6, "post_cmgr": 6, "cmgr_acceleration": 6}


@register("c6_growth_eligibility",
          sql=with_domain(GROWTH_SQL, f"SELECT *, pre_months >= {MIN_PRE} AND post_months >= {MIN_POST} AND "
                                      "total_months >= 0 AS suitable FROM elig_t"),
          texts=("event_date",))
def q_eligibility(spark, d):
    """C-6: months in total, before and from the first engagement per treated account; suitability."""
    t = growth_panel(spark, d).where(F.col("event_date").isNotNull())
    return G.eligibility(t, "account_id", "period", "event_date", MIN_PRE, MIN_POST)


@register("c6_eligibility_summary",
          sql=with_domain(GROWTH_SQL,
                          f"SELECT count(*) AS units, count(*) FILTER (WHERE pre_months >= {MIN_PRE} AND post_months >= {MIN_POST}) "
                          "AS suitable_units, avg(total_months) AS avg_total_months, avg(pre_months) AS avg_pre_months, "
                          "avg(post_months) AS avg_post_months FROM elig_t"),
          doubles={"avg_total_months": 6, "avg_pre_months": 6, "avg_post_months": 6})
def q_elig_summary(spark, d):
    """C-6: data-sufficiency summary."""
    t = growth_panel(spark, d).where(F.col("event_date").isNotNull())
    return G.eligibility_summary(G.eligibility(t, "account_id", "period", "event_date", MIN_PRE, MIN_POST))


@register("g2_treated_growth", sql=with_domain(GROWTH_SQL, "SELECT * FROM tg"), doubles=_GD,
          texts=("event_date",))
def q_treated_growth(spark, d):
    """G-1/G-2/G-3/W-1/W-2: pre/post CMGR and acceleration per suitable treated account and revenue type."""
    return treated_growth(spark, d)


@register("c7_control_eligibility",
          sql=with_domain(GROWTH_SQL, f"SELECT *, pre_months >= {MIN_PRE} AND post_months >= {MIN_POST} AND "
                                      f"total_months >= {MIN_ROWS} AS suitable FROM celig"),
          texts=("event_date",))
def q_control_elig(spark, d):
    """C-7/A-13: never-treated accounts around the pseudo date (median treated event date)."""
    return control_arm(spark, d)[2]


@register("c8_control_sample", sql=with_domain(GROWTH_SQL, "SELECT account_id FROM csample"))
def q_control_sample(spark, d):
    """C-8: seeded sample of k = min(n treated, n eligible) controls without replacement."""
    return control_arm(spark, d)[3]


def control_growth(spark, d):
    panel, pseudo_d, _, sample, tg = control_arm(spark, d)
    cp = panel.where(F.col("event_date").isNull()).join(sample, "account_id", "left_semi")
    return G.growth_per_unit(cp, "account_id", "period", pseudo_d, REV, PRE, POST, MIN_ROWS), tg


@register("g4_control_growth", sql=with_domain(GROWTH_SQL, "SELECT * FROM cg"), doubles=_GD,
          texts=("event_date",))
def q_control_growth(spark, d):
    """G-4: CMGR of the sampled controls at the pseudo event date."""
    return control_growth(spark, d)[0]


@register("g5_growth_comparison",
          sql=with_domain(GROWTH_SQL + ",\n"
                          "ta AS (SELECT metric, count(*) AS n_t, avg(pre_cmgr) AS pre_t, avg(post_cmgr) AS post_t, "
                          "avg(cmgr_acceleration) AS mean_t, var_samp(cmgr_acceleration) AS var_t FROM tg GROUP BY metric),\n"
                          "ca AS (SELECT metric, count(*) AS n_c, avg(pre_cmgr) AS pre_c, avg(post_cmgr) AS post_c, "
                          "avg(cmgr_acceleration) AS mean_c, var_samp(cmgr_acceleration) AS var_c FROM cg GROUP BY metric),\n"
                          "j AS (SELECT ta.*, coalesce(ca.n_c, 0) AS n_c, ca.pre_c, ca.post_c, ca.mean_c, ca.var_c "
                          "FROM ta LEFT JOIN ca ON ta.metric = ca.metric)",
                          with_p_sql("SELECT metric, n_t, pre_t, post_t, mean_t, var_t, n_c, pre_c, post_c, mean_c, var_c, "
                          "(mean_t - mean_c) / nullif(sqrt(((n_t - 1) * coalesce(var_t, 0.0) + (n_c - 1) * coalesce(var_c, 0.0)) "
                          "/ nullif(n_t + n_c - 2, 0) * (1.0 / nullif(n_t, 0) + 1.0 / nullif(n_c, 0))), 0.0) AS t_stat, "
                          "CAST(n_t + n_c - 2 AS BIGINT) AS df, mean_t - coalesce(mean_c, 0.0) AS net_impact, "
                          "pow(1.0 + (mean_t - coalesce(mean_c, 0.0)), 12.0) - 1.0 AS net_impact_annual FROM j", t_p_sql())),
          doubles={k: 6 for k in ("pre_t", "post_t", "mean_t", "var_t", "pre_c", "post_c", "mean_c", "var_c",
                                  "t_stat", "net_impact", "net_impact_annual", "p_value")})
def q_growth_compare(spark, d):
    """G-5/P-20: treated vs control accelerations per revenue type, net impact and annualised impact."""
    cg, tg = control_growth(spark, d)
    return G.growth_comparison(tg, cg, with_p=True).select(
        "metric", "n_t", "pre_t", "post_t", "mean_t", "var_t", "n_c", "pre_c", "post_c", "mean_c", "var_c",
        "t_stat", "df", "net_impact", "net_impact_annual", "p_value", "significant")


# ---- dense panel: daily event values, days taken as months, at the default windows ----------
_EVENT_BODY = (
    "ev AS (SELECT user_id, CAST(DATE '2020-01-01' + to_months(CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER)) AS DATE) AS period, "
    "event_type, value FROM events),\n"
    "es AS (SELECT user_id, min(period) AS event_date FROM ev WHERE event_type = 'signup' GROUP BY user_id),\n"
    "ex AS (SELECT p.*, es.event_date FROM (SELECT user_id, period, sum(value) AS value FROM ev GROUP BY user_id, period) p "
    "JOIN es ON p.user_id = es.user_id)")


@register("g2_event_growth", sql=f"WITH {_EVENT_BODY}\n{growth_sql('ex', 'user_id', 'event_date', ['value'], 6, 6, 12)}",
          doubles=_GD, texts=("event_date",))
def q_event_growth(spark, d):
    """G-2/G-3/W-1/W-2 at 6 / 6 / 12: growth of users' event values around their first signup,
    each day of the events table taken as a month."""
    e = Domain(spark, d).t.events
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    ev = e.select("user_id", "event_type", "value", F.add_months(F.lit("2020-01-01").cast("date"), day).alias("period"))
    first = ev.where("event_type = 'signup'").groupBy("user_id").agg(F.min("period").alias("event_date"))
    panel = ev.groupBy("user_id", "period").agg(F.sum("value").alias("value")).join(first, "user_id")
    return G.growth_per_unit(panel, "user_id", "period", "event_date", ["value"], 6, 6, 12)


@register("e2_one_sample_acceleration",
          sql=with_domain(GROWTH_SQL, with_p_sql("SELECT metric, count(*) AS n, avg(cmgr_acceleration) AS mean, "
                                      "stddev_samp(cmgr_acceleration) AS sd, avg(cmgr_acceleration) / "
                                      "nullif(stddev_samp(cmgr_acceleration) / sqrt(count(*)), 0.0) AS t_stat, "
                                      "CAST(count(*) - 1 AS BIGINT) AS df FROM tg GROUP BY metric", t_p_sql(), flag=False)),
          doubles={"mean": 6, "sd": 6, "t_stat": 6, "p_value": 6})
def q_one_sample(spark, d):
    """E-2: one-sample t of the treated acceleration against zero."""
    return one_sample_t(treated_growth(spark, d), "cmgr_acceleration", ["metric"]).select(
        "metric", "n", "mean", "sd", "t_stat", "df", "p_value")


@register("g6_growth_by_segment",
          sql=with_domain(GROWTH_SQL + ",\nseg AS (SELECT DISTINCT account_id, segment FROM gp)",
                          "SELECT s.segment, count(*) AS customers, avg(tg.cmgr_acceleration) AS avg_acceleration "
                          "FROM tg LEFT JOIN seg s ON tg.account_id = s.account_id WHERE tg.metric = 'revenue' "
                          "AND s.segment IS NOT NULL GROUP BY s.segment HAVING count(*) > 5"),
          doubles={"avg_acceleration": 6})
def q_growth_segment(spark, d):
    """G-6/J-8: mean revenue acceleration per segment (more than 5 customers)."""
    panel = growth_panel(spark, d)
    seg = panel.select("account_id", "segment").distinct()
    tg = treated_growth(spark, d, panel=panel).where(F.col("metric") == "revenue")
    j = tg.join(seg, "account_id", "left").where(F.col("segment").isNotNull())
    return (j.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"),
                                     F.avg("cmgr_acceleration").alias("avg_acceleration"))
            .where(F.col("customers") > 5))


def _tti_sql() -> str:
    blocks = [f"SELECT {h} AS months_post, * FROM ({growth_sql('tp', 'account_id', 'event_date', ['revenue'], PRE, h, MIN_ROWS)})"
              for h in HORIZONS]
    return with_domain(GROWTH_SQL + ",\ntti AS (" + "\nUNION ALL\n".join(blocks) + ")",
                       "SELECT months_post, avg(cmgr_acceleration) AS mean_acceleration, count(*) AS sample_size "
                       "FROM tti GROUP BY months_post")


@register("g7_time_to_impact", sql=_tti_sql(), doubles={"mean_acceleration": 6})
def q_time_to_impact(spark, d):
    """G-7/C-9: mean revenue acceleration for several post-window lengths, over all suitable accounts."""
    panel = growth_panel(spark, d)
    ok = _suitable(panel).where("suitable").select("account_id")
    t = panel.join(ok, "account_id", "left_semi")
    h = t.withColumn("months_post", F.explode(F.array(*[F.lit(x) for x in HORIZONS])))
    # one grouped pass for all horizons: the horizon is part of the group key
    e, p = F.col("event_date"), F.col("period")
    pre = (p >= F.add_months(e, -PRE)) & (p < e)
    post = (p >= e) & (p < F.add_months(e, F.col("months_post")))
    v = F.col("revenue")
    g = h.groupBy("account_id", "months_post").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(pre & (v > 0)).alias("pk"), F.min_by(v, F.when(pre & (v > 0), p)).alias("pf"),
        F.max_by(v, F.when(pre & (v > 0), p)).alias("pl"),
        F.count_if(post & (v > 0)).alias("qk"), F.min_by(v, F.when(post & (v > 0), p)).alias("qf"),
        F.max_by(v, F.when(post & (v > 0), p)).alias("ql"))
    g = (g.withColumn("pre", G.cmgr(F.col("pf"), F.col("pl"), F.col("pk")))
         .withColumn("post", G.cmgr(F.col("qf"), F.col("ql"), F.col("qk")))
         .where((F.col("rows") >= MIN_ROWS) & F.col("pre").isNotNull() & F.col("post").isNotNull()))
    return g.groupBy("months_post").agg(F.avg(F.col("post") - F.col("pre")).alias("mean_acceleration"),
                                        F.count(F.lit(1)).alias("sample_size"))


# ---- difference in differences and panel descriptives (cleaned panel) -------------------
_DID_D = {c: 4 for c in ("treat_pre", "treat_post", "control_pre", "control_post", "treat_pre_sd",
                         "treat_post_sd", "control_pre_sd", "control_post_sd", "did_estimate",
                         "standard_error")}
_DID_D.update({"t_statistic": 6, "p_value_simplified": 6, "p_value": 6})


def _did_sql() -> str:
    cells = (("treat_pre", 1, 0), ("treat_post", 1, 1), ("control_pre", 0, 0), ("control_post", 0, 1))
    blocks = []
    for o in OUTCOMES:
        cols = []
        for n, a, p in cells:
            cond = f"treated = {a} AND post = {p}"
            cols += [f"avg({o}) FILTER (WHERE {cond}) AS {n}", f"stddev_samp({o}) FILTER (WHERE {cond}) AS {n}_sd",
                     f"count({o}) FILTER (WHERE {cond}) AS {n}_n"]
        blocks.append(f"SELECT '{o}' AS outcome, {', '.join(cols)} FROM dp")
    se = "sqrt(" + " + ".join(f"pow({n}_sd, 2) / {n}_n" for n, _, _ in cells) + ")"
    est = "((treat_post - treat_pre) - (control_post - control_pre))"
    t = f"CASE WHEN {se} > 0 THEN {est} / {se} WHEN {se} = 0 THEN 0.0 END"
    body = (PREP_SQL + ",\nmed AS (SELECT quantile_cont(CAST(period - DATE '1970-01-01' AS DOUBLE), 0.5) AS m FROM clean),\n"
            "dp AS (SELECT c.*, CAST(CAST(period - DATE '1970-01-01' AS DOUBLE) >= med.m AS INTEGER) AS post "
            "FROM clean c CROSS JOIN med),\n"
            "cells AS (" + "\nUNION ALL\n".join(blocks) + ")")
    return with_domain(body, with_p_sql(f"SELECT *, {est} AS did_estimate, {se} AS standard_error, {t} AS t_statistic, "
                             f"CASE WHEN abs({t}) <= 1 THEN 2 * (1 - abs({t})) WHEN abs({t}) > 1 THEN 0.05 END AS p_value_simplified FROM cells", z_p_sql("t_statistic"), flag=False))


@register("e13_did", sql=_did_sql(), doubles=_DID_D)
def q_did(spark, d):
    """E-13/A-2/A-13/A-16: 2x2 difference in differences per outcome, split at the median period."""
    return DD.did(prepared_panel(spark, d), "account_id", "period", "treated", OUTCOMES)


def _cluster_sql() -> str:
    body = (PREP_SQL + ",\nmed AS (SELECT quantile_cont(CAST(period - DATE '1970-01-01' AS DOUBLE), 0.5) AS m FROM clean),\n"
            "dp AS (SELECT c.account_id, c.revenue AS y, c.treated AS a, "
            "CAST(CAST(period - DATE '1970-01-01' AS DOUBLE) >= med.m AS INTEGER) AS p FROM clean c CROSS JOIN med),\n"
            "cm AS (SELECT a, p, avg(y) AS m, count(*) AS n FROM dp GROUP BY a, p),\n"
            "j AS (SELECT dp.*, cm.m, cm.n, CASE WHEN dp.a = dp.p THEN 1.0 ELSE -1.0 END AS s "
            "FROM dp JOIN cm ON dp.a = cm.a AND dp.p = cm.p),\n"
            "pu AS (SELECT account_id, sum(s / n * (y - m)) AS su, count(*) AS k, sum(s / n * y) AS b FROM j GROUP BY account_id),\n"
            "g AS (SELECT sum(b) AS did_estimate, sum(su * su) AS v, count(*) AS clusters, sum(k) AS n_obs FROM pu)")
    se = "sqrt(v * (clusters / (clusters - 1.0)) * ((n_obs - 1.0) / (n_obs - 4.0)))"
    return with_domain(body, f"SELECT did_estimate, clusters, CAST(n_obs AS BIGINT) AS n_obs, {se} AS se_cluster, "
                             f"did_estimate / nullif({se}, 0.0) AS t_cluster FROM g")


@register("e14_did_cluster_se", sql=_cluster_sql(),
          doubles={"did_estimate": 4, "se_cluster": 4, "t_cluster": 6})
def q_did_cluster(spark, d):
    """E-14: DiD interaction estimate with unit-clustered (CR1) standard error on revenue."""
    p = prepared_panel(spark, d)
    med = p.agg(F.percentile(F.unix_date("period").cast("double"), 0.5).alias("m")).first()["m"]
    r = DD.did_cluster_se(p, "account_id", "period", "treated", "revenue",
                          F.unix_date("period") >= F.lit(med))
    return r.select("did_estimate", "clusters", F.col("n_obs").cast("long").alias("n_obs"),
                    "se_cluster", "t_cluster")


def _prepost_sql_units() -> str:
    blocks = [f"SELECT account_id, '{o}' AS outcome, avg({o}) FILTER (WHERE period < event_date) AS pre_mean, "
              f"avg({o}) FILTER (WHERE period >= event_date) AS post_mean FROM clean WHERE event_date IS NOT NULL "
              "GROUP BY account_id" for o in OUTCOMES]
    return ("pp AS (SELECT *, post_mean - pre_mean AS change FROM (" + "\nUNION ALL\n".join(blocks)
            + ") WHERE pre_mean IS NOT NULL AND post_mean IS NOT NULL)")


@register("e15_prepost_change",
          sql=with_domain(PREP_SQL + ",\n" + _prepost_sql_units(),
                          "SELECT outcome, count(*) AS units, avg(pre_mean) AS mean_pre, avg(post_mean) AS mean_post, "
                          "coalesce((avg(post_mean) - avg(pre_mean)) / nullif(avg(pre_mean), 0) * 100.0, 0.0) AS pct_change, "
                          "avg(change) / nullif(stddev_samp(change) / sqrt(count(*)), 0.0) AS t_stat "
                          "FROM pp GROUP BY outcome"),
          doubles={"mean_pre": 4, "mean_post": 4, "pct_change": 6, "t_stat": 6})
def q_prepost(spark, d):
    """E-15: within-unit change from before to after each account's own first engagement."""
    u = DD.prepost_change(prepared_panel(spark, d), "account_id", "period", "event_date", OUTCOMES)
    g = u.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("units"), F.avg("pre_mean").alias("mean_pre"),
        F.avg("post_mean").alias("mean_post"),
        F.try_divide(F.avg("change"), F.nullif(F.stddev_samp("change") / F.sqrt(F.count(F.lit(1))), F.lit(0.0)))
        .alias("t_stat"))
    return g.withColumn("pct_change", F.coalesce(
        F.try_divide(F.col("mean_post") - F.col("mean_pre"), F.nullif(F.col("mean_pre"), F.lit(0.0))) * 100.0,
        F.lit(0.0)))


@register("e16_wilcoxon_prepost",
          sql=with_domain(PREP_SQL + ",\n" + _prepost_sql_units() + ",\n"
                          "wd AS (SELECT outcome, round(change, 4) AS dd FROM pp WHERE round(change, 4) <> 0),\n"
                          "wr AS (SELECT outcome, dd, rank() OVER (PARTITION BY outcome ORDER BY abs(dd)) "
                          "+ (count(*) OVER (PARTITION BY outcome, abs(dd)) - 1) / 2.0 AS r, "
                          "count(*) OVER (PARTITION BY outcome, abs(dd)) AS tc FROM wd),\n"
                          "ws AS (SELECT outcome, count(*) AS n, coalesce(sum(r) FILTER (WHERE dd > 0), 0) AS w_plus, "
                          "coalesce(sum(r) FILTER (WHERE dd < 0), 0) AS w_minus, sum(CAST(tc AS DOUBLE) * tc - 1) AS tie "
                          "FROM wr GROUP BY outcome)",
                          with_p_sql("SELECT outcome, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic, "
                          "(w_plus - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie / 48.0), 0.0) AS z "
                          "FROM ws", z_p_sql(), flag=False)),
          doubles={"w_plus": 1, "w_minus": 1, "statistic": 1, "z": 6, "p_value": 6})
def q_wilcoxon(spark, d):
    """E-16/W-4: Wilcoxon signed-rank on per-account post - pre means (rounded to 4 dp, zeros dropped)."""
    u = DD.prepost_change(prepared_panel(spark, d), "account_id", "period", "event_date", OUTCOMES)
    u = u.withColumn("dd", F.round("change", 4))
    return wilcoxon_signed_rank(u, "dd", ["outcome"]).select(
        "outcome", "n", "w_plus", "w_minus", "statistic", "z", "p_value")


@register("a13_a14_quantiles",
          sql=with_domain(PREP_SQL, "SELECT segment, count(revenue) AS n, quantile_cont(revenue, 0.25) AS q1, "
                                    "quantile_cont(revenue, 0.75) AS q3, quantile_cont(revenue, 0.75) - "
                                    "quantile_cont(revenue, 0.25) AS iqr, (SELECT CAST(quantile_cont(CAST(period AS TIMESTAMP), 0.5) AS VARCHAR) "
                                    "FROM clean) AS median_period FROM clean GROUP BY segment"),
          doubles={"q1": 4, "q3": 4, "iqr": 4})
def q_quantiles(spark, d):
    """A-13/A-14: revenue quartiles per segment (linear interpolation) and the median period."""
    p = prepared_panel(spark, d)
    med = median_time(p, "period")
    return quartiles(p, "revenue", ["segment"]).withColumn("median_period", F.lit(str(med)))


@register("a15_profile",
          sql=with_domain(PREP_SQL, "SELECT count(*) AS rows, count(DISTINCT account_id) AS units, "
                                    "count(DISTINCT account_id) FILTER (WHERE treated = 1) AS treated_units, "
                                    "count(DISTINCT account_id) FILTER (WHERE treated = 0) AS control_units, "
                                    + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max, avg({c}) AS {c}_mean"
                                                for c in REV) + " FROM clean"),
          doubles={f"{c}_{s}": 4 for c in REV for s in ("min", "max", "mean")})
def q_profile(spark, d):
    """A-15: data profile of the cleaned panel."""
    return profile(prepared_panel(spark, d), "account_id", "treated", REV)


@register("a16_arm_period_moments",
          sql=with_domain(PREP_SQL + ",\nmed AS (SELECT quantile_cont(CAST(period - DATE '1970-01-01' AS DOUBLE), 0.5) AS m FROM clean)",
                          "SELECT treated, CAST(CAST(period - DATE '1970-01-01' AS DOUBLE) >= med.m AS INTEGER) AS post, "
                          "count(revenue) AS n, avg(revenue) AS mean, stddev_samp(revenue) AS sd "
                          "FROM clean CROSS JOIN med GROUP BY ALL"),
          doubles={"mean": 4, "sd": 4})
def q_arm_period(spark, d):
    """A-16: n, mean and sd of revenue per (arm, post) cell."""
    p = prepared_panel(spark, d)
    med = p.agg(F.percentile(F.unix_date("period").cast("double"), 0.5).alias("m")).first()["m"]
    p = p.withColumn("post", (F.unix_date("period") >= F.lit(med)).cast("int"))
    return arm_period_moments(p, "treated", "post", "revenue")


@register("c2_zscore_filter",
          sql=with_domain("zm AS (SELECT avg(revenue) AS m, stddev_samp(revenue) AS s FROM panel)",
                          "SELECT p.account_id, p.period, p.revenue FROM panel p CROSS JOIN zm "
                          "WHERE abs(p.revenue - zm.m) / zm.s < 3"),
          doubles={"revenue": 2}, texts=("period",))
def q_zscore(spark, d):
    """C-2: global z-score filter |z| < 3 on monthly revenue."""
    p = Domain(spark, d).panel().select("account_id", "period", "revenue")
    return remove_outliers_zscore(p, ["revenue"], 3.0)

