"""Cohort, analysis-table and opportunity-grain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import opportunity as O
from .domain import RESILIENCY_PRODUCTS, SECURITY_AREAS, Domain, with_domain
from ..session import cut_lineage
from .registry import register
from .sqlgen import with_p_sql, z_p_sql

FLAGS = ("qualified_account_flag", "has_revenue_flag", "created_opportunities_flag")
#: the products of the test tables, for the oracle SQL
PRODUCTS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def analysis(spark, d):
    dm = Domain(spark, d)
    opps = dm.opportunities()
    acc_rev = opps.groupBy("account_id").agg(F.sum("opp_arr").alias("account_revenue"))
    t = C.analysis_table(dm.accounts(), dm.engagements(), dm.engagement_details(),
                         opps, dm.lines(), acc_rev, FLAGS)
    # the analysis table feeds several branches of every analysis: persist it once
    # in the shared checkpoint folder (the template's persisted analysis table)
    return cut_lineage(t)


def _acc_sel(prefix="acc"):
    return ", ".join(f"{prefix}.{c}" for c in ("account_id", "account_name", "segment", "phase",
                                               "revenue_bucket", "industry", "support_level",
                                               "region", "organization"))


_OPP_SEL = ("o.opp_id, o.created_date, o.stage_name, o.probability, o.is_closed, o.is_won, o.opp_arr, "
            "o.line_no, o.functional_area, o.product_name, "
            "CAST(o.line_price AS DECIMAL(18,2)) AS total_price, CAST(CAST(o.line_price AS DECIMAL(18,2)) * (1 - CAST(o.discount AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS service_arr, "
            "o.is_security, o.is_resiliency")

ANALYSIS_SQL = f"""
treat AS (SELECT DISTINCT account_id FROM engagement_details WHERE engagement_id IS NOT NULL),
ctl AS (SELECT DISTINCT account_id FROM engagement_details
        WHERE engagement_id IS NULL AND qualified_account_flag AND has_revenue_flag AND created_opportunities_flag
          AND account_id NOT IN (SELECT account_id FROM treat)),
cohorts AS (SELECT account_id, 'Treatment' AS group_type FROM treat
            UNION ALL SELECT account_id, 'Control' AS group_type FROM ctl),
edr AS (SELECT min(engagement_date) AS lo, max(engagement_date) + INTERVAL 6 MONTH AS hi FROM engagements),
ol AS (SELECT o.*, l.line_no, l.functional_area, l.product_name, l.line_price, l.line_arr, l.discount,
              l.is_security, l.is_resiliency, c.group_type
       FROM opps o JOIN lines l ON o.opp_id = l.opp_id JOIN cohorts c ON o.account_id = c.account_id
       CROSS JOIN edr WHERE o.created_date >= edr.lo AND o.created_date <= edr.hi),
sec_res AS (SELECT * FROM ol WHERE is_security = 1 OR is_resiliency = 1),
acc_rev AS (SELECT account_id, sum(opp_arr) AS account_revenue FROM opps GROUP BY account_id),
acc AS (SELECT a.account_id, a.account_name, a.segment, a.phase,
               CASE WHEN r.account_revenue IS NULL THEN 'Unknown' WHEN r.account_revenue < 100000 THEN 'Small'
                    WHEN r.account_revenue < 1000000 THEN 'Medium' WHEN r.account_revenue < 10000000 THEN 'Large'
                    ELSE 'Enterprise' END AS revenue_bucket,
               a.region AS industry, coalesce(a.support_level, 'Basic') AS support_level, a.region, a.organization
        FROM accounts a LEFT JOIN acc_rev r ON a.account_id = r.account_id),
analysis0 AS (
  SELECT {_acc_sel()}, 'Treatment' AS group_type, e.engagement_id AS activity_id, e.engagement_type, e.is_direct,
         CASE WHEN e.is_attributed = 1 THEN 1 WHEN e.is_direct = 0 AND e.engagement_id IS NOT NULL THEN 1 ELSE 0 END
           AS is_attributed, {_OPP_SEL}
  FROM engagements e JOIN treat t ON e.account_id = t.account_id
       LEFT JOIN acc ON acc.account_id = e.account_id
       LEFT JOIN sec_res o ON o.account_id = e.account_id AND o.group_type = 'Treatment'
  UNION ALL
  SELECT {_acc_sel()}, 'Control' AS group_type, CAST(NULL AS BIGINT) AS activity_id,
         CAST(NULL AS VARCHAR) AS engagement_type, 0 AS is_direct, 0 AS is_attributed, {_OPP_SEL}
  FROM acc JOIN ctl ON acc.account_id = ctl.account_id
       LEFT JOIN sec_res o ON o.account_id = acc.account_id AND o.group_type = 'Control'),
analysis AS (SELECT *, CASE WHEN is_security = 1 OR is_resiliency = 1 THEN 1 ELSE 0 END AS is_sec_res
             FROM analysis0)"""


def q(body: str, final: str) -> str:
    ctes = ANALYSIS_SQL.strip()
    if body.strip():
        ctes += ",\n" + body.strip()
    return with_domain(ctes, final)


@register("c3_cohorts", sql=q("", "SELECT account_id, group_type FROM cohorts"))
def q_cohorts(spark, d):
    """C-3/J-3/D-4: treatment and control cohorts (control anti-joined with treatment)."""
    det = Domain(spark, d).engagement_details()
    return C.labelled_cohorts(C.treatment_cohort(det), C.control_cohort(det, FLAGS))


@register("c4_observation_window", sql=q("", "SELECT CAST(lo AS DATE) AS lo, CAST(hi AS DATE) AS hi FROM edr"),
          texts=("lo", "hi"))
def q_window(spark, d):
    """C-4/P-17: engagement date range with a 6-month tail."""
    e = Domain(spark, d).engagements()
    return e.agg(F.min("engagement_date").alias("lo"),
                 F.add_months(F.max("engagement_date"), 6).alias("hi"))


_ANALYSIS_D = {"probability": 2, "opp_arr": 2, "total_price": 2, "service_arr": 2}


@register("c5_analysis_table", sql=q("", "SELECT * FROM analysis"),
          doubles=_ANALYSIS_D, texts=("created_date",))
def q_analysis(spark, d):
    """C-5/D-5/J-2..J-5/P-9/P-12/P-14/P-16/P-21: analysis table, treated x engagements x lines UNION ALL controls."""
    return analysis(spark, d)


@register("s4_group_extract",
          sql=q("", "SELECT DISTINCT account_id, group_type, opp_id, product_name FROM analysis "
                    "WHERE group_type IN ('Treatment', 'Control')"))
def q_extract(spark, d):
    """S-4/D-6: distinct union of the per-group extracts."""
    return C.group_extract(analysis(spark, d), ["Treatment", "Control"],
                           ["account_id", "group_type", "opp_id", "product_name"])


@register("j6_team_flag",
          sql=with_domain("", "SELECT DISTINCT t.opp_id, 1 AS on_team_flag FROM team_members t "
                              "JOIN users u ON u.user_id = t.user_id "
                              "WHERE t.delete_flag = 'N' AND u.alias IN (SELECT alias FROM roster)"))
def q_team(spark, d):
    """J-6: opportunity has a live team member on the roster (semi join)."""
    dm = Domain(spark, d)
    return C.team_flag(dm.team_members(), dm.users(), dm.roster())


_D1_ORDER = ["activity_id", "line_no", "functional_area", "product_name", "total_price", "service_arr"]


@register("d1_first_row_per_opportunity",
          sql=q("", "SELECT opp_id, account_id, group_type, activity_id, line_no, functional_area, product_name FROM ("
                    "SELECT *, row_number() OVER (PARTITION BY opp_id ORDER BY activity_id NULLS FIRST, line_no, "
                    "functional_area, product_name, total_price, service_arr) AS rn FROM analysis "
                    "WHERE opp_id IS NOT NULL) WHERE rn = 1"))
def q_first_row(spark, d):
    """D-1: keep the first analysis row per opportunity under a total order."""
    out = ["opp_id", "account_id", "group_type", "activity_id", "line_no", "functional_area", "product_name"]
    # a row is kept as one struct, so what is not asked for would be sorted along with it
    t = analysis(spark, d).where(F.col("opp_id").isNotNull()).select(*out, *(c for c in _D1_ORDER if c not in out))
    return C.keep_first(t, ["opp_id"], _D1_ORDER).select(*out)


@register("d2_first_engagement_per_opportunity",
          sql=q("", "SELECT a.opp_id, arg_min(e.engagement_id, (e.engagement_date, e.engagement_id)) AS first_activity_id, "
                    "min(e.engagement_date) AS first_engagement_date "
                    "FROM (SELECT DISTINCT opp_id, activity_id FROM analysis WHERE group_type = 'Treatment' "
                    "AND opp_id IS NOT NULL) a JOIN engagements e ON a.activity_id = e.engagement_id GROUP BY a.opp_id"),
          texts=("first_engagement_date",))
def q_first_engagement(spark, d):
    """D-2: the engagement credited with each opportunity: first by date, then id."""
    t = (analysis(spark, d).where((F.col("group_type") == "Treatment") & F.col("opp_id").isNotNull())
         .select("opp_id", "activity_id").distinct())
    e = Domain(spark, d).engagements().select(F.col("engagement_id").alias("activity_id"), "engagement_date")
    j = t.join(e, "activity_id")
    return j.groupBy("opp_id").agg(
        F.min_by("activity_id", F.struct("engagement_date", "activity_id")).alias("first_activity_id"),
        F.min("engagement_date").alias("first_engagement_date"))


@register("d3_engagement_rank",
          sql=with_domain("", "SELECT account_id, engagement_id, engagement_date, engagement_type, "
                              "row_number() OVER (PARTITION BY account_id ORDER BY engagement_date, engagement_id) "
                              "AS event_rank FROM engagements"),
          texts=("engagement_date",))
def q_engagement_rank(spark, d):
    """D-3/W-3: every engagement with its ordinal per account (rank 1 = first engagement)."""
    e = Domain(spark, d).engagements()
    return (C.first_per_key(e, "account_id", ["engagement_date", "engagement_id"], mode="all")
            .select("account_id", "engagement_id", "engagement_date", "engagement_type", "event_rank"))


_A3_KEYS = ["account_id", "group_type", "organization", "segment"]


@register("a3_account_arr",
          sql=q("opp_acc AS (SELECT DISTINCT account_id, group_type, organization, segment, opp_id, opp_arr, is_won, "
                "is_closed FROM analysis)",
                "SELECT account_id, group_type, organization, segment, coalesce(sum(opp_arr), 0.0) AS real_total_arr, "
                "count(opp_id) AS total_opportunities, count(*) FILTER (WHERE is_won) AS won_opportunities, "
                "count(*) FILTER (WHERE is_closed) AS closed_opportunities, "
                "count(*) FILTER (WHERE is_won) / greatest(count(*) FILTER (WHERE is_closed), 1) AS real_win_rate "
                "FROM opp_acc GROUP BY account_id, group_type, organization, segment"),
          doubles={"real_total_arr": 2, "real_win_rate": 6})
def q_account_arr(spark, d):
    """A-3: account ARR over distinct opportunities, counts and win rate."""
    return O.account_arr_metrics(analysis(spark, d), _A3_KEYS)


@register("a4_distinct_counts",
          sql=q("", "SELECT group_type, count(DISTINCT account_id) AS n_account_id, count(DISTINCT opp_id) AS n_opp_id "
                    "FROM analysis GROUP BY group_type"))
def q_distinct(spark, d):
    """A-4: distinct accounts and opportunities per group."""
    return O.distinct_counts(analysis(spark, d), ["group_type"], ["account_id", "opp_id"])


@register("a5_type_kpis",
          sql=q("", "SELECT engagement_type, count(DISTINCT account_id) AS accounts, count(DISTINCT opp_id) AS opportunities, "
                    "sum(CAST(service_arr AS DOUBLE)) AS total_arr, avg(CAST(service_arr AS DOUBLE)) AS avg_arr_per_opp, "
                    "count(*) FILTER (WHERE is_closed) AS closed_opps, count(*) FILTER (WHERE is_closed AND is_won) AS won_opps, "
                    "least(coalesce(count(*) FILTER (WHERE is_closed AND is_won) / "
                    "nullif(count(*) FILTER (WHERE is_closed), 0), 0.0), 1.0) AS win_rate "
                    "FROM analysis WHERE group_type = 'Treatment' AND engagement_type IS NOT NULL AND opp_id IS NOT NULL "
                    "GROUP BY engagement_type"),
          doubles={"total_arr": 2, "avg_arr_per_opp": 4, "win_rate": 6})
def q_type_kpis(spark, d):
    """A-5/A-6: KPI table per engagement type, win rate capped at 1."""
    return O.type_kpis(analysis(spark, d))


def features_sql_parts() -> tuple[str, str]:
    sec = ", ".join(f"'{v}'" for v in SECURITY_AREAS)
    res = ", ".join(f"'{v}'" for v in RESILIENCY_PRODUCTS)
    piv = ", ".join(f"coalesce(max(1) FILTER (WHERE product_name = '{p}'), 0) AS {p}" for p in PRODUCTS)
    body = (
        "opp_acc AS (SELECT DISTINCT account_id, group_type, opp_id, opp_arr, is_won, is_closed FROM analysis),\n"
        "arr AS (SELECT account_id, group_type, coalesce(sum(opp_arr), 0.0) AS real_total_arr, count(opp_id) AS total_opportunities, "
        "count(*) FILTER (WHERE is_won) AS won_opportunities, count(*) FILTER (WHERE is_closed) AS closed_opportunities "
        "FROM opp_acc GROUP BY account_id, group_type),\n"
        f"mat AS (SELECT account_id, group_type, {piv} FROM analysis GROUP BY account_id, group_type),\n"
        f"fam AS (SELECT account_id, group_type, CAST(coalesce(max(CAST(functional_area IN ({sec}) AS INTEGER)), 0) AS INTEGER) AS has_security, "
        f"CAST(coalesce(max(CAST(product_name IN ({res}) AS INTEGER)), 0) AS INTEGER) AS has_resiliency, "
        "count(DISTINCT product_name) AS product_diversity FROM analysis GROUP BY account_id, group_type)")
    cols = ", ".join(f"CAST(mat.{p} AS INTEGER) AS {p}" for p in PRODUCTS)
    final = (f"SELECT arr.*, {cols}, fam.has_security, fam.has_resiliency, fam.product_diversity "
             "FROM arr JOIN mat ON arr.account_id = mat.account_id AND arr.group_type = mat.group_type "
             "JOIN fam ON arr.account_id = fam.account_id AND arr.group_type = fam.group_type")
    return body, final


def _features_sql() -> str:
    body, final = features_sql_parts()
    return q(body, final)


REPORT_PRODUCTS = 1_000  # widest report; :mod:`..operators.sparse` has the form without a bound


def product_names(table) -> tuple[str, ...]:
    """The products of the data in sorted order, for a report with a column each."""
    names = [r[0] for r in table.select("product_name").where(F.col("product_name").isNotNull()).distinct().limit(REPORT_PRODUCTS + 1).collect()]
    if len(names) > REPORT_PRODUCTS:
        raise ValueError(f"more than {REPORT_PRODUCTS} products: use the sparse form")
    return tuple(sorted(names))


def account_features(spark, d):
    t = analysis(spark, d)
    products = product_names(t)
    key = ["account_id", "group_type"]
    arr = O.account_arr_metrics(t, key).drop("real_win_rate")
    mat = O.product_matrix(t, key, "product_name", products)
    fam = O.family_flags(t, key, {
        "security": F.coalesce(F.col("functional_area").isin(*SECURITY_AREAS), F.lit(False)),
        "resiliency": F.coalesce(F.col("product_name").isin(*RESILIENCY_PRODUCTS), F.lit(False))})
    fam = fam.withColumn("has_security", F.coalesce("has_security", F.lit(0)).cast("int")) \
             .withColumn("has_resiliency", F.coalesce("has_resiliency", F.lit(0)).cast("int"))
    mat = mat.select(*key, *[F.col(p).cast("int").alias(p) for p in products])
    return arr.join(mat, key, "left").join(fam, key, "left").na.fill(0, list(products))


@register("k1_account_features", sql=_features_sql(), doubles={"real_total_arr": 2})
def q_features(spark, d):
    """K-1/A-8/A-9/A-10: account ARR metrics, 0/1 product matrix, family flags, product diversity."""
    return account_features(spark, d)


@register("a12_category_mode",
          sql=with_domain("c AS (SELECT region, segment, count(*) AS n FROM accounts GROUP BY region, segment)",
                          "SELECT region, arg_min(segment, (-n, segment)) AS top_segment FROM c GROUP BY region"))
def q_mode(spark, d):
    """A-12: most frequent segment per region, ties to the smallest name."""
    return O.category_mode(Domain(spark, d).accounts(), ["region"], "segment", "top_segment")


def _chi2_sql(a, b, c, d) -> str:
    a, b, c, d = (f"CAST(({x}) AS DOUBLE)" for x in (a, b, c, d))
    n = f"({a} + {b} + {c} + {d})"
    r1, r2, c1, c2 = f"({a} + {b})", f"({c} + {d})", f"({a} + {c})", f"({b} + {d})"
    adj = f"greatest(abs({a} - {r1} * {c1} / {n}) - 0.5, 0.0)"
    inv = (f"(1.0 / ({r1} * {c1} / {n}) + 1.0 / ({r1} * {c2} / {n}) + 1.0 / ({r2} * {c1} / {n}) "
           f"+ 1.0 / ({r2} * {c2} / {n}))")
    return (f"(CASE WHEN {r1} > 0 AND {r2} > 0 AND {c1} > 0 AND {c2} > 0 "
            f"THEN {adj} * {adj} * {inv} END)")


@register("e7_direct_vs_attributed",
          sql=q("t AS (SELECT *, CASE WHEN is_direct = 1 THEN 'Direct' WHEN is_attributed = 1 THEN 'Attributed' "
                "ELSE 'Other' END AS engagement_category FROM analysis WHERE group_type = 'Treatment' "
                "AND opp_id IS NOT NULL AND (is_direct = 1 OR is_attributed = 1)),\n"
                "g AS (SELECT engagement_category, count(DISTINCT account_id) AS accounts, count(*) AS total_opportunities, "
                "count(*) FILTER (WHERE is_closed AND is_won) AS won_opportunities, "
                "least(coalesce(count(*) FILTER (WHERE is_closed AND is_won) / nullif(count(*) FILTER (WHERE is_closed), 0), 0.0), 1.0) AS win_rate, "
                "avg(CAST(service_arr AS DOUBLE)) AS avg_arr_per_opp, sum(CAST(service_arr AS DOUBLE)) AS total_arr, "
                "count(*) FILTER (WHERE is_won) AS wins FROM t GROUP BY engagement_category),\n"
                "p AS (SELECT max(wins) FILTER (WHERE engagement_category = 'Direct') AS dw, "
                "max(total_opportunities) FILTER (WHERE engagement_category = 'Direct') AS d_tot, "
                "max(wins) FILTER (WHERE engagement_category = 'Attributed') AS aw, "
                "max(total_opportunities) FILTER (WHERE engagement_category = 'Attributed') AS a_tot FROM g),\n"
                "s AS (SELECT CASE WHEN dw > 0 AND d_tot > dw AND aw > 0 AND a_tot > aw AND d_tot >= 5 AND a_tot >= 5 THEN "
                + _chi2_sql("dw", "d_tot - dw", "aw", "a_tot - aw") + " END AS chi2 FROM p)",
                with_p_sql("SELECT g.engagement_category, g.accounts, g.total_opportunities, g.won_opportunities, g.win_rate, "
                           "g.avg_arr_per_opp, g.total_arr, s.chi2 FROM g, s", z_p_sql("sqrt(chi2)"))),
          doubles={"win_rate": 6, "avg_arr_per_opp": 4, "total_arr": 2, "chi2": 6, "p_value": 6})
def q_direct_attr(spark, d):
    """E-7/P-13: Direct vs Attributed comparison with the corrected 2x2 chi-square."""
    return O.direct_vs_attributed(analysis(spark, d))


def _mw_sql(src: str, key: str, tcond: str) -> str:
    """Rank-sum statistics per key from a relation with columns key, v."""
    return (f"rk AS (SELECT {key}, ({tcond}) AS is_t, rank() OVER (PARTITION BY {key} ORDER BY v) "
            f"+ (count(*) OVER (PARTITION BY {key}, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {key}, v) AS tc "
            f"FROM {src}),\n"
            f"mw0 AS (SELECT {key}, count(*) FILTER (WHERE is_t) AS n_t, count(*) FILTER (WHERE NOT is_t) AS n_c, "
            f"sum(r) FILTER (WHERE is_t) AS rs, sum(CAST(tc AS DOUBLE) * tc - 1) AS tie FROM rk GROUP BY {key}),\n"
            f"mw AS (SELECT {key}, rs - n_t * (n_t + 1) / 2.0 AS u_stat, "
            f"(greatest(rs - n_t * (n_t + 1) / 2.0, n_t * n_c - (rs - n_t * (n_t + 1) / 2.0)) - n_t * n_c / 2.0 - 0.5) / "
            f"nullif(sqrt(n_t * n_c / 12.0 * ((n_t + n_c + 1) - tie / ((n_t + n_c) * (n_t + n_c - 1.0)))), 0.0) AS z "
            f"FROM mw0)")


_E8_D = {"treatment_arr": 2, "control_arr": 2, "arr_lift_pct": 6, "treatment_win_rate": 6,
         "control_win_rate": 6, "win_rate_lift_pct": 6, "win_rate_chi2": 6, "u_stat": 2, "z": 6,
         "arr_p_value": 6, "win_rate_p_value": 6}


def _both_p_sql(final: str, win_rate_p: str) -> str:
    """The p-values of the rank test and of the win-rate chi-square, and their flags."""
    inner = f"SELECT *, {z_p_sql('z')} AS arr_p_value, {win_rate_p} AS win_rate_p_value FROM ({final}) AS stats"
    return (f"SELECT *, coalesce(arr_p_value < 0.05, FALSE) AS arr_significant, "
            f"coalesce(win_rate_p_value < 0.05, FALSE) AS win_rate_significant FROM ({inner}) AS tests")


def _e8_sql() -> str:
    body = (
        "opp AS (SELECT DISTINCT organization, opp_id, account_id, group_type, opp_arr, is_closed, is_won FROM analysis "
        "WHERE opp_id IS NOT NULL AND opp_arr > 0 AND opp_arr < 50000000 AND organization IS NOT NULL),\n"
        "g0 AS (SELECT organization, count(*) FILTER (WHERE group_type = 'Treatment') AS treatment_opps, "
        "count(*) FILTER (WHERE group_type = 'Control') AS control_opps, "
        "sum(opp_arr) FILTER (WHERE group_type = 'Treatment') AS treatment_arr, "
        "sum(opp_arr) FILTER (WHERE group_type = 'Control') AS control_arr, "
        "count(DISTINCT account_id) FILTER (WHERE group_type = 'Treatment') AS treatment_accounts, "
        "count(DISTINCT account_id) FILTER (WHERE group_type = 'Control') AS control_accounts, "
        "count(*) FILTER (WHERE group_type = 'Treatment' AND is_closed) AS t_closed, "
        "count(*) FILTER (WHERE group_type = 'Treatment' AND is_closed AND is_won) AS t_won, "
        "count(*) FILTER (WHERE group_type = 'Control' AND is_closed) AS c_closed, "
        "count(*) FILTER (WHERE group_type = 'Control' AND is_closed AND is_won) AS c_won "
        "FROM opp GROUP BY organization),\n"
        "g AS (SELECT * FROM g0 WHERE treatment_opps > 5 AND control_opps > 5),\n"
        "mwsrc AS (SELECT o.organization, o.opp_arr AS v, o.group_type FROM opp o WHERE o.organization IN (SELECT organization FROM g)),\n"
        + _mw_sql("mwsrc", "organization", "group_type = 'Treatment'"))
    twr = "coalesce(t_won / nullif(t_closed, 0), 0.0)"
    cwr = "coalesce(c_won / nullif(c_closed, 0), 0.0)"
    final = (
        "SELECT g.*, CASE WHEN control_accounts > 0 AND control_arr > 0 THEN "
        "(treatment_arr / treatment_accounts - control_arr / control_accounts) / (control_arr / control_accounts) * 100.0 "
        "ELSE 0.0 END AS arr_lift_pct, "
        f"{twr} AS treatment_win_rate, {cwr} AS control_win_rate, "
        f"coalesce(({twr} - {cwr}) / nullif({cwr}, 0) * 100.0, 0.0) AS win_rate_lift_pct, "
        "CASE WHEN t_closed > 0 AND c_closed > 0 THEN "
        + _chi2_sql("t_won", "t_closed - t_won", "c_won", "c_closed - c_won") + " END AS win_rate_chi2, "
        "mw.u_stat, mw.z FROM g LEFT JOIN mw ON g.organization = mw.organization")
    return q(body, _both_p_sql(final, f"CASE WHEN t_closed = 0 OR c_closed = 0 THEN 1.0 ELSE {z_p_sql('sqrt(win_rate_chi2)')} END"))


@register("e8_organization_lift", sql=_e8_sql(), doubles=_E8_D)
def q_org_lift(spark, d):
    """E-8/E-5/E-6/P-8: per organization, treated vs control opportunities: ARR/account lift,
    win-rate lift, Mann-Whitney z on ARR and chi-square on closed won/lost."""
    return O.segment_pipeline_lift(analysis(spark, d), "organization")


_E9_D = {"arr_per_account": 4, "control_arr_per_account": 4, "arr_lift_pct": 6, "win_rate": 6,
         "control_win_rate": 6, "win_rate_lift_pct": 6, "win_rate_chi2": 6, "u_stat": 2, "z": 6,
         "arr_p_value": 6, "win_rate_p_value": 6}


def _e9_sql() -> str:
    body = (
        "base AS (SELECT * FROM analysis WHERE opp_id IS NOT NULL AND opp_arr > 0 AND opp_arr < 50000000),\n"
        "tt AS (SELECT DISTINCT engagement_type, opp_id, account_id, opp_arr, is_closed, is_won FROM base "
        "WHERE group_type = 'Treatment' AND engagement_type IS NOT NULL),\n"
        "co AS (SELECT DISTINCT opp_id, account_id, opp_arr, is_closed, is_won FROM base WHERE group_type = 'Control'),\n"
        "cs AS (SELECT sum(opp_arr) / nullif(count(DISTINCT account_id), 0) AS capa, "
        "count(*) FILTER (WHERE is_closed) AS c_closed, count(*) FILTER (WHERE is_closed AND is_won) AS c_won FROM co),\n"
        "g0 AS (SELECT engagement_type, count(DISTINCT account_id) AS accounts, count(*) AS opportunities, "
        "sum(opp_arr) AS arr, count(*) FILTER (WHERE is_closed) AS t_closed, "
        "count(*) FILTER (WHERE is_closed AND is_won) AS t_won FROM tt GROUP BY engagement_type),\n"
        "g AS (SELECT * FROM g0 WHERE opportunities > 5),\n"
        "mwsrc AS (SELECT engagement_type, opp_arr AS v, 1 AS t FROM tt WHERE engagement_type IN (SELECT engagement_type FROM g) "
        "UNION ALL SELECT g.engagement_type, co.opp_arr AS v, 0 AS t FROM co CROSS JOIN g),\n"
        + _mw_sql("mwsrc", "engagement_type", "t = 1"))
    cwr = "coalesce(cs.c_won / nullif(cs.c_closed, 0), 0.0)"
    twr = "coalesce(t_won / nullif(t_closed, 0), 0.0)"
    final = (
        "SELECT g.engagement_type, g.accounts, g.opportunities, g.t_closed, g.t_won, "
        "g.arr / g.accounts AS arr_per_account, coalesce(cs.capa, 0.0) AS control_arr_per_account, "
        "CASE WHEN coalesce(cs.capa, 0.0) > 0 THEN (g.arr / g.accounts - cs.capa) / cs.capa * 100.0 ELSE 0.0 END AS arr_lift_pct, "
        f"{twr} AS win_rate, {cwr} AS control_win_rate, "
        f"CASE WHEN {cwr} > 0 THEN ({twr} - {cwr}) / {cwr} * 100.0 ELSE 0.0 END AS win_rate_lift_pct, "
        "CASE WHEN t_closed > 0 AND cs.c_closed > 0 THEN "
        + _chi2_sql("t_won", "t_closed - t_won", "cs.c_won", "cs.c_closed - cs.c_won") + " END AS win_rate_chi2, "
        "mw.u_stat, mw.z FROM g CROSS JOIN cs LEFT JOIN mw ON g.engagement_type = mw.engagement_type")
    return q(body, _both_p_sql(final, f"coalesce({z_p_sql('sqrt(win_rate_chi2)')}, 1.0)"))


@register("e9_type_lift_vs_control", sql=_e9_sql(), doubles=_E9_D)
def q_type_pipeline(spark, d):
    """E-9: each engagement type against the pooled control opportunities."""
    return O.type_pipeline_lift(analysis(spark, d))


@register("e11_effectiveness",
          sql=q("t AS (SELECT *, CASE WHEN is_security = 1 THEN 'Security' WHEN is_resiliency = 1 THEN 'Resiliency' "
                "ELSE 'Other' END AS product_category FROM analysis WHERE group_type = 'Treatment' "
                "AND opp_id IS NOT NULL AND engagement_type IS NOT NULL),\n"
                "g AS (SELECT engagement_type, product_category, count(DISTINCT account_id) AS accounts, "
                "count(*) AS opportunities, count(*) FILTER (WHERE is_closed) AS closed_opps, "
                "least(coalesce(count(*) FILTER (WHERE is_closed AND is_won) / nullif(count(*) FILTER (WHERE is_closed), 0), 0.0), 1.0) AS win_rate, "
                "avg(CAST(service_arr AS DOUBLE)) AS avg_arr, sum(CAST(service_arr AS DOUBLE)) AS total_arr, "
                "CASE WHEN GROUPING(product_category) = 0 THEN 'type_category' ELSE 'type' END AS level "
                "FROM t GROUP BY GROUPING SETS ((engagement_type), (engagement_type, product_category)))",
                "SELECT * FROM g WHERE level = 'type' OR product_category IN ('Security', 'Resiliency')"),
          doubles={"win_rate": 6, "avg_arr": 4, "total_arr": 2})
def q_effectiveness(spark, d):
    """E-11/P-15/A-17: effectiveness per type and per type x product category in one grouping-sets pass."""
    return O.effectiveness(analysis(spark, d))


@register("r4_stage_performance",
          sql=q("o AS (SELECT DISTINCT opp_id, account_id, stage_name, opp_arr, is_closed, is_won FROM analysis "
                "WHERE opp_id IS NOT NULL)",
                "SELECT stage_name, count(*) AS opportunities, count(DISTINCT account_id) AS accounts, "
                "sum(opp_arr) AS total_arr, coalesce(count(*) FILTER (WHERE is_closed AND is_won) / "
                "nullif(count(*) FILTER (WHERE is_closed), 0), 0.0) AS win_rate FROM o GROUP BY stage_name"),
          doubles={"total_arr": 2, "win_rate": 6})
def q_stage(spark, d):
    """R-4: opportunity performance by stage."""
    o = O.opportunity_grain(analysis(spark, d), ["opp_id", "account_id", "stage_name", "opp_arr",
                                                 "is_closed", "is_won"])
    closed = F.count_if(F.col("is_closed"))
    won = F.count_if(F.col("is_closed") & F.col("is_won"))
    return o.groupBy("stage_name").agg(
        F.count(F.lit(1)).alias("opportunities"), F.countDistinct("account_id").alias("accounts"),
        F.sum("opp_arr").alias("total_arr"), O.win_rate(closed, won, cap=False).alias("win_rate"))
