"""Revenue-lift family on the customer x month panel.

Panel preparation (coercion, category filling, segment IQR trimming),
customer cross-section, overall / segment / type lifts, top-N, wide report.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clean import coerce_numeric, fill_categories, remove_outliers_iqr
from ..operators.effects import lift_vs_common_control, two_sample_t
from ..operators.panel import cross_section
from ..session import cut_lineage
from .domain import OUTCOMES, Domain, with_domain
from .registry import register
from .sqlgen import first_by_sql, iqr_chain_sql, moments_sql, pooled_t_cols, t_p_sql, with_p_sql

CATS = ("segment", "phase", "region", "support_level", "organization")
REV = ("revenue", "security_revenue", "resiliency_revenue")
METRICS = OUTCOMES
NUM = OUTCOMES + ("adoption_score",)


def clean_panel(spark, d):
    """Panel with coerced outcomes and filled categories, written once."""
    p = Domain(spark, d).panel()
    p = coerce_numeric(p, NUM)
    p = fill_categories(p, CATS)
    # the trimming chain reads the panel once per column and once for the rows:
    # materialise it once (it is far smaller than the line items it comes from)
    return cut_lineage(p)


def trimmed(panel, factor=2.5):
    """Outliers trimmed per segment."""
    return remove_outliers_iqr(panel, REV, "segment", factor=factor, min_n=10)


def prepared_panel(spark, d, factor=2.5):
    """Coerce outcomes, fill categories, trim outliers per segment."""
    return trimmed(clean_panel(spark, d), factor)


def panel_xs(panel):
    return cross_section(panel, "account_id", NUM,
                         ("treated",) + CATS + ("event_type",), "period")


def customer_xs(spark, d, factor=2.5):
    return panel_xs(prepared_panel(spark, d, factor))


# ---- SQL side ---------------------------------------------------------------------
_P0 = ("p0 AS (SELECT account_id, period, event_date, event_type, treated, "
       + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in NUM) + ", "
       + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'Unknown') AS {c}" for c in CATS)
       + " FROM panel)")
_IQR, _CLEAN = iqr_chain_sql("p0", REV, "segment", 2.5, 10)
PREP_SQL = f"{_P0},\n{_IQR},\nclean AS (SELECT * FROM {_CLEAN})"
XS_SQL = (PREP_SQL + ",\nxs AS (SELECT account_id, "
          + ", ".join(f"avg({c}) AS {c}" for c in NUM) + ", "
          + ", ".join(f"{first_by_sql(c, 'period')} AS {c}"
                      for c in ("treated",) + CATS + ("event_type",))
          + " FROM clean GROUP BY account_id)")

_PANEL_D = {"revenue": 2, "security_revenue": 4, "resiliency_revenue": 4,
            "security_count": 6, "resiliency_count": 6, "adoption_score": 6}
_XS_D = {"revenue": 4, "security_revenue": 4, "resiliency_revenue": 4,
         "security_count": 6, "resiliency_count": 6, "adoption_score": 6}
_T_D = {"mean_t": 4, "mean_c": 4, "sd_t": 4, "sd_c": 4, "diff": 4, "lift_pct": 6, "t_stat": 6, "p_value": 6}
_T_COLS = ["metric", "n_t", "n_c", "mean_t", "mean_c", "sd_t", "sd_c", "diff", "lift_pct",
           "t_stat", "df", "p_value", "significant"]


@register("s3_engagement_panel",
          sql=with_domain("", "SELECT * FROM panel"),
          doubles={k: v for k, v in _PANEL_D.items() if not k.endswith("_count")}, texts=("period", "event_date"))
def q_panel(spark, d):
    """S-3/J-1/P-4: customer x month engagement panel joined to account attributes."""
    return Domain(spark, d).panel()


@register("c1_outlier_removal",
          sql=with_domain(PREP_SQL, "SELECT * FROM clean"),
          doubles=_PANEL_D, texts=("period", "event_date"))
def q_outliers(spark, d):
    """C-1/P-1/P-2: segment IQR trimming over three revenue columns in sequence."""
    return prepared_panel(spark, d)


@register("a1_customer_cross_section",
          sql=with_domain(XS_SQL, "SELECT * FROM xs"),
          doubles=_XS_D)
def q_cross_section(spark, d):
    """A-1: per customer mean outcomes and first non-null attributes."""
    return customer_xs(spark, d)


@register("e1_two_sample_ttest",
          sql=with_domain(XS_SQL + ",\nm AS (" + moments_sql("xs", "treated", METRICS) + ")",
                          with_p_sql(f"SELECT metric, n_t, n_c, mean_t, mean_c, {pooled_t_cols()} FROM m", t_p_sql())),
          doubles=_T_D)
def q_ttest(spark, d):
    """E-1: treated vs control pooled t test on the customer cross-section, all outcomes."""
    r = two_sample_t(customer_xs(spark, d), "treated", METRICS)
    return r.select(*_T_COLS)


@register("e3_segment_lift",
          sql=with_domain(XS_SQL + ",\nm AS (" + moments_sql("xs", "treated", METRICS, ["organization"]) + ")",
                          with_p_sql(f"SELECT organization, metric, n_t, n_c, mean_t, mean_c, {pooled_t_cols()} "
                                     "FROM m WHERE n_t >= 10 AND n_c >= 10", t_p_sql())),
          doubles=_T_D)
def q_segment_lift(spark, d):
    """E-3/A-11: lift per organization with at least 10 customers in each arm."""
    r = two_sample_t(customer_xs(spark, d), "treated", METRICS, by=["organization"],
                     min_n=10)
    return r.select("organization", *_T_COLS)


def _type_lift_sql() -> str:
    blocks_t, blocks_c = [], []
    for m in METRICS:
        blocks_t.append(
            f"SELECT event_type, '{m}' AS metric, count({m}) AS n_t, avg({m}) AS mean_t, "
            f"var_samp({m}) AS var_t FROM xs WHERE treated = 1 AND event_type IS NOT NULL GROUP BY event_type")
        blocks_c.append(
            f"SELECT '{m}' AS metric, count({m}) AS n_c, avg({m}) AS mean_c, var_samp({m}) AS var_c "
            f"FROM xs WHERE treated = 0")
    ctes = (XS_SQL + ",\ntm AS (" + "\nUNION ALL\n".join(blocks_t) + "),\ncm AS ("
            + "\nUNION ALL\n".join(blocks_c) + "),\nj AS (SELECT tm.*, cm.n_c, cm.mean_c, cm.var_c "
            "FROM tm JOIN cm ON tm.metric = cm.metric WHERE tm.n_t >= 5 AND cm.mean_c > 0)")
    return with_domain(ctes, with_p_sql(f"SELECT event_type, metric, n_t, n_c, mean_t, mean_c, {pooled_t_cols()} FROM j", t_p_sql()))


@register("e4_type_lift", sql=_type_lift_sql(), doubles=_T_D)
def q_type_lift(spark, d):
    """E-4: each first-engagement type (>= 5 customers) against the common control."""
    r = lift_vs_common_control(customer_xs(spark, d), "treated", "event_type", METRICS,
                               min_n=5)
    return r.select("event_type", *_T_COLS)


@register("d8_top_segments",
          sql=with_domain(XS_SQL + ",\nm AS (" + moments_sql("xs", "treated", ["revenue"], ["organization"]) + ")",
                          "SELECT organization, n_t, n_c, lift_pct FROM ("
                          f"SELECT organization, n_t, n_c, {pooled_t_cols()} FROM m WHERE n_t >= 10 AND n_c >= 10) "
                          "ORDER BY lift_pct DESC NULLS LAST, organization LIMIT 10"),
          doubles={"lift_pct": 6})
def q_top_segments(spark, d):
    """D-8: top 10 organizations by revenue lift (a top-k report)."""
    r = two_sample_t(customer_xs(spark, d), "treated", ["revenue"], by=["organization"],
                     min_n=10, with_p=False)
    return (r.orderBy(F.col("lift_pct").desc_nulls_last(), "organization").limit(10)
            .select("organization", "n_t", "n_c", "lift_pct"))


@register("r5_segment_wide",
          sql=with_domain(XS_SQL + ",\nm AS (" + moments_sql("xs", "treated", METRICS, ["organization"]) + "),\n"
                          f"t AS (SELECT organization, metric, n_t, n_c, {pooled_t_cols()} FROM m WHERE n_t >= 10 AND n_c >= 10)",
                          "SELECT organization, max(n_t) AS treatment_accounts, max(n_c) AS control_accounts, "
                          + ", ".join(f"max(lift_pct) FILTER (WHERE metric = '{m}') AS {m}_lift_pct" for m in METRICS)
                          + " FROM t GROUP BY organization"),
          doubles={f"{m}_lift_pct": 6 for m in METRICS})
def q_segment_wide(spark, d):
    """R-5: wide per-organization table with one lift column per metric."""
    r = two_sample_t(customer_xs(spark, d), "treated", METRICS, by=["organization"],
                     min_n=10, with_p=False)
    wide = (r.groupBy("organization").pivot("metric", list(METRICS))
            .agg(F.first("lift_pct")))
    counts = r.groupBy("organization").agg(F.max("n_t").alias("treatment_accounts"),
                                           F.max("n_c").alias("control_accounts"))
    return counts.join(wide, "organization").select(
        "organization", "treatment_accounts", "control_accounts",
        *[F.col(m).alias(f"{m}_lift_pct") for m in METRICS])
