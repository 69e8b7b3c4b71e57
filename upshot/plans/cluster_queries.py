"""Clustering-based control-group queries (K-1 .. K-13, E-18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as K
from ..session import cut_lineage
from .domain import Domain
from ..operators.effects import add_t_pvalue, arm_moments, pooled_t
from ..operators.ranks import mann_whitney
from .opportunity_queries import _mw_sql, account_features, features_sql_parts, q
from .registry import register
from .sqlgen import moments_sql, pooled_t_cols, t_p_sql, with_p_sql, z_p_sql

ENCODED = ("segment", "phase", "industry", "organization")
NUMERIC = ("real_total_arr", "total_opportunities", "won_opportunities",
                      "closed_opportunities", "has_security", "has_resiliency", "product_diversity")


def clustering_input(spark, d):
    """K-1/K-2/K-3/K-4: account features + encoded attributes, robust-scaled and assembled."""
    f = account_features(spark, d)
    acc = Domain(spark, d).accounts().select("account_id", "segment", "phase",
                                             F.col("region").alias("industry"), "organization")
    x = (f.join(acc, "account_id", "inner")
         .withColumn("treated", (F.col("group_type") == "Treatment").cast("int")))
    x = K.label_encode(x, ENCODED)
    products = [c for c in f.columns if c not in {"account_id", "group_type", *NUMERIC}]
    features = [*products, *NUMERIC, *[f"{c}_encoded" for c in ENCODED]]
    x = K.robust_scale(x, features, suffix="_s")
    return K.assemble(x, [f"{c}_s" for c in features])


def sweep(spark, d):
    x = cut_lineage(clustering_input(spark, d))
    scores, best = K.cluster_sweep(x, "treated")
    return x, scores, best


def _scaled_sql() -> str:
    body, final = features_sql_parts()
    enc = ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_encoded" for c in ENCODED)
    cols = ("real_total_arr", "product_diversity")
    qs = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) AS q_{c}" for c in cols)
    scaled = ", ".join(f"(CAST(fx.{c} AS DOUBLE) - qq.q_{c}[2]) / coalesce(nullif(qq.q_{c}[3] - qq.q_{c}[1], 0), 1.0) "
                       f"AS {c}_s" for c in cols)
    body = (body + ",\nfeat AS (" + final + "),\n"
            "fx AS (SELECT feat.account_id, a.segment, a.phase, a.region AS industry, a.organization, "
            "feat.real_total_arr, feat.product_diversity FROM feat JOIN accounts a ON feat.account_id = a.account_id),\n"
            f"qq AS (SELECT {qs} FROM fx)")
    return q(body, f"SELECT fx.account_id, {enc}, {scaled} FROM fx CROSS JOIN qq")


@register("k2_k3_scaled_features", sql=_scaled_sql(),
          doubles={"real_total_arr_s": 6, "product_diversity_s": 6})
def q_scaled(spark, d):
    """K-2/K-3: sorted-label codes of the categorical attributes and median/IQR scaling."""
    x = clustering_input(spark, d)
    return x.select("account_id", *[f"{c}_encoded" for c in ENCODED], "real_total_arr_s",
                    "product_diversity_s")


@register("k5_k10_cluster_selection", doubles={"silhouette": 6, "calinski_harabasz": 4,
                                               "avg_balance_ratio": 6, "composite": 6})
def q_selection(spark, d):
    """K-5..K-10: k-means (best of 10 starts) and bisecting k-means for k = 3..7 with silhouette,
    Calinski-Harabasz, arm balance and the composite selection score."""
    return sweep(spark, d)[1]


def _best(spark, d):
    x, scores, best = sweep(spark, d)
    if best is None:
        # Q-20: no valid configuration -> typed result with a null cluster
        return x.withColumn("cluster", F.lit(None).cast("int"))
    return best


@register("k11_cluster_profile", doubles={"avg_product_diversity": 6, "treatment_ratio": 6,
                                          "balance_ratio": 6})
def q_profile(spark, d):
    """K-11/A-12: profile of the selected clustering."""
    p = _best(spark, d)
    return K.cluster_profile(p, "treated").withColumn("security_accounts", F.col("security_accounts").cast("long")) \
        .withColumn("resiliency_accounts", F.col("resiliency_accounts").cast("long"))


@register("k12_e18_within_cluster_tests", doubles={"mean_t": 4, "mean_c": 4, "sd_t": 4, "sd_c": 4,
                                                   "diff": 4, "lift_pct": 6, "t_stat": 6,
                                                   "p_value": 6, "var_t": 4, "var_c": 4})
def q_within(spark, d):
    """K-12/E-18: product-diversity difference between arms inside each valid cluster."""
    p = _best(spark, d)
    valid = K.cluster_balance(p, "treated")
    return K.within_cluster_tests(p, "treated", "product_diversity", valid)


@register("k13_pca", doubles={"pc1": 6, "pc2": 6, "explained_1": 6, "explained_2": 6})
def q_pca(spark, d):
    """K-13: 2-D PCA projection of the scaled features with explained-variance ratios."""
    p = _best(spark, d)
    out, ev = K.pca_2d(p.select("account_id", "treated", "cluster", "features"))
    return (out.withColumn("explained_1", F.lit(ev[0])).withColumn("explained_2", F.lit(ev[1])))


def _rule_sql() -> str:
    body, final = features_sql_parts()
    body = (body + ",\nfeat AS (" + final + "),\n"
            "fx AS (SELECT feat.*, least(feat.product_diversity, 4) AS cluster, a.segment, a.region AS industry, "
            "CAST(feat.group_type = 'Treatment' AS INTEGER) AS treated FROM feat JOIN accounts a ON feat.account_id = a.account_id),\n"
            "sm AS (SELECT cluster, segment, count(*) AS n FROM fx GROUP BY cluster, segment),\n"
            "im AS (SELECT cluster, industry, count(*) AS n FROM fx GROUP BY cluster, industry),\n"
            "g AS (SELECT cluster, count(*) AS total_accounts, count(*) FILTER (WHERE treated = 1) AS treatment_accounts, "
            "count(*) FILTER (WHERE treated = 0) AS control_accounts, CAST(sum(has_security) AS BIGINT) AS security_accounts, "
            "CAST(sum(has_resiliency) AS BIGINT) AS resiliency_accounts, avg(product_diversity) AS avg_product_diversity "
            "FROM fx GROUP BY cluster)")
    final = ("SELECT g.*, g.treatment_accounts / g.total_accounts AS treatment_ratio, "
             "coalesce(least(g.treatment_accounts, g.control_accounts) / nullif(greatest(g.treatment_accounts, g.control_accounts), 0), 0.0) AS balance_ratio, "
             "(SELECT arg_min(segment, (-n, segment)) FROM sm WHERE sm.cluster = g.cluster) AS top_segment, "
             "(SELECT arg_min(industry, (-n, industry)) FROM im WHERE im.cluster = g.cluster) AS top_industry FROM g")
    return q(body, final)


def _rule_rows_sql() -> str:
    body, final = features_sql_parts()
    return (body + ",\nfeat AS (" + final + "),\n"
            "fx AS (SELECT feat.account_id, least(feat.product_diversity, 4) AS cluster, CAST(feat.group_type = 'Treatment' AS INTEGER) AS treated, "
            "feat.real_total_arr, least(coalesce(feat.won_opportunities / nullif(feat.closed_opportunities, 0), 0.0), 1.0) AS win_rate FROM feat),\n"
            "bal AS (SELECT cluster, count(*) AS total_accounts, count(*) FILTER (WHERE treated = 1) AS treatment_accounts, "
            "count(*) FILTER (WHERE treated = 0) AS control_accounts FROM fx GROUP BY cluster),\n"
            "rb AS (SELECT *, treatment_accounts / total_accounts AS treatment_ratio, control_accounts / total_accounts AS control_ratio, "
            "coalesce(least(treatment_accounts, control_accounts) / nullif(greatest(treatment_accounts, control_accounts), 0), 0.0) AS balance_ratio FROM bal),\n"
            "vb AS (SELECT *, total_accounts >= 10 AND balance_ratio >= 0.3 AND treatment_accounts > 0 AND control_accounts > 0 AS is_valid FROM rb)")


def rule_clusters(spark, d):
    """Accounts with a cluster fixed by a rule: product diversity capped at 4."""
    f = account_features(spark, d)
    rate = F.least(F.coalesce(F.try_divide(F.col("won_opportunities").cast("double"), F.col("closed_opportunities")), F.lit(0.0)), F.lit(1.0))
    return cut_lineage(f.select("account_id", F.least(F.col("product_diversity"), F.lit(4)).alias("cluster"), "real_total_arr",
                                (F.col("group_type") == "Treatment").cast("int").alias("treated"), rate.alias("win_rate")))


@register("k9_rule_balance", sql=q(_rule_rows_sql(), "SELECT * FROM vb"),
          doubles={"treatment_ratio": 6, "control_ratio": 6, "balance_ratio": 6})
def q_rule_balance(spark, d):
    """K-9: arm balance and validity of clusters fixed by a rule."""
    return K.cluster_balance(rule_clusters(spark, d), "treated")


def _within_sql() -> str:
    body = (_rule_rows_sql() + ",\nvx AS (SELECT * FROM fx WHERE cluster IN (SELECT cluster FROM vb WHERE is_valid)),\n"
            "m AS (" + moments_sql("vx", "treated", ["real_total_arr", "win_rate"], ["cluster"]) + "),\n"
            "mwsrc AS (SELECT cluster || ':real_total_arr' AS k, real_total_arr AS v, treated FROM vx UNION ALL "
            "SELECT cluster || ':win_rate', win_rate, treated FROM vx),\n" + _mw_sql("mwsrc", "k", "treated = 1"))
    tested = with_p_sql(f"SELECT cluster, metric, n_t, n_c, mean_t, mean_c, {pooled_t_cols()} FROM m", t_p_sql())
    return q(body, f"SELECT w.*, mw.u_stat, {z_p_sql('mw.z')} AS rank_p_value FROM ({tested}) AS w "
                   "LEFT JOIN mw ON mw.k = w.cluster || ':' || w.metric")


@register("e18_within_cluster_lift", sql=_within_sql(),
          doubles={"mean_t": 4, "mean_c": 4, "sd_t": 4, "sd_c": 4, "diff": 4, "lift_pct": 6, "t_stat": 6, "p_value": 6,
                   "u_stat": 1, "rank_p_value": 6})
def q_within_lift(spark, d):
    """E-18: ARR and win-rate lift, t test and Mann-Whitney U inside each valid cluster (rule labels)."""
    x = rule_clusters(spark, d)
    valid = K.cluster_balance(x, "treated").where("is_valid").select("cluster")
    v = cut_lineage(x.join(valid, "cluster", "left_semi"))
    metrics = ["real_total_arr", "win_rate"]
    t = add_t_pvalue(pooled_t(arm_moments(v, "treated", metrics, ["cluster"])))
    long = v.select("cluster", "treated", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("s")).select("cluster", "treated", "s.*")
    u = mann_whitney(long, "treated", "v", ["cluster", "metric"]).select("cluster", "metric", "u_stat", F.col("p_value").alias("rank_p_value"))
    return t.join(u, ["cluster", "metric"], "left").select("cluster", "metric", "n_t", "n_c", "mean_t", "mean_c", "sd_t", "sd_c", "diff",
                                                           "lift_pct", "t_stat", "df", "p_value", "significant", "u_stat", "rank_p_value")


_POINTS = ("pt AS (SELECT account_id, cluster, treated, CAST(real_total_arr AS DOUBLE) / 1e6 AS x, win_rate AS y FROM fx),\n"
           "cl AS (SELECT cluster, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS q FROM pt GROUP BY cluster)")


def _scores_sql() -> str:
    body = (_rule_rows_sql() + ",\n" + _POINTS + ",\n"
            "ds AS (SELECT p.account_id, p.cluster = c.cluster AS own, c.n, p.x * p.x + p.y * p.y + c.q / c.n - 2 * (p.x * c.sx + p.y * c.sy) / c.n AS m FROM pt p CROSS JOIN cl c),\n"
            "ab AS (SELECT account_id, max(n) FILTER (WHERE own) AS n, max(CASE WHEN n > 1 THEN m * n / (n - 1) ELSE m END) FILTER (WHERE own) AS a, "
            "min(m) FILTER (WHERE NOT own) AS b FROM ds GROUP BY account_id),\n"
            "sc AS (SELECT (SELECT avg(CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END) FROM ab) AS silhouette, "
            "(sum((sx * sx + sy * sy) / n) - (pow(sum(sx), 2) + pow(sum(sy), 2)) / sum(n)) / (count(*) - 1) / "
            "(sum(q - (sx * sx + sy * sy) / n) / (sum(n) - count(*))) AS calinski_harabasz FROM cl),\n"
            "vl AS (SELECT count(*) FILTER (WHERE is_valid) AS valid_clusters, coalesce(avg(balance_ratio) FILTER (WHERE is_valid), 0.0) AS avg_balance_ratio FROM vb)")
    return q(body, "SELECT silhouette, calinski_harabasz, valid_clusters, avg_balance_ratio, "
                   "0.7 * avg_balance_ratio + 0.3 * (silhouette + calinski_harabasz / 1000.0) / 2.0 AS composite FROM sc, vl")


def rule_points(spark, d):
    x = rule_clusters(spark, d)
    return cut_lineage(K.assemble(x.withColumn("x", F.col("real_total_arr").cast("double") / 1e6).withColumn("y", F.col("win_rate")), ["x", "y"]))


@register("k8_k10_rule_scores", sql=_scores_sql(),
          doubles={"silhouette": 6, "calinski_harabasz": 4, "avg_balance_ratio": 6, "composite": 6})
def q_rule_scores(spark, d):
    """K-7/K-8/K-10: silhouette, Calinski-Harabasz and composite score of the rule clusters over (ARR, win rate)."""
    x = rule_points(spark, d)
    found = K.score_labels(x, ["cluster"])["cluster"]
    valid = K.cluster_balance(x, "treated").agg(F.count_if("is_valid").alias("valid_clusters"),
                                                F.coalesce(F.avg(F.when(F.col("is_valid"), F.col("balance_ratio"))), F.lit(0.0)).alias("avg_balance_ratio"))
    s, c = found["silhouette"], found["calinski_harabasz"]
    return valid.select(F.lit(s).alias("silhouette"), F.lit(c).alias("calinski_harabasz"), "valid_clusters", "avg_balance_ratio",
                        (F.col("avg_balance_ratio") * 0.7 + F.lit(0.3 * (s + c / 1000.0) / 2.0)).alias("composite"))


@register("k12_rule_within_tests",
          sql=q(_rule_rows_sql() + ",\nvx AS (SELECT * FROM fx WHERE cluster IN (SELECT cluster FROM vb WHERE is_valid)),\n"
                "m AS (" + moments_sql("vx", "treated", ["real_total_arr"], ["cluster"]) + ")",
                with_p_sql(f"SELECT cluster, metric, n_t, n_c, mean_t, mean_c, {pooled_t_cols()} FROM m", t_p_sql())),
          doubles={"mean_t": 4, "mean_c": 4, "sd_t": 4, "sd_c": 4, "diff": 4, "lift_pct": 6, "t_stat": 6, "p_value": 6})
def q_rule_within(spark, d):
    """K-12: ARR difference between arms inside each valid rule cluster."""
    x = rule_clusters(spark, d)
    r = K.within_cluster_tests(x, "treated", "real_total_arr", K.cluster_balance(x, "treated"))
    return r.select("cluster", "metric", "n_t", "n_c", "mean_t", "mean_c", "sd_t", "sd_c", "diff", "lift_pct", "t_stat", "df", "p_value", "significant")


@register("k13_rule_pca",
          sql=q(_rule_rows_sql() + ",\n" + _POINTS.split(",\ncl AS")[0] + ",\n"
                "cv AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM pt),\n"
                "ev AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM cv),\n"
                "ax AS (SELECT *, b / sqrt(b * b + pow(l1 - a, 2)) AS u, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS v FROM ev),\n"
                # the second axis is (-v, u); the part of larger size is made positive
                "sg AS (SELECT *, sign(CASE WHEN abs(u) > abs(v) THEN u ELSE v END) AS s1, sign(CASE WHEN abs(u) > abs(v) THEN u ELSE -v END) AS s2 FROM ax)",
                "SELECT account_id, s1 * (u * (x - mx) + v * (y - my)) AS pc1, s2 * (u * (y - my) - v * (x - mx)) AS pc2, "
                "l1 / (l1 + l2) AS explained_1, l2 / (l1 + l2) AS explained_2 FROM pt, sg"),
          doubles={"pc1": 6, "pc2": 6, "explained_1": 6, "explained_2": 6})
def q_rule_pca(spark, d):
    """K-13: projection of (ARR, win rate) on their principal axes, the largest loading of each positive."""
    out, shares = K.pca_2d(rule_points(spark, d).select("account_id", "features"))
    return out.withColumn("explained_1", F.lit(shares[0])).withColumn("explained_2", F.lit(shares[1]))


@register("k9_k11_rule_clusters", sql=_rule_sql(),
          doubles={"avg_product_diversity": 6, "treatment_ratio": 6, "balance_ratio": 6})
def q_rule_clusters(spark, d):
    """K-9/K-11/A-12 on clusters fixed by a rule (product diversity capped at 4), so the
    balance and profile arithmetic is checked independently of the clustering."""
    f = account_features(spark, d)
    acc = Domain(spark, d).accounts().select("account_id", "segment", F.col("region").alias("industry"))
    x = (f.join(acc, "account_id").withColumn("treated", (F.col("group_type") == "Treatment").cast("int"))
         .withColumn("cluster", F.least(F.col("product_diversity"), F.lit(4))))
    p = K.cluster_profile(x, "treated")
    return p.withColumn("security_accounts", F.col("security_accounts").cast("long")) \
            .withColumn("resiliency_accounts", F.col("resiliency_accounts").cast("long"))
