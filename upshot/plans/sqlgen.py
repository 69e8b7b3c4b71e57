"""Text builders for the DuckDB oracle queries (the independent check).

These only generate SQL strings; nothing here runs on Spark.
"""

from __future__ import annotations

from collections.abc import Sequence


def moments_sql(src: str, arm: str, metrics: Sequence[str], by: Sequence[str] = (),
                where: str = "TRUE", treated_value: str = "1") -> str:
    """UNION ALL of per-metric conditional moments (one block per metric)."""
    keys = ", ".join(by)
    sel_keys = f"{keys}, " if by else ""
    grp = f"GROUP BY {keys}" if by else ""
    blocks = []
    for m in metrics:
        t = f"{arm} = {treated_value}"
        c = f"{arm} <> {treated_value} AND {arm} IS NOT NULL"
        blocks.append(
            f"SELECT {sel_keys}'{m}' AS metric, "
            f"count(CAST({m} AS DOUBLE)) FILTER (WHERE {t}) AS n_t, "
            f"avg(CAST({m} AS DOUBLE)) FILTER (WHERE {t}) AS mean_t, "
            f"var_samp(CAST({m} AS DOUBLE)) FILTER (WHERE {t}) AS var_t, "
            f"count(CAST({m} AS DOUBLE)) FILTER (WHERE {c}) AS n_c, "
            f"avg(CAST({m} AS DOUBLE)) FILTER (WHERE {c}) AS mean_c, "
            f"var_samp(CAST({m} AS DOUBLE)) FILTER (WHERE {c}) AS var_c "
            f"FROM {src} WHERE {where} {grp}")
    return "\nUNION ALL\n".join(blocks)


def pooled_t_cols(prefix: str = "") -> str:
    """Columns of the pooled two-sample t test over a moments relation."""
    p = prefix
    ss = f"(({p}n_t - 1) * coalesce({p}var_t, 0.0) + ({p}n_c - 1) * coalesce({p}var_c, 0.0))"
    dof = f"({p}n_t + {p}n_c - 2)"
    sp2 = f"({ss} / nullif({dof}, 0))"
    se = f"sqrt({sp2} * (1.0 / nullif({p}n_t, 0) + 1.0 / nullif({p}n_c, 0)))"
    return (f"sqrt({p}var_t) AS sd_t, sqrt({p}var_c) AS sd_c, "
            f"{p}mean_t - {p}mean_c AS diff, "
            f"{lift_sql(p + 'mean_t', p + 'mean_c')} AS lift_pct, "
            f"({p}mean_t - {p}mean_c) / nullif({se}, 0.0) AS t_stat, "
            f"CAST({dof} AS BIGINT) AS df")


def lift_sql(t: str, c: str) -> str:
    return f"coalesce(({t} - {c}) / nullif({c}, 0) * 100.0, 0.0)"


def first_by_sql(col: str, order: str) -> str:
    return f"arg_min({col}, {order}) FILTER (WHERE {col} IS NOT NULL)"


def fill_unknown(col: str) -> str:
    return f"coalesce(CAST({col} AS VARCHAR), 'Unknown')"


def iqr_chain_sql(src: str, cols: Sequence[str], segment: str, factor: float = 2.5,
                  min_n: int = 10, prefix: str = "iqr") -> tuple[str, str]:
    """CTEs removing IQR outliers column after column; returns (ctes, last)."""
    ctes, cur = [], src
    for i, c in enumerate(cols):
        st, nxt = f"{prefix}_s{i}", f"{prefix}_c{i}"
        ctes.append(
            f"{st} AS (SELECT {segment} AS seg, count(*) AS n, quantile_cont({c}, 0.25) AS q1, "
            f"quantile_cont({c}, 0.75) AS q3 FROM {cur} WHERE {segment} IS NOT NULL GROUP BY {segment})")
        ctes.append(
            f"{nxt} AS (SELECT x.* FROM {cur} x LEFT JOIN {st} s ON x.{segment} = s.seg "
            f"AND s.n > {min_n} AND s.q3 - s.q1 > 0 "
            f"WHERE s.seg IS NULL OR (x.{c} >= s.q1 - {factor} * (s.q3 - s.q1) "
            f"AND x.{c} <= s.q3 + {factor} * (s.q3 - s.q1)))")
        cur = nxt
    return ",\n".join(ctes), cur


def growth_sql(src: str, unit: str, event: str, metrics: Sequence[str], pre: int, post: int,
               min_rows: int, extra_keys: Sequence[str] = ()) -> str:
    """Per (unit, metric) pre/post compound growth (UNION ALL over metrics)."""
    ek = "".join(f"{k}, " for k in extra_keys)
    blocks = []
    for m in metrics:
        pre_c = f"period >= ({event}) - INTERVAL {pre} MONTH AND period < ({event})"
        post_c = f"period >= ({event}) AND period < ({event}) + INTERVAL {post} MONTH"
        parts = []
        for tag, c in (("pre", pre_c), ("post", post_c)):
            pos = f"{c} AND {m} > 0"
            parts.append(
                f"count(*) FILTER (WHERE {c}) AS {tag}_months, "
                f"count(*) FILTER (WHERE {pos}) AS {tag}_k, "
                f"arg_min(CAST({m} AS DOUBLE), period) FILTER (WHERE {pos}) AS {tag}_first, "
                f"arg_max(CAST({m} AS DOUBLE), period) FILTER (WHERE {pos}) AS {tag}_last")
        blocks.append(f"SELECT {ek}{unit}, '{m}' AS metric, count(*) AS rows_n, "
                      f"CAST(min({event}) AS DATE) AS event_date, {', '.join(parts)} "
                      f"FROM {src} GROUP BY {ek}{unit}")
    inner = "\nUNION ALL\n".join(blocks)
    cm = lambda t: f"CASE WHEN {t}_k >= 2 THEN pow({t}_last / {t}_first, 1.0 / ({t}_k - 1)) - 1.0 END"
    return (f"SELECT {ek}{unit}, metric, event_date, {cm('pre')} AS pre_cmgr, {cm('post')} AS post_cmgr, "
            f"{cm('post')} - {cm('pre')} AS cmgr_acceleration, pre_months, post_months "
            f"FROM ({inner}) WHERE rows_n >= {min_rows} AND {cm('pre')} IS NOT NULL AND {cm('post')} IS NOT NULL")


def t_p_sql(stat: str = "t_stat", dof: str = "df", steps: int = 8000) -> str:
    """Two-sided tail of Student's t: Simpson's rule on the density after
    t = sqrt(df) tan(a), where it is a power of the cosine."""
    start = f"atan(abs({stat}) / sqrt({dof}))"
    step = f"((least(pi() / 2, {start} + 45.0 / sqrt({dof})) - {start}) / {steps})"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    total = (f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * "
             f"pow(greatest(cos({start} + i * {step}), 0.0), {dof} - 1.0)))")
    return (f"CASE WHEN {stat} IS NULL OR {dof} <= 0 THEN NULL ELSE least(1.0, 2.0 * exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) "
            f"/ sqrt(pi()) * {step} / 3.0 * {total}) END")


def z_p_sql(stat: str = "z", steps: int = 4000) -> str:
    """Two-sided tail of the normal distribution by Simpson's rule."""
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    total = (f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * "
             f"exp(-pow(abs({stat}) + i * 40.0 / {steps}, 2) / 2.0)))")
    return f"CASE WHEN {stat} IS NULL THEN NULL ELSE least(1.0, 2.0 / sqrt(2.0 * pi()) * (40.0 / {steps}) / 3.0 * {total}) END"


def chi2_p_sql(stat: str = "chi2", dof: str = "dof", steps: int = 8000) -> str:
    """Upper tail of the chi-square distribution: Simpson's rule on the density of its root."""
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    u = f"(sqrt({stat}) + i * 40.0 / {steps})"
    total = (f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * "
             f"CASE WHEN {dof} = 1 THEN exp(-{u} * {u} / 2.0) ELSE pow({u}, {dof} - 1.0) * exp(-{u} * {u} / 2.0) END))")
    return (f"CASE WHEN {stat} IS NULL OR {dof} <= 0 THEN NULL ELSE least(1.0, pow(2.0, 1.0 - {dof} / 2.0) * exp(-lgamma({dof} / 2.0)) "
            f"* (40.0 / {steps}) / 3.0 * {total}) END")


def with_p_sql(final: str, p: str, flag: bool = True) -> str:
    """``final`` with its p-value and, if wanted, the 5 % significance flag."""
    inner = f"SELECT *, {p} AS p_value FROM ({final}) AS stats"
    return f"SELECT *, coalesce(p_value < 0.05, FALSE) AS significant FROM ({inner}) AS tests" if flag else inner
