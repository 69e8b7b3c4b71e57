"""Column expressions for cleaning, flags and derived measures (P-1 .. P-21).

All of these are built-in Spark expressions, so they stay inside whole-stage
code generation; none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c, default: float = 0.0) -> Column:
    """P-1: unparsable or null -> ``default`` (0), as double."""
    return F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(float(default)))


def clean_category(c, fill: str = UNKNOWN) -> Column:
    """P-2: null (or the literal text 'nan') -> 'Unknown'."""
    s = _c(c).cast("string")
    return F.when(s.isNull() | (s == "nan"), F.lit(fill)).otherwise(s)


def to_flag(c) -> Column:
    """P-3: 't'/'true'/'1' (any case) -> true; other non-null -> false."""
    s = F.lower(F.trim(_c(c).cast("string")))
    return F.when(s.isNull(), F.lit(None).cast("boolean")).otherwise(s.isin("t", "true", "1", "y", "yes"))


def flag_from_date(c) -> Column:
    """P-4: treated when the event date is present."""
    return _c(c).isNotNull().cast("int")


def flag_from_label(c, label: str = "Treatment") -> Column:
    """P-5: treated when the group label equals ``label``."""
    return F.coalesce((_c(c) == F.lit(label)).cast("int"), F.lit(0))


def in_range(c, lo=None, hi=None, inclusive: bool = False) -> Column:
    """P-8: open (default) or closed range predicate."""
    x = _c(c)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((x >= lo) if inclusive else (x > lo))
    if hi is not None:
        cond = cond & ((x <= hi) if inclusive else (x < hi))
    return cond


# Size bucket thresholds used by the cohort template (fixed values).
SIZE_BUCKETS = ((100000, "Small"), (1000000, "Medium"), (10000000, "Large"))
SIZE_TOP = "Enterprise"


def size_bucket(c, null_label: str | None = UNKNOWN) -> Column:
    """P-9: Small < 100k <= Medium < 1M <= Large < 10M <= Enterprise.

    The template lets NULL fall through to the top bucket; by default NULL gets
    its own ``Unknown`` label (pass ``null_label=None`` for the template rule).
    """
    x = _c(c)
    e = None
    for bound, label in SIZE_BUCKETS:
        e = F.when(x < bound, label) if e is None else e.when(x < bound, label)
    e = e.otherwise(SIZE_TOP)
    if null_label is not None:
        e = F.when(x.isNull(), F.lit(null_label)).otherwise(e)
    return e


def in_list(c, values) -> Column:
    """P-10: exact-name membership flag as 0/1."""
    return F.coalesce(_c(c).isin(list(values)).cast("int"), F.lit(0))


def contains_any(c, needles) -> Column:
    """P-11: 1 when the text contains any of the substrings."""
    s = F.coalesce(_c(c).cast("string"), F.lit(""))
    cond = F.lit(False)
    for n in needles:
        cond = cond | s.contains(n)
    return cond.cast("int")


def either_flag(a, b) -> Column:
    """P-12: 1 when either 0/1 flag is 1."""
    return F.when((_c(a) == 1) | (_c(b) == 1), 1).otherwise(0)


def engagement_category(direct, attributed) -> Column:
    """P-13: Direct > Attributed > Other."""
    return (F.when(_c(direct) == 1, "Direct")
            .when(_c(attributed) == 1, "Attributed").otherwise("Other"))


def attribution_flag(attributed, direct, engagement_id) -> Column:
    """P-14: attributed, or not direct but engaged."""
    return (F.when(_c(attributed) == 1, 1)
            .when((_c(direct) == 0) & _c(engagement_id).isNotNull(), 1).otherwise(0))


def product_category(security, resiliency) -> Column:
    """P-15: Security > Resiliency > Other."""
    return (F.when(_c(security) == 1, "Security")
            .when(_c(resiliency) == 1, "Resiliency").otherwise("Other"))


def default_text(c, value: str = "Basic") -> Column:
    """P-16: null -> default text."""
    return F.coalesce(_c(c), F.lit(value))


def add_months(c, months) -> Column:
    """P-17: month offset on a date; month ends clamp (Aug 31 - 6 = Feb 29)."""
    m = months if isinstance(months, Column) else F.lit(int(months))
    return F.add_months(_c(c).cast("date"), m)


def lift_pct(treat, control) -> Column:
    """P-18: (t - c) / c * 100, 0 when the control value is 0 or missing."""
    return F.coalesce(lift_pct_raw(treat, control), F.lit(0.0))


def lift_pct_raw(treat, control) -> Column:
    """P-18 without the zero fill: null when the control value is 0."""
    t, c = _c(treat), _c(control)
    return F.try_divide(t - c, F.nullif(c, F.lit(0))) * 100.0


def stars(p) -> Column:
    """P-19: significance stars at .001 / .01 / .05."""
    x = _c(p)
    return (F.when(x < 0.001, "***").when(x < 0.01, "**")
            .when(x < 0.05, "*").otherwise(""))


def annualise(rate) -> Column:
    """P-20: (1 + r)^12 - 1."""
    return F.pow(F.lit(1.0) + _c(rate), F.lit(12.0)) - 1.0


def money(c) -> Column:
    """P-21: decimal(18,2) money."""
    return _c(c).cast("decimal(18,2)")


def uniform(seed, *keys) -> Column:
    """Reproducible pseudo-random number in [0, 1) from md5(seed | keys).

    The first 8 hex digits of the digest divided by 2^32; the same value is
    obtainable in any SQL engine with md5, so sampled cohorts can be checked
    independently.
    """
    parts = [F.lit(str(seed))] + [_c(k).cast("string") for k in keys]
    h = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed, *keys: str) -> str:
    """The DuckDB expression equal to :func:`uniform` (for oracle SQL)."""
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(CAST(('0x' || substr(md5({inner}), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0)"
