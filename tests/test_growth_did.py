import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from upshot.operators import did as DD
from upshot.operators import growth as G


def _months(start, n):
    y, m = start
    out = []
    for _ in range(n):
        out.append(dt.date(y, m, 1))
        m += 1
        if m == 13:
            y, m = y + 1, 1
    return out


def _cmgr(vals):
    v = [x for x in vals if x > 0]
    if len(v) < 2:
        return None
    return (v[-1] / v[0]) ** (1 / (len(v) - 1)) - 1


def test_growth_windows_against_brute_force(spark):
    rows = []
    e = dt.date(2024, 7, 1)
    # u1: 12 clean rows; u2: 11 rows (excluded); u3: zeros / negatives inside windows;
    # u4: one positive value pre (no rate); u5: gap months, month-end event date
    for i, p in enumerate(_months((2024, 1), 12)):
        rows.append(("u1", p, e, 100.0 * (1.05 ** i)))
    for i, p in enumerate(_months((2024, 1), 11)):
        rows.append(("u2", p, e, 100.0 + i))
    for i, (p, v) in enumerate(zip(_months((2024, 1), 12), [0, 50, -3, 60, 70, 0, 80, 0, 90, 95, -1, 120])):
        rows.append(("u3", p, e, float(v)))
    for p, v in zip(_months((2024, 1), 12), [0, 0, 0, 0, 0, 9, 1, 2, 3, 4, 5, 6]):
        rows.append(("u4", p, e, float(v)))
    e5 = dt.date(2024, 8, 31)
    for p, v in zip([m for k, m in enumerate(_months((2023, 10), 18)) if k % 3 != 1],
                    np.linspace(10, 40, 12)):
        rows.append(("u5", p, e5, float(v)))
    pdf = pd.DataFrame(rows, columns=["u", "period", "e", "v"])
    df = spark.createDataFrame(pdf, "u string, period date, e date, v double")
    got = {r.u: r for r in G.growth_per_unit(df, "u", "period", "e", ["v"], 6, 6, 12).collect()}
    assert set(got) == {"u1", "u3", "u5"}
    for u, r in got.items():
        sub = pdf[pdf.u == u].sort_values("period")
        ev = pd.Timestamp(sub.e.iloc[0])
        per = pd.to_datetime(sub.period)
        pre = sub[(per >= ev - pd.DateOffset(months=6)) & (per < ev)].v.tolist()
        post = sub[(per >= ev) & (per < ev + pd.DateOffset(months=6))].v.tolist()
        assert abs(r.pre_cmgr - _cmgr(pre)) < 1e-12 and abs(r.post_cmgr - _cmgr(post)) < 1e-12
        assert r.pre_months == len(pre) and r.post_months == len(post)


def test_eligibility_event_on_period_is_post(spark):
    df = spark.createDataFrame([("a", dt.date(2024, m, 1), dt.date(2024, 4, 1)) for m in range(1, 8)],
                               "u string, p date, e date")
    r = G.eligibility(df, "u", "p", "e", 3, 4).first()
    assert (r.pre_months, r.post_months, r.suitable) == (3, 4, True)


def test_did_zero_when_arms_shift_equally_and_cluster_form(spark):
    rng = np.random.default_rng(0)
    rows = []
    for u in range(40):
        arm = u % 2
        base = rng.normal(100, 10)
        for t in range(6):
            rows.append((u, t, arm, base + 5.0 * arm + (7.0 if t >= 3 else 0.0)))
    df = spark.createDataFrame(rows, "u long, t long, a int, y double")
    r = DD.did(df, "u", "t", "a", ["y"], split=F.col("t") >= 3).first()
    assert abs(r.did_estimate) < 1e-9
    c = DD.did_cluster_se(df, "u", "t", "a", "y", F.col("t") >= 3).first()
    assert abs(c.did_estimate - r.did_estimate) < 1e-9
    rows2 = [(u, t, a, y + (3.0 if a == 1 and t >= 3 else 0.0)) for u, t, a, y in rows]
    r2 = DD.did(spark.createDataFrame(rows2, "u long, t long, a int, y double"), "u", "t", "a", ["y"],
                split=F.col("t") >= 3).first()
    assert abs(r2.did_estimate - 3.0) < 1e-9
