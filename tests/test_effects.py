import numpy as np
import pandas as pd

from upshot.functions import distributions as D
from upshot.operators import effects as E


def _pooled(a, b):
    na, nb = len(a), len(b)
    sp2 = ((na - 1) * np.var(a, ddof=1) + (nb - 1) * np.var(b, ddof=1)) / (na + nb - 2)
    return (np.mean(a) - np.mean(b)) / np.sqrt(sp2 * (1 / na + 1 / nb)), na + nb - 2


def test_two_sample_t_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for seg in ("A", "B"):
        for arm in (0, 1):
            for _ in range(15 + 5 * arm):
                rows.append((seg, arm, float(rng.normal(10 + arm, 3)), float(rng.normal(5, 1))))
    pdf = pd.DataFrame(rows, columns=["seg", "arm", "x", "y"])
    df = spark.createDataFrame(pdf)
    out = E.two_sample_t(df, "arm", ["x", "y"], by=["seg"]).toPandas()
    for _, r in out.iterrows():
        g = pdf[pdf.seg == r.seg]
        t, dof = _pooled(g[g.arm == 1][r.metric].to_numpy(), g[g.arm == 0][r.metric].to_numpy())
        assert abs(r.t_stat - t) < 1e-9 and r.df == dof
        assert abs(r.p_value - D.t_two_sided(t, dof)) < 1e-12
        mt, mc = g[g.arm == 1][r.metric].mean(), g[g.arm == 0][r.metric].mean()
        assert abs(r.lift_pct - (mt - mc) / mc * 100) < 1e-9


def test_min_n_filter_and_missing_arm(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("A", 1, 2.0), ("B", 0, 1.0)], "seg string, arm int, x double")
    out = E.two_sample_t(df, "arm", ["x"], by=["seg"], with_p=False)
    rows = {r.seg: r for r in out.collect()}
    assert rows["A"].n_c == 0 and rows["A"].t_stat is None and rows["A"].lift_pct == 0.0
    assert E.two_sample_t(df, "arm", ["x"], by=["seg"], min_n=1, with_p=False).count() == 0


def test_one_sample_and_effect_size(spark):
    x = [0.1, -0.2, 0.3, 0.4, 0.05]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    r = E.one_sample_t(df, "v").first()
    t = np.mean(x) / (np.std(x, ddof=1) / np.sqrt(len(x)))
    assert abs(r.t_stat - t) < 1e-12 and r.df == 4
    m = E.cohens_d(E.arm_moments(spark.createDataFrame([(1, 2.0), (1, 4.0), (0, 1.0), (0, 3.0)], "a int, v double"),
                                 "a", ["v"]))
    row = E.add_power(m).first()
    assert abs(row.cohens_d - 1.0 / np.sqrt(2.0)) < 1e-12 and row.effect_label == "medium"
    assert row.required_n == int(np.ceil(2 * ((E.Z_975 + E.Z_80) / row.cohens_d) ** 2))
    assert 0 < row.power < 1


def test_lift_vs_common_control(spark):
    rows = [(1, "X", float(v)) for v in range(1, 7)] + [(1, "Y", 9.0)] * 5 + [(0, None, float(v)) for v in (2, 4, 6)]
    df = spark.createDataFrame(rows, "arm int, typ string, v double")
    out = {r.typ: r for r in E.lift_vs_common_control(df, "arm", "typ", ["v"], min_n=5).collect()}
    assert set(out) == {"X", "Y"}
    assert out["X"].mean_c == 4.0 and abs(out["X"].lift_pct - (3.5 - 4) / 4 * 100) < 1e-12
