import numpy as np
import pandas as pd

from upshot.operators.iv import iv_estimate


def test_iv_wald_and_two_stage(spark):
    rng = np.random.default_rng(12)
    n = 3000
    z = rng.normal(size=n)
    w = rng.normal(size=n)
    u = rng.normal(size=n)                      # confounder
    x = 0.8 * z + 0.5 * u + 0.3 * w + rng.normal(scale=0.3, size=n)
    y = 2.0 * x + 1.5 * u + 0.7 * w + rng.normal(scale=0.3, size=n)
    df = spark.createDataFrame(pd.DataFrame({"z": z, "x": x, "y": y, "w": w}))
    wald = iv_estimate(df, "z", "x", "y").first()
    assert abs(wald.iv_estimate - np.cov(z, y)[0, 1] / np.cov(z, x)[0, 1]) < 1e-9 and abs(wald.first_stage - np.cov(z, x)[0, 1]) < 1e-9
    two = iv_estimate(df, "z", "x", "y", controls=["w"]).first()
    assert abs(two.iv_estimate - 2.0) < 0.15 and two.n == n
    # standard error by the textbook matrices
    design, instruments = np.column_stack([np.ones(n), x, w]), np.column_stack([np.ones(n), z, w])
    fitted = instruments @ np.linalg.lstsq(instruments, design, rcond=None)[0]
    beta = np.linalg.lstsq(fitted, y, rcond=None)[0]
    s2 = ((y - design @ beta) ** 2).sum() / (n - 3)
    se = np.sqrt(s2 * np.linalg.inv(fitted.T @ fitted)[1, 1])
    assert np.isclose(two.iv_estimate, beta[1]) and np.isclose(two.standard_error, se) and np.isclose(two.t_stat, beta[1] / se)
    assert two.df == n - 3 and two.p_value < 1e-6


def test_iv_without_rows_or_variation(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (1.0, 1.0, 3.0), (1.0, None, 3.0)], "z double, x double, y double")
    for d in (df, df.where("1 = 0")):
        r = iv_estimate(d, "z", "x", "y").first()
        assert r.iv_estimate is None and r.p_value is None and r.n == d.where("x is not null").count()
