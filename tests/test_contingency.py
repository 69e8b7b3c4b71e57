import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from upshot.operators import contingency as CT


def _yates(t):
    t = np.asarray(t, float)
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    d = e - t
    adj = t + np.minimum(0.5, np.abs(d)) * np.sign(d)
    return ((adj - e) ** 2 / e).sum()


def test_chi2_2x2_and_zero_margin(spark):
    cases = [(12, 5, 7, 9), (3, 1, 1, 3), (10, 0, 5, 0)]
    df = spark.createDataFrame(cases, "a int, b int, c int, d int")
    out = df.select(CT.chi2_2x2("a", "b", "c", "d").alias("x")).collect()
    for (a, b, c, d), r in zip(cases, out):
        if b + d == 0:
            assert r.x is None
        else:
            assert abs(r.x - _yates([[a, b], [c, d]])) < 1e-9


def test_chi2_independence_rxc(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"r": rng.choice(list("abc"), 200), "c": rng.choice(list("xyz"), 200)})
    out = CT.chi2_independence(spark.createDataFrame(pdf), "r", "c").first()
    t = pd.crosstab(pdf.r, pdf.c).to_numpy().astype(float)
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    assert out.dof == 4 and abs(out.chi2 - ((t - e) ** 2 / e).sum()) < 1e-9
    two = spark.createDataFrame(pdf[(pdf.r != "c") & (pdf.c != "z")]).where(F.lit(True))
    r2 = CT.chi2_independence(two, "r", "c").first()
    t2 = pd.crosstab(pdf[(pdf.r != "c") & (pdf.c != "z")].r, pdf[(pdf.r != "c") & (pdf.c != "z")].c).to_numpy()
    assert r2.dof == 1 and abs(r2.chi2 - _yates(t2)) < 1e-9
