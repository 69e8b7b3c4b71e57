import numpy as np
import pandas as pd

from upshot.operators.clean import remove_outliers_iqr, remove_outliers_zscore


def _brute(pdf, cols, seg, factor=2.5, min_n=10):
    out = pdf.copy()
    for c in cols:
        for s in out[seg].dropna().unique():
            m = out[seg] == s
            v = out.loc[m, c]
            if len(v) > min_n:
                q1, q3 = v.quantile(0.25), v.quantile(0.75)
                iqr = q3 - q1
                if iqr > 0:
                    bad = (v < q1 - factor * iqr) | (v > q3 + factor * iqr)
                    out = out[~(m & bad.reindex(out.index, fill_value=False))]
    return out


def test_iqr_matches_sequential_brute_force(spark):
    rng = np.random.default_rng(7)
    n = 300
    pdf = pd.DataFrame({"id": np.arange(n), "seg": rng.choice(["A", "B", "C", None], n, p=[.5, .3, .1, .1]),
                        "x": rng.lognormal(3, 1, n), "y": rng.lognormal(2, 1.5, n)})
    pdf.loc[pdf.seg == "C", "x"] = np.r_[[1e6], pdf.loc[pdf.seg == "C", "x"].to_numpy()[1:]]
    small = pdf.seg == "C"
    pdf = pdf[~small | (pdf.index.isin(pdf[small].index[:9]))]   # segment C keeps 9 rows (n <= 10)
    got = remove_outliers_iqr(spark.createDataFrame(pdf), ["x", "y"], "seg")
    assert sorted(r.id for r in got.collect()) == sorted(_brute(pdf, ["x", "y"], "seg").id)
    got_auto = remove_outliers_iqr(spark.createDataFrame(pdf), ["x", "y"], "seg")
    assert got_auto.count() == got.count()
    assert set(pdf[pdf.seg.isna()].id) <= {r.id for r in got.collect()}


def test_zscore(spark):
    vals = [1.0] * 50 + [100.0]
    got = remove_outliers_zscore(spark.createDataFrame([(v,) for v in vals], "v double"), ["v"], 3.0)
    assert got.count() == 50
