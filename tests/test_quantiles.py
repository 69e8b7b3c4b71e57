import numpy as np
import pytest

from upshot.operators import quantiles as Q

PROBS = (0.0, 0.25, 0.5, 0.9, 1.0)


def sample(kind, n, rng):
    return {"normal": rng.normal(size=n), "ties": rng.integers(0, 5, n).astype(float), "skew": rng.lognormal(3, 3, n),
            "one": np.full(n, 7.0)}[kind]


@pytest.mark.parametrize("small", [4_000, 0])
def test_exact_by_group(spark, monkeypatch, small):
    """``small = 0`` brackets every group by the sketch."""
    monkeypatch.setattr(Q, "SMALL", small)
    rng = np.random.default_rng(3)
    want, rows = {}, []
    for kind in ("normal", "ties", "skew", "one"):
        for n in ((1, 2, 11, 3001) if small else (20_001,)):
            x = sample(kind, n, rng)
            want[f"{kind}{n}"] = np.quantile(x, PROBS)
            rows += [(f"{kind}{n}", float(v)) for v in x]
    rows += [("normal", None), (None, 1.0), ("empty", None)]
    got = {r["g"]: (r["n"], r["q"]) for r in Q.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", PROBS, ["g"]).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert np.allclose(got[k][1], w, rtol=1e-12, atol=1e-12), k


def test_without_groups_and_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 0)
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert Q.exact_quantiles(df, "v", (0.25, 0.5)).first()["q"] == [25.0, 50.0]
    assert Q.exact_quantiles(df.where("v < 0"), "v", (0.5,)).count() == 0


def test_median_time_of_dates_and_timestamps(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from upshot.operators.panel import median_time
    days = [dt.date(2024, 1, d) for d in (1, 2, 9, 20)] + [None]
    df = spark.createDataFrame([(d,) for d in days], "d date").withColumn("t", F.col("d").cast("timestamp"))
    for c in ("d", "t"):
        assert median_time(df, c) == dt.datetime(2024, 1, 5, 12)
        assert median_time(df.where("1 = 0"), c) is None
