import hashlib

import numpy as np

from upshot.operators import cohort as C
from upshot.operators import resample as B


def _u(seed, k):
    return int(hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:8], 16) / 2 ** 32


def test_seeded_sample_exact_top_k(spark):
    ids = list(range(1, 501))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = sorted(r.id for r in C.seeded_sample(df, "id", 37, seed=42, buckets=16).collect())
    assert got == sorted(sorted(ids, key=lambda i: (_u(42, i), i))[:37])


def test_stratified_assignment(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(1, 101)]
    out = C.stratified_assignment(spark.createDataFrame(rows, "id long, s string"), "id", ["s"], 0.5, buckets=8)
    res = {r.s: (r.n, r.k) for r in out.groupBy("s").agg({"*": "count", "assigned": "sum"})
           .withColumnRenamed("count(1)", "n").withColumnRenamed("sum(assigned)", "k").collect()}
    for s, (n, k) in res.items():
        assert k == n // 2


def test_poisson_weights():
    keys = [str(k) for k in range(3000)]
    w = B.poisson_weights(keys, 42, 20)
    assert abs(w.mean() - 1.0) < 0.02 and abs(w.var() - 1.0) < 0.05
    digest = hashlib.md5(b"42|17|1").hexdigest()  # replicates 8 to 15
    assert w[17, 8:16].tolist() == [sum(int(digest[4 * j:4 * j + 4], 16) >= t for t in B.THRESHOLDS) for j in range(8)]
    assert np.abs(np.corrcoef(w.T.astype(float))[np.triu_indices(20, 1)]).max() < 0.1


def test_weights_in_sql():
    import duckdb
    rows = duckdb.sql(f"SELECT k, r, {B.weight_sql(7, 'k')} FROM (SELECT unnest(['a', 'b|c', '12']) AS k), range(30) t(r)").fetchall()
    w = B.poisson_weights(["a", "b|c", "12"], 7, 30)
    assert {(k, r): int(x) for k, r, x in rows} == {(k, r): int(w[i, r]) for i, k in enumerate(["a", "b|c", "12"]) for r in range(30)}


def test_groups_measures_and_nulls_against_plain_sums(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"k{i}", int(i % 2), None if i % 7 == 0 else ["a", "b"][i % 3 == 0], None if i % 11 == 0 else float(rng.normal(10 + i % 2, 2)), float(i % 5))
            for i in range(300)] + [(None, 1, "a", 1e9, 1e9), ("lost", None, "a", 1e9, 1e9), ("only", 1, "single", 4.0, None)]
    df = spark.createDataFrame(rows, "k string, arm int, g string, x double, y double").repartition(5)
    for held in (1, B.HELD_BYTES):
        monkeypatch.setattr(B, "HELD_BYTES", held)
        got = {(r["g"], r["measure"]): r for r in B.bootstrap_diff_ci(df, ["x", "y"], "k", "arm", ["g"], 40, 7).collect()}
        for g in ("a", "b", None):
            for j, name in ((3, "x"), (4, "y")):
                mine = [r for r in rows if r[2] == g and r[0] is not None and r[1] is not None and r[j] is not None]
                w = B.poisson_weights([r[0] for r in mine], 7, 40).astype(float)
                v, arm = np.array([r[j] for r in mine]), np.array([r[1] for r in mine])
                t, c = (w[arm == a].T @ v[arm == a] / w[arm == a].sum(axis=0) for a in (1, 0))
                lo, hi = np.quantile(t - c, [0.025, 0.975])
                assert np.allclose([got[g, name]["ci_lower"], got[g, name]["ci_upper"]], [lo, hi]) and got[g, name]["replicates"] == 40
        assert got["single", "x"]["ci_lower"] is None and got["single", "x"]["replicates"] == 0
        assert B.bootstrap_diff_ci(df.where("1 = 0"), ["x"], "k", "arm", ["g"], 10).collect() == []


def test_ate_independent_of_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 2), float(rng.normal(10 + (i % 2), 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, arm int, v double")
    ate = B.average_treatment_effect(df, "v", "id", "arm", reps=200, seed=7).first()
    assert ate.ci_lower <= ate.estimate <= ate.ci_upper and ate.replicates == 200 and ate.measure == "v"
    again = B.average_treatment_effect(df.repartition(3), ["v"], "id", "arm", reps=200, seed=7).first()
    assert abs(again.ci_lower - ate.ci_lower) < 1e-9
