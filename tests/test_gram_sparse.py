import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from upshot.operators import cluster as K
from upshot.operators import kmeans as KM
from upshot.operators import match as M
from upshot.operators import opportunity as O
from upshot.operators import sparse as S
from upshot.operators.gram import gram, principal_axes, two_stage


def test_gram_of_far_off_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]]) + [1e6, -3, 0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).unionByName(spark.createDataFrame([(None, 1.0, 2.0)], "a double, b double, c double"))
    g = gram(df.repartition(5), ["a", "b", "c"])
    d = x - x.mean(axis=0)
    assert g.n == 500 and np.allclose(g.mean, x.mean(axis=0)) and np.allclose(g.products, d.T @ d, rtol=1e-9)
    axes, shares = principal_axes(g, 2)
    _, s, vt = np.linalg.svd(d, full_matrices=False)
    assert np.allclose(np.abs(axes.T), np.abs(vt[:2]), atol=1e-6) and np.allclose(shares, s[:2] ** 2 / (s ** 2).sum())
    assert (axes[np.abs(axes).argmax(axis=0), [0, 1]] > 0).all()
    assert two_stage(gram(df.where("1 = 0"), ["a", "b", "c"]), 0, 1, 2) is None


def products(seed=3, accounts=60, names=10_000):
    rng = np.random.default_rng(seed)
    group = rng.integers(0, 3, accounts)
    rows = []
    for a in range(accounts):
        for p in set(rng.integers(group[a] * 40, group[a] * 40 + 40, 15).tolist()) | {int(rng.integers(200, names))}:
            rows.append((a, f"p{p:05d}", float(rng.integers(1, 9))))
    rows += [(10_000 + k, f"p{k:05d}", 1.0) for k in range(names)]  # every product occurs
    return rows, group


def test_ten_thousand_products(spark):
    rows, group = products()
    t = spark.createDataFrame(rows, "account long, product_name string, amount double").repartition(4)
    index = {r["product_name"]: r["index"] for r in S.product_index(t).collect()}
    assert index == {f"p{k:05d}": k for k in range(10_000)}
    long = S.product_amounts(t, ["account"], amount=F.col("amount"))
    keys = t.select("account").distinct()
    x = S.sparse_features(keys, long, ["account"])
    wide = np.zeros((60, 10_000))
    for a, p, v in rows:
        if a < 60:
            wide[a, int(p[1:])] += v
    got = {r["account"]: r["features"] for r in x.where("account < 60").collect()}
    for a in range(60):
        assert got[a]["size"] == 10_000 and got[a]["indices"] == np.flatnonzero(wide[a]).tolist() and got[a]["values"] == wide[a][wide[a] > 0].tolist()
    few = x.where("account < 60")
    runs = KM.fit_starts(KM.weighted_points(few), (3,), range(42, 48))
    labels = {r["account"]: r["cluster"] for r in KM.assign_nearest(few, runs[3].centres).collect()}
    assert len({(group[a], labels[a]) for a in range(60)}) == 3
    dense = spark.createDataFrame([(a, wide[a, :120].tolist()) for a in range(60)], "account long, features array<double>")
    cost = sum(((wide[[a for a in range(60) if labels[a] == c]] - wide[[a for a in range(60) if labels[a] == c]].mean(axis=0)) ** 2).sum() for c in range(3))
    assert runs[3].cost == pytest.approx(cost)
    same = KM.fit_starts(KM.weighted_points(dense), (3,), range(42, 48))[3]
    assert len({(labels[a], same.centres[:, :120].shape) for a in range(60)}) == 3


def test_quantiles_with_implicit_zeros(spark):
    rng = np.random.default_rng(2)
    wide = np.where(rng.uniform(size=(37, 6)) < [0.9, 0.8, 0.5, 0.3, 0.1, 1.0], rng.integers(-3, 9, (37, 6)), 0).astype(float)
    rows = [(a, f"p{p}", float(wide[a, p])) for a in range(37) for p in range(6) if wide[a, p]]
    long = spark.createDataFrame(rows, "account long, product_name string, value double")
    got = {r["product_name"]: (r["n"], r["q"]) for r in S.sparse_quantiles(long, 37, (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    for p in range(6):
        assert got[f"p{p}"][0] == 37 and np.allclose(got[f"p{p}"][1], np.quantile(wide[:, p], [0.0, 0.25, 0.5, 0.9, 1.0]))
    scaled = {(r["account"], r["product_name"]): r["value"] for r in S.sparse_scale(long, 37).collect()}
    for p in range(6):
        q1, q3 = np.quantile(wide[:, p], [0.25, 0.75])
        assert all(scaled[a, f"p{p}"] == pytest.approx(wide[a, p] / ((q3 - q1) or 1.0)) for a in range(37) if wide[a, p])


def test_sketches_merge(spark):
    rows = [(i % 7, "x" if i % 3 else "y", i) for i in range(20_000)]
    t = spark.createDataFrame(rows, "a int, b string, k long")
    kept = O.distinct_sketches(t, ["a", "b"], ["k"])
    assert kept.count() == 14
    got = {(r["a"], r["b"]): r["approx_k"] for r in O.merged_distinct(kept, [["a"], ["b"], []], ["a", "b"], ["k"]).collect()}
    for (a, b), n in got.items():
        want = sum((a is None or x == a) and (b is None or y == b) for x, y, _ in rows)
        assert abs(n - want) <= 0.05 * want
    assert len(got) == 10


def test_cross_fitted_scores_and_auc(spark):
    rng = np.random.default_rng(9)
    n = 300
    x = rng.normal(size=n)
    arm = (x + rng.normal(scale=0.5, size=n) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "arm": arm, "x": x, "noise": rng.normal(size=n), "seg": rng.choice(["a", "b"], n)}))
    scores = M.cross_fitted_scores(df, "id", "arm", ["x", "noise"], ["seg"], trees=8, depth=2, folds=3)
    pdf = scores.toPandas()
    assert sorted(pdf.id) == list(range(n)) and set(pdf.fold) == {0, 1, 2} and pdf.gbt_score.between(0, 1).all()
    got = {r["fold"]: r["auc"] for r in M.auc_by_group(scores, "arm", "gbt_score", ["fold"]).collect()}
    for f, part in pdf.groupby("fold"):
        p, q = part[part.arm == 1].gbt_score.to_numpy(), part[part.arm == 0].gbt_score.to_numpy()
        assert got[f] == pytest.approx(((p[:, None] > q[None, :]) + 0.5 * (p[:, None] == q[None, :])).mean())
        assert got[f] > 0.75
    one = M.auc_by_group(df.withColumn("one", F.lit(1)), "one", "x").first()
    assert one["auc"] is None and one["n_c"] == 0


def test_features_of_one_kind(spark):
    assert K.nearest_centre is KM.nearest_centre
