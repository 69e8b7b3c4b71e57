import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from upshot.operators import cluster as K


def frame(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 3, n)
    x = np.column_stack([centre * 10 + rng.normal(size=n), 1e6 - centre * 7 + rng.normal(size=n)])
    pdf = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "truth": centre, "arm": rng.integers(0, 2, n)})
    return pdf, K.assemble(spark.createDataFrame(pdf), ["a", "b"])


def test_label_codes(spark):
    values = ["pear", None, "apple", "fig", "apple", "Unknown", "fig", "zebra"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string").repartition(5)
    got = {r["id"]: r["v_encoded"] for r in K.label_encode(df, ["v"]).collect()}
    codes = {v: i for i, v in enumerate(sorted({v or "Unknown" for v in values}))}
    assert got == {i: codes[v or "Unknown"] for i, v in enumerate(values)}


def test_robust_scale(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.normal(size=500), "flat": np.r_[np.ones(3), np.zeros(497)]})
    got = K.robust_scale(spark.createDataFrame(pdf), ["x", "flat"], suffix="_s").toPandas()
    q1, med, q3 = np.quantile(pdf.x, [0.25, 0.5, 0.75])
    assert np.allclose(got.x_s, (got.x - med) / (q3 - q1)) and np.allclose(got.flat_s, got.flat)


def test_calinski_harabasz_with_a_large_mean(spark):
    pdf, x = frame(spark)
    got = K.calinski_harabasz(x.withColumnRenamed("truth", "cluster"))
    v = pdf[["a", "b"]].to_numpy()
    v = v - v.mean(axis=0)
    within = sum(((v[pdf.truth == c] - v[pdf.truth == c].mean(axis=0)) ** 2).sum() for c in range(3))
    between = (v ** 2).sum() - within
    assert got == pytest.approx((between / 2) / (within / (len(v) - 3)), rel=1e-6)


def test_kmeans_and_sweep_find_the_clusters(spark):
    pdf, x = frame(spark)
    found = K.fit_kmeans(x, 3).select("truth", "cluster").toPandas()
    assert found.groupby("truth").cluster.nunique().max() == 1 and found.cluster.nunique() == 3
    scores, best = K.cluster_sweep(x, "arm", ks=(2, 3), seeds=(42, 43))
    assert scores.count() == 4 and best is not None
    assert K.silhouette(K.fit_bisecting(x, 3)) > 0.5
    none, nothing = K.cluster_sweep(x, "arm", ks=(2,), seeds=(42,), min_size=10_000)
    assert nothing is None and not any(r["best"] for r in none.collect())


def test_balance_and_composite(spark):
    rows = [(0, 1)] * 8 + [(0, 0)] * 4 + [(1, 1)] * 20 + [(2, 1)] * 3 + [(2, 0)] * 3 + [(3, 1)] * 20 + [(3, 0)] * 2
    got = {r["cluster"]: r for r in K.cluster_balance(spark.createDataFrame(rows, "cluster int, arm int"), "arm").collect()}
    assert [got[c]["is_valid"] for c in range(4)] == [True, False, False, False]
    assert got[0]["balance_ratio"] == pytest.approx(0.5) and got[1]["balance_ratio"] == 0.0
    assert K.composite_score(0.5, 0.4, 200.0) == pytest.approx(0.35 + 0.09)


def test_pca_of_centred_features(spark):
    pdf, x = frame(spark)
    out, shares = K.pca_2d(x)
    v = pdf[["a", "b"]].to_numpy()
    v = v - v.mean(axis=0)
    _, s, _ = np.linalg.svd(v, full_matrices=False)
    assert np.allclose(shares, s ** 2 / (s ** 2).sum(), atol=1e-6)
    got = out.toPandas()
    assert np.allclose(sorted(np.abs(got.pc1.std() * np.sqrt(len(v) - 1)) for _ in (0,))[0], s[0], rtol=1e-6)


def test_all_starts_in_one_scan_cost_no_more_than_separate_fits(spark):
    from pyspark.ml.clustering import KMeans
    rng = np.random.default_rng(5)
    n = 600
    v = np.column_stack([rng.normal(size=n) + rng.integers(0, 5, n) * 3, rng.normal(size=n) * 2, rng.integers(0, 3, n)])
    x = K.assemble(spark.createDataFrame(pd.DataFrame(np.round(v, 2), columns=list("abc"))), list("abc"))
    points = K.weighted_points(x)
    runs = K.fit_starts(points, (3, 5), K.SEEDS)
    for k in (3, 5):
        best = min(KMeans(k=k, seed=s, maxIter=300).fit(x).summary.trainingCost for s in K.SEEDS[:5])
        assert runs[k].cost <= best * 1.0001 and runs[k].done
        labels = x.withColumn("cluster", K.nearest_centre("features", runs[k].centres)).toPandas().cluster.to_numpy()
        w = np.round(v, 2)
        assert runs[k].cost == pytest.approx(sum(((w[labels == c] - w[labels == c].mean(axis=0)) ** 2).sum() for c in set(labels)), rel=1e-6)


def test_equal_points_and_few_points(spark):
    hot = K.assemble(spark.createDataFrame([(1.0, 2.0)] * 500 + [(5.0, 2.0)] * 3 + [(None, None)], "a double, b double"), ["a", "b"])
    points = K.weighted_points(hot)
    assert sorted(r["w"] for r in points.collect()) == [1, 3, 500]
    runs = K.fit_starts(points, (2, 4), (1, 2))
    assert len(runs[4].centres) == 3 and runs[4].cost == 0.0 and runs[2].cost < 200
    assert K.fit_starts(K.weighted_points(hot.where("1 = 0")), (2,), (1,)) == {}


def test_scores_of_labellings_against_spark_and_plain_sums(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    pdf, x = frame(spark)
    x = x.withColumn("b2", F.col("id") % 4).withColumn("single", F.when(F.col("id") == 0, 1).otherwise(0))
    got = K.score_labels(x, ["truth", "b2", "single"], arm="arm")
    for c in ("truth", "b2", "single"):
        want = ClusteringEvaluator(featuresCol="features", predictionCol=c).evaluate(x)
        assert got[c]["silhouette"] == pytest.approx(want, abs=1e-6)
    assert got["truth"]["clusters"] == [(c, int((pdf.truth == c).sum()), int(pdf[pdf.truth == c].arm.sum())) for c in range(3)]
    assert np.isnan(K.silhouette(x.withColumn("cluster", F.lit(0))))


def test_trees_of_all_cluster_numbers_share_their_passes(spark, monkeypatch):
    """The labels of Spark ML's bisecting fits, with no more passes than one tree of three levels makes."""
    from pyspark.ml.clustering import BisectingKMeans
    from upshot.operators import kmeans
    rng = np.random.default_rng(7)
    n = 400
    blob = rng.choice(8, n, p=[.3, .2, .15, .1, .08, .07, .06, .04])
    v = np.column_stack([blob % 2 * 40, blob // 2 % 2 * 17, blob // 4 * 7]) + rng.normal(size=(n, 3)) + [3, 1, 2]
    x = K.assemble(spark.createDataFrame(pd.DataFrame(v, columns=list("abc"))), list("abc"))
    passes = []
    monkeypatch.setattr(kmeans, "_divide", lambda *a, f=kmeans._divide: passes.append(1) or f(*a))
    trees = kmeans.fit_trees(K.weighted_points(x), range(3, 8), 42)
    assert 0 < len(passes) <= 3 * kmeans.TREE_ITERATIONS
    for k in range(3, 8):
        want = BisectingKMeans(k=k, seed=42, predictionCol="want").fit(x).transform(x)
        got = want.withColumn("got", kmeans.tree_leaf("features", trees[k])).toPandas()
        assert got.want.nunique() == k and (got.want == got.got).all()
    assert K.fit_bisecting(x.where("1 = 0"), 3).count() == 0


def test_equal_rows_make_one_leaf(spark):
    hot = K.assemble(spark.createDataFrame([(1.0, 2.0)] * 50 + [(5.0, 2.0)] * 3, "a double, b double"), ["a", "b"])
    got = K.fit_bisecting(hot, 4).toPandas()
    assert got.groupby("a").cluster.nunique().max() == 1 and got.cluster.nunique() == 2
