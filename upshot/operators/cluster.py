"""Clustering-based control groups (K-1 .. K-13, E-18).

Features are scaled with per-column median / IQR from one aggregation,
clustered with k-means (best of several starts, all in one scan) and bisecting
k-means, and scored by silhouette, Calinski-Harabasz and treated / control
balance per cluster, for all labellings at once. Every score comes from small per-cluster tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_category
from ..session import cut_lineage
from .effects import two_sample_t
from .gram import gram, principal_axes
from .kmeans import ROWS_PER_PARTITION, fit_starts, fit_trees, nearest_centre, score_labels, tree_leaf, weighted_points
from .opportunity import category_mode
from .quantiles import exact_quantiles, small_side


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_encoded") -> DataFrame:
    """K-2: code = position of the value among the sorted distinct values
    (nulls filled with 'Unknown' first). The distinct values are range
    partitioned and numbered within each partition; the partitions' counts give
    the offsets, so no task sees all values."""
    base = cut_lineage(df.withColumns({c: clean_category(c) for c in cols}))
    out = base
    for c in cols:
        values = cut_lineage(base.select(c).distinct().repartitionByRange(c).withColumn("__p", F.spark_partition_id()))
        sizes = values.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
        before = sizes.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(
            Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))  # a row per partition
        codes = (values.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(c)) - 1)
                 .join(before, F.col("__p") == F.col("__q"))
                 .select(F.col(c).alias("__value"), (F.col("__r") + F.col("__o")).cast("int").alias(f"{c}{suffix}")))
        out = out.join(small_side(codes), F.col(c) == F.col("__value"), "left").drop("__value")
    return out


def robust_scale(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """K-3: (x - median) / IQR per column; a zero IQR divides by 1 (so rare
    binary columns keep their signal). Medians and quartiles of all columns are
    exact at any size and come from one pass over (column, value)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in cols])).alias("s")).select("s.*")
    found = {r["c"]: r["q"] for r in exact_quantiles(long, "x", (0.25, 0.5, 0.75), ["c"]).collect()}  # a row per column
    out = df
    for c in cols:
        q1, med, q3 = found.get(c, (0.0, 0.0, 0.0))
        iqr = (q3 - q1) or 1.0
        out = out.withColumn(f"{c}{suffix}", (F.col(c).cast("double") - F.lit(med)) / F.lit(iqr))
    return out


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """K-4: feature vector (nulls as 0)."""
    filled = df.na.fill(0, subset=list(cols))
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(filled)


SEEDS = tuple(range(42, 52))  # ten starts


def fit_kmeans(df: DataFrame, k: int, seeds: Sequence[int] = SEEDS,
               features: str = "features", out: str = "cluster", max_iter: int = 300) -> DataFrame:
    """K-5: k-means (k-means|| start), best (lowest cost) of ten seeded runs, each until it
    converges; all runs share their scans (``kmeans.fit_starts``)."""
    best = fit_starts(weighted_points(df, features), [k], seeds, max_iter)
    return df.withColumn(out, nearest_centre(features, best[k].centres) if best else F.lit(None).cast("int"))


def fit_bisecting(df: DataFrame, k: int, seed: int = 42, features: str = "features",
                  out: str = "cluster") -> DataFrame:
    """K-6: hierarchical (top-down bisecting) alternative."""
    trees = fit_trees(weighted_points(df, features), [k], seed)
    return df.withColumn(out, tree_leaf(features, trees[k]) if trees else F.lit(None).cast("int"))


def silhouette(pred: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """K-7: silhouette (squared Euclidean); nan for fewer than two clusters."""
    return score_labels(pred, [cluster], features).get(cluster, {}).get("silhouette", float("nan"))


def calinski_harabasz(pred: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """K-8: (B / (k - 1)) / (W / (n - k)) with within / between sums of squares
    from per-cluster counts, sums and sums of squares (one aggregation)."""
    return score_labels(pred, [cluster], features).get(cluster, {}).get("calinski_harabasz", float("nan"))


def cluster_balance(pred: DataFrame, arm: str, cluster: str = "cluster", min_size: int = 10,
                    min_ratio: float = 0.3) -> DataFrame:
    """K-9: per cluster counts, arm ratios, balance = min ratio / max ratio,
    valid when size >= min_size, balance >= min_ratio and both arms present."""
    g = pred.groupBy(cluster).agg(F.count(F.lit(1)).alias("total_accounts"),
                                  F.count_if(F.col(arm) == 1).alias("treatment_accounts"),
                                  F.count_if(F.col(arm) == 0).alias("control_accounts"))
    tr = F.col("treatment_accounts") / F.col("total_accounts")
    cr = F.col("control_accounts") / F.col("total_accounts")
    bal = F.coalesce(F.try_divide(F.least(tr, cr), F.nullif(F.greatest(tr, cr), F.lit(0.0))), F.lit(0.0))
    return (g.withColumn("treatment_ratio", tr).withColumn("control_ratio", cr)
            .withColumn("balance_ratio", bal)
            .withColumn("is_valid", (F.col("total_accounts") >= min_size) & (F.col("balance_ratio") >= min_ratio)
                        & (F.col("treatment_accounts") > 0) & (F.col("control_accounts") > 0)))


def composite_score(balance: float, sil: float, ch: float) -> float:
    """K-10: 0.7 * balance + 0.3 * (silhouette + CH / 1000) / 2."""
    b = balance if balance > 0 else 0.0
    return b * 0.7 + ((sil if sil == sil else 0.0) + ch / 1000.0) / 2.0 * 0.3


def cluster_sweep(x: DataFrame, arm: str, ks: Sequence[int] = range(3, 8),
                  seeds: Sequence[int] = SEEDS, min_size: int = 10, min_ratio: float = 0.3,
                  parallel: int = 8):
    """K-5 .. K-10: fit both algorithms for every k, score them, and return
    (scores DataFrame, best prediction DataFrame or None). Q-20: when no
    configuration has a valid cluster, the best prediction is None.

    All k-means runs share one scan an iteration, all bisecting trees another, and all labellings
    one scan for their moments and one for their silhouettes; the two kinds of fits run side by side."""
    spark = x.sparkSession
    # many short jobs over the same rows: partitions of some thousand rows
    # each, so that a job has tasks by the data and not by the plan before
    x = cut_lineage(x.repartition(max(1, -(-x.count() // ROWS_PER_PARTITION))))
    from concurrent.futures import ThreadPoolExecutor
    points = weighted_points(x)
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, 2))) as ex:
        fits = ex.submit(fit_trees, points, ks, seeds[0])
        runs = fit_starts(points, ks, seeds)
        trees = fits.result()
    labels = {f"__kmeans_{k}": nearest_centre("features", r.centres) for k, r in runs.items()}
    labelled = cut_lineage(x.withColumns(labels | {f"__bisecting_{k}": tree_leaf("features", t) for k, t in trees.items()}))
    cfgs = [(alg, k) for k in ks for alg in ("kmeans", "bisecting")]
    found = score_labels(labelled, [f"__{alg}_{k}" for alg, k in cfgs], arm=arm)
    rows = []
    for alg, k in cfgs:
        s = found[f"__{alg}_{k}"]
        ratios = [min(t, n - t) / max(t, n - t) for _, n, t in s["clusters"]]
        valid = [r for r, (_, n, t) in zip(ratios, s["clusters"]) if n >= min_size and r >= min_ratio and 0 < t < n]
        balance = sum(valid) / len(valid) if valid else 0.0
        rows.append((alg, k, s["silhouette"], s["calinski_harabasz"], len(valid), balance,
                     composite_score(balance, s["silhouette"], s["calinski_harabasz"])))
    scores = spark.createDataFrame(rows, "algorithm string, n_clusters int, silhouette double, "
                                         "calinski_harabasz double, valid_clusters int, "
                                         "avg_balance_ratio double, composite double")
    ok = [r for r in rows if r[4] > 0]
    best = max(ok, key=lambda r: r[6]) if ok else None
    scores = scores.withColumn("best", F.lit(False) if best is None else
                               (F.col("algorithm") == best[0]) & (F.col("n_clusters") == best[1]))
    return scores, (labelled.select(*x.columns, F.col(f"__{best[0]}_{best[1]}").alias("cluster")) if best else None)


def cluster_profile(pred: DataFrame, arm: str, cluster: str = "cluster") -> DataFrame:
    """K-11: sizes, arm ratio, balance, family counts, mean diversity and the
    most frequent segment / industry per cluster."""
    g = pred.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("total_accounts"),
        F.count_if(F.col(arm) == 1).alias("treatment_accounts"),
        F.count_if(F.col(arm) == 0).alias("control_accounts"),
        F.sum("has_security").alias("security_accounts"),
        F.sum("has_resiliency").alias("resiliency_accounts"),
        F.avg("product_diversity").alias("avg_product_diversity"))
    g = (g.withColumn("treatment_ratio", F.col("treatment_accounts") / F.col("total_accounts"))
         .withColumn("balance_ratio", F.coalesce(F.try_divide(
             F.least("treatment_accounts", "control_accounts").cast("double"),
             F.nullif(F.greatest("treatment_accounts", "control_accounts"), F.lit(0)).cast("double")),
             F.lit(0.0))))
    seg = category_mode(pred, [cluster], "segment", "top_segment")
    ind = category_mode(pred, [cluster], "industry", "top_industry")
    return g.join(seg, cluster, "left").join(ind, cluster, "left")


def within_cluster_tests(pred: DataFrame, arm: str, value: str, valid: DataFrame,
                         cluster: str = "cluster", with_p: bool = True) -> DataFrame:
    """K-12 / E-18: treated vs control t test of ``value`` inside each valid
    cluster (heterogeneous effects)."""
    v = pred.join(valid.where("is_valid").select(cluster), cluster, "left_semi")
    return two_sample_t(v, arm, [value], by=[cluster], with_p=with_p)


def pca_2d(df: DataFrame, features: str = "features"):
    """K-13: 2-D projection of mean-centred features and explained variance ratios, from one
    cross-product matrix; the largest loading of each axis is positive."""
    first = df.select(vector_to_array(features).alias("v")).first()
    if first is None:
        return df.select(*df.columns, F.lit(0.0).alias("pc1"), F.lit(0.0).alias("pc2")).drop(features), [float("nan")] * 2
    dims = len(first["v"])
    v = vector_to_array(features)
    g = gram(df.select(*[v[j].alias(f"v{j}") for j in range(dims)]), [f"v{j}" for j in range(dims)])
    axes, shares = principal_axes(g, 2)

    def project(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        z = (np.stack(x.to_numpy()) - g.mean) @ axes
        return pd.Series([[*row, 0.0][:2] for row in z.tolist()])

    z = df.withColumn("__z", F.pandas_udf(project, "array<double>")(v))
    out = z.select(*df.columns, F.col("__z")[0].alias("pc1"), F.col("__z")[1].alias("pc2"))
    return out.drop(features), [float(x) for x in shares] + [0.0] * (2 - len(shares))
