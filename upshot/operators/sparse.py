"""Account x product features in long and sparse form (A-8, K-1, K-3, K-4).

The list of products comes from the data, whatever its length: products are numbered in sorted
order over ranges, an account is a struct of ascending indices and values, and quantiles of a
product count the accounts without it as zeros, which are never written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .match import numbered


def product_index(long: DataFrame, product: str = "product_name") -> DataFrame:
    """(product, ``index``): the distinct products, numbered in sorted order from 0."""
    values = long.select(product).where(F.col(product).isNotNull()).distinct()
    return numbered(values, [product], "index").select(product, F.col("index").cast("int").alias("index"))


def product_amounts(table: DataFrame, key: Sequence[str], product: str = "product_name", amount: Column | None = None) -> DataFrame:
    """(key, product, ``value``): presence (1.0), or the sum of ``amount``, of each product a key has; zeros are left out."""
    value = F.lit(1.0) if amount is None else F.sum(amount.cast("double"))
    rows = table.where(F.col(product).isNotNull()).groupBy(*key, product)
    out = rows.agg(F.max(value).alias("value")) if amount is None else rows.agg(value.alias("value"))
    return out.where("value <> 0")


def sparse_quantiles(long: DataFrame, rows: int, probs: Sequence[float], product: str = "product_name") -> DataFrame:
    """(product, ``n``, ``q``): quantiles (linear interpolation) of each product's value over ``rows`` keys, those without the product
    counting as zeros. Values are counted before they are ranked; a product's distinct values are in one window."""
    hist = long.groupBy(product, "value").agg(F.count(F.lit(1)).alias("c"))
    zeros = long.groupBy(product).agg((F.lit(rows) - F.count(F.lit(1))).alias("c")).where("c > 0").select(product, F.lit(0.0).alias("value"), "c")
    order = Window.partitionBy(product).orderBy("value")
    ranked = hist.unionByName(zeros).withColumn("end", F.sum("c").over(order)).withColumn("start", F.col("end") - F.col("c"))
    aggs = [F.sum("c").alias("n")]
    for i, p in enumerate(probs):
        at = p * (rows - 1)
        for side, rank in (("lo", int(at)), ("hi", -int(-at // 1))):
            aggs.append(F.max(F.when((F.col("start") <= rank) & (F.lit(rank) < F.col("end")), F.col("value"))).alias(f"{side}{i}"))
    got = ranked.groupBy(product).agg(*aggs)
    return got.select(product, "n", F.array(*[
        F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (p * (rows - 1) - int(p * (rows - 1))) for i, p in enumerate(probs)]).alias("q"))


def sparse_scale(long: DataFrame, rows: int, product: str = "product_name") -> DataFrame:
    """K-3 in long form: values divided by their product's IQR (1 if that is zero). The median is not taken off, which would fill the
    zeros; it moves all keys alike and so no distance between them."""
    stats = sparse_quantiles(long, rows, (0.25, 0.75), product)
    width = F.when(F.col("q")[1] > F.col("q")[0], F.col("q")[1] - F.col("q")[0]).otherwise(F.lit(1.0))
    return long.join(stats.select(F.col(product).alias("__p"), width.alias("__w")), F.col(product) == F.col("__p")).withColumn(
        "value", F.col("value") / F.col("__w")).drop("__p", "__w")


def sparse_features(keys: DataFrame, long: DataFrame, key: Sequence[str], product: str = "product_name", out: str = "features") -> DataFrame:
    """K-4: ``keys`` (a row per key) with the struct (size, indices, values) of its products; keys without any have empty lists."""
    index = cut_lineage(product_index(long, product))
    size = index.count()
    named = long.join(index.select(F.col(product).alias("__p"), "index"), F.col(product) == F.col("__p"))
    packed = named.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("index", "value"))).alias("__v"))
    joined = keys.join(packed.select(*[F.col(c).alias(f"__{c}") for c in key], "__v"),
                       [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left").drop(*[f"__{c}" for c in key])
    pairs = F.coalesce("__v", F.array().cast("array<struct<index: int, value: double>>"))
    return joined.withColumn(out, F.struct(F.lit(size).alias("size"), F.transform(pairs, lambda p: p["index"]).alias("indices"),
                                           F.transform(pairs, lambda p: p["value"]).alias("values"))).drop("__v")
