"""Exact quantiles of groups of any size, without buffering a group in one task.

A mergeable sketch brackets each quantile: its rank error is below one in
``ACCURACY``, so the value asked for lies between the sketch's values ``MARGIN``
to either side. Then one pass counts what is below each bracket and builds the
histogram of the values inside, and the two ranks around the position
``p (n - 1)`` are picked from it and interpolated. Groups too small for the margin
are their own bracket. The result is exact and does not depend on the size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 0.001
SMALL = 4_000          # below it, MARGIN is less than two ranks
BROADCAST_GROUPS = 10_000


def small_side(df: DataFrame, limit: int = BROADCAST_GROUPS) -> DataFrame:
    """``df`` fetched and marked for broadcast if it has at most ``limit`` rows, else itself."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Columns ``by``, ``n`` (rows with a value) and ``q`` (array of the quantiles,
    linear interpolation). Groups with a null key are left out; without any
    value, a group has no row."""
    keys = list(by) or ["__all"]
    v = F.col(value).cast("double")
    src = df.select(*[F.col(b) for b in by], v.alias("__v")) if by else df.select(F.lit(0).alias("__all"), v.alias("__v"))
    src = src.where(F.col("__v").isNotNull())
    for b in by:
        src = src.where(F.col(b).isNotNull())
    edges = [max(0.0, min(1.0, p + s * MARGIN)) for p in probs for s in (-1, 1)]
    approx = F.percentile_approx("__v", F.array(*[F.lit(e) for e in edges]), ACCURACY)
    frame = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), approx.alias("__e"), F.min("__v").alias("__min"),
                                   F.max("__v").alias("__max"))
    brackets = []
    for i, p in enumerate(probs):
        whole = F.col("n") < SMALL
        low = F.when(whole | (edges[2 * i] <= 0.0), F.col("__min")).otherwise(F.col("__e")[2 * i])
        high = F.when(whole | (edges[2 * i + 1] >= 1.0), F.col("__max")).otherwise(F.col("__e")[2 * i + 1])
        brackets.append(F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high"),
                                 (F.lit(float(p)) * (F.col("n") - 1)).alias("at")))
    frame = small_side(frame.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], "n", F.array(*brackets).alias("__b")))
    same = [F.col(k) == F.col(f"__k{j}") for j, k in enumerate(keys)]
    placed = src.join(frame, same, "inner").select(*keys, "__v", "n", "__b")
    # values inside a bracket keep themselves; those below count at the bracket's start
    inside = (placed.select(*keys, "__v", "n", F.explode("__b").alias("__s")).where(F.col("__v") <= F.col("__s.high"))
              .select(*keys, "n", F.col("__s.i").alias("__i"), F.col("__s.at").alias("__at"),
                      F.when(F.col("__v") >= F.col("__s.low"), F.col("__v")).alias("__x"))
              .groupBy(*keys, "n", "__i", "__at", "__x").agg(F.count(F.lit(1)).alias("__c")))
    order = Window.partitionBy(*keys, "__i").orderBy(F.col("__x").asc_nulls_first())
    ranked = (inside.withColumn("__end", F.sum("__c").over(order)).withColumn("__start", F.col("__end") - F.col("__c"))
              .where(F.col("__x").isNotNull()))

    def holding(rank):
        return F.max(F.when((F.col("__start") <= rank) & (rank < F.col("__end")), F.col("__x")))

    lo, hi = F.floor("__at"), F.ceil("__at")
    got = (ranked.groupBy(*keys, "n", "__i", "__at").agg(holding(lo).alias("__lo"), holding(hi).alias("__hi"))
           .withColumn("__q", F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__at") - F.floor("__at"))))
    out = got.groupBy(*keys, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__q"))), lambda s: s["__q"]).alias("q"))
    return out if by else out.drop("__all")
