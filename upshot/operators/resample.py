"""Bootstrap confidence intervals (B-1 .. B-3, E-12).

Poisson bootstrap: every row gets an independent Poisson(1) weight in every replicate. The
weights of eight replicates are the eight 16-bit numbers of md5(seed | row key | block of
replicates), put through the Poisson(1) distribution; they depend on nothing but the key, and
any SQL engine with md5 can draw them (:func:`weight_sql`).

Rows are never replicated. A task keeps one array of partial sums per (group, arm), replicates x
measures, and gives it once at its end (or when its arrays reach ``HELD_BYTES``), for all
measures at once; Spark adds the arrays by position. So what is shuffled is groups x tasks
arrays, and percentiles are taken over the replicates of a group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_HASH = 8
HELD_BYTES = 64 << 20
BLOCK_NUMBERS = 2 << 20  # rows x replicates weighted at once


def _thresholds() -> list[int]:
    """A 16-bit number has weight k if it reaches k of these: 65536 x P(weight < k) for k = 1, 2 ..."""
    total, out = 0.0, []
    for k in range(16):
        total += math.exp(-1.0) / math.factorial(k)
        if int(65536 * total) < 65536:
            out.append(int(65536 * total))
    return sorted(set(out))


THRESHOLDS = _thresholds()


def poisson_weights(keys: Sequence[str], seed: int, reps: int) -> np.ndarray:
    """Weights, keys x replicates, as small integers."""
    blocks = [b"%d" % b for b in range(-(-reps // PER_HASH))]
    digests = bytearray()
    for key in keys:
        start = hashlib.md5(f"{seed}|{key}|".encode())
        for b in blocks:
            h = start.copy()
            h.update(b)
            digests += h.digest()
    u = np.frombuffer(bytes(digests), dtype=">u2").reshape(len(keys), -1)[:, :reps]
    out = np.zeros(u.shape, dtype=np.uint8)
    for t in THRESHOLDS:
        out += u >= t
    return out


def weight_sql(seed: int, key: str, replicate: str = "r") -> str:
    """The DuckDB expression of a row's weight in a replicate."""
    digest = f"md5('{seed}|' || CAST({key} AS VARCHAR) || '|' || CAST({replicate} // {PER_HASH} AS VARCHAR))"
    u = f"CAST('0x' || substr({digest}, CAST(4 * ({replicate} % {PER_HASH}) + 1 AS INTEGER), 4) AS INTEGER)"
    return f"list_sum(list_transform([{u}], lambda u: {' + '.join(f'CAST(u >= {t} AS INTEGER)' for t in THRESHOLDS)}))"


def _partials(reps: int, seed: int, measures: int):
    def give(held: dict) -> Iterator[pa.RecordBatch]:
        for (g, a), sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.string()), pa.array([a], pa.int32()), pa.array([sums.ravel()], pa.list_(pa.float64()))],
                                             ["__g", "__arm", "sums"])

    def fn(batches):
        held: dict = {}
        step = max(1, BLOCK_NUMBERS // max(reps, 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                keys, group, arm = (part.column(c).to_pylist() for c in ("__key", "__g", "__arm"))
                x = np.column_stack([part.column(f"__x{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(measures)])
                there = ~np.isnan(x)
                wide = np.concatenate([there.astype(float), np.where(there, x, 0.0)], axis=1)
                weight = poisson_weights(keys, seed, reps).astype(float)
                places: dict = {}
                for i, cell in enumerate(zip(group, arm, strict=True)):
                    places.setdefault(cell, []).append(i)
                for cell, rows in places.items():
                    sums = weight[rows].T @ wide[rows]
                    if cell in held:
                        held[cell] += sums
                    else:
                        held[cell] = sums
                if len(held) * reps * 2 * measures * 8 > HELD_BYTES:
                    yield from give(held)
                    held = {}
        yield from give(held)

    return fn


def _group_key(by: Sequence[str]):
    return F.concat_ws("\u0001", *[F.coalesce(F.col(b).cast("string"), F.lit("\u0002")) for b in by]) if by else F.lit("")


def replicate_means(df: DataFrame, values: str | Sequence[str], key: str, arm: str | None = None,
                    by: Sequence[str] = (), reps: int = 1000, seed: int = 42) -> DataFrame:
    """Per (group, arm, replicate): the weighted mean of each of ``values`` (columns ``mean_<value>``), from one pass
    over the rows. ``key`` must be a unique row key; its text draws the weights. Rows of no arm, a null
    key or without any value don't count; a replicate without a weighted row has a null mean."""
    values = [values] if isinstance(values, str) else list(values)
    m = len(values)
    x = df.select(_group_key(by).alias("__g"), F.col(key).cast("string").alias("__key"),
                  (F.col(arm).cast("int") if arm else F.lit(1)).alias("__arm"),
                  *[F.col(v).cast("double").alias(f"__x{j}") for j, v in enumerate(values)])
    x = x.where(F.col("__key").isNotNull() & F.col("__arm").isNotNull())
    parts = x.mapInArrow(_partials(reps, seed, m), "__g string, __arm int, sums array<double>")
    sums = parts.select("__g", "__arm", F.posexplode("sums").alias("__at", "__v")).groupBy("__g", "__arm", "__at").agg(F.sum("__v").alias("__v"))
    wide = sums.groupBy("__g", "__arm", F.expr(f"__at div {2 * m}").alias("rep")).agg(
        *[F.sum(F.when(F.col("__at") % (2 * m) == j, F.col("__v"))).alias(f"__s{j}") for j in range(2 * m)])
    return wide.select("__g", "__arm", "rep", *[
        F.try_divide(F.col(f"__s{m + j}"), F.nullif(F.col(f"__s{j}"), F.lit(0.0))).alias(f"mean_{v}") for j, v in enumerate(values)])


def _groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.select(*by, _group_key(by).alias("__g")).distinct()


def _interval(per: DataFrame, names: Sequence[str], level: float) -> DataFrame:
    """(measure, ci_lower, ci_upper, replicates) of each group from the statistic's value per replicate."""
    ends = F.array(F.lit((1 - level) / 2), F.lit(1 - (1 - level) / 2))
    long = per.select("__g", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"__{n}").alias("s")) for n in names])).alias("p"))
    return (long.groupBy("__g", F.col("p.measure").alias("measure"))
            .agg(F.percentile("p.s", ends).alias("__ci"), F.count("p.s").alias("replicates"))
            .select("__g", "measure", F.col("__ci")[0].alias("ci_lower"), F.col("__ci")[1].alias("ci_upper"), "replicates"))


def bootstrap_diff_ci(df: DataFrame, values: str | Sequence[str], key: str, arm: str, by: Sequence[str] = (),
                      reps: int = 1000, seed: int = 42, level: float = 0.95,
                      relative: bool = False) -> DataFrame:
    """B-1 / B-3: percentile CI of mean(treated) - mean(control) (or of the
    relative effect (mt - mc) / mc when ``relative``) per group and, if ``values`` is a list, per ``measure``."""
    names = [values] if isinstance(values, str) else list(values)
    rm = replicate_means(df, names, key, arm, by, reps, seed)
    per = rm.groupBy("__g", "rep").agg(*[F.max(F.when(F.col("__arm") == a, F.col(f"mean_{n}"))).alias(f"__{n}_{a}") for n in names for a in (0, 1)])
    for n in names:
        diff = F.col(f"__{n}_1") - F.col(f"__{n}_0")
        per = per.withColumn(f"__{n}", F.try_divide(diff, F.nullif(F.col(f"__{n}_0"), F.lit(0.0))) if relative else diff)
    ci = _interval(per, names, level)
    ci = ci.drop("measure") if isinstance(values, str) else ci
    out = _groups(df, by).join(ci, "__g", "left") if by else ci
    return out.drop("__g")


def bootstrap_mean_ci(df: DataFrame, value: str, key: str, by: Sequence[str] = (),
                      reps: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """B-2: percentile CI of a mean (e.g. a win rate over closed rows) per group."""
    rm = replicate_means(df, value, key, None, by, reps, seed)
    ci = _interval(rm.withColumnRenamed(f"mean_{value}", f"__{value}"), [value], level).drop("measure", "replicates")
    out = _groups(df, by).join(ci, "__g", "left") if by else ci
    return out.drop("__g")


def average_treatment_effect(df: DataFrame, values: str | Sequence[str], key: str, arm: str,
                             reps: int = 1000, seed: int = 42) -> DataFrame:
    """E-12: ATE = mean(treated) - mean(control) with a bootstrap CI for each of ``values`` (column
    ``measure``); the effect is significant when the CI excludes 0; ``pct_effect`` is the ATE
    relative to the control mean (0 when that mean is not positive)."""
    names = [values] if isinstance(values, str) else list(values)
    t, c = F.col(arm) == 1, F.col(arm) == 0
    est = df.agg(F.count_if(t).alias("n_t"), F.count_if(c).alias("n_c"), F.array(*[
        F.struct(F.lit(n).alias("measure"), F.avg(F.when(t, F.col(n))).cast("double").alias("mean_t"),
                 F.avg(F.when(c, F.col(n))).cast("double").alias("mean_c")) for n in names]).alias("m"))
    est = est.select("n_t", "n_c", F.explode("m").alias("m")).select("m.*", "n_t", "n_c")
    ci = bootstrap_diff_ci(df, names, key, arm, (), reps, seed)
    return (est.join(ci, "measure", "left").withColumn("replicates", F.coalesce("replicates", F.lit(0)))
            .withColumn("estimate", F.col("mean_t") - F.col("mean_c"))
            .withColumn("significant", ~((F.col("ci_lower") <= 0) & (F.col("ci_upper") >= 0)))
            .withColumn("pct_effect", F.when(F.col("mean_c") > 0,
                                             F.col("estimate") / F.col("mean_c") * 100.0).otherwise(0.0)))
