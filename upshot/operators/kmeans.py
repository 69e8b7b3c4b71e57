"""K-means with all starts and all cluster numbers in one scan (K-5, K-7 .. K-9).

Equal points are added up first, to a point and its weight; then every step is one
pass over these, for all (cluster number, start) runs at once:

* start: k-means|| as in the separate fits. A run begins with one point and draws, in two
  rounds, points with a chance in proportion to their squared distance; the draws'
  weights are counted in one pass, and a small k-means++ picks the centres from them.
* iteration: a task multiplies its points with all runs' centres, and gives the
  sums, weight and cost of each centre as (centre, place, value); Spark adds these up by centre and
  place. A run whose centres have stopped moving leaves the following passes.

So there is a job an iteration, not one for each start. Points of numbers are packed into blocks of some
hundred for these passes. Bisecting trees of all cluster numbers share their passes in the same way (``fit_trees``).
The driver holds the centres, runs x k x dimensions numbers, whatever the rows. Draws come from a hash of seed, round
and point, so a repeated task draws the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship_package

ROWS_PER_PARTITION = 20_000
ROUNDS = 2          # of k-means||
OVERSAMPLE = 2      # expected draws of a round, in centres
CHUNK_NUMBERS = 1 << 19  # points x centres handled at once in a task
BLOCK_NUMBERS = 1 << 14  # of a block of packed points
TREE_ITERATIONS = 20  # of a split


@dataclass
class Run:
    """One start with one number of clusters."""

    k: int
    seed: int
    centres: np.ndarray
    cost: float = float("inf")
    iterations: int = 0
    done: bool = False


SPARSE = "struct<size: int, indices: array<int>, values: array<double>>"


def weighted_points(df: DataFrame, features: str = "features") -> DataFrame:
    """Distinct feature vectors ``x`` with their number ``w`` and a key
    ``h``, written once, in partitions of some thousand points. Features are an ML vector or an array
    of doubles, or a struct ``SPARSE`` with ascending indices, which stays sparse."""
    kind = df.schema[features].dataType
    x = df.select(vector_to_array(features).alias("x")) if kind.typeName() not in ("struct", "array") else df.select(F.col(features).alias("x"))
    points = cut_lineage(x.where(F.col("x").isNotNull()).groupBy("x").agg(F.count(F.lit(1)).alias("w")).withColumn("h", F.xxhash64("x")))
    n = points.count()
    return cut_lineage(points.repartition(max(1, -(-n // ROWS_PER_PARTITION)), "h"))


class Dense:
    """Rows of numbers."""

    def __init__(self, column: pa.Array | np.ndarray):
        if isinstance(column, np.ndarray):
            self.x = column
            return
        flat = column.flatten().to_numpy(zero_copy_only=False)
        self.x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))

    def __len__(self) -> int:
        return len(self.x)

    def distances(self, centres: np.ndarray) -> np.ndarray:
        return distances(self.x, centres)

    def sums(self, nearest: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
        take = np.zeros((len(self.x), k))
        take[np.arange(len(self.x)), nearest] = weight
        return take.T @ self.x

    def rows(self, which: np.ndarray) -> list[list[float]]:
        return self.x[which].tolist()


class Sparse:
    """Rows of (index, value) pairs; work is by pairs, not by dimensions."""

    def __init__(self, column: pa.Array):
        self.index = column.field("indices").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.value = column.field("values").flatten().to_numpy(zero_copy_only=False)
        self.n = column.field("indices").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = int(column.field("size")[0].as_py()) if len(column) else 0
        self.owner = np.repeat(np.arange(len(self.n)), self.n)

    def __len__(self) -> int:
        return len(self.n)

    def _by_row(self, x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        at = np.concatenate([[0], np.cumsum(self.n)])
        return total[at[1:]] - total[at[:-1]]

    def distances(self, centres: np.ndarray) -> np.ndarray:
        dots = self._by_row(self.value[:, None] * centres.T[self.index])
        norm = self._by_row(np.square(self.value)[:, None])
        return np.maximum(norm + (centres * centres).sum(axis=1)[None, :] - 2.0 * dots, 0.0)

    def sums(self, nearest: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
        place = nearest[self.owner] * self.size + self.index
        return np.bincount(place, self.value * weight[self.owner], minlength=k * self.size).reshape(k, self.size)

    def rows(self, which: np.ndarray) -> list[list[float]]:
        out = np.zeros((len(which), self.size))
        back = np.full(len(self.n), -1)
        back[which] = np.arange(len(which))
        mine = back[self.owner] >= 0
        out[back[self.owner[mine]], self.index[mine]] = self.value[mine]
        return out.tolist()


def _points(column: pa.Array) -> Dense | Sparse:
    return Sparse(column) if pa.types.is_struct(column.type) else Dense(column)


def _matrix(column: pa.Array) -> np.ndarray:
    return Dense(column).x


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points x centres. Both are shifted to the centres' mean, so that far-off
    data lose no digits."""
    middle = centres.mean(axis=0)
    a, b = x - middle, centres - middle
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T, 0.0)


def _packed(points: DataFrame) -> DataFrame:
    """Points of numbers in blocks, a row each, written once; sparse ones as they are."""
    if points.schema["x"].dataType.typeName() != "array":
        return points

    def pack(batches):
        for batch in batches:
            x = _matrix(batch.column("x"))
            w, h = (batch.column(c).to_numpy() for c in ("w", "h"))
            step = max(1, BLOCK_NUMBERS // max(x.shape[1], 1))
            cut = range(0, len(x), step)
            yield pa.RecordBatch.from_arrays([pa.array([c[at:at + step].tobytes() for at in cut], pa.binary()) for c in (x, w, h)], ["x", "w", "h"])

    return cut_lineage(points.mapInArrow(pack, "x binary, w binary, h binary"))


def _chunks(batches, width: int):
    """Points, weights and keys, of packed or single points."""
    numbers = max(width, 1)
    for batch in batches:
        if pa.types.is_binary(batch.column("x").type):
            for x, w, h in zip(*(batch.column(c).to_pylist() for c in ("x", "w", "h")), strict=True):
                w, h = np.frombuffer(w, dtype=np.int64), np.frombuffer(h, dtype=np.int64)
                x = np.frombuffer(x).reshape(len(w), -1)
                step = max(1, CHUNK_NUMBERS // numbers)
                for at in range(0, len(w), step):
                    yield Dense(x[at:at + step]), w[at:at + step], h[at:at + step]
            continue
        step = max(1, CHUNK_NUMBERS // numbers)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield _points(part.column("x")), part.column("w").to_numpy(), part.column("h").to_numpy()


def _bounds(groups: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(int)


def _collect(points: DataFrame, run, fields: str):
    """Rows added up by (slot, place): a bounded table."""
    parts = points.mapInArrow(run, fields)
    return parts.groupBy("slot", "place").agg(F.sum("value").alias("value")).toPandas()


def _rows(values: np.ndarray) -> pa.RecordBatch:
    """(slot, place, value) of a table slots x places, without zeros."""
    slot, place = np.nonzero(values)
    return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(values[slot, place])],
                                      ["slot", "place", "value"])


def _table(rows, slots: int, places: int) -> np.ndarray:
    out = np.zeros((slots, places))
    out[rows["slot"].to_numpy(dtype=int), rows["place"].to_numpy(dtype=int)] = rows["value"].to_numpy(dtype=float)
    return out


FIELDS = "slot int, place int, value double"


def _assign(points: DataFrame, groups: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the centres of several runs: sums of each centre's points, their weight, and their cost."""
    at, stacked = _bounds(groups), np.concatenate(groups)
    held = points.sparkSession.sparkContext.broadcast((at, stacked))  # runs x k x dimensions numbers

    def run(batches):
        at, stacked = held.value
        total = np.zeros((len(stacked), stacked.shape[1] + 2))
        for x, w, _ in _chunks(batches, len(stacked)):
            d = np.ascontiguousarray(x.distances(stacked).T)  # a row a centre
            took = np.empty_like(d)
            for a, b in zip(at[:-1], at[1:]):
                least, nearest = d[a].copy(), np.zeros(len(x), dtype=np.int32)
                for j in range(a + 1, b):
                    np.putmask(nearest, d[j] < least, j - a)
                    np.minimum(least, d[j], out=least)
                for j in range(a, b):
                    np.multiply(nearest == j - a, w, out=took[j])
                total[a:b, -1] += took[a:b] @ least
                if isinstance(x, Sparse):
                    total[a:b, :-2] += x.sums(nearest, w, b - a)
            total[:, -2] += took.sum(axis=1)
            if isinstance(x, Dense):
                total[:, :-2] += took @ x.x
        yield _rows(total)

    got = _table(_collect(points, run, FIELDS), len(stacked), stacked.shape[1] + 2)
    held.destroy()
    return got[:, :-2], got[:, -2], got[:, -1]


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each key and seed."""
    with np.errstate(over="ignore"):
        z = h.view(np.uint64) ^ (np.uint64(seed % (1 << 64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(odd)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / float(1 << 53)


def _draw(points: DataFrame, runs: Sequence[tuple[int, int]], candidates: list[np.ndarray], cost: np.ndarray, number: int) -> list[np.ndarray]:
    """Draws of one k-means|| round for every (k, seed): some ``OVERSAMPLE * k`` points each."""
    at, stacked = _bounds(candidates), np.concatenate(candidates)
    held = points.sparkSession.sparkContext.broadcast((at, stacked, cost))

    def run(batches):
        at, stacked, cost = held.value
        for x, w, h in _chunks(batches, len(stacked)):
            d = x.distances(stacked)
            for r, (k, seed) in enumerate(runs):
                if cost[r] <= 0:
                    continue
                chance = OVERSAMPLE * k * w * d[:, at[r]:at[r + 1]].min(axis=1) / cost[r]
                hit = np.flatnonzero(_uniform(h, seed * 1_000_003 + 31 * k + number) < chance)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), r, dtype=np.int32)), pa.array(x.rows(hit), pa.list_(pa.float64()))], ["run", "x"])

    got = points.mapInArrow(run, "run int, x array<double>").toPandas()  # some 2 k rows a run
    held.destroy()
    out = []
    for r, c in enumerate(candidates):
        new = got.loc[got["run"] == r, "x"]
        rows = np.array(sorted(map(tuple, new))) if len(new) else np.zeros((0, c.shape[1]))
        out.append(np.concatenate([c, rows]))
    return out


def _plus_plus(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ over few candidates, and some Lloyd steps."""
    rng = np.random.default_rng(seed)
    weight = np.maximum(weight, 1e-12)
    if len(candidates) <= k:
        return candidates
    chosen = [int(rng.choice(len(candidates), p=weight / weight.sum()))]
    near = distances(candidates, candidates[chosen])[:, 0]
    while len(chosen) < k:
        p = weight * near
        if p.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(candidates), p=p / p.sum())))
        near = np.minimum(near, distances(candidates, candidates[chosen[-1:]])[:, 0])
    centres = candidates[chosen]
    for _ in range(30):
        nearest = distances(candidates, centres).argmin(axis=1)
        new = centres.copy()
        for j in range(len(centres)):
            mine = nearest == j
            if mine.any():
                new[j] = np.average(candidates[mine], axis=0, weights=weight[mine])
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def _dense(x) -> list[float]:
    if not hasattr(x, "indices"):
        return list(x)
    out = [0.0] * x["size"]
    for i, v in zip(x["indices"], x["values"], strict=True):
        out[i] = v
    return out


def starts(points: DataFrame, runs: Sequence[tuple[int, int]], single: DataFrame | None = None) -> list[np.ndarray]:
    """First centres of every (k, seed) run by k-means||; ``single`` are the points if ``points`` are packed."""
    seeds = sorted({seed for _, seed in runs})
    firsts = (points if single is None else single).agg(*[F.min_by("x", F.xxhash64("h", F.lit(s))).alias(f"s{s}") for s in seeds]).first()
    candidates = [np.array([_dense(firsts[f"s{seed}"])]) for _, seed in runs]
    for number in range(ROUNDS):
        _, _, cost = _assign(points, candidates)
        at = _bounds(candidates)
        candidates = _draw(points, runs, candidates, np.add.reduceat(cost, at[:-1]), number)
    candidates = [np.unique(c, axis=0) for c in candidates]
    _, weight, _ = _assign(points, candidates)
    at = _bounds(candidates)
    return [_plus_plus(c, weight[a:b], k, seed) for c, a, b, (k, seed) in zip(candidates, at[:-1], at[1:], runs, strict=True)]


def fit_starts(points: DataFrame, ks: Sequence[int], seeds: Sequence[int], max_iter: int = 300, tol: float = 1e-4) -> dict[int, Run]:
    """The run of least cost for each number of clusters; ``points`` of :func:`weighted_points`.
    A run ends when no centre moves by more than ``tol``."""
    ship_package(points.sparkSession)
    wanted = [(k, s) for k in ks for s in seeds]
    if points.isEmpty():
        return {}
    single, points = points, _packed(points)
    runs = [Run(k, s, c) for (k, s), c in zip(wanted, starts(points, wanted, single), strict=True)]
    for _ in range(max_iter):
        live = [r for r in runs if not r.done]
        if not live:
            break
        sums, weight, cost = _assign(points, [r.centres for r in live])
        at = _bounds([r.centres for r in live])
        for r, a, b in zip(live, at[:-1], at[1:], strict=True):
            n = weight[a:b, None]
            new = np.where(n > 0, sums[a:b] / np.where(n > 0, n, 1), r.centres)
            r.cost, r.iterations = float(cost[a:b].sum()), r.iterations + 1  # of the centres before the step
            r.done = bool((np.square(new - r.centres).sum(axis=1) <= tol * tol).all())
            r.centres = new
    _, _, cost = _assign(points, [r.centres for r in runs])
    at = _bounds([r.centres for r in runs])
    for r, c in zip(runs, np.add.reduceat(cost, at[:-1]), strict=True):
        r.cost = float(c)
    return {k: min((r for r in runs if r.k == k), key=lambda r: (r.cost, r.seed)) for k in ks}


@dataclass
class Split:
    """A cluster's division in two; ``parent`` is the split and side that its points come from."""

    parent: tuple[int, int] | None
    sides: np.ndarray  # two centres; infinite for a side without points
    weight: np.ndarray
    cost: np.ndarray
    done: bool = False


@dataclass
class Tree:
    """A tree of clusters: centres by place in the tree (1, children of p at 2 p and 2 p + 1), and the leaves' numbers."""

    centres: dict[int, np.ndarray]
    leaves: dict[int, int]

    def labels(self, x: Dense | Sparse) -> np.ndarray:
        """Leaf of each point, by the nearer child from the root on."""
        places = sorted(self.centres)
        d = x.distances(np.array([self.centres[p] for p in places]))
        at, column = np.ones(len(x), dtype=np.int64), {p: i for i, p in enumerate(places)}
        for p in places:
            kids = [c for c in (2 * p, 2 * p + 1) if c in column]
            if kids:
                mine = np.flatnonzero(at == p)
                far = kids[-1:] if len(kids) == 1 else np.where(d[mine, column[kids[1]]] < d[mine, column[kids[0]]], kids[1], kids[0])
                at[mine] = far
        out = np.zeros(len(x), dtype=np.int32)
        for p, number in self.leaves.items():
            out[at == p] = number
        return out


class _Noise:
    """``java.util.Random`` doubles, as Spark ML's bisecting k-means draws them."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def draw(self, n: int) -> np.ndarray:
        return np.array([((self._bits(26) << 27) + self._bits(27)) / float(1 << 53) for _ in range(n)])


def _divide(points: DataFrame, splits: list[Split]) -> None:
    """One pass: the points of every split that isn't done go to the nearer side, whose centre moves to their mean."""
    given = [(s.parent, s.sides, s.done) for s in splits]
    dims = splits[0].sides.shape[1]
    held = points.sparkSession.sparkContext.broadcast(given)

    def run(batches):
        given = held.value
        stacked = np.concatenate([np.where(np.isfinite(sides), sides, 0.0) for _, sides, _ in given])
        gone = ~np.isfinite(np.array([sides[:, 0] for _, sides, _ in given])).ravel()
        total = np.zeros((len(stacked), dims + 2))
        for x, w, _ in _chunks(batches, len(stacked)):
            d = x.distances(stacked)
            d[:, gone] = np.inf
            member = {}
            for k, (parent, _, done) in enumerate(given):
                mine = member[parent] if parent else np.ones(len(x), dtype=bool)
                right = d[:, 2 * k + 1] < d[:, 2 * k]
                member[k, 0], member[k, 1] = mine & ~right, mine & right
                if not done:
                    side, weight = right.astype(np.int64), w * mine
                    total[2 * k:2 * k + 2, :-2] += x.sums(side, weight, 2)
                    total[2 * k:2 * k + 2, -2] += np.bincount(side, weight, minlength=2)
                    total[2 * k:2 * k + 2, -1] += np.bincount(side, weight * np.where(mine, d[np.arange(len(x)), 2 * k + side], 0.0), minlength=2)
        yield _rows(total)

    got = _table(_collect(points, run, FIELDS), 2 * len(splits), dims + 2).reshape(len(splits), 2, dims + 2)
    held.destroy()
    for s, g in zip(splits, got, strict=True):
        if s.done:
            continue
        n = g[:, dims]
        new = np.where(n[:, None] > 0, g[:, :dims] / np.where(n > 0, n, 1)[:, None], np.inf)
        moved = np.where(n > 0, np.square(np.where(np.isfinite(new), new, 0.0) - np.where(np.isfinite(s.sides), s.sides, 0.0)).sum(axis=1), 0.0)
        s.done = bool(np.array_equal(new, s.sides))  # the same points go there from now on
        s.sides, s.weight, s.cost = new, n, np.maximum(g[:, dims + 1] - n * moved, 0.0)


def fit_trees(points: DataFrame, ks: Sequence[int], seed: int, max_iter: int = TREE_ITERATIONS) -> dict[int, Tree]:
    """K-6: bisecting k-means for all cluster numbers at once, in ``max_iter`` passes a level at most, with the rules of Spark ML's:
    every level divides the clusters that can be, the largest if not all are needed, each from two points beside its mean.
    Equal divisions of several trees are made once; one whose centres have stopped moving is done."""
    ship_package(points.sparkSession)
    if points.isEmpty():
        return {}
    dims = len(_dense(points.first()["x"]))
    points = _packed(points)
    sums, weight, cost = _assign(points, [np.zeros((1, dims))])
    mean = sums[0] / weight[0]
    root = (None, mean, weight[0], max(cost[0] - weight[0] * float(mean @ mean), 0.0))  # split and side, centre, weight, cost
    splits: list[Split] = []
    known: dict = {}
    clusters = {k: {1: root} for k in ks}
    active = {k: {1: root} for k in ks}
    noise, needed = {k: _Noise(seed) for k in ks}, {k: k - 1 for k in ks}
    while True:
        level: list[tuple[int, int, int]] = []
        for k in ks:
            able = [p for p, (_, _, n, c) in sorted(active[k].items()) if n >= 1 and c > np.finfo(float).eps * n] if needed[k] > 0 else []
            if len(able) > needed[k]:
                able = sorted(able, key=lambda p: -active[k][p][2])[:needed[k]]
            for p in able:
                parent, centre, _, _ = active[k][p]
                beside = 1e-4 * np.sqrt(float(centre @ centre)) * noise[k].draw(dims)
                sides = np.array([centre - beside, centre + beside])
                key = parent, sides.tobytes()
                if key not in known:
                    known[key] = len(splits)
                    splits.append(Split(parent, sides, np.zeros(2), np.zeros(2)))
                level.append((k, p, known[key]))
            needed[k] -= len(able)
        if not level:
            break
        for _ in range(max_iter):
            if all(s.done for s in splits):
                break
            _divide(points, splits)
        for s in splits:
            s.done = True
        active = {k: {} for k in ks}
        for k, p, number in level:
            s = splits[number]
            for side in (0, 1):
                if s.weight[side] > 0:
                    active[k][2 * p + side] = ((number, side), s.sides[side], s.weight[side], s.cost[side])
        for k in ks:
            clusters[k] |= active[k]

    def leaves(of: dict, p: int) -> list[int]:
        below = [x for c in (2 * p, 2 * p + 1) if c in of for x in leaves(of, c)]
        return below or [p]

    return {k: Tree({p: c[1] for p, c in clusters[k].items()}, {p: i for i, p in enumerate(leaves(clusters[k], 1))}) for k in ks}


def tree_leaf(features: str, tree: Tree) -> Column:
    """Number of a tree's leaf, for a feature vector."""
    def leaf(x: pd.Series) -> pd.Series:
        return pd.Series(tree.labels(Dense(np.stack(x.to_numpy()))) if len(x) else [], dtype="int32")

    return F.pandas_udf(leaf, "int")(vector_to_array(features))


def nearest_centre(features: str, centres: np.ndarray) -> Column:
    """Number of the nearest of some centres, for a feature vector."""
    def nearest(x: pd.Series) -> pd.Series:
        return pd.Series(distances(np.stack(x.to_numpy()), centres).argmin(axis=1) if len(x) else [], dtype="int32")

    return F.pandas_udf(nearest, "int")(vector_to_array(features))


def assign_nearest(df: DataFrame, centres: np.ndarray, features: str = "features", out: str = "cluster") -> DataFrame:
    """``df`` with the nearest centre's number, for sparse (or array) features."""
    ship_package(df.sparkSession)
    names = df.columns

    def run(batches):
        for batch in batches:
            found = _points(batch.column(names.index(features))).distances(centres).argmin(axis=1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())]))


def score_labels(df: DataFrame, labels: Sequence[str], features: str = "features", arm: str | None = None) -> dict[str, dict]:
    """K-7, K-8 and the counts of K-9 for several labellings of the same rows, in two passes for all: silhouette with squared
    Euclidean distances, Calinski-Harabasz, and each cluster's rows and treated rows.

    Distances to a cluster's points come from its count, sum vector and sum of squared norms."""
    spark = df.sparkSession
    ship_package(spark)
    x = df.select(vector_to_array(features).alias("x"), F.array(*[F.col(c).cast("int") for c in labels]).alias("c"),
                  (F.col(arm).cast("int") if arm else F.lit(0)).alias("arm"))
    x = cut_lineage(x.where(F.col("x").isNotNull()))
    head = x.agg(F.max(F.array_max("c")), F.count(F.lit(1))).first()
    if not head[1]:
        return {}
    top, dims = int(head[0]) + 1, len(x.first()["x"])
    # sums around a point near the data lose no digits
    origin = np.array(x.agg(*[F.avg(F.col("x")[j]) for j in range(dims)]).first(), dtype=float) if dims <= 1000 else np.zeros(dims)
    n_labels = len(labels)

    def moments(batches):
        total = np.zeros((n_labels * top, dims + 3))
        for b in batches:
            v, c, t = _matrix(b.column("x")) - origin, _matrix(b.column("c")).astype(int), b.column("arm").to_numpy()
            wide = np.column_stack([v, (v * v).sum(axis=1), np.ones(len(v)), t])
            for k in range(n_labels):
                np.add.at(total, k * top + c[:, k], wide)
        yield _rows(total)

    got = _table(_collect(x, moments, FIELDS), n_labels * top, dims + 3).reshape(n_labels, top, dims + 3)

    def widths(batches):
        total = np.zeros((n_labels, 1))
        for b in batches:
            v, c = _matrix(b.column("x")) - origin, _matrix(b.column("c")).astype(int)
            norm = (v * v).sum(axis=1)
            for k in range(n_labels):
                used = np.flatnonzero(got[k, :, dims + 1])
                y, q, n = got[k, used, :dims], got[k, used, dims], got[k, used, dims + 1]
                mean = np.maximum(norm[:, None] + (q / n)[None, :] - 2.0 * v @ (y / n[:, None]).T, 0.0)
                rows, mine = np.arange(len(v)), np.searchsorted(used, c[:, k])
                size = n[mine]
                own = mean[rows, mine] * size / np.maximum(size - 1, 1)  # the point itself is at distance 0
                mean[rows, mine] = np.inf
                other = mean.min(axis=1)
                wide = np.maximum(own, other)
                s = np.where((size > 1) & (wide > 0) & np.isfinite(other), (other - own) / np.where(wide > 0, wide, 1), 0.0)
                total[k, 0] += s.sum()
        yield _rows(total)

    sil = _table(_collect(x, widths, FIELDS), n_labels, 1)[:, 0]
    out = {}
    for k, label in enumerate(labels):
        used = np.flatnonzero(got[k, :, dims + 1])
        y, q, n, t = got[k, used, :dims], got[k, used, dims], got[k, used, dims + 1], got[k, used, dims + 2]
        rows, clusters = n.sum(), len(used)
        within = float((q - (y * y).sum(axis=1) / n).sum())
        between = float(((y * y).sum(axis=1) / n).sum() - np.square(y.sum(axis=0)).sum() / rows)
        ch = float("nan") if clusters < 2 or rows <= clusters else float("inf") if within <= 0 else float((between / (clusters - 1)) / (within / (rows - clusters)))
        out[label] = {"silhouette": float(sil[k] / rows) if clusters > 1 else float("nan"), "calinski_harabasz": ch,
                      "clusters": [(int(c), int(a), int(b)) for c, a, b in zip(used, n, t, strict=True)]}
    return out
