"""Propensity scores and 1:1 matching without replacement (M-1 .. M-8, J-9, J-10).

Two rules: the closest free pair first, until none is left (``closest``), or the treated in
order of score, each with its nearest free control (``score_order``).

Units of equal score and arm are a block: a row with their number, and units take part by their
rank in it, which is counted over ranges of ids (:func:`numbered`). So a common score is one
row whatever its size, and two common scores a step apart pair in one step.

``closest`` depends on no order of processing, so pairs that nothing closer can disturb are settled
at once: blocks are cut into buckets of ``BUCKET`` in order of score, and a bucket settles its pairs in
order of distance, as long as they are closer than the nearest free block outside; a pair that isn't
holds back its blocks, and with them what depends on them. Matched units, and blocks without a
partner within the caliper, leave; buckets are cut anew at shifted borders, until no pair is possible.

``score_order`` serves all buckets at once, again and again, each with what the buckets before took in the round
before, until nothing changes. Rounds are as many as buckets that really pass shortage on to each other, and each
leaves jobs and plans in the driver; so these buckets have ``ORDER_BUCKET`` blocks, as many as a task holds well.

Strata, or the cells of a grid, are matched together: blocks are keyed by their cell.
"""

from __future__ import annotations

import bisect
import heapq
from array import array
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_category, to_number, uniform
from ..session import cut_lineage
from .ranks import mann_whitney


# ---- M-1 ------------------------------------------------------------------------------

def propensity_scores(df: DataFrame, label: str, numeric: Sequence[str],
                      categorical: Sequence[str] = (), out: str = "propensity_score",
                      c: float = 1.0, max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    """M-1: P(treated | covariates) from an L2 logistic regression.

    Categories are filled with 'Unknown' and dummy-coded with the
    alphabetically first level dropped; missing numbers become 0; every
    feature is centred and divided by its population standard deviation; the
    penalty C = 1 on the sum of losses is ``regParam = 1 / (n C)`` on Spark's
    mean loss, with an unpenalised intercept."""
    x = df
    for col in numeric:
        x = x.withColumn(f"__n_{col}", to_number(col))
    for col in categorical:
        x = x.withColumn(f"__c_{col}", clean_category(col))
    # several fits read the input: materialise it once in the shared checkpoint folder
    x = cut_lineage(x)
    stages, feats = [], [f"__n_{c_}" for c_ in numeric]
    for col in categorical:
        # descending order puts the alphabetically first level last; dropLast removes it
        stages.append(StringIndexer(inputCol=f"__c_{col}", outputCol=f"__i_{col}",
                                    stringOrderType="alphabetDesc", handleInvalid="error"))
        stages.append(OneHotEncoder(inputCol=f"__i_{col}", outputCol=f"__o_{col}", dropLast=True,
                                    handleInvalid="error"))
        feats.append(f"__o_{col}")
    stages.append(VectorAssembler(inputCols=feats, outputCol="__raw"))
    stages.append(StandardScaler(inputCol="__raw", outputCol="__std", withMean=True, withStd=True))
    prep = Pipeline(stages=stages).fit(x)
    z = prep.transform(x)
    n = z.count()
    # sample -> population standard deviation: multiply by sqrt(n / (n - 1))
    fac = (n / (n - 1.0)) ** 0.5 if n > 1 else 1.0
    arr = F.transform(vector_to_array("__std"), lambda v: v * F.lit(fac))
    from pyspark.ml.functions import array_to_vector
    z = z.withColumn("__features", array_to_vector(arr)).withColumn("__label", F.col(label).cast("double"))
    lr = LogisticRegression(featuresCol="__features", labelCol="__label", regParam=1.0 / (n * c),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
    model = lr.fit(z)
    scored = model.transform(z).withColumn(out, vector_to_array("probability")[1])
    keep = list(df.columns) + [out]
    return scored.select(*keep)


# ---- J-9 / J-10 / M-2 / M-3 -------------------------------------------------------------

BUCKET = 10_000
ORDER_BUCKET = 500_000   # of score order
RANGE = 10_000   # units of one row of a range of pairs
RANGES = "g string, ts double, tf long, cs double, cf long, n long, distance double, b long"


def numbered(df: DataFrame, order: Sequence[str], out: str, within: Sequence[str] = ()) -> DataFrame:
    """Rows numbered 0, 1, 2 ... by ``order`` (whose first columns are ``within``) over all rows or those
    of equal ``within``. Rows are dealt by ranges of ``order``, numbered in each range, and the counts
    of the ranges before are added; a large group lies in many ranges."""
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    keys = list(within)
    local = Window.partitionBy("__p", *keys).orderBy(*order)
    sizes = dealt.groupBy("__p", *keys).agg(F.count(F.lit(1)).alias("__n"))
    # a row for each range that has the group
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("__p").alias("__q"), *[F.col(k).alias(f"__k_{k}") for k in keys],
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    if keys:  # a row for each group and its ranges: too many to broadcast
        offsets = offsets.hint("merge")
    same = F.col("__p") == F.col("__q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return (dealt.withColumn("__r", F.row_number().over(local) - 1).join(offsets, same)
            .withColumn(out, F.col("__r") + F.col("__o")).drop("__p", "__q", "__r", "__o", *[f"__k_{k}" for k in keys]))


def _settle(blocks: list[list], caliper: float | None, outside: Sequence) -> list[tuple[int, int, int, float]]:
    """(treated block, control block, units, distance) of one bucket, closest first. Blocks are
    [score, arm, units] in order of (score, arm). ``outside``: scores just beyond the bucket, (control below,
    control above, treated below, treated above), None if there is none."""
    left = [-1, *range(len(blocks) - 1)]
    right = [*range(1, len(blocks)), -1]
    held = [False] * len(blocks)
    free = [b[2] for b in blocks]
    heap: list = []

    def offer(i: int, j: int) -> None:
        if i < 0 or j < 0 or blocks[i][1] == blocks[j][1]:
            return
        t, c = (i, j) if blocks[i][1] else (j, i)
        d = blocks[j][0] - blocks[i][0]
        if caliper is None or d <= caliper:
            heapq.heappush(heap, (d, blocks[t][0], blocks[c][0], t, c))

    def safe(d: float, s: float, below, above) -> bool:
        # at equal distance the lower score goes first
        return (below is None or d < s - below) and (above is None or d <= above - s)

    for k in range(len(blocks) - 1):
        offer(k, k + 1)
    pairs = []
    while heap:
        d, ts, cs, t, c = heapq.heappop(heap)
        if not free[t] or not free[c]:
            continue
        if held[t] or held[c] or not (safe(d, ts, outside[0], outside[1]) and safe(d, cs, outside[2], outside[3])):
            held[t] = held[c] = True            # what is farther waits for these two
            continue
        n = min(free[t], free[c])
        pairs.append((t, c, n, d))
        for k in (t, c):
            free[k] -= n
            if not free[k]:
                i, j = left[k], right[k]
                if i >= 0:
                    right[i] = j
                if j >= 0:
                    left[j] = i
                offer(i, j)
    return pairs


def _serve(treated: list[list], controls: list[list], caliper: float | None, below, above) -> tuple[list[tuple[int, int, int, float]], bool]:
    """(treated block, control block, units, distance) with treated blocks [score, units] served in order, each by its
    nearest free control; blocks are in order of score. ``below`` and ``above``: free control
    scores just beyond those given. The flag tells that one beyond was nearer: what follows is open."""
    score, free = [c[0] for c in controls], [c[1] for c in controls]
    up, down = array("q", range(len(score) + 1)), array("q", range(len(score) + 1))  # next free one, itself included; down[i] is for i - 1

    def find(to: array, i: int) -> int:
        root = i
        while to[root] != root:
            root = to[root]
        while to[i] != root:
            to[i], i = root, to[i]
        return root

    pairs = []
    for t, (s, n) in enumerate(treated):
        at = bisect.bisect_right(score, s)
        while n:
            j, i = find(up, at), find(down, at) - 1
            dj = score[j] - s if j < len(score) else None
            di = s - score[i] if i >= 0 else None
            k, d = (i, di) if dj is None or (di is not None and di <= dj) else (j, dj)
            inside = d is not None and (caliper is None or d <= caliper)
            reach = d if inside else caliper
            if below is not None and (reach is None or s - below <= reach):
                return pairs, True
            if above is not None and (reach is None or above - s < reach or (not inside and above - s == reach)):
                return pairs, True
            if not inside:
                break
            q = min(n, free[k])
            pairs.append((t, k, q, d))
            n, free[k] = n - q, free[k] - q
            if not free[k]:
                up[k], down[k + 1] = k + 1, k
    return pairs, False


def _range_rows(rows: list[tuple]):
    """Ranges of pairs as a frame, in pieces of at most ``RANGE`` units."""
    import pandas as pd
    out = []
    for g, ts, tf, cs, cf, n, d, b in rows:
        for at in range(0, n, RANGE):
            out.append((g, ts, tf + at, cs, cf + at, min(RANGE, n - at), d, b))
    names = [f.split()[0] for f in RANGES.split(", ")]
    kinds = dict(zip(names, ("object", "float64", "int64", "float64", "int64", "int64", "float64", "int64"), strict=True))
    return pd.DataFrame(out, columns=names).astype(kinds)


def _edges(ends: DataFrame, lo: str, hi: str, name: str, step: int = 1) -> DataFrame:
    """Adds ``name``_below and ``name``_above: of the cell's buckets ``step`` or more before, the last ``hi``, and of those
    after, the first ``lo``. A row per cell and bucket."""
    order = Window.partitionBy("g").orderBy("b")
    before, after = order.rangeBetween(Window.unboundedPreceding, -step), order.rangeBetween(step, Window.unboundedFollowing)
    return (ends.withColumn(f"{name}_below", F.last(hi, ignorenulls=True).over(before))
            .withColumn(f"{name}_above", F.first(lo, ignorenulls=True).over(after)))


def _with_partner(blocks: DataFrame) -> DataFrame:
    """Blocks whose cell has the other arm, and within the caliper: in their own or a neighbouring caliper-wide
    step. The others can't match, now or later."""
    step = F.when(F.col("cal").isNull(), F.lit(0.0)).otherwise(F.floor(F.col("s") / F.col("cal")).cast("double"))
    cell = blocks.withColumn("__step", F.when(F.col("cal") == 0, F.col("s")).otherwise(step))
    near = F.when(F.col("cal") > 0, F.array(*[F.col("__step") + k for k in (-1, 0, 1)])).otherwise(F.array("__step"))
    other = cell.select("g", "arm", "cal", "__step").distinct().select(
        F.col("g").alias("__g"), (1 - F.col("arm")).alias("__arm"), F.explode(near).alias("__at")).distinct()
    return cell.join(other, (F.col("g") == F.col("__g")) & (F.col("arm") == F.col("__arm")) & (F.col("__step") == F.col("__at")), "left_semi").drop("__step")


def _closest_first(blocks: DataFrame, size: int) -> list[DataFrame]:
    """Ranges of pairs of each pass."""
    found, number = [], 0
    free = blocks.withColumn("used", F.lit(0).cast("long"))
    while True:
        free = cut_lineage(_with_partner(free))
        count = free.count()
        if not count:
            return found
        number += 1
        dealt = numbered(free, ["g", "s", "arm"], "o").withColumn("b", F.expr(f"(o + {size // 2 * (number % 2)}) div {size}"))
        dealt = cut_lineage(dealt)
        ends = dealt.groupBy("g", "b").agg(*[f(F.when(F.col("arm") == k, F.col("s"))).alias(f"{name}{k}") for k in (0, 1)
                                             for name, f in (("lo", F.min), ("hi", F.max))])
        ends = _edges(_edges(ends, "lo0", "hi0", "c"), "lo1", "hi1", "t").select(
            F.col("g").alias("__g"), F.col("b").alias("__b"), "c_below", "c_above", "t_below", "t_above")
        given = dealt.join(ends, (F.col("g") == F.col("__g")) & (F.col("b") == F.col("__b"))).drop("__g", "__b", "o")

        def run(key, pdf):
            rows = []
            for g, cell in pdf.sort_values(["g", "s", "arm"]).groupby("g", sort=False):
                first = cell.iloc[0]
                caliper, *outside = (None if pd_null(first[c]) else float(first[c]) for c in ("cal", "c_below", "c_above", "t_below", "t_above"))
                blocks = [list(x) for x in zip(cell["s"].tolist(), cell["arm"].tolist(), cell["n"].tolist(), strict=True)]
                used = cell["used"].tolist()
                for t, c, n, d in _settle(blocks, caliper, outside):
                    rows.append((g, blocks[t][0], used[t], blocks[c][0], used[c], n, d, int(key[0])))
                    used[t] += n
                    used[c] += n
            return _range_rows(rows)

        got = cut_lineage(given.groupBy("b").applyInPandas(run, RANGES))
        if got.isEmpty():
            if count <= size // 2:
                return found
            size *= 2
            continue
        found.append(got.withColumn("round", F.lit(number)))
        taken = (got.select("g", F.col("ts").alias("s"), F.lit(1).alias("arm"), "n").union(got.select("g", "cs", F.lit(0), "n"))
                 .groupBy(F.col("g").alias("__g"), F.col("s").alias("__s"), F.col("arm").alias("__arm")).agg(F.sum("n").alias("__n")))
        same = (F.col("g") == F.col("__g")) & (F.col("s") == F.col("__s")) & (F.col("arm") == F.col("__arm"))
        gone = F.coalesce("__n", F.lit(0))
        free = (free.join(taken, same, "left").withColumn("n", F.col("n") - gone).withColumn("used", F.col("used") + gone)
                .where("n > 0").drop("__g", "__s", "__arm", "__n"))


def pd_null(x) -> bool:
    return x is None or x != x


def _serve_bucket(key, table):
    """Ranges of pairs of one bucket's treated blocks, with the controls offered to it; a range of no units for a
    cell that is open. Columns stay arrays: a bucket is large."""
    import numpy as np
    import pyarrow as pa
    cells = table["g"].combine_chunks().dictionary_encode()
    names, cell = cells.dictionary.to_pylist(), cells.indices.to_numpy(zero_copy_only=False)
    s, n, used, arm = (table[c].to_numpy() for c in ("s", "n", "used", "arm"))
    order = np.lexsort((s, cell))
    starts = np.searchsorted(cell[order], np.arange(len(names) + 1))
    found: list[list] = [[] for _ in RANGES.split(", ")]

    def add(*row) -> None:
        for to, x in zip(found, row, strict=True):
            to.append(x)

    bucket = key[0].as_py()
    for k, g in enumerate(names):
        own = order[starts[k]:starts[k + 1]]
        t, c = own[arm[own] == 1], own[arm[own] == 0]
        if not len(t):
            continue
        caliper, below, above = (table[x][int(t[0])].as_py() for x in ("cal", "c_below", "c_above"))
        served, offered = (list(zip(s[x].tolist(), (n[x] - used[x]).tolist(), strict=True)) for x in (t, c))
        before, taken = used[c].tolist(), [0] * len(served)
        pairs, more = _serve(served, offered, caliper, below, above)
        for i, j, units, d in pairs:
            for at in range(0, units, RANGE):
                add(g, served[i][0], taken[i] + at, offered[j][0], before[j] + at, min(RANGE, units - at), d, bucket)
            taken[i] += units
            before[j] += units
        if more:
            add(g, served[0][0], 0, 0.0, 0, 0, 0.0, bucket)
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    return pa.table({name: pa.array(x, kinds[kind]) for x, (name, kind) in zip(found, (f.split() for f in RANGES.split(", ")), strict=True)})


def _score_order(blocks: DataFrame, size: int) -> list[DataFrame]:
    """Ranges of pairs with treated units served in order of score.

    Buckets of ``size`` blocks are served at the same time, each as if the buckets before had taken what they took
    in the round before, from the controls of the ``wide`` buckets to either side. When no bucket
    takes otherwise than in the round before, each has met what the ones before it really took, from the
    first on: that is the result of serving all in one row. So it is after as many rounds as buckets in which none was open,
    as each makes one bucket more sure.

    Joins of the rounds are by sorting: a broadcast each would pile up in the driver."""
    dealt = cut_lineage(numbered(_with_partner(blocks), ["g", "s", "arm"], "o").withColumn("b", F.expr(f"o div {size}")))
    treated = dealt.where("arm = 1").select("g", "b", "s", "n", "cal")
    controls = dealt.where("arm = 0").select("g", "b", "s", "n")
    served = treated.select(F.col("g").alias("__g"), F.col("b").alias("__to")).distinct()
    buckets = (dealt.agg(F.max("b")).first()[0] or 0) + 1
    got, wide, number, sure = None, 1, 0, 0  # ``sure``: buckets, from the first on, that have met what the ones before really took
    while True:
        number += 1
        if got is None:
            known = controls.withColumn("last", F.lit(None).cast("long"))  # ``last``: the bucket that takes the control's last unit
        else:
            takes = got.where("n > 0").groupBy("g", "b", "cs").agg(F.sum("n").alias("n"))
            so_far = Window.partitionBy("g", "cs").orderBy("b")
            whole = (takes.withColumn("sum", F.sum("n").over(so_far)).select(F.col("g").alias("__g"), F.col("cs").alias("__s"), "b", "sum")
                     .join(controls.select("g", "s", F.col("n").alias("all")).hint("merge"), (F.col("g") == F.col("__g")) & (F.col("s") == F.col("__s")))
                     .where("sum >= all").groupBy("__g", "__s").agg(F.min("b").alias("last")))
            known = cut_lineage(controls.join(whole.hint("merge"), (F.col("g") == F.col("__g")) & (F.col("s") == F.col("__s")), "left").drop("__g", "__s"))
        seen = known.withColumn("to", F.explode(F.expr(f"sequence(b - {wide}, greatest(b - {wide}, least(b + {wide}, coalesce(last, b + {wide}))))")))
        seen = seen.join(served.hint("merge"), (F.col("g") == F.col("__g")) & (F.col("to") == F.col("__to")), "left_semi")
        if got is not None:
            low = takes.select(F.col("g").alias("__g"), F.col("cs").alias("__s"), F.col("b").alias("__by"), F.col("n").alias("__n"))
            seen = (seen.join(low.hint("merge"), (F.col("g") == F.col("__g")) & (F.col("s") == F.col("__s")) & (F.col("__by") < F.col("to")), "left")
                    .groupBy("g", "to", "s", "n").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("used")))
        else:
            seen = seen.select("g", "to", "s", "n", F.lit(0).cast("long").alias("used"))
        seen = seen.where("n > used")
        ends = known.groupBy("g", "b").agg(F.min("s").alias("lo"), F.max(F.when(F.col("last").isNull(), F.col("s"))).alias("hi"))
        ends = dealt.select("g", "b").distinct().join(ends.select(F.col("g").alias("__g"), F.col("b").alias("__b"), "lo", "hi").hint("merge"),
                                                      (F.col("g") == F.col("__g")) & (F.col("b") == F.col("__b")), "left").drop("__g", "__b")
        ends = _edges(ends, "lo", "hi", "c", wide + 1).select(F.col("g").alias("__g"), F.col("b").alias("__b"), "c_below", "c_above")
        mine = (treated.join(ends.hint("merge"), (F.col("g") == F.col("__g")) & (F.col("b") == F.col("__b")))
                .select("g", "b", F.lit(1).alias("arm"), "s", "n", F.lit(0).cast("long").alias("used"), "cal", "c_below", "c_above"))
        none = F.lit(None).cast("double")
        given = mine.union(seen.select("g", "to", F.lit(0), "s", "n", "used", none, none, none))

        new = cut_lineage(given.groupBy("b").applyInArrow(_serve_bucket, RANGES))
        if not new.where("n = 0").isEmpty():
            wide, sure = wide * 2, 0
        else:
            sure += 1
            if sure >= buckets or (got is not None and _same_rows(new, got)):
                return [new.withColumn("round", F.lit(number))]
        got = new


def _same_rows(a: DataFrame, b: DataFrame) -> bool:
    both = a.select("*", F.lit(1).alias("__in")).union(b.select("*", F.lit(-1))).groupBy(*a.columns).agg(F.sum("__in").alias("__in"))
    return both.where("__in <> 0").isEmpty()


def match_nearest(units: DataFrame, id_col: str, arm: str, score: str,
                  caliper: float | str | None = 0.1, bucket: int | None = None, by: Sequence[str] = (),
                  rule: str = "closest") -> DataFrame:
    """M-2 (``caliper`` set, absolute score units) / M-3 (``caliper=None``): 1:1
    matching without replacement. Ids are of any type that orders.

    ``rule="closest"``: the closest free pair first; at equal distance the lower treated
    score, then the lower control score. ``rule="score_order"``: treated units in ascending order of score, each with
    its nearest free control (at equal distance the one of lower score). Units of equal score go by id.

    ``by``: strata, or the cells of a grid; units match within their cell, and all cells are matched in the
    same passes. ``caliper`` may name a column, constant within a cell.

    Returns ``by``, ``treatment_id``, ``control_id``, ``distance`` and ``round``, the pass that settled the pair."""
    if rule not in ("closest", "score_order"):
        raise ValueError(f"unknown rule {rule!r}")
    s = F.col(score).cast("double") + F.lit(0.0)
    cal = F.col(caliper).cast("double") if isinstance(caliper, str) else F.lit(caliper).cast("double")
    cell = F.to_json(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(by)]), {"ignoreNullFields": "false"}) if by else F.lit("")
    free = units.where(s.isNotNull() & ~F.isnan(s) & F.col(arm).isNotNull() & F.col(id_col).isNotNull()).select(
        cell.alias("g"), s.alias("s"), F.when(F.col(arm) == 1, 1).otherwise(0).alias("arm"), F.col(id_col).alias("id"),
        F.greatest(cal, F.lit(0.0)).alias("cal") if caliper is not None else cal.alias("cal"), *[F.col(c).alias(f"__by_{k}") for k, c in enumerate(by)])
    ranked = cut_lineage(numbered(free, ["g", "s", "arm", "id"], "r", ["g", "s", "arm"]))
    blocks = cut_lineage(ranked.groupBy("g", "s", "arm").agg(F.count(F.lit(1)).alias("n"), F.max("cal").alias("cal")))
    found = _closest_first(blocks, bucket or BUCKET) if rule == "closest" else _score_order(blocks, bucket or ORDER_BUCKET)
    columns = [F.col(f"__by_{k}").alias(c) for k, c in enumerate(by)] + ["treatment_id", "control_id", "distance", "round"]
    if not found:
        none = ranked.where("1 = 0")
        return none.withColumn("treatment_id", F.col("id")).withColumn("control_id", F.col("id")).withColumn("distance", F.lit(0.0)).withColumn(
            "round", F.lit(0)).select(*columns)
    ranges = found[0]
    for f in found[1:]:
        ranges = ranges.unionByName(f)
    pairs = (ranges.withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
             .select("g", "ts", (F.col("tf") + F.col("i")).alias("tr"), "cs", (F.col("cf") + F.col("i")).alias("cr"), "distance", "round"))
    t = ranked.where("arm = 1").select(F.col("g").alias("__tg"), F.col("s").alias("__ts"), F.col("r").alias("__tr"), F.col("id").alias("treatment_id"),
                                       *[f"__by_{k}" for k in range(len(by))])
    c = ranked.where("arm = 0").select(F.col("g").alias("__cg"), F.col("s").alias("__cs"), F.col("r").alias("__cr"), F.col("id").alias("control_id"))
    return (pairs.join(t.hint("merge"), (F.col("g") == F.col("__tg")) & (F.col("ts") == F.col("__ts")) & (F.col("tr") == F.col("__tr")))
            .join(c.hint("merge"), (F.col("g") == F.col("__cg")) & (F.col("cs") == F.col("__cs")) & (F.col("cr") == F.col("__cr"))).select(*columns))


def match_report(pairs: DataFrame, units: DataFrame, arm: str) -> DataFrame:
    """M-4: matched pairs, treated units, match rate, mean / max distance."""
    n_t = units.where(F.col(arm) == 1).count()
    return pairs.agg(F.count(F.lit(1)).alias("matched"),
                     F.avg("distance").alias("mean_distance"),
                     F.max("distance").alias("max_distance"),
                     F.max("round").alias("rounds")) \
        .withColumn("treated_units", F.lit(n_t).cast("long")) \
        .withColumn("match_rate", F.try_divide(F.col("matched").cast("double"), F.lit(float(n_t))))


def matched_units(pairs: DataFrame, units: DataFrame, id_col: str) -> DataFrame:
    """D-9 / M-8 input: the matched units of both arms (ids from the pairs)."""
    ids = (pairs.select(F.col("treatment_id").alias(id_col))
           .unionByName(pairs.select(F.col("control_id").alias(id_col))))
    return units.join(ids, id_col, "left_semi")


def matched_rows(df: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """M-8: keep panel rows whose unit is in a matched pair (semi join)."""
    return matched_units(pairs, df, id_col)


def cross_fitted_scores(df: DataFrame, key: str, label: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                        trees: int = 100, depth: int = 3, step: float = 0.1, folds: int = 5, seed: int = 42, out: str = "gbt_score") -> DataFrame:
    """M-7: boosted-tree propensity out of fold: columns ``key``, ``label``, ``fold`` and ``out``, the score of a model that has not
    seen the row's fold. One table of features with a fold number (md5 of the key) is written; the folds' models
    are fitted from it at the same time. :func:`auc_by_group` gives the folds' AUC."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.classification import GBTClassifier
    x = df.withColumns({f"__n_{c}": to_number(c) for c in numeric} | {f"__c_{c}": clean_category(c) for c in categorical})
    fold = F.floor(uniform(seed, key) * folds).cast("int")
    x = x.where(F.col(label).isNotNull()).select(F.col(key), F.col(label).cast("int").alias("__y"), fold.alias("__fold"),
                                                 *[f"__n_{c}" for c in numeric], *[f"__c_{c}" for c in categorical])
    stages = [StringIndexer(inputCol=f"__c_{c}", outputCol=f"__i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categorical]
    stages.append(VectorAssembler(inputCols=[f"__n_{c}" for c in numeric] + [f"__i_{c}" for c in categorical], outputCol="__features"))
    x = cut_lineage(x)
    levels = [r for r in x.agg(*[F.countDistinct(f"__c_{c}") for c in categorical]).first()] if categorical else []
    z = Pipeline(stages=stages).fit(x).transform(x).select(F.col(key), F.col("__y").cast("double").alias("__label"), "__fold", "__features")
    z = cut_lineage(z.repartition(max(1, -(-z.count() // FIT_ROWS))))

    def fit(k: int) -> DataFrame:
        seen, rest = z.where(F.col("__fold") != k), z.where(F.col("__fold") == k)
        arms = {r["__label"] for r in seen.select("__label").distinct().collect()}
        if len(arms) < 2:  # nothing to learn
            return rest.withColumn(out, F.lit(float(max(arms, default=0.0))))
        gbt = GBTClassifier(featuresCol="__features", labelCol="__label", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed,
                            maxBins=max([32, *(n + 1 for n in levels)]))
        return gbt.fit(seen).transform(rest).withColumn(out, vector_to_array("probability")[1])

    with ThreadPoolExecutor(max_workers=folds) as ex:
        parts = list(ex.map(fit, range(folds)))
    scored = [p.select(F.col(key), F.col("__label").cast("int").alias(label), F.col("__fold").alias("fold"), out) for p in parts]
    whole = scored[0]
    for p in scored[1:]:
        whole = whole.unionByName(p)
    return whole


FIT_ROWS = 100_000  # of a partition: a fit makes some thousand short passes, and a task of few rows is mostly its start


def auc_by_group(scores: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve of a score per group, from average ranks (W-4): U of the positives over all pairs;
    null where an arm is missing."""
    r = mann_whitney(scores, label, score, by, with_p=False)
    pairs = F.col("n_t").cast("double") * F.col("n_c")
    return r.select(*by, "n_t", "n_c", F.try_divide(F.col("u_stat"), F.nullif(pairs, F.lit(0.0))).alias("auc"))


def gbt_propensity(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                   trees: int = 100, depth: int = 3, step: float = 0.1, folds: int = 5, seed: int = 42):
    """M-7: boosted-tree propensity with k-fold cross-validated AUC.
    Returns (scored DataFrame with ``gbt_score``, mean CV AUC)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    x = df
    for col in numeric:
        x = x.withColumn(f"__n_{col}", to_number(col))
    stages, feats = [], [f"__n_{c_}" for c_ in numeric]
    for col in categorical:
        x = x.withColumn(f"__c_{col}", clean_category(col))
        stages.append(StringIndexer(inputCol=f"__c_{col}", outputCol=f"__i_{col}", handleInvalid="keep"))
        feats.append(f"__i_{col}")
    stages.append(VectorAssembler(inputCols=feats, outputCol="__features"))
    x = x.withColumn("__label", F.col(label).cast("double"))
    levels = x.agg(*[F.countDistinct(f"__c_{col}").alias(col) for col in categorical]).first() if categorical else ()
    gbt = GBTClassifier(featuresCol="__features", labelCol="__label", maxIter=trees, maxDepth=depth,
                        stepSize=step, seed=seed, maxBins=max(32, *(n + 1 for n in levels)) if levels else 32)
    pipe = Pipeline(stages=stages + [gbt])
    ev = BinaryClassificationEvaluator(labelCol="__label", metricName="areaUnderROC")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev,
                        numFolds=folds, seed=seed)
    model = cv.fit(x)
    scored = model.bestModel.transform(x).withColumn("gbt_score", vector_to_array("probability")[1])
    return scored.select(*df.columns, "gbt_score"), float(model.avgMetrics[0])
