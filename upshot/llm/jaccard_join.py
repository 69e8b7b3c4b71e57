"""Near-duplicate documents by a chosen-path join on word shingles.

The set of a document are the hashes of its shingles of ``SHINGLE`` words (a
shorter text with words is one shingle). Two sets are linked if their Jaccard
similarity is at least ``4/5``.

Method. A node of a run's recursion is a path of tokens. At each node a set of
size n goes on with every token whose hash, seeded by the path, is below
``1/(0.8 n)``: about 1.25 of them, and the same ones in similar sets, for the
larger one's choice is among the smaller one's. Sets that share a path make up a
bucket, from the second level on, so that a passage in common rarely makes one.
Buckets of at most ``LIMIT`` sets are compared by brute force with exact
intersections; larger ones recurse. A pair at the threshold shares a path of two
tokens with probability 0.47 at least, so ``RUNS`` runs leave one in 300,000 such
pairs apart, and fewer at higher similarities. Deeper paths are shared less often.
So members of large buckets get ``MORE_RUNS`` further runs, once the similar cores and the texts that only
share a passage (both below) are taken off, and
below the second level a node chooses the tokens below ``1/(0.64 n)``. Of pairs at
the threshold with sizes 4:5, the worst case, a run then shares a path of 3, 4, 5,
6 and 7 tokens with probability 0.40, 0.36, 0.33, 0.32 and 0.30; all runs miss one
with probability 1e-9, 2e-8, 9e-8, 2e-7 and 5e-7, which comes on top of the 3e-6
of pairs that share no path of two tokens in the first ``RUNS``.

Before a large bucket is split, its similar core is taken off: distances (one
minus similarity) to the bucket's smallest member obey the triangle inequality,
so a set nearer than 0.5 has all its links within distance 0.7. The sets within
0.7 are compared completely, once, in tiles (an exact way, whatever their
number), and the near ones leave the recursion. They are sent as what they lack and have
beside the smallest member, which is little in a core. Of what is left, the tokens of a smallest member that
more than ``LIMIT`` members hold are common, a passage in most cases. A set whose links need m tokens besides its common ones
goes on with single rare ones, chosen below 1/m in ``RUNS`` runs, which leaves one link in 4e8 apart, and leaves the
recursion; a set whose links may do without goes on with all its rare tokens, and stays in it. What is still large after
``LEVELS`` levels is compared in tiles too, so nothing is capped.

Equal sets are one representative with the number of its different texts. A pair
counts where it first meets (its smallest common bucket), so links are counted
without being written as pairs; buckets pass on one link per member to its
smallest relative, from which classes are joined.

Defined cases: a null text is an empty text; texts without words form one class
and have no links; rows that repeat an id and text are copies; rows with a null
id are classed by their text like others, and the class id is null if all members
lack one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import BINARY, BOOL, INT, LONG, documents, drop_scratch, lean, materialise, schema
from .components import components

SHINGLE = 5
RUNS = 20
MORE_RUNS = 20  # for members of large buckets
LIMIT = 128
LEVELS = 5
TILE = 256
SALT = 32  # parts into which the members of a large bucket are dealt to meet its smallest one
LOW = 0.8  # least overlap relative to the larger set at similarity 0.8
DEEP = 0.64  # in place of LOW below the second level
NEAR, FAR = 0.5, 0.7  # FAR - NEAR is the distance 0.2 of the threshold

_SEEDS = W.mix64(np.arange(1, RUNS + MORE_RUNS + 1).astype(W.U) * W.U(0x9E3779B97F4A7C15))


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each text end to end, and where each text begins."""
    w = W.split(texts)
    h = w.hashes()
    x, whole = w.windows(h, SHINGLE)
    own = w.owner()
    tokens, of = [x[whole]], [own[whole]]
    for n in range(1, SHINGLE):  # texts of fewer words
        short = np.flatnonzero(w.counts == n)
        if len(short):
            y, _ = w.windows(h, n)
            tokens.append(y[w.first[short]])
            of.append(short)
    x, own = np.concatenate(tokens), np.concatenate(of)
    order = np.argsort(x)
    order = order[np.argsort(own[order], kind="stable")]
    x, own = x[order], own[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (own[1:] != own[:-1])
    x, own = x[new], own[new]
    return x, np.searchsorted(own, np.arange(len(w.counts) + 1))


def _sum(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, dtype=W.U)
    np.cumsum(x, dtype=W.U, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _marks(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart."""
    return _sum(W.mix64(x), at), _sum(W.mix64(x ^ W.U(0x5851F42D4C957F2D)), at)


def _bound(n: np.ndarray, low: float = LOW) -> np.ndarray:
    """Below this hash a token of a set of size n is chosen."""
    share = 2.0**64 / (low * np.maximum(n, 1))
    return np.where(share >= 2.0**64, 2.0**64 - 2048, share).astype(W.U)


def _draw(x: np.ndarray, seed: np.ndarray | W.U) -> np.ndarray:
    """Hash of each token at a node."""
    v = (x ^ seed) * W.U(0xA24BAED4963EE407)
    v ^= v >> W.U(29)
    return v * W.U(0x9FB21C651E98DF25)


def _paths(x: np.ndarray, at: np.ndarray, seeds: np.ndarray = _SEEDS[:RUNS]) -> tuple[np.ndarray, np.ndarray]:
    """The runs' paths of two tokens, and the text of each."""
    size = np.diff(at)
    own = np.repeat(np.arange(len(size)), size)
    each = _bound(size)
    bound = each[own]
    paths, of = [], []
    for seed in seeds:
        u = _draw(x, seed)
        hit = np.flatnonzero(u < bound)
        node, text = W.mix64(u[hit] + seed), own[hit]
        n = size[text]
        token = np.repeat(at[text] - np.cumsum(n) + n, n) + np.arange(n.sum())
        u = _draw(x[token], np.repeat(node, n))
        hit = np.flatnonzero(u < np.repeat(each[text], n))
        parent = np.repeat(np.arange(len(text)), n)[hit]
        paths.append(W.mix64(u[hit] + node[parent]))
        of.append(text[parent])
    paths, of = np.concatenate(paths), np.concatenate(of)
    order = np.lexsort((paths, of))
    paths, of = paths[order], of[order]
    new = np.ones(len(paths), dtype=bool)
    new[1:] = (paths[1:] != paths[:-1]) | (of[1:] != of[:-1])
    return paths[new], of[new]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: set size and marks, text hash, paths."""
    for batch in batches:
        for c in W.chunks(batch, "text"):
            x, at = _sets(c.column("text"))
            size = np.diff(at)
            paths, of = _paths(x, at)
            cut = np.searchsorted(of, np.arange(len(size) + 1)).astype(np.int32)
            m1, m2 = _marks(x, at)
            yield pa.RecordBatch.from_pydict({
                "id": c.column("id"), "m1": pa.array(W.int64(m1)), "m2": pa.array(W.int64(m2)),
                "n": pa.array(size.astype(np.int64)), "th": c.column("th"),
                "paths": pa.ListArray.from_arrays(pa.array(cut), pa.array(W.int64(paths)))})


def _collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in W.chunks(batch, "text"):
            x, at = _sets(c.column("text"))
            m1, m2 = _marks(x, at)
            same = ((W.int64(m1) == c.column("m1").to_numpy()) & (W.int64(m2) == c.column("m2").to_numpy()))
            rows = np.flatnonzero(same)
            yield pa.RecordBatch.from_pydict({
                "rep": c.column("rep").take(pa.array(rows)), "large": c.column("large").take(pa.array(rows)),
                "set": pa.array([x[at[i]:at[i + 1]].tobytes() for i in rows], pa.binary())})


def _tokens(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, dtype=W.U)


def _more_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of two tokens of the further runs."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            lists = [_tokens(cell) for cell in part.column("set").to_pylist()]
            at = np.cumsum([0, *map(len, lists)])
            paths, of = _paths(np.concatenate(lists), at, _SEEDS[RUNS:])
            yield pa.RecordBatch.from_pydict({"rep": part.column("rep").take(pa.array(of)), "path": pa.array(W.int64(paths))})


def _children(x: np.ndarray, path: W.U) -> np.ndarray:
    """Paths of one token more."""
    u = _draw(x, W.mix64(path + W.U(1)))
    return W.mix64(u[u < _bound(np.array([len(x)]), DEEP)] + path)


def _recurse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a member of large buckets with the same smallest member: whether it is near that one;
    if it lies around it, its size and what it lacks and has beside it; if it isn't near it, the paths of the next level.
    Then, for each smallest member, how many of the task's members that aren't near hold each of its tokens."""
    names = ["rep", "pivot", "near", "size", "gone", "fresh", "children", "counts"]
    held: dict[int, np.ndarray] = {}

    def counted() -> pa.RecordBatch:
        n = len(held)
        out = [pa.nulls(n, pa.int64()), pa.array(list(held), pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
               pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.array([x.astype("<i4").tobytes() for x in held.values()], pa.binary())]
        held.clear()
        return pa.RecordBatch.from_arrays(out, names)

    for batch in batches:
        near, size, gone, fresh, children = [], [], [], [], []
        for pivot, paths, x, p in zip(*(batch.column(k).to_pylist() for k in ("pivot", "paths", "set", "pivot_set")), strict=True):
            x, p = _tokens(x), _tokens(p)
            has = np.isin(p, x, assume_unique=True)
            out, new = p[~has], np.setdiff1d(x, p, assume_unique=True)
            far = 1 - (len(p) - len(out)) / (len(p) + len(new))
            near.append(far < NEAR)
            size.append(len(p) if far <= FAR else None)
            gone.append(out.tobytes() if far <= FAR else None)
            fresh.append(new.tobytes() if far <= FAR else None)
            nxt = []
            if far >= NEAR:
                held[pivot] = held[pivot] + has if pivot in held else has.astype(np.int64)
                for seed in np.array(paths, dtype=np.int64).view(W.U):
                    nxt += W.int64(_children(x, seed)).tolist()
            children.append(nxt)
        yield pa.RecordBatch.from_arrays([
            batch.column("rep"), batch.column("pivot"), pa.array(near, pa.bool_()), pa.array(size, pa.int64()), pa.array(gone, pa.binary()),
            pa.array(fresh, pa.binary()), pa.array(children, pa.list_(pa.int64())), pa.nulls(len(near), pa.binary())], names)
        if len(held) > 1000:
            yield counted()
    if held:
        yield counted()


def _common_tokens(table: pa.Table) -> pa.Table:
    """The tokens of a bucket's smallest member that more than ``LIMIT`` of the members hold."""
    total = sum(np.frombuffer(c, dtype="<i4").astype(np.int64) for c in table.column("counts").to_pylist())
    tokens = _tokens(table.column("pivot_set")[0].as_py())
    return pa.table({"pivot": table.column("pivot")[:1], "common": pa.array([tokens[total > LIMIT].tobytes()], pa.binary())})


def _rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of one token among a member's rare ones under any of its smallest members, and whether a link may do without them.

    A linked set holds at least 0.8 n of a set's n tokens; c of these being common, m = 0.8 n - c of the rare ones. A run would
    choose the rare tokens whose hash is below 1/m; ``RUNS`` runs at once choose those below 1 - (1 - 1/m)^RUNS. Sets that meet
    in a bucket have its smallest member, so the same common tokens, and choose alike. The hash is the same under every smallest
    member, so a token makes one path, whatever the number of large buckets that its set is in."""
    seed = W.mix64(np.array([1], dtype=W.U))
    for batch in batches:
        paths, stays = [], []
        for x, commons in zip(*(batch.column(k).to_pylist() for k in ("set", "commons")), strict=True):
            x = _tokens(x)
            u, chosen, free = _draw(x, seed), np.zeros(len(x), dtype=bool), False
            for common in set(commons):
                rare = np.isin(x, _tokens(common), assume_unique=True, invert=True)
                least = -(-4 * len(x) // 5) - (len(x) - int(rare.sum()))
                if least > 1:
                    rare &= u < W.U(int((1 - (1 - 1 / least)**RUNS) * (1 - 1e-12) * 2.0**64))
                chosen |= rare
                free |= least <= 0
            paths.append(W.int64(W.mix64(u[chosen] ^ seed)).tolist())
            stays.append(free)
        yield pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "children": pa.array(paths, pa.list_(pa.int64())), "stays": pa.array(stays, pa.bool_())})


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, in batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:], strict=False):
            now = tuple(k[:, a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _common(lists: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted lists without repeats."""
    own = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values = np.concatenate(lists)
    if not len(values):
        return np.zeros((len(lists), len(lists)), dtype=np.int64)
    order = np.argsort(values, kind="stable")
    values, own = values[order], own[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(values)))
    column = np.cumsum(new) - 1
    keep = np.repeat(count > 1, count)  # a value of one list is in no intersection
    own, column = own[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(lists), len(lists)), dtype=np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, columns):
        part = slice(*np.searchsorted(column, [at, at + columns]))
        m = np.zeros((len(lists), min(columns, width - at)), dtype=np.float32)
        m[own[part], column[part] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each member of a bucket or pair of tiles, and its smallest relative there."""
    reps, links, labels = [], [], []

    def flush():
        out = pa.RecordBatch.from_pydict({"rep": pa.array(reps, pa.int64()), "links": pa.array(links, pa.int64()),
                                          "label": pa.array(labels, pa.int64())})
        reps.clear()
        links.clear()
        labels.clear()
        return out

    for g in _groups(batches, ["home", "a", "b"]):
        rep, order = np.unique(g.column("rep").to_numpy(), return_index=True)
        side = g.column("side").to_numpy()[order]
        weight = g.column("weight").to_numpy()[order]
        homes = g.column("homes").to_pylist()
        if g.column("pivot_size")[0].as_py() is None:
            cells = g.column("set").to_pylist()
            both = _common([_tokens(cells[i]) for i in order])
            size = np.array([len(cells[i]) // 8 for i in order], dtype=np.int64)
        else:  # sets by what they lack and have beside the same one
            whole = g.column("pivot_size")[0].as_py()
            gone, fresh = ([_tokens(cells[i]) for i in order] for cells in (g.column("gone").to_pylist(), g.column("fresh").to_pylist()))
            less, more = (np.array([len(x) for x in side_], dtype=np.int64) for side_ in (gone, fresh))
            size = whole - less + more
            both = whole - less[:, None] - less[None, :] + _common(gone) + _common(fresh)
        linked = 5 * both >= 4 * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(linked, False)
        if g.column("a")[0] != g.column("b")[0]:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            continue
        home = g.column("home")[0].as_py()
        before = [np.array([h for h in homes[i] if h < home], dtype=np.int64) for i in order]
        counted = linked & (_common(before) == 0) if any(map(len, before)) else linked
        label = np.arange(len(rep))
        while True:
            new = np.minimum(label, np.where(linked, label[None, :], len(rep)).min(axis=1))
            if (new == label).all():
                break
            label = new
        touched = linked.any(axis=1)
        reps += rep[touched].tolist()
        links += (counted @ weight)[touched].tolist()
        labels += rep[label][touched].tolist()
        if len(reps) > 10_000:
            yield flush()
    if reps:
        yield flush()


def _members(paths: DataFrame) -> DataFrame:
    """Rows (path, rep) of buckets of two at least, with the bucket's size and smallest member."""
    sized = (paths.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).where("size > 1")
             .withColumnRenamed("path", "_path"))
    return paths.join(sized, F.col("path") == F.col("_path")).drop("_path")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: the one whose id is the class id."""
    taken = set(docs.columns)
    at, hashed = (next(f"{name}{n}" for n in range(len(taken) + 1) if f"{name}{n}" not in taken) for name in ("class_", "hash_"))
    first = (near_duplicates(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("class_id")))
             .select(F.col(id_col).alias(at), F.col("text_hash").alias(hashed)).distinct())
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    return (docs.join(first, own.eqNullSafe(F.col(at)) & (text_hash(text) == F.col(hashed)), "left_semi")
            .dropDuplicates([id_col, text_col]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``class_id`` (smallest id of the texts
    linked with it, directly or through others), ``n_links`` (different texts
    with similarity 0.8 or more), ``n_copies`` (documents with an equal set, itself
    included) and ``text_hash`` (:func:`text_hash`)."""
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    hashed = given.withColumn("th", text_hash(F.col("text")))
    described = schema(id=LONG, m1=LONG, m2=LONG, n=LONG, th=LONG).add("paths", T.ArrayType(LONG))
    rows, _ = materialise(hashed.mapInArrow(lean(_describe), described), "sets")

    texts = rows.groupBy("m1", "m2", "n", "th").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "th", "paths")).alias("first"), F.count(F.lit(1)).alias("copies"))
    reps, _ = materialise(
        texts.groupBy("m1", "m2", "n").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("weight"),
                                           F.sum("copies").alias("copies")).orderBy("first.id")
        .select(F.monotonically_increasing_id().alias("rep"), "m1", "m2", "n", "weight", "copies", "first.id", "first.th", "first.paths"),
        "reps")  # ids may repeat with other texts, so sets are numbered, in the order of their ids; the written table fixes the numbers
    usable = reps.where("n > 0")
    members, members_path = materialise(_members(usable.select(F.explode("paths").alias("path"), "rep")), "members")

    wanted = (members.groupBy("rep").agg(F.max(F.when(F.col("size") > LIMIT, 1).otherwise(0)).alias("large"))
              .join(usable.select("rep", "m1", "m2", F.col("id").alias("_id"), F.col("th").alias("_th")), "rep"))
    sets, sets_path = materialise(
        hashed.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("rep", "m1", "m2", "large", "text")
        .mapInArrow(lean(_collect_sets), schema(rep=LONG, large=INT, set=BINARY)), "tokens", "large")
    in_large, sets = sets.where("large = 1").select("rep", "set"), sets.select("rep", "set")

    small = members.where(F.col("size") <= LIMIT).select("path", "rep")
    large = members.where(F.col("size") > LIMIT).select("path", "rep", "pivot")
    shape = schema(rep=LONG, pivot=LONG, near=BOOL, size=LONG, gone=BINARY, fresh=BINARY).add("children", T.ArrayType(LONG)).add("counts", BINARY)
    around: list[DataFrame] = []
    for level in range(LEVELS):
        if large.isEmpty():
            break
        pivots = (in_large.join(large.select("pivot").distinct(), F.col("rep") == F.col("pivot"))
                  .select(F.col("rep").alias("_pivot"), F.col("set").alias("pivot_set"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_part")))
        met = large.repartition("rep").groupBy("rep", "pivot").agg(F.collect_list("path").alias("paths"))
        step, _ = materialise(
            met.join(in_large, "rep").withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(SALT)).cast("int"))
            .join(pivots, (F.col("pivot") == F.col("_pivot")) & (F.col("part") == F.col("_part")))
            .select("rep", "pivot", "paths", "set", "pivot_set").mapInArrow(lean(_recurse), shape), "level")
        around.append(step.where("size is not null").select(F.xxhash64(F.lit("around"), F.lit(level), "pivot").alias("home"), "rep",
                                                            F.col("size").alias("pivot_size"), "gone", "fresh"))
        # a member near any smallest one meets all its links around it
        apart = (step.where("rep is not null").groupBy("rep").agg(F.max("near").alias("complete"), F.flatten(F.collect_list("children")).alias("children"))
                 .where("not complete").select("rep", "children"))
        apart, _ = materialise(apart, "apart")
        paths = apart.select(F.explode("children").alias("path"), "rep")
        if not level:
            common = (step.where("rep is null").select("pivot", "counts")
                      .join(in_large.select(F.col("rep").alias("_pivot"), F.col("set").alias("pivot_set")), F.col("pivot") == F.col("_pivot"))
                      .select("pivot", "counts", "pivot_set").groupBy("pivot").applyInArrow(_common_tokens, schema(pivot=LONG, common=BINARY)))
            common = common.select(F.col("pivot").alias("_pivot"), "common", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_part"))
            met = (step.where("rep is not null").select("rep", "pivot", F.pmod(F.xxhash64("rep"), F.lit(SALT)).cast("int").alias("part"))
                   .join(common, (F.col("pivot") == F.col("_pivot")) & (F.col("part") == F.col("_part"))).select("rep", "common"))
            met = apart.select("rep").join(met, "rep").groupBy("rep").agg(F.collect_set("common").alias("commons"))
            own = met.join(in_large, "rep").select("rep", "set", "commons")
            rare, _ = materialise(own.mapInArrow(lean(_rare), schema(rep=LONG).add("children", T.ArrayType(LONG)).add("stays", BOOL)), "rare")
            stays = rare.where("stays").select(F.col("rep").alias("_rep"))
            again = in_large.join(stays, F.col("rep") == F.col("_rep"), "left_semi")
            stay_on = apart.join(stays, F.col("rep") == F.col("_rep"), "left_semi").select("rep", "children")
            paths, _ = materialise(
                stay_on.union(rare.select("rep", "children")).select(F.explode("children").alias("path"), "rep")
                .union(again.mapInArrow(lean(_more_paths), schema(rep=LONG, path=LONG)).select("path", "rep")), "paths")  # read twice
        deeper, _ = materialise(_members(paths), "members")
        small = small.union(deeper.where(F.col("size") <= LIMIT).select("path", "rep"))
        large = deeper.where(F.col("size") > LIMIT).select("path", "rep", "pivot")
    rest = large.select(F.col("path").alias("home"), "rep").distinct()  # still large: compared in tiles

    # buckets of the same members are compared once
    listed = small.groupBy("path").agg(F.sort_array(F.collect_list("rep")).alias("reps"))
    once = (listed.groupBy("reps").agg(F.min("path").alias("home"))
            .select("home", F.explode("reps").alias("rep"), F.lit(0).alias("tiles")))
    whole = [F.lit(None).cast("long").alias("pivot_size"), F.lit(None).cast("binary").alias("gone"), F.lit(None).cast("binary").alias("fresh")]
    tiled = rest.select("home", "rep", *whole)
    for part in around:
        tiled = tiled.union(part)
    tiles = tiled.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).withColumnRenamed("home", "_home")
    homes, homes_path = materialise(once.select("home", "rep", "tiles", *whole).union(
        tiled.join(tiles, F.col("home") == F.col("_home")).select("home", "rep", "tiles", "pivot_size", "gone", "fresh")), "homes")

    per_rep = (homes.groupBy("rep").agg(F.collect_list("home").alias("homes")).join(usable.select(F.col("rep").alias("_w"), "weight"), F.col("rep") == F.col("_w"))
               .select(F.col("rep").alias("_rep"), "homes", "weight"))
    # the members of a core by their differences, all others by their sets
    at, listed_at = ["home", "rep", "tiles", "pivot_size", "gone", "fresh"], F.col("rep") == F.col("_rep")
    whole_sets = homes.where("pivot_size is null").select(*at).join(sets, "rep").join(per_rep, listed_at).select(*at, "set", "homes", "weight")
    cores = homes.where("pivot_size is not null").join(per_rep, listed_at).select(*at, F.lit(None).cast("binary").alias("set"), "homes", "weight")
    placed = (whole_sets.union(cores)
              .withColumn("own", F.pmod(F.xxhash64("rep"), F.greatest("tiles", F.lit(1))).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("tiles", F.lit(1)) - 1)))
              .select("home", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.col("own").alias("side"),
                      "rep", "weight", "set", "homes", "pivot_size", "gone", "fresh"))
    found, found_path = materialise(
        placed.repartition("home", "a", "b").sortWithinPartitions("home", "a", "b")
        .mapInArrow(lean(_compare), schema(rep=LONG, links=LONG, label=LONG)), "links")
    drop_scratch(spark, sets_path, members_path, homes_path)

    counts = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "_rep")
    classes = components(found, "rep", "label")
    named = classes.join(reps.select("rep", "id"), F.col("node") == F.col("rep"))
    least = named.groupBy("label").agg(F.min("id").alias("least")).withColumnRenamed("label", "_label")
    named = named.join(least, F.col("label") == F.col("_label")).select("node", "least")
    by_rep = (reps.select("m1", "m2", "n", "weight", "copies", "rep", "id")
              .join(counts, F.col("rep") == F.col("_rep"), "left")
              .join(named, F.col("rep") == F.col("node"), "left")
              .select(F.col("m1").alias("_m1"), F.col("m2").alias("_m2"), F.col("n").alias("_n"),
                      F.coalesce("least", "id").alias("class_id"), "copies",
                      (F.coalesce("links", F.lit(0)) + F.when(F.col("n") > 0, F.col("weight") - 1).otherwise(0)).alias("n_links")))
    return (rows.select("id", "m1", "m2", "n", "th")
            .join(by_rep, (F.col("m1") == F.col("_m1")) & (F.col("m2") == F.col("_m2")) & (F.col("n") == F.col("_n")))
            .select(F.col("id").alias(id_col), "class_id", F.col("n_links").cast("long").alias("n_links"),
                    F.col("copies").cast("long").alias("n_copies"), F.col("th").alias("text_hash")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents and the number of links of each."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
texts AS (SELECT text, min(doc_id) AS rep, count(*) AS copies, any_value(words) AS words FROM w GROUP BY text),
shingles AS (
  SELECT rep, unnest(list_distinct(CASE WHEN len(words) >= 5
    THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS s FROM texts),
sizes AS (SELECT rep, count(*) AS n FROM shingles GROUP BY rep),
common AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.rep <> b.rep GROUP BY a.rep, b.rep),
links AS (
  SELECT a, b, c, x.n AS na, y.n AS nb FROM common JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b
  WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(a, b) AS (
  SELECT rep, rep FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
blank AS (SELECT min(rep) AS first, sum(copies) AS copies FROM texts WHERE len(words) = 0),
n_links AS (SELECT a AS rep, count(*) AS n_links FROM links GROUP BY a),
equal_sets AS (SELECT a AS rep, sum(t.copies) AS copies FROM links JOIN texts t ON t.rep = b WHERE c = na AND c = nb GROUP BY a)
SELECT w.doc_id, CASE WHEN len(t.words) = 0 THEN blank.first ELSE k.class_id END AS class_id,
       CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links,
       CAST(CASE WHEN len(t.words) = 0 THEN blank.copies ELSE t.copies + coalesce(e.copies, 0) END AS BIGINT) AS n_copies
FROM w JOIN texts t ON t.text = w.text JOIN classes k ON k.rep = t.rep CROSS JOIN blank
LEFT JOIN n_links n ON n.rep = t.rep LEFT JOIN equal_sets e ON e.rep = t.rep
"""
