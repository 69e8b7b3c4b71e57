"""Conversation prefix trie by z-fast tries.

A conversation is a string of turns, and the trie has a node for each distinct
sequence of first turns. It is kept compacted: a node of the compacted trie stands
where conversations end or part, and its edge holds the turns from its parent down to its
extent. Prefixes are named by 128 bits of hash, sums over the turns of the hash
of a turn and its place, so the names of all prefixes of a string are running sums.

In the z-fast trie each compacted node is hashed under its handle, the prefix whose
length is the two-fattest number (divisible by the largest power of two) between its
parent's extent and its own. The last node on a conversation's way is found by fat
binary search: probe the prefix of two-fattest length between the depths known to be
on the way and to be off it; a hit moves the lower bound to the node's extent, a miss
the upper one. That takes a logarithm of the conversation's turns in probes. Each
batch of conversations is located in the trie as it stands before, then inserted from
the places found: an edge left in its middle is split there, the rest becomes a leaf.

Distribution: conversations that are rebuilt from one base lie in the same partition, and
each task builds the trie of its own and expands its edges to nodes with
their members counted; so a prefix that many conversations share leaves a task once, and tries
merge by the prefixes' names. A trie of more than ``TRIE_TURNS`` turns is given out
and begun anew. Each expanded node carries the names of its ancestors at distances
1, 2, 4 ...: sums over subtrees then take one aggregation for each power of two, as
the sum over descendants nearer than 2d is the node's own sum over those nearer than d, and those of its
descendants at distance d. The ids that end at a node are hashed as a stream in sorted order.
Texts are read once and shuffled as digests; a conversation is a row of about 80 bytes a turn.

Defined cases: turns without ``conv_id`` belong to no conversation and make no node; a null role or
text is empty; turns of equal number go by role, then by the MD5 of their text; a
conversation without turns ends at the root; equal conversations end at the same
node; an empty table has no member and no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG, STRING, drop_scratch, materialise, schema, ship_package
from .words import U, int64, mix64

BASE, HEAD = 5, 9  # conversations of a base, and one more than the turns taken from it
TRIE_TURNS = 2_000_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
TURN = "array<struct<t1 bigint, t2 bigint, size bigint>>"


def two_fattest(low: int, high: int) -> int:
    """The number in ``low + 1 .. high`` that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted trie over strings given by the names of their prefixes: arrays
    ``k1`` and ``k2`` with the empty prefix first, ``size`` of each place."""

    def __init__(self):
        self.handle: dict[tuple[int, int], int] = {}  # name of the handle -> node
        self.child: dict[tuple[int, int], int] = {}  # name of the edge's first turn -> node
        self.top, self.extent, self.text = [0], [0], [None]  # parent's extent, own extent, a string below
        self.count, self.least = [0], [None]  # strings that end at the node, the smallest id
        self.turns = 0

    def _name(self, node: int, depth: int) -> tuple[int, int]:
        k1, k2, _ = self.text[node]
        return int(k1[depth]), int(k2[depth])

    def locate(self, k1: list, k2: list, low: int = 0, node: int = 0) -> tuple[int, int, int | None]:
        """(node, its extent, exit node) of a string: the last node wholly on its way,
        and the one it leaves on the edge of, if any. ``node`` with extent ``low`` is
        known to be on the way."""
        high = len(k1) - 1
        last = high
        while low < high:
            f = two_fattest(low, high)
            found = self.handle.get((k1[f], k2[f]))
            if found is None:
                high = f - 1
                continue
            end = self.extent[found]
            if end > last or self._name(found, end) != (k1[end], k2[end]):
                if self.top[found] > low:  # its parent is on the way too: go on below the handle
                    high = self.top[found]
                    continue
                return node, low, found
            node, low = found, end
        return node, low, self.child.get((k1[low + 1], k2[low + 1])) if low < last else None

    def _place(self, node: int) -> None:
        f = two_fattest(self.top[node], self.extent[node])
        self.handle[self._name(node, f)] = node

    def _add(self, top: int, extent: int, text: tuple) -> int:
        node = len(self.top)
        for held, value in ((self.top, top), (self.extent, extent), (self.text, text), (self.count, 0), (self.least, None)):
            held.append(value)
        return node

    def _split(self, node: int, depth: int) -> int:
        """A new node at ``depth`` of the edge of ``node``."""
        top = self.top[node]
        del self.handle[self._name(node, two_fattest(top, self.extent[node]))]
        upper = self._add(top, depth, self.text[node])
        self.top[node] = depth
        self.child[self._name(upper, top + 1)] = upper
        self.child[self._name(node, depth + 1)] = node
        self._place(upper)
        self._place(node)
        return upper

    def insert(self, doc_id: int, text: tuple, k1: list, k2: list, node: int = 0) -> None:
        node, low, exit_node = self.locate(k1, k2, self.extent[node], node)
        last = len(k1) - 1
        if exit_node is not None:
            same, off = low + 1, min(last, self.extent[exit_node] - 1) + 1  # equal up to ``same``, not from ``off`` on
            o1, o2, _ = self.text[exit_node]
            while off - same > 1:
                middle = (same + off) // 2
                if k1[middle] == o1[middle] and k2[middle] == o2[middle]:
                    same = middle
                else:
                    off = middle
            node, low = self._split(exit_node, same), same
        if low < last:
            leaf = self._add(low, last, text)
            self.child[(k1[low + 1], k2[low + 1])] = leaf
            self._place(leaf)
            self.turns += last + 1
            node = leaf
        self.count[node] += 1
        self.least[node] = doc_id if self.least[node] is None else min(self.least[node], doc_id)

    def insert_batch(self, ids: list[int], texts: list[tuple]) -> None:
        names = [(k1.tolist(), k2.tolist()) for k1, k2, _ in texts]
        found = [self.locate(*n)[0] for n in names]
        for i in sorted(range(len(ids)), key=found.__getitem__):
            self.insert(ids[i], texts[i], *names[i], found[i])

    def expand(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Edges as nodes, some at a time: arrays (depth, k1, k2, p1, p2, size, n, conv),
        and (number, u1, u2) of their ancestors at distances 1, 2, 4 ..."""
        count, least = list(self.count), list(self.least)
        order = sorted(range(1, len(self.top)), key=self.extent.__getitem__, reverse=True)
        parent = {}
        for node in range(1, len(self.top)):
            parent.setdefault(self._name(node, self.extent[node]), node)
        for node in order:  # the deeper before the shallower
            up = parent[self._name(node, self.top[node])] if self.top[node] else 0
            count[up] += count[node]
            if least[up] is None or least[node] < least[up]:
                least[up] = least[node]
        one = np.zeros(1, dtype=np.int64)
        yield one, one, one, one, one, one, one + count[0], one + least[0], one, one[:0], one[:0]
        for first in range(0, len(order), 2000):
            rows, ups = [], []
            for node in order[first:first + 2000]:
                k1, k2, size = self.text[node]
                a, b = self.top[node] + 1, self.extent[node] + 1
                depth = np.arange(a, b)
                n = np.floor(np.log2(depth)).astype(np.int64) + 1
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(depth, n) - (1 << step)
                rows.append((depth, k1[a:b], k2[a:b], k1[a - 1:b - 1], k2[a - 1:b - 1], size[a:b],
                             np.full(b - a, count[node]), np.full(b - a, least[node]), n))
                ups.append((k1[at], k2[at]))
            yield *(np.concatenate(c) for c in zip(*rows, strict=True)), *(np.concatenate(c) for c in zip(*ups, strict=True))


def prefix_names(t1: np.ndarray, t2: np.ndarray, size: np.ndarray, at: np.ndarray) -> list[tuple]:
    """For strings ``at[i]:at[i + 1]``: names of their prefixes and sizes of their places."""
    n = np.diff(at)
    place = (np.arange(len(t1)) - np.repeat(at[:-1], n) + 1).astype(U)
    out = []
    sums = []
    for t, odd in ((t1, 0x9E3779B97F4A7C15), (t2, 0xC2B2AE3D27D4EB4F)):
        total = np.zeros(len(t) + 1, dtype=U)
        np.cumsum(mix64(t.view(U) ^ mix64(place * U(odd))), dtype=U, out=total[1:])
        sums.append(total)
    sizes = np.concatenate([np.zeros(1, dtype=np.int64), size])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        k1, k2 = (int64(s[a:b + 1] - s[a]) for s in sums)
        out.append((k1, k2, np.concatenate([sizes[:1], size[a:b]])))
    return out


def strings(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, turns) of each conversation: digests and text bytes of its turns in order."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.struct(
        F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), F.substring(F.md5(text), 1, 16).alias("tie"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), F.octet_length(text).cast("long").alias("size")).alias("t")).where("id is not null")
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("id").agg(ordered.alias("all")).select(
        "id", F.transform("all", lambda t: F.struct(t["t1"].alias("t1"), t["t2"].alias("t2"), t["size"].alias("size"))).alias("turns"))


def rebuild(given: DataFrame, base: int = BASE, head: int = HEAD) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % ``base`` in place of its own,
    h = crc32(c) % ``head``."""
    given, _ = materialise(given, "conversations")
    c = F.col("id")
    mine = given.select("id", "turns", (c - c % base).alias("base"), (F.crc32(c.cast("string").cast("binary")) % head).cast("int").alias("h"))
    first = given.where(c % base == 0).select(c.alias("_base"), F.slice("turns", 1, head - 1).alias("_first"))
    joined = mine.join(first, F.col("base") == F.col("_base"), "left")
    none = F.array().cast(TURN)
    return joined.select("id", F.concat(F.slice(F.coalesce("_first", none), F.lit(1), F.col("h")),
                                        F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def local_tries(rebuilt: DataFrame, trie_turns: int = TRIE_TURNS) -> DataFrame:
    """Expanded nodes of each task's tries (``kind`` 0: members counted, ancestors' names)
    and the conversations' ends (``kind`` 1: name of the whole string, ``conv``)."""
    ship_package(rebuilt.sparkSession)
    names = ["depth", "k1", "k2", "p1", "p2", "size", "n", "conv"]
    out = schema(kind=LONG, **{c: LONG for c in names}, u1=T.ArrayType(LONG), u2=T.ArrayType(LONG))

    def give(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
        for *columns, n, u1, u2 in trie.expand():
            at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(n), np.int64)), *(pa.array(c) for c in columns),
                 *(pa.ListArray.from_arrays(at[:len(n) + 1], pa.array(u)) for u in (u1, u2))], out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for batch in batches:
            if not batch.num_rows:
                continue
            turns = batch.column("turns")
            flat = turns.flatten()
            at = np.concatenate([[0], np.cumsum(turns.value_lengths().to_numpy())])
            t1, t2, size = (flat.field(k).to_numpy() for k in range(3))
            ids, texts = batch.column("id").to_pylist(), prefix_names(t1, t2, size, at)
            if trie.turns > trie_turns:
                yield from give(trie)
                trie = ZFastTrie()
            trie.insert_batch(ids, texts)
            ends = {"kind": np.ones(len(ids), np.int64), "depth": np.diff(at), "k1": np.array([k[0][-1] for k in texts]),
                    "k2": np.array([k[1][-1] for k in texts]), "conv": np.array(ids)}
            yield pa.RecordBatch.from_arrays([pa.array(ends[f.name], pa.int64()) if f.name in ends else pa.nulls(
                len(ids), pa.list_(pa.int64()) if f.name[0] == "u" else pa.int64()) for f in out.fields], out.names)
        if trie.least[0] is not None or len(trie.top) > 1:
            yield from give(trie)

    return rebuilt.mapInArrow(run, out)


def ends_digest(ends: DataFrame) -> DataFrame:
    """Rows (k1, k2, ends_sha256): the ids of each name in ascending order, hashed as they stream by."""
    out = schema(k1=LONG, k2=LONG, ends_sha256=STRING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            done = []
            for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv")), strict=True):
                if (k1, k2) != name:
                    if name is not None:
                        done.append((*name, digest.hexdigest()))
                    name, digest = (k1, k2), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], out.names)
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*name, digest.hexdigest())], out.names)

    return ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv").mapInArrow(run, out)


def _same(a: list[str], b: list[str]) -> Column:
    return (F.col(a[0]) == F.col(b[0])) & (F.col(a[1]) == F.col(b[1]))


def trie_nodes(rebuilt: DataFrame, trie_turns: int = TRIE_TURNS) -> DataFrame:
    """A row per node for conversations (id, turns): ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    spark = rebuilt.sparkSession
    parts, parts_path = materialise(local_tries(rebuilt, trie_turns), "tries", "kind")
    merged = parts.where("kind = 0").groupBy("k1", "k2").agg(
        *(F.min(c).alias(c) for c in ("depth", "p1", "p2", "size")), F.sum("n").alias("n"), F.min("conv").alias("conv"),
        F.first("u1").alias("u1"), F.first("u2").alias("u2"))
    merged, merged_path = materialise(merged, "nodes")
    deepest, root = merged.agg(F.max("depth"), F.min("conv")).first()
    children = (merged.where("depth > 0").groupBy(F.col("p1").alias("_c1"), F.col("p2").alias("_c2"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    nodes = (merged.join(children, _same(["k1", "k2"], ["_c1", "_c2"]), "left").drop("_c1", "_c2")
             .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
             .withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
             .withColumn("saved", (F.col("n") - 1) * F.col("size")))
    sums, sums_path = materialise(nodes, "sums")
    for level in range((deepest or 0).bit_length()):
        below = (sums.where(F.size("u1") > level)
                 .groupBy(F.get("u1", F.lit(level)).alias("_a1"), F.get("u2", F.lit(level)).alias("_a2"))
                 .agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved")))
        new = (sums.join(below, _same(["k1", "k2"], ["_a1", "_a2"]), "left")
               .withColumn("n_leaves", F.col("n_leaves") + F.coalesce("_leaves", F.lit(0)))
               .withColumn("saved", F.col("saved") + F.coalesce("_saved", F.lit(0)))
               .drop("_a1", "_a2", "_leaves", "_saved"))
        old = sums_path
        sums, sums_path = materialise(new, "sums")
        drop_scratch(spark, old)
    digests = ends_digest(parts.where("kind = 1").select("k1", "k2", "conv"))
    digests = digests.select(F.col("k1").alias("_e1"), F.col("k2").alias("_e2"), "ends_sha256")
    full = sums.drop("u1", "u2").join(digests, _same(["k1", "k2"], ["_e1", "_e2"]), "left")
    up = merged.select(F.col("k1").alias("_p1"), F.col("k2").alias("_p2"), F.col("conv").alias("parent_conv_id"))
    shallow = full.where("depth = 1").withColumn("parent_conv_id", F.lit(root).cast("long"))  # the root's children don't meet in one task
    deep = full.where("depth <> 1").join(up.where("_p1 <> 0 or _p2 <> 0"), (F.col("depth") > 0) & _same(["p1", "p2"], ["_p1", "_p2"]), "left")
    names = ["conv", "depth", "parent_conv_id", "n", "n_children", "n_leaves", "saved", "ends_sha256"]
    out = deep.select(*names).union(shallow.select(*names))
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie_nodes(rebuild(strings(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = f"""
WITH own AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), substr(md5(coalesce(text, '')), 1, 16)) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, t, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
    list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT))),
    lambda s, b: list_reduce(list_concat([xor(s, b)], CAST(range(8) AS BIGINT[])),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT)) % {HEAD} AS h FROM own),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.t, [])[1:a.h], a.t[a.h + 1:]) AS t FROM h a LEFT JOIN own b ON b.c = a.c - a.c % {BASE}),
seqs AS (SELECT c, t, len(t) AS n, list_transform(range(0, len(t) + 1), lambda d: sha256(CAST(to_json(t[1:d]) AS VARCHAR))) AS keys FROM rebuilt),
visits AS (SELECT c, n, d, keys[d + 1] AS k, CASE WHEN d > 0 THEN keys[d] END AS p, keys[1:d + 1] AS path,
  CASE WHEN d > 0 THEN strlen(t[d].text) ELSE 0 END AS size FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM seqs)),
nodes AS (SELECT k, min(c) AS conv_id, min(d) AS depth, min(p) AS p, count(*) AS n_convs, min(path) AS path, (count(*) - 1) * min(size) AS saved,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM visits GROUP BY k),
kids AS (SELECT p, count(*) AS n_children FROM nodes GROUP BY p),
below AS (SELECT a AS k, sum(saved) AS saved, sum(leaf) AS leaves FROM (SELECT unnest(n.path) AS a, n.saved, CASE WHEN x.p IS NULL THEN 1 ELSE 0 END AS leaf
  FROM nodes n LEFT JOIN kids x ON x.p = n.k) GROUP BY a)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(x.n_children, 0) AS BIGINT) AS n_children,
  CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.k = n.k LEFT JOIN kids x ON x.p = n.k LEFT JOIN nodes u ON u.k = n.p
"""
