"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts are a group and stay together. A partial partition is
``SHARDS`` sums; a single group is one with all its bytes in one sum. Differencing
takes the two partial partitions with the largest spread (largest minus smallest
sum) and adds them in opposite order, largest to smallest, until one is left.

Distribution: groups are dealt into buckets of about ``LEAF`` by a hash, each
bucket is differenced in a task, and its subsets are groups of the next level,
until few are left for a last task, which deals them to the shards. Groups that
are large for a shard, at most ``SHARDS * COARSE`` a level, and one bucket a level
go to that task as they are: so it has groups of all sizes to even out the large
ones. It sees at most ``5 * LEAF + SHARDS * COARSE`` groups and as many more per
level, and each level is ``LEAF / SHARDS`` times smaller. A frequent text is one
group, summed before it is shuffled.

Defined cases: a null text has size 1 and null texts are a group; repeated rows
are rows of their group; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import INT, LONG, documents, gapless_rank, materialise, schema

SHARDS = 16
LEAF = 4096
COARSE = 64


def difference(parts: list[np.ndarray]) -> list[np.ndarray]:
    """For each partial partition, the final subset of each of its sums.

    Equal spreads are taken in the order given, so the result depends on
    nothing but the input."""
    k = len(parts[0])
    nodes: list[tuple] = [None] * len(parts)
    heap = [(-int(p.max() - p.min()), i, p) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        down, up = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        total = a[down] + b[up]
        nodes.append((i, down, j, up))
        heapq.heappush(heap, (-int(total.max() - total.min()), len(nodes) - 1, total))
    final: list = [None] * len(nodes)
    final[heap[0][1]] = np.arange(k)
    for n in range(len(nodes) - 1, len(parts) - 1, -1):
        i, down, j, up = nodes[n]
        final[i], final[j] = np.empty(k, dtype=np.int64), np.empty(k, dtype=np.int64)
        final[i][down] = final[n]
        final[j][up] = final[n]
    return final[:len(parts)]


def _deal(shards: int):
    """The subset of each group of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("level", "ascending"), ("a", "ascending"), ("b", "ascending")])
        parts = [np.append(np.int64(s), np.zeros(shards - 1, np.int64)) for s in table.column("bytes").to_numpy()]
        subset = np.array([f[0] for f in difference(parts)], dtype=np.int64)
        return table.append_column("subset", pa.array(subset))

    return run


def deal(groups: DataFrame, shards: int = SHARDS, leaf: int = LEAF) -> DataFrame:
    """Rows (a, b, shard) for ``groups`` (a, b, bytes), where a and b name a group."""
    out = schema(level=INT, a=LONG, b=LONG, bytes=LONG, node=LONG, subset=LONG)
    level, held, below = groups.withColumn("level", F.lit(0)), [], []
    while True:
        count, total = level.agg(F.count(F.lit(1)), F.sum("bytes")).first()
        if count <= 4 * leaf:
            break
        nodes = -(-count // leaf)
        level = level.withColumn("node", F.when(F.col("bytes") > total // (shards * COARSE), 0).otherwise(
            F.pmod(F.xxhash64("a", "b"), F.lit(nodes))).cast("long"))
        held.append(level.where("node = 0").select("level", "a", "b", "bytes"))
        step, _ = materialise(level.where("node > 0").select("level", "a", "b", "bytes", "node").groupBy("node")
                              .applyInArrow(_deal(shards), out), "subsets")
        below.append(step)
        level, _ = materialise(step.groupBy("node", "subset").agg(F.sum("bytes").alias("bytes"))
                               .select(F.lit(len(below)).alias("level"), F.col("node").alias("a"), F.col("subset").alias("b"), "bytes"), "groups")
    last = level.select("level", "a", "b", "bytes")
    for h in held:
        last = last.union(h)
    last, _ = materialise(last.withColumn("node", F.lit(0).cast("long")).groupBy("node").applyInArrow(_deal(shards), out), "shards")
    place = last.where(F.col("level") == len(below)).select("a", "b", F.col("subset").alias("shard"))
    for number in range(len(below) - 1, -1, -1):
        above = place.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "shard")
        down = (below[number].join(above, (F.col("node") == F.col("_a")) & (F.col("subset") == F.col("_b")))
                .select("a", "b", "shard"))
        place = down.union(last.where(F.col("level") == number).select("a", "b", F.col("subset").alias("shard")))
    return place


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                   leaf: int = LEAF) -> DataFrame:
    """A row per document: ``id_col``, ``size``, ``text_crc32``, ``shard``, ``slot``."""
    text = F.col(f"`{text_col}`").cast("string")
    meta, _ = materialise(docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), 0).otherwise(F.xxhash64(text)).alias("k1"),
        F.when(text.isNull(), 0).otherwise(F.xxhash64(F.lit(1), text)).alias("k2")), "sizes")
    groups, _ = materialise(meta.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")), "groups")
    placed = deal(groups.select(F.col("k1").alias("a"), F.col("k2").alias("b"), "bytes"), shards, leaf).select(
        F.col("a").alias("_k1"), F.col("b").alias("_k2"), F.col("shard").cast("int").alias("shard"))
    dealt, _ = materialise(
        meta.join(placed, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
        .select("id", "size", "text_crc32", "shard"), "shards")
    return gapless_rank(dealt, "shard", ["id", "text_crc32"], "slot").withColumnRenamed("id", id_col)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, equal texts together."""
    out = shard_by_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
