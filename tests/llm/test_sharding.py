import random
import zlib
from collections import defaultdict

import numpy as np

from upshot.llm import sharding as K

from .conftest import tricky_rows


def test_differencing_two_ways():
    # the textbook case: 8, 7, 6, 5, 4 differ by 2 after differencing into two
    parts = [np.array([x, 0]) for x in (8, 7, 6, 5, 4)]
    final = K.difference(parts)
    sums = [0, 0]
    for x, f in zip((8, 7, 6, 5, 4), final):
        sums[f[0]] += x
    assert sorted(sums) == [14, 16]


def test_differencing_is_tight():
    r = random.Random(3)
    sizes = [int(r.lognormvariate(7, 1)) for _ in range(3000)]
    parts = [np.array([s] + [0] * 15) for s in sizes]
    sums = np.zeros(16, int)
    for s, f in zip(sizes, K.difference(parts)):
        assert sorted(f) == list(range(16))
        sums[f[0]] += s
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 16


def check(rows, want):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in want), key=str)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))


def test_shards(spark, tricky, no_rows):
    rows = K.shard_by_bytes(tricky).collect()
    check(rows, [r[:2] for r in tricky_rows()])
    together = defaultdict(set)
    for r in rows:
        together[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(v) == 1 for k, v in together.items() if k[0] > 1)
    assert K.shard_by_bytes(no_rows).collect() == []


def test_levels_of_differencing(spark):
    """Many leaves and several levels; one text has a third of all rows."""
    r = random.Random(5)
    rows = [(i, "common" if i % 3 == 0 else "t%d " % i + "x" * r.randrange(400)) for i in range(2400)]
    got = K.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), leaf=16).collect()
    check(got, rows)
    sums = np.zeros(16, int)
    for x in got:
        sums[x["shard"]] += x["size"]
    assert sums.max() - sums.min() <= 64
