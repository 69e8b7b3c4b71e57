import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from upshot.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest()[:16], text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + v[h:]
    return out


def brute(convs):
    """The rows by plain enumeration of every prefix."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        mine = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = mine + sum(saved[k] for k in kids[node])
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def conversations(seed, n, longest=9):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        turns = [r.choice(["a", "b", "ü", "", None]) for _ in range(r.randrange(1, longest))] if r.random() < 0.7 else ["hot", "hot2", r.choice("xyz")]
        rows += [(c * r.choice([1, 1, 1, 3]), k, r.choice(["user", None]) if k % 3 else "user", t) for k, t in enumerate(turns)]
    return rows


EDGE = [(None, 0, "user", "lost"), (None, 1, "user", "lost"), (7, None, "system", "first"), (7, 0, "user", "x"), (7, 0, "user", "x"), (7, 1, None, None),
        (11, 5, "user", "a"), (11, 5, "assistant", "a"), (12, 0, "user", ""), (12, 1, "", None), (15, 0, "u", "x" * 50_000), (16, 0, "u", "x" * 50_000)]


@pytest.mark.parametrize("low,high", [(a, b) for a in range(20) for b in range(a + 1, 21)])
def test_two_fattest(low, high):
    best = max(range(low + 1, high + 1), key=lambda x: x & -x)
    assert P.two_fattest(low, high) == best


@pytest.mark.parametrize("seed,letters,longest,batch", [(1, 2, 12, 1), (2, 2, 12, 50), (3, 3, 40, 7), (4, 1, 30, 5), (5, 2, 300, 20)])
def test_trie_of_strings(seed, letters, longest, batch):
    """Handles, exit nodes and expanded nodes against plain sets of prefixes."""
    r = random.Random(seed)
    texts = [[r.randrange(letters) for _ in range(r.randrange(longest))] for _ in range(120)]
    texts += [t[:r.randrange(len(t) + 1)] + [r.randrange(letters)] * r.randrange(9) for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    flat = np.array([x for t in texts for x in t], dtype=np.int64)
    named = P.prefix_names(flat, flat * 7 + 1, flat + 1, at)
    trie = P.ZFastTrie()
    for k in range(0, len(texts), batch):
        trie.insert_batch(list(range(k, min(k + batch, len(texts)))), named[k:k + batch])
    prefixes = {tuple(t[:d]) for t in texts for d in range(len(t) + 1)}
    stops = {p for p in prefixes if p in {tuple(t) for t in texts} or sum(p + (x,) in prefixes for x in range(letters)) > 1} | {()}
    assert len(trie.top) == len(stops) and sorted(trie.extent) == sorted(map(len, stops))
    assert len(trie.handle) == len(trie.child) == len(stops) - 1
    for t, (k1, k2, _) in zip(texts, named):
        node, low, off = trie.locate(k1.tolist(), k2.tolist())
        assert low == trie.extent[node] == len(t) and off is None
        other = t[:len(t) // 2] + [letters + 1] * 3  # leaves the trie half way
        o = np.array(other, dtype=np.int64)
        j1, j2, _ = P.prefix_names(o, o * 7 + 1, o + 1, np.array([0, len(other)]))[0]
        node, low, off = trie.locate(j1.tolist(), j2.tolist())
        want = max(len(s) for s in stops if len(s) <= len(t) // 2 and tuple(t[:len(s)]) == s)
        assert low == want and (off is not None) == (low < len(t) // 2)
    depth, n = (np.concatenate(c) for c in list(zip(*trie.expand()))[:7:6])
    assert len(depth) == len(prefixes) and sorted(zip(depth.tolist(), n.tolist())) == sorted(
        (len(p), sum(tuple(t[:len(p)]) == p for t in texts)) for p in prefixes)


@pytest.mark.parametrize("trie_turns", [3, P.TRIE_TURNS])
@pytest.mark.parametrize("rows", [EDGE, conversations(1, 90) + EDGE[:4], conversations(2, 40, 60)])
def test_nodes(spark, rows, trie_turns):
    given = [(*r, 1, "x") for r in rows]
    df = spark.createDataFrame(given, "conv_id long, turn int, role string, text string, id int, k1 string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows_of(P.trie_nodes(P.rebuild(P.strings(df)), trie_turns)) == brute(rebuilt(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_turnless_and_empty(spark):
    # conversation 8 takes its first turns from conversation 5, which is absent: nothing is left of it
    assert zlib.crc32(b"8") % 9 > 2
    rows = [(8, 0, "user", "a"), (8, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = rows_of(P.trie_nodes(P.rebuild(P.strings(df))))
    assert got == brute(rebuilt(rows)) and got[0][:5] == (8, 0, None, 1, 0)
    assert rows_of(P.trie_nodes(P.rebuild(P.strings(df.where("1 = 0"))))) == []
