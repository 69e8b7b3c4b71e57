import re
from collections import defaultdict

import numpy as np
import pytest

from upshot.llm import jaccard_join as J
from upshot.llm.components import components

from .conftest import prose, tricky_rows


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """{(doc_id, text): (class_id, n_links, n_copies)}, null ids apart."""
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[t or ""].append(i)
    names, sets = list(texts), [shingles(t) for t in texts]
    links = defaultdict(set)
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            x, y = sets[a], sets[b]
            alike = not x and not y
            if x and 5 * len(x & y) >= 4 * len(x | y):
                links[a].add(b)
                links[b].add(a)
                alike = True
            if alike:
                parent[find(a)] = find(b)
    group = defaultdict(list)
    for k, t in enumerate(names):
        group[find(k)] += [i for i in texts[t] if i is not None]
    out = {}
    for k, t in enumerate(names):
        copies = sum(len(texts[names[j]]) for j in range(len(names)) if sets[j] == sets[k])
        for i in texts[t]:
            out[i, t] = (min(group[find(k)], default=None), len(links[k]) if sets[k] else 0, copies)
    return out


def check(df, rows):
    text_of = defaultdict(set)
    for r in df.select("doc_id", "class_id", "n_links", "n_copies").collect():
        text_of[r["doc_id"]].add((r["class_id"], r["n_links"], r["n_copies"]))
    want = defaultdict(set)
    for (i, _), v in brute(rows).items():
        want[i].add(v)
    assert text_of == want


def test_against_brute_force(tricky):
    out = J.near_duplicates(tricky)
    assert out.count() == len(tricky_rows())
    check(out, tricky_rows())


def family():
    """Two large groups of near copies, a passage that dissimilar texts share, and pairs at the threshold."""
    rows, n = [], 0
    for seed in (1, 2):
        base = prose(seed, 120).split()
        for k in range(30):
            w = list(base)
            for j in range(1 + k % 3):
                w[(k * 7 + j * 31) % 118] = f"x{seed}y{k}z{j}"
            rows.append((n, " ".join(w), "en"))
            n += 1
    passage = prose(3, 60)
    for k in range(40):
        rows.append((n, passage + " " + prose(100 + k, 60), "en"))
        n += 1
    return rows


@pytest.mark.parametrize("levels", [1, 4])
def test_large_buckets(spark, monkeypatch, levels):
    """Recursion, cores and tiles on buckets of over four sets."""
    monkeypatch.setattr(J, "LIMIT", 4)
    monkeypatch.setattr(J, "TILE", 7)
    monkeypatch.setattr(J, "LEVELS", levels)
    rows = family()
    check(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string")), rows)


def test_a_token_is_one_path_however_many_large_buckets_a_set_is_in(spark, monkeypatch):
    """Rare tokens are gone on with once for each set, not once for each of its smallest members, and exploded once."""
    monkeypatch.setattr(J, "LIMIT", 4)
    written = defaultdict(list)
    monkeypatch.setattr(J, "materialise", lambda df, name, *by, f=J.materialise: written[name].append(f(df, name, *by)) or written[name][-1])
    rows = family()
    check(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string")), rows)
    rare, = (x for x, _ in written["rare"])
    assert rare.count() > 20 and rare.count() == rare.select("rep").distinct().count()
    paths, = (x for x, _ in written["paths"])
    assert paths.count() > 20 and paths.count() == paths.distinct().count()


def test_keep_one_and_no_rows(spark, tricky, no_rows):
    kept = J.keep_one(tricky)
    assert kept.columns == tricky.columns
    want = {(i, t) for (i, t), v in brute(tricky_rows()).items() if v[0] == i and i is not None}
    assert {(r["doc_id"], r["text"] or "") for r in kept.collect() if r["doc_id"] is not None} == want
    assert J.near_duplicates(no_rows).count() == 0 and J.keep_one(no_rows).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 101), (7, 7), (200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}


def test_pairs_at_the_threshold_share_paths_at_every_depth():
    """Sets of 40 and 50 tokens with 40 in common, the worst case, followed through the levels of a bucket that stays large."""
    rng, lost = np.random.default_rng(1), [0] * (J.LEVELS + 1)
    for _ in range(800):
        y = rng.integers(0, 2**63, 50, dtype=np.int64).astype(np.uint64)
        pair = [np.sort(y[:40]), np.sort(y)]
        first = [J._paths(x, np.array([0, len(x)]), J._SEEDS)[0] for x in pair]
        shared = np.intersect1d(*first)
        for depth in range(J.LEVELS + 1):
            lost[depth] += not len(shared)
            shared = np.array([c for p in shared for c in np.intersect1d(*(J._children(x, p) for x in pair))], dtype=np.uint64)
    assert lost == [0] * (J.LEVELS + 1)


def test_a_large_core_and_a_shared_passage(spark):
    """1,200 near copies and 500 texts with a passage in common, at the limits in use, against all intersections."""
    import pyarrow as pa
    rows = []
    base = prose(1, 120).split()
    for k in range(1200):
        w = list(base)
        for j in range(1 + k % 4):
            w[(k * 7 + j * 31) % 118] = f"x{k}z{j}"
        rows.append((k, " ".join(w)))
    passage = prose(3, 60)
    rows += [(2000 + k, passage + " " + prose(100 + k // 2, 60) + f" q{k}" * (k % 2)) for k in range(500)]  # in pairs
    x, at = J._sets(pa.array([t for _, t in rows]))
    lists = [x[a:b] for a, b in zip(at[:-1], at[1:])]
    size = np.diff(at)
    both = J._common(lists)
    linked = 5 * both >= 4 * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, False)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    label = np.arange(len(rows))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(rows)).min(axis=1))
        if (new == label).all():
            break
        label = new
    assert got == {i: (rows[label[k]][0], int(linked[k].sum())) for k, (i, _) in enumerate(rows)}


def test_helper_columns_may_exist(spark):
    rows = [(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 1, 2, 3), (3, "z", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _hash int, class_0 int")
    kept = J.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
