import hashlib
import re
from collections import defaultdict

from upshot.llm import substring_dedup as S

from .conftest import tricky_rows


def brute(rows, window=S.WINDOW):
    split = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    least = defaultdict(lambda: float("inf"))
    for (i, *_), w in zip(rows, split):
        for p in range(len(w) - window + 1):
            if i is not None:
                least[tuple(w[p:p + window])] = min(least[tuple(w[p:p + window])], i)
    out = []
    for (i, *_), w in zip(rows, split):
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and least[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def result(df):
    return [tuple(r) for r in df.select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()]


def order(rows):
    return sorted(rows, key=str)


def test_cover_holds_every_difference():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_against_brute_force(spark, tricky, monkeypatch):
    want = brute(tricky_rows())
    out = S.dedup_substrings(tricky)
    assert order(result(out)) == order(want)
    assert sum(w[2] for w in want) > 300
    rows = {(r["row"]["id"], r["kept"], r["n_removed"]) for r in out.collect()}
    before = {i: r[1] for i, r in enumerate(tricky_rows())}
    assert all(kept == before[i] for i, kept, gone in rows if not gone)


def test_many_small_chunks_give_the_same(spark, tricky, monkeypatch):
    from pyspark import cloudpickle
    monkeypatch.setattr(S, "CHUNK_ROWS", 2)
    cloudpickle.register_pickle_by_value(S)
    try:
        assert order(result(S.dedup_substrings(tricky))) == order(brute(tricky_rows()))
    finally:
        cloudpickle.unregister_pickle_by_value(S)


def test_no_rows(no_rows):
    assert result(S.dedup_substrings(no_rows)) == []
