import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from upshot.llm import packing as P

from .conftest import tricky_rows


def filled(patterns):
    out = Counter()
    for n, lengths in patterns:
        assert n > 0 and sum(lengths) <= P.CAPACITY
        for k in lengths:
            out[k] += n
    return out


@pytest.mark.parametrize("lengths", [[], [1], [2048] * 5, [1025] * 7, [700] * 999, [2048, 1, 1025, 1025, 1023], list(range(1, 2049)),
                                     [random.Random(1).choice([700, 1340, 650, 9]) for _ in range(3000)],
                                     [min(2048, int(random.Random(k).lognormvariate(6.3, 1)) + 1) for k in range(5000)]])
def test_plan_places_every_piece(lengths):
    h = Counter(lengths)
    for groups, small in P.SETTINGS:
        assert filled(P.linear_grouping(dict(h), P.CAPACITY, groups, small)) == h
    plan = P.plan(dict(h))
    assert filled(plan) == h
    need = sum(n for n, _ in plan)
    plain = P._best_fit([], dict(h), P.CAPACITY)
    assert -(-sum(lengths) // P.CAPACITY) <= need <= sum(n for n, _ in plain)


def test_configurations_are_best():
    # two of 700 and one of 600, or three of 600: 2000 wide, none better
    found = P.best_configurations([1000, 700, 600], [10, 20, 10], 2048)
    assert sum(n for n, _ in found) <= 20
    for n, times in found:
        assert sum(t * s for t, s in zip(times, [1000, 700, 600])) <= 2048


def test_cut():
    assert P.cut(1, 2048) == [(0, 1)] and P.cut(2048, 2048) == [(0, 2048)]
    assert P.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


TEXTS = ["", " ", "a  b\n\n c", "It's 12,345.67 don't!!", "漢字 émigré   x", "<|endoftext|> in the <|endoftext|>text", "\x00\x07 control",
         "👩‍👩‍👧 family", "A" * 500, "\r\n\r\n  \t", "ﬁ ligature ½", "नमस्ते", "áe"]


def test_same_ids_as_the_tokenizers_library():
    whole, fast = Tokenizer.from_file(P.tokenizer_path()), P.encoder(P.tokenizer_path())
    import pyarrow.parquet as pq
    texts = TEXTS + [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t]
    for t in texts:
        assert fast(t) == whole.encode(t, add_special_tokens=False).ids


def test_long_runs_of_white_space(spark):
    texts = [(k, c * 1_000_000 + tail) for k, (c, tail) in enumerate([(" ", ""), ("\n", "x"), ("\u00a0", "\u00a0y")])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    check(P.pack(docs).collect(), texts)
    import corpus_pipeline
    assert corpus_pipeline.pack(spark, docs, "").count() > 3


def check(rows, texts):
    """Pieces rebuild each document's ids; sequences are gapless and not overfull."""
    whole = Tokenizer.from_file(P.tokenizer_path())
    want = Counter()
    for i, t in texts:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k, (s, n) in enumerate(P.cut(len(ids), P.CAPACITY)):
            want[i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= P.CAPACITY
    return len(by)


def test_pack(tricky, no_rows):
    rows = P.pack(tricky).collect()
    need = check(rows, [r[:2] for r in tricky_rows()])
    assert need <= -(-sum(r["length"] for r in rows) // P.CAPACITY) + 1
    assert P.pack(no_rows).collect() == []


def test_ids_on_request(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in P.pack(docs, keep_ids=True).collect()}
    assert got[2] == [0] and got[1][-1] == 0 and len(got[1]) == 3
