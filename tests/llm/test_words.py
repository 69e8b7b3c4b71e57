import re

import numpy as np
import pyarrow as pa

from upshot.llm import words as W

TEXTS = [None, "", " ", "a", " a b\n\nb\x0bc ", "é漢 x", "tail", "head tail", "x" * 50, "a b c d"]


def test_split_and_bounds():
    w = W.split(pa.array(TEXTS))
    raw = w.data.tobytes()
    for i, t in enumerate(TEXTS):
        got = [raw[a:b].decode() for a, b in zip(w.start[w.first[i]:w.first[i + 1]], w.end[w.first[i]:w.first[i + 1]])]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_hashes_depend_on_the_words_alone():
    w = W.split(pa.array(["p q r s", "zz p q r"]))
    h = w.hashes()
    assert h[0] == h[5] and h[0] != h[1]
    x, whole = w.windows(h, 3)
    assert whole.tolist() == [True, True, False, False] * 2
    assert x[0] == x[5] and x[0] != x[1]
    other = W.split(pa.array(["q r", "p q r"]))
    assert other.windows(other.hashes(), 3)[0][2] == x[0]


def test_chunks_keep_all_rows():
    b = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10] * 5 + [None, "b" * 100, "c"])})
    parts = list(W.chunks(b, "text", 25))
    assert sum(p.num_rows for p in parts) == 8 and max(p.num_rows for p in parts) <= 4
    assert [v for p in parts for v in p.column("text").to_pylist()] == b.column("text").to_pylist()


def test_no_texts():
    w = W.split(pa.array([], pa.string()))
    assert len(w.hashes()) == 0 and len(w.counts) == 0
    assert np.array_equal(w.first, [0])
