import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from upshot.llm import grammar_ids as G
from upshot.llm.common import open_file, scratch_path

from .conftest import tricky_rows


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(G.vocabulary_path())


def numbers(seed, n, top):
    r = random.Random(seed)
    words = [[r.randrange(top) for _ in range(r.randrange(1, 9))] for _ in range(30)]
    return np.array([x for _ in range(n) for x in (r.choice(words) if r.random() < 0.8 else [r.randrange(top)])], dtype="<u4")


@pytest.mark.parametrize("ids", [np.zeros(0, "<u4"), np.array([7], "<u4"), np.full(1000, 7, "<u4"), np.array([1, 1, 2] * 300, "<u4"),
                                 np.array([1, 2, 1] * 300 + [1] * 77, "<u4"), numbers(1, 400, 50), numbers(2, 3000, 49408)])
@pytest.mark.parametrize("terminals", [49408, 70000])
def test_round_trip_and_random_access(ids, terminals):
    shard = G.unpack_shard(G.pack_shard(ids, terminals, [(3, len(ids), 7)], min_count=4))
    assert np.array_equal(shard.ids(), ids)
    assert shard.symbols.itemsize == (2 if terminals < 65536 else 4)
    r = random.Random(len(ids))
    for _ in range(30):
        start, n = r.randrange(len(ids) + 1), r.randrange(40)
        assert np.array_equal(shard.ids(start, n), ids[start:start + n])


def expand(symbol, rules, terminals):
    return [symbol] if symbol < terminals else [y for s in rules[symbol - terminals] for y in expand(s, rules, terminals)]


def test_grammar_by_plain_expansion():
    ids = numbers(5, 500, 40)
    rules, symbols = G.compress(ids, 40, min_count=3)
    assert [y for s in symbols.tolist() for y in expand(s, rules.tolist(), 40)] == ids.tolist()
    assert G.expansion_lengths(rules, 40).tolist() == [len(expand(40 + k, rules.tolist(), 40)) for k in range(len(rules))]
    pairs = Counter(zip(symbols.tolist(), symbols.tolist()[1:]))
    assert len(symbols) < len(ids) / 2 and max(pairs.values()) < 3


TEXTS = ["", " ", "a  b\n\n c", "It's 12,345.67 DON'T!!", "漢字 émigré   x", "<|endoftext|> in the <|startoftext|>text", "\x00\x07 \x1c control\x85x",
         "👩‍👩‍👧 family", "A" * 5000, "\r\n\r\n  \t", "ﬁ ligature ½", "नमस्ते", "á e\u0301 \u0301x", "İstanbul ΟΔΟΣ ẞ ſ", "x\u00a0y\u3000z", " " * 100_000,
         "\n" * 100_000, "\u00a0" * 100_000, "<|not|>", "'S 's s'", "--==__", "١٢٣"]


def test_same_ids_as_the_tokenizers_library(whole):
    import pyarrow.parquet as pq
    encode = G.encoder(G.vocabulary_path())
    r = random.Random(3)
    texts = TEXTS + [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t]
    texts += ["".join(r.choice("abcdeéßÜÀzQ019.,!?'-$%<|>_ſ×÷ÿŸ ") for _ in range(60)) for _ in range(2000)]
    texts.append(" ".join(w.removesuffix("</w>") for w in whole.get_vocab() if w.isascii()))
    for t in texts:
        assert encode.ids(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids


def brute(rows, whole):
    """(doc_id, n_tokens, crc) of each row, and the ids of all rows in file order."""
    out = []
    for i, t in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        out.append((i, len(ids), zlib.crc32(ids.tobytes())))
    return out


@pytest.mark.parametrize("shard_ids", [97, G.SHARD_IDS])
def test_files(spark, tricky, no_rows, whole, shard_ids):
    manifest = G.write_files(tricky, scratch_path(spark, "ids"), shard_ids=shard_ids, part_bytes=20_000, min_count=8)
    got = sorted(G.read_files(manifest).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(brute([r[:2] for r in tricky_rows()], whole))
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert G.read_files(G.write_files(no_rows, scratch_path(spark, "ids"))).collect() == []


def test_read_ranges(spark, tricky):
    manifest = G.write_files(tricky, scratch_path(spark, "ids"), shard_ids=500, part_bytes=20_000, min_count=8)
    docs = G.read_files(manifest)
    rows = G.read_ranges(manifest, docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"]
    total = manifest.selectExpr("sum(ids)").first()[0]
    everything = G.read_ranges(manifest, spark.createDataFrame([(0, total)], "start long, n_tokens long")).collect()
    joined = b"".join(r["ids"] for r in sorted(everything, key=lambda r: r["part"]))
    plain = b"".join(r["ids"] for r in sorted(rows, key=lambda r: r["start"]))
    assert joined == plain


def test_a_damaged_tail_is_refused(spark, tmp_path):
    with open_file(str(tmp_path / "x.ids"), write=True) as f:
        f.write(b"x" * 100)
    with open_file(str(tmp_path / "x.ids")) as f, pytest.raises(ValueError):
        G.read_table(f)
