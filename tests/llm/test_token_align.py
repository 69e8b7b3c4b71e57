import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from upshot.llm import token_align as A

from .conftest import tricky_rows

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = ["", " ", "a  b\n\n c", "It's 12,345.67 DON'T!!", "漢字 émigré   x", "<|endoftext|> in the <|endoftext|>text <s> <0x0A>", "\x00\x07 \x1c control\x85x",
         "👩‍👩‍👧 family", "A" * 5000, "\r\n\r\n  \t", "ﬁ ligature ½", "नमस्ते", "á e\u0301 \u0301x", "x\u00a0y\u3000z", " " * 50_000, "\n" * 20_000 + "x",
         "\u00a0" * 20_000, "a ▁b", "trailing \n", "\n leading", "x;\r\n y);\r", " two", "e " * 300, "\ufeff bom", "\u2028x \u2003 y"]


@pytest.fixture(scope="module")
def known():
    import public_tokenizers
    return A.vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def plain(text, known):
    """Ids of both libraries over the whole text; none if their bytes are not the text's."""
    if not text:
        return [], []
    a, b = known.whole.encode(" " + text, add_special_tokens=False).ids, known.piece.encode(text)
    want = (" " + text).encode()
    good = b"".join(known.bytes_a[i] for i in a) == want == b"".join(known.bytes_b[i] for i in b)
    return (a, b) if good else ([], [])


def brute(rows, known):
    docs, count = [], Counter()
    for i, text in rows:
        a, b = plain(text, known)
        spans = [[], []]
        for k, (ids, names) in enumerate(((a, known.bytes_a), (b, known.bytes_b))):
            at = 0
            for x in ids:
                spans[k].append((at, at + len(names[x]), x))
                at += len(names[x])
        links, j = [], 0
        for s, e, x in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((x, spans[1][k][2]))
                k += 1
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        parts = [[[], []] for _ in both]
        for k in range(2):
            g = 0
            for _, e, x in spans[k]:
                while both[g] < e:
                    g += 1
                parts[g][k].append(str(x))
        text_of = ";".join(",".join(p) + "|" + ",".join(q) for p, q in parts)
        docs.append((i, len(a), len(b), len(both), links, hashlib.sha256(text_of.encode()).hexdigest() if a else ""))
        count.update(links)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return Counter((i, na, nb, g, len(v), sum(count[x] == most[x[1]] for x in v), sum(count[x] for x in v), h) for i, na, nb, g, v, h in docs), count


def test_segments_give_the_whole_texts_ids(known):
    r = random.Random(1)
    pieces = [" ", " ", "\n", "\t", "\u00a0", "\u3000", "\r", ";", "a", "b", "é", "漢", "x'", "'s", "1", "2", ".", "<s>", "<0x0A>", "\x00", "👩", "े", "\x1c", "\x85"]
    texts = TEXTS + ["".join(r.choice(pieces) for _ in range(r.randrange(1, 30))) for _ in range(5000)]
    assert known.segmented
    for t in texts:
        parts = known.segments(t)
        assert "".join(parts) == " " + t
        assert [i for s in parts for i in known.encode_a(s)] == known.whole.encode(" " + t, add_special_tokens=False).ids
        if t and "▁" not in t:
            assert [i for ids in known.encode_b(parts) for i in ids] == known.piece.encode(t)


@pytest.mark.parametrize("seed", range(20))
def test_align(seed):
    """Groups by pointer jumping against the bytes where both end."""
    r = random.Random(seed)
    n = r.choice([1, 5, 60, 3000])
    step = r.choice([0.9, 0.5, 0.05])
    a, b = (np.array(sorted({n, *(x for x in range(1, n) if r.random() < step)})) for _ in range(2))
    of_a, of_b, over_a, over_b, meets = A.align(a, b)
    both = np.array(sorted(set(a.tolist()) & set(b.tolist())))
    assert of_a.tolist() == np.searchsorted(both, a).tolist() and of_b.tolist() == np.searchsorted(both, b).tolist()
    assert meets.tolist() == [x in set(a.tolist()) for x in b.tolist()]


def test_varint():
    x = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**62, 5], dtype=np.int64)
    assert A.unvarint(A.varint(x)).tolist() == x.tolist() and A.unvarint(A.varint(x[:0])).tolist() == []


@pytest.mark.parametrize("block_bytes", [1, 3000, A.BLOCK_BYTES])
def test_documents(spark, tricky, known, block_bytes):
    rows = [r[:2] for r in tricky_rows()] + [(100 + k, t) for k, t in enumerate(TEXTS)]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    docs, links = A.align_tokenizers(tricky.unionByName(more, allowMissingColumns=True), block_bytes=block_bytes)
    want, count = brute(rows, known)
    assert Counter(tuple(r) for r in docs.select(*COLUMNS).collect()) == want
    assert {(r["a"], r["b"]): r["total"] for r in links.collect()} == count


def test_empty_and_unsegmented(spark, no_rows, known):
    assert A.align_tokenizers(no_rows)[0].collect() == []
    assert A.align_tokenizers(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))[0].select(*COLUMNS).collect() == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    known.segmented = False
    try:
        held = A.Segments(known)
        block = A.Block(held)
        texts = [t for t in TEXTS if t]
        block.add(list(range(len(texts))), [t.encode() for t in texts])
        got = Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in block.finish()[0])
        assert got == Counter({x[:5] + x[7:]: n for x, n in brute(list(enumerate(texts)), known)[0].items()})
    finally:
        known.segmented = True
