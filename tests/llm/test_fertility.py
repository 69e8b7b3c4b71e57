import re
from collections import Counter

import pyarrow as pa
import pytest

from upshot.llm import fertility as Q
from upshot.llm import words as W

from .conftest import prose, tricky_rows

EXTRA = ["a b c a b c", "x\nx\n\n \nx y\nx", "#*$%&|<> #", "é漢 é漢", "\n", "a\nb", "a b a b a b", "tail\n"]


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_counts():
    texts = EXTRA + [r[1] for r in tricky_rows()]
    got = Q.base_counts(W.split(pa.array(texts)))
    assert [tuple(int(got[c][i]) for c in COLS) for i in range(len(texts))] == [base(t) for t in texts]


def test_measures_by_brute_force():
    import math
    import public_tokenizers
    byte, piece, fallback = Q._vocabularies(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["the cat the dog", "漢字 ☃ zz", "", "a"]
    w = W.split(pa.array(texts))
    got = Q.token_measures(w, byte, piece, fallback, Q.base_counts(w)["word_chars"])
    for i, t in enumerate(texts):
        ids = [x for word in t.split() for x in piece.encode(word)]
        if not ids:
            assert got["piece_chars"][i] != got["piece_chars"][i]
            continue
        chars = sum(map(len, t.split()))
        n = sum(len(byte.encode_ordinary(" " + x)) for x in t.split())
        p = [c / len(ids) for c in Counter(ids).values()]
        bits = -sum(x * math.log2(x) for x in p) / math.log2(len(ids)) if len(ids) > 1 else 0
        assert got["piece_chars"][i] == pytest.approx(chars / len(ids)) and got["byte_chars"][i] == pytest.approx(chars / n)
        assert got["fallback"][i] == pytest.approx(sum(bool(fallback[x]) for x in ids) / len(ids))
        assert got["entropy"][i] == pytest.approx(bits)


def test_bands_reject_odd_texts(spark):
    rows = [(i, prose(i, 120 + i), "en") for i in range(80)] + [(100, " ".join("zqx%dvkj" % k for k in range(150)), "en"),
                                                              (101, " ".join("𓀀" * 3 + str(k) for k in range(90)), "en")]
    out = {r["doc_id"]: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not out[100]["kept"] and not out[101]["kept"] and "fallback" in out[101]["rejected"]
    assert sum(out[i]["kept"] for i in range(80)) >= 79


def test_edge_rows(spark, tricky, no_rows):
    rows = Q.judge(tricky).collect()
    assert sorted((tuple(r[c] for c in ["doc_id", *COLS]) for r in rows), key=str) == sorted(((i, *base(t)) for i, t, _ in tricky_rows()), key=str)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and r["kept"] is not None
    assert Q.judge(no_rows).count() == 0
    assert Q.judge(tricky.drop("lang")).count() == len(rows)
    assert Q.script("привет мир abc") == "cyrillic" and Q.script("12") == "other"


def test_long_runs_of_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    byte = Q._vocabularies(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))[0]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for word in ("\u00a0" * 100_000, "ab" + "\u00a0" * 100_000 + "cd.\u3000x", "x" + "\u3000" * 70_000):
        assert Q.byte_tokens(byte, word) == len(whole.encode(" " + word, add_special_tokens=False).ids)
    docs = [(1, " " * 1_000_000, "en"), (2, "\n" * 1_000_000, "en"), (3, "\u00a0" * 1_000_000, "en"), (4, prose(1, 60), "en")]
    out = {r["doc_id"]: r for r in Q.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert [out[i]["n_words"] for i in (1, 2, 3, 4)] == [0, 0, 1, 60]


def plain_bands(rows):
    """Verdicts from the measures by plain loops."""
    import statistics
    passed = [r for r in rows if not r["base_failed"]]

    def low_median(v):
        return sorted(v)[(len(v) + 1) // 2 - 1]

    def band(of):
        out = {}
        for k, (scale, least, _, _) in Q.MEASURES.items():
            v = [int(r[k] * scale + 0.5) for r in passed if of(r) and r[k] is not None]
            if v:
                out[k] = low_median(v), max(least, low_median([abs(x - low_median(v)) for x in v])), len(v)
        return out

    kept = {}
    for r in rows:
        mine = band(lambda x: x["lang"] is not None and x["lang"] == r["lang"])
        if not mine or min(n for _, _, n in mine.values()) < Q.GROUP_ROWS:
            mine = band(lambda x: x["script"] == r["script"])
        wider = max(1.0, Q.FULL_WORDS / max(r["n_words"], 1)) ** 0.5
        out = False
        for k, (scale, _, below, above) in Q.MEASURES.items():
            if k in mine and r[k] is not None:
                away = (r[k] * scale - mine[k][0]) / (mine[k][1] * wider)
                out |= away < -below or away > above
        kept[r["doc_id"]] = not r["base_failed"] and not out
    assert statistics
    return kept


def test_verdicts_by_plain_loops_and_rare_languages(spark):
    junk = [" ".join("zqx%dvkj" % (k + j) for k in range(150)) for j in range(4)]
    rows = [(i, prose(i, 60 + 3 * i), "en") for i in range(60)] + [(100 + i, prose(200 + i, 120), "zz") for i in range(5)]
    rows += [(200, junk[0], "en"), (201, junk[1], "zz"), (202, junk[2], None), (203, junk[3], "one"), (300, "привет мир " * 40 + prose(1, 5), "ru")]
    out = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    got = {r["doc_id"]: r["kept"] for r in out}
    assert got == plain_bands(out)
    assert not any(got[i] for i in (200, 201, 202, 203)) and all(got[100 + i] for i in range(5))
