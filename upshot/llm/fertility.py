"""Quality rules from tokeniser fertility, beside plain word rules.

Fertility is measured on the words of a text with public vocabularies, each word
encoded by itself: characters per token for a byte-level and for a piece
vocabulary, the share of byte-fallback tokens of the latter, and the entropy of
its tokens relative to the most that as many tokens allow. Junk shows as words that break
into many or few pieces, as bytes outside the vocabulary, or as a flat or
repetitive choice of tokens.

A measure is rejected outside a band around the median of the document's language,
or of its main script where the language is unknown or has fewer than ``GROUP_ROWS``
documents that pass the word rules: some times the median
absolute deviation (``MEASURES``), and wider for texts of fewer than
``FULL_WORDS`` words, by the square root of the ratio, as their measures scatter
more. Medians and deviations come from exact histograms of the rounded measures of
all documents that pass the word rules; a script's counts all its documents, whatever
their language.

Distribution: one pass over the texts writes a few numbers per document; the
histograms are aggregated before the shuffle and have a bounded number of bins per
group. Words are encoded once per chunk of text, and the encoder holds no state.

Defined cases: a null or empty text has no words, fails the word rules and has
null measures; rows that repeat an id are rows of their own; a missing or null
language counts as unknown; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .common import DOUBLE, LONG, STRING, column_or_null, documents, materialise, schema, ship_package
from .packing import is_panic

MIN_WORDS = 50
REPEAT_WINDOW = 3
FULL_WORDS = 200
GROUP_ROWS = 30
CHUNK = 4 << 20
#: measure -> (bins per unit, least deviation in bins, deviations allowed below and above the median)
MEASURES = {"byte_chars": (1000, 15, 5, 8), "piece_chars": (1000, 15, 5, 8), "fallback": (1000, 5, 8, 8), "entropy": (1000, 15, 8, 8)}
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: first byte of a UTF-8 character -> script, coarse ranges of code points
SCRIPTS = ((0x41, 0x24F, "latin"), (0x370, 0x3FF, "greek"), (0x400, 0x52F, "cyrillic"), (0x590, 0x5FF, "hebrew"),
           (0x600, 0x6FF, "arabic"), (0x900, 0xDFF, "indic"), (0xE00, 0xE7F, "thai"), (0x3040, 0x30FF, "kana"),
           (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7A3, "hangul"))
WHITE = " \t-\r\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"([{WHITE}]+)([^{WHITE}]*)")
_LOADED: dict = {}


def _vocabularies(byte_path: str, piece_path: str):
    key = byte_path, piece_path
    if key not in _LOADED:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        byte = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        fallback = np.array([piece.is_byte(i) for i in range(piece.get_piece_size())])
        _LOADED[key] = byte, piece, fallback
    return _LOADED[key]


def script(text: str) -> str:
    """The script of most letters of the listed ranges, else ``other``."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    best, most = "other", 0
    for low, high, name in SCRIPTS:
        n = int(((code >= low) & (code <= high)).sum())
        if n > most:
            best, most = name, n
    return best


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the bounds ``at``."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def base_counts(w: W.Words) -> dict[str, np.ndarray]:
    """The word rules' counts of each text."""
    n = len(w.counts)
    data = w.data
    lead = (data & 0xC0) != 0x80
    inside = ~W._SPACE[data]
    out = {"n_words": w.counts.astype(np.int64), "word_chars": _per_text(lead & inside, w.text_at),
           "n_symbols": _per_text(SYMBOLS[data], w.text_at)}
    # lines: between line feeds and the texts' bounds
    feed = np.flatnonzero(data == 0x0A)
    start = np.concatenate([w.text_at[:-1], feed + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(w.text_at, feed, side="right") - 1])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    end = np.append(start[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, bool)
    end = np.where(last, w.text_at[owner + 1], end - 1)
    with_word = np.searchsorted(w.start, start) < np.searchsorted(w.start, end)
    start, end, owner = start[with_word], end[with_word], owner[with_word]
    h = w.span_hash(start, end)
    order = np.lexsort((h, owner))
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[order][again], minlength=n).astype(np.int64)
    # words in windows that occur twice or more in the text
    h = w.hashes()
    x, whole = w.windows(h, REPEAT_WINDOW)
    at, own = np.flatnonzero(whole), w.owner()
    order = at[np.lexsort((x[at], own[at]))]
    same = (x[order][1:] == x[order][:-1]) & (own[order][1:] == own[order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    if len(order):
        twice[1:] |= same
        twice[:-1] |= same
    cover = np.zeros(len(h) + REPEAT_WINDOW, dtype=bool)
    for k in range(REPEAT_WINDOW):
        cover[order[twice] + k] = True
    out["n_repeat_words"] = _per_text(cover[:len(h)], w.first)
    return out


def byte_tokens(byte, word: str) -> int:
    """Tokens of a word behind a blank. A run of white space other than ASCII that is too long
    for the pattern is cut as the pattern would: one piece, but for the last character
    if another one follows."""
    try:
        return len(byte.encode_ordinary(" " + word))
    except BaseException as e:
        if not is_panic(e):
            raise
    one_piece, total = byte._core_bpe.encode_single_piece, 0
    for run, rest in LONG_RUN.findall(" " + word):
        if run == " ":
            total += len(byte.encode_ordinary(run + rest))
        else:
            cut = [run[:-1], run[-1]] if rest else [run]
            total += sum(len(one_piece(x.encode())) for x in cut if x) + len(byte.encode_ordinary(rest))
    return total


def token_measures(w: W.Words, byte, piece, fallback: np.ndarray, chars: np.ndarray) -> dict[str, np.ndarray]:
    """Fertility measures of each text; nan where it has no token."""
    n = len(w.counts)
    _, first, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    raw = w.data.tobytes()
    words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[first], w.end[first], strict=True)]
    byte_n = np.array([byte_tokens(byte, x) for x in words], dtype=np.int64)
    ids = piece.encode(words, num_threads=1) if words else []
    piece_n = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.fromiter((t for x in ids for t in x), dtype=np.int64, count=int(piece_n.sum()))
    begin = np.cumsum(piece_n) - piece_n
    own = w.owner()
    tokens = np.bincount(own, piece_n[which], minlength=n) if n else np.zeros(0)
    bytes_ = np.bincount(own, byte_n[which], minlength=n) if n else np.zeros(0)
    m = piece_n[which]
    at = np.repeat(begin[which] - np.cumsum(m) + m, m) + np.arange(m.sum())
    token, of = flat[at], np.repeat(own, m)
    back = np.bincount(of, fallback[token], minlength=n) if n else np.zeros(0)
    key, count = np.unique(of * len(fallback) + token, return_counts=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = count / tokens[key // len(fallback)]
        bits = np.bincount(key // len(fallback), -share * np.log2(share), minlength=n) if n else np.zeros(0)
        return {"byte_chars": chars / bytes_, "piece_chars": chars / tokens, "fallback": back / tokens,
                "entropy": np.where(tokens > 1, bits / np.log2(np.maximum(tokens, 2)), np.where(tokens > 0, 0.0, np.nan))}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Counts of the word rules and fertility measures of each document."""
    if byte_path is None or piece_path is None:
        import public_tokenizers
        byte_path = byte_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        piece_path = piece_path or public_tokenizers.path("piece_bpe_32k.model")
    ship_package(docs.sparkSession)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = schema(id=LONG, lang=STRING, script=STRING, **{c: LONG for c in counts}, **{c: DOUBLE for c in MEASURES})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte, piece, fallback = _vocabularies(byte_path, piece_path)
        for batch in batches:
            for c in W.chunks(batch, "text", CHUNK):
                w = W.split(c.column("text"))
                base = base_counts(w)
                found = token_measures(w, byte, piece, fallback, base["word_chars"])
                scripts = [script(text.as_py() or "") for text in c.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [c.column("id"), c.column("lang"), pa.array(scripts, pa.string()), *(pa.array(base[k], pa.int64()) for k in counts),
                     *(pa.array(found[k], pa.float64(), from_pandas=True) for k in MEASURES)], out.names)

    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                        column_or_null(docs, lang_col, "string").alias("lang"))
    return given.mapInArrow(run, out)


def _median(histogram: DataFrame, value: str, out: str) -> DataFrame:
    """Least value that half of a (band, measure)'s documents don't exceed, from (value, n)."""
    order = Window.partitionBy("band", "measure").orderBy(value)
    whole = Window.partitionBy("band", "measure")
    return (histogram.withColumn("_upto", F.sum("n").over(order)).withColumn("_all", F.sum("n").over(whole))
            .where(F.col("_upto") * 2 >= F.col("_all")).groupBy("band", "measure")
            .agg(F.min(value).alias(out), F.max("_all").alias("rows")))


def _band(kind: str):
    return F.concat(F.lit(f"{kind}:"), F.col(kind))


def bands(measured: DataFrame) -> DataFrame:
    """Rows (band, then median and deviation of each measure, in bins) from all documents that pass the word
    rules: of each script, and of each language of ``GROUP_ROWS`` such documents."""
    pairs = [F.struct(F.lit(k).alias("measure"), F.round(F.col(k) * scale).cast("long").alias("bin")) for k, (scale, *_) in MEASURES.items()]
    histogram = (measured.where("not base_failed").select("lang", "script", F.explode(F.array(*pairs)).alias("p"))
                 .where("p.bin is not null").groupBy("lang", "script", F.col("p.measure").alias("measure"), F.col("p.bin").alias("bin"))
                 .agg(F.count(F.lit(1)).alias("n"))
                 .select(F.explode(F.array(_band("lang"), _band("script"))).alias("band"), "measure", "bin", "n").where("band is not null").groupBy("band", "measure", "bin").agg(F.sum("n").alias("n")))
    middle = _median(histogram, "bin", "middle").where((F.col("rows") >= GROUP_ROWS) | F.col("band").startswith("script:"))
    away = (histogram.join(middle.drop("rows"), ["band", "measure"])
            .groupBy("band", "measure", "middle", F.abs(F.col("bin") - F.col("middle")).alias("away")).agg(F.sum("n").alias("n")))
    spread = _median(away, "away", "spread").drop("rows")
    least = F.create_map(*[F.lit(x) for k, (_, low, _, _) in MEASURES.items() for x in (k, low)])
    found = middle.join(spread, ["band", "measure"]).withColumn("spread", F.greatest("spread", least[F.col("measure")]))
    return found.groupBy("band").agg(*[F.max(F.when(F.col("measure") == k, F.col(e))).alias(f"{k}_{e}")
                                       for k in MEASURES for e in ("middle", "spread")])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_bands: int = 10_000) -> DataFrame:
    """Counts, measures, ``base_failed``, ``rejected`` (names of the measures outside their band) and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    measured, _ = materialise(measure(docs, id_col, text_col, lang_col).withColumn("base_failed", failed), "fertility")
    edges, _ = materialise(bands(measured), "bands")
    small = edges.count() <= max_bands

    def side(prefix: str) -> DataFrame:
        named = edges.select(*(F.col(c).alias(f"{prefix}{c}") for c in edges.columns))
        return F.broadcast(named) if small else named  # else as Spark plans it

    wider = F.sqrt(F.greatest(F.lit(1.0), F.lit(FULL_WORDS) / F.greatest("n_words", F.lit(1))))
    outside = []
    for k, (scale, _, below, above) in MEASURES.items():
        middle, spread = (F.when(F.col("l_band").isNotNull(), F.col(f"l_{k}_{e}")).otherwise(F.col(f"s_{k}_{e}")) for e in ("middle", "spread"))
        away = (F.col(k) * scale - middle) / (spread * wider)
        outside.append(F.when((away < -below) | (away > above), F.lit(k)))
    joined = (measured.join(side("l_"), _band("lang") == F.col("l_band"), "left").join(side("s_"), _band("script") == F.col("s_band"), "left"))
    out = joined.withColumn("rejected", F.array_compact(F.array(*outside))).withColumn("band", F.coalesce("l_band", "s_band"))
    return (out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected") == 0))
            .drop(*(p + c for p in ("l_", "s_") for c in edges.columns)).withColumnRenamed("id", id_col))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rules and fertility bands over all documents."""
    out = judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      *MEASURES, F.concat_ws(",", "rejected").alias("rejected"))
