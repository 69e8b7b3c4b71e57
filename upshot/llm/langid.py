"""Language identification with string kernels.

Two texts are compared by the blended spectrum presence kernel: the number of
character n-grams, n from 1 to ``MAX_N``, that both have, divided by the geometric
mean of how many each has. N-grams of the lower-cased text are hashed to
``2**BITS`` places.

Model: landmarks ``K_mm``, Nyström features ``K_nm K_mm^(-1/2)`` and a constant,
and one-versus-rest kernel ridge regression. The kernel with a landmark is an
inner product of presence vectors, so scores of a batch of texts are a product of
their presence matrix and one matrix of weights (landmarks times dual
coefficients), divided by the texts' norms.

Fitting uses a bounded sample of labelled rows, the documented limit
``TRAIN_ROWS`` over all languages, spread evenly, picked by a hash of the id; the
driver gets their presence bits only, ``2**BITS / 8`` bytes each, 16 MB at most.
Every row is predicted from its whole text, in slices of bounded size.

Defined cases: a null text, one without a letter, and any text if nothing was
learned are ``und`` with score 0; a single learned language is always predicted;
ties go to the first language in alphabetical order; repeated rows are predicted
alike; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BINARY, DOUBLE, LONG, STRING, documents, lean, release, schema, ship_package

MAX_N = 3
BITS = 16
TRAIN_ROWS = 2048
LANDMARKS = 256
RIDGE = 1e-2
SLICE = 1 << 16
BATCH = 64
ROWS = 512  # texts held as Python strings

_STEP = np.uint32(0x9E3779B1)


def has_letter(text: str) -> bool:
    """Whether a text has a character of the categories L."""
    return any(map(str.isalpha, text))


def places(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, slice by slice."""
    for at in range(0, len(text), SLICE):
        code = np.frombuffer(text[at:at + SLICE + MAX_N - 1].lower().encode("utf-32-le", "replace"), dtype="<u4")
        h = np.zeros(len(code), dtype=np.uint32)
        for n in range(1, MAX_N + 1):
            if len(code) < n:
                break
            h = (h[:len(code) - n + 1] * np.uint32(0x85EBCA6B)) ^ (code[n - 1:] + np.uint32(n))
            h *= _STEP
            yield ((h ^ (h >> np.uint32(15))) * _STEP) >> np.uint32(32 - BITS)


def presence(texts: list[str]) -> np.ndarray:
    """Presence matrix, a row of zeros and ones per text."""
    out = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        for at in places(text):
            row[at] = 1
    return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # place x language
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.langs and t and has_letter(t)]
        for at in range(0, len(known), BATCH):
            rows = known[at:at + BATCH]
            p = presence([texts[i] for i in rows])
            margin = (p @ self.weights) / np.sqrt(np.maximum(p.sum(axis=1), 1))[:, None] + self.bias
            best = margin.argmax(axis=1)
            for i, k, m in zip(rows, best, margin[np.arange(len(rows)), best], strict=True):
                langs[i], scores[i] = self.langs[k], float(min(max((m + 1) / 2, 0), 1))
        return langs, scores


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``bits``: packed presence rows. Landmarks are taken from the languages in turn."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))

    def unpacked(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(rows, axis=1).astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]  # in place: the driver holds few copies
        return x

    y = np.array([langs.index(v) for v in labels])
    turn = np.empty(len(y), dtype=np.int64)
    for k in range(len(langs)):
        turn[y == k] = np.arange((y == k).sum())
    marks = np.lexsort((y, turn))[:landmarks]
    m = np.empty((len(marks), 1 << BITS), np.float32)
    for at in range(0, len(m), BATCH):
        m[at:at + BATCH] = unpacked(bits[marks[at:at + BATCH]])
    k_nm = np.vstack([unpacked(bits[at:at + BATCH]) @ m.T for at in range(0, len(bits), BATCH)]).astype(float)
    value, vector = np.linalg.eigh(k_nm[marks])
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # K_mm^(-1/2) on its range
    z = np.hstack([k_nm @ root, np.ones((len(y), 1))])
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    share = 1 / np.bincount(y, minlength=len(langs))[y]  # languages weigh alike
    share = (share / share.mean())[:, None]
    penalty = ridge * len(y) * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9 * len(y)
    w = np.linalg.solve(z.T @ (share * z) + penalty, z.T @ (share * target))
    return Model(langs, (m.T @ (root @ w[:-1]).astype(np.float32)), w[-1])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` rows with a language and a letter in the text."""
    ship_package(labelled.sparkSession)
    given = labelled.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                            F.col(f"`{text_col}`").cast("string").alias("text")).where(
        "lang is not null and lang <> 'und' and text is not null").where(F.col("text").rlike(r"\p{L}"))
    keyed = given.select("lang", F.xxhash64(F.coalesce("id", F.lit(""))).alias("h"), F.xxhash64("text").alias("t"))
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()  # at most ``rows`` languages
    if not sizes:
        return fit(np.zeros((0, (1 << BITS) // 8), np.uint8), [])
    each = max(1, rows // len(sizes))
    # hashes are uniform: the lowest ``each`` of a language lie below four times their share of the range, so few rows are ranked
    share = [4.0 * (each + 16) / max(r["n"], 1) for r in sizes]
    bound = labelled.sparkSession.createDataFrame(
        [(r["lang"], int(x * 2.0**64) - 2**63 if x < 0.999 else 2**63 - 1) for r, x in zip(sizes, share, strict=True)], "_lang string, bound long")
    keyed = keyed.join(F.broadcast(bound), F.col("lang") == F.col("_lang")).where("h <= bound").drop("_lang", "bound")
    order = Window.partitionBy("lang").orderBy("h", "t")
    chosen = keyed.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).limit(rows).select("lang", "h", "t")
    picked = given.withColumn("h", F.xxhash64(F.coalesce("id", F.lit("")))).withColumn("t", F.xxhash64("text")).join(
        F.broadcast(chosen), ["lang", "h", "t"], "left_semi")  # at most ``rows`` rows

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                packed = np.packbits(presence(part.column("text").to_pylist()).astype(np.uint8), axis=1)
                yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "h": part.column("h"), "t": part.column("t"),
                                                  "bits": pa.array([r.tobytes() for r in packed], pa.binary())})

    got = (picked.select("lang", "h", "t", "text").mapInArrow(lean(bits), schema(lang=STRING, h=LONG, t=LONG, bits=BINARY))
           .dropDuplicates(["lang", "h", "t"]).orderBy("lang", "h", "t").limit(rows).collect())
    langs = [r["lang"] for r in got]
    packed = np.empty((len(got), (1 << BITS) // 8), np.uint8)
    for at in range(len(got)):
        packed[at], got[at] = np.frombuffer(got[at]["bits"], np.uint8), None  # a row goes as its bits are copied
    try:
        return fit(packed, langs)
    finally:
        release()


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in the struct ``row``, with ``lang_pred`` and ``score``."""
    ship_package(docs.sparkSession)
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = T.StructType([given.schema["row"], T.StructField("lang_pred", STRING), T.StructField("score", DOUBLE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                langs, scores = model.predict(pc.struct_field(b.column("row"), text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], out.names)

    return given.mapInArrow(lean(run), out)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; the model learns from rows not held out."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    out = classify(docs.select("doc_id", "text"), model)
    return out.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
