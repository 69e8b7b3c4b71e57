import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from upshot.llm import langid as L

from .conftest import tricky_rows

DATA = "/root/testdata/sf0.01"


def test_kernel_is_the_share_of_common_grams():
    p = L.presence(["abc", "abd", "ABC"])
    assert p[0].sum() == 6 and (p[0] * p[1]).sum() == 3 and (p[0] == p[2]).all()
    long = "xyz" * L.SLICE
    assert (L.presence([long])[0] == L.presence(["xyzxyz"])[0]).all()


def test_nystrom_with_all_rows_is_kernel_ridge():
    texts = ["the cat sat", "a dog ran", "der hund lief", "die katze sass", "the dog sat", "der kater"]
    labels = ["en", "en", "de", "de", "en", "de"]
    bits = np.packbits(L.presence(texts).astype(np.uint8), axis=1)
    model = L.fit(bits, labels, landmarks=len(texts))
    assert model.predict(texts)[0] == labels
    x = L.presence(texts)
    x /= np.sqrt(x.sum(axis=1))[:, None]
    k = (x @ x.T).astype(float)
    y = np.where(np.array(labels)[:, None] == np.array(model.langs), 1.0, -1.0)
    n = len(texts)  # dual solution with a free constant
    m = np.block([[k + L.RIDGE * n * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    dual = np.linalg.solve(m, np.vstack([y, np.zeros((1, 2))]))
    assert np.allclose(k @ dual[:n] + dual[n], x @ model.weights + model.bias, atol=1e-3)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    rows = L.op4(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_rows(spark, tricky, no_rows):
    model = L.train(tricky, rows=12)
    assert model.langs == ["de", "en", "fr"]
    rows = L.classify(tricky, model).collect()
    assert len(rows) == len(tricky_rows()) and rows[0]["row"].asDict().keys() == set(tricky.columns)
    for r in rows:
        text = r["row"]["text"]
        und = not text or not any(c.isalpha() for c in text)
        assert (r["lang_pred"] == "und") == und and (r["score"] == 0.0 or not und)
    again = {r["row"]["id"]: (r["lang_pred"], r["score"]) for r in L.classify(tricky.repartition(1), L.train(tricky.repartition(2), rows=12)).collect()}
    assert again == {r["row"]["id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert L.classify(no_rows, model).count() == 0
    none = L.train(tricky.withColumn("lang", F.lit(None).cast("string")))
    assert none.langs == [] and {r["lang_pred"] for r in L.classify(tricky, none).collect()} == {"und"}


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "word %d" % i, "l%d" % (i % 7)) for i in range(200)], "doc_id long, text string, lang string")
    assert len(L.train(docs, rows=21).langs) == 7 and len(L.train(docs, rows=5).langs) <= 5


def test_fit_holds_the_landmarks_once():
    import tracemalloc
    rng = np.random.default_rng(5)
    bits = np.packbits(rng.random((L.LANDMARKS, 1 << L.BITS)) < 0.02, axis=1)
    tracemalloc.start()
    L.fit(bits, ["l%d" % (i % 3) for i in range(len(bits))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.9 * 4 * (L.LANDMARKS << L.BITS)


def test_letters():
    assert not any(map(L.has_letter, ["½", "²", "Ⅷ", "12 !?", "_", "☃", "", "१"]))
    assert all(map(L.has_letter, ["1a", "漢", "ª", "ʰ", "½ é"]))
