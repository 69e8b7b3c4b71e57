"""The registered queries against their oracle SQL, and the pipeline against brute force, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from upshot.llm import decontaminate, packing
from upshot.llm.common import documents, materialise
from upshot.llm.queries import QUERIES

from . import test_jaccard_join, test_packing, test_substring_dedup

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q[1]])
def test_oracle(spark, name):
    build, sql = QUERIES[name]
    df = build(spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(map(tuple, res.fetchall()))


def test_pipeline_by_stage(spark):
    docs = documents(spark, DATA)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs, _ = materialise(stage(spark, docs, DATA), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            assert after == {i: t for i, t in before if t and any(c.isalpha() for c in t)}
        elif name == "ngram_jaccard_join":
            assert after == {i: t for (i, t), v in test_jaccard_join.brute(before).items() if v[0] == i}
        elif name == "substring_dedup":
            want = {r[0]: r for r in test_substring_dedup.brute(before)}
            assert set(after) == {i for i, n, gone, _ in want.values() if not gone or gone < n}
            for i, t in before:
                if i in after:
                    n, gone = want[i][1:3]
                    assert after[i] == t if not gone else len(after[i].split()) == n - gone
        elif name == "benchmark_decontamination":
            con = duckdb.connect()
            con.register("documents", pd.DataFrame(before, columns=["doc_id", "text"]))
            con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{DATA}/benchmark.parquet')")
            gone = {r[0] for r in con.execute(f"SELECT doc_id FROM ({decontaminate.SQL})").fetchall()}
            assert gone and after == {i: t for i, t in before if i not in gone}
        else:
            test_packing.check(docs.collect(), before)


def test_run_and_stages_on_edge_rows(spark, tricky, no_rows):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_rows, DATA).count() == 0
        out = stage(spark, tricky, DATA)
        assert out.count() <= tricky.count() + 40
        assert stage is corpus_pipeline.pack or out.columns == tricky.columns
    assert packing.CAPACITY == 2048
