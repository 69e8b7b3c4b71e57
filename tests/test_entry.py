import duckdb
import pytest

import __spark_entry__ as entry_mod
from upshot.plans import load_all

SMOKE = "/root/testdata/sf0.001"
QUICK = ["s3_engagement_panel", "e1_two_sample_ttest", "c5_analysis_table", "e8_organization_lift",
         "g2_treated_growth", "e13_did"]


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() == 5 and "t_stat" in df.columns


def test_every_query_has_declared_scales():
    reg = load_all()
    assert len(reg) >= 60
    for name, q in reg.items():
        assert not name.startswith("op") and q.doc


@pytest.mark.parametrize("name", QUICK)
def test_quick_queries_match_oracle(spark, name):
    import os
    if not os.path.exists(SMOKE):
        pytest.skip("no smoke data")
    q = load_all()[name]
    rows = sorted(tuple(str(v) for v in r) for r in q.build(spark, SMOKE).collect())
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    res = con.execute(q.sql)
    cols = [c[0] for c in res.description]
    sdf_cols = q.build(spark, SMOKE).columns
    assert sorted(cols) == sorted(sdf_cols)
    order = [cols.index(c) for c in sdf_cols]
    drows = sorted(tuple(str(r[i]) for i in order) for r in res.fetchall())
    assert rows == drows
