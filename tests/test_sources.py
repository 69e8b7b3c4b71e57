import os
import tempfile

from pyspark.sql import functions as F

from upshot.operators.cohort import keep_first
from upshot.sources import read_csv, read_source, write_result


def test_csv_scan_bad_dates_become_null(spark):
    d = tempfile.mkdtemp()
    path = os.path.join(d, "panel.csv")
    with open(path, "w") as f:
        f.write("unit,ar_date,rev\nA,2024-01-01,10.5\nB,not a date,x\nC,2024-02-30,3\n")
    df = read_csv(spark, path, "unit string, ar_date string, rev string", date_cols=["ar_date"])
    rows = {r.unit: r for r in df.collect()}
    assert str(rows["A"].ar_date) == "2024-01-01" and rows["B"].ar_date is None and rows["C"].ar_date is None


def test_sink_round_trip(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([(1, "T", 2.0), (2, "C", 3.0)], "id long, g string, v double")
    write_result(df, os.path.join(d, "out"), partition_by=["g"])
    back = read_source(spark, "parquet", os.path.join(d, "out"))
    assert sorted((r.id, r.g) for r in back.collect()) == [(1, "T"), (2, "C")]
    write_result(df, os.path.join(d, "csv"), fmt="csv", single_file=True)
    assert read_source(spark, "csv", os.path.join(d, "csv"), header=True).count() == 2


def test_keep_first_total_order_nulls_first(spark):
    df = spark.createDataFrame([(1, None, 5, "a"), (1, 3, 1, "b"), (2, 7, 2, "c"), (2, 7, 1, "d")],
                               "k long, a long, b long, tag string")
    got = {r.k: r.tag for r in keep_first(df, ["k"], ["a", "b"]).collect()}
    assert got == {1: "a", 2: "d"}
    assert keep_first(df, ["k"], ["a", "b"]).where(F.col("k") == 1).first().a is None


def test_report_bundle(spark):
    from upshot.plans.report import write_bundle
    if not os.path.exists("/root/testdata/sf0.001"):
        return
    from upshot.plans.report import BUNDLE
    out = write_bundle(spark, "/root/testdata/sf0.001", tempfile.mkdtemp())
    assert set(out) == set(BUNDLE)
    for table, path in out.items():
        df = spark.read.parquet(path)
        assert df.columns and (df.count() > 0 or table == "cluster")


def test_bucketed_table_is_replaced_and_read_without_a_shuffle(spark, tmp_path):
    from upshot.sources.files import replace_table
    rows = spark.createDataFrame([(i % 50, float(i)) for i in range(2000)], "account_id long, v double")
    other = spark.createDataFrame([(i, f"n{i}") for i in range(50)], "account_id long, name string")
    replace_table(rows, "ups_rows", "account_id", 8, str(tmp_path))
    replace_table(other, "ups_names", "account_id", 8, str(tmp_path))
    per = spark.table("ups_rows").groupBy("account_id").agg(F.sum("v").alias("s"))
    joined = per.join(spark.table("ups_names").hint("merge"), "account_id")
    for df in (per, joined):
        assert "Exchange" not in df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert joined.agg(F.sum("s")).first()[0] == sum(range(2000))
    replace_table(rows.where("v < 100"), "ups_rows", "account_id", 8, str(tmp_path))
    assert spark.table("ups_rows").count() == 100
    versions = [t.name for t in spark.catalog.listTables() if t.name.startswith("ups_rows_v")]
    assert len(versions) == 1
    for t in ("ups_rows", "ups_names"):
        spark.sql(f"DROP VIEW {t}")
    for t in spark.catalog.listTables():
        if t.name.startswith(("ups_rows_v", "ups_names_v")):
            spark.sql(f"DROP TABLE {t.name}")


def test_staging_views(spark):
    from upshot.sources.tables import register_views
    if not os.path.exists("/root/testdata/sf0.001"):
        return
    register_views(spark, "/root/testdata/sf0.001", ("nation",), prefix="stg_")
    assert spark.sql("SELECT count(*) FROM stg_nation").first()[0] == 25


PANEL_ROWS = [("C1", "2024-01-31", "2024-02-10", "Review", "100", "20", "", "2", "x", "Small", "", "Retail", "Basic", "0.5", "East"),
              ("C1", "2024-02-30", "", "", "n/a", "1e3", "7", "3", "4", "Small", "Old", "Retail", "", "", "East"),
              ("C2", "", "bad", "", "55.5", "0", "0", "0", "0", "", "", "", "", "text", "")]


def _csv(path, names, rows):
    path.write_text("\n".join([",".join(names), *(",".join(r) for r in rows)]) + "\n")
    return str(path)


def test_panel_extract(spark, tmp_path):
    from upshot.sources.layouts import PANEL, read_panel
    df = read_panel(spark, _csv(tmp_path / "panel.csv", PANEL, PANEL_ROWS))
    rows = [r.asDict() for r in df.collect()]
    assert df.columns == [n for n, _ in PANEL.values()] + ["treated"]
    assert [str(r["period"]) for r in rows] == ["2024-01-31", "None", "None"] and [r["treated"] for r in rows] == [1, 0, 0]
    assert [r["revenue"] for r in rows] == [100.0, 0.0, 55.5] and [r["security_revenue"] for r in rows] == [20.0, 1000.0, 0.0]
    assert [r["resiliency_count"] for r in rows] == [0.0, 4.0, 0.0] and rows[0]["phase"] is None and rows[2]["adoption_score"] == 0.0


def test_pipeline_extract(spark, tmp_path):
    from upshot.sources.layouts import PIPELINE, read_pipeline
    base = {c: "" for c in PIPELINE}
    rows = [base | {"accountid": "A", "group_type": "Treatment", "isclosed": "t", "iswon": "f", "opp_total_arr": "1500.505", "is_security": "1", "opp_created_date": "2024-01-15"},
            base | {"accountid": "B", "group_type": "Control", "isclosed": "F", "iswon": "1", "opp_total_arr": "none", "is_security": "y"}]
    got = [r.asDict() for r in read_pipeline(spark, _csv(tmp_path / "pipe.csv", PIPELINE, [list(r.values()) for r in rows])).collect()]
    assert [r["is_closed"] for r in got] == [True, False] and [r["is_won"] for r in got] == [False, True]
    assert str(got[0]["opp_arr"]) in ("1500.50", "1500.51") and got[1]["opp_arr"] is None and [r["is_security"] for r in got] == [1, 0]
    assert str(got[0]["created_date"]) == "2024-01-15" and got[1]["created_date"] is None
