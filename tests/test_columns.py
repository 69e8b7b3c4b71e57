import datetime as dt
import hashlib

from pyspark.sql import functions as F

from upshot.functions import columns as C


def test_cleaning_expressions(spark):
    df = spark.createDataFrame([("12.5", None, "t", 50000.0), ("x", "nan", "F", None),
                                (None, "A", "1", 2e7)], "v string, cat string, flag string, rev double")
    r = df.select(C.to_number("v").alias("n"), C.clean_category("cat").alias("c"),
                  C.to_flag("flag").alias("f"), C.size_bucket("rev").alias("b"),
                  C.size_bucket("rev", null_label=None).alias("b_raw")).collect()
    assert [x.n for x in r] == [12.5, 0.0, 0.0]
    assert [x.c for x in r] == ["Unknown", "Unknown", "A"]
    assert [x.f for x in r] == [True, False, True]
    assert [x.b for x in r] == ["Small", "Unknown", "Enterprise"]
    assert r[1].b_raw == "Enterprise"


def test_lift_stars_annualise_months(spark):
    df = spark.createDataFrame([(120.0, 100.0, 0.0004, 0.01, dt.date(2024, 8, 31))],
                               "t double, c double, p double, r double, d date")
    r = df.select(C.lift_pct("t", "c").alias("l"), C.lift_pct(F.col("t"), F.lit(0.0)).alias("l0"),
                  C.stars("p").alias("s"), C.annualise("r").alias("a"),
                  C.add_months("d", -6).alias("m")).first()
    assert abs(r.l - 20.0) < 1e-12 and r.l0 == 0.0 and r.s == "***"
    assert abs(r.a - (1.01 ** 12 - 1)) < 1e-12
    assert r.m == dt.date(2024, 2, 29)


def test_uniform_matches_md5(spark):
    r = spark.createDataFrame([(7,), (123,)], "k long").select("k", C.uniform(42, "k").alias("u")).collect()
    for row in r:
        h = hashlib.md5(f"42|{row.k}".encode()).hexdigest()
        assert abs(row.u - int(h[:8], 16) / 2 ** 32) < 1e-15
