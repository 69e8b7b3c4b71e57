import datetime as dt

import numpy as np

from upshot.operators import match as M
from upshot.plans import domain, match_queries

PANEL = ("account_id long, period date, event_date date, event_type string, treated int, revenue double, security_revenue double, "
         "resiliency_revenue double, security_count long, resiliency_count long, segment string, organization string, region string, "
         "phase string, support_level string, adoption_score double")


def _panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        for m in (1, 2):
            a, b, c = (float(x) for x in rng.integers(1, 100, 3))
            rows.append((i, dt.date(2024, m, 1), None, None, i % 2, a if i else 5000.0, b, c, int(b) % 5, int(c) % 3, "s%d" % (i % 8 // 4), "o%d" % (i % 5), "r%d" % (i % 3), "p%d" % (i % 4 // 2),
                         (None, "b")[i % 7 // 4], i / 60))
    return spark.createDataFrame(rows, PANEL)


def test_factors_of_the_grid_share_one_panel(spark, monkeypatch):
    panel, built = _panel(spark), []

    def build(self):
        built.append(self.base)
        return panel

    monkeypatch.setattr(domain.Domain, "panel", build)
    monkeypatch.setattr(match_queries, "CALIPERS", (0.1,))
    monkeypatch.setattr(match_queries, "FACTORS", (2.0, 1000.0))
    got = {r.outlier_factor: r for r in match_queries.q_sensitivity(spark, "/none").collect()}
    assert built == ["/none"]
    assert set(got) == {"2.0", "1000.0"}
    assert got["2.0"].effect_size_pct != got["1000.0"].effect_size_pct  # the outlier is trimmed in one alone


def test_first_rows_are_kept_without_other_columns(spark, monkeypatch):
    from pyspark.sql import functions as F

    from upshot.plans import opportunity_queries as Q
    rows = [(i % 5, 1, "Treatment", 9 - i, 1, "f", "p", 1.0, 1.0, "a name that nobody asks for") for i in range(10)] + [(None, 1, "Control", None, None, None, None, None, None, "x")]
    t = spark.createDataFrame(rows, "opp_id long, account_id long, group_type string, activity_id long, line_no int, functional_area string, "
                                    "product_name string, total_price double, service_arr double, account_name string")
    monkeypatch.setattr(Q, "analysis", lambda spark, d: t.repartition(2).withColumn("account_name", F.upper("account_name")))
    out = Q.q_first_row(spark, "/none")
    assert {(r.opp_id, r.activity_id) for r in out.collect()} == {(i, 4 - i) for i in range(5)}
    assert "upper(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_fit_makes_few_tasks_a_pass(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    seen = []
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or _Same())
    df = spark.range(60_000).selectExpr("id", "cast(id % 2 as int) as treated", "cast(id % 7 as double) as x")
    out = M.cross_fitted_scores(df, "id", "treated", ["x"], folds=2)
    assert out.count() == 60_000
    assert seen == [1, 1]


class _Same:
    def transform(self, df):
        from pyspark.ml.functions import array_to_vector
        from pyspark.sql import functions as F
        return df.withColumn("probability", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))))
