import datetime as dt

from upshot.operators import cohort as C

DAY = dt.date(2024, 1, 1)
FLAGS = ("f", "g")


def _tables(spark):
    accounts = spark.createDataFrame([(i, f"n{i}", "s", "p", "sup" if i % 2 else None, "r", "o") for i in (1, 2, 3, 4, 4, 5)],
                                     "account_id long, account_name string, segment string, phase string, support_level string, region string, organization string")
    # 2 has both kinds of rows, 3 lacks a flag, 4 is a control that comes twice, 9 has no account
    details = spark.createDataFrame([(1, 10, True, True), (2, None, True, True), (2, 20, True, True), (3, None, True, None), (4, None, True, True),
                                     (5, None, True, True), (9, 90, True, True), (None, None, True, True)], "account_id long, engagement_id long, f boolean, g boolean")
    engagements = spark.createDataFrame([(10, 1, DAY, 1, 0, "t"), (11, 1, DAY, 0, 1, "t"), (20, 2, DAY, 1, 0, "u"), (50, 5, DAY, 1, 0, "u"), (90, 9, DAY, 1, 0, None)],
                                        "engagement_id long, account_id long, engagement_date date, is_direct int, is_attributed int, engagement_type string")
    opps = spark.createDataFrame([(100 + a, a, DAY, "s", 0.5, True, False, 1000.0) for a in (1, 2, 3, 4, 9)],
                                 "opp_id long, account_id long, created_date date, stage_name string, probability double, is_closed boolean, is_won boolean, opp_arr double")
    lines = spark.createDataFrame([(100 + a, k, "A", "P", 10.0, 0.1, k % 2, 0) for a in (1, 2, 3, 4, 9) for k in (1, 2)],
                                  "opp_id long, line_no int, functional_area string, product_name string, line_price double, discount double, is_security int, is_resiliency int")
    revenue = spark.createDataFrame([(1, 5.0), (4, 2e6)], "account_id long, account_revenue double")
    return accounts, engagements, details, opps, lines, revenue


def test_analysis_rows_of_both_groups(spark):
    got = C.analysis_table(*_tables(spark), FLAGS).select("group_type", "account_id", "activity_id", "opp_id", "line_no", "revenue_bucket", "account_name").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, [
        ("Treatment", 1, 10, 101, 1, "Small", "n1"), ("Treatment", 1, 11, 101, 1, "Small", "n1"), ("Treatment", 2, 20, 102, 1, "Unknown", "n2"),
        ("Treatment", 9, 90, 109, 1, None, None),   # an engaged account without attributes
        ("Control", 4, None, 104, 1, "Large", "n4"), ("Control", 4, None, 104, 1, "Large", "n4"), ("Control", 5, None, None, None, "Unknown", "n5")]))


def test_a_task_of_the_analysis_sorts_few_tables(spark):
    """The cohorts' own joins and groups are not repeated behind each use of a cohort."""
    plan = C.analysis_table(*_tables(spark), FLAGS)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) <= 10
    assert sum("Aggregate" in line for line in plan.splitlines()) == 0
