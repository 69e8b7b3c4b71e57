"""Mapping of the driver's warehouse tables onto the treatment-effect domain.

Account = customer, opportunity = order, opportunity line = lineitem x part,
engagement = a pending order of high priority. Every builder here is a lazy
DataFrame over the parquet scans; the same definitions are written as DuckDB
CTEs in :data:`DOMAIN_SQL` so the oracle queries see identical inputs.

Scale notes: nation/region are fixed-size dimensions (broadcast); customer,
part, orders and lineitem are fact-sized and joined by key so AQE can choose
broadcast only from measured sizes. Line items meet the orders table once and
all line measures of the panel are aggregated in one pass per (account,
month); the engagement-type lookup semi-joins lines to engagement orders
before aggregating.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables

# ---- fixed values of the mapping --------------------------------------------
ENGAGED_STATUS = "P"
DIRECT_PRIORITY = "1-URGENT"
ATTRIBUTED_PRIORITY = "2-HIGH"
CLOSED_STATUSES = ("F", "P")
WON_STATUS = "F"
# functional area = part brand, product name = part type
SECURITY_AREAS = ("Brand#11", "Brand#12", "Brand#13", "Brand#14", "Brand#15")
RESILIENCY_PRODUCTS = ("ECONOMY", "PROMO")
OUTCOMES = ("revenue", "security_revenue", "resiliency_revenue",
            "security_count", "resiliency_count")
# ------------------------------------------------------------------------------


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


class Domain:
    """Lazily built domain frames for one data directory."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base
        self.t = Tables(spark, base)

    # accounts ---------------------------------------------------------------
    def accounts(self) -> DataFrame:
        t = self.t
        c, n, r = t.customer, t.nation, t.region
        bal = F.col("c_acctbal")
        return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
                .join(r, n.n_regionkey == r.r_regionkey, "left")
                .select(F.col("c_custkey").alias("account_id"),
                        F.col("c_name").alias("account_name"),
                        F.col("c_mktsegment").alias("segment"),
                        F.col("n_name").alias("organization"),
                        F.col("r_name").alias("region"),
                        bal.alias("acctbal"),
                        F.when(bal < 0, "Dormant").when(bal < 5000, "Growth")
                        .otherwise("Mature").alias("phase"),
                        F.when(bal >= 7500, "Enterprise").when(bal >= 2500, "Business")
                        .alias("support_level"),
                        ((bal + 1000.0) / 11000.0).alias("adoption_score")))

    # opportunities ------------------------------------------------------------
    def opportunities(self) -> DataFrame:
        o = self.t.orders
        st = F.col("o_orderstatus")
        return o.select(F.col("o_orderkey").alias("opp_id"),
                        F.col("o_custkey").alias("account_id"),
                        F.col("o_orderdate").cast("date").alias("created_date"),
                        F.col("o_orderpriority").alias("stage_name"),
                        F.when(st == WON_STATUS, 1.0).when(st == ENGAGED_STATUS, 0.5)
                        .otherwise(0.1).alias("probability"),
                        st.isin(*CLOSED_STATUSES).alias("is_closed"),
                        (st == WON_STATUS).alias("is_won"),
                        F.col("o_totalprice").alias("opp_arr"))

    def lines(self) -> DataFrame:
        li, p = self.t.lineitem, self.t.part
        return (li.join(p, li.l_partkey == p.p_partkey, "inner")
                .select(F.col("l_orderkey").alias("opp_id"),
                        F.col("l_linenumber").alias("line_no"),
                        F.col("l_partkey").alias("part_id"),
                        F.col("l_suppkey").alias("supp_id"),
                        F.col("p_type").alias("product_name"),
                        F.col("p_brand").alias("functional_area"),
                        F.col("l_extendedprice").alias("line_price"),
                        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("line_arr"),
                        F.col("p_brand").isin(*SECURITY_AREAS).cast("int").alias("is_security"),
                        F.col("p_type").isin(*RESILIENCY_PRODUCTS).cast("int").alias("is_resiliency"),
                        F.col("l_returnflag").alias("return_flag"),
                        F.col("l_quantity").alias("quantity"),
                        F.col("l_discount").alias("discount"),
                        F.col("l_tax").alias("tax"),
                        F.col("l_shipdate").alias("ship_ts")))

    def first_line_type(self, only: DataFrame | None = None) -> DataFrame:
        """Product of the lowest line per opportunity (total order on all line
        attributes, since line numbers repeat within an order). ``only``
        restricts the lines to the given ``opp_id`` set first (semi join)."""
        ln = self.lines()
        if only is not None:
            ln = ln.join(only, "opp_id", "left_semi")
        key = F.struct("line_no", "part_id", "supp_id", "line_price", "discount",
                       "quantity", "tax", "ship_ts")
        return ln.groupBy("opp_id").agg(F.min_by("product_name", key).alias("engagement_type"))

    # engagements ----------------------------------------------------------------
    def engagements(self) -> DataFrame:
        o = self.t.orders
        pr = F.col("o_orderpriority")
        e = (o.where((F.col("o_orderstatus") == ENGAGED_STATUS)
                     & pr.isin(DIRECT_PRIORITY, ATTRIBUTED_PRIORITY))
             .select(F.col("o_orderkey").alias("engagement_id"),
                     F.col("o_custkey").alias("account_id"),
                     F.col("o_orderdate").cast("date").alias("engagement_date"),
                     (pr == DIRECT_PRIORITY).cast("int").alias("is_direct"),
                     (pr == ATTRIBUTED_PRIORITY).cast("int").alias("is_attributed")))
        ft = (self.first_line_type(e.select(F.col("engagement_id").alias("opp_id")))
              .withColumnRenamed("opp_id", "engagement_id"))
        return e.join(ft, "engagement_id", "left")

    def first_direct(self) -> DataFrame:
        """Per account: date and type of the first direct engagement."""
        e = self.engagements().where(F.col("is_direct") == 1)
        k = F.struct("engagement_date", "engagement_id")
        return (e.groupBy("account_id")
                .agg(F.min("engagement_date").alias("event_date"),
                     F.min_by("engagement_type", k).alias("event_type")))

    # customer x month panel -----------------------------------------------------
    def panel(self) -> DataFrame:
        o = self.t.orders.select(
            F.col("o_orderkey").alias("opp_id"), F.col("o_custkey").alias("account_id"),
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"),
            F.col("o_totalprice").alias("price"))
        rev = o.groupBy("account_id", "period").agg(F.sum("price").alias("revenue"))
        # only lines of a family count; a part belongs to its families as a whole, so
        # distinct parts are rows of the first aggregation
        ln = (self.lines().where((F.col("is_security") == 1) | (F.col("is_resiliency") == 1))
              .select("opp_id", "part_id", "line_arr", "is_security", "is_resiliency"))
        parts = (ln.join(o.select("opp_id", "account_id", "period"), "opp_id")
                 .groupBy("account_id", "period", "part_id", "is_security", "is_resiliency")
                 .agg(F.sum("line_arr").alias("arr")))
        fam = parts.groupBy("account_id", "period").agg(
            F.sum(F.when(F.col("is_security") == 1, F.col("arr")).otherwise(0.0)).alias("security_revenue"),
            F.sum(F.when(F.col("is_resiliency") == 1, F.col("arr")).otherwise(0.0)).alias("resiliency_revenue"),
            F.sum("is_security").alias("security_count"),
            F.sum("is_resiliency").alias("resiliency_count"))
        p = (rev.join(fam, ["account_id", "period"], "left")
             .join(self.first_direct(), "account_id", "left")
             .join(self.accounts().select("account_id", "segment", "organization", "region",
                                          "phase", "support_level", "adoption_score"),
                   "account_id", "inner"))
        return p.select(
            "account_id", "period", "event_date", "event_type",
            F.col("event_date").isNotNull().cast("int").alias("treated"),
            "revenue",
            F.coalesce("security_revenue", F.lit(0.0)).alias("security_revenue"),
            F.coalesce("resiliency_revenue", F.lit(0.0)).alias("resiliency_revenue"),
            F.coalesce("security_count", F.lit(0)).cast("long").alias("security_count"),
            F.coalesce("resiliency_count", F.lit(0)).cast("long").alias("resiliency_count"),
            "segment", "organization", "region", "phase", "support_level", "adoption_score")

    # cohort inputs (template tables) ------------------------------------------------
    def engagement_details(self) -> DataFrame:
        """One row per (account, direct engagement); accounts without one get a
        row with a null engagement id and the eligibility flags."""
        acc = self.t.customer.select(F.col("c_custkey").alias("account_id"),
                                     (F.col("c_acctbal") > 0).alias("qualified_account_flag"))
        o = self.t.orders
        flags = o.groupBy(F.col("o_custkey").alias("account_id")).agg(
            F.max((F.col("o_orderstatus") == WON_STATUS).cast("int")).cast("boolean").alias("has_revenue_flag"),
            F.max((F.col("o_orderstatus") == "O").cast("int")).cast("boolean").alias("created_opportunities_flag"))
        d = (self.engagements().where(F.col("is_direct") == 1)
             .select("account_id", "engagement_id"))
        base = acc.join(flags, "account_id", "left")
        with_e = base.join(d, "account_id", "left")
        return with_e.select("account_id", "engagement_id", "qualified_account_flag",
                             F.coalesce("has_revenue_flag", F.lit(False)).alias("has_revenue_flag"),
                             F.coalesce("created_opportunities_flag", F.lit(False)).alias("created_opportunities_flag"))

    def team_members(self) -> DataFrame:
        """Opportunity team: suppliers on the order's lines; returned lines are
        deleted memberships."""
        li = self.t.lineitem
        return li.select(F.col("l_orderkey").alias("opp_id"), F.col("l_suppkey").alias("user_id"),
                         F.when(F.col("l_returnflag") == "R", "Y").otherwise("N").alias("delete_flag"))

    def users(self) -> DataFrame:
        s = self.t.supplier
        return s.select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("alias"))

    def roster(self) -> DataFrame:
        s = self.t.supplier
        return s.where(F.col("s_acctbal") > 0).select(F.col("s_name").alias("alias"))


# ---- the same definitions as DuckDB CTEs (oracle side) ----------------------------
DOMAIN_SQL = f"""
accounts AS (
  SELECT c.c_custkey AS account_id, c.c_name AS account_name, c.c_mktsegment AS segment,
         n.n_name AS organization, r.r_name AS region, c.c_acctbal AS acctbal,
         CASE WHEN c.c_acctbal < 0 THEN 'Dormant' WHEN c.c_acctbal < 5000 THEN 'Growth' ELSE 'Mature' END AS phase,
         CASE WHEN c.c_acctbal >= 7500 THEN 'Enterprise' WHEN c.c_acctbal >= 2500 THEN 'Business' END AS support_level,
         (c.c_acctbal + 1000.0) / 11000.0 AS adoption_score
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
                  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
opps AS (
  SELECT o_orderkey AS opp_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS created_date,
         o_orderpriority AS stage_name,
         CASE WHEN o_orderstatus = '{WON_STATUS}' THEN 1.0 WHEN o_orderstatus = '{ENGAGED_STATUS}' THEN 0.5 ELSE 0.1 END AS probability,
         o_orderstatus IN ({_sql_list(CLOSED_STATUSES)}) AS is_closed,
         o_orderstatus = '{WON_STATUS}' AS is_won, o_totalprice AS opp_arr
  FROM orders),
lines AS (
  SELECT l_orderkey AS opp_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id,
         p_type AS product_name, p_brand AS functional_area, l_extendedprice AS line_price,
         l_extendedprice * (1 - l_discount) AS line_arr,
         CAST(p_brand IN ({_sql_list(SECURITY_AREAS)}) AS INTEGER) AS is_security,
         CAST(p_type IN ({_sql_list(RESILIENCY_PRODUCTS)}) AS INTEGER) AS is_resiliency,
         l_returnflag AS return_flag, l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
         l_shipdate AS ship_ts
  FROM lineitem JOIN part ON l_partkey = p_partkey),
first_line AS (
  SELECT opp_id, product_name AS engagement_type FROM (
    SELECT opp_id, product_name, row_number() OVER (PARTITION BY opp_id
           ORDER BY line_no, part_id, supp_id, line_price, discount, quantity, tax, ship_ts) AS rn
    FROM lines) WHERE rn = 1),
engagements AS (
  SELECT o_orderkey AS engagement_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS engagement_date,
         CAST(o_orderpriority = '{DIRECT_PRIORITY}' AS INTEGER) AS is_direct,
         CAST(o_orderpriority = '{ATTRIBUTED_PRIORITY}' AS INTEGER) AS is_attributed,
         fl.engagement_type
  FROM orders LEFT JOIN first_line fl ON fl.opp_id = o_orderkey
  WHERE o_orderstatus = '{ENGAGED_STATUS}' AND o_orderpriority IN ('{DIRECT_PRIORITY}', '{ATTRIBUTED_PRIORITY}')),
first_direct AS (
  SELECT account_id, engagement_date AS event_date, engagement_type AS event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY engagement_date, engagement_id) AS rn
    FROM engagements WHERE is_direct = 1) WHERE rn = 1),
order_month AS (
  SELECT o_orderkey AS opp_id, o_custkey AS account_id,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_totalprice AS price FROM orders),
panel_rev AS (SELECT account_id, period, sum(price) AS revenue FROM order_month GROUP BY account_id, period),
panel_fam AS (
  SELECT om.account_id, om.period,
         sum(CASE WHEN is_security = 1 THEN line_arr ELSE 0.0 END) AS security_revenue,
         sum(CASE WHEN is_resiliency = 1 THEN line_arr ELSE 0.0 END) AS resiliency_revenue,
         count(DISTINCT CASE WHEN is_security = 1 THEN part_id END) AS security_count,
         count(DISTINCT CASE WHEN is_resiliency = 1 THEN part_id END) AS resiliency_count
  FROM lines l JOIN order_month om ON l.opp_id = om.opp_id GROUP BY om.account_id, om.period),
panel AS (
  SELECT pr.account_id, pr.period, fd.event_date, fd.event_type,
         CAST(fd.event_date IS NOT NULL AS INTEGER) AS treated, pr.revenue,
         coalesce(pf.security_revenue, 0.0) AS security_revenue,
         coalesce(pf.resiliency_revenue, 0.0) AS resiliency_revenue,
         CAST(coalesce(pf.security_count, 0) AS BIGINT) AS security_count,
         CAST(coalesce(pf.resiliency_count, 0) AS BIGINT) AS resiliency_count,
         a.segment, a.organization, a.region, a.phase, a.support_level, a.adoption_score
  FROM panel_rev pr LEFT JOIN panel_fam pf ON pr.account_id = pf.account_id AND pr.period = pf.period
       LEFT JOIN first_direct fd ON pr.account_id = fd.account_id
       JOIN accounts a ON pr.account_id = a.account_id),
engagement_details AS (
  SELECT c.c_custkey AS account_id, e.engagement_id, c.c_acctbal > 0 AS qualified_account_flag,
         coalesce(f.has_revenue_flag, false) AS has_revenue_flag,
         coalesce(f.created_opportunities_flag, false) AS created_opportunities_flag
  FROM customer c
  LEFT JOIN (SELECT o_custkey AS account_id, bool_or(o_orderstatus = '{WON_STATUS}') AS has_revenue_flag,
                    bool_or(o_orderstatus = 'O') AS created_opportunities_flag
             FROM orders GROUP BY o_custkey) f ON f.account_id = c.c_custkey
  LEFT JOIN (SELECT account_id, engagement_id FROM engagements WHERE is_direct = 1) e
       ON e.account_id = c.c_custkey),
team_members AS (
  SELECT l_orderkey AS opp_id, l_suppkey AS user_id,
         CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS delete_flag FROM lineitem),
users AS (SELECT s_suppkey AS user_id, s_name AS alias FROM supplier),
roster AS (SELECT s_name AS alias FROM supplier WHERE s_acctbal > 0)
"""


def with_domain(body_ctes: str, final_select: str) -> str:
    """Compose an oracle query: domain CTEs + query CTEs + final SELECT."""
    extra = f",\n{body_ctes}" if body_ctes.strip() else ""
    return f"WITH {DOMAIN_SQL.strip()}{extra}\n{final_select}"
