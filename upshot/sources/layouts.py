"""The two CSV extracts analysts keep: a customer x month panel and pipeline line items (S-1).

Column names and types are declared, flags are parsed once, and the columns get the names the
operators use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import money, to_flag, to_number
from .files import read_csv

# Column of the extract -> (name in the library, kind), in the extract's order.
PANEL = {
    "sfdc_customer_id": ("account_id", "string"), "ar_date": ("period", "date"), "firstactivitydate": ("event_date", "date"),
    "first_engagement_type": ("event_type", "string"), "ttl_sls_rev": ("revenue", "number"), "ttl_security_rev": ("security_revenue", "number"),
    "ttl_resiliency_rev": ("resiliency_revenue", "number"), "security_services_count": ("security_count", "number"),
    "resiliency_services_count": ("resiliency_count", "number"), "sub_segment": ("segment", "string"), "account_phase__c": ("phase", "string"),
    "gtm_industry__c": ("industry", "string"), "max_aws_support_level": ("support_level", "string"),
    "customer_stage_of_adoption_score__c": ("adoption_score", "number"), "level_9": ("organization", "string"),
}
PIPELINE = {
    "accountid": ("account_id", "string"), "account_name": ("account_name", "string"), "group_type": ("group_type", "string"),
    "sub_segment": ("segment", "string"), "account_phase__c": ("phase", "string"), "tas_bucket": ("revenue_bucket", "string"),
    "gtm_industry__c": ("industry", "string"), "max_aws_support_level": ("support_level", "string"), "level_1": ("level_1", "string"),
    "level_2": ("level_2", "string"), "level_3": ("level_3", "string"), "level_9": ("organization", "string"),
    "activity_id": ("activity_id", "string"), "g3_engagement_type": ("engagement_type", "string"),
    "is_direct_engagement": ("is_direct", "int"), "is_attributed_engagement": ("is_attributed", "int"), "opp_id": ("opp_id", "string"),
    "opportunity_name": ("opportunity_name", "string"), "opp_created_date": ("created_date", "date"), "opp_close_date": ("close_date", "date"),
    "stagename": ("stage_name", "string"), "probability": ("probability", "number"), "isclosed": ("is_closed", "flag"),
    "iswon": ("is_won", "flag"), "opp_total_arr": ("opp_arr", "money"), "olm_id": ("line_no", "string"),
    "functional_area__c": ("functional_area", "string"), "product_name__c": ("product_name", "string"), "totalprice": ("total_price", "money"),
    "service_arr": ("service_arr", "money"), "is_security": ("is_security", "int"), "is_resiliency": ("is_resiliency", "int"),
    "is_sec_res_opportunity": ("is_sec_res", "int"),
}


def _read(spark: SparkSession, path: str, layout: dict[str, tuple[str, str]]) -> DataFrame:
    dates = [c for c, (_, kind) in layout.items() if kind == "date"]
    raw = read_csv(spark, path, ", ".join(f"`{c}` string" for c in layout), date_cols=dates)
    kinds = {"string": lambda c: F.col(c), "date": lambda c: F.col(c), "number": to_number, "money": lambda c: money(F.col(c).try_cast("double")),
             "int": lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)), "flag": to_flag}
    return raw.select(*[kinds[kind](c).alias(name) for c, (name, kind) in layout.items()])


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Customer x month rows with ``treated`` (1 if the customer has an event date)."""
    return _read(spark, path, PANEL).withColumn("treated", F.col("event_date").isNotNull().cast("int"))


def read_pipeline(spark: SparkSession, path: str) -> DataFrame:
    """Account x engagement x opportunity x line rows, the grain of the analysis table."""
    return _read(spark, path, PIPELINE)
