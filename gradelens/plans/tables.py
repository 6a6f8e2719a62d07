"""Test-table roles (see FIXTURES §3) as lazy DataFrames.

Every loader is a column-pruned scan: Spark only reads the columns a query
later selects, and filters reach the Parquet reader as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelens.functions.bands import weekend_flag
from gradelens.spec import OutcomeSpec

# The outcome roles of the test tables.
LINE_OUTCOME = OutcomeSpec("l_returnflag", ("N", "A", "R"), ("low", "mid", "high"), (0, 1, 3))
EVENT_OUTCOME = OutcomeSpec("severity", ("low", "mid", "high"), ("low", "mid", "high"), (0, 1, 3))
ORDER_OUTCOME = OutcomeSpec("o_orderstatus", ("F", "O", "P"), ("low", "mid", "high"), (0, 1, 3))
EVENT_LEVELS = {"view": "low", "click": "low", "signup": "low", "purchase": "mid", "error": "high"}
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the dashboard roles: outcome, hour, weekday, weekend, count."""
    ev = table(spark, sf_dir, "events")
    level = F.lit(None).cast("string")
    for raw, lvl in reversed(list(EVENT_LEVELS.items())):
        level = F.when(F.col("event_type") == raw, F.lit(lvl)).otherwise(level)
    return ev.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        level.alias("severity"),
        F.hour("ts").alias("hour"),
        F.date_format("ts", "EEEE").alias("day_of_week"),
        weekend_flag(F.date_format("ts", "EEEE")).alias("is_weekend"),
        F.regexp_extract("props", r'"k":\s*(-?\d+)', 1).try_cast("long").alias("k"),
    )


def line_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` joined to its order (every line has one)."""
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders")
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner")


def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pt = table(spark, sf_dir, "part")
    return li.join(pt, li.l_partkey == pt.p_partkey, "inner")


def order_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with the customer's nation name as the region role."""
    od = table(spark, sf_dir, "orders")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (od.join(cu, od.o_custkey == cu.c_custkey, "inner")
              .join(na, F.col("c_nationkey") == F.col("n_nationkey"), "inner"))


# The same roles in DuckDB SQL, for the oracles.
EVENTS_SQL = """
  SELECT event_id, ts, user_id, event_type, value, props,
         CASE event_type WHEN 'view' THEN 'low' WHEN 'click' THEN 'low'
              WHEN 'signup' THEN 'low' WHEN 'purchase' THEN 'mid'
              WHEN 'error' THEN 'high' END AS severity,
         CAST(hour(ts) AS INTEGER) AS hour,
         dayname(ts) AS day_of_week,
         dayname(ts) IN ('Saturday', 'Sunday') AS is_weekend,
         TRY_CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS BIGINT) AS k
  FROM events
"""
LINE_ORDERS_SQL = "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
LINE_PARTS_SQL = "SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey"
ORDER_NATIONS_SQL = """
  SELECT o.*, c_nationkey, c_mktsegment, n_nationkey, n_name, n_regionkey
  FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
