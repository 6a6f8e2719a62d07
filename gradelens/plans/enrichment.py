"""Catalog: exact quota assignment, its check and balanced expansion (Q1, Q2, Q3).

Test roles: customers per nation are the target shares, every order gets a
nation; orders are expanded to 2.5 times their count.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelens.operators import quota
from gradelens.plans.registry import register
from gradelens.plans.tables import table

SEED = 42

_SIZES_SQL = """
WITH w AS (SELECT n_name AS label, count(*) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
n AS (SELECT count(*) AS n FROM orders),
t AS (SELECT sum(weight) AS tw FROM w),
s AS (SELECT label, weight, CAST((weight * n) // tw AS BIGINT) AS base, (weight * n) % tw AS rem FROM w, n, t),
sh AS (SELECT (SELECT n FROM n) - sum(base) AS short FROM s)
SELECT label, weight, base, CAST(rem AS VARCHAR) AS remainder,
       base + CASE WHEN ROW_NUMBER() OVER (ORDER BY rem DESC, label ASC) <= (SELECT short FROM sh) THEN 1 ELSE 0 END
       AS size
FROM s
"""


def nation_weights(spark, sf):
    cu = table(spark, sf, "customer")
    na = table(spark, sf, "nation")
    per = cu.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("weight"))
    return per.join(na, per.c_nationkey == na.n_nationkey).select(
        F.col("n_name").alias("label"), "weight")


def sizes(spark, sf):
    od = table(spark, sf, "orders")
    return quota.quota_sizes(nation_weights(spark, sf), "label", "weight",
                             od.select(F.count(F.lit(1))).scalar())


def assigned(spark, sf):
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return quota.assign(od, ["o_orderkey"], sizes(spark, sf), seed=SEED, out="nation", unique=True)


@register("quota_sizes", _SIZES_SQL)
def quota_sizes(spark, sf):
    """Q1: largest-remainder quota per nation; sizes sum to the order count."""
    return sizes(spark, sf)


@register("quota_assignment", f"SELECT label AS nation, size AS assigned FROM ({_SIZES_SQL})")
def quota_assignment(spark, sf):
    """Q1: assigned orders per nation equal the quotas exactly."""
    return assigned(spark, sf).groupBy("nation").agg(F.count(F.lit(1)).alias("assigned"))


# the seeded order of ``quota.positions`` over orders (keys are unique)
_ORDERED_SQL = f"""
SELECT o_orderkey, o_orderstatus, o_totalprice,
       ROW_NUMBER() OVER (ORDER BY substr(md5('{SEED}|' || o_orderkey), 1, 16), o_orderkey) - 1 AS pos FROM orders
"""


_ROWS_SQL = f"""
WITH r AS (SELECT label, sum(size) OVER (ORDER BY label) - size AS lo, sum(size) OVER (ORDER BY label) AS hi
           FROM ({_SIZES_SQL}))
SELECT o_orderkey, o_orderstatus, o_totalprice, label AS nation
FROM ({_ORDERED_SQL}) JOIN r ON pos >= lo AND pos < hi
"""


@register("quota_rows", _ROWS_SQL)
def quota_rows(spark, sf):
    """Q1 rows: every order with its nation, fixed by the seed."""
    return assigned(spark, sf)


@register("quota_check", f"""
WITH s AS ({_SIZES_SQL}),
tot AS (SELECT sum(weight) AS tw, sum(size) AS n FROM s),
c AS (SELECT nation, count(*) AS assigned FROM ({_ROWS_SQL}) GROUP BY 1)
SELECT label, size, COALESCE(assigned, 0) AS assigned,
       100.0 * abs(CAST(COALESCE(assigned, 0) AS DOUBLE) / CAST((SELECT n FROM tot) AS DOUBLE)
                   - CAST(weight AS DOUBLE) / CAST((SELECT tw FROM tot) AS DOUBLE)) AS diff_pp
FROM s LEFT JOIN c ON label = nation
""")
def quota_check(spark, sf):
    """Q2: assigned vs quota per nation and the share error in percentage points."""
    return quota.check(assigned(spark, sf), sizes(spark, sf), label="nation")


@register("balanced_expansion", """
WITH n AS (SELECT count(*) AS n FROM orders),
t AS (SELECT CAST(ceil(2.5 * n) AS BIGINT) AS t, n FROM n)
SELECT t // n + 1 AS copies, t % n AS sources FROM t WHERE t % n > 0
UNION ALL SELECT t // n AS copies, n - t % n AS sources FROM t WHERE n - t % n > 0 AND t // n > 0
""")
def balanced_expansion(spark, sf):
    """Q3: orders repeated to 2.5x their count; copies per order as a distribution."""
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    target = od.select(F.ceil(F.count(F.lit(1)) * F.lit(2.5)).cast("long")).scalar()
    ex = quota.expand(od, ["o_orderkey"], target, seed=SEED, unique=True)
    per = ex.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("copies"))
    return per.groupBy("copies").agg(F.count(F.lit(1)).alias("sources"))


@register("balanced_rows", f"""
WITH t AS (SELECT CAST(ceil(2.5 * count(*)) AS BIGINT) AS t, count(*) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, t // n + CASE WHEN pos < t % n THEN 1 ELSE 0 END AS copies
FROM ({_ORDERED_SQL}), t
""")
def balanced_rows(spark, sf):
    """Q3 rows: the number of copies of every order, fixed by the seed."""
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    target = od.select(F.ceil(F.count(F.lit(1)) * F.lit(2.5)).cast("long")).scalar()
    return quota.expand(od, ["o_orderkey"], target, seed=SEED, unique=True) \
                .groupBy("o_orderkey", "o_orderstatus").agg(F.max("_copy").alias("copies"))
