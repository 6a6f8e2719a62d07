"""Physical-plan properties: filters pushed to the scan, pruned columns, one scan per table."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def executed(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0]


def test_flagship_pushes_filter_and_prunes(spark):
    df = E.queries()["outcome_breakdown"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)]" in plan
    assert "ReadSchema: struct<l_linenumber:int,l_returnflag:string,l_linestatus:string>" in plan
    assert "TakeOrderedAndProject" in plan or "TakeOrdered" in plan


def test_typed_values_reach_the_scan(spark):
    df = E.queries()["facet_breakdown"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(l_linenumber, [1,2,3])" in plan


def test_one_scan_per_table(spark):
    # the groups of the last two are checkpointed from one scan per table; what is left reads the dimension alone, or nothing
    for name, scans in [("association", 1), ("profile", 1), ("kpis", 1), ("condition_lift", 2),
                        ("region_share", 1), ("share_top", 0)]:
        plan = executed(E.queries()[name](spark, SF_SMALL))
        assert plan.count("FileScan parquet") == scans, name


def test_positions_read_the_checkpoint_without_reshuffling(spark):
    from pyspark.sql import functions as F
    from gradelens.operators import quota
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("v"))
    pos = quota.positions(df, ["k"], seed=3)
    plan = executed(pos)
    # the shuffles and the sort happened once, inside the checkpoint; the
    # rows are read narrow from it, and the only exchanges carry the tiny
    # per-(partition, group) counts: partial-count shuffle, single-partition
    # window, broadcast of the offsets
    assert "Exchange rangepartitioning(_h" not in plan
    assert "Scan ExistingRDD" in plan
    assert plan.count("Exchange") <= 3


def test_child_joins_grow_by_the_same_amount(spark):
    from pyspark.sql import functions as F
    from gradelens.operators import assemble
    parent = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    child = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")

    def scans(n):
        kids = [(child.select(F.col("l_orderkey").alias(f"k{i}"), F.col("l_linenumber").alias(f"n{i}")), f"k{i}", F.col(f"n{i}") == 1)
                for i in range(n)]
        out = assemble.flat_record(parent, "o_orderkey", children=kids)
        return out._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert [scans(n) for n in (0, 1, 2, 3)] == [1, 2, 3, 4]


def test_median_fill_reads_its_input_twice(spark):
    from pyspark.sql import functions as F
    from gradelens.operators import clean
    df = spark.read.parquet(f"{SF_SMALL}/part.parquet").select(F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"))
    # one pass counts both columns when the fill is built, the other applies it
    plan = clean.median_fill(df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
