"""Exact order statistics without a single-task buffer.

``F.median`` keeps every distinct value of the column in one aggregation
buffer on one task.  Here all columns are counted per distinct value in one
pass (a partial aggregate), the distinct values are range-partitioned and
checkpointed together with their partition number, so both later reads see the same partitions.
Per-partition totals then name the one or two partitions that
hold a column's middle values, and only those are ordered.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelens.session import checkpoint_dir


def exact_medians(df: DataFrame, values: Mapping[str, Column]) -> dict[str, Column]:
    """Per name a scalar subquery: the median of its numeric expression (mean of the
    two middle values for an even count, as ``percentile(0.5)``); NULL when there is
    none.  ``df`` is read once for all of them, when this is called."""
    names = list(values)
    if not names:
        return {}
    spark = df.sparkSession
    nparts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(*[values[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    counts = (src.unpivot([], src.columns, "f", "v").filter(F.col("v").isNotNull())
                 .groupBy("f", "v").agg(F.count(F.lit(1)).alias("c")))
    checkpoint_dir(spark)
    ordered = counts.repartitionByRange(nparts, "f", "v").withColumn("p", F.spark_partition_id()).checkpoint(eager=True)

    by_field = Window.partitionBy("f")
    totals = ordered.groupBy("f", "p").agg(F.sum("c").alias("pc"))
    upto = by_field.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = (totals.withColumn("upto", F.sum("pc").over(upto)).withColumn("n", F.sum("pc").over(by_field))
                   .withColumn("lo", F.floor((F.col("n") - 1) / 2)).withColumn("hi", F.floor(F.col("n") / 2))
                   .filter((F.col("upto") > F.col("lo")) & (F.col("upto") - F.col("pc") <= F.col("hi")))
                   .select("f", "p", (F.col("upto") - F.col("pc")).alias("before"), "lo", "hi"))
    # at most two partitions per listed column
    middle = ordered.join(F.broadcast(parts), ["f", "p"])
    inside = Window.partitionBy("f", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the value at rank r is the smallest v whose cumulative count exceeds r
    cum = middle.withColumn("cum", F.col("before") + F.sum("c").over(inside))
    mids = cum.groupBy("f").agg(F.min(F.when(F.col("cum") > F.col("lo"), F.col("v"))).alias("a"),
                                F.min(F.when(F.col("cum") > F.col("hi"), F.col("v"))).alias("b"))
    found = mids.agg(F.map_from_entries(F.collect_list(F.struct("f", (F.col("a") + F.col("b")) / F.lit(2.0)))))
    return {n: F.try_element_at(found.scalar(), F.lit(f"v{i}")) for i, n in enumerate(names)}


def exact_median(df: DataFrame, value: Column) -> Column:
    """The median of one numeric expression (see ``exact_medians``)."""
    return exact_medians(df, {"value": value})["value"]
