"""Dataset profiles.

The profile of many fields is one scan: fields are cast to text, unpivoted to
``(field, value)`` and counted; partial aggregation keeps the shuffle at one
row per distinct (field, value) per partition.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.spec import OutcomeSpec


def value_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, value, n)`` for every field in one pass; NULL values kept."""
    src = df.select(*[F.col(f).cast("string").alias(f) for f in fields])
    long = src.unpivot([], list(fields), "field", "value")
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, fields: Sequence[str], spec: OutcomeSpec) -> DataFrame:
    """Row count, count per outcome level (0 when absent) and the values of
    each field with their counts, as rows ``(section, field, value, n)``.

    One scan and one aggregate: the outcome column is unpivoted with the
    fields, a zero-weight row per listed level is added so absent levels
    still appear, and ``GROUPING SETS ((field, value), (field))`` yields the
    value counts and, for the outcome column, the row count.
    """
    tag = "\u0000outcome"
    src = df.select(*[F.col(f).cast("string").alias(f) for f in fields],
                    F.col(spec.column).cast("string").alias(tag))
    long = src.unpivot([], [*fields, tag], "field", "value").withColumn("w", F.lit(1).cast("long"))
    zeros = df.sparkSession.createDataFrame([(tag, lv, 0) for lv in spec.levels],
                                            "field string, value string, w long")
    agg = (long.unionByName(zeros)
               .groupingSets([["field", "value"], ["field"]], "field", "value")
               .agg(F.sum("w").alias("n"), F.grouping_id().alias("g")))
    is_tag = F.col("field") == F.lit(tag)
    section = (F.when((F.col("g") == 1) & is_tag, F.lit("rows"))
                .when((F.col("g") == 0) & is_tag & F.col("value").isin(list(spec.levels)), F.lit("outcome"))
                .when((F.col("g") == 0) & ~is_tag, F.lit("distinct")))
    out = agg.select(section.alias("section"),
                     F.when(is_tag & (F.col("g") == 1), F.lit(None).cast("string"))
                      .when(is_tag, F.lit(spec.column)).otherwise(F.col("field")).alias("field"),
                     F.col("value"), F.col("n"))
    return out.filter(F.col("section").isNotNull())


def levels(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Sorted distinct values per field, ``(field, levels array)``, NULL last.

    The list form puts a field's distinct values in one row; for fields of very many values
    ``value_counts`` keeps one row per value.
    """
    vc = value_counts(df, fields)
    per = vc.groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("_vals"),
                                  F.max(F.col("value").isNull()).alias("_null"))
    # a NULL value is a level too (listed last), as a SQL DISTINCT keeps it
    with_null = F.concat("_vals", F.array(F.lit(None).cast("string")))
    return per.select("field", F.when(F.col("_null"), with_null).otherwise(F.col("_vals")).alias("levels"))


def group_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per value of ``key``, largest first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(key))


def source_counts(sources: Mapping[str, DataFrame]) -> DataFrame:
    """``(source, rows)`` for several inputs (each a count-only scan)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
             for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
