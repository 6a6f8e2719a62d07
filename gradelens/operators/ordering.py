"""Report orderings.

Each function returns an ordering as a list of sort Columns, and ``ranked``
numbers rows by it: a range sort, checkpointed, where a row's number is the count of the earlier ranges plus its place in
its own, so no task meets all rows.  Lists bounded by a parameter (a top k, given values) are
numbered in one task (``top_ranked``, ``ranked_few``), a top k after its cut; ``df.orderBy(*order)`` sorts an open list
without a number.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelens.functions.labels import OTHER, unknown_or_other
from gradelens.session import checkpoint_dir

POS_BITS = 33      # monotonically_increasing_id = partition << 33 | position


def by_total(key: str = "key") -> list[Column]:
    """Total descending, key ascending (NULL last) as the tie-break."""
    return [F.desc("total"), F.asc_nulls_last(key)]


def by_desc(col: str, key: str = "key") -> list[Column]:
    return [F.desc(col), F.asc_nulls_last(key)]


def other_last(base: Sequence[Column], key: str = "key", other: str = OTHER) -> list[Column]:
    """The ``Other`` row after every other row, then ``base``."""
    return [F.asc(F.coalesce((F.col(key) == F.lit(other)).cast("int"), F.lit(0))), *base]


def unknown_last(base: Sequence[Column], key: str = "key") -> list[Column]:
    """T4: keys starting with unknown / other (any case) last, then ``base``."""
    return [F.asc(F.coalesce(unknown_or_other(F.col(key)).cast("int"), F.lit(0))), *base]


def listed(values: Sequence, base: Sequence[Column] = (), key: str = "key") -> list[Column]:
    """T5: keys in the order of ``values``; unlisted keys after them."""
    pos = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(key))
    big = F.lit(len(values) + 1).cast("long")
    return [F.asc(F.when(pos > 0, pos).otherwise(big)), *base]


def numeric_key(key: str = "key") -> list[Column]:
    """By the integer value of a text key; non-numeric keys last."""
    return [F.asc_nulls_last(F.col(key).try_cast("long")), F.asc_nulls_last(key)]


def ranked(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Number rows 1.. by ``order``, over any number of rows."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    at = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", POS_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)      # one row per range
    counts = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") - F.shiftleft("_part", POS_BITS) + 1
    return at.join(F.broadcast(counts), "_part").select(*df.columns, place.cast("long").alias(name))


def ranked_few(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Number rows 1.. by ``order`` in one task, for lists that a parameter bounds."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_ranked(df: DataFrame, order: Sequence[Column], k: int, name: str = "pos") -> DataFrame:
    """The first ``k`` rows by ``order``, numbered 1..k (each partition keeps its own first ``k``)."""
    return ranked_few(top(df, order, k), order, name)


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """T6 / T7 first step: the first ``k`` rows by ``order`` (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def exclude_prefix(df: DataFrame, pattern: str = r"(?i)^unknown", key: str = "key") -> DataFrame:
    """Drop keys matching ``pattern`` (e.g. the unknown region)."""
    return df.filter(~F.coalesce(F.col(key).rlike(pattern), F.lit(False)))
