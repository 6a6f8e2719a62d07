"""Category folding over breakdown rows.

Folding runs on breakdown output (``key``, ``total``, level counts): map the
key, drop rows whose mapped key is NULL, sum counts per mapped key, and
recompute rates.  Because the input is already one row per key, this second
aggregate is over one row per key.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens.functions.numeric import scaled_round, with_rates
from gradelens.spec import OutcomeSpec

KeyMap = Callable[[Column], Column]


def fold(rows: DataFrame, mapper: KeyMap, spec: OutcomeSpec, key: str = "key") -> DataFrame:
    """Re-aggregate breakdown rows by ``mapper(key)``; NULL mapping drops the row."""
    mapped = rows.select(mapper(F.col(key)).alias("key"), "total", *spec.names) \
                 .filter(F.col("key").isNotNull())
    agg = mapped.groupBy("key").agg(F.sum("total").cast("long").alias("total"),
                                    *[F.sum(n).cast("long").alias(n) for n in spec.names])
    return with_rates(agg, spec)


def member_rows(rows: DataFrame, mapper: KeyMap, key: str = "key") -> DataFrame:
    """``(folded, raw)``, a row for each raw key and the key it folds into, for any number of them."""
    mapped = rows.select(mapper(F.col(key)).alias("folded"), F.col(key).alias("raw"))
    return mapped.filter(F.col("folded").isNotNull() & F.col("raw").isNotNull()).distinct()


def members(rows: DataFrame, mapper: KeyMap, key: str = "key") -> DataFrame:
    """Folded key → sorted list of the raw keys folded into it, in one row: for a filter's value list (``member_rows`` otherwise)."""
    mapped = rows.select(mapper(F.col(key)).alias("folded"), F.col(key).alias("raw")) \
                 .filter(F.col("folded").isNotNull())
    return mapped.groupBy("folded").agg(F.array_sort(F.collect_set("raw")).alias("members"))


def frequency_vs_rate(folded: DataFrame, spec: OutcomeSpec, digits: int = 2) -> DataFrame:
    """Per group total and top-level percent, plus the unweighted mean of
    the group percents (each rounded to ``digits`` first)."""
    scaled = scaled_round(F.col(spec.top).cast("long") * F.lit(100), F.col("total"), digits)
    scale = float(10 ** digits)
    rows = folded.select("key", "total", scaled.alias("_scaled"))
    # mean of the rounded percents from their exact integer form: order-free, one-row aggregate
    mean = rows.select(F.sum("_scaled").cast("double") / (F.count(F.lit(1)).cast("double") * F.lit(scale))).scalar()
    return rows.select("key", "total", (F.col("_scaled").cast("double") / F.lit(scale)).alias(f"{spec.top}_pct"),
                       mean.alias(f"mean_{spec.top}_pct"))


def risk_range(rows: DataFrame, col: str = "risk") -> DataFrame:
    """Min and max of ``col`` across groups."""
    return rows.select(F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"))
