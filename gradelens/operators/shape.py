"""Grids, wide form, shares and mean-relative domains.

Grand totals and means are window aggregates over *breakdown rows* (one row
per group, bounded by the breakdown limit), never over the scanned data.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelens.functions.numeric import ratio
from gradelens.session import checkpoint_dir


def grid(spark: SparkSession, x_values: Sequence, y_values: Sequence,
         x: str = "x", y: str = "y") -> DataFrame:
    """Every (x, y) pair of two fixed value lists, built from ``range``."""
    nx, ny = len(x_values), len(y_values)
    idx = F.col("id")
    return spark.range(nx * ny).select(
        F.element_at(F.array(*[F.lit(v) for v in x_values]), (idx / ny).cast("int") + 1).alias(x),
        F.element_at(F.array(*[F.lit(v) for v in y_values]), (idx % ny).cast("int") + 1).alias(y),
    )


def dense(agg: DataFrame, cells: DataFrame, keys: Sequence[str],
          fill: Sequence[str]) -> DataFrame:
    """Every cell of ``cells`` with the aggregate's values, 0 when absent.

    The aggregate is first restricted to the cell keys, so the broadcast side
    has at most ``cells.count()`` rows — a bound fixed by the caller's lists.
    """
    inside = agg.join(cells, list(keys), "left_semi")
    joined = cells.join(F.broadcast(inside), list(keys), "left")
    return joined.select(*keys, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in fill])


def wide(long: DataFrame, row: str, col: str, value: str, values: Sequence,
         prefix: str | None = None) -> DataFrame:
    """One row per ``row`` value, one column per listed ``col`` value.

    ``pivot`` with the value list given runs no extra distinct job.
    """
    out = long.groupBy(row).pivot(col, list(values)).agg(F.sum(value))
    prefix = f"{col}_" if prefix is None else prefix
    return out.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("long").alias(f"{prefix}{v}")
                             for v in values])


def materialised(df: DataFrame) -> DataFrame:
    """A report's groups checkpointed, so that totals over them and their numbering do not read the table again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def whole(df: DataFrame, agg: Column) -> Column:
    """An aggregate of all rows of ``df`` beside each row (a one-row aggregate)."""
    return df.select(agg).scalar()


def with_share(df: DataFrame, col: str = "total", name: str = "share") -> DataFrame:
    """``col / sum(col)`` over all rows of the report.

    Compute shares before a top-N cut so they stay shares of every group.
    """
    return df.withColumn(name, ratio(F.col(col), whole(df, F.sum(col))))


def ratio_to_mean(df: DataFrame, col: str) -> DataFrame:
    """``col / mean(col)`` and a domain symmetric around the mean.

    ``half = max(max ratio - 1, 1 - min ratio, 0.5)``,
    ``lo = max(0, 1 - half) * mean``, ``hi = (1 + half) * mean``.
    """
    m = whole(df, F.avg(col))
    half = F.greatest(F.try_divide(whole(df, F.max(col)), m) - 1,
                      1 - F.try_divide(whole(df, F.min(col)), m), F.lit(0.5))
    staged = df.select("*", m.alias("_m"), half.alias("_half"))
    return staged.select(*df.columns,
                         F.try_divide(F.col(col), F.col("_m")).alias("ratio"),
                         (F.greatest(F.lit(0.0), 1 - F.col("_half")) * F.col("_m")).alias("domain_lo"),
                         ((1 + F.col("_half")) * F.col("_m")).alias("domain_hi"))


def attach(dim: DataFrame, agg: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Every dimension row with its aggregate, NULL where there is none."""
    return dim.join(agg, on, "left")
