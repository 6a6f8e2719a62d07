"""Intermediate tables in the shared checkpoint folder, bounded samples, bounded broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelens.session import checkpoint_dir


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back: cuts lineage and survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows (2 * ``rows`` at most) chosen by a hash of ``key``: no sort, no task that meets all rows.

    One count over the key column fixes the threshold.  With ``rows`` rows or fewer, all are taken.
    """
    n = df.count()
    part = min(1.0, rows / max(n, 1))
    limit = int(part * (1 << 32))
    pick = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 32)) < limit
    return df.where(pick).limit(2 * rows)
