"""Functions over Arrow batches as DataFrame steps, with batches of bounded size."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as ST

#: Parameter: most bytes of an Arrow batch.  Spark's default of 64 MB is held several times over, in the JVM and in Python.
BATCH_BYTES = 4 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with the session's Arrow batches held to ``BATCH_BYTES`` (a smaller setting stays)."""
    conf = df.sparkSession.conf
    size, unit = re.fullmatch(r"(-?\d+)\s*([kmg]?)i?b?", conf.get(SETTING).strip().lower()).groups()
    if not 0 < int(size) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[unit] <= BATCH_BYTES:
        conf.set(SETTING, f"{BATCH_BYTES}b")

    def run(batches):
        yield from fn(batches)
        # a worker waits for its next task with no more memory than it needs
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, new: dict[str, str], fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns ``new`` (name → type) that ``fn`` computes for each Arrow batch.

    Input columns of those names (in any case) are replaced.  ``fn`` sees the whole batch, the
    replaced columns included; Spark bounds a batch by rows and bytes.
    """
    taken = {n.lower() for n in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = ST.StructType(kept + ST.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in new.items())).fields)
    positions = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in taken]
    names = [f.name for f in schema.fields]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(i) for i in positions] + fn(b), names=names)

    return map_batches(df, run, schema)
