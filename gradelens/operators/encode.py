"""One-hot encoding from a dictionary table (M1): fields with any number of levels, none of them on the driver.

The dictionary is a table ``(field, level, slot)``: the distinct levels are range-sorted by field and level, and a slot is the count of
the levels in earlier ranges plus the place in its own range.  Rows meet it in one equi-join over all fields (a row per field and level) and are put
together again by their number, as ``slots`` and ``values`` in slot order.  Slots are the same as those of index-and-one-hot stages in
alphabetical order: field by field, then the numeric fields; unseen and NULL levels set none.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelens.operators import ordering
from gradelens.session import checkpoint_dir

def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unpivoted(df: DataFrame, cat: Sequence[str], *keys: str) -> DataFrame:
    """``(keys, field, level)``: a row per field, ``field`` its place in ``cat``; NULL levels left out."""
    fields = F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).cast("string").alias("level")) for i, c in enumerate(cat)])
    return df.select(*keys, F.inline(fields)).filter(F.col("level").isNotNull())


def level_dictionary(df: DataFrame, cat: Sequence[str]) -> DataFrame:
    """``(field, level, slot)`` of all levels, slots from 0 in order of field and level."""
    levels = ordering.ranked(unpivoted(df, cat).distinct(), [F.asc("field"), F.asc("level")], "slot")
    return levels.withColumn("slot", F.col("slot") - 1)


@dataclass
class TableEncoder:
    """A dictionary with its field names and the number of its levels; the driver holds one number per field."""

    levels: DataFrame
    cat: list[str]
    num: list[str]
    first: list[int]        # first slot of every categorical field, then of the numeric fields
    size: int

    @classmethod
    def fit(cls, df: DataFrame, cat: Sequence[str], num: Sequence[str]) -> "TableEncoder":
        levels = kept(level_dictionary(df, cat), "levels")
        counts = {r["field"]: r["n"] for r in levels.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}
        first = [0]
        for i in range(len(cat)):
            first.append(first[-1] + counts.get(i, 0))
        return cls(levels, list(cat), list(num), first, first[-1] + len(num))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``slots`` (array<int>, ascending) and ``values`` (array<double>); zeros are left out."""
        rows = kept(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
        hits = unpivoted(rows, self.cat, "_row").join(self.levels, ["field", "level"])
        own = [F.max(F.when(F.col("field") == i, F.col("slot").cast("int"))) for i in range(len(self.cat))]      # one per field at most
        set_ = hits.groupBy("_row").agg(F.array_compact(F.array(*own)).alias("_set"))
        numbers = F.filter(F.array(*[F.struct(F.lit(self.first[-1] + i).alias("s"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v"))
                                     for i, c in enumerate(self.num)]), lambda x: x["v"] != 0) if self.num else F.array().cast("array<struct<s:int,v:double>>")
        found = F.coalesce("_set", F.array().cast("array<int>"))
        return (rows.join(set_, "_row", "left")
                .select(*df.columns, F.concat(found, F.transform(numbers, lambda x: x["s"])).alias("slots"),
                        F.concat(F.transform(found, lambda s: F.lit(1.0)), F.transform(numbers, lambda x: x["v"])).alias("values")))

    def vectors(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``df`` (or an already transformed one) with its slots as a sparse ML vector, written once and read back with the vector type."""
        rows = df if {"slots", "values"} <= set(df.columns) else self.transform(df)
        sparse = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(self.size).alias("size"), F.col("slots").alias("indices"), F.col("values").alias("values"))
        plain = rows.select(*df.columns, sparse.alias(out))
        path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/vectors-{uuid.uuid4().hex}"
        plain.write.parquet(path)
        schema = T.StructType([*[f for f in plain.schema.fields if f.name != out], T.StructField(out, VectorUDT())])
        return df.sparkSession.read.schema(schema).parquet(path)

    def slot_names(self) -> DataFrame:
        """``(slot, feature, level)`` of every slot; numeric fields have no level."""
        names = F.array(*[F.lit(c) for c in self.cat])
        own = self.levels.select("slot", F.get(names, F.col("field")).alias("feature"), "level")
        rows = [(self.first[-1] + i, c, None) for i, c in enumerate(self.num)]
        return own.unionByName(self.levels.sparkSession.createDataFrame(rows, "slot long, feature string, level string")) if rows else own
