"""Scans and sinks.

- Parquet directories register as temp views (partition columns discovered).
- CSV scans read every column as text and type it with ``try_cast``; a row
  whose typed column does not parse is skipped whatever the projection
  (Spark's own DROPMALFORMED is applied lazily and depends on the columns a
  query reads).  Rows with a wrong field count are caught with the corrupt
  record column; every query parses whole rows.  Quoted line breaks do not keep a file in one task (``csv_ranges``).
- Sinks write zstd Parquet with a row cap per file, header CSV, and JSON.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelens.sources import csv_ranges

CORRUPT = "_corrupt_record"
NO_DATA = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


# -- parquet -----------------------------------------------------------------------------
def register_views(spark: SparkSession, datasets: Mapping[str, str], suffix: str = "records") -> dict:
    """``{name: dir}`` → temp view ``{name}_{suffix}`` per present directory.

    Returns ``{view: columns}`` (S2); directories that are missing or empty are
    skipped, as a service starts without the data it lacks.  Any other fault is raised.
    """
    cols = {}
    for name, path in datasets.items():
        try:
            df = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in NO_DATA:
                raise
            continue
        view = f"{name}_{suffix}"
        df.createOrReplaceTempView(view)
        cols[view] = columns(df)
    return cols


def resolve(views: Mapping[str, list[str]], datasets: Mapping[str, Mapping], dataset: str, name: str | None = None) -> str:
    """The view of a data set's table (its ``default_table`` if none is named); ``datasets`` has ``tables`` and ``default_table`` of each.

    Unknown data sets and tables, and tables without data (not among ``views``), raise LookupError with what is wrong.
    """
    if dataset not in datasets:
        raise LookupError(f"unknown dataset '{dataset}'")
    name = name or datasets[dataset]["default_table"]
    if name not in datasets[dataset]["tables"]:
        raise LookupError(f"unknown table '{name}' for dataset '{dataset}'")
    view = f"{dataset}_{name}"
    if view not in views:
        raise LookupError(f"data for {view} not available")
    return view


def columns(df: DataFrame) -> list[str]:
    """Column discovery."""
    return list(df.columns)


def write_parquet(df: DataFrame, path: str, max_records_per_file: int = 1_000_000,
                  compression: str = "zstd", partition_by: list[str] | None = None) -> None:
    """Overwrite ``path`` with zstd Parquet, at most
    ``max_records_per_file`` rows per file, one or more files per partition."""
    w = (df.write.mode("overwrite").option("compression", compression)
           .option("maxRecordsPerFile", max_records_per_file))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


#: Quotes are doubled inside a quoted field.
CSV = {"escape": '"'}
#: How line breaks inside quoted fields are read: in byte ranges (``csv_ranges``; two passes, any number of tasks), by one task per file
#: (Spark's ``multiLine``), or not at all (each line is a record; one pass).
BREAKS = ("split", "whole", "none")


def _options(breaks: str) -> dict[str, str]:
    if breaks not in BREAKS:
        raise ValueError(f"breaks must be one of {BREAKS}")
    return {**CSV, "multiLine": str(breaks == "whole").lower()}


# -- csv ----------------------------------------------------------------------------------
def read_csv_text(spark: SparkSession, path: str, names: list[str] | None = None,
                  header: bool = True, breaks: str = "split") -> DataFrame:
    """Every field as text, no NA inference (an empty field reads as NULL)."""
    r = spark.read.options(**_options(breaks)).option("header", header).option("inferSchema", False)
    if breaks == "split":
        names = names or spark.read.options(**_options("whole")).option("header", header).csv(path).columns
        return csv_ranges.records(spark, path, header).select(F.from_csv("record", _ddl(names), CSV).alias("r")).select("r.*")
    if names:
        r = r.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return r.csv(path)


def _ddl(names: list[str], more: str = "") -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names) + more


def read_csv_typed(spark: SparkSession, path: str, schema: Mapping[str, str],
                   header: bool = True, check_field_count: bool = True, breaks: str = "split") -> DataFrame:
    """S3: CSV with typed columns; rows that do not fit are skipped.

    ``schema`` maps every column, in file order, to a Spark type name.  A
    row is kept when each non-empty field casts to its type and (with
    ``check_field_count``) it has exactly ``len(schema)`` fields.
    """
    names = list(schema)
    if breaks == "split":
        options = {**CSV, **({"columnNameOfCorruptRecord": CORRUPT} if check_field_count else {})}
        ddl = _ddl(names, f", {CORRUPT} string" if check_field_count else "")
        raw = csv_ranges.records(spark, path, header).select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
        if check_field_count:
            raw = raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    else:
        fields = [T.StructField(n, T.StringType()) for n in names]
        r = spark.read.options(**_options(breaks)).option("header", header).option("mode", "PERMISSIVE")
        if check_field_count:
            fields.append(T.StructField(CORRUPT, T.StringType()))
            r = r.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
        raw = r.schema(T.StructType(fields)).csv(path)
        if check_field_count:
            # the test of the first field is always true: a scan of the corrupt record alone is refused
            first = F.length(F.coalesce(F.col(names[0]), F.lit(""))) >= 0
            raw = raw.filter(F.col(CORRUPT).isNull() & first).drop(CORRUPT)
    typed = [F.col(n).try_cast(t).alias(n) if t != "string" else F.col(n) for n, t in schema.items()]
    ok = [F.col(n).isNull() | F.col(n).try_cast(t).isNotNull() for n, t in schema.items() if t != "string"]
    out = raw.filter(reduce(lambda a, b: a & b, ok)) if ok else raw
    return out.select(*typed)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row, overwriting."""
    df.write.mode("overwrite").option("header", True).option("escape", CSV["escape"]).csv(path)


# -- json ---------------------------------------------------------------------------------
def write_json(df: DataFrame, path: str) -> None:
    """A profile (or any result) as JSON lines, overwriting."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a JSON-lines result back."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def source_row_counts(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv",
                      header: bool = True) -> DataFrame:
    """``(source, rows)`` per input file or directory."""
    from gradelens.operators.profile import source_counts
    readers = {n: (csv_ranges.records(spark, p, header) if fmt == "csv" else spark.read.format(fmt).load(p)) for n, p in paths.items()}
    return source_counts(readers)


# -- checked sinks ------------------------------------------------------------------------
def digest(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(rows, total, parity)``: an order-free digest of a table's rows as text.

    Sum and exclusive or of a 64-bit hash of every row's JSON, NULLs included; one scan, one row.
    """
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in names or df.columns]), {"ignoreNullFields": "false"}))
    return df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("parity"))


def compare(source: DataFrame, written: DataFrame) -> DataFrame:
    """``(rows, written, same)``: whether a table that was written has the rows of its source."""
    a = digest(source).select(F.col("rows"), F.col("total").alias("t1"), F.col("parity").alias("p1"), F.lit(1).alias("one"))
    b = digest(written, source.columns).select(F.col("rows").alias("written"), F.col("total").alias("t2"), F.col("parity").alias("p2"), F.lit(1).alias("one"))
    same = (F.col("rows") == F.col("written")) & F.col("t1").eqNullSafe(F.col("t2")) & F.col("p1").eqNullSafe(F.col("p2"))
    return a.join(b, "one").select("rows", "written", same.alias("same"))      # one row each
