"""Catalog: partition pruning (S1, S7, P2), CSV in ranges (S3, S4, S5, S9), checked sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradelens.functions.predicates import Selection
from gradelens.operators import outcome
from gradelens.plans import sqltext as S
from gradelens.plans.registry import register
from gradelens.plans.tables import ORDER_OUTCOME, table
from gradelens.session import checkpoint_dir
from gradelens.sources import io

OO = ORDER_OUTCOME


def scratch(spark, label):
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def by_year(spark, sf):
    """Orders as a record table partitioned by year, as a view with its partition column."""
    path = scratch(spark, "orders-by-year")
    io.write_parquet(table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")), path, partition_by=["year"])
    view = next(iter(io.register_views(spark, {f"orders_{uuid.uuid4().hex}": path})))
    return spark.table(view)


@register("pruned_years", f"""
SELECT key, total, low, mid, high, {S.rates(OO)} FROM (
  SELECT o_orderpriority AS key, count(*) AS total, {S.level_counts(OO)} FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1)
ORDER BY total DESC, key LIMIT 200
""")
def pruned_years(spark, sf):
    """A year range over a partitioned record table reads those partitions alone."""
    return outcome.breakdown(by_year(spark, sf), "o_orderpriority", OO, Selection({}, {"year": (1996, 1998)}))


@register("pruned_join", """
WITH y AS (SELECT year(l_shipdate) AS year, max(l_quantity) AS most FROM lineitem WHERE year(l_shipdate) % 2 = 1 GROUP BY 1)
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, most, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM orders JOIN y ON year(o_orderdate) = y.year GROUP BY 1, 2
""")
def pruned_join(spark, sf):
    """A join on the partition column reads the partitions of the years that the other side has."""
    li = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), "l_quantity").filter(F.col("year") % 2 == 1)
    years = li.groupBy("year").agg(F.max("l_quantity").alias("most"))
    return (by_year(spark, sf).join(F.broadcast(years), "year")      # a row per year
            .groupBy("year", "most").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")))


def _written(spark, sf, name, label, write, read):
    source = table(spark, sf, name)
    path = scratch(spark, label)
    write(source, path)
    return io.compare(source, read(path, source))


_SAME = "SELECT count(*) AS rows, count(*) AS written, true AS same FROM {}"


@register("sink_parquet", _SAME.format("lineitem"))
def sink_parquet(spark, sf):
    """Zstd Parquet by line number, at most 10,000 rows a file, has the rows of its source."""
    return _written(spark, sf, "lineitem", "sink-parquet", lambda df, p: io.write_parquet(df, p, max_records_per_file=10_000, partition_by=["l_linenumber"]),
                    lambda p, df: spark.read.schema(df.schema).parquet(p).select(*df.columns))


@register("sink_csv", _SAME.format("documents"))
def sink_csv(spark, sf):
    """Documents with line breaks and quotes as CSV, read back in ranges, typed."""
    def read(path, df):
        return io.read_csv_typed(spark, path, {f.name: f.dataType.simpleString() for f in df.schema.fields})
    return _written(spark, sf, "documents", "sink-csv", io.write_csv, read)


@register("sink_csv_text", _SAME.format("events"))
def sink_csv_text(spark, sf):
    """Events as text fields, one task per file and line breaks not looked for."""
    source = table(spark, sf, "events")
    texts = source.select(*[F.col(c).cast("string").alias(c) for c in source.columns])
    path = scratch(spark, "sink-text")
    io.write_csv(texts, path)
    return io.compare(texts, io.read_csv_text(spark, path, breaks="none"))


@register("sink_json", _SAME.format("orders"))
def sink_json(spark, sf):
    """Orders as JSON lines, read back with their schema."""
    return _written(spark, sf, "orders", "sink-json", io.write_json, lambda p, df: io.read_json(spark, p, df.schema))


@register("csv_row_counts", "SELECT 'documents' AS source, count(*) AS rows FROM documents UNION ALL SELECT 'supplier', count(*) FROM supplier")
def csv_row_counts(spark, sf):
    """Records of CSV files, quoted line breaks counted as one record."""
    paths = {}
    for name in ("documents", "supplier"):
        paths[name] = scratch(spark, f"count-{name}")
        io.write_csv(table(spark, sf, name), paths[name])
    return io.source_row_counts(spark, paths)
