"""CSV records with quoted line breaks, read in byte ranges.

A line break ends a record if the quotes before it in the file are even in number.  The scan gives physical lines with the byte range that
they begin in; the parity of each range's quotes and its running sum over the ranges of a file (one row per range) say whether a range begins
inside a quoted field.  Each task then puts the records of its ranges together line by line; only what crosses a range's end, one piece
on each side, is shuffled and joined by its place.

Quotes must be used as RFC 4180 has them: around whole fields, doubled inside.  Blank records are skipped, as Spark's CSV reader does.
A quoted field that never ends takes the rest of its file.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges that begin inside a quoted field are known to every task (a path and an offset each): most of them.
MAX_OPEN_RANGES = 1_000_000
PIECE = "file string, start long, text string, first boolean, place int"
#: Places of a piece: a whole record, what continues the previous range, what goes on in the next one.
WHOLE, HEAD, TAIL = 0, 1, 2


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their file and the start of the byte range that they begin in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def open_ranges(rows: DataFrame) -> list[tuple[str, int]]:
    """The ranges that begin inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = rows.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    found = ranges.withColumn("open", F.sum("odd").over(before) % 2).filter("open = 1").select("file", "start")
    got = [(r["file"], r["start"]) for r in found.limit(MAX_OPEN_RANGES + 1).collect()]
    if len(got) > MAX_OPEN_RANGES:
        raise ValueError(f"over {MAX_OPEN_RANGES} ranges begin inside a quoted field; raise spark.sql.files.maxPartitionBytes")
    return got


def records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``record``: the text of every record of the files below ``path``, without the first of each file if ``header``."""
    rows = lines(spark, path)
    begin_open = spark.sparkContext.broadcast(frozenset(open_ranges(rows)))

    def run(batches):
        now, held, odd, head, first = None, [], 0, False, False     # the range, its open record's lines, quote parity, a head piece, begins the file
        out: list[tuple] = []

        def close(place):
            nonlocal held, first, head
            out.append((now[0], now[1], "\n".join(held), first, place))
            held, first, head = [], False, False

        def batch():
            got = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int32()))],
                                             names=["file", "start", "text", "first", "place"])
            out.clear()
            return got

        for b in batches:
            files, starts, values = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False)
            values = values.to_pylist()
            for f, s, v, q in zip(files, starts, values, (quotes & 1).tolist()):
                if now != (f, s):
                    if held:
                        close(HEAD if head else TAIL)
                    now = (f, s)
                    odd = int(now in begin_open.value)
                    head, first = bool(odd), s == 0
                if odd == 0 and q == 0:
                    out.append((f, s, v, first, WHOLE))
                    first = False
                    continue
                held.append(v)
                odd ^= q
                if odd == 0:
                    close(HEAD if head else WHOLE)
            yield batch()
        if held:
            close(HEAD if head else TAIL)
        yield batch()

    pieces = rows.mapInArrow(run, PIECE)
    # written once: whole records go on from here, the pieces at range ends are joined
    from gradelens.operators.encode import kept
    pieces = kept(pieces, "csv-pieces")
    cut = pieces.filter(F.col("place") != WHOLE)
    so_far = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = cut.withColumn("record_start", F.last(F.when(F.col("place") == TAIL, F.col("start")), ignorenulls=True).over(so_far))
    joined = of.groupBy("file", "record_start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "\n").alias("text"), F.max("first").alias("first"))
    every = pieces.filter(F.col("place") == WHOLE).select("text", "first").unionByName(joined.select("text", "first"))
    if header:
        every = every.filter(~F.col("first"))
    return every.select(F.regexp_replace("text", "\r$", "").alias("record")).filter(F.trim("record") != "")
