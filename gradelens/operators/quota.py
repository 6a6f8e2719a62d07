"""Exact quota assignment, its check, and balanced expansion (Q1, Q2, Q3).

Quotas (largest remainder): with target weights ``w_i`` (sum ``W``) and ``n``
rows, label ``i`` gets ``floor(w_i n / W)`` rows plus one more for the
``n - sum(floor)`` labels with the largest remainders ``w_i n mod W``
(ties: label ascending).  The arithmetic is exact in DECIMAL(38, 0).

Rows get labels by position in a seeded pseudo-random order (``positions``).
The order is md5 of seed and keys, so it depends on the data and the seed
alone, not on how the input happens to be partitioned.  The position finds its
label's ``[lo, hi)`` range through a binned equi-join against the quota
table, whose size is bounded by ``#labels + bins``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelens.session import checkpoint_dir

DEC = "decimal(38,0)"
_POS_BITS = 33  # monotonically_increasing_id = partition index << 33 | position
RUN = 10_000     # copies made in one go
NULL_MARK = "\\N"


def quota_sizes(weights: DataFrame, label: str, weight: str, n: Column | int) -> DataFrame:
    """Q1 sizes: ``(label, weight, base, remainder, size)``; sizes sum to ``n``.

    ``weights`` is the small target table (one row per label); ``n`` may be a
    scalar subquery such as ``df.select(count(*)).scalar()``.  Totals over the
    target table are windows over its rows (bounded by the label count), so
    only ``n`` is a subquery.
    """
    n_col = (n if isinstance(n, Column) else F.lit(n)).cast(DEC)
    every = Window.partitionBy()
    w = weights.select(F.col(label).alias("label"), F.col(weight).cast("long").alias("weight"))
    w = w.withColumn("_prod", F.col("weight").cast(DEC) * n_col) \
         .withColumn("_total", F.sum(F.col("weight").cast(DEC)).over(every))
    w = w.withColumn("remainder", F.pmod("_prod", "_total").cast(DEC))
    w = w.withColumn("base", ((F.col("_prod") - F.col("remainder")) / F.col("_total")).cast("long"))
    w = w.withColumn("_short", n_col.cast("long") - F.sum("base").over(every))
    rank = F.row_number().over(Window.orderBy(F.desc("remainder"), F.asc("label")))
    w = w.withColumn("size", F.col("base") + F.when(rank <= F.col("_short"), 1).otherwise(0))
    return w.select("label", "weight", "base", F.col("remainder").cast("string").alias("remainder"), "size")


def quota_ranges(sizes: DataFrame) -> DataFrame:
    """Cumulative ``[lo, hi)`` position range per label, labels in ascending order."""
    w = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.select("label", "size", (F.sum("size").over(w) - F.col("size")).alias("lo"),
                        F.sum("size").over(w).alias("hi"))


def seeded_hash(keys: Sequence[str], seed: int) -> Column:
    """First 16 hex digits of ``md5(seed|key|key...)``, NULL keys marked."""
    text = [F.coalesce(F.col(k).cast("string"), F.lit(NULL_MARK)) for k in keys]
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *text)), 1, 16)


def numbered_copies(df: DataFrame, n: Column, keys: Sequence[str], name: str) -> DataFrame:
    """Every row ``n`` times, numbered from 1 (none for ``n < 1``).  Copies are made in two steps of at most
    ``RUN`` with a shuffle of the runs between, so one row's copies are made on many tasks."""
    last = F.floor((F.col("_times") - 1) / RUN)
    # a stated number of partitions, which AQE does not coalesce by the size of the runs
    nparts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (df.withColumn("_times", n).filter(F.col("_times") > 0)
              .withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), last)))
              .repartition(nparts, *keys, "_run"))
    copies = F.sequence(F.col("_run") * RUN + 1, F.least((F.col("_run") + 1) * RUN, F.col("_times")))
    return runs.withColumn(name, F.explode(copies)).drop("_times", "_run")


def positions(df: DataFrame, keys: Sequence[str], seed: int, group: str | None = None,
              name: str = "_pos", total: str | None = None, unique: bool = False) -> DataFrame:
    """Number the rows 0..n-1 (within each ``group`` when given) in a seeded
    pseudo-random order; ``total`` names a column for the number of rows (of the group).

    The order is ``(seeded_hash(keys), all columns)``: rows that tie are equal
    in every column, so the result is fixed by seed and data.  Equal rows are
    counted and numbered before the range sort (skipped with ``unique``, for rows known
    to be distinct), so a row that repeats a billion times is spread over the
    partitions by its number, and a retried task numbers it the same way.  The sorted
    rows are checkpointed to the shared folder.  A row's position is its group's count
    in earlier partitions plus its offset from the group's first row in its partition,
    read from a (partition x group) count table.  Columns must be orderable (no maps).
    """
    spark = df.sparkSession
    nparts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    order = ["_h", *keys, *[c for c in cols if c not in set(keys)]]
    numbered = df
    if not unique:
        counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
        numbered = numbered_copies(counted, F.col("_n"), cols, "_copy").drop("_n")
        order.append("_copy")
    rows = (numbered.withColumn("_h", seeded_hash(keys, seed)).repartitionByRange(nparts, *order)
                    .sortWithinPartitions(*([group] if group else []), *order).select(*cols))
    # one materialisation of the sorted rows: every later read (counts,
    # offsets, positions) is narrow and sees the same partitions
    checkpoint_dir(spark)
    rows = rows.checkpoint(eager=True)
    with_id = rows.withColumn("_mid", F.monotonically_increasing_id()) \
                  .withColumn("_part", F.shiftright(F.col("_mid"), _POS_BITS)) \
                  .withColumn("_pip", F.col("_mid") - F.shiftleft(F.col("_part"), _POS_BITS)) \
                  .withColumn("_g", F.col(group) if group else F.lit(0))
    counts = with_id.groupBy("_part", "_g").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_pip").alias("_first"))
    of_group = Window.partitionBy("_g")
    upto = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(F.col("_part").alias("_op"), F.col("_g").alias("_og"), "_first",
                            (F.sum("_cnt").over(upto) - F.col("_cnt")).alias("_before"),
                            F.sum("_cnt").over(of_group).alias("_total"))
    # without groups: one row per partition, a proven bound; with groups the
    # table is partitions x groups and AQE picks the join from its real size
    joined = with_id.join(F.broadcast(offsets) if group is None else offsets,
                          (F.col("_part") == F.col("_op")) & F.col("_g").eqNullSafe(F.col("_og")))
    more = [F.col("_total").alias(total)] if total else []
    return joined.select(*cols, (F.col("_before") + F.col("_pip") - F.col("_first")).alias(name), *more)


def assign(df: DataFrame, keys: Sequence[str], sizes: DataFrame, seed: int = 42,
           out: str = "label", bins: int = 4096, unique: bool = False) -> DataFrame:
    """Q1 rows: every row of ``df`` gets a label; label counts equal ``sizes``.

    ``sizes`` must sum to the row count of ``df`` (``quota_sizes`` with
    ``n = count(df)``), so the label ranges cover every position.  ``unique``
    says that no two rows are equal (see ``positions``).
    """
    indexed = positions(df, keys, seed, unique=unique)
    # one row per label: materialise it once so the quota arithmetic (whose
    # totals are subqueries over the data) is not re-run by every later job
    ranges = quota_ranges(sizes).checkpoint(eager=True)
    n = ranges.select(F.max("hi")).scalar()
    width = F.greatest(F.ceil(n / F.lit(bins)), F.lit(1)).cast("long")
    # explode each label range over the bins it touches: <= #labels + bins rows
    binned = ranges.filter(F.col("hi") > F.col("lo")).select(
        "label", "lo", "hi",
        F.explode(F.sequence((F.col("lo") / width).cast("long"),
                             ((F.col("hi") - 1) / width).cast("long"))).alias("_bin"))
    rows = indexed.withColumn("_bin", (F.col("_pos") / width).cast("long"))
    joined = rows.join(binned.withColumnRenamed("label", "_label"), "_bin")
    hit = joined.filter((F.col("_pos") >= F.col("lo")) & (F.col("_pos") < F.col("hi")))
    return hit.withColumnRenamed("_label", out).drop("_bin", "lo", "hi", "_pos")


def check(assigned: DataFrame, sizes: DataFrame, label: str = "label") -> DataFrame:
    """Q2: per label, assigned rows vs quota and target share (percentage points).

    The target share of a label is ``weight / W``; ``diff_pp`` is
    ``100 * |assigned / n - weight / W|``.
    """
    counts = assigned.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("assigned"))
    every = Window.partitionBy()      # one row per label
    sizes = sizes.withColumn("_w", F.sum("weight").over(every)).withColumn("_size", F.sum("size").over(every))
    j = sizes.join(counts, "label", "full")
    total_w, n = F.max("_w").over(every), F.max("_size").over(every)
    return j.select(
        "label", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("assigned", F.lit(0)).alias("assigned"),
        (F.lit(100.0) * F.abs(F.coalesce("assigned", F.lit(0)) / n - F.col("weight") / total_w)).alias("diff_pp"))


def expand(df: DataFrame, keys: Sequence[str], target: int | Column, seed: int = 42,
           unique: bool = False) -> DataFrame:
    """Q3: rows repeated to ``target`` rows in total keeping the distribution.

    Each row appears ``target div n`` times, plus once more for the first
    ``target mod n`` rows in seeded hash order; ``_copy`` numbers the copies.
    """
    indexed = positions(df, keys, seed, total="_total", unique=unique)
    n = F.col("_total")
    t = (target if isinstance(target, Column) else F.lit(target)).cast("long")
    extra = F.pmod(t, n)
    reps = ((t - extra) / n).cast("long") + F.when(F.col("_pos") < extra, 1).otherwise(0)
    return numbered_copies(indexed, reps, ["_pos"], "_copy").drop("_pos", "_total")
