"""Parent / child assembly into one flat record.

A flat record is a parent row with the columns of its first-listed child of
each child table, per-key flags aggregated from a child table, decoded codes
and a final projection.

Joins keep plain left-join semantics (a parent with several first-listed
children fans out; a parent with none keeps NULL child columns) and are
planned so a hot key cannot pin one task.  The most children of one key are counted first, over the key column
alone.  Up to ``MAX_PER_KEY`` it is a left join, whose parent side AQE splits where it is skewed.  Beyond, the child side is completed with an
all-NULL row for every parent key that has no child, which makes the join
an inner one, and AQE can split a skewed partition on either side.  Flags are one row
per key after a partial aggregate.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens.functions.labels import clean_label


#: Children of one key that a left join takes: a task that holds them all is no larger than others.
MAX_PER_KEY = 100_000


def first_child(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str,
                ref: Column | None = None, dedupe: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """``parent LEFT JOIN (child WHERE ref)`` on ``parent_key = child_key``.

    ``ref`` selects the first-listed child (e.g. ``reference = 1``).  With
    ``dedupe`` one child row per key is kept (the smallest by all columns),
    turning the fan-out off; the default keeps left-join semantics.  NULL keys match nothing.
    ``keys`` is a frame with the same ``parent_key`` values as ``parent`` (default
    ``parent`` itself): in a chain of children the first parent, so that the plan
    grows by the same amount with each child.
    """
    kids = child if ref is None else child.filter(ref)
    kids = kids.filter(F.col(child_key).isNotNull())
    if dedupe:
        kids = (kids.groupBy(child_key)
                    .agg(F.min(F.struct(*[c for c in kids.columns if c != child_key])).alias("_k"))
                    .select(child_key, "_k.*"))
    if dedupe or _most_of_a_key(kids, child_key) <= MAX_PER_KEY:
        side = kids.withColumn("_jk", F.col(child_key))
        side = side.drop(child_key) if parent_key == child_key else side
        return parent.join(side, parent[parent_key] == side["_jk"], "left").drop("_jk")
    wanted = (parent if keys is None else keys).select(F.col(parent_key).alias("_jk")).distinct()
    listed = kids.select(F.col(child_key).alias("_listed")).distinct()
    absent = wanted.join(listed, F.col("_jk") == F.col("_listed"), "left_anti")
    side = kids.withColumn("_jk", F.col(child_key)).unionByName(absent, allowMissingColumns=True)
    if parent_key == child_key:
        side = side.drop(child_key)
    out = parent.withColumn("_jp", F.col(parent_key)).join(side, F.col("_jp").eqNullSafe(F.col("_jk")), "inner")
    return out.drop("_jp", "_jk")


def _most_of_a_key(kids: DataFrame, key: str) -> int:
    """The largest number of rows with one key (one job over the key column)."""
    return kids.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def child_flags(child: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """A10: per key, ``max(CASE WHEN cond THEN 1 ELSE 0 END)`` for each flag."""
    return child.groupBy(key).agg(*[
        F.max(F.when(cond, F.lit(1)).otherwise(F.lit(0))).alias(name) for name, cond in flags.items()])


def attach_flags(df: DataFrame, flags: DataFrame, df_key: str, flag_key: str) -> DataFrame:
    """Left join of the per-key flags (one row per key)."""
    renamed = flags.withColumnRenamed(flag_key, "_fk")
    return df.join(renamed, df[df_key] == renamed["_fk"], "left").drop("_fk")


def code_list(rows: DataFrame, table_col: str = "table", field_col: str = "field",
              code_col: str = "code", label_col: str = "label", clean: bool = True,
              order_col: str | None = None) -> DataFrame:
    """S11 (+ P7): ``(table, field, code, label)`` rows of a code list, with their
    place in the list as ``ord`` when ``order_col`` names it.

    Rows with both code and label NULL, and non-integer codes, are skipped;
    labels are cleaned (NULL / junk → Unknown) unless ``clean`` is off.
    """
    code = F.col(code_col).cast("string").try_cast("double")
    whole = F.when(code == F.floor(code), code.cast("long"))
    lab = clean_label(F.col(label_col)) if clean else F.col(label_col)
    return (rows.filter(F.col(code_col).isNotNull() | F.col(label_col).isNotNull())
                .select(F.col(table_col).alias("table"), F.col(field_col).alias("field"),
                        whole.alias("code"), lab.alias("label"),
                        *([F.col(order_col).alias("ord")] if order_col else []))
                .filter(F.col("code").isNotNull()))


def decode(df: DataFrame, col: str, codes: DataFrame, table: str, field: str,
           default: str | Column = "Unknown", name: str | None = None) -> DataFrame:
    """Label for ``col`` from the code list, ``default`` when unmatched.

    Of a code listed twice the last label by ``ord`` holds (without ``ord`` the smallest
    label), so the join never fans out; text that is not a number gets ``default``.
    The join is planned from the list's size.
    """
    label = F.max_by("label", F.struct("ord", "label")) if "ord" in codes.columns else F.min("label")
    d = (codes.filter((F.col("table") == table) & (F.col("field") == field))
              .groupBy("code").agg(label.alias("_label"))
              .withColumnRenamed("code", "_code"))
    dflt = default if isinstance(default, Column) else F.lit(default)
    out = df.join(d, df[col].cast("string").try_cast("long") == d["_code"], "left")
    return out.withColumn(name or col, F.coalesce(F.col("_label"), dflt)).drop("_code", "_label")


#: Codes of a field up to which its labels are a constant of the plan; longer lists are joined.
MAX_MAP_CODES = 256


def decode_all(df: DataFrame, fields: Sequence[tuple[str, str, str, str, str]], codes: DataFrame) -> DataFrame:
    """P6 / J8 for many columns: ``(column, table, field, default, name)`` each, equal to one ``decode`` per entry.

    The code list is aggregated once.  Fields with few codes, counted first, become constants looked up in the projection, so they
    cost no join; the others go through ``decode``.
    """
    label = F.max_by("label", F.struct("ord", "label")) if "ord" in codes.columns else F.min("label")
    wanted = F.struct("table", "field").isin([F.struct(F.lit(t), F.lit(f)) for _, t, f, _, _ in fields])
    every = codes.filter(wanted).groupBy("table", "field", "code").agg(label.alias("label"))
    per = every.groupBy("table", "field").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("code", "label")).alias("all"))
    few = per.filter(F.col("n") <= MAX_MAP_CODES).select("table", "field", F.to_json("all").alias("all"))
    maps = {(r["table"], r["field"]): r["all"] for r in few.collect()}      # a row per field that is asked for
    long = {(r["table"], r["field"]) for r in per.filter(F.col("n") > MAX_MAP_CODES).select("table", "field").collect()} if len(maps) < len({x[1:3] for x in fields}) else set()
    made = {}
    for col, table, field, default, name in fields:
        if (table, field) in long:
            df = decode(df, col, codes, table, field, default, name=name)
        elif (table, field) in maps:
            labels = F.map_from_entries(F.from_json(F.lit(maps[table, field]), "array<struct<code:bigint,label:string>>"))
            made[name] = F.coalesce(F.try_element_at(labels, F.col(col).cast("string").try_cast("long")), F.lit(default))
        else:
            made[name] = F.lit(default)
    return df.withColumns(made) if made else df


def flat_record(parent: DataFrame, parent_key: str,
                children: Sequence[tuple[DataFrame, str, Column | None]] = (),
                flags: Sequence[tuple[DataFrame, str, dict[str, Column]]] = (),
                projection: Sequence[Column] | None = None, dedupe: bool = False) -> DataFrame:
    """J1 + J2 + J3 + P13: a parent with the first-listed row of each child
    table ``(child, child_key, ref)``, per-key flags of ``(child, child_key,
    {name: condition})`` and the final projection — the left-join chain
    ``parent ⟕ child1 ⟕ child2 ⟕ flags`` planned as in ``first_child``."""
    out = parent
    for child, key, ref in children:
        out = first_child(out, child, parent_key, key, ref=ref, dedupe=dedupe, keys=parent)
    for child, key, conds in flags:
        out = attach_flags(out, child_flags(child, key, conds), parent_key, key)
    return out.select(*projection) if projection is not None else out
