"""Rule-based cleaning.

Each step is a projection or one aggregate; dataset-level values (medians,
the time-parse switch) are scalar subqueries evaluated once and broadcast as
constants, so no step collects data to the driver.
"""

from __future__ import annotations

import re
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelens.operators.stats import exact_medians
from gradelens.spec import count_when

from gradelens.functions.bands import hour_of_time_text
from gradelens.functions.labels import NULL_TOKENS, canonical

# Whitespace as Python's str.isspace() sees it (a run collapses to one space).
WHITESPACE_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
TRUE_TOKENS = ("True", "true", "1")
# The ends of BIGINT as doubles; the cast takes 2^63 as the largest BIGINT.
LONG_ENDS = (-2.0 ** 63, 2.0 ** 63)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def squish(col) -> Column:
    """Collapse whitespace runs to one space, then trim."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(c, WHITESPACE_CLASS, " "))


def trim_names(df: DataFrame) -> DataFrame:
    """Strip the column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def token_pattern(tokens: Sequence[str] = NULL_TOKENS) -> str:
    """Whole text that squishes to one of ``tokens`` (any case)."""
    alts = "|".join(re.escape(t) for t in tokens if t)
    ws = WHITESPACE_CLASS[:-1] + "*"
    return f"(?i)^{ws}({alts})?{ws}$"


def clean_text(df: DataFrame, columns: Sequence[str] | None = None,
               tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """P14 + P15 on string columns: squish, and texts that squish to a missing
    token become NULL.

    The token test is an anchored regex on the raw text (it fails at the
    first character that is neither whitespace nor part of a token), so the
    whitespace rewrite of long texts runs once per value.
    """
    cols = set(string_columns(df) if columns is None else columns)
    pat = token_pattern(tokens)

    def one(c):
        return F.when(F.col(c).rlike(pat), F.lit(None).cast("string")).otherwise(squish(c)).alias(c)
    return df.select(*[one(c) if c in cols else F.col(c) for c in df.columns])


def dedupe(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (count = rows in - rows out)."""
    return df.dropDuplicates()


def median_fill(df: DataFrame, cols: str | Sequence[str], fallback: float = 1.0,
                lower: float = 1.0) -> DataFrame:
    """P16 + P17: text → double (bad → NULL), NULL → median (or ``fallback``),
    clip at ``lower``, round half-even, integer; what a BIGINT cannot hold takes its nearest end.

    The numbers are projected once, all medians come from one pass over them
    and are applied in one projection.
    """
    names = [cols] if isinstance(cols, str) else list(cols)

    def number(c):
        v = F.col(c).cast("string").try_cast("double")
        return F.when(F.abs(v) < F.lit(float("inf")), v)         # infinite and NaN are bad values
    medians = exact_medians(df, {c: number(c) for c in names})

    def filled(c):
        v = F.coalesce(number(c), medians[c], F.lit(fallback))
        return F.bround(F.least(F.greatest(v, F.lit(lower), F.lit(LONG_ENDS[0])), F.lit(LONG_ENDS[1])), 0).cast("long").alias(c)
    return df.select(*[filled(c) if c in medians else F.col(c) for c in df.columns])


def fill_unknown(df: DataFrame, columns: Sequence[str] | None = None, value: str = "Unknown") -> DataFrame:
    """NULL categorical cells → ``value``."""
    cols = string_columns(df) if columns is None else list(columns)
    return df.fillna(value, subset=cols) if cols else df


def null_cells(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Number of NULL cells in ``columns`` as an aggregate expression (P18 count)."""
    cols = string_columns(df) if columns is None else list(columns)
    if not cols:
        return F.lit(0).cast("long")
    return sum((count_when(F.col(c).isNull()) for c in cols[1:]), count_when(F.col(cols[0]).isNull()))


def canonical_target(df: DataFrame, col: str, synonyms: Mapping[str, str]) -> DataFrame:
    """Target through the synonym map; rows without a mapping are dropped."""
    return df.withColumn(col, canonical(F.col(col), synonyms)).filter(F.col(col).isNotNull())


def derive_hour(df: DataFrame, time_col: str, out: str = "Hour", default: int = 12) -> DataFrame:
    """P20: hour from ``H:m:s`` text; only when *every* row fails, the leading
    one or two digits; NULL → rounded median (``default`` if none); clip 0-23."""
    parsed = hour_of_time_text(F.col(time_col))
    leading = F.regexp_extract(F.col(time_col).cast("string"), r"^\s*(\d{1,2})", 1).try_cast("int")
    # the switch and the median from one count per (hour, leading digits): at most 25 x 101 rows
    cells = df.groupBy(parsed.alias("p"), leading.alias("f")).agg(F.count(F.lit(1)).alias("c"))
    every = Window.partitionBy()
    cells = cells.withColumn("failed", F.max("p").over(every).isNull())
    cells = cells.withColumn("h", F.when(F.col("failed"), F.col("f")).otherwise(F.col("p"))).filter(F.col("h").isNotNull())
    upto = Window.orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("cum", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(every))
    facts = cells.agg(
        F.coalesce(F.max("failed"), F.lit(True)).alias("failed"),
        ((F.min(F.when(F.col("cum") > F.floor((F.col("n") - 1) / 2), F.col("h")))
          + F.min(F.when(F.col("cum") > F.floor(F.col("n") / 2), F.col("h")))) / F.lit(2.0)).alias("median")
    ).select(F.struct("failed", "median")).scalar()
    hour = F.when(facts.getField("failed"), leading).otherwise(parsed).cast("double")
    fill = F.coalesce(F.bround(facts.getField("median"), 0), F.lit(float(default)))  # half-even, like round() in Python
    h = F.least(F.greatest(F.coalesce(hour, fill), F.lit(0.0)), F.lit(23.0))
    return df.withColumn(out, h.cast("short"))


def parse_bool(col, true_tokens: Sequence[str] = TRUE_TOKENS) -> Column:
    """Text → boolean (listed tokens are true; anything else, NULL too, is false)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string").isin(list(true_tokens)), F.lit(False))


def compact(df: DataFrame, shorts: Sequence[str] = (), bools: Sequence[str] = ()) -> DataFrame:
    """Integer columns to SMALLINT (bad → 0), boolean text to BOOLEAN."""
    s, b = set(shorts), set(bools)
    return df.select(*[
        F.coalesce(F.col(c).cast("string").try_cast("double").try_cast("short"), F.lit(0).cast("short")).alias(c)
        if c in s else parse_bool(c).alias(c) if c in b else F.col(c)
        for c in df.columns])


def require(df: DataFrame, columns: Sequence[str], forbidden: Sequence[str] = ()) -> None:
    """Required columns present, no target-derived column among features."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    leaks = sorted(set(forbidden) & set(df.columns))
    if leaks:
        raise ValueError(f"refusing target-derived columns as features: {leaks}")


def clean_rows(df: DataFrame, target: str, synonyms: Mapping[str, str],
               numeric: Sequence[str] = (), drop_duplicates: bool = True) -> DataFrame:
    """The cleaning pass: squish + missing tokens (P14, P15) → exact
    de-duplication (A20) → median fill of ``numeric`` (P16, P17) → fill
    categorical NULLs (P18) → canonical target, unmappable rows dropped (P19)."""
    cats = [c for c in string_columns(df) if c not in numeric]
    stage = clean_text(trim_names(df))
    stage = dedupe(stage) if drop_duplicates else stage
    present = [c for c in numeric if c in stage.columns]
    if present:
        stage = median_fill(stage, present)
    cats = [c for c in cats if c in stage.columns]
    return canonical_target(fill_unknown(stage, cats), target, synonyms)


def clean_report(df: DataFrame, target: str, synonyms: Mapping[str, str],
                 numeric: Sequence[str] = (), drop_duplicates: bool = True) -> DataFrame:
    """Rows in, duplicates removed, categorical cells imputed, unmappable
    target rows dropped, rows out — one aggregate over the de-duplicated rows,
    each carrying its duplicate count (one scan, one shuffle): the steps after
    de-duplication change values, not the row count, until the target filter."""
    cats = [c for c in string_columns(df) if c not in numeric]
    stage1 = clean_text(trim_names(df))
    cats = [c for c in cats if c in stage1.columns]
    if drop_duplicates:
        grouped = stage1.groupBy(*stage1.columns).agg(F.count(F.lit(1)).alias("_dups"))
        kept = F.count(F.lit(1))
        per_row = F.lit(1)
        nulls = null_cells(grouped, cats)
    else:
        grouped = stage1.withColumn("_dups", F.lit(1).cast("long"))
        kept = F.sum("_dups")
        per_row = F.col("_dups")
        nulls = null_cells(grouped, cats)
    target_col = F.coalesce(F.col(target), F.lit("Unknown")) if target in cats else F.col(target)
    rows_out = F.coalesce(F.sum(F.when(canonical(target_col, synonyms).isNotNull(), per_row).otherwise(0)),
                          F.lit(0))
    rows_in = F.coalesce(F.sum("_dups"), F.lit(0))
    return grouped.agg(
        rows_in.cast("long").alias("rows_in"),
        (rows_in - kept).cast("long").alias("duplicates_removed"),
        nulls.cast("long").alias("categorical_cells_imputed"),
        (kept - rows_out).cast("long").alias("unmappable_target_rows_dropped"),
        rows_out.cast("long").alias("rows_out"))


def clean(df: DataFrame, target: str, synonyms: Mapping[str, str],
          numeric: Sequence[str] = (), drop_duplicates: bool = True):
    """``(clean_rows, clean_report)`` of the same input."""
    return (clean_rows(df, target, synonyms, numeric, drop_duplicates),
            clean_report(df, target, synonyms, numeric, drop_duplicates))


def derive(df: DataFrame, levels: Sequence[str], time_col: str = "Time", day_col: str = "Day_of_week",
           target: str = "Accident_severity") -> DataFrame:
    """Derived columns of a cleaned record: ``Hour`` (P20), ``Time_of_day``
    (P9, both night ends share one label), ``Is_weekend`` (P21) and
    ``Severity_rank`` (P22, position of the outcome in ``levels``)."""
    from gradelens.functions.bands import hour_band, ordinal, weekend_flag
    out = derive_hour(df, time_col, "Hour")
    return out.select("*", hour_band(F.col("Hour")).alias("Time_of_day"),
                      weekend_flag(F.col(day_col)).alias("Is_weekend"),
                      ordinal(F.col(target), levels).alias("Severity_rank"))
