"""Named dashboard reports: compositions of breakdown, fold, order and share.

Each report is one lazy plan: filter → breakdown (one scan, one shuffle of
partial aggregates) → fold / order / share over every breakdown row; a top k
is cut last.
Parameters are column names and value lists, never domain names.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens.functions.bands import PART_OF_DAY, hour_band
from gradelens.functions.labels import fold_other_unknown, fold_lane_change
from gradelens.functions.numeric import pct_rounded, rate_band, sqrt_scaled
from gradelens.functions.predicates import Selection
from gradelens.operators import fold, ordering, outcome, shape
from gradelens.spec import OutcomeSpec

Mapper = Callable[[Column], Column]


def folded_breakdown(df: DataFrame, by: str, spec: OutcomeSpec, selection: Selection | None,
                     mapper: Mapper = fold_other_unknown, min_count: int = 0) -> DataFrame:
    """Every group of A1 (own field excluded) → A7 fold.  The minimum count applies before folding."""
    sel = (selection or Selection()).without(by)
    rows = outcome.breakdown_all(df, by, spec, sel, min_count=min_count)
    return fold.fold(rows, mapper, spec)


def both_folds(c: Column) -> Column:
    return fold_lane_change(fold_other_unknown(c))


def share_top(df, by, spec, selection, k=8, mapper: Mapper = fold_other_unknown):
    """Outcome share by area, top k: Other last; shares of every folded group."""
    folded = shape.with_share(shape.materialised(folded_breakdown(df, by, spec, selection, mapper)))
    return ordering.top_ranked(folded, ordering.other_last(ordering.by_total()), k)


def top_by(df, by, spec, selection, k, min_count, order: str = "total",
           mapper: Mapper = fold_other_unknown, other_last: bool = True):
    """Fold then top k by ``order`` (total or risk); ``Other`` last when asked."""
    folded = folded_breakdown(df, by, spec, selection, mapper, min_count)
    base = ordering.by_desc(order)
    order_cols = ordering.other_last(base) if other_last else base
    return ordering.top_ranked(folded, order_cols, k)


def leading(df, by, spec, selection, k=10, min_count=5, mapper: Mapper = both_folds):
    """Leading groups: both folds, top k by total with Other last, and
    square-root scaled level counts for the stacked bars (P29)."""
    rows = top_by(df, by, spec, selection, k, min_count, mapper=mapper)
    return rows.select("*", *sqrt_scaled(*spec.names))


def surface_band(df, by, spec, selection, k=6, min_count=5):
    """Top k by risk with the band between the two upper-level rates."""
    rows = top_by(df, by, spec, selection, k, min_count, order="risk", other_last=False)
    lo, hi = rate_band(f"{spec.top}_rate", f"{spec.second}_rate")
    return rows.select("*", lo.alias("band_lo"), hi.alias("band_hi"))


def class_breakdown(df, by, spec, selection, classifier: Mapper, min_count=5):
    """Vehicle-class style report: A1 (min count) → ordered regex classes → fold → Other last."""
    folded = folded_breakdown(df, by, spec, selection, classifier, min_count)
    return ordering.ranked(folded, ordering.other_last(ordering.by_total()))


def risk_extremes(df, by, spec, selection, k=8, min_count=5, mapper: Mapper = fold_other_unknown):
    """Top k folded groups (Other last) and the min / max risk among them."""
    rows = top_by(df, by, spec, selection, k, min_count, mapper=mapper)
    return fold.risk_range(rows)


def frequency_vs_rate(df, by, spec, selection, min_count=10, mapper: Mapper = fold_other_unknown):
    """Frequency vs top-level percent with the mean of the rounded percents."""
    return fold.frequency_vs_rate(folded_breakdown(df, by, spec, selection, mapper, min_count), spec)


def volume_lethality(df, by, spec, selection, min_count=5, mapper: Mapper = fold_other_unknown):
    """Fold, Other last, then the top-level rate relative to the mean of the rows."""
    folded = folded_breakdown(df, by, spec, selection, mapper, min_count)
    return shape.ratio_to_mean(folded, f"{spec.top}_rate")


def ordered_shares(df, by, spec, selection, order: Sequence[Column], exclude_own=True,
                   min_count=0):
    """A1 → explicit ordering (T4 / T5 / T9) → share of all groups."""
    sel = (selection or Selection())
    sel = sel.without(by) if exclude_own else sel
    rows = outcome.breakdown_all(df, by, spec, sel, min_count=min_count)
    return ordering.ranked(shape.with_share(shape.materialised(rows)), order)


def factor_bars(df, by, spec, selection, k=7, min_count=10):
    """Top k by risk, shares of the total of all groups (T6 + A16)."""
    rows = shape.with_share(outcome.breakdown_all(df, by, spec, (selection or Selection()).without(by), min_count))
    return ordering.top_ranked(rows, ordering.by_desc("risk"), k)


def part_of_day_share(df, hour: str, spec, selection):
    """Share by part of day: four fixed bands, zeros for absent bands (D1 + A16)."""
    src = df.withColumn("_part", hour_band(F.col(hour)))
    rows = outcome.breakdown_all(src, "_part", spec, selection)
    cells = df.sparkSession.createDataFrame([(p,) for p in PART_OF_DAY], "key string")
    dense = shape.dense(rows, cells, ["key"], ["total", *spec.names])
    return shape.with_share(dense)


def hourly_rates(df, hour: str, spec, selection, digits: int = 1):
    """Rates by hour: 24 rows, hour range dropped, percents rounded to one digit (A1 + D1)."""
    sel = (selection or Selection()).without(drop_ranges=(hour,))
    rows = outcome.breakdown_all(df, hour, spec, sel, as_text=False)
    cells = df.sparkSession.range(24).select(F.col("id").cast(df.schema[hour].dataType).alias("key"))
    dense = shape.dense(rows, cells, ["key"], ["total", *spec.names])
    return dense.select("key", "total",
                        pct_rounded(spec.top, "total", digits).alias(f"{spec.top}_pct"),
                        pct_rounded(spec.second, "total", digits).alias(f"{spec.second}_pct"))


def weekday_counts(df, day: str, spec, selection, days: Sequence[str]):
    """Counts by weekday in calendar order, zeros for absent days (A1 + D1 + T5)."""
    rows = outcome.breakdown_all(df, day, spec, (selection or Selection()).without(day))
    cells = df.sparkSession.createDataFrame([(d,) for d in days], "key string")
    dense = shape.dense(rows, cells, ["key"], ["total", *spec.names])
    return ordering.ranked_few(dense, ordering.listed(days))


def region_ranking(df, region: str, spec, selection, dim: DataFrame, dim_key: str, k: int = 5):
    """Region map / ranked list: every region of the dimension (J6) with its
    counts, share of the filtered total (A16), ratio of its top-level rate to
    the mean (A17) and its rank; ``k`` marks the top list (T7)."""
    rows = outcome.breakdown_all(df, region, spec, (selection or Selection()).without(region), as_text=False)
    shared = shape.with_share(shape.materialised(rows))
    rel = shape.ratio_to_mean(shared, f"{spec.top}_rate")
    ranked = ordering.ranked(rel, ordering.by_total())
    out = shape.attach(dim.select(F.col(dim_key).alias("key")).distinct(), ranked, "key")
    return out.withColumn("in_top", F.coalesce(F.col("pos") <= k, F.lit(False)))


def option_list(df, by, spec, preferred: Sequence | None = None, k: int = 3):
    """Quick-filter options: preferred values that occur, in the given order,
    else the top ``k`` by total; filters never apply (T10)."""
    rows = outcome.breakdown_all(df, by, spec)
    if preferred:
        kept = rows.filter(F.col("key").isin([str(v) for v in preferred]))
        return ordering.ranked_few(kept, ordering.listed([str(v) for v in preferred]))
    return ordering.top_ranked(rows, ordering.by_total(), k)


def region_options(df, region: str, exclude: str = r"(?i)^unknown"):
    """Region option list: distinct regions, excluding a pattern, sorted (T10 + U1)."""
    vals = df.select(F.col(region).cast("string").alias("key")).distinct()
    return ordering.ranked(ordering.exclude_prefix(vals, exclude), [F.asc_nulls_last("key")])


def scenario_regions(df, region: str, spec, selection):
    """Scenario region list: every region with its own field excluded, in the order of T1 (A1 + T1)."""
    rows = outcome.breakdown_all(df, region, spec, (selection or Selection()).without(region))
    return rows.orderBy(*ordering.by_total())
