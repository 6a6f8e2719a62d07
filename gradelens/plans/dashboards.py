"""Catalog: named dashboard reports over the test tables (folds, orders, shares, grids)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelens.functions.labels import classify, fold_matching
from gradelens.functions.numeric import pct_text
from gradelens.functions.predicates import Selection
from gradelens.operators import ordering, selection as selection_ops
from gradelens.plans import reports
from gradelens.plans import sqltext as S
from gradelens.plans.registry import register
from gradelens.plans.tables import (EVENT_OUTCOME, EVENTS_SQL, LINE_OUTCOME, LINE_PARTS_SQL,
                                    ORDER_NATIONS_SQL, ORDER_OUTCOME, WEEKDAYS, events, line_parts,
                                    order_nations, table)

LO, EO, OO = LINE_OUTCOME, EVENT_OUTCOME, ORDER_OUTCOME

# Test roles: part types standing in for labels folded into "Other".
TYPE_FOLD = r"^(promo|economy)$"
# Test roles: ordered class rules over part names (first match wins, \b matters).
PART_CLASS_RULES = (
    ("Fastener", r"\bbolt\b|\bring\b|\brod\b"),
    ("Mechanism", r"gear|gizmo|widget"),
    ("Heavy", r"\banvil\b"),
)


def type_fold(c):
    return fold_matching(c, TYPE_FOLD, "Other")


def part_class(c):
    return classify(c, PART_CLASS_RULES)


# -- SQL builders ------------------------------------------------------------------
def _rows_sql(src, key, spec, where="", min_count=0):
    having = f"HAVING count(*) >= {min_count}" if min_count > 0 else ""
    inner = (f"SELECT CAST({key} AS VARCHAR) AS key, count(*) AS total, {S.level_counts(spec)} "
             f"FROM ({src}) {where} GROUP BY 1 {having}")
    return f"SELECT * FROM ({inner}) ORDER BY total DESC, key ASC NULLS LAST"


def _fold_sql(rows_sql, mapper_sql, spec):
    sums = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in spec.names)
    return (f"SELECT key, CAST(sum(total) AS BIGINT) AS total, {sums} FROM ("
            f"SELECT {mapper_sql} AS key, total, {', '.join(spec.names)} FROM ({rows_sql})"
            f") WHERE key IS NOT NULL GROUP BY 1")


def _with_rates(sql, spec):
    return f"SELECT *, {S.rates(spec)} FROM ({sql})"


TYPE_FOLD_SQL = "CASE WHEN regexp_matches(key, '(?i)^(promo|economy)$') THEN 'Other' ELSE key END"
PART_CLASS_SQL = ("CASE WHEN regexp_matches(lower(key), '\\bbolt\\b|\\bring\\b|\\brod\\b') THEN 'Fastener' "
                  "WHEN regexp_matches(lower(key), 'gear|gizmo|widget') THEN 'Mechanism' "
                  "WHEN regexp_matches(lower(key), '\\banvil\\b') THEN 'Heavy' ELSE 'Other' END")
OTHER_LAST_SQL = "CASE WHEN key = 'Other' THEN 1 ELSE 0 END, total DESC, key ASC NULLS LAST"

_LP_F = "WHERE l_linestatus IN ('F')"
_LP_FT = "WHERE l_linestatus IN ('F') AND p_type IN ('SMALL')"
LINE_F = Selection({"l_linestatus": ["F"], "p_type": ["SMALL"]})


def _folded_types_sql(min_count=5, where=_LP_F, key="p_type", mapper=TYPE_FOLD_SQL):
    rows = _rows_sql(LINE_PARTS_SQL, key, LO, where, min_count)
    return _with_rates(_fold_sql(rows, mapper, LO), LO)


# -- folds -------------------------------------------------------------------------
@register("fold_breakdown", f"""
SELECT *, ROW_NUMBER() OVER (ORDER BY {OTHER_LAST_SQL}) AS pos FROM ({_folded_types_sql()})
""")
def fold_breakdown(spark, sf):
    """A1 (min 5) P26 A7 T3: part types with two folded into Other, Other last."""
    rows = reports.folded_breakdown(line_parts(spark, sf), "p_type", LO, LINE_F, type_fold, min_count=5)
    return ordering.ranked(rows, ordering.other_last(ordering.by_total()))


@register("fold_members", f"""
SELECT folded, array_to_string(list_sort(list_distinct(list(raw))), '|') AS members FROM (
  SELECT {TYPE_FOLD_SQL} AS folded, key AS raw FROM ({_rows_sql(LINE_PARTS_SQL, 'p_type', LO, _LP_F, 5)})
) WHERE folded IS NOT NULL GROUP BY 1
""")
def fold_members(spark, sf):
    """Folded key → its raw members (as text for the value hash)."""
    from gradelens.operators import fold, outcome
    rows = outcome.breakdown_all(line_parts(spark, sf), "p_type", LO, LINE_F.without("p_type"), min_count=5)
    m = fold.members(rows, type_fold)
    return m.select("folded", F.array_join("members", "|").alias("members"))


@register("fold_member_rows", f"""
SELECT DISTINCT {TYPE_FOLD_SQL} AS folded, key AS raw FROM ({_rows_sql(LINE_PARTS_SQL, 'p_type', LO, _LP_F, 5)}) WHERE key IS NOT NULL AND {TYPE_FOLD_SQL} IS NOT NULL
""")
def fold_member_rows(spark, sf):
    """Folded key and raw member, a row each."""
    from gradelens.operators import fold, outcome
    rows = outcome.breakdown_all(line_parts(spark, sf), "p_type", LO, LINE_F.without("p_type"), min_count=5)
    return fold.member_rows(rows, type_fold)


@register("class_breakdown", f"""
SELECT *, ROW_NUMBER() OVER (ORDER BY {OTHER_LAST_SQL}) AS pos
FROM ({_folded_types_sql(5, _LP_FT, 'p_name', PART_CLASS_SQL)})
""")
def class_breakdown(spark, sf):
    """A1 (min 5) P27 A7 T3: ordered regex classes over part names."""
    return reports.class_breakdown(line_parts(spark, sf), "p_name", LO, LINE_F, part_class)


@register("share_top", f"""
WITH f AS ({_folded_types_sql(0)})
SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY {OTHER_LAST_SQL}) AS pos,
         {S.ratio('total', '(SELECT sum(total) FROM f)')} AS share FROM f
) WHERE pos <= 3
""")
def share_top(spark, sf):
    """Top 3 folded groups, share of every group's total."""
    return reports.share_top(line_parts(spark, sf), "p_type", LO, LINE_F, k=3, mapper=type_fold)


@register("frequency_vs_rate", f"""
WITH f AS ({_folded_types_sql(10)}),
r AS (SELECT key, total, {S.round_ratio('high * 100', 'total', 2)} AS high_pct FROM f)
SELECT key, total, high_pct,
       CAST(sum(CAST(round(high_pct * 100) AS BIGINT)) OVER () AS DOUBLE) / (CAST(count(*) OVER () AS DOUBLE) * 100.0)
       AS mean_high_pct FROM r
""")
def frequency_vs_rate(spark, sf):
    """A1 (min 10) P26 A7 A18: total vs top-level percent and the mean percent."""
    return reports.frequency_vs_rate(line_parts(spark, sf), "p_type", LO, LINE_F, mapper=type_fold)


_BRAND_TOP8 = f"""
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {OTHER_LAST_SQL}) AS pos
               FROM ({_folded_types_sql(5, _LP_FT, 'p_brand', TYPE_FOLD_SQL)})) WHERE pos <= 8
"""


@register("risk_extremes", f"SELECT min(risk) AS min_risk, max(risk) AS max_risk FROM ({_BRAND_TOP8})")
def risk_extremes(spark, sf):
    """A1 (min 5) A7 T3 A19: min / max risk of the top 8 brands."""
    return reports.risk_extremes(line_parts(spark, sf), "p_brand", LO, LINE_F, mapper=type_fold)


@register("surface_band", f"""
SELECT *, least(high_rate, mid_rate) AS band_lo, greatest(high_rate, mid_rate) AS band_hi FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY risk DESC, key ASC NULLS LAST) AS pos
  FROM ({_folded_types_sql(5, _LP_FT, 'p_brand', TYPE_FOLD_SQL)})
) WHERE pos <= 6
""")
def surface_band(spark, sf):
    """A1 (min 5) A7 T6 P29: top 6 brands by risk, band of the two upper rates."""
    return reports.surface_band(line_parts(spark, sf), "p_brand", LO, LINE_F)


def _ratio_to_mean_sql(src, col):
    return f"""
WITH base AS ({src}),
st AS (SELECT avg({col}) AS m, max({col}) AS mx, min({col}) AS mn FROM base),
h AS (SELECT m, greatest(mx / m - 1, 1 - mn / m, 0.5) AS half FROM st)
SELECT base.*, {col} / (SELECT m FROM h) AS ratio,
       greatest(0.0, 1 - (SELECT half FROM h)) * (SELECT m FROM h) AS domain_lo,
       (1 + (SELECT half FROM h)) * (SELECT m FROM h) AS domain_hi
FROM base
"""


@register("ratio_to_mean", _ratio_to_mean_sql(_folded_types_sql(5, _LP_FT, 'p_brand', TYPE_FOLD_SQL), "high_rate"))
def ratio_to_mean(spark, sf):
    """A1 (min 5) A7 A17: each brand's top-level rate against the mean of the brands."""
    return reports.volume_lethality(line_parts(spark, sf), "p_brand", LO, LINE_F, mapper=type_fold)


# -- explicit orders and shares ------------------------------------------------------
def _prio_label():
    return (F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("Unknown"))
             .when(F.col("o_orderpriority") == "5-LOW", F.lit("Other (low)"))
             .otherwise(F.col("o_orderpriority")))
_PRIO_LABEL_SQL = ("CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'Unknown' WHEN '5-LOW' THEN 'Other (low)' "
                   "ELSE o_orderpriority END")


def _shares_sql(rows_sql, order_sql):
    return f"""
WITH r AS (SELECT *, {S.rates(OO)} FROM ({rows_sql}))
SELECT *, ROW_NUMBER() OVER (ORDER BY {order_sql}) AS pos,
       {S.ratio('total', '(SELECT sum(total) FROM r)')} AS share FROM r
"""


@register("unknown_last", _shares_sql(
    _rows_sql(f"SELECT *, {_PRIO_LABEL_SQL} AS prio_label FROM orders", "prio_label", OO),
    "CASE WHEN regexp_matches(trim(key), '(?i)^(unknown|other)') THEN 1 ELSE 0 END, total DESC, key ASC NULLS LAST"))
def unknown_last(spark, sf):
    """Labels starting with unknown / other sorted last, with shares."""
    od = table(spark, sf, "orders").withColumn("prio_label", _prio_label())
    return reports.ordered_shares(od, "prio_label", OO, None, ordering.unknown_last(ordering.by_total()))


CUSTOM_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]


@register("custom_order", _shares_sql(
    _rows_sql("SELECT * FROM orders", "o_orderpriority", OO,
              "WHERE o_orderpriority IN ('1-URGENT', '5-LOW', '4-NOT SPECIFIED', '3-MEDIUM')"),
    "CASE key WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 "
    "ELSE 5 END, total DESC, key ASC NULLS LAST"))
def custom_order(spark, sf):
    """Fixed order, unlisted last; keeps its own field's filter."""
    sel = Selection({"o_orderpriority": ["1-URGENT", "5-LOW", "4-NOT SPECIFIED", "3-MEDIUM"]})
    return reports.ordered_shares(table(spark, sf, "orders"), "o_orderpriority", OO, sel,
                                  ordering.listed(CUSTOM_ORDER, ordering.by_total()), exclude_own=False)


AGE_BANDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("age_band_rates", _shares_sql(
    _rows_sql("SELECT * FROM orders", "o_orderpriority", OO, "WHERE o_orderstatus IN ('F', 'O')"),
    "CASE key WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 ELSE 6 END"))
def age_band_rates(spark, sf):
    """Bands in their fixed order, without the bands' own filter."""
    sel = Selection({"o_orderpriority": ["1-URGENT"], "o_orderstatus": ["F", "O"]})
    return reports.ordered_shares(table(spark, sf, "orders"), "o_orderpriority", OO, sel, ordering.listed(AGE_BANDS))


@register("surface_order", _shares_sql(
    _rows_sql(f"SELECT *, {_PRIO_LABEL_SQL} AS prio_label FROM orders", "prio_label", OO, "WHERE o_orderstatus IN ('F', 'P')"),
    "CASE WHEN regexp_matches(trim(key), '(?i)^(unknown|other)') THEN 1 ELSE 0 END, total DESC, key ASC NULLS LAST"))
def surface_order(spark, sf):
    """A1 (min 1) T4 A16: the query's order (largest first), unknown last, with its own filter left out."""
    od = table(spark, sf, "orders").withColumn("prio_label", _prio_label())
    sel = Selection({"o_orderstatus": ["F", "P"], "prio_label": ["1-URGENT"]})
    return reports.ordered_shares(od, "prio_label", OO, sel, ordering.unknown_last(ordering.by_total()), min_count=1)


@register("percent_texts", """
WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN -1.0 * p_size WHEN 2 THEN NULL WHEN 3 THEN p_size * 1.0
                       WHEN 4 THEN p_size / 64.0 ELSE p_size / 65536.0 END AS v FROM part)
SELECT p_partkey, CASE WHEN v IS NULL OR v <= 0 THEN '0' WHEN v >= 1 THEN fixed(v, 1) WHEN v >= 0.1 THEN fixed(v, 2)
       WHEN round(CAST(v AS DOUBLE), 3) = 0 THEN '<0.001' ELSE fixed(v, 3) END AS shown FROM t
""".replace("fixed(v, 1)", "regexp_replace(regexp_replace(printf('%.1f', round(CAST(v AS DOUBLE), 1)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')")
   .replace("fixed(v, 2)", "regexp_replace(regexp_replace(printf('%.2f', round(CAST(v AS DOUBLE), 2)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')")
   .replace("fixed(v, 3)", "regexp_replace(regexp_replace(printf('%.3f', round(CAST(v AS DOUBLE), 3)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"))
def percent_texts(spark, sf):
    """Adaptive percent texts of positive, zero, negative and missing shares."""
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("double")
    v = (F.when(k == 0, 0.0).when(k == 1, -size).when(k == 2, F.lit(None).cast("double")).when(k == 3, size).when(k == 4, size / 64).otherwise(size / 65536))
    return table(spark, sf, "part").select("p_partkey", pct_text(v).alias("shown"))


@register("numeric_key_order", f"""
WITH r AS (SELECT *, {S.rates(LO)} FROM ({_rows_sql(LINE_PARTS_SQL, 'p_size', LO, _LP_FT)}))
SELECT *, ROW_NUMBER() OVER (ORDER BY TRY_CAST(key AS BIGINT) ASC NULLS LAST, key ASC NULLS LAST) AS pos,
       {S.ratio('total', '(SELECT sum(total) FROM r)')} AS share FROM r
""")
def numeric_key_order(spark, sf):
    """Text keys ordered by their integer value."""
    return reports.ordered_shares(line_parts(spark, sf), "p_size", LO, LINE_F, ordering.numeric_key())


@register("factor_bars", f"""
WITH r AS (SELECT *, {S.rates(LO)} FROM ({_rows_sql(LINE_PARTS_SQL, 'p_size', LO, _LP_FT, 10)}))
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY risk DESC, key ASC NULLS LAST) AS pos,
       {S.ratio('total', '(SELECT sum(total) FROM r)')} AS share FROM r) WHERE pos <= 7
""")
def factor_bars(spark, sf):
    """A1 (min 10) T6 A16: top 7 by risk, shares of the total of all groups."""
    return reports.factor_bars(line_parts(spark, sf), "p_size", LO, LINE_F)


@register("option_list", f"""
SELECT * FROM (SELECT *, {S.rates(OO)}, ROW_NUMBER() OVER (ORDER BY total DESC, key ASC NULLS LAST) AS pos
               FROM ({_rows_sql('SELECT * FROM orders', 'o_orderpriority', OO)})) WHERE pos <= 3
""")
def option_list(spark, sf):
    """Quick-filter options, top 3 by total, no filters."""
    return reports.option_list(table(spark, sf, "orders"), "o_orderpriority", OO)


@register("option_list_preferred", f"""
SELECT *, {S.rates(OO)},
       ROW_NUMBER() OVER (ORDER BY CASE key WHEN '3-MEDIUM' THEN 1 WHEN '9-NONE' THEN 2 WHEN '1-URGENT' THEN 3 END) AS pos
FROM ({_rows_sql('SELECT * FROM orders', 'o_orderpriority', OO)})
WHERE key IN ('3-MEDIUM', '9-NONE', '1-URGENT')
""")
def option_list_preferred(spark, sf):
    """Preferred values that occur, in the given order."""
    return reports.option_list(table(spark, sf, "orders"), "o_orderpriority", OO,
                               preferred=["3-MEDIUM", "9-NONE", "1-URGENT"])


@register("region_options", f"""
SELECT key, ROW_NUMBER() OVER (ORDER BY key ASC NULLS LAST) AS pos FROM (
  SELECT DISTINCT CAST(n_name AS VARCHAR) AS key FROM ({ORDER_NATIONS_SQL})
) WHERE NOT COALESCE(regexp_matches(key, '^NATION_1'), false)
""")
def region_options(spark, sf):
    """Distinct regions in use, a prefix excluded, sorted."""
    return reports.region_options(order_nations(spark, sf), "n_name", exclude=r"^NATION_1")


REGION_SEL = Selection({"n_name": ["NATION_3"], "n_regionkey": [0, 1], "o_orderpriority": ["1-URGENT", "2-HIGH"]})
_REGION_WHERE = "WHERE n_regionkey IN (0, 1) AND o_orderpriority IN ('1-URGENT', '2-HIGH')"


def _region_sql(top_only=False):
    rows = f"SELECT *, {S.rates(OO)} FROM ({_rows_sql(ORDER_NATIONS_SQL, 'n_name', OO, _REGION_WHERE)})"
    shared = f"SELECT *, {S.ratio('total', '(SELECT sum(total) FROM r0)')} AS share FROM r0"
    rel = _ratio_to_mean_sql(shared, "high_rate").replace("WITH base AS", "WITH r0 AS (" + rows + "), base AS", 1)
    ranked = f"SELECT *, ROW_NUMBER() OVER (ORDER BY total DESC, key ASC NULLS LAST) AS pos FROM ({rel})"
    out = f"""
SELECT d.key, g.total, g.low, g.mid, g.high, g.high_rate, g.mid_rate, g.risk, g.share, g.ratio,
       g.domain_lo, g.domain_hi, g.pos, COALESCE(g.pos <= 5, false) AS in_top
FROM (SELECT DISTINCT n_name AS key FROM nation) d LEFT JOIN ({ranked}) g ON d.key = g.key
"""
    return f"SELECT * FROM ({out}) WHERE in_top" if top_only else out


def _region(spark, sf):
    return reports.region_ranking(order_nations(spark, sf), "n_name", OO, REGION_SEL,
                                  table(spark, sf, "nation"), "n_name")


@register("region_share", _region_sql())
def region_share(spark, sf):
    """Every nation with counts, share, ratio to mean and rank."""
    return _region(spark, sf)


@register("region_top", _region_sql(top_only=True))
def region_top(spark, sf):
    """The top 5 nations of the ranking with their shares."""
    return _region(spark, sf).filter("in_top")


@register("scenario_regions", f"""
SELECT *, {S.rates(OO)} FROM ({_rows_sql(ORDER_NATIONS_SQL, 'n_name', OO, "WHERE o_orderpriority IN ('1-URGENT')", 0)})
""")
def scenario_regions(spark, sf):
    """Region list for a scenario, own field excluded."""
    sel = Selection({"n_name": ["NATION_2"], "o_orderpriority": ["1-URGENT"]})
    return reports.scenario_regions(order_nations(spark, sf), "n_name", OO, sel)


# -- event grids -----------------------------------------------------------------------
_PART_SQL = ("CASE WHEN hour BETWEEN 6 AND 11 THEN 'Morning (6-11)' WHEN hour BETWEEN 12 AND 16 THEN 'Afternoon (12-16)' "
             "WHEN hour BETWEEN 17 AND 20 THEN 'Evening (17-20)' ELSE 'Night (0-5)' END")


@register("part_of_day_share", f"""
WITH r AS (SELECT {_PART_SQL} AS key, count(*) AS total, {S.level_counts(EO)}
           FROM ({EVENTS_SQL}) WHERE event_type IN ('error', 'signup') AND k >= 0 AND k <= 10 GROUP BY 1),
g AS (SELECT * FROM (VALUES ('Morning (6-11)'), ('Afternoon (12-16)'), ('Evening (17-20)'), ('Night (0-5)')) t(key)),
d AS (SELECT g.key, CAST(COALESCE(total, 0) AS BIGINT) AS total, CAST(COALESCE(low, 0) AS BIGINT) AS low,
             CAST(COALESCE(mid, 0) AS BIGINT) AS mid, CAST(COALESCE(high, 0) AS BIGINT) AS high
      FROM g LEFT JOIN r ON g.key = r.key)
SELECT *, {S.ratio('total', '(SELECT sum(total) FROM d)')} AS share FROM d
""")
def part_of_day_share(spark, sf):
    """Four fixed part-of-day bands with zeros and shares."""
    sel = Selection({"event_type": ["error", "signup"]}, {"k": (0, 10)})
    return reports.part_of_day_share(events(spark, sf), "hour", EO, sel)


@register("hourly_rates", f"""
WITH r AS (SELECT hour AS key, count(*) AS total, {S.level_counts(EO)}
           FROM ({EVENTS_SQL}) WHERE day_of_week IN ('Sunday') AND k >= 0 AND k <= 20 GROUP BY 1),
d AS (SELECT g.key, CAST(COALESCE(total, 0) AS BIGINT) AS total, CAST(COALESCE(high, 0) AS BIGINT) AS high,
             CAST(COALESCE(mid, 0) AS BIGINT) AS mid
      FROM (SELECT CAST(range AS INTEGER) AS key FROM range(24)) g LEFT JOIN r ON g.key = r.key)
SELECT key, total, {S.pct('high', 'total', 1)} AS high_pct, {S.pct('mid', 'total', 1)} AS mid_pct FROM d
""")
def hourly_rates(spark, sf):
    """24 hours with percents to one digit; the hour range is dropped."""
    sel = Selection({"day_of_week": ["Sunday"]}, {"hour": (5, 9), "k": (0, 20)})
    return reports.hourly_rates(events(spark, sf), "hour", EO, sel)


@register("weekday_counts", f"""
WITH r AS (SELECT day_of_week AS key, count(*) AS total, {S.level_counts(EO)}
           FROM ({EVENTS_SQL}) WHERE event_type IN ('error') AND k >= 0 AND k <= 2 GROUP BY 1),
d AS (SELECT g.key, g.o, CAST(COALESCE(total, 0) AS BIGINT) AS total, CAST(COALESCE(low, 0) AS BIGINT) AS low,
             CAST(COALESCE(mid, 0) AS BIGINT) AS mid, CAST(COALESCE(high, 0) AS BIGINT) AS high
      FROM (VALUES ('Monday', 1), ('Tuesday', 2), ('Wednesday', 3), ('Thursday', 4), ('Friday', 5),
                   ('Saturday', 6), ('Sunday', 7)) g(key, o) LEFT JOIN r ON g.key = r.key)
SELECT key, total, low, mid, high, ROW_NUMBER() OVER (ORDER BY o) AS pos FROM d
""")
def weekday_counts(spark, sf):
    """Counts by weekday, Monday first, zeros for absent days."""
    sel = Selection({"day_of_week": ["Friday"], "event_type": ["error"]}, {"k": (0, 2)})
    return reports.weekday_counts(events(spark, sf), "day_of_week", EO, sel, WEEKDAYS)


# -- selections across tables ---------------------------------------------------------
SURVIVE = {"l_returnflag": ["A", "R", "Z"], "l_linestatus": ["F", "X"], "l_linenumber": ["1", "7", "9", "x"],
           "o_orderpriority": ["1-URGENT"]}


@register("surviving_filters", """
SELECT DISTINCT field, value FROM (
  SELECT 'l_returnflag' AS field, CAST(l_returnflag AS VARCHAR) AS value FROM lineitem WHERE l_returnflag IN ('A', 'R', 'Z')
  UNION ALL SELECT 'l_linestatus', CAST(l_linestatus AS VARCHAR) FROM lineitem WHERE l_linestatus IN ('F', 'X')
  UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_linenumber IN (1, 7, 9)
)
""")
def surviving_filters(spark, sf):
    """Selected values that still exist in lineitem (unknown fields drop)."""
    return selection_ops.surviving(SURVIVE, table(spark, sf, "lineitem"))


@register("distinct_sorted", """
SELECT DISTINCT p_brand FROM part
""")
def distinct_sorted(spark, sf):
    """Distinct brands in ascending order."""
    pt = table(spark, sf, "part")
    return selection_ops.distinct_sorted(pt, "p_brand")


# -- named reports with the fixed folds -------------------------------------------------
_BOTH_FOLDS_SQL = (
    "CASE WHEN regexp_matches(k1, '(?i)^changing lane to the (left|right)$') THEN 'Lane change' ELSE k1 END")
_OTHER_UNKNOWN_SQL = (
    "CASE WHEN regexp_matches(key, '(?i)^(other|others|unknown|not known|unknown \\(self reported\\)"
    "|unknown vehicle type \\(self rep only\\)|rural village areasoffice areas)$') THEN 'Other' ELSE key END")


def _both_folds_sql():
    return _BOTH_FOLDS_SQL.replace("k1", f"({_OTHER_UNKNOWN_SQL})")


@register("leading_causes", f"""
SELECT *, sqrt(low) AS low_disp, sqrt(mid) AS mid_disp, sqrt(high) AS high_disp FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY {OTHER_LAST_SQL}) AS pos
  FROM ({_folded_types_sql(5, _LP_FT, 'p_brand', _both_folds_sql())})) WHERE pos <= 10
""")
def leading_causes(spark, sf):
    """A1 (min 5) P26 (both fixed folds) A7 T3 P29: top 10 by total, Other last, sqrt-scaled counts."""
    return reports.leading(line_parts(spark, sf), "p_brand", LO, LINE_F)


@register("area_risk", f"""
SELECT *, ROW_NUMBER() OVER (ORDER BY CASE WHEN key = 'Other' THEN 1 ELSE 0 END, risk DESC, key ASC NULLS LAST) AS pos
FROM ({_folded_types_sql(1, _LP_F, 'p_type', TYPE_FOLD_SQL)})
""")
def area_risk(spark, sf):
    """A1 (min 1) A7 T3: every folded group ranked by risk, Other last."""
    rows = reports.folded_breakdown(line_parts(spark, sf), "p_type", LO, LINE_F, type_fold, min_count=1)
    return ordering.ranked(rows, ordering.other_last(ordering.by_desc("risk")))


@register("share_ranking", f"""
WITH r AS (SELECT *, {S.rates(OO)} FROM ({_rows_sql('SELECT * FROM orders', 'o_orderpriority', OO,
                                                   "WHERE o_orderstatus IN ('F', 'O')", 1)}))
SELECT *, {S.ratio('total', '(SELECT sum(total) FROM r)')} AS share,
       ROW_NUMBER() OVER (ORDER BY total DESC, key ASC NULLS LAST) AS pos FROM r
""")
def share_ranking(spark, sf):
    """A1 (min 1) A16: groups ranked by their share of the selection."""
    sel = Selection({"o_orderpriority": ["1-URGENT"], "o_orderstatus": ["F", "O"]})
    return reports.ordered_shares(table(spark, sf, "orders"), "o_orderpriority", OO, sel,
                                  [F.desc("share"), F.asc_nulls_last("key")], min_count=1)


@register("lane_types", f"""
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {OTHER_LAST_SQL}) AS pos
               FROM ({_folded_types_sql(5, _LP_F, 'p_type', TYPE_FOLD_SQL)})) WHERE pos <= 6
""")
def lane_types(spark, sf):
    """A1 (min 5) A7 T3: top 6 folded groups by total, Other sorted last before the cut."""
    return reports.top_by(line_parts(spark, sf), "p_type", LO, LINE_F, 6, 5, mapper=type_fold)
