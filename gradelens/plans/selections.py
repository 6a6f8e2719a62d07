"""Catalog: facet panels, selections as JSON data, codes that are no numbers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gradelens.functions.bands import number_band
from gradelens.functions.labels import decode_map
from gradelens.functions.predicates import Selection
from gradelens.operators import panel
from gradelens.plans import sqltext as S
from gradelens.plans import unify
from gradelens.plans.registry import register
from gradelens.plans.tables import LINE_ORDERS_SQL, LINE_OUTCOME, line_orders, table

LO = LINE_OUTCOME

PANEL_SELECTION = Selection({"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "l_linestatus": ["O"], "l_linenumber": ["1", "2", "3", "4"],
                             "o_orderstatus": ["O", "P"], "l_tax": ["0.01", "0.02", "0.03", "0.04", "0.05"]},
                            {"l_quantity": (5, 40), "l_suppkey": (2, 80)})
# five facets on value lists and two on ranges, each without its own filter
PANEL_FACETS = {f: (f,) for f in ("o_orderpriority", "l_linestatus", "l_linenumber", "o_orderstatus", "l_tax", "l_quantity", "l_suppkey")}
_PANEL_CLAUSES = {
    "o_orderpriority": "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')", "l_linestatus": "l_linestatus IN ('O')",
    "l_linenumber": "l_linenumber IN (1, 2, 3, 4)", "o_orderstatus": "o_orderstatus IN ('O', 'P')",
    "l_tax": "l_tax IN (0.01, 0.02, 0.03, 0.04, 0.05)", "l_quantity": "l_quantity >= 5 AND l_quantity <= 40", "l_suppkey": "l_suppkey >= 2 AND l_suppkey <= 80",
}


def _panel_sql():
    parts = []
    for f in PANEL_FACETS:
        cond = " AND ".join(c for name, c in _PANEL_CLAUSES.items() if name != f)
        parts.append(f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS key, count(*) AS total, {S.level_counts(LO)} FROM src WHERE {cond} GROUP BY 2")
    return f"WITH src AS ({LINE_ORDERS_SQL}), p AS ({' UNION ALL '.join(parts)}) SELECT *, {S.rates(LO)} FROM p"


@register("facet_panel", _panel_sql())
def facet_panel(spark, sf):
    """Seven charts, each without its own filter, from one scan."""
    return panel.facet_panel(line_orders(spark, sf), PANEL_FACETS, LO, PANEL_SELECTION)


# (filter text, SQL condition or None, error or None)
SELECTIONS = [
    (json.dumps({"l_linestatus": [s], "l_linenumber": [str(n), n + 1]}), f"l_linestatus = '{s}' AND l_linenumber IN ({n}, {n + 1})", None)
    for s in ("O", "F") for n in range(1, 7)
] + [
    ("{}", "true", None), ("", "true", None), (None, "true", None),
    ('{"l_returnflag": ["R", "A"], "l_suppkey": ["7"]}', "l_returnflag IN ('R', 'A') AND l_suppkey = 7", None),
    ('{"l_linenumber": ["01"]}', "false", None),
    ('{"l_linenumber": [1', None, "filters must be a JSON object {field: [values]}"),
    ('{"l_nothing": [1]}', None, "unknown filter field 'l_nothing'"),
    ('{"l_linestatus": "O"}', None, "filter 'l_linestatus' needs a non-empty list"),
]


def _selections_sql():
    parts = []
    for i, (_, cond, error) in enumerate(SELECTIONS):
        if error is None:
            parts.append(f"SELECT {i} AS selection, CAST(NULL AS VARCHAR) AS error, l_shipmonth AS key, count(*) AS total, {S.level_counts(LO)} FROM src WHERE {cond} GROUP BY 3")
    rows = f"SELECT *, {S.rates(LO)} FROM ({' UNION ALL '.join(parts)})"
    zero = ", ".join(f"CAST(NULL AS BIGINT) AS {n}" for n in ("total", *LO.names)) + ", " + ", ".join(
        f"CAST(NULL AS DOUBLE) AS {n}" for n in (*(f"{x}_rate" for x in reversed(LO.names[1:])), "risk"))
    broken = " UNION ALL ".join(f"SELECT {i} AS selection, {S.q(e)} AS error, CAST(NULL AS VARCHAR) AS key, {zero}" for i, (_, _, e) in enumerate(SELECTIONS) if e)
    return f"WITH src AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem) {rows} UNION ALL {broken}"


@register("selection_breakdowns", _selections_sql())
def selection_breakdowns(spark, sf):
    """Twenty selections as JSON rows, three of them broken, in one scan."""
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(SELECTIONS)], "id int, filters string")
    df = table(spark, sf, "lineitem").withColumn("l_shipmonth", F.date_format("l_shipdate", "yyyy-MM"))
    return panel.breakdown_by_selection(df, rows, "l_shipmonth", LO)


_CODES = ("1", "2", "3", "4", "5", "0", "-1", "x", "M", "n/a", "?")
_TEXT_SQL = "CASE {k} % 13 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END"


def _code_text(key):
    expr = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(_CODES))):
        expr = F.when(key % 13 == i, F.lit(c)).otherwise(expr)
    return expr


@register("bad_codes", f"""
WITH t AS (SELECT p_partkey, {_TEXT_SQL.format(k='p_partkey')} AS skid, {_TEXT_SQL.format(k='(p_partkey // 3)')} AS leaving,
                  {_TEXT_SQL.format(k='(p_partkey // 5)')} AS hit, {_TEXT_SQL.format(k='(p_partkey // 7)')} AS vehicles FROM part),
n AS (SELECT p_partkey, TRY_CAST(skid AS INTEGER) AS s, TRY_CAST(leaving AS INTEGER) AS l, TRY_CAST(hit AS INTEGER) AS h, TRY_CAST(vehicles AS INTEGER) AS v FROM t)
SELECT p_partkey,
  CASE s WHEN 1 THEN 'Skidded' WHEN 2 THEN 'Skidded and overturned' WHEN 3 THEN 'Jackknifed' WHEN 4 THEN 'Jackknifed and overturned' WHEN 5 THEN 'Overturned'
    ELSE CASE WHEN l NOT IN (0, -1) THEN 'Left carriageway' WHEN s = -1 THEN 'Unknown' ELSE 'No abnormal movement' END END AS movement,
  CASE WHEN s IN (2, 4, 5) THEN 'Rollover' WHEN h NOT IN (0, -1) OR l NOT IN (0, -1) THEN 'Collision with roadside objects'
    WHEN v >= 2 THEN 'Vehicle with vehicle collision' ELSE 'Other' END AS collision,
  CASE s WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Unknown' END AS sex,
  CASE WHEN v < 0 THEN 'Unknown' WHEN v <= 2 THEN '0-2 yrs' WHEN v <= 5 THEN '3-5 yrs' ELSE 'Unknown' END AS age_band
FROM n
""")
def bad_codes(spark, sf):
    """Codes that are text, some of them no numbers, take the default labels."""
    pt = table(spark, sf, "part").select("p_partkey", _code_text(F.col("p_partkey")).alias("skid"), _code_text(F.expr("p_partkey div 3")).alias("leaving"),
                                         _code_text(F.expr("p_partkey div 5")).alias("hit"), _code_text(F.expr("p_partkey div 7")).alias("vehicles"))
    return pt.select("p_partkey", unify.vehicle_movement(F.col("skid"), F.col("leaving")).alias("movement"),
                     unify.type_of_collision(F.lit(0), F.col("skid"), F.col("leaving"), F.col("hit"), F.col("vehicles")).alias("collision"),
                     decode_map(unify.code(F.col("skid")), unify.SEX_CODES, "Unknown").alias("sex"), number_band("vehicles").alias("age_band"))
