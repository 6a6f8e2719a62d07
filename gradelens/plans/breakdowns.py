"""Catalog: outcome breakdowns, KPIs, matrices, condition lift, association.

Roles follow FIXTURES §3: ``lineitem.l_returnflag`` (N < A < R) and the
``events`` outcome (view/click/signup < purchase < error) with hour and
weekday taken from ``events.ts``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelens.functions.predicates import Selection
from gradelens.operators import association, outcome, shape
from gradelens.plans import sqltext as S
from gradelens.plans.registry import register
from gradelens.plans.tables import (EVENT_OUTCOME, EVENTS_SQL, LINE_ORDERS_SQL, LINE_OUTCOME,
                                    WEEKDAYS, events, line_orders, table)

LO = LINE_OUTCOME
EO = EVENT_OUTCOME

# -- A1 flagship -----------------------------------------------------------------
FLAGSHIP_SELECTION = Selection({"l_linestatus": ["F"]})

FLAGSHIP_SQL = f"""
SELECT key, total, low, mid, high, {S.rates(LO)} FROM (
  SELECT CAST(l_linenumber AS VARCHAR) AS key, count(*) AS total, {S.level_counts(LO)}
  FROM lineitem WHERE l_linestatus IN ('F')
  GROUP BY 1 HAVING count(*) >= 1
) ORDER BY total DESC, key ASC NULLS LAST LIMIT 200
"""


@register("outcome_breakdown", FLAGSHIP_SQL)
def outcome_breakdown(spark, sf):
    """Outcome by line number over open/closed status."""
    return outcome.breakdown(table(spark, sf, "lineitem"), "l_linenumber", LO,
                             FLAGSHIP_SELECTION, min_count=1, limit=200)


@register("outcome_breakdown_range", f"""
WITH ev AS ({EVENTS_SQL})
SELECT key, total, low, mid, high, {S.rates(EO)} FROM (
  SELECT CAST(hour AS VARCHAR) AS key, count(*) AS total, {S.level_counts(EO)}
  FROM ev WHERE day_of_week IN ('Monday', 'Friday', 'Saturday') AND hour >= 6 AND hour <= 20
  GROUP BY 1
) ORDER BY total DESC, key ASC NULLS LAST LIMIT 200
""")
def outcome_breakdown_range(spark, sf):
    """Value lists OR-ed inside a field plus a closed hour range."""
    sel = Selection({"day_of_week": ["Monday", "Friday", "Saturday"]}, {"hour": (6, 20), "year": (2000, None)})
    return outcome.breakdown(events(spark, sf), "hour", EO, sel)


FACET_SELECTION = Selection({"o_orderpriority": ["1-URGENT", "2-HIGH"], "l_linestatus": ["O"],
                             "l_linenumber": ["1", "2", 3]})


@register("facet_breakdown", f"""
SELECT key, total, low, mid, high, {S.rates(LO)} FROM (
  SELECT CAST(o_orderpriority AS VARCHAR) AS key, count(*) AS total, {S.level_counts(LO)}
  FROM ({LINE_ORDERS_SQL}) WHERE l_linestatus IN ('O') AND l_linenumber IN (1, 2, 3)
  GROUP BY 1
) ORDER BY total DESC, key ASC NULLS LAST LIMIT 200
""")
def facet_breakdown(spark, sf):
    """A chart on a filtered field drops its own filter (facet self-exclusion)."""
    df = line_orders(spark, sf)
    return outcome.breakdown(df, "o_orderpriority", LO, FACET_SELECTION.without("o_orderpriority"))


KPI_DAYS = ["Monday", "Tuesday", "Saturday", "Sunday"]


@register("kpis", f"""
WITH ev AS ({EVENTS_SQL}),
s AS (SELECT * FROM ev WHERE day_of_week IN ('Monday', 'Tuesday', 'Saturday', 'Sunday')),
per AS (SELECT hour AS h, count(*) AS n, sum(CAST(k AS BIGINT)) AS m_sum, count(k) AS m_cnt,
               count(*) FILTER (WHERE is_weekend) AS wk, {S.level_counts(EO)}
        FROM s GROUP BY hour),
one AS (SELECT CAST(COALESCE(sum(n), 0) AS BIGINT) AS total, CAST(COALESCE(sum(m_sum), 0) AS BIGINT) AS m_sum,
               CAST(COALESCE(sum(m_cnt), 0) AS BIGINT) AS m_cnt, CAST(COALESCE(sum(wk), 0) AS BIGINT) AS wk,
               CAST(COALESCE(sum(low), 0) AS BIGINT) AS low, CAST(COALESCE(sum(mid), 0) AS BIGINT) AS mid,
               CAST(COALESCE(sum(high), 0) AS BIGINT) AS high,
               (SELECT h FROM per ORDER BY n DESC, h ASC LIMIT 1) AS peak_hour
        FROM per)
SELECT total, {S.pct('high', 'total', 2)} AS high_pct, {S.pct('mid', 'total', 2)} AS mid_pct,
       {S.round_ratio('m_sum', 'm_cnt', 2)} AS avg_k, {S.pct('wk', 'total', 2)} AS weekend_pct,
       peak_hour, low, mid, high
FROM one
""")
def kpis(spark, sf):
    """Headline numbers of a selection in one scan."""
    return outcome.kpis(events(spark, sf), EO, "k", "is_weekend", "hour",
                        Selection({"day_of_week": KPI_DAYS}))


MATRIX_SELECTION = Selection({"day_of_week": ["Monday"], "event_type": ["view", "purchase", "error", "click"]},
                             {"hour": (8, 18)})


@register("outcome_matrix", f"""
WITH ev AS ({EVENTS_SQL})
SELECT day_of_week AS x, hour AS y, count(*) AS total,
       count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'mid') AS mid
FROM ev WHERE event_type IN ('view', 'purchase', 'error', 'click')
GROUP BY 1, 2
""")
def outcome_matrix(spark, sf):
    """A3 + P3: day x hour heatmap; drops its own day filter and the hour range."""
    sel = MATRIX_SELECTION.without("day_of_week", drop_ranges=("hour",))
    return outcome.matrix(events(spark, sf), "day_of_week", "hour", EO, sel)


def _sparse_matrix(spark, sf):
    sel = Selection({"event_type": ["error", "purchase"]}, {"k": (0, 3)})
    return outcome.matrix(events(spark, sf), "day_of_week", "hour", EO, sel)


_GRID_SQL = """
  SELECT d.x, h.y FROM (VALUES ('Monday'), ('Tuesday'), ('Wednesday'), ('Thursday'), ('Friday'),
                               ('Saturday'), ('Sunday')) d(x),
                       (SELECT CAST(range AS INTEGER) AS y FROM range(24)) h
"""
_SPARSE_SQL = f"""
  SELECT day_of_week AS x, hour AS y, count(*) AS total,
         count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'mid') AS mid
  FROM ({EVENTS_SQL}) WHERE event_type IN ('error', 'purchase') AND k >= 0 AND k <= 3 GROUP BY 1, 2
"""


@register("dense_matrix", f"""
SELECT g.x, g.y, COALESCE(m.total, 0) AS total, COALESCE(m.high, 0) AS high, COALESCE(m.mid, 0) AS mid
FROM ({_GRID_SQL}) g LEFT JOIN ({_SPARSE_SQL}) m ON g.x = m.x AND g.y = m.y
""")
def dense_matrix(spark, sf):
    """Full 7 x 24 grid with zeros for empty cells."""
    cells = shape.grid(spark, WEEKDAYS, list(range(24)))
    return shape.dense(_sparse_matrix(spark, sf), cells, ["x", "y"], ["total", "high", "mid"])


@register("matrix_wide", f"""
WITH d AS (
  SELECT g.x, g.y, COALESCE(m.total, 0) AS total
  FROM ({_GRID_SQL}) g LEFT JOIN ({_SPARSE_SQL}) m ON g.x = m.x AND g.y = m.y)
SELECT x, {", ".join(f"CAST(sum(CASE WHEN y = {h} THEN total ELSE 0 END) AS BIGINT) AS h{h}" for h in range(24))}
FROM d GROUP BY x
""")
def matrix_wide(spark, sf):
    """The dense matrix with one column per hour."""
    cells = shape.grid(spark, WEEKDAYS, list(range(24)))
    d = shape.dense(_sparse_matrix(spark, sf), cells, ["x", "y"], ["total"])
    return shape.wide(d, "x", "y", "total", list(range(24)), prefix="h")


def line_conditions():
    """P5: named conditions over lineitem joined to orders."""
    return {
        "Urgent": F.col("o_orderpriority").startswith("1-"),
        "High or urgent": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        "Bulk": F.col("l_quantity") >= 40,
        "Open line": F.col("l_linestatus") == "O",
        "Taxed or filled": (F.col("l_tax") >= 0.06) | (F.col("o_orderstatus") == "F"),
        "First line": F.col("l_linenumber") == 1,
    }


_LINE_CONDITIONS_SQL = [
    ("Urgent", "o_orderpriority LIKE '1-%'"),
    ("High or urgent", "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("Bulk", "l_quantity >= 40"),
    ("Open line", "l_linestatus = 'O'"),
    ("Taxed or filled", "(l_tax >= 0.06 OR o_orderstatus = 'F')"),
    ("First line", "l_linenumber = 1"),
]


def _lift_sql():
    sev = "l_returnflag <> 'N'"
    aggs = ["count(*) AS base_n", f"count(*) FILTER (WHERE {sev}) AS base_severe"]
    for i, (_, c) in enumerate(_LINE_CONDITIONS_SQL):
        aggs.append(f"count(*) FILTER (WHERE {c}) AS n{i}")
        aggs.append(f"count(*) FILTER (WHERE ({c}) AND {sev}) AS s{i}")
    rows = " UNION ALL ".join(
        f"SELECT {i} AS ordinal, {S.q(name)} AS axis, n{i} AS n, s{i} AS severe, base_n, base_severe FROM one"
        for i, (name, _) in enumerate(_LINE_CONDITIONS_SQL))
    return f"""
WITH one AS (SELECT {", ".join(aggs)} FROM ({LINE_ORDERS_SQL}) WHERE o_orderstatus IN ('F', 'O')),
r AS ({rows})
SELECT ordinal, axis, n, severe, {S.pct('severe', 'n', 1)} AS value, {S.pct('base_severe', 'base_n', 1)} AS baseline
FROM r
"""


@register("condition_lift", _lift_sql())
def condition_lift(spark, sf):
    """Percent of non-base outcomes under six conditions vs baseline, one scan."""
    return outcome.condition_lift(line_orders(spark, sf), LO, line_conditions(),
                                  Selection({"o_orderstatus": ["F", "O"]}))


ASSOC_FIELDS = ["l_linestatus", "l_linenumber", "l_tax", "l_quantity", "l_suppkey"]


def _assoc_sql(fields, spec, src="lineitem"):
    L = len(spec.levels)
    casts = ", ".join(f"CAST({f} AS VARCHAR) AS f{i}" for i, f in enumerate(fields))
    long = " UNION ALL ".join(f"SELECT {S.q(f)} AS field, f{i} AS value, o FROM src" for i, f in enumerate(fields))
    cs = ", ".join(f"count(*) FILTER (WHERE o = {S.q(lv)}) AS c{i}" for i, lv in enumerate(spec.levels))
    ts = ", ".join(f"sum(c{i}) AS t{i}" for i in range(L))
    n = " + ".join(f"t{i}" for i in range(L))
    rt = " + ".join(f"c{i}" for i in range(L))
    terms = []
    for i in range(L):
        e = f"(CAST(rt AS DOUBLE) * CAST(t{i} AS DOUBLE) / CAST(n AS DOUBLE))"
        terms.append(f"(CASE WHEN n > 0 AND {e} > 0 THEN (c{i} - {e}) * (c{i} - {e}) / {e} ELSE 0.0 END)")
    k = f"least(r, {L})"
    return f"""
WITH src AS (SELECT {spec.column} AS o, {casts} FROM {src}),
long AS ({long}),
cells AS (SELECT field, value, {cs} FROM long GROUP BY field, value),
m AS (SELECT field, count(*) AS r, {ts} FROM cells GROUP BY field),
j AS (SELECT cells.*, r, {", ".join(f"t{i}" for i in range(L))}, {n} AS n, {rt} AS rt FROM cells JOIN m USING (field)),
t AS (SELECT field, r, n, 0.0 + {" + ".join(terms)} AS term FROM j),
f AS (SELECT field, sum(term) AS chi2, max(r) AS r, max(n) AS n FROM t GROUP BY field)
SELECT field, round(CASE WHEN n = 0 OR r < 2 OR n * ({k} - 1) <= 0 THEN 0.0
                         ELSE least(1.0, sqrt(chi2 / (CAST(n AS DOUBLE) * ({k} - 1)))) END, 4) AS v
FROM f ORDER BY v DESC, field
"""


@register("association", _assoc_sql(ASSOC_FIELDS, LO))
def association_ranking(spark, sf):
    """Cramér's V of five fields vs the outcome, one scan."""
    return association.cramers_v(table(spark, sf, "lineitem"), ASSOC_FIELDS, LO)


@register("contingency", f"""
WITH src AS (SELECT l_returnflag AS o, {", ".join(f"CAST({f} AS VARCHAR) AS f{i}" for i, f in enumerate(ASSOC_FIELDS[:3]))}
             FROM lineitem)
SELECT field, value, o AS outcome, count(*) AS n FROM (
  {" UNION ALL ".join(f"SELECT {S.q(f)} AS field, f{i} AS value, o FROM src" for i, f in enumerate(ASSOC_FIELDS[:3]))}
) GROUP BY 1, 2, 3
""")
def contingency_counts(spark, sf):
    """A4: long contingency table for three fields in one pass."""
    li = table(spark, sf, "lineitem")
    return association.contingency(li, ASSOC_FIELDS[:3], LO)
