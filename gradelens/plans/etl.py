"""Catalog: assembly, decoding, banding, cleaning and profiles over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelens.functions.bands import hour_band, hour_or_default, number_band, ordinal, weekend_from_ts
from gradelens.functions.labels import decode_map, first_match
from gradelens.operators import assemble, clean, profile
from gradelens.plans import sqltext as S
from gradelens.plans import unify
from gradelens.plans.registry import register
from gradelens.plans.tables import EVENTS_SQL, LINE_OUTCOME, ORDER_NATIONS_SQL, events, order_nations, table
from gradelens.operators.clean import WHITESPACE_CLASS

LO = LINE_OUTCOME

# -- assembly ---------------------------------------------------------------------------
_ASSEMBLE_SQL = """
WITH first AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_tax, l_shipdate
               FROM lineitem WHERE l_linenumber = 1),
flags AS (SELECT l_orderkey AS fk, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_return
          FROM lineitem GROUP BY 1),
x AS (SELECT * FROM orders LEFT JOIN first ON o_orderkey = l_orderkey LEFT JOIN flags ON o_orderkey = fk)
SELECT o_orderkey,
       CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE 'Unknown' END AS order_status,
       l_linestatus AS line_status,
       CASE WHEN l_quantity - 5 < 0 THEN 'Unknown' WHEN l_quantity - 5 <= 2 THEN '0-2 yrs'
            WHEN l_quantity - 5 <= 5 THEN '3-5 yrs' WHEN l_quantity - 5 <= 10 THEN '6-10 yrs'
            WHEN l_quantity - 5 <= 15 THEN '11-15 yrs' WHEN l_quantity - 5 IS NOT NULL THEN 'Over 15 yrs'
            ELSE 'Unknown' END AS quantity_band,
       CASE WHEN l_returnflag = 'R' THEN 'Returned' WHEN l_returnflag = 'A' THEN 'Accepted'
            WHEN l_tax NOT IN (0.0, 0.08) THEN 'Taxed' WHEN l_quantity < 3 THEN 'Small'
            ELSE 'No abnormal movement' END AS movement,
       CASE WHEN has_return = 1 THEN 'With return' WHEN l_linestatus IN ('O') THEN 'Open line'
            WHEN l_tax NOT IN (0.0) OR l_quantity NOT IN (1.0, 2.0) THEN 'Charged'
            WHEN o_totalprice >= 200000 THEN 'Large order' ELSE 'Other' END AS order_type,
       'Not available (test)' AS unavailable,
       CAST(COALESCE(hour(l_shipdate), 12) AS SMALLINT) AS hour,
       CASE WHEN hour(l_shipdate) BETWEEN 6 AND 11 THEN 'Morning (6-11)'
            WHEN hour(l_shipdate) BETWEEN 12 AND 16 THEN 'Afternoon (12-16)'
            WHEN hour(l_shipdate) BETWEEN 17 AND 20 THEN 'Evening (17-20)' ELSE 'Night (0-5)' END AS part_of_day,
       dayname(o_orderdate) IN ('Saturday', 'Sunday') AS is_weekend,
       CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS SMALLINT) AS status_rank,
       has_return
FROM x
"""


def assembled(spark, sf):
    od = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    first = li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_tax",
                      "l_shipdate")
    raw_hour = F.hour("l_shipdate")
    rf, tax, qty = F.col("l_returnflag"), F.col("l_tax"), F.col("l_quantity")
    return assemble.flat_record(
        od, "o_orderkey",
        children=[(first, "l_orderkey", F.col("l_linenumber") == 1)],
        flags=[(li, "l_orderkey", {"has_return": F.col("l_returnflag") == "R"})],
        projection=[
        F.col("o_orderkey"),
        decode_map(F.col("o_orderstatus"), {"F": "Filled", "O": "Open"}, "Unknown").alias("order_status"),
        F.col("l_linestatus").alias("line_status"),
        number_band(qty - 5).alias("quantity_band"),
        first_match([(rf == "R", "Returned"), (rf == "A", "Accepted"), (~tax.isin(0.0, 0.08), "Taxed"),
                     (qty < 3, "Small")], "No abnormal movement").alias("movement"),
        first_match([(F.col("has_return") == 1, "With return"), (F.col("l_linestatus").isin("O"), "Open line"),
                     (~tax.isin(0.0) | ~qty.isin(1.0, 2.0), "Charged"),
                     (F.col("o_totalprice") >= 200000, "Large order")], "Other").alias("order_type"),
        F.lit("Not available (test)").alias("unavailable"),
        hour_or_default(raw_hour).alias("hour"),
        hour_band(raw_hour).alias("part_of_day"),
        weekend_from_ts(F.col("o_orderdate")).alias("is_weekend"),
        ordinal(F.col("o_orderstatus"), ("F", "O", "P")).alias("status_rank"),
        F.col("has_return"),
    ])


@register("assemble_first_child", _ASSEMBLE_SQL)
def assemble_first_child(spark, sf):
    """Orders + first line + return flag."""
    return assembled(spark, sf)


# Test roles of the three raw tables: an order is a collision, its lines are vehicles (by line number) and
# casualties (by line number less one, so one-line orders have none).  Expressions that both engines read.
_RAW = {
    "collision": ("orders", {
        "collision_index": "o_orderkey", "day_of_week": "1 + o_custkey % 8", "collision_severity": "1 + o_orderkey % 4",
        "number_of_vehicles": "1 + o_custkey % 3", "number_of_casualties": "o_custkey % 5", "urban_or_rural_area": "o_custkey % 4",
        "road_type": "o_custkey % 7", "first_road_class": "o_custkey % 6", "road_surface_conditions": "o_orderkey % 7",
        "light_conditions": "o_orderkey % 5", "weather_conditions": "o_orderkey % 9", "police_force": "o_custkey % 11"}),
    "vehicle": ("lineitem", {
        "collision_index": "l_orderkey", "vehicle_reference": "l_linenumber", "vehicle_type": "l_partkey % 9",
        "sex_of_driver": "l_partkey % 4", "age_band_of_driver": "l_suppkey % 8", "vehicle_manoeuvre": "l_partkey % 7",
        "driver_imd_decile": "l_suppkey % 6", "age_of_vehicle": "CAST(l_quantity AS INT) - 5",
        "skidding_and_overturning": "l_partkey % 8 - 1", "vehicle_leaving_carriageway": "l_suppkey % 3 - 1",
        "hit_object_off_carriageway": "l_partkey % 3 - 1"}),
    "casualty": ("lineitem", {
        "collision_index": "l_orderkey", "casualty_reference": "l_linenumber - 1", "casualty_class": "l_suppkey % 5",
        "sex_of_casualty": "l_partkey % 3", "age_band_of_casualty": "l_suppkey % 9", "casualty_severity": "l_partkey % 4",
        "pedestrian_movement": "l_suppkey % 7"}),
}
_DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def _raw_codes():
    """Codes 1 to 5 of each decoded field (7 of the weekday): code 3 listed twice, code 4 a junk label, code 5 none."""
    rows = []
    for _, tab, fld, _ in unify.DECODED:
        names = [f"{fld} 1", f"{fld} 2", f"{fld} 3", "Data missing or out of range", None]
        listed = list(enumerate(_DAY_NAMES if fld == "day_of_week" else names, 1))
        listed += [] if fld == "day_of_week" else [(3, f"a later {fld}")]
        rows += [(tab, fld, str(code), name, pos) for pos, (code, name) in enumerate(listed)]
    return rows


def _raw_sql(name):
    tab, cols = _RAW[name]
    more = ", strftime(o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 1440), '%H:%M:%S') AS time" if name == "collision" else ""
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())}{more} FROM {tab}"


def _decoded_sql():
    alias = {"collision": "c", "vehicle": "v", "casualty": "k"}
    out = []
    for name, tab, fld, default in unify.DECODED:
        labels = {code: "Unknown" if lab is None or "missing" in lab else lab for t, f, code, lab, _ in _raw_codes() if (t, f) == (tab, fld)}
        whens = " ".join(f"WHEN {code} THEN '{lab}'" for code, lab in labels.items())
        out.append(f"CASE {alias[tab]}.{fld} {whens} ELSE '{default}' END AS {name}")
    return ", ".join(out)


_UNIFIED_SQL = f"""
WITH c AS ({_raw_sql('collision')}), vs AS ({_raw_sql('vehicle')}), ks AS ({_raw_sql('casualty')}),
v AS (SELECT * FROM vs WHERE vehicle_reference = 1), k AS (SELECT * FROM ks WHERE casualty_reference = 1),
p AS (SELECT collision_index, max(CASE WHEN casualty_class = 3 THEN 1 ELSE 0 END) AS has_pedestrian FROM ks GROUP BY 1),
d AS (SELECT c.time AS "Time", {_decoded_sql()},
  CASE sex_of_driver WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Unknown' END AS Sex_of_driver,
  CASE WHEN age_of_vehicle < 0 THEN 'Unknown' WHEN age_of_vehicle <= 2 THEN '0-2 yrs' WHEN age_of_vehicle <= 5 THEN '3-5 yrs'
       WHEN age_of_vehicle <= 10 THEN '6-10 yrs' WHEN age_of_vehicle <= 15 THEN '11-15 yrs'
       WHEN age_of_vehicle IS NOT NULL THEN 'Over 15 yrs' ELSE 'Unknown' END AS Driving_experience,
  CASE WHEN has_pedestrian = 1 THEN 'Collision with pedestrians' WHEN skidding_and_overturning IN (2, 4, 5) THEN 'Rollover'
       WHEN hit_object_off_carriageway NOT IN (0, -1) OR vehicle_leaving_carriageway NOT IN (0, -1)
       THEN 'Collision with roadside objects' WHEN number_of_vehicles >= 2 THEN 'Vehicle with vehicle collision' ELSE 'Other' END
       AS Type_of_collision,
  CAST(number_of_vehicles AS SMALLINT) AS Number_of_vehicles_involved, CAST(number_of_casualties AS SMALLINT) AS Number_of_casualties,
  CASE WHEN skidding_and_overturning = 1 THEN 'Skidded' WHEN skidding_and_overturning = 2 THEN 'Skidded and overturned'
       WHEN skidding_and_overturning = 3 THEN 'Jackknifed' WHEN skidding_and_overturning = 4 THEN 'Jackknifed and overturned'
       WHEN skidding_and_overturning = 5 THEN 'Overturned' WHEN vehicle_leaving_carriageway NOT IN (0, -1) THEN 'Left carriageway'
       WHEN skidding_and_overturning = -1 THEN 'Unknown' ELSE 'No abnormal movement' END AS Vehicle_movement,
  CASE sex_of_casualty WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Unknown' END AS Sex_of_casualty,
  CASE casualty_severity WHEN 1 THEN 'Fatal injury' WHEN 2 THEN 'Serious Injury' WHEN 3 THEN 'Slight Injury' ELSE 'Unknown' END
       AS Casualty_severity,
  CASE collision_severity WHEN 1 THEN 'Fatal injury' WHEN 2 THEN 'Serious Injury' WHEN 3 THEN 'Slight Injury' ELSE 'Unknown' END
       AS Accident_severity,
  CAST(substr(c.time, 1, 2) AS SMALLINT) AS Hour,
  CASE WHEN CAST(substr(c.time, 1, 2) AS INT) BETWEEN 6 AND 11 THEN 'Morning (6-11)'
       WHEN CAST(substr(c.time, 1, 2) AS INT) BETWEEN 12 AND 16 THEN 'Afternoon (12-16)'
       WHEN CAST(substr(c.time, 1, 2) AS INT) BETWEEN 17 AND 20 THEN 'Evening (17-20)' ELSE 'Night (0-5)' END AS Time_of_day,
  CAST(CASE collision_severity WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS SMALLINT) AS Severity_rank,
  {', '.join(f"'{unify.NOT_AVAILABLE}' AS {n}" for n in unify.UNRECORDED)}
  FROM c LEFT JOIN v ON v.collision_index = c.collision_index LEFT JOIN k ON k.collision_index = c.collision_index
         LEFT JOIN p ON p.collision_index = c.collision_index)
SELECT *, Day_of_week IN ('Saturday', 'Sunday') AS Is_weekend FROM d
"""


@register("unified_records", _UNIFIED_SQL)
def unified_records(spark, sf):
    """Three tables and a code list → the 37-column record."""
    def raw(name):
        tab, cols = _RAW[name]
        return table(spark, sf, tab).select("*", *[F.expr(e).alias(c) for c, e in cols.items()])
    minutes = F.expr("make_interval(0, 0, 0, 0, 0, CAST(o_orderkey % 1440 AS INT), 0)")
    collision = raw("collision").withColumn("time", F.date_format(F.col("o_orderdate") + minutes, "HH:mm:ss"))
    listed = spark.createDataFrame(_raw_codes(), "table string, field string, code string, label string, pos int")
    return unify.unified_records(collision, raw("vehicle"), raw("casualty"), assemble.code_list(listed, order_col="pos"))


# Test roles: a code list for l_linenumber with a junk label, a NULL label, a
# non-integer code, an all-NULL row and another field; line 7 is left out.
CODE_ROWS = [
    ("line", "l_linenumber", "1", "First"), ("line", "l_linenumber", "2", "Second"),
    ("line", "l_linenumber", "3", "Data missing or out of range"), ("line", "l_linenumber", "4", None),
    ("line", "l_linenumber", "5", "Fifth"), ("line", "l_linenumber", "6", "Sixth"),
    ("line", "l_linenumber", "x", "Bad code"), ("line", "l_linenumber", None, None),
    ("line", "other_field", "1", "Wrong field"),
]


@register("decode_codes", """
WITH codes AS (SELECT * FROM (VALUES (1, 'First'), (2, 'Second'), (3, 'Unknown'), (4, 'Unknown'),
                                     (5, 'Fifth'), (6, 'Sixth')) t(code, label))
SELECT l_orderkey, l_linenumber, l_returnflag, COALESCE(label, 'Unlisted') AS line_label
FROM lineitem LEFT JOIN codes ON l_linenumber = code
""")
def decode_codes(spark, sf):
    """Decode line numbers through a code list (junk → Unknown, unlisted → default)."""
    raw = spark.createDataFrame(CODE_ROWS, "table string, field string, code string, label string")
    codes = assemble.code_list(raw)
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return assemble.decode(li, "l_linenumber", codes, "line", "l_linenumber", "Unlisted", name="line_label") \
                   .select("l_orderkey", "l_linenumber", "l_returnflag", "line_label")


# -- banding ----------------------------------------------------------------------------
@register("hour_banding", f"""
SELECT event_id, CAST(COALESCE(hour, 12) AS SMALLINT) AS hour_or_default,
       CASE WHEN hour BETWEEN 6 AND 11 THEN 'Morning (6-11)' WHEN hour BETWEEN 12 AND 16 THEN 'Afternoon (12-16)'
            WHEN hour BETWEEN 17 AND 20 THEN 'Evening (17-20)' ELSE 'Night (0-5)' END AS part_of_day,
       dayname(ts) IN ('Saturday', 'Sunday') AS is_weekend
FROM ({EVENTS_SQL})
""")
def hour_banding(spark, sf):
    """Part of day, hour default and weekend flag per event."""
    ev = events(spark, sf)
    return ev.select("event_id", hour_or_default(F.col("hour")).alias("hour_or_default"),
                     hour_band(F.col("hour")).alias("part_of_day"), weekend_from_ts(F.col("ts")).alias("is_weekend"))


@register("number_banding", """
SELECT p_partkey, CASE WHEN p_size - 10 < 0 THEN 'Unknown' WHEN p_size - 10 <= 2 THEN '0-2 yrs'
            WHEN p_size - 10 <= 5 THEN '3-5 yrs' WHEN p_size - 10 <= 10 THEN '6-10 yrs'
            WHEN p_size - 10 <= 15 THEN '11-15 yrs' WHEN p_size - 10 IS NOT NULL THEN 'Over 15 yrs'
            ELSE 'Unknown' END AS size_band
FROM part
""")
def number_banding(spark, sf):
    """Ordered numeric bands with an unknown band for negatives."""
    pt = table(spark, sf, "part")
    return pt.select("p_partkey", number_band(F.col("p_size") - 10).alias("size_band"))


# -- cleaning -----------------------------------------------------------------------------
_WS_SQL = WHITESPACE_CLASS.replace("'", "''")
_NULL_TOKENS_SQL = "('na', 'nan', 'unknown', 'n/a', 'none', 'null', '', '?')"


def _clean_sql(col):
    sq = f"trim(regexp_replace({col}, '{_WS_SQL}', ' ', 'g'))"
    return f"(CASE WHEN lower(trim({sq})) IN {_NULL_TOKENS_SQL} THEN NULL ELSE {sq} END)"


@register("clean_text", f"""
SELECT doc_id, md5({_clean_sql('text')}) AS text_md5, length({_clean_sql('text')}) AS text_len,
       {_clean_sql('lang')} AS lang, {_clean_sql('source')} AS source
FROM documents
""")
def clean_text(spark, sf):
    """Whitespace collapse, trim and missing tokens over whole document texts."""
    docs = clean.clean_text(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_len"),
                       "lang", "source")


@register("impute_numeric", """
WITH x AS (SELECT doc_id, TRY_CAST(regexp_extract(text, '(\\d+)', 1) AS DOUBLE) AS v FROM documents),
m AS (SELECT median(v) AS med FROM x)
SELECT doc_id, CAST(round_even(greatest(COALESCE(v, COALESCE((SELECT med FROM m), 1.0)), 1.0), 0) AS BIGINT) AS number
FROM x
""")
def impute_numeric(spark, sf):
    """First number in each text, missing → median, clip at 1, half-even round."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.regexp_extract("text", r"(\d+)", 1).alias("number"))
    return clean.median_fill(docs, "number")


# Test roles: synonyms of the event outcome; 'signup' has none and is dropped.
EVENT_SYNONYMS = {"view": "low", "click": "low", "purchase": "mid", "error": "high"}


@register("canonical_label", """
SELECT event_id, CASE lower(trim(event_type)) WHEN 'view' THEN 'low' WHEN 'click' THEN 'low'
                      WHEN 'purchase' THEN 'mid' WHEN 'error' THEN 'high' END AS event_type
FROM events WHERE lower(trim(event_type)) IN ('view', 'click', 'purchase', 'error')
""")
def canonical_label(spark, sf):
    """Target through a synonym map, unmappable rows dropped."""
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return clean.canonical_target(ev, "event_type", EVENT_SYNONYMS)


@register("hour_parse", """
SELECT event_id, CAST(least(greatest(hour(try_strptime(strftime(ts, '%H:%M:%S'), '%H:%M:%S')), 0), 23) AS SMALLINT)
       AS Hour
FROM events
""")
def hour_parse(spark, sf):
    """P20: hour parsed from H:mm:ss text."""
    ev = table(spark, sf, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("t"))
    return clean.derive_hour(ev, "t").select("event_id", "Hour")


@register("hour_parse_fallback", """
SELECT event_id, CAST(least(greatest(CAST(regexp_extract(CAST(hour(ts) AS VARCHAR) || ' h', '^\\s*(\\d{1,2})', 1)
       AS INTEGER), 0), 23) AS SMALLINT) AS Hour
FROM events
""")
def hour_parse_fallback(spark, sf):
    """P20: every text fails the time format, so the leading digits are used."""
    ev = table(spark, sf, "events").select("event_id", F.concat(F.hour("ts").cast("string"), F.lit(" h")).alias("t"))
    return clean.derive_hour(ev, "t").select("event_id", "Hour")


def _report_input(spark, sf):
    ev = events(spark, sf)
    return ev.select("event_type", "day_of_week", F.col("k").cast("string").alias("k"))


@register("cleaning_report", """
WITH src AS (SELECT event_type, dayname(ts) AS day_of_week,
                    CAST(TRY_CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS BIGINT) AS VARCHAR) AS k FROM events),
d AS (SELECT DISTINCT * FROM src)
SELECT (SELECT count(*) FROM src) AS rows_in,
       (SELECT count(*) FROM src) - (SELECT count(*) FROM d) AS duplicates_removed,
       CAST((SELECT count(*) FILTER (WHERE event_type IS NULL) + count(*) FILTER (WHERE day_of_week IS NULL) FROM d) AS BIGINT)
           AS categorical_cells_imputed,
       (SELECT count(*) FROM d WHERE lower(trim(event_type)) NOT IN ('view', 'click', 'purchase', 'error'))
           AS unmappable_target_rows_dropped,
       (SELECT count(*) FROM d WHERE lower(trim(event_type)) IN ('view', 'click', 'purchase', 'error')) AS rows_out
""")
def cleaning_report(spark, sf):
    """The cleaning pass and its one-row report."""
    return clean.clean_report(_report_input(spark, sf), "event_type", EVENT_SYNONYMS, numeric=["k"])


@register("cleaned_rows", """
WITH src AS (SELECT DISTINCT event_type, dayname(ts) AS day_of_week,
                    CAST(TRY_CAST(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS BIGINT) AS VARCHAR) AS k FROM events),
m AS (SELECT median(TRY_CAST(k AS DOUBLE)) AS med FROM src)
SELECT CASE lower(trim(event_type)) WHEN 'view' THEN 'low' WHEN 'click' THEN 'low' WHEN 'purchase' THEN 'mid'
            WHEN 'error' THEN 'high' END AS event_type, day_of_week,
       CAST(round_even(greatest(COALESCE(TRY_CAST(k AS DOUBLE), (SELECT med FROM m), 1.0), 1.0), 0) AS BIGINT) AS k
FROM src WHERE lower(trim(event_type)) IN ('view', 'click', 'purchase', 'error')
""")
def cleaned_rows(spark, sf):
    """The cleaned, de-duplicated rows."""
    return clean.clean_rows(_report_input(spark, sf), "event_type", EVENT_SYNONYMS, numeric=["k"])


# The same pass over cells with missing tokens, NULLs, loose white space and bad numbers.
_LOOSE_DAY = ("CASE day_of_week WHEN 'Sunday' THEN ' n/A ' WHEN 'Monday' THEN NULL WHEN 'Tuesday' THEN ' Tues   day' "
              "ELSE day_of_week END")
_LOOSE_K = "CASE WHEN event_id % 7 = 0 THEN 'oops' WHEN event_id % 11 = 0 THEN 'inf' WHEN event_id % 13 = 0 THEN '?' ELSE k END"
_LOOSE_SQL = f"""
src AS (SELECT event_type, CASE d WHEN ' n/A ' THEN NULL WHEN ' Tues   day' THEN 'Tues day' ELSE d END AS day_of_week, NULLIF(k, '?') AS k
        FROM (SELECT event_type, {_LOOSE_DAY} AS d, {_LOOSE_K} AS k FROM (SELECT * REPLACE (CAST(k AS VARCHAR) AS k) FROM ({EVENTS_SQL})))),
uniq AS (SELECT DISTINCT *, CASE WHEN k NOT IN ('oops', 'inf') THEN TRY_CAST(k AS DOUBLE) END AS num FROM src)
"""


def _loose_input(spark, sf):
    ev = events(spark, sf).withColumn("k", F.col("k").cast("string"))
    return ev.select("event_type", F.expr(_LOOSE_DAY).alias("day_of_week"), F.expr(_LOOSE_K).alias("k"))


@register("cleaned_loose_rows", f"""
WITH {_LOOSE_SQL}
SELECT CASE event_type WHEN 'view' THEN 'low' WHEN 'click' THEN 'low' WHEN 'purchase' THEN 'mid' WHEN 'error' THEN 'high' END AS event_type,
       COALESCE(day_of_week, 'Unknown') AS day_of_week,
       CAST(round_even(greatest(COALESCE(num, (SELECT median(num) FROM uniq), 1.0), 1.0), 0) AS BIGINT) AS k
FROM uniq WHERE event_type IN ('view', 'click', 'purchase', 'error')
""")
def cleaned_loose_rows(spark, sf):
    """P14-P19 A20 on cells with missing tokens, NULLs, loose white space and bad numbers."""
    return clean.clean_rows(_loose_input(spark, sf), "event_type", EVENT_SYNONYMS, numeric=["k"])


@register("cleaning_loose_report", f"""
WITH {_LOOSE_SQL}
SELECT (SELECT count(*) FROM src) AS rows_in, (SELECT count(*) FROM src) - count(*) AS duplicates_removed,
       count(*) FILTER (WHERE day_of_week IS NULL) AS categorical_cells_imputed,
       count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase', 'error')) AS unmappable_target_rows_dropped,
       count(*) FILTER (WHERE event_type IN ('view', 'click', 'purchase', 'error')) AS rows_out
FROM (SELECT DISTINCT event_type, day_of_week, k FROM uniq)
""")
def cleaning_loose_report(spark, sf):
    """A21 on the same cells."""
    return clean.clean_report(_loose_input(spark, sf), "event_type", EVENT_SYNONYMS, numeric=["k"])


@register("dedupe_count", """
SELECT (SELECT count(*) FROM lineitem) AS rows_in,
       (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem)) AS rows_out
""")
def dedupe_count(spark, sf):
    """Exact duplicates of a projection removed; rows in and out."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    d = clean.dedupe(li)
    return spark.range(1).select(li.select(F.count(F.lit(1))).scalar().alias("rows_in"),
                                 d.select(F.count(F.lit(1))).scalar().alias("rows_out"))


# -- profiles ---------------------------------------------------------------------------
PROFILE_FIELDS = ["l_linestatus", "l_linenumber", "l_tax"]


@register("profile", f"""
SELECT 'rows' AS section, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM lineitem
UNION ALL SELECT 'outcome', 'l_returnflag', 'N', count(*) FILTER (WHERE l_returnflag = 'N') FROM lineitem
UNION ALL SELECT 'outcome', 'l_returnflag', 'A', count(*) FILTER (WHERE l_returnflag = 'A') FROM lineitem
UNION ALL SELECT 'outcome', 'l_returnflag', 'R', count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem
UNION ALL SELECT 'distinct', field, value, count(*) FROM (
  {" UNION ALL ".join(f"SELECT {S.q(f)} AS field, CAST({f} AS VARCHAR) AS value FROM lineitem" for f in PROFILE_FIELDS)}
) GROUP BY 2, 3
""")
def profile_query(spark, sf):
    """Row count, per-level counts and value counts of three fields in one scan."""
    return profile.profile(table(spark, sf, "lineitem"), PROFILE_FIELDS, LO)


LEVEL_FIELDS = ["l_linestatus", "l_linenumber", "l_returnflag"]


@register("levels", f"""
SELECT field, array_to_string(list_sort(list(DISTINCT value)), '|') AS levels FROM (
  {" UNION ALL ".join(f"SELECT {S.q(f)} AS field, CAST({f} AS VARCHAR) AS value FROM lineitem" for f in LEVEL_FIELDS)}
) WHERE value IS NOT NULL GROUP BY 1
""")
def levels_query(spark, sf):
    """Sorted distinct levels per categorical field (as text for the value hash)."""
    lv = profile.levels(table(spark, sf, "lineitem"), LEVEL_FIELDS)
    return lv.select("field", F.array_join("levels", "|").alias("levels"))


@register("level_rows", """
SELECT field, value, count(*) AS n FROM (
  SELECT 'l_returnflag' AS field, NULLIF(l_returnflag, 'R') AS value FROM lineitem
  UNION ALL SELECT 'l_suppkey', CAST(NULLIF(l_suppkey, 1) AS VARCHAR) FROM lineitem) GROUP BY ALL
""")
def level_rows(spark, sf):
    """One row per level and field, NULL a level like any other, fields of any number of levels."""
    li = table(spark, sf, "lineitem").select(F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"),
                                             F.nullif("l_suppkey", F.lit(1)).alias("l_suppkey"))
    return profile.value_counts(li, ["l_returnflag", "l_suppkey"])


@register("region_counts", f"""
SELECT n_name, count(*) AS n FROM ({ORDER_NATIONS_SQL}) GROUP BY 1
""")
def region_counts(spark, sf):
    """Orders per nation, largest first."""
    return profile.group_counts(order_nations(spark, sf), "n_name")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


@register("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS rows FROM {t}" for t in TABLES))
def row_counts(spark, sf):
    """Row counts per source."""
    return profile.source_counts({t: table(spark, sf, t) for t in TABLES})


@register("type_compaction", f"""
SELECT event_id,
       COALESCE(CAST(TRY_CAST(k_text AS DOUBLE) AS SMALLINT), CAST(0 AS SMALLINT)) AS k_text,
       COALESCE(weekend_text IN ('True', 'true', '1'), false) AS weekend_text
FROM (SELECT event_id, CAST(k AS VARCHAR) AS k_text, CAST(is_weekend AS VARCHAR) AS weekend_text
      FROM ({EVENTS_SQL}))
""")
def type_compaction(spark, sf):
    """Text counts to SMALLINT (bad → 0) and boolean text to BOOLEAN."""
    ev = events(spark, sf).select("event_id", F.col("k").cast("string").alias("k_text"),
                                  F.col("is_weekend").cast("string").alias("weekend_text"))
    return clean.compact(ev, shorts=["k_text"], bools=["weekend_text"])
