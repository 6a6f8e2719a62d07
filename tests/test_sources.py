"""Sources and sinks on files in a fresh scratch folder."""

import os
import tempfile

from pyspark.sql import functions as F

from gradelens.operators import assemble, profile
from gradelens.plans.tables import LINE_OUTCOME
from gradelens.sources import io
from tests.conftest import SF_SMALL


def scratch():
    return tempfile.mkdtemp(prefix="gradelens-test-", dir="/tmp")


def test_typed_csv_skips_bad_rows(spark):
    d = scratch()
    p = os.path.join(d, "in.csv")
    with open(p, "w") as f:
        f.write("a,b,s\n1,2,x\n3,oops,y\n4,5\n6,7,z,extra\n8,,w\n")
    df = io.read_csv_typed(spark, p, {"a": "int", "b": "int", "s": "string"})
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2, "x"), (8, None, "w")]
    # the same rows whatever the projection
    assert sorted(r[0] for r in df.select("a").collect()) == [1, 8]
    assert df.count() == 2 and df.select("s").filter("s = 'w'").count() == 1
    texts = io.read_csv_typed(spark, p, {"a": "string", "b": "string", "s": "string"})
    assert texts.count() == 3 and texts.select("s").distinct().count() == 3
    loose = io.read_csv_typed(spark, p, {"a": "int", "b": "int", "s": "string"}, check_field_count=False)
    assert 3 not in [r[0] for r in loose.select("a").collect()]


def test_text_csv_and_sinks_round_trip(spark):
    d = scratch()
    src = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    io.write_csv(src, os.path.join(d, "csv"))
    back = io.read_csv_text(spark, os.path.join(d, "csv"))
    assert back.count() == 25 and dict(back.dtypes)["n_nationkey"] == "string"
    io.write_parquet(src, os.path.join(d, "pq"), max_records_per_file=10)
    files = [f for f in os.listdir(os.path.join(d, "pq")) if f.endswith(".parquet")]
    assert len(files) >= 3 and spark.read.parquet(os.path.join(d, "pq")).count() == 25
    io.write_parquet(src.limit(5), os.path.join(d, "pq"))  # overwrite
    assert spark.read.parquet(os.path.join(d, "pq")).count() == 5


def test_views_profile_json_and_counts(spark):
    d = scratch()
    views = io.register_views(spark, {"line": SF_SMALL + "/lineitem.parquet", "gone": d + "/missing"})
    assert list(views) == ["line_records"] and "l_returnflag" in views["line_records"]
    assert spark.sql("SELECT count(*) FROM line_records").first()[0] == spark.read.parquet(
        SF_SMALL + "/lineitem.parquet").count()
    prof = profile.profile(spark.table("line_records"), ["l_linestatus"], LINE_OUTCOME)
    io.write_json(prof, os.path.join(d, "meta"))
    back = io.read_json(spark, os.path.join(d, "meta"))
    assert back.filter(F.col("section") == "rows").first()["n"] == spark.table("line_records").count()
    counts = io.source_row_counts(spark, {"nation": SF_SMALL + "/nation.parquet"}, fmt="parquet")
    assert counts.first()["rows"] == 25


def test_code_list_from_csv(spark):
    d = scratch()
    p = os.path.join(d, "codes.csv")
    with open(p, "w") as f:
        f.write("table,field,code,label,note\nveh,type,1,Car,\nveh,type,2,Data missing,\nveh,type,x,Bad,\n"
                "veh,type,,,\n")
    raw = io.read_csv_text(spark, p)
    codes = assemble.code_list(raw)
    assert sorted((r["code"], r["label"]) for r in codes.collect()) == [(1, "Car"), (2, "Unknown")]


def test_build_records_end_to_end(spark):
    from gradelens.functions.labels import SEVERITY_SYNONYMS
    from gradelens.plans.build import build_records
    from gradelens.plans.presets import SEVERITY
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    sev = (F.when(F.col("event_type") == "error", F.lit(" Fatal "))
            .when(F.col("event_type") == "purchase", F.lit("serious injury"))
            .when(F.col("event_type") == "signup", F.lit("??"))
            .otherwise(F.lit("Slight")))
    raw = ev.select(F.date_format("ts", "H:mm:ss").alias("Time"), F.date_format("ts", "EEEE").alias("Day_of_week"),
                    sev.alias("Accident_severity"),
                    F.regexp_extract("props", r"(\d+)", 1).alias("Number_of_vehicles_involved"),
                    F.lit("1").alias("Number_of_casualties"))
    shares = spark.createDataFrame([("North", 5), ("South", 3), ("East", 2)], "label string, weight long")
    out = os.path.join(scratch(), "records")
    meta = os.path.join(scratch(), "meta")
    res = build_records(raw, SEVERITY, SEVERITY_SYNONYMS, out, shares=shares, meta_dir=meta)
    rep = res.report.first()
    n = res.records.count()
    assert rep["rows_out"] == n and rep["rows_in"] == ev.count() and rep["unmappable_target_rows_dropped"] > 0
    # largest remainder: every region within one row of its ideal share
    assert res.quota_check.agg(F.max("diff_pp")).first()[0] <= 100.0 / n
    assert sum(r["assigned"] for r in res.quota_check.collect()) == n
    types = dict(res.records.dtypes)
    assert types["Hour"] == "smallint" and types["Is_weekend"] == "boolean" and types["Severity_rank"] == "smallint"
    assert res.profile.filter(F.col("section") == "rows").first()["n"] == n
    assert io.read_json(spark, os.path.join(meta, "profile")).filter("section = 'rows'").first()["n"] == n
    assert io.read_json(spark, os.path.join(meta, "quota_check")).count() == 3
    lv = io.read_json(spark, os.path.join(meta, "levels")).filter("field = 'State'")
    assert sorted(r["value"] for r in lv.collect()) == ["East", "North", "South"]
    assert "_pos" not in res.records.columns


def test_build_unified_end_to_end(spark):
    from gradelens.plans.build import build_unified
    from gradelens.plans.presets import SEVERITY
    from gradelens.plans.unify import COLUMNS, DECODED, _CASUALTY, _PARENT, _VEHICLE
    own = {"collision": _PARENT, "vehicle": _VEHICLE, "casualty": _CASUALTY}
    cols = {t: ["collision_index", *own[t], *[f for _, tab, f, _ in DECODED if tab == t]] for t in own}

    def frame(t, *rows):
        types = ", ".join(f"{c} {'string' if c == 'time' else 'int'}" for c in cols[t])
        return spark.createDataFrame([tuple(r.get(c) for c in cols[t]) for r in rows], types)
    collision = frame("collision", {"collision_index": 1, "time": "9:05", "collision_severity": 1, "number_of_vehicles": 2, "day_of_week": 1},
                      {"collision_index": 2, "time": "bad", "collision_severity": 9, "number_of_vehicles": 99999})
    vehicle = frame("vehicle", {"collision_index": 1, "vehicle_reference": 1, "skidding_and_overturning": 5, "sex_of_driver": 2},
                    {"collision_index": 1, "vehicle_reference": 2, "skidding_and_overturning": 1})
    casualty = frame("casualty", {"collision_index": 1, "casualty_reference": 2, "casualty_class": 3})
    codes = spark.createDataFrame([("collision", "day_of_week", 1, "Sunday")], "table string, field string, code long, label string")
    out = scratch()
    res = build_unified(collision, vehicle, casualty, codes, SEVERITY, os.path.join(out, "records"), meta_dir=os.path.join(out, "meta"))
    assert tuple(res.records.columns) == COLUMNS and len(COLUMNS) == 37
    a, b = sorted(res.records.collect(), key=lambda r: r.Hour)
    assert (a.Time, a.Time_of_day, a.Is_weekend, a.Severity_rank, a.Sex_of_driver) == ("09:05:00", "Morning (6-11)", True, 2, "Female")
    assert (a.Vehicle_movement, a.Type_of_collision) == ("Overturned", "Collision with pedestrians")
    assert (b.Time, b.Hour, b.Time_of_day, b.State, b.Accident_severity) == (None, 12, "Night (0-5)", "Unknown Force", "Unknown")
    assert (b.Vehicle_movement, b.Type_of_collision, b.Severity_rank) == ("No abnormal movement", "Vehicle with vehicle collision", None)
    assert b.Number_of_vehicles_involved is None and b.Pedestrian_movement == "Not a Pedestrian"
    assert res.profile.filter("section = 'rows'").first()["n"] == 2
