"""The unified collision record: three raw tables and a code list → one flat row per collision.

``collision`` is the parent; the first-listed vehicle and casualty give their columns, and the
casualties a pedestrian flag.  Codes are numbers; ``codes`` is ``assemble.code_list``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens.functions.bands import hour_band, hour_or_default, number_band, ordinal
from gradelens.functions.labels import decode_map, first_match
from gradelens.operators import assemble

KEY = "collision_index"

# The columns of the record, in order.
COLUMNS = (
    "Time", "Day_of_week", "Age_band_of_driver", "Sex_of_driver", "Educational_level", "Vehicle_driver_relation",
    "Driving_experience", "Type_of_vehicle", "Owner_of_vehicle", "Service_year_of_vehicle", "Defect_of_vehicle",
    "Area_accident_occured", "Lanes_or_Medians", "Road_allignment", "Types_of_Junction", "Road_surface_type",
    "Road_surface_conditions", "Light_conditions", "Weather_conditions", "Type_of_collision",
    "Number_of_vehicles_involved", "Number_of_casualties", "Vehicle_movement", "Casualty_class", "Sex_of_casualty",
    "Age_band_of_casualty", "Casualty_severity", "Work_of_casuality", "Fitness_of_casuality", "Pedestrian_movement",
    "Cause_of_accident", "Accident_severity", "Hour", "Time_of_day", "Is_weekend", "Severity_rank", "State",
)

# Columns decoded through the code list (column, table, field, label of an unlisted code).
DECODED = (
    ("Day_of_week", "collision", "day_of_week", "Unknown"),
    ("Area_accident_occured", "collision", "urban_or_rural_area", "Unknown"),
    ("Lanes_or_Medians", "collision", "road_type", "Unknown"),
    ("Road_surface_type", "collision", "first_road_class", "Unknown"),
    ("Road_surface_conditions", "collision", "road_surface_conditions", "Unknown"),
    ("Light_conditions", "collision", "light_conditions", "Unknown"),
    ("Weather_conditions", "collision", "weather_conditions", "Unknown"),
    ("State", "collision", "police_force", "Unknown Force"),
    ("Type_of_vehicle", "vehicle", "vehicle_type", "Unknown"),
    ("Age_band_of_driver", "vehicle", "age_band_of_driver", "Unknown"),
    ("Cause_of_accident", "vehicle", "vehicle_manoeuvre", "Unknown"),
    ("Educational_level", "vehicle", "driver_imd_decile", "Unknown"),
    ("Casualty_class", "casualty", "casualty_class", "Unknown"),
    ("Age_band_of_casualty", "casualty", "age_band_of_casualty", "Unknown"),
    ("Pedestrian_movement", "casualty", "pedestrian_movement", "Not a Pedestrian"),
)

# Columns the source does not record, and their label.
UNRECORDED = ("Vehicle_driver_relation", "Owner_of_vehicle", "Service_year_of_vehicle", "Defect_of_vehicle",
              "Road_allignment", "Types_of_Junction", "Work_of_casuality", "Fitness_of_casuality")
NOT_AVAILABLE = "Not available (UK)"

# Codes with a label of their own.
SEVERITY_CODES = {1: "Fatal injury", 2: "Serious Injury", 3: "Slight Injury"}
SEX_CODES = {1: "Male", 2: "Female"}
SKID_LABELS = {1: "Skidded", 2: "Skidded and overturned", 3: "Jackknifed", 4: "Jackknifed and overturned", 5: "Overturned"}
ROLLOVER_CODES = (2, 4, 5)
NONE_CODES = (0, -1)          # nothing happened / not recorded
PEDESTRIAN_CLASS = 3
WEEKEND = ("Saturday", "Sunday")

_PARENT = ("time", "collision_severity", "number_of_vehicles", "number_of_casualties")
_VEHICLE = ("vehicle_reference", "sex_of_driver", "age_of_vehicle", "skidding_and_overturning", "vehicle_leaving_carriageway",
            "hit_object_off_carriageway")
_CASUALTY = ("casualty_reference", "sex_of_casualty", "casualty_severity")


def code(col: Column) -> Column:
    """A code as a number, NULL for a text that is none."""
    return col.try_cast("int")


def vehicle_movement(skid: Column, leaving: Column) -> Column:
    """P10: what the vehicle did, the first rule that holds; a code that is no number holds in none."""
    skid, leaving = code(skid), code(leaving)
    return first_match([*[(skid == code, label) for code, label in SKID_LABELS.items()],
                        (~leaving.isin(*NONE_CODES), "Left carriageway"), (skid == -1, "Unknown")], "No abnormal movement")


def type_of_collision(pedestrian: Column, skid: Column, leaving: Column, hit: Column, vehicles: Column) -> Column:
    """The kind of collision, the first rule that holds; a code that is no number holds in none."""
    skid, leaving, hit, vehicles = code(skid), code(leaving), code(hit), code(vehicles)
    return first_match([(pedestrian == 1, "Collision with pedestrians"), (skid.isin(*ROLLOVER_CODES), "Rollover"),
                        (~hit.isin(*NONE_CODES) | ~leaving.isin(*NONE_CODES), "Collision with roadside objects"),
                        (vehicles >= 2, "Vehicle with vehicle collision")], "Other")


def _pick(df: DataFrame, table: str, names) -> DataFrame:
    """Key and needed columns as ``<table>.<name>`` with ``_`` for the dot, so tables cannot clash."""
    fields = [f for _, t, f, _ in DECODED if t == table]
    return df.select(F.col(KEY).alias(f"{table}_key"), *[F.col(n).alias(f"{table}_{n}") for n in (*names, *fields)])


def unified_records(collision: DataFrame, vehicle: DataFrame, casualty: DataFrame, codes: DataFrame) -> DataFrame:
    """The 37 columns of every collision; a parent with several first-listed children fans out (left join).

    ``time`` is ``H:m`` or ``H:m:s`` text, and every code a number or its text; a code that is no number is treated as not listed, and
    a missing child gives the defaults.
    """
    flat = assemble.flat_record(
        _pick(collision, "collision", _PARENT), "collision_key",
        children=[(_pick(vehicle, "vehicle", _VEHICLE), "vehicle_key", code(F.col("vehicle_vehicle_reference")) == 1),
                  (_pick(casualty, "casualty", _CASUALTY), "casualty_key", code(F.col("casualty_casualty_reference")) == 1)],
        flags=[(casualty, KEY, {"has_pedestrian": code(F.col("casualty_class")) == PEDESTRIAN_CLASS})])
    flat = assemble.decode_all(flat, [(f"{table}_{field}", table, field, default, name) for name, table, field, default in DECODED], codes)
    at = F.coalesce(*[F.try_to_timestamp(F.col("collision_time"), F.lit(p)) for p in ("H:m:s", "H:m")])
    hour = F.hour(at)
    skid, leaving = F.col("vehicle_skidding_and_overturning"), F.col("vehicle_vehicle_leaving_carriageway")
    severity = code(F.col("collision_collision_severity"))
    made = {
        "Time": F.date_format(at, "HH:mm:ss"),
        "Sex_of_driver": decode_map(code(F.col("vehicle_sex_of_driver")), SEX_CODES, "Unknown"),
        "Driving_experience": number_band(F.col("vehicle_age_of_vehicle")),
        "Type_of_collision": type_of_collision(F.col("has_pedestrian"), skid, leaving, F.col("vehicle_hit_object_off_carriageway"),
                                               F.col("collision_number_of_vehicles")),
        "Number_of_vehicles_involved": F.col("collision_number_of_vehicles").try_cast("short"),
        "Number_of_casualties": F.col("collision_number_of_casualties").try_cast("short"),
        "Vehicle_movement": vehicle_movement(skid, leaving),
        "Sex_of_casualty": decode_map(code(F.col("casualty_sex_of_casualty")), SEX_CODES, "Unknown"),
        "Casualty_severity": decode_map(code(F.col("casualty_casualty_severity")), SEVERITY_CODES, "Unknown"),
        "Accident_severity": decode_map(severity, SEVERITY_CODES, "Unknown"),
        "Hour": hour_or_default(hour),
        "Time_of_day": hour_band(hour),
        "Is_weekend": F.col("Day_of_week").isin(*WEEKEND),
        "Severity_rank": ordinal(severity, (3, 2, 1)),
        **{name: F.lit(NOT_AVAILABLE) for name in UNRECORDED},
    }
    return flat.select(*[made[c].alias(c) if c in made else F.col(c) for c in COLUMNS])
