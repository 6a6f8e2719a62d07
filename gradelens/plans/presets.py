"""Presets for the road-collision record: the outcome, the association field
list and the named conditions of each dataset, as used by the dashboard.

With these, the dashboard's calls map onto the operators one to one, e.g.
``outcome.condition_lift(df, SEVERITY, conditions("uk"), selection)`` or
``association.cramers_v(df, ASSOCIATION_FIELDS, SEVERITY, selection)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelens.spec import OutcomeSpec

# Outcome column, levels (lowest first), output names and risk weights.
SEVERITY = OutcomeSpec("Accident_severity", ("Slight Injury", "Serious Injury", "Fatal injury"),
                       ("slight", "serious", "fatal"), (0, 1, 3))

# The fields ranked by association with the outcome.
ASSOCIATION_FIELDS = (
    "Light_conditions", "Weather_conditions", "Cause_of_accident", "Type_of_collision",
    "Area_accident_occured", "Age_band_of_driver", "Driving_experience", "Road_surface_conditions",
    "Sex_of_driver", "Time_of_day", "Day_of_week", "Vehicle_movement", "Type_of_vehicle",
    "Lanes_or_Medians", "Educational_level", "Number_of_vehicles_involved", "Number_of_casualties",
)

# Model features, target-derived columns refused as features,
# the field offered on the scenario form only, seed and PCA variance kept.
FEATURE_CAT = (
    "Time_of_day", "Day_of_week", "Age_band_of_driver", "Sex_of_driver", "Driving_experience",
    "Area_accident_occured", "Light_conditions", "Weather_conditions", "Road_surface_conditions",
    "Type_of_collision", "Cause_of_accident",
)
FEATURE_NUM = ("Number_of_vehicles_involved", "Number_of_casualties")
LEAKING_COLUMNS = ("Severity_rank",)
FORM_ONLY_CAT = ("State",)
SEED = 42
PCA_VARIANCE = 0.95

# The named conditions of each data set, in display order, as SQL conditions.
CONDITIONS = {
    "india": (
        ("Darkness", "Light_conditions LIKE 'Darkness%'"),
        ("Rain / Fog", "Weather_conditions IN ('Raining', 'Raining and Windy', 'Fog or mist')"),
        ("Speed / DUI", "Cause_of_accident IN ('Driving at high speed', 'Driving under the influence of drugs')"),
        ("Night", "Time_of_day LIKE 'Night%'"),
        ("Weekend", "Is_weekend = true"),
        ("Multi-vehicle", "Number_of_vehicles_involved >= 3"),
    ),
    "uk": (
        ("Darkness", "Light_conditions LIKE 'Darkness%'"),
        ("Rain / Fog", "Weather_conditions LIKE 'Raining%' OR Weather_conditions = 'Fog or mist'"),
        ("Rural road", "Area_accident_occured = 'Rural'"),
        ("Night", "Time_of_day LIKE 'Night%'"),
        ("Weekend", "Is_weekend = true"),
        ("Multi-vehicle", "Number_of_vehicles_involved >= 3"),
    ),
}


def conditions(dataset: str) -> dict[str, Column]:
    """P5: the data set's named conditions as Columns, in display order."""
    if dataset not in CONDITIONS:
        raise ValueError(f"no condition presets defined for '{dataset}'")
    return {name: F.expr(sql) for name, sql in CONDITIONS[dataset]}
