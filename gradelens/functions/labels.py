"""Label expressions: folds, classes, decoding, junk and null tokens.

All of them are ``when`` chains or map lookups evaluated inside whole-stage
codegen; none needs a Python UDF.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels folded into "Other" (whole label, case-insensitive).
OTHER = "Other"
OTHER_UNKNOWN_PATTERN = (
    r"^(other|others|unknown|not known|unknown \(self reported\)"
    r"|unknown vehicle type \(self rep only\)|rural village areasoffice areas)$"
)
# The two lane-change labels folded into one.
LANE_CHANGE_PATTERN = r"^changing lane to the (left|right)$"
LANE_CHANGE = "Lane change"

# Vehicle classes, first matching rule wins, searched in the lower-cased label.
VEHICLE_CLASS_RULES = (
    ("Two-wheeler", r"motorcycle|bajaj|bicycle|pedal cycle|scooter"),
    ("Four-wheeler", r"automobile|taxi|stationwagen|pick up|public \(12|\bcar\b"),
    ("Long chassis", r"lorry|public \(1[3-9]|public \(> ?45|public \(45|\bbus\b|coach|goods|\bvan\b"),
)

# Junk code-list labels (searched, case-insensitive).
JUNK_LABEL_PATTERN = r"data missing|out of range|unallocated|not known|undefined"

# Text tokens read as missing (compared trimmed and lower-cased).
NULL_TOKENS = ("na", "nan", "unknown", "n/a", "none", "null", "", "?")

# Outcome synonyms (lower-cased) → canonical outcome label.
SEVERITY_SYNONYMS = {
    "slight injury": "Slight Injury",
    "slight": "Slight Injury",
    "serious injury": "Serious Injury",
    "serious": "Serious Injury",
    "fatal injury": "Fatal injury",
    "fatal": "Fatal injury",
}

UNKNOWN_OR_OTHER_PREFIX = r"(?i)^(unknown|other)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_matching(col, pattern: str, target: str) -> Column:
    """Labels whose whole text matches ``pattern`` (any case) become ``target``."""
    c = _c(col)
    return F.when(c.rlike("(?i)" + pattern), F.lit(target)).otherwise(c)


def fold_other_unknown(col) -> Column:
    return fold_matching(col, OTHER_UNKNOWN_PATTERN, OTHER)


def fold_lane_change(col) -> Column:
    return fold_matching(col, LANE_CHANGE_PATTERN, LANE_CHANGE)


def classify(col, rules: Sequence[tuple[str, str]], default: str | None = OTHER) -> Column:
    """First rule whose pattern is found in the lower-cased text wins."""
    s = F.lower(_c(col).cast("string"))
    expr = None
    for label, pattern in rules:
        cond = s.rlike(pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def vehicle_class(col) -> Column:
    return classify(col, VEHICLE_CLASS_RULES)


def first_match(rules: Sequence[tuple[Column, str]], default) -> Column:
    """Priority CASE, the first true condition gives the label."""
    expr = None
    for cond, label in rules:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    dflt = default if isinstance(default, Column) else F.lit(default)
    return dflt if expr is None else expr.otherwise(dflt)


def clean_label(col, pattern: str = JUNK_LABEL_PATTERN, unknown: str = "Unknown") -> Column:
    """NULL or a junk label → ``unknown``."""
    c = _c(col)
    return F.when(c.isNull() | c.rlike("(?i)" + pattern), F.lit(unknown)).otherwise(c)


def decode_map(col, mapping: Mapping, default) -> Column:
    """P6 for a small literal dictionary: ``element_at(map, col)`` with a default."""
    if not mapping:
        return default if isinstance(default, Column) else F.lit(default)
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    dflt = default if isinstance(default, Column) else F.lit(default)
    key = _c(col).cast("string") if all(isinstance(k, str) for k in mapping) else _c(col)
    return F.coalesce(F.try_element_at(m, key), dflt)


def canonical(col, synonyms: Mapping[str, str] = SEVERITY_SYNONYMS) -> Column:
    """Lower-cased, trimmed text through a synonym map; NULL when unmapped."""
    m = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, F.lower(F.trim(_c(col).cast("string"))))


def unknown_or_other(col) -> Column:
    """T4 test: label starts with unknown / other (trimmed, any case)."""
    return F.trim(_c(col).cast("string")).rlike(UNKNOWN_OR_OTHER_PREFIX)
