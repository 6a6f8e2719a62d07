"""Operator 12, license scans by ordered signature rules, in DataFrame functions alone.

1. A rule's keywords are the words that all its matches hold.  The words of a text (A-Z lower-cased runs of letters, digits and
   non-ASCII characters) that are the first keyword of a rule select the rules whose keywords are all there; no other rule can match.
2. Where rules are selected, the words are numbered in place (``0:the 1:mit``), so that a match carries its place, and the regular
   expressions of these rules run over that line.
3. Each match is an interval of words.  In order of start, end (longest first), level and rule, an interval inside an earlier one of the
   same or a stronger level is suppressed; whatever contains an interval comes before it in this order.  The largest end so far of each
   level decides, block by block of ``BLOCK`` intervals, so a text of a million matches costs its length.
4. What stays gives the labels and, by its strongest level, the score.  Base rules are counted at all their places and never suppressed.

All of it is one pass over the rows without a shuffle: rows of one text, of one source or of a group of copies stay where they are read.

Defined results: NULL and empty texts have no words and no detections.  Matches of one rule do not overlap (the leftmost counts).
Repeated rows give equal rows, empty tables empty results; clashing input columns are replaced.  Long texts are scanned whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens.llm.license_rules import Rule, default_rules, keywords

#: Fixed value: what lies between the words of a lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Parameters: score of the strongest level that stays, intervals of a block.
SCORES = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.5}
BLOCK = 64
DETECTION = "struct<start:int,end:int,level:int,rule:int>"


def compiled(pattern: str) -> str:
    """The regular expression over numbered words: every space is followed by a word's number, ``<n>`` is up to n words."""
    body = re.sub(r" (?=[^?])", r" \\d+:", pattern.replace(" ?", "\x00"))
    body = body.replace("\x00", r"(?: \d+:)?")
    body = re.sub(r"<(\d+)>", r"(?: \\S+){0,\1}", body)
    return rf"(?<= )\d+:(?:{body})(?= )"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; ``lower`` changes nothing else in a text of ASCII characters."""
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(low, GAP), "")


def constant(value, kind: str) -> Column:
    """A literal of any type (folded when the query is optimised)."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def selected(words: Column, rules: Sequence[Rule]) -> Column:
    """The rules (number, level, keywords, expression) whose keywords are all among the words, found by their first keyword."""
    by_first: dict[str, list[dict]] = {}
    for i, r in enumerate(rules):
        first, *more = keywords(r.pattern)
        by_first.setdefault(first, []).append({"rule": i, "level": r.level, "words": more, "expr": compiled(r.pattern)})
    kind = "array<struct<rule:int,level:int,words:array<string>,expr:string>>"
    table = constant(by_first, f"map<string,{kind}>")
    here = F.array_intersect(words, constant(sorted(by_first), "array<string>"))
    return F.filter(F.flatten(F.transform(here, lambda k: F.element_at(table, k))), lambda r: F.forall(r["words"], lambda w: F.array_contains(words, w)))


def numbered(words: Column) -> Column:
    """`` 0:first 1:second `` with a space at both ends."""
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w, i: F.concat(i.cast("string"), F.lit(":"), w)), " "), F.lit(" "))


def detections(line: Column, rules: Column) -> Column:
    """All matches of the rules in the numbered words, as an array of ``DETECTION``."""

    def places(rule: Column) -> Column:
        def place(m: Column) -> Column:
            start = F.substring_index(m, ":", 1).cast("int")
            spaces = F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit("")))
            return F.struct(start.alias("start"), (start + spaces + 1).alias("end"), rule["level"].alias("level"), rule["rule"].alias("rule"))
        return F.transform(F.regexp_extract_all(line, rule["expr"], F.lit(0)), place)

    return F.flatten(F.transform(rules, places))


def ordered(found: Column) -> Column:
    """Detections by start, end (longest first), level and rule."""
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["level"].alias("level"), d["rule"].alias("rule"))))
    return F.transform(order, lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["level"].alias("level"), d["rule"].alias("rule")))


def unsuppressed(found: Column, levels: Sequence[int]) -> Column:
    """The ``ordered`` detections (a column: it is read block by block) that lie in no other one of their own or a stronger level."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.slice(found, b * BLOCK + 1, F.lit(BLOCK)))
    none = F.lit(0)

    def reach(block: Column, level: int, before: Column) -> Column:
        """The largest end of the detections of ``level`` or stronger ones, up to the end of a block."""
        return F.greatest(before, F.coalesce(F.array_max(F.transform(F.filter(block, lambda d: d["level"] <= level), lambda d: d["end"])), none))

    def step(state: Column, block: Column) -> Column:
        def stays(d: Column, i: Column) -> Column:
            earlier = F.exists(F.slice(block, F.lit(1), i), lambda c: (c["level"] <= d["level"]) & (c["end"] >= d["end"]))
            return ~earlier & (F.element_at(state["ends"], d["level"]) < d["end"])
        ends = F.array(*[reach(block, level, F.element_at(state["ends"], level)) for level in levels])
        return F.struct(ends.alias("ends"), F.array_append(state["kept"], F.filter(block, stays)).alias("kept"))

    empty = F.array().cast(f"array<array<{DETECTION}>>")
    start = F.struct(F.array(*[none for _ in levels]).alias("ends"), empty.alias("kept"))
    return F.flatten(F.aggregate(blocks, start, step, lambda state: state["kept"]))


def scratch_names(columns: Sequence[str], names: Sequence[str]) -> list[str]:
    """Column names that the frame does not have."""
    taken, mark = {c.lower() for c in columns}, "__"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def scan(df: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """``df`` with ``n_words``, all base places ``base_places`` (start, label), the detections that stay ``detections`` (start, end, label,
    level), ``base_labels`` and ``labels`` (distinct, sorted) and ``score``."""
    rules = default_rules() if rules is None else tuple(rules)
    levels = sorted(SCORES)
    new = ("n_words", "base_places", "detections", "base_labels", "labels", "score")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    words, chosen, found, stay = scratch_names(df.columns, ("words", "chosen", "found", "stay"))
    base = [i for i, r in enumerate(rules) if r.base]
    labels = constant([r.label for r in rules], "array<string>")
    label_of = lambda d: F.element_at(labels, d["rule"] + 1)
    none = F.array().cast(f"array<{DETECTION}>")

    first = df.withColumn(words, words_of(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    first = first.withColumn(chosen, selected(F.col(words), rules))
    second = first.withColumn(found, F.when(F.size(chosen) == 0, none).otherwise(ordered(detections(numbered(F.col(words)), F.col(chosen)))))
    third = second.withColumn(stay, F.when(F.size(found) == 0, none).otherwise(unsuppressed(F.col(found), levels)))
    at_base = F.array_sort(F.transform(F.filter(found, lambda d: d["rule"].isin(base)), lambda d: F.struct(d["start"].alias("start"), label_of(d).alias("label"))))
    base_labels = F.array_sort(F.array_distinct(F.transform(at_base, lambda p: p["label"])))
    spans = F.transform(stay, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), label_of(d).alias("label"), d["level"].alias("level")))
    own = F.transform(F.filter(stay, lambda d: ~d["rule"].isin(base)), label_of)
    strongest = F.array_min(F.transform(stay, lambda d: d["level"]))
    score = F.lit(0.0)
    for x in reversed(levels):
        score = F.when(strongest == x, F.lit(SCORES[x])).otherwise(score)
    return third.select(*kept, F.size(words).cast("long").alias("n_words"), at_base.alias("base_places"), spans.alias("detections"), base_labels.alias("base_labels"),
                        F.array_sort(F.array_distinct(F.concat(base_labels, own))).alias("labels"), score.alias("score"))
