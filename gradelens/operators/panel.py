"""Many filtered breakdowns from one scan: facet panels (P3) and tables of selections (P4, filter JSON as data).

A panel carries, for each row, a bit mask of the predicates that it fails.  A row counts for a facet if it fails none but the
facet's own, so every chart of a dashboard comes from the same pass: one scan, one partial aggregate by (facet, key), one shuffle of
at most a row per facet and key and partition.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens.functions.numeric import with_rates
from gradelens.functions.predicates import Selection, require_columns, where
from gradelens.operators.outcome import outcome_counts
from gradelens.spec import OutcomeSpec

#: Predicates of one selection: the mask is a long.
MAX_PREDICATES = 62
#: Selections that are evaluated side by side; larger tables go in several calls.
MAX_SELECTIONS = 1000


def failed_mask(clauses: Sequence[Column]) -> Column:
    """Bit i is set where predicate i does not hold (NULL does not hold)."""
    if len(clauses) > MAX_PREDICATES:
        raise ValueError(f"at most {MAX_PREDICATES} predicates")
    bits = [F.when(c, F.lit(0)).otherwise(F.lit(1 << i)).cast("long") for i, c in enumerate(clauses)]
    return reduce(lambda a, b: a + b, bits, F.lit(0).cast("long"))


def facet_panel(df: DataFrame, facets: Sequence[str] | Mapping[str, Sequence[str]], spec: OutcomeSpec,
                selection: Selection | None = None, min_count: int = 0) -> DataFrame:
    """P3 + A1: ``(facet, key, total, counts, rates)`` of every facet, each without its own filters.

    ``facets`` are columns; a mapping names the fields whose values and ranges each of them ignores (the column itself by default).
    Equal to one ``breakdown_all`` per facet.  Predicates that no facet ignores are a plain filter and reach the scan.
    """
    selection = selection or Selection()
    own = {f: tuple(facets[f]) if isinstance(facets, Mapping) else (f,) for f in facets}
    require_columns(df, [*own, spec.column])
    clauses = selection.clauses(df)
    shared = [c for name, c in clauses if not any(name in fields for fields in own.values())]
    loose = [(name, c) for name, c in clauses if any(name in fields for fields in own.values())]
    src = df.filter(reduce(lambda a, b: a & b, shared)) if shared else df

    def counts_for(fields):
        ignored = sum(1 << i for i, (name, _) in enumerate(loose) if name in fields)
        return F.col("_failed").bitwiseAND(F.lit(~ignored)) == 0

    masked = src.select(spec.column, *[F.col(f).cast("string").alias(f"_key{i}") for i, f in enumerate(own)],
                        failed_mask([c for _, c in loose]).alias("_failed"))
    shown = [F.struct(F.lit(f).alias("facet"), F.col(f"_key{i}").alias("key"), counts_for(fields).alias("_shown"))
             for i, (f, fields) in enumerate(own.items())]
    any_shown = reduce(lambda a, b: a | b, [counts_for(fields) for fields in own.values()])
    rows = masked.filter(any_shown).select(spec.column, F.inline(F.array(*shown))).filter("_shown")
    counts = outcome_counts(rows, ["facet", "key"], spec)
    if min_count > 0:
        counts = counts.filter(F.col("total") >= F.lit(min_count))
    return with_rates(counts, spec)


def read_selections(selections: DataFrame, columns: Sequence[str], id_col: str = "id", text: str = "filters") -> DataFrame:
    """P4 as data: ``(id, values, error)`` of rows whose ``text`` is a JSON object ``{field: [values]}``.

    ``values`` maps fields to value texts (numbers and booleans as JSON writes them), NULL where ``error`` says what is wrong: no
    object, an unknown field, or something else than a non-empty list.  NULL and empty texts select everything.  Of a repeated field the last
    list counts.
    """
    raw = F.col(text)
    blank = raw.isNull() | (F.trim(raw) == "")
    parsed = F.from_json(raw, "map<string,string>")
    fields = F.map_entries(parsed)
    last = F.filter(fields, lambda e, i: ~F.exists(F.slice(fields, i + 2, F.greatest(F.size(fields), F.lit(1))), lambda x: x["key"] == e["key"]))
    lists = F.transform(last, lambda e: F.struct(e["key"].alias("key"), F.when(e["value"].startswith("["), F.from_json(e["value"], "array<string>")).alias("value")))
    known = F.array(*[F.lit(c) for c in columns])
    unknown = F.get(F.filter(lists, lambda e: ~F.array_contains(known, e["key"])), F.lit(0))["key"]
    broken = F.get(F.filter(lists, lambda e: e["value"].isNull() | (F.size(e["value"]) == 0)), F.lit(0))["key"]
    # an array parses as a map without fields only by accident: the text must begin as an object does
    error = (F.when(blank, F.lit(None).cast("string"))
             .when(parsed.isNull() | ~F.trim(raw).startswith("{"), F.lit("filters must be a JSON object {field: [values]}"))
             .when(unknown.isNotNull(), F.concat(F.lit("unknown filter field '"), unknown, F.lit("'")))
             .when(broken.isNotNull(), F.concat(F.lit("filter '"), broken, F.lit("' needs a non-empty list"))))
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:array<string>>>"))
    step = selections.select(F.col(id_col).alias("id"), error.alias("error"), F.when(blank, empty).otherwise(F.map_from_entries(lists)).alias("values"))
    return step.select("id", F.when(F.col("error").isNull(), F.col("values")).alias("values"), "error")


def breakdown_by_selection(df: DataFrame, selections: DataFrame, by: str, spec: OutcomeSpec, id_col: str = "id", text: str = "filters",
                           min_count: int = 0) -> DataFrame:
    """A1 for every selection of a table (``read_selections``), in one scan of ``df``.

    ``(selection, error, key, total, counts, rates)``: the groups of each good selection, and one row with its error for each broken one.  A
    selection without a matching row has no row.  Values are compared as text.  The selections, at most ``MAX_SELECTIONS``, are one
    constant that every row is held against; columns are read only if a selection names them.
    """
    require_columns(df, [by, spec.column])
    n = selections.count()
    if n > MAX_SELECTIONS:
        raise ValueError(f"{n} selections; at most {MAX_SELECTIONS} in one call")
    read = read_selections(selections, df.columns, id_col, text)
    good, broken = read.filter(F.col("error").isNull()), read.filter(F.col("error").isNotNull())
    used = sorted(r[0] for r in good.select(F.explode(F.map_keys("values"))).distinct().collect())      # at most one per column
    # the good selections as one constant, folded into the plan
    as_json = [r[0] for r in good.select(F.to_json(F.struct("id", F.map_entries("values").alias("fields")))).collect()]
    kind = f"array<struct<id:{good.schema['id'].dataType.simpleString()},fields:array<struct<key:string,value:array<string>>>>>"
    listed = F.from_json(F.lit(f"[{','.join(as_json)}]"), kind)
    texts = F.create_map(*[x for c in used for x in (F.lit(c), F.col(c).cast("string"))]) if used else F.lit(None).cast("map<string,string>")
    rows = df.select(spec.column, F.col(by).cast("string").alias("key"), texts.alias("_texts"))
    fits = F.filter(listed, lambda s: F.forall(s["fields"], lambda e: F.coalesce(F.array_contains(e["value"], F.element_at("_texts", e["key"])), F.lit(False))))
    hits = rows.select(spec.column, "key", F.explode(F.transform(fits, lambda s: s["id"])).alias("selection"))
    counts = outcome_counts(hits, ["selection", "key"], spec)
    if min_count > 0:
        counts = counts.filter(F.col("total") >= F.lit(min_count))
    shown = with_rates(counts, spec)
    errors = broken.select(F.col("id").alias("selection"), "error")
    return shown.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


def breakdowns_apart(df: DataFrame, facets: Mapping[str, Sequence[str]], spec: OutcomeSpec, selection: Selection) -> DataFrame:
    """The same rows as ``facet_panel`` from one query per facet (for comparison)."""
    parts = []
    for f, fields in facets.items():
        src = where(df, selection.without(*fields))
        counts = outcome_counts(src, [F.lit(f).alias("facet"), F.col(f).cast("string").alias("key")], spec)
        parts.append(with_rates(counts, spec))
    return reduce(DataFrame.unionByName, parts)
