"""Unit tests on small literal frames (FIXTURES §4) and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from gradelens.functions.labels import vehicle_class
from gradelens.functions.predicates import Selection, validate_selection
from gradelens.operators import assemble, association, clean, fold, model, outcome, quota, shape
from gradelens.spec import OutcomeSpec

SPEC = OutcomeSpec("outcome", ("low", "mid", "high"), ("low", "mid", "high"))


def frame(spark, rows, schema="key string, outcome string"):
    return spark.createDataFrame(rows, schema)


MIXED = [("a", "low"), ("a", "high"), ("a", None), (None, "mid"), (None, "low"),
         ("b", "other"), ("b", "mid"), ("b", "high")]


def test_breakdown_null_key_and_unlisted_outcome(spark):
    rows = {r["key"]: r for r in outcome.breakdown(frame(spark, MIXED), "key", SPEC).collect()}
    assert set(rows) == {"a", "b", None}
    assert rows["a"]["total"] == 3 and rows["a"]["low"] + rows["a"]["mid"] + rows["a"]["high"] == 2
    assert rows["b"]["total"] == 3 and rows["b"]["mid"] == 1 and rows["b"]["high"] == 1
    assert rows["a"]["risk"] == pytest.approx(3 / 3)
    assert rows["a"]["high_rate"] == pytest.approx(1 / 3)


def test_breakdown_tie_break_and_limit(spark):
    df = frame(spark, [("y", "low"), ("y", "low"), ("x", "mid"), ("x", "mid")])
    keys = [r["key"] for r in outcome.breakdown(df, "key", SPEC, limit=1).collect()]
    assert keys == ["x"]
    with pytest.raises(ValueError):
        outcome.breakdown(df, "key", SPEC, limit=5000)


def test_breakdown_typed_filter_and_min_count(spark):
    df = spark.createDataFrame([(1, "low"), (1, "high"), (2, "mid"), (3, "low")], "n int, outcome string")
    rows = outcome.breakdown(df, "n", SPEC, Selection({"n": ["1", 2, "01", "x"]}), min_count=2).collect()
    assert [(r["key"], r["total"]) for r in rows] == [("1", 2)]


def test_selection_validation(spark):
    df = frame(spark, MIXED)
    for bad in ({"nope": ["a"]}, {"key": "a"}, {"key": []}):
        with pytest.raises(ValueError):
            validate_selection(df, bad)
    sel = Selection({"key": ["a"], "outcome": ["low"]}, {"hour": (1, 2)})
    assert sel.without("key").values == {"outcome": ["low"]}
    assert sel.without(drop_ranges=("hour",)).ranges == {}


def test_cramers_v_edges_and_bounds(spark):
    one = frame(spark, [("a", "low"), ("a", "high")])
    assert association.cramers_v(one, ["key"], SPEC).first()["v"] == 0.0
    empty = frame(spark, [], "key string, outcome string")
    assert association.cramers_v(empty, ["key"], SPEC).count() == 0
    perfect = frame(spark, [("a", "low")] * 5 + [("b", "high")] * 5)
    assert association.cramers_v(perfect, ["key"], SPEC).first()["v"] == 1.0
    mixed = frame(spark, MIXED)
    v1 = association.cramers_v(mixed, ["key"], SPEC).first()["v"]
    v2 = association.cramers_v(mixed.orderBy(F.rand(7)), ["key"], SPEC).first()["v"]
    assert 0.0 <= v1 <= 1.0 and v1 == v2


def test_kpis_and_lift_empty_selection(spark):
    df = spark.createDataFrame([(1, True, 3, "low")], "m int, wk boolean, h int, outcome string")
    k = outcome.kpis(df, SPEC, "m", "wk", "h", Selection({"outcome": ["zzz"]})).first()
    assert k["total"] == 0 and k["high_pct"] == 0.0 and k["avg_m"] == 0.0 and k["peak_hour"] is None
    lift = outcome.condition_lift(df, SPEC, {"c": F.col("m") > 5}, Selection({"outcome": ["zzz"]})).first()
    assert lift["value"] == 0.0 and lift["baseline"] == 0.0


def test_peak_tie_smallest(spark):
    df = spark.createDataFrame([(3,), (5,), (5,), (3,)], "h int")
    assert outcome.peak(df, "h").first()[0] == 3


def test_fold_preserves_totals_and_shares_sum_to_one(spark):
    df = frame(spark, MIXED)
    rows = outcome.breakdown(df, "key", SPEC)
    folded = fold.fold(rows, lambda c: F.when(c == "b", F.lit("a")).otherwise(c), SPEC)
    # folding keeps every row whose mapped key is not NULL (the NULL key maps to NULL)
    kept = rows.filter(F.col("key").isNotNull()).agg(F.sum("total")).first()[0]
    assert folded.agg(F.sum("total")).first()[0] == kept == 6
    dropped = fold.fold(rows, lambda c: F.when(c == "b", F.lit(None)).otherwise(c), SPEC)
    assert dropped.agg(F.sum("total")).first()[0] == 3  # only "a" survives
    shares = shape.with_share(rows).agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(1.0)


def test_vehicle_class_rules(spark):
    labels = ["Minibus/Motor caravan (1979-1998)", "Car", "Mobility scooter",
              "Goods vehicle - unknown weight", "Taxi/Private hire car", "Tram"]
    df = spark.createDataFrame([(x,) for x in labels], "v string")
    got = [r[0] for r in df.select(vehicle_class(F.col("v"))).collect()]
    assert got == ["Other", "Four-wheeler", "Two-wheeler", "Long chassis", "Four-wheeler", "Other"]


def test_code_list_cleaning(spark):
    raw = spark.createDataFrame(
        [("t", "f", "1", "Good"), ("t", "f", "2", "Data missing or out of range"), ("t", "f", "3", None),
         ("t", "f", "x", "Bad"), ("t", "f", None, None)],
        "table string, field string, code string, label string")
    got = {r["code"]: r["label"] for r in assemble.code_list(raw).collect()}
    assert got == {1: "Good", 2: "Unknown", 3: "Unknown"}


def test_first_child_fan_out_and_unmatched(spark):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "pk int")
    child = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 2, "d")], "ck int, ref int, v string")
    out = assemble.first_child(parent, child, "pk", "ck", ref=F.col("ref") == 1)
    got = sorted((r["pk"], r["v"]) for r in out.collect())
    assert got == [(1, "a"), (1, "b"), (2, None), (3, None)]
    one = assemble.first_child(parent, child, "pk", "ck", ref=F.col("ref") == 1, dedupe=True)
    assert one.count() == 3


def test_time_parse_both_branches(spark):
    df = spark.createDataFrame([("7:05:00",), ("17:05:00",), ("25:00:00",), ("bad",), (None,)], "t string")
    got = [r["Hour"] for r in clean.derive_hour(df, "t").collect()]
    assert got == [7, 17, 12, 12, 12]
    df2 = spark.createDataFrame([("17 h",), ("17 h",), ("3 h",)], "t string")
    assert [r["Hour"] for r in clean.derive_hour(df2, "t").collect()] == [17, 17, 3]


def test_text_cleaning_tokens(spark):
    df = spark.createDataFrame([(" a  b ",), ("NA",), ("?",), ("",), ("Unknown",), (" x \ty ",)], "s string")
    got = [r[0] for r in clean.clean_text(df).collect()]
    assert got == ["a b", None, None, None, None, "x y"]
    filled = [r[0] for r in clean.fill_unknown(clean.clean_text(df)).collect()]
    assert filled[1] == "Unknown"


def test_median_fill_half_even_and_clip(spark):
    df = spark.createDataFrame([("2",), ("x",), ("-3",), ("2.5",), (None,)], "n string")
    assert [r[0] for r in clean.median_fill(df, "n").collect()] == [2, 2, 1, 2, 2]
    none = spark.createDataFrame([("x",), (None,)], "n string")
    assert [r[0] for r in clean.median_fill(none, "n").collect()] == [1, 1]


def test_required_and_leak_guard(spark):
    df = frame(spark, MIXED)
    with pytest.raises(ValueError):
        clean.require(df, ["key", "missing"])
    with pytest.raises(ValueError):
        clean.require(df, ["key"], forbidden=["outcome"])
    with pytest.raises(ValueError):
        model.check_features(df.columns, ["key", "rank"], [], forbidden=["rank"])


def test_quota_sizes_largest_remainder(spark):
    w = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "label string, w long")
    for n, want in ((7, {"a": 4, "b": 2, "c": 1}), (1, {"a": 1, "b": 0, "c": 0})):
        got = {r["label"]: r["size"] for r in quota.quota_sizes(w, "label", "w", n).collect()}
        assert got == want and sum(got.values()) == n


def test_quota_assignment_exact_counts(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    w = spark.createDataFrame([("a", 7), ("b", 2), ("c", 1)], "label string, w long")
    sizes = quota.quota_sizes(w, "label", "w", 1000)
    got = quota.assign(rows, ["k"], sizes, seed=3)
    counts = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}
    assert counts == {"a": 700, "b": 200, "c": 100}
    assert got.select("k").distinct().count() == 1000
    chk = quota.check(got, sizes).agg(F.max("diff_pp")).first()[0]
    assert chk <= 0.001


def test_balanced_expansion(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    out = quota.expand(rows, ["k"], 25, seed=1)
    assert out.count() == 25
    per = sorted(r["count"] for r in out.groupBy("k").count().collect())
    assert per == [2] * 5 + [3] * 5


def test_split_is_leak_free(spark):
    df = spark.range(400).select((F.col("id") % 37).cast("string").alias("f"),
                                 (F.col("id") % 3).cast("string").alias("label"))
    combos = df.groupBy("f", "label").agg(F.count(F.lit(1)).alias("weight"))
    s = model.split(combos, ["f"], 0.2, 42)
    both = s.groupBy("f").agg(F.countDistinct("is_test").alias("sides")).filter("sides > 1")
    assert both.count() == 0
    assert s.count() == combos.count()


def test_metrics_zero_division(spark):
    rows = [("a", "a", 2.0), ("a", "b", 1.0), ("b", "b", 3.0), ("c", "b", 1.0), ("c", "a", 1.0), ("b", "a", 1.0)]
    conf = model.confusion(spark.createDataFrame(rows, "label string, predicted string, weight double"))
    per = {r["label"]: r for r in model.class_metrics(conf, ["a", "b", "c"]).collect()}
    assert per["c"]["precision"] == 0.0 and per["c"]["recall"] == 0.0 and per["c"]["f1"] == 0.0
    assert per["a"]["precision"] == pytest.approx(2 / 4)
    overall = model.overall_metrics(conf, ["a", "b", "c"]).first()
    assert overall["accuracy"] == pytest.approx(5 / 9)
    assert math.isclose(overall["macro_f1"], sum(per[c]["f1"] for c in "abc") / 3)


def test_scoring_defaults_and_unseen_levels(spark, tmp_path):
    rows = [("x", 1.0, "low")] * 30 + [("y", 5.0, "high")] * 30 + [("x", 5.0, "mid")] * 10
    df = spark.createDataFrame(rows, "c string, n double, outcome string")
    combos = model.combinations(df, ["c"], ["n"], "outcome")
    m = model.fit(combos, ["c"], ["n"], list(SPEC.levels), max_iter=20)
    scen = spark.createDataFrame([("x", 1.0), ("unseen", 0.0), (None, None)], "c string, n double")
    out = model.score(m, scen, list(SPEC.levels)).collect()
    assert len(out) == 3
    for r in out:
        assert r["p_low"] + r["p_mid"] + r["p_high"] == pytest.approx(1.0, abs=1e-5)  # 6-digit rounding
        assert len(r["contributions"]) <= 6
    imp = model.importance(m, spark=spark).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)
    # contributions against the encoded vector, and the same scores from a saved model
    sent = m.pipeline.transform(model.scenario_defaults(scen, m.cat, m.num)).select("encoded", "prediction").collect()
    full = model.score(m, scen, list(SPEC.levels), eps=-1.0, c_digits=None).collect()
    for r, e in zip(full, sent):
        parts = (e["encoded"].toArray() - m.means) * m.coef[int(e["prediction"])]
        want = {f: sum(p for p, s in zip(parts, m.slots) if s == f) for f in ("c", "n")}
        assert {c["feature"]: c["value"] for c in r["contributions"]} == pytest.approx(want)
    path = str(tmp_path / "model")
    m.save(path)
    m.save(path)      # overwrites
    assert model.score(model.SeverityModel.load(spark, path), scen, list(SPEC.levels)).collect() == out


def test_cleaning_report_counts(spark):
    rows = [("Slight", "a"), ("Slight", "a"), (" fatal ", None), ("xx", "b"), ("na", "c")]
    df = spark.createDataFrame(rows, "sev string, other string")
    from gradelens.functions.labels import SEVERITY_SYNONYMS
    out, report = clean.clean(df, "sev", SEVERITY_SYNONYMS)
    r = report.first().asDict()
    assert r == {"rows_in": 5, "duplicates_removed": 1, "categorical_cells_imputed": 2,
                 "unmappable_target_rows_dropped": 2, "rows_out": 2}
    assert sorted(tuple(x) for x in out.collect()) == [("Fatal injury", "Unknown"), ("Slight Injury", "a")]


def test_exact_median_matches_percentile(spark):
    from gradelens.operators.stats import exact_median
    df = spark.range(0, 1001).select(((F.col("id") * 7919) % 503).cast("double").alias("x"))
    df = df.union(spark.createDataFrame([(None,)], "x double"))
    for frame_ in (df, df.filter("x < 250"), df.limit(0)):
        got = frame_.sparkSession.range(1).select(exact_median(frame_, F.col("x"))).first()[0]
        want = frame_.select(F.median("x")).first()[0]
        assert got == want


def test_type_compaction(spark):
    df = spark.createDataFrame([("3", "True"), ("x", "false"), ("2.0", "1"), (None, None)], "n string, b string")
    got = [tuple(r) for r in clean.compact(df, shorts=["n"], bools=["b"]).collect()]
    assert got == [(3, True), (0, False), (2, True), (0, False)]
    assert dict(clean.compact(df, shorts=["n"], bools=["b"]).dtypes) == {"n": "smallint", "b": "boolean"}


def test_model_fallback():
    a, b = object(), object()
    assert model.resolve({"x": a, "y": b}, "x", "y") is a
    assert model.resolve({"y": b}, "x", "y") is b
    with pytest.raises(LookupError):
        model.resolve({}, "x", "y")


def test_presets_on_a_record_frame(spark):
    from gradelens.plans import presets
    schema = ("Light_conditions string, Time_of_day string, Is_weekend boolean, Number_of_vehicles_involved short, "
              "Weather_conditions string, Cause_of_accident string, Area_accident_occured string, "
              "Accident_severity string")
    rows = [("Darkness - lights lit", "Night (0-5)", True, 3, "Raining", "Driving at high speed", "Rural",
             "Fatal injury"),
            ("Daylight", "Morning (6-11)", False, 1, "Fine", "Other", "Urban", "Slight Injury")]
    df = spark.createDataFrame(rows, schema)
    for ds in ("india", "uk"):
        out = {r["axis"]: r for r in outcome.condition_lift(df, presets.SEVERITY, presets.conditions(ds)).collect()}
        assert list(out) == [name for name, _ in presets.CONDITIONS[ds]]
        assert all(r["n"] == 1 and r["value"] == 100.0 and r["baseline"] == 50.0 for r in out.values())
    with pytest.raises(ValueError):
        presets.conditions("elsewhere")


def test_positions_are_permutations(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    flat = quota.positions(df, ["k"], seed=5)
    assert sorted(r[0] for r in flat.select("_pos").collect()) == list(range(1000))
    grouped = quota.positions(df, ["k"], seed=5, group="g")
    for g in range(3):
        n = df.filter(F.col("g") == g).count()
        got = sorted(r[0] for r in grouped.filter(F.col("g") == g).select("_pos").collect())
        assert got == list(range(n))
    again = quota.positions(df, ["k"], seed=5)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in flat.collect()}


def test_derive_record_columns(spark):
    df = spark.createDataFrame([("7:05:00", "Sunday", "Fatal injury"), ("22:10:00", "Monday", "Slight Injury"),
                                ("bad", "Saturday", "x")], "Time string, Day_of_week string, Accident_severity string")
    levels = ["Slight Injury", "Serious Injury", "Fatal injury"]
    got = [tuple(r) for r in clean.derive(df, levels).select("Hour", "Time_of_day", "Is_weekend",
                                                            "Severity_rank").collect()]
    assert got == [(7, "Morning (6-11)", True, 2), (22, "Night (0-5)", False, 0), (14, "Afternoon (12-16)", True, None)]


def test_exact_rounding_half_even(spark):
    from gradelens.functions.numeric import round_ratio
    rows = [(1, 8), (3, 8), (201, 200), (203, 200), (1, 3), (2, 3), (0, 5), (5, 0), (-1, 8)]
    df = spark.createDataFrame(rows, "n long, d long")
    got = [r[0] for r in df.select(round_ratio("n", "d", 2)).collect()]
    # 0.125 -> 0.12 (even), 0.375 -> 0.38 (even), 1.005 -> 1.0, 1.015 -> 1.02, thirds, zero den -> 0
    assert got == [0.12, 0.38, 1.0, 1.02, 0.33, 0.67, 0.0, 0.0, -0.12]


def test_levels_keep_null_last_and_ties_keep_field_order(spark):
    from gradelens.operators import profile
    df = spark.createDataFrame([("b", "x"), (None, "x"), ("a", "x")], "f string, g string")
    got = {r["field"]: r["levels"] for r in profile.levels(df, ["f", "g"]).collect()}
    assert got == {"f": ["a", "b", None], "g": ["x"]}
    same = spark.createDataFrame([("a", "a", "low"), ("b", "b", "high")] * 3, "z string, y string, outcome string")
    assert [r["field"] for r in association.cramers_v(same, ["z", "y"], SPEC).collect()] == ["z", "y"]
    assert [r["field"] for r in association.cramers_v(same, ["y", "z"], SPEC).collect()] == ["y", "z"]


def test_pct_text(spark):
    from gradelens.functions.numeric import pct_text
    vals = [12.34, 12.0, 100.0, 0.5, 0.123, 0.05, 0.0004, 0.0, -1.0, None, 1.25, 0.1]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(pct_text("v")).collect()]
    assert got == ["12.3", "12", "100", "0.5", "0.12", "0.05", "<0.001", "0", "0", "0", "1.3", "0.1"]


def test_first_child_null_keys_match_nothing(spark):
    parent = spark.createDataFrame([(1, "p"), (None, "q"), (None, "r"), (2, "s")], "k int, pv string")
    child = spark.createDataFrame([(1, "a"), (None, "b")], "ck long, v string")
    got = assemble.first_child(parent, child, "k", "ck")
    assert sorted((r.pv, r.ck, r.v) for r in got.collect()) == [("p", 1, "a"), ("q", None, None), ("r", None, None), ("s", None, None)]


def test_first_child_same_key_name_and_flags(spark):
    parent = spark.createDataFrame([(1, "p1"), (2, "p2")], "k int, pv string")
    child = spark.createDataFrame([(1, 1, "R"), (1, 2, "N"), (2, 2, "R")], "k int, ref int, flag string")
    out = assemble.first_child(parent, child, "k", "k", ref=F.col("ref") == 1)
    flags = assemble.child_flags(child, "k", {"has_r": F.col("flag") == "R"})
    got = sorted(tuple(r) for r in assemble.attach_flags(out, flags, "k", "k").select("k", "ref", "has_r").collect())
    assert got == [(1, 1, 1), (2, None, 1)]


def test_decode_duplicate_and_bad_codes(spark):
    codes = spark.createDataFrame([("t", "f", 1, "B"), ("t", "f", 1, "A"), ("t", "f", 2, "C")],
                                  "table string, field string, code long, label string")
    df = spark.createDataFrame([(1,), (2,), (3,)], "c int")
    got = sorted(tuple(r) for r in assemble.decode(df, "c", codes, "t", "f", "none", name="label").collect())
    assert got == [(1, "A"), (2, "C"), (3, "none")]  # no fan-out on duplicate codes
    raw = spark.createDataFrame([("t", "f", "1", "A", 2), ("t", "f", "1", "B", 3), ("t", "f", "1", "C", 1)],
                                "table string, field string, code string, label string, row int")
    listed = assemble.code_list(raw, order_col="row")
    assert assemble.decode(df.limit(1), "c", listed, "t", "f", "none", name="label").first()["label"] == "B"
    text = spark.createDataFrame([("1",), ("x",), (None,)], "c string")
    got = sorted(tuple(r) for r in assemble.decode(text, "c", codes, "t", "f", "none", name="label").select("label").collect())
    assert got == [("A",), ("none",), ("none",)]  # text that is not a number gets the default


def test_surviving_filters_and_dense_grid(spark):
    from gradelens.operators import selection
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    got = sorted(tuple(r) for r in selection.surviving({"s": ["a", "z"], "n": ["2", "x"], "gone": ["q"]}, df).collect())
    assert got == [("n", "2"), ("s", "a")]
    agg = spark.createDataFrame([("x", 1, 5), ("q", 9, 7)], "x string, y int, total long")
    cells = shape.grid(spark, ["x", "w"], [1, 2])
    dense = sorted(tuple(r) for r in shape.dense(agg, cells, ["x", "y"], ["total"]).collect())
    assert dense == [("w", 1, 0), ("w", 2, 0), ("x", 1, 5), ("x", 2, 0)]


def test_train_flow_end_to_end(spark):
    from tests.conftest import SF_SMALL
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").withColumn("rank", F.lit(1))
    res = model.train_flow(li, ["l_linestatus", "l_linenumber", "missing_col"], ["l_tax", "l_quantity"],
                           "l_returnflag", ["N", "A", "R"], forbidden=["rank"], use_pca=True)
    m = res.metrics.first()
    assert 0.0 <= m["accuracy"] <= 1.0 and m["n_test"] > 0
    assert sorted(r["label"] for r in res.per_class.collect()) == sorted(res.model.classes)
    assert {r["field"] for r in res.levels.collect()} == {"l_linestatus", "l_linenumber"}
    assert sum(r["importance"] for r in res.importances.collect()) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        model.train_flow(li, ["rank"], [], "l_returnflag", ["N", "A", "R"], forbidden=["rank"])


def test_positions_spread_duplicate_keys(spark):
    # one key tuple or one row holding most rows must not land in one partition
    hot = F.when(F.col("id") < 75_000, F.lit(7)).otherwise(F.col("id")).alias("k")
    for df in (spark.range(100_000).select(hot, F.col("id").alias("v")), spark.range(100_000).select(hot)):
        pos = quota.positions(df, ["k"], seed=1)
        got = pos.agg(F.count(F.lit(1)), F.countDistinct("_pos"), F.min("_pos"), F.max("_pos")).first()
        assert tuple(got) == (100_000, 100_000, 0, 99_999)
        sizes = [r[0] for r in pos.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) < 60_000


def test_positions_depend_on_seed_and_data_only(spark):
    df = spark.range(3000).select((F.col("id") % 1500).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts in (8, 13):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = quota.positions(df.repartition(parts), ["k"], seed=5, group="g", total="n").collect()
            seen.append(sorted((r.k, -1 if r.g is None else r.g, r._pos, r.n) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] and len(seen[0]) == 3000
    other = quota.positions(df, ["k"], seed=6, group="g", total="n").collect()
    assert sorted((r.k, -1 if r.g is None else r.g, r._pos, r.n) for r in other) != seen[0]


def test_expansion_of_few_rows_spreads(spark):
    out = quota.expand(spark.createDataFrame([(1,), (1,)], "k int"), ["k"], 60_001, seed=1)
    assert out.count() == 60_001
    assert max(r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()) < 60_001
    assert quota.expand(spark.createDataFrame([], "k int"), ["k"], 5, seed=1).count() == 0


def test_decode_map_text_keys_on_numbers(spark):
    from gradelens.functions.labels import decode_map
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "c int")
    got = [r[0] for r in df.select(decode_map("c", {"1": "Fatal injury", "2": "Serious Injury"}, "Unknown")).collect()]
    assert got == ["Fatal injury", "Serious Injury", "Unknown", "Unknown"]


def test_flat_record_two_children_and_flags(spark):
    parent = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3")], "pk int, pv string")
    veh = spark.createDataFrame([(1, 1, "car"), (1, 2, "bus"), (2, 1, "van")], "vk int, vref int, vtype string")
    cas = spark.createDataFrame([(1, 1, "driver"), (3, 1, "pedestrian"), (3, 2, "passenger")],
                                "ck int, cref int, cclass string")
    out = assemble.flat_record(
        parent, "pk",
        children=[(veh, "vk", F.col("vref") == 1), (cas, "ck", F.col("cref") == 1)],
        flags=[(cas, "ck", {"has_ped": F.col("cclass") == "pedestrian"})],
        projection=[F.col("pk"), F.coalesce("vtype", F.lit("Unknown")).alias("vehicle"),
                    F.coalesce("cclass", F.lit("Unknown")).alias("casualty"), F.col("has_ped")])
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, "car", "driver", 0), (2, "van", "Unknown", None), (3, "Unknown", "pedestrian", 1)]
