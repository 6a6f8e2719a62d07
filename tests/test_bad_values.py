"""Values that must not end a job, be cut, or lose rows."""

from pyspark.sql import functions as F

from gradelens.functions import bands
from gradelens.functions.predicates import typed_values
from gradelens.operators import clean, model
from gradelens.plans import reports
from gradelens.sources import io
from gradelens.spec import OutcomeSpec


def test_shares_and_folds_cover_every_group(spark):
    spec = OutcomeSpec("sev", ("l", "m", "h"), ("low", "mid", "high"), (0, 1, 3))
    df = spark.range(3000).select((F.col("id") % 300).cast("string").alias("g"), F.lit("l").alias("sev"))
    rows = reports.folded_breakdown(df, "g", spec, None, lambda c: F.lit("all"))
    assert [(r.key, r.total) for r in rows.collect()] == [("all", 3000)]
    top = reports.share_top(df, "g", spec, None, k=4).collect()
    assert len(top) == 4 and all(abs(r.share - 10 / 3000) < 1e-12 for r in top) and sorted(r.pos for r in top) == [1, 2, 3, 4]


def test_split_keeps_null_features(spark):
    rows = [(None if i % 3 == 0 else f"f{i}", i, "ab"[i % 2], 1) for i in range(20)]
    combos = spark.createDataFrame(rows, "f string, n long, label string, weight long")
    out = model.split(combos, ["f", "n"])
    assert out.count() == 20 and out.where("f IS NULL").count() == 7


def test_bad_numbers_and_times(spark):
    df = spark.createDataFrame([("99999", "1"), ("3.0", "inf"), ("x", "nan"), (None, "3")], "s string, v string")
    assert [r.s for r in clean.compact(df.select("s"), shorts=["s"]).collect()] == [0, 3, 0, 0]
    assert [r.v for r in clean.median_fill(df.select("v"), "v").collect()] == [1, 2, 2, 3]
    times = spark.createDataFrame([("9:5:3",), ("09:05:03",), ("25:00:00",), ("x",)], "t string")
    assert [r[0] for r in times.select(bands.hour_of_time_text("t")).collect()] == [9, 9, None, None]


def test_integer_filters_compare_text(spark):
    assert typed_values(spark.range(1), "id", ["1", "01", " 2 ", "-3", 4]) == [1, -3, 4]


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    rows = [(1, 'a "quoted", b'), (2, "two\nlines"), (3, "plain")]
    path = str(tmp_path / "out")
    io.write_csv(spark.createDataFrame(rows, "id int, t string").coalesce(1), path)
    back = io.read_csv_typed(spark, path, {"id": "int", "t": "string"})
    assert sorted(tuple(r) for r in back.collect()) == rows
    assert io.source_row_counts(spark, {"x": path}).collect()[0].rows == 3
    assert io.read_csv_text(spark, path).count() == 3


def test_median_does_not_depend_on_plan_settings(spark):
    from gradelens.operators.stats import exact_medians
    df = spark.range(40_001).select((F.col("id") * 7919 % 40_009).alias("a"), F.when(F.col("id") < 10, F.col("id")).alias("b"),
                                    F.lit(None).cast("int").alias("c"))
    want = tuple(df.agg(F.percentile("a", 0.5), F.percentile("b", 0.5), F.percentile("c", 0.5)).first())
    keys = ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k, "true") for k in keys}
    try:
        for reuse, aqe in (("true", "true"), ("false", "true"), ("true", "false"), ("false", "false")):
            spark.conf.set(keys[0], reuse)
            spark.conf.set(keys[1], aqe)
            m = exact_medians(df, {n: F.col(n) for n in "abc"})
            assert tuple(spark.range(1).select(*[m[n] for n in "abc"]).first()) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_numbers_past_bigint_take_its_end_and_count_in_the_median(spark):
    df = spark.createDataFrame([("40000123456789012345678", "-1e30"), ("9223372036854775807", "1e19"), ("7", None), ("8", "4"), (None, "x")], "a string, b string")
    most = 2 ** 63 - 1
    assert [r.a for r in clean.median_fill(df, "a").collect()][:4] == [most, most, 7, 8]
    assert clean.median_fill(df, "a").collect()[4].a == 4611686018427387904     # the mean of 8 and 2^63, as a double
    assert [r.b for r in clean.median_fill(df, "b", lower=-1e40).collect()] == [-2 ** 63, most, 4, 4, 4]


def test_hours_of_empty_and_unparsed_tables(spark):
    empty = spark.createDataFrame([], "t string")
    assert clean.derive_hour(empty, "t").count() == 0
    none = spark.createDataFrame([("x",), (None,)], "t string")
    assert [r.Hour for r in clean.derive_hour(none, "t").collect()] == [12, 12]
    two = spark.createDataFrame([("99 h",), ("x",)], "t string")
    assert [r.Hour for r in clean.derive_hour(two, "t").collect()] == [23, 23]
