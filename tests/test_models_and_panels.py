"""Facet panels and selections, boosted trees, dictionary encoding, subspace components."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from gradelens.functions import bands
from gradelens.functions.predicates import Selection, typed_values
from gradelens.operators import bordered, encode, model, panel, subspace, trees
from gradelens.plans import selections as sel
from gradelens.plans.tables import LINE_OUTCOME, line_orders
from gradelens.spec import OutcomeSpec

SF = "/root/testdata/sf0.001"
SPEC = OutcomeSpec("y", ("l", "m", "h"), ("low", "mid", "high"), (0, 1, 3))


def test_panel_equals_single_breakdowns_in_one_scan(spark):
    df = line_orders(spark, SF)
    got = panel.facet_panel(df, sel.PANEL_FACETS, LINE_OUTCOME, sel.PANEL_SELECTION)
    apart = panel.breakdowns_apart(df, sel.PANEL_FACETS, LINE_OUTCOME, sel.PANEL_SELECTION)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, apart.select(*got.columns).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2      # lineitem and orders, once each


def test_panel_pushes_what_no_facet_ignores_and_counts_nulls_out(spark):
    df = spark.createDataFrame([("a", 1, "l"), ("b", None, "h"), (None, 2, "m"), ("a", 2, "h")], "f string, n int, y string")
    s = Selection({"f": ["a"]}, {"n": (2, None)})
    got = {(r.facet, r.key): r.total for r in panel.facet_panel(df, ["f"], SPEC, s).collect()}
    assert got == {("f", None): 1, ("f", "a"): 1}
    assert {(r.facet, r.key): r.total for r in panel.facet_panel(df, ["f", "n"], SPEC, s).collect()} == {("f", None): 1, ("f", "a"): 1, ("n", "1"): 1, ("n", "2"): 1}
    with pytest.raises(ValueError, match="predicates"):
        panel.failed_mask([F.lit(True)] * 63)


def test_selections_as_json(spark):
    texts = ['{"f": ["a"]}', '{"f": []}', '{"f": "a"}', "[1]", "{", None, "", '{"n": [1, 2], "f": ["a", "b"]}', '{"q": [1]}', '{"f": ["b"], "f": ["a"]}', '{"f": [null]}']
    df = spark.createDataFrame([("a", 1, "l"), ("b", 2, "h"), ("a", 3, "m")], "f string, n int, y string")
    read = {r.id: (r["values"], r.error) for r in panel.read_selections(spark.createDataFrame(list(enumerate(texts)), "id int, filters string"), df.columns).collect()}
    errors = {i: e for i, (_, e) in read.items() if e}
    assert errors == {1: "filter 'f' needs a non-empty list", 2: "filter 'f' needs a non-empty list", 3: "filters must be a JSON object {field: [values]}",
                      4: "filters must be a JSON object {field: [values]}", 8: "unknown filter field 'q'"}
    assert read[7][0] == {"n": ["1", "2"], "f": ["a", "b"]} and read[9][0] == {"f": ["a"]} and read[5][0] == {}
    rows = panel.breakdown_by_selection(df, spark.createDataFrame(list(enumerate(texts)), "id int, filters string"), "f", SPEC).collect()
    got = {(r.selection, r.key): r.total for r in rows if r.error is None}
    assert got == {(0, "a"): 2, (5, "a"): 2, (5, "b"): 1, (6, "a"): 2, (6, "b"): 1, (7, "a"): 1, (7, "b"): 1, (9, "a"): 2}
    assert {r.selection for r in rows if r.error} == set(errors)
    with pytest.raises(ValueError, match="selections"):
        panel.breakdown_by_selection(df, spark.range(1001).select("id", F.lit("{}").alias("filters")), "f", SPEC)


def test_filter_values_are_the_columns_text(spark):
    df = spark.createDataFrame([(1.0, 1, True)], "d double, i int, b boolean").select("*", F.lit("1.50").cast("decimal(5,2)").alias("x"))
    assert typed_values(df, "d", [1.0, "1.0", "1", True, "x", "0.5"]) == [1.0, 0.5]
    assert typed_values(df, "i", [10 ** 30, "2147483648", -5, "7", True]) == [-5, 7]
    assert [str(v) for v in typed_values(df, "x", ["1.50", "1.5", 1.5, "n/a", 10 ** 30, "9999.00", "NaN"])] == ["1.50"]
    for values in ([10 ** 30], ["n/a"], [1.5]):
        assert Selection({"x": values}).apply(df).count() == (values == [1.5])
    assert [r[0] for r in spark.createDataFrame([("n/a",), ("4",), (None,), ("-1",)], "t string").select(bands.number_band("t")).collect()] == ["Unknown", "3-5 yrs", "Unknown", "Unknown"]


def xor_rows(spark, n=900):
    """Three classes that no linear model of the fields separates, repeated over a numeric field."""
    rows = [(f"a{i % 2}", f"b{i // 2 % 2}", float(i % 7), "lmh"[(i % 2) ^ (i // 2 % 2) if i % 7 < 4 else 2], 1 + i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "f string, g string, x double, label string, weight long").groupBy("f", "g", "x", "label").agg(F.sum("weight").alias("weight"))


def log_loss(scored):
    p = F.when(F.col("label") == "l", F.col("p_l")).when(F.col("label") == "m", F.col("p_m")).otherwise(F.col("p_h"))
    return scored.agg((F.sum(-F.log(F.greatest(p, F.lit(1e-12))) * F.col("weight")) / F.sum("weight"))).first()[0]


def test_boosted_trees_beat_the_linear_model_and_come_back(spark, tmp_path):
    train = xor_rows(spark)
    linear = model.fit(train, ["f", "g"], ["x"], ["l", "m", "h"])
    boosted = model.fit(train, ["f", "g"], ["x"], ["l", "m", "h"], learner="boosted", rounds=12)
    scored = model.score(boosted, train, ["l", "m", "h"], top=99, eps=0.0, p_digits=None, c_digits=None, margins=True)
    rows = scored.collect()
    assert all(abs(r.p_l + r.p_m + r.p_h - 1) < 1e-9 and abs(r.base + sum(c.value for c in r.contributions) - r.margin) < 1e-9 for r in rows)
    assert log_loss(scored) < log_loss(model.score(linear, train, ["l", "m", "h"], p_digits=None)) - 0.1
    boosted.save(str(tmp_path / "m"))
    back = model.SeverityModel.load(spark, str(tmp_path / "m"))
    again = {(r.f, r.g, r.x, r.label): r for r in model.score(back, train, ["l", "m", "h"]).collect()}
    first = {(r.f, r.g, r.x, r.label): r for r in model.score(boosted, train, ["l", "m", "h"]).collect()}
    assert again == first and json.dumps(boosted.forests) and abs(sum(r.importance for r in model.importance(boosted).collect()) - 1) < 1e-9


def test_walks_of_a_known_tree(spark):
    tree = {"w": 0.5, "feature": [0, -1, 1, -1, -1], "cut": [0.5, 0, 2.0, 0, 0], "left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1], "value": [1.0, 0.0, 2.0, 3.0, 5.0]}
    df = spark.createDataFrame([([0.0, 9.0],), ([1.0, 2.0],), ([1.0, 3.0],)], "x array<double>")
    got = [[(s.f, s.d) for s in r[0]] for r in df.select(trees.split_changes([[tree]], F.lit(0), F.col("x"))).collect()]
    assert got == [[(0, -0.5)], [(0, 0.5), (1, 0.5)], [(0, 0.5), (1, 1.5)]] and trees.depth([tree]) == 2 and trees.roots([tree]) == 0.5


def test_dictionary_slots_are_those_of_the_stages(spark):
    rows = [("b", "x", 1.0), ("a", None, 0.0), ("c", "y", 2.5), ("a", "x", -1.0), (None, "z", 3.0)]
    df = spark.createDataFrame(rows, "f string, g string, n double")
    enc = encode.TableEncoder.fit(df, ["f", "g"], ["n"])
    stages = [StringIndexer(inputCols=["f", "g"], outputCols=["fi", "gi"], handleInvalid="keep", stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCols=["fi", "gi"], outputCols=["fo", "go"], dropLast=True), VectorAssembler(inputCols=["fo", "go", "n"], outputCol="e")]
    fitted = Pipeline(stages=stages).fit(df)
    unseen = df.union(spark.createDataFrame([("q", "x", 1.0), ("a", "q", 4.0)], df.schema))
    want = {(r.f, r.g, r.n): r.e.toArray().tolist() for r in fitted.transform(unseen).collect()}
    got = {(r.f, r.g, r.n): r.features.toArray().tolist() for r in enc.vectors(unseen).collect()}
    assert got == want and enc.size == 7
    assert {(r.slot, r.feature, r.level) for r in enc.slot_names().collect()} == {(0, "f", "a"), (1, "f", "b"), (2, "f", "c"), (3, "g", "x"), (4, "g", "y"), (5, "g", "z"), (6, "n", None)}


def test_a_large_field_is_fitted_without_its_labels_on_the_driver(spark):
    df = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id") % 100_000).alias("f"), (F.col("id") % 2).cast("double").alias("y"))
    enc = encode.TableEncoder.fit(df, ["f"], [])
    assert enc.size == 100_000 and enc.first == [0, 100_000]
    from pyspark.ml.classification import LogisticRegression
    train = enc.vectors(df)
    fitted = LogisticRegression(featuresCol="features", labelCol="y", maxIter=3, regParam=1e-4).fit(train)
    assert fitted.numFeatures == 100_000 and fitted.transform(train.limit(50)).where("prediction <> y").count() == 0


def test_subspace_components_are_those_of_pca(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), f"f{rng.integers(60)}", f"g{rng.integers(37)}", float(rng.normal()), float(3 * rng.normal())) for i in range(1500)]
    df = spark.createDataFrame(rows, "i long, f string, g string, x double, z double")
    enc = encode.TableEncoder.fit(df, ["f", "g"], ["x", "z"])
    assert 95 <= enc.size <= 99
    sparse = encode.kept(enc.transform(df), "sparse")
    got = subspace.components(sparse, enc.size, 0.95)
    want = PCA(k=enc.size, inputCol="features", outputCol="p").fit(enc.vectors(df)).explainedVariance.toArray()
    k = len(got.explained)
    assert k == model.components_for(want, 0.95) and np.abs(got.explained - want[:k]).max() < 1e-6
    assert np.allclose(got.vectors.T @ got.vectors, np.eye(k), atol=1e-8)
    r = subspace.project(sparse, got).first()
    dense = np.zeros(enc.size)
    dense[r.slots] = r["values"]
    assert np.allclose(dense @ got.vectors, r.reduced)


def test_subspace_components_of_many_slots(spark):
    size = 20_000
    df = spark.range(4000).select(F.array((F.col("id") * 7919 % (size - 2)).cast("int"), F.lit(size - 2), F.lit(size - 1)).alias("slots"),
                                  F.array(F.lit(1.0), F.sin(F.col("id")) * 50, F.cos(F.col("id")) * 20).alias("values"))
    got = subspace.components(df, size, 0.95, block=4)
    assert len(got.explained) == 2 and got.explained[0] > got.explained[1] > 0.1 and abs(abs(got.vectors[size - 2, 0]) - 1) < 1e-3


def test_flat_spectra_take_few_rounds_over_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    size, calls = 420, []
    level = rng.integers(0, 400, 3000)
    second, x = 400 + rng.integers(0, 18, 3000), rng.normal(size=3000)
    df = spark.createDataFrame([([int(a), int(b), 418], [1.0, 1.0, float(v)]) for a, b, v in zip(level, second, x)], "slots array<int>, values array<double>")
    dense = np.zeros((3000, size))
    dense[np.arange(3000), level] = dense[np.arange(3000), second] = 1
    dense[:, 418] = x
    want = np.linalg.eigvalsh(np.cov(dense.T))[::-1]
    want /= want.sum()
    was = subspace.multiplied
    monkeypatch.setattr(subspace, "multiplied", lambda *a: calls.append(1) or was(*a))
    got = subspace.components(df, size, 0.95)
    k = len(got.explained)
    assert k == model.components_for(want, 0.95) > 200 and np.abs(got.explained - want[:k]).max() < 1e-9
    assert np.allclose(np.cov(dense.T) @ got.vectors, got.vectors * (got.explained * np.cov(dense.T).trace()), atol=1e-9)
    assert len(calls) <= 20      # 60 rounds of each block before
    enc = encode.TableEncoder(None, [], [], [0], size)
    full = subspace.full_pca(enc.vectors(df), size)
    assert np.abs(full.explained - want).max() < 1e-9 and np.allclose(full.vectors[:, :5] * full.explained[:5], np.cov(dense.T) @ full.vectors[:, :5] / np.cov(dense.T).trace(), atol=1e-9)
    assert subspace.full_pca(enc.vectors(df.limit(0)), size).vectors.shape == (size, 0)


def test_products_of_rows_of_any_length(spark, monkeypatch):
    rng = np.random.default_rng(4)
    size, rows = 30, []
    for i in range(300):
        slots = sorted(int(s) for s in rng.choice(size, rng.integers(0, 9), replace=i % 50 == 0))     # some with a slot twice
        rows.append((slots, [float(v) for v in rng.normal(size=len(slots))]))
    df = spark.createDataFrame(rows, "slots array<int>, values array<double>")
    dense = np.zeros((300, size))
    for i, (slots, values) in enumerate(rows):
        np.add.at(dense[i], slots, values)
    q = rng.normal(size=(size, 5))
    for pairs in (subspace.PAIRS, 7):
        monkeypatch.setattr(subspace, "PAIRS", pairs)
        met = subspace.products(df)
        assert np.allclose(subspace.multiplied(met, q), dense.T @ (dense @ q))
        assert np.allclose(subspace.whole_covariance(met, 300, dense.mean(axis=0)), np.cov(dense.T))
    assert subspace.components(df.limit(0), size).vectors.shape == (size, 0)


def test_slots_are_gathered_without_lists(spark):
    """One slot a field: NULL and unseen levels, rows without any and rows that come twice; lists in the shuffle took more disk, and spilled."""
    make = lambda rows: spark.createDataFrame(rows, "f string, g string, x double")
    enc = encode.TableEncoder.fit(make([("b", "q", 1.0), ("a", "p", None), ("c", None, 0.0)]), ["f", "g"], ["x"])
    df = make([("a", "q", 2.0), ("a", "q", 2.0), (None, "p", 0.0), ("z", None, None), ("c", "z", -1.0)])
    got = enc.transform(df)
    want = [([0, 4, 5], [1.0, 1.0, 2.0])] * 2 + [([3], [1.0]), ([], []), ([2, 5], [1.0, -1.0])]
    assert sorted((r.slots, r["values"]) for r in got.collect()) == sorted(want)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def one_large_field(spark, rng, levels: int, n: int, value=None):
    """Rows of a large field, two small ones and two numbers, with their covariance; now and then a level or a number is missing."""
    size = levels + 9
    level = np.minimum((levels * rng.random(n) ** 2).astype(int), levels - 1)
    small, other = levels + rng.integers(0, 3, n), levels + 3 + np.minimum(rng.geometric(0.5, n) - 1, 3)
    rows = []
    for i in range(n):
        row = {int(level[i]): 1.0 if value is None else float(value[i]), int(small[i]): 1.0, int(other[i]): 1.0,
               levels + 7: float(rng.integers(0, 9)) / 100, levels + 8: float(rng.normal()) * 0.3}
        row.pop((int(level[i]), int(small[i]), levels + 7, -1)[min(int(rng.integers(0, 40)), 3)], None)
        rows.append((sorted(row), [row[s] for s in sorted(row)]))
    dense = np.zeros((n, size))
    for x, (slots, values) in zip(dense, rows):
        x[slots] = values
    df = spark.createDataFrame(rows, "slots array<int>, values array<double>").repartition(3)
    return df, size, np.cov(dense.T)


@pytest.mark.parametrize("kind", ["levels", "values"])
def test_one_large_field_is_solved_without_the_whole_covariance(spark, monkeypatch, kind):
    rng = np.random.default_rng(6)
    df, size, cov = one_large_field(spark, rng, 300, 3000, None if kind == "levels" else rng.normal(size=3000) + 0.5)
    want = np.linalg.eigvalsh(cov)[::-1] / cov.trace()
    monkeypatch.setattr(subspace, "DENSE", 50, raising=False)
    monkeypatch.setattr(subspace, "HELD", 1000, raising=False)
    monkeypatch.setattr(subspace, "whole_covariance", lambda *a: pytest.fail("the whole covariance was held"))
    got = subspace.components(df, size, 0.95)
    k = len(got.explained)
    assert k == model.components_for(want, 0.95) > 100 and np.abs(got.explained - want[:k]).max() < 1e-12
    full = subspace.full_pca(encode.TableEncoder(None, [], [], [0], size).vectors(df), size)
    assert len(full.explained) == size and np.abs(full.explained - want).max() < 1e-12
    for x in (got, full):
        assert np.abs(x.vectors.T @ x.vectors - np.eye(len(x.explained))).max() < 1e-6
        assert np.abs(cov @ x.vectors - x.vectors * (x.explained * cov.trace())).max() < 1e-9 * cov.trace()
    projected = subspace.project(df, got).first()
    dense = np.zeros(size)
    dense[projected.slots] = projected["values"]
    assert np.allclose(dense @ got.vectors, projected.reduced)


def test_a_large_field_takes_less_of_the_driver_than_its_covariance(spark):
    import tracemalloc
    df, size, cov = one_large_field(spark, np.random.default_rng(7), 3000, 9000)
    want = np.linalg.eigvalsh(cov)[::-1] / cov.trace()
    features = encode.TableEncoder(None, [], [], [0], size).vectors(df)
    tracemalloc.start()
    got, full = subspace.components(df, size, 0.95), subspace.full_pca(features, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * size ** 2        # the covariance has 8 bytes a number
    assert np.abs(got.explained - want[:len(got.explained)]).max() < 1e-12 and np.abs(full.explained - want).max() < 1e-12


def test_borders_are_found_or_the_whole_covariance_is_solved(spark, monkeypatch):
    entries = lambda pairs: spark.createDataFrame([(i, j, 1.0) for i, j in pairs], "i int, j int, p double")
    large = [(i, i) for i in range(105)] + [(i, j) for i in range(100) for j in (100, 101)]
    assert bordered.border(entries(large), 10) == [100, 101]
    assert bordered.border(entries([*large, (7, 102), (9, 102), (103, 104)]), 10) == [100, 101, 102, 103]      # rare levels too
    assert bordered.border(entries([*large, (7, 102)]).withColumn("p", F.when(F.col("j") == 102, 0.0).otherwise(1.0)), 10) == [100, 101]
    assert bordered.border(entries((i, i) for i in range(5)), 10) == []
    assert bordered.border(entries((i, 20 + i) for i in range(20)), 10) is None
    assert bordered.border(entries((i, 50 + j) for i in range(50) for j in range(50)), 10) is None
    rng = np.random.default_rng(9)
    rows = [([int(a), 80 + int(b)], [1.0, 1.0]) for a, b in zip(rng.integers(0, 80, 2000), rng.integers(0, 90, 2000))]
    df = spark.createDataFrame(rows, "slots array<int>, values array<double>")
    vectors = encode.TableEncoder(None, [], [], [0], 170).vectors(df)
    want = subspace.components(df, 170, 0.9), subspace.full_pca(vectors, 170)
    monkeypatch.setattr(subspace, "DENSE", 20)
    got = subspace.components(df, 170, 0.9), subspace.full_pca(vectors, 170)
    assert all(isinstance(x.solved, np.ndarray) and np.allclose(x.explained, y.explained) for x, y in zip(got, want))


def test_few_and_alone_and_empty_rows_of_many_slots(spark, monkeypatch):
    monkeypatch.setattr(subspace, "DENSE", 5)
    monkeypatch.setattr(subspace, "HELD", 10)
    vectors = encode.TableEncoder(None, [], [], [0], 40).vectors
    make = lambda rows: spark.createDataFrame(rows, "slots array<int>, values array<double>")
    for rows in ([([i % 13], [1.0]) for i in range(50)],                                # no two slots meet
                 [([3, 7], [1.0, 2.0]), ([], [])], [([3, 7], [2.0, 2.0]), ([7], [0.5]), ([2, 7], [1.0, -1.0])],
                 [([i % 13, 39], [2.0, 3.0]) for i in range(39)]):                     # all as often, the border constant
        df, dense = make(rows), np.zeros((len(rows), 40))
        for x, (slots, values) in zip(dense, rows):
            np.add.at(x, slots, values)
        cov = np.cov(dense.T)
        want = np.linalg.eigvalsh(cov)[::-1]
        got = subspace.components(df, 40, 1.0)
        assert np.allclose(got.explained, want[:len(got.explained)] / cov.trace(), atol=1e-12) and got.explained.sum() > 1 - 1e-9
        assert np.allclose(cov @ got.vectors, got.vectors * got.explained * cov.trace(), atol=1e-9)
        full = subspace.full_pca(vectors(df), 40)
        assert np.allclose(full.explained, want / cov.trace(), atol=1e-12) and np.allclose(full.vectors.T @ full.vectors, np.eye(40), atol=1e-8)
    for rows in ([], [([3, 7], [1.0, 2.0])]):
        df = spark.createDataFrame(rows, "slots array<int>, values array<double>")
        assert subspace.components(df, 40).vectors.shape == subspace.full_pca(vectors(df), 40).vectors.shape == (40, 0)
    same = make([([3, 7], [1.0, 2.0])] * 4)
    assert subspace.components(same, 40).vectors.shape == (40, 0) and subspace.full_pca(vectors(same), 40).explained.max() < 1e-12


def test_children_by_left_join_and_by_completed_side_agree(spark, monkeypatch):
    from gradelens.operators import assemble
    parent = spark.createDataFrame([(k, f"p{k}") for k in (1, 2, 2, 3, None)], "k int, p string")
    child = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 1, "c"), (2, 2, "d"), (None, 1, "e"), (9, 1, "f")], "ck int, ref int, c string")
    rows = lambda: sorted(map(str, assemble.first_child(parent, child, "k", "ck", ref=F.col("ref") == 1).collect()))
    left = rows()
    monkeypatch.setattr(assemble, "MAX_PER_KEY", 0)
    assert rows() == left and len(left) == 6


def test_code_lists_of_any_length_decode_alike(spark, monkeypatch):
    from gradelens.operators import assemble
    codes = assemble.code_list(spark.createDataFrame([("t", "f", str(i % 50), f"L{i}", i) for i in range(80)] + [("t", "g", "1", None, 0), ("u", "f", "1", "other", 1)],
                                                     "table string, field string, code string, label string, pos int"), order_col="pos")
    df = spark.createDataFrame([(i, str(i * 3 % 70), "x") for i in range(60)] + [(60, None, "1")], "i int, a string, b string")
    fields = [("a", "t", "f", "none", "x"), ("b", "t", "g", "none", "y"), ("a", "t", "missing", "dflt", "z")]
    want = df
    for col, table, field, default, name in fields:
        want = assemble.decode(want, col, codes, table, field, default, name=name)
    want = sorted(map(str, want.collect()))
    assert sorted(map(str, assemble.decode_all(df, fields, codes).select("i", "a", "b", "x", "y", "z").collect())) == want
    monkeypatch.setattr(assemble, "MAX_MAP_CODES", 10)
    assert sorted(map(str, assemble.decode_all(df, fields, codes).select("i", "a", "b", "x", "y", "z").collect())) == want
