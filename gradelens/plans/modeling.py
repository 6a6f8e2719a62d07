"""Catalog: weighted combinations, split, class weights, evaluation and scoring.

Test roles: features ``l_linestatus``, ``l_linenumber`` (categorical) and
``l_tax``, ``l_quantity`` (numeric); label ``l_returnflag`` (N < A < R).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelens.operators import encode, model, profile, subspace
from gradelens.plans.dashboards import TYPE_FOLD_SQL, type_fold
from gradelens.plans.registry import register
from gradelens.plans.tables import LINE_OUTCOME, table

CAT = ["l_linestatus", "l_linenumber"]
NUM = ["l_tax", "l_quantity"]
FEATURES = CAT + NUM
LEVELS = list(LINE_OUTCOME.levels)
SEED = 42

_COMBOS_SQL = """
SELECT CAST(l_linestatus AS VARCHAR) AS l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
       COALESCE(TRY_CAST(CAST(l_tax AS VARCHAR) AS DOUBLE), 0.0) AS l_tax,
       COALESCE(TRY_CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE), 0.0) AS l_quantity,
       CAST(l_returnflag AS VARCHAR) AS label, count(*) AS weight
FROM lineitem GROUP BY ALL
"""
_DOMINANT_SQL = f"""
SELECT l_linestatus, l_linenumber, l_tax, l_quantity, label AS dominant, combo_weight FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_linestatus, l_linenumber, l_tax, l_quantity
                               ORDER BY weight DESC, label DESC) AS rn,
         CAST(sum(weight) OVER (PARTITION BY l_linestatus, l_linenumber, l_tax, l_quantity) AS BIGINT) AS combo_weight
  FROM ({_COMBOS_SQL})
) WHERE rn = 1
"""


def combos(spark, sf):
    return model.combinations(table(spark, sf, "lineitem"), CAT, NUM, "l_returnflag")


@register("weighted_combinations", _COMBOS_SQL)
def weighted_combinations(spark, sf):
    """Rows compressed to (feature tuple, label, weight)."""
    return combos(spark, sf)


@register("dominant_label", _DOMINANT_SQL)
def dominant_label(spark, sf):
    """The heaviest label of every feature tuple."""
    return model.dominant(combos(spark, sf), FEATURES)


@register("class_weights", f"""
WITH per AS (SELECT label, sum(weight) AS w_c FROM ({_COMBOS_SQL}) GROUP BY 1)
SELECT label, sqrt(CAST((SELECT sum(w_c) FROM per) AS DOUBLE)
                   / (CAST((SELECT count(*) FROM per) AS DOUBLE) * CAST(w_c AS DOUBLE))) AS class_weight
FROM per
""")
def class_weights(spark, sf):
    """Tempered class weights (W / (K W_c)) ** 0.5."""
    return model.class_weights(combos(spark, sf))


@register("weighted_stats", f"""
WITH c AS ({_COMBOS_SQL})
SELECT 'l_tax' AS feature, CAST(sum(CAST(l_tax AS DECIMAL(30, 12)) * weight) AS DOUBLE) / CAST(sum(weight) AS DOUBLE)
       AS mean, min(l_tax) AS min, max(l_tax) AS max FROM c
UNION ALL
SELECT 'l_quantity', CAST(sum(CAST(l_quantity AS DECIMAL(30, 12)) * weight) AS DOUBLE) / CAST(sum(weight) AS DOUBLE),
       min(l_quantity), max(l_quantity) FROM c
""")
def weighted_stats(spark, sf):
    """Weighted mean, min and max of the numeric features."""
    return model.weighted_stats(combos(spark, sf), NUM)


@register("distinct_tuples", f"SELECT DISTINCT l_linestatus, l_linenumber, l_tax, l_quantity FROM ({_COMBOS_SQL})")
def distinct_tuples(spark, sf):
    """Distinct feature tuples."""
    return model.distinct_tuples(combos(spark, sf), FEATURES)


@register("first_per_label", f"""
SELECT label, min(value) AS first_value FROM (
  SELECT {TYPE_FOLD_SQL.replace('key', 'value')} AS label, value FROM (
    SELECT DISTINCT CAST(p_type AS VARCHAR) AS value FROM part)
) WHERE label IS NOT NULL GROUP BY 1
""")
def first_per_label(spark, sf):
    """First level of every remapped label (levels from the part table)."""
    lv = profile.value_counts(table(spark, sf, "part"), ["p_type"]).select("value")
    return model.first_per_label(lv, "value", type_fold)


def split_combos(spark, sf):
    return model.split(combos(spark, sf), FEATURES, 0.2, SEED)


_SPLIT_SQL = f"""
WITH d AS ({_DOMINANT_SQL}),
s AS (SELECT *, CASE WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM d GROUP BY dominant)) >= 2 THEN dominant ELSE '' END
             AS stratum FROM d),
p AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n,
             ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY substr(md5(
               '{SEED}|' || l_linestatus || '|' || l_linenumber || '|' || CAST(l_tax AS VARCHAR) || '|' || CAST(l_quantity AS VARCHAR)),
               1, 16)) - 1 AS pos FROM s)
SELECT c.*, pos < ceil(n * CAST(0.2 AS DOUBLE)) AS is_test
FROM ({_COMBOS_SQL}) c JOIN p USING (l_linestatus, l_linenumber, l_tax, l_quantity)
"""


@register("stratified_split", _SPLIT_SQL)
def stratified_split(spark, sf):
    """Combinations with their side of a stratified 80/20 tuple split, fixed by the seed."""
    return split_combos(spark, sf)


@register("split_summary", f"""
SELECT dominant, count(*) AS tuples, CAST(ceil(count(*) * 0.2) AS BIGINT) AS test_tuples
FROM ({_DOMINANT_SQL}) GROUP BY 1
""")
def split_summary(spark, sf):
    """M2: per stratum, tuples and test tuples (exact ceil of 20 %); no tuple on both sides."""
    s = split_combos(spark, sf)
    t = F.col("is_test").cast("int")
    tuples = s.groupBy(*FEATURES).agg(F.max(t).alias("t"), F.min(t).alias("t_min"),
                                      F.max_by("label", F.struct("weight", "label")).alias("dominant"))
    # a tuple on both sides would count twice and break the match with the oracle
    return tuples.groupBy("dominant").agg(
        F.count(F.lit(1)).alias("tuples"),
        (F.sum("t") + F.sum(F.when(F.col("t") != F.col("t_min"), 1).otherwise(0))).cast("long")
        .alias("test_tuples"))


_PRED_SQL = "CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_tax >= 0.05 THEN 'R' ELSE 'A' END"


def _rule_scored(spark, sf):
    c = combos(spark, sf)
    pred = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_tax") >= 0.05, "R").otherwise("A")
    return c.withColumn("predicted", pred)


_CONF_SQL = f"""
conf AS (SELECT label, {_PRED_SQL} AS predicted, CAST(sum(weight) AS DOUBLE) AS w FROM ({_COMBOS_SQL}) GROUP BY 1, 2),
cls AS (SELECT * FROM (VALUES ('N'), ('A'), ('R')) t(label)),
j AS (SELECT cls.label,
             COALESCE((SELECT sum(w) FROM conf WHERE conf.label = cls.label AND predicted = cls.label), 0.0) AS tp,
             COALESCE((SELECT sum(w) FROM conf WHERE conf.label = cls.label), 0.0) AS support,
             COALESCE((SELECT sum(w) FROM conf WHERE conf.predicted = cls.label), 0.0) AS pred FROM cls),
pm AS (SELECT label, CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM j),
m AS (SELECT label, precision, recall,
             CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
             support FROM pm)
"""


@register("class_metrics", f"WITH {_CONF_SQL} SELECT * FROM m")
def class_metrics(spark, sf):
    """M5: weighted per-class precision, recall, F1, support of a rule prediction."""
    conf = model.confusion(_rule_scored(spark, sf))
    return model.class_metrics(conf, LEVELS)


@register("weighted_metrics", f"""
WITH {_CONF_SQL}
SELECT COALESCE((SELECT sum(w) FILTER (WHERE label = predicted) / sum(w) FROM conf), 0.0) AS accuracy,
       list_sum(list(f1 ORDER BY label)) / count(*) AS macro_f1,
       CASE WHEN sum(support) > 0 THEN list_sum(list(f1 * support ORDER BY label)) / sum(support) ELSE 0.0 END
           AS weighted_f1,
       sum(support) AS n_test
FROM m
""")
def weighted_metrics(spark, sf):
    """M5: weighted accuracy, macro F1 and weighted F1 of a rule prediction."""
    conf = model.confusion(_rule_scored(spark, sf))
    return model.overall_metrics(conf, LEVELS)


def _trained(spark, sf, use_pca=False, learner="logistic", rounds=4):
    s = split_combos(spark, sf)
    train = s.filter(~F.col("is_test"))
    m = model.fit(train, CAT, NUM, LEVELS, learner=learner, use_pca=use_pca, max_iter=50, seed=SEED, rounds=rounds)
    return m, s


@register("score_batch")
def score_batch(spark, sf):
    """Score held-out tuples: ordered probabilities, class, top-6 contributions."""
    m, s = _trained(spark, sf)
    test = model.distinct_tuples(s.filter(F.col("is_test")), FEATURES)
    return model.score(m, test, LEVELS)


@register("score_batch_pca")
def score_batch_pca(spark, sf):
    """M3 M6: the same with PCA keeping 95 % of the variance."""
    m, s = _trained(spark, sf, use_pca=True)
    test = model.distinct_tuples(s.filter(F.col("is_test")), FEATURES)
    return model.score(m, test, LEVELS)


@register("holdout_metrics")
def holdout_metrics(spark, sf):
    """M4 M5: weighted held-out metrics of the fitted model."""
    m, s = _trained(spark, sf)
    test = s.filter(F.col("is_test"))
    scored = model.score(m, test, LEVELS)
    return model.overall_metrics(model.confusion(scored), m.classes)


@register("feature_importance")
def feature_importance(spark, sf):
    """M7: importance per field, normalised, top 15 (logistic)."""
    m, _ = _trained(spark, sf)
    return model.importance(m, spark=spark)


@register("feature_importance_forest")
def feature_importance_forest(spark, sf):
    """M3 M7: gain importances of a forest on PCA components, spread back to fields."""
    m, _ = _trained(spark, sf, use_pca=True, learner="forest")
    return model.importance(m, spark=spark)


@register("score_checks", f"SELECT count(*) AS scored, 0 AS sums_off, 0 AS not_largest FROM (SELECT DISTINCT l_linestatus, l_linenumber, "
          f"l_tax, l_quantity FROM ({_SPLIT_SQL}) WHERE is_test)")
def score_checks(spark, sf):
    """M4 M6: held-out tuples scored, probability sums off by over 1e-6, classes that are not the likeliest."""
    m, s = _trained(spark, sf)
    test = model.distinct_tuples(s.filter(F.col("is_test")), FEATURES)
    probs = [F.col(f"p_{c}") for c in m.classes]
    best = F.element_at(F.create_map(*[x for c, p in zip(m.classes, probs) for x in (F.lit(c), p)]), F.col("predicted"))
    return model.score(m, test, LEVELS, p_digits=None).agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(F.abs(sum(probs[1:], probs[0]) - 1) > 1e-6).cast("int").alias("sums_off"),
        F.count_if(best < F.greatest(*probs)).cast("int").alias("not_largest"))


_TESTED_SQL = f"SELECT DISTINCT l_linestatus, l_linenumber, l_tax, l_quantity FROM ({_SPLIT_SQL}) WHERE is_test"


def _sums(m, scored):
    """Scored rows: how many, probability sums off, classes that are not the likeliest, contributions that do not add up to the margin."""
    probs = [F.col(f"p_{c}") for c in m.classes]
    best = F.element_at(F.create_map(*[x for c, p in zip(m.classes, probs) for x in (F.lit(c), p)]), F.col("predicted"))
    parts = F.aggregate("contributions", F.lit(0.0), lambda acc, c: acc + c["value"])
    return scored.agg(F.count(F.lit(1)).alias("scored"),
                      F.count_if(F.abs(sum(probs[1:], probs[0]) - 1) > 1e-9).cast("int").alias("sums_off"),
                      F.count_if(best < F.greatest(*probs)).cast("int").alias("not_largest"),
                      F.count_if(F.coalesce(F.abs(F.col("base") + parts - F.col("margin")) > 1e-9, F.lit(True))).cast("int").alias("margins_off"))


FULL = {"top": 1000, "eps": 0.0, "p_digits": None, "c_digits": None, "margins": True}


@register("boosted_checks", f"SELECT count(*) AS scored, 0 AS sums_off, 0 AS not_largest, 0 AS margins_off FROM ({_TESTED_SQL})")
def boosted_checks(spark, sf):
    """M4 M6: boosted trees: probabilities sum to 1, the class is the likeliest, base and contributions are the margin."""
    m, s = _trained(spark, sf, learner="boosted")
    return _sums(m, model.score(m, model.distinct_tuples(s.filter(F.col("is_test")), FEATURES), LEVELS, **FULL))


@register("forest_checks", f"SELECT count(*) AS scored, 0 AS sums_off, 0 AS not_largest, 0 AS margins_off FROM ({_TESTED_SQL})")
def forest_checks(spark, sf):
    """M3 M6: the same for a forest on components, whose changes go back to the fields by their parts."""
    m, s = _trained(spark, sf, learner="forest", use_pca=True)
    return _sums(m, model.score(m, model.distinct_tuples(s.filter(F.col("is_test")), FEATURES), LEVELS, **FULL))


@register("score_each_checks", f"""
SELECT CASE WHEN l_linestatus = 'O' THEN 'own' ELSE 'shared' END AS model, count(*) AS scored, 0 AS sums_off, 0 AS not_largest, 0 AS margins_off
FROM ({_TESTED_SQL}) GROUP BY 1
""")
def score_each_checks(spark, sf):
    """M8: tuples of two data sets, scored by the own model of the one and by the fallback for the other, in one job."""
    shared, s = _trained(spark, sf)
    own = model.fit(s.filter(~F.col("is_test") & (F.col("l_tax") < 0.05)), CAT, NUM, LEVELS, max_iter=20, seed=SEED)
    tuples = model.distinct_tuples(s.filter(F.col("is_test")), FEATURES).withColumn("dataset", F.when(F.col("l_linestatus") == "O", "own").otherwise("none"))
    scored = model.score_each({"own": own, "shared": shared}, tuples, "dataset", "shared", LEVELS, **FULL)
    checked = [_sums(shared, scored.filter(F.col("model") == name)).select(F.lit(name).alias("model"), "*") for name in ("own", "shared")]
    return checked[0].unionByName(checked[1]).filter("scored > 0")


ENCODED_CAT = ["p_brand", "p_type", "p_name"]
_LEVELS_SQL = " UNION ALL ".join(f"SELECT {i} AS field, CAST({c} AS VARCHAR) AS level FROM part" for i, c in enumerate(ENCODED_CAT))
_SLOTS_SQL = f"SELECT field, level, row_number() OVER (ORDER BY field, level) - 1 AS slot FROM (SELECT DISTINCT * FROM ({_LEVELS_SQL}) WHERE level IS NOT NULL)"


@register("level_dictionary", _SLOTS_SQL)
def level_dictionary(spark, sf):
    """M1: slots of all levels of three fields as a table, one field with a level per row."""
    return encode.TableEncoder.fit(table(spark, sf, "part"), ENCODED_CAT, ["p_size"]).levels


@register("encoded_rows", f"""
WITH d AS ({_SLOTS_SQL}), n AS (SELECT count(*) AS n FROM d)
SELECT p_partkey, b.slot || ',' || t.slot || ',' || m.slot || CASE WHEN p_size <> 0 THEN ',' || n ELSE '' END AS slots,
       3.0 + COALESCE(CAST(p_size AS DOUBLE), 0.0) AS total
FROM part, n JOIN d b ON b.field = 0 AND b.level = p_brand JOIN d t ON t.field = 1 AND t.level = p_type JOIN d m ON m.field = 2 AND m.level = p_name
""")
def encoded_rows(spark, sf):
    """M1: every part as sparse slots and values, from one join with the dictionary."""
    pt = table(spark, sf, "part").select("p_partkey", *ENCODED_CAT, "p_size")
    rows = encode.TableEncoder.fit(pt, ENCODED_CAT, ["p_size"]).transform(pt)
    return rows.select("p_partkey", F.array_join(F.transform("slots", lambda s: s.cast("string")), ",").alias("slots"),
                       F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v).alias("total"))


@register("subspace_checks", f"""
SELECT count(DISTINCT l_linestatus) + count(DISTINCT l_linenumber) + count(DISTINCT l_suppkey) + 2 AS slots, 0 AS shares_off, true AS enough FROM lineitem
""")
def subspace_checks(spark, sf):
    """M1 M3: components of the encoded lines by subspace iteration against a full PCA: shares off by over 1e-6, 95 % reached."""
    cat, num = ["l_linestatus", "l_linenumber", "l_suppkey"], ["l_tax", "l_discount"]
    li = table(spark, sf, "lineitem").select(*cat, *num)
    enc = encode.TableEncoder.fit(li, cat, num)
    rows = encode.kept(enc.transform(li).select("slots", "values"), "encoded")
    got = subspace.components(rows, enc.size, 0.95)
    got = got.explained      # the vectors are slots x k numbers
    want = subspace.full_pca(enc.vectors(rows), enc.size).explained
    off = sum(abs(a - b) > 1e-6 for a, b in zip(got, want)) + abs(len(got) - model.components_for(want, 0.95))
    return spark.range(1).select(F.lit(enc.size).cast("long").alias("slots"), F.lit(int(off)).alias("shares_off"), F.lit(bool(got.sum() >= 0.95)).alias("enough"))


@register("table_model_checks", f"SELECT count(*) AS scored, 0 AS sums_off, 0 AS not_largest, 0 AS margins_off FROM ({_TESTED_SQL})")
def table_model_checks(spark, sf):
    """M1 M3 M6: the model on levels as a table and components by subspace iteration: sums, classes and margins as for the others."""
    s = split_combos(spark, sf)
    m = model.fit(s.filter(~F.col("is_test")), CAT, NUM, LEVELS, use_pca=True, max_iter=30, seed=SEED, encoder="table")
    return _sums(m, model.score(m, model.distinct_tuples(s.filter(F.col("is_test")), FEATURES), LEVELS, **FULL))


@register("split_facts", f"""
SELECT count(*) FILTER (WHERE NOT t) AS n_train_combos, count(*) FILTER (WHERE t) AS n_test_combos, CAST(sum(CASE WHEN t THEN w ELSE 0 END) AS BIGINT) AS n_test,
       0.5::DOUBLE AS class_weight_temper
FROM (SELECT bool_or(is_test) AS t, sum(weight) AS w FROM ({_SPLIT_SQL}) GROUP BY l_linestatus, l_linenumber, l_tax, l_quantity)
""")
def split_facts(spark, sf):
    """M2: tuples on each side of the split and the weighted test rows."""
    return model.split_facts(split_combos(spark, sf), FEATURES)


@register("feature_check", """
SELECT * FROM (VALUES ('l_linestatus', 'cat', true), ('l_linenumber', 'cat', true), ('l_gone', 'cat', false), ('l_tax', 'num', true), ('n_gone', 'num', false)) t(feature, kind, kept)
""")
def feature_check(spark, sf):
    """Features that the table has; a target-derived one is refused."""
    li = table(spark, sf, "lineitem")
    cat, num = ["l_linestatus", "l_linenumber", "l_gone"], ["l_tax", "n_gone"]
    kept = model.check_features(li.columns, cat, num, forbidden=["l_returnflag"])
    try:
        model.check_features(li.columns, [*cat, "l_returnflag"], num, forbidden=["l_returnflag"])
        kept = ([], [])      # the guard failed: nothing is kept
    except ValueError:
        pass
    asked = [(f, k, f in have) for k, names, have in (("cat", cat, kept[0]), ("num", num, kept[1])) for f in names]
    return spark.createDataFrame(asked, "feature string, kind string, kept boolean")


@register("importance_checks", """
SELECT * FROM (VALUES ('boosted', 4, 0, 0), ('logistic', 4, 0, 0)) t(learner, fields, sum_off, out_of_order)
""")
def importance_checks(spark, sf):
    """M7: importances of two learners: a row per field, sum 1, falling."""
    rows = []
    for learner in ("boosted", "logistic"):
        m, _ = _trained(spark, sf, learner=learner)
        got = [r["importance"] for r in model.importance(m, spark=spark).collect()]
        rows.append((learner, len(got), int(abs(sum(got) - 1) > 1e-9), sum(a < b for a, b in zip(got, got[1:]))))
    return spark.createDataFrame(rows, "learner string, fields int, sum_off int, out_of_order int")


@register("scenario_defaults", """
SELECT p_partkey, COALESCE(NULLIF(p_brand, 'Brand#11'), '') AS brand, COALESCE(NULLIF(CAST(p_size % 5 AS DOUBLE), 0.0), 1.0) AS size,
       '' AS gone, COALESCE(TRY_CAST(p_type AS DOUBLE), 1.0) AS text_number FROM part
""")
def scenario_defaults(spark, sf):
    """Missing categorical -> '', missing, zero or bad numeric -> 1.0."""
    pt = table(spark, sf, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#11")).alias("brand"),
                                         (F.col("p_size") % 5).alias("size"), F.col("p_type").alias("text_number"))
    return model.scenario_defaults(pt, ["brand", "gone"], ["size", "text_number"])
