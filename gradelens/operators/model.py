"""Weighted outcome classifier on Spark ML.

Flow: compress rows to weighted feature combinations (one ``groupBy``) →
dominant label per combination → leak-free stratified split *of
combinations* → tempered class weights → fit (one-hot encode → optional
PCA → multinomial logistic regression, a random forest, or boosted trees) →
weighted evaluation from a confusion aggregate → batch scoring with ordered class
probabilities and per-field contributions, all as DataFrame plans.

Boosted trees are one weighted binary booster per class; the probabilities of
the classes against the rest are normalised to sum 1.  Their contributions, and a forest's, are
the signed changes of the node value along a row's paths (``trees``), which add up to
the margin.  Model metadata (coefficients, loadings, feature means, tree nodes) is small —
its size is the encoded feature width and the trees' — and is the only thing brought to the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelens.operators import encode, subspace, trees
from gradelens.operators.quota import positions
from gradelens.session import checkpoint_dir

CLASS_WEIGHT_TEMPER = 0.5
# Rounds, depth, learning rate, share of rows and of features of the boosted trees.
BOOST_ROUNDS, BOOST_DEPTH, BOOST_RATE, BOOST_ROWS, BOOST_FEATURES = 150, 3, 0.08, 0.9, 0.8


# -- data preparation ------------------------------------------------------------------
def check_features(columns: Sequence[str], cat: Sequence[str], num: Sequence[str],
                   forbidden: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Keep features the table has; refuse target-derived ones."""
    leaks = sorted(set(forbidden) & (set(cat) | set(num)))
    if leaks:
        raise ValueError(f"refusing to train with target-derived features: {leaks}")
    cols = set(columns)
    return [c for c in cat if c in cols], [c for c in num if c in cols]


def combinations(df: DataFrame, cat: Sequence[str], num: Sequence[str], target: str) -> DataFrame:
    """One row per (feature tuple, label) with ``weight = count(*)``.

    Categoricals become text, numerics doubles (unparsable → 0).  The
    partial aggregate collapses repeated tuples before the shuffle.
    """
    cols = [F.col(c).cast("string").alias(c) for c in cat] + \
           [F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).alias(c) for c in num]
    return (df.select(*cols, F.col(target).cast("string").alias("label"))
              .groupBy(*cat, *num, "label").agg(F.count(F.lit(1)).alias("weight")))


def dominant(combos: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature tuple the label with the largest weight (ties: larger label)."""
    return combos.groupBy(*features).agg(
        F.max_by("label", F.struct("weight", "label")).alias("dominant"),
        F.sum("weight").alias("combo_weight"))


def split(combos: DataFrame, features: Sequence[str], test_fraction: float = 0.2,
          seed: int = 42) -> DataFrame:
    """M2 + J5: ``is_test`` per combination row; every tuple lands on one side.

    Tuples are stratified by their dominant label; in each stratum the first
    ``ceil(test_fraction * n)`` tuples in seeded hash order are test.  When a
    stratum has fewer than two tuples the split is not stratified.  Positions
    within each stratum come from ``quota.positions`` (no per-stratum task).
    """
    # the compressed table is read three times below (dominant labels, the
    # smallest stratum, the final join): materialise it once in the shared folder
    checkpoint_dir(combos.sparkSession)
    combos = combos.checkpoint(eager=True)
    dom = dominant(combos, features)
    sizes = dom.groupBy("dominant").agg(F.count(F.lit(1)).alias("n"))
    stratified = sizes.select(F.min("n") >= 2).scalar()
    dom = dom.withColumn("stratum", F.when(stratified, F.col("dominant")).otherwise(F.lit("")))
    indexed = positions(dom, list(features), seed, group="stratum", total="_n", unique=True)
    test_n = F.ceil(F.col("_n") * F.lit(test_fraction))
    flags = indexed.select(*features, (F.col("_pos") < test_n).alias("is_test"))
    # NULL is a feature value like any other, so the join is null-safe
    side = flags.select(*[F.col(f).alias(f"_f{i}") for i, f in enumerate(features)], "is_test")
    same = reduce(lambda a, b: a & b, [combos[f].eqNullSafe(side[f"_f{i}"]) for i, f in enumerate(features)])
    return combos.join(side, same, "inner").select(*features, *[c for c in combos.columns if c not in features], "is_test")


def class_weights(train: DataFrame, temper: float = CLASS_WEIGHT_TEMPER) -> DataFrame:
    """``(W / (K * W_c)) ** temper`` per present label."""
    per = train.groupBy("label").agg(F.sum("weight").alias("w_c"))
    every = Window.partitionBy()      # one row per label
    base = F.sum("w_c").over(every).cast("double") / (
        F.count(F.lit(1)).over(every).cast("double") * F.col("w_c").cast("double"))
    cw = F.sqrt(base) if temper == 0.5 else F.pow(base, F.lit(temper))
    return per.select("label", cw.alias("class_weight"))


def with_fit_weight(train: DataFrame, levels: Sequence[str], temper: float = CLASS_WEIGHT_TEMPER) -> DataFrame:
    """Row fit weight = combination weight x class weight, for rows of the listed
    levels (at most one weight per level, a proven bound for the broadcast, so a label
    that holds most rows is not shuffled to one task)."""
    cw = class_weights(train, temper).filter(F.col("label").isin(list(levels)))
    return train.join(F.broadcast(cw), "label").withColumn(
        "fit_weight", F.col("weight").cast("double") * F.col("class_weight"))


def weighted_stats(combos: DataFrame, num: Sequence[str]) -> DataFrame:
    """Weighted mean, min and max of every numeric feature.

    ``sum(x * w)`` is summed in DECIMAL(30, 12) so it does not depend on the
    order rows arrive in (feature values up to 1e18, 12 decimals).
    """
    def mean(c):
        exact = F.sum(F.col(c).cast("decimal(30,12)") * F.col("weight"))
        return (exact.cast("double") / F.sum("weight").cast("double")).alias("mean")
    rows = [combos.select(F.lit(c).alias("feature"), mean(c), F.min(c).alias("min"), F.max(c).alias("max"))
            for c in num]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# -- model -------------------------------------------------------------------------------
@dataclass
class SeverityModel:
    """Fitted pipeline plus the metadata scoring needs."""

    pipeline: PipelineModel
    classes: list[str]
    cat: list[str]
    num: list[str]
    slots: list[str]           # original field of every encoded slot
    slot_names: list[str]      # field=level / field of every encoded slot
    means: list[float]         # weighted mean of every encoded slot (training rows)
    variances: list[float] = field(default_factory=list)  # weighted variance of every slot
    coef: np.ndarray | None = None         # (classes x slots) in encoded space, LR only
    importances_raw: np.ndarray | None = None
    intercepts: list[float] = field(default_factory=list)  # one per class, LR only
    learner: str = "logistic"
    forests: list = field(default_factory=list)            # per class the trees (``trees.node_lists``)
    loadings: np.ndarray | None = None     # slots x components of the kept PCA components, tree learners only
    encoder: encode.TableEncoder | None = None     # levels as a table; then slots and slot_names stay empty

    def save(self, path: str) -> None:
        """Overwrite ``path`` with the fitted pipeline, the level table if there is one, and the metadata (one JSON text)."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        meta = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items() if k not in ("pipeline", "encoder")}
        if self.encoder is not None:
            self.encoder.levels.write.mode("overwrite").parquet(f"{path}/levels")
            meta["encoder"] = {"first": self.encoder.first, "size": self.encoder.size}
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SeverityModel":
        """A model that ``save`` wrote."""
        meta = json.loads(spark.read.text(f"{path}/metadata", wholetext=True).first()["value"])
        for k in ("coef", "importances_raw", "loadings"):
            meta[k] = None if meta.get(k) is None else np.array(meta[k])
        if meta.get("encoder"):
            meta["encoder"] = encode.TableEncoder(spark.read.parquet(f"{path}/levels"), meta["cat"], meta["num"], **meta["encoder"])
        return cls(pipeline=PipelineModel.load(f"{path}/pipeline"), **meta)


def _label_index(levels: Sequence[str]) -> Column:
    expr = F.lit(None).cast("double")
    for i in reversed(range(len(levels))):
        expr = F.when(F.col("label") == F.lit(levels[i]), F.lit(float(i))).otherwise(expr)
    return expr


def components_for(explained: Sequence[float], variance: float = 0.95) -> int:
    """M3: the smallest k whose cumulative explained variance reaches ``variance``."""
    return int(np.searchsorted(np.cumsum(explained), variance - 1e-12) + 1)


def fit(train: DataFrame, cat: Sequence[str], num: Sequence[str], levels: Sequence[str],
        learner: str = "logistic", use_pca: bool = False, variance: float = 0.95,
        max_iter: int = 100, seed: int = 42, rounds: int = BOOST_ROUNDS, encoder: str = "stages") -> SeverityModel:
    """M1 + M3 + M4: encode, optionally reduce, fit with the fit weights.

    ``learner`` is ``logistic``, ``forest`` or ``boosted`` (``rounds`` trees per class).  With ``encoder="table"`` the levels of the
    fields stay in a table (``encode``) and components come from subspace iteration (``subspace``), for fields of many levels: the
    driver then holds slots x classes (or x components) numbers and no labels.
    """
    if encoder not in ("stages", "table"):
        raise ValueError("encoder must be 'stages' or 'table'")
    # one job; at most len(levels) rows come back
    seen = {r[0] for r in train.filter(F.col("label").isin(list(levels))).select("label").distinct().collect()}
    present = [lv for lv in levels if lv in seen]
    if len(present) < 2:
        raise ValueError("need at least two outcome classes to train")
    data = with_fit_weight(train, present).withColumn("label_idx", _label_index(present)) \
                                 .filter(F.col("label_idx").isNotNull())
    # the encoders, PCA, the learner and the summary each read the training
    # rows; keep them for the length of the fit instead of re-deriving them
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if encoder == "table":
            return _fit_table(data, cat, num, present, learner, use_pca, variance, max_iter, seed, rounds)
        return _fit(data, cat, num, present, learner, use_pca, variance, max_iter, seed, rounds)
    finally:
        data.unpersist()


def _fit(data: DataFrame, cat, num, present, learner, use_pca, variance, max_iter, seed, rounds) -> SeverityModel:
    idx_cols = [f"{c}__idx" for c in cat]
    oh_cols = [f"{c}__oh" for c in cat]
    stages = [StringIndexer(inputCols=list(cat), outputCols=idx_cols, handleInvalid="keep",
                            stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCols=idx_cols, outputCols=oh_cols, dropLast=True),
              VectorAssembler(inputCols=oh_cols + list(num), outputCol="encoded", handleInvalid="keep")]
    enc = Pipeline(stages=stages).fit(data)
    encoded = enc.transform(data)
    labels_arr = enc.stages[0].labelsArray
    slots, slot_names = [], []
    for c, labs in zip(cat, labels_arr):
        slots += [c] * len(labs)
        slot_names += [f"{c}={v}" for v in labs]
    slots += list(num)
    slot_names += list(num)
    dim = len(slots)
    feat_col = "encoded"
    extra_stages = []
    loadings = None
    if use_pca:
        # one fit with all components (dim x dim numbers on the driver); the first k are kept
        pca = PCA(k=dim, inputCol="encoded", outputCol="components").fit(encoded)
        k = min(components_for(pca.explainedVariance.toArray(), variance), dim)
        keep = VectorSlicer(inputCol="components", outputCol="reduced", indices=list(range(k)))
        extra_stages += [pca, keep]
        loadings = pca.pc.toArray()[:, :k]   # dim x k
        encoded = keep.transform(pca.transform(encoded))
        feat_col = "reduced"
    fitted = _learners(encoded, feat_col, present, learner, max_iter, seed, rounds)
    clf_model = fitted[0]
    pipeline = PipelineModel(stages=[*enc.stages, *extra_stages, *fitted])
    summary = encoded.select(Summarizer.metrics("mean", "variance")
                             .summary(F.col("encoded"), F.col("weight")).alias("s")).first()["s"]
    means = list(summary["mean"].toArray())
    variances = list(summary["variance"].toArray())
    coef = imp = None
    intercepts, forests = [], []
    spark = data.sparkSession
    if learner == "logistic":
        coef = clf_model.coefficientMatrix.toArray()          # K x (dim or k)
        intercepts = [float(v) for v in clf_model.interceptVector.toArray()]
        if loadings is not None:
            coef = coef @ loadings.T                          # back to encoded space (PCA is linear)
    else:
        imp = sum(m.featureImportances.toArray() for m in fitted)
        forests = [trees.node_lists(spark, m)[0] for m in fitted] if learner == "boosted" else trees.node_lists(spark, clf_model, len(present))
        if loadings is not None:                              # spread component gain over |loading|
            a = np.abs(loadings)
            share = a / np.where(a.sum(axis=0, keepdims=True) == 0, 1, a.sum(axis=0, keepdims=True))
            imp = share @ imp
    return SeverityModel(pipeline, present, list(cat), list(num), slots, slot_names, means,
                         variances, coef, imp, intercepts, learner, forests, None if learner == "logistic" else loadings)


def _learners(encoded: DataFrame, features: str, classes: Sequence[str], learner: str, max_iter: int, seed: int, rounds: int) -> list:
    """M4: the fitted learner on a vector column (one booster per class for ``boosted``)."""
    if learner == "logistic":
        return [LogisticRegression(featuresCol=features, labelCol="label_idx", weightCol="fit_weight",
                                   family="multinomial", maxIter=max_iter, regParam=1e-4).fit(encoded)]
    if learner == "forest":
        return [RandomForestClassifier(featuresCol=features, labelCol="label_idx", weightCol="fit_weight",
                                       numTrees=50, maxDepth=6, seed=seed).fit(encoded)]
    if learner == "boosted":
        return _boosters(encoded, features, classes, rounds, seed)
    raise ValueError("learner must be 'logistic', 'forest' or 'boosted'")


def _fit_table(data: DataFrame, cat, num, present, learner, use_pca, variance, max_iter, seed, rounds) -> SeverityModel:
    """M1 + M3 with the levels as a table; the row's slots stay sparse arrays until they are a vector."""
    own = encode.TableEncoder.fit(data, cat, num)
    rows = encode.kept(own.transform(data), "encoded")
    loadings = None
    if use_pca:
        found = subspace.components(rows, own.size, variance, seed=seed)
        loadings, n, means = found.vectors, found.n, found.means
        encoded = subspace.project(rows, found, "reduced_array").withColumn("reduced", array_to_vector("reduced_array"))
    else:
        encoded = own.vectors(data, "reduced")
    n, total, square = subspace.moments(rows, own.size)
    means = total / n
    variances = np.clip(square / n - means ** 2, 0, None)
    fitted = _learners(encoded, "reduced", present, learner, max_iter, seed, rounds)
    coef = None
    intercepts: list[float] = []
    if learner == "logistic":
        coef = fitted[0].coefficientMatrix.toArray()
        coef = coef if loadings is None else coef @ loadings.T
        intercepts = [float(v) for v in fitted[0].interceptVector.toArray()]
    imp = None if learner == "logistic" else sum(m.featureImportances.toArray() for m in fitted)
    if imp is not None and loadings is not None:
        a = np.abs(loadings)
        imp = (a / np.where(a.sum(axis=0, keepdims=True) == 0, 1, a.sum(axis=0, keepdims=True))) @ imp
    return SeverityModel(PipelineModel(stages=fitted), present, list(cat), list(num), [], [], [float(m) for m in means], [float(v) for v in variances],
                         coef, imp, intercepts, learner, [], loadings, own)


def _encoded_by_table(model: SeverityModel, prepared: DataFrame) -> DataFrame:
    """``prepared`` with the sparse arrays and, as ``reduced``, the vector that the learner reads."""
    if model.loadings is None:
        sparse = model.encoder.vectors(model.encoder.transform(prepared), "reduced")
        return sparse
    found = subspace.Components(model.loadings, np.zeros(model.loadings.shape[1]), np.asarray(model.means), 0)
    rows = subspace.project(encode.kept(model.encoder.transform(prepared), "encoded"), found, "reduced_array")
    return rows.withColumn("reduced", array_to_vector("reduced_array")).drop("reduced_array")


def _slot_sums(df: DataFrame, model: SeverityModel, pred: str, out: str) -> DataFrame:
    """``out``: for each field the coefficients of the predicted class over the row's slots, less their part at the mean row.

    The coefficients (classes x slots numbers) are broadcast.
    """
    first = np.array([*model.encoder.first, *[model.encoder.first[-1] + i + 1 for i in range(len(model.num))]])
    fields = len(first) - 1
    coef = np.asarray(model.coef)
    whole = np.concatenate([np.zeros((len(coef), 1)), np.cumsum(coef * np.asarray(model.means), axis=1)], axis=1)
    base = whole[:, first[1:]] - whole[:, first[:-1]]
    shared = df.sparkSession.sparkContext.broadcast((coef, base, first))
    names = df.columns
    schema = df.withColumn(out, F.array().cast("array<double>")).schema

    def run(batches):
        for b in batches:
            w, at_mean, starts = shared.value
            slots, at = subspace.flat_list(b.column(names.index("slots")))
            values, _ = subspace.flat_list(b.column(names.index("values")))
            cls = b.column(names.index(pred)).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(cls)), np.diff(at))
            sums = np.zeros((len(cls), fields))
            np.add.at(sums, (row, np.searchsorted(starts, slots, "right") - 1), w[cls[row], slots] * values)
            got = sums - at_mean[cls]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(cls) + 1) * fields, pa.int32()), pa.array(got.ravel()))],
                                             names=[*names, out])

    return df.mapInArrow(run, schema)


def _boosters(encoded: DataFrame, features: str, classes: Sequence[str], rounds: int, seed: int) -> list:
    """M4: per class a weighted binary booster of the class against the rest, with columns of its own."""
    out = []
    for i in range(len(classes)):
        gbt = GBTClassifier(featuresCol=features, labelCol="is_class", weightCol="fit_weight", maxIter=rounds, maxDepth=BOOST_DEPTH,
                            stepSize=BOOST_RATE, subsamplingRate=BOOST_ROWS, featureSubsetStrategy=str(BOOST_FEATURES), seed=seed,
                            predictionCol=f"pred_{i}").setProbabilityCol(f"prob_{i}").setRawPredictionCol(f"raw_{i}")
        out.append(gbt.fit(encoded.withColumn("is_class", (F.col("label_idx") == i).cast("double"))))
    return out


# -- scoring -----------------------------------------------------------------------------
def scenario_defaults(df: DataFrame, cat: Sequence[str], num: Sequence[str]) -> DataFrame:
    """Missing categorical → '', missing / zero / bad numeric → 1.0."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
            for c in cat]
    for c in num:
        v = F.col(c).cast("string").try_cast("double") if c in df.columns else F.lit(None).cast("double")
        cols.append(F.coalesce(F.nullif(v, F.lit(0.0)), F.lit(1.0)).alias(c))
    keep = [F.col(c) for c in df.columns if c not in set(cat) | set(num)]
    return df.select(*keep, *cols)


def score(model: SeverityModel, scenarios: DataFrame, levels: Sequence[str], top: int = 6,
          eps: float = 1e-6, p_digits: int | None = 6, c_digits: int | None = 4, margins: bool = False) -> DataFrame:
    """M6: class probabilities in outcome order, the predicted class, and the
    ``top`` signed per-field contributions to it (|value| > ``eps``).

    Contribution of an encoded slot for class c is ``coef[c, j] * (x_j -
    mean_j)`` (exact for the logistic model), summed to its field.  A one-hot field
    has at most one slot set, so its sum is the coefficient of the row's level
    less a constant per class: one array lookup per field.  For trees it is the sum of the value changes at
    the splits on the field's slots.  Probabilities are rounded to
    ``p_digits`` and contributions to ``c_digits`` (half-even; None keeps
    full precision).  ``margins`` adds ``base`` and ``margin`` of the predicted class: all contributions and the base add up to
    the margin (a forest's is its probability).
    """
    prepared = scenario_defaults(scenarios, model.cat, model.num)
    out = model.pipeline.transform(_encoded_by_table(model, prepared) if model.encoder is not None else prepared)
    if model.learner == "boosted":
        alone = [F.element_at(vector_to_array(f"prob_{i}"), 2) for i in range(len(model.classes))]
        total = reduce(lambda a, b: a + b, alone)
        out = out.withColumn("__prob", F.array(*[p / total for p in alone]))
        prob = F.col("__prob")
        pred = (F.array_position(prob, F.array_max(prob)) - 1).cast("int")
    else:
        prob = vector_to_array("probability")
        pred = F.col("prediction").cast("int")
    def rnd(x, d):
        return x if d is None else F.bround(x, d)
    cols = [rnd(F.element_at(prob, i + 1), p_digits).alias(f"p_{c}") for i, c in enumerate(model.classes)]
    classes = F.array(*[F.lit(c) for c in model.classes])
    res = out.select("*", *cols, F.element_at(classes, pred + 1).alias("predicted"))
    if model.encoder is not None and model.coef is not None:
        fields = [*model.cat, *model.num]
        raw = vector_to_array("rawPrediction")
        plain = res.withColumn("__pred", pred).withColumn("__raw", F.element_at(raw, F.col("__pred") + 1))
        vectors = [c for c, t in plain.dtypes if t == "vector"]
        res = _slot_sums(plain.drop(*vectors), model, "__pred", "__values")
        per_field = F.arrays_zip(F.array(*[F.lit(f) for f in fields]).alias("feature"), F.col("__values").alias("value"))
        at_means = np.asarray(model.intercepts) + np.asarray(model.coef) @ np.asarray(model.means, float)
        base = F.element_at(F.array(*[F.lit(float(v)) for v in at_means]), F.col("__pred") + 1)
        margin = F.col("__raw")
    elif model.coef is not None:
        fields = list(dict.fromkeys(model.slots))
        means = np.asarray(model.means, dtype=float)

        def numbers(values, kind="array<double>"):       # one constant of the plan
            return F.from_json(F.lit(json.dumps(np.asarray(values, float).tolist())), kind)

        def contribution(f):
            at = [i for i, s in enumerate(model.slots) if s == f]
            base = F.element_at(numbers(model.coef[:, at] @ means[at]), pred + 1)
            if f in model.num:
                return F.element_at(numbers(model.coef[:, at[0]]), pred + 1) * F.col(f) - base
            by_class = numbers(model.coef[:, at], "array<array<double>>")
            level = F.try_element_at(F.element_at(by_class, pred + 1), F.col(f"{f}__idx").cast("int") + 1)
            return F.coalesce(level, F.lit(0.0)) - base      # an unseen level sets no slot
        per_field = F.array(*[F.struct(F.lit(f).alias("feature"), contribution(f).alias("value")) for f in fields])
        base = F.element_at(numbers(np.asarray(model.intercepts) + model.coef @ means), pred + 1) if model.intercepts else F.lit(None).cast("double")
        margin = F.element_at(vector_to_array("rawPrediction"), pred + 1)
    elif model.forests:
        fields = list(dict.fromkeys(model.slots))
        x = vector_to_array("encoded")
        res = res.withColumn("__pred", pred).withColumn("__x", x)
        res = res.withColumn("__changes", trees.split_changes(model.forests, F.col("__pred"), x if model.loadings is None else vector_to_array("reduced")))
        res = res.withColumn("__values", trees.field_contributions(F.col("__changes"), fields, model.slots, F.col("__x"), model.loadings, model.means))
        per_field = F.arrays_zip(F.array(*[F.lit(f) for f in fields]).alias("feature"), F.col("__values").alias("value"))
        base = F.element_at(F.array(*[F.lit(trees.roots(f)) for f in model.forests]), F.col("__pred") + 1)
        margin = (F.element_at(F.array(*[F.element_at(vector_to_array(f"raw_{i}"), 2) for i in range(len(model.classes))]), F.col("__pred") + 1)
                  if model.learner == "boosted" else F.element_at(prob, F.col("__pred") + 1))
    else:
        per_field = None
    if per_field is not None:
        kept = F.transform(F.filter(per_field, lambda s: F.abs(s["value"]) > eps),
                           lambda s: F.struct(s["feature"].alias("feature"),
                                              rnd(s["value"], c_digits).alias("value")))
        ordered = F.array_sort(kept, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                               .when(F.abs(a["value"]) < F.abs(b["value"]), 1).otherwise(0))
        res = res.withColumn("contributions", F.slice(ordered, 1, top)).withColumns({"base": base, "margin": margin})
    else:
        none = F.lit(None).cast("double")
        res = res.withColumn("contributions", F.lit(None).cast("array<struct<feature:string,value:double>>")).withColumns({"base": none, "margin": none})
    keep = [c for c in scenarios.columns]
    return res.select(*keep, *[f"p_{c}" for c in model.classes], "predicted", "contributions", *(["base", "margin"] if margins else []))


def score_each(models: Mapping[str, SeverityModel], scenarios: DataFrame, dataset: str, fallback: str, levels: Sequence[str], **options) -> DataFrame:
    """M8: each scenario scored by the model of its own data set, else by the fallback's, in one job; ``model`` names the one used.

    ``scenarios`` has the data set's name in ``dataset`` (NULL and names without a model take the fallback).  Probability columns of
    a class that a model does not have are NULL.
    """
    resolve(models, fallback, fallback)
    used = F.when(F.col(dataset).isin(list(models)), F.col(dataset)).otherwise(F.lit(fallback))
    named = scenarios.withColumn("model", used)
    parts = [score(m, named.filter(F.col("model") == name), levels, **options) for name, m in models.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def importance(model: SeverityModel, top: int = 15, spark=None) -> DataFrame:
    """M7: importance per original field, normalised to sum 1, largest ``top``.

    Logistic: ``sum_c |coef[c, j]| * sd_j`` over the encoded slots (``sd_j``
    the weighted standard deviation of slot j on the training rows); forest:
    the learner's gain importances (spread back through PCA loadings).
    """
    if model.coef is not None:
        sd = np.sqrt(np.clip(np.asarray(model.variances), 0, None))
        raw = np.abs(model.coef).sum(axis=0) * sd
    else:
        raw = np.asarray(model.importances_raw)
    owners = model.slots
    if model.encoder is not None:
        n = np.diff([*model.encoder.first, *[model.encoder.first[-1] + i + 1 for i in range(len(model.num))]])
        owners = [f for f, k in zip([*model.cat, *model.num], n) for _ in range(k)]
    per: dict[str, float] = {}
    for s, v in zip(owners, raw):
        per[s] = per.get(s, 0.0) + float(v)
    total = sum(per.values()) or 1.0
    rows = sorted(((k, v / total) for k, v in per.items()), key=lambda kv: -kv[1])[:top]
    spark = spark or SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, importance double")


def resolve(models: Mapping[str, SeverityModel], name: str, fallback: str) -> SeverityModel:
    """M8: a dataset's own model, else the fallback dataset's model."""
    if name in models:
        return models[name]
    if fallback in models:
        return models[fallback]
    raise LookupError("no model available")


# -- evaluation ---------------------------------------------------------------------------
def confusion(scored: DataFrame, label: str = "label", pred: str = "predicted",
              weight: str = "weight") -> DataFrame:
    """Weighted confusion cells ``(label, predicted, w)``."""
    return scored.groupBy(F.col(label).alias("label"), F.col(pred).alias("predicted")) \
                 .agg(F.sum(F.col(weight).cast("double")).alias("w"))


def _per_class(conf: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``(label, tp, support, pred)`` from one pass over the confusion cells.

    Every cell contributes to its true class (support, tp) and to its
    predicted class (pred); listed classes without cells get zeros.
    """
    w = F.col("w").cast("double")
    parts = F.array(
        F.struct(F.col("label").alias("cls"), w.alias("support"),
                 F.when(F.col("label") == F.col("predicted"), w).otherwise(0.0).alias("tp"),
                 F.lit(0.0).alias("pred")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0.0).alias("support"), F.lit(0.0).alias("tp"),
                 w.alias("pred")))
    zeros = conf.sparkSession.createDataFrame([(c, 0.0, 0.0, 0.0) for c in classes],
                                              "cls string, support double, tp double, pred double")
    cells = conf.select(F.inline(parts)).unionByName(zeros)
    return (cells.filter(F.col("cls").isin(list(classes)))
                 .groupBy(F.col("cls").alias("label"))
                 .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("pred").alias("pred")))


def _scores(per: DataFrame) -> DataFrame:
    p = F.coalesce(F.try_divide("tp", "pred"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    staged = per.select("label", "tp", p.alias("precision"), r.alias("recall"), "support")
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return staged.select("label", "tp", "precision", "recall", f1.alias("f1"), "support")


def class_metrics(conf: DataFrame, classes: Sequence[str]) -> DataFrame:
    """M5: per class precision, recall, F1 and support (zero division → 0)."""
    return _scores(_per_class(conf, classes)).drop("tp")


def overall_metrics(conf: DataFrame, classes: Sequence[str]) -> DataFrame:
    """M5: weighted accuracy, macro F1 and support-weighted F1 over the listed
    classes, from the same single pass over the confusion cells."""
    per = _scores(_per_class(conf, classes))
    # one row per class: fold the F1s in label order so the float sums do not
    # depend on the order rows arrive in
    rows = per.agg(F.array_sort(F.collect_list(F.struct("label", "f1", "support"))).alias("a"),
                   F.sum("tp").alias("tp"), F.sum("support").alias("support"))
    f1_sum = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x["f1"])
    f1_weighted = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x["f1"] * x["support"])
    return rows.select(
        F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("accuracy"),
        F.try_divide(f1_sum, F.size("a").cast("double")).alias("macro_f1"),
        F.coalesce(F.try_divide(f1_weighted, F.col("support")), F.lit(0.0)).alias("weighted_f1"),
        F.col("support").alias("n_test"))


def first_per_label(levels_df: DataFrame, value: str, mapper) -> DataFrame:
    """First (smallest) raw value for every remapped label."""
    return levels_df.select(mapper(F.col(value)).alias("label"), F.col(value).alias("value")) \
                    .filter(F.col("label").isNotNull()) \
                    .groupBy("label").agg(F.min("value").alias("first_value"))


def distinct_tuples(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct feature tuples."""
    return df.dropDuplicates(list(cols)).select(*cols)



@dataclass
class TrainResult:
    """Everything one training run produces, as the model plus DataFrames."""

    model: SeverityModel
    metrics: DataFrame        # accuracy, macro_f1, weighted_f1, n_test
    per_class: DataFrame      # label, precision, recall, f1, support
    importances: DataFrame    # feature, importance (top 15)
    levels: DataFrame         # field, value, n (A15, one row per level); with the fields that only the form offers
    num_stats: DataFrame      # feature, mean, min, max (A14)
    facts: DataFrame          # n_train_combos, n_test_combos, n_test, class_weight_temper


def train_flow(records: DataFrame, cat: Sequence[str], num: Sequence[str], target: str,
               levels: Sequence[str], forbidden: Sequence[str] = (), test_fraction: float = 0.2,
               seed: int = 42, learner: str = "logistic", use_pca: bool = True,
               variance: float = 0.95, form_only: Sequence[str] = (), rounds: int = BOOST_ROUNDS, encoder: str = "stages") -> TrainResult:
    """The training run end to end: features the table has (leak guard),
    weighted combinations, leak-free stratified split of combinations, fit
    on the training side, weighted evaluation on the held-out side.  ``form_only`` fields are offered on the scenario form without
    being features: their levels are listed too."""
    from gradelens.operators.profile import value_counts
    cat, num = check_features(records.columns, cat, num, forbidden)
    combos = combinations(records, cat, num, target)
    sides = split(combos, [*cat, *num], test_fraction, seed)
    m = fit(sides.filter(~F.col("is_test")), cat, num, levels, learner=learner, use_pca=use_pca,
            variance=variance, seed=seed, rounds=rounds, encoder=encoder)
    conf = confusion(score(m, sides.filter(F.col("is_test")), levels))
    shown = value_counts(combos, cat)
    extra = [c for c in form_only if c in records.columns and c not in cat]
    if extra:
        shown = shown.unionByName(value_counts(records, extra))
    return TrainResult(m, overall_metrics(conf, m.classes), class_metrics(conf, m.classes),
                       importance(m, spark=records.sparkSession), shown, weighted_stats(combos, num), split_facts(sides, [*cat, *num]))


def split_facts(sides: DataFrame, features: Sequence[str], temper: float = CLASS_WEIGHT_TEMPER) -> DataFrame:
    """M2: training and test tuples, weighted test rows, and the class weight temper, of a split, in one row."""
    tuples = sides.groupBy(*features).agg(F.max(F.col("is_test").cast("int")).alias("t"), F.sum(F.when(F.col("is_test"), F.col("weight")).otherwise(0)).alias("w"))
    return tuples.agg(F.count(F.when(F.col("t") == 0, 1)).alias("n_train_combos"), F.count(F.when(F.col("t") == 1, 1)).alias("n_test_combos"),
                      F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("n_test")).withColumn("class_weight_temper", F.lit(float(temper)))
