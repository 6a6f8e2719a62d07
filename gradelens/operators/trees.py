"""Fitted trees as node tables, and the signed change of a row's node value at every split of its path (M4, M6).

A tree is five arrays (feature, cut, left, right, value) and a weight; the nodes of a forest are few (rounds x 2^(depth + 1) per
class), so they are a constant of the plan.  A row walks each tree with array functions: at a split it goes left if its feature is at
most the cut, and the value changes from the node's to the child's.  The changes of all paths and the weighted root values add up to the
forest's margin exactly.
"""

from __future__ import annotations

import json
import uuid
from typing import Sequence

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gradelens.session import checkpoint_dir

TREE = "struct<w:double,feature:array<int>,cut:array<double>,left:array<int>,right:array<int>,value:array<double>>"
STEP = "struct<f:int,d:double>"


def _cut(split) -> tuple[float, bool]:
    """(cut, swapped) of a split: an encoded slot with the categories 0 and 1 is cut at a half."""
    if split["numCategories"] < 0:
        return float(split["leftCategoriesOrThreshold"][0]), False
    return 0.5, 0.0 not in split["leftCategoriesOrThreshold"]


def node_lists(spark: SparkSession, model, classes: int = 1) -> list[list[dict]]:
    """For each class the trees of a fitted ensemble, read from the node table that it saves.

    A boosted model has one value per node (``classes`` = 1); a forest's nodes have class counts, whose shares are the values.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    by_tree: dict[int, dict[int, object]] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], {})[r["id"]] = r
    weights = list(model.treeWeights)
    total = sum(weights) if classes > 1 else 1.0
    out: list[list[dict]] = [[] for _ in range(classes)]
    for t in sorted(by_tree):
        nodes = [by_tree[t][i] for i in range(len(by_tree[t]))]
        feature, cut, left, right = [], [], [], []
        for n in nodes:
            inner = n["leftChild"] >= 0
            at, swapped = _cut(n["split"]) if inner else (0.0, False)
            kids = (n["rightChild"], n["leftChild"]) if swapped else (n["leftChild"], n["rightChild"])
            feature.append(n["split"]["featureIndex"] if inner else -1)
            cut.append(at)
            left.append(kids[0] if inner else -1)
            right.append(kids[1] if inner else -1)
        for c in range(classes):
            if classes == 1:
                value = [float(n["prediction"]) for n in nodes]
            else:
                value = [float(n["impurityStats"][c]) / (sum(n["impurityStats"]) or 1.0) for n in nodes]
            out[c].append({"w": float(weights[t]) / total, "feature": feature, "cut": cut, "left": left, "right": right, "value": value})
    return out


def roots(trees: Sequence[dict]) -> float:
    """The margin without any split: weighted root values."""
    return float(sum(t["w"] * t["value"][0] for t in trees))


def depth(trees: Sequence[dict]) -> int:
    """Splits on the longest path."""
    longest = 0
    for t in trees:
        todo = [(0, 0)]
        while todo:
            node, d = todo.pop()
            longest = max(longest, d)
            if t["left"][node] >= 0:
                todo += [(t["left"][node], d + 1), (t["right"][node], d + 1)]
    return longest


def split_changes(forests: Sequence[Sequence[dict]], which: Column, x: Column) -> Column:
    """``array<(feature, change)>`` of a row's paths through the forest number ``which`` (from 0); ``x`` is its feature array."""
    every = F.from_json(F.lit(json.dumps(list(map(list, forests)))), f"array<array<{TREE}>>")
    most = max(max(depth(f) for f in forests), 1)
    empty = F.array().cast(f"array<{STEP}>")

    def walk(tree: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            at = state["node"] + 1
            down = F.element_at(tree["left"], at)
            goes = F.when(F.element_at(x, F.element_at(tree["feature"], at) + 1) <= F.element_at(tree["cut"], at), down).otherwise(F.element_at(tree["right"], at))
            change = tree["w"] * (F.element_at(tree["value"], goes + 1) - F.element_at(tree["value"], at))
            moved = F.struct(goes.alias("node"), F.array_append(state["out"], F.struct(F.element_at(tree["feature"], at).alias("f"), change.alias("d"))).alias("out"))
            return F.when(down < 0, state).otherwise(moved)

        start = F.struct(F.lit(0).alias("node"), empty.alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["out"])

    return F.flatten(F.transform(F.element_at(every, which + 1), walk))


def sum_where(changes: Column, test) -> Column:
    """Sum of the changes whose feature passes ``test``, in path order."""
    return F.aggregate(F.filter(changes, lambda s: test(s["f"])), F.lit(0.0), lambda acc, s: acc + s["d"])


def field_contributions(changes: Column, fields: Sequence[str], slots: Sequence[str], x: Column,
                        loadings: np.ndarray | None = None, means: Sequence[float] = ()) -> Column:
    """``array<double>``: for each field the changes of its slots.

    With ``loadings`` (slots x components) the splits are on components: the change of a component goes to the slots by their part
    ``loading * (x - mean)`` of it (nothing where the component is 0 for the row).
    """
    at = {f: [i for i, s in enumerate(slots) if s == f] for f in fields}
    if loadings is None:
        return F.array(*[sum_where(changes, lambda i, own=at[f]: i.isin(own)) for f in fields])
    k = loadings.shape[1]
    table = F.from_json(F.lit(json.dumps(np.asarray(loadings, float).T.tolist())), "array<array<double>>")
    centre = F.from_json(F.lit(json.dumps([float(m) for m in means])), "array<double>")
    centred = F.zip_with(x, centre, lambda a, b: a - b)
    zero = F.lit(0.0)
    total = lambda a: F.aggregate(a, zero, lambda acc, v: acc + v)

    def of_component(c: Column) -> Column:
        part = F.zip_with(F.element_at(table, c + 1), centred, lambda a, b: a * b)
        phi = F.aggregate(F.filter(changes, lambda s: s["f"] == c), zero, lambda acc, s: acc + s["d"])
        z = total(part)
        rate = F.when(F.abs(z) > 1e-9, phi / z).otherwise(zero)
        return F.array(*[rate * total(F.transform(F.array(*[F.lit(i + 1) for i in at[f]]), lambda i: F.element_at(part, i))) for f in fields])

    per = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), of_component)
    return F.aggregate(per, F.array(*[zero for _ in fields]), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
