"""Shapley values of a fitted forest for every row (path-dependent, as for tree ensembles).

A leaf is reached under one condition per feature on its path: the feature lies in an interval
(conditions on the same feature merged). With a coalition of known features, a tree's value is
the sum over its leaves of the leaf's value times, for each feature on the path, 1 or 0 by the
row if the feature is known, else the share of training weight that follows the path there.
A feature's Shapley value for a leaf then depends on the row only through which conditions hold:
a table of 2^m entries for a path of m features, filled from the subset weights.

Rows stay where they are: each task looks up its own rows, tree by tree, so it holds one tree's
tables at a time. The forest's leaves are broadcast; their number is bounded by the model's own
parameters (trees times 2^depth), whatever the table holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import checkpoint_dir

MOST_LEAVES = 1 << 20


@dataclass
class Leaf:
    """value, and by feature on the path: above < x <= upto, share of the weight."""

    value: float
    conditions: dict[int, tuple[float, float, float]]


def forest_leaves(model) -> list[list[Leaf]]:
    """Leaves of each tree of a binary forest classifier (continuous features), from the node
    table the model writes; a leaf's value is its share of class 1."""
    import uuid

    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    most = model.getNumTrees * 2 ** model.getOrDefault("maxDepth")
    if most > MOST_LEAVES:
        raise ValueError(f"a forest of up to {most} leaves is not broadcast")
    path = f"{checkpoint_dir(spark)}/forest-{uuid.uuid4().hex[:12]}"
    model.write().save(path)
    node = "nodeData"
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", f"{node}.id", f"{node}.impurityStats", f"{node}.leftChild", f"{node}.rightChild",
        F.col(f"{node}.split.featureIndex").alias("feature"),
        F.col(f"{node}.split.leftCategoriesOrThreshold").alias("threshold"),
        F.col(f"{node}.split.numCategories").alias("categories")).collect()   # at most twice MOST_LEAVES
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r.treeID, {})[r.id] = r
    return [_leaves(nodes) for _, nodes in sorted(trees.items())]


def _leaves(nodes: dict) -> list[Leaf]:
    out, todo = [], [(0, {})]
    while todo:
        at, conditions = todo.pop()
        node = nodes[at]
        if node.leftChild < 0:
            out.append(Leaf(node.impurityStats[1] / sum(node.impurityStats), conditions))
            continue
        if node.categories >= 0:
            raise ValueError("only continuous features")
        whole, cut = sum(node.impurityStats), node.threshold[0]
        above, upto, share = conditions.get(node.feature, (-math.inf, math.inf, 1.0))
        for child, interval in ((node.leftChild, (above, min(upto, cut))), (node.rightChild, (max(above, cut), upto))):
            part = sum(nodes[child].impurityStats) / whole
            todo.append((child, {**conditions, node.feature: (*interval, share * part)}))
    return out


def base_value(trees: list[list[Leaf]]) -> float:
    """What the forest gives when no feature is known."""
    return float(np.mean([sum(x.value * math.prod(c[2] for c in x.conditions.values()) for x in tree) for tree in trees]))


def _table(leaf: Leaf) -> np.ndarray:
    """(2^m, m): the value of each feature on the path by which conditions hold (bit k: the k-th)."""
    m = len(leaf.conditions)
    share = np.array([c[2] for c in leaf.conditions.values()])
    held = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    out = np.empty((1 << m, m))
    weight = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
    for j in range(m):
        # Coefficient s: the sum over coalitions of s others of what the path lets through.
        through = np.zeros((1 << m, m))
        through[:, 0] = 1.0
        for k in range(m):
            if k != j:
                grown = through * share[k]
                grown[:, 1:] += through[:, :-1] * held[:, k:k + 1]
                through = grown
        out[:, j] = through @ weight * (held[:, j] - share[j]) * leaf.value
    return out


def contributions(x: np.ndarray, trees: list[list[Leaf]]) -> np.ndarray:
    """Shapley value of each feature (columns of ``x``) for each row, averaged over the trees."""
    out = np.zeros(x.shape)
    for tree in trees:
        for leaf in tree:
            holds = np.zeros(len(x), np.int64)
            for k, (feature, (above, upto, _)) in enumerate(leaf.conditions.items()):
                column = x[:, feature]
                holds |= ((column > above) & (column <= upto)).astype(np.int64) << k
            if leaf.conditions:
                out[:, list(leaf.conditions)] += _table(leaf)[holds]
    return out / len(trees)


def explain(rows: DataFrame, model, features: list[str]) -> DataFrame:
    """``rows`` plus base_value and, for each feature, shap_<feature>: they add up to the
    model's probability of class 1. One pass over the rows, without a shuffle."""
    trees = forest_leaves(model)
    base = base_value(trees)
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    names = ["base_value", *[f"shap_{f}" for f in features]]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
            phi = contributions(x, shared.value)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(x), base)), *[pa.array(phi[:, i]) for i in range(len(features))]],
                [*b.schema.names, *names])

    return rows.mapInArrow(run, schema)
