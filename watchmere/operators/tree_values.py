"""Exact Shapley values of tree models, in time polynomial in the size of the trees.

The value of a set of features is the mean output over background rows whose features outside the set are kept and whose
features in it are the explained row's. For one tree and one background row, a leaf is reached if each interval on its
path holds the feature of the row that it is taken from. Let a be the number of path features that only the explained
row satisfies, b that of those that only the background row does; a leaf that neither satisfies in some feature is out
of reach. Then each of the a features gains leaf x (a-1)! b! / (a+b)!, each of the b loses leaf x a! (b-1)! / (a+b)!.
Sums over leaves, trees and background rows are exact: they add up to the output less the mean output of the background.

What is explained is what trees add up to: the mean path length of a forest, the margin of boosted trees. Only flagged
rows are explained, dealt evenly to the tasks; trees and the patterns of at most BACKGROUND_ROWS background rows are sent
to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.operators.attribution import BACKGROUND_ROWS, background_rows
from watchmere.operators.boosted import BoostedTrees
from watchmere.operators.forest import Forest
from watchmere.operators.scaling import Scaler
from watchmere.session import scratch_path, spread

# Explained rows for which a task of its own is worth its start.
ROWS_PER_TASK = 16


@dataclass(frozen=True)
class Leaves:
    """The leaves of one tree: values, and per leaf the features of its path with the interval (low, high] of each."""

    value: np.ndarray
    feature: np.ndarray  # leaves x longest path, -1 where a path has fewer features
    low: np.ndarray
    high: np.ndarray


def leaves_of(feature, threshold, left, right, value) -> Leaves:
    """From arrays of nodes, the first being the root; rows with a value up to the threshold go left."""
    paths: list[tuple[float, dict[int, tuple[float, float]]]] = []
    waiting: list[tuple[int, dict[int, tuple[float, float]]]] = [(0, {})]
    while waiting:
        node, path = waiting.pop()
        f = int(feature[node])
        if f < 0:
            paths.append((float(value[node]), path))
            continue
        low, high = path.get(f, (-math.inf, math.inf))
        cut = float(threshold[node])
        waiting.append((int(right[node]), {**path, f: (max(low, cut), high)}))
        waiting.append((int(left[node]), {**path, f: (low, min(high, cut))}))
    most = max(1, max(len(p) for _, p in paths))
    shape = len(paths), most
    found = Leaves(np.array([v for v, _ in paths]), np.full(shape, -1), np.full(shape, -math.inf), np.full(shape, math.inf))
    for i, (_, path) in enumerate(paths):
        for j, (f, (low, high)) in enumerate(path.items()):
            found.feature[i, j], found.low[i, j], found.high[i, j] = f, low, high
    return found


def forest_leaves(forest: Forest) -> list[Leaves]:
    """Leaves of a forest, their values shared out so that trees add up to the mean path length."""
    trees = [tree for _, tree in forest.trees.groupby("tree", sort=True)]
    names = ("feature", "threshold", "left_node", "right_node")
    return [leaves_of(*(t[n].to_numpy() for n in names), t["path"].to_numpy() / len(trees)) for t in trees]


def boosted_leaves(spark: SparkSession, model: BoostedTrees) -> list[Leaves]:
    """Leaves of boosted trees, weighted so that trees add up to the margin; read from the saved model's node table."""
    path = scratch_path(spark, "trees")
    model.model.write().save(path)
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID",
        node["id"].alias("id"),
        F.when(node["leftChild"] >= 0, node["split"]["featureIndex"]).otherwise(-1).alias("feature"),
        F.coalesce(F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["prediction"].alias("value"),
    )
    table = nodes.toPandas().sort_values(["treeID", "id"])
    return [
        leaves_of(*(tree[c].to_numpy() for c in ("feature", "threshold", "left", "right")), weight * tree["value"].to_numpy())
        for (_, tree), weight in zip(table.groupby("treeID", sort=True), model.model.treeWeights, strict=True)
    ]


def outputs(trees: list[Leaves], x: np.ndarray) -> np.ndarray:
    """What the trees add up to for each row."""
    total = np.zeros(len(x))
    for t in trees:
        seen = x[:, t.feature]
        inside = ((seen > t.low) & (seen <= t.high) | (t.feature < 0)).all(axis=2)
        total += inside @ t.value
    return total


def _weights(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(a-1)! b! / (a+b)! and a! (b-1)! / (a+b)! by a and b, zero where a, or b, is."""
    gain = np.zeros((most + 1, most + 1))
    for a in range(1, most + 1):
        for b in range(most + 1 - a):
            gain[a, b] = math.factorial(a - 1) * math.factorial(b) / math.factorial(a + b)
    return gain, gain.T


@dataclass(frozen=True)
class Patterns:
    """The leaves of all trees, and which of a leaf's path features background rows satisfy, as bits.

    Background rows that satisfy the same features of a leaf are one pattern with their number, so none is looked at
    again for each explained row.
    """

    leaves: Leaves
    full: np.ndarray  # per leaf the bits of all its path features
    leaf: np.ndarray  # per pattern
    bits: np.ndarray
    share: np.ndarray  # the rows of the pattern by all rows, times the leaf's value


def _bits(leaves: Leaves, seen: np.ndarray) -> np.ndarray:
    """The path features that hold the values `seen`, whose last two axes are leaves and their features."""
    inside = (seen > leaves.low) & (seen <= leaves.high) & (leaves.feature >= 0)
    return inside @ (1 << np.arange(leaves.feature.shape[1], dtype=np.int64))


def patterns_of(trees: list[Leaves], background: np.ndarray) -> Patterns:
    most = max(t.feature.shape[1] for t in trees)

    def joined(parts: list[np.ndarray], fill: float) -> np.ndarray:
        return np.concatenate([np.pad(p, ((0, 0), (0, most - p.shape[1])), constant_values=fill) for p in parts])

    found = Leaves(
        np.concatenate([t.value for t in trees]),
        joined([t.feature for t in trees], -1),
        joined([t.low for t in trees], -math.inf),
        joined([t.high for t in trees], math.inf),
    )
    full = (found.feature >= 0) @ (1 << np.arange(most, dtype=np.int64))
    leaf, bits, share, at = [], [], [], 0
    for t in trees:  # One tree at a time, as whole rows by all leaves need not fit.
        met = _bits(t, background[:, t.feature])
        keys, n = np.unique(met + (np.arange(len(t.value)) << most), return_counts=True)
        at_leaf = keys >> most
        leaf.append(at_leaf + at)
        bits.append(keys & ((1 << most) - 1))
        share.append(n / len(background) * t.value[at_leaf])
        at += len(t.value)
    return Patterns(found, full, np.concatenate(leaf), np.concatenate(bits), np.concatenate(share))


def values_of(patterns: Patterns, row: np.ndarray) -> np.ndarray:
    """The Shapley values of one row against the background rows of the patterns."""
    leaves = patterns.leaves
    most = leaves.feature.shape[1]
    own = _bits(leaves, row[leaves.feature])
    reach = np.flatnonzero((own[patterns.leaf] | patterns.bits) == patterns.full[patterns.leaf])
    leaf, theirs, share = patterns.leaf[reach], patterns.bits[reach], patterns.share[reach]
    ours, theirs = own[leaf] & ~theirs, theirs & ~own[leaf]
    a, b = np.bitwise_count(ours), np.bitwise_count(theirs)
    gain, loss = _weights(most)
    gained, lost = gain[a, b] * share, loss[a, b] * share
    values = np.zeros(len(row))
    for j in range(most):
        step = np.where(ours >> j & 1, gained, 0.0) - np.where(theirs >> j & 1, lost, 0.0)
        some = np.flatnonzero(step)
        values += np.bincount(leaves.feature[leaf[some], j], step[some], minlength=len(row))
    return values


def shapley(trees: list[Leaves], row: np.ndarray, background: np.ndarray) -> np.ndarray:
    """The Shapley values of one row against background rows."""
    return values_of(patterns_of(trees, background), row)


def attribution_trees(
    trees: list[Leaves], scaler: Scaler, flagged: DataFrame, rows: DataFrame, names: list[str], limit: int = BACKGROUND_ROWS
) -> DataFrame:
    """Long rows (entity_id, feature, score, signed, output, base) of the flagged `(row_key, features)`.

    Background rows are those of smallest hash among `rows`, `limit` at most. Signed values add up to output - base.
    """
    held = background_rows(scaler.transform(rows.select("row_key", "features")), limit).orderBy("background").collect()
    background = np.array([r["reference"] for r in held])
    found = patterns_of(trees, background) if len(held) else None
    base = float(outputs(trees, background).mean())
    shared = flagged.sparkSession.sparkContext.broadcast((trees, found, base))
    columns = list(names)

    def explain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, patterns, base = shared.value
        for part in parts:
            for key, features in zip(part["row_key"], part["features"], strict=True):
                x = np.asarray(features, dtype=float)
                signed = values_of(patterns, x)
                output = float(outputs(trees, x[None])[0])
                yield pd.DataFrame(
                    {"entity_id": key, "feature": columns, "score": np.abs(signed), "signed": signed, "output": output, "base": base}
                )

    kept = flagged.select(F.col("row_key").cast("string").alias("row_key"), scaler.scaled(F.col("features")).alias("features"))
    # Few rows of much work each, which would else be taken by the one task that holds them.
    kept = spread(kept, kept.count(), ROWS_PER_TASK)
    made = "entity_id string, feature string, score double, signed double, output double, base double"
    return kept.mapInPandas(explain, made)
