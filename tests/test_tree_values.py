"""Exact Shapley values of trees, forests from one hash a row, and sums of whole weight arrays."""

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from watchmere.operators import tree_values as T
from watchmere.operators.autoencoder import _added_up
from watchmere.operators.boosted import train_boosted_trees
from watchmere.operators.forest import train_forest, tree_samples
from watchmere.operators.scaling import Scaler

WIDTH = 8
NAMES = [f"f{i}" for i in range(WIDTH)]


def by_enumeration(trees, row, background):
    """The definition: each feature's gain over all sets of the others."""

    def value(chosen):
        mixed = background.copy()
        mixed[:, list(chosen)] = row[list(chosen)]
        return T.outputs(trees, mixed).mean()

    n = len(row)
    out = np.zeros(n)
    for j in range(n):
        others = [i for i in range(n) if i != j]
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for chosen in itertools.combinations(others, size):
                out[j] += weight * (value((*chosen, j)) - value(chosen))
    return out


def table(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, WIDTH)).round(1)  # Many equal values, also on thresholds.
    label = ((x[:, 0] > 0) & (x[:, 1] < 0.5) | (x[:, 2] > 1)).astype(int)
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_key int, features array<double>, label int"), x


def check(spark, trees, scaler, rows, output):
    some = rows.filter("row_key < 12")
    made = T.attribution_trees(trees, scaler, some, rows, NAMES, limit=20)
    found = made.toPandas()
    assert len(found) == 12 * WIDTH
    from watchmere.operators.attribution import background_rows

    held = [r["reference"] for r in background_rows(scaler.transform(rows.select("row_key", "features")), 20).orderBy("background").collect()]
    background = np.array(held)
    x = {str(r["row_key"]): np.array(r["features"]) for r in scaler.transform(some).collect()}
    for key, part in found.groupby("entity_id"):
        part = part.set_index("feature").loc[NAMES]
        assert abs(part["signed"].sum() - (part["output"].iloc[0] - part["base"].iloc[0])) < 1e-9
        assert abs(part["output"].iloc[0] - output[key]) < 1e-9
        assert np.allclose(part["score"], part["signed"].abs())
        if int(key) < 4:
            assert np.abs(part["signed"].to_numpy() - by_enumeration(trees, x[key], background)).max() < 1e-9
    assert T.attribution_trees(trees, scaler, some.limit(0), rows, NAMES).count() == 0


def test_values_of_a_forest(spark):
    rows, _ = table(spark)
    forest = train_forest(rows, WIDTH, trees=15, max_samples=64)
    trees = T.forest_leaves(forest)
    scored = forest.raw_scores(rows.filter("row_key < 12")).collect()
    from watchmere.operators.forest import average_path

    path = {str(r["row_key"]): -math.log2(-r["raw_score"]) * average_path(forest.sample_size) for r in scored}
    check(spark, trees, forest.scaler, rows, path)


def test_values_of_boosted_trees(spark):
    rows, _ = table(spark)
    model = train_boosted_trees(rows, NAMES, rounds=6, depth=4)
    trees = T.boosted_leaves(spark, model)
    # The probability is 1 / (1 + exp(-2 margin)).
    scored = model.transform(rows.filter("row_key < 12")).collect()
    margin = {str(r["row_key"]): math.log(r["anomaly_score"] / (1 - r["anomaly_score"])) / 2 for r in scored}
    check(spark, trees, model.scaler, rows, margin)


def test_a_tree_of_one_leaf(spark):
    leaf = T.leaves_of([-1], [0.0], [-1], [-1], [3.5])
    assert T.shapley([leaf], np.zeros(4), np.ones((5, 4))).tolist() == [0.0] * 4
    assert T.outputs([leaf], np.zeros((2, 4))).tolist() == [3.5, 3.5]


def test_features_used_twice_on_a_path():
    # f0 <= 5 then f0 <= 2: the inner leaf needs the lower bound of both.
    tree = T.leaves_of([0, 0, -1, -1, -1], [5.0, 2.0, 0, 0, 0], [1, 2, -1, -1, -1], [4, 3, -1, -1, -1], [0, 0, 1.0, 2.0, 4.0])
    for x, z in itertools.product((1.0, 2.0, 3.0, 5.0, 6.0), repeat=2):
        row, background = np.array([x, 0.0]), np.array([[z, 0.0]])
        want = T.outputs([tree], row[None])[0] - T.outputs([tree], background)[0]
        assert T.shapley([tree], row, background).tolist() == [want, 0.0]


def test_every_tree_has_its_sample_at_any_partitioning(spark):
    rows = spark.range(30_000).select(F.col("id").alias("row_key"), F.array(F.col("id").cast("double")).alias("features"))
    one = tree_samples(rows.coalesce(1), 30_000, 50, 64, 7)
    many = tree_samples(rows.repartition(9, "features"), 30_000, 50, 64, 7)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    sizes = [r["count"] for r in one.groupBy("tree").count().collect()]
    assert len(sizes) == 50 and min(sizes) > 55 and max(sizes) == 64
    # Rows are alike in how often they are drawn: no part of the table is preferred.
    means = one.groupBy("tree").agg(F.avg(F.element_at("features", 1)).alias("m")).toPandas()["m"]
    assert abs(means.mean() - 15_000) < 5 * 8_660 / math.sqrt(50 * 64)
    # Trees draw independently: two trees share about 64 * 64 / 30,000 rows.
    assert one.groupBy("features").count().filter("count > 5").count() == 0
    few = tree_samples(rows.limit(40), 40, 5, 64, 7)
    assert few.groupBy("tree").count().filter("count = 40").count() == 5


def test_weights_add_up_over_tasks(spark):
    rows = [([float(i), 1.0], i, i / 2, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "weights array<double>, n bigint, loss double, m bigint").repartition(5)
    total, n, loss, m = _added_up(df, 3)
    assert total.tolist() == [190.0, 20.0] and (n, loss, m) == (190, 95.0, 20)


def test_scaled_rows_are_explained(spark):
    rows, _ = table(spark, 60)
    tree = T.leaves_of([0, -1, -1], [1.0, 0, 0], [1, -1, -1], [2, -1, -1], [0, 0.0, 10.0])
    scaler = Scaler((1.0,) + (0.0,) * 7, (0.5,) + (1.0,) * 7)
    found = T.attribution_trees([tree], scaler, rows, rows, NAMES, 10).toPandas()
    raw = {str(r["row_key"]): r["features"][0] for r in rows.collect()}
    for r in pd.DataFrame(found[found["feature"] == "f0"]).itertuples():
        assert r.output == (10.0 if (raw[r.entity_id] - 1.0) / 0.5 > 1.0 else 0.0)


def test_explained_rows_are_dealt_to_tasks(spark):
    """Rows that one task holds are explained by several, and each still gets the values of its own."""
    rows, x = table(spark)
    forest = train_forest(rows, WIDTH, trees=5, max_samples=64)
    trees = T.forest_leaves(forest)
    made = T.attribution_trees(trees, forest.scaler, rows.filter("row_key < 60").coalesce(1), rows, NAMES, limit=20)
    tasks = made.select("entity_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r["task"] for r in tasks}) > 1 and len(tasks) == 60
    # Equal background rows are one pattern; what they add up to is that of each by itself.
    some = np.repeat(x[:6], [1, 2, 3, 1, 1, 4], axis=0)
    for row in x[:5]:
        each = np.mean([T.shapley(trees, row, z[None]) for z in some], axis=0)
        assert np.abs(T.shapley(trees, row, some) - each).max() < 1e-12
