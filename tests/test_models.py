"""Detectors by what they rank, not by values: outliers planted far from the rest must come first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchmere.operators import boosted
from watchmere.operators.attribution import attribution_lime, attribution_shap, background_rows
from watchmere.operators.autoencoder import Autoencoder, gradient, initial_weights, reconstruction_errors, train_autoencoder
from watchmere.operators.boosted import OneClassError, train_boosted_trees
from watchmere.operators.forest import Forest, train_forest
from watchmere.operators.scaling import Scaler
from watchmere.session import scratch_path

WIDTH = 6
NAMES = [f"f{i}" for i in range(WIDTH)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    common = rng.normal(size=(600, WIDTH))
    common[:, 3] = common[:, 0] + common[:, 1]
    strange = rng.normal(size=(6, WIDTH))
    strange = 10 * strange / np.linalg.norm(strange, axis=1)[:, None]
    x = np.vstack([common, strange])
    rows = [(i, x[i].tolist(), int(i >= 600)) for i in range(len(x))]
    return spark.createDataFrame(rows, "row_key INT, features ARRAY<DOUBLE>, label INT").cache()


def top(scored, n=6):
    return {r["row_key"] for r in scored.orderBy(F.desc("anomaly_score"), F.desc("row_key")).limit(n).collect()}


def test_forest_finds_outliers_repeats_and_persists(spark, planted):
    forest = train_forest(planted, WIDTH, trees=60)
    scored = forest.transform(planted)
    assert top(scored) == set(range(600, 606))
    low, high = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0 <= low < high <= 1
    again = train_forest(planted.repartition(5, "label", "row_key"), WIDTH, trees=60)
    assert np.allclose(forest.trees["threshold"], again.trees["threshold"])
    path = scratch_path(spark, "forest")
    forest.save(spark, path)
    loaded = Forest.load(spark, path).transform(planted).orderBy("row_key").select("anomaly_score").collect()
    assert loaded == scored.orderBy("row_key").select("anomaly_score").collect()
    one = forest.transform(planted.limit(1), normalize="batch").first()
    assert one["anomaly_score"] == pytest.approx(1.0)


def test_gradient_is_the_slope_of_the_loss():
    sizes, rng = (4, 3, 4), np.random.default_rng(0)
    x, flat = rng.normal(size=(5, 4)), initial_weights((4, 3, 4), 1)
    slope = gradient(x, flat, sizes)
    for i in range(0, len(flat), 5):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        change = [reconstruction_errors(x, flat + s * step, sizes).mean() * 4 / 2 for s in (1, -1)]
        # The penalty on weights is tiny against the tolerance.
        assert slope[i] == pytest.approx((change[0] - change[1]) / 2e-6, abs=1e-3)


def test_autoencoder_finds_outliers_and_repeats(spark, planted):
    options = {"hidden": (8, 4), "epochs": 40, "local_epochs": 10, "shard_rows": 250}
    normal = planted.filter("label = 0")
    model = train_autoencoder(normal, WIDTH, **options)
    errors = model.errors(planted).orderBy(F.desc("error")).limit(6)
    assert len({r["row_key"] for r in errors.collect()} & set(range(600, 606))) >= 5
    assert model.transform(planted).filter("anomaly_score < 0 OR anomaly_score > 1").isEmpty()
    again = train_autoencoder(normal.repartition(3, "row_key"), WIDTH, **options)
    assert np.allclose(model.weights, again.weights, atol=1e-6)
    path = scratch_path(spark, "autoencoder")
    model.save(spark, path)
    assert np.array_equal(Autoencoder.load(spark, path).weights, model.weights)


def test_boosted_trees_need_two_classes(spark, planted):
    with pytest.raises(OneClassError):
        train_boosted_trees(planted.filter("label = 0"), NAMES)
    model = train_boosted_trees(planted, NAMES, rounds=3, depth=3)
    assert top(model.transform(planted)) == set(range(600, 606))
    assert model.importance(spark).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def linear(rows):
    x = F.col("features")
    return rows.withColumn("anomaly_score", 2.0 * x[0] - 3.0 * x[1] + 0.5)


def test_shapley_values_of_a_linear_model(spark, planted):
    flagged = planted.filter("label = 1").select("row_key", "features")
    background = background_rows(planted, limit=20)
    got = attribution_shap(linear, flagged, background, NAMES, samples=400)
    values = {(r["entity_id"], r["feature"]): r["signed"] for r in got.collect()}
    assert len(values) == 6 * WIDTH
    for row in flagged.collect():
        assert all(values[row["row_key"], f"f{i}"] == pytest.approx(0.0, abs=1e-9) for i in range(2, WIDTH))
    # With one background row the values of a row add up to the exact difference of scores.
    single = background.filter("background = 0")
    base = linear(single.withColumnRenamed("reference", "features")).first()["anomaly_score"]
    sums = attribution_shap(linear, flagged, single, NAMES).groupBy("entity_id").agg(F.sum("signed").alias("s")).collect()
    scores = {r["row_key"]: r["anomaly_score"] for r in linear(flagged).collect()}
    assert {r["entity_id"]: r["s"] for r in sums} == pytest.approx({k: v - base for k, v in scores.items()})


def test_local_fit_of_a_linear_model(spark, planted):
    flagged = planted.filter("row_key = 600").select("row_key", "features")
    scaler = Scaler((0.0,) * WIDTH, (1.0, 2.0, 1.0, 1.0, 1.0, 1.0))
    got = {r["feature"]: r["signed"] for r in attribution_lime(linear, flagged, scaler, NAMES, features=2).collect()}
    assert set(got) == {"f0", "f1"}
    assert got["f0"] == pytest.approx(2.0, rel=0.05) and got["f1"] == pytest.approx(-6.0, rel=0.05)


def test_trees_split_neighbouring_doubles():
    """Between two neighbouring doubles a draw can only round to one of them; both sides keep rows all the same."""
    import pandas as pd

    from watchmere.operators.forest import grow_tree

    high = np.nextafter(1.0, 2.0)
    for tree in range(40):
        rows = pd.DataFrame({"tree": tree, "draw": range(8), "features": [[1.0 if i % 3 else high, 0.0] for i in range(8)]})
        grown = grow_tree(rows, 42)
        split = grown[grown["feature"] >= 0]
        assert len(split) == 1 and float(split["threshold"].iloc[0]) == 1.0


def test_boosted_trees_grow_in_as_many_tasks_as_run_at_once(spark, monkeypatch):
    seen = []

    class Learner:
        def __init__(self, **_):
            pass

        def fit(self, vectors):
            seen.append(vectors.rdd.glom().map(len).collect())

    monkeypatch.setattr(boosted, "GBTClassifier", Learner)
    rows = spark.range(20000).select(
        F.array((F.col("id") % 977).cast("double"), F.lit(1.0)).alias("features"), (F.col("id") % 2).cast("int").alias("label")
    )
    for given in (1, 64):  # one file, or many small ones
        train_boosted_trees(rows.repartition(given), ["a", "b"])
    few, many = seen
    assert len(few) == len(many) == 4 and sum(few) == sum(many) == 20000 and max(few) < 6000
