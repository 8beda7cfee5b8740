"""Attributing the score of a row to its features, for any model that scores feature arrays.

A model is a function from a DataFrame with `features` to the same with `anomaly_score`. Only flagged
rows are explained. All changed copies of all rows are scored in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchmere.operators.scaling import Scaler

Model = Callable[[DataFrame], DataFrame]

# Sample counts.
BACKGROUND_ROWS = 100
SHAPLEY_SAMPLES = 200
LIME_SAMPLES = 1000
LIME_FEATURES = 10
RIDGE = 1.0
SEED = 42


def background_rows(rows: DataFrame, limit: int = BACKGROUND_ROWS, seed: int = SEED) -> DataFrame:
    """A sample of training rows, those of smallest hash, numbered from 0."""
    picked = rows.select("features", F.xxhash64(F.lit(seed), "row_key").alias("_hash")).orderBy("_hash").limit(limit)
    # The window sees at most `limit` rows.
    numbered = picked.withColumn("background", F.row_number().over(Window.orderBy("_hash")) - 1)
    return numbered.select("background", F.col("features").alias("reference"))


def attribution_shap(
    model: Model,
    flagged: DataFrame,
    background: DataFrame,
    names: list[str],
    samples: int = SHAPLEY_SAMPLES,
    seed: int = SEED,
) -> DataFrame:
    """Shapley values from sampled orders (Strumbelj and Kononenko 2014), as long rows.

    Each of `flagged` (row_key, features) walks from a background row to itself, one feature at a
    time, in `samples / width` random orders but at least two; a feature's value is the mean change of
    the score at its step. Values of a row add up to its score minus the mean score of the background
    rows it started from. `score` is the absolute value, `signed` the value.
    """
    width = len(names)
    orders = max(2, math.ceil(samples / width))
    size = max(background.count(), 1)
    positions = F.sequence(F.lit(0), F.lit(width - 1))
    starts = flagged.select("row_key", "features", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("walk"))
    starts = starts.withColumn("background", F.pmod(F.xxhash64(F.lit(seed), "row_key", "walk"), F.lit(size)).cast("int"))
    # At most BACKGROUND_ROWS rows by construction.
    starts = starts.join(F.broadcast(background), "background")
    shuffled = F.array_sort(
        F.transform(
            positions, lambda j: F.struct(F.xxhash64(F.lit(seed), "row_key", "walk", j).alias("h"), j.alias("j"))
        )
    )
    starts = starts.withColumn("order", F.transform(shuffled, lambda s: s["j"]))
    # step_of[j] is the step at which feature j is taken over.
    starts = starts.withColumn(
        "step_of", F.transform(positions, lambda j: F.array_position("order", j).cast("int"))
    )
    steps = starts.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width)))).withColumn(
        "features",
        F.transform(
            positions,
            lambda j: F.when(F.get("step_of", j) <= F.col("step"), F.get("features", j)).otherwise(F.get("reference", j)),
        ),
    )
    scored = model(steps.select("row_key", "order", "step", "features"))
    # A score counts for the feature taken over at its step and against the one of the next step.
    ends = F.array(
        F.struct(F.get("order", F.col("step") - 1).alias("j"), F.col("anomaly_score").alias("v")),
        F.struct(F.get("order", F.col("step")).alias("j"), (-F.col("anomaly_score")).alias("v")),
    )
    values = scored.select("row_key", F.inline(ends)).filter(F.col("j").isNotNull())
    labels = F.array(*[F.lit(name) for name in names])
    signed = values.groupBy("row_key", "j").agg((F.sum("v") / orders).alias("signed"))
    return signed.select(
        F.col("row_key").alias("entity_id"),
        F.get(labels, F.col("j")).alias("feature"),
        F.abs("signed").alias("score"),
        "signed",
    )


def _uniform(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(*parts: Column) -> Column:
    """A standard normal number that depends on nothing but `parts`."""
    radius = F.sqrt(-2.0 * F.ln(_uniform(F.lit(1), *parts)))
    return radius * F.cos(2.0 * math.pi * _uniform(F.lit(2), *parts))


def _local_fit(part: pd.DataFrame, names: list[str], limit: int) -> pd.DataFrame:
    """Weighted ridge regression of the scores on the steps taken from the row, largest weights first."""
    x = np.stack(part["steps"].to_numpy())
    y, weight = part["anomaly_score"].to_numpy(), np.sqrt(np.exp(-(x**2).sum(axis=1) / (0.75**2 * x.shape[1])))
    weight = weight / max(weight.sum(), 1e-300)
    x_mean, y_mean = weight @ x, weight @ y
    centred = x - x_mean
    # The weights sum to one, so the penalty is that of as many rows of weight one.
    gram = centred.T @ (centred * weight[:, None]) + RIDGE / len(x) * np.eye(x.shape[1])
    slope = np.linalg.solve(gram, centred.T @ (weight * (y - y_mean)))
    top = np.lexsort((np.arange(len(slope)), -np.abs(slope)))[:limit]
    return pd.DataFrame(
        {
            "entity_id": [str(part["row_key"].iloc[0])] * len(top),
            "feature": [names[i] for i in top],
            "score": np.abs(slope[top]),
            "signed": slope[top],
        }
    )


def attribution_lime(
    model: Model,
    flagged: DataFrame,
    scaler: Scaler,
    names: list[str],
    samples: int = LIME_SAMPLES,
    features: int = LIME_FEATURES,
    seed: int = SEED,
) -> DataFrame:
    """Weights of a linear model that imitates the score around each row (Ribeiro et al. 2016).

    Every flagged row is moved `samples` times by normal steps in units of the training deviations;
    the fit then sees `samples` rows per flagged row, a fixed number.
    """
    width = len(names)
    positions = F.sequence(F.lit(0), F.lit(width - 1))
    deviations = F.array(*[F.lit(d) for d in scaler.deviations])
    moved = flagged.select("row_key", "features", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    moved = moved.withColumn("steps", F.transform(positions, lambda j: _normal(F.lit(seed), F.col("row_key"), F.col("sample"), j)))
    moved = moved.withColumn(
        "features",
        F.transform(positions, lambda j: F.get("features", j) + F.get("steps", j) * F.get(deviations, j)),
    )
    scored = model(moved).select("row_key", "steps", "anomaly_score")
    schema = "entity_id STRING, feature STRING, score DOUBLE, signed DOUBLE"
    return scored.groupBy("row_key").applyInPandas(lambda part: _local_fit(part, names, features), schema)
