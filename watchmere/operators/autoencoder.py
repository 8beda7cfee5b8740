"""Autoencoder trained by averaging: every shard of rows trains from the same weights, then the
weights are averaged by Spark and the next round begins (Zinkevich et al. 2010).

Shards are given by hashes of the row key and have a bounded number of rows, so rounds repeat exactly
whatever the partitioning. The result is close to, not the same as, one sequential training run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from watchmere.functions.columns import mod_hash
from watchmere.operators.scaling import Scaler, fit_scaler

# Layers and training.
HIDDEN_LAYERS = (128, 64, 32)
ENCODING = 32
EPOCHS = 100
VALIDATION_PERCENT = 10
LEARNING_RATE = 0.001
BATCH = 200
PENALTY = 0.0001
PATIENCE_EPOCHS = 10
TOLERANCE = 0.0001
LABEL_ABOVE = 0.5
SEED = 42

# Ours: rows per shard on average, and passes over a shard between two averagings.
SHARD_ROWS = 8192
LOCAL_EPOCHS = 5


def layer_shapes(sizes: Sequence[int]) -> list[tuple[int, int]]:
    return list(zip(sizes[:-1], sizes[1:]))


def unpack(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the flat weights as (matrix, bias) per layer."""
    layers, at = [], 0
    for rows, columns in layer_shapes(sizes):
        matrix = flat[at : at + rows * columns].reshape(rows, columns)
        at += rows * columns
        layers.append((matrix, flat[at : at + columns]))
        at += columns
    return layers


def initial_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    parts = []
    for rows, columns in layer_shapes(sizes):
        bound = math.sqrt(6.0 / (rows + columns))
        parts += [random.uniform(-bound, bound, rows * columns), random.uniform(-bound, bound, columns)]
    return np.concatenate(parts)


def activations(x: np.ndarray, layers) -> list[np.ndarray]:
    out = [x]
    for i, (matrix, bias) in enumerate(layers):
        z = out[-1] @ matrix + bias
        out.append(z if i == len(layers) - 1 else np.maximum(z, 0.0))
    return out


def gradient(x: np.ndarray, flat: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Gradient of half the mean squared reconstruction error plus the weight penalty."""
    layers = unpack(flat, sizes)
    levels = activations(x, layers)
    out = np.empty_like(flat)
    slots = unpack(out, sizes)
    delta = (levels[-1] - x) / len(x)
    for i in range(len(layers) - 1, -1, -1):
        slots[i][0][:] = levels[i].T @ delta + PENALTY / len(x) * layers[i][0]
        slots[i][1][:] = delta.sum(axis=0)
        if i:
            delta = (delta @ layers[i][0].T) * (levels[i] > 0)
    return out


def train_shard(x: np.ndarray, flat: np.ndarray, sizes: Sequence[int], epochs: int, seed: Sequence[int]) -> np.ndarray:
    """Some epochs of mini-batch Adam over the rows of one shard."""
    flat = flat.copy()
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    random, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for start in range(0, len(x), BATCH):
            g = gradient(x[order[start : start + BATCH]], flat, sizes)
            step += 1
            first = 0.9 * first + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            rate = LEARNING_RATE * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            flat -= rate * first / (np.sqrt(second) + 1e-8)
    return flat


def reconstruction_errors(x: np.ndarray, flat: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    return np.mean((activations(x, unpack(flat, sizes))[-1] - x) ** 2, axis=1)


@dataclass(frozen=True)
class Autoencoder:
    """Trained weights, the scaler, and mean and deviation of the training errors."""

    weights: np.ndarray
    sizes: tuple[int, ...]
    scaler: Scaler
    error_mean: float = 0.0
    error_deviation: float = 0.0

    def importances(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """Rows (feature, importance): a reconstruction error says nothing about single features, so all are alike."""
        values = [(name, 1.0 / len(names)) for name in names]
        return rows.sparkSession.createDataFrame(values, "feature STRING, importance DOUBLE")

    def errors(self, rows: DataFrame, name: str = "error") -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(self.weights)
        sizes = self.sizes

        @pandas_udf("double")
        def error(features: pd.Series) -> pd.Series:
            if len(features) == 0:
                return pd.Series([], dtype="float64")
            return pd.Series(reconstruction_errors(np.stack(features.to_numpy()), shared.value, sizes))

        return rows.withColumn(name, error(self.scaler.scaled(F.col("features"))))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add `anomaly_score`, the error's z-score cut to [0, 1], and `is_anomaly`."""
        z = (F.col("error") - self.error_mean) / (self.error_deviation + 1e-10)
        scored = self.errors(rows).withColumn("anomaly_score", F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0)))
        return scored.withColumn("is_anomaly", (F.col("anomaly_score") > LABEL_ABOVE).cast("int")).drop("error")

    def save(self, spark: SparkSession, path: str) -> None:
        row = (
            self.weights.tolist(),
            list(self.sizes),
            list(self.scaler.means),
            list(self.scaler.deviations),
            self.error_mean,
            self.error_deviation,
        )
        schema = (
            "weights ARRAY<DOUBLE>, sizes ARRAY<INT>, means ARRAY<DOUBLE>, deviations ARRAY<DOUBLE>, "
            "error_mean DOUBLE, error_deviation DOUBLE"
        )
        spark.createDataFrame([row], schema).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Autoencoder:
        row = spark.read.parquet(path).first()
        scaler = Scaler(tuple(row["means"]), tuple(row["deviations"]))
        return Autoencoder(
            np.array(row["weights"]), tuple(row["sizes"]), scaler, row["error_mean"], row["error_deviation"]
        )


def unscaled(width: int) -> Scaler:
    return Scaler((0.0,) * width, (1.0,) * width)


ROUND_SCHEMA = "weights ARRAY<DOUBLE>, n BIGINT, loss DOUBLE, m BIGINT"


def _round_of_training(shared, sizes: Sequence[int], epochs: int, seed: list[int]):
    """A function that trains one shard, giving weights times rows, and tells the loss of the weights it started from."""

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_key")
        x, held_out = np.stack(part["features"].to_numpy()), part["held_out"].to_numpy()
        weights = shared.value
        loss = float(reconstruction_errors(x[held_out], weights, sizes).sum()) if held_out.any() else 0.0
        kept = x[~held_out]
        if len(kept):
            weights = train_shard(kept, weights, sizes, epochs, [*seed, int(part["shard"].iloc[0])])
        return pd.DataFrame([{"weights": weights * len(kept), "n": len(kept), "loss": loss, "m": int(held_out.sum())}])

    return train


def _add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for all rows of a task: weights, counts and losses added up, one row held at a time."""
    total, n, loss, m = None, 0, 0.0, 0
    for part in parts:
        for row in part.itertuples(index=False):
            total = np.array(row.weights) if total is None else total + row.weights
            n, loss, m = n + row.n, loss + row.loss, m + row.m
    if total is not None:
        yield pd.DataFrame([{"weights": total, "n": n, "loss": loss, "m": m}])


def _added_up(trained: DataFrame, groups: int) -> tuple[np.ndarray, int, float, int]:
    """Weights times rows, rows, losses and held-out rows over all shards.

    Each task that trained adds up its shards, some groups add up the tasks, and the driver adds the groups: whole
    arrays travel, one row per task and one per group.
    """
    rows = trained.mapInPandas(_add, ROUND_SCHEMA).repartition(groups).mapInPandas(_add, ROUND_SCHEMA).collect()
    return (
        np.sum([r["weights"] for r in rows], axis=0),
        sum(r["n"] for r in rows),
        math.fsum(r["loss"] for r in rows),
        sum(r["m"] for r in rows),
    )


def train_autoencoder(
    rows: DataFrame,
    width: int,
    hidden: Sequence[int] = (*HIDDEN_LAYERS, ENCODING),
    epochs: int = EPOCHS,
    local_epochs: int = LOCAL_EPOCHS,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
) -> Autoencoder:
    """Train on `(row_key, features)`. Per round one set of averaged weights comes to the driver."""
    scaler = fit_scaler(rows, width)
    sizes = (width, *hidden, width)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    # Rows are laid out by shard once; rounds then group them without a shuffle. A lost executor's
    # rows are computed again from the input.
    laid_out = (
        rows.select(
            "row_key",
            scaler.scaled(F.col("features")).alias("features"),
            mod_hash(["row_key"], shards).alias("shard"),
            (mod_hash([F.lit(seed), "row_key"], 100) < VALIDATION_PERCENT).alias("held_out"),
        )
        .repartition("shard")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    weights = initial_weights(sizes, seed)
    best, best_loss, waited = weights, math.inf, 0

    def held_out_loss(flat: np.ndarray) -> float:
        """Without held-out rows every loss is the same, and the last weights count."""
        errors = Autoencoder(flat, sizes, unscaled(width)).errors(laid_out.filter("held_out").select("features"))
        found = errors.agg(F.avg("error")).first()[0]
        return -math.inf if found is None else float(found)

    try:
        for round_number in range(math.ceil(epochs / local_epochs)):
            shared = rows.sparkSession.sparkContext.broadcast(weights)

            trained = laid_out.groupBy("shard").applyInPandas(
                _round_of_training(shared, sizes, local_epochs, [seed, round_number]), ROUND_SCHEMA
            )
            total, n, errors, scored = _added_up(trained, math.ceil(math.sqrt(shards)))
            loss = errors / scored if scored else math.inf
            if loss < best_loss - TOLERANCE:
                best, best_loss, waited = weights, loss, 0
            elif scored:
                waited += local_epochs
                if waited >= PATIENCE_EPOCHS:
                    break
            weights = total / n if n else weights
        else:
            # A round tells the loss of the weights that it starts from, so those of the last one are scored here.
            if held_out_loss(weights) < best_loss - TOLERANCE:
                best = weights
    finally:
        laid_out.unpersist()
    model = Autoencoder(best, sizes, scaler)
    mean, deviation = model.errors(rows.select("features")).agg(F.avg("error"), F.stddev_pop("error")).first()
    return Autoencoder(best, sizes, scaler, mean, deviation)
