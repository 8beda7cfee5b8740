"""Combining the scores of several detectors and saying in words what they found.

Scores are long rows `(entity_id, model_name, anomaly_score, is_anomaly)`, one per scored vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchmere.functions.columns import exact_mean, two_places

# Decision and text thresholds.
DECISION_ABOVE = 0.5
NORMAL_BELOW = 0.3
TOP_EXPLAINED = 3

# What the texts say.
NORMAL_TEXT = ": Normal behavior detected"
ANOMALY_TEXT = ": Anomaly detected. Top contributors: "


def with_labels(scores: DataFrame, above: float = DECISION_ABOVE) -> DataFrame:
    """Add `is_anomaly` to scores whose detector gives no label of its own."""
    return scores.withColumn("is_anomaly", (F.col("anomaly_score") > above).cast("int"))


def model_predictions(scores: DataFrame) -> DataFrame:
    """One prediction per entity and model: the mean over the entity's vectors."""
    mean = exact_mean("anomaly_score")
    return scores.groupBy("entity_id", "model_name").agg(
        mean.alias("anomaly_score"),
        (F.avg("is_anomaly") > DECISION_ABOVE).alias("is_anomaly"),
        (1 - F.abs(mean - 0.5) * 2).alias("confidence"),
    )


def ensemble_score(predictions: DataFrame) -> DataFrame:
    """The mean of the models' scores, the decision, and the share of models that vote anomaly."""
    mean = exact_mean("anomaly_score")
    return predictions.groupBy("entity_id").agg(
        mean.alias("final_score"),
        (mean > DECISION_ABOVE).alias("final_decision"),
        F.avg(F.col("is_anomaly").cast("double")).alias("consensus_level"),
        F.count("*").alias("model_count"),
    )


def batch_ensemble_score(scores: DataFrame) -> DataFrame:
    """One answer for all rows together: each model averages its rows first."""
    one = scores.withColumn("entity_id", F.lit(""))
    return ensemble_score(model_predictions(one))


def ranked_list(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The `limit` best (feature, score) pairs per key as an ordered array.

    The rank is cut before anything is collected, so that an array holds `limit` pairs at most.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "feature")
    top = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)
    pairs = F.array_sort(F.collect_list(F.struct("_rank", "feature", "score")))
    return top.groupBy(*keys).agg(pairs.alias("top"))


def model_explanations(predictions: DataFrame, importances: DataFrame) -> DataFrame:
    """A sentence per prediction; `importances` has (model_name, feature, score) or, per entity,
    (entity_id, feature, score)."""
    keys = [name for name in ("entity_id", "model_name") if name in importances.columns]
    top = ranked_list(importances, TOP_EXPLAINED, *keys)
    named = F.transform("top", lambda x: F.concat(x["feature"], F.lit(" ("), two_places(x["score"]), F.lit(")")))
    text = F.when(
        F.col("anomaly_score") < NORMAL_BELOW, F.concat("model_name", F.lit(NORMAL_TEXT))
    ).otherwise(
        F.concat("model_name", F.lit(ANOMALY_TEXT), F.concat_ws(", ", named))
    )
    return predictions.join(top, keys, "left").withColumn("explanation", text).drop("top")


def aggregated_importance(importances: DataFrame, model_count: int) -> DataFrame:
    """Importance per feature, summed over models and divided by their number."""
    return importances.groupBy("feature").agg((F.sum("score") / F.lit(float(model_count))).alias("importance"))
