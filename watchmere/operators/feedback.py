"""Analyst feedback on alerts and what retraining takes from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchmere.schemas import as_timestamp

# Retraining.
MIN_SAMPLES = 100
CONFIDENCE_RANGE = (1, 5)
FIRST_VERSION = "1.0.0"


def valid_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback whose required fields are there and whose confidence is in range."""
    required = F.col("alert_id").isNotNull() & F.col("is_true_positive").isNotNull()
    return feedback.filter(required & F.col("confidence").between(*CONFIDENCE_RANGE))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The newest feedback id of each alert."""
    newest = F.max(F.struct("event_time", "feedback_id"))
    return (
        valid_feedback(feedback)
        .groupBy("alert_id")
        .agg(newest.alias("_last"), F.count("*").alias("feedback_count"))
        .select("alert_id", F.col("_last.feedback_id").alias("feedback_id"), "feedback_count")
    )


def feedback_history(feedback: DataFrame, requested: DataFrame) -> DataFrame:
    """All feedback of the requested alerts, as rows: one alert may have any number of them."""
    return feedback.join(requested.select("alert_id"), "alert_id", "left_semi")


def pending_feedback(feedback: DataFrame, last_retrain=None) -> DataFrame:
    """Valid feedback that came after the last retraining."""
    rows = valid_feedback(feedback)
    return rows if last_retrain is None else rows.filter(F.col("event_time") > as_timestamp(last_retrain))


def retraining_data(feedback: DataFrame, min_samples: int = MIN_SAMPLES, last_retrain=None) -> DataFrame:
    """The first `min_samples` true and as many false positives in order of arrival."""
    order = Window.partitionBy("is_true_positive").orderBy("event_time", "feedback_id")
    rows = pending_feedback(feedback, last_retrain).select("feedback_id", "alert_id", "event_time", "is_true_positive")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= min_samples)


def feedback_statistics(feedback: DataFrame, last_retrain=None) -> DataFrame:
    valid = valid_feedback(feedback)
    late = F.lit(True) if last_retrain is None else F.col("event_time") > as_timestamp(last_retrain)
    hit = F.col("is_true_positive")
    return valid.agg(
        F.count("*").alias("total_feedback"),
        F.count_if(hit).alias("true_positives"),
        F.count_if(~hit).alias("false_positives"),
        (F.count_if(hit) / F.greatest(F.count("*"), F.lit(1))).alias("true_positive_rate"),
        F.count_if(late).alias("pending_retraining_samples"),
    )


def retraining_status(
    feedback: DataFrame, min_samples: int = MIN_SAMPLES, last_retrain=None, version: str = FIRST_VERSION
) -> DataFrame:
    pending = F.col("pending_retraining_samples")
    return feedback_statistics(feedback, last_retrain).select(
        F.when(pending >= min_samples, "ready").otherwise("collecting").alias("status"),
        pending.alias("samples_collected"),
        F.lit(version).alias("model_version"),
    )


def next_version(version: str) -> str:
    return f"{int(version.split('.')[0]) + 1}.0.0"


def feedback_disposition(feedback: DataFrame) -> DataFrame:
    """The status that each piece of feedback suggests for its alert."""
    status = F.when(F.col("is_true_positive"), "resolved").otherwise("false_positive")
    return valid_feedback(feedback).select("feedback_id", "alert_id", "event_time", status.alias("status"))


def apply_disposition(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Alerts with the status that their newest feedback suggests."""
    newest = (
        feedback_disposition(feedback)
        .groupBy("alert_id")
        .agg(F.max(F.struct("event_time", "feedback_id", "status")).alias("_last"))
        .select("alert_id", F.col("_last.status").alias("_status"), F.col("_last.event_time").alias("_at"))
    )
    return (
        alerts.join(newest, "alert_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("resolved_at", F.coalesce("_at", "resolved_at"))
        .drop("_status", "_at")
    )


def training_rows(feedback: DataFrame, alerts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows `(row_key, features, label)` for a supervised model from pending feedback.

    Feedback meets its alert and the alert's entity its stored vector; the label is 1 for a true
    positive. Feedback is cut to one verdict per alert first, so that an alert with much feedback
    weighs as much as any other and sends one row.
    """
    verdict = (
        valid_feedback(feedback)
        .groupBy("alert_id")
        .agg(F.max(F.struct("event_time", "feedback_id", "is_true_positive")).alias("_last"))
        .select("alert_id", F.col("_last.is_true_positive").cast("int").alias("label"))
    )
    return (
        verdict.join(alerts.select("alert_id", "entity_id"), "alert_id")
        .join(vectors.select("entity_id", "features"), "entity_id")
        .select(F.col("alert_id").alias("row_key"), "features", "label")
    )
