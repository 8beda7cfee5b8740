"""Streaming jobs: the same operators over streams, tables as what is handed on between jobs.

Trailing windows that move with every event would repeat each event thousands of times, so a stream
only normalizes and appends to a table partitioned by day; features are computed by a batch job over
that table for the entities that changed. Sinks are files with checkpoints: a restarted job goes on
where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchmere.functions.columns import seconds_interval
from watchmere.operators import features as FE
from watchmere.operators import normalize as N
from watchmere.operators import rules as R
from watchmere.operators.alerts import create_alerts
from watchmere.operators.windows import by_day
from watchmere.schemas import ALERT_STATUSES, WINDOW_SECONDS, as_timestamp

RETENTION = "7 days"


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), every: str | None = None
) -> StreamingQuery:
    """Start appending a stream to a parquet table: every so often, or once for all there is now."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_to_table(stream: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Process all that is there now and read the table back."""
    schema = stream.schema
    append_stream(stream, f"{path}/table", f"{path}/checkpoint", partition_by).awaitTermination()
    # Partition columns are read with the types that they were written with.
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/table")


def normalize_stream(raw: DataFrame) -> DataFrame:
    """Accepted events of a stream of raw logs; nothing is kept between micro-batches."""
    return N.accepted(N.normalize(raw))


def event_table_stream(events: DataFrame) -> DataFrame:
    """Events with the day they belong to, for the table that features are computed from."""
    return events.withColumn("event_date", F.to_date("event_time"))


def unique_events(events: DataFrame, delay: str = RETENTION) -> DataFrame:
    """Each event id once. Ids are remembered for as long as events are retained, and events older
    than that are dropped."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def sliding_counts(events: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """Counts per entity in sliding windows, each given out once, when it can no longer change."""
    kind = F.lower("event_type")
    window = F.window("event_time", size, slide)
    counts = (
        events.withWatermark("event_time", delay)
        .groupBy("entity_id", window.alias("w"))
        .agg(
            F.count("*").alias("event_count"),
            *[F.count_if(kind.contains(text)).alias(name) for name, text in FE.TYPE_COUNTERS.items()],
        )
    )
    return counts.select(
        "entity_id",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "event_count",
        *FE.TYPE_COUNTERS,
    )


def changed_entities(events: DataFrame, since, as_of, windows: Sequence[int] = WINDOW_SECONDS) -> DataFrame:
    """Entities whose features differ between the two instants: something came in after `since`, or
    an event left one of the windows."""
    start, end = as_timestamp(since), as_timestamp(as_of)
    time = F.col("event_time")
    moved = (time > start) & (time <= end)
    for w in windows:
        moved = moved | ((time >= start - seconds_interval(w)) & (time < end - seconds_interval(w)))
    held = by_day(events, "event_date", start - seconds_interval(max(windows)), end)
    return held.filter(moved).select("entity_id").distinct()


def refresh_features(
    events: DataFrame, previous: DataFrame, since, as_of, windows: Sequence[int] = WINDOW_SECONDS
) -> DataFrame:
    """The features at `as_of` from those at `since`: changed entities anew, the others as they were."""
    changed = changed_entities(events, since, as_of, windows)
    touched = events.join(changed, "entity_id", "left_semi")
    fresh = FE.extract_features(touched, as_of, windows, entities=changed)
    return fresh.unionByName(previous.join(changed, "entity_id", "left_anti"))


def brute_force_stream(
    events: DataFrame, failures: int = R.BRUTE_FORCE_FAILURES, seconds: int = R.BRUTE_FORCE_SECONDS, delay: str = "1 hour"
) -> DataFrame:
    """Sessions of failed logins as `brute_force_sessions` finds them, each given out once when it is closed.

    A session is closed when the watermark is past its end: no row that may still come can be part of it.
    """
    return R.brute_force_sessions(events.withWatermark("event_time", delay), failures, seconds)


def score_stream(vectors: DataFrame, detectors, as_of) -> DataFrame:
    """Alert rows for a stream of `(row_key, features)`, each row scored by itself."""
    scored = vectors
    for name, model in detectors.models.items():
        scored = model.transform(scored).withColumn(f"_{name}", F.col("anomaly_score")).drop("anomaly_score", "is_anomaly")
    total = sum((F.col(f"_{name}") for name in detectors.models), F.lit(0.0))
    rated = scored.select(F.col("row_key").cast("string").alias("entity_id"), (total / len(detectors.models)).alias("final_score"))
    return create_alerts(rated, as_of)


def exfiltration_stream(events: DataFrame, seconds: int = R.EXFILTRATION_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Exfiltration events that follow a file access of the same entity; each is given out once."""
    late = events.withWatermark("event_time", delay)
    access = late.filter(F.col("event_type") == "file_access").select(
        F.col("entity_id").alias("access_entity"), F.col("event_time").alias("access_time")
    )
    sent = late.filter(F.col("event_type") == "data_exfiltration").select("entity_id", "event_id", "event_time")
    near = (
        (F.col("entity_id") == F.col("access_entity"))
        & (F.col("access_time") <= F.col("event_time"))
        & (F.col("access_time") >= F.col("event_time") - F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    )
    return sent.join(access, near, "left_semi")


def open_alert_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New and open alerts from the alert log as they are appended."""
    return spark.readStream.schema(schema).parquet(path).filter(F.col("status").isin(*ALERT_STATUSES[:2]))
