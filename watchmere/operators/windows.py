"""Trailing windows ending at a fixed instant, retention and engine statistics.

All windows end at `as_of` and are nested, so an event belongs to every window at least as long as
its age. The operators scan once, for the longest window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchmere.functions.columns import seconds_interval
from watchmere.schemas import WINDOW_SECONDS, as_timestamp


def by_day(rows: DataFrame, day: str, first: Column | None, last: Column | None) -> DataFrame:
    """Where a table is partitioned by a day column, its partitions are cut down to the days of a time range."""
    if day in rows.columns:
        if first is not None:
            rows = rows.filter(F.col(day) >= F.to_date(first))
        if last is not None:
            rows = rows.filter(F.col(day) <= F.to_date(last))
    return rows


def window_events(events: DataFrame, as_of, window_seconds: int, time: str = "event_time") -> DataFrame:
    """Events not older than the window and not after `as_of`, both ends included."""
    end = as_timestamp(as_of)
    start = end - seconds_interval(window_seconds)
    held = by_day(events, "event_date", start, end) if time == "event_time" else events
    return held.filter((F.col(time) >= start) & (F.col(time) <= end))


def in_windows(
    events: DataFrame, as_of, windows: Sequence[int] = WINDOW_SECONDS, time: str = "event_time"
) -> DataFrame:
    """Every event once per trailing window that holds it, in the column `window_size`.

    Windows are nested, so only the events of the short windows are repeated: with an hour, a day and
    a week, even load makes about 1.15 rows of one event.
    """
    windows = sorted(windows)
    age = F.unix_micros(as_timestamp(as_of)) - F.unix_micros(F.col(time))
    held = F.array(*[F.lit(w).cast("bigint") for w in windows])
    smaller = sum(((age > F.lit(w * 1_000_000)).cast("int") for w in windows), F.lit(0))
    recent = window_events(events, as_of, windows[-1], time)
    return recent.withColumn("window_size", F.explode(F.slice(held, smaller + 1, F.lit(len(windows)))))


def multi_window(events: DataFrame, as_of, windows: Sequence[int] = WINDOW_SECONDS) -> DataFrame:
    """Event count and time span per entity and window."""
    return (
        in_windows(events, as_of, windows)
        .groupBy("entity_id", "window_size")
        .agg(
            F.count("*").alias("event_count"),
            F.min("event_time").alias("first_event"),
            F.max("event_time").alias("last_event"),
        )
    )


def evict_old_events(events: DataFrame, as_of, max_age_seconds: int = max(WINDOW_SECONDS)) -> DataFrame:
    """Events that stay under the retention rule."""
    oldest = as_timestamp(as_of) - seconds_interval(max_age_seconds)
    return by_day(events, "event_date", oldest, None).filter(F.col("event_time") >= oldest)


def eviction_report(events: DataFrame, as_of, max_age_seconds: int = max(WINDOW_SECONDS)) -> DataFrame:
    """How many events the retention rule removes and keeps, and how many entities become empty."""
    old = F.col("event_time") < as_timestamp(as_of) - seconds_interval(max_age_seconds)
    per_entity = events.groupBy("entity_id").agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))
    return per_entity.agg(
        F.coalesce(F.sum("removed"), F.lit(0)).alias("removed_events"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("kept_events"),
        F.count_if(F.col("kept") == 0).alias("removed_entities"),
    )


def engine_statistics(
    events: DataFrame, windows: Sequence[int], extractor_count: int, feature_count: int
) -> DataFrame:
    per_entity = events.groupBy("entity_id").agg(F.count("*").alias("n"))
    return per_entity.agg(
        F.count("*").alias("entity_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.lit(",".join(str(w) for w in windows)).alias("window_sizes"),
        F.lit(extractor_count).cast("bigint").alias("extractor_count"),
        F.lit(feature_count).cast("bigint").alias("total_features"),
    )
