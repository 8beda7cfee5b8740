"""Detection rules for four attack shapes.

A user under attack can be the busiest of all, so no rule gathers the events of one user: they count
per second first, or compare rows and carry values inside chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchmere.functions.columns import haversine_km
from watchmere.operators.features import IMPOSSIBLE_KMH, MIN_HOURS
from watchmere.operators.sequence import with_latest, with_previous

# Durations of the attacks in seconds.
BRUTE_FORCE_SECONDS = 300
EXFILTRATION_SECONDS = 600
ESCALATION_SECONDS = 120

BRUTE_FORCE_FAILURES = 3
ESCALATION_EVENTS = 2


def _second(time: str = "event_time"):
    return F.floor(F.unix_micros(time) / 1_000_000)


def detect_brute_force(
    events: DataFrame, failures: int = BRUTE_FORCE_FAILURES, seconds: int = BRUTE_FORCE_SECONDS
) -> DataFrame:
    """Seconds at which an entity has at least so many authentication failures in the seconds before.

    Failures are counted per entity and second; a stretch of `seconds` then holds at most as many
    rows, and each stretch is summed together with a copy of the one before it.
    """
    counts = (
        events.filter(F.col("event_type") == "authentication_failure")
        .groupBy("entity_id", _second().alias("second"))
        .agg(F.count("*").alias("n"))
    )
    stretch = F.floor(F.col("second") / seconds)
    copies = counts.select(
        "*", F.inline(F.array(F.struct(stretch.alias("stretch"), F.lit(True).alias("own")),
                              F.struct((stretch + 1).alias("stretch"), F.lit(False).alias("own"))))
    )
    trailing = Window.partitionBy("entity_id", "stretch").orderBy("second").rangeBetween(1 - seconds, 0)
    return (
        copies.withColumn("failures", F.sum("n").over(trailing))
        .filter(F.col("own") & (F.col("failures") >= failures))
        .select("entity_id", F.timestamp_seconds("second").alias("detected_at"), "failures")
    )


def brute_force_sessions(
    events: DataFrame, failures: int = BRUTE_FORCE_FAILURES, seconds: int = BRUTE_FORCE_SECONDS
) -> DataFrame:
    """Sessions of an entity's failed logins, each within so many seconds of the one before, with enough failures.

    A session ends so many seconds after its last failure. Rows of one entity are merged before the shuffle, so an
    attacked one sends a row for each session and task. Works on streams with a watermark as well.
    """
    session = F.session_window("event_time", f"{seconds} seconds")
    return (
        events.filter(F.col("event_type") == "authentication_failure")
        .groupBy("entity_id", session.alias("w"))
        .agg(F.count("*").alias("failures"))
        .filter(F.col("failures") >= failures)
        .select("entity_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "failures")
    )


def detect_impossible_travel(events: DataFrame, kmh: float = IMPOSSIBLE_KMH) -> DataFrame:
    """Consecutive located logins of an entity that are too far apart for the time between them."""
    logins = events.filter((F.col("event_type") == "login") & F.col("location").isNotNull())
    slim = logins.select("entity_id", "event_id", "event_time", "city", "location.lat", "location.lon")
    point = F.struct("event_id", "event_time", "city", "lat", "lon")

    def distance(at, before):
        return haversine_km(before["lat"], before["lon"], at["lat"], at["lon"])

    def speed(at, before):
        hours = (F.unix_micros(at["event_time"]) - F.unix_micros(before["event_time"])) / 3.6e9
        return distance(at, before) / F.greatest(hours, F.lit(MIN_HOURS))

    moved = with_previous(
        slim, ["entity_id"], ["event_time", "event_id"], point, "before", keep=lambda at, before: speed(at, before) > kmh
    )
    here = {name: F.col(name) for name in ("lat", "lon", "event_time")}
    return moved.select(
        "entity_id",
        "event_id",
        "event_time",
        F.col("before.event_id").alias("previous_event_id"),
        F.col("before.city").alias("from_city"),
        F.col("city").alias("to_city"),
        distance(here, F.col("before")).alias("distance_km"),
        speed(here, F.col("before")).alias("speed_kmh"),
    )


def detect_exfiltration(events: DataFrame, seconds: int = EXFILTRATION_SECONDS) -> DataFrame:
    """Exfiltration events that follow a file access of the same entity within so many seconds.

    An as-of join in one pass: the last access is carried forward over the entity's accesses and exfiltrations in
    order of time, accesses first where times are equal. Any span costs the same, and nothing is gathered.
    """
    at = F.unix_micros("event_time")
    access = F.col("event_type") == "file_access"
    slim = events.filter(
        F.col("event_type").isin("file_access", "data_exfiltration")
        & F.col("event_time").isNotNull()
        & F.col("entity_id").isNotNull()
    ).select("entity_id", "event_id", "event_time", at.alias("at"), F.when(access, 0).otherwise(1).alias("sent"))

    def follows(accessed):
        return (F.col("sent") == 1) & (F.col("at") - accessed <= seconds * 1_000_000)

    value = F.when(F.col("sent") == 0, F.col("at"))
    found = with_latest(slim, ["entity_id"], ["at", "sent", "event_id"], value, "accessed", keep=follows)
    return found.select("entity_id", "event_id", "event_time")


def detect_privilege_escalation(
    events: DataFrame, count: int = ESCALATION_EVENTS, seconds: int = ESCALATION_SECONDS
) -> DataFrame:
    """Tumbling windows in which an entity has at least so many privilege escalations."""
    return (
        events.filter(F.col("event_type") == "privilege_escalation")
        .groupBy("entity_id", F.window("event_time", f"{seconds} seconds").alias("w"))
        .agg(F.count("*").alias("escalations"))
        .filter(F.col("escalations") >= count)
        .select("entity_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "escalations")
    )
