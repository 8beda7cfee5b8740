"""The alert table: creating, listing, changing and counting alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchmere.operators.ensemble import ranked_list
from watchmere.operators.store import tie_breaker
from watchmere.schemas import ALERT_STATUSES, ENTITY_TYPES, ATTACK_TYPES, SEVERITIES, as_timestamp

MAX_PAGE_SIZE = 100
HIGH_ABOVE = 0.5
DEFAULT_CONFIDENCE = 0.5
REASONS = 10
RELATED = 10


def dashboard_stats(alerts: DataFrame, as_of) -> DataFrame:
    """All counters of the dashboard from one aggregate."""
    status, severity = F.col("status"), F.col("severity")
    today = F.col("resolved_at") >= F.date_trunc("day", as_timestamp(as_of))
    return alerts.agg(
        F.count("*").alias("total_alerts"),
        *[F.count_if(severity == s).alias(f"{s}_alerts") for s in SEVERITIES if s != "info"],
        F.count_if(status.isin("new", "in_progress")).alias("open_alerts"),
        F.count_if(today & (status == "resolved")).alias("resolved_today"),
        F.count_if(today & (status == "false_positive")).alias("false_positives_today"),
    )


def filter_alerts(
    alerts: DataFrame, severity: str | None = None, status: str | None = None, attack_type: str | None = None
) -> DataFrame:
    wanted = {"severity": (severity, SEVERITIES), "status": (status, ALERT_STATUSES), "attack_type": (attack_type, ATTACK_TYPES)}
    for name, (value, allowed) in wanted.items():
        if value is not None:
            if value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
            alerts = alerts.filter(F.col(name) == value)
    return alerts


def page_alerts(alerts: DataFrame, page: int = 1, page_size: int = 20, after: tuple | None = None) -> DataFrame:
    """One page, newest first, with the number of alerts before paging on every row.

    A page past the last one is a single row of nulls and the number. `after` takes (event_time,
    alert_id) of the last row seen and makes the page start behind it, so that no earlier row is
    gathered; paging by number reads on to the page and is for the first few.
    """
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError("page starts at 1 and page_size lies between 1 and 100")
    rest = alerts
    if after is not None:
        seen = as_timestamp(after[0])
        same = (F.col("event_time") == seen) & (F.col("alert_id") > after[1])
        rest = alerts.filter((F.col("event_time") < seen) | same)
    rows = rest.orderBy(F.desc("event_time"), "alert_id").offset((page - 1) * page_size).limit(page_size)
    total = alerts.agg(F.count("*").alias("total")).select("total", F.lit(1).alias("_one"))
    # Both sides are bounded by construction: one row and one page. An equi-join on a constant attaches them.
    joined = total.join(rows.withColumn("_one", F.lit(1)), "_one", "left")
    return joined.select(*alerts.columns, "total").orderBy(F.desc("event_time"), "alert_id")


def lookup_alerts(alerts: DataFrame, requested: DataFrame) -> DataFrame:
    """Alerts whose ids are requested."""
    return alerts.join(requested.select("alert_id"), "alert_id", "left_semi")


def missing_alerts(alerts: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ids that no alert has."""
    return requested.select("alert_id").distinct().join(alerts.select("alert_id"), "alert_id", "left_anti")


def upsert_alerts(alerts: DataFrame, changes: DataFrame, version: str = "written_at") -> DataFrame:
    """The newest row per alert id of the stored rows and the changes; all have a `version` column."""
    both = alerts.unionByName(changes, allowMissingColumns=True)
    newest = Window.partitionBy("alert_id").orderBy(F.desc(version), tie_breaker(both))
    return both.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def list_alerts_by_id(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("alert_id")


def alert_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("alert_count"))


def assign_alerts(alerts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Give known alerts to analysts: `assignments` has (alert_id, analyst_id), one row per id."""
    given = assignments.select("alert_id", F.col("analyst_id").alias("_analyst"))
    hit = F.col("_analyst").isNotNull()
    before = F.col("assigned_to") if "assigned_to" in alerts.columns else F.lit(None).cast("string")
    return (
        alerts.join(given, "alert_id", "left")
        .withColumn("assigned_to", F.coalesce("_analyst", before))
        .withColumn("status", F.when(hit, "in_progress").otherwise(F.col("status")))
        .drop("_analyst")
    )


def resolve_alerts(alerts: DataFrame, resolutions: DataFrame, as_of) -> DataFrame:
    """Close known alerts: `resolutions` has (alert_id, resolution_notes) and may have `status`."""
    outcome = F.col("status") if "status" in resolutions.columns else F.lit("resolved")
    given = resolutions.select(
        "alert_id", F.col("resolution_notes").alias("_notes"), outcome.alias("_status"), F.lit(True).alias("_hit")
    )
    hit = F.col("_hit").isNotNull()
    before = F.col("resolution_notes") if "resolution_notes" in alerts.columns else F.lit(None).cast("string")
    return (
        alerts.join(given, "alert_id", "left")
        .withColumn("status", F.when(hit, F.col("_status")).otherwise(F.col("status")))
        .withColumn("resolved_at", F.when(hit, as_timestamp(as_of)).otherwise(F.col("resolved_at")))
        .withColumn("resolution_notes", F.when(hit, F.col("_notes")).otherwise(before))
        .drop("_notes", "_status", "_hit")
    )


def delete_alerts(alerts: DataFrame, doomed: DataFrame) -> DataFrame:
    return alerts.join(doomed.select("alert_id"), "alert_id", "left_anti")


def _reasons(attributions: DataFrame) -> DataFrame:
    """(entity_id, _reasons): the largest attributions of each entity as a map."""
    top = ranked_list(attributions.select("entity_id", "feature", "score"), REASONS, "entity_id")
    entries = F.transform("top", lambda x: F.struct(x["feature"], x["score"]))
    return top.select("entity_id", F.map_from_entries(entries).alias("_reasons"))


def _open_alerts(alerts: DataFrame, as_of) -> DataFrame:
    """(entity_id, _related): ids of each entity's newest open alerts, the newest first.

    Spark keeps RELATED rows per entity on the sending side of the shuffle.
    """
    order = Window.partitionBy("entity_id").orderBy(F.desc("event_time"), "alert_id")
    held = alerts.filter(F.col("status").isin(*ALERT_STATUSES[:2]) & (F.col("event_time") <= as_timestamp(as_of)))
    newest = held.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= RELATED)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "alert_id")))
    return newest.groupBy("entity_id").agg(F.transform(listed, lambda x: x["alert_id"]).alias("_related"))


def create_alerts(
    scored: DataFrame,
    as_of,
    narratives: DataFrame | None = None,
    attributions: DataFrame | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """An alert per scored entity (entity_id, final_score), its text from (entity_id, narrative).

    Its reasons are the entity's largest REASONS `attributions` (entity_id, feature, score), its related alerts the
    entity's newest RELATED open ones among the `earlier` alerts. All fields of an alert are there, so that every other
    operator on alerts takes the result. The entity's type is the prefix of its id.
    """
    if attributions is not None:
        scored = scored.join(_reasons(attributions), "entity_id", "left")
    if earlier is not None:
        scored = scored.join(_open_alerts(earlier, as_of), "entity_id", "left")
    reasons = F.col("_reasons") if attributions is not None else F.lit(None).cast("map<string,double>")
    related = F.col("_related") if earlier is not None else F.lit(None)
    kind = F.substring_index("entity_id", ":", 1)
    high = F.col("final_score") > HIGH_ABOVE
    if narratives is not None:
        scored = scored.join(narratives.select("entity_id", "narrative"), "entity_id", "left")
    text = F.col("narrative") if "narrative" in scored.columns else F.lit(None).cast("string")
    severity = F.when(high, "high").otherwise("low")
    stamp = F.unix_micros(as_timestamp(as_of)).cast("string")
    return scored.select(
        F.sha2(F.concat_ws("|", "entity_id", stamp), 256).alias("alert_id"),
        as_timestamp(as_of).alias("event_time"),
        "entity_id",
        F.when(F.col("entity_id").contains(":") & kind.isin(*ENTITY_TYPES), kind).otherwise("user").alias("entity_type"),
        severity.alias("severity"),
        F.lit("unknown").alias("attack_type"),
        F.lit(DEFAULT_CONFIDENCE).alias("confidence"),
        F.col("final_score").alias("anomaly_score"),
        F.lit("new").alias("status"),
        F.concat(F.lit("Anomalous behavior of "), "entity_id").alias("title"),
        F.coalesce(text, F.lit("")).alias("description"),
        F.array(F.col("entity_id").cast("string")).alias("affected_assets"),
        F.coalesce(related, F.array()).cast("array<string>").alias("related_alerts"),
        reasons.alias("feature_importance"),
        text.alias("explanation"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("resolution_notes"),
        F.lit(None).cast("double").alias("feedback_score"),
    )


def entity_risk(scores: DataFrame) -> DataFrame:
    """The latest final score of each entity, from (entity_id, final_score, scored_at)."""
    latest = F.max(F.struct("scored_at", "final_score"))
    return (
        scores.groupBy("entity_id")
        .agg(latest.alias("_last"))
        .select(
            "entity_id",
            F.col("_last.final_score").alias("risk_score"),
            F.col("_last.scored_at").alias("last_assessment"),
        )
    )


def system_metrics(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Events processed, alerts, and event throughput over the span of the event times."""
    seen = events.agg(
        F.count("*").alias("events_processed"),
        F.min("event_time").alias("_from"),
        F.max("event_time").alias("_to"),
        F.lit(1).alias("_one"),
    )
    raised = alerts.agg(F.count("*").alias("alerts_generated"), F.lit(1).alias("_one"))
    span = (F.unix_micros("_to") - F.unix_micros("_from")) / 1e6
    return (
        seen.join(F.broadcast(raised), "_one")
        .select("events_processed", "alerts_generated", F.try_divide("events_processed", span).alias("throughput_events_per_sec"))
    )
