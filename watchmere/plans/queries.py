"""Named queries: each reads the given tables and applies one operator to all of them."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchmere.operators import alerts as A
from watchmere.operators import ensemble as E
from watchmere.operators import estimators as M
from watchmere.operators import explain as X
from watchmere.operators import features as FE
from watchmere.operators import feedback as B
from watchmere.operators import graph as G
from watchmere.operators import normalize as N
from watchmere.operators import partials as H
from watchmere.operators import rules as R
from watchmere.operators import scaling as D
from watchmere.operators import store as S
from watchmere.operators import tree_values as V
from watchmere.operators import windows as W
from watchmere.operators.alert_pages import AlertPages
from watchmere.operators.snapshots import SnapshotTable
from watchmere.operators.attribution import attribution_lime as lime_values
from watchmere.operators.attribution import attribution_shap as shapley_values
from watchmere.operators.attribution import background_rows
from watchmere.operators.autoencoder import train_autoencoder
from watchmere.operators.boosted import train_boosted_trees
from watchmere.operators.forest import train_forest
from watchmere.operators.retraining import Retraining
from watchmere.plans.detection import Detectors, train_detectors
from watchmere.plans.detection import Pipeline as AlertPipeline
from watchmere.schemas import WINDOW_SECONDS
from watchmere.session import cut_lineage, prepare, scratch_path
from watchmere.sources import logs
from watchmere.sources import projections as P
from watchmere.sources.tables import stream_table
from watchmere.streaming import jobs as J
from watchmere.streaming import retention as K

AS_OF = "2024-01-31 00:00:00"
ALERTS_AS_OF = "2001-07-31 12:00:00"
RETRAIN_AT = "2024-01-16 00:00:00"
HALF_TIME = "2024-01-30 12:00:00"
PATH_SOURCE = "user:u1"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in different orders agree; no negative zeros."""
    return df.select(
        *[
            (F.round(f.name, places) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, places: int = 6):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return rounded(function(prepare(spark), root), places)

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        return run

    return register


# Ingestion and normalization.

NORMALIZED = (
    "event_id",
    "event_time",
    "source_type",
    "event_type",
    "entity_id",
    "entity_type",
    "source_ip",
    "hostname",
    "username",
    "raw_message",
    "dns_query",
)


def _normalized_kind(kind: str):
    @query(f"normalize_{kind}")
    def run(spark, root):
        raw = P.raw_logs(spark, root).filter(F.col("source_type") == kind)
        return N.accepted(N.normalize(raw, (kind,))).select(*NORMALIZED)

    return run


for _kind in N.RULES:
    _normalized_kind(_kind)


@query("raw_log_source")
def raw_log_source(spark, root):
    """Raw logs written as a table and read again through the source."""
    path = scratch_path(spark, "raw_logs")
    P.raw_logs(spark, root).select("value", "source_type", "ingest_time").write.parquet(path)
    return logs.table_raw_logs(spark, path)


@query("normalized_sink")
def normalized_sink(spark, root):
    events = N.accepted(N.normalize(P.raw_logs(spark, root)))
    return N.keyed_json(events)


@query("route_by_source")
def route_by_source(spark, root):
    routed = N.normalize(P.raw_logs(spark, root))
    known = F.col("source_type").isin(*N.RULES)
    return routed.groupBy("source_type", F.when(known, "routed").otherwise("unknown").alias("route")).agg(
        F.count("*").alias("records")
    )


@query("process_raw_logs")
def process_raw_logs(spark, root):
    return N.accepted(N.normalize(P.raw_logs(spark, root))).select(*NORMALIZED)


@query("consume_events")
def consume_events(spark, root):
    """The source type is read from the record itself."""
    raw = P.raw_logs(spark, root).select("event_id", "value", "ingest_time")
    return N.accepted(N.normalize(raw)).select(*NORMALIZED)


@query("reject_sink")
def reject_sink(spark, root):
    return N.reject_counts(N.normalize(P.raw_logs(spark, root)))


@query("normalized_schema_check")
def normalized_schema_check(spark, root):
    return N.schema_violations(N.normalize(P.raw_logs(spark, root))).select("event_id", "reject_reason")


@query("event_defaults")
def event_defaults(spark, root):
    raw = P.raw_logs(spark, root).select("value", "source_type", "ingest_time")
    return N.accepted(N.normalize(raw)).select("event_id", "event_time", "source_type")


# Windows and features.


@query("window_events")
def window_events(spark, root):
    return W.window_events(P.sec_events(spark, root), AS_OF, 86400).select("entity_id", "event_id", "event_time")


@query("multi_window")
def multi_window(spark, root):
    return W.multi_window(P.sec_events(spark, root), AS_OF)


@query("extract_features")
def extract_features(spark, root):
    return FE.extract_features(P.sec_events(spark, root), AS_OF)


@query("feature_vector")
def feature_vector(spark, root):
    vectors = FE.feature_vectors(FE.extract_features(P.sec_events(spark, root), AS_OF), AS_OF)
    return vectors.select(
        "entity_id",
        "timestamp",
        "window_size",
        "is_valid",
        F.size("features").cast("bigint").alias("feature_count"),
        *[F.col("features")[name].alias(name) for name in FE.FEATURE_NAMES],
    )


@query("flattened_features")
def flattened_features(spark, root):
    return FE.flattened_features(P.sec_events(spark, root), AS_OF)


@query("zero_fill")
def zero_fill(spark, root):
    """Entities without any event in a window have rows of zeros."""
    return FE.extract_features(P.sec_events(spark, root), AS_OF).filter(F.col("events_per_hour") == 0)


for _family in FE.FAMILIES:

    def _features(spark, root, family=_family):
        return FE.extract_features(P.sec_events(spark, root), AS_OF, families=[family])

    query(f"features_{_family}")(_features)


def _session_features(part, window):
    span = part("last_second") - part("first_second")
    return {"longest_command": part("longest_command"), "active_share": span / window}


@query("features_own_family")
def features_own_family(spark, root):
    """A family that brings aggregates of its own, beside one that does not."""
    second = F.unix_seconds("event_time")
    own = FE.Family(
        ("longest_command", "active_share"),
        _session_features,
        aggregates={
            "longest_command": F.max(F.length("command_line")),
            "first_second": F.min(second),
            "last_second": F.max(second),
        },
    )
    return FE.extract_features(P.sec_events(spark, root), AS_OF, families=["entropy", own])


@query("engine_statistics")
def engine_statistics(spark, root):
    return W.engine_statistics(P.sec_events(spark, root), WINDOW_SECONDS, len(FE.FAMILIES), len(FE.FEATURE_NAMES))


@query("evict_old_events")
def evict_old_events(spark, root):
    return W.eviction_report(P.sec_events(spark, root), AS_OF)


# Feature store.

STORED = ("login_count", "unique_hosts", "unique_ips")
VECTOR_KEYS = ("entity_id", "window_size")


def _vector_log(spark, root):
    return S.stamped(P.feature_log(spark, root))


@query("save_feature_vectors")
def save_feature_vectors(spark, root):
    path = scratch_path(spark, "feature_vectors")
    S.append_rows(_vector_log(spark, root), path)
    return spark.read.parquet(path).drop("written_date")


@query("latest_feature_vectors")
def latest_feature_vectors(spark, root):
    return S.latest_feature_vectors(_vector_log(spark, root), AS_OF)


def _snapshot_table(spark, root) -> SnapshotTable:
    """The vector log, a quarter of a month at a time, compacted after all but the last."""
    table = SnapshotTable(spark, scratch_path(spark, "vector_table"), VECTOR_KEYS, buckets=8)
    log = _vector_log(spark, root).withColumn("_day", F.to_date("written_at"))
    for first, last in zip(("2023-12-31", *COMPACTED), (*COMPACTED, "2024-01-31")):
        table.append(log.filter((F.col("_day") > first) & (F.col("_day") <= last)).drop("_day"))
        if last in COMPACTED:
            table.compact(last)
    return table


COMPACTED = ("2024-01-10", "2024-01-20", "2024-01-29")


@query("snapshot_feature_vectors")
def snapshot_feature_vectors(spark, root):
    """As latest_feature_vectors, from the last snapshot and the day after it."""
    return _snapshot_table(spark, root).latest(AS_OF)


@query("lookup_feature_vectors")
def lookup_feature_vectors(spark, root):
    """Requests: engineers' day vectors, everything of the sales people."""
    people = P.entities(spark, root).filter(F.col("department").isin("Engineering", "Sales"))
    window = F.when(F.col("department") == "Engineering", F.lit(86400))
    return S.lookup_feature_vectors(
        _vector_log(spark, root), people.select("entity_id", window.alias("window_size")), AS_OF
    )


def _behavior_log(spark, root):
    log = P.feature_log(spark, root).filter(F.col("window_size") == 604800).drop("window_size")
    return S.stamped(
        log.withColumns({"entity_type": F.lit("user"), "confidence": F.lit(0.5), "baseline_version": F.lit(1)})
    )


@query("save_entity_behavior")
def save_entity_behavior(spark, root):
    path = scratch_path(spark, "behavior")
    S.append_rows(_behavior_log(spark, root), path)
    return spark.read.parquet(path).drop("written_date")


@query("latest_entity_behavior")
def latest_entity_behavior(spark, root):
    return S.latest_entity_behavior(_behavior_log(spark, root), AS_OF)


@query("entity_behavior")
def entity_behavior(spark, root):
    """The behaviour of every known entity, empty where none is stored."""
    stored = S.latest_entity_behavior(_behavior_log(spark, root), AS_OF)
    known = P.entities(spark, root).select("entity_id")
    return known.join(stored.select("entity_id", *STORED), "entity_id", "left").select(
        "entity_id", *[F.coalesce(name, F.lit(0.0)).alias(name) for name in STORED]
    )


@query("store_entity_ids")
def store_entity_ids(spark, root):
    return S.store_entity_ids(_vector_log(spark, root), AS_OF)


@query("save_baseline_features")
def save_baseline_features(spark, root):
    vectors = S.latest_feature_vectors(_vector_log(spark, root), AS_OF).select("entity_id", "window_size", *STORED)
    return S.baseline_features(vectors, AS_OF)


@query("population_baseline")
def population_baseline(spark, root):
    vectors = S.latest(S.stamped(P.feature_log(spark, root), ttl_seconds=7 * 86400), VECTOR_KEYS, AS_OF)
    return S.population_baseline(vectors, P.entities(spark, root), list(STORED))


@query("cold_start_features")
def cold_start_features(spark, root):
    """Entities without a live vector of the day window take their department's mean in that window."""
    people = P.entities(spark, root)
    recent = S.latest(S.stamped(P.feature_log(spark, root), ttl_seconds=43200), VECTOR_KEYS, AS_OF)
    week = S.latest(S.stamped(P.feature_log(spark, root), ttl_seconds=7 * 86400), VECTOR_KEYS, AS_OF)
    return S.cold_start_features(people, recent, S.population_baseline(week, people, list(STORED)), list(STORED), 86400)


@query("save_predictions")
def save_predictions(spark, root):
    """The last prediction per entity and model."""
    scores = P.model_scores(spark, root, "event_time")
    log = S.stamped(scores.withColumnRenamed("event_time", "written_at"))
    return S.latest_predictions(log, AS_OF).select("entity_id", "model_name", "anomaly_score", "written_at", "expires_at")


@query("delete_entities")
def delete_entities(spark, root):
    """The HR people are deleted from the vectors."""
    gone = P.entities(spark, root).filter(F.col("department") == "HR")
    return S.delete_entities(_vector_log(spark, root), gone).select("entity_id", "window_size", "written_at")


# Detectors and explanations on given scores.


def _matrix_names():
    return P.feature_matrix_names()


@query("standard_scale")
def standard_scale(spark, root):
    rows = P.feature_matrix(spark, root)
    scaler = D.fit_scaler(rows, len(_matrix_names()))
    return scaler.transform(rows).select("row_key", F.posexplode("features").alias("position", "value"))


@query("iforest_importance")
def iforest_importance(spark, root):
    return D.mean_importance(P.feature_matrix(spark, root), _matrix_names())


def _predictions(spark, root):
    return E.model_predictions(E.with_labels(P.model_scores(spark, root)))


@query("ensemble_score")
def ensemble_score(spark, root):
    return E.ensemble_score(_predictions(spark, root))


# Means of a few fixed values often end in a five at an early place.
@query("model_predictions", places=11)
def model_predictions(spark, root):
    return _predictions(spark, root)


@query("ensemble_score_batch")
def ensemble_score_batch(spark, root):
    return E.batch_ensemble_score(E.with_labels(P.model_scores(spark, root)))


@query("model_explanation")
def model_explanation(spark, root):
    told = E.model_explanations(_predictions(spark, root), P.attributions(spark, root))
    return told.select("entity_id", "model_name", "explanation")


@query("aggregated_importance")
def aggregated_importance(spark, root):
    return E.aggregated_importance(P.attributions(spark, root), 3)


@query("attribution_abs")
def attribution_abs(spark, root):
    return X.attribution_abs(P.feature_matrix(spark, root), _matrix_names())


@query("attribution_abs_08")
def attribution_abs_08(spark, root):
    return X.attribution_abs(P.feature_matrix(spark, root), _matrix_names(), X.LIME_FALLBACK_FACTOR)


@query("top_contributors")
def top_contributors(spark, root):
    return X.top_contributors(P.attributions(spark, root))


@query("alert_narrative")
def alert_narrative(spark, root):
    return X.alert_narratives(P.attributions(spark, root), P.entities(spark, root))


@query("alert_explanation")
def alert_explanation(spark, root):
    return X.alert_explanations(E.ensemble_score(_predictions(spark, root)), P.attributions(spark, root))


# Entity graph.


def _observations(spark, root):
    events = P.sec_events(spark, root)
    return G.edge_observations(events).unionByName(G.membership_observations(events))


def _graph(spark, root):
    seen = _observations(spark, root)
    nodes = G.graph_nodes(G.observed_nodes(seen))
    return nodes, G.graph_edges(seen)


@query("graph_nodes")
def graph_nodes(spark, root):
    return _graph(spark, root)[0]


@query("graph_metadata")
def graph_metadata(spark, root):
    """Users with the department and the kind of their last event as metadata."""
    about = F.create_map(F.lit("department"), "department", F.lit("last_event"), "event_type")
    seen = P.sec_events(spark, root).select(
        "entity_id",
        F.lit("user").alias("entity_type"),
        F.col("username").alias("name"),
        F.lit(0.0).alias("risk_score"),
        "event_time",
        about.alias("metadata"),
    )
    return G.graph_nodes(seen).select("entity_id", "name", "last_seen", "metadata")


@query("graph_edges")
def graph_edges(spark, root):
    """Only edges between known nodes: departments are not known here."""
    seen = _observations(spark, root)
    nodes = G.graph_nodes(G.observed_nodes(seen)).filter(F.col("entity_type") != "dept")
    return G.graph_edges(seen, nodes)


@query("record_access")
def record_access(spark, root):
    return G.graph_edges(G.record_access(P.sec_events(spark, root), "entity_id", "hostname", "event_type"))


@query("node_degree")
def node_degree(spark, root):
    return G.node_degree(*_graph(spark, root))


@query("degree_centrality")
def degree_centrality(spark, root):
    return G.degree_centrality(*_graph(spark, root))


@query("neighbors_k_hop")
def neighbors_k_hop(spark, root):
    """Direct neighbours of every node."""
    return G.neighbors_k_hop(*_graph(spark, root), limit=G.NEIGHBOR_LIMIT)


@query("neighbors_from_entity")
def neighbors_from_entity(spark, root):
    """Everything within three steps of one entity."""
    nodes, edges = _graph(spark, root)
    seed = spark.createDataFrame([(PATH_SOURCE,)], "entity_id STRING")
    return G.neighbors_k_hop(nodes, edges, depth=3, seeds=seed, limit=None)


@query("shortest_path")
def shortest_path(spark, root):
    """Paths from one entity to all that it reaches."""
    _, edges = _graph(spark, root)
    start = spark.createDataFrame([(PATH_SOURCE,)], "source STRING")
    paths = G.shortest_paths(edges, start)
    return paths.select("source", "target", F.concat_ws(" > ", "path").alias("path"), "length")


@query("shortest_path_between")
def shortest_path_between(spark, root):
    """Paths between each entity and the first one of its department."""
    _, edges = _graph(spark, root)
    members = P.entities(spark, root).select("entity_id", "department")
    first = members.groupBy("department").agg(F.min("entity_id").alias("source"))
    pairs = members.join(first, "department").select("source", F.col("entity_id").alias("target"))
    paths = G.paths_between(edges, pairs)
    return paths.select("source", "target", F.concat_ws(" > ", "path").alias("path"), "length")


@query("lateral_movement")
def lateral_movement(spark, root):
    return G.lateral_movement(*_graph(spark, root))


@query("clustering_coefficient")
def clustering_coefficient(spark, root):
    return G.clustering_coefficient(*_graph(spark, root)).select("entity_id", "degree", "triangles", "coefficient")


@query("update_risk")
def update_risk(spark, root):
    nodes, _ = _graph(spark, root)
    scores = E.ensemble_score(_predictions(spark, root)).select(
        "entity_id", F.col("final_score").alias("risk_score"), F.lit(AS_OF).cast("timestamp").alias("updated_at")
    )
    return G.update_risk(nodes, scores)


@query("graph_statistics")
def graph_statistics(spark, root):
    return G.graph_statistics(*_graph(spark, root))


# Alerts.


def _reviews(spark, root):
    """One row per reviewed alert: its newest feedback as an analyst's assignment or resolution."""
    newest = F.max(F.struct("event_time", "feedback_id", "confidence", "is_true_positive"))
    return (
        P.feedback(spark, root)
        .groupBy("alert_id")
        .agg(newest.alias("_last"))
        .select(
            "alert_id",
            F.concat(F.lit("analyst-"), F.col("_last.confidence").cast("string")).alias("analyst_id"),
            F.col("_last.feedback_id").alias("resolution_notes"),
            F.col("_last.is_true_positive").alias("is_true_positive"),
        )
    )


@query("dashboard_stats")
def dashboard_stats(spark, root):
    return A.dashboard_stats(P.alerts(spark, root), ALERTS_AS_OF)


@query("filter_alerts")
def filter_alerts(spark, root):
    return A.filter_alerts(P.alerts(spark, root), severity="critical", status="new", attack_type="brute_force")


@query("page_alerts")
def page_alerts(spark, root):
    return A.page_alerts(P.alerts(spark, root), page=3, page_size=20).select("alert_id", "event_time", "severity", "total")


def _alert_pages(spark, root):
    """All alerts in parts, a sixteenth of them each."""
    alerts = P.alerts(spark, root)
    return AlertPages.write(alerts, scratch_path(spark, "alert_pages"), max(1, alerts.count() // 16))


@query("page_alerts_deep")
def page_alerts_deep(spark, root):
    """The page in the middle of all alerts, and the one in the middle of the new ones, by the index."""
    pages = _alert_pages(spark, root)
    shown = []
    for status in (None, "new"):
        total = pages.page(1, 1, status=status).select("total").first()
        middle = (total["total"] if total else 0) // 40 + 1
        page = pages.page(middle, 20, status=status)
        shown.append(page.select(F.lit(status or "any").alias("listed"), "alert_id", "event_time", "severity", "total"))
    return shown[0].unionByName(shown[1])


@query("lookup_alerts")
def lookup_alerts(spark, root):
    return A.lookup_alerts(P.alerts(spark, root), P.feedback(spark, root)).select("alert_id", "severity", "status")


@query("missing_alerts")
def missing_alerts(spark, root):
    """Ids asked for once per event, a quarter of which no alert has."""
    asked = P.sec_events(spark, root).select(F.concat(F.lit("al-"), (F.col("eid") * 2).cast("string")).alias("alert_id"))
    return A.missing_alerts(P.alerts(spark, root), asked)


@query("upsert_alerts")
def upsert_alerts(spark, root):
    """Alerts in progress are written again, as resolved."""
    stored = P.alerts(spark, root).select("alert_id", "severity", "status", F.col("event_time").alias("written_at"))
    changes = stored.filter(F.col("status") == "in_progress").select(
        "alert_id", "severity", F.lit("resolved").alias("status"), F.lit(AS_OF).cast("timestamp").alias("written_at")
    )
    return A.upsert_alerts(stored, changes)


@query("list_alerts_by_id")
def list_alerts_by_id(spark, root):
    return A.list_alerts_by_id(P.alerts(spark, root)).select("alert_id", "entity_id", "severity", "status")


@query("alert_count")
def alert_count(spark, root):
    return A.alert_count(P.alerts(spark, root))


@query("assign_alerts")
def assign_alerts(spark, root):
    done = A.assign_alerts(P.alerts(spark, root), _reviews(spark, root))
    return done.select("alert_id", "status", F.coalesce("assigned_to", F.lit("")).alias("assigned_to"))


@query("resolve_alerts")
def resolve_alerts(spark, root):
    reviewed = _reviews(spark, root).filter("is_true_positive")
    done = A.resolve_alerts(P.alerts(spark, root), reviewed, AS_OF)
    return done.select("alert_id", "status", "resolved_at", F.coalesce("resolution_notes", F.lit("")).alias("notes"))


@query("delete_alerts")
def delete_alerts(spark, root):
    return A.delete_alerts(P.alerts(spark, root), P.feedback(spark, root)).select("alert_id")


@query("create_alerts")
def create_alerts(spark, root):
    return plain_alerts(_new_alerts(spark, root))


def _new_alerts(spark, root):
    scored = E.ensemble_score(_predictions(spark, root))
    told = X.alert_narratives(P.attributions(spark, root))
    return A.create_alerts(scored, AS_OF, told)


def plain_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts with their lists and maps as text."""
    lists = {name: F.array_join(name, ",") for name in ("affected_assets", "related_alerts")}
    return alerts.withColumns({**lists, "feature_importance": F.to_json("feature_importance")})


@query("alert_lifecycle")
def alert_lifecycle(spark, root):
    """New alerts are given to analysts, the low ones are closed, and feedback decides about the rest."""
    alerts = _new_alerts(spark, root)
    high, low = alerts.filter("severity = 'high'"), alerts.filter("severity = 'low'")
    given = A.assign_alerts(alerts, high.select("alert_id", F.lit("analyst-1").alias("analyst_id")))
    closed = A.resolve_alerts(given, low.select("alert_id", F.lit("too small").alias("resolution_notes")), AS_OF)
    verdicts = high.select(
        F.concat(F.lit("fb-"), "entity_id").alias("feedback_id"),
        "alert_id",
        "event_time",
        (F.col("anomaly_score") > 0.75).alias("is_true_positive"),
        F.lit(5).alias("confidence"),
    )
    done = B.apply_disposition(closed, verdicts)
    return done.select("alert_id", "entity_type", "severity", "status", "assigned_to", "resolved_at", "resolution_notes")


@query("alert_lifecycle_stats")
def alert_lifecycle_stats(spark, root):
    """The dashboard over alerts after assignment and resolution."""
    alerts = _new_alerts(spark, root)
    low = alerts.filter("severity = 'low'")
    return A.dashboard_stats(
        A.resolve_alerts(alerts, low.select("alert_id", F.lit("too small").alias("resolution_notes")), AS_OF), AS_OF
    )


@query("entity_risk")
def entity_risk(spark, root):
    """The ensemble score of the last event of each entity."""
    scores = P.model_scores(spark, root, "event_time")
    event = ("entity_id", "event_id", F.col("event_time").alias("scored_at"))
    return A.entity_risk(scores.groupBy(*event).agg(F.avg("anomaly_score").alias("final_score")))


@query("system_metrics")
def system_metrics(spark, root):
    return A.system_metrics(P.sec_events(spark, root), P.alerts(spark, root))


# Feedback.


@query("save_feedback")
def save_feedback(spark, root):
    return B.latest_feedback(P.feedback(spark, root))


@query("feedback_history")
def feedback_history(spark, root):
    """All feedback of the alerts that are still open."""
    open_alerts = P.alerts(spark, root).filter(F.col("status").isin("new", "in_progress"))
    return B.feedback_history(P.feedback(spark, root), open_alerts).select(
        "alert_id", "feedback_id", "event_time", "is_true_positive", F.col("confidence").cast("bigint").alias("confidence")
    )


@query("retraining_data")
def retraining_data(spark, root):
    return B.retraining_data(P.feedback(spark, root)).withColumn("position", F.col("position").cast("bigint"))


@query("feedback_statistics")
def feedback_statistics(spark, root):
    return B.feedback_statistics(P.feedback(spark, root), last_retrain="2024-01-15 00:00:00")


@query("retraining_status")
def retraining_status(spark, root):
    return B.retraining_status(P.feedback(spark, root))


@query("feedback_disposition")
def feedback_disposition(spark, root):
    return B.feedback_disposition(P.feedback(spark, root))


@query("apply_disposition")
def apply_disposition(spark, root):
    return B.apply_disposition(P.alerts(spark, root), P.feedback(spark, root)).select("alert_id", "status", "resolved_at")


# Detection rules.


@query("detect_brute_force")
def detect_brute_force(spark, root):
    return R.detect_brute_force(P.sec_events(spark, root))


@query("detect_impossible_travel")
def detect_impossible_travel(spark, root):
    return R.detect_impossible_travel(P.sec_events(spark, root))


@query("detect_exfiltration")
def detect_exfiltration(spark, root):
    return R.detect_exfiltration(P.sec_events(spark, root))


@query("detect_privilege_escalation")
def detect_privilege_escalation(spark, root):
    return R.detect_privilege_escalation(P.sec_events(spark, root))


# The same rules with wider limits, under which the sparse given events show more.


@query("detect_brute_force_hour")
def detect_brute_force_hour(spark, root):
    """At least two failures in an hour, the given events being sparse."""
    return R.detect_brute_force(P.sec_events(spark, root), failures=2, seconds=3600)


@query("detect_fast_travel")
def detect_fast_travel(spark, root):
    return R.detect_impossible_travel(P.sec_events(spark, root), kmh=100.0)


@query("detect_exfiltration_month")
def detect_exfiltration_month(spark, root):
    """A span of thirty days: as cheap as one of ten minutes, as only the last access is carried."""
    return R.detect_exfiltration(P.sec_events(spark, root), seconds=30 * 86400)


@query("detect_exfiltration_day")
def detect_exfiltration_day(spark, root):
    return R.detect_exfiltration(P.sec_events(spark, root), seconds=86400)


@query("detect_privilege_escalation_day")
def detect_privilege_escalation_day(spark, root):
    return R.detect_privilege_escalation(P.sec_events(spark, root), count=2, seconds=86400)


# Trained detectors. Several queries ask about the same model; a session trains it once for each folder.

_TRAINED: dict[tuple[str, str, str], object] = {}


def _once(spark, root, name, train):
    key = (spark.sparkContext.applicationId, root, name)
    if key not in _TRAINED:
        _TRAINED[key] = train()
    return _TRAINED[key]


def _matrix(spark, root):
    return P.feature_matrix(spark, root)


def _forest(spark, root):
    return train_forest(_matrix(spark, root).filter("label = 0"), len(_matrix_names()))


@query("iforest_train")
def iforest_train(spark, root):
    """The trees of a forest as a table."""
    path = scratch_path(spark, "forest")
    _forest(spark, root).save(spark, path)
    return spark.read.parquet(f"{path}/trees")


@query("iforest_score")
def iforest_score(spark, root):
    return _forest(spark, root).transform(_matrix(spark, root)).drop("features")


@query("iforest_score_batch")
def iforest_score_batch(spark, root):
    """Scores stretched over the batch that is scored."""
    return _forest(spark, root).transform(_matrix(spark, root), normalize="batch").drop("features")


def _autoencoder(spark, root):
    return train_autoencoder(_matrix(spark, root).filter("label = 0"), len(_matrix_names()))


@query("autoencoder_train")
def autoencoder_train(spark, root):
    """The reconstruction error of every row under the trained weights."""
    return _autoencoder(spark, root).errors(_matrix(spark, root)).drop("features")


@query("autoencoder_score")
def autoencoder_score(spark, root):
    return _autoencoder(spark, root).transform(_matrix(spark, root)).drop("features")


def _boosted(spark, root):
    return _once(spark, root, "boosted", lambda: train_boosted_trees(_matrix(spark, root), _matrix_names()))


@query("boosted_trees_train")
def boosted_trees_train(spark, root):
    """Scores of a model that was trained, saved and loaded."""
    path = scratch_path(spark, "boosted")
    model = _boosted(spark, root)
    model.save(spark, path)
    return type(model).load(spark, path).transform(_matrix(spark, root)).drop("features")


@query("boosted_trees_score")
def boosted_trees_score(spark, root):
    return _boosted(spark, root).transform(_matrix(spark, root)).drop("features")


@query("boosted_trees_importance")
def boosted_trees_importance(spark, root):
    return _boosted(spark, root).importance(spark)


@query("boosted_trees_fallback")
def boosted_trees_fallback(spark, root):
    model = train_boosted_trees(_matrix(spark, root), _matrix_names(), fallback=True)
    return model.transform(_matrix(spark, root)).drop("features")


def _detectors(spark, root):
    rows = _matrix(spark, root)
    return _once(
        spark,
        root,
        "detectors",
        lambda: train_detectors(rows.filter("label = 0"), rows.filter("label = 1"), _matrix_names()),
    )


@query("ensemble_train")
def ensemble_train(spark, root):
    """All detectors trained; their scores combined per row."""
    return E.ensemble_score(E.model_predictions(_detectors(spark, root).score(_matrix(spark, root))))


@query("model_importances")
def model_importances(spark, root):
    """Per model the features it weighs, and the sum of their importances."""
    found = _detectors(spark, root).importances(_matrix(spark, root), _matrix_names())
    return found.groupBy("model_name").agg(F.countDistinct("feature").alias("features"), F.sum("score").alias("total"))


@query("ensemble_importance")
def ensemble_importance(spark, root):
    """Importance per feature over the trained models."""
    detectors = _detectors(spark, root)
    found = detectors.importances(_matrix(spark, root), _matrix_names())
    return E.aggregated_importance(found, len(detectors.models))


@query("score_ranges")
def score_ranges(spark, root):
    """Per model the rows scored and those outside [0, 1]; the forest's batch scores reach both ends."""
    detectors = _detectors(spark, root)
    scored = detectors.score(_matrix(spark, root))
    # The detectors' forest is the one that `_forest` would grow once more.
    batch = detectors.models["isolation_forest"].transform(_matrix(spark, root), normalize="batch")
    batch = batch.select(F.lit("isolation_forest, batch").alias("model_name"), "anomaly_score")
    both = scored.select("model_name", "anomaly_score").unionByName(batch)
    ends = F.col("model_name") == "isolation_forest, batch"
    return both.groupBy("model_name").agg(
        F.count("*").alias("scored_rows"),
        F.count_if(~F.col("anomaly_score").between(0, 1)).alias("outside"),
        F.min(F.when(ends, F.col("anomaly_score"))).alias("least"),
        F.max(F.when(ends, F.col("anomaly_score"))).alias("largest"),
    )


@query("model_persistence")
def model_persistence(spark, root):
    """All detectors are saved and loaded: per detector the rows scored and the largest difference."""
    path = scratch_path(spark, "saved")
    detectors = _detectors(spark, root)
    detectors.save(spark, path)
    scores = scratch_path(spark, "saved_scores")
    detectors.score(_matrix(spark, root)).write.parquet(scores)
    again = Detectors.load(spark, path).score(_matrix(spark, root)).withColumnRenamed("anomaly_score", "again")
    both = spark.read.parquet(scores).join(again.drop("is_anomaly"), ["entity_id", "model_name"])
    return both.groupBy("model_name").agg(
        F.count("*").alias("scored_rows"), F.max(F.abs(F.col("anomaly_score") - F.col("again"))).alias("largest_difference")
    )


@query("detector_pipeline")
def detector_pipeline(spark, root):
    """The three detectors as stages of one Spark pipeline, fitted, saved and read: rows scored and largest difference."""
    normal = {"width": len(_matrix_names()), "trainWhere": "label = 0"}
    stages = [
        M.IsolationForest(scoreCol="isolation_forest", anomalyCol="_forest", **normal),
        M.AutoencoderDetector(scoreCol="autoencoder", anomalyCol="_autoencoder", epochs=20, **normal),
        M.BoostedDetector(scoreCol="boosted_trees", anomalyCol="_boosted", names=_matrix_names(), rounds=10),
    ]
    names = [stage.getOrDefault("scoreCol") for stage in stages]
    fitted = Pipeline(stages=stages).fit(_matrix(spark, root))
    path = scratch_path(spark, "pipeline_model")
    fitted.save(path)

    def scores(model):
        return model.transform(_matrix(spark, root)).unpivot("row_key", names, "model_name", "score")

    both = scores(fitted).join(scores(PipelineModel.load(path)).withColumnRenamed("score", "again"), ["row_key", "model_name"])
    return both.groupBy("model_name").agg(
        F.count("*").alias("scored_rows"),
        F.count_if(~F.col("score").between(0, 1)).alias("outside"),
        F.max(F.abs(F.col("score") - F.col("again"))).alias("largest_difference"),
    )


def _flagged(spark, root):
    forest = _forest(spark, root)
    return forest, forest.transform(_matrix(spark, root)).filter("is_anomaly = 1").select("row_key", "features")


@query("attribution_shap")
def attribution_shap(spark, root):
    """Sampled Shapley values of the rows that the forest flags."""
    forest, flagged = _flagged(spark, root)
    return shapley_values(forest.transform, flagged, background_rows(_matrix(spark, root)), _matrix_names())


@query("attribution_lime")
def attribution_lime(spark, root):
    forest, flagged = _flagged(spark, root)
    return lime_values(forest.transform, flagged, forest.scaler, _matrix_names())


def _tree_values(spark, root):
    """Exact values of the rows that the forest flags, for the forest's paths and the boosted trees' margin."""
    rows = _matrix(spark, root)
    models = _detectors(spark, root).models
    forest, trees = models["isolation_forest"], models["boosted_trees"]
    flagged = forest.transform(rows).filter("is_anomaly = 1").select("row_key", "features")
    parts = [
        V.attribution_trees(leaves, model.scaler, flagged, rows, _matrix_names()).withColumn("model_name", F.lit(name))
        for name, model, leaves in (
            ("isolation_forest", forest, V.forest_leaves(forest)),
            ("boosted_trees", trees, V.boosted_leaves(spark, trees)),
        )
    ]
    return parts[0].unionByName(parts[1])


@query("attribution_trees")
def attribution_trees(spark, root):
    return _tree_values(spark, root)


@query("attribution_trees_sums")
def attribution_trees_sums(spark, root):
    """Per model the flagged rows whose values do not add up to the output less the base, and whether any were flagged."""
    rows = _tree_values(spark, root).groupBy("model_name", "entity_id").agg(
        F.sum("signed").alias("added"), F.max(F.col("output") - F.col("base")).alias("wanted")
    )
    return rows.groupBy("model_name").agg(
        F.count_if(F.abs(F.col("added") - F.col("wanted")) > 1e-9).alias("off"), (F.count("*") > 0).alias("some_flagged")
    )


@query("explain_prediction")
def explain_prediction(spark, root):
    """Everything about each flagged row in one row per explainer."""
    forest, flagged = _flagged(spark, root)
    shap = shapley_values(forest.transform, flagged, background_rows(_matrix(spark, root)), _matrix_names())
    lime = lime_values(forest.transform, flagged, forest.scaler, _matrix_names())
    told = reduce(
        DataFrame.unionByName,
        [X.explanation_bundle(v.select("entity_id", "feature", "score"), n) for n, v in (("shap", shap), ("lime", lime))],
    )
    return told.withColumns({name: F.to_json(name) for name in ("feature_importance", "top_features")})


@query("retrain")
def retrain(spark, root):
    """Boosted trees learn from pending feedback joined to stored vectors; their scores per alert.

    Alerts name customers and vectors name users; user numbers stand for both.
    """
    log = P.feature_log(spark, root).filter(F.col("window_size") == 86400)
    vectors = S.latest(S.stamped(log, ttl_seconds=30 * 86400), VECTOR_KEYS, AS_OF)
    stored = vectors.select("entity_id", F.array(*STORED).alias("features"))
    rows = B.training_rows(B.pending_feedback(P.feedback(spark, root)), P.alerts(spark, root), stored)
    model = train_boosted_trees(rows, list(STORED))
    return model.transform(rows).select(
        "row_key", "label", "anomaly_score", "is_anomaly", F.lit(B.next_version(B.FIRST_VERSION)).alias("model_version")
    )


def _pipeline_alerts(spark, root):
    """The alerts of a whole run as a table, and the models left out; one run per session and folder."""

    def run():
        pipeline = AlertPipeline(AS_OF, scratch_path(spark, "pipeline"))
        events = pipeline.events(P.raw_logs(spark, root))
        vectors = pipeline.vectors(events)
        detectors = pipeline.train(*pipeline.by_rules(events, vectors))
        alerts = pipeline.alerts(vectors, detectors, P.alerts(spark, root))
        alerts.write.parquet(f"{pipeline.path}/alerts")
        return f"{pipeline.path}/alerts", json.dumps(detectors.left_out)

    path, left_out = _once(spark, root, "pipeline_alerts", run)
    return spark.read.parquet(path), left_out


@query("pipeline_alerts")
def pipeline_alerts(spark, root):
    """From raw logs to alerts: normalize, features of all windows, detectors, text; with the models left out and why.

    Entities that an attack rule finds are the supervised model's attacks.
    """
    alerts, left_out = _pipeline_alerts(spark, root)
    return plain_alerts(alerts).withColumn("models_left_out", F.lit(left_out))


@query("pipeline_alert_checks")
def pipeline_alert_checks(spark, root):
    """Of the same run: alerts, entities, alerts whose severity, reasons or score are not what they must be."""
    alerts, _ = _pipeline_alerts(spark, root)
    high = F.col("anomaly_score") > A.HIGH_ABOVE
    reasons = F.coalesce(F.size("feature_importance"), F.lit(0))
    wrong = ((F.col("severity") == "high") != high) | (high != (reasons == A.REASONS)) | ~F.col("anomaly_score").between(0, 1)
    return alerts.agg(
        F.count("*").alias("alert_count"),
        F.countDistinct("entity_id").alias("entity_count"),
        F.count_if(wrong).alias("wrong_alerts"),
        F.count_if(F.size("related_alerts") > A.RELATED).alias("too_many_related"),
    )


@query("alert_reasons")
def alert_reasons(spark, root):
    """New alerts from given scores, one row per reason, with the entity's newest open alerts."""
    scored = E.ensemble_score(_predictions(spark, root))
    reasons = P.attributions(spark, root)
    alerts = A.create_alerts(scored, AS_OF, X.alert_narratives(reasons), reasons, P.alerts(spark, root))
    related = F.array_join("related_alerts", ",").alias("related_alerts")
    return alerts.select("entity_id", "severity", related, F.explode("feature_importance").alias("feature", "importance"))


@query("retraining_gate")
def retraining_gate(spark, root):
    """Three calls of retraining: half way through the feedback, at once again, and at its end, with the status after each."""
    feedback, alerts = P.feedback(spark, root), P.alerts(spark, root)
    log = P.feature_log(spark, root).filter(F.col("window_size") == 86400)
    vectors = S.latest(S.stamped(log, ttl_seconds=30 * 86400), VECTOR_KEYS, AS_OF)
    stored = cut_lineage(vectors.select("entity_id", F.array(*STORED).alias("features")))
    work = Retraining(spark, scratch_path(spark, "retraining"))
    parts = []
    for step, at in enumerate((RETRAIN_AT, RETRAIN_AT, AS_OF)):
        model = work.trigger(feedback, alerts, stored, STORED, at)
        status = work.status(feedback, AS_OF)
        parts.append(status.select(F.lit(step).cast("bigint").alias("step"), F.lit(model is not None).alias("trained"), "*"))
    return reduce(DataFrame.unionByName, parts)


# Streams.


def _event_stream(spark, root):
    return P.sec_events_from(stream_table(spark, root, "events"))


@query("stream_normalize")
def stream_normalize(spark, root):
    raw = P.raw_logs_from(stream_table(spark, root, "events"))
    return J.run_to_table(J.normalize_stream(raw), scratch_path(spark, "stream_normalize")).select(*NORMALIZED)


EVENT_COLUMNS = (
    "event_id",
    "event_time",
    "event_type",
    "entity_id",
    "hostname",
    "source_ip",
    "command_line",
    "dns_query",
    "country",
    "city",
    "location",
)


def _event_table(spark, root):
    stream = J.event_table_stream(_event_stream(spark, root).select(*EVENT_COLUMNS))
    return J.run_to_table(stream, scratch_path(spark, "event_table"), ["event_date"])


@query("stream_entity_buffer")
def stream_entity_buffer(spark, root):
    """The table that a stream of events has filled, counted by entity and day."""
    return _event_table(spark, root).groupBy("entity_id", "event_date").agg(F.count("*").alias("event_count"))


# Events come in deliveries of ten days; of every ten, the third comes three deliveries late and the seventh twice.
DELIVERY_DAYS = 10
FIRST_DAY = "2024-01-01"
LATE_BY = 3
STREAM_DELAY = "2 days"


def _deliveries(spark, root) -> DataFrame:
    """Events with the number of the delivery they come in, some twice."""
    events = P.sec_events(spark, root).select("event_id", "event_time", "entity_id", "event_type", "eid")
    own = F.floor(F.datediff("event_time", F.lit(FIRST_DAY).cast("date")) / DELIVERY_DAYS)
    numbers = F.when(F.col("eid") % 10 == 3, F.array(own + LATE_BY)).when(F.col("eid") % 10 == 7, F.array(own, own + 1))
    return events.withColumn("delivery", F.explode(F.coalesce(numbers, F.array(own)))).drop("eid")


def _retention_run(spark, root):
    """The event table after all deliveries, one run of the stream for each, and the days that were retired."""
    base = scratch_path(spark, "retention")
    deliveries = _deliveries(spark, root)
    deliveries.write.partitionBy("delivery").parquet(f"{base}/delivered")
    delivered = spark.read.parquet(f"{base}/delivered")
    schema = delivered.drop("delivery").schema
    first, last = delivered.agg(F.min("delivery"), F.max("delivery")).first()
    late = 0
    for number in range(first, last + 1) if first is not None else ():
        delivered.filter(F.col("delivery") == number).drop("delivery").write.mode("append").parquet(f"{base}/inbox")
        stream = spark.readStream.schema(schema).parquet(f"{base}/inbox")
        run = K.fill_event_table(stream, f"{base}/table", f"{base}/checkpoint", STREAM_DELAY)
        run.awaitTermination()
        late += K.rows_dropped_as_late(run)
    filled = K.read_event_table(spark, f"{base}/table", schema)
    counts = delivered.count(), filled.count()
    days = K.retire_days(spark, f"{base}/table", AS_OF)
    return K.read_event_table(spark, f"{base}/table", schema, AS_OF), counts, late, days


@query("stream_eviction")
def stream_eviction(spark, root):
    """What is left of a stream whose late rows are dropped, whose copies are found and whose old days are retired."""
    return _retention_run(spark, root)[0].select("event_id", "event_time", "entity_id")


@query("stream_eviction_report")
def stream_eviction_report(spark, root):
    """Rows delivered, accepted and kept by the run of `stream_eviction`, whether rows were dropped as late, and retired days."""
    kept, (delivered, accepted), late, days = _retention_run(spark, root)
    return kept.agg(F.count("*").alias("kept_rows")).select(
        F.lit(delivered).cast("bigint").alias("delivered_rows"),
        F.lit(accepted).cast("bigint").alias("accepted_rows"),
        "kept_rows",
        F.lit(late > 0).alias("some_were_late"),
        F.lit(len(days)).cast("bigint").alias("retired_days"),
    )


@query("stream_unique_events")
def stream_unique_events(spark, root):
    """A stream in which every event comes twice, once each after the filter of ids."""
    twice = _event_stream(spark, root).unionByName(_event_stream(spark, root))
    unique = J.unique_events(twice.select("event_id", "event_time", "entity_id"))
    return J.run_to_table(unique, scratch_path(spark, "stream_unique_events"))


# Failures within an hour of each other, two at least: the tables hold few that come closer.
SESSION = {"failures": 2, "seconds": 3600}


@query("brute_force_sessions")
def brute_force_sessions(spark, root):
    return R.brute_force_sessions(P.sec_events(spark, root), **SESSION)


@query("stream_brute_force")
def stream_brute_force(spark, root):
    """The same from a stream: the sessions that are closed when it has been read."""
    found = J.brute_force_stream(_event_stream(spark, root), delay="1 hour", **SESSION)
    return J.run_to_table(found, scratch_path(spark, "stream_brute_force"))


@query("stream_periodic_features")
def stream_periodic_features(spark, root):
    """Features brought from noon to midnight for the entities that changed."""
    events = _event_table(spark, root)
    before = HALF_TIME
    known = FE.extract_features(W.evict_old_events(events, before, 30 * 86400), before, entities=events)
    return J.refresh_features(events, known, before, AS_OF)


def _stored_hours(spark, root, kinds):
    """The event table of a stream, and its hours up to AS_OF stored in two runs, one up to the noon before."""
    events, path = _event_table(spark, root), scratch_path(spark, "hours")
    for since, until in ((FIRST_DAY, HALF_TIME), (HALF_TIME, AS_OF)):
        H.store_hours(events, path, since, until, kinds)
    return events, path


@query("stream_partial_features")
def stream_partial_features(spark, root):
    """As stream_periodic_features, from stored hours and the few raw events at the ends of the windows."""
    events, path = _stored_hours(spark, root, ("values", "pieces"))
    return H.features_from_hours(spark, path, events, AS_OF)


@query("sketched_features")
def sketched_features(spark, root):
    """Distinct counts by sketches against the exact ones, per entity and over all: three standard errors are allowed."""
    events, path = _stored_hours(spark, root, ("sketches",))
    held = W.in_windows(events, AS_OF)
    columns = list(H.SKETCHED.items())
    parts = []
    for everyone in (False, True):
        keys = ["window_size"] if everyone else ["entity_id", "window_size"]
        exact = held.groupBy(*keys).agg(*[F.countDistinct(F.nullif(F.col(c), F.lit(""))).alias(n) for n, c in columns])
        if everyone:
            exact = exact.withColumn("entity_id", F.lit(None).cast("string"))
        exact = exact.unpivot(["entity_id", "window_size"], list(H.SKETCHED), "feature", "exact_count")
        found = H.distinct_estimates(spark, path, events, AS_OF, everyone=everyone).alias("s")
        same = [F.col(f"s.{c}").eqNullSafe(exact[c]) for c in ("entity_id", "window_size", "feature")]
        near = F.abs(F.col("estimate") - F.col("exact_count")) <= 3 * H.sketch_error() * F.col("exact_count")
        parts.append(
            exact.join(found, reduce(lambda a, b: a & b, same), "left").select(
                *[exact[c] for c in ("entity_id", "window_size", "feature", "exact_count")],
                F.coalesce(near, F.lit(False)).alias("within_bound"),
            )
        )
    return parts[0].unionByName(parts[1])


@query("stream_sliding_features")
def stream_sliding_features(spark, root):
    counts = J.sliding_counts(_event_stream(spark, root), "1 day", "6 hours", "1 hour")
    return J.run_to_table(counts, scratch_path(spark, "sliding"))


# Size and slide of each trailing window.
SLIDING = {3600: ("1 hour", "15 minutes"), 86400: ("1 day", "6 hours"), 604800: ("7 days", "1 day")}


@query("stream_sliding_windows")
def stream_sliding_windows(spark, root):
    """As stream_sliding_features for an hour, a day and a week, with the window's seconds in the key."""
    parts = []
    for seconds, (size, slide) in SLIDING.items():
        counts = J.sliding_counts(_event_stream(spark, root), size, slide, "1 hour")
        counts = counts.withColumn("window_size", F.lit(seconds))
        parts.append(J.run_to_table(counts, scratch_path(spark, f"sliding_{seconds}")))
    return reduce(DataFrame.unionByName, parts)


@query("stream_to_alerts")
def stream_to_alerts(spark, root):
    """A stream of vectors scored by all detectors, saved and loaded, its alerts appended to a log."""
    path = scratch_path(spark, "stream_detectors")
    _detectors(spark, root).save(spark, path)
    detectors = Detectors.load(spark, path)
    stream = stream_table(spark, root, "embeddings").select(
        F.col("vec_id").alias("row_key"), F.col("embedding").cast("array<double>").alias("features")
    )
    return plain_alerts(J.run_to_table(J.score_stream(stream, detectors, AS_OF), scratch_path(spark, "alert_log")))


@query("stream_exfiltration")
def stream_exfiltration(spark, root):
    return J.run_to_table(J.exfiltration_stream(_event_stream(spark, root)), scratch_path(spark, "exfiltration"))


@query("stream_exfiltration_day")
def stream_exfiltration_day(spark, root):
    found = J.exfiltration_stream(_event_stream(spark, root), seconds=86400)
    return J.run_to_table(found, scratch_path(spark, "exfiltration"))
