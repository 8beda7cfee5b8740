"""Event ids, reruns, partition pruning, times as logs write them, open registries and alerts from end to end."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchmere.operators import alerts as A
from watchmere.operators import feedback as B
from watchmere.operators import features as FE
from watchmere.operators import normalize as N
from watchmere.operators import store as S
from watchmere.operators import windows as W
from watchmere.plans.detection import Pipeline, train_detectors
from watchmere.sources import logs
from watchmere.streaming import jobs as J

FAILED = {"hostname": "pc", "program": "sshd", "source_type": "linux", "message": "sshd[1]: Failed password for bob from 10.0.0.1"}


@pytest.fixture
def log_file(tmp_path):
    (tmp_path / "day.json").write_text("\n".join([json.dumps(FAILED)] * 5 + [json.dumps(FAILED | {"hostname": "other"})]) + "\n")
    return str(tmp_path / "day.json")


def test_equal_lines_of_a_file_are_events_of_their_own(spark, log_file):
    ids = [{r.event_id for r in N.accepted(N.normalize(logs.file_raw_logs(spark, log_file))).collect()} for _ in range(2)]
    assert len(ids[0]) == 6 and ids[0] == ids[1]


def test_a_line_repeated_many_times_is_numbered_in_steps(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("same\n" * 25_000 + "other\n" + "pair\n" * 2)
    rows = logs.file_raw_logs(spark, str(tmp_path / "logs"))
    made = rows.withColumn("n", F.regexp_extract("record_place", "([0-9]+)$", 1).cast("long")).groupBy("value")
    found = made.agg(F.count("*"), F.count_distinct("record_place"), F.min("n"), F.max("n")).collect()
    assert {tuple(r) for r in found} == {("same", 25_000, 25_000, 1, 25_000), ("other", 1, 1, 1, 1), ("pair", 2, 2, 1, 2)}
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()


def test_ids_without_ingest_time_do_not_change(spark):
    raw = spark.createDataFrame([(json.dumps(FAILED),)], "value STRING")
    assert N.normalize(raw).first()["event_id"] == N.normalize(raw).first()["event_id"]


def test_a_second_run_adds_nothing(spark, log_file, tmp_path):
    pipeline = Pipeline("2030-01-01 00:00:00", str(tmp_path / "out"))
    for _ in range(2):
        assert pipeline.events(logs.file_raw_logs(spark, log_file)).count() == 6


def test_equal_lines_survive_the_stream(spark, log_file, tmp_path):
    stream = J.normalize_stream(logs.file_raw_logs(spark, log_file.rsplit("/", 1)[0], streaming=True))
    assert J.run_to_table(J.unique_events(stream), str(tmp_path / "stream")).count() == 6


def _days(spark, path):
    rows = spark.range(30 * 24).select(
        F.concat(F.lit("user:u"), (F.col("id") % 5).cast("string")).alias("entity_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("event_time"),
        F.lit("login").alias("event_type"),
        *[F.lit(None).cast("string").alias(c) for c in ("hostname", "source_ip", "command_line", "dns_query", "country", "city")],
        F.lit(None).cast("struct<lat:double,lon:double>").alias("location"),
        F.col("id").cast("string").alias("event_id"),
    )
    logs.write_events(rows, path)
    return spark.read.parquet(path)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_windows_read_only_their_days(spark, tmp_path):
    events = _days(spark, str(tmp_path / "events"))
    for frame in (
        W.window_events(events, "2024-01-20 00:00:00", 86400),
        W.evict_old_events(events, "2024-01-20 00:00:00"),
        J.changed_entities(events, "2024-01-19 00:00:00", "2024-01-20 00:00:00"),
    ):
        assert "PartitionFilters: [isnotnull(event_date" in _plan(frame)
    scans = [line for line in _plan(FE.extract_features(events, "2024-01-20 00:00:00")).split("\n") if "FileScan" in line]
    assert scans and all("PartitionFilters: [isnotnull(event_date" in line for line in scans)
    assert W.window_events(events, "2024-01-20 00:00:00", 86400).count() == 25


def test_store_reads_only_days_written(spark, tmp_path):
    rows = S.stamped(spark.createDataFrame([("a", 1, datetime(2024, 1, 1)), ("a", 1, datetime(2024, 1, 5))], "entity_id STRING, window_size BIGINT, written_at TIMESTAMP"))
    S.append_rows(rows, str(tmp_path / "store"))
    found = S.latest_feature_vectors(spark.read.parquet(str(tmp_path / "store")), "2024-01-02 00:00:00")
    assert "PartitionFilters: [isnotnull(written_date" in _plan(found)


def test_ties_and_short_lives(spark):
    at = datetime(2024, 1, 1)
    rows = [("a", 1, at, datetime(2024, 1, 9), 1.0), ("a", 1, at, datetime(2024, 1, 9), 2.0), ("b", 1, at, datetime(2024, 1, 9), 1.0), ("b", 1, datetime(2024, 1, 2), datetime(2024, 1, 3), 2.0)]
    frame = spark.createDataFrame(rows, "entity_id STRING, window_size BIGINT, written_at TIMESTAMP, expires_at TIMESTAMP, x DOUBLE")
    picks = {tuple(S.latest_feature_vectors(f, "2024-01-04 00:00:00").collect()) for f in (frame, frame.orderBy("x"), frame.orderBy(F.desc("x")).repartition(3))}
    assert len(picks) == 1
    assert [r.entity_id for r in next(iter(picks))] == ["a"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1704164645", datetime(2024, 1, 2, 3, 4, 5)),
        ("1704164645000", datetime(2024, 1, 2, 3, 4, 5)),
        ("Jan  2 03:04:05", datetime(2024, 1, 2, 3, 4, 5)),
        ("Dec 31 23:00:00", datetime(2023, 12, 31, 23)),
        ("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5)),
        ("no time", datetime(2024, 1, 3)),
    ],
)
def test_times_as_logs_write_them(spark, text, want):
    raw = spark.createDataFrame([(json.dumps(FAILED | {"timestamp": text}),)], "value STRING")
    row = N.normalize(raw.withColumn("ingest_time", F.lit("2024-01-03 00:00:00").cast("timestamp"))).first()
    assert row["event_time"] == want


def test_added_source_fills_any_column(spark, monkeypatch):
    def rule(record, text):
        place = F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
        return N.Rule(
            fields={"event_type": F.lit("login"), "entity_id": F.lit("user:x"), "entity_type": F.lit("user"), "raw_message": F.lit(""), "command_line": record.text("cmd"), "country": F.lit("FR"), "location": place},
        )

    monkeypatch.setitem(N.RULES, "added", rule)
    row = N.normalize(spark.createDataFrame([(json.dumps({"cmd": "ls -l"}), "added")], "value STRING, source_type STRING")).first()
    assert (row["command_line"], row["country"], row["location"]["lon"], row["reject_reason"]) == ("ls -l", "FR", 2.0, None)
    assert json.loads(row["raw_data"]) == {"cmd": "ls -l"}


def test_alerts_from_end_to_end(spark):
    scored = spark.createDataFrame([("user:a", 0.9), ("host:b", 0.6), ("plain", 0.1)], "entity_id STRING, final_score DOUBLE")
    alerts = A.create_alerts(scored, "2024-01-02 00:00:00")
    assert len(alerts.columns) == 19
    assert {r.entity_id: r.entity_type for r in alerts.collect()} == {"user:a": "user", "host:b": "host", "plain": "user"}
    given = A.assign_alerts(alerts, alerts.filter("severity = 'high'").select("alert_id", F.lit("ann").alias("analyst_id")))
    closed = A.resolve_alerts(given, alerts.filter("severity = 'low'").select("alert_id", F.lit("small").alias("resolution_notes")), "2024-01-02 10:00:00")
    verdict = alerts.filter("entity_id = 'host:b'").select(F.lit("f1").alias("feedback_id"), "alert_id", F.lit(datetime(2024, 1, 2, 11)).alias("event_time"), F.lit(False).alias("is_true_positive"), F.lit(4).alias("confidence"))
    done = B.apply_disposition(closed, verdict)
    assert {r.entity_id: r.status for r in done.collect()} == {"user:a": "in_progress", "host:b": "false_positive", "plain": "resolved"}
    row = A.dashboard_stats(done, "2024-01-02 12:00:00").first()
    assert (row["total_alerts"], row["open_alerts"], row["resolved_today"], row["false_positives_today"]) == (3, 1, 1, 1)


def test_pages_past_the_end_and_by_key(spark):
    rows = spark.range(45).selectExpr("cast(id as string) alert_id", "timestamp_seconds(id) event_time", "'low' severity")
    empty = A.page_alerts(rows, 9, 20).collect()
    assert [(r.alert_id, r.total) for r in empty] == [(None, 45)]
    last = A.page_alerts(rows, 1, 20).collect()[-1]
    following = A.page_alerts(rows, 1, 20, after=(last.event_time, last.alert_id)).collect()
    assert [r.alert_id for r in following] == [str(i) for i in range(24, 4, -1)]


def test_a_model_left_out_is_named(spark):
    rows = spark.createDataFrame([(str(i), [float(i % 3), 1.0 * i]) for i in range(40)], "row_key STRING, features ARRAY<DOUBLE>")
    detectors = train_detectors(rows, None, ["a", "b"])
    assert set(detectors.models) == {"isolation_forest", "autoencoder"} and "boosted_trees" in detectors.left_out
