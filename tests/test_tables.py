"""Feature store, alerts, feedback, ensemble and texts."""

import re
from datetime import datetime

import pytest

from watchmere.operators import alerts as A
from watchmere.operators import ensemble as E
from watchmere.operators import explain as X
from watchmere.operators import feedback as B
from watchmere.operators import scaling as D
from watchmere.operators import store as S
from watchmere.operators.alert_pages import AlertPages
from watchmere.schemas import SEVERITIES


def test_rows_expire_and_the_last_write_wins(spark):
    rows = [("a", 3600, datetime(2024, 1, 30), 1.0), ("a", 3600, datetime(2024, 1, 30, 12), 2.0), ("a", 86400, datetime(2024, 1, 30, 0, 0, 1), 3.0)]
    stored = S.stamped(spark.createDataFrame(rows, "entity_id STRING, window_size BIGINT, written_at TIMESTAMP, x DOUBLE"))

    def live(at):
        return {(r["window_size"], r["x"]) for r in S.latest_feature_vectors(stored, at).collect()}

    assert live("2024-01-30 12:00:00") == {(3600, 2.0), (86400, 3.0)}
    assert live("2024-01-30 11:00:00") == {(3600, 1.0), (86400, 3.0)}
    assert live("2024-01-31 00:00:01") == {(3600, 2.0)}
    assert live("2024-01-31 12:00:00") == set()
    asked = spark.createDataFrame([("a", 86400), ("b", None)], "entity_id STRING, window_size BIGINT")
    assert [r["x"] for r in S.lookup_feature_vectors(stored, asked, "2024-01-30 12:00:00").collect()] == [3.0]
    assert S.delete_entities(stored, asked).count() == 0


def test_dashboard_counts_false_positives_of_the_day(spark):
    rows = [("1", "critical", "false_positive", datetime(2024, 1, 2)), ("2", "info", "resolved", datetime(2024, 1, 1, 23)), ("3", "low", "new", None)]
    row = A.dashboard_stats(spark.createDataFrame(rows, "alert_id STRING, severity STRING, status STRING, resolved_at TIMESTAMP"), "2024-01-02 10:00:00").first()
    assert (row["false_positives_today"], row["resolved_today"], row["open_alerts"], row["critical_alerts"]) == (1, 0, 1, 1)


def test_pages_and_filters_check_their_arguments(spark):
    rows = spark.range(45).selectExpr("cast(id as string) alert_id", "timestamp_seconds(id) event_time", "'low' severity")
    page = A.page_alerts(rows, 3, 20).collect()
    assert [r["alert_id"] for r in page] == ["4", "3", "2", "1", "0"] and page[0]["total"] == 45
    with pytest.raises(ValueError):
        A.page_alerts(rows, 1, 101)
    with pytest.raises(ValueError):
        A.filter_alerts(rows, severity="huge")


def test_feedback(spark):
    rows = [(f"f{i}", f"a{i % 3}", datetime(2024, 1, 1, 0, i), i % 2 == 0, 1 + i % 6) for i in range(12)]
    given = spark.createDataFrame(rows, "feedback_id STRING, alert_id STRING, event_time TIMESTAMP, is_true_positive BOOLEAN, confidence INT")
    row = B.feedback_statistics(given).first()
    assert (row["total_feedback"], row["true_positives"], row["false_positives"]) == (10, 6, 4)
    assert B.retraining_status(given, 11).first()["status"] == "collecting"
    assert B.retraining_status(given, 10).first()["status"] == "ready"
    first = {(r["is_true_positive"], r["feedback_id"]) for r in B.retraining_data(given, 2).collect()}
    assert first == {(True, "f0"), (True, "f2"), (False, "f1"), (False, "f3")}
    assert B.next_version("1.0.0") == "2.0.0"
    last = {r["alert_id"]: r["feedback_id"] for r in B.latest_feedback(given).collect()}
    assert last == {"a0": "f9", "a1": "f10", "a2": "f8"}


def test_ensemble(spark):
    rows = [("e", "m1", 0.9, 1), ("e", "m1", 0.7, 1), ("e", "m2", 0.1, 0)]
    scores = spark.createDataFrame(rows, "entity_id STRING, model_name STRING, anomaly_score DOUBLE, is_anomaly INT")
    row = E.ensemble_score(E.model_predictions(scores)).first()
    assert row["final_score"] == pytest.approx(0.45) and not row["final_decision"]
    assert row["consensus_level"] == 0.5 and row["model_count"] == 2


def attributions(spark, values):
    return spark.createDataFrame([("e", n, v) for n, v in values.items()], "entity_id STRING, feature STRING, score DOUBLE")


@pytest.mark.parametrize(
    ("values", "text"),
    [
        ({"x": 2.0}, "Alert triggered because of highly unusual x."),
        ({"x": 8.0, "y": 2.0}, "Alert triggered because of highly unusual x and unusual y."),
        (
            {"a": 60.0, "b": 20.0, "c": 10.0, "d": 5.0, "e": 3.0, "f": 2.0},
            "Alert triggered due to multiple factors: highly unusual a, unusual b, somewhat unusual c, somewhat unusual d, and somewhat unusual e.",
        ),
    ],
)
def test_narratives(spark, values, text):
    assert X.alert_narratives(attributions(spark, values)).first()["narrative"] == text


def test_texts_for_quiet_entities(spark):
    rows = attributions(spark, {"login_count": 0.5, "unique_hosts": 0.05})
    nobody = spark.createDataFrame([("z",)], "entity_id STRING")
    assert X.alert_narratives(rows, nobody).first()["narrative"].startswith("Normal behavior detected.")

    def told(who, score):
        return X.alert_explanations(spark.createDataFrame([(who, score)], "entity_id STRING, final_score DOUBLE"), rows).first()["explanation"]

    assert told("e", 0.2) == "Low risk alert for e. Behavior is mostly normal with minor deviations."
    assert told("z", 0.6) == "Medium risk alert for z. Multiple minor deviations detected."
    assert told("e", 0.61) == "Alert for e (Risk Score: 0.61). Key factors: Login Count (score: 0.50)."


def test_scaler_only_centres_constant_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "row_key INT, features ARRAY<DOUBLE>")
    scaler = D.fit_scaler(rows, 2)
    assert [r["features"] for r in scaler.transform(rows).orderBy("row_key").collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    got = {r["feature"]: r["importance"] for r in D.mean_importance(rows, ["a", "b"]).collect()}
    assert got == pytest.approx({"a": 2 / 3, "b": 1 / 3})


def test_deep_pages_read_the_parts_that_hold_them(spark, tmp_path):
    rows = [
        (f"al-{i:04}", datetime(2024, 1, 1 + i % 3) if i % 40 else None, SEVERITIES[i % 4], "new" if i % 7 else "closed", "unknown", i)
        for i in range(900)
    ]
    schema = "alert_id STRING, event_time TIMESTAMP, severity STRING, status STRING, attack_type STRING, part_of INT"
    alerts = spark.createDataFrame(rows, schema)
    pages = AlertPages.write(alerts, str(tmp_path / "pages"), part_rows=50)
    assert pages.index.select("part").distinct().count() > 10
    for chosen in ({}, {"status": "closed"}, {"severity": SEVERITIES[1], "status": "new"}):
        for page, size in ((1, 20), (7, 20), (4, 33), (100, 20)):
            listed = A.page_alerts(A.filter_alerts(alerts, **chosen), page, size)
            want = [r for r in listed.collect() if r["alert_id"]]
            shown = pages.page(page, size, **chosen)
            assert shown.columns == listed.columns and shown.collect() == want
    plan = pages.page(20, 20)._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)[1]
    assert "part" in read and len(re.findall(r"\d+", read.split("part")[-1])) <= 4
    empty = AlertPages.write(alerts.limit(0), str(tmp_path / "none"))
    assert empty.page(1).collect() == [] and empty.page(1).columns == [*alerts.columns, "total"]
    with pytest.raises(ValueError):
        pages.page(0)
