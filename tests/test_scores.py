"""Scores and their texts: means in any order of rows, and the digits that texts show."""

import pytest
from pyspark.sql import functions as F

from watchmere.functions.columns import two_places
from watchmere.operators import ensemble as E
from watchmere.plans.queries import QUERIES
from watchmere.sources import projections as P


def test_two_places_are_those_of_c(spark):
    values = [0.0, -0.0, 0.125, 0.375, -0.125, -0.001, 0.285, 1.005, 2.675, 0.995, 12345.675, 1e20]
    values += [k / 200 for k in range(1, 2000, 2)] + [k / 8 for k in range(400)]
    rows = spark.createDataFrame([(x,) for x in values], "x DOUBLE").select("x", two_places(F.col("x")).alias("t"))
    assert [(r["x"], r["t"]) for r in rows.collect() if r["t"] != "%.2f" % r["x"]] == []


def test_alert_texts_round_the_score_once(spark, monkeypatch):
    # 0.3249999 and 0.2999998 are 0.325 and 0.3 at six places.
    scores = [("a", "m", 0.3249999), ("b", "m", 0.2999998)]
    made = spark.createDataFrame(scores, "entity_id STRING, model_name STRING, anomaly_score DOUBLE")
    reasons = spark.createDataFrame([("a", "login", 2.0)], "entity_id STRING, feature STRING, score DOUBLE")
    monkeypatch.setattr(P, "model_scores", lambda *_: made)
    monkeypatch.setattr(P, "attributions", lambda *_: reasons)
    told = {r["entity_id"]: r["explanation"] for r in QUERIES["alert_explanation"](spark, "").collect()}
    assert "(Risk Score: 0.32)" in told["a"] and told["b"].startswith("Low risk")


@pytest.mark.parametrize("order", ["v", "-v"])
def test_means_at_a_limit_do_not_depend_on_the_order_of_rows(spark, order):
    # One 0.9 to six of 0.2 is 0.3, which is not below 0.3; plain sums come out on either side.
    rows = [(f"e{n}", "m", 0.9 if i < n // 7 else 0.2) for n in range(7, 350, 7) for i in range(n)]
    made = spark.createDataFrame(rows, "entity_id STRING, model_name STRING, anomaly_score DOUBLE")
    made = made.withColumn("v", F.col("anomaly_score")).repartition(3, "entity_id").sortWithinPartitions(F.expr(order)).drop("v")
    found = E.model_predictions(E.with_labels(made))
    assert {r["anomaly_score"] for r in found.collect()} == {0.3}
    assert {r["final_score"] for r in E.ensemble_score(found).collect()} == {0.3}


def test_scores_without_a_decimal_keep_their_plain_mean(spark):
    rows = [("a", float("nan")), ("a", 1.0), ("b", 1e30), ("b", 1e30), ("c", None), ("c", 0.25)]
    made = spark.createDataFrame(rows, "entity_id STRING, anomaly_score DOUBLE").withColumn("model_name", F.lit("m"))
    found = {r["entity_id"]: r["anomaly_score"] for r in E.model_predictions(E.with_labels(made)).collect()}
    assert str(found["a"]) == "nan" and (found["b"], found["c"]) == (1e30, 0.25)
