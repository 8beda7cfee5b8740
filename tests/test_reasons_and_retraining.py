"""Alerts with reasons, retraining behind its gate, rules that read the days of the windows only."""

from datetime import datetime, timedelta

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from watchmere.operators import alerts as A
from watchmere.operators.boosted import DEPTH, LEARNING_RATE, ROUNDS, train_boosted_trees
from watchmere.operators.feedback import valid_feedback
from watchmere.operators.retraining import Retraining
from watchmere.plans.detection import Pipeline
from watchmere.plans.queries import QUERIES
from watchmere.session import scratch_path
from watchmere.sources import projections as P

ROOT = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def feedback(spark, first, n, true_share=2):
    rows = [(f"fb{i}", f"al{i}", START + timedelta(hours=i), i % true_share == 0, 1 + i % 5) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "feedback_id string, alert_id string, event_time timestamp, is_true_positive boolean, confidence int")


def test_retraining_waits_for_samples_and_counts_versions(spark):
    alerts = spark.createDataFrame([(f"al{i}", f"u{i}") for i in range(60)], "alert_id string, entity_id string")
    vectors = spark.createDataFrame([(f"u{i}", [float(i % 2), float(i)]) for i in range(60)], "entity_id string, features array<double>")
    path = scratch_path(spark, "retraining")
    work = Retraining(spark, path, min_samples=20)
    few = feedback(spark, 0, 19)
    assert work.trigger(few, alerts, vectors, ["a", "b"], "2024-01-31", rounds=2) is None
    assert tuple(work.status(few, "2024-01-31").first()) == ("collecting", 19, "1.0.0")
    assert work.versions().count() == 0
    enough = feedback(spark, 0, 30)
    model = work.trigger(enough, alerts, vectors, ["a", "b"], START + timedelta(hours=24), rounds=2)
    assert model is not None and work.state().version == "2.0.0"
    # What was learnt from is no longer pending, nor is what came after the instant asked for.
    assert tuple(work.status(enough, START + timedelta(hours=27)).first()) == ("collecting", 3, "2.0.0")
    assert work.trigger(enough, alerts, vectors, ["a", "b"], START + timedelta(hours=29), rounds=2) is None
    one_class = feedback(spark, 31, 29, true_share=1)
    assert work.trigger(one_class, alerts, vectors, ["a", "b"], "2024-01-31", rounds=2) is None
    assert work.state().version == "2.0.0"
    both = feedback(spark, 0, 60)
    assert work.trigger(both, alerts, vectors, ["a", "b"], "2024-01-31", rounds=2) is not None
    assert [r.version for r in work.versions().orderBy("trained_at").collect()] == ["2.0.0", "3.0.0"]
    rows = vectors.select(F.col("entity_id").alias("row_key"), "features")
    for version, held in (("2.0.0", model), (None, work.load("3.0.0"))):
        want = held.transform(rows).select("row_key", "anomaly_score").collect()
        assert sorted(map(tuple, work.load(version).transform(rows).select("row_key", "anomaly_score").collect())) == sorted(map(tuple, want))
    assert valid_feedback(both).count() == 60


def test_alerts_carry_their_reasons_and_open_alerts(spark):
    scored = spark.createDataFrame([("user:a", 0.9), ("user:b", 0.1)], "entity_id string, final_score double")
    reasons = spark.createDataFrame([("user:a", f"f{i:02}", float(i % 13)) for i in range(30)], "entity_id string, feature string, score double")
    at = datetime(2024, 1, 10)
    rows = [(f"x{i:02}", "user:a", at - timedelta(hours=i // 2), ["new", "in_progress", "closed"][i % 3]) for i in range(40)]
    rows += [("later", "user:a", at + timedelta(seconds=1), "new"), ("other", "user:c", at, "new")]
    earlier = spark.createDataFrame(rows, "alert_id string, entity_id string, event_time timestamp, status string")
    made = {r.entity_id: r for r in A.create_alerts(scored, at, None, reasons, earlier).collect()}
    want = sorted(((-(i % 13), f"f{i:02}") for i in range(30)))[: A.REASONS]
    assert made["user:a"].feature_importance == {f: float(-s) for s, f in want}
    still_open = sorted((r for r in rows[:40] if r[3] != "closed"), key=lambda r: (at - r[2], r[0]))
    assert made["user:a"].related_alerts == [r[0] for r in still_open[: A.RELATED]]
    assert made["user:b"].feature_importance is None and made["user:b"].related_alerts == []
    plain = A.create_alerts(scored, at)
    assert plain.columns == A.create_alerts(scored, at, None, reasons, earlier).columns
    assert plain.schema == A.create_alerts(scored, at, None, reasons, earlier).schema or plain.dtypes == A.create_alerts(scored, at, None, reasons, earlier).dtypes


@pytest.mark.parametrize("attacked", [True, False])
def test_rules_read_the_days_of_the_windows(spark, attacked):
    table = scratch_path(spark, "events")
    events = P.sec_events(spark, ROOT).withColumn("event_date", F.to_date("event_time"))
    if not attacked:
        events = events.filter("event_type = 'logout'")
    events.write.partitionBy("event_date").parquet(table)
    pipeline = Pipeline("2024-01-20 00:00:00", scratch_path(spark, "p"), (3600, 86400))
    read = spark.read.parquet(table)
    vectors = read.select(F.col("entity_id").alias("row_key")).distinct().withColumn("features", F.array(F.lit(1.0)))
    normal, attack = pipeline.by_rules(read, vectors)
    days = spark.read.parquet(f"{pipeline.path}/recent").select(F.to_date("event_time").cast("string").alias("d")).distinct()
    assert {r.d for r in days.collect()} <= {"2024-01-19", "2024-01-20"}
    assert normal.count() + (attack.count() if attack is not None else 0) == vectors.count()


def test_training_makes_its_rows_once(spark):
    """What training rows are made from may be large joins: they are not run again in each pass over the rows."""
    made = spark.sparkContext.accumulator(0)

    def label(i):
        made.add(1)
        return i % 2

    labels = F.udf(label, "int")("id")
    rows = spark.range(80).repartition(2).select(F.array(F.col("id").cast("double"), F.rand(3)).alias("features"), labels.alias("label"))
    model = train_boosted_trees(rows, ["a", "b"], rounds=2, depth=2)
    assert made.value == 80
    assert model.transform(rows.select("features")).count() == 80


def test_the_gate_trains_whole_models(spark, tmp_path, monkeypatch):
    """A version that the gate lets through is asked for with as many trees, as deep, as any other model."""
    asked, fit = [], GBTClassifier.fit

    def short(self, rows):
        # What was asked for is looked at; two trees are enough to go on with.
        asked.append((self.getMaxIter(), self.getMaxDepth(), self.getStepSize(), self.getSubsamplingRate()))
        return fit(self, rows, {self.maxIter: 2})

    monkeypatch.setattr(GBTClassifier, "fit", short)
    # Alerts of user 0 are true and those of user 1 false; user 1's own events have other alerts.
    events = [(i, START + timedelta(days=2, minutes=i), 0, 1 if i % 2 == 0 else 3) for i in range(120)]
    events += [(i, START + timedelta(days=2, minutes=i), 1, 4) for i in range(120, 123)]
    rows = [(i, at, user, "click", 1.0, f'{{"k": {k}}}') for i, at, user, k in events]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    orders = [(i, i % 2, "O", 1.0, START, "5-LOW") for i in range(120)]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(orders, schema).write.parquet(f"{tmp_path}/orders.parquet")
    told = [tuple(r) for r in QUERIES["retraining_gate"](spark, str(tmp_path)).orderBy("step").collect()]
    assert told == [(step, step == 0, "collecting", 0, "2.0.0") for step in range(3)]
    assert asked == [(ROUNDS, DEPTH, LEARNING_RATE, 1.0)]
