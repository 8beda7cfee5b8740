"""State that expires, stored hours, sketches, snapshots, and detectors as pipeline stages."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from watchmere.operators import estimators as M
from watchmere.operators import features as FE
from watchmere.operators import partials as H
from watchmere.operators import rules as R
from watchmere.operators import store as S
from watchmere.operators.autoencoder import initial_weights, train_autoencoder
from watchmere.operators.snapshots import SnapshotTable
from watchmere.session import scratch_path
from watchmere.sources import projections as P
from watchmere.streaming import jobs as J
from watchmere.streaming import retention as K

ROOT = "/root/testdata/sf0.001"
EVENT = "event_id string, event_time timestamp, entity_id string"
NOON = datetime(2024, 1, 10, 12)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def deliver(spark, base, rows):
    """One delivery and one run of the stream; the rows dropped as late."""
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(EVENT).parquet(f"{base}/in")
    run = K.fill_event_table(stream, f"{base}/table", f"{base}/checkpoint", "1 day")
    run.awaitTermination()
    return K.rows_dropped_as_late(run)


def test_late_rows_are_dropped_and_old_days_retired(spark):
    base = scratch_path(spark, "retention")
    schema = spark.createDataFrame([], EVENT).schema
    for i in range(4):
        day = NOON + timedelta(days=4 * i)
        assert deliver(spark, base, [(f"a{i}", day, "u1"), (f"a{i}", day, "u1"), (f"b{i}", day - timedelta(hours=5), "u2")]) == 0
    # Two rows behind the watermark, one copy of a row that is still remembered, one new row that is not late.
    newest = NOON + timedelta(days=12)
    late = deliver(spark, base, [("a0", NOON, "u1"), ("c0", NOON, "u3"), ("a3", newest, "u1"), ("d", newest - timedelta(hours=20), "u3")])
    assert late == 2
    held = K.read_event_table(spark, f"{base}/table", schema)
    assert sorted(r.event_id for r in held.collect()) == sorted([*(f"{x}{i}" for i in range(4) for x in "ab"), "d"])
    # The week before ends inside a day: the whole days before that go, of the day itself only the older rows.
    as_of = newest + timedelta(hours=0)
    gone = K.retire_days(spark, f"{base}/table", as_of)
    assert gone == [date(2024, 1, 10), date(2024, 1, 14)]
    assert K.retire_days(spark, f"{base}/table", as_of) == []
    left = K.read_event_table(spark, f"{base}/table", schema, as_of)
    assert {r.event_id for r in left.collect()} == {"a2", "b2", "a3", "b3", "d"}
    assert "PartitionFilters: [isnotnull(event_date" in plan_of(left).replace("\n", " ")
    # The stream goes on after days were retired.
    assert deliver(spark, base, [("e", newest + timedelta(hours=1), "u1")]) == 0
    assert K.read_event_table(spark, f"{base}/table", schema, as_of).filter("event_id = 'e'").count() == 1


def test_retiring_a_table_that_is_not_there(spark):
    assert K.retire_days(spark, scratch_path(spark, "nothing"), NOON) == []


def test_sessions_by_stream_are_those_of_the_batch(spark):
    times = [0, 100, 250, 700, 1200, 1201, 1202, 9000, 9001, 9002]
    rows = [(f"{u}{t}", NOON + timedelta(seconds=t), u, "authentication_failure") for u in ("u1", "u2") for t in times]
    rows += [("x", NOON + timedelta(seconds=1100), "u1", "login")]
    base = scratch_path(spark, "sessions")
    df = spark.createDataFrame(rows, "event_id string, event_time timestamp, entity_id string, event_type string")
    df.write.parquet(f"{base}/in")
    batch = R.brute_force_sessions(df)
    got = {(r.entity_id, (r.session_start - NOON).seconds, (r.session_end - NOON).seconds, r.failures) for r in batch.collect()}
    assert got == {(u, s, e, 3) for u in ("u1", "u2") for s, e in ((0, 550), (1200, 1502), (9000, 9302))}
    stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
    closed = J.run_to_table(J.brute_force_stream(stream, delay="10 minutes"), f"{base}/out")
    # The last session may still grow when the stream has been read.
    assert sorted(map(tuple, closed.collect())) == sorted(map(tuple, batch.filter(F.second("session_end") != 2 + 300).filter(
        F.col("session_end") < NOON + timedelta(seconds=9002 - 600)
    ).collect()))


def close(got, want, digits=9):
    def plain(df):
        return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in row) for row in df.collect())

    return plain(got) == plain(want)


@pytest.mark.parametrize(
    "as_of, windows",
    [
        ("2024-01-31 00:00:00", (3600, 86400, 604800)),
        ("2024-01-20 13:37:11.5", (3600, 86400, 604800)),
        ("2024-01-20 13:37:11.5", (600, 5000, 90000)),
        ("2024-01-20 13:00:00", (1800, 3599)),
    ],
)
def test_features_from_hours_are_those_of_the_events(spark, as_of, windows):
    path = scratch_path(spark, "hours")
    events = P.sec_events(spark, ROOT).withColumn("event_date", F.to_date("event_time"))
    for since, until in (("2024-01-01", "2024-01-19 07:00:00"), ("2024-01-19 07:00:00", "2024-01-20 13:00:00"), ("2024-01-20 13:00:00", "2024-02-01")):
        H.store_hours(events, path, since, until)
    H.store_hours(events, path, "2024-01-19 07:00:00", "2024-01-20 13:00:00")  # Again: replaced, not added.
    assert close(H.features_from_hours(spark, path, events, as_of, windows), FE.extract_features(events, as_of, windows))
    some = H.features_from_hours(spark, path, events, as_of, windows, ("entropy",))
    assert close(some, FE.extract_features(events, as_of, windows, ("entropy",)))


def test_refreshing_reads_the_ends_of_windows_only(spark):
    path, table = scratch_path(spark, "hours"), scratch_path(spark, "events")
    P.sec_events(spark, ROOT).withColumn("event_date", F.to_date("event_time")).write.partitionBy("event_date").parquet(table)
    events = spark.read.parquet(table)
    H.store_hours(events, path, "2024-01-01", "2024-02-01", ("values", "pieces", "sketches"))
    cut = H.Cut("2024-01-20 13:00:00", (3600, 86400, 604800))
    assert {r[0] for r in cut.ends(events).select("event_date").distinct().collect()} <= {date(2024, 1, 20)}
    read = cut.hours(H.read_hours(spark, path, "values"))
    assert "PartitionFilters: [isnotnull(event_date" in plan_of(read).replace("\n", " ")
    uncut = H.Cut("2024-01-20 13:30:00", (604800,))
    days = uncut.ends(events).select(F.to_date("event_time").alias("d")).distinct().collect()
    assert {r.d for r in days} <= {date(2024, 1, 13), date(2024, 1, 20)}


def test_gaps_keep_their_digits(spark):
    """Gaps of some 10^8 seconds that differ by one: squares taken from each other would lose them."""
    start, times = datetime(1990, 1, 1), [0]
    for i in range(10):
        times.append(times[-1] + 100_000_000 + i % 2)
    rows = [(f"e{i}", start + timedelta(seconds=t), "u1", "login") for i, t in enumerate(times)]
    blank = "cast(null as string)"
    df = spark.createDataFrame(rows, "event_id string, event_time timestamp, entity_id string, event_type string")
    df = df.selectExpr("*", *[f"{blank} as {c}" for c in ("hostname", "source_ip", "command_line", "dns_query", "country", "city")])
    df = df.withColumn("location", F.lit(None).cast("struct<lat:double,lon:double>"))
    window = 2_000_000_000
    row = FE.extract_features(df, "2022-01-01", [window], ["timeseries"]).first()
    gaps = np.diff(times)
    assert abs((1 - row.periodicity_score) - np.std(gaps) / np.mean(gaps)) < 1e-14


def test_sketches_unite_within_their_error(spark):
    rows = spark.range(60_000).select(
        F.lit("u1").alias("entity_id"),
        (F.lit("2024-01-20 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))).alias("event_time"),
        F.concat(F.lit("h"), F.col("id") % 20_000).alias("hostname"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("ip"), F.col("id") % 50)).alias("source_ip"),
        F.lit(None).cast("string").alias("country"),
        F.lit("c").alias("city"),
    )
    path = scratch_path(spark, "sketches")
    H.store_hours(rows, path, "2024-01-20 00:00:00", "2024-01-21 00:00:00", ("sketches",))
    found = H.distinct_estimates(spark, path, rows, "2024-01-20 16:50:10", (86400,))
    got = {r.feature: r.estimate for r in found.collect()}
    assert abs(got["unique_hosts"] - 20_000) <= 3 * H.sketch_error() * 20_000
    assert (got["unique_ips"], got["unique_countries"], got["unique_cities"]) == (50, 0, 1)
    assert got["new_connections"] == got["unique_hosts"]


def vector_log(spark):
    rows = []
    for d in range(1, 30):
        for u in range(12):
            if (d * 7 + u * 5) % 4 == 0:
                at = datetime(2024, 1, d, u)
                rows.append((f"u{u}", 3600 if d % 2 else 86400, at, float(d), at + timedelta(hours=[6, 30, 400][(d + u) % 3])))
    return spark.createDataFrame(rows, "entity_id string, window_size int, written_at timestamp, v double, expires_at timestamp")


@pytest.mark.parametrize("as_of", ["2024-01-05 00:00:00", "2024-01-11 00:00:00", "2024-01-16 03:30:00", "2024-01-29 23:00:00"])
def test_snapshots_answer_like_the_whole_log(spark, as_of):
    log = vector_log(spark)
    table = SnapshotTable(spark, scratch_path(spark, "table"), S.VECTOR_KEYS, buckets=4)
    table.append(log)
    for day in ("2024-01-10", "2024-01-15", "2024-01-15"):
        table.compact(day)
    assert table.snapshots() == [date(2024, 1, 10), date(2024, 1, 15)]
    want = sorted(map(tuple, S.latest_feature_vectors(log, as_of).collect()))
    got = table.latest(as_of)
    assert sorted(map(tuple, got.select(log.columns).collect())) == want
    some = table.latest(as_of, ["u3", "u4", "nobody"])
    assert sorted(map(tuple, some.select(log.columns).collect())) == [r for r in want if r[0] in ("u3", "u4")]
    if as_of > "2024-01-16":
        plan = plan_of(got).replace("\n", " ")
        assert "written_date" in plan and "(written_date#" in plan and ">= 2024-01-16" in plan.replace(" 19738)", " 2024-01-16)")


def test_latest_reads_only_days_that_can_be_live(spark):
    log = vector_log(spark).filter("expires_at <= written_at + interval 30 hours")
    path = scratch_path(spark, "log")
    S.append_rows(log, path)
    table = spark.read.parquet(path)
    as_of = "2024-01-20 10:00:00"
    bounded = S.latest_feature_vectors(table, as_of, 30 * 3600)
    assert sorted(map(tuple, bounded.select(log.columns).collect())) == sorted(map(tuple, S.latest_feature_vectors(log, as_of).collect()))
    filters = plan_of(bounded).split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert ">=" in filters and "<=" in filters
    asked = spark.createDataFrame([("u1", None), ("u2", 3600), ("zz", None)], "entity_id string, window_size int")
    want = [r for r in S.latest_feature_vectors(log, as_of).collect() if r.entity_id == "u1" or (r.entity_id, r.window_size) == ("u2", 3600)]
    got = S.lookup_feature_vectors(table, asked, as_of, 30 * 3600).select(log.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_one_round_of_training_counts(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "row_key int, features array<double>")
    model = train_autoencoder(rows, 4, hidden=(3, 2), epochs=5, local_epochs=5)
    assert not np.array_equal(model.weights, initial_weights((4, 3, 2, 4), 42))
    few = train_autoencoder(rows.limit(3), 4, hidden=(3, 2), epochs=10, local_epochs=5)
    assert not np.array_equal(few.weights, initial_weights((4, 3, 2, 4), 42))


def test_detectors_stand_in_a_pipeline(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 4)), 8 + rng.normal(size=(6, 4))])
    given = [(i, x[i].tolist(), int(i >= 300), 0.5) for i in range(len(x))]
    rows = spark.createDataFrame(given, "row_key int, vector array<double>, label int, anomaly_score double")
    normal = {"width": 4, "featuresCol": "vector", "trainWhere": "label = 0"}
    stages = [
        M.IsolationForest(trees=20, maxSamples=64, scoreCol="forest", anomalyCol="forest_label", **normal),
        M.AutoencoderDetector(hidden=[3, 2], epochs=5, scoreCol="encoder", anomalyCol="encoder_label", **normal),
        M.BoostedDetector(names=list("abcd"), rounds=3, depth=2, featuresCol="vector", scoreCol="boosted", anomalyCol="boosted_label"),
    ]
    path = scratch_path(spark, "pipeline")
    Pipeline(stages=stages).save(f"{path}/unfitted")
    unfitted = Pipeline.load(f"{path}/unfitted")
    assert unfitted.getStages()[0].getOrDefault("trees") == 20
    fitted = unfitted.fit(rows)
    fitted.save(f"{path}/fitted")
    again = PipelineModel.load(f"{path}/fitted")
    assert [s.uid for s in again.stages] == [s.uid for s in fitted.stages]
    scored = fitted.transform(rows)
    # Columns that were there, one of them named like a detector's own, are as before.
    assert scored.columns == [*rows.columns, "forest", "forest_label", "encoder", "encoder_label", "boosted", "boosted_label"]
    assert {r.anomaly_score for r in scored.collect()} == {0.5}
    assert sorted(map(str, scored.collect())) == sorted(map(str, again.transform(rows).collect()))
    strange = {r.row_key for r in scored.orderBy(F.desc("forest")).limit(6).collect()}
    assert len(strange & set(range(300, 306))) >= 5
    assert scored.filter("boosted_label <> label").count() == 0
    assert again.stages[0].importances(rows.withColumn("features", F.col("vector")), list("abcd")).count() == 4
