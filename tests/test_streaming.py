from datetime import datetime

from pyspark.sql import functions as F

from watchmere.operators import features as FE
from watchmere.operators import rules as R
from watchmere.session import scratch_path
from watchmere.sources import logs
from watchmere.sources import projections as P
from watchmere.sources.tables import stream_table
from watchmere.streaming import jobs as J

ROOT = "/root/testdata/sf0.001"


def test_refreshing_equals_computing_anew(spark):
    events = P.sec_events(spark, ROOT)
    before, now = "2024-01-30 06:00:00", "2024-01-30 09:00:00"
    known = FE.extract_features(events, before, families=["frequency"], entities=events)
    full = FE.extract_features(events, now, entities=events)
    everything = J.refresh_features(events, FE.extract_features(events, before, entities=events), before, now)
    assert everything.count() == known.count()
    assert full.exceptAll(everything).isEmpty()
    assert J.changed_entities(events, before, now).count() <= events.select("entity_id").distinct().count()


def test_streamed_events_are_the_batch(spark):
    stream = P.sec_events_from(stream_table(spark, ROOT, "events")).select("event_id", "event_time", "event_type", "entity_id")
    table = J.run_to_table(J.event_table_stream(stream), scratch_path(spark, "t"), ["event_date"])
    batch = P.sec_events(spark, ROOT).select("event_id", "event_time", "event_type", "entity_id")
    assert table.drop("event_date").exceptAll(batch).isEmpty() and table.count() == batch.count()
    found = J.run_to_table(J.exfiltration_stream(stream, 86400), scratch_path(spark, "x"))
    want = R.detect_exfiltration(batch, 86400)
    assert found.exceptAll(want).isEmpty() and found.count() == want.count()


def test_a_second_run_takes_only_what_is_new(spark):
    path, out = scratch_path(spark, "logs"), scratch_path(spark, "out")
    rows = [('{"query": "a.com"}', "dns", datetime(2024, 1, 1)), ("broken", "dns", datetime(2024, 1, 1))]
    for want in (1, 2):
        logs.write_table(spark.createDataFrame(rows, "value STRING, source_type STRING, ingest_time TIMESTAMP"), path)
        stream = J.normalize_stream(logs.table_raw_logs(spark, path, streaming=True))
        assert J.run_to_table(stream, out).filter(F.col("dns_query") == "a.com").count() == want


def test_state_of_streams_is_not_in_the_heap(spark):
    stream = P.sec_events_from(stream_table(spark, ROOT, "events"))
    counts = J.sliding_counts(stream, "1 day", "6 hours", "1 hour")
    path = scratch_path(spark, "state")
    query = J.append_stream(counts, f"{path}/table", f"{path}/checkpoint")
    query.awaitTermination()
    held = [operator for progress in query.recentProgress for operator in progress["stateOperators"]]
    assert held and all(any(name.startswith("rocksdb") for name in operator["customMetrics"]) for operator in held)
