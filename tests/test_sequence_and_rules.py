import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watchmere.operators import rules as R
from watchmere.operators.sequence import with_latest, with_previous

START = datetime(2024, 1, 1)
SCHEMA = "entity_id STRING, event_id STRING, event_time TIMESTAMP, event_type STRING, city STRING, location STRUCT<lat: DOUBLE, lon: DOUBLE>"


def hot_rows(count=500, kinds=("login",), seconds=5000, seed=3):
    rng = random.Random(seed)
    places = [(0.0, 0.0), (0.0, 60.0), (0.5, 60.0)]
    return [
        (
            "hot" if rng.random() < 0.8 else f"u{rng.randrange(4)}",
            f"e{i:04d}",
            START + timedelta(seconds=round(rng.uniform(0, seconds), 2)),
            rng.choice(kinds),
            "c",
            rng.choice(places),
        )
        for i in range(count)
    ]


def grouped(rows):
    out = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        out[row[0]].append(row)
    return out


def test_previous_row_across_chunks(many_chunks):
    rows = hot_rows()
    frame = many_chunks.createDataFrame(rows, SCHEMA)
    done = with_previous(frame, ["entity_id"], ["event_time", "event_id"], F.struct("event_id"), "before")
    got = {r["event_id"]: r["before"] and r["before"]["event_id"] for r in done.collect()}
    want = {}
    for group in grouped(rows).values():
        want |= {row[1]: before and before[1] for before, row in zip([None, *group], group)}
    assert got == want


def test_impossible_travel_keeps_pairs_across_chunks(many_chunks):
    rows = hot_rows(400, seconds=200000)
    found = R.detect_impossible_travel(many_chunks.createDataFrame(rows, SCHEMA))
    got = {(r["previous_event_id"], r["event_id"]) for r in found.collect()}
    want = set()
    for group in grouped(rows).values():
        for a, b in zip(group, group[1:]):
            hours = max((b[2] - a[2]).total_seconds() / 3600, 0.1)
            degrees = abs(b[5][1] - a[5][1]) or abs(b[5][0] - a[5][0])
            if degrees * 111.19 / hours > 1000:
                want.add((a[1], b[1]))
    assert got == want and want


def test_brute_force_counts_whole_seconds(many_chunks):
    rows = hot_rows(300, kinds=("authentication_failure", "login"), seconds=4000)
    found = R.detect_brute_force(many_chunks.createDataFrame(rows, SCHEMA), failures=4, seconds=60)
    got = {(r["entity_id"], r["detected_at"]): r["failures"] for r in found.collect()}
    want = {}
    for entity, group in grouped(rows).items():
        seconds = [int((r[2] - START).total_seconds()) for r in group if r[3] == "authentication_failure"]
        for s in set(seconds):
            n = sum(s - 60 < x <= s for x in seconds)
            if n >= 4:
                want[entity, START + timedelta(seconds=s)] = n
    assert got == want and want


def test_exfiltration_is_exact_at_both_ends(spark):
    def at(seconds):
        return START + timedelta(seconds=seconds)

    rows = [
        ("a", "access", at(1000.5), "file_access", None, None),
        ("a", "same second before", at(1000.4), "data_exfiltration", None, None),
        ("a", "same second after", at(1000.6), "data_exfiltration", None, None),
        ("a", "at the end", at(1600.5), "data_exfiltration", None, None),
        ("a", "past the end", at(1600.500001), "data_exfiltration", None, None),
        ("b", "other user", at(1001), "data_exfiltration", None, None),
    ]
    found = R.detect_exfiltration(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["event_id"] for r in found} == {"same second after", "at the end"}


def test_exfiltration_matches_pairs(many_chunks):
    rows = hot_rows(400, kinds=("file_access", "data_exfiltration", "login"), seconds=90000)
    found = R.detect_exfiltration(many_chunks.createDataFrame(rows, SCHEMA), seconds=100)
    want = {
        b[1]
        for group in grouped(rows).values()
        for b in group
        if b[3] == "data_exfiltration"
        and any(a[3] == "file_access" and 0 <= (b[2] - a[2]).total_seconds() <= 100 for a in group)
    }
    assert {r["event_id"] for r in found.collect()} == want and want


def test_latest_value_is_carried_over_chunks(many_chunks):
    # One hot key, values on one row in fifty: most chunks have none and take what an earlier one left.
    rows = [("hot" if i % 10 else f"k{i % 30}", i, i * 7 if i % 50 == 21 else None) for i in range(2000)]
    random.Random(3).shuffle(rows)
    df = many_chunks.createDataFrame(rows, "k STRING, t BIGINT, v BIGINT")
    want, last = {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        last[k] = v if v is not None else last.get(k)
        want[t] = last[k]
    got = {r["t"]: r["seen"] for r in with_latest(df, ["k"], ["t"], F.col("v"), "seen").collect()}
    assert got == want
    recent = with_latest(df, ["k"], ["t"], F.col("v"), "seen", keep=lambda seen: F.col("t") - seen / 7 <= 5)
    assert {r["t"] for r in recent.collect()} == {t for t, v in want.items() if v is not None and t - v / 7 <= 5}
    assert with_latest(df.limit(0), ["k"], ["t"], F.col("v"), "seen").count() == 0


def test_exfiltration_with_empty_columns_and_long_spans(many_chunks):
    rows = hot_rows(300, kinds=("file_access", "data_exfiltration", "login"), seconds=90000)
    rows += [("a", None, START, "file_access", None, None), ("a", "no time", None, "data_exfiltration", None, None)]
    rows += [(None, "no one", START, "file_access", None, None), (None, "nobody", START, "data_exfiltration", None, None)]
    rows += [("a", "same instant", START, "data_exfiltration", None, None)]
    found = R.detect_exfiltration(many_chunks.createDataFrame(rows, SCHEMA), seconds=10**6)
    want = sorted(
        b[1]
        for b in rows
        if b[3] == "data_exfiltration" and b[0] and b[2]
        and any(a[0] == b[0] and a[3] == "file_access" and a[2] and a[2] <= b[2] for a in rows)
    )
    assert sorted(r["event_id"] for r in found.collect()) == want and "same instant" in want


def test_privilege_escalation_windows(spark):
    rows = [("a", f"e{i}", START + timedelta(seconds=s), "privilege_escalation", None, None) for i, s in enumerate((1, 119, 121))]
    found = R.detect_privilege_escalation(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["window_start"], r["escalations"]) for r in found] == [(START, 2)]
