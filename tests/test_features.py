"""Features against a plain reading of their definitions, with one entity that has most events."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from watchmere.operators import features as FE
from watchmere.operators import windows as W

AS_OF = datetime(2024, 1, 31)
SCHEMA = (
    "event_id STRING, event_time TIMESTAMP, entity_id STRING, event_type STRING, hostname STRING, source_ip STRING, "
    "command_line STRING, dns_query STRING, country STRING, city STRING, location STRUCT<lat: DOUBLE, lon: DOUBLE>"
)
PLACES = {"New York": ("US", 40.7128, -74.006), "London": ("GB", 51.5074, -0.1278), "Tokyo": ("JP", 35.6762, 139.6503)}


def event(number, ago, entity="user:a", kind="login", host=None, ip=None, command=None, dns=None, city=None):
    country, lat, lon = PLACES[city] if city else (None, None, None)
    place = (lat, lon) if city else None
    return (f"e{number:05d}", AS_OF - timedelta(seconds=ago), entity, kind, host, ip, command, dns, country, city, place)


def random_events(count=600, seed=7):
    rng = random.Random(seed)
    kinds = ["login", "authentication_failure", "authentication_success", "file_delete", "file_modify", "dns_query", "process_create", "network_connection"]
    out = []
    for i in range(count):
        ago = rng.choice([rng.uniform(0, 3600), rng.uniform(0, 86400), rng.uniform(0, 700000)])
        out.append(
            event(
                i,
                round(ago, 3),
                "user:hot" if rng.random() < 0.7 else f"user:{rng.randrange(5)}",
                rng.choice(kinds),
                rng.choice([None, "", "h1", "h2", "10.0.0.1"]),
                rng.choice([None, "10.0.0.1", "h1", "10.0.0.2"]),
                rng.choice([None, "ls", "id"]),
                rng.choice([None, "a.com", "b.com"]),
                rng.choice([None, *PLACES]),
            )
        )
    return out


def entropy(values):
    counts = Counter(values)
    total = sum(counts.values())
    return -sum(c / total * math.log2(c / total) for c in counts.values()) if total else 0.0


def distance(a, b):
    (lat1, lon1), (lat2, lon2) = a, b
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    h += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(h)))


def expected(events, window):
    """Features of one entity and window by their definitions."""
    rows = sorted((e for e in events if AS_OF - timedelta(seconds=window) <= e[1] <= AS_OF), key=lambda e: (e[1], e[0]))
    if not rows:
        return dict.fromkeys(FE.FEATURE_NAMES, 0.0)
    n, hours = len(rows), max(window / 3600, 0.1)
    kinds = [e[3] for e in rows]
    hosts, ips = [e[4] for e in rows if e[4]], [e[5] for e in rows if e[5]]
    links = [(e[5], e[4]) for e in rows if e[4] and e[5]]
    out = {name: sum(text in k for k in kinds) for name, text in FE.TYPE_COUNTERS.items()}
    out |= {"unique_hosts": len(set(hosts)), "unique_ips": len(set(ips)), "avg_events_per_hour": n / hours}
    out |= {
        "source_ip_entropy": entropy(ips),
        "hostname_entropy": entropy(hosts),
        "event_type_entropy": entropy(kinds),
        "command_entropy": entropy([e[6] for e in rows if e[6]]),
        "dns_query_entropy": entropy([e[7] for e in rows if e[7]]),
    }
    placed = [(e[1], e[10]) for e in rows if e[10]]
    moves = [(distance(p, q), max((t2 - t1).total_seconds() / 3600, 0.1)) for (t1, p), (t2, q) in zip(placed, placed[1:])]
    far = max((d for d, _ in moves), default=0.0)
    out |= {
        "unique_countries": len({e[8] for e in rows if e[8]}),
        "unique_cities": len({e[9] for e in rows if e[9]}),
        "max_distance_km": far,
        "avg_distance_km": fmean(d for d, _ in moves) if moves else 0.0,
        "velocity_score": min(far / hours / 1000, 1.0),
        "impossible_travel_count": sum(d / h > 1000 for d, h in moves),
    }
    gaps = [(b[1] - a[1]).total_seconds() for a, b in zip(rows, rows[1:])]
    gaps = [g for g in gaps if g > 0]
    regular = max(0.0, 1 - min(pstdev(gaps) / fmean(gaps), 1)) if n >= 10 and gaps else 0.0
    out |= {
        "events_per_minute": n / max(window / 60, 0.1),
        "events_per_hour": n / hours,
        "night_activity_ratio": sum(e[1].hour >= 22 or e[1].hour < 6 for e in rows) / n,
        "weekend_activity_ratio": sum(e[1].weekday() >= 5 for e in rows) / n,
        "periodicity_score": regular,
        "burst_score": min(n / window / 10, 1.0),
    }
    nodes = len(set(hosts)) + len(set(ips))
    pairs = sum(links[i] == links[j][::-1] for i in range(len(links)) for j in range(i + 1, len(links)))
    out |= {
        "degree_centrality": len(links) / max(nodes * (nodes - 1) / 2 if nodes > 1 else 1, 1),
        "betweenness_centrality": len(set(hosts)) / max(len(set(ips)), 1),
        "clustering_coefficient": pairs / len(links) if len(links) >= 2 else 0.0,
        "new_connections": len(set(hosts)),
        "connection_diversity": len(set(hosts)) / max(len(links), 1),
        "access_pattern_score": sum("delete" in k or "modify" in k for k in kinds) / n,
    }
    return out


def features_of(spark, events, **options):
    frame = spark.createDataFrame(events, SCHEMA)
    rows = FE.extract_features(frame, "2024-01-31 00:00:00", **options).collect()
    return {(r["entity_id"], r["window_size"]): r.asDict() for r in rows}


def test_all_features_match_their_definitions_for_a_hot_entity(many_chunks):
    events = random_events()
    by_entity = defaultdict(list)
    for e in events:
        by_entity[e[2]].append(e)
    got = features_of(many_chunks, events)
    assert len(got) == 3 * len(by_entity)
    for (entity, window), row in got.items():
        want = expected(by_entity[entity], window)
        assert set(want) == set(FE.FEATURE_NAMES)
        for name, value in want.items():
            assert row[name] == pytest.approx(value, abs=1e-7), (entity, window, name)


def test_result_does_not_depend_on_partitions(spark, many_chunks):
    events = random_events(200)
    first = features_of(many_chunks, events)
    many_chunks.conf.set("spark.sql.shuffle.partitions", "1")
    second = features_of(many_chunks, events)
    for key, row in first.items():
        for name in FE.FEATURE_NAMES:
            assert row[name] == pytest.approx(second[key][name], abs=1e-9)


def test_window_edges(spark):
    events = [event(1, 3600), event(2, 3600.000001), event(3, -1)]
    got = features_of(spark, events, families=["frequency"])
    assert got["user:a", 3600]["login_count"] == 1
    assert got["user:a", 86400]["login_count"] == 2
    held = W.window_events(spark.createDataFrame(events, SCHEMA), "2024-01-31 00:00:00", 3600).collect()
    assert [r["event_id"] for r in held] == ["e00001"]


@pytest.mark.parametrize(
    ("agos", "score"), [(range(0, 540, 60), 0.0), (range(0, 600, 60), 1.0), ([30] * 10, 0.0)], ids=["nine", "even", "instant"]
)
def test_periodicity(spark, agos, score):
    got = features_of(spark, [event(i, ago) for i, ago in enumerate(agos)], families=["timeseries"])
    assert got["user:a", 3600]["periodicity_score"] == pytest.approx(score)


def test_family_with_aggregates_of_its_own(spark):
    own = FE.Family(
        ("latest_host_length",),
        lambda part, window: {"latest_host_length": part("host_length") * 3600 / window},
        aggregates={"host_length": F.max(F.length("hostname"))},
    )
    rows = [event(1, 60, host="abc"), event(2, 7200, host="abcdef"), event(3, 7200, entity="user:b", host=None)]
    got = features_of(spark, rows, families=["entropy", own])
    assert got["user:a", 3600]["latest_host_length"] == 3
    assert got["user:a", 86400]["latest_host_length"] == pytest.approx(6 / 24)
    assert got["user:b", 3600]["latest_host_length"] == got["user:b", 86400]["latest_host_length"] == 0
    assert "hostname_entropy" in got["user:a", 3600]
    with pytest.raises(ValueError, match="host_length"):
        FE.needed([own, own])


def test_travel(spark):
    one = features_of(spark, [event(1, 60, city="London")], families=["geo"])["user:a", 86400]
    assert one["max_distance_km"] == 0 and one["impossible_travel_count"] == 0
    fast = features_of(spark, [event(1, 7200, city="New York"), event(2, 3600, city="London")], families=["geo"])
    assert fast["user:a", 86400]["impossible_travel_count"] == 1
    assert fast["user:a", 3600]["impossible_travel_count"] == 0
    slow = features_of(spark, [event(1, 39600, city="New York"), event(2, 3600, city="London")], families=["geo"])
    assert slow["user:a", 86400]["impossible_travel_count"] == 0


def test_reciprocal_edges(spark):
    links = [("a", "b")] * 2 + [("b", "a")] * 3 + [("a", "a")] * 2
    got = features_of(spark, [event(i, 60 + i, ip=ip, host=host) for i, (ip, host) in enumerate(links)], families=["graph"])
    assert got["user:a", 3600]["clustering_coefficient"] == pytest.approx(1.0)


def test_edge_keys_do_not_run_into_each_other(spark):
    links = [("ab", "c"), ("c", "ab"), ("a", "bc"), ("bc", "a")]
    got = features_of(spark, [event(i, 60 + i, ip=ip, host=host) for i, (ip, host) in enumerate(links)], families=["graph"])
    assert got["user:a", 3600]["clustering_coefficient"] == pytest.approx(0.5)


def test_entropy(spark):
    def of(values):
        rows = [event(i, 60 + i, host=v) for i, v in enumerate(values)]
        return features_of(spark, rows, families=["entropy"])["user:a", 3600]["hostname_entropy"]

    assert of(["x", "x", "x"]) == 0.0
    assert of(["x", "y", "z", "w"]) == pytest.approx(2.0)
    assert of([None, "", None]) == 0.0


def test_quiet_entities_get_zeros_and_windows_nest(spark):
    events = random_events(100)
    known = spark.createDataFrame([("user:quiet",), ("user:hot",)], "entity_id STRING")
    got = features_of(spark, events, entities=known)
    assert set(got) == {(e, w) for e in ("user:quiet", "user:hot") for w in (3600, 86400, 604800)}
    assert all(got["user:quiet", 86400][name] == 0.0 for name in FE.FEATURE_NAMES)
    for name in (*FE.TYPE_COUNTERS, "unique_hosts", "unique_ips"):
        assert got["user:hot", 3600][name] <= got["user:hot", 86400][name] <= got["user:hot", 604800][name]


def test_doubling_all_events_keeps_ratios_and_entropies(spark):
    events = random_events(120)
    twice = events + [(e[0] + "x", *e[1:]) for e in events]
    names = [*FE.FAMILIES["entropy"], "night_activity_ratio", "weekend_activity_ratio", "access_pattern_score"]
    one, two = features_of(spark, events), features_of(spark, twice)
    for key in one:
        for name in names:
            assert one[key][name] == pytest.approx(two[key][name], abs=1e-9)


def test_flattened_has_99_features(spark):
    frame = spark.createDataFrame(random_events(30), SCHEMA)
    flat = FE.flattened_features(frame, "2024-01-31 00:00:00")
    assert flat.columns == ["entity_id", *FE.flattened_names()] and len(flat.columns) == 100
    vectors = FE.feature_vectors(FE.extract_features(frame, "2024-01-31 00:00:00"), "2024-01-31 00:00:00")
    row = vectors.first()
    assert len(row["features"]) == 33 and row["is_valid"]


def test_eviction(spark):
    events = [event(1, 8 * 86400, "user:old"), event(2, 10), event(3, 8 * 86400)]
    row = W.eviction_report(spark.createDataFrame(events, SCHEMA), "2024-01-31 00:00:00").first()
    assert (row["removed_events"], row["kept_events"], row["removed_entities"]) == (2, 1, 1)
