import random
from datetime import datetime
from itertools import combinations

import pytest

from watchmere.operators import graph as G

TIME = datetime(2024, 1, 1)


def graph(spark, pairs, counts=None):
    edges = [(a, b, "t", (counts or {}).get((a, b), 1), 1.0, TIME) for a, b in pairs]
    nodes = [(n, "user", n, 0.0, TIME, TIME) for n in sorted({x for p in pairs for x in p})]
    return (
        spark.createDataFrame(nodes, "entity_id STRING, entity_type STRING, name STRING, risk_score DOUBLE, first_seen TIMESTAMP, last_seen TIMESTAMP"),
        spark.createDataFrame(edges, "source STRING, target STRING, edge_type STRING, count BIGINT, weight DOUBLE, last_seen TIMESTAMP"),
    )


def test_upserts_keep_first_and_overwrite_the_rest(spark):
    rows = [("n", "user", "old", 0.1, datetime(2024, 1, 1)), ("n", "host", "new", 0.9, datetime(2024, 1, 3)), ("n", "user", "mid", 0.5, datetime(2024, 1, 2))]
    seen = spark.createDataFrame(rows, "entity_id STRING, entity_type STRING, name STRING, risk_score DOUBLE, event_time TIMESTAMP")
    row = G.graph_nodes(seen).first()
    assert (row["name"], row["entity_type"], row["risk_score"]) == ("new", "host", 0.9)
    assert (row["first_seen"], row["last_seen"]) == (datetime(2024, 1, 1), datetime(2024, 1, 3))
    edges = spark.createDataFrame([("n", "n", "a", 1.0, TIME), ("n", "n", "a", 2.0, TIME), ("n", "x", "a", 1.0, TIME)], "source STRING, target STRING, edge_type STRING, weight DOUBLE, event_time TIMESTAMP")
    made = G.graph_edges(edges, G.graph_nodes(seen)).collect()
    assert [(r["count"], r["weight"]) for r in made] == [(2, 3.0)]


def test_shortest_paths(spark):
    # Two ways of two steps from a to d; e is in another component.
    _, edges = graph(spark, [("a", "c"), ("b", "a"), ("c", "d"), ("d", "b"), ("e", "f"), ("d", "g")])
    start = spark.createDataFrame([("a",)], "source STRING")
    got = {r["target"]: r["path"] for r in G.shortest_paths(edges, start).collect()}
    assert got == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "b", "d"], "g": ["a", "b", "d", "g"]}
    wanted = spark.createDataFrame([("a", "d"), ("a", "e"), ("a", "a")], "source STRING, target STRING")
    got = {r["target"]: r["length"] for r in G.shortest_paths(edges, start, wanted).collect()}
    assert got == {"d": 2, "a": 0}


def test_paths_between_are_the_shortest_paths(spark):
    rng = random.Random(11)
    names = [f"n{i:02}" for i in range(30)]
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(19)] + [tuple(rng.sample(names[:20], 2)) for _ in range(9)]
    pairs += [(names[i], names[j]) for i, j in ((20, 22), (20, 23), (21, 22), (21, 23), (23, 24), (22, 24), (24, 24))]
    _, edges = graph(spark, pairs)
    asked = [(a, b) for a in names for b in names] + [("n00", "n05"), ("n00", None), (None, "n00"), ("x", "x"), ("x", "n00")]
    wanted = spark.createDataFrame(asked, "source STRING, target STRING")
    got = {(r["source"], r["target"]): (r["path"], r["length"]) for r in G.paths_between(edges, wanted).collect()}
    every = G.shortest_paths(edges, wanted.select("source").dropna().distinct(), wanted)
    want = {(r["source"], r["target"]): (r["path"], r["length"]) for r in every.collect()}
    assert got == want and max(length for _, length in got.values()) > 4
    assert len(G.paths_between(edges, wanted).collect()) == len(got)
    assert G.paths_between(edges, wanted.limit(0)).count() == 0
    assert G.paths_between(edges.limit(0), wanted.limit(40)).count() == 2


def test_neighbors(spark):
    nodes, edges = graph(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("a", "a")])
    seed = spark.createDataFrame([("a",)], "entity_id STRING")
    got = {(r["neighbor_id"], r["hop"]) for r in G.neighbors_k_hop(nodes, edges, 2, seed).collect()}
    assert got == {("b", 1), ("c", 2)}
    first = {(r["entity_id"], r["neighbor_id"]) for r in G.neighbors_k_hop(nodes, edges, limit=1).collect()}
    assert first == {("a", "b"), ("b", "a"), ("c", "b"), ("d", "c")}


def test_clustering_of_a_random_graph(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(14)]
    pairs = [tuple(rng.sample(p, 2)) for p in combinations(names, 2) if rng.random() < 0.45 or p[0] == "n0"]
    nodes, edges = graph(spark, [*pairs, ("n1", "n1"), pairs[0][::-1]])
    near = {n: {b if a == n else a for a, b in pairs if n in (a, b)} for n in names}
    for r in G.clustering_coefficient(nodes, edges).collect():
        k = len(near[r["entity_id"]])
        closed = sum(v in near[u] for u, v in combinations(near[r["entity_id"]], 2))
        assert (r["degree"], r["triangles"]) == (k, closed)
        assert r["coefficient"] == pytest.approx(2 * closed / (k * (k - 1)) if k > 1 else 0.0)


def test_clustering_of_triangle_and_star(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("s", "x"), ("s", "y"), ("s", "z")])
    got = {r["entity_id"]: r["coefficient"] for r in G.clustering_coefficient(nodes, edges).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 1.0, "s": 0.0, "x": 0.0, "y": 0.0, "z": 0.0}


def test_lateral_movement_and_risk(spark):
    nodes, edges = graph(spark, [("a", f"t{i:02d}") for i in range(25)] + [("a", "few")], {("a", f"t{i:02d}"): 6 + i for i in range(25)})
    rows = G.lateral_movement(nodes, edges).collect()
    assert len(rows) == 20 and {r["target"] for r in rows} == {f"t{i:02d}" for i in range(5, 25)}
    updates = spark.createDataFrame([("a", 0.7, datetime(2024, 5, 1))], "entity_id STRING, risk_score DOUBLE, updated_at TIMESTAMP")
    risk = {r["entity_id"]: r["risk_score"] for r in G.update_risk(nodes, updates).collect()}
    assert risk["a"] == 0.7 and risk["few"] == 0.0
    counts = G.graph_statistics(nodes, edges).first()
    assert (counts["node_count"], counts["edge_count"]) == (27, 26)


def test_long_paths(spark):
    # More rounds than there are between two compactions.
    names = [f"n{i:02d}" for i in range(2 * G.COMPACT_ROUNDS + 2)]
    _, edges = graph(spark, list(zip(names, names[1:])))
    paths = G.shortest_paths(edges, spark.createDataFrame([(names[0],)], "source STRING")).collect()
    assert {r["target"]: r["path"] for r in paths} == {name: names[: i + 1] for i, name in enumerate(names)}


def test_metadata_of_the_last_observation_stays(spark):
    rows = [("n", "user", "a", 0.1, datetime(2024, 1, 2), {"k": "2"}), ("n", "user", "a", 0.1, TIME, {"k": "1"}), ("m", "user", "m", 0.0, TIME, None)]
    seen = spark.createDataFrame(rows, "entity_id STRING, entity_type STRING, name STRING, risk_score DOUBLE, event_time TIMESTAMP, metadata MAP<STRING, STRING>")
    assert {r["entity_id"]: (r["metadata"], r["first_seen"]) for r in G.graph_nodes(seen).collect()} == {"n": ('{"k":"2"}', TIME), "m": ("{}", TIME)}
    rows = [("n", "m", "t", 1.0, TIME, "old"), ("n", "m", "t", 1.0, datetime(2024, 1, 3), "new"), ("m", "n", "t", 1.0, TIME, None)]
    seen = spark.createDataFrame(rows, "source STRING, target STRING, edge_type STRING, weight DOUBLE, event_time TIMESTAMP, metadata STRING")
    assert {r["source"]: (r["metadata"], r["count"]) for r in G.graph_edges(seen).collect()} == {"n": ("new", 2), "m": ("{}", 1)}
    assert "metadata" not in G.graph_edges(seen.drop("metadata")).columns


def test_traversals_of_everything_are_refused(spark):
    nodes, edges = graph(spark, [("a", "b"), ("c", "b")])
    with pytest.raises(ValueError):
        G.neighbors_k_hop(nodes, edges, depth=2)
    sources = spark.createDataFrame([("a",), ("b",)], "source STRING")
    with pytest.raises(ValueError):
        G.shortest_paths(edges, sources, most_sources=1)
    assert G.shortest_paths(edges, sources, most_sources=2).count() == 6


def test_paths_over_a_hub_do_not_fetch_its_neighbours_for_every_pair(spark, monkeypatch):
    # A pair whose ends meet at a hub needs the neighbours of its ends, not the hub's.
    users = [f"u{i:03d}" for i in range(300)]
    _, edges = graph(spark, [(u, "hub") for u in users] + [(u, "other hub") for u in users])
    wanted = spark.createDataFrame([(users[0], u) for u in users[1:]], "source STRING, target STRING")
    sizes = []
    whole = G._neighbours

    def counted(nodes, both):
        found = whole(nodes, both)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(G, "_neighbours", counted)
    paths = G.paths_between(edges, wanted).collect()
    assert {tuple(r["path"]) for r in paths} == {(users[0], "hub", u) for u in users[1:]}
    assert max(sizes) <= 4 * len(users)
