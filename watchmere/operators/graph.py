"""The entity graph as node and edge tables, and the questions asked of it.

Observations are aggregated to one row per edge before anything is joined, so a hub costs as many
rows as it has neighbours, not as it has events. Traversals are rounds of frontier joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchmere.functions.columns import filled
from watchmere.session import cut_lineage

# Limits of the reports.
NEIGHBOR_LIMIT = 50
LATERAL_MIN_COUNT = 5
LATERAL_LIMIT = 20

# Sources of which the paths to all nodes may be asked at once.
MOST_SOURCES = 1000

# Rounds of a traversal after which the nodes reached so far are written as one table again.
COMPACT_ROUNDS = 8


def record_access(events: DataFrame, user: str, resource: str, action: str, time: str = "event_time") -> DataFrame:
    """Edge observations (user, resource, action, weight 1) from events that name both ends."""
    return events.filter(F.col(user).isNotNull() & F.col(resource).isNotNull()).select(
        F.col(user).alias("source"),
        F.col(resource).alias("target"),
        F.col(action).alias("edge_type"),
        F.lit(1.0).alias("weight"),
        F.col(time).alias("event_time"),
    )


def edge_observations(events: DataFrame) -> DataFrame:
    """What normalized events say about the graph, from one pass over them: entity accessed host,
    entity and host connected to address."""
    host = F.concat(F.lit("host:"), filled("hostname"))
    address = F.concat(F.lit("ip:"), filled("source_ip"))
    seen = [
        (F.col("entity_id"), host, "accessed"),
        (address, host, "connected_to"),
        (F.col("entity_id"), address, "connected_to"),
    ]
    edges = F.array(
        *[
            F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"))
            for a, b, kind in seen
        ]
    )
    return events.select(F.inline(edges), "event_time").filter(
        F.col("source").isNotNull() & F.col("target").isNotNull()
    )


def membership_observations(events: DataFrame) -> DataFrame:
    """One observation per entity and department, at the entity's last event."""
    return (
        events.groupBy("entity_id", "department")
        .agg(F.max("event_time").alias("event_time"))
        .select(
            F.col("entity_id").alias("source"),
            F.concat(F.lit("dept:"), "department").alias("target"),
            F.lit("member_of").alias("edge_type"),
            F.lit(1.0).alias("weight"),
            "event_time",
        )
    )


def observed_nodes(observations: DataFrame) -> DataFrame:
    """Both ends of each edge observation as node observations; type and name come from the id."""
    ends = observations.select(F.explode(F.array("source", "target")).alias("entity_id"), "event_time")
    colon = F.instr("entity_id", ":")
    return ends.select(
        "entity_id",
        F.substr("entity_id", F.lit(1), colon - 1).alias("entity_type"),
        F.substr("entity_id", colon + 1).alias("name"),
        F.lit(0.0).alias("risk_score"),
        "event_time",
    )


def _metadata(observations: DataFrame) -> list[Column]:
    """The column `metadata` as text, where there is one: JSON of a map or a struct, `{}` for nothing."""
    if "metadata" not in observations.columns:
        return []
    held = observations.schema["metadata"].dataType
    text = F.col("metadata") if isinstance(held, T.StringType) else F.to_json("metadata")
    return [F.coalesce(text, F.lit("{}")).alias("metadata")]


def graph_nodes(observations: DataFrame) -> DataFrame:
    """Upsert of node observations: the first time is kept, everything else is overwritten.

    Equal observations are folded together first, which is a hash aggregate; picking the latest of several texts needs
    sorted rows, and by then few are left. A column `metadata` is kept as text, the last one winning with the rest.
    """
    metadata = _metadata(observations)
    kept = ["entity_type", "name", "risk_score", *(["metadata"] if metadata else [])]
    rows = observations.withColumn("metadata", metadata[0]) if metadata else observations
    folded = rows.groupBy("entity_id", *kept).agg(F.min("event_time").alias("first"), F.max("event_time").alias("last"))
    latest = F.max(F.struct("last", *kept))
    return (
        folded.groupBy("entity_id")
        .agg(F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), latest.alias("_last"))
        .select(
            "entity_id",
            *[F.col(f"_last.{name}").alias(name) for name in kept[:3]],
            "first_seen",
            "last_seen",
            *[F.col(f"_last.{name}").alias(name) for name in kept[3:]],
        )
    )


def graph_edges(observations: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Upsert of edge observations keyed by (source, target, type); both ends must be known nodes.

    A column `metadata` is kept as text: that of the last observation, the largest of several at one time.
    """
    metadata = _metadata(observations)
    last = [F.max(F.struct("event_time", *metadata))["metadata"].alias("metadata")] if metadata else []
    edges = observations.groupBy("source", "target", "edge_type").agg(
        F.count("*").alias("count"), F.sum("weight").alias("weight"), F.max("event_time").alias("last_seen"), *last
    )
    if nodes is not None:
        known = nodes.select("entity_id")
        edges = edges.join(known, edges["source"] == known["entity_id"], "left_semi")
        edges = edges.join(known, edges["target"] == known["entity_id"], "left_semi")
    return edges


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Outgoing and incoming edges of every node, in one aggregate over nodes and edge ends."""
    ends = F.array(
        F.struct(F.col("source").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    rows = nodes.select("entity_id", F.lit(0).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.inline(ends)))
    return rows.groupBy("entity_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    degrees = node_degree(nodes, edges)
    return degrees.select("entity_id", ((F.col("in_degree") + F.col("out_degree")) / 2).alias("degree_centrality"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, loops left out."""
    ways = F.array(
        F.struct(F.col("source").alias("a"), F.col("target").alias("b")),
        F.struct(F.col("target").alias("a"), F.col("source").alias("b")),
    )
    return edges.filter(F.col("source") != F.col("target")).select(F.inline(ways), "edge_type")


def _relation_types() -> Column:
    return F.concat_ws(",", F.array_sort(F.collect_set("edge_type")))


def neighbors_k_hop(
    nodes: DataFrame,
    edges: DataFrame,
    depth: int = 1,
    seeds: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Nodes within `depth` steps of each seed in either direction, nearest first, at most `limit`.

    `seeds` has a column `entity_id`; without it every node is a seed, which is allowed for direct neighbours only, as
    more steps would pair almost all nodes with each other. The few distinct types of the edges that lead to a
    neighbour are joined into one text.
    """
    if seeds is None and depth > 1:
        raise ValueError("neighbours beyond one step need seeds")
    both = undirected(edges)
    if seeds is None:
        first = both.select(F.col("a").alias("entity_id"), F.col("b").alias("neighbor_id"), "edge_type")
    else:
        first = both.join(seeds.select(F.col("entity_id").alias("a")).distinct(), "a").select(
            F.col("a").alias("entity_id"), F.col("b").alias("neighbor_id"), "edge_type"
        )
    reached = first.groupBy("entity_id", "neighbor_id").agg(
        F.lit(1).cast("bigint").alias("hop"), _relation_types().alias("relationship_types")
    )
    frontier = reached
    for hop in range(2, depth + 1):
        if hop == 2:
            both = cut_lineage(both)
            reached = frontier = cut_lineage(reached)
        step = (
            frontier.select("entity_id", F.col("neighbor_id").alias("a"))
            .join(both, "a")
            .filter(F.col("b") != F.col("entity_id"))
            .groupBy("entity_id", F.col("b").alias("neighbor_id"))
            .agg(F.lit(hop).cast("bigint").alias("hop"), _relation_types().alias("relationship_types"))
        )
        frontier = cut_lineage(step.join(reached, ["entity_id", "neighbor_id"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    if limit is not None:
        nearest = Window.partitionBy("entity_id").orderBy("hop", "neighbor_id")
        reached = reached.withColumn("_rank", F.row_number().over(nearest)).filter(F.col("_rank") <= limit).drop("_rank")
    about = nodes.select(
        F.col("entity_id").alias("neighbor_id"),
        F.col("entity_type").alias("neighbor_type"),
        F.col("name").alias("neighbor_name"),
        F.col("risk_score").alias("neighbor_risk"),
    )
    return reached.join(about, "neighbor_id").select(
        "entity_id", "neighbor_id", "hop", "neighbor_type", "neighbor_name", "neighbor_risk", "relationship_types"
    )


def shortest_paths(
    edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, most_sources: int = MOST_SOURCES
) -> DataFrame:
    """Undirected shortest paths from each source to every node it reaches, or to given targets.

    `sources` has a column `source`; `targets` has (source, target) pairs and limits the result, the
    search ending early once all of them are found. Rounds of frontier joins: each round extends the
    paths found in the round before by one edge, drops nodes already reached and keeps the smallest
    path per node. Among equally short paths that is the smallest overall, because its every prefix
    is the smallest path to where it ends. Without targets each source gives a row per node it reaches,
    so more than `most_sources` of them are refused; for many pairs use `paths_between`.
    """
    if targets is None and sources.select("source").distinct().limit(most_sources + 1).count() > most_sources:
        raise ValueError(f"more than {most_sources} sources need targets")
    both = cut_lineage(undirected(edges).select("a", "b").distinct())
    start = sources.select("source").distinct()
    reached = cut_lineage(
        start.select("source", F.col("source").alias("target"), F.array("source").alias("path"))
    )
    done = frontier = reached
    wanted = cut_lineage(targets.select("source", "target").distinct()) if targets is not None else None
    rounds = 0
    while not frontier.isEmpty():
        rounds += 1
        if wanted is not None and wanted.join(done, ["source", "target"], "left_anti").isEmpty():
            break
        step = (
            frontier.select("source", F.col("target").alias("a"), "path")
            .join(both, "a")
            .groupBy("source", F.col("b").alias("target"))
            .agg(F.min("path").alias("path"))
            .join(done.select("source", "target"), ["source", "target"], "left_anti")
            .select("source", "target", F.array_append("path", F.col("target")).alias("path"))
        )
        frontier = cut_lineage(step)
        done = done.unionByName(frontier)
        if rounds % COMPACT_ROUNDS == 0:
            done = cut_lineage(done)
    found = done if wanted is None else done.join(wanted, ["source", "target"], "left_semi")
    return found.select("source", "target", "path", (F.size("path") - 1).cast("bigint").alias("length"))


def paths_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Undirected shortest paths between given pairs (source, target), each searched from both of its ends.

    The same paths as `shortest_paths` gives, one row per distinct pair that is connected; pairs with a null end have
    none. The two ends grow layers of nodes in turn until a new layer meets the last one of the other side, so a pair
    explores two balls of half its distance instead of one of all of it. Nodes carry no paths but one step each: on
    the target's side the smallest neighbour nearer to the target, on the source's side the same, told backwards from
    the nodes where the sides meet. Following the steps from the source unrolls the smallest of the shortest paths.
    """
    pair = ["source", "target"]
    step_key = [*pair, "node"]
    both = cut_lineage(undirected(edges).select("a", "b").distinct())
    wanted = cut_lineage(pairs.select(*pair).dropna().distinct())
    ahead = cut_lineage(wanted.select(*pair, F.col("source").alias("node"), F.lit(0).alias("depth")))
    behind = cut_lineage(wanted.select(*pair, F.col("target").alias("node"), F.lit(None).cast("string").alias("next")))
    layers, nexts = [ahead], behind
    met = cut_lineage(ahead.join(behind, step_key, "left_semi"))
    rounds = 0
    while True:
        # A pair that has met, or one side of which has no new nodes, is searched no further.
        going = ahead.select(*pair).distinct().join(behind, pair, "left_semi").join(met, pair, "left_anti")
        going = cut_lineage(going)
        if going.isEmpty():
            break
        rounds += 1
        ahead, behind = ahead.join(going, pair, "left_semi"), behind.join(going, pair, "left_semi")
        if rounds % 2:
            seen = reduce(DataFrame.unionByName, [layer.select(*step_key) for layer in layers])
            step = _neighbours(ahead, both).select(*pair, F.col("b").alias("node")).distinct()
            ahead = step.join(seen, step_key, "left_anti").withColumn("depth", F.lit(len(layers)))
            ahead = cut_lineage(ahead)
            layers.append(ahead)
        else:
            step = _neighbours(behind, both).groupBy(*pair, F.col("b").alias("node")).agg(F.min("a").alias("next"))
            behind = cut_lineage(step.join(nexts, step_key, "left_anti"))
            nexts = nexts.unionByName(behind)
            if rounds % COMPACT_ROUNDS == 0:
                nexts = cut_lineage(nexts)
        met = cut_lineage(met.unionByName(ahead.join(behind, step_key, "left_semi")))

    steps = [nexts]
    on_way = met.filter(F.col("depth") == len(layers) - 1).select(*step_key)
    for depth in range(len(layers) - 2, -1, -1):
        # Along the edges that grew the layers: a hub on the way would bring all of its neighbours for every pair.
        ahead = _neighbours(layers[depth].join(met, pair, "left_semi"), both)
        ends = on_way.select(*pair, F.col("node").alias("b"))
        back = ahead.join(ends, [*pair, "b"]).groupBy(*step_key).agg(F.min("b").alias("next"))
        back = cut_lineage(back)
        steps.append(back)
        on_way = back.select(*step_key).unionByName(met.filter(F.col("depth") == depth).select(*step_key))
    steps = cut_lineage(reduce(DataFrame.unionByName, steps).join(met, pair, "left_semi"))

    walks = met.select(*pair).distinct().select(*pair, F.col("source").alias("node"), F.array("source").alias("path"))
    found = []
    while True:
        walks = cut_lineage(walks)
        found.append(walks.filter(F.col("node") == F.col("target")))
        walks = walks.filter(F.col("node") != F.col("target"))
        if walks.isEmpty():
            break
        moved = walks.join(steps, step_key)
        walks = moved.select(*pair, F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"))
    paths = reduce(DataFrame.unionByName, found)
    return paths.select(*pair, "path", (F.size("path") - 1).cast("bigint").alias("length"))


def _neighbours(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """Each row of `nodes` with the edges (a, b) that leave its node."""
    return nodes.join(both, F.col("node") == F.col("a"))


def lateral_movement(
    nodes: DataFrame, edges: DataFrame, min_count: int = LATERAL_MIN_COUNT, limit: int = LATERAL_LIMIT
) -> DataFrame:
    """The most used outgoing edges of each node, with what is known of their targets.

    The rank is cut before the join, and Spark cuts it to `limit` rows per source before the shuffle
    already, so that a busy source sends few rows.
    """
    order = Window.partitionBy("source").orderBy(F.desc("count"), "target", "edge_type")
    top = (
        edges.filter(F.col("count") > min_count)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= limit)
    )
    about = nodes.select(
        F.col("entity_id").alias("target"),
        F.col("name").alias("target_name"),
        F.col("entity_type").alias("target_type"),
        F.col("risk_score").alias("target_risk"),
    )
    return top.join(about, "target").select(
        F.col("source").alias("entity_id"),
        "target",
        "target_name",
        "target_type",
        F.col("edge_type").alias("relationship"),
        F.col("count").alias("access_count"),
        "target_risk",
    )


def clustering_coefficient(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of the pairs of a node's neighbours that are neighbours themselves.

    Every undirected edge is pointed from the end of lower degree to the end of higher degree (ids
    break ties). A node then has at most sqrt(2 * edges) outgoing edges however large its degree, so
    that its list of them is bounded; an edge meets the lists of its two ends and their common
    entries are its triangles. No pairs of neighbours are formed.
    """
    pairs = (
        edges.filter(F.col("source") != F.col("target"))
        .select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"))
        .distinct()
    )
    degrees = (
        pairs.select(F.explode(F.array("u", "v")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("k"))
    )
    ranked = (
        pairs.join(degrees.select(F.col("entity_id").alias("u"), F.col("k").alias("ku")), "u")
        .join(degrees.select(F.col("entity_id").alias("v"), F.col("k").alias("kv")), "v")
        .withColumn("_up", F.struct("ku", "u") < F.struct("kv", "v"))
    )
    pointed = cut_lineage(
        ranked.select(
            F.when(F.col("_up"), F.col("u")).otherwise(F.col("v")).alias("low"),
            F.when(F.col("_up"), F.col("v")).otherwise(F.col("u")).alias("high"),
        )
    )
    ahead = pointed.groupBy("low").agg(F.collect_list("high").alias("ahead"))
    # Only edges whose both ends point somewhere can close a triangle.
    met = (
        pointed.join(ahead, "low")
        .join(ahead.select(F.col("low").alias("high"), F.col("ahead").alias("ahead_of_high")), "high")
        .select("low", "high", F.array_intersect("ahead", "ahead_of_high").alias("third"))
        .filter(F.size("third") > 0)
    )
    # The two ends of the edge take one triangle per common entry, each entry takes one.
    credits = F.concat(
        F.array(
            F.struct(F.col("low").alias("entity_id"), F.size("third").cast("bigint").alias("t")),
            F.struct(F.col("high").alias("entity_id"), F.size("third").cast("bigint").alias("t")),
        ),
        F.transform("third", lambda x: F.struct(x.alias("entity_id"), F.lit(1).cast("bigint").alias("t"))),
    )
    triangles = met.select(F.inline(credits)).withColumn("k", F.lit(0).cast("bigint"))
    known = nodes.select("entity_id", F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("k"))
    per_degree = degrees.select("entity_id", F.lit(0).cast("bigint").alias("t"), "k")
    gathered = (
        known.unionByName(per_degree)
        .unionByName(triangles)
        .groupBy("entity_id")
        .agg(F.sum("t").alias("triangles"), F.sum("k").alias("degree"))
    )
    k = F.col("degree")
    value = F.when(k > 1, 2.0 * F.col("triangles") / (k * (k - 1))).otherwise(0.0)
    return gathered.select("entity_id", "degree", "triangles", value.alias("coefficient"))


def update_risk(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Set risk and time of known nodes from `updates` (entity_id, risk_score, updated_at)."""
    new = updates.select("entity_id", F.col("risk_score").alias("_risk"), F.col("updated_at").alias("_at"))
    return (
        nodes.join(new, "entity_id", "left")
        .withColumn("risk_score", F.coalesce("_risk", "risk_score"))
        .withColumn("last_seen", F.coalesce("_at", "last_seen"))
        .drop("_risk", "_at")
    )


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(
        edges.select(F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count")
    )
