"""The behavioural features of every entity over all trailing windows.

Two partial results, each keyed by (entity, window), make up the features:

* values: how often each value of a column occurs (counters, distinct counts, entropies, reciprocal
  edges), counted per (entity, window, column, value) first, so that a busy entity never gathers in
  one task;
* sequence: gaps and distances between consecutive events, over range-partitioned chunks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchmere.functions.columns import filled, haversine_km, ratio, zero_if_null
from watchmere.operators.sequence import CHUNK, chunk_window, with_chunks
from watchmere.operators.windows import in_windows, window_events
from watchmere.schemas import WINDOW_SECONDS, as_timestamp

# Feature names in their order, by family.
FAMILIES = {
    "frequency": (
        "login_count",
        "unique_hosts",
        "unique_ips",
        "failed_logins",
        "successful_logins",
        "file_access_count",
        "process_count",
        "dns_query_count",
        "network_connections",
        "avg_events_per_hour",
    ),
    "entropy": (
        "source_ip_entropy",
        "hostname_entropy",
        "event_type_entropy",
        "command_entropy",
        "dns_query_entropy",
    ),
    "geo": (
        "unique_countries",
        "unique_cities",
        "max_distance_km",
        "avg_distance_km",
        "velocity_score",
        "impossible_travel_count",
    ),
    "timeseries": (
        "events_per_minute",
        "events_per_hour",
        "night_activity_ratio",
        "weekend_activity_ratio",
        "periodicity_score",
        "burst_score",
    ),
    "graph": (
        "degree_centrality",
        "betweenness_centrality",
        "clustering_coefficient",
        "new_connections",
        "connection_diversity",
        "access_pattern_score",
    ),
}
FEATURE_NAMES = tuple(name for names in FAMILIES.values() for name in names)

# Thresholds of the features.
MIN_HOURS = 0.1
MIN_MINUTES = 0.1
IMPOSSIBLE_KMH = 1000.0
VELOCITY_CAP_KMH = 1000.0
BURST_EVENTS_PER_SECOND = 10.0
PERIODICITY_MIN_EVENTS = 10
NIGHT_START_HOUR = 22
NIGHT_END_HOUR = 6

# The text in an event type that each counter looks for.
TYPE_COUNTERS = {
    "login_count": "login",
    "failed_logins": "failure",
    "successful_logins": "success",
    "file_access_count": "file",
    "process_count": "process",
    "dns_query_count": "dns",
    "network_connections": "network",
}

KEYS = ["entity_id", "window_size"]


@dataclass(frozen=True)
class Family:
    """A feature family: which partial results it needs and how its features follow from them.

    `features` maps (partial column by name, window seconds) to a column per feature name. `aggregates` are partial results
    of the family's own: numbers aggregated over the events of an entity and window, by name; zero where there are none.
    """

    names: Sequence[str]
    features: Callable[[Callable[[str], Column], Column], dict[str, Column]]
    activity: Sequence[str] = ()
    distinct: Sequence[str] = ()
    entropies: Sequence[str] = ()
    links: bool = False
    gaps: bool = False
    places: bool = False
    aggregates: Mapping[str, Column] = field(default_factory=dict)


def _hours(window: Column) -> Column:
    return F.greatest(window / 3600.0, F.lit(MIN_HOURS))


def _frequency(part, window):
    out = {name: part(name) for name in TYPE_COUNTERS}
    out["unique_hosts"] = part("distinct_hostname")
    out["unique_ips"] = part("distinct_source_ip")
    out["avg_events_per_hour"] = part("n") / _hours(window)
    return out


def _entropy(part, window):
    columns = ("source_ip", "hostname", "event_type", "command_line", "dns_query")
    return dict(zip(FAMILIES["entropy"], [part(f"entropy_{column}") for column in columns]))


def _geo(part, window):
    farthest = part("distance_max")
    return {
        "unique_countries": part("distinct_country"),
        "unique_cities": part("distinct_city"),
        "max_distance_km": farthest,
        "avg_distance_km": zero_if_null(ratio(part("distance_sum"), part("distance_n"))),
        "velocity_score": F.least(farthest / _hours(window) / VELOCITY_CAP_KMH, F.lit(1.0)),
        "impossible_travel_count": part("impossible"),
    }


def _timeseries(part, window):
    n, gaps = part("n"), part("gap_n")
    mean = ratio(part("gap_sum"), gaps)
    variance = ratio(part("gap_m2"), gaps)
    regular = F.greatest(F.lit(0.0), 1 - F.least(ratio(F.sqrt(variance), mean), F.lit(1.0)))
    return {
        "events_per_minute": n / F.greatest(window / 60.0, F.lit(MIN_MINUTES)),
        "events_per_hour": n / _hours(window),
        "night_activity_ratio": zero_if_null(ratio(part("night"), n)),
        "weekend_activity_ratio": zero_if_null(ratio(part("weekend"), n)),
        "periodicity_score": zero_if_null(F.when(n >= PERIODICITY_MIN_EVENTS, regular)),
        "burst_score": F.least(n / F.greatest(window, F.lit(1)) / BURST_EVENTS_PER_SECOND, F.lit(1.0)),
    }


def _graph(part, window):
    hosts, ips, links = part("distinct_hostname"), part("distinct_source_ip"), part("links")
    nodes = hosts + ips
    possible = F.when(nodes > 1, nodes * (nodes - 1) / 2).otherwise(1.0)
    return {
        "degree_centrality": links / F.greatest(possible, F.lit(1.0)),
        "betweenness_centrality": hosts / F.greatest(ips, F.lit(1.0)),
        "clustering_coefficient": F.when(links >= 2, part("reciprocal") / links).otherwise(0.0),
        "new_connections": hosts,
        "connection_diversity": hosts / F.greatest(links, F.lit(1.0)),
        "access_pattern_score": zero_if_null(ratio(part("changes"), part("n"))),
    }


# Further families can be added under a new name, or be passed in place of one.
REGISTRY: dict[str, Family] = {
    "frequency": Family(
        FAMILIES["frequency"], _frequency, activity=("n", *TYPE_COUNTERS), distinct=("hostname", "source_ip")
    ),
    "entropy": Family(
        FAMILIES["entropy"],
        _entropy,
        entropies=("source_ip", "hostname", "event_type", "command_line", "dns_query"),
    ),
    "geo": Family(FAMILIES["geo"], _geo, distinct=("country", "city"), places=True),
    "timeseries": Family(FAMILIES["timeseries"], _timeseries, activity=("n", "night", "weekend"), gaps=True),
    "graph": Family(
        FAMILIES["graph"], _graph, activity=("n", "changes"), distinct=("hostname", "source_ip"), links=True
    ),
}


def _slot() -> Column:
    """Day or night, working day or weekend: four values."""
    hour = F.hour("event_time")
    night = F.when((hour >= NIGHT_START_HOUR) | (hour < NIGHT_END_HOUR), "night").otherwise("day")
    return F.concat_ws(" ", night, F.when(F.weekday("event_time") >= 5, "weekend").otherwise("week"))


def _activity_tests() -> dict[str, tuple[str, Column]]:
    """Counters that follow from value counts: name to (column, test of its value)."""
    value, kind = F.col("value"), F.lower("value")
    tests = {name: ("event_type", kind.contains(text)) for name, text in TYPE_COUNTERS.items()}
    tests["n"] = ("event_type", F.lit(True))
    tests["changes"] = ("event_type", kind.contains("delete") | kind.contains("modify"))
    tests["night"] = ("slot", value.startswith("night"))
    tests["weekend"] = ("slot", value.endswith("weekend"))
    return tests


def value_columns(activity: Sequence[str], distinct: Sequence[str], entropies: Sequence[str]) -> list[str]:
    """The columns whose values are counted."""
    counted = [column for name, (column, _) in _activity_tests().items() if name in activity]
    return list(dict.fromkeys([*counted, *distinct, *entropies]))


def value_counts(held: DataFrame, keys: Sequence[str], columns: Sequence[str], links: bool) -> DataFrame:
    """How often each value of a column occurs: (keys, dimension, value, c), with links also (ahead, loop).

    An edge (address, host) and its reverse share one value, the smaller end first, so that the
    number of reversed pairs follows from how many of its rows run each way.
    """
    columns = list(columns)
    source, target = filled("source_ip"), filled("hostname")
    special = {"event_type": F.coalesce("event_type", F.lit("")), "slot": _slot()}
    picked = [(special[c] if c in special else filled(c)).alias(c) for c in columns]
    if links:
        low, high = F.least(source, target), F.greatest(source, target)
        both = source.isNotNull() & target.isNotNull()
        # The length tells where the first end stops.
        edge = F.when(both, F.concat(F.length(low).cast("string"), F.lit(":"), low, high))
        picked += [edge.alias("edge"), (source < target).alias("forward"), (source == target).alias("loop")]
        columns.append("edge")
    carried = ["forward", "loop"] if links else []
    long = (
        held.select(*keys, *picked)
        .unpivot([*keys, *carried], columns, "dimension", "value")
        .filter(F.col("value").isNotNull())
    )
    ways = [F.count_if("forward").alias("ahead"), F.max("loop").alias("loop")] if links else []
    return long.groupBy(*keys, "dimension", "value").agg(F.count("*").alias("c"), *ways)


def from_value_counts(
    counts: DataFrame, activity: Sequence[str], distinct: Sequence[str], entropies: Sequence[str], links: bool
) -> DataFrame:
    """Counters, distinct counts, entropies and reciprocal edges of (entity, window) from its counts per value."""
    tests = {name: test for name, test in _activity_tests().items() if name in activity}
    c = F.col("c")
    out = [
        F.sum(F.when((F.col("dimension") == column) & test, c)).alias(name) for name, (column, test) in tests.items()
    ]
    out += [F.count_if(F.col("dimension") == name).alias(f"distinct_{name}") for name in distinct]
    for name in entropies:
        here = F.col("dimension") == name
        out.append(F.sum(F.when(here, c)).alias(f"total_{name}"))
        out.append(F.sum(F.when(here, c * F.log2(c.cast("double")))).alias(f"weighted_{name}"))
    if links:
        here, ahead = F.col("dimension") == "edge", F.col("ahead")
        pairs = F.when(F.col("loop"), c * (c - 1) / 2).otherwise((ahead * (c - ahead)).cast("double"))
        out += [F.sum(F.when(here, c)).alias("links"), F.sum(F.when(here, pairs)).alias("reciprocal")]
    gathered = counts.groupBy(*KEYS).agg(*out)
    # H = log2(N) - sum(c * log2(c)) / N
    bits = {}
    for name in entropies:
        total = F.col(f"total_{name}").cast("double")
        bits[f"entropy_{name}"] = F.greatest(F.log2(total) - ratio(F.col(f"weighted_{name}"), total), F.lit(0.0))
    gone = [f"{part}_{name}" for part in ("total", "weighted") for name in entropies]
    return gathered.withColumns(bits).drop(*gone) if bits else gathered


def _values(
    held: DataFrame, activity: Sequence[str], distinct: Sequence[str], entropies: Sequence[str], links: bool
) -> DataFrame:
    counts = value_counts(held, KEYS, value_columns(activity, distinct, entropies), links)
    return from_value_counts(counts, activity, distinct, entropies, links)


def _pair_terms(gaps: bool, places: bool) -> dict[str, tuple[Callable, Column]]:
    """Aggregates over pairs of consecutive rows: name to (aggregate, term of one pair).

    A row carries `gap` (seconds since the row before it), and `distance` and `hours` since the last
    row with a place if it has one itself; they are null where there is no such row.
    """
    terms: dict[str, tuple[Callable, Column]] = {}
    if gaps:
        gap = F.when(F.col("gap") > 0, F.col("gap"))
        terms["gap_n"] = (F.sum, F.when(gap.isNotNull(), 1))
        terms["gap_sum"] = (F.sum, gap)
    if places:
        distance = F.col("distance")
        terms["distance_n"] = (F.sum, F.when(distance.isNotNull(), 1))
        terms["distance_sum"] = (F.sum, distance)
        terms["distance_max"] = (F.max, distance)
        terms["impossible"] = (F.sum, F.when(distance / F.col("hours") > IMPOSSIBLE_KMH, 1))
    return terms


def _with_distance(rows: DataFrame) -> DataFrame:
    ends = [F.col(f"{at}.{x}") for at in ("place_before", "place") for x in ("lat", "lon")]
    hours = (F.unix_micros("place.event_time") - F.unix_micros("place_before.event_time")) / 3.6e9
    return rows.withColumns({"distance": haversine_km(*ends), "hours": F.greatest(hours, F.lit(MIN_HOURS))})


def _seconds(later: str, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def sequence_pieces(held: DataFrame, keys: Sequence[str], gaps: bool, places: bool) -> DataFrame:
    """One row per piece of a key's events in order of time: what its pairs add up to, and its two ends.

    Pieces are the chunks of range partitions. `inside_*` are sums over the pairs within a piece, of gaps also the
    sum of squares about their mean; ends are the first and last event and the first and last one with a place.
    """
    order = ["event_time", "event_id"]
    lat, lon = (F.coalesce(f"location.{x}", F.lit(0.0)).alias(x) for x in ("lat", "lon"))
    point = F.when(F.col("location").isNotNull(), F.struct(*order, lat, lon))
    slim = held.select(*keys, *order, *([point.alias("place")] if places else []))
    if places and not gaps:
        slim = slim.filter(F.col("place").isNotNull())
    inner = chunk_window(keys, order)
    rows = with_chunks(slim, keys, order)
    ends = [F.min(F.struct(*order)).alias("first_event"), F.max(F.struct(*order)).alias("last_event")]
    if gaps:
        rows = rows.withColumn("gap", _seconds("event_time", F.lag("event_time").over(inner)))
        gap = F.when(F.col("gap") > 0, F.col("gap"))
        ends.append((F.var_pop(gap) * F.count(gap)).alias("inside_gap_m2"))
    if places:
        earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
        rows = _with_distance(rows.withColumn("place_before", F.last("place", ignorenulls=True).over(earlier)))
        ends += [F.min("place").alias("place"), F.max("place").alias("last_place")]
    return (
        rows.groupBy(*keys, CHUNK)
        .agg(
            *[aggregate(term).alias(f"inside_{name}") for name, (aggregate, term) in _pair_terms(gaps, places).items()],
            *ends,
        )
        .drop(CHUNK)
    )


def from_pieces(pieces: DataFrame, gaps: bool, places: bool) -> DataFrame:
    """What the pairs of (entity, window) add up to, from its pieces, which must not overlap in time.

    Each piece's first event is set against the last one of the pieces before it: one row per piece. The squares of
    gaps about their mean are those of the pieces about theirs, and of the pieces' means about the whole one, so no
    large numbers are taken from each other.
    """
    terms = _pair_terms(gaps, places)
    along = Window.partitionBy(*KEYS).orderBy("first_event")
    seams = pieces
    if gaps:
        seams = seams.withColumn("gap", _seconds("first_event.event_time", F.lag("last_event.event_time").over(along)))
    if places:
        so_far = along.rowsBetween(Window.unboundedPreceding, -1)
        seams = _with_distance(seams.withColumn("place_before", F.last("last_place", ignorenulls=True).over(so_far)))
    m2 = {"gap_m2": "inside_gap_m2"} if gaps else {}
    both = seams.select(
        *KEYS,
        F.inline(
            F.array(
                F.struct(
                    *[F.col(f"inside_{name}").cast("double").alias(name) for name in terms],
                    *[F.col(column).alias(name) for name, column in m2.items()],
                ),
                F.struct(
                    *[term.cast("double").alias(name) for name, (_, term) in terms.items()],
                    *[F.lit(0.0).alias(name) for name in m2],
                ),
            )
        ),
    )
    out = [aggregate(name).alias(name) for name, (aggregate, _) in terms.items()]
    if gaps:
        whole = Window.partitionBy(*KEYS)
        mean = ratio(F.sum("gap_sum").over(whole), F.sum("gap_n").over(whole))
        apart = ratio(F.col("gap_sum"), F.col("gap_n")) - mean
        both = both.withColumn("gap_m2", F.col("gap_m2") + F.coalesce(F.col("gap_n") * apart * apart, F.lit(0.0)))
        out.append(F.sum("gap_m2").alias("gap_m2"))
    return both.groupBy(*KEYS).agg(*out)


def _sequence(held: DataFrame, gaps: bool, places: bool) -> DataFrame:
    """Sums over pairs of consecutive events: inside pieces first, then over the seams between them."""
    return from_pieces(sequence_pieces(held, KEYS, gaps, places), gaps, places)


def entity_spine(entities: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Every entity once per window, so that quiet ones get rows of zeros."""
    sizes = F.array(*[F.lit(w).cast("bigint") for w in sorted(windows)])
    return entities.select("entity_id").distinct().select("entity_id", F.explode(sizes).alias("window_size"))


def extract_features(
    events: DataFrame,
    as_of,
    windows: Sequence[int] = WINDOW_SECONDS,
    families: Sequence[str | Family] = tuple(FAMILIES),
    entities: DataFrame | None = None,
) -> DataFrame:
    """One row per entity and window with a DOUBLE column per feature, zeros where nothing happened.

    `entities` are all entities to report on, otherwise those that an event of the longest window
    names: older events are past retention and need not be read. The partial results are small by
    then: one row per entity and window.
    """
    needs = needed(families)
    held = in_windows(events, as_of, windows)
    parts = []
    if needs.counted:
        parts.append(_values(held, needs.activity, needs.distinct, needs.entropies, needs.links))
    if needs.gaps or needs.places:
        parts.append(_sequence(held, needs.gaps, needs.places))
    if needs.aggregates:
        parts.append(held.groupBy(*KEYS).agg(*[column.alias(name) for name, column in needs.aggregates.items()]))
    spine = entity_spine(entities if entities is not None else window_events(events, as_of, max(windows)), windows)
    return features_of(spine, parts, families)


@dataclass(frozen=True)
class Needs:
    """The partial results that some families need together."""

    activity: list[str]
    distinct: list[str]
    entropies: list[str]
    links: bool
    gaps: bool
    places: bool
    aggregates: dict[str, Column]

    @property
    def counted(self) -> bool:
        return bool(self.activity or self.distinct or self.entropies or self.links)


def family_of(family: str | Family) -> Family:
    return family if isinstance(family, Family) else REGISTRY[family]


def needed(families: Sequence[str | Family]) -> Needs:
    chosen = [family_of(family) for family in families]
    own = [(name, column) for family in chosen for name, column in family.aggregates.items()]
    twice = {name for name, times in Counter(name for name, _ in own).items() if times > 1}
    if twice:
        raise ValueError(f"families share names of aggregates: {sorted(twice)}")
    lists = (list(dict.fromkeys(x for family in chosen for x in getattr(family, kind))) for kind in ("activity", "distinct", "entropies"))
    return Needs(*lists, *(any(getattr(family, kind) for family in chosen) for kind in ("links", "gaps", "places")), dict(own))


def features_of(spine: DataFrame, parts: Sequence[DataFrame], families: Sequence[str | Family]) -> DataFrame:
    """The features of every row of the spine from the partial results of (entity, window)."""
    chosen = [family_of(family) for family in families]
    joined = reduce(lambda left, right: left.join(right, KEYS, "left"), parts, spine)
    partial = {c: zero_if_null(F.col(c)).alias(c) for part in parts for c in part.columns if c not in KEYS}
    filled_in = joined.select(*KEYS, *partial.values())
    values: dict[str, Column] = {}
    for family in chosen:
        values |= family.features(F.col, F.col("window_size"))
    return filled_in.select(
        *KEYS, *[values[name].cast("double").alias(name) for family in chosen for name in family.names]
    )


def flatten(long: DataFrame, windows: Sequence[int], names: Sequence[str]) -> DataFrame:
    """One row per entity with a column `w<seconds>_<feature>` per window and feature.

    The features of a window travel as one struct, so three aggregates do, not one per column.
    """
    windows = sorted(windows)
    row = F.struct(*names)
    wide = long.groupBy("entity_id").agg(*[F.max(F.when(F.col("window_size") == w, row)).alias(f"_{w}") for w in windows])
    return wide.select("entity_id", *[F.col(f"_{w}.{name}").alias(f"w{w}_{name}") for w in windows for name in names])


def flattened_features(
    events: DataFrame,
    as_of,
    windows: Sequence[int] = WINDOW_SECONDS,
    families: Sequence[str | Family] = tuple(FAMILIES),
    entities: DataFrame | None = None,
) -> DataFrame:
    names = [name for family in families for name in family_of(family).names]
    return flatten(extract_features(events, as_of, windows, families, entities), windows, names)


def flattened_names(windows: Sequence[int] = WINDOW_SECONDS, names: Sequence[str] = FEATURE_NAMES) -> list[str]:
    return [f"w{w}_{name}" for w in sorted(windows) for name in names]


def feature_vectors(long: DataFrame, as_of, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """The vector rows that the feature store keeps: a map of features with time and validity."""
    features = F.map_from_arrays(F.array(*[F.lit(name) for name in names]), F.array(*names))
    return long.select(
        "entity_id",
        as_timestamp(as_of).alias("timestamp"),
        "window_size",
        features.alias("features"),
        (F.size(features) > 0).alias("is_valid"),
    )


def feature_array(flat: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows `(row_key, features)` for the detectors, missing values being zero."""
    return flat.select(
        F.col("entity_id").alias("row_key"), F.array(*[zero_if_null(F.col(name)) for name in names]).alias("features")
    )
