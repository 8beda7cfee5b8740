"""Features from stored partial results per entity and hour, merged into any trailing window.

For each whole hour three small tables are kept, partitioned by day: how often each value of a column occurs, what the
pairs of consecutive events of a piece add up to (with the mean and squared deviations of gaps, and the piece's two
ends), and HyperLogLog sketches of the values. All of them merge: counts add up, pieces are set one behind the other,
sketches unite. A refresh so reads the hours of a window and only those raw events that lie in an hour which the window
cuts at one of its ends, not the raw events of the whole window; the features are those of `extract_features`.

Hours are stored when they can no longer change, that is behind the watermark of the event table. Storing a span of
hours again replaces it. A busy entity's hour is cut into pieces like any other of its spans.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.functions.columns import filled, seconds_interval
from watchmere.operators.features import (
    FAMILIES,
    KEYS,
    entity_spine,
    features_of,
    from_pieces,
    from_value_counts,
    needed,
    sequence_pieces,
    value_columns,
    value_counts,
)
from watchmere.operators.windows import by_day
from watchmere.schemas import WINDOW_SECONDS, as_timestamp

HOUR_KEYS = ["entity_id", "hour"]
# Features that are distinct counts: the column each of them counts. The logarithm of a sketch's size in registers.
SKETCHED = {
    "unique_hosts": "hostname",
    "unique_ips": "source_ip",
    "unique_countries": "country",
    "unique_cities": "city",
    "new_connections": "hostname",
}
SKETCH_LOG = 12


def sketch_error(log: int = SKETCH_LOG) -> float:
    """Relative standard error of a sketch's estimate."""
    return 1.04 / 2 ** (log / 2)


def with_hour(events: DataFrame) -> DataFrame:
    return events.withColumn("hour", F.date_trunc("hour", "event_time"))


def hourly_values(events: DataFrame, families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    needs = needed(families)
    columns = value_columns(needs.activity, needs.distinct, needs.entropies)
    return value_counts(with_hour(events), HOUR_KEYS, columns, needs.links)


def hourly_pieces(events: DataFrame, families: Sequence[str] = tuple(FAMILIES)) -> DataFrame:
    needs = needed(families)
    return sequence_pieces(with_hour(events), HOUR_KEYS, needs.gaps, needs.places)


def sketches(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], log: int = SKETCH_LOG) -> DataFrame:
    """One sketch per key and column; values are sketched where the rows are."""
    return rows.groupBy(*keys).agg(*[F.hll_sketch_agg(filled(c), log).alias(c) for c in columns])


def hourly_sketches(events: DataFrame, log: int = SKETCH_LOG) -> DataFrame:
    return sketches(with_hour(events), HOUR_KEYS, list(dict.fromkeys(SKETCHED.values())), log)


MAKERS = {"values": hourly_values, "pieces": hourly_pieces, "sketches": hourly_sketches}


def store_hours(events: DataFrame, path: str, since, until, kinds: Sequence[str] = ("values", "pieces")) -> None:
    """Store the partial results of the whole hours from `since` up to `until`, both full hours."""
    first, last = as_timestamp(since), as_timestamp(until)
    held = by_day(events, "event_date", first, last).filter((F.col("event_time") >= first) & (F.col("event_time") < last))
    for kind in kinds:
        rows = MAKERS[kind](held)
        rows = rows.withColumns({"event_date": F.to_date("hour"), "since": F.unix_seconds(first)})
        rows.write.partitionBy("event_date", "since").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(
            f"{path}/{kind}"
        )


def read_hours(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{kind}").drop("since")


class Cut:
    """How windows that end at `as_of` are made of whole hours and of raw events at their ends."""

    def __init__(self, as_of, windows: Sequence[int]):
        self.windows = sorted(windows)
        self.end = as_timestamp(as_of)
        self.last_hour = F.date_trunc("hour", self.end)

    def start(self, window: int) -> Column:
        return self.end - seconds_interval(window)

    def first_hour(self, window: int) -> Column:
        start = self.start(window)
        hour = F.date_trunc("hour", start)
        return F.when(hour == start, hour).otherwise(hour + seconds_interval(3600))

    def _sized(self, holds) -> Column:
        sizes = [F.when(holds(w), F.lit(w).cast("bigint")) for w in self.windows]
        return F.explode(F.array_compact(F.array(*sizes))).alias("window_size")

    def hours(self, stored: DataFrame) -> DataFrame:
        """Stored rows once for each window that holds their hour whole."""
        held = by_day(stored, "event_date", self.start(self.windows[-1]), self.end).filter(F.col("hour") < self.last_hour)
        rows = held.select("*", self._sized(lambda w: F.col("hour") >= self.first_hour(w)))
        return rows.drop("event_date")

    def ends(self, events: DataFrame) -> DataFrame:
        """Raw events once for each window that holds them but not their whole hour."""
        rows = with_hour(events)
        time, hour = F.col("event_time"), F.col("hour")
        if "event_date" in events.columns:
            # Only the days that the windows begin and end in; a window that begins with an hour needs no raw events there.
            cut = [F.date_trunc("hour", self.start(w)) != self.start(w) for w in self.windows]
            days = [is_cut & (F.col("event_date") == F.to_date(self.start(w))) for is_cut, w in zip(cut, self.windows)]
            rows = rows.filter(reduce(lambda a, b: a | b, days, F.col("event_date") == F.to_date(self.end)))

        def cut_hour(w: int) -> Column:
            whole = (hour >= self.first_hour(w)) & (hour < self.last_hour)
            return (time >= self.start(w)) & (time <= self.end) & ~whole

        return rows.select("*", self._sized(cut_hour))


def features_from_hours(
    spark: SparkSession,
    path: str,
    events: DataFrame,
    as_of,
    windows: Sequence[int] = WINDOW_SECONDS,
    families: Sequence[str] = tuple(FAMILIES),
    entities: DataFrame | None = None,
) -> DataFrame:
    """What `extract_features` gives, from the stored hours and the events at the ends of the windows."""
    needs, cut = needed(families), Cut(as_of, windows)
    if needs.aggregates:
        raise ValueError(f"stored hours do not hold a family's own aggregates: {sorted(needs.aggregates)}")
    ends = cut.ends(events)
    parts, seen = [], []
    if needs.counted:
        columns = value_columns(needs.activity, needs.distinct, needs.entropies)
        stored = cut.hours(read_hours(spark, path, "values")).drop("hour")
        wanted = [*columns, "edge"] if needs.links else columns
        stored = stored.filter(F.col("dimension").isin(wanted))
        fresh = value_counts(ends, KEYS, columns, needs.links)
        ways = [F.sum("ahead").alias("ahead"), F.max("loop").alias("loop")] if needs.links else []
        both = stored.select(fresh.columns).unionByName(fresh)
        counts = both.groupBy(*KEYS, "dimension", "value").agg(F.sum("c").alias("c"), *ways)
        parts.append(from_value_counts(counts, needs.activity, needs.distinct, needs.entropies, needs.links))
        seen.append(both)
    if needs.gaps or needs.places:
        fresh = sequence_pieces(ends, [*KEYS, "hour"], needs.gaps, needs.places).drop("hour")
        stored = cut.hours(read_hours(spark, path, "pieces"))
        pieces = stored.select(fresh.columns).unionByName(fresh)
        parts.append(from_pieces(pieces, needs.gaps, needs.places))
        seen.append(pieces)
    if entities is None:
        entities = seen[-1].filter(F.col("window_size") == max(windows))
    return features_of(entity_spine(entities, windows), parts, families)


def distinct_estimates(
    spark: SparkSession, path: str, events: DataFrame, as_of, windows: Sequence[int] = WINDOW_SECONDS,
    log: int = SKETCH_LOG, everyone: bool = False,
) -> DataFrame:
    """(entity_id, window_size, feature, estimate) of the features that count distinct values, from united sketches.

    With `everyone`, sketches unite over all entities as well, and the entity is null.
    """
    cut = Cut(as_of, windows)
    columns = list(dict.fromkeys(SKETCHED.values()))
    stored = cut.hours(read_hours(spark, path, "sketches"))
    fresh = sketches(cut.ends(events), KEYS, columns, log)
    keys = ["window_size"] if everyone else KEYS
    united = stored.select(fresh.columns).unionByName(fresh).groupBy(*keys).agg(*[F.hll_union_agg(c).alias(c) for c in columns])
    rows = [
        F.struct(F.lit(name).alias("feature"), F.hll_sketch_estimate(column).alias("estimate")) for name, column in SKETCHED.items()
    ]
    entity = F.lit(None).cast("string").alias("entity_id") if everyone else F.col("entity_id")
    return united.select(entity, "window_size", F.inline(F.array(*rows)))
