"""Feature store semantics on tables: last write wins per key, rows expire, lookups are joins.

Writes append rows with `written_at`; reads take the newest row of each key that has not expired.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from watchmere.functions.columns import seconds_interval
from watchmere.operators.windows import by_day
from watchmere.schemas import BASELINE_TTL_SECONDS, FEATURE_TTL_SECONDS, as_timestamp


def stamped(rows: DataFrame, written_at=None, ttl_seconds: int = FEATURE_TTL_SECONDS) -> DataFrame:
    """Rows with the time they are written and the time they expire."""
    if written_at is not None:
        rows = rows.withColumn("written_at", as_timestamp(written_at))
    return rows.withColumn("expires_at", F.col("written_at") + seconds_interval(ttl_seconds))


def append_rows(rows: DataFrame, path: str) -> None:
    """Append stamped rows to a table partitioned by the day of writing, which reads prune by."""
    rows.withColumn("written_date", F.to_date("written_at")).write.mode("append").partitionBy("written_date").parquet(path)


def live_rows(rows: DataFrame, as_of, longest_ttl: int | None = None) -> DataFrame:
    """Rows written by `as_of` that have not expired; a row is gone at its very expiry."""
    now = as_timestamp(as_of)
    return written_by(rows, now, longest_ttl).filter(F.col("expires_at") > now)


def written_by(rows: DataFrame, now: Column, longest_ttl: int | None = None) -> DataFrame:
    """Rows written by now; with a longest time to live, days whose rows have all expired are not read."""
    first = None if longest_ttl is None else now - seconds_interval(longest_ttl)
    return by_day(rows, "written_date", first, now).filter(F.col("written_at") <= now)


def tie_breaker(rows: DataFrame) -> Column:
    """A number that depends on the whole row, so that of rows of one time always the same one comes first."""
    return F.xxhash64(*[f.name for f in rows.schema.fields if not isinstance(f.dataType, MapType)])


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row per key. Spark keeps one row per key on the sending side of the shuffle already."""
    order = Window.partitionBy(*keys).orderBy(F.desc("written_at"), tie_breaker(rows))
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")


def latest(rows: DataFrame, keys: Sequence[str], as_of, longest_ttl: int | None = None) -> DataFrame:
    """The newest row per key, if it is live: an older one does not come back when the newest expires.

    No row lives longer than `longest_ttl` seconds, if that is given, so on a table by days older ones are not read:
    where they are a key's newest, the key has no live row.
    """
    now = as_timestamp(as_of)
    return newest(written_by(rows, now, longest_ttl), keys).filter(F.col("expires_at") > now)


VECTOR_KEYS = ("entity_id", "window_size")


def latest_feature_vectors(rows: DataFrame, as_of, longest_ttl: int | None = None) -> DataFrame:
    return latest(rows, VECTOR_KEYS, as_of, longest_ttl)


def lookup_feature_vectors(rows: DataFrame, requests: DataFrame, as_of, longest_ttl: int | None = None) -> DataFrame:
    """Vectors for requests (entity_id, window_size); a null window asks for all of the entity's.

    Rows of entities that nobody asks for go before the newest are looked for.
    """
    wanted = requests.select("entity_id", F.col("window_size").alias("_window")).distinct()
    asked = rows.join(requests.select("entity_id").distinct(), "entity_id", "left_semi")
    found = latest_feature_vectors(asked, as_of, longest_ttl).join(wanted, "entity_id")
    match = F.col("_window").isNull() | (F.col("_window") == F.col("window_size"))
    return found.filter(match).drop("_window").distinct()


def latest_entity_behavior(rows: DataFrame, as_of, longest_ttl: int | None = None) -> DataFrame:
    return latest(rows, ["entity_id"], as_of, longest_ttl)


def latest_predictions(rows: DataFrame, as_of, longest_ttl: int | None = None) -> DataFrame:
    return latest(rows, ["entity_id", "model_name"], as_of, longest_ttl)


def store_entity_ids(rows: DataFrame, as_of, longest_ttl: int | None = None) -> DataFrame:
    """Entities that have live features."""
    return live_rows(rows, as_of, longest_ttl).select("entity_id").distinct()


def baseline_features(vectors: DataFrame, written_at, version: int = 1) -> DataFrame:
    """Cold-start baselines per entity, kept seven times as long as features."""
    return stamped(vectors.withColumn("version", F.lit(version)), written_at, BASELINE_TTL_SECONDS)


def population_baseline(vectors: DataFrame, entities: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of every feature per department and window, as long rows.

    One wide aggregate per department, unfolded afterwards; departments are few, and each task sends
    one partial row per department.
    """
    wide = (
        vectors.join(entities.select("entity_id", "department"), "entity_id")
        .groupBy("department", "window_size")
        .agg(
            F.count("*").alias("members"),
            *[F.avg(name).alias(f"mean_{name}") for name in names],
            *[F.stddev_pop(name).alias(f"std_{name}") for name in names],
        )
    )
    rows = [
        F.struct(F.lit(name).alias("feature"), F.col(f"mean_{name}").alias("mean"), F.col(f"std_{name}").alias("std"))
        for name in names
    ]
    return wide.select("department", "window_size", "members", F.inline(F.array(*rows)))


def cold_start_features(
    entities: DataFrame, vectors: DataFrame, baseline: DataFrame, names: Sequence[str], window_size: int
) -> DataFrame:
    """Each entity's features in one window, or its department's mean where it has none of its own.

    `baseline` has (department, window_size, feature, mean) rows.
    """
    means = baseline.filter(F.col("window_size") == window_size).groupBy("department").agg(
        *[F.max(F.when(F.col("feature") == name, F.col("mean"))).alias(f"_{name}") for name in names]
    )
    own = vectors.filter(F.col("window_size") == window_size).select("entity_id", *names)
    return (
        entities.select("entity_id", "department")
        .join(own, "entity_id", "left")
        .join(means, "department", "left")
        .select("entity_id", *[F.coalesce(F.col(name), F.col(f"_{name}")).alias(name) for name in names])
    )


def delete_entities(rows: DataFrame, doomed: DataFrame) -> DataFrame:
    """Rows of any store table without those of the deleted entities."""
    return rows.join(doomed.select("entity_id"), "entity_id", "left_anti")
