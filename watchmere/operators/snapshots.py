"""A store table that is kept up: a compacted snapshot per day and bucket of keys, and the days written since.

Writes append to the log, partitioned by the day of writing. Compaction takes the snapshot before, the days of the log
up to a given one, and writes the newest row of every key as the snapshot of that day, in buckets by a hash of the key.
A read takes the last snapshot before its instant and the days of the log that follow it, whatever the log's age; a read
of few keys takes only their buckets. A row that has expired by the end of the day of a snapshot is not in it: it was the
newest of its key, and older ones do not come back.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.operators.store import append_rows, newest
from watchmere.operators.windows import by_day
from watchmere.schemas import as_timestamp

BUCKETS = 64
SNAPSHOT, BUCKET = "snapshot_date", "bucket"


class SnapshotTable:
    """The log under `path`/log and its snapshots under `path`/snapshots."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def bucket(self, entity: str = "entity_id") -> Column:
        """All rows of an entity are in one bucket, so that a lookup needs no other part of the key."""
        return F.pmod(F.xxhash64(F.col(entity).cast("string")), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame) -> None:
        append_rows(rows, f"{self.path}/log")

    def snapshots(self) -> list[date]:
        """The days that have a snapshot; only folder names are read."""
        try:
            table = self.spark.read.parquet(f"{self.path}/snapshots")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r[0] for r in table.select(F.col(SNAPSHOT)).distinct().collect())

    def _log(self, since: date | None, last: Column) -> DataFrame:
        """The days of the log after a snapshot, up to one."""
        first = None if since is None else F.date_add(F.lit(since), 1)
        log = self.spark.read.parquet(f"{self.path}/log")
        return by_day(log, "written_date", first, last).drop("written_date")

    def _snapshot(self, day: date, columns: Sequence[str]) -> DataFrame:
        """One snapshot; other ones' partitions are not read."""
        return self.spark.read.parquet(f"{self.path}/snapshots").filter(F.col(SNAPSHOT) == F.lit(day)).select(*columns, BUCKET)

    def _merged(self, before: date | None, last: Column) -> DataFrame:
        log = self._log(before, last)
        rows = log.withColumn(BUCKET, self.bucket())
        return rows if before is None else rows.unionByName(self._snapshot(before, log.columns))

    def compact(self, day) -> None:
        """Write the snapshot of a day, from the one before and the days since; writing it again replaces it."""
        day = date.fromisoformat(str(day))
        earlier = [d for d in self.snapshots() if d < day]
        rows = self._merged(earlier[-1] if earlier else None, F.lit(day))
        over = F.date_add(F.lit(day), 1).cast("timestamp")
        live = newest(rows, self.keys).filter(F.col("expires_at") > over)
        live.withColumn(SNAPSHOT, F.lit(day)).repartition(BUCKET).write.partitionBy(SNAPSHOT, BUCKET).mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(f"{self.path}/snapshots")

    def latest(self, as_of, entities: Sequence[str] | None = None) -> DataFrame:
        """The newest row per key that is live at an instant; of the named entities only, if some are."""
        now = as_timestamp(as_of)
        today = self.spark.range(1).select(F.to_date(now)).first()[0]
        earlier = [d for d in self.snapshots() if d < today]
        rows = self._merged(earlier[-1] if earlier else None, F.to_date(now)).filter(F.col("written_at") <= now)
        if entities is not None:
            numbers = self.spark.createDataFrame([(e,) for e in entities], "entity_id string").select(self.bucket()).distinct()
            rows = rows.filter(F.col(BUCKET).isin([r[0] for r in numbers.collect()]) & F.col("entity_id").isin(list(entities)))
        return newest(rows.drop(BUCKET), self.keys).filter(F.col("expires_at") > now)
