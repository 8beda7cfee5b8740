"""The kept-up event table: a stream fills it, each event once, and days past retention go.

A batch of the stream writes only partitions of its own, named by the day and the batch, and overwrites them if it is
run again, so a restart neither loses nor repeats events. Ids are remembered while the watermark allows copies; rows
that come after it are dropped as late, so nothing is ever added to a day that is retired. Retiring removes whole
partitions by their names and reads no data; the rest of the oldest day is filtered when the table is read.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from watchmere.operators.windows import evict_old_events
from watchmere.schemas import WINDOW_SECONDS, as_timestamp
from watchmere.functions.columns import seconds_interval

DAY, BATCH = "event_date", "batch"


def fill_event_table(events: DataFrame, path: str, checkpoint: str, delay: str, every: str | None = None) -> StreamingQuery:
    """Start writing a stream of events to the table: every so often, or all there is now.

    `delay` says how far an event may lie behind the latest one that was seen before its batch.
    """
    unique = events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])

    def write(rows: DataFrame, number: int) -> None:
        dated = rows.withColumn(DAY, F.to_date("event_time")).withColumn(BATCH, F.lit(number))
        # Rows of a day meet in as many tasks as the day needs, not in a file per task and day.
        dated.repartition(DAY, F.pmod(F.xxhash64("event_id"), F.lit(8))).write.partitionBy(DAY, BATCH).mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(path)

    writer = unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rows_dropped_as_late(query: StreamingQuery) -> int:
    """Of the batches that the query still remembers."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def _days(spark: SparkSession, path: str) -> dict[date, object]:
    """The days of the table with their folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in files.listStatus(folder) if files.exists(folder) else []:
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{DAY}="):
            found[date.fromisoformat(name.split("=", 1)[1])] = status.getPath()
    return found


def retire_days(spark: SparkSession, path: str, as_of, max_age_seconds: int = max(WINDOW_SECONDS)) -> list[date]:
    """Remove the days that lie wholly past retention; returns them. May be run again at any time."""
    oldest = spark.range(1).select(F.to_date(as_timestamp(as_of) - seconds_interval(max_age_seconds))).first()[0]
    gone = []
    for day, folder in sorted(_days(spark, path).items()):
        if day < oldest:
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            gone.append(day)
    return gone


def read_event_table(
    spark: SparkSession, path: str, schema: StructType, as_of=None, max_age_seconds: int = max(WINDOW_SECONDS)
) -> DataFrame:
    """Events of the table with their day; with `as_of`, those under the retention rule."""
    held = StructType(schema.fields).add(DAY, "date").add(BATCH, "long")
    rows = spark.read.schema(held).parquet(path).drop(BATCH)
    return rows if as_of is None else evict_old_events(rows, as_of, max_age_seconds)
