"""Reading raw logs and writing normalized events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.operators.normalize import keyed_json
from watchmere.schemas import RAW_LOG

# Topics.
RAW_TOPIC = "raw_logs"
NORMALIZED_TOPIC = "normalized_events"

# Equal lines that are numbered in one array.
NUMBERED = 10_000


def kafka_raw_logs(spark: SparkSession, servers: str, topic: str = RAW_TOPIC, **options: str) -> DataFrame:
    """Raw logs from a Kafka topic, from its beginning; the query's checkpoint keeps the offsets.

    Needs the Kafka connector on the class path of the session.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    stream = reader.options(**options).load()
    place = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return stream.select(
        F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_time"), place.alias("record_place")
    )


def file_raw_logs(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Raw logs from JSON text files, one record per line, the file time being the ingest time.

    A record's place is its file and, among equal lines of that file, its number. A stream cannot count
    like that and takes the line's number instead; it reads each file as one row first, so files that
    are streamed must fit into a task's memory, as landing files do.
    """
    file = [F.col("_metadata.file_modification_time").alias("ingest_time"), F.col("_metadata.file_path").alias("_file")]
    if streaming:
        whole = spark.readStream.text(path, wholetext=True).select("value", *file)
        lines = whole.select("ingest_time", "_file", F.posexplode(F.split("value", "\r?\n")).alias("_line", "value"))
        lines = lines.filter(F.col("value") != "")
        number = F.col("_line")
    else:
        lines = spark.read.text(path).select("value", *file)
        # Equal lines of a file are equal rows: they are counted, with sums in the tasks that read them, and numbered
        # from their count in steps, so that a line repeated any number of times is never sorted or held at once.
        counted = lines.groupBy("_file", "value", "ingest_time").agg(F.count("*").alias("_n"))
        steps = F.sequence(F.lit(0), F.expr(f"(_n - 1) div {NUMBERED}").cast("int"))
        lines = counted.withColumn("_step", F.explode(steps))
        first = F.col("_step") * F.lit(NUMBERED).cast("bigint")
        lines = lines.withColumn("_line", F.explode(F.sequence(first + 1, F.least(F.col("_n"), first + NUMBERED))))
        number = F.col("_line")
    return lines.select("value", "ingest_time", F.concat_ws(":", "_file", number.cast("string")).alias("record_place"))


def table_raw_logs(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Raw logs from a parquet table of (value, source_type, ingest_time)."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(RAW_LOG).parquet(path)


def kafka_sink(events: DataFrame, servers: str, checkpoint: str, topic: str = NORMALIZED_TOPIC):
    """Start writing a stream of normalized events to Kafka, keyed by entity."""
    return (
        keyed_json(events)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.retries", "3")
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append events to a table partitioned by day, which window queries prune by."""
    events.withColumn("event_date", F.to_date("event_time")).write.mode(mode).partitionBy("event_date").parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
