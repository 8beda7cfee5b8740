"""Readers for the given parquet tables, each with a stated schema.

Stating the schema saves the inference pass and reads the zone-less timestamps of the files as
TIMESTAMP, so that time filters reach the parquet scan and event times can carry watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP, o_orderpriority STRING"
    ),
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(table_path(root, name))


def stream_table(spark: SparkSession, root: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a file stream."""
    reader = spark.readStream.schema(SCHEMAS[name])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{root.rstrip('/')}/{name}*.parquet")
