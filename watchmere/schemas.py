"""Fixed vocabularies and the schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies of the event model.
EVENT_TYPES = (
    "login",
    "logout",
    "file_access",
    "file_delete",
    "file_modify",
    "network_connection",
    "dns_query",
    "process_create",
    "privilege_escalation",
    "data_exfiltration",
    "authentication_failure",
    "authentication_success",
    "configuration_change",
    "permission_change",
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
ALERT_STATUSES = ("new", "in_progress", "resolved", "false_positive", "closed")
ENTITY_TYPES = ("user", "host", "ip_address", "application", "service", "database")
ATTACK_TYPES = (
    "brute_force",
    "pass_the_hash",
    "lateral_movement",
    "data_exfiltration",
    "insider_threat",
    "zero_day",
    "credential_theft",
    "privilege_escalation",
    "unknown",
)
SOURCE_TYPES = ("windows", "linux", "cloudtrail", "dns", "ocsf")

# Trailing windows in seconds and times to live in seconds.
WINDOW_SECONDS = (3600, 86400, 604800)
FEATURE_TTL_SECONDS = 86400
BASELINE_TTL_SECONDS = 7 * 86400

LOCATION = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])

NORMALIZED_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("source_type", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("entity_id", T.StringType(), False),
        T.StructField("entity_type", T.StringType(), False),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("raw_message", T.StringType(), False),
        T.StructField("raw_data", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("process_id", T.StringType()),
        T.StructField("command_line", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("dns_query", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("isp", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
    ]
)

RAW_LOG = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("ingest_time", T.TimestampType()),
    ]
)


def as_timestamp(value) -> Column:
    """A timestamp literal from text such as '2024-01-31 00:00:00' (session zone), or a column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")
