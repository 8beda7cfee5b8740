"""Deterministic projections of the given tables onto the tables that operators work on.

The text is SQL that Spark and other engines both read. Two spots differ between engines and are
left as fields: `@K` (reading one key of the JSON text in `props`) and `@D` (the suffix of a
double literal).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.sources.tables import read_table

SEC_EVENTS = """
SELECT 'evt_' || CAST(eid AS STRING) AS event_id,
       ts AS event_time,
       CASE eid % 5 WHEN 0 THEN 'windows' WHEN 1 THEN 'linux' WHEN 2 THEN 'cloudtrail' WHEN 3 THEN 'dns' ELSE 'ocsf' END AS source_type,
       CASE WHEN et = 'error' THEN 'authentication_failure'
            WHEN et = 'signup' AND k % 2 = 0 THEN 'login'
            WHEN et = 'signup' THEN 'authentication_success'
            WHEN et = 'purchase' AND k % 3 = 0 THEN 'file_access'
            WHEN et = 'purchase' AND k % 3 = 1 THEN 'file_modify'
            WHEN et = 'purchase' THEN 'data_exfiltration'
            WHEN et = 'view' AND k % 2 = 0 THEN 'dns_query'
            WHEN et = 'view' THEN 'network_connection'
            WHEN k % 4 = 0 THEN 'process_create'
            WHEN k % 4 = 1 THEN 'privilege_escalation'
            WHEN k % 4 = 2 THEN 'file_delete'
            ELSE 'logout' END AS event_type,
       'user:u' || CAST(user_id AS STRING) AS entity_id,
       'user' AS entity_type,
       'u' || CAST(user_id AS STRING) AS username,
       CASE WHEN k = 11 THEN '10.9.0.2' WHEN k = 12 THEN '10.9.0.1' WHEN k = 13 THEN '10.9.0.3'
            WHEN k % 10 = 0 THEN NULL ELSE 'host-' || CAST(k % 20 AS STRING) END AS hostname,
       CASE WHEN k = 11 THEN '10.9.0.1' WHEN k = 12 THEN '10.9.0.2' WHEN k = 13 THEN '10.9.0.3'
            WHEN k % 7 = 0 THEN NULL
            ELSE '10.0.' || CAST(user_id % 256 AS STRING) || '.' || CAST(k % 8 AS STRING) END AS source_ip,
       CASE WHEN et = 'click' AND k % 4 = 0 THEN 'cmd-' || CAST(k % 5 AS STRING) END AS command_line,
       CASE WHEN et = 'view' AND k % 2 = 0 THEN 'q' || CAST(k % 6 AS STRING) || '.example.com' END AS dns_query,
       CASE WHEN k % 3 = 0 THEN NULL WHEN k % 5 = 0 THEN 40.7128@D WHEN k % 5 = 1 THEN 51.5074@D WHEN k % 5 = 2 THEN 35.6762@D WHEN k % 5 = 3 THEN -33.8688@D ELSE -23.5505@D END AS lat,
       CASE WHEN k % 3 = 0 THEN NULL WHEN k % 5 = 0 THEN -74.0060@D WHEN k % 5 = 1 THEN -0.1278@D WHEN k % 5 = 2 THEN 139.6503@D WHEN k % 5 = 3 THEN 151.2093@D ELSE -46.6333@D END AS lon,
       CASE WHEN k % 3 = 0 THEN NULL WHEN k % 5 = 0 THEN 'New York' WHEN k % 5 = 1 THEN 'London' WHEN k % 5 = 2 THEN 'Tokyo' WHEN k % 5 = 3 THEN 'Sydney' ELSE 'Sao Paulo' END AS city,
       CASE WHEN k % 3 = 0 THEN NULL WHEN k % 5 = 0 THEN 'US' WHEN k % 5 = 1 THEN 'GB' WHEN k % 5 = 2 THEN 'JP' WHEN k % 5 = 3 THEN 'AU' ELSE 'BR' END AS country,
       CASE user_id % 5 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'IT' WHEN 2 THEN 'Finance' WHEN 3 THEN 'HR' ELSE 'Sales' END AS department,
       value, k, user_id, eid, et
FROM (SELECT event_id AS eid, ts, user_id, event_type AS et, value, CAST(@K AS INT) AS k FROM @events) b
"""

RAW_LOGS = """
SELECT event_id, event_time AS ingest_time, source_type, CASE source_type
 WHEN 'windows' THEN '{"source_type":"windows","EventID":"' || CASE WHEN k % 9 = 0 THEN '9999' WHEN et = 'error' THEN '4625' WHEN et = 'signup' THEN '4624' WHEN et = 'click' THEN '4688' WHEN et = 'purchase' THEN '4663' ELSE '4672' END
   || '","Computer":"' || coalesce(hostname, 'host-x') || '"'
   || CASE WHEN k % 8 = 0 THEN '' ELSE ',"SubjectUserName":"' || username || '"' END
   || CASE WHEN source_ip IS NULL THEN '' ELSE ',"IpAddress":"' || source_ip || '"' END || ',"Message":"m"}'
 WHEN 'linux' THEN '{"source_type":"linux","hostname":"' || coalesce(hostname, 'host-x') || '","message":"'
   || CASE WHEN et = 'error' THEN 'sshd[12]: Failed password for ' || username || ' from ' || coalesce(source_ip, 'console') || ' port 22'
           WHEN et = 'signup' THEN 'sshd[12]: Accepted password for ' || username || ' from ' || coalesce(source_ip, 'console') || ' port 22'
           WHEN et = 'click' THEN 'sudo: ' || username || ' : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls'
           WHEN et = 'purchase' THEN 'su: ' || username || ' to root on pts/0'
           ELSE 'kernel: link up' END || '"}'
 WHEN 'cloudtrail' THEN '{"source_type":"cloudtrail","eventName":"' || CASE et WHEN 'error' THEN 'AssumeRole' WHEN 'signup' THEN 'CreateUser' WHEN 'click' THEN 'GetObject' WHEN 'purchase' THEN 'PutObject' ELSE 'DescribeInstances' END
   || '","eventSource":"s3.amazonaws.com"' || CASE WHEN k % 13 = 0 THEN ',"userIdentity":null' WHEN k % 9 = 0 THEN ',"userIdentity":{}' ELSE ',"userIdentity":{"userName":"' || username || '"}' END
   || CASE WHEN source_ip IS NULL THEN '' ELSE ',"sourceIPAddress":"' || source_ip || '"' END || '}'
 WHEN 'dns' THEN '{"source_type":"dns"' || CASE WHEN hostname IS NULL THEN '' ELSE ',"hostname":"' || hostname || '"' END
   || CASE WHEN k % 2 = 0 THEN ',"query_name":"q' || CAST(k % 6 AS STRING) || '.example.com"' ELSE ',"query":"alt.example.com","type":"AAAA"' END || '}'
 ELSE '{"source_type":"ocsf","user_name":"' || username || '","activity_name":"' || event_type || '","entity_type":"' || CASE WHEN k % 11 = 0 THEN 'robot' ELSE 'user' END || '"}' END AS value
FROM @sec_events
"""

GRAPH_EDGE_EVENTS = """
SELECT entity_id AS source, 'host:' || hostname AS target, 'accessed' AS edge_type, event_time FROM @sec_events WHERE hostname IS NOT NULL
UNION ALL SELECT 'ip:' || source_ip, 'host:' || hostname, 'connected_to', event_time FROM @sec_events WHERE source_ip IS NOT NULL AND hostname IS NOT NULL
UNION ALL SELECT entity_id, 'ip:' || source_ip, 'connected_to', event_time FROM @sec_events WHERE source_ip IS NOT NULL
UNION ALL SELECT entity_id, 'dept:' || department, 'member_of', max(event_time) FROM @sec_events GROUP BY entity_id, department
"""

ENTITIES = """
SELECT entity_id, 'user' AS entity_type, max(username) AS name, max(department) AS department, min(event_time) AS first_seen, max(event_time) AS last_seen FROM @sec_events GROUP BY entity_id
"""

ALERTS = """
SELECT 'al-' || CAST(o_orderkey AS STRING) AS alert_id, o_orderdate AS event_time, 'user:u' || CAST(o_custkey AS STRING) AS entity_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'info' END AS severity,
       CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'new' WHEN o_orderstatus = 'O' THEN 'in_progress' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'false_positive' WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'closed' END AS status,
       CASE o_orderkey % 4 WHEN 0 THEN 'brute_force' WHEN 1 THEN 'lateral_movement' WHEN 2 THEN 'data_exfiltration' ELSE 'unknown' END AS attack_type,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '6' HOUR END AS resolved_at
FROM @orders
"""

FEEDBACK = """
SELECT 'fb-' || CAST(eid AS STRING) AS feedback_id, 'al-' || CAST(eid % 200 AS STRING) AS alert_id, event_time, (k % 3 <> 0) AS is_true_positive, 1 + k % 5 AS confidence FROM @sec_events
"""

MODEL_SCORES = """
SELECT entity_id, event_id, 'isolation_forest' AS model_name, least(value / 300, 1.0@D) AS anomaly_score FROM @sec_events
UNION ALL SELECT entity_id, event_id, 'autoencoder', CAST(k AS DOUBLE) / 99 FROM @sec_events
UNION ALL SELECT entity_id, event_id, 'boosted_trees', CASE WHEN et = 'error' THEN 0.9@D ELSE 0.2@D END FROM @sec_events
"""

ATTRIBUTIONS = """
SELECT entity_id, event_type AS feature, CAST(count(*) AS DOUBLE) AS score FROM @sec_events GROUP BY entity_id, event_type
"""

# One row per saved feature vector: what an entity did on one day, written when its last event came.
FEATURE_LOG = """
SELECT entity_id, CASE k % 3 WHEN 0 THEN 3600 WHEN 1 THEN 86400 ELSE 604800 END AS window_size, max(event_time) AS written_at,
       CAST(count(*) AS DOUBLE) AS login_count, CAST(max(k) AS DOUBLE) AS unique_hosts, CAST(min(k) AS DOUBLE) AS unique_ips
FROM @sec_events GROUP BY entity_id, CASE k % 3 WHEN 0 THEN 3600 WHEN 1 THEN 86400 ELSE 604800 END, CAST(event_time AS DATE)
"""

_MARKS = {
    "spark": {"@K": "get_json_object(props,'$.k')", "@D": "D"},
    "duckdb": {"@K": "json_extract_string(props,'$.k')", "@D": "::DOUBLE"},
}


def render(text: str, dialect: str) -> str:
    for mark, value in _MARKS[dialect].items():
        text = text.replace(mark, value)
    return text.strip()


def _project(text: str, **tables: DataFrame) -> DataFrame:
    """Run a projection over DataFrames, under view names that are gone again afterwards."""
    text = render(text, "spark")
    spark = next(iter(tables.values())).sparkSession
    views = {name: f"{name}_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, frame in tables.items():
            frame.createOrReplaceTempView(views[name])
            text = text.replace(f"@{name}", views[name])
        return spark.sql(text)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def sec_events_from(events: DataFrame) -> DataFrame:
    """Security events in the normalized schema, from the `events` table or a stream of it."""
    located = F.when(F.col("lat").isNotNull(), F.struct("lat", "lon"))
    return _project(SEC_EVENTS, events=events).withColumn("location", located)


def sec_events(spark: SparkSession, root: str) -> DataFrame:
    return sec_events_from(read_table(spark, root, "events"))


def raw_logs_from(events: DataFrame) -> DataFrame:
    return _project(RAW_LOGS, sec_events=sec_events_from(events))


def raw_logs(spark: SparkSession, root: str) -> DataFrame:
    return raw_logs_from(read_table(spark, root, "events"))


def entities(spark: SparkSession, root: str) -> DataFrame:
    return _project(ENTITIES, sec_events=sec_events(spark, root))


def alerts(spark: SparkSession, root: str) -> DataFrame:
    return _project(ALERTS, orders=read_table(spark, root, "orders"))


def feedback(spark: SparkSession, root: str) -> DataFrame:
    return _project(FEEDBACK, sec_events=sec_events(spark, root))


def attributions(spark: SparkSession, root: str) -> DataFrame:
    return _project(ATTRIBUTIONS, sec_events=sec_events(spark, root))


def feature_log(spark: SparkSession, root: str) -> DataFrame:
    return _project(FEATURE_LOG, sec_events=sec_events(spark, root))


def model_scores(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The three given scores of each event as long rows, with `columns` of the event, from one pass over the events."""
    scores = F.array(
        *[
            F.struct(F.lit(model).alias("model_name"), score.cast("double").alias("anomaly_score"))
            for model, score in (
                ("isolation_forest", F.least(F.col("value") / 300, F.lit(1.0))),
                ("autoencoder", F.col("k").cast("double") / 99),
                ("boosted_trees", F.when(F.col("et") == "error", 0.9).otherwise(0.2)),
            )
        ]
    )
    return sec_events(spark, root).select("entity_id", "event_id", *columns, F.inline(scores))


def feature_matrix(spark: SparkSession, root: str) -> DataFrame:
    """Rows `(row_key, features, label)`: the embedding columns, attack rows having label 1."""
    return read_table(spark, root, "embeddings").select(
        F.col("vec_id").alias("row_key"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") == 0).cast("int").alias("label"),
    )


def feature_matrix_names(width: int = 64) -> list[str]:
    return [f"f{i}" for i in range(width)]
