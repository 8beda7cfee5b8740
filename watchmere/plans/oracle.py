"""The same queries in DuckDB SQL, written from the definitions and not from the Spark plans.

Features are computed per window over repeated events, reciprocal edges by a pair loop, triangles by
a three-way join: slow but plain.
"""

from __future__ import annotations

from watchmere.schemas import NORMALIZED_EVENT
from watchmere.sources import projections as P

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
DAY_OF_ALERTS = "TIMESTAMP '2001-07-31 00:00:00'"

# Named subqueries: text and the names it needs.
_TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "sec_events": (P.SEC_EVENTS, ()),
    "raw_logs": (P.RAW_LOGS, ("sec_events",)),
    "graph_edge_events": (P.GRAPH_EDGE_EVENTS, ("sec_events",)),
    "entities": (P.ENTITIES, ("sec_events",)),
    "alerts": (P.ALERTS, ()),
    "feedback": (P.FEEDBACK, ("sec_events",)),
    "model_scores": (P.MODEL_SCORES, ("sec_events",)),
    "attributions": (P.ATTRIBUTIONS, ("sec_events",)),
    "feature_log": (P.FEATURE_LOG, ("sec_events",)),
}

# Normalization, one row per record with its reject reason.
_TABLES["records"] = (
    """
SELECT *, json_extract_string(value, '$.EventID') AS code, json_extract_string(value, '$.message') AS line,
       json_extract_string(value, '$.eventName') AS ename, json_extract_string(value, '$.userIdentity.userName') AS cuser,
       CASE WHEN json_type(value, '$.SubjectUserName') IS NOT NULL THEN json_extract_string(value, '$.SubjectUserName')
            ELSE json_extract_string(value, '$.TargetUserName') END AS wuser,
       CASE WHEN json_type(value, '$.query_name') IS NOT NULL THEN json_extract_string(value, '$.query_name')
            ELSE json_extract_string(value, '$.query') END AS qname,
       CASE WHEN json_type(value, '$.query_type') IS NOT NULL THEN json_extract_string(value, '$.query_type')
            WHEN json_type(value, '$.type') IS NOT NULL THEN json_extract_string(value, '$.type') ELSE 'A' END AS qtype
FROM @raw_logs
""",
    ("raw_logs",),
)
_TABLES["typed"] = (
    r"""
SELECT *, CASE source_type
  WHEN 'windows' THEN CASE WHEN code IN ('4624', '4648') THEN 'login' WHEN code = '4625' THEN 'authentication_failure'
       WHEN code = '4634' THEN 'logout' WHEN code = '4672' THEN 'privilege_escalation' WHEN code = '4688' THEN 'process_create'
       WHEN code IN ('4663', '4656') THEN 'file_access' WHEN code = '4670' THEN 'permission_change' END
  WHEN 'linux' THEN CASE WHEN regexp_matches(line, 'sshd\[\d+\]: Accepted password for (\w+)') THEN 'login'
       WHEN regexp_matches(line, 'sshd\[\d+\]: Failed password for (\w+)') THEN 'authentication_failure'
       WHEN regexp_matches(line, 'sudo: (\w+) : TTY=.* ; COMMAND=(.+)') THEN 'privilege_escalation'
       WHEN regexp_matches(line, 'su: (\w+) to (\w+) on') THEN 'privilege_escalation'
       WHEN regexp_matches(line, 'process\[\d+\]: (.+)') THEN 'process_create' END
  WHEN 'cloudtrail' THEN CASE WHEN contains(ename, 'AssumeRole') OR contains(ename, 'GetCallerIdentity') THEN 'login'
       WHEN contains(ename, 'PutObject') OR contains(ename, 'GetObject') THEN 'file_access'
       WHEN contains(ename, 'CreateUser') OR contains(ename, 'ModifyDBInstance') THEN 'configuration_change'
       ELSE 'network_connection' END
  WHEN 'dns' THEN 'dns_query'
  ELSE json_extract_string(value, '$.activity_name') END AS etype,
 CASE source_type WHEN 'windows' THEN wuser WHEN 'cloudtrail' THEN cuser WHEN 'ocsf' THEN json_extract_string(value, '$.user_name')
  WHEN 'linux' THEN nullif(coalesce(nullif(regexp_extract(line, 'password for (\w+)', 1), ''),
                           nullif(regexp_extract(line, 'sudo: (\w+) :', 1), ''), regexp_extract(line, 'su: (\w+) to', 1)), '') END AS uname
FROM @records
""",
    ("records",),
)
_TABLES["outcomes"] = (
    r"""
SELECT event_id, ingest_time AS event_time, source_type, etype AS event_type,
 CASE WHEN source_type IN ('windows', 'linux') AND uname IS NOT NULL THEN 'user:' || uname
      WHEN source_type = 'windows' THEN 'host:' || json_extract_string(value, '$.Computer')
      WHEN source_type = 'linux' THEN 'host:' || json_extract_string(value, '$.hostname')
      WHEN source_type = 'cloudtrail' AND uname IS NOT NULL THEN 'user:' || uname
      WHEN source_type = 'cloudtrail' THEN 'service:' || json_extract_string(value, '$.eventSource')
      WHEN source_type = 'dns' THEN 'host:' || coalesce(json_extract_string(value, '$.hostname'), 'unknown')
      ELSE uname END AS entity_id,
 CASE WHEN source_type IN ('windows', 'linux') THEN CASE WHEN uname IS NOT NULL THEN 'user' ELSE 'host' END
      WHEN source_type = 'cloudtrail' THEN CASE WHEN uname IS NOT NULL THEN 'user' ELSE 'application' END
      WHEN source_type = 'dns' THEN 'host' ELSE json_extract_string(value, '$.entity_type') END AS entity_type,
 CASE source_type WHEN 'windows' THEN json_extract_string(value, '$.IpAddress')
      WHEN 'linux' THEN nullif(regexp_extract(line, 'from (\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})', 1), '')
      WHEN 'cloudtrail' THEN json_extract_string(value, '$.sourceIPAddress') END AS source_ip,
 CASE source_type WHEN 'windows' THEN json_extract_string(value, '$.Computer')
      WHEN 'cloudtrail' THEN json_extract_string(value, '$.eventSource') ELSE json_extract_string(value, '$.hostname') END AS hostname,
 uname AS username,
 CASE source_type WHEN 'windows' THEN json_extract_string(value, '$.Message') WHEN 'linux' THEN line
      WHEN 'dns' THEN qtype || ' ' || qname ELSE '' END AS raw_message,
 CASE WHEN source_type = 'dns' THEN qname END AS dns_query,
 CASE WHEN source_type = 'windows' AND etype IS NULL THEN 'unmapped_code' WHEN source_type = 'linux' AND etype IS NULL THEN 'no_pattern'
      WHEN source_type = 'cloudtrail' AND json_type(value, '$.userIdentity') = 'NULL' THEN 'no_identity'
      WHEN source_type = 'ocsf' AND json_extract_string(value, '$.entity_type') NOT IN ('user', 'host', 'ip_address', 'application', 'service', 'database')
      THEN 'invalid_entity_type' END AS reject_reason,
 value
FROM @typed
""",
    ("typed",),
)

# Features, one row per entity and window; events are repeated per window.
_TABLES["win"] = ("SELECT unnest([3600, 86400, 604800])::BIGINT AS w", ())
_TABLES["wev"] = (
    f"""
SELECT e.*, win.w AS w FROM @sec_events e, @win win
WHERE event_time >= {AS_OF} - to_seconds(win.w) AND event_time <= {AS_OF}
""",
    ("sec_events", "win"),
)
_TABLES["spine"] = ("SELECT DISTINCT e.entity_id, win.w AS w FROM @wev e, @win win", ("wev", "win"))
_TABLES["f_counts"] = (
    """
SELECT entity_id, w, count(*) AS n,
 count(*) FILTER (contains(event_type, 'login')) AS login_count, count(DISTINCT hostname) AS unique_hosts, count(DISTINCT source_ip) AS unique_ips,
 count(*) FILTER (contains(event_type, 'failure')) AS failed_logins, count(*) FILTER (contains(event_type, 'success')) AS successful_logins,
 count(*) FILTER (contains(event_type, 'file')) AS file_access_count, count(*) FILTER (contains(event_type, 'process')) AS process_count,
 count(*) FILTER (contains(event_type, 'dns')) AS dns_query_count, count(*) FILTER (contains(event_type, 'network')) AS network_connections,
 count(DISTINCT country) AS unique_countries, count(DISTINCT city) AS unique_cities,
 count(*) FILTER (hour(event_time) >= 22 OR hour(event_time) < 6) AS night, count(*) FILTER (isodow(event_time) >= 6) AS weekend,
 count(*) FILTER (contains(event_type, 'delete') OR contains(event_type, 'modify')) AS changes,
 count(*) FILTER (source_ip IS NOT NULL AND hostname IS NOT NULL) AS links
FROM @wev GROUP BY entity_id, w
""",
    ("wev",),
)
_TABLES["f_vals"] = (
    """
SELECT entity_id, w, 'source_ip' AS d, source_ip AS v FROM @wev UNION ALL SELECT entity_id, w, 'hostname', hostname FROM @wev
UNION ALL SELECT entity_id, w, 'event_type', event_type FROM @wev UNION ALL SELECT entity_id, w, 'command', command_line FROM @wev
UNION ALL SELECT entity_id, w, 'dns_query', dns_query FROM @wev
""",
    ("wev",),
)
_TABLES["f_probs"] = (
    """
SELECT entity_id, w, d, c / sum(c) OVER (PARTITION BY entity_id, w, d) AS p
FROM (SELECT entity_id, w, d, v, count(*)::DOUBLE AS c FROM @f_vals WHERE v IS NOT NULL GROUP BY ALL) x
""",
    ("f_vals",),
)
_TABLES["f_bits"] = (
    """
SELECT entity_id, w, """
    + ", ".join(
        f"-sum(p * log2(p)) FILTER (d = '{d}') AS h_{d}" for d in ("source_ip", "hostname", "event_type", "command", "dns_query")
    )
    + """ FROM @f_probs GROUP BY entity_id, w
""",
    ("f_probs",),
)
_HAVERSINE = (
    "2 * 6371 * atan2(sqrt({a}), sqrt(1 - {a}))".format(
        a="(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))"
    )
)
_TABLES["f_moves"] = (
    f"""
SELECT entity_id, w, {_HAVERSINE} AS dist, greatest((epoch_us(event_time) - epoch_us(pt)) / 3.6e9, 0.1) AS hours
FROM (SELECT *, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon, lag(event_time) OVER o AS pt FROM @wev WHERE lat IS NOT NULL
      WINDOW o AS (PARTITION BY entity_id, w ORDER BY event_time, event_id)) x WHERE plat IS NOT NULL
""",
    ("wev",),
)
_TABLES["f_geo"] = (
    """
SELECT entity_id, w, max(dist) AS far, avg(dist) AS mean_far, count(*) FILTER (dist / hours > 1000) AS impossible FROM @f_moves GROUP BY entity_id, w
""",
    ("f_moves",),
)
_TABLES["f_gaps"] = (
    """
SELECT entity_id, w, avg(gap) AS mean_gap, stddev_pop(gap) AS std_gap
FROM (SELECT entity_id, w, (epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY entity_id, w ORDER BY event_time, event_id)) / 1e6 AS gap FROM @wev) x
WHERE gap > 0 GROUP BY entity_id, w
""",
    ("wev",),
)
_TABLES["f_pairs"] = (
    """
SELECT a.entity_id, a.w, count(*) AS pairs
FROM (SELECT * FROM @wev WHERE source_ip IS NOT NULL AND hostname IS NOT NULL) a
JOIN (SELECT * FROM @wev WHERE source_ip IS NOT NULL AND hostname IS NOT NULL) b
  ON a.entity_id = b.entity_id AND a.w = b.w AND a.eid < b.eid AND a.source_ip = b.hostname AND a.hostname = b.source_ip
GROUP BY a.entity_id, a.w
""",
    ("wev",),
)
_TABLES["f_all"] = (
    """
SELECT s.entity_id, s.w, coalesce(c.n, 0) AS n, greatest(s.w / 3600.0, 0.1)::DOUBLE AS hours, c.*  EXCLUDE (entity_id, w, n),
 b.* EXCLUDE (entity_id, w), g.* EXCLUDE (entity_id, w), t.* EXCLUDE (entity_id, w), p.pairs
FROM @spine s LEFT JOIN @f_counts c ON s.entity_id = c.entity_id AND s.w = c.w
LEFT JOIN @f_bits b ON s.entity_id = b.entity_id AND s.w = b.w LEFT JOIN @f_geo g ON s.entity_id = g.entity_id AND s.w = g.w
LEFT JOIN @f_gaps t ON s.entity_id = t.entity_id AND s.w = t.w LEFT JOIN @f_pairs p ON s.entity_id = p.entity_id AND s.w = p.w
""",
    ("spine", "f_counts", "f_bits", "f_geo", "f_gaps", "f_pairs"),
)

_FEATURE_SQL = {
    "frequency": {
        **{
            name: name
            for name in (
                "login_count",
                "unique_hosts",
                "unique_ips",
                "failed_logins",
                "successful_logins",
                "file_access_count",
                "process_count",
                "dns_query_count",
                "network_connections",
            )
        },
        "avg_events_per_hour": "n / hours",
    },
    "entropy": {
        "source_ip_entropy": "h_source_ip",
        "hostname_entropy": "h_hostname",
        "event_type_entropy": "h_event_type",
        "command_entropy": "h_command",
        "dns_query_entropy": "h_dns_query",
    },
    "geo": {
        "unique_countries": "unique_countries",
        "unique_cities": "unique_cities",
        "max_distance_km": "far",
        "avg_distance_km": "mean_far",
        "velocity_score": "CASE WHEN far IS NULL THEN 0 ELSE least(far / hours / 1000, 1) END",
        "impossible_travel_count": "impossible",
    },
    "timeseries": {
        "events_per_minute": "n / greatest(w / 60.0, 0.1)::DOUBLE",
        "events_per_hour": "n / hours",
        "night_activity_ratio": "CASE WHEN n > 0 THEN night / n END",
        "weekend_activity_ratio": "CASE WHEN n > 0 THEN weekend / n END",
        "periodicity_score": "CASE WHEN n >= 10 AND mean_gap IS NOT NULL THEN greatest(0, 1 - least(std_gap / mean_gap, 1)) END",
        "burst_score": "least(n / w / 10, 1)",
    },
    "graph": {
        "degree_centrality": "coalesce(links, 0) / greatest(CASE WHEN unique_hosts + unique_ips > 1 THEN (unique_hosts + unique_ips) * (unique_hosts + unique_ips - 1) / 2 ELSE 1 END, 1)",
        "betweenness_centrality": "unique_hosts / greatest(unique_ips, 1)",
        "clustering_coefficient": "CASE WHEN links >= 2 THEN coalesce(pairs, 0) / links END",
        "new_connections": "unique_hosts",
        "connection_diversity": "unique_hosts / greatest(links, 1)",
        "access_pattern_score": "CASE WHEN n > 0 THEN changes / n END",
    },
}


def _feature_columns(*families: str) -> str:
    parts = [(name, text) for family in families for name, text in _FEATURE_SQL[family].items()]
    return ", ".join(f"round(coalesce(({text})::DOUBLE, 0), 6) + 0.0 AS {name}" for name, text in parts)


_ALL = tuple(_FEATURE_SQL)
_TABLES["f_long"] = (f"SELECT entity_id, w AS window_size, n, {_feature_columns(*_ALL)} FROM @f_all", ("f_all",))

# Graph.
_TABLES["nodes"] = (
    """
SELECT entity_id, split_part(entity_id, ':', 1) AS entity_type, substr(entity_id, instr(entity_id, ':') + 1) AS name, 0.0::DOUBLE AS risk_score,
       min(event_time) AS first_seen, max(event_time) AS last_seen
FROM (SELECT source AS entity_id, event_time FROM @graph_edge_events UNION ALL SELECT target, event_time FROM @graph_edge_events) x GROUP BY entity_id
""",
    ("graph_edge_events",),
)
_TABLES["edges"] = (
    """
SELECT source, target, edge_type, count(*) AS "count", count(*)::DOUBLE AS weight, max(event_time) AS last_seen
FROM @graph_edge_events GROUP BY source, target, edge_type
""",
    ("graph_edge_events",),
)
_TABLES["both"] = (
    "SELECT source AS a, target AS b, edge_type FROM @edges WHERE source <> target UNION ALL SELECT target, source, edge_type FROM @edges WHERE source <> target",
    ("edges",),
)
_TABLES["hop1"] = (
    "SELECT a AS entity_id, b AS neighbor_id, 1::BIGINT AS hop, string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) AS relationship_types FROM @both GROUP BY a, b",
    ("both",),
)
_SEED = "user:u1"
_TABLES["from1"] = (f"SELECT * FROM @hop1 WHERE entity_id = '{_SEED}'", ("hop1",))
for _hop in (2, 3):
    _before = " UNION ALL ".join(f"SELECT neighbor_id FROM @from{i}" for i in range(1, _hop))
    _TABLES[f"from{_hop}"] = (
        f"""
SELECT f.entity_id, b.b AS neighbor_id, {_hop}::BIGINT AS hop, string_agg(DISTINCT b.edge_type, ',' ORDER BY b.edge_type) AS relationship_types
FROM @from{_hop - 1} f JOIN @both b ON f.neighbor_id = b.a WHERE b.b <> f.entity_id AND b.b NOT IN ({_before}) GROUP BY f.entity_id, b.b
""",
        ("both", *(f"from{i}" for i in range(1, _hop))),
    )
_TABLES["path0"] = (f"SELECT '{_SEED}' AS target, ['{_SEED}'] AS path", ())
_PATH_DEPTH = 7
for _hop in range(1, _PATH_DEPTH + 1):
    _before = " UNION ALL ".join(f"SELECT target FROM @path{i}" for i in range(_hop))
    _TABLES[f"path{_hop}"] = (
        f"SELECT b.b AS target, min(list_append(p.path, b.b)) AS path FROM @path{_hop - 1} p JOIN @both b ON p.target = b.a WHERE b.b NOT IN ({_before}) GROUP BY b.b",
        ("both", *(f"path{i}" for i in range(_hop))),
    )
_TABLES["pairs"] = (
    """
SELECT f.source, e.entity_id AS target FROM @entities e
JOIN (SELECT department, min(entity_id) AS source FROM @entities GROUP BY department) f ON e.department = f.department
""",
    ("entities",),
)
_TABLES["way0"] = ("SELECT DISTINCT source, source AS target, [source] AS path FROM @pairs", ("pairs",))
for _hop in range(1, _PATH_DEPTH + 1):
    _before = " UNION ALL ".join(f"SELECT source, target FROM @way{i}" for i in range(_hop))
    _TABLES[f"way{_hop}"] = (
        f"""SELECT p.source, b.b AS target, min(list_append(p.path, b.b)) AS path FROM @way{_hop - 1} p JOIN @both b ON p.target = b.a
        WHERE (p.source, b.b) NOT IN ({_before}) GROUP BY p.source, b.b""",
        ("both", *(f"way{i}" for i in range(_hop))),
    )
_TABLES["simple"] = (
    "SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM @edges WHERE source <> target",
    ("edges",),
)

# Deliveries of a stream: ten days each, some rows three deliveries late, some twice. What comes after the watermark,
# the latest time of the deliveries before the last one less two days, is late.
_TABLES["deliveries"] = (
    """
SELECT event_id, event_time, entity_id, unnest(CASE eid % 10 WHEN 3 THEN [d + 3] WHEN 7 THEN [d, d + 1] ELSE [d] END) AS delivery
FROM (SELECT *, date_diff('day', DATE '2024-01-01', CAST(event_time AS DATE)) // 10 AS d FROM @sec_events) x
""",
    ("sec_events",),
)
_TABLES["accepted_events"] = (
    """
SELECT DISTINCT event_id, event_time, entity_id FROM @deliveries d
WHERE NOT EXISTS (SELECT 1 FROM @deliveries b WHERE b.delivery <= d.delivery - 2 AND b.event_time >= d.event_time + INTERVAL 2 DAY)
""",
    ("deliveries",),
)
_TABLES["failure_sessions"] = (
    """
SELECT entity_id, min(event_time) AS session_start, max(event_time) + INTERVAL 1 HOUR AS session_end, count(*) AS failures
FROM (SELECT *, sum(fresh) OVER (PARTITION BY entity_id ORDER BY event_time, event_id) AS session
      FROM (SELECT *, CASE WHEN event_time < lag(event_time) OVER (PARTITION BY entity_id ORDER BY event_time, event_id) + INTERVAL 1 HOUR
                      THEN 0 ELSE 1 END AS fresh FROM @sec_events WHERE event_type = 'authentication_failure') x) y
GROUP BY entity_id, session HAVING count(*) >= 2
""",
    ("sec_events",),
)

# Scores.
_TABLES["predictions"] = (
    """
SELECT entity_id, model_name, avg(anomaly_score) AS anomaly_score, avg(CASE WHEN anomaly_score > 0.5 THEN 1.0 ELSE 0.0 END) > 0.5 AS is_anomaly
FROM @model_scores GROUP BY entity_id, model_name
""",
    ("model_scores",),
)
_TABLES["ensemble"] = (
    """
SELECT entity_id, avg(anomaly_score) AS final_score, avg(anomaly_score) > 0.5 AS final_decision, avg(CASE WHEN is_anomaly THEN 1.0 ELSE 0.0 END) AS consensus_level,
       count(*) AS model_count FROM @predictions GROUP BY entity_id
""",
    ("predictions",),
)
_TABLES["ranked"] = (
    """
SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, feature) AS r, sum(score) OVER (PARTITION BY entity_id) AS total FROM @attributions
""",
    ("attributions",),
)
_TABLES["phrases"] = (
    """
SELECT entity_id, list((CASE WHEN score / total * 100 > 30 THEN 'highly unusual ' WHEN score / total * 100 > 15 THEN 'unusual ' ELSE 'somewhat unusual ' END) || feature ORDER BY r) AS p
FROM @ranked WHERE r <= 5 GROUP BY entity_id
""",
    ("ranked",),
)
_TABLES["narratives"] = (
    """
SELECT entity_id, CASE len(p) WHEN 1 THEN 'Alert triggered because of ' || p[1] || '.' WHEN 2 THEN 'Alert triggered because of ' || p[1] || ' and ' || p[2] || '.'
 ELSE 'Alert triggered due to multiple factors: ' || array_to_string(p[1:len(p) - 1], ', ') || ', and ' || p[len(p)] || '.' END AS narrative FROM @phrases
""",
    ("phrases",),
)
_TABLES["reviews"] = (
    """
SELECT alert_id, 'analyst-' || confidence AS analyst_id, feedback_id AS notes, is_true_positive
FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY event_time DESC, feedback_id DESC) AS r FROM @feedback) x WHERE r = 1
""",
    ("feedback",),
)
_STORED = "login_count, unique_hosts, unique_ips"
_TABLES["vectors"] = ("SELECT *, written_at + INTERVAL 1 DAY AS expires_at FROM @feature_log", ("feature_log",))
_TABLES["live"] = (f"SELECT * FROM @vectors WHERE written_at <= {AS_OF} AND expires_at > {AS_OF}", ("vectors",))
_TABLES["newest"] = (
    "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, window_size ORDER BY written_at DESC) AS r FROM @live) x WHERE r = 1",
    ("live",),
)
_TABLES["behavior"] = (
    "SELECT entity_id, written_at, login_count, unique_hosts, unique_ips, 'user' AS entity_type, 0.5::DOUBLE AS confidence, 1 AS baseline_version, expires_at FROM @vectors WHERE window_size = 604800",
    ("vectors",),
)
_TABLES["last_behavior"] = (
    f"""
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY written_at DESC) AS r FROM @behavior
WHERE written_at <= {AS_OF} AND expires_at > {AS_OF}) x WHERE r = 1
""",
    ("behavior",),
)
for _name, _hours in (("week", 168), ("half_day", 12)):
    _TABLES[_name] = (
        f"""
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, window_size ORDER BY written_at DESC) AS r FROM @feature_log
WHERE written_at <= {AS_OF} AND written_at + INTERVAL {_hours} HOUR > {AS_OF}) x WHERE r = 1
""",
        ("feature_log",),
    )
_TABLES["matrix"] = (
    "SELECT vec_id AS row_key, i::INTEGER AS position, embedding[i + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64)) AS i) n",
    (),
)


def sql(text: str) -> str:
    """The query with the subqueries that its `@names` stand for put in front."""
    import re

    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in _TABLES:
            return
        for needed in _TABLES[name][1]:
            visit(needed)
        order.append(name)

    for name in re.findall(r"@(\w+)", text):
        visit(name)
    # Large shared subqueries are computed once.
    named = ", ".join(f"{name}_t AS MATERIALIZED ({P.render(_TABLES[name][0], 'duckdb')})" for name in order)
    full = f"WITH {named} {text}" if order else text

    def table(match):
        return f"{match.group(1)}_t" if match.group(1) in _TABLES else match.group(1)

    return re.sub(r"@(\w+)", table, full)


def r6(text: str) -> str:
    return f"round(({text})::DOUBLE, 6) + 0.0"


_NORMALIZED = "event_id, event_time, source_type, event_type, entity_id, entity_type, source_ip, hostname, username, raw_message, dns_query"

_EVENT_JSON = " || ',' || ".join(
    f"'\"{name}\":' || "
    + (
        "'\"' || strftime(event_time, '%Y-%m-%dT%H:%M:%S.%g') || 'Z\"'"
        if name == "event_time"
        else "to_json(value)::VARCHAR"
        if name == "raw_data"
        else f"coalesce(to_json({name})::VARCHAR, 'null')"
        if name in _NORMALIZED.split(", ")
        else "'null'"
    )
    for name in NORMALIZED_EVENT.names
)

_SQL: dict[str, str] = {
    **{
        f"normalize_{kind}": f"SELECT {_NORMALIZED} FROM @outcomes WHERE reject_reason IS NULL AND source_type = '{kind}'"
        for kind in ("windows", "linux", "cloudtrail", "dns", "ocsf")
    },
    "raw_log_source": "SELECT value, source_type, ingest_time FROM @raw_logs",
    "normalized_sink": f"SELECT entity_id AS key, '{{' || {_EVENT_JSON} || '}}' AS value FROM @outcomes WHERE reject_reason IS NULL",
    "route_by_source": "SELECT source_type, 'routed' AS route, count(*) AS records FROM @raw_logs GROUP BY source_type",
    "process_raw_logs": f"SELECT {_NORMALIZED} FROM @outcomes WHERE reject_reason IS NULL",
    "consume_events": f"SELECT {_NORMALIZED} FROM @outcomes WHERE reject_reason IS NULL",
    "reject_sink": "SELECT source_type, coalesce(reject_reason, 'accepted') AS outcome, count(*) AS records FROM @outcomes GROUP BY ALL",
    "normalized_schema_check": """SELECT event_id, CASE WHEN event_type IS NULL THEN 'null_event_type' ELSE 'invalid_entity_type' END AS reject_reason FROM @outcomes
        WHERE event_type IS NULL OR entity_type NOT IN ('user', 'host', 'ip_address', 'application', 'service', 'database')""",
    "event_defaults": """SELECT sha256(source_type || '|' || epoch_us(event_time)::VARCHAR || '|' || value) AS event_id, event_time, source_type FROM @outcomes WHERE reject_reason IS NULL""",
    "window_events": "SELECT entity_id, event_id, event_time FROM @wev WHERE w = 86400",
    "multi_window": "SELECT entity_id, w AS window_size, count(*) AS event_count, min(event_time) AS first_event, max(event_time) AS last_event FROM @wev GROUP BY entity_id, w",
    "extract_features": f"SELECT entity_id, window_size, {', '.join(n for f in _ALL for n in _FEATURE_SQL[f])} FROM @f_long",
    "feature_vector": f"SELECT entity_id, {AS_OF} AS timestamp, window_size, true AS is_valid, 33::BIGINT AS feature_count, {', '.join(n for f in _ALL for n in _FEATURE_SQL[f])} FROM @f_long",
    "flattened_features": "SELECT entity_id, "
    + ", ".join(
        f"max({name}) FILTER (window_size = {w}) AS w{w}_{name}"
        for w in (3600, 86400, 604800)
        for f in _ALL
        for name in _FEATURE_SQL[f]
    )
    + " FROM @f_long GROUP BY entity_id",
    "zero_fill": f"SELECT entity_id, window_size, {', '.join(n for f in _ALL for n in _FEATURE_SQL[f])} FROM @f_long WHERE n = 0",
    **{
        f"features_{family}": f"SELECT entity_id, window_size, {', '.join(_FEATURE_SQL[family])} FROM @f_long" for family in _ALL
    },
    "features_own_family": f"""SELECT f.entity_id, f.window_size, {', '.join(_FEATURE_SQL['entropy'])},
        coalesce(x.longest_command, 0)::DOUBLE AS longest_command, round(coalesce(x.active, 0) / f.window_size, 6) AS active_share
        FROM @f_long f LEFT JOIN (SELECT entity_id, w, max(length(command_line)) AS longest_command,
            epoch_us(max(event_time)) // 1000000 - epoch_us(min(event_time)) // 1000000 AS active
            FROM @wev GROUP BY entity_id, w) x ON f.entity_id = x.entity_id AND f.window_size = x.w""",
    "engine_statistics": "SELECT count(DISTINCT entity_id) AS entity_count, count(*) AS total_events, '3600,86400,604800' AS window_sizes, 5::BIGINT AS extractor_count, 33::BIGINT AS total_features FROM @sec_events",
    "evict_old_events": f"""SELECT (count(*) FILTER (old))::BIGINT AS removed_events, (count(*) FILTER (NOT old))::BIGINT AS kept_events,
        (count(DISTINCT entity_id) - count(DISTINCT entity_id) FILTER (NOT old))::BIGINT AS removed_entities
        FROM (SELECT entity_id, event_time < {AS_OF} - INTERVAL 7 DAY AS old FROM @sec_events) x""",
    "save_feature_vectors": "SELECT * FROM @vectors",
    "latest_feature_vectors": "SELECT * FROM @newest",
    "snapshot_feature_vectors": "SELECT * FROM @newest",
    "lookup_feature_vectors": """SELECT n.* FROM @newest n JOIN @entities e ON n.entity_id = e.entity_id
        WHERE e.department = 'Sales' OR (e.department = 'Engineering' AND n.window_size = 86400)""",
    "save_entity_behavior": "SELECT * FROM @behavior",
    "latest_entity_behavior": "SELECT * FROM @last_behavior",
    "entity_behavior": """SELECT e.entity_id, coalesce(b.login_count, 0.0)::DOUBLE AS login_count, coalesce(b.unique_hosts, 0.0)::DOUBLE AS unique_hosts, coalesce(b.unique_ips, 0.0)::DOUBLE AS unique_ips
        FROM @entities e LEFT JOIN @last_behavior b ON e.entity_id = b.entity_id""",
    "store_entity_ids": "SELECT DISTINCT entity_id FROM @live",
    "save_baseline_features": f"SELECT entity_id, window_size, {_STORED}, 1 AS version, {AS_OF} AS written_at, {AS_OF} + INTERVAL 7 DAY AS expires_at FROM @newest",
    "population_baseline": " UNION ALL ".join(
        f"SELECT department, window_size, count(*) AS members, '{name}' AS feature, {r6(f'avg({name})')} AS mean, {r6(f'stddev_pop({name})')} AS std FROM @week w JOIN @entities e ON w.entity_id = e.entity_id GROUP BY department, window_size"
        for name in _STORED.split(", ")
    ),
    "cold_start_features": "SELECT e.entity_id, "
    + ", ".join(f"{r6(f'coalesce(h.{name}, m.{name})')} AS {name}" for name in _STORED.split(", "))
    + """ FROM @entities e LEFT JOIN @half_day h ON e.entity_id = h.entity_id AND h.window_size = 86400 LEFT JOIN (SELECT department, """
    + ", ".join(f"avg({name}) AS {name}" for name in _STORED.split(", "))
    + " FROM @week w JOIN @entities e ON w.entity_id = e.entity_id WHERE w.window_size = 86400 GROUP BY department) m ON e.department = m.department",
    "save_predictions": f"""SELECT entity_id, model_name, {r6('anomaly_score')} AS anomaly_score, event_time AS written_at, event_time + INTERVAL 1 DAY AS expires_at
        FROM (SELECT s.*, e.event_time, row_number() OVER (PARTITION BY s.entity_id, s.model_name ORDER BY e.event_time DESC) AS r FROM @model_scores s JOIN @sec_events e ON s.event_id = e.event_id
              WHERE e.event_time + INTERVAL 1 DAY > {AS_OF}) x WHERE r = 1""",
    "delete_entities": "SELECT v.entity_id, v.window_size, v.written_at FROM @vectors v JOIN @entities e ON v.entity_id = e.entity_id WHERE e.department <> 'HR'",
    "standard_scale": f"SELECT row_key, position, {r6('(x - avg(x) OVER p) / CASE WHEN stddev_pop(x) OVER p = 0 THEN 1 ELSE stddev_pop(x) OVER p END')} AS value FROM @matrix WINDOW p AS (PARTITION BY position)",
    "iforest_importance": f"SELECT 'f' || position AS feature, {r6('i / sum(i) OVER ()')} AS importance FROM (SELECT position, 1 / (avg(x) + 1) AS i FROM @matrix GROUP BY position) t",
    "ensemble_score": f"SELECT entity_id, {r6('final_score')} AS final_score, final_decision, {r6('consensus_level')} AS consensus_level, model_count FROM @ensemble",
    "model_predictions": "SELECT entity_id, model_name, round(anomaly_score, 11) + 0.0 AS anomaly_score, is_anomaly, round(1 - abs(anomaly_score - 0.5) * 2, 11) + 0.0 AS confidence FROM @predictions",
    "ensemble_score_batch": f"""SELECT '' AS entity_id, {r6('avg(s)')} AS final_score, avg(s) > 0.5 AS final_decision, {r6('avg(v)')} AS consensus_level, count(*) AS model_count
        FROM (SELECT avg(anomaly_score) AS s, CASE WHEN avg(CASE WHEN anomaly_score > 0.5 THEN 1.0 ELSE 0.0 END) > 0.5 THEN 1.0 ELSE 0.0 END AS v FROM @model_scores GROUP BY model_name) x""",
    "model_explanation": """SELECT p.entity_id, model_name, CASE WHEN anomaly_score < 0.3 THEN model_name || ': Normal behavior detected'
        ELSE model_name || ': Anomaly detected. Top contributors: ' || t END AS explanation FROM @predictions p
        LEFT JOIN (SELECT entity_id, string_agg(feature || ' (' || printf('%.2f', score) || ')', ', ' ORDER BY r) AS t FROM @ranked WHERE r <= 3 GROUP BY entity_id) x ON p.entity_id = x.entity_id""",
    "aggregated_importance": f"SELECT feature, {r6('sum(score) / 3')} AS importance FROM @attributions GROUP BY feature",
    "attribution_abs": f"SELECT row_key AS entity_id, 'f' || position AS feature, {r6('abs(x)')} AS score FROM @matrix",
    "attribution_abs_08": f"SELECT row_key AS entity_id, 'f' || position AS feature, {r6('abs(x) * 0.8::DOUBLE')} AS score FROM @matrix",
    "top_contributors": f"SELECT entity_id, r AS rank, feature, {r6('score')} AS contribution, {r6('score / total * 100')} AS percentage FROM @ranked WHERE r <= 5",
    "alert_narrative": "SELECT e.entity_id, coalesce(n.narrative, 'Normal behavior detected. No significant anomalies found.') AS narrative FROM @entities e LEFT JOIN @narratives n ON e.entity_id = n.entity_id",
    "alert_explanation": f"""SELECT s.entity_id, {r6('final_score')} AS final_score, CASE WHEN final_score < 0.3 THEN 'Low risk alert for ' || s.entity_id || '. Behavior is mostly normal with minor deviations.'
        WHEN t IS NULL THEN 'Medium risk alert for ' || s.entity_id || '. Multiple minor deviations detected.'
        ELSE 'Alert for ' || s.entity_id || ' (Risk Score: ' || printf('%.2f', final_score) || '). Key factors: ' || t || '.' END AS explanation
        FROM @ensemble s LEFT JOIN (SELECT entity_id, string_agg(array_to_string(list_transform(string_split(feature, '_'), lambda x: upper(x[1]) || x[2:]), ' ') || ' (score: ' || printf('%.2f', score) || ')', ', ' ORDER BY r) AS t
        FROM @ranked WHERE r <= 3 AND score > 0.1 GROUP BY entity_id) x ON s.entity_id = x.entity_id""",
    "graph_nodes": "SELECT * FROM @nodes",
    "graph_metadata": """SELECT entity_id, username AS name, event_time AS last_seen, metadata FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_time DESC, username DESC, metadata DESC) AS r FROM (
            SELECT *, '{"department":"' || department || '","last_event":"' || event_type || '"}' AS metadata FROM @sec_events) x) y WHERE r = 1""",
    "graph_edges": "SELECT * FROM @edges WHERE edge_type <> 'member_of'",
    "record_access": """SELECT entity_id AS source, hostname AS target, event_type AS edge_type, count(*) AS "count", count(*)::DOUBLE AS weight, max(event_time) AS last_seen
        FROM @sec_events WHERE hostname IS NOT NULL GROUP BY entity_id, hostname, event_type""",
    "node_degree": """SELECT n.entity_id, (SELECT count(*) FROM @edges e WHERE e.source = n.entity_id) AS out_degree, (SELECT count(*) FROM @edges e WHERE e.target = n.entity_id) AS in_degree FROM @nodes n""",
    "degree_centrality": """SELECT n.entity_id, ((SELECT count(*) FROM @edges e WHERE e.source = n.entity_id) + (SELECT count(*) FROM @edges e WHERE e.target = n.entity_id)) / 2 AS degree_centrality FROM @nodes n""",
    "neighbors_k_hop": """SELECT h.entity_id, h.neighbor_id, hop, n.entity_type AS neighbor_type, n.name AS neighbor_name, n.risk_score AS neighbor_risk, relationship_types
        FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY hop, neighbor_id) AS r FROM @hop1) h JOIN @nodes n ON h.neighbor_id = n.entity_id WHERE r <= 50""",
    "neighbors_from_entity": """SELECT h.entity_id, h.neighbor_id, hop, n.entity_type AS neighbor_type, n.name AS neighbor_name, n.risk_score AS neighbor_risk, relationship_types
        FROM (SELECT * FROM @from1 UNION ALL SELECT * FROM @from2 UNION ALL SELECT * FROM @from3) h JOIN @nodes n ON h.neighbor_id = n.entity_id""",
    "shortest_path": " UNION ALL ".join(
        f"SELECT '{_SEED}' AS source, target, array_to_string(path, ' > ') AS path, {i}::BIGINT AS length FROM @path{i}" for i in range(_PATH_DEPTH + 1)
    ),
    "shortest_path_between": "SELECT w.* FROM ("
    + " UNION ALL ".join(
        f"SELECT source, target, array_to_string(path, ' > ') AS path, {i}::BIGINT AS length FROM @way{i}" for i in range(_PATH_DEPTH + 1)
    )
    + ") w JOIN @pairs p ON w.source = p.source AND w.target = p.target",
    "lateral_movement": """SELECT e.source AS entity_id, e.target, n.name AS target_name, n.entity_type AS target_type, e.edge_type AS relationship, e."count" AS access_count, n.risk_score AS target_risk
        FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "count" DESC, target, edge_type) AS r FROM @edges WHERE "count" > 5) e JOIN @nodes n ON e.target = n.entity_id WHERE r <= 20""",
    "clustering_coefficient": f"""SELECT n.entity_id, coalesce(k, 0)::BIGINT AS degree, coalesce(t, 0)::BIGINT AS triangles,
        {r6('CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END')} AS coefficient FROM @nodes n
        LEFT JOIN (SELECT a, count(DISTINCT b) AS k FROM @both GROUP BY a) d ON n.entity_id = d.a
        LEFT JOIN (SELECT x, count(*) AS t FROM (SELECT unnest([p.u, p.v, q.v]) AS x FROM @simple p JOIN @simple q ON p.v = q.u JOIN @simple s ON s.u = p.u AND s.v = q.v) y GROUP BY x) z ON n.entity_id = z.x""",
    "update_risk": f"""SELECT n.entity_id, n.entity_type, n.name, {r6('coalesce(e.final_score, n.risk_score)')} AS risk_score, n.first_seen,
        CASE WHEN e.entity_id IS NOT NULL THEN {AS_OF} ELSE n.last_seen END AS last_seen FROM @nodes n LEFT JOIN @ensemble e ON n.entity_id = e.entity_id""",
    "graph_statistics": "SELECT (SELECT count(*) FROM @nodes) AS node_count, (SELECT count(*) FROM @edges) AS edge_count",
    "dashboard_stats": f"""SELECT count(*) AS total_alerts, count(*) FILTER (severity = 'critical') AS critical_alerts, count(*) FILTER (severity = 'high') AS high_alerts,
        count(*) FILTER (severity = 'medium') AS medium_alerts, count(*) FILTER (severity = 'low') AS low_alerts, count(*) FILTER (status = 'new' OR status = 'in_progress') AS open_alerts,
        count(*) FILTER (status = 'resolved' AND resolved_at >= {DAY_OF_ALERTS}) AS resolved_today,
        count(*) FILTER (status = 'false_positive' AND resolved_at >= {DAY_OF_ALERTS}) AS false_positives_today FROM @alerts""",
    "filter_alerts": "SELECT * FROM @alerts WHERE severity = 'critical' AND status = 'new' AND attack_type = 'brute_force'",
    "page_alerts": "SELECT alert_id, event_time, severity, (SELECT count(*) FROM @alerts) AS total FROM @alerts ORDER BY event_time DESC, alert_id LIMIT 20 OFFSET 40",
    "page_alerts_deep": " UNION ALL ".join(
        f"SELECT '{name}' AS listed, alert_id, event_time, severity, total FROM (SELECT *, row_number() OVER (ORDER BY event_time DESC, alert_id) - 1 AS r, count(*) OVER () AS total FROM @alerts{where}) x WHERE r // 20 = total // 40"
        for name, where in (("any", ""), ("new", " WHERE status = 'new'"))
    ),
    "lookup_alerts": "SELECT alert_id, severity, status FROM @alerts WHERE alert_id IN (SELECT alert_id FROM @feedback)",
    "missing_alerts": "SELECT DISTINCT 'al-' || (eid * 2)::VARCHAR AS alert_id FROM @sec_events WHERE 'al-' || (eid * 2)::VARCHAR NOT IN (SELECT alert_id FROM @alerts)",
    "upsert_alerts": f"""SELECT alert_id, severity, CASE WHEN status = 'in_progress' THEN 'resolved' ELSE status END AS status,
        CASE WHEN status = 'in_progress' THEN {AS_OF} ELSE event_time END AS written_at FROM @alerts""",
    "list_alerts_by_id": "SELECT alert_id, entity_id, severity, status FROM @alerts",
    "alert_count": "SELECT count(*) AS alert_count FROM @alerts",
    "assign_alerts": """SELECT a.alert_id, CASE WHEN r.alert_id IS NOT NULL THEN 'in_progress' ELSE a.status END AS status, coalesce(r.analyst_id, '') AS assigned_to
        FROM @alerts a LEFT JOIN @reviews r ON a.alert_id = r.alert_id""",
    "resolve_alerts": f"""SELECT a.alert_id, CASE WHEN r.alert_id IS NOT NULL THEN 'resolved' ELSE a.status END AS status,
        CASE WHEN r.alert_id IS NOT NULL THEN {AS_OF} ELSE a.resolved_at END AS resolved_at, coalesce(r.notes, '') AS notes
        FROM @alerts a LEFT JOIN (SELECT * FROM @reviews WHERE is_true_positive) r ON a.alert_id = r.alert_id""",
    "delete_alerts": "SELECT alert_id FROM @alerts WHERE alert_id NOT IN (SELECT alert_id FROM @feedback)",
    "create_alerts": f"""SELECT sha256(e.entity_id || '|' || epoch_us({AS_OF})::VARCHAR) AS alert_id, {AS_OF} AS event_time, e.entity_id, 'user' AS entity_type,
        CASE WHEN final_score > 0.5 THEN 'high' ELSE 'low' END AS severity, 'unknown' AS attack_type, 0.5::DOUBLE AS confidence, {r6('final_score')} AS anomaly_score, 'new' AS status,
        'Anomalous behavior of ' || e.entity_id AS title, coalesce(n.narrative, '') AS description, e.entity_id AS affected_assets, '' AS related_alerts,
        NULL::VARCHAR AS feature_importance, n.narrative AS explanation, NULL::VARCHAR AS assigned_to, NULL::TIMESTAMP AS resolved_at, NULL::VARCHAR AS resolution_notes,
        NULL::DOUBLE AS feedback_score FROM @ensemble e LEFT JOIN @narratives n ON e.entity_id = n.entity_id""",
    "entity_risk": f"""SELECT entity_id, {r6('s')} AS risk_score, event_time AS last_assessment FROM
        (SELECT m.entity_id, m.event_id, e.event_time, avg(anomaly_score) AS s, row_number() OVER (PARTITION BY m.entity_id ORDER BY e.event_time DESC) AS r
         FROM @model_scores m JOIN @sec_events e ON m.event_id = e.event_id GROUP BY m.entity_id, m.event_id, e.event_time) x WHERE r = 1""",
    "system_metrics": f"""SELECT count(*) AS events_processed, (SELECT count(*) FROM @alerts) AS alerts_generated,
        {r6('count(*) / ((epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1e6)')} AS throughput_events_per_sec FROM @sec_events""",
    "save_feedback": """SELECT alert_id, feedback_id, n AS feedback_count FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY event_time DESC, feedback_id DESC) AS r,
        count(*) OVER (PARTITION BY alert_id) AS n FROM @feedback) x WHERE r = 1""",
    "feedback_history": """SELECT alert_id, feedback_id, event_time, is_true_positive, confidence::BIGINT AS confidence FROM @feedback
        WHERE alert_id IN (SELECT alert_id FROM @alerts WHERE status IN ('new', 'in_progress'))""",
    "retraining_data": """SELECT feedback_id, alert_id, event_time, is_true_positive, r AS position FROM
        (SELECT *, row_number() OVER (PARTITION BY is_true_positive ORDER BY event_time, feedback_id) AS r FROM @feedback) x WHERE r <= 100""",
    "feedback_statistics": f"""SELECT count(*) AS total_feedback, count(*) FILTER (is_true_positive) AS true_positives, count(*) FILTER (NOT is_true_positive) AS false_positives,
        {r6('count(*) FILTER (is_true_positive) / count(*)')} AS true_positive_rate, count(*) FILTER (event_time > TIMESTAMP '2024-01-15 00:00:00') AS pending_retraining_samples FROM @feedback""",
    "retraining_status": "SELECT CASE WHEN count(*) >= 100 THEN 'ready' ELSE 'collecting' END AS status, count(*) AS samples_collected, '1.0.0' AS model_version FROM @feedback",
    "feedback_disposition": "SELECT feedback_id, alert_id, event_time, CASE WHEN is_true_positive THEN 'resolved' ELSE 'false_positive' END AS status FROM @feedback",
    "apply_disposition": """SELECT a.alert_id, CASE WHEN f.alert_id IS NULL THEN a.status WHEN f.is_true_positive THEN 'resolved' ELSE 'false_positive' END AS status,
        coalesce(f.event_time, a.resolved_at) AS resolved_at FROM @alerts a LEFT JOIN
        (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY event_time DESC, feedback_id DESC) AS r FROM @feedback) x WHERE r = 1) f ON a.alert_id = f.alert_id""",
    "detect_brute_force": """SELECT entity_id, to_timestamp(s)::TIMESTAMP AS detected_at, failures FROM (SELECT entity_id, s,
        (sum(n) OVER (PARTITION BY entity_id ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW))::BIGINT AS failures
        FROM (SELECT entity_id, epoch_us(event_time) // 1000000 AS s, count(*) AS n FROM @sec_events WHERE event_type = 'authentication_failure' GROUP BY ALL) c) x WHERE failures >= 2""",
    "detect_impossible_travel": f"""SELECT entity_id, event_id, event_time, pid AS previous_event_id, pcity AS from_city, city AS to_city, {r6(_HAVERSINE)} AS distance_km,
        {r6(_HAVERSINE + ' / greatest((epoch_us(event_time) - epoch_us(pt)) / 3.6e9, 0.1)')} AS speed_kmh
        FROM (SELECT *, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon, lag(event_time) OVER o AS pt, lag(event_id) OVER o AS pid, lag(city) OVER o AS pcity FROM @sec_events
        WHERE event_type = 'login' AND lat IS NOT NULL WINDOW o AS (PARTITION BY entity_id ORDER BY event_time, event_id)) x
        WHERE pid IS NOT NULL AND {_HAVERSINE} / greatest((epoch_us(event_time) - epoch_us(pt)) / 3.6e9, 0.1) > 100""",
    "detect_exfiltration": """SELECT entity_id, event_id, event_time FROM @sec_events x WHERE event_type = 'data_exfiltration' AND EXISTS (SELECT 1 FROM @sec_events a
        WHERE a.entity_id = x.entity_id AND a.event_type = 'file_access' AND a.event_time <= x.event_time AND a.event_time >= x.event_time - INTERVAL 86400 SECOND)""",
    "detect_privilege_escalation": """SELECT entity_id, time_bucket(INTERVAL 86400 SECOND, event_time, TIMESTAMP '1970-01-01') AS window_start,
        time_bucket(INTERVAL 86400 SECOND, event_time, TIMESTAMP '1970-01-01') + INTERVAL 86400 SECOND AS window_end, count(*) AS escalations
        FROM @sec_events WHERE event_type = 'privilege_escalation' GROUP BY ALL HAVING count(*) >= 2""",
}

# The named rules run with their defaults; the wider ones keep the limits written above.
for _name, _wide, _limits in (
    ("detect_brute_force", "detect_brute_force_hour", (("3599 PRECEDING", "299 PRECEDING"), ("failures >= 2", "failures >= 3"))),
    ("detect_impossible_travel", "detect_fast_travel", (("> 100", "> 1000"),)),
    ("detect_exfiltration", "detect_exfiltration_day", (("86400 SECOND", "600 SECOND"),)),
    ("detect_privilege_escalation", "detect_privilege_escalation_day", (("86400 SECOND", "120 SECOND"),)),
):
    _SQL[_wide] = _SQL[_name]
    for _old, _new in _limits:
        _SQL[_name] = _SQL[_name].replace(_old, _new)
_SQL["detect_exfiltration_month"] = _SQL["detect_exfiltration_day"].replace("86400 SECOND", "2592000 SECOND")

_SQL["alert_lifecycle"] = f"""SELECT sha256(entity_id || '|' || epoch_us({AS_OF})::VARCHAR) AS alert_id, 'user' AS entity_type,
    CASE WHEN final_score > 0.5 THEN 'high' ELSE 'low' END AS severity,
    CASE WHEN final_score > 0.75 OR final_score <= 0.5 THEN 'resolved' ELSE 'false_positive' END AS status,
    CASE WHEN final_score > 0.5 THEN 'analyst-1' END AS assigned_to, {AS_OF} AS resolved_at,
    CASE WHEN final_score <= 0.5 THEN 'too small' END AS resolution_notes FROM @ensemble"""
_SQL["alert_lifecycle_stats"] = """SELECT count(*) AS total_alerts, 0::BIGINT AS critical_alerts, count(*) FILTER (final_score > 0.5) AS high_alerts,
    0::BIGINT AS medium_alerts, count(*) FILTER (final_score <= 0.5) AS low_alerts, count(*) FILTER (final_score > 0.5) AS open_alerts,
    count(*) FILTER (final_score <= 0.5) AS resolved_today, 0::BIGINT AS false_positives_today FROM @ensemble"""
_SQL["model_persistence"] = f"""SELECT model_name, (SELECT count(*) FROM embeddings) AS scored_rows, 0.0::DOUBLE AS largest_difference
    FROM (SELECT unnest(['isolation_forest', 'autoencoder', 'boosted_trees']) AS model_name) m"""

_SQL["model_importances"] = """SELECT model_name, 64::BIGINT AS features, 1.0::DOUBLE AS total
    FROM (SELECT unnest(['isolation_forest', 'autoencoder', 'boosted_trees']) AS model_name) m"""
_SQL["score_ranges"] = """SELECT model_name, (SELECT count(*) FROM embeddings) AS scored_rows, 0::BIGINT AS outside,
    CASE WHEN contains(model_name, 'batch') THEN 0.0::DOUBLE END AS least, CASE WHEN contains(model_name, 'batch') THEN 1.0::DOUBLE END AS largest
    FROM (SELECT unnest(['isolation_forest', 'autoencoder', 'boosted_trees', 'isolation_forest, batch']) AS model_name) m"""
_SQL["pipeline_alert_checks"] = f"""SELECT count(DISTINCT entity_id) AS alert_count, count(DISTINCT entity_id) AS entity_count, 0::BIGINT AS wrong_alerts,
    0::BIGINT AS too_many_related FROM @outcomes WHERE reject_reason IS NULL AND event_time BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF}"""
_SQL["alert_reasons"] = f"""SELECT e.entity_id, CASE WHEN final_score > 0.5 THEN 'high' ELSE 'low' END AS severity, coalesce(o.ids, '') AS related_alerts,
    r.feature, r.score AS importance FROM @ensemble e JOIN @ranked r ON r.entity_id = e.entity_id AND r.r <= 10
    LEFT JOIN (SELECT entity_id, string_agg(alert_id, ',' ORDER BY n) AS ids FROM (
        SELECT entity_id, alert_id, row_number() OVER (PARTITION BY entity_id ORDER BY event_time DESC, alert_id) AS n
        FROM @alerts WHERE status IN ('new', 'in_progress') AND event_time <= {AS_OF}) x WHERE n <= 10 GROUP BY entity_id) o ON o.entity_id = e.entity_id"""
# Half of the feedback trains the second version, its other half the third, if there is enough of each.
_SQL["retraining_gate"] = f"""
SELECT * FROM (WITH f AS (SELECT count(*) FILTER (event_time <= TIMESTAMP '2024-01-16 00:00:00') AS early, count(*) FILTER (event_time > TIMESTAMP '2024-01-16 00:00:00') AS late
               FROM @feedback WHERE event_time <= {AS_OF}), steps AS (SELECT unnest([0, 1, 2])::BIGINT AS step),
    done AS (SELECT step, early >= 100 AS half, CASE WHEN early >= 100 THEN late ELSE early + late END AS rest FROM f, steps),
    told AS (SELECT step, CASE step WHEN 0 THEN half WHEN 1 THEN FALSE ELSE rest >= 100 END AS trained,
                    CASE WHEN step = 2 AND rest >= 100 THEN 0 ELSE rest END AS samples_collected,
                    1 + half::INT + (step = 2 AND rest >= 100)::INT AS v FROM done)
    SELECT step, trained, CASE WHEN samples_collected >= 100 THEN 'ready' ELSE 'collecting' END AS status, samples_collected, v || '.0.0' AS model_version FROM told) y"""
_SQL["attribution_trees_sums"] = """SELECT model_name, 0::BIGINT AS off, TRUE AS some_flagged
    FROM (SELECT unnest(['isolation_forest', 'boosted_trees']) AS model_name) m"""
_SQL["detector_pipeline"] = """SELECT model_name, (SELECT count(*) FROM embeddings) AS scored_rows, 0::BIGINT AS outside, 0.0::DOUBLE AS largest_difference
    FROM (SELECT unnest(['isolation_forest', 'autoencoder', 'boosted_trees']) AS model_name) m"""

# A stream gives the same rows as its batch.
_SQL["stream_normalize"] = _SQL["process_raw_logs"]
_SQL["stream_entity_buffer"] = (
    "SELECT entity_id, CAST(event_time AS DATE) AS event_date, count(*) AS event_count FROM @sec_events GROUP BY ALL"
)
_SQL["stream_unique_events"] = "SELECT event_id, event_time, entity_id FROM @sec_events"
_SQL["stream_eviction"] = f"""SELECT event_id, event_time, entity_id FROM @accepted_events
 WHERE event_time >= {AS_OF} - INTERVAL 7 DAY"""
_SQL["stream_eviction_report"] = f"""SELECT (SELECT count(*) FROM @deliveries) AS delivered_rows, (SELECT count(*) FROM @accepted_events) AS accepted_rows,
 (SELECT count(*) FROM @accepted_events WHERE event_time >= {AS_OF} - INTERVAL 7 DAY) AS kept_rows, TRUE AS some_were_late,
 (SELECT count(DISTINCT CAST(event_time AS DATE)) FROM @accepted_events WHERE CAST(event_time AS DATE) < CAST({AS_OF} - INTERVAL 7 DAY AS DATE)) AS retired_days"""
_SQL["brute_force_sessions"] = "SELECT * FROM @failure_sessions"
# A session is given out when it ends before the watermark.
_SQL["stream_brute_force"] = """SELECT * FROM @failure_sessions
 WHERE session_end <= (SELECT max(event_time) FROM @sec_events WHERE event_type = 'authentication_failure') - INTERVAL 1 HOUR"""
_SQL["stream_periodic_features"] = _SQL["extract_features"]
_SQL["stream_partial_features"] = _SQL["extract_features"]
_SQL["sketched_features"] = " UNION ALL ".join(
    f"""SELECT {entity} AS entity_id, w AS window_size, '{name}' AS feature, count(DISTINCT {column}) AS exact_count, TRUE AS within_bound
 FROM @wev GROUP BY {keys}"""
    for entity, keys in (("entity_id", "entity_id, w"), ("NULL::VARCHAR", "w"))
    for name, column in (
        ("unique_hosts", "hostname"),
        ("unique_ips", "source_ip"),
        ("unique_countries", "country"),
        ("unique_cities", "city"),
        ("new_connections", "hostname"),
    )
)
_SQL["stream_exfiltration"] = _SQL["detect_exfiltration"]
_SQL["stream_exfiltration_day"] = _SQL["detect_exfiltration_day"]
# Windows that the watermark, an hour before the last event, has passed.
_TYPE_COUNTS = ", ".join(
    f"count(*) FILTER (contains(event_type, '{text}')) AS {name}"
    for name, text in (
        ("login_count", "login"),
        ("failed_logins", "failure"),
        ("successful_logins", "success"),
        ("file_access_count", "file"),
        ("process_count", "process"),
        ("dns_query_count", "dns"),
        ("network_connections", "network"),
    )
)


def _sliding(seconds: int, slide: int, more: str = "") -> str:
    return f"""SELECT entity_id, s AS window_start, s + to_seconds({seconds}) AS window_end, {more} count(*) AS event_count, {_TYPE_COUNTS}
    FROM (SELECT *, unnest(range(0, {seconds}, {slide})) AS back FROM @sec_events) e,
    LATERAL (SELECT time_bucket(to_seconds({slide}), e.event_time, TIMESTAMP '1970-01-01') - to_seconds(e.back) AS s) x
    WHERE s + to_seconds({seconds}) <= date_trunc('milliseconds', (SELECT max(event_time) FROM @sec_events)) - INTERVAL 1 HOUR GROUP BY entity_id, s"""


_SQL["stream_sliding_features"] = _sliding(86400, 21600)
_SQL["stream_sliding_windows"] = " UNION ALL ".join(
    _sliding(seconds, slide, f"{seconds} AS window_size,") for seconds, slide in ((3600, 900), (86400, 21600), (604800, 86400))
)


def oracle_sql() -> dict[str, str]:
    return {name: sql(text) for name, text in _SQL.items()}
