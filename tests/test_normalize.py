import json

import pytest
from pyspark.sql import functions as F

from watchmere.operators import normalize as N


def one(spark, record, kind=None):
    text = record if isinstance(record, str) else json.dumps(record)
    columns = "value STRING, source_type STRING" if kind else "value STRING"
    frame = spark.createDataFrame([(text, kind) if kind else (text,)], columns)
    return N.normalize(frame.withColumn("ingest_time", F.lit("2024-01-01 00:00:00").cast("timestamp"))).first()


@pytest.mark.parametrize(("code", "kind"), N.WINDOWS_EVENT_CODES.items())
def test_windows_codes(spark, code, kind):
    row = one(spark, {"EventID": code, "Computer": "pc", "TargetUserName": "bob"}, "windows")
    assert (row["event_type"], row["entity_id"], row["entity_type"], row["raw_message"]) == (kind, "user:bob", "user", "")


def test_windows_details(spark):
    row = one(spark, {"Event_ID": 4624, "Hostname": "pc", "SubjectUserName": "", "Message": "m"}, "windows")
    assert (row["entity_id"], row["entity_type"], row["event_type"]) == ("host:pc", "host", "login")
    # A key that is present with null hides the key that would stand in for it.
    row = one(spark, {"EventID": "4624", "Computer": None, "Hostname": "pc", "SubjectUserName": "bob"}, "windows")
    assert row["hostname"] is None and row["entity_id"] == "user:bob"
    row = one(spark, {"EventID": "4624", "SubjectUserName": None, "TargetUserName": "eve", "Computer": "pc"}, "windows")
    assert row["username"] is None and row["entity_id"] == "host:pc"
    assert one(spark, {"EventID": "1", "Computer": "pc"}, "windows")["reject_reason"] == "unmapped_code"
    assert one(spark, {"EventID": "4624"}, "windows")["reject_reason"] == "no_entity"
    assert one(spark, {"EventID": "4624", "Computer": "pc", "Message": None}, "windows")["reject_reason"] == "null_raw_message"
    assert one(spark, {"EventID": "4624", "Computer": 5}, "windows")["reject_reason"] == "invalid_type"
    assert one(spark, {"EventID": "4624", "Computer": "5"}, "windows")["reject_reason"] is None


def test_windows_address(spark):
    base = {"EventID": "4624", "Computer": "pc"}
    assert one(spark, base | {"IpAddress": "10.1.2.3"}, "windows")["source_ip"] == "10.1.2.3"
    assert one(spark, base | {"Message": "from 10.1.2.3"}, "windows")["source_ip"] is None
    assert one(spark, base | {"IpAddress": "-", "Message": "at 10.9.9.9"}, "windows")["source_ip"] == "10.9.9.9"


@pytest.mark.parametrize(
    ("message", "kind", "user", "address"),
    [
        ("sshd[1]: Accepted password for bob from 10.0.0.1 port 2", "login", "bob", "10.0.0.1"),
        ("sshd[1]: Failed password for jörg from console", "authentication_failure", "jörg", None),
        ("sudo: bob : TTY=pts/0 ; COMMAND=/bin/ls", "privilege_escalation", "bob", None),
        ("su: bob to root on pts/0", "privilege_escalation", "bob", None),
        ("process[7]: started thing", "process_create", "started thing", None),
    ],
)
def test_linux_patterns(spark, message, kind, user, address):
    row = one(spark, {"message": message, "hostname": "h"}, "linux")
    assert (row["event_type"], row["username"], row["source_ip"]) == (kind, user, address)
    assert row["entity_id"] == f"user:{user}" and row["reject_reason"] is None


def test_linux_rejects(spark):
    assert one(spark, {"message": "kernel: up", "hostname": "h"}, "linux")["reject_reason"] == "no_pattern"
    assert one(spark, {"Message": "su: a to b on c"}, "linux")["event_type"] == "privilege_escalation"


@pytest.mark.parametrize(
    ("name", "kind"),
    [
        ("AssumeRoleWithSAML", "login"),
        ("GetCallerIdentity", "login"),
        ("PutObject", "file_access"),
        ("GetObjectAcl", "file_access"),
        ("CreateUser", "configuration_change"),
        ("ModifyDBInstance", "configuration_change"),
        ("assumerole", "network_connection"),
    ],
)
def test_cloudtrail_names(spark, name, kind):
    row = one(spark, {"eventName": name, "eventSource": "s3", "userIdentity": {"userName": "bob"}}, "cloudtrail")
    assert (row["event_type"], row["entity_id"], row["hostname"]) == (kind, "user:bob", "s3")


def test_cloudtrail_identities(spark):
    base = {"eventName": "X", "eventSource": "s3"}
    for identity in ({}, {"userName": None}):
        row = one(spark, base | {"userIdentity": identity}, "cloudtrail")
        assert (row["entity_id"], row["entity_type"]) == ("service:s3", "application")
    assert one(spark, base, "cloudtrail")["entity_id"] == "service:s3"
    assert one(spark, base | {"userIdentity": None}, "cloudtrail")["reject_reason"] == "no_identity"


def test_dns(spark):
    row = one(spark, {"query": "a.com", "type": "AAAA", "src_ip": "1.1.1.1"}, "dns")
    assert (row["raw_message"], row["dns_query"], row["entity_id"]) == ("AAAA a.com", "a.com", "host:unknown")
    row = one(spark, {"query_name": "b.com", "hostname": "h", "user": "bob"}, "dns")
    assert (row["raw_message"], row["entity_id"], row["entity_type"]) == ("A b.com", "host:h", "host")


def test_ocsf(spark):
    row = one(spark, {"user_name": "bob", "hostname": "h", "url": "u", "dest_ip": "2.2.2.2"}, "ocsf")
    assert (row["event_type"], row["entity_id"], row["entity_type"], row["url"]) == ("unknown", "bob", "user", "u")
    assert row["destination_ip"] == "2.2.2.2"
    assert one(spark, {"entity_id": "x", "entity_type": "robot"}, "ocsf")["reject_reason"] == "invalid_entity_type"
    assert one(spark, {"entity_id": None, "user_name": "bob"}, "ocsf")["reject_reason"] == "no_entity"
    assert one(spark, {"user_name": "bob", "activity_name": None}, "ocsf")["reject_reason"] == "null_event_type"


def test_routing_times_and_ids(spark):
    assert one(spark, "not json", "dns")["reject_reason"] == "bad_json"
    assert one(spark, {"a": "b"}, "syslog")["reject_reason"] == "unknown_source"
    assert one(spark, {"hostname": "h"})["reject_reason"] == "unknown_source"
    read = one(spark, {"source_type": "dns", "query": "a.com", "timestamp": "2024-02-03T04:05:06"})
    assert read["reject_reason"] is None and str(read["event_time"]) == "2024-02-03 04:05:06"
    again = one(spark, {"source_type": "dns", "query": "a.com", "timestamp": "2024-02-03T04:05:06"})
    assert read["event_id"] == again["event_id"] and len(read["event_id"]) == 64
    assert str(one(spark, {"query": "a.com"}, "dns")["event_time"]) == "2024-01-01 00:00:00"


def test_accepted_and_rejected_add_up(spark):
    from watchmere.sources import projections as P

    raw = P.raw_logs(spark, "/root/testdata/sf0.001")
    done = N.normalize(raw)
    assert N.accepted(done).count() + N.rejected(done).count() == raw.count()
    keyed = N.keyed_json(N.accepted(done)).first()
    assert json.loads(keyed["value"])["entity_id"] == keyed["key"]
