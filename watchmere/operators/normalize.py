"""Raw log records of five kinds to one normalized event schema, in a single projection.

A record is JSON text. It is parsed once into a map; the kind of the record selects, column by
column, which rule fills the normalized event. Records that a rule refuses keep a reject reason, so
that accepted and rejected rows always add up to the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchmere.functions.columns import filled
from watchmere.functions.records import Record, may_hold_other_than_text, parse_record
from watchmere.schemas import ENTITY_TYPES, NORMALIZED_EVENT

RECORD = "_record"

# Windows event codes.
WINDOWS_EVENT_CODES = {
    "4624": "login",
    "4625": "authentication_failure",
    "4634": "logout",
    "4648": "login",
    "4672": "privilege_escalation",
    "4688": "process_create",
    "4663": "file_access",
    "4656": "file_access",
    "4670": "permission_change",
}

# Syslog message patterns, the first that matches wins.
SYSLOG_PATTERNS = (
    (r"sshd\[\d+\]: Accepted password for (\w+)", "login"),
    (r"sshd\[\d+\]: Failed password for (\w+)", "authentication_failure"),
    (r"sudo: (\w+) : TTY=.* ; COMMAND=(.+)", "privilege_escalation"),
    (r"su: (\w+) to (\w+) on", "privilege_escalation"),
    (r"process\[\d+\]: (.+)", "process_create"),
)

# Texts in a CloudTrail event name, the first that occurs wins.
CLOUDTRAIL_NAMES = (
    (("AssumeRole", "GetCallerIdentity"), "login"),
    (("PutObject", "GetObject"), "file_access"),
    (("CreateUser", "ModifyDBInstance"), "configuration_change"),
)
CLOUDTRAIL_OTHER = "network_connection"

# Address patterns.
DOTTED_QUAD = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
FROM_DOTTED_QUAD = r"from " + DOTTED_QUAD

# `\w` of any script; a dot stops at a line feed only.
REGEX_FLAGS = "(?Ud)"

TIME_KEYS = ("TimeCreated", "timestamp", "eventTime")


@dataclass(frozen=True)
class Rule:
    """How one kind of record becomes an event.

    `fields` maps event columns to expressions over the record, null where left out. `owner` is the
    entity when the record names no user (or always, where `by_user` is false): a prefix, the column
    that follows it, and the entity type. `refuse` lists reject reasons with their conditions in the
    order in which they are tried; `no_type` is the reason when no event type was found. `texts` are
    the keys whose values must be text or null.
    """

    fields: dict[str, Column]
    owner: tuple[str, Column, str] | None = None
    by_user: bool = True
    refuse: tuple[tuple[str, Column], ...] = ()
    no_type: str | None = None
    texts: tuple[str, ...] = ()


def _first_match(message: Column, pattern: str, group: int = 1) -> Column:
    return filled(F.regexp_extract(message, REGEX_FLAGS + pattern, group))


def windows_rule(record: Record, text: Column) -> Rule:
    codes = F.create_map(*[F.lit(x) for pair in WINDOWS_EVENT_CODES.items() for x in pair])
    event_type = codes[record.first("EventID", "Event_ID", default="")]
    host = record.first("Computer", "Hostname")
    address = F.coalesce(
        _first_match(record.text("IpAddress"), DOTTED_QUAD),
        F.when(text.contains("IpAddress"), _first_match(text, DOTTED_QUAD)),
    )
    return Rule(
        fields={
            "event_type": event_type,
            "source_ip": address,
            "hostname": host,
            "username": record.first("SubjectUserName", "TargetUserName"),
            "raw_message": record.first("Message", default=""),
        },
        owner=("host:", filled(host), "host"),
        no_type="unmapped_code",
        texts=("Computer", "Hostname", "SubjectUserName", "TargetUserName", "Message"),
    )


def linux_rule(record: Record, text: Column) -> Rule:
    message = record.first("message", "Message", default="")
    # A pattern that matches captures at least one character, so the first capture is the user.
    users = [_first_match(message, pattern) for pattern, _ in SYSLOG_PATTERNS]
    kinds = [F.when(user.isNotNull(), kind) for user, (_, kind) in zip(users, SYSLOG_PATTERNS)]
    host = record.text("hostname")
    return Rule(
        fields={
            "event_type": F.coalesce(*kinds),
            "source_ip": _first_match(message, FROM_DOTTED_QUAD),
            "hostname": host,
            "username": F.coalesce(*users),
            "raw_message": message,
        },
        owner=("host:", filled(host), "host"),
        no_type="no_pattern",
        texts=("message", "Message", "hostname"),
    )


def cloudtrail_rule(record: Record, text: Column) -> Rule:
    name = record.first("eventName", default="")
    source = record.first("eventSource", default="")
    kinds = [F.when(name.contains(x) | name.contains(y), kind) for (x, y), kind in CLOUDTRAIL_NAMES]
    identity = record.text("userIdentity")
    return Rule(
        fields={
            "event_type": F.when(name.isNotNull(), F.coalesce(*kinds, F.lit(CLOUDTRAIL_OTHER))),
            "source_ip": record.text("sourceIPAddress"),
            "hostname": source,
            "username": record.text("userIdentity", "userName"),
            "raw_message": record.first("errorMessage", default=""),
        },
        owner=("service:", source, "application"),
        refuse=(("no_identity", record.has("userIdentity") & ~F.coalesce(identity.startswith("{"), F.lit(False))),),
        texts=("eventName", "eventSource", "sourceIPAddress", "errorMessage"),
    )


def dns_rule(record: Record, text: Column) -> Rule:
    name = record.first("query_name", "query", default="")
    kind = record.first("query_type", "type", default="A")
    return Rule(
        fields={
            "event_type": F.lit("dns_query"),
            "source_ip": record.text("src_ip"),
            "hostname": record.text("hostname"),
            "username": record.text("user"),
            "raw_message": F.concat_ws(" ", F.coalesce(kind, F.lit("None")), F.coalesce(name, F.lit("None"))),
            "dns_query": name,
        },
        owner=("host:", filled(record.first("hostname", default="unknown")), "host"),
        by_user=False,
        texts=("src_ip", "hostname", "user", "query_name", "query"),
    )


def ocsf_rule(record: Record, text: Column) -> Rule:
    entity_type = record.first("entity_type", default="user")
    return Rule(
        fields={
            "event_type": record.first("activity_name", default="unknown"),
            "source_ip": record.text("src_ip"),
            "destination_ip": record.text("dest_ip"),
            "hostname": record.text("hostname"),
            "username": record.text("user_name"),
            "raw_message": record.first("raw_data", default=""),
            "entity_id": record.first("entity_id", "user_name", "hostname"),
            "entity_type": entity_type,
            "url": record.text("url"),
            "dns_query": record.text("dns_query"),
        },
        refuse=(("invalid_entity_type", ~F.coalesce(entity_type.isin(*ENTITY_TYPES), F.lit(False))),),
        texts=(
            "src_ip",
            "dest_ip",
            "hostname",
            "user_name",
            "activity_name",
            "raw_data",
            "entity_id",
            "url",
            "dns_query",
        ),
    )


# More kinds of source can be added here: a name and a function of (record, raw text) to a rule.
RULES: dict[str, Callable[[Record, Column], Rule]] = {
    "windows": windows_rule,
    "linux": linux_rule,
    "cloudtrail": cloudtrail_rule,
    "dns": dns_rule,
    "ocsf": ocsf_rule,
}

REQUIRED = ("event_type", "raw_message", "entity_id", "entity_type")
RULE_FIELDS = (
    "event_type",
    "source_ip",
    "destination_ip",
    "hostname",
    "username",
    "raw_message",
    "entity_id",
    "entity_type",
    "dns_query",
    "url",
    "session_id",
    "process_id",
    "command_line",
    "file_path",
    "user_agent",
    "isp",
    "country",
    "city",
    "location",
)


def required_field_missing() -> Column:
    """The first reject reason of the envelope check: a required field that is null."""
    labels = {name: F.lit(f"null_{name}") for name in REQUIRED}
    labels["event_type"] = F.coalesce("_no_type", labels["event_type"])
    labels["entity_id"] = F.lit("no_entity")
    return F.coalesce(*[F.when(F.col(name).isNull(), label) for name, label in labels.items()])


def event_time(record: Record, ingest_time: Column) -> Column:
    """The time the source wrote into the record, or else when the record came in."""
    return F.coalesce(*[written_time(record.text(key), ingest_time) for key in TIME_KEYS], ingest_time)


def written_time(text: Column, ingest_time: Column) -> Column:
    """A time as logs write it: ISO, seconds or milliseconds since 1970, or a syslog day without a year.

    A syslog time takes the year that brings it nearest to, and not more than a day behind, the ingest time.
    """
    number = F.when(text.rlike(r"^[0-9]{9,10}(\.[0-9]+)?$"), text.try_cast("double"))
    millis = F.when(text.rlike("^[0-9]{12,13}$"), text.try_cast("double") / 1000)
    epoch = F.timestamp_seconds(F.coalesce(number, millis))
    day = F.when(text.rlike(r"^[A-Z][a-z]{2} +[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.regexp_replace(text, " +", " "))

    def in_year(back: int) -> Column:
        year = (F.year(ingest_time) - back).cast("string")
        return F.try_to_timestamp(F.concat(year, F.lit(" "), day), F.lit("yyyy MMM d HH:mm:ss"))

    this_year = in_year(0)
    latest = ingest_time + F.expr("INTERVAL 1 DAY")
    syslog = F.when(this_year <= latest, this_year).otherwise(in_year(1))
    plain = F.when(number.isNull() & millis.isNull() & day.isNull(), text)
    return F.coalesce(epoch, syslog, F.try_to_timestamp(plain))


def event_id(source_type: Column, ingest_time: Column | None, text: Column, place: Column | None = None) -> Column:
    """A stable id: the same record read twice gets the same one.

    Where the source tells a record's place (topic, partition and offset, or file and occurrence), equal
    records at different places have different ids. Without an ingest time in the data none takes part.
    """
    time = [] if ingest_time is None else [F.unix_micros(ingest_time).cast("string")]
    parts = F.concat_ws("|", source_type, *time, text, *([] if place is None else [place]))
    return F.sha2(parts, 256)


def normalize(raw: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Route every record to the rule of its `source_type` and apply it; batch or stream.

    `raw` has `value` (JSON text) and may have `source_type` (otherwise read from the record, with
    'unknown' when the key is missing), `ingest_time` (otherwise the current time) and `record_place`
    (where the source has the record, which tells equal records apart). All columns of
    `raw` whose names do not clash are passed through. The result has the normalized columns and
    `reject_reason`, null for accepted rows.
    """
    known_time = "ingest_time" in raw.columns
    if not known_time:
        raw = raw.withColumn("ingest_time", F.current_timestamp())
    record, text = Record(RECORD, "value"), F.col("value")
    parsed = raw.withColumns({RECORD: parse_record(text), "_odd": may_hold_other_than_text(text)})
    if "source_type" not in raw.columns:
        parsed = parsed.withColumn("source_type", record.first("source_type", default="unknown"))
    kind = F.col("source_type")
    rules = {name: RULES[name](record, text) for name in (kinds or tuple(RULES))}

    nothing = F.lit(None)

    def draw(rule: Rule) -> Column:
        """What one rule makes of a record, as a struct that is the same for every rule."""
        tests = (("invalid_type", F.col("_odd") & record.not_text(*rule.texts)), *rule.refuse)
        prefix, name, owner_type = rule.owner or (None, nothing, None)
        drawn = {field: rule.fields.get(field, nothing) for field in RULE_FIELDS}
        unknown = set(rule.fields) - set(RULE_FIELDS)
        if unknown:
            raise ValueError(f"events have no {', '.join(sorted(unknown))}")
        drawn["_owner"] = F.concat(F.lit(prefix).cast("string"), name.cast("string"))
        drawn["_owner_type"] = F.lit(owner_type).cast("string")
        drawn["_by_user"] = F.lit(rule.owner is not None and rule.by_user)
        drawn["_no_type"] = F.lit(rule.no_type).cast("string")
        drawn["_refused"] = F.coalesce(*[F.when(test, label) for label, test in tests])
        kinds = {"_by_user": "boolean", "location": NORMALIZED_EVENT["location"].dataType}
        return F.struct(*[value.cast(kinds.get(field, "string")).alias(field) for field, value in drawn.items()])

    drawn = F
    for name, rule in rules.items():
        drawn = drawn.when(kind == name, draw(rule))
    drawn = drawn.otherwise(draw(Rule(fields={}, refuse=(("unknown_source", F.lit(True)),))))
    kept = [c for c in raw.columns if c not in {*RULE_FIELDS, "source_type", "event_time"}]
    # Everything that reads the record is computed once, into a struct; unfolding it with a generator
    # keeps later filters from being pushed below, where they would parse and match all over again.
    drawn_once = parsed.select(
        *kept,
        "source_type",
        F.col(RECORD).isNull().alias("_bad_json"),
        event_time(record, F.col("ingest_time")).alias("_time"),
        drawn.alias("_drawn"),
    )
    rows = drawn_once.select(*kept, "source_type", "_bad_json", "_time", F.inline(F.array("_drawn")))

    user_owns = F.col("_by_user") & filled("username").isNotNull()
    entity_id = F.when(user_owns, F.concat(F.lit("user:"), "username")).otherwise(F.coalesce("entity_id", "_owner"))
    entity_type = F.when(user_owns, "user").otherwise(F.coalesce("entity_type", "_owner_type"))
    rows = rows.withColumns({"entity_id": entity_id, "entity_type": entity_type})
    columns = {f.name: F.lit(None).cast(f.dataType) for f in NORMALIZED_EVENT}
    columns |= {name: F.col(name) for name in (*RULE_FIELDS, "source_type")}
    columns["event_time"] = F.col("_time")
    columns["raw_data"] = text
    columns["event_id"] = (
        F.col("event_id")
        if "event_id" in raw.columns
        else event_id(
            kind,
            F.col("ingest_time") if known_time else None,
            text,
            F.col("record_place") if "record_place" in raw.columns else None,
        )
    )
    return rows.select(
        *[columns[name].alias(name) for name in NORMALIZED_EVENT.names],
        F.when(F.col("_bad_json"), "bad_json")
        .otherwise(F.coalesce("_refused", required_field_missing()))
        .alias("reject_reason"),
        *[name for name in kept if name != "event_id"],
    )


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNull()).select(*NORMALIZED_EVENT.names)


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNotNull())


def reject_counts(normalized: DataFrame) -> DataFrame:
    """Rows per source and outcome; 'accepted' stands beside the reject reasons."""
    return normalized.groupBy(
        "source_type", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    ).agg(F.count("*").alias("records"))


def schema_violations(events: DataFrame) -> DataFrame:
    """Events that break the envelope: a required field is null or a vocabulary does not have it."""
    reason = (
        F.when(F.col("source_type").isNull(), "null_source_type")
        .when(F.col("event_type").isNull(), "null_event_type")
        .when(F.col("raw_message").isNull(), "null_raw_message")
        .when(F.col("entity_id").isNull(), "no_entity")
        .when(F.col("entity_type").isNull(), "null_entity_type")
        .when(~F.col("entity_type").isin(*ENTITY_TYPES), "invalid_entity_type")
    )
    return events.withColumn("reject_reason", reason).filter(F.col("reject_reason").isNotNull())


def keyed_json(events: DataFrame) -> DataFrame:
    """Key and JSON value of each event, as a message sink wants them."""
    return events.select(
        F.col("entity_id").alias("key"),
        F.to_json(F.struct(*[c for c in events.columns]), {"ignoreNullFields": "false"}).alias("value"),
    )
