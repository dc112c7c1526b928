"""Raw payloads to one event model, with a quarantine for what does not fit."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed
from faultline.functions.payload import Payload, computed_once, parse_object, text_value, timestamp_of, unpack
from faultline.functions.text import first_hit, json_string, lookup, non_blank, py_strip

Normalizer = Callable[[Payload], Mapping[str, Column]]

# the fields a normalizer gives; `timestamp` is an unpacked value, and becomes the arrival time if unreadable
FIELDS = ("severity", "service", "message", "timestamp", "error_type", "affected_resource")


# --- scalar rules -----------------------------------------------------------------------------
def severity_from_log_level(level: Column) -> Column:
    return lookup(F.lower(level), fixed.LOG_LEVEL_SEVERITY, fixed.DEFAULT_SEVERITY)


def severity_generic(severity: Column) -> Column:
    return lookup(F.lower(severity), fixed.GENERIC_SEVERITY, fixed.DEFAULT_SEVERITY)


def service_from_logger(logger: Column) -> Column:
    """Third dotted part of a logger name, else the last one there is."""
    parts = F.split(F.coalesce(logger, F.lit("")), "[.]")
    return (
        F.when(F.size(parts) >= 3, parts[2])
        .when(F.size(parts) == 2, F.try_element_at(parts, F.lit(2)))
        .when(parts[0] != "", parts[0])
        .otherwise(fixed.UNKNOWN_SERVICE)
    )


def exception_simple_name(name: Column) -> Column:
    return F.element_at(F.split(name, "[.]"), -1)


def service_from_group(group: Column) -> Column:
    """A consumer group without its -consumer and -group endings."""
    return F.regexp_replace(F.regexp_replace(group, "-consumer$", ""), "-group$", "")


def service_from_topic(topic: Column) -> Column:
    head = F.split(topic, "-")[0]
    return F.when(head != "", head).otherwise(topic)


def error_type_from_text(error: Column) -> Column:
    """Error type of a message-bus error text; null where there is no text."""
    return F.when(
        F.coalesce(error, F.lit("")) != "", first_hit(error, fixed.KAFKA_ERROR_WORDS, "technical_error")
    )


def incident_type_from_error(error_type: Column) -> Column:
    text = F.coalesce(error_type, F.lit(""))
    return first_hit(text, fixed.INCIDENT_TYPE_WORDS, fixed.DEFAULT_INCIDENT_TYPE)


# --- one normalizer per source ------------------------------------------------------------------
def normalize_jvm_log(p: Payload) -> dict[str, Column]:
    return {
        "severity": severity_from_log_level(p.truthy("level")),
        "service": F.coalesce(p.truthy("service"), service_from_logger(p.any_truthy("logger", "loggerName"))),
        "message": F.coalesce(p.any_truthy("message", "msg"), F.lit("No message")),
        "timestamp": p.first_value("timestamp", "@timestamp"),
        "error_type": exception_simple_name(p.any_truthy("exception", "exceptionClass")),
        "affected_resource": p.first_truthy("requestUri", "endpoint"),
        "text_fields": _true_text(p, "level") & _chosen_text(p, "requestUri", "endpoint"),
    }


def normalize_kafka_event(p: Payload) -> dict[str, Column]:
    error = p.truthy("error")
    topic_text = F.when(p.get("topic").isNull(), F.lit("unknown")).otherwise(F.coalesce(p.text("topic"), F.lit("None")))
    return {
        "severity": severity_generic(p.truthy("severity")),
        "service": F.coalesce(
            p.truthy("headers.service"),
            service_from_group(p.any_truthy("consumer_group", "groupId")),
            service_from_topic(p.truthy("topic")),
            F.lit(fixed.UNKNOWN_SERVICE),
        ),
        "message": F.coalesce(
            p.any_truthy("error", "message"), F.concat(F.lit("Kafka event on topic "), topic_text)
        ),
        "timestamp": p.first_value("timestamp"),
        "error_type": F.coalesce(p.truthy("error_type"), error_type_from_text(error)),
        "affected_resource": p.text("topic"),
        "text_fields": _true_text(p, "severity") & _true_text(p, "error_type") & p.is_text("topic"),
    }


def normalize_webhook(p: Payload) -> dict[str, Column]:
    when = p.first_non_blank(*fixed.WEBHOOK_TIMESTAMP)
    return {
        "severity": severity_generic(p.first_non_blank(*fixed.WEBHOOK_SEVERITY)),
        "service": F.coalesce(p.first_non_blank(*fixed.WEBHOOK_SERVICE), F.lit(fixed.UNKNOWN_SERVICE)),
        "message": F.coalesce(p.first_non_blank(*fixed.WEBHOOK_MESSAGE), F.lit("Webhook event received")),
        # the alias is read as text, so an epoch number is not a timestamp here
        "timestamp": text_value(when),
        "error_type": p.first_truthy("error_type", "alert_name", "type"),
        "affected_resource": p.first_truthy("resource", "endpoint", "url"),
        "text_fields": _chosen_text(p, "error_type", "alert_name", "type") & _chosen_text(p, "resource", "endpoint", "url"),
    }


def _true_text(p: Payload, key: str) -> Column:
    """Whether a value that counts as true is a text; others are not used."""
    return p.truthy(key).isNull() | p.is_text(key)


def _chosen_text(p: Payload, *keys: str) -> Column:
    """Whether the value that `first_truthy` picks from the keys is absent, null or a text."""
    result = p.is_text(keys[-1])
    for key in reversed(keys[:-1]):
        result = F.when(p.truthy(key).isNotNull(), p.is_text(key)).otherwise(result)
    return result


NORMALIZERS: dict[str, Normalizer] = {
    "spring-boot": normalize_jvm_log,
    "kafka": normalize_kafka_event,
    "generic": normalize_webhook,
}


# --- operators ----------------------------------------------------------------------------------
def with_ids(payloads: DataFrame) -> DataFrame:
    """Adds `incident_id` if there is none: a hash of source, text, and the place in the source or else the arrival.

    Equal lines at different places are separate events, and a line keeps its id however often and late it is read.
    """
    if "incident_id" in payloads.columns:
        return payloads
    place = F.col("arrival_ts").cast("string")
    if "position" in payloads.columns:
        place = F.coalesce("position", place)
    content = F.concat_ws("|", "source_system", F.coalesce(place, F.lit("")), "raw")
    return payloads.withColumn("incident_id", F.substring(F.sha2(content, 256), 1, 32))


def normalize(df: DataFrame, normalizers: Mapping[str, Normalizer] | None = None) -> DataFrame:
    """raw, source_system, arrival_ts -> the event columns and `reasons`, in one pass.

    `reasons` is empty for a good event; see `accepted` and `rejected`. Rows keep an `incident_id` they
    bring along, else get one, see `with_ids`.
    """
    normalizers = {**NORMALIZERS, **(normalizers or {})}
    df = with_ids(df)
    df = computed_once(df, "_variant", parse_object("raw"))
    parsed = F.col("_variant").isNotNull()
    # two steps per source: only the keys of a row's own source are read, and each generated method stays small
    for i, (source, normalizer) in enumerate(normalizers.items()):
        payload = Payload(f"_payload_{i}")
        row = _row(normalizer(payload))
        mine = parsed & (F.col("source_system") == source)
        df = computed_once(df, f"_payload_{i}", F.when(mine, unpack("_variant", payload.keys)))
        df = computed_once(df, f"_event_{i}", F.when(mine, row)).drop(f"_payload_{i}")
    df = df.withColumn("event", F.coalesce(*[f"_event_{i}" for i in range(len(normalizers))]))
    known = F.coalesce(F.col("source_system").isin(*normalizers), F.lit(False))
    checks = [
        (~known, "unknown source_system"),
        (~parsed, "payload is not a JSON object"),
        (parsed & ~F.col("event.text_fields"), "text field holds another type"),
        (parsed & (py_strip(F.col("event.service")) == ""), "service must not be blank"),
        (parsed & (py_strip(F.col("event.message")) == ""), "message must not be blank"),
    ]
    return df.select(
        "incident_id",
        "source_system",
        F.col("event.severity").alias("severity"),
        py_strip(F.col("event.service")).alias("service"),
        py_strip(F.col("event.message")).alias("message"),
        F.coalesce(timestamp_of(F.col("event.timestamp")), F.col("arrival_ts")).alias("timestamp"),
        "raw",
        F.col("event.error_type").alias("error_type"),
        F.col("event.affected_resource").alias("affected_resource"),
        "arrival_ts",
        _reasons(checks).alias("reasons"),
    )


def _row(fields: Mapping[str, Column]) -> Column:
    fine = fields.get("text_fields", F.lit(True))
    return F.struct(*[fields[name].alias(name) for name in FIELDS], fine.alias("text_fields"))


def _reasons(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in checks]))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.size("reasons") == 0).drop("reasons")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.size("reasons") > 0)


def validate_events(df: DataFrame) -> DataFrame:
    """Check rows that already have the event columns; adds `reasons`, strips service and message."""
    checks = [
        (non_blank(F.col("service")).isNull(), "service must not be blank"),
        (non_blank(F.col("message")).isNull(), "message must not be blank"),
        (~F.coalesce(F.col("source_system").isin(*fixed.SOURCE_SYSTEMS), F.lit(False)), "unknown source_system"),
        (~F.coalesce(F.col("severity").isin(*fixed.SEVERITIES), F.lit(False)), "unknown severity"),
        (F.col("timestamp").isNull(), "timestamp cannot be parsed"),
    ]
    return df.withColumns(
        {"service": py_strip(F.col("service")), "message": py_strip(F.col("message")), "reasons": _reasons(checks)}
    )


def to_standard_incident(df: DataFrame) -> DataFrame:
    """Normalized events -> incidents for evaluation; keeps arrival_ts if there is one."""
    error, resource = F.col("error_type"), F.col("affected_resource")
    some = (F.coalesce(error, F.lit("")) != "") | (F.coalesce(resource, F.lit("")) != "")
    context = F.map_filter(
        F.create_map(F.lit("error_type"), error, F.lit("affected_resource"), resource), lambda _, v: v.isNotNull()
    )
    columns = [
        F.col("incident_id").alias("id"),
        "timestamp",
        F.col("service").alias("workflow"),
        lookup(F.col("source_system"), fixed.STAGE_OF_SOURCE).alias("stage"),
        incident_type_from_error(error).alias("incident_type"),
        F.col("source_system").alias("category"),
        "severity",
        F.col("source_system").alias("source"),
        "message",
        F.when(some, context).alias("context"),
    ]
    return df.select(*columns, *[c for c in ("arrival_ts",) if c in df.columns])


def incident_text(df: DataFrame) -> Column:
    """The one-line text of an incident that is embedded for retrieval."""
    names = ("workflow", "stage", "incident_type", "severity", "category", "source", "message")
    parts = [F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n), F.lit(""))) for n in names]
    if "context" in df.columns:
        pairs = F.transform(
            F.map_entries("context"), lambda e: F.concat(json_string(e["key"], True), F.lit(": "), json_string(e["value"], True))
        )
        text = F.concat(F.lit("context: {"), F.array_join(pairs, ", "), F.lit("}"))
        parts.append(F.when(F.size("context") > 0, text))
    return F.concat_ws(" | ", *parts)


# --- contracts ----------------------------------------------------------------------------------
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$"

# contract -> (required texts, {column: allowed values}, optional texts, ISO datetimes, {column: (low, high)})
CONTRACTS = {
    "incident": {
        "texts": ("id", "workflow", "stage", "category", "source", "message"),
        "enums": {"incident_type": fixed.INCIDENT_TYPES, "severity": fixed.SEVERITIES},
        "datetimes": ("timestamp",),
    },
    "evaluation": {
        "texts": ("summary",),
        "optional_texts": ("reasoning",),
        "enums": {"status": fixed.STATUSES},
        "optional_enums": {"suggested_action": fixed.ACTIONS},
        "ranges": {"score": (0, 100)},
        "text_lists": ("tags",),
    },
    "health": {
        "texts": ("workflow", "summary"),
        "enums": {"status": fixed.HEALTH_STATUSES, "trend": fixed.HEALTH_TRENDS},
        "ranges": {"score": (0, 100), "recent_incident_count": (0, None)},
        "optional_datetimes": ("timestamp",),
    },
}


def validate_contract(df: DataFrame, contract: str) -> DataFrame:
    """Adds `reasons`: the columns that break the named contract. Datetimes are checked as text."""
    rules = CONTRACTS[contract]
    checks: list[tuple[Column, str]] = []

    def no(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    for name in rules.get("texts", ()):
        checks.append((no(F.length(name) > 0), name))
    for name in rules.get("optional_texts", ()):
        checks.append((F.length(name) == 0, name))
    for name, values in rules.get("enums", {}).items():
        checks.append((no(F.col(name).isin(*values)), name))
    for name, values in rules.get("optional_enums", {}).items():
        checks.append((F.col(name).isNotNull() & ~F.col(name).isin(*values), name))
    for name in rules.get("datetimes", ()):
        checks.append((no(_is_iso_datetime(F.col(name))), name))
    for name in rules.get("optional_datetimes", ()):
        checks.append((F.col(name).isNotNull() & no(_is_iso_datetime(F.col(name))), name))
    for name, (low, high) in rules.get("ranges", {}).items():
        inside = F.col(name) >= low if high is None else F.col(name).between(low, high)
        checks.append((no(inside), name))
    for name in rules.get("text_lists", ()):
        checks.append((F.exists(name, lambda x: F.coalesce(x, F.lit("")) == ""), name))
    return df.withColumn("reasons", _reasons(checks))


def _is_iso_datetime(text: Column) -> Column:
    return text.rlike(ISO_DATETIME) & text.try_cast("timestamp").isNotNull()
