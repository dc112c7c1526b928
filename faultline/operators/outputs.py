"""Checks of a table of model outputs, and the prompts they answer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed
from faultline.functions.numeric import clamp
from faultline.functions.payload import computed_once
from faultline.functions.text import fill, json_string


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(_at(value, path))


def _text(value: Column, path: str) -> Column:
    """A non-empty string, else null."""
    return F.when(_kind(value, path) == "STRING", F.nullif(_at(value, path, "string"), F.lit("")))


def _texts(value: Column, path: str) -> Column:
    """The list at path if all its items are non-empty strings, else null."""
    items = _at(value, path, "array<variant>")
    fine = F.forall(items, lambda x: (F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") != ""))
    return F.when(fine, F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))


# --- test cases -----------------------------------------------------------------------------------
CASE_FIELDS = ("id", "title", "steps", "expected", "tags", "risk", "feature_id")


def _read_case(case: Column) -> Column:
    """The fields of one test case, null where a field breaks the contract."""
    tags = F.when(_at(case, "$.tags").isNull(), F.array().cast("array<string>")).otherwise(_texts(case, "$.tags"))
    risk = F.when(_at(case, "$.risk").isNull(), F.lit("medium")).otherwise(_at(case, "$.risk", "string"))
    steps = _texts(case, "$.steps")
    return F.struct(
        _text(case, "$.id").alias("id"),
        _text(case, "$.title").alias("title"),
        F.when(F.size(steps) > 0, steps).alias("steps"),
        _text(case, "$.expected").alias("expected"),
        tags.alias("tags"),
        F.when(risk.isin(*fixed.RISKS), risk).alias("risk"),
        _text(case, "$.createdFromFeatureId").alias("feature_id"),
    )


def _whole(case: Column) -> Column:
    result = F.lit(True)
    for name in CASE_FIELDS:
        result = result & case[name].isNotNull()
    return result


def _with_cases(df: DataFrame, raw: Column, name: str) -> DataFrame:
    """Adds the test cases of one output; null where the text is no JSON or any case breaks the contract."""
    read = F.transform(_at(F.try_parse_json(raw), "$.testCases", "array<variant>"), _read_case)
    df = computed_once(df, "_read", read)
    return computed_once(df, name, F.when(F.forall("_read", _whole), F.col("_read"))).drop("_read")


def validate_test_cases(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `cases` and `valid`; an output with one bad case is rejected whole."""
    return _with_cases(outputs, F.col(raw), "cases").withColumn("valid", F.col("cases").isNotNull())


def test_cases(validated: DataFrame, key: str = "output_id") -> DataFrame:
    return validated.where("valid").select(key, F.explode("cases").alias("c")).select(key, "c.*")


def recover_outputs(outputs: DataFrame, raw: str = "raw", repaired: str = "repaired") -> DataFrame:
    """The first text if it is valid, else the repaired one; adds recovery_attempted and recovery_ok."""
    parsed = _with_cases(outputs, F.col(raw), "_first")
    failed = F.col("_first").isNull()
    parsed = _with_cases(parsed, F.when(failed, F.col(repaired)), "_second")
    return parsed.withColumns(
        {
            "cases": F.coalesce("_first", "_second"),
            "recovery_attempted": failed,
            "recovery_ok": failed & F.col("_second").isNotNull(),
        }
    ).drop("_first", "_second")


def recovery_stats(recovered: DataFrame) -> DataFrame:
    return recovered.agg(
        F.count("*").alias("requests"),
        F.count_if("recovery_attempted").alias("recovery_attempts"),
        F.count_if("recovery_ok").alias("recovery_successes"),
    )


# --- window reports ---------------------------------------------------------------------------------
def parse_window_reports(reports: DataFrame, fallback: DataFrame, batch: str = "batch_id") -> DataFrame:
    """batch_id, report_json -> report columns; an unreadable text gives the rule-based report.

    `fallback` is the nested rule-based report of every batch.
    """
    v = F.try_parse_json("report_json")
    parsed = computed_once(reports.select(batch, "report_json"), "v", v)
    entries = F.filter(
        F.transform(
            F.coalesce(_at(F.col("v"), "$.events_by_service", "array<variant>"), F.array().cast("array<variant>")),
            lambda e: F.struct(
                F.when(_kind(e, "$.service") == "STRING", _at(e, "$.service", "string")).alias("service"),
                _at(e, "$.count", "bigint").alias("count"),
                _at(e, "$.dominant_severity", "string").alias("dominant_severity"),
                _list(e, "$.incident_types").alias("incident_types"),
            ),
        ),
        lambda e: e["service"].isNotNull()
        & e["count"].isNotNull()
        & e["dominant_severity"].isin(*fixed.SEVERITIES)
        & e["incident_types"].isNotNull(),
    )
    risk = _at(F.col("v"), "$.hallucination_risk", "string")
    confidence = _at(F.col("v"), "$.confidence_score", "double")
    no_confidence = _at(F.col("v"), "$.confidence_score").isNull()
    assessment = _at(F.col("v"), "$.overall_assessment")
    pattern_kind = _kind(F.col("v"), "$.critical_pattern")
    actions = _at(F.col("v"), "$.recommended_actions")
    usable = (
        F.col("v").try_cast("map<string,variant>").isNotNull()
        & (no_confidence | confidence.isNotNull())
        & (assessment.isNull() | (F.schema_of_variant(assessment) == "STRING"))
        & (pattern_kind.isNull() | pattern_kind.isin("STRING", "VOID"))
        & (actions.isNull() | _list(F.col("v"), "$.recommended_actions").isNotNull())
    )
    read = parsed.where(F.coalesce(usable, F.lit(False))).select(
        batch,
        F.lit(True).alias("_read"),
        F.coalesce(_at(F.col("v"), "$.overall_assessment", "string"), F.lit("Analysis unavailable.")).alias("p_assessment"),
        _at(F.col("v"), "$.critical_pattern", "string").alias("p_pattern"),
        F.coalesce(_list(F.col("v"), "$.recommended_actions"), F.array().cast("array<string>")).alias("p_actions"),
        entries.alias("p_entries"),
        F.when(risk.isin(*fixed.RISKS), risk).otherwise("medium").alias("p_risk"),
        clamp(F.when(no_confidence, 50).otherwise(clamp(confidence, -1.0, 101.0).cast("int")), 0, 100).alias("p_confidence"),
    )
    joined = fallback.join(read, batch, "left")
    used = F.coalesce("_read", F.lit(False))

    def pick(mine: str, theirs: str) -> Column:
        return F.when(used, F.col(mine)).otherwise(F.col(theirs))

    services = F.when(used & (F.size("p_entries") > 0), F.col("p_entries.service")).otherwise(F.col("services_affected"))
    return joined.select(
        batch,
        "event_count",
        "window_seconds",
        services.alias("services_affected"),
        pick("p_assessment", "overall_assessment").alias("overall_assessment"),
        pick("p_pattern", "critical_pattern").alias("critical_pattern"),
        pick("p_actions", "recommended_actions").alias("recommended_actions"),
        pick("p_entries", "events_by_service").alias("events_by_service"),
        pick("p_risk", "hallucination_risk").alias("hallucination_risk"),
        pick("p_confidence", "confidence_score").alias("confidence_score"),
        used.alias("llm_used"),
    )


def _list(value: Column, path: str) -> Column:
    """The list at path if all its items are strings, else null."""
    items = _at(value, path, "array<variant>")
    fine = F.forall(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.when(fine, F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))


# --- copilot ------------------------------------------------------------------------------------------
COPILOT = "struct<summary:string,probable_cause:string,suggested_actions:array<string>,confidence:double>"


def parse_copilot_output(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """JSON value of a model answer (an object, or a string that holds one) -> the four fields."""
    # an answer may be a JSON string with the object inside
    outer = F.try_parse_json(raw)
    inner = F.when(F.schema_of_variant(outer) == "STRING", F.try_parse_json(outer.try_cast("string"))).otherwise(outer)
    df = computed_once(outputs, "_v", inner)
    v = F.col("_v")
    confidence = F.when(
        _kind(v, "$.confidence").isin("BIGINT", "DOUBLE", "FLOAT") | _kind(v, "$.confidence").startswith("DECIMAL"),
        _at(v, "$.confidence", "double"),
    )
    actions = _texts(v, "$.suggestedActions")
    fine = (
        _text(v, "$.summary").isNotNull()
        & _text(v, "$.probableCause").isNotNull()
        & (F.size(actions) > 0)
        & confidence.between(0, 1)
    )

    def fixed_row(values: tuple) -> Column:
        summary, cause, steps, sure = values
        return F.struct(F.lit(summary), F.lit(cause), F.array(*[F.lit(s) for s in steps]), F.lit(sure)).cast(COPILOT)

    good = F.struct(_text(v, "$.summary"), _text(v, "$.probableCause"), actions, confidence).cast(COPILOT)
    answer = (
        # no answer at all counts as an empty object
        F.when(F.col(raw).isNull(), fixed_row(fixed.COPILOT_BAD_SHAPE))
        .when(v.isNull(), fixed_row(fixed.COPILOT_BAD_JSON))
        .when(F.coalesce(fine, F.lit(False)), good)
        .otherwise(fixed_row(fixed.COPILOT_BAD_SHAPE))
    )
    return df.withColumn("_a", answer).select(*outputs.columns, "_a.*")


# --- prompts ------------------------------------------------------------------------------------------
def render_prompts(df: DataFrame, template: Column | str, values: Mapping[str, Column], name: str = "prompt") -> DataFrame:
    """The template with every {{KEY}} replaced, one key after the other."""
    text = F.lit(template) if isinstance(template, str) else template
    for key, value in values.items():
        text = F.replace(text, F.lit("{{" + key + "}}"), value)
    return df.withColumn(name, text)


def feature_spec_json(df: DataFrame) -> Column:
    """A feature spec as indented JSON; missing tags are an empty list."""

    def listed(column: str) -> Column:
        items = F.coalesce(F.col(column), F.array().cast("array<string>"))
        lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("    "), json_string(x))), ",\n")
        return F.when(F.size(items) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n"), lines, F.lit("\n  ]")))

    return F.concat(
        F.lit('{\n  "id": '), json_string(F.col("id")),
        F.lit(',\n  "title": '), json_string(F.col("title")),
        F.lit(',\n  "description": '), json_string(F.col("description")),
        F.lit(',\n  "acceptanceCriteria": '), listed("acceptance_criteria"),
        F.lit(',\n  "tags": '), listed("tags"),
        F.lit("\n}"),
    )


def repair_prompt(bad_output: Column) -> Column:
    """Asks for the JSON again; no output at all is an empty one."""
    return fill(fixed.REPAIR_PROMPT, output=F.coalesce(bad_output, F.lit("")))


def incident_prompt(timestamp: Column) -> Column:
    """The text that asks for an analysis of one incident; what is missing is written as None."""
    names = ("workflow", "stage", "source", "incident_type", "category", "severity", "message")
    values = {n: F.coalesce(F.col(n), F.lit("None")) for n in names}
    return fill(fixed.INCIDENT_PROMPT, **values, timestamp=F.coalesce(timestamp, F.lit("None")))


def _json_number(value: Column) -> Column:
    """A number without a fraction of zero, as scripts print it; null as null."""
    return F.coalesce(F.regexp_replace(value.cast("string"), r"\.0$", ""), F.lit("null"))


def copilot_prompt(df: DataFrame) -> DataFrame:
    """service, environment, health, ts, rates and issues -> adds `system` and `user`, a text of indented JSON."""
    issues = F.coalesce("issues", F.array().cast("array<string>"))
    listed = F.concat(F.lit("[\n"), F.array_join(F.transform(issues, lambda x: F.concat(F.lit("    "), json_string(x))), ",\n"), F.lit("\n  ]"))
    user = F.concat(
        F.lit('{\n  "incident": {\n    "service": '), json_string(F.col("service")),
        F.lit(',\n    "environment": '), json_string(F.col("environment")),
        F.lit(',\n    "healthStatus": '), json_string(F.col("health")),
        F.lit(',\n    "timestamp": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.lit('"\n  },\n  "kpis": {\n    "retryRate": '), _json_number(F.col("retry_rate")),
        F.lit(',\n    "fallbackRate": '), _json_number(F.col("fallback_rate")),
        F.lit(',\n    "avgAttempts": '), _json_number(F.col("avg_attempts")),
        F.lit('\n  },\n  "issues": '), F.when(F.size(issues) == 0, F.lit("[]")).otherwise(listed), F.lit("\n}"),
    )
    return df.withColumn("system", F.lit(fixed.COPILOT_SYSTEM)).withColumn("user", user)
