"""Time-window summaries per service, and the reports made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed
from faultline.functions.joins import join_with_nulls
from faultline.functions.text import cut, fill, lookup
from faultline.operators.ordered import running, running_totals

EVENTS_BY_SERVICE = "array<struct<service:string,count:bigint,dominant_severity:string,incident_types:array<string>>>"


def with_defaults(events: DataFrame) -> DataFrame:
    """Missing service, severity and type as the summaries read them."""
    names = set(events.columns)
    kinds = [F.nullif(F.col(c), F.lit("")) for c in ("incident_type", "incidentType") if c in names]
    return events.withColumns(
        {
            "service": F.coalesce("service", F.lit("unknown")),
            "severity": F.coalesce("severity", F.lit("low")),
            "incident_type": F.coalesce(*kinds, F.lit(fixed.DEFAULT_INCIDENT_TYPE)),
        }
    )


def severity_rank(severity: Column) -> Column:
    return lookup(severity, fixed.SEVERITY_RANK, 0)


def is_urgent(severity: Column) -> Column:
    return severity.isin("critical", "high")


def window_start(ts: Column | str, seconds: int) -> Column:
    return F.window(ts, f"{seconds} seconds")["start"]


def window_service_summary(events: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch and service: count, dominant severity, distinct types, number of urgent events.

    The dominant severity goes by rank; an unknown severity wins over nothing but itself, and of equal
    ranks the first by name is taken.
    """
    severity = F.col("severity")
    best = F.min(F.struct((-severity_rank(severity)).alias("rank"), severity.alias("name")))
    return (
        with_defaults(events)
        .groupBy(batch, "service")
        .agg(
            F.count("*").alias("count"),
            best["name"].alias("dominant_severity"),
            F.sort_array(F.collect_set("incident_type")).alias("incident_types"),
            F.count_if(is_urgent(severity)).alias("urgent"),
        )
    )


def window_report(summary: DataFrame, window_seconds: int, batch: str = "batch_id", lists: bool = False) -> DataFrame:
    """The rule-based report per batch: counts and texts, and if wanted the nested lists of services."""
    entries = F.sort_array(F.collect_list(F.struct("service", "count", "dominant_severity", "incident_types")))
    totals = summary.groupBy(batch).agg(
        *([entries.alias("events_by_service")] if lists else []),
        F.sum("count").alias("event_count"),
        F.count("*").alias("services"),
        F.sum("urgent").alias("urgent_count"),
    )
    values = {
        "services": F.col("services"),
        "urgent": F.col("urgent_count"),
        "events": F.col("event_count"),
        "minutes": F.lit(window_seconds // 60),
    }
    urgent = F.col("urgent_count") > F.col("event_count") * 0.5
    return totals.select(
        batch,
        "event_count",
        F.lit(window_seconds).alias("window_seconds"),
        "services",
        "urgent_count",
        F.when(urgent, fill(fixed.URGENT_ASSESSMENT, **values))
        .otherwise(fill(fixed.CALM_ASSESSMENT, **values))
        .alias("overall_assessment"),
        F.when(urgent, fill(fixed.URGENT_PATTERN, **values)).alias("critical_pattern"),
        F.when(urgent, _texts(fixed.URGENT_ACTIONS)).otherwise(_texts(fixed.CALM_ACTIONS)).alias("recommended_actions"),
        F.lit("low").alias("hallucination_risk"),
        F.lit(40).alias("confidence_score"),
        F.lit(False).alias("llm_used"),
        *([F.col("events_by_service"), F.col("events_by_service.service").alias("services_affected")] if lists else []),
    )


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def nested_report(report: DataFrame, summary: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The report with its lists of services. One entry per service, whatever the number of events."""
    entry = F.struct("service", "count", "dominant_severity", "incident_types")
    lists = summary.groupBy(batch).agg(F.sort_array(F.collect_list(entry)).alias("events_by_service"))
    lists = lists.withColumn("services_affected", F.col("events_by_service.service"))
    return join_with_nulls(report, lists, [batch], "left")


def _empty_report(window_seconds: int) -> list[Column]:
    """The columns of a report on no events."""
    return [
        F.lit(0).cast("bigint").alias("event_count"),
        F.lit(window_seconds).alias("window_seconds"),
        F.lit(0).cast("bigint").alias("services"),
        F.lit(0).cast("bigint").alias("urgent_count"),
        F.lit(fixed.EMPTY_ASSESSMENT).alias("overall_assessment"),
        F.lit(None).cast("string").alias("critical_pattern"),
        F.array().cast("array<string>").alias("recommended_actions"),
        F.lit("low").alias("hallucination_risk"),
        F.lit(0).alias("confidence_score"),
        F.lit(False).alias("llm_used"),
    ]


def with_empty_windows(report: DataFrame, batch: str, window_seconds: int) -> DataFrame:
    """Adds the fixed report for every window without events between the first and the last one.

    `batch` is the window start. Each report row gives the starts between the report before and itself, so the span is
    never held in one array; the report before is found over blocks of the time axis.
    """
    step = F.expr(f"interval {window_seconds} seconds")
    starts = running(report.select(F.col(batch).alias("_to")).where("_to IS NOT NULL"), [], ["_to"], {}, {"_from": F.col("_to")})
    gaps = starts.where(F.col("_to") > F.col("_from") + step).select(
        F.explode(F.sequence(F.col("_from") + step, F.col("_to") - step, step)).alias(batch)
    )
    empty = gaps.select(batch, *_empty_report(window_seconds))
    return report.unionByName(empty)


def analyze_window(events: DataFrame, as_of: Column, seconds: int, service: str | None = None) -> DataFrame:
    """Report on the events that arrived within `seconds` before `as_of`; one row, also without events."""
    if not 60 <= seconds <= 3600:
        raise ValueError("the window must be 60 to 3600 seconds")
    recent = events.where(F.col("arrival_ts") >= as_of - F.expr(f"interval {seconds} seconds"))
    recent = recent.where(F.col("arrival_ts") <= as_of)
    if service is not None:
        recent = recent.where(F.col("service") == service)
    summary = window_service_summary(recent.withColumn("batch_id", F.lit(0)))
    report = window_report(summary, seconds, lists=True)
    none = (F.array().cast(EVENTS_BY_SERVICE).alias("events_by_service"), F.array().cast("array<string>").alias("services_affected"))
    empty = events.sparkSession.range(1).select(F.lit(0).alias("batch_id"), *_empty_report(seconds), *none)
    # the empty report is what is left where there is no other
    return report.unionByName(empty).orderBy(F.desc("event_count")).limit(1).drop("batch_id", "urgent_count")


# --- prompts ------------------------------------------------------------------------------------
def _line_values(unknown: str) -> dict[str, Column]:
    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(unknown))

    return {
        "service": given("service"),
        "severity": given("severity"),
        "kind": F.coalesce(F.nullif(F.col("incident_type"), F.lit("")), F.lit(unknown)),
        "source": given("source_system"),
    }


def window_prompt_lines(events: DataFrame, window_seconds: int, batch: str, order: tuple[str, ...]) -> DataFrame:
    """The analyst prompt as rows (batch, line_no, line): line 0 is the header, then one line per event.

    A prompt has a line per event and no bound, so it stays rows: a writer sorts on (batch, line_no).
    """
    numbered = running_totals(events, [batch], list(order), {"line_no": F.lit(1).cast("bigint")})
    values = _line_values("unknown") | {
        "line_no": F.col("line_no"),
        "message": cut(F.coalesce(F.col("message"), F.lit("")), 120),
    }
    template = "{line_no}. [{service}] severity={severity} type={kind} source={source} | {message}"
    lines = numbered.select(batch, "line_no", fill(template, **values).alias("line"))
    headers = events.groupBy(batch).agg(F.count("*").alias("n")).select(
        batch,
        F.lit(0).cast("bigint").alias("line_no"),
        fill(fixed.WINDOW_PROMPT_HEADER, events=F.col("n"), minutes=F.lit(window_seconds // 60)).alias("line"),
    )
    return headers.unionByName(lines)


JUDGE_EVENTS = 50


def judge_prompt(events: DataFrame, batch: str, order: tuple[str, ...]) -> DataFrame:
    """The event part of the judge prompt per batch: the total, and the first 50 events."""
    from pyspark.sql import Window

    first = Window.partitionBy(batch).orderBy(*order)
    ranked = events.withColumn("_no", F.row_number().over(first)).where(F.col("_no") <= JUDGE_EVENTS)
    values = _line_values("?") | {"no": F.col("_no"), "message": cut(F.coalesce(F.col("message"), F.lit("")), 80)}
    template = "{no}. service={service} severity={severity} type={kind} msg={message}"
    lines = ranked.groupBy(batch).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_no"), fill(template, **values).alias("line")))).alias("lines")
    )
    totals = events.groupBy(batch).agg(F.count("*").alias("total"))
    header = fill(
        "ACTUAL EVENTS ({total} total, showing first {shown}):\n",
        total=F.col("total"),
        shown=F.least(F.col("total"), F.lit(JUDGE_EVENTS)),
    )
    text = F.concat(header, F.array_join("lines.line", "\n"))
    return join_with_nulls(lines, totals, [batch]).select(batch, text.alias("prompt"))


def full_judge_prompt(reports: DataFrame, events: DataFrame, batch: str, order: tuple[str, ...]) -> DataFrame:
    """The whole judge prompt per batch: what the report says, then the events; nested reports."""
    head, tail = judge_report_header(reports, batch), judge_prompt(events, batch, order)
    return join_with_nulls(head, tail, [batch]).select(batch, F.concat("header", "prompt").alias("prompt"))


def judge_report_header(reports: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The report part of the judge prompt, from nested reports."""

    def quoted(items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))

    entries = F.transform(
        "events_by_service",
        lambda e: F.concat(
            F.lit("{'service': '"), e["service"], F.lit("', 'count': "), e["count"].cast("string"),
            F.lit(", 'dominant_severity': '"), e["dominant_severity"], F.lit("', 'incident_types': "),
            quoted(e["incident_types"]), F.lit("}"),
        ),
    )
    text = F.concat(
        F.lit("BATCH ANALYSIS REPORT:\nservices_affected: "), quoted(F.col("services_affected")),
        F.lit("\noverall_assessment: "), F.col("overall_assessment"),
        F.lit("\ncritical_pattern: "), F.coalesce("critical_pattern", F.lit("None")),
        F.lit("\nevents_by_service: ["), F.array_join(entries, ", "), F.lit("]\n\n"),
    )
    return reports.select(batch, text.alias("header"))
