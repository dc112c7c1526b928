"""Rule scoring, tool scoring and action dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import fixed
from faultline.functions.text import cut, fill, lookup

RULE_SCHEMA = (
    "rule_type string, rule_severity string, rule_status string, rule_score int, "
    "rule_action string, rule_tag string, rule_summary string, rule_reasoning string"
)


def evaluation_rules(spark: SparkSession, rules=fixed.EVALUATION_RULES) -> DataFrame:
    """The rule table, one row per incident type and severity, and one per type with a null severity for any other.

    There are two bands: what is neither high nor critical is in the lower one, whatever it is called.
    """
    rows = [
        (kind, severity, status, score, action, tag, *texts)
        for kind, severities, status, score, action, tag, texts in rules
        for severity in (severities if "high" in severities else (*severities, None))
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def evaluate_incidents(df: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Adds status, score, summary, reasoning, suggested_action and tags.

    A rule with a null severity holds for the severities of its type that have no rule of their own. The built-in rule
    table is made from a list on the driver, so it is always small enough to broadcast. How a caller's table is joined is
    left to the optimizer; a (type, severity) that it holds twice is an error, as it would double incidents.
    """
    small = F.broadcast if rules is None else lambda x: x
    if rules is None:
        rules = evaluation_rules(df.sparkSession)
    elif not rules.groupBy("rule_type", "rule_severity").count().where("count > 1").isEmpty():
        raise ValueError("a rule table holds one row per type and severity")
    # one row per type, so that no incident meets two rules: the outcomes by severity, and the one for any other
    outcome = F.struct("rule_status", "rule_score", "rule_action", "rule_tag", "rule_summary", "rule_reasoning")
    own = F.collect_list(F.when(F.col("rule_severity").isNotNull(), F.struct(F.col("rule_severity"), outcome)))
    by_type = rules.groupBy("rule_type").agg(
        F.map_from_entries(own).alias("_own"), F.first(F.when(F.col("rule_severity").isNull(), outcome), True).alias("_other")
    )
    status, score, action, (summary, reasoning) = fixed.DEFAULT_OUTCOME
    third = (
        F.when(F.col("rule_tag") == "stage", F.col("stage"))
        .when(F.col("rule_tag") == "source", F.col("source"))
        .otherwise(F.col("workflow"))
    )
    tags = F.when(F.col("rule_type").isNull(), F.array(F.lit("unclassified"))).otherwise(
        F.array(F.col("rule_type"), F.col("category"), third)
    )
    joined = df.join(small(by_type), F.col("incident_type") == F.col("rule_type"), "left")
    # a null severity is any other one, too
    found = F.coalesce(F.when(F.col("severity").isNotNull(), F.try_element_at("_own", F.col("severity"))), F.col("_other"))
    joined = joined.withColumn("_rule", found)
    names = [f.name for f in rules.schema.fields if f.name not in ("rule_type", "rule_severity")]
    joined = joined.withColumn("rule_type", F.when(F.col("_rule").isNotNull(), F.col("rule_type"))).select(
        *df.columns, "rule_type", *[F.col(f"_rule.{n}").alias(n) for n in names]
    )
    return joined.select(
        *df.columns,
        F.coalesce("rule_status", F.lit(status)).alias("status"),
        F.coalesce("rule_score", F.lit(score)).alias("score"),
        F.coalesce("rule_summary", F.lit(summary)).alias("summary"),
        F.coalesce("rule_reasoning", F.lit(reasoning)).alias("reasoning"),
        F.coalesce("rule_action", F.lit(action)).alias("suggested_action"),
        tags.alias("tags"),
    )


# --- actions ------------------------------------------------------------------------------------
def dispatch_actions(df: DataFrame) -> DataFrame:
    """Evaluated incidents -> action log, one row per incident that needs an action."""
    action = F.col("suggested_action")
    values = {
        "workflow": F.col("workflow"),
        "stage": F.col("stage"),
        "severity": F.col("severity"),
        "message": F.col("message"),
        "category": F.col("category"),
        "incident_type": F.col("incident_type"),
        "source": F.col("source"),
        "score": F.col("score"),
        "mode": F.when(F.col("severity") == "critical", "immediate").otherwise("deferred (60 s backoff)"),
        "channel": lookup(F.col("severity"), fixed.ESCALATION_CHANNEL, "Jira"),
        "message_120": cut(F.col("message"), 120),
    }
    detail = _by_name(action, fixed.ACTION_DETAIL, values, fill("No handler for action '{a}'", a=action))
    return df.where((F.col("status") != "ok") & action.isNotNull()).select(
        F.concat(F.lit("act_"), F.sha2(F.col("record_id").cast("string"), 256)).alias("action_id"),
        "record_id",
        F.col("received_at").alias("executed_at"),
        action.alias("action_type"),
        F.when(action.isin(*fixed.ACTIONS), "success").otherwise("failed").alias("outcome"),
        detail.alias("detail"),
        "workflow",
        "severity",
    )


def _by_name(name: Column, templates: dict[str, str], values: dict[str, Column], otherwise: Column) -> Column:
    result: Column | None = None
    for key, template in templates.items():
        text = fill(template, **values)
        result = F.when(name == key, text) if result is None else result.when(name == key, text)
    return result.otherwise(otherwise)


# --- tool calls ---------------------------------------------------------------------------------
TOOL_CALLS = "array<struct<id:string,function:string,arguments:string>>"
TOOL_ARGUMENTS = "struct<workflow:string,severity:string,reason:string>"


def tool_score(severity: Column, tools: Column) -> Column:
    base = lookup(severity, fixed.TOOL_BASE_SCORE, 50)
    return (
        F.when(tools == 0, F.greatest(F.lit(10), base - 20))
        .when(tools > 2, F.least(F.lit(95), base + 15))
        .otherwise(base)
    )


def score_status(score: Column) -> Column:
    return F.when(score <= 40, "ok").when(score <= 80, "needs_attention").otherwise("critical")


def dispatch_tool_calls(df: DataFrame, unknown_succeeds: bool = False) -> DataFrame:
    """record_id, tool_calls_json (a list of {id, function, arguments}) -> one row per call.

    A call whose arguments are no JSON object with workflow, severity and reason fails. A call of an
    unknown function fails too, unless `unknown_succeeds`.
    """
    calls = F.from_json("tool_calls_json", TOOL_CALLS)
    rows = df.select("record_id", F.posexplode(calls).alias("position", "call"))
    args = F.from_json("call.arguments", TOOL_ARGUMENTS)
    rows = rows.select("record_id", "position", "call.id", "call.function", args.alias("args"))
    name, given = F.col("function"), F.col("args")
    valid = F.coalesce(
        given.workflow.isNotNull() & given.severity.isNotNull() & given.reason.isNotNull(), F.lit(False)
    )
    values = {
        "workflow": given.workflow,
        "reason": given.reason,
        "mode": F.when(given.severity == "critical", "immediate").otherwise("deferred"),
        "channel": lookup(given.severity, fixed.TOOL_CHANNEL, "Jira"),
    }
    detail = _by_name(name, fixed.TOOL_DETAIL, values, fill("Unknown tool function: {f}", f=name))
    known = F.lit(True) if unknown_succeeds else name.isin(*fixed.TOOL_DETAIL)
    return rows.select(
        "record_id",
        "position",
        F.col("id").alias("tool_call_id"),
        "function",
        F.when(valid & known, "success").otherwise("failed").alias("outcome"),
        F.when(valid, detail).otherwise("Tool execution error: invalid arguments").alias("detail"),
        valid.alias("accepted"),
    )


def tool_call_log(calls: DataFrame) -> DataFrame:
    """Calls per record: how many were accepted, how many succeeded."""
    return calls.groupBy("record_id").agg(
        F.count_if("accepted").alias("total_tools"),
        F.count_if(F.col("outcome") == "success").alias("successful_tools"),
    )


def evaluate_with_tools(df: DataFrame, log: DataFrame) -> DataFrame:
    """Incidents with the number of accepted tool calls -> score and status from severity and tools."""
    joined = df.join(log, "record_id", "left").withColumn("total_tools", F.coalesce("total_tools", F.lit(0)))
    scored = joined.withColumn("score", tool_score(F.col("severity"), F.col("total_tools")))
    return scored.withColumns(
        {
            "status": score_status(F.col("score")),
            "summary": fill("LLM analysis with {n} tool call(s)", n=F.col("total_tools")),
            "suggested_action": F.lit(None).cast("string"),
            "tags": F.array("incident_type", "category", "workflow"),
        }
    )


# --- health -------------------------------------------------------------------------------------
def health_of_status(status: Column) -> Column:
    return lookup(
        status, {"ok": "healthy", "needs_attention": "degraded", "critical": "critical"}, "unstable"
    )


def workflow_health(df: DataFrame, recent_since: Column | None = None) -> DataFrame:
    """The latest evaluation per workflow as its health; counts incidents since `recent_since`."""
    newest = F.max_by(F.struct("status", "score"), F.struct("received_at", "record_id"))
    recent = F.lit(True) if recent_since is None else F.col("received_at") >= recent_since
    return df.groupBy("workflow").agg(newest.alias("last"), F.count_if(recent).alias("recent_incident_count")).select(
        "workflow",
        health_of_status(F.col("last.status")).alias("status"),
        F.col("last.score").alias("score"),
        F.lit("stable").alias("trend"),
        "recent_incident_count",
    )


def cycle_summary(records: DataFrame, actions: DataFrame, hits: DataFrame, cycle: str = "cycle_id") -> DataFrame:
    """Records, actions and retrieval hits per cycle."""
    parts = [
        records.select(cycle, F.lit(1).alias("r"), F.lit(0).alias("a"), F.lit(0).alias("h")),
        actions.select(cycle, F.lit(0).alias("r"), F.lit(1).alias("a"), F.lit(0).alias("h")),
        hits.select(cycle, F.lit(0).alias("r"), F.lit(0).alias("a"), F.lit(1).alias("h")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy(cycle).agg(
        F.sum("r").alias("records"), F.sum("a").alias("actions"), F.sum("h").alias("retrieval_hits")
    )
