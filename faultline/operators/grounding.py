"""Is a written window report backed by the events it was made from?

Reports have columns batch_id, services_affected ARRAY<STRING>, claimed_types ARRAY<STRING>,
overall_assessment and critical_pattern; events have batch_id, service, incident_type and severity.
Claims and facts meet in equi-joins on (batch_id, name), so no batch is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed
from faultline.functions.joins import join_with_nulls
from faultline.functions.numeric import clamp, round_half_even
from faultline.functions.text import fill
from faultline.operators.windows import is_urgent, with_defaults

BATCH = "batch_id"


def event_entities(events: DataFrame) -> DataFrame:
    """The distinct services and types per batch: (batch_id, kind, name)."""
    pair = F.explode(
        F.array(
            F.struct(F.lit("service").alias("kind"), F.col("service").alias("name")),
            F.struct(F.lit("type").alias("kind"), F.col("incident_type").alias("name")),
        )
    )
    # distinct pairs first, so that the explode works on few rows
    pairs = with_defaults(events).select(BATCH, "service", "incident_type").distinct()
    return pairs.select(BATCH, pair.alias("e")).select(BATCH, "e.kind", "e.name").distinct()


def event_severity(events: DataFrame) -> DataFrame:
    """Events and urgent events per batch."""
    counted = with_defaults(events).groupBy(BATCH)
    return counted.agg(F.count("*").alias("event_count"), F.count_if(is_urgent(F.col("severity"))).alias("urgent_count"))


def event_facts(events: DataFrame) -> DataFrame:
    """What the checks need to know about a batch, as counts."""
    entities = event_entities(events).groupBy(BATCH).agg(
        F.count_if(F.col("kind") == "service").alias("services"), F.count_if(F.col("kind") == "type").alias("types")
    )
    return join_with_nulls(event_severity(events), entities, [BATCH])


def _grounding(reports: DataFrame, entities: DataFrame, kind: str, claims: Column) -> DataFrame:
    """Per batch: the share of claims found among the batch's entities, and the ones not found."""
    real = entities.where(F.col("kind") == kind).select(BATCH, F.col("name"), F.lit(True).alias("_real"))
    claimed = reports.select(BATCH, F.posexplode(claims).alias("_at", "name"))
    checked = claimed.join(real, [BATCH, "name"], "left")
    # claims come from one report's list, so gathering them again is bounded by that list
    missing = F.sort_array(F.collect_list(F.when(F.col("_real").isNull(), F.struct("_at", "name"))))
    found = F.count("_real") / F.count("*")
    return checked.groupBy(BATCH).agg(
        found.alias(f"{kind}_ratio"), missing["name"].alias(f"ungrounded_{kind}s")
    )


def services_grounding(reports: DataFrame, entities: DataFrame) -> DataFrame:
    """Every claimed service counts, also a repeated one."""
    return _grounding(reports, entities, "service", F.col("services_affected"))


def types_grounding(reports: DataFrame, entities: DataFrame) -> DataFrame:
    """Claimed types are a set; they come out in name order."""
    return _grounding(reports, entities, "type", F.sort_array(F.array_distinct("claimed_types")))


def pattern_grounding(reports: DataFrame, entities: DataFrame) -> DataFrame:
    """True where the pattern names one of the batch's services or types, in any letter case."""
    patterns = reports.where(F.col("critical_pattern").isNotNull()).select(BATCH, F.lower("critical_pattern").alias("_text"))
    named = patterns.join(entities, BATCH, "left").groupBy(BATCH)
    hit = F.max(F.coalesce(F.col("_text").contains(F.lower("name")), F.lit(False)))
    return named.agg(hit.alias("pattern_grounded"))


def severity_consistent(assessment: Column, events: Column, urgent: Column) -> Column:
    """Half or more urgent events call for urgent words, under a fifth forbid them."""
    text = F.lower(assessment)
    says = F.lit(False)
    for word in fixed.URGENT_WORDS:
        says = says | text.contains(word)
    share = urgent / events
    return (
        F.when(F.coalesce(events, F.lit(0)) == 0, True)
        .when((share >= 0.5) & ~says, False)
        .when((share < 0.2) & says, False)
        .otherwise(True)
    )


def rule_score(services: Column, types: Column, pattern: Column, severity: Column) -> Column:
    score = services * 40 + types * 30 + F.when(pattern, 10).otherwise(0) + F.when(severity, 20).otherwise(0)
    return score.cast("int")


def verdict(score: Column) -> Column:
    return F.when(score >= 80, "faithful").when(score >= 40, "partially_faithful").otherwise("hallucinated")


def rule_checks(reports: DataFrame, events: DataFrame) -> DataFrame:
    """One row per report: the four checks, the score, the verdict and the claims not backed."""
    entities = event_entities(events)
    joined = (
        reports.join(services_grounding(reports, entities), BATCH, "left")
        .join(types_grounding(reports, entities), BATCH, "left")
        .join(pattern_grounding(reports, entities), BATCH, "left")
        .join(event_severity(events), BATCH, "left")
    )
    consistent = severity_consistent(F.col("overall_assessment"), F.col("event_count"), F.col("urgent_count"))
    checked = joined.select(
        BATCH,
        round_half_even(F.coalesce("service_ratio", F.lit(1.0)), 3).alias("services_ratio"),
        round_half_even(F.coalesce("type_ratio", F.lit(1.0)), 3).alias("types_ratio"),
        F.coalesce("pattern_grounded", F.col("critical_pattern").isNull()).alias("pattern_grounded"),
        consistent.alias("severity_consistent"),
        "ungrounded_services",
        "ungrounded_types",
    )
    score = rule_score(
        F.col("services_ratio"), F.col("types_ratio"), F.col("pattern_grounded"), F.col("severity_consistent")
    )
    scored = checked.withColumn("rule_score", score)
    return scored.select(
        BATCH, "services_ratio", "types_ratio", "pattern_grounded", "severity_consistent", "rule_score",
        verdict(F.col("rule_score")).alias("rule_verdict"), _claims().alias("ungrounded_claims"),
    )


def _claims() -> Column:
    none = F.array().cast("array<string>")

    def named(column: str, template: str) -> Column:
        return F.transform(F.coalesce(F.col(column), none), lambda x: fill(template, name=x))

    return F.concat(
        named("ungrounded_services", fixed.CLAIM_SERVICE),
        named("ungrounded_types", fixed.CLAIM_TYPE),
        F.when(~F.col("pattern_grounded"), F.array(F.lit(fixed.CLAIM_PATTERN))).otherwise(none),
        F.when(~F.col("severity_consistent"), F.array(F.lit(fixed.CLAIM_SEVERITY))).otherwise(none),
    )


def parse_judge(judge: DataFrame) -> DataFrame:
    """batch_id, judge_json -> judge_score 0..100, judge_claims, judge_verdict; unreadable rows are left out.

    A missing score is 50; a score that is no number makes the row unreadable.
    """
    v = F.try_parse_json("judge_json")
    score = F.try_variant_get(v, "$.faithfulness_score", "double")
    absent = F.try_variant_get(v, "$.faithfulness_score", "variant").isNull()
    whole = F.when(absent, F.lit(50)).otherwise(clamp(score, -1.0, 101.0).cast("int"))
    claims = F.try_variant_get(v, "$.ungrounded_claims", "array<string>")
    given = F.try_variant_get(v, "$.verdict", "string")
    out = judge.select(
        BATCH, clamp(whole, 0, 100).alias("judge_score"), F.coalesce(claims, F.array().cast("array<string>")).alias("judge_claims"),
        given.alias("_verdict"), v.try_cast("map<string,variant>").isNotNull().alias("_object"),
    ).where(F.col("_object") & F.col("judge_score").isNotNull())
    kept = F.when(F.col("_verdict").isin(*fixed.VERDICTS), F.col("_verdict"))
    missing = F.when(F.col("_verdict").isNull(), F.lit("partially_faithful"))
    return out.select(
        BATCH, "judge_score", "judge_claims",
        F.coalesce(kept, missing, verdict(F.col("judge_score"))).alias("judge_verdict"),
    )


def faithfulness(reports: DataFrame, events: DataFrame, judge: DataFrame | None = None) -> DataFrame:
    """Rule checks per report, averaged with the judge's score where there is one."""
    checks = rule_checks(reports, events)
    if judge is None:
        final = checks.withColumns({"judge_score": F.lit(None).cast("int"), "judge_claims": F.lit(None).cast("array<string>")})
    else:
        final = checks.join(parse_judge(judge), BATCH, "left")
    used = F.col("judge_score").isNotNull()
    score = F.when(used, F.floor((F.col("rule_score") + F.col("judge_score")) / 2).cast("int")).otherwise(F.col("rule_score"))
    claims = F.when(used & (F.size("judge_claims") > 0), F.col("judge_claims")).otherwise(F.col("ungrounded_claims"))
    return final.withColumns({"faithfulness_score": score, "llm_used": used, "ungrounded_claims": claims}).select(
        BATCH, "faithfulness_score", verdict(F.col("faithfulness_score")).alias("verdict"), "services_ratio",
        "types_ratio", "pattern_grounded", "severity_consistent", "ungrounded_claims", "llm_used",
    )
