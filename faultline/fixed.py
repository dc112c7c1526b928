"""Values that must be equal to the ones incident producers and readers already use.

Everything in this module is a fixed value: word lists, thresholds, texts and bucket bounds.
"""

# --- enumerations -----------------------------------------------------------------------------
SEVERITIES = ("low", "medium", "high", "critical")
SOURCE_SYSTEMS = ("spring-boot", "kafka", "mysql", "generic")
INCIDENT_TYPES = ("schema_error", "technical_error", "semantic_error", "degradation")
STATUSES = ("ok", "needs_attention", "critical")
ACTIONS = ("monitor", "retry", "inspect_prompt", "inspect_schema", "check_provider", "escalate")
HEALTH_STATUSES = ("healthy", "degraded", "critical", "unstable")
HEALTH_TRENDS = ("improving", "stable", "degrading")
RISKS = ("low", "medium", "high")
VERDICTS = ("faithful", "partially_faithful", "hallucinated")

# --- normalization ----------------------------------------------------------------------------
LOG_LEVEL_SEVERITY = {
    "fatal": "critical",
    "error": "high",
    "warn": "medium",
    "warning": "medium",
    "info": "low",
    "debug": "low",
    "trace": "low",
}
GENERIC_SEVERITY = {
    "critical": "critical",
    "high": "high",
    "error": "high",
    "medium": "medium",
    "warning": "medium",
    "warn": "medium",
    "low": "low",
    "info": "low",
}
DEFAULT_SEVERITY = "medium"
UNKNOWN_SERVICE = "unknown-service"
WEBHOOK_SEVERITY = ("severity", "level", "priority", "urgency")
WEBHOOK_MESSAGE = ("message", "summary", "description", "text", "body", "title", "alert_name")
WEBHOOK_SERVICE = ("service", "service_name", "component", "source", "app", "application", "name")
WEBHOOK_TIMESTAMP = ("timestamp", "fired_at", "created_at", "time", "event_time", "occurred_at")
STAGE_OF_SOURCE = {"spring-boot": "service", "kafka": "stream", "mysql": "database", "generic": "external"}
# error text -> error type, the first hit wins
KAFKA_ERROR_WORDS = (
    (("lag",), "consumer_lag"),
    (("timeout", "timed out"), "timeout_exceeded"),
    (("schema", "deserialization"), "schema_validation_failed"),
    (("dlq", "dead letter"), "dlq_entry"),
)
# error type -> incident type, the first hit wins
INCIDENT_TYPE_WORDS = (
    (("schema", "validation", "json"), "schema_error"),
    (("semantic", "quality", "hallucin", "factual"), "semantic_error"),
    (("degradation", "latency", "slow", "timeout"), "degradation"),
)
DEFAULT_INCIDENT_TYPE = "technical_error"

# --- rule table: (type, severity band) -> outcome -----------------------------------------------
SCHEMA_TEXT = (
    "Schema validation failure detected in the workflow.",
    "The incident was classified as a schema error, which means the LLM output could not be safely "
    "consumed by downstream components.",
)
TECHNICAL_CRITICAL_TEXT = (
    "Critical technical failure detected in the workflow.",
    "A high-severity technical error suggests that the workflow was interrupted by infrastructure, "
    "provider, or runtime issues.",
)
TECHNICAL_TEXT = (
    "Technical issue detected in the workflow.",
    "The incident was classified as a technical error, but its current severity does not indicate a "
    "full critical failure.",
)
SEMANTIC_TEXT = (
    "Semantic quality issue detected in the workflow output.",
    "The model produced an output that is structurally valid but may be incorrect, misleading, or "
    "not useful for the intended task.",
)
DEGRADATION_TEXT = (
    "Workflow degradation detected.",
    "The workflow is still operating, but signals indicate worsening performance or reliability over time.",
)
UNCLASSIFIED_TEXT = (
    "Unclassified incident received by evaluation service.",
    "The evaluation service received an incident that could not be matched to a specialized evaluation rule.",
)
# type, severities, status, score, action, third tag, (summary, reasoning)
EVALUATION_RULES = (
    ("schema_error", ("high", "critical"), "critical", 85, "inspect_schema", "stage", SCHEMA_TEXT),
    ("schema_error", ("low", "medium"), "critical", 70, "inspect_schema", "stage", SCHEMA_TEXT),
    ("technical_error", ("high", "critical"), "critical", 80, "check_provider", "source", TECHNICAL_CRITICAL_TEXT),
    ("technical_error", ("low", "medium"), "needs_attention", 60, "monitor", "source", TECHNICAL_TEXT),
    ("semantic_error", ("high", "critical"), "needs_attention", 65, "inspect_prompt", "workflow", SEMANTIC_TEXT),
    ("semantic_error", ("low", "medium"), "needs_attention", 50, "inspect_prompt", "workflow", SEMANTIC_TEXT),
    ("degradation", ("high", "critical"), "needs_attention", 70, "monitor", "workflow", DEGRADATION_TEXT),
    ("degradation", ("low", "medium"), "needs_attention", 55, "monitor", "workflow", DEGRADATION_TEXT),
)
DEFAULT_OUTCOME = ("needs_attention", 50, "escalate", UNCLASSIFIED_TEXT)

# --- action texts -----------------------------------------------------------------------------
ACTION_DETAIL = {
    "monitor": "Enhanced monitoring activated for workflow '{workflow}' (stage: {stage}). "
    "Elevated alert threshold: severity≥{severity}.",
    "retry": "Retry scheduled ({mode}) for workflow '{workflow}' at stage '{stage}'. Reason: {message}.",
    "inspect_prompt": "Prompt review ticket created for workflow '{workflow}' (category: {category}, "
    "incidentType: {incident_type}). Assignee: prompt-engineering-team.",
    "inspect_schema": "Schema review ticket created for workflow '{workflow}' (stage: {stage}, "
    "incidentType: {incident_type}). Attach full incident payload for schema diff analysis.",
    "check_provider": "Provider health check completed for workflow '{workflow}'. Provider status: operational. "
    "Source: {source}. Recommendation: monitor and retry.",
    "escalate": "Escalation triggered via {channel} for workflow '{workflow}' | severity: {severity} "
    "| score: {score} | message: {message_120}",
}
ESCALATION_CHANNEL = {
    "critical": "PagerDuty (immediate page)",
    "high": "Slack #ops-alerts",
    "medium": "Jira (medium priority)",
    "low": "Jira (low priority)",
}
TOOL_DETAIL = {
    "monitor": "Enhanced monitoring activated for workflow '{workflow}' based on LLM analysis: {reason}",
    "retry": "Retry scheduled ({mode}) for workflow '{workflow}'. LLM reasoning: {reason}",
    "inspect_prompt": "Prompt review ticket created for workflow '{workflow}'. LLM identified issue: {reason}",
    "inspect_schema": "Schema review ticket created for workflow '{workflow}'. LLM detected problem: {reason}",
    "check_provider": "Provider health check initiated for workflow '{workflow}'. LLM suspected: {reason}",
    "escalate": "Escalation triggered via {channel} for workflow '{workflow}'. LLM reasoning: {reason}",
}
TOOL_CHANNEL = {**ESCALATION_CHANNEL, "critical": "PagerDuty (immediate)"}
TOOL_BASE_SCORE = {"low": 20, "medium": 40, "high": 70, "critical": 90}

# --- window reports ---------------------------------------------------------------------------
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
URGENT_ASSESSMENT = (
    "High volume of critical/high severity incidents across {services} service(s). "
    "{urgent} of {events} events require immediate attention."
)
URGENT_PATTERN = "Elevated error rate: {urgent}/{events} events are high/critical severity"
URGENT_ACTIONS = (
    "Investigate affected services immediately",
    "Check infrastructure health",
    "Consider rollback if recent deployment",
)
CALM_ASSESSMENT = (
    "Received {events} incident event(s) across {services} service(s) in the last {minutes} minutes. "
    "No critical pattern detected by rule-based analysis."
)
CALM_ACTIONS = ("Monitor situation", "Review individual incident logs")
EMPTY_ASSESSMENT = "No events in the current window."
WINDOW_PROMPT_HEADER = (
    "You have received {events} incident event(s) in the last {minutes} minutes.\n"
    "Analyze the pattern and identify what is happening across all services.\n\nINCIDENTS:"
)

# --- grounding --------------------------------------------------------------------------------
URGENT_WORDS = ("critical", "urgent", "immediate", "severe", "emergency")
CLAIM_SERVICE = "Service '{name}' mentioned but not found in events"
CLAIM_TYPE = "Incident type '{name}' mentioned but not observed in events"
CLAIM_PATTERN = "critical_pattern references entities not found in events"
CLAIM_SEVERITY = "overall_assessment severity inconsistent with actual event distribution"

# --- retrieval --------------------------------------------------------------------------------
CONTEXT_HEADER = (
    "## Historical Context — Similar Past Incidents\n\n"
    "The following incidents from the operational history are semantically similar\n"
    "to the current one and may provide useful signal for evaluation:\n\n"
)

# --- histogram bounds -------------------------------------------------------------------------
SCORE_BOUNDS = (10, 20, 30, 40, 50, 60, 70, 80, 90, 100)
RETRIEVAL_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
EMBEDDING_BOUNDS = (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0)
FOUND_BOUNDS = (0, 1, 2, 3, 4, 5)
BATCH_EVENT_BOUNDS = (0, 1, 5, 10, 25, 50, 100, 250, 500)
FAITHFULNESS_BOUNDS = (0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100)

# --- reliability ------------------------------------------------------------------------------
# rate name, warn, critical, label in the issue text, two actions
KPI_RULES = (
    ("retry_rate", 0.05, 0.2, "retry rate", (
        "Investigate provider latency/timeouts (review timeoutMs and provider response times).",
        "If retries remain high, tune fallback policy or reduce maxAttempts to fail fast.")),
    ("fallback_rate", 0.01, 0.05, "fallback rate", (
        "Primary provider may be unstable—check status, rate limits, and error responses.",
        "Consider routing traffic to secondary provider earlier or adding provider health checks.")),
    ("recovery_fail_rate", 0.05, 0.2, "recovery fail rate", (
        "Recovery prompt may be weak—review and strengthen the JSON repair prompt.",
        "Add golden tests for prompt outputs and consider a second repair strategy.")),
)
RETRYABLE_CODES = ("ETIMEDOUT", "ECONNRESET", "EAI_AGAIN", "ENOTFOUND", "ECONNREFUSED")
ALERT_NAME = "LLM_HEALTH_CRITICAL"
ALERT_MESSAGE = "LLM pipeline health is CRITICAL (retries/timeouts/failures above threshold)."
COPILOT_CAUSE = "Likely transient upstream instability or timeout pressure; not enough signals to be sure."
COPILOT_ACTIONS = (
    "Check provider/service status and recent latency trends",
    "Inspect recent timeouts/errors around the same timestamp",
    "Consider increasing timeout or enabling fallback for stability",
    "If recurring, add signature + clustering for this failure mode",
)
COPILOT_BAD_JSON = (
    "Copilot could not parse model output as JSON.",
    "Model returned invalid JSON.",
    ("Check model/provider response format",
     "Enable JSON-only mode / tool mode if available",
     "Log raw output for debugging"),
    0.2,
)
COPILOT_BAD_SHAPE = (
    "Copilot output failed validation.",
    "Model returned JSON that does not match the expected schema.",
    ("Inspect schema mismatch details in logs",
     "Tighten prompt instructions (JSON keys + types)",
     "Add repair step or fallback to deterministic heuristics"),
    0.25,
)

# --- routing ----------------------------------------------------------------------------------
ROUTING_NODES = {
    "direct_action": "execute_action",
    "staged_execution": "prepare_staged_action",
    "escalate": "escalate_incident",
    "conservative_approach": "conservative_action",
    "monitor_only": "monitor_and_wait",
}
# rule name, conditions (list: one of; number: at least), action, priority
ROUTING_RULES = (
    ("critical_incident_fast_track",
     {"severity": ["critical"], "health_status": ["healthy", "degraded"]}, "direct_action", 1),
    ("high_load_cautious", {"workload": ["high", "overload"], "severity": ["medium", "high"]}, "staged_execution", 2),
    ("repeated_incident_escalation", {"similar_incidents_1h": 3}, "escalate", 1),
    ("degraded_system_conservative", {"health_status": ["degraded", "unhealthy"]}, "conservative_approach", 3),
)

# --- prompts ------------------------------------------------------------------------------------
# fixed values: texts that prompts must have
REPAIR_PROMPT = (
    "\nThe previous response was not valid JSON.\n\nReturn ONLY valid JSON.\n"
    "Do not include explanations, markdown or extra text.\n\nInvalid response:\n{output}\n"
)
INCIDENT_PROMPT = (
    "\nAnalyze this LLM pipeline incident:\n\nWorkflow: {workflow}\nStage: {stage}\nSource: {source}\nType: {incident_type}\n"
    "Category: {category}\nSeverity: {severity}\nMessage: {message}\nTimestamp: {timestamp}\n\n"
    "Please analyze this incident and call appropriate tools to address it."
)
COPILOT_SYSTEM = (
    "You are an Incident Copilot for backend + LLM systems. "
    "Your job is to interpret telemetry (KPIs, issues, health) and propose next steps. "
    "Be concise, practical, and avoid speculation. If unsure, say so. "
    "Return ONLY valid JSON with keys: summary, probableCause, suggestedActions, confidence. "
    "confidence must be a number between 0 and 1."
)
