"""Review tasks, their state as events change it, and stable codes for errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that must be known, with their names and the priority of asking for them (fixed values).
MANDATORY = (("identity.legal_name", "legal name", "high"), ("identity.tax_id", "tax ID", "urgent"), ("identity.registration_number", "registration number", "urgent"), ("identity.address", "headquarters address", "high"), ("leadership.ceo", "chief executive", "high"))
#: From which states each action is allowed (None: from all), and to which state it leads (fixed values).
ACTIONS = {"claim": (("open", "reopened", "changes_requested"), "in_review"), "release": (None, "open"), "complete": (None, "completed"), "reopen": (None, "reopened")}


def review_tasks(conflicts: DataFrame, rejected: DataFrame, outcomes: DataFrame, gaps: DataFrame) -> DataFrame:
    """workspace_id, company_id, job_id, task_type, title, priority of the tasks that follow, each title once for a job.

    conflicts has field_key and materiality, rejected url and reason, outcomes provider and outcome, gaps field_key; all
    have the three ids.
    """
    ids = ["workspace_id", "company_id", "job_id"]
    task = lambda df, kind, title, priority: df.select(*ids, F.lit(kind).alias("task_type"), title.alias("title"), priority.alias("priority"))
    by_materiality = F.when(F.col("materiality") == "critical", "urgent").when(F.col("materiality") == "high", "high").otherwise("medium")
    asked = F.create_map(*[F.lit(x) for f, label, priority in MANDATORY for x in (f, F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority")))])[F.col("field_key")]
    parts = [
        task(conflicts, "field_conflict", F.concat(F.lit("Review conflicting value for "), "field_key"), by_materiality),
        task(rejected.where(F.contains("reason", F.lit("ENTITY_MATCH_REVIEW_REQUIRED"))), "identity_ambiguity", F.concat(F.lit("Review source identity match: "), "url"), F.lit("high")),
        task(outcomes.where(F.col("outcome").isin("blocked", "manual_required", "unavailable")), "source_verification", F.concat(F.lit("Verify source provider availability: "), "provider"), F.when(F.col("outcome") == "manual_required", "medium").otherwise("high")),
        task(gaps, "high_impact_fact", F.concat(F.lit("Verify mandatory high-impact field: "), F.coalesce(asked["label"], "field_key")), F.coalesce(asked["priority"], F.lit("high"))),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.groupBy(*ids, "task_type", "title").agg(F.min("priority").alias("priority"))


#: Actions that lead to a state from all states, and the one that some states refuse. Where a claim was taken, or refused, all
#: further ones are refused until another action leads elsewhere; so of claims in a row only the first may count.
_ALWAYS = {name: to for name, (states, to) in ACTIONS.items() if states is None}
_FROM, _TO = ACTIONS["claim"]

#: What sums up a run of events of a task, whatever state it begins in.
CHANGE = "head bigint, head_actor string, status string, named boolean, who string, done bigint, refused bigint"


def summed(events: DataFrame) -> DataFrame:
    """task_id and what a run of events (task_id, seq, action, actor) does to each task: one row a task, by one sort of narrow rows.

    head counts the claims before the first other action, of which the state before decides whether the first is taken
    (head_actor); all else is known: the status after, if any is reached, whether someone or nobody is then assigned, and how
    many events are done and refused.
    """
    w = Window.partitionBy("task_id").orderBy("seq", "action", "actor")
    here = w.rowsBetween(Window.unboundedPreceding, 0)
    to = F.create_map(*[F.lit(x) for kv in _ALWAYS.items() for x in kv])[F.col("action")]
    claim = F.coalesce(F.col("action") == "claim", F.lit(False))
    rows = events.select("task_id", "seq", "action", "actor", to.alias("__to"), claim.alias("__claim"))
    rows = rows.withColumns({"__at": F.row_number().over(w), "__state": F.last("__to", ignorenulls=True).over(here), "__n": F.count_if("__claim").over(here)})
    rows = rows.withColumn("__before", F.coalesce(F.last(F.when(F.col("__to").isNotNull(), F.col("__n")), ignorenulls=True).over(here), F.lit(0)))
    taken = F.coalesce(F.col("__claim") & (F.col("__n") == F.col("__before") + 1) & F.col("__state").isin(*_FROM), F.lit(False))
    head, done = F.col("__claim") & F.col("__state").isNull(), taken | F.col("__to").isNotNull()
    names, at = taken | F.coalesce(F.col("action") == "release", F.lit(False)), F.col("__at")
    return rows.groupBy("task_id").agg(
        F.count_if(head).alias("head"), F.min_by("actor", F.when(head, at)).alias("head_actor"), F.max_by(F.when(taken, _TO).otherwise(F.col("__to")), F.when(done, at)).alias("status"),
        F.max(names).alias("named"), F.max_by(F.when(taken, F.col("actor")), F.when(names, at)).alias("who"), F.count_if(done).alias("done"), F.count_if(~done & ~head).alias("refused"),
    )


def after(before: Column, change: Column) -> Column:
    """The state (status, who, done, refused) of a task after a run of events that is summed up."""
    took = (change["head"] > 0) & before["status"].isin(*_FROM)
    status = F.coalesce(change["status"], F.when(took, _TO).otherwise(before["status"]))
    who = F.when(change["named"], change["who"]).when(took, change["head_actor"]).otherwise(before["who"])
    done, refused = before["done"] + change["done"] + took.cast("long"), before["refused"] + change["refused"] + change["head"] - took.cast("long")
    return F.struct(status.alias("status"), who.alias("who"), done.alias("done"), refused.alias("refused"))


def opened() -> Column:
    """The state in which a task begins."""
    return F.struct(F.lit("open").alias("status"), F.lit(None).cast("string").alias("who"), F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("refused"))


def shown_state(rows: DataFrame, end: Column) -> DataFrame:
    """task_id, status, assigned_to, row_version, n_refused by the state in which each task ends."""
    rows = rows.select("task_id", end.alias("__end"))
    return rows.select("task_id", "__end.status", F.col("__end.who").alias("assigned_to"), (F.col("__end.done") + 1).cast("int").alias("row_version"), F.col("__end.refused").cast("int").alias("n_refused"))


def fold_reviews(events: DataFrame, block: int = 64, folder: str | None = None) -> DataFrame:
    """task_id, status, assigned_to, row_version, n_refused after the events (task_id, seq, action, actor) of each task in order.

    A task begins open with version 1. An action that its state doesn't allow changes nothing. No task's events are ever one
    list, or composed one by one: windows over their order tell what each does. (Without blocks, block and folder have no
    effect; they stay for callers.)
    """
    change = F.struct(*[c.split()[0] for c in CHANGE.split(", ")])
    return shown_state(summed(events), after(opened(), change))


#: What errors of a connection say, in the order in which they are told apart (fixed values).
CERTIFICATE = ("CERTIFICATE_VERIFY_FAILED", "CERTIFICATE_VERIFY", "HOSTNAME_MISMATCH", "IP_ADDRESS_MISMATCH", "UNKNOWN_CA")
COMPATIBILITY = ("DH_KEY_TOO_SMALL", "UNSAFE_LEGACY_RENEGOTIATION_DISABLED", "LEGACY_SIGALG_DISALLOWED_OR_UNSUPPORTED")
HANDSHAKE = ("[SSL:", "SSLV3_ALERT", "TLSV1_ALERT", "WRONG_VERSION_NUMBER", "UNEXPECTED_EOF_WHILE_READING")
#: Codes of failed connections and of models' failures by their HTTP status (fixed values).
TRANSPORT = {"timeout": "HTTP_REQUEST_TIMEOUT", "tls_certificate": "TLS_CERTIFICATE_VERIFICATION_FAILED", "tls_compatibility": "TLS_COMPATIBILITY_ERROR", "tls_handshake": "TLS_HANDSHAKE_FAILED", "connect_error": "CONNECT_ERROR", "http_client": "HTTP_CLIENT_ERROR"}
MODEL = {429: "AI_QUOTA_EXCEEDED", 401: "AI_AUTHENTICATION_FAILED", 403: "AI_AUTHENTICATION_FAILED", 404: "AI_MODEL_NOT_FOUND", 400: "AI_REQUEST_REJECTED"}
RETRYABLE = ("HTTP_REQUEST_TIMEOUT", "CONNECT_ERROR", "HTTP_CLIENT_ERROR")


def transport_code(kind: Column, message: Column) -> Column:
    """The code of a failed connection from the error's kind (timeout, connect or another) and what it says."""
    said = F.upper(F.coalesce(message, F.lit("")))
    says = lambda marks: F.array_contains(F.array(*[F.contains(said, F.lit(m)) for m in marks]), True)
    name = (
        F.when(kind == "timeout", "timeout").when(says(CERTIFICATE), "tls_certificate").when(says(COMPATIBILITY), "tls_compatibility").when(says(HANDSHAKE), "tls_handshake")
        .when(kind == "connect", "connect_error").otherwise("http_client")
    )
    return F.create_map(*[F.lit(x) for kv in TRANSPORT.items() for x in kv])[name]


def provider_code(status: Column) -> Column:
    """What a provider's answer means by its HTTP status, as outcome and reason; null for 200."""
    pair = lambda outcome, reason: F.concat(F.lit(f"{outcome}:"), reason)
    code = status.cast("string")
    return (
        F.when(status == 404, pair("not_found", F.lit("HTTP_404"))).when(status.isin(401, 403, 407), pair("blocked", F.concat(F.lit("ACCESS_CONTROL_HTTP_"), code)))
        .when(status == 429, pair("unavailable", F.lit("RATE_LIMITED"))).when(status != 200, pair("unavailable", F.concat(F.lit("HTTP_"), code)))
    )


def model_code(status: Column, is_connection: Column) -> Column:
    """The code of a model's failure from its HTTP status, if there is one, and whether the connection failed."""
    known = F.create_map(*[F.lit(x) for kv in MODEL.items() for x in kv])[status]
    return F.coalesce(known, F.when((status >= 500) | is_connection, "AI_PROVIDER_UNAVAILABLE"), F.lit("AI_PROVIDER_ERROR"))


def task_code(step: Column, kind: Column, message: Column) -> Column:
    """The code of a failed step: a message that is a code itself stays, of all others only the error's kind."""
    said = F.trim(F.coalesce(message, F.lit("")))
    return F.concat(F.lit("TASK_STEP_FAILED:"), step, F.lit(":"), F.when(said.rlike("^[A-Z0-9_:-]{1,160}$"), said).otherwise(F.upper(kind)))


def diagnostics(warnings: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, warning: the first warning of each family of a job; failed searches are one family."""
    family = F.when(F.col("warning").startswith("SEARCH_PROVIDER_UNAVAILABLE:"), "SEARCH_PROVIDER_UNAVAILABLE").otherwise(F.col("warning"))
    first = F.row_number().over(Window.partitionBy(key, family).orderBy(order))
    return warnings.withColumn("__n", first).where("__n = 1").select(key, order, "warning")
