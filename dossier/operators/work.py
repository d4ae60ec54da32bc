"""Publication, review work and jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..sources.scratch import new_folder, written
from .facts import ACTIVE, FACT_KEY, SCANNED, conflict_members, detect_conflicts, missing_fields, with_score

STEPS = 9


def link_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of each active fact, moved to the first fact that states the same value; each link once."""
    keys = [*FACT_KEY, "origin_type", "value_json"]
    active = facts.where(F.col("fact_status").isin(*ACTIVE)).select("fact_id", *keys)
    first = active.groupBy(*keys).agg(F.min("fact_id").alias("candidate_id"))
    return active.join(first, keys).join(evidence, "fact_id").select("candidate_id", "source_id", "block_key").distinct()


def conflict_summary(facts: DataFrame) -> DataFrame:
    """Fields in conflict of each company, and the warning for its reviewer."""
    out = detect_conflicts(facts).groupBy("workspace_id", "company_id").agg(F.count("*").alias("n_fields"))
    return out.withColumn("warning", F.concat(F.lit("CONFLICT_REVIEW_REQUIRED:"), F.col("n_fields").cast("string")))


def publication_blockers(companies: DataFrame, facts: DataFrame, mandatory: tuple[str, ...]) -> DataFrame:
    """Fields in conflict, and mandatory ones without an active fact."""
    active = facts.where(F.col("fact_status").isin(*ACTIVE))
    open_ = detect_conflicts(facts).select("workspace_id", "company_id", "field_key", F.lit("OPEN_CONFLICT").alias("code"), "materiality")
    missing = missing_fields(companies, active, mandatory).select("workspace_id", "company_id", "field_key", F.lit("MISSING_FIELD").alias("code"), F.lit("critical").alias("materiality"))
    return open_.unionByName(missing)


def publishable(companies: DataFrame, blockers: DataFrame) -> DataFrame:
    critical = blockers.where("materiality = 'critical'").select("workspace_id", "company_id")
    return companies.select("workspace_id", "company_id").join(critical, ["workspace_id", "company_id"], "left_anti")


def publishable_values(companies: DataFrame, facts: DataFrame, as_of: Column, mandatory: tuple[str, ...]) -> DataFrame:
    """The best scored active fact of each field, with its value, of the companies that no critical blocker keeps back.

    The same as assemble_drafts of those that are publishable, but facts are read and dealt by company once: conflicts,
    missing fields and the choice all follow from one order of a company's facts.
    """
    c, company = F.col, FACT_KEY[:2]
    kept = ["context_key", "fact_id", "value_type", "value_json", "fact_status", "score"]
    rows = with_score(facts.where(c("fact_status").isin(*SCANNED)), as_of).select(*company, "field_key", *kept)
    rows = conflict_members(rows.repartition(*company))
    # a condition first: what it rules out isn't compared
    rows = rows.withColumn("blocks", (scoring.materiality(c("field_key")) == "critical") & c("differs"))
    place = F.when(c("fact_status").isin(*ACTIVE), F.struct(-c("score"), c("fact_id")))
    fields = rows.groupBy(*company, "field_key").agg(F.bool_or("blocks").alias("blocks"), F.min_by(F.struct(*kept), place).alias("best"))
    w = Window.partitionBy(*company)
    there = F.count_if(c("field_key").isin(*mandatory) & c("best").isNotNull()).over(w) == len(set(mandatory))
    ready = fields.withColumn("ready", there & ~F.coalesce(F.bool_or("blocks").over(w), F.lit(False))).where("ready AND best IS NOT NULL")
    status = F.when(c("fact_status").isin("accepted", "validated"), "verified").otherwise("inferred")
    values = ready.select(*company, "field_key", "best.*").join(companies.select(*company), company, "left_semi")
    return values.select(*company, "field_key", "context_key", "fact_id", "value_type", "value_json", status.alias("display_status"), "score")


def publish(values: DataFrame, evidence: DataFrame, versions: DataFrame, *, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next version of each company in values, its field values, and the copies of their evidence.

    values has the chosen fact of each field with its value and status, versions what is published already. Sources are
    counted by themselves, and the hash covers the fields in order of their keys. The values are written to a folder once, and
    evidence of other facts goes before anything is worked out of it.
    """
    company = FACT_KEY[:2]
    values = written(values.repartition("fact_id"), folder or new_folder(values.sparkSession))
    last = versions.groupBy(*company).agg(F.max("version_number").alias("last"))
    own = evidence.select("fact_id", "source_id", "block_key").join(values.select("fact_id"), "fact_id", "left_semi")
    copies = values.select(*company, "field_key", "context_key", "fact_id").join(own, "fact_id")
    counted = copies.select(*company, "source_id").repartition(*company).groupBy(*company).agg(F.count("*").alias("n_evidence"), F.count_distinct("source_id").alias("n_sources"))
    lines = F.array_sort(F.collect_list(F.struct("field_key", "context_key", "value_json", "display_status")))
    # the mean in whole hundredths, halves upwards, which no binary fraction disturbs
    total, n = F.sum(F.round(F.col("score") * 100).cast("long")), F.count("*")
    hundredths = F.floor((total * 2 + n) / (n * 2)) / 100
    whole = values.groupBy(*company).agg(F.count("*").alias("n_fields"), hundredths.alias("confidence"), lines.alias("lines"))
    text_ = F.array_join(F.transform("lines", lambda x: F.concat_ws("|", x["field_key"], x["context_key"], F.coalesce(x["value_json"], F.lit("")), x["display_status"])), "\n")
    out = whole.join(counted, company, "left").join(last, company, "left")
    number = (F.coalesce("last", F.lit(0)) + 1).cast("int")
    out = out.select(*company, number.alias("version_number"), "n_fields", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "confidence", F.sha2(text_, 256).alias("content_hash"))
    return out, values, copies


def current_profiles(versions: DataFrame) -> DataFrame:
    """The newest version of each company that is not withdrawn."""
    newest = F.max_by(F.struct("version_id", "version_number"), "version_number").alias("v")
    return versions.where("NOT withdrawn").groupBy("workspace_id", "company_id").agg(newest).select("workspace_id", "company_id", "v.*")


def superseded_drafts(drafts: DataFrame) -> DataFrame:
    w = Window.partitionBy("workspace_id", "company_id").orderBy(F.desc("published_at"), F.desc("version_id"))
    return drafts.select("version_id", F.when(F.row_number().over(w) == 1, "ready").otherwise("superseded").alias("status"))


def inbox(tasks: DataFrame, decisions: DataFrame, *, status: str | None = None, company_id: str | None = None, task_type: str | None = None, assigned_to: str | None = None) -> DataFrame:
    """The tasks that fit, numbered from the newest within their workspace, each with its decisions (seq, action) in order."""
    wanted = {"status": status, "company_id": company_id, "task_type": task_type, "assigned_to": assigned_to}
    for column, value in wanted.items():
        if value is not None:
            tasks = tasks.where(F.col(column) == value)
    own = decisions.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("decisions"))
    w = Window.partitionBy("workspace_id").orderBy(F.desc("created_at"), F.desc("task_id"))
    return tasks.join(own, "task_id", "left").select("workspace_id", "company_id", "task_id", "task_type", "priority", F.row_number().over(w).alias("place"), "decisions")


def job_status(tasks: DataFrame, steps: int = STEPS) -> DataFrame:
    """failed, running (with the next step), partial or completed, from the log of each job's steps."""
    out = tasks.groupBy("job_id").agg(
        F.bool_or(F.col("status") == "failed").alias("failed"), F.bool_or(F.col("partial") & (F.col("status") == "completed")).alias("partial"),
        F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(steps - 1)), F.collect_set(F.when(F.col("status") == "completed", F.col("step_rank"))))).alias("todo"),
    )
    status = F.when(F.col("failed"), "failed").when(F.size("todo") > 0, "running").when(F.col("partial"), "partial").otherwise("completed")
    return out.select("job_id", status.alias("status"), F.when(status == "running", F.element_at("todo", 1)).alias("next_step"))


def latest_state(tasks: DataFrame) -> DataFrame:
    """The completed step of highest rank of each job; of equal ones the latest."""
    last = F.max_by(F.struct("step_rank", "partial"), F.struct("step_rank", "created_at")).alias("s")
    return tasks.where("status = 'completed'").groupBy("job_id").agg(last).select("job_id", "s.step_rank", "s.partial")


def counters(logs: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """metric, labels, n: rows of each log by its labels (name: (log, labels)), of which there are few.

    All metrics of one log are grouping sets of one pass over it.
    """
    by_log: dict[int, list[tuple[str, list[str]]]] = {}
    for name, (log, labels) in logs.items():
        by_log.setdefault(id(log), []).append((name, labels))
    frames = {id(log): log for log, _ in logs.values()}
    parts = []
    for key, metrics in by_log.items():
        every = list(dict.fromkeys(x for _, labels in metrics for x in labels))
        sets = list(dict.fromkeys(tuple(x for x in every if x in labels) for _, labels in metrics))
        counts = frames[key].groupingSets([[F.col(x) for x in s] for s in sets], *[F.col(x) for x in every]).agg(F.grouping_id().alias("__set"), F.count("*").alias("n"))
        # a bit is set for each column that a set lacks, the last column's being the lowest
        bits = lambda labels, every=every: sum(1 << (len(every) - 1 - i) for i, x in enumerate(every) if x not in labels)
        said = lambda labels: F.concat_ws(",", *[F.concat(F.lit(f"{x}="), F.coalesce(F.col(x).cast("string"), F.lit(""))) for x in labels])
        own = F.filter(F.array(*[F.struct((F.col("__set") == bits(labels)).alias("is"), F.lit(name).alias("metric"), said(labels).alias("labels")) for name, labels in metrics]), lambda m: m["is"])
        parts.append(counts.select(F.explode(own).alias("m"), "n").select("m.metric", "m.labels", "n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def mean_confidence(versions: DataFrame) -> DataFrame:
    """Versions of each workspace and the mean of their whole confidence, to four digits."""
    return versions.groupBy("workspace_id").agg(F.count("*").alias("n"), F.round(F.avg("overall_confidence"), 4).alias("mean_confidence"))


def stale_tasks(tasks: DataFrame, as_of: Column) -> DataFrame:
    """job_id, n_expired, n_exhausted, since: running tasks past their lease, and failed ones without an attempt left."""
    expired = (F.col("status") == "running") & (F.col("lease_until") < as_of)
    spent = (F.col("status") == "failed") & (F.col("attempts") >= F.col("max_attempts"))
    out = tasks.where(expired | spent).groupBy("job_id")
    return out.agg(F.count_if(expired).alias("n_expired"), F.count_if(spent).alias("n_exhausted"), F.min("created_at").alias("since"))


def text_blocks(pages: DataFrame, cap: int = 10_000_000) -> DataFrame:
    """doc_id, block_key, block: the paragraphs of each page, up to the first that takes their bytes together beyond the cap.

    Paragraphs stand between blank lines; their white space is collapsed, and keys count blank ones as well.
    """
    trimmed = F.regexp_replace("text", f"^{text.SPACES}|{text.SPACES}$", "")
    paragraphs = lambda docs: docs.select("doc_id", F.posexplode(F.split(trimmed, "\n[ \t\n\x0B\f\r]*\n")).alias("at", "raw")).select("doc_id", "at", text.clean_text(F.col("raw")).alias("block")).where("block <> ''")
    # a text within the cap keeps all of its paragraphs, so only longer ones are summed up
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    w = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    long = paragraphs(pages.where(size > cap)).withColumn("bytes", F.sum(F.octet_length("block").cast("long")).over(w)).where(F.col("bytes") <= cap).drop("bytes")
    rows = paragraphs(pages.where(size <= cap)).unionByName(long)
    return rows.select("doc_id", F.concat(F.lit("p1_b"), (F.col("at") + 1).cast("string")).alias("block_key"), "block")
