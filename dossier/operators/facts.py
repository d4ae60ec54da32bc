"""Facts, conflicts, drafts and versions: set-wide transforms of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..sources.scratch import partitions

FACT_KEY = ["workspace_id", "company_id", "field_key", "context_key"]
#: What rows of a fact's key are dealt by: a context that is a constant would hide that they lie together.
FIELD = FACT_KEY[:3]
ACTIVE = ("candidate", "validated", "recommended", "accepted")
#: Statuses of facts that conflicts are sought among: all but the rejected ones.
SCANNED = (*ACTIVE, "superseded")
#: Statuses of conflicts that new evidence opens again.
CLOSED = ("resolved", "accepted_multiple", "dismissed")


def dedupe_facts(facts: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One active candidate, the first, for each key, origin and value that no active stored fact has already."""
    keys = [*FACT_KEY, "origin_type", "value_json"]
    active = lambda df: df.where(F.col("fact_status").isin(*ACTIVE))
    out = active(facts).groupBy(*keys).agg(F.min("fact_id").alias("fact_id"))
    return out if stored is None else out.join(active(stored).select(*keys), keys, "left_anti")


def with_score(facts: DataFrame, as_of: Column) -> DataFrame:
    c = F.col
    return facts.withColumn("score", scoring.confidence(c("field_key"), c("authority_tier"), c("support_type"), c("observed_at"), c("origin_type"), c("hint"), as_of))


def score_facts(facts: DataFrame, as_of: Column) -> DataFrame:
    return with_score(facts, as_of).select("fact_id", "score", scoring.rating(F.col("score")).alias("rating"))


def freshness(facts: DataFrame, as_of: Column) -> DataFrame:
    return facts.select("fact_id", scoring.freshness(F.col("field_key"), F.col("observed_at"), as_of).alias("freshness"))


def corroborate(facts: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Of each value the number of distinct domains that state it, and whether the field has competing values.

    sources has source_id and domain. Rejected values have no part in it. Rivals follow from the values themselves, so the
    facts are read once. Domains are looked up while rows are narrow, and all that is counted of a field is dealt once, in
    as many parts as the session states, so that a task's memory doesn't grow with the input.
    """
    scanned = facts.where(F.col("fact_status").isin(*SCANNED)).select("fact_id", *FACT_KEY, "value_json")
    stated = evidence.select("fact_id", "source_id").join(sources.where("domain <> ''").select("source_id", "domain"), "source_id").drop("source_id")
    rows = scanned.join(stated, "fact_id", "left").drop("fact_id").repartition(partitions(facts.sparkSession), *FIELD)
    values = rows.groupBy(*FACT_KEY, "value_json").agg(F.count_distinct("domain").alias("n_domains"))
    w = Window.partitionBy(*FACT_KEY)
    return values.withColumn("competing", F.min("value_json").over(w) < F.max("value_json").over(w))


def corroborated_scores(facts: DataFrame, evidence: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """fact_id, score and explanation of the facts that aren't rejected, with their domains and rivals counted in."""
    c = F.col
    known = corroborate(facts, evidence, sources)
    rows = facts.where(c("fact_status").isin(*SCANNED)).repartition(partitions(facts.sparkSession), *FIELD, "value_json").join(known, [*FACT_KEY, "value_json"])
    score = scoring.confidence(c("field_key"), c("authority_tier"), c("support_type"), c("observed_at"), c("origin_type"), c("hint"), as_of, c("n_domains"), c("competing"))
    rows = rows.withColumn("score", score)
    return rows.select("fact_id", "score", scoring.explanation(c("score"), c("authority_tier"), c("support_type"), c("origin_type"), c("n_domains"), c("competing")).alias("explanation"))


#: Columns of a company that hold a field's value themselves (fixed values).
PROFILE_COLUMNS = {"identity.legal_name": "legal_name", "identity.tax_id": "tax_id", "identity.registration_number": "registration_number", "identity.address": "headquarters_address"}


def missing_fields(companies: DataFrame, facts: DataFrame, fields: tuple[str, ...], *, profile_columns: bool = False) -> DataFrame:
    """Expected fields without a fact, and with profile_columns also without a value in the company's own columns.

    The few fields multiply each company's row in place.
    """
    kept = lambda f: F.lit(True) if not profile_columns or PROFILE_COLUMNS.get(f) not in companies.columns else F.coalesce(F.col(PROFILE_COLUMNS[f]), F.lit("")) == ""
    wanted = companies.select("workspace_id", "company_id", F.explode(F.array_compact(F.array(*[F.when(kept(f), F.lit(f)) for f in fields]))).alias("field_key"))
    return wanted.join(facts.select("workspace_id", "company_id", "field_key"), ["workspace_id", "company_id", "field_key"], "left_anti")


def list_facts(facts: DataFrame, evidence: DataFrame, *, field_key: str | None = None, status: str | None = None) -> DataFrame:
    """Facts newest first within their company, each with its evidence (source_id, block_key) in order."""
    for column, value in (("field_key", field_key), ("fact_status", status)):
        if value is not None:
            facts = facts.where(F.col(column) == value)
    own = evidence.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "block_key"))).alias("evidence"))
    w = Window.partitionBy("workspace_id", "company_id").orderBy(F.desc("fact_id"))
    return facts.join(own, "fact_id", "left").select("workspace_id", "company_id", "fact_id", "field_key", F.row_number().over(w).alias("place"), "evidence")


def _number(kind: Column, json: Column) -> Column:
    return F.when(kind == "boolean", F.when(json == "true", 1.0).otherwise(0.0)).otherwise(json.try_cast("double"))


def materially_different(field: Column, kind: Column, a: Column, other_kind: Column, b: Column, *, strict_reference: bool = False) -> Column:
    """Whether two values of one field, as JSON with their types, disagree.

    Strings are compared without case and outer blanks, legal names also by whether one's words are among the other's;
    numbers may differ by a twentieth of the larger; lists and objects must be equal but for the order of keys; values of
    different types are compared as text, a string by what it says. Null agrees with everything. Two zeros are equal, unless strict_reference asks
    for the comparison that divides by the larger one and so finds them different.
    """
    text = lambda j: F.lower(F.btrim(F.try_variant_get(F.try_parse_json(j), "$", "string"), F.lit(" \t\n\x0b\x0c\r")))
    s, t = text(a), text(b)
    # no lambda: with one, every task would generate the whole comparison's code anew
    words = [F.array_remove(F.split(v, r"\s+"), "") for v in (s, t)]
    inside = (F.size(words[0]) > 0) & (F.size(words[1]) > 0) & ((F.size(F.array_except(words[0], words[1])) == 0) | (F.size(F.array_except(words[1], words[0])) == 0))
    strings = (s != t) & ~((field == "identity.legal_name") & inside)
    x, y = _number(kind, a), _number(other_kind, b)
    larger = F.greatest(F.abs(x), F.abs(y))
    numbers = F.abs(x - y) * 20 > larger
    if strict_reference:
        numbers = numbers | (larger == 0)
    # a variant's objects have their keys in order
    whole = lambda k, j: F.when(k == "string", F.try_variant_get(F.try_parse_json(j), "$", "string")).otherwise(F.to_json(F.try_parse_json(j)))
    numeric = ("integer", "number", "boolean")
    both = lambda *kinds: kind.isin(*kinds) & other_kind.isin(*kinds)
    # the same text of one type is the same value, and most texts needn't be parsed to see that
    same = (kind == other_kind) & ~kind.isin(*numeric) & (a == b)
    return F.when(a.isNull() | b.isNull() | same, False).when(both("string"), strings).when(both(*numeric), numbers).otherwise(whole(kind, a) != whole(other_kind, b))


def conflict_members(facts: DataFrame, *, strict_reference: bool = False) -> DataFrame:
    """Every fact that isn't rejected, with its role (the field's first is primary) and whether it disagrees with the first."""
    w = Window.partitionBy(*FACT_KEY).orderBy("fact_id")
    out = facts.where(F.col("fact_status").isin(*SCANNED))
    out = out.withColumn("first_value", F.first("value_json").over(w)).withColumn("first_type", F.first("value_type").over(w))
    out = out.withColumn("role", F.when(F.row_number().over(w) == 1, "primary").otherwise("competing"))
    c = F.col
    return out.withColumn("differs", materially_different(c("field_key"), c("first_type"), c("first_value"), c("value_type"), c("value_json"), strict_reference=strict_reference))


def attached(facts: DataFrame, **how) -> DataFrame:
    """The members of conflicts: a field's first fact and those that disagree with it, where there are any."""
    out = conflict_members(facts, **how).withColumn("__any", F.max("differs").over(Window.partitionBy(*FACT_KEY)))
    return out.where(F.col("__any") & (F.col("differs") | (F.col("role") == "primary"))).drop("__any")


def detect_conflicts(facts: DataFrame, **how) -> DataFrame:
    """Fields of which some fact disagrees with the first one, with their materiality."""
    out = conflict_members(facts, **how).groupBy(*FACT_KEY).agg(F.count("*").alias("n_facts"), F.count_if("differs").alias("n_differing")).where("n_differing > 0")
    return out.withColumn("materiality", scoring.materiality(F.col("field_key")))


def reopen_conflicts(conflicts: DataFrame, members: DataFrame, facts: DataFrame) -> DataFrame:
    """conflict_id, status, first_new, n_new of closed conflicts that a fact not yet attached opens again.

    conflicts has the key, conflict_id and status, members has conflict_id and fact_id. Open conflicts aren't extended.
    """
    closed = conflicts.where(F.col("status").isin(*CLOSED)).select(*FACT_KEY, "conflict_id")
    new = attached(facts).select(*FACT_KEY, "fact_id").join(closed, FACT_KEY).join(members, ["conflict_id", "fact_id"], "left_anti")
    return new.groupBy("conflict_id").agg(F.lit("reopened").alias("status"), F.min("fact_id").alias("first_new"), F.count("*").alias("n_new"))


def list_conflicts(conflicts: DataFrame, members: DataFrame, facts: DataFrame, status: str | None = None) -> DataFrame:
    """Conflicts newest first within their company, each with its members (fact_id, role, value_json) in order of the facts."""
    rows = conflicts if status is None else conflicts.where(F.col("status") == status)
    role = F.when(F.col("fact_id") == F.min("fact_id").over(Window.partitionBy("conflict_id")), "primary").otherwise("competing")
    own = members.join(facts.select("fact_id", "value_json"), "fact_id").select("conflict_id", F.struct("fact_id", role.alias("role"), "value_json").alias("m"))
    own = own.groupBy("conflict_id").agg(F.array_sort(F.collect_list("m")).alias("members"))
    w = Window.partitionBy("workspace_id", "company_id").orderBy(F.desc("conflict_id"))
    return rows.join(own, "conflict_id", "left").select("workspace_id", "company_id", "conflict_id", "status", F.row_number().over(w).alias("place"), "members")


def assemble_drafts(facts: DataFrame, as_of: Column) -> DataFrame:
    """The best scored active fact of each field, in order of score."""
    scored = with_score(facts.where(F.col("fact_status").isin(*ACTIVE)), as_of)
    best = Window.partitionBy("workspace_id", "company_id", "field_key").orderBy(F.desc("score"), "fact_id")
    out = scored.withColumn("n", F.row_number().over(best)).where("n = 1")
    order = Window.partitionBy("workspace_id", "company_id").orderBy(F.desc("score"), "fact_id")
    return out.select("workspace_id", "company_id", "field_key", "fact_id", "score", F.row_number().over(order).alias("display_order"))


def version_history(versions: DataFrame) -> DataFrame:
    """Status of each version: the newest is published, older ones are superseded at the next one's time."""
    w = Window.partitionBy("workspace_id", "company_id").orderBy("version_number")
    out = versions.withColumn("superseded_at", F.lead("published_at").over(w))
    status = F.when(F.col("withdrawn"), "withdrawn").when(F.col("superseded_at").isNull(), "published").otherwise("superseded")
    return out.select("version_id", "version_number", status.alias("status"), "superseded_at")


def diff_versions(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Changes between the versions old_id and new_id of each pair: added, removed, modified and unchanged fields.

    A field is modified if its shown value, its value or its status differs. Evidence of a side that isn't there counts 0.
    """
    sides = ("display_value", "value_json", "display_status", "evidence_count")
    keys = ["old_id", "new_id", "field_key", "context_key"]

    def side(of: str) -> DataFrame:
        return pairs.join(values, pairs[f"{of}_id"] == values.version_id).select(*keys, *[F.col(c).alias(f"{of}_{c}") for c in sides], F.lit(True).alias(f"has_{of}"))

    both = side("old").join(side("new"), keys, "full_outer")
    same = F.lit(True)
    for c in sides[:3]:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(~same, "modified").otherwise("unchanged")
    count = lambda of: F.coalesce(f"{of}_evidence_count", F.lit(0)).alias(f"{of}_evidence")
    return both.select(*keys, F.col("old_display_value").alias("old_value"), F.col("new_display_value").alias("new_value"), F.col("old_display_status").alias("old_status"), F.col("new_display_status").alias("new_status"), count("old"), count("new"), change.alias("change"))


def diff_summary(changes: DataFrame, pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """Fields of each kind of change, and by how much the whole confidence rose, for every pair; versions has version_id, overall_confidence."""
    kinds = ("added", "removed", "modified", "unchanged")
    n = changes.groupBy("old_id", "new_id").agg(*[F.count_if(F.col("change") == k).alias(f"n_{k}") for k in kinds])
    was, now = (versions.select(F.col("version_id").alias(f"{of}_id"), F.col("overall_confidence").alias(f"{of}_confidence")) for of in ("old", "new"))
    out = pairs.select("old_id", "new_id").join(n, ["old_id", "new_id"], "left").join(was, "old_id").join(now, "new_id")
    delta = F.round(F.col("new_confidence") - F.col("old_confidence"), 2).alias("confidence_delta")
    return out.select("old_id", "new_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in kinds], delta)
