"""Changes to stored tables as joins: merges, resolutions, overrides, upserts and the policies' versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, values
from .facts import FACT_KEY


def label_facts(blocks: DataFrame) -> DataFrame:
    """workspace_id, company_id, block_key, field_key, value of every labelled line."""
    lines = blocks.select("workspace_id", "company_id", "block_key", F.explode(F.split("text_content", r"\r\n|[\n\r]")).alias("line"))
    found = lines.select("workspace_id", "company_id", "block_key", values.labelled(F.col("line")).alias("f"))
    return found.select("workspace_id", "company_id", "block_key", "f.*").where("value <> ''")


def creation_duplicates(new: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """new_id, company_id, reason: the strongest sign that a new company is there already (the first by id).

    Each sign's companies are reduced to one a key before the join, so a key on very many rows is no hot join key.
    """
    def first(df: DataFrame, key, of: str) -> DataFrame:
        return df.where(key.isNotNull() & (key != "")).groupBy("workspace_id", key.alias(f"k_{of}")).agg(F.min("company_id").alias(of))

    out = new.withColumn("k_name", text.normalize_name(F.col("company_name")))
    out = out.withColumns({"k_tax": F.col("tax_id"), "k_reg": F.col("registration_number"), "k_alias": F.col("k_name")})
    out = out.join(first(companies, F.col("tax_id"), "tax"), ["workspace_id", "k_tax"], "left").join(first(companies, F.col("registration_number"), "reg"), ["workspace_id", "k_reg"], "left")
    out = out.join(first(companies, text.normalize_name(F.col("company_name")), "name"), ["workspace_id", "k_name"], "left")
    out = out.join(first(aliases, text.normalize_name(F.col("alias_name")), "alias"), ["workspace_id", "k_alias"], "left")
    reason = F.when(F.col("tax").isNotNull(), "EXACT_TAX_ID_MATCH").when(F.col("reg").isNotNull(), "EXACT_REGISTRATION_NUMBER_MATCH").otherwise("EXACT_NORMALIZED_NAME_OR_ALIAS_MATCH")
    return out.select("new_id", F.coalesce("tax", "reg", "name", "alias").alias("company_id"), reason.alias("reason")).where("company_id IS NOT NULL")


def merge_companies(companies: DataFrame, pairs: DataFrame) -> DataFrame:
    """workspace_id, company_id, status, merged_into, version_steps after merging pairs (workspace_id, source_id, target_id)."""
    gone = pairs.select("workspace_id", F.col("source_id").alias("company_id"), F.col("target_id").alias("merged_into"))
    into = pairs.groupBy("workspace_id", F.col("target_id").alias("company_id")).agg(F.count("*").alias("n"))
    out = companies.join(gone, ["workspace_id", "company_id"], "left").join(into, ["workspace_id", "company_id"], "left")
    steps = F.coalesce("n", F.lit(0)) + F.when(F.col("merged_into").isNotNull(), 1).otherwise(0)
    return out.select("workspace_id", "company_id", F.when(F.col("merged_into").isNotNull(), "merged").otherwise(F.col("status")).alias("status"), "merged_into", steps.cast("long").alias("version_steps"))


def merged_aliases(companies: DataFrame, aliases: DataFrame, pairs: DataFrame) -> DataFrame:
    """workspace_id, normalized_alias, company_id, alias_type after a merge, one row for each normalized alias.

    A merged company's name becomes a former name of its target, which wins over an alias of the same form; other aliases
    of merged companies move to the target. Of several claims to one form the first company by id has it.
    """
    gone = pairs.select("workspace_id", F.col("source_id").alias("company_id"), "target_id")
    former = companies.join(gone, ["workspace_id", "company_id"]).select("workspace_id", text.normalize_name(F.col("company_name")).alias("normalized_alias"), F.col("target_id").alias("company_id"), F.lit("former_name").alias("alias_type"))
    moved = aliases.join(gone, ["workspace_id", "company_id"], "left").select("workspace_id", text.normalize_name(F.col("alias_name")).alias("normalized_alias"), F.coalesce("target_id", "company_id").alias("company_id"), "alias_type")
    claim = F.min(F.struct((F.col("alias_type") != "former_name").alias("late"), "company_id", "alias_type")).alias("c")
    return former.unionByName(moved).groupBy("workspace_id", "normalized_alias").agg(claim).select("workspace_id", "normalized_alias", "c.company_id", "c.alias_type")


def relationships(edges: DataFrame) -> DataFrame:
    """Each directed edge once for each type; edges of a company to itself go."""
    return edges.where("source_id <> target_id").select("workspace_id", "source_id", "target_id", "relationship_type").distinct()


def resolve_conflicts(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """fact_id, is_selected, fact_status of all facts whose conflict is decided (key, resolution, selected fact ids)."""
    out = members.join(decisions, list(FACT_KEY)).withColumn("is_selected", F.array_contains("selected", F.col("fact_id")))
    status = F.when(F.col("is_selected"), "accepted").when(F.col("resolution") == "select_one", "superseded").otherwise(F.col("fact_status"))
    return out.select("fact_id", "is_selected", status.alias("fact_status"))


def decision_log(events: DataFrame, key: str, order: str, tie: str, state: str) -> DataFrame:
    """tie, previous_state, new_state of every event, in the order of its key's events."""
    w = Window.partitionBy(key).orderBy(order, tie)
    return events.select(tie, F.lag(state).over(w).alias("previous_state"), F.col(state).alias("new_state"))


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """workspace_id, company_id, normalized, status: each key once; a rejected source that is chosen again is discovered."""
    keys = ["workspace_id", "company_id", "normalized"]
    was = old.groupBy(*keys).agg(F.min("status").alias("was"))
    now = new.select(*keys).distinct().withColumn("chosen", F.lit(True))
    status = F.when(F.col("was").isNull() | (F.col("chosen") & (F.col("was") == "rejected")), "discovered").otherwise(F.col("was"))
    return was.join(now, keys, "full").select(*keys, status.alias("status"))


def apply_overrides(selections: DataFrame, overrides: DataFrame) -> DataFrame:
    """draft_id, field_key, display_value, overridden, display_order: values replaced, new fields put at the end by name."""
    own = overrides.select("draft_id", "field_key", F.col("value").alias("__new"), F.lit(True).alias("__over"))
    out = selections.join(own, ["draft_id", "field_key"], "full")
    w = Window.partitionBy("draft_id").orderBy(F.col("display_order").asc_nulls_last(), "field_key")
    value = F.when(F.col("__over"), F.col("__new")).otherwise(F.col("display_value"))
    return out.select("draft_id", "field_key", value.alias("display_value"), F.coalesce("__over", F.lit(False)).alias("overridden"), F.row_number().over(w).alias("display_order"))


def domain_policies(old: DataFrame, new: DataFrame, deleted: DataFrame) -> DataFrame:
    """workspace_id, domain, policy: new rows replace old ones of their key, deleted keys go."""
    keys = ["workspace_id", "domain"]
    return old.join(new, keys, "left_anti").unionByName(new).join(deleted, keys, "left_anti")


def policy_versions(policies: DataFrame, activated: DataFrame) -> DataFrame:
    """workspace_id, policy_id, version_number by creation, and is_active: the one last activated, else none."""
    chosen = activated.groupBy("workspace_id").agg(F.max_by("policy_id", F.struct("activated_at", "policy_id")).alias("chosen"))
    number = F.row_number().over(Window.partitionBy("workspace_id").orderBy("created_at", "policy_id"))
    out = policies.select("workspace_id", "policy_id", number.alias("version_number")).join(chosen, "workspace_id", "left")
    return out.select("workspace_id", "policy_id", "version_number", F.coalesce(F.col("policy_id") == F.col("chosen"), F.lit(False)).alias("is_active"))
