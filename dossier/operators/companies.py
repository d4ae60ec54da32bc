"""Companies, their names and their candidates for sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Which origin of a candidate is preferred (fixed values).
PRIORITY = {
    "verified_official_domain": 70, "official_website": 65, "manual_url": 60, "trusted_provider": 55, "source_history": 50,
    "sitemap": 40, "internal_link": 35, "search_provider": 30,
}


def lookup_by_name(names: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """workspace_id, name, company_id (the first by id), matched_by: by normalized name, else by alias, else null."""
    def named(df: DataFrame, name: str, of: str) -> DataFrame:
        return df.groupBy("workspace_id", text.normalize_name(F.col(name)).alias("key")).agg(F.min("company_id").alias(of))

    out = names.select("workspace_id", "name", text.normalize_name(F.col("name")).alias("key"))
    out = out.join(named(companies, "company_name", "own"), ["workspace_id", "key"], "left").join(named(aliases, "alias_name", "other"), ["workspace_id", "key"], "left")
    by = F.when(F.col("own").isNotNull(), "name").when(F.col("other").isNotNull(), "alias")
    return out.select("workspace_id", "name", F.coalesce("own", "other").alias("company_id"), by.alias("matched_by"))


def default_aliases(companies: DataFrame) -> DataFrame:
    """Name and legal name of each company, one row for each normalized form."""
    names = F.array(F.struct(F.lit("display_name").alias("alias_type"), F.col("company_name").alias("alias_name")), F.struct(F.lit("legal_name").alias("alias_type"), F.col("legal_name").alias("alias_name")))
    out = companies.select("workspace_id", "company_id", F.inline(names)).where("alias_name IS NOT NULL")
    out = out.groupBy("workspace_id", "company_id", text.normalize_name(F.col("alias_name")).alias("normalized_alias"))
    return out.agg(F.min("alias_type").alias("alias_type"))


def list_companies(companies: DataFrame, *, status: str | None = None, term: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Of each workspace the companies of a status whose name or identifiers hold the term, by name: from offset on, at most limit."""
    found = companies if status is None else companies.where(F.col("status") == status)
    if term is not None:
        holds = [F.coalesce(F.contains(F.lower(c), F.lit(term)), F.lit(False)) for c in ("company_name", "tax_id", "registration_number")]
        found = found.where(holds[0] | holds[1] | holds[2])
    w = Window.partitionBy("workspace_id").orderBy("company_name", "company_id")
    out = found.select("workspace_id", "company_id", "company_name", F.row_number().over(w).alias("place"))
    return out.where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def apply_company_changes(companies: DataFrame, changes: DataFrame) -> DataFrame:
    """workspace_id, company_id, status, company_name, version_steps, refused after a batch of changes, one a company.

    changes has action (archive, restore or update) and company_name (for updates, null keeps it). Archiving what is
    archived changes nothing; merged companies can't be restored.
    """
    out = companies.join(changes.select("workspace_id", "company_id", "action", F.col("company_name").alias("new_name")), ["workspace_id", "company_id"], "left")
    action, status = F.col("action"), F.col("status")
    refused = F.coalesce((action == "restore") & (status == "merged"), F.lit(False))
    idle = action.isNull() | refused | ((action == "archive") & (status == "archived"))
    now = F.when(idle | (action == "update"), status).when(action == "archive", "archived").otherwise("published")
    name = F.when(~idle & (action == "update"), F.coalesce("new_name", "company_name")).otherwise(F.col("company_name"))
    return out.select("workspace_id", "company_id", now.alias("status"), name.alias("company_name"), F.when(idle, 0).otherwise(1).alias("version_steps"), refused.alias("refused"))


def merge_candidates(candidates: DataFrame, normalized: Column) -> DataFrame:
    """One row for each company and normalized url of enriched candidates.

    The preferred origin has the highest priority, the earlier row among equals; provenance holds all origins in order; of
    tiers (also by field), scores, relevance and depth the best counts; title, snippet and page group are the first that
    say something. Rows are first gathered by origin, of which there are eight, so a url with very many rows makes no long
    list. Columns that the rows lack count as null.
    """
    for column, kind in (("authority_tier", "int"), ("authority_by_field", "map<string,int>"), ("entity_match_score", "double"), ("relevance_score", "double"), ("title", "string"), ("snippet", "string"), ("page_group", "string")):
        if column not in candidates.columns:
            candidates = candidates.withColumn(column, F.lit(None).cast(kind))
    priority = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    keys = ["workspace_id", "company_id", "normalized"]
    said = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("ord")))
    whole = [F.min("crawl_depth").alias("crawl_depth"), F.bool_or("provided").alias("provided"), F.min("authority_tier").alias("authority_tier"), F.max("entity_match_score").alias("entity_match_score"), F.max("relevance_score").alias("relevance_score")]
    rows = candidates.withColumn("normalized", normalized)
    firsts = [F.struct(F.min(F.when(F.col(c) != "", F.col("ord"))).alias("ord"), said(c).alias("v")).alias(c) for c in ("title", "snippet", "page_group")]
    by_origin = rows.groupBy(*keys, "discovered_via").agg(F.min("ord").alias("ord"), *whole, *firsts)
    rank = F.struct(F.coalesce(priority[F.col("discovered_via")], F.lit(0)), -F.col("ord"))
    out = by_origin.groupBy(*keys).agg(
        F.max_by("discovered_via", rank).alias("preferred"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "discovered_via"))), lambda x: x["discovered_via"]), ",").alias("provenance"),
        *whole, *[F.min(F.when(F.col(f"{c}.ord").isNotNull(), F.col(c))).getField("v").alias(c) for c in ("title", "snippet", "page_group")],
    )
    by_field = rows.select(*keys, F.explode("authority_by_field").alias("field", "tier")).groupBy(*keys, "field").agg(F.min("tier").alias("tier"))
    by_field = by_field.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "tier")))).alias("authority_by_field"))
    return out.join(by_field, keys, "left")


def source_policy(sources: DataFrame, companies: DataFrame, blocked: Column) -> DataFrame:
    """status and reason of every source: blocked domains and low entity scores are rejected."""
    own = companies.select("company_id", "company_name", "tax_id")
    score = text.entity_match(F.col("company_name"), F.col("tax_id"), F.col("url"))
    out = sources.join(own, "company_id").select("source_id", blocked.alias("blocked"), score.alias("score"))
    reason = F.when(F.col("blocked"), "BLOCKED_DOMAIN").when(F.col("score") < 0.3, "LOW_MATCH_SCORE").otherwise("ACCEPTED")
    return out.select("source_id", "score", F.when(reason == "ACCEPTED", "fetched").otherwise("rejected").alias("status"), reason.alias("reason"))


def crawl_gaps(sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """Sources never fetched, and the failures of the others, each code once."""
    never = sources.join(attempts, "source_id", "left_anti").select("source_id", F.lit("CRAWL_BUDGET_OR_QUEUE_LIMIT").alias("code"))
    failed = attempts.where("outcome_code <> 'success'").join(sources, "source_id", "left_semi").select("source_id", F.col("outcome_code").alias("code")).distinct()
    return never.unionByName(failed)


def snapshot_actions(snapshots: DataFrame, content_hash: Column) -> DataFrame:
    """Whether each snapshot repeats its source's latest content, an older one, or is new."""
    rows = snapshots.select("source_id", "snapshot_id", "retrieved_at", content_hash.alias("hash"))
    by_time = Window.partitionBy("source_id").orderBy("retrieved_at", "snapshot_id")
    same = Window.partitionBy("source_id", "hash").orderBy("retrieved_at", "snapshot_id")
    action = F.when(F.lag("hash").over(by_time) == F.col("hash"), "reuse_latest").when(F.row_number().over(same) > 1, "reuse_hash").otherwise("new")
    return rows.select("source_id", "snapshot_id", action.alias("action"))


def tenant_leaks(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    other = parent.select(key, F.col("workspace_id").alias("parent_workspace"))
    return child.join(other, key).where("workspace_id <> parent_workspace")
