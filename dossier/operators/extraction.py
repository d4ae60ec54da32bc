"""Checks of extracted facts, pair scores, and texts built from field values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranking, text


def fact_errors(value: Column, is_unknown: Column, cited: Column, hint: Column) -> Column:
    """An array of the rules that an extracted fact breaks; empty if none."""
    return F.array_compact(
        F.array(
            F.when(is_unknown & value.isNotNull(), "UNKNOWN_WITH_VALUE"),
            F.when(~is_unknown & (F.size(cited) <= 0), "NO_EVIDENCE"),
            F.when(~is_unknown & value.isNull(), "NO_VALUE"),
            F.when((hint < 0) | (hint > 1), "HINT_OUT_OF_RANGE"),
        )
    )


def missing_evidence(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """fact_id, block_key of every cited block that the company's blocks don't hold; facts has cited, an array."""
    cited = facts.select("workspace_id", "company_id", "fact_id", F.explode(F.array_distinct("cited")).alias("block_key")).where("block_key <> ''")
    return cited.join(blocks, ["workspace_id", "company_id", "block_key"], "left_anti").select("fact_id", "block_key")


def name_mismatch(company_name: Column, value: Column) -> Column:
    """Whether a legal name holds none of the company's words of more than two letters; false if it has no such word."""
    words = F.filter(F.split(text.clean_text(F.lower(company_name)), " "), lambda w: F.length(w) > 2)
    return (F.size(words) > 0) & ~F.exists(words, lambda w: F.contains(F.lower(value), w))


def match_score(own: Column, other: Column) -> Column:
    """score and reason of a pair by the columns tax_id, registration_number, those with other_, and the two normalized names."""
    same = lambda key: (F.col(key) != "") & (F.col(key) == F.col(f"other_{key}"))
    rules = [
        (same("tax_id"), 1.0, "EXACT_TAX_ID_MATCH"), (same("registration_number"), 1.0, "EXACT_REGISTRATION_NUMBER_MATCH"), ((own != "") & (own == other), 0.85, "EXACT_NORMALIZED_NAME_MATCH"),
        ((own != "") & (F.contains(own, other) | F.contains(other, own)), 0.65, "PARTIAL_NAME_SUBSTRING_MATCH"),
    ]
    return F.coalesce(*[F.when(c, F.struct(F.lit(s).alias("score"), F.lit(r).alias("reason"))) for c, s, r in rules], F.struct(F.lit(0.0).alias("score"), F.lit("NO_MATCH").alias("reason")))


def match_scores(pairs: DataFrame) -> DataFrame:
    """new_id, company_id, score, reason of pairs (tax_id, registration_number, company_name and those with other_)."""
    # the names are long expressions, worked out once a pair
    names = F.array(text.normalize_name(F.col("company_name")), text.normalize_name(F.col("other_name")))
    found = ranking.let(names, lambda n: match_score(F.get(n, F.lit(0)), F.get(n, F.lit(1))))
    return pairs.select("new_id", "company_id", found.alias("m")).select("new_id", "company_id", "m.score", "m.reason")


def search_outcome(queries: DataFrame, key: str) -> DataFrame:
    """outcome and reason of each key's queries (succeeded, n_results)."""
    n = queries.groupBy(key).agg(F.count_if("succeeded").alias("ok"), F.coalesce(F.sum("n_results"), F.lit(0)).alias("results"))
    none, empty = F.col("ok") == 0, F.col("results") == 0
    reason = F.when(none, "NO_QUERY_SUCCEEDED").when(empty, "NO_RESULTS").otherwise(F.format_string("QUERIES:%d;RESULTS:%d", "ok", "results"))
    return n.select(key, F.when(none, "unavailable").when(empty, "not_found").otherwise("success").alias("outcome"), reason.alias("reason"))


def grounded_summary(companies: DataFrame, values: DataFrame) -> DataFrame:
    """workspace_id, company_id, summary from the values (field_key, display_value) that each company has."""
    has = lambda k: F.max(F.when((F.col("field_key") == k) & (F.col("display_value") != ""), F.col("display_value")))
    found = values.groupBy("workspace_id", "company_id").agg(has("identity.legal_name").alias("legal"), has("overview.description").alias("about"), has("identity.industry").alias("i1"), has("overview.industry").alias("i2"))
    out = companies.select("workspace_id", "company_id", "company_name").join(found, ["workspace_id", "company_id"], "left")
    industry = F.coalesce("i1", "i2")
    parts = F.concat(F.coalesce("legal", "company_name"), F.lit(" is a verified company profile.")), F.concat(F.lit("Industry: "), industry, F.lit(".")), F.coalesce("about", F.lit("Verified commercial entity profile."))
    return out.select("workspace_id", "company_id", F.concat_ws(" ", *parts).alias("summary"))
