"""What models returned: checks of fields and runs, the facts that pass, prompts and translations. No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text, values
from .extraction import fact_errors, name_mismatch

#: Fields that each operation may return, with the shape of their value (fixed values).
FIELDS = {
    "extract_identity": {"identity.legal_name": "any", "identity.brand_name": "any", "identity.tax_id": "any", "identity.registration_number": "any", "identity.country": "country", "identity.legal_form": "any", "identity.founding_year": "year"},
    "extract_overview": {"overview.description": "text", "overview.industry": "any", "overview.business_model": "any", "overview.hq_address": "any"},
    "extract_products": {"products.list": "named_list"},
    "extract_size": {"size.employee_count_range": "any", "size.revenue_range": "any", "size.office_count": "count"},
    "extract_markets": {"markets.target_markets": "list", "markets.customer_segments": "list", "markets.key_partners": "list"},
    "extract_leadership": {"leadership.ceo": "named", "leadership.founders": "named_list", "leadership.board_members": "named_list"},
    "extract_innovation": {"innovation.awards": "list", "innovation.certifications": "list", "innovation.funding_rounds": "list", "innovation.recent_activities": "list"},
}
YEARS, LONGEST_TEXT = (1800, 2100), 2000

#: How much of how many blocks a prompt holds, and how long its key is (fixed values).
PROMPT_BLOCKS, PROMPT_CHARACTERS, KEY_LENGTH = 20, 2000, 16


def field_rules(spark: SparkSession) -> DataFrame:
    """operation, field_key, shape of every field that an operation may return."""
    return spark.createDataFrame([(o, f, shape) for o, fields in FIELDS.items() for f, shape in fields.items()], "operation string, field_key string, shape string")


def _shape_error(shape: Column, kind: Column, value: Column) -> Column:
    v = F.try_parse_json(value)
    whole, said = F.try_variant_get(v, "$", "bigint"), F.try_variant_get(v, "$", "string")
    items = F.try_variant_get(v, "$", "array<variant>")
    unnamed = F.exists(items, lambda x: ~F.schema_of_variant(x).startswith("OBJECT") | F.try_variant_get(x, "$.name", "variant").isNull())
    whole_number = kind.isin("integer", "boolean")
    return (
        F.when((shape == "year") & ~(whole_number & F.coalesce(whole.between(*YEARS), F.lit(False))), "NOT_A_YEAR")
        .when((shape == "country") & ~F.coalesce(said.rlike(r"^\p{L}{2}$"), F.lit(False)), "NOT_A_COUNTRY_CODE")
        .when((shape == "text") & ((kind != "string") | (F.length(said) > LONGEST_TEXT)), "NOT_A_SHORT_TEXT")
        .when((shape == "count") & ~((kind == "integer") & (whole >= 0)), "NOT_A_COUNT")
        .when((shape == "list") & (kind != "list"), "NOT_A_LIST")
        .when((shape == "named") & ~((kind == "object") & F.try_variant_get(v, "$.name", "variant").isNotNull()), "NOT_A_NAMED_OBJECT")
        .when((shape == "named_list") & ((kind != "list") | unnamed), "NOT_A_LIST_OF_NAMED")
    )


def field_errors(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """run_id, fact_id, error of facts (operation, field_key, value as JSON, is_unknown) that break their field's rule.

    Unknown facts are only held against the vocabulary.
    """
    rows = facts.join(rules, ["operation", "field_key"], "left")
    shaped = F.when(~F.col("is_unknown"), _shape_error(F.col("shape"), values.value_type(F.col("value")), F.col("value")))
    error = F.when(F.col("shape").isNull(), "UNKNOWN_FIELD").otherwise(shaped)
    return rows.select("run_id", "fact_id", error.alias("error")).where("error IS NOT NULL")


def run_errors(facts: DataFrame, rules: DataFrame, blocks: DataFrame) -> DataFrame:
    """run_id, fact_id, error of everything that speaks against a run's facts, each once.

    facts has workspace_id, company_id, company_name, run_id, fact_id, operation, field_key, value (JSON), is_unknown,
    cited (array of block keys) and hint.
    """
    known = facts.where("NOT is_unknown")
    said = F.try_variant_get(F.try_parse_json("value"), "$", "string")
    is_text = values.value_type(F.col("value")) == "string"
    broken = facts.select("run_id", "fact_id", F.explode(fact_errors(F.col("value"), F.col("is_unknown"), F.col("cited"), F.col("hint"))).alias("error"))
    cited = known.select("workspace_id", "company_id", "run_id", "fact_id", F.explode(F.array_distinct("cited")).alias("block_key"))
    absent = cited.join(blocks.select("workspace_id", "company_id", "block_key"), ["workspace_id", "company_id", "block_key"], "left_anti").select("run_id", "fact_id", F.lit("NO_SUCH_BLOCK").alias("error"))
    other = known.where((F.col("field_key") == "identity.legal_name") & is_text & name_mismatch(F.col("company_name"), said)).select("run_id", "fact_id", F.lit("NAME_MISMATCH").alias("error"))
    injected = known.where(is_text & (F.size(text.injection_hits(said)) > 0)).select("run_id", "fact_id", F.lit("INJECTION").alias("error"))
    return field_errors(facts, rules).unionByName(broken).unionByName(absent).unionByName(other).unionByName(injected).distinct()


def run_verdicts(facts: DataFrame, errors: DataFrame) -> DataFrame:
    """run_id, n_facts, n_errors, is_valid: one error rejects the whole run."""
    n = errors.groupBy("run_id").agg(F.count("*").alias("n_errors"))
    out = facts.groupBy("run_id").agg(F.count("*").alias("n_facts")).join(n, "run_id", "left")
    return out.select("run_id", "n_facts", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.col("n_errors").isNull().alias("is_valid"))


def accepted_facts(facts: DataFrame, verdicts: DataFrame, blocks: DataFrame, as_of: Column) -> DataFrame:
    """fact_id, field_key, value_type, value, block_key, score of the known facts of valid runs, with their first cited block.

    facts has authority_tier, the tier of the source for the field. Strings lose their control characters; a fact whose
    first block isn't there goes.
    """
    rows = facts.where("NOT is_unknown").join(verdicts.where("is_valid").select("run_id"), "run_id", "left_semi").withColumn("block_key", F.get("cited", 0))
    rows = rows.join(blocks.select("workspace_id", "company_id", "block_key").distinct(), ["workspace_id", "company_id", "block_key"], "left_semi")
    c = F.col
    score = scoring.confidence(c("field_key"), c("authority_tier"), F.lit("direct"), F.lit(None).cast("timestamp"), F.lit("ai"), c("hint"), as_of)
    kind = values.value_type(c("value"))
    clean = F.when(kind == "string", F.regexp_replace("value", r"\\u00(0[0-8bBcCeEfF]|1[0-9a-fA-F]|7[fF])", "")).otherwise(c("value"))
    return rows.select("fact_id", "field_key", kind.alias("value_type"), text.sanitize(clean).alias("value"), "block_key", score.alias("score"))


def prompt_inputs(blocks: DataFrame, key: str, order: str, id_: str, content: str) -> DataFrame:
    """key, prompt, prompt_key: the first blocks of each snapshot, each tagged and cut, and the beginning of their hash."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = blocks.withColumn("__n", place).where(F.col("__n") <= PROMPT_BLOCKS)
    line = F.concat(F.lit("[BLOCK:"), F.col(id_), F.lit("] "), F.substring(content, 1, PROMPT_CHARACTERS))
    rows = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))
    return rows.select(key, "prompt", F.substring(F.sha2("prompt", 256), 1, KEY_LENGTH).alias("prompt_key"))


def merge_translations(texts: DataFrame, translations: DataFrame, target: str) -> DataFrame:
    """text_id, translated, provider of texts (text_id, content, language): passed through, translated, or as they are.

    Blank texts and those already in the target language pass through; one without a translation stays, marked fallback.
    """
    out = texts.join(translations.select("text_id", F.col("translated").alias("__new"), F.col("provider").alias("__by")), "text_id", "left")
    passes = F.coalesce(F.trim("content") == "", F.lit(True)) | F.coalesce(F.col("language") == target, F.lit(False))
    return out.select("text_id", F.when(passes, F.col("content")).otherwise(F.coalesce("__new", "content")).alias("translated"), F.when(passes, "passthrough").otherwise(F.coalesce(F.when(F.col("__new").isNotNull(), F.col("__by")), F.lit("fallback"))).alias("provider"))
