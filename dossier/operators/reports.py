"""Briefs, fit to a program, and exports of published profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Criteria of the fit to a program, and from which score on each status holds (fixed values).
CRITERIA = ("tax_registration_verified", "legal_name_verified", "digital_footprint_established", "minimum_fact_density")
LEAST_FACTS, STATUSES = 2, ((0.75, "eligible"), (0.5, "review_recommended"), (0.0, "needs_more_data"))
OVERRIDES = ("eligible", "review_recommended", "ineligible", "needs_more_data")

#: Sentences of a brief, by language (fixed values).
SENTENCES = {
    "vi": ("Tóm Tắt Cuộc Họp: ", "Xác nhận tên pháp lý chính thức và mã số thuế hiện tại (%s).", "Xác nhận quy mô nhân sự (%s) và địa bàn hoạt động chính.", "Hỏi về các sản phẩm/dịch vụ chủ lực đang triển khai trong năm nay."),
    "en": ("Executive Meeting Brief: ", "Verify official legal name and tax registration ID (%s).", "Confirm headcount footprint (%s) and primary market presence.", "Inquire about flagship products/services actively offered this year."),
}
ASKED = {"identity.tax_id": "tax_id", "overview.description": "overview_description", "size.employee_range": "employee_size"}


def meeting_briefs(versions: DataFrame, values: DataFrame, locale: str = "vi") -> DataFrame:
    """version_id, title, legal_name, industry, description, tax_id, website, employee_range, missing, questions of every version.

    versions has version_id, title and summary, values field_key, context_key and display_value; only values without a
    context count.
    """
    heading, ask_tax, ask_size, ask_offer = SENTENCES["vi" if locale.startswith("vi") else "en"]
    keys = {"legal": "identity.legal_name", "i1": "identity.industry", "i2": "overview.industry", "about": "overview.description", "tax": "identity.tax_id", "site": "identity.website", "staff": "size.employee_range"}
    found = values.where("context_key = ''").groupBy("version_id").agg(*[F.max(F.when(F.col("field_key") == k, F.coalesce("display_value", F.lit("")))).alias(a) for a, k in keys.items()])
    out = versions.join(found, "version_id", "left")
    legal, tax, staff = F.coalesce("legal", "title"), F.coalesce("tax", F.lit("N/A")), F.coalesce("staff", F.lit("N/A"))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(ASKED[keys[c]])) for c in ("tax", "about", "staff")]))
    questions = F.array_compact(F.array(F.format_string(ask_tax, tax), F.when(F.col("staff").isNotNull(), F.format_string(ask_size, staff)), F.lit(ask_offer)))
    return out.select(
        "version_id", F.concat(F.lit(heading), legal).alias("title"), legal.alias("legal_name"), F.coalesce("i1", "i2", F.lit("Commercial Entity")).alias("industry"), F.coalesce("about", "summary").alias("description"),
        tax.alias("tax_id"), F.coalesce("site", F.lit("N/A")).alias("website"), staff.alias("employee_range"), missing.alias("missing"), questions.alias("questions"),
    )


def fit_assessments(companies: DataFrame, facts: DataFrame) -> DataFrame:
    """workspace_id, company_id, fit_score, status, reasons (criterion, status, evidence_ref) of every company."""
    n = facts.where("fact_status = 'accepted'").groupBy("workspace_id", "company_id").agg(F.count("*").alias("__n"))
    out = companies.join(n, ["workspace_id", "company_id"], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    checks = [(has(c), F.concat(F.lit(f"company.{c}:"), F.col(c))) for c in ("tax_id", "legal_name", "website_url")]
    checks.append((F.col("__n") >= LEAST_FACTS, F.concat(F.lit("facts_count:"), F.col("__n").cast("string"))))
    reasons = [F.struct(F.lit(k).alias("criterion"), F.when(ok, "passed").otherwise("missing").alias("status"), F.when(ok, ref).alias("evidence_ref")) for k, (ok, ref) in zip(CRITERIA, checks, strict=True)]
    score = sum((F.when(ok, 1).otherwise(0) for ok, _ in checks), F.lit(0)) / len(checks)
    status = F.lit(STATUSES[-1][1])
    for least, name in reversed(STATUSES[:-1]):
        status = F.when(score >= least, name).otherwise(status)
    return out.select("workspace_id", "company_id", score.alias("fit_score"), status.alias("status"), F.array(*reasons).alias("reasons"))


def apply_fit_overrides(fits: DataFrame, overrides: DataFrame) -> DataFrame:
    """Assessments with the reviewer's status and notes, and the status that holds; overrides beyond the vocabulary don't count."""
    own = overrides.where(F.col("override").isin(*OVERRIDES)).select("workspace_id", "company_id", "override", "notes")
    return fits.join(own, ["workspace_id", "company_id"], "left").withColumn("final_status", F.coalesce("override", "status"))


def export_json(versions: DataFrame, values: DataFrame, evidence: DataFrame, *, appendix: bool = True) -> DataFrame:
    """version_id, document (JSON), checksum, bytes of every version, its fields in order of their keys.

    versions has version_id, title, version_number, content_hash and overall_confidence; values and evidence have
    version_id, field_key and context_key. A version's fields are few, so one row holds them. Fields and evidence are gathered
    by version and meet as whole versions, so tables that are dealt by version aren't dealt again.
    """
    keys = ["version_id", "field_key", "context_key"]
    proofs = "array<struct<excerpt:string,url:string,tier:int>>"
    field = F.struct("field_key", "context_key", "value_json", "display_value", F.col("display_status").alias("status"), "confidence")
    fields = values.groupBy("version_id").agg(F.array_sort(F.collect_list(field)).alias("fields"))
    none, given = F.array().cast(proofs), lambda f: F.lit(None)
    if appendix:
        own = evidence.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("excerpt", "url", "tier"))).alias("evidences"))
        fields = fields.join(own.groupBy("version_id").agg(F.collect_list(F.struct("field_key", "context_key", "evidences")).alias("own")), "version_id", "left")
        given = lambda f: F.get(F.filter("own", lambda e: (e["field_key"] == f["field_key"]) & (e["context_key"] == f["context_key"])), F.lit(0))["evidences"]
    fields = fields.select("version_id", F.transform("fields", lambda f: f.withField("evidences", F.coalesce(given(f).cast(proofs), none))).alias("fields"))
    out = versions.join(fields, "version_id", "left")
    document = F.to_json(F.struct("title", "version_number", "content_hash", "overall_confidence", F.coalesce("fields", F.array().cast(fields.schema["fields"].dataType)).alias("fields")))
    out = out.select("version_id", document.alias("document"))
    return out.select("version_id", "document", F.sha2("document", 256).alias("checksum"), F.octet_length("document").alias("bytes"))


def export_text(versions: DataFrame, values: DataFrame, evidence: DataFrame, *, appendix: bool = True) -> DataFrame:
    """version_id, document (a report in plain text), checksum, bytes of every version; versions also has summary and published_at."""
    keys = ["version_id", "field_key", "context_key"]
    percent = F.floor(F.col("confidence") * 100).cast("int").cast("string")
    line = F.concat(F.lit("• "), "field_key", F.lit(": "), F.coalesce("display_value", "value_json", F.lit("")), F.lit(" (Confidence: "), percent, F.lit("%)"))
    fields = values.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("field_key", "context_key", line.alias("line")))).alias("f"))
    proof = F.concat(F.lit("  - ["), "field_key", F.lit('] Excerpt: "'), "excerpt", F.lit('" (URL: '), F.coalesce("url", F.lit("N/A")), F.lit(")"))
    proofs = evidence.join(values.select(*keys), keys, "left_semi").groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("field_key", "context_key", "excerpt", "url", proof.alias("line")))).alias("e"))
    out = versions.join(fields, "version_id", "left").join(proofs, "version_id", "left")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    title = F.concat(F.lit("VERIFIED COMPANY PROFILE — v"), F.col("version_number").cast("string"))
    parts = [
        title, F.lit("\n"), F.repeat(F.lit("="), F.length(title)), F.lit("\n"), F.col("title"), F.lit(" (Published: "), F.date_format("published_at", "yyyy-MM-dd"), F.lit(")\nHash: "), F.col("content_hash"),
        F.lit("\n\nExecutive Summary:\n"), F.col("summary"), F.lit("\n\nFields:\n"), F.coalesce(joined("f"), F.lit("")),
    ]
    if appendix:
        parts.append(F.coalesce(F.concat(F.lit("\n\nSource Evidence Appendix:\n"), joined("e")), F.lit("")))
    out = out.select("version_id", F.concat(*parts).alias("document"))
    return out.select("version_id", "document", F.sha2("document", 256).alias("checksum"), F.octet_length("document").alias("bytes"))
