"""Queries over model runs, review work, briefs and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranking, text
from ..operators import facts, model_runs, reports, review
from .profiles import _CONFLICT
from .registry import _SCANNED, AS_OF, over

_RULES = "(VALUES " + ", ".join(f"('{o}', '{f}', '{shape}')" for o, fields in model_runs.FIELDS.items() for f, shape in fields.items()) + ") r(operation, field_key, shape)"
_KIND = "CASE json_type(value) WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'string' END"
_UNNAMED = "len(list_filter(CAST(json(value) AS JSON[]), lambda x: json_type(x) <> 'OBJECT' OR (x -> 'name') IS NULL)) > 0"
_SHAPE = (
    f"CASE WHEN shape = 'year' AND NOT ({_KIND} = 'integer' AND coalesce(TRY_CAST(value AS BIGINT) BETWEEN 1800 AND 2100, FALSE)) THEN 'NOT_A_YEAR' WHEN shape = 'country' AND NOT coalesce(regexp_matches(value ->> '$', '^\\pL{{2}}$'), FALSE) THEN 'NOT_A_COUNTRY_CODE'"
    f" WHEN shape = 'text' AND ({_KIND} <> 'string' OR length(value ->> '$') > 2000) THEN 'NOT_A_SHORT_TEXT' WHEN shape = 'count' AND NOT ({_KIND} = 'integer' AND CAST(value AS BIGINT) >= 0) THEN 'NOT_A_COUNT' WHEN shape = 'list' AND {_KIND} <> 'list' THEN 'NOT_A_LIST'"
    f" WHEN shape = 'named' AND NOT ({_KIND} = 'object' AND json_extract(value, '$.name') IS NOT NULL) THEN 'NOT_A_NAMED_OBJECT' WHEN shape = 'named_list' AND CASE WHEN {_KIND} = 'list' THEN {_UNNAMED} ELSE TRUE END THEN 'NOT_A_LIST_OF_NAMED' END"
)
_FIELD = f"SELECT run_id, fact_id, CASE WHEN shape IS NULL THEN 'UNKNOWN_FIELD' WHEN NOT is_unknown THEN {_SHAPE} END AS error FROM b_run_fact LEFT JOIN {_RULES} USING (operation, field_key)"


def _cited(f):
    return f.withColumn("cited", F.filter(F.split("cited", ","), lambda x: x != ""))


# a null value has no type that JSON knows: it is a string, as it is for the operator
_FIELD_ERRORS = f"SELECT * FROM ({_FIELD}) WHERE error IS NOT NULL"
over("i2_field_errors", "b_run_fact", _FIELD_ERRORS, lambda f: model_runs.field_errors(_cited(f), model_runs.field_rules(f.sparkSession)))

_WORDS = "list_filter(string_split(trim(regexp_replace(lower(company_name), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 2)"
_INJECTED = " OR ".join(f"regexp_matches(value ->> '$', '(?i){p}')" for p in text.INJECTIONS)
_ERRORS = (
    f"{_FIELD_ERRORS} UNION SELECT run_id, fact_id, 'UNKNOWN_WITH_VALUE' FROM b_run_fact WHERE is_unknown AND value IS NOT NULL UNION SELECT run_id, fact_id, 'NO_EVIDENCE' FROM b_run_fact WHERE NOT is_unknown AND cited = ''"
    " UNION SELECT run_id, fact_id, 'NO_VALUE' FROM b_run_fact WHERE NOT is_unknown AND value IS NULL UNION SELECT run_id, fact_id, 'HINT_OUT_OF_RANGE' FROM b_run_fact WHERE hint < 0 OR hint > 1"
    " UNION SELECT run_id, fact_id, 'NO_SUCH_BLOCK' FROM (SELECT workspace_id, company_id, run_id, fact_id, unnest(string_split(cited, ',')) AS block_key FROM b_run_fact WHERE NOT is_unknown AND cited <> '') ANTI JOIN b_label_block USING (workspace_id, company_id, block_key)"
    f" UNION SELECT run_id, fact_id, 'NAME_MISMATCH' FROM b_run_fact WHERE NOT is_unknown AND field_key = 'identity.legal_name' AND {_KIND} = 'string' AND value IS NOT NULL AND len({_WORDS}) > 0 AND len(list_filter({_WORDS}, lambda w: contains(lower(value ->> '$'), w))) = 0"
    f" UNION SELECT run_id, fact_id, 'INJECTION' FROM b_run_fact WHERE NOT is_unknown AND {_KIND} = 'string' AND ({_INJECTED})"
)


def _errors(f, b):
    return model_runs.run_errors(_cited(f), model_runs.field_rules(f.sparkSession), b)


over("i5_run_errors", "b_run_fact b_label_block", _ERRORS, _errors)
_VERDICTS = f"SELECT run_id, count(*) AS n_facts, coalesce(any_value(n), 0) AS n_errors, any_value(n) IS NULL AS is_valid FROM b_run_fact LEFT JOIN (SELECT run_id, count(*) AS n FROM ({_ERRORS}) GROUP BY run_id) USING (run_id) GROUP BY run_id"
over("i5_run_verdicts", "b_run_fact b_label_block", _VERDICTS, lambda f, b: model_runs.run_verdicts(f, _errors(f, b)))
_AUTH = "CASE WHEN field_key IN ('identity.legal_name', 'identity.tax_id', 'identity.registration_number', 'identity.country') AND authority_tier = 1 THEN 1.00 WHEN field_key IN ('overview.description', 'products.list', 'markets.target_markets') AND authority_tier IN (1, 2) THEN 0.95 WHEN authority_tier = 1 THEN 1.00 WHEN authority_tier = 2 THEN 0.85 WHEN authority_tier = 3 THEN 0.70 ELSE 0.50 END"
_AI = f"CAST(round(CAST({_AUTH} AS DECIMAL(8,4)) * 0.40 + 0.95 * 0.30 + CAST(least(1.00, greatest(0.50, CAST(coalesce(hint, 0.80) AS DECIMAL(5,2)) * 0.95)) AS DECIMAL(8,4)) * 0.15 + 1.00 * 0.15, 2) AS DOUBLE)"
over("i8_model_facts", "b_run_fact b_label_block", f"SELECT fact_id, field_key, {_KIND} AS value_type, value, split_part(cited, ',', 1) AS block_key, {_AI} AS score FROM b_run_fact JOIN (SELECT run_id FROM ({_VERDICTS}) WHERE is_valid) USING (run_id) SEMI JOIN b_label_block b ON b.workspace_id = b_run_fact.workspace_id AND b.company_id = b_run_fact.company_id AND b.block_key = split_part(cited, ',', 1) WHERE NOT is_unknown", lambda f, b: model_runs.accepted_facts(_cited(f), model_runs.run_verdicts(f, _errors(f, b)), b, F.expr(AS_OF)))
_PROMPT = "SELECT source_id, string_agg(concat('[BLOCK:', snapshot_id, '] ', substring(content, 1, 2000)), chr(10) ORDER BY snapshot_id) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY snapshot_id) AS n FROM b_snapshot) WHERE n <= 20 GROUP BY source_id"
over("i6_prompt_inputs", "b_snapshot", f"SELECT source_id, prompt, substring(sha256(prompt), 1, 16) AS prompt_key FROM ({_PROMPT})", lambda s: model_runs.prompt_inputs(s.withColumn("block", F.col("snapshot_id").cast("string")), "source_id", "snapshot_id", "block", "content"))
_PASSES = "coalesce(trim(content) = '', TRUE) OR coalesce(language = 'en', FALSE)"
over("i9_translations", "b_translation b_translated", f"SELECT text_id, CASE WHEN {_PASSES} THEN content ELSE coalesce(translated, content) END AS translated, CASE WHEN {_PASSES} THEN 'passthrough' ELSE coalesce(provider, 'fallback') END AS provider FROM b_translation LEFT JOIN b_translated USING (text_id)", lambda t, n: model_runs.merge_translations(t, n, "en"))

_LABEL = "CASE field_key " + " ".join(f"WHEN '{f}' THEN '{label}'" for f, label, _ in review.MANDATORY) + " ELSE field_key END"
_ASKED = "CASE field_key " + " ".join(f"WHEN '{f}' THEN '{priority}'" for f, _, priority in review.MANDATORY) + " ELSE 'high' END"
_FIELDS = tuple(f for f, _, _ in review.MANDATORY)
_GAPS = f"SELECT workspace_id, company_id, field_key FROM (SELECT * FROM b_company CROSS JOIN (SELECT unnest(['{"', '".join(_FIELDS)}']) AS field_key)) ANTI JOIN (SELECT workspace_id, company_id, field_key FROM b_fact WHERE {_SCANNED}) USING (workspace_id, company_id, field_key) WHERE CASE field_key WHEN 'identity.legal_name' THEN coalesce(legal_name, '') WHEN 'identity.tax_id' THEN coalesce(tax_id, '') WHEN 'identity.registration_number' THEN coalesce(registration_number, '') ELSE '' END = ''"


def _tasks(c, f, o):
    job = lambda df: df.withColumn("job_id", F.substring("company_id", 2, 9).cast("bigint"))
    gaps = facts.missing_fields(c, f.where(F.col("fact_status").isin(*facts.SCANNED)), _FIELDS, profile_columns=True)
    return review.review_tasks(job(facts.detect_conflicts(f)), o, o, job(gaps))


over("j1_review_tasks", "b_company b_fact b_outcome", (
    f"SELECT workspace_id, company_id, job_id, task_type, title, min(priority) AS priority FROM (SELECT workspace_id, company_id, CAST(substring(company_id, 2, 9) AS BIGINT) AS job_id, 'field_conflict' AS task_type, concat('Review conflicting value for ', field_key) AS title, CASE materiality WHEN 'critical' THEN 'urgent' WHEN 'high' THEN 'high' ELSE 'medium' END AS priority FROM ({_CONFLICT})"
    " UNION ALL SELECT workspace_id, company_id, job_id, 'identity_ambiguity', concat('Review source identity match: ', url), 'high' FROM b_outcome WHERE reason = 'ENTITY_MATCH_REVIEW_REQUIRED'"
    " UNION ALL SELECT workspace_id, company_id, job_id, 'source_verification', concat('Verify source provider availability: ', provider), CASE WHEN outcome = 'manual_required' THEN 'medium' ELSE 'high' END FROM b_outcome WHERE outcome <> 'success'"
    f" UNION ALL SELECT workspace_id, company_id, CAST(substring(company_id, 2, 9) AS BIGINT), 'high_impact_fact', concat('Verify mandatory high-impact field: ', {_LABEL}), {_ASKED} FROM ({_GAPS})) GROUP BY ALL"
), _tasks)

_OK = "(e.action <> 'claim' OR f.status IN ('open', 'reopened', 'changes_requested'))"
_FOLD = (
    "WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS n FROM b_review_event), f AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS n, 'open' AS status, CAST(NULL AS VARCHAR) AS assigned_to, 1 AS row_version, 0 AS n_refused FROM e UNION ALL"
    f" SELECT f.task_id, e.n, CASE WHEN {_OK} THEN CASE e.action WHEN 'claim' THEN 'in_review' WHEN 'release' THEN 'open' WHEN 'complete' THEN 'completed' ELSE 'reopened' END ELSE f.status END,"
    f" CASE WHEN {_OK} AND e.action = 'claim' THEN e.actor WHEN e.action = 'release' THEN NULL ELSE f.assigned_to END, f.row_version + CASE WHEN {_OK} THEN 1 ELSE 0 END, f.n_refused + CASE WHEN {_OK} THEN 0 ELSE 1 END FROM f JOIN e ON e.task_id = f.task_id AND e.n = f.n + 1)"
    " SELECT task_id, arg_max(status, n) AS status, max_by(struct_pack(a := assigned_to), n).a AS assigned_to, arg_max(row_version, n) AS row_version, arg_max(n_refused, n) AS n_refused FROM f GROUP BY task_id"
)
over("j3_review_states", "b_review_event", _FOLD, review.fold_reviews)

_SAYS = lambda marks: " OR ".join(f"contains(upper(message), '{m}')" for m in marks)
_TRANSPORT = f"CASE WHEN kind = 'timeout' THEN 'HTTP_REQUEST_TIMEOUT' WHEN {_SAYS(review.CERTIFICATE)} THEN 'TLS_CERTIFICATE_VERIFICATION_FAILED' WHEN {_SAYS(review.COMPATIBILITY)} THEN 'TLS_COMPATIBILITY_ERROR' WHEN {_SAYS(review.HANDSHAKE)} THEN 'TLS_HANDSHAKE_FAILED' WHEN kind = 'connect' THEN 'CONNECT_ERROR' ELSE 'HTTP_CLIENT_ERROR' END"
over("c15_error_codes", "b_error", (
    f"SELECT event_id, {_TRANSPORT} AS transport, CASE WHEN status = 404 THEN 'not_found:HTTP_404' WHEN status IN (401, 403, 407) THEN concat('blocked:ACCESS_CONTROL_HTTP_', status) WHEN status = 429 THEN 'unavailable:RATE_LIMITED' WHEN status <> 200 THEN concat('unavailable:HTTP_', status) END AS provider,"
    " CASE status WHEN 429 THEN 'AI_QUOTA_EXCEEDED' WHEN 401 THEN 'AI_AUTHENTICATION_FAILED' WHEN 403 THEN 'AI_AUTHENTICATION_FAILED' WHEN 404 THEN 'AI_MODEL_NOT_FOUND' WHEN 400 THEN 'AI_REQUEST_REJECTED' ELSE CASE WHEN coalesce(status >= 500, FALSE) OR kind = 'connect' THEN 'AI_PROVIDER_UNAVAILABLE' ELSE 'AI_PROVIDER_ERROR' END END AS model,"
    " concat('TASK_STEP_FAILED:fetch:', CASE WHEN regexp_matches(trim(message), '^[A-Z0-9_:-]{1,160}$') THEN trim(message) ELSE upper(kind) END) AS task FROM b_error"
), lambda e: e.select("event_id", review.transport_code(F.col("kind"), F.col("message")).alias("transport"), review.provider_code(F.col("status")).alias("provider"), review.model_code(F.col("status"), F.col("kind") == "connect").alias("model"), review.task_code(F.lit("fetch"), F.col("kind"), F.col("message")).alias("task")))
over("c16_diagnostics", "b_error", "SELECT job_id, event_id, warning FROM b_error QUALIFY row_number() OVER (PARTITION BY job_id, CASE WHEN starts_with(warning, 'SEARCH_PROVIDER_UNAVAILABLE:') THEN 'SEARCH_PROVIDER_UNAVAILABLE' ELSE warning END ORDER BY event_id) = 1", lambda e: review.diagnostics(e, "job_id", "event_id"))

_PIVOT = {"legal": "identity.legal_name", "i1": "identity.industry", "i2": "overview.industry", "about": "overview.description", "tax": "identity.tax_id", "site": "identity.website", "staff": "size.employee_range"}
_VALUES = "SELECT version_id, " + ", ".join(f"max(display_value) FILTER (field_key = '{k}') AS {a}" for a, k in _PIVOT.items()) + " FROM b_brief_value WHERE context_key = '' GROUP BY version_id"


def _brief(locale: str) -> str:
    head, ask_tax, ask_size, ask_offer = reports.SENTENCES[locale]
    return (
        f"SELECT version_id, concat('{head}', coalesce(legal, title)) AS title, coalesce(legal, title) AS legal_name, coalesce(i1, i2, 'Commercial Entity') AS industry, coalesce(about, summary) AS description, coalesce(tax, 'N/A') AS tax_id, coalesce(site, 'N/A') AS website, coalesce(staff, 'N/A') AS employee_range,"
        " concat_ws(',', CASE WHEN tax IS NULL THEN 'tax_id' END, CASE WHEN about IS NULL THEN 'overview_description' END, CASE WHEN staff IS NULL THEN 'employee_size' END) AS missing,"
        f" concat_ws(' | ', printf('{ask_tax}', coalesce(tax, 'N/A')), CASE WHEN staff IS NOT NULL THEN printf('{ask_size}', staff) END, '{ask_offer}') AS questions FROM b_shown_version LEFT JOIN ({_VALUES}) USING (version_id)"
    )


for _locale in ("vi", "en"):
    over(f"k12_meeting_briefs_{_locale}", "b_shown_version b_brief_value", _brief(_locale), lambda v, x, locale=_locale: reports.meeting_briefs(v, x, locale).withColumn("missing", F.array_join("missing", ",")).withColumn("questions", F.array_join("questions", " | ")))

_PASSED = ["coalesce(tax_id <> '', FALSE)", "coalesce(legal_name <> '', FALSE)", "coalesce(website_url <> '', FALSE)", "coalesce(n, 0) >= 2"]
_REFS = ["concat('company.tax_id:', tax_id)", "concat('company.legal_name:', legal_name)", "concat('company.website_url:', website_url)", "concat('facts_count:', n)"]
_REASONS = ", ';', ".join(f"'{c} ', CASE WHEN {p} THEN concat('passed ', {r}) ELSE 'missing ' END" for c, p, r in zip(reports.CRITERIA, _PASSED, _REFS, strict=True))
_FIT = f"SELECT *, CASE WHEN fit_score >= 0.75 THEN 'eligible' WHEN fit_score >= 0.5 THEN 'review_recommended' ELSE 'needs_more_data' END AS status FROM (SELECT workspace_id, company_id, ({' + '.join(f'CAST({p} AS INT)' for p in _PASSED)})::DOUBLE / 4 AS fit_score, concat({_REASONS}) AS reasons FROM b_company LEFT JOIN (SELECT workspace_id, company_id, count(*) AS n FROM b_fact WHERE fact_status = 'accepted' GROUP BY ALL) USING (workspace_id, company_id))"


def _fits(c, f):
    told = F.transform("reasons", lambda r: F.concat(r["criterion"], F.lit(" "), r["status"], F.lit(" "), F.coalesce(r["evidence_ref"], F.lit(""))))
    return reports.fit_assessments(c, f).withColumn("reasons", F.array_join(told, ";"))


over("k13_fit_assessments", "b_company b_fact", _FIT, _fits)
over("k14_fit_overrides", "b_company b_fact b_fit_override", f"SELECT f.*, override, notes, coalesce(override, status) AS final_status FROM ({_FIT}) f LEFT JOIN (SELECT * FROM b_fit_override WHERE override IN ('eligible', 'review_recommended', 'ineligible', 'needs_more_data')) USING (workspace_id, company_id)", lambda c, f, o: reports.apply_fit_overrides(_fits(c, f), o))


def _exported(v, x, e):
    # a document is read once for all that is told of it
    whole = "title string, version_number int, content_hash string, fields array<struct<field_key:string,display_value:string,evidences:array<struct<excerpt:string>>>>"

    def told(d):
        f = d["fields"]
        n = F.aggregate(f, F.lit(0), lambda a, y: a + F.size(y["evidences"]))
        shown = F.array_join(F.transform(f, lambda y: F.concat(y["field_key"], F.lit("="), y["display_value"])), ";")
        return F.struct(d["title"].alias("title"), d["version_number"].alias("version_number"), d["content_hash"].alias("content_hash"), F.size(f).alias("n_fields"), n.alias("n_evidence"), shown.alias("shown"))

    out = reports.export_json(v, x, e)
    return out.select("version_id", ranking.let(F.from_json("document", whole), told).alias("t"), (F.col("checksum") == F.sha2("document", 256)).alias("sealed")).select("version_id", "t.*", "sealed")


over("a9_json_exports", "b_shown_version b_field_value b_field_evidence", (
    "SELECT version_id, title, version_number, content_hash, coalesce(CAST(n_fields AS INT), 0) AS n_fields, coalesce(CAST(n AS INT), 0) AS n_evidence, coalesce(shown, '') AS shown, TRUE AS sealed FROM b_shown_version LEFT JOIN (SELECT version_id, count(*) AS n_fields, string_agg(concat(field_key, '=', display_value), ';' ORDER BY field_key, context_key) AS shown FROM b_field_value GROUP BY version_id) USING (version_id)"
    " LEFT JOIN (SELECT version_id, count(*) AS n FROM b_field_evidence SEMI JOIN b_field_value USING (version_id, field_key, context_key) GROUP BY version_id) USING (version_id)"
), _exported, keyed=True)
_TITLE = "concat('VERIFIED COMPANY PROFILE — v', version_number)"
_TEXT = (
    f"concat({_TITLE}, chr(10), repeat('=', length({_TITLE})), chr(10), title, ' (Published: ', strftime(published_at, '%Y-%m-%d'), ')', chr(10), 'Hash: ', content_hash, chr(10), chr(10), 'Executive Summary:', chr(10), summary, chr(10), chr(10), 'Fields:', chr(10), coalesce(lines, ''),"
    " CASE WHEN proofs IS NOT NULL THEN concat(chr(10), chr(10), 'Source Evidence Appendix:', chr(10), proofs) ELSE '' END)"
)
over("a10_text_exports", "b_shown_version b_field_value b_field_evidence", (
    f"SELECT version_id, sha256(document) AS checksum, CAST(strlen(document) AS INT) AS bytes FROM (SELECT version_id, {_TEXT} AS document FROM b_shown_version"
    " LEFT JOIN (SELECT version_id, string_agg(concat('• ', field_key, ': ', display_value, ' (Confidence: ', CAST(floor(confidence * 100) AS INT), '%)'), chr(10) ORDER BY field_key, context_key) AS lines FROM b_field_value GROUP BY version_id) USING (version_id)"
    " LEFT JOIN (SELECT version_id, string_agg(concat('  - [', field_key, '] Excerpt: \"', excerpt, '\" (URL: ', coalesce(url, 'N/A'), ')'), chr(10) ORDER BY field_key, context_key, excerpt, url NULLS FIRST) AS proofs FROM b_field_evidence SEMI JOIN b_field_value USING (version_id, field_key, context_key) GROUP BY version_id) USING (version_id))"
), lambda v, x, e: reports.export_text(v, x, e).drop("document"))
