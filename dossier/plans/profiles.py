"""Queries over names, candidates, publication and jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, url
from ..operators import companies, facts, work
from .registry import _ACTIVE, _DOMAIN, _KEY, _MEMBERS, _NORMAL, _SCORE, AS_OF, _has, _in, over, query


def _pages(s, d, *columns):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", *columns)


_FORMS = "lower(strip_accents({}))"
for _f in text.LEGAL_FORMS:
    _FORMS = f"regexp_replace({_FORMS}, '\\b{_f}\\b', ' ', 'g')"
_NAME = f"coalesce(nullif(trim(regexp_replace(regexp_replace({_FORMS}, '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ''), trim(lower({{}})), '')"
_name = lambda c: _NAME.format(c, c)
_clean = lambda c: f"trim(regexp_replace({c}, '{text.SPACES}', ' ', 'g'))"

over("c1_c2_company_names", "b_company", f"SELECT workspace_id, company_id, {_name('company_name')} AS normalized, trim(regexp_replace(lower(strip_accents(company_name)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM b_company", lambda c: c.select("workspace_id", "company_id", text.normalize_name(F.col("company_name")).alias("normalized"), text.fold_text(F.col("company_name")).alias("folded")))
over("c4_c6_clean_text", "b_snapshot", f"SELECT snapshot_id, {_clean('content')} AS cleaned, CASE WHEN {_has('lower(content)', text.MARKERS['vi'])} THEN 'vi' WHEN {_has('lower(content)', text.MARKERS['en'])} THEN 'en' ELSE 'und' END AS inferred FROM b_snapshot", lambda s: s.select("snapshot_id", text.clean_text(F.col("content")).alias("cleaned"), text.infer_language(F.col("content")).alias("inferred")))
_HITS = ", ".join(f"CASE WHEN regexp_matches(content, '(?i){p}') THEN '{p}' END" for p in text.INJECTIONS)
over("c12_c13_injection", "b_snapshot", f"SELECT snapshot_id, concat_ws(' ; ', {_HITS}) AS hits, regexp_replace(content, '{text.CONTROLS}', '', 'g') <> content AS changed FROM b_snapshot", lambda s: s.select("snapshot_id", F.array_join(text.injection_hits(F.col("content")), " ; ").alias("hits"), (text.sanitize(F.col("content")) != F.col("content")).alias("changed")))
over("c14_l4_redacted", "b_audit", f"SELECT audit_id, k AS key, CASE WHEN regexp_matches(lower(k), '{'|'.join(text.SENSITIVE)}') THEN '[REDACTED]' ELSE metadata_json ->> ('$.\"' || k || '\"') END AS value FROM (SELECT audit_id, metadata_json, unnest(json_keys(metadata_json)) AS k FROM b_audit)", lambda a: a.select("audit_id", F.explode(F.from_json("metadata_json", "map<string,string>"))).select("audit_id", "key", text.redact(F.col("key"), F.col("value")).alias("value")))


_STATUS = "CASE CAST(page_id % 7 AS INT) WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 403 WHEN 3 THEN 500 ELSE 200 END"
_THIN = f"length({_clean("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) < 80 AND (contains(lower(html), '<script') OR contains(lower(html), 'id=\"root\"'))"


@query("b10_b12_b13_page_checks", f"SELECT page_id, CASE WHEN contains(url, '://') THEN url ELSE concat('https://', url) END AS full_url, CASE WHEN {_STATUS} IN (404, 410) THEN TRUE ELSE {_STATUS} = 200 AND {_THIN} END AS needs_render, contains(html, '{text.SIGNATURE}') AS infected FROM pages")
def page_checks(s, d):
    rendered = text.needs_render(F.col("html"), F.expr(_STATUS), F.lit("text/html"))
    return _pages(s, d, url.ensure_scheme(F.col("url")).alias("full_url"), rendered.alias("needs_render"), text.malware_flag(F.col("html")).alias("infected"))


_GIVEN = "CASE WHEN page_id % 3 = 0 THEN concat(' EN_', CAST(page_id % 4 AS STRING)) END"


@query("c6_page_language", f"SELECT page_id, coalesce(nullif(lower(trim(replace({_GIVEN}, '_', '-'))), ''), nullif(lower(regexp_extract(html, '(?i)<html[^>]*[ \\t\\n]lang=[\"'']?([^\"'' >]*)', 1)), ''), CASE WHEN {_has('lower(html)', text.MARKERS['vi'])} THEN 'vi' WHEN {_has('lower(html)', text.MARKERS['en'])} THEN 'en' ELSE 'und' END) AS language FROM pages")
def page_language(s, d):
    return _pages(s, d, text.infer_language(F.col("html"), F.col("html"), F.expr(_GIVEN)).alias("language"))


@query("d2_page_meta", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, lower(regexp_extract(html, '(?i)<html[^>]* lang=\"([^\"]*)\"', 1)) AS language FROM pages")
def page_meta(s, d):
    return _pages(s, d, F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.lower(F.regexp_extract("html", '(?i)<html[^>]* lang="([^"]*)"', 1)).alias("language"))


CAP = 10_000_000
_BLANK = r"[ \t\n\x0B\f\r]"


def _text_blocks(cap: int) -> str:
    trimmed = f"regexp_replace(text, '^{text.SPACES}|{text.SPACES}$', '', 'g')"
    parts = f"SELECT doc_id, unnest(l) AS raw, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, regexp_split_to_array({trimmed}, '\\n{_BLANK}*\\n') AS l FROM documents)"
    return f"SELECT doc_id, concat('p1_b', n) AS block_key, block FROM (SELECT doc_id, n, block, sum(strlen(block)) OVER (PARTITION BY doc_id ORDER BY n) AS bytes FROM (SELECT doc_id, n, {_clean('raw')} AS block FROM ({parts})) WHERE block <> '') WHERE bytes <= {cap}"


@query("d7_text_blocks", _text_blocks(CAP))
def text_blocks(s, d):
    return work.text_blocks(s.read.parquet(f"{d}/documents.parquet"), CAP)


_TERMS = "list_filter(regexp_split_to_array(lower(company_name), '[^\\pL\\pN_]+'), lambda t: length(t) > 2)"


def _match(low: str) -> str:
    share = f"CASE WHEN len({_TERMS}) > 0 THEN CAST(len(list_filter({_TERMS}, lambda t: contains({low}, t))) AS DOUBLE) / len({_TERMS}) * 0.5::DOUBLE ELSE 0 END"
    return f"CASE WHEN {low} = '' THEN 0::DOUBLE ELSE round_even(least(1::DOUBLE, CASE WHEN tax_id <> '' AND contains({low}, tax_id) THEN 0.5::DOUBLE ELSE 0::DOUBLE END + {share}), 2) END"


over("g5_entity_match", "b_company b_label_block", f"SELECT workspace_id, company_id, block_key, {_match('lower(text_content)')} AS score FROM b_company JOIN b_label_block USING (workspace_id, company_id)", lambda c, b: c.join(b, ["workspace_id", "company_id"]).select("workspace_id", "company_id", "block_key", text.entity_match(F.col("company_name"), F.col("tax_id"), F.col("text_content")).alias("score")))
over("g3_lookup_by_name", "b_alias b_company", f"SELECT workspace_id, name, coalesce(own, other) AS company_id, CASE WHEN own IS NOT NULL THEN 'name' WHEN other IS NOT NULL THEN 'alias' END AS matched_by FROM (SELECT workspace_id, alias_name AS name, {_name('alias_name')} AS k FROM b_alias) LEFT JOIN (SELECT workspace_id, {_name('company_name')} AS k, min(company_id) AS own FROM b_company GROUP BY ALL) USING (workspace_id, k) LEFT JOIN (SELECT workspace_id, {_name('alias_name')} AS k, min(company_id) AS other FROM b_alias GROUP BY ALL) USING (workspace_id, k)", lambda a, c: companies.lookup_by_name(a.withColumnRenamed("alias_name", "name"), c, a.select("*")))
over("g7_default_aliases", "b_company", f"SELECT workspace_id, company_id, {_name('alias_name')} AS normalized_alias, min(alias_type) AS alias_type FROM (SELECT workspace_id, company_id, company_name AS alias_name, 'display_name' AS alias_type FROM b_company UNION ALL SELECT workspace_id, company_id, legal_name, 'legal_name' FROM b_company WHERE legal_name IS NOT NULL) GROUP BY ALL", companies.default_aliases)
over("g9_list_companies", "b_company", "SELECT workspace_id, company_id, company_name, place FROM (SELECT workspace_id, company_id, company_name, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY company_name, company_id) AS INT) AS place FROM b_company WHERE status = 'published' AND (contains(lower(company_name), 'node 1') OR contains(lower(tax_id), 'node 1') OR contains(lower(registration_number), 'node 1'))) WHERE place > 2 AND place <= 22", lambda c: companies.list_companies(c, status="published", term="node 1", limit=20, offset=2))
over("g10_company_changes", "b_company b_company_change", (
    "SELECT workspace_id, company_id, CASE WHEN idle OR action = 'update' THEN status WHEN action = 'archive' THEN 'archived' ELSE 'published' END AS status, CASE WHEN NOT idle AND action = 'update' THEN coalesce(new_name, company_name) ELSE company_name END AS company_name,"
    " CASE WHEN idle THEN 0 ELSE 1 END AS version_steps, coalesce(action = 'restore' AND status = 'merged', FALSE) AS refused FROM (SELECT c.*, action, h.company_name AS new_name,"
    " action IS NULL OR (action = 'restore' AND status = 'merged') OR (action = 'archive' AND status = 'archived') AS idle FROM b_company c LEFT JOIN b_company_change h USING (workspace_id, company_id))"
), companies.apply_company_changes)

_PRIORITY = "CASE discovered_via " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in companies.PRIORITY.items()) + " ELSE 0 END"
over("e4_merge_candidates", "b_candidate", f"SELECT workspace_id, company_id, normalized, arg_max(discovered_via, ({_PRIORITY}, -ord)) AS preferred, string_agg(discovered_via, ',' ORDER BY ord) AS provenance, min(depth) AS crawl_depth, bool_or(given) AS provided FROM (SELECT workspace_id, company_id, {_NORMAL} AS normalized, discovered_via, min(ord) AS ord, min(crawl_depth) AS depth, bool_or(provided) AS given FROM b_candidate GROUP BY ALL) GROUP BY ALL", lambda c: companies.merge_candidates(c, url.normalize_url(F.col("url"))).select("workspace_id", "company_id", "normalized", "preferred", "provenance", "crawl_depth", "provided"))
over("e9_source_policy", "b_source b_company", f"SELECT source_id, score, CASE WHEN blocked OR score < 0.3 THEN 'rejected' ELSE 'fetched' END AS status, CASE WHEN blocked THEN 'BLOCKED_DOMAIN' WHEN score < 0.3 THEN 'LOW_MATCH_SCORE' ELSE 'ACCEPTED' END AS reason FROM (SELECT source_id, ends_with({_DOMAIN}, '.net') AS blocked, {_match('lower(url)')} AS score FROM b_source JOIN (SELECT company_id, company_name, tax_id FROM b_company) USING (company_id))", lambda s, c: companies.source_policy(s, c, url.normalize_domain(F.col("url")).endswith(".net")))
over("e12_crawl_gaps", "b_source b_attempt", "SELECT source_id, 'CRAWL_BUDGET_OR_QUEUE_LIMIT' AS code FROM b_source ANTI JOIN b_attempt USING (source_id) UNION ALL SELECT DISTINCT source_id, outcome_code FROM b_attempt SEMI JOIN b_source USING (source_id) WHERE outcome_code <> 'success'", companies.crawl_gaps)
over("e15_snapshot_actions", "b_snapshot", "SELECT source_id, snapshot_id, CASE WHEN before = h THEN 'reuse_latest' WHEN n > 1 THEN 'reuse_hash' ELSE 'new' END AS action FROM (SELECT *, lag(h) OVER (PARTITION BY source_id ORDER BY retrieved_at, snapshot_id) AS before, row_number() OVER (PARTITION BY source_id, h ORDER BY retrieved_at, snapshot_id) AS n FROM (SELECT *, sha256(content) AS h FROM b_snapshot))", lambda s: companies.snapshot_actions(s, F.sha2("content", 256)))
over("q4_tenant_leaks", "b_source b_company", "SELECT source_id, s.workspace_id, c.workspace_id AS parent_workspace FROM b_source s JOIN b_company c USING (company_id) WHERE s.workspace_id <> c.workspace_id", lambda s, c: companies.tenant_leaks(s, c, "company_id").select("source_id", "workspace_id", "parent_workspace"))

_VALUE = f"{_KEY}, origin_type, value_json"
over("f5_link_evidence", "b_fact b_evidence", f"SELECT DISTINCT candidate_id, source_id, block_key FROM (SELECT fact_id, min(fact_id) OVER (PARTITION BY {_VALUE}) AS candidate_id FROM b_fact WHERE {_ACTIVE}) JOIN b_evidence USING (fact_id)", work.link_evidence)
_CONFLICT = f"SELECT {_KEY}, CASE WHEN field_key IN {_in(facts.scoring.CRITICAL_FIELDS)} THEN 'critical' WHEN field_key IN {_in(facts.scoring.HIGH_FIELDS)} THEN 'high' ELSE 'medium' END AS materiality FROM ({_MEMBERS}) GROUP BY {_KEY} HAVING count(*) FILTER (differs) > 0"
over("h8_conflict_summary", "b_fact", f"SELECT workspace_id, company_id, count(*) AS n_fields, concat('CONFLICT_REVIEW_REQUIRED:', count(*)) AS warning FROM ({_CONFLICT}) GROUP BY workspace_id, company_id", work.conflict_summary)
MANDATORY = ("identity.legal_name", "identity.tax_id")
_BLOCKERS = f"SELECT workspace_id, company_id, field_key, 'OPEN_CONFLICT' AS code, materiality FROM ({_CONFLICT}) UNION ALL SELECT c.workspace_id, c.company_id, w.field_key, 'MISSING_FIELD', 'critical' FROM b_company c CROSS JOIN (SELECT unnest(['{"', '".join(MANDATORY)}']) AS field_key) w ANTI JOIN (SELECT * FROM b_fact WHERE {_ACTIVE}) f ON f.workspace_id = c.workspace_id AND f.company_id = c.company_id AND f.field_key = w.field_key"
over("k4_publication_blockers", "b_company b_fact", _BLOCKERS, lambda c, f: work.publication_blockers(c, f, MANDATORY))
over("k5_publishable", "b_company b_fact", f"SELECT workspace_id, company_id FROM b_company ANTI JOIN (SELECT * FROM ({_BLOCKERS}) WHERE materiality = 'critical') USING (workspace_id, company_id)", lambda c, f: work.publishable(c, work.publication_blockers(c, f, MANDATORY)))
_CHOSEN = f"SELECT workspace_id, company_id, field_key, context_key, fact_id, value_json, score, CASE WHEN fact_status IN ('accepted', 'validated') THEN 'verified' ELSE 'inferred' END AS display_status FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, company_id, field_key ORDER BY score DESC, fact_id) AS n FROM (SELECT *, {_SCORE} AS score FROM b_fact WHERE {_ACTIVE})) WHERE n = 1"
_READY = f"SELECT workspace_id, company_id FROM b_company ANTI JOIN (SELECT * FROM ({_BLOCKERS}) WHERE materiality = 'critical') USING (workspace_id, company_id)"


def _ready_values(c, f):
    return work.publishable_values(c, f, F.expr(AS_OF), MANDATORY)


over("k6_published_versions", "b_company b_fact b_evidence b_version", (
    f"WITH x AS ({_CHOSEN}), ready AS ({_READY}), v AS (SELECT workspace_id, company_id, count(*) AS n_fields, floor((sum(CAST(round(score * 100) AS BIGINT)) * 2 + count(*)) / (count(*) * 2)) / 100 AS confidence, sha256(string_agg(concat_ws('|', field_key, context_key, coalesce(value_json, ''), display_status), chr(10) ORDER BY field_key, context_key)) AS content_hash FROM x GROUP BY workspace_id, company_id),"
    " e AS (SELECT workspace_id, company_id, count(*) AS n_evidence, count(DISTINCT source_id) AS n_sources FROM x JOIN b_evidence USING (fact_id) GROUP BY workspace_id, company_id), l AS (SELECT workspace_id, company_id, max(version_number) AS last FROM b_version GROUP BY workspace_id, company_id)"
    " SELECT workspace_id, company_id, CAST(coalesce(last, 0) + 1 AS INT) AS version_number, n_fields, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_sources, 0) AS n_sources, confidence, content_hash FROM ready JOIN v USING (workspace_id, company_id) LEFT JOIN e USING (workspace_id, company_id) LEFT JOIN l USING (workspace_id, company_id)"
), lambda c, f, e, v: work.publish(_ready_values(c, f), e, v)[0])
over("k6_published_values", "b_company b_fact b_evidence b_version", f"SELECT workspace_id, company_id, field_key, context_key, fact_id, value_json, display_status, score FROM ({_CHOSEN}) JOIN ({_READY}) USING (workspace_id, company_id)", lambda c, f, e, v: _ready_values(c, f).drop("value_type"))
over("k9_current_profiles", "b_version", "SELECT workspace_id, company_id, arg_max(version_id, version_number) AS version_id, max(version_number) AS version_number FROM b_version WHERE NOT withdrawn GROUP BY ALL", work.current_profiles)
over("k2_superseded_drafts", "b_version", "SELECT version_id, CASE WHEN row_number() OVER (PARTITION BY workspace_id, company_id ORDER BY published_at DESC, version_id DESC) = 1 THEN 'ready' ELSE 'superseded' END AS status FROM b_version", work.superseded_drafts)
over("j2_inbox", "b_review b_decision", "SELECT workspace_id, company_id, task_id, task_type, priority, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, task_id DESC) AS INT) AS place, coalesce(decisions, '') AS decisions FROM b_review LEFT JOIN (SELECT task_id, string_agg(concat(seq, ' ', action), ';' ORDER BY seq) AS decisions FROM b_decision GROUP BY task_id) USING (task_id) WHERE status = 'open' AND task_type = 'field_conflict' AND assigned_to = 'U3'", lambda t, d: work.inbox(t, d, status="open", task_type="field_conflict", assigned_to="U3").withColumn("decisions", F.coalesce(F.array_join(F.transform("decisions", lambda x: F.concat_ws(" ", x["seq"].cast("string"), x["action"])), ";"), F.lit(""))))
over("l5_job_status", "b_task", f"SELECT job_id, status, CASE WHEN status = 'running' THEN todo[1] END AS next_step FROM (SELECT job_id, todo, CASE WHEN failed THEN 'failed' WHEN len(todo) > 0 THEN 'running' WHEN part THEN 'partial' ELSE 'completed' END AS status FROM (SELECT job_id, bool_or(status = 'failed') AS failed, bool_or(partial AND status = 'completed') AS part, list_filter(range({work.STEPS}), lambda x: NOT coalesce(list_contains(list(step_rank) FILTER (status = 'completed'), x), FALSE)) AS todo FROM b_task GROUP BY job_id))", work.job_status)
over("l6_latest_state", "b_task", "SELECT job_id, step_rank, partial FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY step_rank DESC, created_at DESC) AS n FROM b_task WHERE status = 'completed') WHERE n = 1", work.latest_state)
over("l7_counters", "b_attempt b_task b_ai_run", "SELECT 'requests' AS metric, concat('adapter=', adapter, ',outcome_code=', outcome_code, ',http_status=', http_status) AS labels, count(*) AS n FROM b_attempt GROUP BY ALL UNION ALL SELECT 'tasks', concat('step_rank=', step_rank, ',status=', status), count(*) FROM b_task GROUP BY ALL UNION ALL SELECT 'outcomes', concat('outcome_code=', outcome_code), count(*) FROM b_attempt GROUP BY ALL UNION ALL SELECT 'steps', concat('step_rank=', step_rank), count(*) FROM b_task GROUP BY ALL UNION ALL SELECT 'ai_runs', concat('validation_outcome=', validation_outcome), count(*) FROM b_ai_run GROUP BY ALL", lambda a, t, r: work.counters({"requests": (a, ["adapter", "outcome_code", "http_status"]), "outcomes": (a, ["outcome_code"]), "tasks": (t, ["step_rank", "status"]), "steps": (t, ["step_rank"]), "ai_runs": (r, ["validation_outcome"])}))
over("l7_mean_confidence", "b_version", "SELECT workspace_id, count(*) AS n, round(avg(overall_confidence), 4) AS mean_confidence FROM b_version GROUP BY workspace_id", work.mean_confidence)
over("l10_stale_tasks", "b_queue_task", "SELECT job_id, count(*) FILTER (expired) AS n_expired, count(*) FILTER (spent) AS n_exhausted, min(created_at) AS since FROM (SELECT *, status = 'running' AND lease_until < TIMESTAMP '2024-01-15 00:00:00' AS expired, status = 'failed' AND attempts >= max_attempts AS spent FROM b_queue_task) WHERE expired OR spent GROUP BY job_id", lambda t: work.stale_tasks(t, F.expr("TIMESTAMP '2024-01-15 00:00:00'")))
