"""Queries over typed values and changes to stored tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import changes, logs
from .profiles import _name
from .registry import _KEY, over

_LINE = "trim(regexp_replace(line, '\\s+', ' ', 'g'))"
_FIELD = "CASE " + " ".join(f"WHEN regexp_matches({_LINE}, '(?i){p}') THEN '{k}'" for k, p in values.LABELS) + " END"
_VALUE = "CASE " + " ".join(f"WHEN regexp_matches({_LINE}, '(?i){p}') THEN trim(regexp_extract({_LINE}, '(?i){p}', 1))" for _, p in values.LABELS) + " END"
over("f1_label_facts", "b_label_block", f"SELECT * FROM (SELECT workspace_id, company_id, block_key, {_FIELD} AS field_key, {_VALUE} AS value FROM (SELECT workspace_id, company_id, block_key, unnest(string_split(text_content, chr(10))) AS line FROM b_label_block)) WHERE value <> ''", changes.label_facts)

_FOLDED = "trim(regexp_replace(lower(strip_accents(company_name)), '[^a-z0-9]+', ' ', 'g'))"
over("c3_matches_token", "b_company", f"SELECT workspace_id, company_id, contains({_FOLDED}, 'viet nam') OR contains(replace({_FOLDED}, ' ', ''), 'vietnam') AS matches FROM b_company", lambda c: c.select("workspace_id", "company_id", values.matches_token(F.col("company_name"), "Việt-Nam").alias("matches")))

_TYPE = "CASE json_type({0}) WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'string' END"
over("c8_value_types", "b_fact b_audit", f"SELECT 'fact' AS origin, {_TYPE.format('value_json')} AS value_type, count(*) AS n FROM b_fact GROUP BY ALL UNION ALL SELECT 'audit', {_TYPE.format('metadata_json')}, count(*) FROM b_audit GROUP BY ALL", lambda f, a: f.select(F.lit("fact").alias("origin"), values.value_type(F.col("value_json")).alias("value_type")).unionByName(a.select(F.lit("audit").alias("origin"), values.value_type(F.col("metadata_json")).alias("value_type"))).groupBy("origin", "value_type").agg(F.count("*").alias("n")))

_PARTS = ", ".join(f"nullif(trim(text_content ->> '$.address.{p}'), '')" for p in values.ADDRESS)
over("c10_address_text", "b_json_block", f"SELECT workspace_id, company_id, nullif(concat_ws(', ', {_PARTS}), '') AS address FROM b_json_block", lambda b: b.select("workspace_id", "company_id", values.address_text(F.col("text_content")).alias("address")))

over("c17_ai_cost", "b_ai_run", "SELECT run_id, CAST(CAST(run_id % 5000 AS DECIMAL(18,0)) * 0.10 + CAST(job_id % 900 AS DECIMAL(18,0)) * 0.40 AS DOUBLE) / 1000000.0 AS usd FROM b_ai_run", lambda r: r.select("run_id", values.ai_cost(F.expr("run_id % 5000"), F.expr("job_id % 900")).alias("usd")))



def _by_field():
    return F.when(F.expr("source_id % 3 = 0"), F.create_map(F.lit("*"), F.expr("CAST(source_id % 7 AS INT)"))).when(F.expr("source_id % 3 = 1"), F.create_map(F.lit("identity.tax_id"), F.lit(1)))


over("e13_authority_for_field", "b_source", "SELECT source_id, CASE WHEN source_id % 3 = 0 AND source_id % 7 BETWEEN 1 AND 4 THEN CAST(source_id % 7 AS INT) WHEN source_id % 3 = 1 THEN 1 ELSE crawl_depth + 2 END AS tier FROM b_source", lambda s: s.select("source_id", values.authority_for_field(_by_field(), F.lit("identity.tax_id"), F.col("crawl_depth") + 2).alias("tier")))

_FIRST = lambda key, table, c: f"SELECT workspace_id, {key} AS k, min(company_id) AS {c} FROM {table} WHERE {key} <> '' GROUP BY ALL"
over("g4_creation_duplicates", "b_new_company b_company b_alias", (
    "SELECT new_id, coalesce(tax, reg, name, alias) AS company_id, CASE WHEN tax IS NOT NULL THEN 'EXACT_TAX_ID_MATCH' WHEN reg IS NOT NULL THEN 'EXACT_REGISTRATION_NUMBER_MATCH' ELSE 'EXACT_NORMALIZED_NAME_OR_ALIAS_MATCH' END AS reason FROM b_new_company n"
    f" LEFT JOIN ({_FIRST('tax_id', 'b_company', 'tax')}) t ON t.workspace_id = n.workspace_id AND t.k = n.tax_id LEFT JOIN ({_FIRST('registration_number', 'b_company', 'reg')}) r ON r.workspace_id = n.workspace_id AND r.k = n.registration_number"
    f" LEFT JOIN ({_FIRST(_name('company_name'), 'b_company', 'name')}) c ON c.workspace_id = n.workspace_id AND c.k = {_name('n.company_name')} LEFT JOIN ({_FIRST(_name('alias_name'), 'b_alias', 'alias')}) a ON a.workspace_id = n.workspace_id AND a.k = {_name('n.company_name')}"
    " WHERE coalesce(tax, reg, name, alias) IS NOT NULL"
), changes.creation_duplicates)

over("g6_merge_companies", "b_company b_merge_pair", (
    "SELECT c.workspace_id, c.company_id, CASE WHEN p.target_id IS NOT NULL THEN 'merged' ELSE c.status END AS status, p.target_id AS merged_into,"
    " coalesce(i.n, 0) + CASE WHEN p.target_id IS NOT NULL THEN 1 ELSE 0 END AS version_steps FROM b_company c LEFT JOIN b_merge_pair p ON p.workspace_id = c.workspace_id AND p.source_id = c.company_id"
    " LEFT JOIN (SELECT workspace_id, target_id, count(*) AS n FROM b_merge_pair GROUP BY ALL) i ON i.workspace_id = c.workspace_id AND i.target_id = c.company_id"
), changes.merge_companies)

_CLAIMS = (
    f"SELECT c.workspace_id, {_name('c.company_name')} AS normalized_alias, p.target_id AS company_id, 'former_name' AS alias_type, 0 AS late FROM b_company c JOIN b_merge_pair p ON p.workspace_id = c.workspace_id AND p.source_id = c.company_id"
    f" UNION ALL SELECT a.workspace_id, {_name('a.alias_name')}, coalesce(p.target_id, a.company_id), a.alias_type, 1 FROM b_alias a LEFT JOIN b_merge_pair p ON p.workspace_id = a.workspace_id AND p.source_id = a.company_id"
)
over("g6_merged_aliases", "b_company b_alias b_merge_pair", f"SELECT workspace_id, normalized_alias, company_id, alias_type FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, normalized_alias ORDER BY late, company_id, alias_type) AS n FROM ({_CLAIMS})) WHERE n = 1", changes.merged_aliases)

over("g8_relationships", "b_edge", "SELECT DISTINCT workspace_id, source_id, target_id, relationship_type FROM b_edge WHERE source_id <> target_id", changes.relationships)

_DECISIONS = f"SELECT {_KEY}, CASE WHEN max(fact_id) % 2 = 0 THEN 'select_one' ELSE 'accepted_multiple' END AS resolution, min(fact_id) AS low, max(fact_id) AS high FROM b_fact GROUP BY {_KEY} HAVING count(*) > 1"


def _resolved(f):
    decisions = f.groupBy(*changes.FACT_KEY).agg(F.expr("CASE WHEN max(fact_id) % 2 = 0 THEN 'select_one' ELSE 'accepted_multiple' END").alias("resolution"), F.expr("CASE WHEN max(fact_id) % 2 = 0 THEN array(max(fact_id)) ELSE array(min(fact_id), max(fact_id)) END").alias("selected"), F.count("*").alias("n"))
    return changes.resolve_conflicts(f, decisions.where("n > 1").drop("n"))


_SELECTED = "(fact_id = high OR (fact_id = low AND resolution = 'accepted_multiple'))"
over("h6_resolve_conflicts", "b_fact", f"SELECT fact_id, {_SELECTED} AS is_selected, CASE WHEN {_SELECTED} THEN 'accepted' WHEN resolution = 'select_one' THEN 'superseded' ELSE fact_status END AS fact_status FROM b_fact JOIN ({_DECISIONS}) USING ({_KEY})", _resolved)

over("j4_decision_log", "b_audit", "SELECT audit_id, lag(action) OVER (PARTITION BY actor_id ORDER BY created_at, audit_id) AS previous_state, action AS new_state FROM b_audit", lambda a: changes.decision_log(a, "actor_id", "created_at", "audit_id", "action"))
over("l2_recent_jobs", "b_review", "SELECT workspace_id, task_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, task_id DESC) AS INT) AS place FROM b_review) WHERE place <= 50", lambda r: logs.recent(r, "workspace_id", "created_at", "task_id").select("workspace_id", "task_id", "place"))
over("e10_upsert_sources", "b_old_source b_new_source", (
    "SELECT workspace_id, company_id, normalized, CASE WHEN was IS NULL OR (chosen AND was = 'rejected') THEN 'discovered' ELSE was END AS status"
    " FROM (SELECT workspace_id, company_id, normalized, min(status) AS was FROM b_old_source GROUP BY ALL) FULL JOIN (SELECT DISTINCT *, TRUE AS chosen FROM b_new_source) USING (workspace_id, company_id, normalized)"
), changes.upsert_sources)
over("k3_apply_overrides", "b_selection b_override", (
    "SELECT draft_id, field_key, CASE WHEN value IS NOT NULL THEN value ELSE display_value END AS display_value, value IS NOT NULL AS overridden,"
    " CAST(row_number() OVER (PARTITION BY draft_id ORDER BY display_order NULLS LAST, field_key) AS INT) AS display_order FROM b_selection FULL JOIN b_override USING (draft_id, field_key)"
), changes.apply_overrides)
over("l9_domain_policies", "b_old_policy b_new_policy b_deleted_policy", "SELECT * FROM (SELECT * FROM b_old_policy ANTI JOIN b_new_policy USING (workspace_id, domain) UNION ALL SELECT * FROM b_new_policy) ANTI JOIN b_deleted_policy USING (workspace_id, domain)", changes.domain_policies)
over("k15_policy_versions", "b_policy b_activated", (
    "SELECT p.workspace_id, policy_id, CAST(row_number() OVER (PARTITION BY p.workspace_id ORDER BY created_at, policy_id) AS INT) AS version_number, coalesce(policy_id = chosen, FALSE) AS is_active"
    " FROM b_policy p LEFT JOIN (SELECT workspace_id, arg_max(policy_id, (activated_at, policy_id)) AS chosen FROM b_activated GROUP BY workspace_id) a ON a.workspace_id = p.workspace_id"
), changes.policy_versions)
