"""All registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranking, scoring, url
from ..operators import facts, logs
from .bindings import bound, with_views

AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, with_views(sql)
        return f

    return add


def over(name: str, views: str, sql: str, f: Callable[..., DataFrame], **how: bool) -> None:
    """Registers a query over views, named in a string; dealt is for views that make long texts of a small table's rows, keyed for those that gather a large one's."""
    query(name, sql)(lambda s, d: f(*(bound(s, d, v, **how) for v in views.split())))


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _pages(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", "url")


_PART = r"regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', {})"
_HOST = f"lower({_PART.format(4)})"
_DOMAIN = rf"regexp_replace(regexp_replace(regexp_extract({_HOST}, '^(?:[^@]*@)?([^:]*)', 1), '\.$', ''), '^www\.', '')"
_JOINED = lambda c: f"regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', '', 'g')"
_WHERE = _JOINED(f"url_decode(concat({_PART.format(5)}, ' ', {_PART.format(7)}))")
_TOKEN = "CASE " + " ".join(f"WHEN contains({_WHERE}, '{ranking.joined_token(t)}') THEN '{t}'" for t in url.EXCLUDED_TOKENS) + " END"


def _has(c: str, parts) -> str:
    return " OR ".join(f"contains({c}, '{p}')" for p in parts)


def _class(kind: bool) -> str:
    rules = [
        (f"contains({_DOMAIN}, 'gov.vn') OR contains(lower(url), 'dangkykinhdoanh')", "registry", 1), (_has(_DOMAIN, url.REGISTRIES), "registry", 2), (_has(_DOMAIN, url.DIRECTORIES), "directory", 3),
        (f"contains({_DOMAIN}, 'wikipedia.org')", "web_page", 3), (_has(_DOMAIN, url.FINANCE_NEWS), "news", 3), (_has(_DOMAIN, url.NEWS), "news", 4),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN " + (f"'{k}'" if kind else str(t)) for c, k, t in rules) + (" ELSE 'web_page' END" if kind else " ELSE 3 END")


_SCHEME = f"CASE WHEN {_PART.format(2)} = '' THEN 'https' ELSE lower({_PART.format(2)}) END"
_NORMAL = (
    f"concat({_SCHEME}, ':', CASE WHEN {_HOST} <> '' THEN concat('//', CASE WHEN {_SCHEME} = 'http' THEN regexp_replace({_HOST}, ':80$', '') WHEN {_SCHEME} = 'https' THEN regexp_replace({_HOST}, ':443$', '') ELSE {_HOST} END) ELSE '' END,"
    f" regexp_replace({_PART.format(5)}, '/+$', ''), CASE WHEN {_PART.format(7)} <> '' THEN concat('?', {_PART.format(7)}) ELSE '' END)"
)


@query("b_url_functions", f"SELECT page_id, {_NORMAL} AS normalized, {_DOMAIN} AS domain, {_TOKEN} AS excluded, {_class(True)} AS source_type, {_class(False)} AS authority_tier, NOT (contains(url, '/admin') OR contains(url, '/private')) AS open_path FROM pages")
def url_functions(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    out = _pages(s, d).withColumn("domain", url.normalize_domain(u)).withColumn("class", url.source_class(F.col("domain"), u))
    return out.select("page_id", url.normalize_url(u).alias("normalized"), "domain", ranking.excluded_token(u).alias("excluded"), "class.source_type", "class.authority_tier", url.robots_path(u).alias("open_path"))


@query("flagship_best_pages", f"SELECT domain, page_id, place FROM (SELECT domain, page_id, CAST(row_number() OVER (PARTITION BY domain ORDER BY tier, length(normalized), page_id) AS INT) AS place FROM (SELECT page_id, {_DOMAIN} AS domain, {_class(False)} AS tier, {_NORMAL} AS normalized, {_TOKEN} AS excluded FROM pages) WHERE excluded IS NULL) WHERE place <= 3")
def flagship(s: SparkSession, d: str) -> DataFrame:
    """The best three pages of each site: without excluded words, by authority, then the shortest url."""
    u = F.col("url")
    out = _pages(s, d).select("page_id", url.normalize_domain(u).alias("domain"), u, url.normalize_url(u).alias("normalized")).where(ranking.excluded_token(u).isNull())
    w = Window.partitionBy("domain").orderBy(url.source_class(F.col("domain"), u).getField("authority_tier"), F.length("normalized"), "page_id")
    return out.withColumn("place", F.row_number().over(w)).where("place <= 3").select("domain", "page_id", "place")


_DAYS = f"greatest(0, CAST(floor((epoch({AS_OF}) - epoch(observed_at)) / 86400) AS BIGINT))"
_AUTH = f"CASE WHEN field_key IN {_in(scoring.REGISTRY_FIELDS)} AND authority_tier = 1 THEN 1.00 WHEN field_key IN {_in(scoring.SITE_FIELDS)} AND authority_tier IN (1, 2) THEN 0.95 " + " ".join(f"WHEN authority_tier = {k} THEN {v}" for k, v in scoring.TIERS.items()) + " ELSE 0.50 END"
_SUPPORT = "CASE support_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.SUPPORT.items()) + " ELSE 0.80 END"
_RELIABLE = "CASE WHEN origin_type IN ('reviewer', 'user', 'deterministic') THEN 1.00 WHEN origin_type = 'ai' THEN least(1.00, greatest(0.50, coalesce(hint, 0.80) * 0.95)) ELSE 0.80 END"
_FRESH = f"CASE WHEN observed_at IS NULL OR {_DAYS} <= 30 THEN 1.00 WHEN {_DAYS} <= 180 THEN 0.90 WHEN {_DAYS} <= 365 THEN 0.80 ELSE 0.65 END"
_SCORE = f"CAST(round(greatest(0.00, least(1.00, CAST({_AUTH} AS DECIMAL(8,4)) * 0.40 + CAST({_SUPPORT} AS DECIMAL(8,4)) * 0.30 + CAST({_RELIABLE} AS DECIMAL(8,4)) * 0.15 + CAST({_FRESH} AS DECIMAL(8,4)) * 0.15)), 2) AS DOUBLE)"
_LIMIT = lambda i: "CASE split_part(field_key, '.', 1) " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in scoring.STALENESS.items()) + f" ELSE {(180, 365)[i]} END"
_ACTIVE = f"fact_status IN {_in(facts.ACTIVE)}"
_KEY = ", ".join(facts.FACT_KEY)

over("f4_dedupe_facts", "b_fact", f"SELECT {_KEY}, origin_type, value_json, min(fact_id) AS fact_id FROM b_fact WHERE {_ACTIVE} GROUP BY ALL", facts.dedupe_facts)
_VALUE_KEY = f"{_KEY}, origin_type, value_json"
over("f4_new_facts", "b_fact", f"SELECT {_VALUE_KEY}, min(fact_id) AS fact_id FROM (SELECT * FROM b_fact WHERE fact_id % 2 = 0 AND {_ACTIVE}) ANTI JOIN (SELECT {_VALUE_KEY} FROM b_fact WHERE fact_id % 2 = 1 AND {_ACTIVE}) USING ({_VALUE_KEY}) GROUP BY {_VALUE_KEY}", lambda f: facts.dedupe_facts(f.where("fact_id % 2 = 0"), f.where("fact_id % 2 = 1")))
_OWN_EVIDENCE = "SELECT fact_id, string_agg(concat(source_id, ' ', block_key), ';' ORDER BY source_id, block_key) AS evidence FROM b_evidence GROUP BY fact_id"
over("f6_list_facts", "b_fact b_evidence", f"SELECT workspace_id, company_id, fact_id, field_key, CAST(row_number() OVER (PARTITION BY workspace_id, company_id ORDER BY fact_id DESC) AS INT) AS place, coalesce(evidence, '') AS evidence FROM b_fact LEFT JOIN ({_OWN_EVIDENCE}) USING (fact_id) WHERE fact_status = 'accepted' AND field_key = 'identity.tax_id'", lambda f, e: facts.list_facts(f, e, field_key="identity.tax_id", status="accepted").withColumn("evidence", F.coalesce(F.array_join(F.transform("evidence", lambda x: F.concat_ws(" ", x["source_id"].cast("string"), x["block_key"])), ";"), F.lit(""))))
over("f7_f8_score_facts", "b_fact", f"SELECT fact_id, score, CASE WHEN score >= 0.8 THEN 'High' WHEN score >= 0.6 THEN 'Medium' ELSE 'Low' END AS rating FROM (SELECT fact_id, {_SCORE} AS score FROM b_fact)", lambda f: facts.score_facts(f, F.expr(AS_OF)))
_SCANNED = f"fact_status IN {_in(facts.SCANNED)}"
_CORROBORATED = f"SELECT {_KEY}, value_json, count(DISTINCT nullif({_DOMAIN}, '')) AS n_domains FROM (SELECT * FROM b_fact WHERE {_SCANNED}) LEFT JOIN b_evidence USING (fact_id) LEFT JOIN (SELECT source_id, url FROM b_source) USING (source_id) GROUP BY {_KEY}, value_json"
_CORROBORATED = f"SELECT {_KEY}, value_json, n_domains, min(value_json) OVER w < max(value_json) OVER w AS competing FROM ({_CORROBORATED}) WINDOW w AS (PARTITION BY {_KEY})"
_FULL_SCORE = _SCORE.replace(" * 0.15)), 2)", " * 0.15 + CASE WHEN n_domains >= 2 THEN 0.10 ELSE 0.00 END - CASE WHEN competing THEN 0.25 ELSE 0.00 END)), 2)")
_WORDS_OF_SCORE = (
    "concat(CASE WHEN score >= 0.8 THEN 'High' WHEN score >= 0.6 THEN 'Medium' ELSE 'Low' END, ' confidence (', printf('%.2f', score), '): supported by ', CASE authority_tier "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in scoring.TIER_NAMES.items())
    + f" ELSE concat('Tier ', authority_tier) END, ' (', support_type, ' evidence)', CASE WHEN origin_type IN ('reviewer', 'user') THEN '; {scoring.BY_HAND}' ELSE '' END,"
    f" CASE WHEN n_domains >= 2 THEN printf('; {scoring.CORROBORATION}', n_domains) ELSE '' END, CASE WHEN competing THEN '; {scoring.WARNING}' ELSE '' END, '.')"
)


def _with_domains(sources: DataFrame) -> DataFrame:
    return sources.select("source_id", url.normalize_domain(F.col("url")).alias("domain"))


over("f9_corroborate", "b_fact b_evidence b_source", _CORROBORATED, lambda f, e, s: facts.corroborate(f, e, _with_domains(s)), keyed=True)
over("f7_f8_f9_corroborated_scores", "b_fact b_evidence b_source", f"SELECT fact_id, score, {_WORDS_OF_SCORE} AS explanation FROM (SELECT *, {_FULL_SCORE} AS score FROM (SELECT * FROM b_fact WHERE {_SCANNED}) JOIN ({_CORROBORATED}) USING ({_KEY}, value_json))", lambda f, e, s: facts.corroborated_scores(f, e, _with_domains(s), F.expr(AS_OF)), keyed=True)
over("f10_freshness", "b_fact", f"SELECT fact_id, CASE WHEN observed_at IS NULL OR {_DAYS} > {_LIMIT(1)} THEN 'stale' WHEN {_DAYS} > {_LIMIT(0)} THEN 'warning' ELSE 'fresh' END AS freshness FROM b_fact", lambda f: facts.freshness(f, F.expr(AS_OF)))

EXPECTED = ("identity.legal_name", "identity.tax_id", "overview.hq_address", "overview.description")
over("f11_missing_fields", "b_company b_fact", f"SELECT c.workspace_id, c.company_id, w.field_key FROM b_company c CROSS JOIN (SELECT unnest(['{"', '".join(EXPECTED)}']) AS field_key) w ANTI JOIN b_fact f ON f.workspace_id = c.workspace_id AND f.company_id = c.company_id AND f.field_key = w.field_key", lambda c, f: facts.missing_fields(c, f, EXPECTED))
_HAS = "CASE field_key WHEN 'identity.legal_name' THEN coalesce(legal_name, '') WHEN 'identity.tax_id' THEN coalesce(tax_id, '') WHEN 'identity.registration_number' THEN coalesce(registration_number, '') ELSE '' END"
_WANTED = (*EXPECTED, "identity.registration_number")
over("f11_gaps_beside_profiles", "b_company b_fact", f"SELECT workspace_id, company_id, field_key FROM (SELECT * FROM b_company CROSS JOIN (SELECT unnest(['{"', '".join(_WANTED)}']) AS field_key)) ANTI JOIN (SELECT workspace_id, company_id, field_key FROM b_fact WHERE {_SCANNED}) USING (workspace_id, company_id, field_key) WHERE {_HAS} = ''", lambda c, f: facts.missing_fields(c, f.where(F.col("fact_status").isin(*facts.SCANNED)), _WANTED, profile_columns=True))

_TEXT = lambda c: f"lower(trim({c} ->> '$', ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
_WORDS = lambda c: f"list_filter(regexp_split_to_array({_TEXT(c)}, '\\s+'), lambda w: w <> '')"
_NUMBER = lambda k, c: f"CASE WHEN {k} = 'boolean' THEN CASE WHEN {c} = 'true' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE TRY_CAST({c} AS DOUBLE) END"
_SORTED = lambda c: f"CASE WHEN json_type({c}) = 'OBJECT' THEN array_to_string(list_transform(list_sort(json_keys({c})), lambda k: concat(k, ':', json_extract({c}, '$.' || k))), ',') ELSE CAST(json({c}) AS VARCHAR) END"
_WHOLE = lambda k, c: f"CASE WHEN {k} = 'string' THEN {c} ->> '$' ELSE {_SORTED(c)} END"
_NUMERIC = "('integer', 'number', 'boolean')"


def _differs(k: str, a: str, m: str, b: str) -> str:
    x, y = _NUMBER(k, a), _NUMBER(m, b)
    subset = f"len({_WORDS(a)}) > 0 AND len({_WORDS(b)}) > 0 AND (list_has_all({_WORDS(b)}, {_WORDS(a)}) OR list_has_all({_WORDS(a)}, {_WORDS(b)}))"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN FALSE WHEN {k} = 'string' AND {m} = 'string' THEN {_TEXT(a)} <> {_TEXT(b)} AND NOT (field_key = 'identity.legal_name' AND {subset})"
        f" WHEN {k} IN {_NUMERIC} AND {m} IN {_NUMERIC} THEN abs(({x}) - ({y})) * 20 > greatest(abs({x}), abs({y})) ELSE {_WHOLE(k, a)} <> {_WHOLE(m, b)} END"
    )


over("h1_materially_different", "b_value_pair", f"SELECT pair_id, {_differs('a_type', 'a_json', 'b_type', 'b_json')} AS differs FROM b_value_pair", lambda p: p.select("pair_id", facts.materially_different(F.col("field_key"), F.col("a_type"), F.col("a_json"), F.col("b_type"), F.col("b_json")).alias("differs")))
_DIFFERS = _differs("first_type", "first_value", "value_type", "value_json")
_MEMBERS = f"SELECT *, {_DIFFERS} AS differs FROM (SELECT *, first_value(value_json) OVER w AS first_value, first_value(value_type) OVER w AS first_type, CASE WHEN row_number() OVER w = 1 THEN 'primary' ELSE 'competing' END AS role FROM b_fact WHERE {_SCANNED} WINDOW w AS (PARTITION BY {_KEY} ORDER BY fact_id))"
_ATTACHED = f"SELECT * FROM (SELECT *, bool_or(differs) OVER (PARTITION BY {_KEY}) AS any_differs FROM ({_MEMBERS})) WHERE any_differs AND (differs OR role = 'primary')"
over("h1_h4_conflict_members", "b_fact", f"SELECT fact_id, role, differs FROM ({_ATTACHED})", lambda f: facts.attached(f).select("fact_id", "role", "differs"))
over("h5_reopen_conflicts", "b_conflict b_conflict_member b_fact", f"SELECT conflict_id, 'reopened' AS status, min(fact_id) AS first_new, count(*) AS n_new FROM ({_ATTACHED}) JOIN (SELECT {_KEY}, conflict_id FROM b_conflict WHERE status IN {_in(facts.CLOSED)}) USING ({_KEY}) ANTI JOIN b_conflict_member m USING (conflict_id, fact_id) GROUP BY conflict_id", facts.reopen_conflicts)
_MEMBER_TEXT = "SELECT conflict_id, string_agg(concat(fact_id, ' ', role, ' ', coalesce(value_json, '')), ';' ORDER BY fact_id) AS members FROM (SELECT conflict_id, m.fact_id, CASE WHEN m.fact_id = min(m.fact_id) OVER (PARTITION BY conflict_id) THEN 'primary' ELSE 'competing' END AS role, value_json FROM b_conflict_member m JOIN b_fact f ON f.fact_id = m.fact_id) GROUP BY conflict_id"
over("h7_list_conflicts", "b_conflict b_conflict_member b_fact", f"SELECT workspace_id, company_id, conflict_id, status, CAST(row_number() OVER (PARTITION BY workspace_id, company_id ORDER BY conflict_id DESC) AS INT) AS place, coalesce(members, '') AS members FROM b_conflict LEFT JOIN ({_MEMBER_TEXT}) USING (conflict_id) WHERE status = 'resolved'", lambda c, m, f: facts.list_conflicts(c, m, f, "resolved").withColumn("members", F.coalesce(F.array_join(F.transform("members", lambda x: F.concat_ws(" ", x["fact_id"].cast("string"), x["role"], F.coalesce(x["value_json"], F.lit("")))), ";"), F.lit(""))))
over("h2_h3_detect_conflicts", "b_fact", f"SELECT {_KEY}, count(*) AS n_facts, count(*) FILTER (differs) AS n_differing, CASE WHEN field_key IN {_in(scoring.CRITICAL_FIELDS)} THEN 'critical' WHEN field_key IN {_in(scoring.HIGH_FIELDS)} THEN 'high' ELSE 'medium' END AS materiality FROM ({_MEMBERS}) GROUP BY {_KEY} HAVING count(*) FILTER (differs) > 0", facts.detect_conflicts)
over("k1_assemble_drafts", "b_fact", f"SELECT workspace_id, company_id, field_key, fact_id, score, CAST(row_number() OVER (PARTITION BY workspace_id, company_id ORDER BY score DESC, fact_id) AS INT) AS display_order FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, company_id, field_key ORDER BY score DESC, fact_id) AS n FROM (SELECT *, {_SCORE} AS score FROM b_fact WHERE {_ACTIVE})) WHERE n = 1", lambda f: facts.assemble_drafts(f, F.expr(AS_OF)))
over("k8_version_history", "b_version", "SELECT version_id, version_number, CASE WHEN withdrawn THEN 'withdrawn' WHEN superseded_at IS NULL THEN 'published' ELSE 'superseded' END AS status, superseded_at FROM (SELECT *, lead(published_at) OVER (PARTITION BY workspace_id, company_id ORDER BY version_number) AS superseded_at FROM b_version)", facts.version_history)

_PAIRS = "SELECT a.version_id AS old_id, b.version_id AS new_id FROM b_version a JOIN b_version b ON a.workspace_id = b.workspace_id AND a.company_id = b.company_id AND b.version_number = a.version_number + 1"
_SIDE = lambda k: f"SELECT old_id, new_id, field_key, context_key, display_value AS {k}_value, value_json AS {k}_json, display_status AS {k}_status, evidence_count AS {k}_n, TRUE AS has_{k} FROM pairs JOIN b_field_value ON version_id = {k}_id"
_DIFF = (
    "SELECT old_id, new_id, field_key, context_key, old_value, new_value, old_status, new_status, coalesce(old_n, 0) AS old_evidence, coalesce(new_n, 0) AS new_evidence, CASE WHEN has_old IS NULL THEN 'added' WHEN has_new IS NULL THEN 'removed'"
    " WHEN old_value IS DISTINCT FROM new_value OR old_json IS DISTINCT FROM new_json OR old_status IS DISTINCT FROM new_status THEN 'modified' ELSE 'unchanged' END AS change"
    f" FROM ({_SIDE('old')}) FULL JOIN ({_SIDE('new')}) USING (old_id, new_id, field_key, context_key)"
)


def _version_pairs(versions: DataFrame) -> DataFrame:
    w = Window.partitionBy("workspace_id", "company_id").orderBy("version_number")
    return versions.select(F.col("version_id").alias("old_id"), F.lead("version_id").over(w).alias("new_id")).where("new_id IS NOT NULL")


_KINDS = ("added", "removed", "modified", "unchanged")
over("k10_diff_versions", "b_version b_field_value", f"WITH pairs AS ({_PAIRS}) SELECT * FROM ({_DIFF}) WHERE change <> 'unchanged'", lambda v, x: facts.diff_versions(_version_pairs(v), x).where("change <> 'unchanged'"))
over("k11_diff_summary", "b_version b_field_value", f"WITH pairs AS ({_PAIRS}), n AS (SELECT old_id, new_id, " + ", ".join(f"count(*) FILTER (change = '{k}') AS n_{k}" for k in _KINDS) + f" FROM ({_DIFF}) GROUP BY old_id, new_id) SELECT old_id, new_id, " + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _KINDS) + ", round(b.overall_confidence - a.overall_confidence, 2) AS confidence_delta FROM pairs LEFT JOIN n USING (old_id, new_id) JOIN b_version a ON a.version_id = old_id JOIN b_version b ON b.version_id = new_id", lambda v, x: facts.diff_summary(facts.diff_versions(_version_pairs(v), x), _version_pairs(v), v))
over("l1_ai_usage", "b_ai_run", "SELECT workspace_id, count(*) AS n_runs, CAST(round(sum(cost_usd), 4) AS DOUBLE) AS cost_usd FROM b_ai_run GROUP BY workspace_id", logs.ai_usage)
over("i7_within_budget", "b_ai_run", "SELECT job_id, run_id, cost_usd FROM (SELECT *, max(refused) OVER (PARTITION BY job_id ORDER BY created_at, run_id) AS stopped FROM (SELECT *, CASE WHEN coalesce(sum(cost_usd) OVER (PARTITION BY job_id ORDER BY created_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.10 > 50.00 THEN 1 ELSE 0 END AS refused FROM b_ai_run)) WHERE stopped = 0", lambda r: logs.within_budget(r, "50.00"))
over("i10_ai_status", "b_ai_run", "SELECT job_id, CASE WHEN f = 0 THEN 'completed' WHEN f = n THEN 'unavailable' ELSE 'partial' END AS status, first_failed FROM (SELECT job_id, count(*) AS n, count(*) FILTER (validation_outcome = 'failed') AS f, min(CASE WHEN validation_outcome = 'failed' THEN run_id END) AS first_failed FROM b_ai_run GROUP BY job_id)", logs.ai_status)
over("e16_fetch_stats", "b_attempt", "SELECT coalesce(adapter, 'all') AS adapter, coalesce(outcome_code, 'all') AS outcome_code, count(*) AS n, count(*) FILTER (http_status >= 500) AS n_server_errors FROM b_attempt GROUP BY ROLLUP (adapter, outcome_code)", logs.fetch_stats)
over("e14_source_status", "b_source b_attempt b_snapshot", "SELECT source_id, attempt_id, outcome_code, http_status, snapshot_id, coalesce(n_snapshots, 0) AS n_snapshots FROM b_source LEFT JOIN (SELECT * FROM b_attempt QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, attempt_id DESC) = 1) a USING (source_id) LEFT JOIN (SELECT source_id, arg_max(snapshot_id, (retrieved_at, snapshot_id)) AS snapshot_id, count(*) AS n_snapshots FROM b_snapshot GROUP BY source_id) USING (source_id)", logs.source_status)
over("l3_audit_trail", "b_audit", "SELECT workspace_id, audit_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, audit_id DESC) AS INT) AS place FROM b_audit WHERE action = 'click' AND actor_id = 7) WHERE place > 10 AND place <= 60", lambda a: logs.audit_trail(a, action="click", actor_id=7, offset=10).select("workspace_id", "audit_id", "place"))
over("l8_snapshots_of_sources", "b_snapshot", "SELECT source_id, snapshot_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY retrieved_at DESC, snapshot_id) AS INT) AS place FROM b_snapshot", lambda s: logs.children(s, "source_id", [F.desc("retrieved_at"), "snapshot_id"]).select("source_id", "snapshot_id", "place"))
over("l8_attempts_of_sources", "b_attempt", "SELECT source_id, attempt_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, attempt_id DESC) AS INT) AS place FROM b_attempt", lambda a: logs.children(a, "source_id", [F.desc("started_at"), F.desc("attempt_id")]).select("source_id", "attempt_id", "place"))
over("a8_c5_unique_snapshots", "b_snapshot", "SELECT workspace_id, source_id, sha256(content) AS content_hash, min(snapshot_id) AS snapshot_id FROM b_snapshot GROUP BY ALL", lambda s: logs.unique_snapshots(s, F.sha2("content", 256)))
over("q1_vocab_violations", "b_fact", "SELECT support_type AS value, count(*) AS n FROM b_fact WHERE support_type NOT IN ('structured', 'direct') GROUP BY support_type", lambda f: logs.vocab_violations(f, "support_type", ("structured", "direct")))
over("q2_key_violations", "b_fact", f"SELECT {_KEY}, count(*) AS n FROM b_fact GROUP BY {_KEY} HAVING count(*) > 1", lambda f: logs.key_violations(f, facts.FACT_KEY))
over("q3_orphans", "b_evidence b_fact", "SELECT fact_id, source_id, block_key FROM b_evidence e ANTI JOIN (SELECT fact_id FROM b_fact WHERE fact_status <> 'rejected') f USING (fact_id)", lambda e, f: logs.orphans(e, f.where("fact_status <> 'rejected'"), "fact_id"))
