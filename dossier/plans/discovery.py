"""Queries over payloads, candidates, robots rules and the frontier, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url
from ..operators import companies, discovery

from .blocks import _RANKED, _RESOLVED, _TOKEN_OF
from .profiles import _PRIORITY, _clean, _match
from .bindings import bound
from .registry import _DOMAIN, _JOINED, _NORMAL, _PART, ORACLE_SQL, _class, _in, over, query


def _of(expression: str, column: str) -> str:
    """An expression over the column url, over another one."""
    return expression.replace("(url", f"({column}")


_WEB = lambda c: f"lower({_of(_PART.format(2), c)}) IN ('http', 'https')"
_ITEMS = "SELECT query_id, company_id, i AS rank, json_extract(payload, '$.items[' || (i - 1) || ']') AS item FROM (SELECT *, unnest(range(1, CAST(json_array_length(payload, '$.items') AS BIGINT) + 1)) AS i FROM b_search_payload)"
_FOUND = f"SELECT query_id, company_id, CAST(rank AS INT) AS rank, url, title, snippet, {_DOMAIN} AS domain FROM (SELECT query_id, company_id, rank, trim(coalesce(item ->> 'link', '')) AS url, {_clean("coalesce(item ->> 'title', '')")} AS title, {_clean("coalesce(item ->> 'snippet', '')")} AS snippet FROM ({_ITEMS})) WHERE {_WEB('url')} AND {_DOMAIN} <> '' AND title <> ''"
over("a3_search_items", "b_search_payload", f"SELECT query_id, rank, url, title, snippet, domain FROM ({_FOUND})", discovery.search_items)

_WITHIN = lambda c, domain: f"({_WEB(c)} AND (h = {domain} OR ends_with(h, concat('.', {domain}))))"
_HOST = lambda c: rf"regexp_replace(regexp_extract(lower({_of(_PART.format(4), c)}), '^(?:[^@]*@)?([^:]*)', 1), '\.+$', '')"
_KNOWN = "(VALUES " + ", ".join(f"('{k}', '{domain}', '{source}', {tier}, {by['*']})" for k, domain, _, source, tier, by in discovery.PROVIDERS) + ") p(provider, domain, source_type, authority_tier, any_tier)"
_LOOKUPS = f"""SELECT lookup_id, provider, domain, source_type, authority_tier, any_tier, is_list, is_object, CASE WHEN is_list THEN 'success' WHEN is_object THEN lower(trim(coalesce(payload ->> '$.outcome', 'success'))) ELSE 'unavailable' END AS said, coalesce(payload ->> '$.reason', '') AS why,
 CASE WHEN is_list THEN CAST(payload AS JSON) ELSE json_extract(payload, '$.candidates') END AS list FROM (SELECT *, starts_with(trim(payload), '[') AS is_list, starts_with(trim(payload), '{{') AS is_object FROM b_provider_payload JOIN {_KNOWN} USING (provider))"""
_JUDGED = f"SELECT *, CASE WHEN said IN {_in(discovery.OUTCOMES)} THEN said ELSE 'unavailable' END AS outcome, CASE WHEN NOT is_list AND NOT is_object THEN 'INVALID_STRUCTURED_PROVIDER_RESULT' WHEN said NOT IN {_in(discovery.OUTCOMES)} THEN 'INVALID_PROVIDER_OUTCOME' ELSE why END AS reason FROM ({_LOOKUPS})"
_OFFERED = f"SELECT *, {_HOST('url')} AS h FROM (SELECT lookup_id, provider, domain, source_type, authority_tier, any_tier, i, trim(coalesce(x ->> 'url', '')) AS url, coalesce(x ->> 'title', '') AS title, coalesce(x ->> 'snippet', '') AS snippet, CAST(x ->> 'entity_match_score' AS DOUBLE) AS entity_match_score FROM (SELECT *, list -> (i - 1) AS x FROM (SELECT *, unnest(range(1, CAST(coalesce(json_array_length(list), 0) AS BIGINT) + 1)) AS i FROM ({_JUDGED}) WHERE outcome = 'success')))"
_ALLOWED = f"SELECT * FROM ({_OFFERED}) WHERE {_WITHIN('url', 'domain')}"
over("a4_provider_items", "b_provider_payload", f"SELECT lookup_id, provider, CAST(row_number() OVER (PARTITION BY lookup_id ORDER BY i) AS INT) AS rank, url, title, snippet, entity_match_score, source_type, authority_tier, any_tier FROM ({_ALLOWED})", lambda p: discovery.provider_items(p, discovery.registry(p.sparkSession))[0].withColumn("any_tier", F.col("authority_by_field")["*"]).drop("authority_by_field"))
over("a4_provider_outcomes", "b_provider_payload", f"SELECT lookup_id, provider, CASE WHEN outcome = 'success' AND n IS NULL THEN 'not_found' ELSE outcome END AS outcome, CASE WHEN outcome = 'success' AND n IS NULL AND reason = '' THEN 'NO_ALLOWED_MATCHING_SOURCE' ELSE reason END AS reason FROM ({_JUDGED}) LEFT JOIN (SELECT lookup_id, count(*) AS n FROM ({_ALLOWED}) GROUP BY lookup_id) USING (lookup_id)", lambda p: discovery.provider_items(p, discovery.registry(p.sparkSession))[1])
_MATCHED = lambda t: _match(f"lower({t})")
_WIKI = "SELECT company_id, company_name, tax_id, CAST(i AS INT) AS rank, json_extract(payload, '$.query.pages[' || (i - 1) || ']') AS p FROM (SELECT *, unnest(range(1, CAST(json_array_length(payload, '$.query.pages') AS BIGINT) + 1)) AS i FROM b_wiki_response)"
over("a5_wiki_items", "b_wiki_response", f"SELECT company_id, rank, url, title, snippet, {_MATCHED("concat_ws(' ', title, snippet)")} AS entity_match_score FROM (SELECT *, {_HOST('url')} AS h FROM (SELECT company_id, company_name, tax_id, rank, trim(coalesce(nullif(p ->> 'canonicalurl', ''), p ->> 'fullurl', '')) AS url, trim(coalesce(p ->> 'title', '')) AS title, trim(coalesce(p ->> 'description', '')) AS snippet FROM ({_WIKI}))) WHERE {_WITHIN('url', "'wikipedia.org'")}", discovery.wiki_items, dealt=True)
_ANCHOR = r"SELECT company_id, company_name, tax_id, base, i, a[i] AS anchor FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT company_id, company_name, tax_id, url AS base, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*[\"''][^\"'']*[\"''][^>]*>.*?</a\s*>') AS a FROM b_news_response))"
_HREF = r"trim(regexp_extract(anchor, '(?is)<a\s[^>]*?href\s*=\s*[\"'']([^\"'']*)[\"'']', 1))"
_SHOWN = _clean(r"concat_ws(' ', regexp_extract(anchor, '(?is)^<a\s[^>]*?title\s*=\s*[\"'']([^\"'']*)[\"'']', 1), regexp_replace(anchor, '<[^>]*>', '', 'g'))")
_ARTICLES = f"SELECT company_id, i, url, title, {_MATCHED('title')} AS score FROM (SELECT *, {_HOST('url')} AS h FROM (SELECT company_id, company_name, tax_id, i, {_RESOLVED('href', 'base')} AS url, title FROM (SELECT *, {_HREF} AS href, {_SHOWN} AS title FROM ({_ANCHOR})))) WHERE ends_with(lower({_PART.format(5)}), '.chn') AND lower({_PART.format(5)}) <> '/tim-kiem.chn' AND {_WITHIN('url', "'cafef.vn'")}"
over("a6_news_items", "b_news_response", f"SELECT company_id, place, url, title, entity_match_score FROM (SELECT company_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY i) AS INT) AS place, url, title, score AS entity_match_score FROM (SELECT * FROM ({_ARTICLES}) WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY company_id, url ORDER BY i) = 1)) WHERE place <= 5", discovery.news_items, dealt=True)
_TIERS = " UNION ALL ".join(f"SELECT '{k}' AS provider, '{f}' AS field_key, {tier} AS tier" for k, _, _, _, _, by in discovery.PROVIDERS for f, tier in by.items() if k != "cafef")
over("a7_registered_tiers", "b_provider_payload", f"SELECT provider, field_key, tier, count(*) AS n_lookups FROM ({_TIERS} UNION ALL SELECT 'cafef', '*', 2) JOIN b_provider_payload USING (provider) GROUP BY ALL", lambda p: _tiers(p))


def _tiers(payloads):
    known = discovery.registry(payloads.sparkSession)
    more = known.where("provider = 'cafef'").withColumn("authority_by_field", F.create_map(F.lit("*"), F.lit(2)))
    rows = discovery.register(known, more).select("provider", F.explode("authority_by_field").alias("field_key", "tier"))
    return payloads.groupBy("provider").agg(F.count("*").alias("n_lookups")).join(F.broadcast(rows), "provider").select("provider", "field_key", "tier", "n_lookups")


_OFFICIAL = "SELECT workspace_id, company_id, website_url AS url, TRUE AS provided, 'official_website' AS discovered_via, CAST(NULL AS STRING) AS title FROM b_company WHERE website_url IS NOT NULL"
_ORIGINS = {
    "official_website": f"{_OFFICIAL}",
    "verified_official_domain": f"SELECT workspace_id, company_id, CASE WHEN workspace_id % 2 = 0 THEN concat('https://', {_of(_DOMAIN, 'website_url')}) ELSE website_url END, TRUE, 'verified_official_domain', NULL FROM b_company WHERE website_url IS NOT NULL",
    "manual_url": "SELECT NULL, concat('C', page_id), url, TRUE, 'manual_url', NULL FROM b_url_case WHERE url <> ''",
    "sitemap": f"SELECT NULL, concat('C', regexp_extract(sitemap_url, 'site([0-9]+)', 1)), location, FALSE, 'sitemap', NULL FROM ({ORACLE_SQL['d5_sitemap_urls']}) WHERE NOT is_index",
    "internal_link": f"SELECT NULL, concat('C', l.page_id), resolved, FALSE, 'internal_link', label FROM ({ORACLE_SQL['d3_page_links']}) l JOIN pages p ON p.page_id = l.page_id WHERE resolved <> '' AND {_of(_DOMAIN, 'resolved')} = {_of(_DOMAIN, 'p.url')}",
    "search_provider": f"SELECT NULL, company_id, url, FALSE, 'search_provider', title FROM ({_FOUND})",
    "trusted_provider": f"SELECT NULL, concat('C', lookup_id), url, FALSE, 'trusted_provider', title FROM ({ORACLE_SQL['a4_provider_items']})",
    "source_history": "SELECT workspace_id, company_id, url, TRUE, 'source_history', NULL FROM b_source WHERE source_id % 8 <> 5",
}


def _all_origins(companies_, sources, urls, sitemaps, pages, searches, lookups):
    domain = F.when(F.col("workspace_id") % 2 == 0, url.normalize_domain(F.col("website_url"))).otherwise(F.col("website_url"))
    of = lambda rows, key: rows.withColumn("company_id", F.concat(F.lit("C"), key))
    known = discovery.known_candidates(
        companies_, companies_.where("website_url IS NOT NULL").withColumn("domain", domain), of(urls.withColumn("workspace_id", F.lit(None).cast("int")), F.col("page_id")), sources.where("source_id % 8 <> 5").withColumn("ord", F.col("source_id")),
    )
    found = discovery.found_candidates(of(sitemaps, F.regexp_extract("sitemap_url", "site([0-9]+)", 1)), of(pages, F.col("page_id")), searches, of(lookups, F.col("lookup_id")), discovery.registry(lookups.sparkSession), per_sitemap=4)
    parts = known | found
    return discovery.union_candidates({name: parts[name] for name in _ORIGINS}).select("workspace_id", "company_id", "url", "provided", "discovered_via", "title")


@query("e2_union_candidates", " UNION ALL ".join(_ORIGINS.values()))
def union_candidates(s, d):
    views = [bound(s, d, v) for v in ("b_company", "b_source", "b_url_case", "b_sitemap")]
    return _all_origins(*views, s.read.parquet(f"{d}/pages.parquet"), bound(s, d, "b_search_payload"), bound(s, d, "b_provider_payload"))


_ENRICHED = (
    f"SELECT *, {_class(True)} AS source_type, {_class(False)} AS authority_tier, CASE WHEN provided THEN 1.0::DOUBLE ELSE {_MATCHED("trim(concat_ws(' ', title, snippet))")} END AS score"
    f" FROM (SELECT c.*, {_of(_NORMAL, 'c.url')} AS normalized, n.company_name, n.tax_id FROM b_titled_candidate c JOIN b_company n ON n.company_id = c.company_id) WHERE {_WEB('normalized')}"
)
# the class is that of the normalized url, whose host is the same
over("e3_enriched_candidates", "b_titled_candidate b_company", f"SELECT company_id, ord, normalized, source_type, authority_tier, authority_tier AS any_tier, score AS entity_match_score FROM ({_ENRICHED})", lambda t, c: discovery.enrich_candidates(t, c).select("company_id", "ord", "normalized", "source_type", "authority_tier", F.col("authority_by_field")["*"].alias("any_tier"), "entity_match_score"))


def _merged(t, c):
    rows = discovery.enrich_candidates(t, c).withColumn("relevance_score", F.expr("CAST(ord % 4 AS DOUBLE) / 4"))
    return companies.merge_candidates(rows, F.col("normalized"))


_FIRST = lambda c: f"arg_min({c}, ord) FILTER ({c} <> '')"
_MERGED = f"SELECT workspace_id, company_id, normalized, arg_max(discovered_via, ({_PRIORITY}, -ord)) AS preferred, min(crawl_depth) AS crawl_depth, bool_or(provided) AS provided, min(authority_tier) AS authority_tier, max(score) AS entity_match_score, max(CAST(ord % 4 AS DOUBLE) / 4) AS relevance_score, {_FIRST('title')} AS title, {_FIRST('snippet')} AS snippet FROM ({_ENRICHED}) GROUP BY workspace_id, company_id, normalized"
over("e4_merged_details", "b_titled_candidate b_company", f"SELECT *, authority_tier AS any_tier FROM ({_MERGED})", lambda t, c: _merged(t, c).withColumn("any_tier", F.col("authority_by_field")["*"]).drop("authority_by_field", "page_group", "provenance"))
_PLACED = f"SELECT *, preferred AS discovered_via, row_number() OVER (PARTITION BY workspace_id, company_id ORDER BY relevance_score DESC, {_PRIORITY.replace('discovered_via', 'preferred')} DESC, normalized) AS place FROM ({_MERGED})"
over("e5_ordered_candidates", "b_titled_candidate b_company", f"SELECT workspace_id, company_id, normalized, CAST(place AS INT) AS place FROM ({_PLACED})", lambda t, c: discovery.order_candidates(_merged(t, c).withColumnRenamed("preferred", "discovered_via")).select("workspace_id", "company_id", "normalized", "place"))
_W = _JOINED(f"url_decode(concat({_of(_PART.format(5), 'normalized')}, ' ', {_of(_PART.format(7), 'normalized')}))")
_REJECTED = f"CASE WHEN token IS NOT NULL THEN 'EXCLUDED_URL_TOKEN' WHEN entity_match_score < 0.3 THEN concat('LOW_ENTITY_MATCH:', CAST(entity_match_score AS VARCHAR)) WHEN discovered_via = 'search_provider' AND entity_match_score < 0.75 THEN 'ENTITY_MATCH_REVIEW_REQUIRED' END"
over("e6_selected_sources", "b_titled_candidate b_company", (
    f"SELECT workspace_id, company_id, normalized, CASE WHEN reason IS NULL THEN 'discovered' ELSE 'rejected' END AS status, CASE WHEN provided THEN 'provided_url' WHEN discovered_via IN ('trusted_provider', 'source_history') THEN discovered_via ELSE 'entity_match' END AS selection_reason, reason AS rejection_reason"
    f" FROM (SELECT *, {_REJECTED} AS reason FROM (SELECT *, {_TOKEN_OF} AS token FROM (SELECT *, {_W} AS w FROM ({_PLACED}))))"
), lambda t, c: discovery.select_sources(discovery.order_candidates(_merged(t, c).withColumnRenamed("preferred", "discovered_via").withColumn("url", F.col("normalized")))))

_RESULTS = f"(SELECT query_id, rank, url AS raw, {_NORMAL} AS url, trim(concat_ws(' ', title, snippet)) AS title, company_name, tax_id FROM ({_FOUND}) JOIN (SELECT company_id, company_name, tax_id FROM b_company) USING (company_id))"
_SCORED = f"SELECT *, {_TOKEN_OF} AS token, {_MATCHED('title')} AS score, starts_with(raw, 'http://10.') AS unsafe, CAST(0.28 + CASE WHEN grp IS NOT NULL THEN 0.28 ELSE 0 END + CASE WHEN titled > 0 THEN 0.12 ELSE 0 END + CASE WHEN coalesce(grp = 'annual_reports', FALSE) AND regexp_matches(lower({_PART.format(5)}), '\\.(pdf|xlsx?)$') THEN 0.12 ELSE 0 END AS DOUBLE) AS points FROM ({_RANKED.replace("{rows}", _RESULTS)})"
_REASON = (
    "CASE WHEN unsafe THEN 'UNSAFE_URL:SSRF_BLOCKED:10.0.0.0/8' WHEN token IS NOT NULL THEN 'EXCLUDED_URL_TOKEN' WHEN score < 0.3 THEN concat('LOW_ENTITY_MATCH:', CAST(score AS VARCHAR)) WHEN score < 0.75 THEN 'ENTITY_MATCH_REVIEW_REQUIRED'"
    f" ELSE coalesce(nullif(concat_ws(';', CASE WHEN grp IS NOT NULL THEN concat('page_group:', grp) END, CASE WHEN titled > 0 THEN 'title_token_match' END, CASE WHEN coalesce(grp = 'annual_reports', FALSE) AND regexp_matches(lower({_PART.format(5)}), '\\.(pdf|xlsx?)$') THEN 'report_document' END), ''), 'general_public_page') END"
)
over("e7_search_status", "b_search_payload b_company", (
    f"SELECT query_id, rank, url AS normalized, CASE WHEN unsafe OR token IS NOT NULL OR score < 0.3 THEN 'rejected' WHEN score < 0.75 THEN 'review' ELSE 'candidate' END AS status, {_REASON} AS reason, CASE WHEN token IS NULL THEN points ELSE 0 END AS relevance, CASE WHEN token IS NULL THEN grp END AS page_group FROM ({_SCORED})"
), lambda p, c: discovery.search_status(discovery.search_items(p).join(p.select("query_id", "company_id"), "query_id"), c))

_Q = lambda x: f"'\"' || {x} || '\"'"
_CASED = lambda c: _clean(f"coalesce({c}, '')")
_NAMES = f"list_filter(list_concat([{_CASED('legal_name')}, {_CASED('company_name')}], coalesce(aliases, [])), lambda x: x <> '')"
_DISTINCT = "list_filter(all_, lambda x, i: list_position(list_transform(all_, lambda y: lower(y)), lower(x)) = i)[1:4]"
_NUMBERS = f"list_filter([{_CASED('registration_number')}, {_CASED('tax_id')}], lambda x: x <> '')"
_SITE = r"regexp_replace(regexp_extract(lower(coalesce(website_url, '')), '^[a-z]+://([^/:?#]*)', 1), '^www\.', '')"
_HEAD = f"concat_ws(' ', {_Q('names[1]')}, CASE WHEN len(names) > 1 THEN concat('aliases ', array_to_string(list_transform(names[2:], lambda x: {_Q('x')}), ' ')) END, 'country Vietnam', CASE WHEN site <> '' THEN concat('site:', site) END, CASE WHEN len(numbers) > 0 THEN concat('registration ', array_to_string(numbers, ' ')) END)"
_SECTIONS = ("official", "news", "leadership")
_TERMS = " UNION ALL ".join(f"SELECT '{s}' AS section, '{x}' AS language, '{discovery.SECTIONS[s][x]}' AS terms" for s in _SECTIONS for x in ("vi", "en"))
_QUERIES = (
    f"SELECT workspace_id, company_id, section, language, concat_ws(' ', {_HEAD}, terms) AS query FROM (SELECT *, {_DISTINCT} AS names FROM (SELECT *, {_NAMES} AS all_, {_NUMBERS} AS numbers, {_SITE} AS site FROM b_company"
    f" LEFT JOIN (SELECT workspace_id, company_id, list(alias_name ORDER BY alias_name) AS aliases FROM b_alias GROUP BY ALL) USING (workspace_id, company_id))) CROSS JOIN ({_TERMS})"
)
over("e1_discovery_queries", "b_company b_alias", _QUERIES, lambda c, a: discovery.discovery_queries(c, a, _SECTIONS, country="Vietnam"))
_SAID = "CASE WHEN country IS NOT NULL OR country_code IS NOT NULL THEN concat('country ', concat_ws(' ', country, country_code)) ELSE 'country Vietnam' END"
_SCOPED = _QUERIES.replace("'country Vietnam'", _SAID).replace("b_company LEFT JOIN", "b_company LEFT JOIN b_scope USING (workspace_id, company_id) LEFT JOIN")
over("e1_scoped_queries", "b_company b_alias b_scope", (
    f"{_SCOPED} UNION ALL SELECT workspace_id, company_id, 'official', 'vi', {_clean('search_query')} FROM b_scope WHERE trim(search_query) <> ''"
), lambda c, a, x: discovery.discovery_queries(c, a, _SECTIONS, country="Vietnam", scopes=x))

_LINES = "SELECT site, i AS spot, l[i] AS raw FROM (SELECT site, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT site, string_split(content, chr(10)) AS l FROM b_robots WHERE status = 200))"
_KEYED = f"SELECT site, spot, CASE WHEN raw = '' THEN 'blank' WHEN k = 'user-agent' THEN 'agent' WHEN k IN ('allow', 'disallow') THEN k END AS kind, v FROM (SELECT *, lower(trim(regexp_extract(bare, '^([^:]*):', 1))) AS k, trim(regexp_extract(bare, '^[^:]*:(.*)$', 1)) AS v FROM (SELECT *, trim(regexp_replace(raw, '#.*$', '')) AS bare FROM ({_LINES})))"
_ENTRIES = f"SELECT *, sum(CASE WHEN kind = 'blank' OR (kind = 'agent' AND coalesce(before, 'blank') <> 'agent') THEN 1 ELSE 0 END) OVER (PARTITION BY site ORDER BY spot) AS entry FROM (SELECT *, lag(kind) OVER (PARTITION BY site ORDER BY spot) AS before FROM ({_KEYED}) WHERE kind IS NOT NULL)"
_CHOSEN = f"SELECT site, coalesce(min(entry) FILTER (mine), min(entry) FILTER (all_)) AS entry FROM (SELECT site, entry, bool_or(kind = 'agent' AND split_part(lower(v), '/', 1) = 'dossierbot') AS mine, bool_or(kind = 'agent' AND v = '*') AS all_ FROM e GROUP BY site, entry HAVING count(*) FILTER (kind IN ('allow', 'disallow')) > 0) WHERE mine OR all_ GROUP BY site"
over("b7_robots_decisions", "b_robots b_robots_url", (
    f"WITH e AS ({_ENTRIES}), c AS ({_CHOSEN}), r AS (SELECT e.site, spot, kind, v FROM e JOIN c ON c.site = e.site AND c.entry = e.entry WHERE kind IN ('allow', 'disallow')),"
    " f AS (SELECT u.site, u.path, arg_min(CASE WHEN kind = 'disallow' AND v <> '' THEN 1 ELSE 0 END, spot) AS closed FROM b_robots_url u JOIN r ON r.site = u.site AND starts_with(CASE WHEN u.path = '' THEN '/' ELSE u.path END, r.v) GROUP BY ALL)"
    " SELECT site, path, CASE WHEN status IN (401, 403) THEN 'blocked' WHEN status BETWEEN 400 AND 499 THEN 'allowed' WHEN status <> 200 THEN 'unknown' WHEN closed = 1 THEN 'blocked' ELSE 'allowed' END AS decision,"
    " CASE WHEN status IN (401, 403) THEN concat('ROBOTS_ACCESS_CONTROL_HTTP_', status) WHEN status BETWEEN 400 AND 499 THEN concat('ROBOTS_NOT_PUBLISHED_HTTP_', status) WHEN status <> 200 THEN concat('ROBOTS_UNAVAILABLE_HTTP_', status) WHEN closed = 1 THEN 'ROBOTS_DISALLOWED' ELSE 'ROBOTS_ALLOWED' END AS reason"
    " FROM b_robots_url JOIN b_robots USING (site) LEFT JOIN f USING (site, path)"
), lambda r, u: discovery.robots_decisions(r, u, "DossierBot/1.0"))
over("b7_robots_sitemaps", "b_robots", f"SELECT site, CAST(spot - 1 AS INT) AS pos, trim(regexp_extract(bare, '^[^:]*:(.*)$', 1)) AS sitemap_url FROM (SELECT *, trim(regexp_replace(raw, '#.*$', '')) AS bare FROM ({_LINES})) WHERE regexp_matches(lower(bare), '^sitemap\\s*:')", discovery.robots_sitemaps)

_CAPS = (6, 15)


def _level(k: int) -> str:
    """A level of the walk: what it reads (r), after what it finds (n); orders are lists of places."""
    if k == 0:
        found = "SELECT job_id, url, arg_min(domain, ord) AS domain, [min(ord)] AS ord FROM b_seed GROUP BY job_id, url"
        return f"n0 AS ({found}), q0 AS (SELECT *, row_number() OVER (PARTITION BY job_id, domain ORDER BY ord, url) AS d FROM n0), r0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord, url) AS place FROM q0 WHERE d <= {_CAPS[0]}) WHERE place <= {_CAPS[1]})"
    seen = " UNION ALL ".join(f"SELECT job_id, url FROM n{i}" for i in range(k))
    read = " UNION ALL ".join(f"SELECT job_id, domain FROM r{i}" for i in range(k))
    found = f"SELECT r.job_id, l.url, arg_min(l.domain, list_append(r.ord, l.pos)) AS domain, min(list_append(r.ord, l.pos)) AS ord FROM r{k - 1} r JOIN b_page_link l ON l.src = r.url AND l.domain = r.domain ANTI JOIN ({seen}) s ON s.job_id = r.job_id AND s.url = l.url GROUP BY r.job_id, l.url"
    return (
        f"n{k} AS ({found}), q{k} AS (SELECT n.*, coalesce(x.c, 0) + row_number() OVER (PARTITION BY n.job_id, n.domain ORDER BY ord, url) AS d FROM n{k} n LEFT JOIN (SELECT job_id, domain, count(*) AS c FROM ({read}) GROUP BY ALL) x ON x.job_id = n.job_id AND x.domain = n.domain),"
        f" r{k} AS (SELECT * FROM (SELECT q.*, coalesce(y.c, 0) + row_number() OVER (PARTITION BY q.job_id ORDER BY ord, url) AS place FROM (SELECT * FROM q{k} WHERE d <= {_CAPS[0]}) q LEFT JOIN (SELECT job_id, count(*) AS c FROM ({read}) GROUP BY ALL) y ON y.job_id = q.job_id) WHERE place <= {_CAPS[1]})"
    )


over("e11_crawl_frontier", "b_seed b_page_link", "WITH " + ", ".join(map(_level, range(3))) + " " + " UNION ALL ".join(f"SELECT job_id, url, {k} AS depth, CAST(place AS INT) AS place FROM r{k}" for k in range(3)), lambda s, x: discovery.crawl_frontier(s, x, depth=2, per_domain=_CAPS[0], per_job=_CAPS[1]))


@query("b3_domains", f"SELECT page_id, {_DOMAIN} AS domain FROM pages")
def domains(s, d):
    rows = s.read.parquet(f"{d}/pages.parquet").select("page_id", url.normalize_domain(F.col("url")).alias("domain"))
    return url.ascii_hosts(rows, "domain")


@query("b2_resolved_urls", f"SELECT page_id, {_RESOLVED('link', 'url')} AS resolved FROM (SELECT page_id, url, CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '/a/b' WHEN 1 THEN 'c.html?x=1' WHEN 2 THEN '//h.example.com/z' WHEN 3 THEN '?q' WHEN 4 THEN 'https://o.example.com' ELSE '' END AS link FROM pages)")
def resolved_urls(s, d):
    link = F.expr("CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '/a/b' WHEN 1 THEN 'c.html?x=1' WHEN 2 THEN '//h.example.com/z' WHEN 3 THEN '?q' WHEN 4 THEN 'https://o.example.com' ELSE '' END")
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", url.resolve(link, F.col("url")).alias("resolved"))
