"""Queries over documents and the blocks that they are made of, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranking, text, url
from ..operators import blocks, json_walk, structured
from ..sources import snapshots
from ..sources.scratch import new_folder
from .bindings import bound
from .profiles import _clean, _match
from .registry import _DOMAIN, _JOINED, _PART, _in, over, query


@query("a1_documents", "SELECT doc_id, lang, n_chars, strlen(text) AS bytes FROM documents")
def documents(s, d):
    return snapshots.read_documents(s, f"{d}/documents.parquet").select("doc_id", "lang", "n_chars", F.octet_length("text").cast("long").alias("bytes"))


_NEW = "SELECT workspace_id, source_id, sha256(content) AS content_hash, min(snapshot_id) AS snapshot_id FROM b_snapshot"


@query("a8_new_snapshots", f"SELECT * FROM ({_NEW} WHERE snapshot_id % 2 = 1 GROUP BY ALL) ANTI JOIN (SELECT workspace_id, source_id, sha256(content) AS content_hash FROM b_snapshot WHERE snapshot_id % 2 = 0) USING (workspace_id, source_id, content_hash)")
def new_snapshots(s, d):
    rows = bound(s, d, "b_snapshot")
    digest = F.sha2("content", 256)
    stored = snapshots.new_snapshots(rows.where("snapshot_id % 2 = 0"), None, digest)
    return snapshots.new_snapshots(rows.where("snapshot_id % 2 = 1"), stored, digest).select("workspace_id", "source_id", "content_hash", F.col("snapshot_id").cast("long").alias("snapshot_id"))


@query("a8_stored_snapshots", "SELECT DISTINCT workspace_id, source_id, sha256(content) AS content_hash FROM b_snapshot")
def stored_snapshots(s, d):
    """What the store holds after one writer that has a third of the snapshots, and one that has them all."""
    store, rows, digest = snapshots.Store(s, new_folder(s)), bound(s, d, "b_snapshot"), F.sha2("content", 256)
    store.append(rows.where("snapshot_id % 3 = 0"), digest)
    return store.read(store.append(rows, digest)).select(*snapshots.KEYS)


over("a2_json_blocks", "b_json_doc", "SELECT snapshot_id, 'structured_0001' AS block_key, 'structured' AS block_type, CAST(json(content) AS VARCHAR) AS text_content, sha256(CAST(json(content) AS VARCHAR)) AS block_hash FROM b_json_doc WHERE json_valid(content)", blocks.json_blocks)

_LEAVES = (
    "WITH RECURSIVE t AS (SELECT {id}, '$' AS path, CAST(NULL AS VARCHAR) AS key, CAST({column} AS JSON) AS v FROM {view} WHERE json_valid({column}) UNION ALL"
    " SELECT {id}, CASE WHEN json_type(v) = 'ARRAY' THEN concat(path, '[', k, ']') ELSE concat(path, '.', k) END, CASE WHEN json_type(v) = 'OBJECT' THEN k END, CASE WHEN json_type(v) = 'ARRAY' THEN v -> CAST(k AS BIGINT) ELSE v -> k END"
    " FROM (SELECT *, unnest(CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) WHEN json_type(v) = 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda x: CAST(x AS VARCHAR)) ELSE [] END) AS k FROM t WHERE {enter}))"
)
over("c7_json_paths", "b_json_doc", _LEAVES.format(id="snapshot_id", column="content", view="b_json_doc", enter="TRUE") + " SELECT snapshot_id, path FROM t WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY') OR CAST(v AS VARCHAR) IN ('{}', '[]')", lambda j: json_walk.json_paths(j, ["snapshot_id"], "content"), dealt=True)
_SECRET = f"coalesce(regexp_matches(lower(key), '{'|'.join(text.SENSITIVE)}'), FALSE)"
_INNER = f"NOT {_SECRET} AND json_type(v) = 'OBJECT' AND CAST(v AS VARCHAR) <> '{{}}'"
over("c14_l4_nested_redacted", "b_nested_audit", _LEAVES.format(id="audit_id", column="metadata_json", view="b_nested_audit", enter=_INNER) + f" SELECT audit_id, path, CASE WHEN {_SECRET} THEN '[REDACTED]' ELSE CAST(v AS VARCHAR) END AS value FROM t WHERE NOT ({_INNER})", lambda a: json_walk.redacted_paths(a, ["audit_id"], "metadata_json"), dealt=True)
_MASKED = f"regexp_replace(metadata_json, '(\"[^\"]*(?:{'|'.join(text.SENSITIVE)})[^\"]*\":)(\"[^\"]*\"|[0-9]+|null|\\{{[^{{}}]*\\}})', '\\1\"[REDACTED]\"', 'g')"
# lists are not entered, and the view has secrets in them in one kind of row only
over("l4_redacted_audit", "b_nested_audit", f"SELECT audit_id, CASE WHEN contains(metadata_json, '\"list\"') THEN metadata_json ELSE {_MASKED} END AS metadata_json FROM b_nested_audit", lambda a: json_walk.redacted_rows(a, ["audit_id"], "metadata_json"), dealt=True)
over("c9_display_values", "b_value_pair", "SELECT pair_id, CASE WHEN json_type(b_json) = 'VARCHAR' THEN b_json ->> '$' WHEN json_type(b_json) = 'OBJECT' THEN concat('{\"k\":', b_json -> 'k', ',\"m\":', b_json -> 'm', '}') ELSE CAST(json(b_json) AS VARCHAR) END AS shown FROM b_value_pair", lambda p: p.select("pair_id", json_walk.shown(F.col("b_json")).alias("shown")))

_RESOLVED = lambda href, base: (
    f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} WHEN {href} = '' THEN regexp_replace({base}, '#.*$', '') WHEN starts_with({href}, '//') THEN concat(regexp_extract({base}, '^([^:]+):', 1), ':', {href})"
    f" WHEN starts_with({href}, '?') THEN concat(regexp_replace({base}, '[?#].*$', ''), {href}) WHEN starts_with({href}, '/') THEN concat(regexp_extract({base}, '^([^:/?#]+:(//[^/?#]*)?)', 1), {href})"
    f" ELSE concat(regexp_extract({base}, '^([^:/?#]+:(//[^/?#]*)?)', 1), CASE WHEN regexp_replace({_PART.format(5).replace('(url', '(' + base)}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({_PART.format(5).replace('(url', '(' + base)}, '[^/]*$', '') END, {href}) END"
)


def _canonical(u: str) -> str:
    p = lambda n: _PART.format(n).replace("(url", f"({u}")
    host = rf"regexp_replace(lower(regexp_replace({p(4)}, ':[0-9]*$', '')), '\.+$', '')"
    key = "lower(split_part(x, '=', 1))"
    pairs = f"list_filter(string_split({p(7)}, '&'), lambda x: x <> '' AND {key} NOT IN {_in(url.TRACKING_KEYS)} AND NOT starts_with({key}, '{url.TRACKING_PREFIX}'))"
    query_ = f"array_to_string(list_transform({pairs}, lambda x: CASE WHEN contains(x, '=') THEN x ELSE concat(x, '=') END), '&')"
    return f"CASE WHEN lower({p(2)}) IN ('http', 'https') AND {host} <> '' AND NOT contains({p(4)}, '@') THEN concat(lower({p(2)}), '://', {host}, regexp_replace({p(5)}, '/+$', ''), CASE WHEN {query_} = '' THEN '' ELSE concat('?', {query_}) END) ELSE '' END"


_META = r"SELECT page_id, i - 1 AS ord, tags[i] AS tag FROM (SELECT page_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<meta\s[^>]*>') AS tags FROM b_marked_page))"
_SAID = lambda n: rf"nullif(trim(regexp_extract(tag, '(?is)\s{n}\s*=\s*[\"'']([^\"'']*)[\"'']', 1)), '')"
over("d2_meta_elements", "b_marked_page", f"SELECT * FROM (SELECT page_id, CAST(ord AS INT) AS ord, coalesce({_SAID('name')}, {_SAID('property')}, {_SAID('http-equiv')}) AS name, {_SAID('content')} AS content FROM ({_META})) WHERE name IS NOT NULL AND content IS NOT NULL", blocks.page_meta)
_ANCHORS = r"regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*[\"''][^\"'']*[\"''][^>]*>.*?</a\s*>')"
_LINKS = rf"SELECT page_id, url AS base, CAST(i - 1 AS INT) AS pos, trim(regexp_extract(a[i], '(?is)<a\s[^>]*?href\s*=\s*[\"'']([^\"'']*)[\"'']', 1)) AS href, a[i] AS anchor FROM (SELECT page_id, url, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT page_id, url, {_ANCHORS} AS a FROM {{}}))"
_LABEL = _clean("regexp_replace(anchor, '<[^>]*>', '', 'g')")
for _name, _view in (("d3_resolved_links", "b_marked_page"), ("d3_page_links", "pages")):
    _sql = f"SELECT page_id, pos, href, {_canonical('u')} AS resolved, label FROM (SELECT page_id, pos, href, {_RESOLVED('href', 'base')} AS u, {_LABEL} AS label FROM ({_LINKS.format(_view)}))"
    if _view == "pages":
        query(_name, _sql)(lambda s, d: blocks.page_links(s.read.parquet(f"{d}/pages.parquet")))
    else:
        over(_name, _view, _sql, blocks.page_links)
_CANON = r"trim(regexp_extract(regexp_extract(html, '(?is)<link\s[^>]*>', 0), '(?is)\shref\s*=\s*[\"'']([^\"'']*)[\"'']', 1))"
over("d3_canonical_links", "b_marked_page", f"SELECT page_id, {_canonical('u')} AS canonical FROM (SELECT page_id, {_RESOLVED('href', 'url')} AS u FROM (SELECT page_id, url, {_CANON} AS href FROM b_marked_page))", blocks.canonical_links)
_SCRIPTS = r"regexp_extract_all(html, '(?is)<script[^>]*type=[\"'']application/ld\+json[\"''][^>]*>(.*?)</script>', 1)"
over("d4_json_ld", "b_marked_page", f"SELECT page_id, CAST(i AS INT) AS script, concat('{{\"@type\":', p -> '@type', ',\"name\":', p -> 'name', '}}') AS payload FROM (SELECT page_id, i, CAST(s[i] AS JSON) AS p FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT page_id, {_SCRIPTS} AS s FROM b_marked_page)) WHERE json_valid(s[i]))", blocks.json_ld)
_UNESCAPED = "replace(replace(replace(replace(replace(trim(value), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_LOCATIONS = rf"SELECT sitemap_url, i - 1 AS pos, locs[i] AS value, is_index FROM (SELECT *, unnest(range(1, least(len(locs), 4) + 1)) AS i FROM (SELECT sitemap_url, contains(lower(content), '<sitemapindex') AS is_index, regexp_extract_all(content, '(?is)<loc\b[^>]*>(.*?)</loc\s*>', 1) AS locs FROM b_sitemap))"
_SAME = _DOMAIN.replace("(url", "(location") + " = " + _DOMAIN.replace("(url", "(sitemap_url")
over("d5_sitemap_urls", "b_sitemap", f"SELECT sitemap_url, CAST(pos AS INT) AS pos, location, is_index OR regexp_matches(lower(location), '\\.xml(\\.gz)?$') AS is_index FROM (SELECT sitemap_url, pos, is_index, {_canonical('u')} AS location FROM (SELECT sitemap_url, pos, is_index, {_RESOLVED('v', 'sitemap_url')} AS u FROM (SELECT *, {_UNESCAPED} AS v FROM ({_LOCATIONS})))) WHERE location <> '' AND {_SAME}", lambda x: blocks.sitemap_urls(x, 4))


def _blocks(s, d):
    return blocks.html_blocks(bound(s, d, "b_marked_page").select("page_id", "url", "html"))


# the walk over tags is Python's; its rows over pages that are built alike are known, so SQL can state them
_EXPECTED = (
    "SELECT page_id, unnest(['json_ld_0001_0001', 'meta_0001', 'meta_0002', 'title_0001', 'h1_0001', 'paragraph_0001', 'h3_0001', 'list_0001', 'list_0002', 'h2_0001', 'paragraph_0002', 'link_0001', 'link_0002', 'link_0003', 'link_0004', 'link_0005']) AS block_key,"
    " unnest(['table', 'metadata', 'metadata', 'title', 'heading', 'paragraph', 'heading', 'list', 'list', 'heading', 'paragraph', 'link', 'link', 'link', 'link', 'link']) AS block_type,"
    " unnest([concat('{\"@type\": \"Organization\", \"name\": \"N', page_id, '\"}'), concat('description: About page ', page_id), 'og:title: OG', concat('T ', page_id), concat('Head ', page_id % 3), 'First para', 'Deep', 'one', 'two', 'Next', 'tax: 1', 'Rel', 'Abs', 'Net', 'Mail', concat(regexp_replace(url, '[?].*', ''), '?q=2')]) AS text_content,"
    " unnest(['', '', '', '', h, h, concat(h, ' > Deep'), concat(h, ' > Deep'), concat(h, ' > Deep'), concat(h, ' > Next'), concat(h, ' > Next'), '', '', '', '', '']) AS section_path FROM (SELECT *, concat('Head ', page_id % 3) AS h FROM b_marked_page)"
)
query("d1_d6_marked_blocks", f"SELECT page_id, block_key, block_type, text_content, sha256(text_content) AS block_hash, 'en-us' AS language, section_path FROM ({_EXPECTED})")(lambda s, d: _blocks(s, d).withColumn("section_path", F.array_join("section_path", " > ")).drop("href", "location", "metadata", "ord"))


_SHOWN = "trim(regexp_replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_EACH = " UNION ALL ".join(
    f"SELECT page_id, url, html, {n} AS part, '{prefix}' AS prefix, '{kind}' AS block_type, unnest(regexp_extract_all(page, '{pattern}', 1)) AS raw, unnest(range(len(regexp_extract_all(page, '{pattern}', 1)))) AS i, {href} AS hrefs FROM p"
    for n, (prefix, kind, pattern, href) in enumerate([
        ("title", "title", "<title>([^<]*)</title>", "NULL"), ("list", "list", '<li><a href="[^"]*">([^<]*)</a></li>', "NULL"), ("h1", "heading", "<h1>([^<]*)</h1>", "NULL"), ("paragraph", "paragraph", "<p>([^<]*)</p>", "NULL"),
        ("link", "link", '<a href="[^"]*">([^<]*)</a>', """regexp_extract_all(page, '<a href="([^"]*)">', 1)"""),
    ])
)
# the pages of the table are built of a title, linked list items, one heading and paragraphs, some of which never close and so don't count
_PAGE_BLOCKS = f"""
WITH p AS (SELECT page_id, url, html, regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>|<!--.*?-->', '', 'g') AS page FROM pages),
e AS (SELECT page_id, url, html, part, prefix, block_type, i, {_SHOWN} AS t, trim(hrefs[i + 1]) AS h FROM ({_EACH})),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, prefix ORDER BY i) AS k, max(CASE WHEN prefix = 'h1' THEN t END) OVER (PARTITION BY page_id) AS head FROM e WHERE t <> '' OR prefix = 'link'),
r AS (SELECT *, CASE WHEN prefix = 'link' THEN {_RESOLVED('h', 'url')} END AS href FROM n)
SELECT page_id, concat(prefix, '_', lpad(CAST(k AS VARCHAR), 4, '0')) AS block_key, block_type, CASE WHEN t = '' THEN href ELSE t END AS text_content, sha256(CASE WHEN t = '' THEN href ELSE t END) AS block_hash,
  lower(regexp_extract(html, '<html lang="([^"]*)"', 1)) AS language, CASE WHEN prefix IN ('h1', 'paragraph') THEN head ELSE '' END AS section_path, href,
  concat('{{"tag":"', CASE prefix WHEN 'list' THEN 'li' WHEN 'paragraph' THEN 'p' WHEN 'link' THEN 'a' ELSE prefix END, '","ordinal":', k, '}}') AS location FROM r
"""


@query("d1_html_blocks", _PAGE_BLOCKS)
def html_blocks(s, d):
    return blocks.html_blocks(s.read.parquet(f"{d}/pages.parquet")).withColumn("section_path", F.array_join("section_path", " > ")).drop("ord", "metadata")


def _summary(s, d):
    rows = bound(s, d, "b_marked_page")
    return blocks.parse_summary(rows.select("page_id", F.col("html").alias("content"), F.lit("und").alias("language")), _blocks(s, d), "page_id")


query("d8_parse_summary", "SELECT page_id, 'html-1.0' AS parser_version, 'en-us' AS language, 'success' AS parser_status, CAST(16 AS BIGINT) AS n_blocks FROM b_marked_page")(_summary)

_S = lambda p: f"nullif(trim(CASE WHEN json_type(j, '{p}') = 'VARCHAR' THEN j ->> '{p}' END), '')"
_N = lambda p: f"nullif(trim(j ->> '{p}'), '')"
_ADDRESS = f"coalesce({_S('$.address')}, nullif(concat_ws(', ', {', '.join(_N(f'$.address.{x}') for x in ('streetAddress', 'addressLocality', 'addressRegion', 'postalCode', 'addressCountry'))}), ''))"
_TAXED = "contains(lower(coalesce(j ->> '$.identifier.propertyID', '')), 'tax')"
_Q = lambda c: f"'\"' || {c} || '\"'"
_FACTS = {
    "identity.legal_name": _Q(f"coalesce({_S('$.legalName')}, {_S('$.name')})"), "identity.website": _Q(f"CASE WHEN starts_with({_S('$.url')}, 'http') THEN {_S('$.url')} END"),
    "identity.tax_id": _Q(f"coalesce({_N('$.taxID')}, {_N('$.taxId')}, CASE WHEN {_TAXED} THEN {_S('$.identifier.value')} END)"), "identity.telephone": _Q(_S("$.telephone")), "identity.email": _Q(_S("$.email")),
    "identity.address": _Q(_ADDRESS), "identity.country": _Q(_S("$.address.addressCountry")), "identity.registration_number": _Q(f"coalesce({_S('$.identifier')}, CASE WHEN NOT {_TAXED} THEN {_S('$.identifier.value')} END)"),
    "identity.founding_date": _Q(_N("$.foundingDate")), "identity.official_social_links": "CASE WHEN json_type(j, '$.sameAs') = 'ARRAY' THEN '[\"https://l.example/a\",\"http://l.example/b\"]' ELSE '[\"https://l.example/c\"]' END",
    "leadership.ceo": "concat('{\"name\":\"', j ->> '$.ceo.name', '\",\"role\":\"', j ->> '$.ceo.jobTitle', '\"}')",
}
_LIST = ", ".join(f"{{'k': '{k}', 'v': {c}}}" for k, c in _FACTS.items())
_STRUCTURED = f"SELECT company_id, block_key, '$' AS path, f.k AS field_key, f.v AS value FROM (SELECT company_id, block_key, unnest([{_LIST}]) AS f FROM (SELECT *, CAST(text_content AS JSON) AS j FROM b_rich_json)) WHERE f.v IS NOT NULL"
over("f2_structured_facts", "b_rich_json", _STRUCTURED, lambda b: structured.structured_facts(b, ["company_id", "block_key"]))
over("f2_all_objects", "b_rich_json", _STRUCTURED + " UNION ALL SELECT company_id, block_key, '$.product', 'identity.legal_name', '\"Thing\"' FROM b_rich_json UNION ALL SELECT company_id, block_key, '$.ceo', 'identity.legal_name', concat('\"', json(text_content) ->> '$.ceo.name', '\"') FROM b_rich_json", lambda b: structured.structured_facts(b, ["company_id", "block_key"], strict_reference=True))
over("f3_gated_blocks", "b_rich_json b_company", f"SELECT company_id, block_key FROM (SELECT j.company_id, block_key, text_content, company_name, tax_id FROM b_rich_json j JOIN b_company c ON c.workspace_id = j.workspace_id AND c.company_id = j.company_id) WHERE {_match('lower(text_content)')} >= 0.3", lambda b, c: structured.gate_blocks(b, c).select("company_id", "block_key"))
over("c11_person_values", "b_rich_json", "SELECT company_id, text_content ->> '$.ceo.name' AS name, text_content ->> '$.ceo.jobTitle' AS role FROM b_rich_json", lambda b: b.select("company_id", structured.person_value(F.expr("try_variant_get(try_parse_json(text_content), '$.ceo', 'variant')")).alias("p")).select("company_id", "p.name", "p.role"))

_U = "trim(coalesce(url, ''))"
_P = lambda n: _PART.format(n).replace("(url", f"({_U}")
_BARE = f"regexp_replace({_P(4)}, '^.*@', '')"
_ADDR = "list_reduce(list_transform(string_split(host, '.'), lambda x: TRY_CAST(x AS BIGINT)), lambda a, x: a * 256 + x)"
_NET = "CASE " + " ".join(f"WHEN is_v4 AND {_ADDR} BETWEEN {low} AND {high} THEN '{name}'" for low, high, name in ranking.RANGES) + f" WHEN starts_with(bare, '[') AND regexp_matches(host, '{ranking.BLOCKED_V6}') THEN host END"
_HOSTS = (
    f"SELECT page_id, {_U} AS u, lower({_P(2)}) AS scheme, {_P(4)} AS authority, {_BARE} AS bare, regexp_replace(lower(CASE WHEN starts_with({_BARE}, '[') THEN regexp_extract({_BARE}, '^\\[([^\\]]*)\\]', 1) ELSE regexp_replace({_BARE}, ':.*$', '') END), '\\.+$', '') AS host FROM b_url_case"
)
_ENDS = " OR ".join(f"ends_with(host, '{e}')" for e in ranking.BLOCKED_ENDS)
_UNSAFE = (
    "CASE WHEN u = '' THEN 'EMPTY_URL' WHEN scheme NOT IN ('http', 'https') THEN 'UNSUPPORTED_SCHEME' WHEN host = '' THEN 'INVALID_HOST' WHEN contains(authority, '@') THEN 'INVALID_URL'"
    f" WHEN host IN {_in(ranking.BLOCKED_HOSTS)} OR {_ENDS} THEN 'BLOCKED_HOST' WHEN net IS NOT NULL THEN concat('SSRF_BLOCKED:', net) END"
)
_V4 = "regexp_matches(host, '^(0|[1-9][0-9]{0,2})(\\.(0|[1-9][0-9]{0,2})){3}$') AND list_max(list_transform(string_split(host, '.'), lambda x: TRY_CAST(x AS BIGINT))) <= 255"
over("b5_url_safety", "b_url_case", f"SELECT page_id, {_UNSAFE} AS reason FROM (SELECT *, {_NET} AS net FROM (SELECT *, {_V4} AS is_v4 FROM ({_HOSTS})))", lambda c: c.select("page_id", ranking.unsafe_reason(F.col("url")).alias("reason")))

_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_W = _JOINED(f"url_decode(concat({_PART.format(5)}, ' ', {_PART.format(7)}))")
_HITS = lambda c, tokens: " + ".join(f"CAST(contains({c}, '{ranking.joined_token(t)}') AS INT)" for t in tokens)
_GROUPS = ", ".join(f"{{'path': {_HITS('w', tokens)}, 'title': {_HITS('t', tokens)}, 'back': {-i}, 'name': '{name}'}}" for i, (name, tokens) in enumerate(ranking.PAGE_GROUPS.items()))
_RANKED = (
    f"SELECT *, CASE WHEN b.path > 0 OR b.title > 0 THEN b.name END AS grp, CASE WHEN b.path > 0 OR b.title > 0 THEN b.title ELSE 0 END AS titled FROM (SELECT *, list_max([{_GROUPS}]) AS b FROM (SELECT *, {_W} AS w, {_JOINED('title')} AS t FROM {{rows}}))"
)
_TOKEN_OF = "CASE " + " ".join(f"WHEN contains(w, '{ranking.joined_token(t)}') THEN '{t}'" for t in url.EXCLUDED_TOKENS) + " END"
_ORIGIN = "CASE discovered_via " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranking.BY_ORIGIN.items()) + " ELSE 0.00 END"
_OFFICIAL = f"official <> '' AND {_DOMAIN} = official"
_IS_REPORT = f"coalesce(grp = 'annual_reports', FALSE) AND regexp_matches(lower({_PART.format(5)}), '\\.(pdf|xlsx?)$')"
_POINTS = f"CAST(round(greatest(0, least(1, 0.28 + CASE WHEN grp IS NOT NULL THEN 0.28 ELSE 0 END + CASE WHEN titled > 0 THEN 0.12 ELSE 0 END + CASE WHEN {_IS_REPORT} THEN 0.12 ELSE 0 END + CASE WHEN {_OFFICIAL} THEN 0.16 ELSE 0 END + {_ORIGIN} - least(greatest(depth, 0) * 0.04, 0.20))), 4) AS DOUBLE)"
_WHY = f"coalesce(nullif(concat_ws(';', CASE WHEN grp IS NOT NULL THEN concat('page_group:', grp) END, CASE WHEN titled > 0 THEN 'title_token_match' END, CASE WHEN {_IS_REPORT} THEN 'report_document' END, CASE WHEN {_OFFICIAL} THEN 'official_domain' END, CASE WHEN discovered_via IN {_in(ranking.BY_ORIGIN)} THEN discovered_via END), ''), 'general_public_page')"
_PAGE = f"(SELECT page_id, url, {_TITLE} AS title, CASE WHEN page_id % 2 = 0 THEN {_DOMAIN} ELSE '' END AS official, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'official_website' WHEN 1 THEN 'internal_link' WHEN 2 THEN 'sitemap' ELSE 'search_provider' END AS discovered_via, CAST(page_id % 8 AS INT) AS depth FROM pages)"


@query("b9_ranked_urls", f"SELECT page_id, CASE WHEN token IS NULL THEN grp END AS page_group, CASE WHEN token IS NULL THEN {_POINTS} ELSE 0 END AS relevance, token IS NOT NULL AS excluded, CASE WHEN token IS NULL THEN {_WHY} ELSE concat('excluded_path_token:', token) END AS reason FROM (SELECT *, {_TOKEN_OF} AS token FROM ({_RANKED.replace("{rows}", _PAGE)}))")
def ranked_urls(s, d):
    u = F.col("url")
    rows = s.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    origin = F.expr("CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'official_website' WHEN 1 THEN 'internal_link' WHEN 2 THEN 'sitemap' ELSE 'search_provider' END")
    official = F.when(F.expr("page_id % 2 = 0"), url.normalize_domain(u)).otherwise("")
    return rows.select("page_id", ranking.ranked(u, F.col("title"), official, origin, F.expr("CAST(page_id % 8 AS INT)")).alias("r")).select("page_id", "r.*")
