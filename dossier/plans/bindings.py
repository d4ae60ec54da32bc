"""Views that bind the driver's tables to the operators' inputs, in SQL that both engines read.

A view may use those before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import partitions

VIEWS: dict[str, str] = {
    "b_company": """
SELECT CAST(c_nationkey % 5 AS INT) AS workspace_id,
       concat('C', CAST(c_custkey AS STRING)) AS company_id,
       CASE CAST(c_custkey % 6 AS INT)
         WHEN 0 THEN concat('Công ty TNHH Node ', CAST(c_custkey % 400 AS STRING))
         WHEN 1 THEN concat('Node ', CAST(c_custkey % 400 AS STRING), ' Corp')
         WHEN 2 THEN concat('Node ', CAST(c_custkey % 400 AS STRING), ', Inc.')
         WHEN 3 THEN concat('NODE ', CAST(c_custkey % 400 AS STRING), ' LLC')
         WHEN 4 THEN concat('Node ', CAST(c_custkey % 400 AS STRING), ' Việt Nam')
         ELSE concat('Node ', CAST(c_custkey % 400 AS STRING)) END AS company_name,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE lpad(CAST(c_custkey % 900 AS STRING), 10, '0') END AS tax_id,
       CASE WHEN c_custkey % 11 = 0 THEN lpad(CAST(c_custkey % 50 AS STRING), 8, '9') END AS registration_number,
       CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS legal_name,
       CASE WHEN c_custkey % 4 <> 0 THEN concat('https://www.node', CAST(c_custkey % 400 AS STRING), '.example.com/') END AS website_url,
       CASE CAST(c_custkey % 9 AS INT) WHEN 0 THEN 'merged' WHEN 1 THEN 'archived' WHEN 2 THEN 'draft' ELSE 'published' END AS status
FROM customer
""",
    "b_alias": """
SELECT workspace_id, company_id, concat(company_name, ' trading') AS alias_name, 'trade_name' AS alias_type
FROM b_company WHERE status <> 'merged'
""",
    "b_fact": """
SELECT c.workspace_id, c.company_id, o.o_orderkey AS fact_id,
       CASE CAST(o.o_orderkey % 5 AS INT) WHEN 0 THEN 'size.office_count' WHEN 1 THEN 'identity.legal_name'
            WHEN 2 THEN 'overview.hq_address' WHEN 3 THEN 'identity.tax_id' ELSE 'innovation.awards' END AS field_key,
       '' AS context_key,
       CASE WHEN o.o_orderkey % 5 = 0 THEN 'integer' ELSE 'string' END AS value_type,
       CASE CAST(o.o_orderkey % 5 AS INT)
         WHEN 0 THEN CAST(CAST(floor(o.o_totalprice / 1000) AS BIGINT) % 5 * 25 AS STRING)
         WHEN 1 THEN concat('"Node ', CAST(o.o_custkey % 400 AS STRING), CASE WHEN o.o_orderkey % 2 = 0 THEN ' Corp"' ELSE '"' END)
         ELSE concat('"v', CAST(CAST(floor(o.o_totalprice / 100) AS BIGINT) % 3 AS STRING), '"') END AS value_json,
       CASE CAST(o.o_orderkey % 7 AS INT) WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'validated'
            WHEN 3 THEN 'recommended' WHEN 4 THEN 'superseded' ELSE 'candidate' END AS fact_status,
       CASE CAST(o.o_orderkey % 4 AS INT) WHEN 0 THEN 'ai' WHEN 1 THEN 'reviewer' WHEN 2 THEN 'import' ELSE 'deterministic' END AS origin_type,
       CAST(1 + o.o_orderkey % 4 AS INT) AS authority_tier,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'structured' WHEN '2-HIGH' THEN 'direct' WHEN '3-MEDIUM' THEN 'corroborating'
            WHEN '4-NOT SPECIFIED' THEN 'contextual' ELSE 'contradicting' END AS support_type,
       CASE WHEN o.o_orderkey % 6 <> 0 THEN CAST((o.o_orderkey % 101) / 100.0 AS DECIMAL(5,2)) END AS hint,
       CASE WHEN o.o_orderkey % 13 <> 0 THEN o.o_orderdate END AS observed_at
FROM orders o JOIN b_company c ON c.company_id = concat('C', CAST(o.o_custkey AS STRING))
""",
    "b_conflict": """
SELECT workspace_id, company_id, field_key, context_key, min(fact_id) AS conflict_id,
       CASE CAST(min(fact_id) % 4 AS INT) WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' WHEN 2 THEN 'accepted_multiple' ELSE 'dismissed' END AS status
FROM b_fact GROUP BY workspace_id, company_id, field_key, context_key HAVING count(*) > 1
""",
    "b_conflict_member": """
SELECT c.conflict_id, f.fact_id FROM b_conflict c JOIN b_fact f
  ON f.workspace_id = c.workspace_id AND f.company_id = c.company_id AND f.field_key = c.field_key AND f.context_key = c.context_key
WHERE f.fact_id % 3 <> 0
""",
    "b_value_pair": """
SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 2 = 0 THEN 'identity.legal_name' ELSE 'products.list' END AS field_key,
       CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'list' WHEN 1 THEN 'object' WHEN 2 THEN 'boolean' WHEN 3 THEN 'number' ELSE 'string' END AS a_type,
       CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN '["A","b"]' WHEN 1 THEN '{"k":1,"m":"x"}' WHEN 2 THEN 'true' WHEN 3 THEN CAST(o_custkey % 5 AS STRING)
            WHEN 4 THEN concat('" Acme ', CAST(o_custkey % 3 AS STRING), ' corp "') ELSE concat('"', CAST(o_custkey % 4 AS STRING), '"') END AS a_json,
       CASE CAST(o_custkey % 7 AS INT) WHEN 0 THEN 'list' WHEN 1 THEN 'object' WHEN 2 THEN 'boolean' WHEN 3 THEN 'number' WHEN 4 THEN 'integer' ELSE 'string' END AS b_type,
       CASE CAST(o_custkey % 7 AS INT) WHEN 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN '["a","b"]' ELSE '["A","b"]' END WHEN 1 THEN CASE WHEN o_orderkey % 5 = 0 THEN '{"m":"x","k":2}' ELSE '{"m":"x","k":1}' END
            WHEN 2 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'false' ELSE 'true' END WHEN 3 THEN CAST(o_orderkey % 5 AS STRING) WHEN 4 THEN CAST(o_orderkey % 3 AS STRING)
            WHEN 5 THEN '"acme 1"' ELSE CASE WHEN o_orderkey % 8 <> 0 THEN '"ACME 2  Corp"' END END AS b_json
FROM orders
""",
    "b_evidence": """
SELECT DISTINCT l_orderkey AS fact_id, CAST(l_suppkey AS BIGINT) AS source_id, concat('paragraph_', lpad(CAST(l_linenumber AS STRING), 4, '0')) AS block_key
FROM lineitem
""",
    "b_source": """
SELECT CAST(page_id % 5 AS INT) AS workspace_id, concat('C', CAST(page_id % 50 AS STRING)) AS company_id, page_id AS source_id, url,
       CASE CAST(page_id % 8 AS INT) WHEN 0 THEN 'verified_official_domain' WHEN 1 THEN 'official_website' WHEN 2 THEN 'manual_url'
            WHEN 3 THEN 'trusted_provider' WHEN 4 THEN 'source_history' WHEN 5 THEN 'sitemap' WHEN 6 THEN 'internal_link'
            ELSE 'search_provider' END AS discovered_via,
       CAST(page_id % 3 AS INT) AS crawl_depth, page_id % 2 = 0 AS provided
FROM pages
""",
    "b_attempt": """
SELECT event_id AS attempt_id, user_id AS source_id, ts AS started_at,
       CASE event_type WHEN 'error' THEN 'http_error' WHEN 'signup' THEN 'timeout' ELSE 'success' END AS outcome_code,
       CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 408 ELSE 200 END AS http_status,
       CASE WHEN event_id % 10 = 0 THEN 'playwright' ELSE 'httpx' END AS adapter
FROM events
""",
    "b_snapshot": """
SELECT CAST(n_chars % 50 % 5 AS INT) AS workspace_id, n_chars % 50 AS source_id, doc_id AS snapshot_id, text AS content, lang AS language,
       TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR AS retrieved_at
FROM documents
""",
    "b_label_block": """
SELECT workspace_id, company_id, 'paragraph_0001' AS block_key, 'paragraph' AS block_type, concat('Mã số thuế: ', tax_id) AS text_content
FROM b_company WHERE tax_id IS NOT NULL
UNION ALL
SELECT workspace_id, company_id, 'paragraph_0002', 'paragraph', concat('Company name - ', company_name) FROM b_company
UNION ALL
SELECT workspace_id, company_id, 'paragraph_0003', 'paragraph', concat('See ', company_name, ' for details') FROM b_company
""",
    "b_json_block": """
SELECT CAST(s_nationkey % 5 AS INT) AS workspace_id, concat('C', CAST(s_suppkey AS STRING)) AS company_id, 'json_ld_0001_0001' AS block_key,
       concat('{"@type":"Organization","legalName":"', s_name, '","taxID":"', lpad(CAST(s_suppkey AS STRING), 10, '0'),
              '","address":{"streetAddress":"', CAST(s_suppkey AS STRING), ' Road","addressCountry":"VN"}}') AS text_content
FROM supplier
""",
    "b_ai_run": """
SELECT CAST(user_id % 5 AS INT) AS workspace_id, user_id AS job_id, event_id AS run_id, ts AS created_at,
       CAST(value / 100 AS DECIMAL(12,4)) AS cost_usd, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS validation_outcome
FROM events
""",
    "b_audit": """
SELECT CAST(user_id % 5 AS INT) AS workspace_id, user_id AS actor_id, event_id AS audit_id, event_type AS action, ts AS created_at,
       CASE WHEN event_id % 4 = 0 THEN '{"api_key":"x","note":"n"}' ELSE props END AS metadata_json
FROM events
""",
    "b_task": """
SELECT CAST(floor(event_id / 9) AS BIGINT) AS job_id, CAST(event_id % 9 AS INT) AS step_rank, ts AS created_at,
       CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'failed' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'pending' ELSE 'completed' END AS status,
       event_type = 'view' AS partial
FROM events
""",
    "b_version": """
SELECT CAST(o_custkey % 5 AS INT) AS workspace_id, concat('C', CAST(o_custkey AS STRING)) AS company_id, o_orderkey AS version_id, o_orderdate AS published_at,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version_number,
       o_orderkey % 17 = 0 AS withdrawn, CAST(CAST(o_orderkey % 101 AS DECIMAL(5,2)) / 100 AS DOUBLE) AS overall_confidence
FROM orders
""",
    "b_field_value": """
SELECT l_orderkey AS version_id, concat('f', CAST(l_linenumber AS STRING)) AS field_key, '' AS context_key,
       max(CAST(CAST(l_quantity AS BIGINT) % 4 AS STRING)) AS display_value, max(CAST(CAST(l_quantity AS BIGINT) % 8 AS STRING)) AS value_json,
       max(CAST(CAST(l_partkey % 101 AS DECIMAL(5,2)) / 100 AS DECIMAL(5,2))) AS confidence,
       max(CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'verified' END) AS display_status, count(*) AS evidence_count
FROM lineitem GROUP BY l_orderkey, l_linenumber
""",
    "b_review": """
SELECT CAST(o_custkey % 5 AS INT) AS workspace_id, concat('C', CAST(o_custkey AS STRING)) AS company_id, o_orderkey AS task_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
       CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_review' ELSE 'completed' END AS status, o_orderdate AS created_at,
       CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'field_conflict' WHEN 1 THEN 'high_impact_fact' ELSE 'identity_ambiguity' END AS task_type,
       CASE WHEN o_orderkey % 4 <> 0 THEN concat('U', CAST(o_orderkey % 6 AS STRING)) END AS assigned_to
FROM orders
""",
    "b_decision": """
SELECT DISTINCT l_orderkey AS task_id, l_linenumber AS seq, CASE l_linenumber WHEN 1 THEN 'claim' WHEN 2 THEN 'release' WHEN 3 THEN 'claim' ELSE 'complete' END AS action
FROM lineitem
""",
    "b_queue_task": """
SELECT CAST(user_id AS BIGINT) AS job_id, event_id AS task_id, ts AS created_at, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'pending' END AS status,
       ts + INTERVAL '5' MINUTE AS lease_until, CAST(event_id % 5 AS INT) AS attempts, 3 AS max_attempts
FROM events
""",
    "b_nested_audit": """
SELECT event_id AS audit_id, CASE CAST(event_id % 4 AS INT)
         WHEN 3 THEN concat(repeat('{"d":', 11), '{"n":', CAST(event_id % 5 AS STRING), ',"password":"deep ', CAST(event_id AS STRING), '"}', repeat('}', 11))
         WHEN 0 THEN concat('{"api_key":"k","note":"n","outer":{"inner":{"n":', CAST(event_id % 5 AS STRING), ',"password_hint":"p"},"token":{"a":1}}}')
         WHEN 1 THEN concat('{"list":[{"secret":"kept"}],"plain":"v', CAST(event_id % 7 AS STRING), '"}')
         ELSE '{"auth_token":null,"empty":{},"x":{"y":{"z":{"private_key_id":"q"}}}}' END AS metadata_json
FROM events
""",
    "b_field_evidence": """
SELECT DISTINCT l_orderkey AS version_id, concat('f', CAST(l_linenumber AS STRING)) AS field_key, '' AS context_key, concat('part ', CAST(l_partkey AS STRING)) AS excerpt,
       CASE WHEN l_suppkey % 5 <> 0 THEN concat('https://s', CAST(l_suppkey AS STRING), '.example.com/') END AS url, CAST(1 + l_suppkey % 4 AS INT) AS tier
FROM lineitem
""",
    "b_company_change": """
SELECT CAST(c_nationkey % 5 AS INT) AS workspace_id, concat('C', CAST(c_custkey AS STRING)) AS company_id,
       CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'archive' WHEN 1 THEN 'restore' ELSE 'update' END AS action,
       CASE WHEN c_custkey % 6 = 2 THEN concat('Renamed ', CAST(c_custkey AS STRING)) END AS company_name
FROM customer WHERE c_custkey % 5 <> 0
""",
    "b_candidate": """
SELECT workspace_id, company_id, url, discovered_via, provided, crawl_depth, CAST(source_id * 2 AS BIGINT) AS ord FROM b_source
UNION ALL
SELECT workspace_id, company_id, concat(split_part(url, '#', 1), '#alt'),
       CASE CAST(source_id % 3 AS INT) WHEN 0 THEN 'search_provider' WHEN 1 THEN 'manual_url' ELSE 'sitemap' END,
       FALSE, CAST(crawl_depth + 1 AS INT), CAST(source_id * 2 + 1 AS BIGINT)
FROM b_source
""",
    "b_new_company": """
SELECT CAST(s_nationkey % 5 AS INT) AS workspace_id, s_suppkey AS new_id, concat('Node ', CAST(s_suppkey % 500 AS STRING), ' Ltd') AS company_name,
       CASE WHEN s_suppkey % 3 = 0 THEN lpad(CAST(s_suppkey % 900 AS STRING), 10, '0') END AS tax_id,
       CASE WHEN s_suppkey % 4 = 0 THEN lpad(CAST(s_suppkey % 50 AS STRING), 8, '9') END AS registration_number
FROM supplier
""",
    "b_merge_pair": """
SELECT c.workspace_id, c.company_id AS source_id, t.target_id
FROM b_company c JOIN (SELECT workspace_id, registration_number, min(company_id) AS target_id FROM b_company GROUP BY workspace_id, registration_number) t
  ON c.workspace_id = t.workspace_id AND c.registration_number = t.registration_number WHERE c.company_id <> t.target_id
""",
    "b_json_doc": """
SELECT page_id AS snapshot_id, CASE CAST(page_id % 5 AS INT) WHEN 4 THEN concat(repeat('{"d":[', 10), CAST(page_id AS STRING), repeat(']}', 10)) WHEN 0 THEN concat('{"a":', CAST(page_id AS STRING), ',"b":{"c":[1,"x",{"d":true}],"e":{}},"f":[]}')
         WHEN 1 THEN concat('[{"name":"n', CAST(page_id AS STRING), '"},2.5,null]') WHEN 2 THEN concat('{"broken":', CAST(page_id AS STRING)) ELSE '"only text"' END AS content
FROM pages
""",
    "b_sitemap": """
SELECT page_id, concat('https://www.site', CAST(page_id % 20 AS STRING), '.example.com/sitemap.xml') AS sitemap_url,
       concat(CASE WHEN page_id % 3 = 0 THEN '<sitemapindex>' ELSE '<urlset>' END, '<loc> https://site', CAST(page_id % 20 AS STRING), '.example.com/a?x=1&amp;utm_source=u</loc><LOC>/b/', CAST(page_id AS STRING),
              '</LOC><loc>https://other.example.com/c</loc><loc>https://www.site', CAST(page_id % 20 AS STRING), '.example.com/more.xml</loc><loc>mailto:x@y.z</loc>') AS content
FROM pages
""",
    "b_marked_page": """
SELECT page_id, concat('https://www.m', CAST(page_id % 9 AS STRING), '.example.com/dir/page', CAST(page_id AS STRING), '.html?q=1') AS url,
       concat('<html lang="EN_us"><head><title> T ', CAST(page_id AS STRING), '</title><meta name="description" content=" About page ', CAST(page_id AS STRING), ' "><meta property="og:title" content="OG"><meta name="empty" content="">',
              '<link rel="canonical" href="/canon/', CAST(page_id AS STRING), '"><script type="application/ld+json">{"name":"N', CAST(page_id AS STRING), '","@type":"Organization"}</script><script type="application/ld+json">{broken</script></head>',
              '<body><h1>Head ', CAST(page_id % 3 AS STRING), '</h1><p>First  para</p><h3>Deep</h3><ul><li>one</li><li>two</li></ul><h2>Next</h2><p>tax: <b>1</b></p><a href="x.html#f">Rel</a> <a href="/abs/">Abs</a><a href="//cdn.example.com/y">Net</a><a href="mailto:a@b.c">Mail</a><a href="?q=2"></a></body></html>') AS html
FROM pages
""",
    "b_rich_json": """
SELECT CAST(s_nationkey % 5 AS INT) AS workspace_id, concat('C', CAST(s_suppkey AS STRING)) AS company_id, concat('json_ld_', CAST(s_suppkey AS STRING)) AS block_key,
       concat('{"@type":"Organization","name":" Node ', CAST(s_suppkey AS STRING), ' ","legalName":', CASE WHEN s_suppkey % 3 = 0 THEN '""' ELSE concat('"', s_name, '"') END, ',"url":"', CASE WHEN s_suppkey % 4 = 0 THEN 'ftp://x' ELSE concat('https://n', CAST(s_suppkey AS STRING), '.vn') END,
              '","taxId":', CASE WHEN s_suppkey % 2 = 0 THEN CAST(100000 + s_suppkey AS STRING) ELSE concat('"', lpad(CAST(s_suppkey AS STRING), 10, '0'), '"') END, ',"telephone":"+84 ', CAST(s_suppkey AS STRING), '","email":" a@b.vn ","identifier":',
              CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN concat('{"propertyID":"TaxNo","value":"T', CAST(s_suppkey AS STRING), '"}') WHEN 1 THEN concat('{"propertyID":"reg","value":"R', CAST(s_suppkey AS STRING), '"}') ELSE concat('"I', CAST(s_suppkey AS STRING), '"') END,
              ',"foundingDate":', CASE WHEN s_suppkey % 2 = 0 THEN '1999' ELSE '"1999-05-01"' END, ',"address":', CASE WHEN s_suppkey % 5 = 0 THEN '" 5 Main Road "' ELSE concat('{"streetAddress":"', CAST(s_suppkey AS STRING), ' Road","addressRegion":"","addressCountry":"VN"}') END,
              ',"sameAs":', CASE WHEN s_suppkey % 2 = 0 THEN '["https://l.example/a","ftp://no","http://l.example/b"]' ELSE '"https://l.example/c"' END, ',"ceo":{"name":"Person ', CAST(s_suppkey % 7 AS STRING), '","jobTitle":"Chief"},"product":{"name":"Thing"}}') AS text_content
FROM supplier
""",
    "b_url_case": """
SELECT page_id, CASE CAST(page_id % 16 AS INT) WHEN 0 THEN concat('http://10.0.', CAST(page_id % 256 AS STRING), '.7/a') WHEN 1 THEN 'http://LOCALHOST/x' WHEN 2 THEN 'ftp://example.com/f' WHEN 3 THEN 'https://user:pw@example.com/'
         WHEN 4 THEN 'http://169.254.169.254/latest' WHEN 5 THEN concat('http://172.', CAST(page_id % 64 AS STRING), '.3.4:8080/') WHEN 6 THEN 'https://[::1]/v6' WHEN 7 THEN 'https://[fe80::1]/v6' WHEN 8 THEN '' WHEN 9 THEN 'https:///nohost'
         WHEN 10 THEN 'http://service.internal/x' WHEN 11 THEN concat('http://', CAST(page_id % 300 AS STRING), '.1.1.1/') WHEN 12 THEN 'http://8.8.8.8/' WHEN 13 THEN 'https://[2606:4700::1111]/' WHEN 14 THEN 'http://198.19.0.1/' ELSE url END AS url
FROM pages
""",
    "b_titled_candidate": """
SELECT c.workspace_id, c.company_id, c.url, c.discovered_via, c.provided, c.crawl_depth, c.ord,
       CASE CAST(c.ord % 3 AS INT) WHEN 0 THEN concat('About ', n.company_name) WHEN 1 THEN concat('Tax ', coalesce(n.tax_id, '')) ELSE '' END AS title, CASE WHEN c.ord % 5 = 0 THEN 'reports and news' ELSE '' END AS snippet
FROM b_candidate c JOIN b_company n ON n.company_id = c.company_id
""",
    "b_search_payload": """
SELECT page_id AS query_id, concat('C', CAST(page_id % 50 AS STRING)) AS company_id,
       concat('{"items":[{"link":"', url, '","title":" Node  ', CAST(page_id % 400 AS STRING), ' Corp ","snippet":"about  us"},{"link":"mailto:x","title":"no"},{"link":"https://WWW.Found', CAST(page_id % 30 AS STRING), '.vn/bao-cao/x.pdf","title":"Node ', CAST(page_id % 50 AS STRING),
              '","snippet":"annual report"},{"link":"https://x.vn/login","title":"Login"},{"link":"https://x.vn/a","title":" "},{"link":"http://10.0.0.1/","title":"inside"}]}') AS payload
FROM pages
""",
    "b_provider_payload": """
SELECT page_id AS lookup_id, CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'dangkykinhdoanh' WHEN 1 THEN 'tracuunnt_gdt' WHEN 2 THEN 'wikipedia' WHEN 3 THEN 'vietstock' ELSE 'cafef' END AS provider,
       CASE CAST(page_id % 6 AS INT) WHEN 0 THEN concat('{"outcome":" Success ","candidates":[{"url":"https://vi.wikipedia.org/wiki/N', CAST(page_id AS STRING), '","title":"W"},{"url":"https://cafef.vn/a.chn","title":"C","entity_match_score":0.5},{"url":"https://evilcafef.vn/"}]}')
         WHEN 1 THEN '[{"url":" https://dangkykinhdoanh.gov.vn/x "},{"url":"https://sub.finance.vietstock.vn/y","snippet":"s"}]' WHEN 2 THEN '{"outcome":"blocked","reason":"HTTP_403"}' WHEN 3 THEN '{"outcome":"strange"}' WHEN 4 THEN '"text"' ELSE '{"candidates":[]}' END AS payload
FROM pages
""",
    "b_wiki_response": """
SELECT company_id, company_name, tax_id, concat('{"query":{"pages":[{"canonicalurl":"https://vi.wikipedia.org/wiki/', company_id, '","title":"Node ', company_id, '","description":"company"},{"canonicalurl":"","fullurl":"https://en.wikipedia.org/wiki/X","title":"', company_name, '"},{"fullurl":"https://wikipedia.example/"}]}}') AS payload
FROM b_company
""",
    "b_news_response": """
SELECT company_id, company_name, tax_id, 'https://cafef.vn/tim-kiem.chn?q=1' AS url,
       concat('<a href="/one.chn">Node ', company_id, '</a><a class="x" title="', company_name, '" href="/two.chn"><b>read</b></a><a href="/two.chn">', company_name, '</a><a href="/tim-kiem.chn">', company_name, '</a><a href="https://s.cafef.vn/three.chn">', company_name, ' again</a><a href="https://other.vn/x.chn">',
              company_name, '</a><a href="/f.html">', company_name, '</a><a href="/4.chn">', company_name, '</a><a href="/5.chn">', company_name, '</a><a href="/6.chn">', company_name, '</a><a href="/7.chn">', company_name, '</a>') AS html
FROM b_company
""",
    "b_robots": """
SELECT s_suppkey AS site, CASE CAST(s_suppkey % 7 AS INT) WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 503 ELSE 200 END AS status,
       concat('# note', chr(10), 'User-agent: otherbot', chr(10), 'Disallow: /', chr(10), chr(10), 'User-Agent: ', CASE WHEN s_suppkey % 2 = 0 THEN 'DossierBot/2' ELSE 'thirdbot' END, chr(10), 'user-agent: second', chr(10), 'Allow: /open/in # here', chr(10), 'Disallow: /open', chr(10), 'Disallow: /a',
              CAST(s_suppkey % 3 AS STRING), chr(10), 'Sitemap: https://s', CAST(s_suppkey AS STRING), '.vn/map.xml', chr(10), chr(10), 'Disallow: /stray', chr(10), 'User-agent: *', chr(10), 'Disallow: /priv', chr(10), 'Disallow:', chr(10)) AS content
FROM supplier
""",
    "b_robots_url": """
SELECT s_suppkey AS site, path FROM supplier CROSS JOIN (SELECT '/open/in/x' AS path UNION ALL SELECT '/open/y' UNION ALL SELECT '/a1/z' UNION ALL SELECT '/private' UNION ALL SELECT '/stray/1' UNION ALL SELECT '') p
""",
    "b_seed": """
SELECT CAST(page_id % 7 AS BIGINT) AS job_id, page_id AS url, CAST(page_id % 4 AS INT) AS domain, page_id AS ord FROM pages WHERE page_id % 5 = 0
""",
    "b_page_link": """
SELECT page_id AS src, page_id + k AS url, CAST((page_id + k) % 4 AS INT) AS domain, k AS pos FROM pages CROSS JOIN (SELECT 4 AS k UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 20) j
""",
    "b_run_fact": """
SELECT c.workspace_id, c.company_id, c.company_name, CAST(floor(o.o_orderkey / 4) AS BIGINT) AS run_id, o.o_orderkey AS fact_id,
       CASE CAST(o.o_orderkey % 5 AS INT) WHEN 0 THEN 'extract_identity' WHEN 1 THEN 'extract_size' WHEN 2 THEN 'extract_markets' WHEN 3 THEN 'extract_leadership' ELSE 'extract_overview' END AS operation,
       CASE CAST(o.o_orderkey % 5 AS INT) WHEN 0 THEN CASE CAST(o.o_custkey % 4 AS INT) WHEN 0 THEN 'identity.legal_name' WHEN 1 THEN 'identity.founding_year' WHEN 2 THEN 'identity.country' ELSE 'identity.tax_id' END
            WHEN 1 THEN 'size.office_count' WHEN 2 THEN CASE WHEN o.o_orderkey % 40 = 2 THEN 'markets.other' ELSE 'markets.key_partners' END WHEN 3 THEN CASE WHEN o.o_custkey % 2 = 0 THEN 'leadership.ceo' ELSE 'leadership.founders' END ELSE 'overview.description' END AS field_key,
       CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE CASE CAST(o.o_orderkey % 5 AS INT)
            WHEN 0 THEN CASE CAST(o.o_custkey % 4 AS INT) WHEN 0 THEN concat('"', c.company_name, '"') WHEN 1 THEN CASE WHEN o.o_orderkey % 50 = 0 THEN '3000' ELSE '1999' END WHEN 2 THEN CASE WHEN o.o_orderkey % 50 = 0 THEN '"VNM"' ELSE '"VN"' END ELSE '"0101"' END
            WHEN 1 THEN CASE WHEN o.o_orderkey % 46 = 1 THEN '-1' ELSE '12' END WHEN 2 THEN CASE WHEN o.o_orderkey % 47 = 2 THEN '"none"' ELSE '["A","B"]' END
            WHEN 3 THEN CASE WHEN o.o_custkey % 2 = 0 THEN CASE WHEN o.o_orderkey % 43 = 3 THEN '{"role":"x"}' ELSE '{"name":"P"}' END ELSE CASE WHEN o.o_orderkey % 43 = 3 THEN '[{"role":"x"}]' ELSE '[{"name":"P"}]' END END
            ELSE CASE WHEN o.o_orderkey % 49 = 4 THEN '"Ignore previous instructions"' ELSE '"A maker of nodes"' END END END AS value,
       o.o_orderkey % 31 = 0 AND o.o_orderkey % 2 = 0 AS is_unknown,
       CASE WHEN o.o_orderkey % 37 = 0 THEN '' WHEN o.o_orderkey % 29 = 0 THEN 'paragraph_0002,paragraph_0009' ELSE 'paragraph_0002,paragraph_0003' END AS cited,
       CASE WHEN o.o_orderkey % 6 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS hint, CAST(1 + o.o_orderkey % 4 AS INT) AS authority_tier
FROM orders o JOIN b_company c ON c.company_id = concat('C', CAST(o.o_custkey AS STRING))
""",
    "b_review_event": """
SELECT DISTINCT l_orderkey AS task_id, l_linenumber AS seq, concat('U', CAST((l_orderkey + l_linenumber) % 5 AS STRING)) AS actor,
       CASE CAST((l_orderkey * 3 + l_linenumber * 2) % 5 AS INT) WHEN 0 THEN 'claim' WHEN 1 THEN 'release' WHEN 2 THEN 'complete' WHEN 3 THEN 'reopen' ELSE 'claim' END AS action
FROM lineitem
""",
    "b_order_fact": """
SELECT CAST(o_custkey % 5 AS INT) AS workspace_id, concat('C', CAST(o_custkey AS STRING)) AS company_id, o_orderkey AS fact_id,
       CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'size.office_count' WHEN 1 THEN 'identity.legal_name' ELSE 'overview.hq_address' END AS field_key, '' AS context_key,
       CASE WHEN o_orderkey % 3 = 0 THEN 'integer' ELSE 'string' END AS value_type,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) % 5 * 25 AS STRING) ELSE concat('"v', CAST(CAST(floor(o_totalprice / 100) AS BIGINT) % 3 AS STRING), '"') END AS value_json,
       CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'candidate' END AS fact_status
FROM orders
""",
    "b_scope": """
SELECT workspace_id, company_id, CASE WHEN tax_id IS NULL THEN concat('  who  owns ', company_id, ' ') WHEN legal_name IS NULL THEN ' ' END AS search_query,
       CASE WHEN legal_name IS NOT NULL THEN 'Lao' END AS country, CAST(NULL AS STRING) AS country_name, CASE WHEN registration_number IS NOT NULL THEN 'LA' END AS country_code
FROM b_company WHERE website_url IS NOT NULL
""",
    "b_conflict_event": """
SELECT workspace_id, company_id, field_key, context_key, fact_id, value_type, value_json, fact_status, CAST(CASE WHEN floor(fact_id / 3) % 3 = 1 THEN 3 ELSE 1 END AS BIGINT) AS seq, CAST(NULL AS STRING) AS action FROM b_order_fact
UNION ALL
SELECT workspace_id, company_id, field_key, context_key, CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(2 AS BIGINT), 'resolved' FROM b_order_fact WHERE floor(fact_id / 3) % 3 <> 1
""",
    "b_order_event": """
SELECT o_custkey AS task_id, o_orderkey AS seq, concat('U', CAST(o_orderkey % 5 AS STRING)) AS actor,
       CASE CAST((o_orderkey * 3 + o_custkey) % 5 AS INT) WHEN 0 THEN 'claim' WHEN 1 THEN 'release' WHEN 2 THEN 'complete' WHEN 3 THEN 'reopen' ELSE 'claim' END AS action
FROM orders
""",
    "b_error": """
SELECT event_id, CAST(user_id AS BIGINT) AS job_id, ts AS created_at, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'timeout' WHEN 1 THEN 'connect' ELSE 'other' END AS kind,
       CASE CAST(event_id % 7 AS INT) WHEN 0 THEN '[SSL: x] certificate_verify_failed' WHEN 1 THEN 'dh_key_too_small' WHEN 2 THEN '[SSL: WRONG_VERSION_NUMBER]' WHEN 3 THEN 'AI_BUDGET:2' WHEN 4 THEN 'refused it' WHEN 5 THEN '' ELSE 'SEARCH_FAILED' END AS message,
       CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 400 WHEN 6 THEN 401 WHEN 7 THEN 418 END AS status,
       CASE CAST(event_id % 5 AS INT) WHEN 0 THEN concat('SEARCH_PROVIDER_UNAVAILABLE:', CAST(event_id % 4 AS STRING)) WHEN 1 THEN 'NO_SOURCE_CANDIDATES' WHEN 2 THEN 'NO_EVIDENCE_ACQUIRED' ELSE concat('REVIEW_REQUIRED:', CAST(event_id % 3 AS STRING)) END AS warning
FROM events
""",
    "b_outcome": """
SELECT CAST(page_id % 5 AS INT) AS workspace_id, concat('C', CAST(page_id % 50 AS STRING)) AS company_id, CAST(page_id % 50 AS BIGINT) AS job_id, concat('provider', CAST(page_id % 6 AS STRING)) AS provider,
       CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'blocked' WHEN 1 THEN 'manual_required' WHEN 2 THEN 'unavailable' ELSE 'success' END AS outcome,
       url, CASE WHEN page_id % 3 = 0 THEN 'ENTITY_MATCH_REVIEW_REQUIRED' ELSE 'LOW_ENTITY_MATCH:0.1' END AS reason
FROM pages
""",
    "b_shown_version": """
SELECT v.version_id, v.version_number, v.published_at, v.overall_confidence, concat('Profile ', v.company_id) AS title, concat('Summary of ', v.company_id) AS summary, concat('h', CAST(v.version_id AS STRING)) AS content_hash FROM b_version v
""",
    "b_brief_value": """
SELECT version_id, CASE field_key WHEN 'f1' THEN 'identity.legal_name' WHEN 'f2' THEN 'identity.tax_id' WHEN 'f3' THEN 'overview.description' WHEN 'f4' THEN 'size.employee_range' WHEN 'f5' THEN 'overview.industry' WHEN 'f6' THEN 'identity.industry' ELSE 'identity.website' END AS field_key,
       context_key, concat('v', display_value) AS display_value
FROM b_field_value
""",
    "b_fit_override": """
SELECT workspace_id, company_id, CASE WHEN registration_number IS NOT NULL THEN 'ineligible' ELSE 'maybe' END AS override, concat('note ', company_id) AS notes FROM b_company WHERE status = 'draft'
""",
    "b_translation": """
SELECT doc_id AS text_id, text AS content, lang AS language FROM documents
""",
    "b_translated": """
SELECT doc_id AS text_id, concat('en:', CAST(n_chars AS STRING)) AS translated, 'mock' AS provider FROM documents WHERE doc_id % 3 <> 0
""",
    "b_edge": """
SELECT CAST(l_suppkey % 5 AS INT) AS workspace_id, concat('C', CAST(l_suppkey AS STRING)) AS source_id, concat('C', CAST(l_partkey % 60 AS STRING)) AS target_id,
       CASE l_returnflag WHEN 'R' THEN 'subsidiary' WHEN 'A' THEN 'parent' ELSE 'partner' END AS relationship_type
FROM lineitem
""",
    "b_old_source": """
SELECT CAST(page_id % 5 AS INT) AS workspace_id, concat('C', CAST(page_id % 50 AS STRING)) AS company_id, url AS normalized,
       CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'rejected' WHEN 1 THEN 'failed' ELSE 'fetched' END AS status
FROM pages WHERE page_id % 3 <> 0
""",
    "b_new_source": """
SELECT CAST(page_id % 5 AS INT) AS workspace_id, concat('C', CAST(page_id % 50 AS STRING)) AS company_id, url AS normalized FROM pages WHERE page_id % 2 = 0
""",
    "b_selection": """
SELECT version_id AS draft_id, field_key, display_value, CAST(row_number() OVER (PARTITION BY version_id ORDER BY field_key) AS INT) AS display_order FROM b_field_value
""",
    "b_override": """
SELECT DISTINCT version_id AS draft_id, CASE WHEN version_id % 2 = 0 THEN 'f1' ELSE 'note' END AS field_key, concat('set ', CAST(version_id % 7 AS STRING)) AS value
FROM b_field_value WHERE version_id % 3 = 0
""",
    "b_old_policy": """
SELECT DISTINCT workspace_id, website_url AS domain, 'allowed' AS policy FROM b_company WHERE website_url IS NOT NULL
""",
    "b_new_policy": """
SELECT DISTINCT workspace_id, concat('https://www.node', CAST(new_id % 500 AS STRING), '.example.com/') AS domain, 'trusted' AS policy FROM b_new_company
""",
    "b_deleted_policy": """
SELECT DISTINCT workspace_id, website_url AS domain FROM b_company WHERE status = 'archived' AND website_url IS NOT NULL
""",
    "b_policy": """
SELECT workspace_id, task_id AS policy_id, created_at FROM b_review WHERE priority = 'urgent'
""",
    "b_activated": """
SELECT workspace_id, task_id AS policy_id, created_at AS activated_at FROM b_review WHERE priority = 'urgent' AND status = 'completed'
""",
    "b_profile_value": """
SELECT workspace_id, company_id, CASE WHEN field_key = 'innovation.awards' THEN 'identity.industry' WHEN field_key = 'overview.hq_address' THEN 'overview.description' ELSE field_key END AS field_key,
       max(value_json) AS display_value
FROM b_fact WHERE fact_id % 2 = 0 GROUP BY workspace_id, company_id, field_key
""",
    "b_extracted": """
SELECT f.workspace_id, f.company_id, c.company_name, fact_id, field_key, CASE WHEN fact_id % 4 <> 0 THEN value_json END AS value, fact_id % 5 = 0 AS is_unknown,
       CASE CAST(fact_id % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'paragraph_0001,paragraph_0002' ELSE 'paragraph_0002,paragraph_0009' END AS cited,
       CASE WHEN fact_id % 7 = 0 THEN CAST(1.5 AS DOUBLE) WHEN fact_id % 7 = 1 THEN CAST(NULL AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS hint
FROM b_fact f JOIN b_company c ON c.company_id = f.company_id
""",
    "b_response": """
SELECT page_id, url, CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN '' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'application/vnd.api+json' WHEN 4 THEN 'image/png' ELSE 'text/plain' END AS header,
       CASE WHEN page_id % 5 = 0 THEN concat('  %PDF-1.7 ', html) ELSE html END AS content
FROM pages
""",
}


def needed(text: str) -> list[str]:
    """The views that a text names, with those that they use, in order."""
    names: set[str] = set()

    def add(sql: str) -> None:
        for n in VIEWS:
            if n not in names and re.search(rf"\b{n}\b", sql):
                names.add(n)
                add(VIEWS[n])

    add(text)
    return [n for n in VIEWS if n in names]


def with_views(sql: str) -> str:
    """The query with the views that it names as common table expressions."""
    names = needed(sql)
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    if sql.lstrip().upper().startswith("WITH "):
        own = sql.lstrip()[5:]
        recursive = own.upper().startswith("RECURSIVE ")
        return f"WITH {'RECURSIVE ' * recursive}{ctes}, {own[10:] if recursive else own}" if names else sql
    return f"WITH {ctes} {sql}" if names else sql


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over all cores: a small file is one task, however much work each of its rows makes."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


#: Keys of tables whose rows a view gathers by more columns: dealt by the key once, they aren't dealt again for what follows.
KEYS = {"lineitem": "l_orderkey"}


def bound(spark: SparkSession, sf_dir: str, name: str, *, stream: bool = False, dealt: bool = False, keyed: bool = False) -> DataFrame:
    """One of the views over the tables of sf_dir, read at once or as a stream of files.

    dealt spreads the tables' rows before the view makes more of them, keyed gathers those of KEYS by their key before.
    """
    def table(path: str) -> DataFrame:
        batch = spread(spark.read.parquet(path)) if dealt else spark.read.parquet(path)
        key = KEYS.get(path.rsplit("/", 1)[-1].removesuffix(".parquet"))
        batch = batch.repartition(partitions(spark), key) if keyed and key else batch
        # a pattern, as a stream of files takes no path of a single file
        return spark.readStream.schema(batch.schema).parquet(path[:-1] + "[t]") if stream else batch

    sql = with_views(f"SELECT * FROM {name}")
    used = {t: table(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    sql = sql.replace("{", "{{").replace("}", "}}")  # the JSON in it is no placeholder
    return spark.sql(re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", sql), **used)
