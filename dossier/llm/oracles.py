"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .common import SPACE_CLASS
from .license_scan import PHRASES
from .license_texts import TEMPLATES
from .quality import BOILERPLATE, SYMBOLS

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SP = SPACE_CLASS

_LENGTHS = "list_sum(list_transform({}, lambda x: length(x)))"
#: A mark between blanks, each blank doubled so that neighbouring places don't share one.
_PLACES = rf"len(regexp_extract_all(regexp_replace(x, '([{_SP}])', '\1\1', 'g'), '[{_SP}][|»›•·>][{_SP}]'))"
_WORDS_IN_LINE = rf"len(regexp_extract_all(x, '[^{_SP}]+'))"
_BROKEN = (
    f"(NOT regexp_matches(x, '[.!?…;:]') AND {_WORDS_IN_LINE} >= 10) OR (upper(x) = x AND lower(x) <> x AND {_WORDS_IN_LINE} >= 5)"
    rf" OR length(x) - length(regexp_replace(x, '!!|\?\?', '', 'g')) >= 6 OR {_PLACES} >= 3"
    f" OR length(regexp_replace(x, '{SYMBOLS}', '', 'g')) * 10 <= length(x) * 9 OR regexp_matches(x, '(?i){'|'.join(BOILERPLATE)}')"
)

_folded = lambda c: _FOLDED.replace("text", c)
_TEMPLATES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
_PHRASES = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())

_part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_leaf = lambda n="n_chars": f"sha256({' || '.join(_part(c) for c in ('doc_id', 'source', 'lang', n, 'text'))})"
#: The CRC-32 of the decimal doc_id, bit by bit.
_BIT = "lambda x, _: xor(x >> 1, (x & 1) * 3988292384)"
_BYTE = f"lambda z, c: list_reduce(list_concat([xor(z, c)], CAST(range(8) AS BIGINT[])), {_BIT})"
_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
_CRC32 = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_BYTES}), {_BYTE}), 4294967295)"

ORACLE_SQL = {
    "op2_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(t, '[^{_SP}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SP}]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM s WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce({_LENGTHS.format('w')}, 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, CAST(coalesce({_LENGTHS.format('lines')}, 0) AS BIGINT) AS n_chars_judged,
  CAST(coalesce({_LENGTHS.format(f'list_filter(lines, lambda x: {_BROKEN})')}, 0) AS BIGINT) AS n_chars_lost FROM s LEFT JOIN rep USING (doc_id))
SELECT *, NOT base_failed AND n_chars_lost * 100 <= n_chars_judged * 50 AS kept FROM (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM c)
""",
    "op3_line_dedup": f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT DISTINCT doc_id, i, regexp_extract_all(l[i], '[^{_SP}]+') AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d WHERE text IS NOT NULL)),
k AS (SELECT (coalesce(doc_id, -1), i) AS place, doc_id, i, w, array_to_string(w, ' ') AS line FROM x WHERE len(w) > 0),
f AS (SELECT line, any_value(w) AS w, min(place) AS place FROM k GROUP BY line),
v AS (SELECT line, place, n, j, array_to_string(list_concat(w[1:j - 1], w[j + 1:]), ' ') AS cut FROM (SELECT *, len(w) AS n, unnest(range(1, len(w) + 1)) AS j FROM f WHERE len(w) >= 5)),
replaced AS (SELECT n, j, cut, min(place) AS least FROM v GROUP BY n, j, cut),
longer AS (SELECT cut, min(place) AS least FROM v GROUP BY cut),
near AS (SELECT line FROM v JOIN replaced USING (n, j, cut) WHERE least < place
  UNION SELECT f.line FROM f JOIN longer ON cut = f.line WHERE len(w) >= 5 AND least < place
  UNION SELECT v.line FROM v JOIN f ON f.line = v.cut WHERE len(f.w) >= 5 AND f.place < v.place),
gone AS (SELECT doc_id, list(i) AS lines FROM k JOIN (SELECT line, place AS first_place FROM f) USING (line) WHERE place <> first_place OR line IN (SELECT line FROM near) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN lines IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(lines, i)), chr(10)) END AS text,
  CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN gone ON gone.doc_id IS NOT DISTINCT FROM d.doc_id
""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item, w, least(10, len(w)) AS n FROM (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS w FROM benchmark WHERE item_id IS NOT NULL)),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b WHERE n > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, gram)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
met AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN met USING (doc_id)
""",
    "op9_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS newest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND payload_bytes >= 1000
""",
    "op10_license_scan": f"""
WITH d AS (SELECT doc_id AS doc, {_folded('text')} AS w FROM documents),
t AS (SELECT template, label, {_folded('body')} AS w FROM (VALUES {_TEMPLATES}) x(template, label, body)),
tg AS (SELECT template, label, len(w) AS n, i AS spot, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM t)),
dg AS (SELECT doc, i AS pos, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT doc, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
votes AS (SELECT DISTINCT doc, template, label, n, pos - spot AS diagonal, pos - 1 AS pos FROM dg JOIN tg USING (gram)),
a AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc, template ORDER BY diagonal) <= 3 THEN 0 ELSE 1 END AS fresh FROM votes),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY doc, template ORDER BY diagonal) AS band FROM a),
c AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc, template, band ORDER BY pos), 9) AS step FROM b),
e AS (SELECT *, sum(CASE WHEN step > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, template, band ORDER BY pos) AS span FROM c),
f AS (SELECT doc, template, label, n, min(pos) AS first, max(pos) + 2 AS last, sum(least(step, 3)) AS covered FROM e GROUP BY doc, template, label, n, band, span),
g AS (SELECT *, CAST(covered AS DOUBLE) / greatest(last - first + 1, least(n, 12)) AS score FROM f),
h AS (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY doc ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM g WHERE score >= 0.75),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY first) AS island FROM h),
best AS (SELECT doc, label FROM k QUALIFY rank() OVER (PARTITION BY doc, island ORDER BY score DESC, CAST(covered AS DOUBLE) / n DESC, covered DESC) = 1),
top AS (SELECT doc, max(score) AS score FROM g GROUP BY doc),
p AS (SELECT * FROM (VALUES {_PHRASES}) x(phrase, label, n)),
places AS (SELECT doc, i - 1 AS place, label FROM (SELECT doc, w, phrase, label, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, p) WHERE array_to_string(w[i:i + n - 1], ' ') = phrase),
base AS (SELECT doc, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM places GROUP BY doc),
own AS (SELECT doc, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc),
every AS (SELECT doc, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc, label FROM places UNION ALL SELECT doc, label FROM best) GROUP BY doc)
SELECT doc AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc) LEFT JOIN own USING (doc) LEFT JOIN every USING (doc) LEFT JOIN top USING (doc)
""",
    "op11_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^{_SP}]+')), 0) AS BIGINT) AS size,
  CAST('0x' || md5(concat_ws(':', '0', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(source, '-'), coalesce(text, '')))[1:15] AS BIGINT) AS h FROM documents),
s AS (SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
t AS (SELECT *, cap / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
u AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio RANGE UNBOUNDED PRECEDING EXCLUDE GROUP), 0)) / sum(weight) OVER (ORDER BY ratio RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > ratio AS above FROM t),
v AS (SELECT *, CASE WHEN above THEN cap ELSE least(cap, (total - coalesce(sum(cap) FILTER (above) OVER (), 0)) * weight / sum(weight) FILTER (NOT above) OVER ()) END AS target FROM u),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM v),
x AS (SELECT doc_id, size, source_size, target, passes, target - passes * source_size AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN before + size / 2.0 <= rest AND rest > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
""",
    "op12_merkle": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf()} AS leaf, CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t(level, lang, pos, n, digest) AS (SELECT 0, lang, pos, n, leaf FROM p
  UNION ALL SELECT level + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY level, lang, pos // 2, n),
s AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, pos, n, digest) AS (SELECT 0, pos, n, subroot FROM s
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
a AS (SELECT lang, leaf, pos, unnest(range(40)) AS level, n FROM p),
b AS (SELECT lang, pos, unnest(range(40)) AS level, n FROM s),
x AS (SELECT a.lang, a.pos, a.level, CASE WHEN (a.pos >> a.level) % 2 = 1 THEN 'b' ELSE 'a' END || coalesce(t.digest, '') AS step
  FROM a LEFT JOIN t ON t.lang IS NOT DISTINCT FROM a.lang AND t.level = a.level AND t.pos = xor(a.pos >> a.level, 1) WHERE (1::BIGINT << a.level) < a.n),
y AS (SELECT b.lang, b.level, CASE WHEN (b.pos >> b.level) % 2 = 1 THEN 'b' ELSE 'a' END || coalesce(u.digest, '') AS step
  FROM b LEFT JOIN u ON u.level = b.level AND u.pos = xor(b.pos >> b.level, 1) WHERE (1::BIGINT << b.level) < b.n),
own AS (SELECT lang, pos, list(step ORDER BY level) AS steps FROM x GROUP BY lang, pos),
above AS (SELECT lang, list(step ORDER BY level) AS steps FROM y GROUP BY lang),
q AS (SELECT p.*, subroot, list_concat(coalesce(own.steps, []), coalesce(above.steps, [])) AS steps FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN own ON own.lang IS NOT DISTINCT FROM p.lang AND own.pos = p.pos LEFT JOIN above ON above.lang IS NOT DISTINCT FROM p.lang),
r AS (SELECT doc_id, leaf, subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256,
  list_reduce(list_concat([coalesce(changed, leaf)], steps), lambda z, x: CASE WHEN x[1] = 'b' THEN sha256(x[2:] || z) ELSE sha256(z || x[2:]) END) AS folded_root FROM q)
SELECT *, folded_root = root AS verified FROM r
""",
}
