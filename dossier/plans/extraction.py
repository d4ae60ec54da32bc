"""Queries over extracted facts, responses and field values, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import url
from ..operators import extraction, logs
from .profiles import _name, _pages
from .registry import _PART, _in, over, query

_SCHEME, _AUTH = f"lower({_PART.format(2)})", _PART.format(4)
_HOSTNAME = rf"regexp_replace(lower(regexp_replace({_AUTH}, ':[0-9]*$', '')), '\.+$', '')"
_PORT = f"regexp_extract({_AUTH}, ':([0-9]+)$', 1)"
_PATH = f"regexp_replace(regexp_replace({_PART.format(5)}, ';[^/]*$', ''), '/+$', '')"
_QUERY = (
    f"array_to_string(list_transform(list_filter(string_split({_PART.format(7)}, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {_in(url.TRACKING_KEYS)} AND NOT starts_with(lower(split_part(p, '=', 1)), '{url.TRACKING_PREFIX}')),"
    " lambda p: CASE WHEN contains(p, '=') THEN p ELSE concat(p, '=') END), '&')"
)
_CANONICAL = (
    f"CASE WHEN {_SCHEME} IN ('http', 'https') AND {_HOSTNAME} <> '' AND NOT contains({_AUTH}, '@') THEN concat({_SCHEME}, '://', {_HOSTNAME},"
    f" CASE WHEN {_PORT} = '' OR ({_SCHEME} = 'http' AND {_PORT} = '80') OR ({_SCHEME} = 'https' AND {_PORT} = '443') THEN '' ELSE concat(':', {_PORT}) END, {_PATH},"
    f" CASE WHEN {_QUERY} = '' THEN '' ELSE concat('?', {_QUERY}) END) ELSE '' END"
)


@query("b2_canonical_urls", f"SELECT page_id, {_CANONICAL} AS canonical FROM (SELECT page_id, trim(coalesce(concat(url, CASE CAST(page_id % 3 AS INT) WHEN 0 THEN '/;v=1?utm_source=a&FBCLID=1&b&c=2#x' ELSE '' END), '')) AS url FROM pages)")
def canonical_urls(s, d):
    tracked = F.concat("url", F.when(F.expr("page_id % 3 = 0"), "/;v=1?utm_source=a&FBCLID=1&b&c=2#x").otherwise(""))
    return _pages(s, d, tracked.alias("url")).select("page_id", url.canonical_url(F.col("url")).alias("canonical"))


_URL_PATH = f"lower({_PART.format(5)})"
_TYPED = f"SELECT *, CASE WHEN said <> '' THEN said WHEN suffix(p, '.pdf') THEN 'application/pdf' WHEN suffix(p, '.json') OR suffix(p, '.jsonld') THEN 'application/json' ELSE 'text/html' END AS content_type FROM (SELECT page_id, content, lower(trim(split_part(header, ';', 1))) AS said, {_URL_PATH} AS p FROM b_response)"
_KNOWN = f"(content_type IN {_in(url.CONTENT_TYPES)} OR suffix(content_type, '+json') OR suffix(content_type, '+xml'))"
_SIGNED = "regexp_matches(coalesce(content, ''), '^[\\x09-\\x0D ]*%PDF')"


def _checked(r):
    r = r.withColumn("content_type", url.content_type(F.col("header"), F.col("url")))
    return r.select("page_id", "content_type", url.content_problem(F.col("content_type"), F.col("url"), F.col("content")).alias("problem"))


over("b11_content_types", "b_response", f"SELECT page_id, content_type, CASE WHEN NOT {_KNOWN} THEN 'UNSUPPORTED_TYPE' WHEN suffix(p, '.pdf') AND content_type <> 'application/pdf' THEN 'PDF_EXTENSION' WHEN {_SIGNED} AND content_type <> 'application/pdf' THEN 'PDF_SIGNATURE' WHEN content_type = 'application/pdf' AND NOT {_SIGNED} THEN 'NO_PDF_SIGNATURE' END AS problem FROM ({_TYPED})", _checked)

_ERRORS = "concat_ws(',', CASE WHEN is_unknown AND value IS NOT NULL THEN 'UNKNOWN_WITH_VALUE' END, CASE WHEN NOT is_unknown AND cited = '' THEN 'NO_EVIDENCE' END, CASE WHEN NOT is_unknown AND value IS NULL THEN 'NO_VALUE' END, CASE WHEN hint < 0 OR hint > 1 THEN 'HINT_OUT_OF_RANGE' END)"


def _blocks():
    return F.filter(F.split("cited", ","), lambda b: b != "")


over("i1_check_extracted", "b_extracted", f"SELECT fact_id, {_ERRORS} AS errors FROM b_extracted", lambda e: e.select("fact_id", F.array_join(extraction.fact_errors(F.col("value"), F.col("is_unknown"), _blocks(), F.col("hint")), ",").alias("errors")))
over("i3_missing_evidence", "b_extracted b_label_block", "SELECT fact_id, block_key FROM (SELECT DISTINCT workspace_id, company_id, fact_id, unnest(string_split(cited, ',')) AS block_key FROM b_extracted) ANTI JOIN b_label_block USING (workspace_id, company_id, block_key) WHERE block_key <> ''", lambda e, b: extraction.missing_evidence(e.withColumn("cited", _blocks()), b))

_LONG = "list_filter(string_split(trim(regexp_replace(lower(company_name), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 2)"
over("i4_name_mismatch", "b_extracted", f"SELECT fact_id, len({_LONG}) > 0 AND len(list_filter({_LONG}, lambda w: contains(lower(value), w))) = 0 AS mismatch FROM b_extracted WHERE field_key = 'identity.legal_name' AND value IS NOT NULL", lambda e: e.where("field_key = 'identity.legal_name' AND value IS NOT NULL").select("fact_id", extraction.name_mismatch(F.col("company_name"), F.col("value")).alias("mismatch")))


def _scored(new, companies):
    other = companies.select(F.col("company_id"), F.col("company_name").alias("other_name"), F.col("tax_id").alias("other_tax_id"), F.col("registration_number").alias("other_registration_number"))
    return extraction.match_scores(new.withColumn("company_id", F.concat(F.lit("C"), F.col("new_id").cast("string"))).join(other, "company_id"))


_OWN, _OTHER = _name("n.company_name"), _name("c.company_name")
_CASES = [("n.tax_id <> '' AND n.tax_id = c.tax_id", 1.0, "EXACT_TAX_ID_MATCH"), ("n.registration_number <> '' AND n.registration_number = c.registration_number", 1.0, "EXACT_REGISTRATION_NUMBER_MATCH"), (f"{_OWN} <> '' AND {_OWN} = {_OTHER}", 0.85, "EXACT_NORMALIZED_NAME_MATCH"), (f"{_OWN} <> '' AND (contains({_OWN}, {_OTHER}) OR contains({_OTHER}, {_OWN}))", 0.65, "PARTIAL_NAME_SUBSTRING_MATCH")]
over("g1_match_scores", "b_new_company b_company", "SELECT new_id, company_id, CAST(CASE " + " ".join(f"WHEN {c} THEN {s}" for c, s, _ in _CASES) + " ELSE 0.0 END AS DOUBLE) AS score, CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in _CASES) + " ELSE 'NO_MATCH' END AS reason FROM b_new_company n JOIN b_company c ON c.company_id = concat('C', CAST(new_id AS STRING))", _scored)

over("e8_search_outcome", "b_attempt", (
    "SELECT source_id, CASE WHEN ok = 0 THEN 'unavailable' WHEN results = 0 THEN 'not_found' ELSE 'success' END AS outcome, CASE WHEN ok = 0 THEN 'NO_QUERY_SUCCEEDED' WHEN results = 0 THEN 'NO_RESULTS' ELSE concat('QUERIES:', ok, ';RESULTS:', results) END AS reason"
    " FROM (SELECT source_id, count(*) FILTER (outcome_code = 'success') AS ok, CAST(sum(CASE WHEN outcome_code = 'success' THEN attempt_id % 2 ELSE 0 END) AS BIGINT) AS results FROM b_attempt GROUP BY source_id)"
), lambda a: extraction.search_outcome(a.select("source_id", (F.col("outcome_code") == "success").alias("succeeded"), F.expr("CASE WHEN outcome_code = 'success' THEN attempt_id % 2 ELSE 0 END").alias("n_results")), "source_id"))

_HAS = lambda k: f"max(CASE WHEN field_key = '{k}' AND display_value <> '' THEN display_value END)"
over("k7_grounded_summary", "b_company b_profile_value", (
    "SELECT c.workspace_id, c.company_id, concat_ws(' ', concat(coalesce(legal, company_name), ' is a verified company profile.'), 'Industry: ' || coalesce(i1, i2) || '.', coalesce(about, 'Verified commercial entity profile.')) AS summary"
    f" FROM b_company c LEFT JOIN (SELECT workspace_id, company_id, {_HAS('identity.legal_name')} AS legal, {_HAS('overview.description')} AS about, {_HAS('identity.industry')} AS i1, {_HAS('overview.industry')} AS i2 FROM b_profile_value GROUP BY ALL) v ON v.workspace_id = c.workspace_id AND v.company_id = c.company_id"
), extraction.grounded_summary)


_FIRST_BY = lambda k: f"n.{k} <> '' AND c.company_id = (SELECT min(f.company_id) FROM b_company f WHERE f.workspace_id = n.workspace_id AND f.{k} = n.{k})"
over("g2_duplicate_candidates", "b_new_company b_company", (
    "SELECT new_id, company_id, CAST(CASE " + " ".join(f"WHEN {c} THEN {s}" for c, s, _ in _CASES) + " END AS DOUBLE) AS score, CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in _CASES) + " END AS reason FROM b_new_company n JOIN b_company c ON c.workspace_id = n.workspace_id"
    f" WHERE ({_FIRST_BY('tax_id')}) OR ({_FIRST_BY('registration_number')}) OR (c.status <> 'merged' AND {_OWN} <> '' AND {_OTHER} <> '' AND (contains({_OWN}, {_OTHER}) OR contains({_OTHER}, {_OWN})))"
), lambda n, c: logs.duplicate_candidates(n, c).drop("workspace_id"), dealt=True)
