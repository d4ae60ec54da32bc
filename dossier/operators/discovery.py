"""Payloads of searches and trusted providers, candidates for sources, robots rules, and the bounded frontier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranking, text, url
from ..sources.scratch import new_folder, written
from . import blocks
from .companies import PRIORITY

#: Providers that are trusted, with the tier of their word on each field (fixed values).
PROVIDERS = (
    ("dangkykinhdoanh", "dangkykinhdoanh.gov.vn", "government_registry", "registry", 1, {"identity.legal_name": 1, "identity.registration_number": 1, "identity.tax_id": 2, "*": 2}),
    ("tracuunnt_gdt", "tracuunnt.gdt.gov.vn", "government_tax_registry", "registry", 1, {"identity.tax_id": 1, "identity.legal_name": 2, "identity.registration_number": 2, "*": 2}),
    ("wikipedia", "wikipedia.org", "reference_encyclopedia", "web_page", 3, {"overview.description": 3, "identity.aliases": 3, "identity.legal_name": 4, "identity.tax_id": 4, "identity.registration_number": 4, "*": 3}),
    ("vietstock", "finance.vietstock.vn", "financial_database", "news", 3, {"leadership.members": 3, "ownership.structure": 3, "finance.revenue": 3, "identity.legal_name": 4, "identity.tax_id": 4, "identity.registration_number": 4, "*": 3}),
    ("cafef", "cafef.vn", "financial_media_database", "news", 3, {"leadership.members": 3, "ownership.structure": 3, "finance.revenue": 3, "identity.legal_name": 4, "identity.tax_id": 4, "identity.registration_number": 4, "*": 3}),
)

#: What a provider's lookup may end in (fixed values).
OUTCOMES = ("success", "not_found", "blocked", "unavailable", "manual_required")

#: What is searched for in each section, by language (fixed values).
SECTIONS = {
    "official": {"en": "official company website", "vi": "website chính thức công ty"},
    "about_company_history": {"en": "about company history", "vi": "giới thiệu công ty lịch sử"},
    "products_services_solutions": {"en": "products services solutions", "vi": "sản phẩm dịch vụ giải pháp"},
    "leadership": {"en": "leadership management", "vi": "lãnh đạo ban điều hành"},
    "markets_customers_partners": {"en": "markets customers partners", "vi": "thị trường khách hàng đối tác"},
    "investor_relations": {"en": "investor relations", "vi": "quan hệ nhà đầu tư"},
    "annual_reports": {"en": "annual reports", "vi": "báo cáo thường niên"},
    "news": {"en": "company news", "vi": "tin tức công ty"},
    "careers": {"en": "careers recruitment", "vi": "tuyển dụng việc làm"},
    "contact": {"en": "contact headquarters", "vi": "liên hệ trụ sở"},
}

LOW_MATCH, SEARCH_MATCH = 0.3, 0.75


def registry(spark: SparkSession) -> DataFrame:
    """provider, domain, provider_type, source_type, authority_tier, authority_by_field of the known providers."""
    return spark.createDataFrame(list(PROVIDERS), "provider string, domain string, provider_type string, source_type string, authority_tier int, authority_by_field map<string,int>")


def register(known: DataFrame, more: DataFrame) -> DataFrame:
    """The registry with further providers; one of the same key is replaced."""
    return known.join(more.select("provider"), "provider", "left_anti").unionByName(more)


def search_items(payloads: DataFrame) -> DataFrame:
    """query_id, rank, url, title, snippet, domain of the results in search payloads (query_id, payload).

    Results without an http address, a host or a title go; ranks stay those of the payload.
    """
    items = F.from_json("payload", "items array<struct<link:string,title:string,snippet:string>>").getField("items")
    rows = payloads.select("query_id", F.posexplode(items).alias("at", "item"))
    clean = lambda c: text.clean_text(F.coalesce(F.col(f"item.{c}"), F.lit("")))
    rows = rows.select("query_id", (F.col("at") + 1).alias("rank"), F.trim(F.coalesce("item.link", F.lit(""))).alias("url"), clean("title").alias("title"), clean("snippet").alias("snippet"))
    rows = rows.withColumn("domain", url.normalize_domain(F.col("url")))
    return rows.where(F.lower(url.part(F.col("url"), 2)).isin("http", "https") & (F.col("domain") != "") & (F.col("title") != ""))


def _within(u: Column, domain: Column) -> Column:
    host = F.regexp_replace(F.regexp_extract(F.lower(url.part(F.trim(u), 4)), r"^(?:[^@]*@)?([^:]*)", 1), r"\.+$", "")
    return F.lower(url.part(F.trim(u), 2)).isin("http", "https") & ((host == domain) | host.endswith(F.concat(F.lit("."), domain)))


def provider_items(payloads: DataFrame, providers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and outcomes from lookups (lookup_id, provider, payload): an object with outcome and candidates, or a list.

    Outcomes beyond the vocabulary become unavailable; candidates outside the provider's domain go, and a success without
    any left is not found.
    """
    item = "struct<url:string,title:string,snippet:string,entity_match_score:double>"
    whole = F.from_json("payload", f"outcome string, reason string, candidates array<{item}>")
    listed = F.from_json("payload", f"array<{item}>")
    is_list = F.trim("payload").startswith("[")
    is_object = F.trim("payload").startswith("{")
    rows = payloads.join(providers, "provider").withColumn("__whole", whole)
    said = F.when(is_list, "success").when(is_object, F.lower(F.trim(F.coalesce("__whole.outcome", F.lit("success"))))).otherwise("unavailable")
    known = said.isin(*OUTCOMES)
    reason = F.when(~is_list & ~is_object, "INVALID_STRUCTURED_PROVIDER_RESULT").when(~known, "INVALID_PROVIDER_OUTCOME").otherwise(F.coalesce("__whole.reason", F.lit("")))
    rows = rows.withColumn("outcome", F.when(known, said).otherwise("unavailable")).withColumn("reason", reason)
    rows = rows.withColumn("items", F.filter(F.when(is_list, listed).otherwise(F.col("__whole.candidates")), lambda x: _within(x["url"], F.col("domain"))))
    rows = rows.withColumn("items", F.when(F.col("outcome") == "success", F.col("items")))
    found = F.coalesce(F.size("items"), F.lit(0)) > 0
    none = (F.col("outcome") == "success") & ~found
    outcomes = rows.select("lookup_id", "provider", F.when(none, "not_found").otherwise(F.col("outcome")).alias("outcome"), F.when(none & (F.col("reason") == ""), "NO_ALLOWED_MATCHING_SOURCE").otherwise(F.col("reason")).alias("reason"))
    items = rows.select("lookup_id", "provider", "source_type", "authority_tier", "authority_by_field", F.posexplode("items").alias("at", "item"))
    return items.select("lookup_id", "provider", (F.col("at") + 1).alias("rank"), F.trim("item.url").alias("url"), F.coalesce("item.title", F.lit("")).alias("title"), F.coalesce("item.snippet", F.lit("")).alias("snippet"), "item.entity_match_score", "source_type", "authority_tier", "authority_by_field"), outcomes


def wiki_items(responses: DataFrame, domain: str = "wikipedia.org") -> DataFrame:
    """company_id, rank, url, title, snippet, entity_match_score of the pages in encyclopedia responses (company_id, company_name, tax_id, payload)."""
    pages = F.from_json("payload", "query struct<pages:array<struct<canonicalurl:string,fullurl:string,title:string,description:string>>>").getField("query").getField("pages")
    rows = responses.select("company_id", "company_name", "tax_id", F.posexplode(pages).alias("at", "p"))
    u = F.trim(F.coalesce(F.nullif("p.canonicalurl", F.lit("")), "p.fullurl", F.lit("")))
    plain = lambda c: F.trim(F.coalesce(F.col(f"p.{c}"), F.lit("")))
    rows = rows.select("company_id", "company_name", "tax_id", (F.col("at") + 1).alias("rank"), u.alias("url"), plain("title").alias("title"), plain("description").alias("snippet"))
    score = text.entity_match(F.col("company_name"), F.col("tax_id"), F.concat_ws(" ", "title", "snippet"))
    return rows.where(_within(F.col("url"), F.lit(domain))).select("company_id", "rank", "url", "title", "snippet", score.alias("entity_match_score"))


def news_items(responses: DataFrame, domain: str = "cafef.vn", most: int = 5) -> DataFrame:
    """company_id, place, url, title, entity_match_score: the first articles in the answers of a news search.

    responses has company_id, company_name, tax_id, url and html. Articles end in .chn, stay within the domain, match the
    company by 0.3 or more, and count once.
    """
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a\s*>"), 0)
    rows = responses.select("company_id", "company_name", "tax_id", F.col("url").alias("__base"), F.posexplode(anchors).alias("at", "anchor"))
    href = F.trim(F.regexp_extract("anchor", r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']", 1))
    title = F.regexp_extract("anchor", r"(?is)^<a\s[^>]*?title\s*=\s*[\"']([^\"']*)[\"']", 1)
    label = text.clean_text(F.concat_ws(" ", title, F.regexp_replace("anchor", "<[^>]*>", "")))
    # as a generator's rows, urls and titles are worked out once; as columns, filters would repeat them for each place that names them
    rows = rows.select("company_id", "company_name", "tax_id", "at", F.inline(F.array(F.struct(url.resolve(href, F.col("__base")).alias("url"), label.alias("title")))))
    path = F.lower(url.part(F.col("url"), 5))
    rows = rows.where(path.endswith(".chn") & (path != "/tim-kiem.chn") & _within(F.col("url"), F.lit(domain)))
    rows = rows.withColumn("score", text.entity_match(F.col("company_name"), F.col("tax_id"), F.col("title"))).where(F.col("score") >= LOW_MATCH)
    rows = rows.groupBy("company_id", "url").agg(F.min_by(F.struct("title", "score"), "at").alias("f"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("at"))
    return rows.select("company_id", place.alias("place"), "url", "f.title", F.col("f.score").alias("entity_match_score")).where(F.col("place") <= most)


def with_scheme(domain: Column) -> Column:
    """An address from a verified domain, which may be given as one."""
    bare = F.trim(domain)
    return F.when(F.contains(bare, F.lit("://")), bare).otherwise(F.concat(F.lit("https://"), bare))


def known_candidates(companies: DataFrame, domains: DataFrame, manual: DataFrame, history: DataFrame) -> dict[str, DataFrame]:
    """Candidates that somebody has stated: companies' websites, verified domains (domain), urls by hand, sources used before.

    All have workspace_id and company_id, the last two url; an ord of theirs stays.
    """
    own = lambda rows, u: rows.withColumn("url", u).where("url <> ''").select("workspace_id", "company_id", "url", F.lit(True).alias("provided"), (F.col("ord") if "ord" in rows.columns else F.lit(0)).alias("ord"))
    return {
        "official_website": own(companies, F.col("website_url")), "verified_official_domain": own(domains, with_scheme(F.col("domain"))),
        "manual_url": own(manual, F.col("url")), "source_history": own(history, F.col("url")),
    }


def found_candidates(sitemaps: DataFrame, pages: DataFrame, searches: DataFrame, lookups: DataFrame, providers: DataFrame, *, per_sitemap: int = 100) -> dict[str, DataFrame]:
    """Candidates that captured documents lead to: pages of sitemaps, links within a page's site, search results, providers' answers.

    Each has company_id: sitemaps with sitemap_url and content, pages with page_id, url and html, searches with query_id and
    payload, lookups with lookup_id, provider and payload. Nested sitemaps are no candidates.
    """
    of = lambda rows, key: rows.select(key, "company_id").distinct()
    own = lambda rows, u, ord_, *more: rows.select("company_id", u.alias("url"), F.lit(False).alias("provided"), ord_.alias("ord"), *more)
    named = blocks.sitemap_urls(sitemaps.select("sitemap_url", "content").distinct(), per_sitemap).where("NOT is_index").join(of(sitemaps, "sitemap_url"), "sitemap_url")
    links = blocks.page_links(pages).join(pages.select("page_id", "company_id", F.col("url").alias("__page")), "page_id")
    links = links.where((F.col("resolved") != "") & (url.normalize_domain(F.col("resolved")) == url.normalize_domain(F.col("__page"))))
    results = search_items(searches).join(of(searches, "query_id"), "query_id")
    answers = provider_items(lookups, providers)[0].join(of(lookups, "lookup_id"), "lookup_id")
    return {
        "sitemap": own(named, F.col("location"), F.col("pos")), "internal_link": own(links, F.col("resolved"), F.col("pos"), F.col("label").alias("title")), "search_provider": own(results, F.col("url"), F.col("rank"), "title", "snippet"),
        "trusted_provider": own(answers, F.col("url"), F.col("rank"), "title", "snippet", "entity_match_score", "source_type", "authority_tier", "authority_by_field"),
    }


def union_candidates(parts: dict[str, DataFrame]) -> DataFrame:
    """Candidates of all origins (name: rows) as one table with discovered_via and ord, the origin's place and then the row's own ord.

    Columns that an origin lacks are null. Origins without an ord of their own are ordered by url.
    """
    rows = [df.withColumn("discovered_via", F.lit(name)).withColumn("ord", F.struct(F.lit(i).alias("origin"), (F.col("ord") if "ord" in df.columns else F.lit(0)).cast("bigint").alias("at"), F.col("url").alias("url"))) for i, (name, df) in enumerate(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def enrich_candidates(candidates: DataFrame, companies: DataFrame) -> DataFrame:
    """Candidates with normalized url, source type, tier, tiers by field and match score; those without a web address go.

    What a candidate brings itself stays; a provided one matches by 1.0, others by title and snippet.
    """
    rows = candidates
    for column, kind in (("source_type", "string"), ("authority_tier", "int"), ("authority_by_field", "map<string,int>"), ("entity_match_score", "double"), ("title", "string"), ("snippet", "string")):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast(kind))
    rows = rows.withColumn("normalized", url.normalize_url(F.col("url")))
    domain = url.normalize_domain(F.col("normalized"))
    rows = rows.where(F.lower(url.part(F.col("normalized"), 2)).isin("http", "https") & (domain != "")).withColumn("__class", url.source_class(domain, F.col("normalized")))
    rows = rows.join(companies.select("company_id", F.col("company_name").alias("__name"), F.col("tax_id").alias("__tax")), "company_id")
    tier = F.coalesce("authority_tier", "__class.authority_tier")
    score = F.coalesce("entity_match_score", F.when(F.col("provided"), 1.0).otherwise(text.entity_match(F.col("__name"), F.col("__tax"), F.trim(F.concat_ws(" ", "title", "snippet")))))
    by_field = F.coalesce(F.when(F.size("authority_by_field") > 0, F.col("authority_by_field")), F.create_map(F.lit("*"), tier))
    return rows.withColumns({"source_type": F.coalesce("source_type", "__class.source_type"), "authority_by_field": by_field, "authority_tier": tier, "entity_match_score": score}).drop("__class", "__name", "__tax")


def order_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with their place in their company: by relevance, then the origin's priority, then the url."""
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("discovered_via")], F.lit(0))
    w = Window.partitionBy("workspace_id", "company_id").orderBy(F.desc(F.coalesce("relevance_score", F.lit(0.0))), F.desc(priority), "normalized")
    return candidates.withColumn("place", F.row_number().over(w))


def select_sources(candidates: DataFrame) -> DataFrame:
    """workspace_id, company_id, normalized, status, selection_reason, rejection_reason: the first candidate of each url, judged.

    candidates are enriched and have place.
    """
    w = Window.partitionBy("workspace_id", "company_id", "normalized").orderBy("place")
    rows = candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    unsafe, score = ranking.unsafe_reason(F.col("url")), F.col("entity_match_score")
    rejected = (
        F.when(unsafe.isNotNull(), F.concat(F.lit("UNSAFE_URL:"), unsafe)).when(ranking.excluded_token(F.col("normalized")).isNotNull(), "EXCLUDED_URL_TOKEN")
        .when(score < LOW_MATCH, F.concat(F.lit("LOW_ENTITY_MATCH:"), score.cast("string"))).when((F.col("discovered_via") == "search_provider") & (score < SEARCH_MATCH), "ENTITY_MATCH_REVIEW_REQUIRED")
    )
    chosen = F.when(F.col("provided"), "provided_url").when(F.col("discovered_via").isin("trusted_provider", "source_history"), F.col("discovered_via")).otherwise("entity_match")
    return rows.select("workspace_id", "company_id", "normalized", F.when(rejected.isNull(), "discovered").otherwise("rejected").alias("status"), chosen.alias("selection_reason"), rejected.alias("rejection_reason"))


def search_status(items: DataFrame, companies: DataFrame) -> DataFrame:
    """query_id, rank, normalized, status, reason, relevance, page_group of search results (with company_id): rejected, for review, or a candidate."""
    rows = items.join(companies.select("company_id", "company_name", "tax_id"), "company_id").withColumn("normalized", url.normalize_url(F.col("url")))
    said = F.trim(F.concat_ws(" ", "title", "snippet"))
    rank = ranking.ranked(F.col("normalized"), said, F.lit(""), F.lit("search_provider"), F.lit(0))
    score, unsafe = text.entity_match(F.col("company_name"), F.col("tax_id"), said), ranking.unsafe_reason(F.col("url"))
    rows = rows.withColumns({"score": score, "unsafe": unsafe, "rank_": rank})
    rows = rows.withColumns({"page_group": F.col("rank_.page_group"), "relevance": F.col("rank_.relevance"), "excluded": F.col("rank_.excluded"), "why": F.col("rank_.reason")})
    low, middle = F.col("score") < LOW_MATCH, F.col("score") < SEARCH_MATCH
    status = F.when(F.col("unsafe").isNotNull() | F.col("excluded") | low, "rejected").when(middle, "review").otherwise("candidate")
    reason = (
        F.when(F.col("unsafe").isNotNull(), F.concat(F.lit("UNSAFE_URL:"), "unsafe")).when(F.col("excluded"), "EXCLUDED_URL_TOKEN").when(low, F.concat(F.lit("LOW_ENTITY_MATCH:"), F.col("score").cast("string")))
        .when(middle, "ENTITY_MATCH_REVIEW_REQUIRED").otherwise(F.col("why"))
    )
    return rows.select("query_id", "rank", "normalized", status.alias("status"), reason.alias("reason"), "relevance", "page_group")


def discovery_queries(companies: DataFrame, aliases: DataFrame, sections: tuple[str, ...] = ("official",), languages: tuple[str, ...] = ("vi", "en"), country: str | None = None, most_names: int = 4, scopes: DataFrame | None = None) -> DataFrame:
    """workspace_id, company_id, section, language, query: what to search for each company, each text once.

    Names are the legal name, the name and aliases, told apart without case, at most four. scopes, one row a company at
    most, has what a user asks for: search_query (their own text, which comes first), and country, country_name and
    country_code, which where any is given stand in place of the country for all.
    """
    name = lambda c: text.clean_text(F.coalesce(F.col(c), F.lit("")))
    own = aliases.groupBy("workspace_id", "company_id").agg(F.array_sort(F.collect_set(name("alias_name"))).alias("aliases"))
    rows = companies.join(own, ["workspace_id", "company_id"], "left")
    every = F.filter(F.concat(F.array(name("legal_name"), name("company_name")), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x != "")
    rows = rows.withColumns({"__all": every, "__country": F.lit(country).cast("string"), "__asked": F.lit(None).cast("string")})
    if scopes is not None:
        said = F.nullif(F.concat_ws(" ", "country", "country_name", "country_code"), F.lit(""))
        asked = scopes.select("workspace_id", "company_id", said.alias("__said"), F.nullif(text.clean_text(F.col("search_query")), F.lit("")).alias("__own"))
        rows = rows.join(asked, ["workspace_id", "company_id"], "left").withColumns({"__country": F.coalesce("__said", "__country"), "__asked": F.col("__own")})
    rows = rows.withColumn("__names", F.slice(F.filter("__all", lambda x, i: F.array_position(F.transform("__all", F.lower), F.lower(x)) == i + 1), 1, most_names))
    site = F.regexp_replace(F.regexp_extract(F.lower(url.part(url.ensure_scheme(F.coalesce("website_url", F.lit(""))), 4)), r"^(?:[^@]*@)?([^:]*)", 1), r"^www\.", "")
    numbers = F.array_distinct(F.filter(F.array(name("registration_number"), name("tax_id")), lambda x: x != ""))
    quoted = lambda names: F.array_join(F.transform(names, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " ")
    rest = F.slice("__names", 2, most_names)
    head = F.concat_ws(
        " ", quoted(F.slice("__names", 1, 1)), F.when(F.size(rest) > 0, F.concat(F.lit("aliases "), quoted(rest))), F.concat(F.lit("country "), "__country"),
        F.when(site != "", F.concat(F.lit("site:"), site)), F.when(F.size(numbers) > 0, F.concat(F.lit("registration "), F.array_join(numbers, " "))),
    )
    terms = [F.struct(F.lit(i * len(languages) + j).alias("ord"), F.lit(s).alias("section"), F.lit(x).alias("language"), F.lit(SECTIONS.get(s, SECTIONS["official"]).get(x, SECTIONS.get(s, SECTIONS["official"])["en"])).alias("terms")) for i, s in enumerate(sections) for j, x in enumerate(languages)]
    first = F.struct(F.lit(-1).alias("ord"), F.lit("official").alias("section"), F.lit(languages[0]).alias("language"), F.lit(None).cast("string").alias("terms"))
    rows = rows.where(F.size("__names") > 0).select("workspace_id", "company_id", head.alias("__head"), "__asked", F.inline(F.array(first, *terms)))
    rows = rows.withColumn("query", F.when(F.col("ord") < 0, F.col("__asked")).otherwise(F.concat_ws(" ", "__head", "terms"))).where("query IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("workspace_id", "company_id", F.lower("query")).orderBy("ord"))
    return rows.withColumn("__n", first).where("__n = 1").select("workspace_id", "company_id", "section", "language", "query")


def robots_decisions(robots: DataFrame, urls: DataFrame, agent: str) -> DataFrame:
    """site, path, decision, reason for every url (site, path) by the captured robots.txt of its site (site, status, content).

    Lines of agents and the rules below them make entries; the first entry that names the agent decides, else the first for
    all agents; in it the first rule that the path begins with. A blank line ends an entry. Without a captured file the
    decision is unknown.
    """
    lines = robots.where("status = 200").select("site", F.posexplode(F.split("content", r"\r\n|[\n\r]")).alias("at", "raw"))
    blank = F.col("raw") == ""
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    key = F.lower(F.trim(F.regexp_extract(bare, "^([^:]*):", 1)))
    kind = F.when(blank, "blank").when(key == "user-agent", "agent").when(key.isin("allow", "disallow"), key)
    lines = lines.withColumn("kind", kind).withColumn("value", F.trim(F.regexp_extract(bare, "^[^:]*:(.*)$", 1))).where("kind IS NOT NULL")
    by_line = Window.partitionBy("site").orderBy("at")
    starts = (F.col("kind") == "blank") | ((F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(by_line), F.lit("blank")) != "agent"))
    lines = lines.withColumn("entry", F.sum(F.when(starts, 1).otherwise(0)).over(by_line))
    names = F.lower(F.split_part("value", F.lit("/"), F.lit(1)))
    mine = F.contains(F.lit(agent.split("/")[0].lower()), names) & (names != "*") & (names != "")
    rules = F.array_sort(F.collect_list(F.when(F.col("kind").isin("allow", "disallow"), F.struct("at", F.col("kind").alias("rule"), F.col("value").alias("prefix")))))
    entries = lines.groupBy("site", "entry").agg(F.max(F.coalesce((F.col("kind") == "agent") & mine, F.lit(False))).alias("mine"), F.max((F.col("kind") == "agent") & (names == "*")).alias("all"), rules.alias("rules"))
    entries = entries.where(F.size("rules") > 0)
    chosen = entries.groupBy("site").agg(F.min_by("rules", F.when(F.col("mine"), F.col("entry"))).alias("__mine"), F.min_by("rules", F.when(F.col("all"), F.col("entry"))).alias("__all"))
    known = robots.select("site", "status").join(chosen.select("site", F.coalesce("__mine", "__all").alias("rules")), "site", "left")
    rows = urls.join(known, "site", "left")
    path = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    hits = F.filter("rules", lambda r: (r["prefix"] == "*") | path.startswith(r["prefix"]))
    first = F.get(hits, 0)
    closed = F.coalesce((first["rule"] == "disallow") & (first["prefix"] != ""), F.lit(False))
    status = F.col("status")
    decision = (
        F.when(status.isNull(), "unknown").when(status.isin(401, 403), "blocked").when(status.between(400, 499), "allowed").when(status != 200, "unknown").when(closed, "blocked").otherwise("allowed")
    )
    code = lambda name: F.concat(F.lit(f"ROBOTS_{name}_HTTP_"), status.cast("string"))
    reason = (
        F.when(status.isNull(), "ROBOTS_NOT_CAPTURED").when(status.isin(401, 403), code("ACCESS_CONTROL")).when(status.between(400, 499), code("NOT_PUBLISHED")).when(status != 200, code("UNAVAILABLE"))
        .when(closed, "ROBOTS_DISALLOWED").otherwise("ROBOTS_ALLOWED")
    )
    return rows.select("site", "path", decision.alias("decision"), reason.alias("reason"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """site, pos, sitemap_url of the sitemaps that captured robots.txt files name."""
    lines = robots.where("status = 200").select("site", F.posexplode(F.split("content", r"\r\n|[\n\r]")).alias("pos", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    return lines.where(F.lower(bare).rlike(r"^sitemap\s*:")).select("site", "pos", F.trim(F.regexp_extract(bare, "^[^:]*:(.*)$", 1)).alias("sitemap_url"))


def crawl_frontier(seeds: DataFrame, links: DataFrame, *, depth: int = 1, per_domain: int = 25, per_job: int = 50, folder: str | None = None) -> DataFrame:
    """job_id, url, depth, place of the pages that a bounded walk over captured links reads, in its order.

    seeds has job_id, url, domain, ord; links has src, url, domain, pos. A link counts if it stays on its page's domain;
    a url counts where it is first seen. Pages beyond a domain's or a job's limit are not read, and lead nowhere.

    Each level is written to the folder before the next is planned, so every level's plan is the same and reads what the
    one before has left; the limits are ranks with a bound, which keep the first rows of a domain or job before they move.
    """
    order = ["ord", "url"]
    folder = folder or new_folder(seeds.sparkSession)
    tables: dict[str, DataFrame] = {}

    def save(kind: str, step: int, rows: DataFrame) -> DataFrame:
        """The level's rows; all levels of the kind are one table, a folder each."""
        own = written(rows, f"{folder}/{kind}/level={step}")
        tables[kind] = seeds.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{kind}")
        return own

    first = F.min(F.struct("ord", "domain")).alias("f")
    level = seeds.groupBy("job_id", "url").agg(first).select("job_id", "url", "f.domain", F.array(F.col("f.ord").cast("bigint")).alias("ord"))
    for step in range(min(max(depth, 0), 5) + 1):
        if step:
            found = kept.select("job_id", F.col("url").alias("src"), F.col("domain").alias("__domain"), F.col("ord").alias("__ord")).join(links, "src").where("domain = __domain")
            found = found.select("job_id", "url", "domain", F.concat("__ord", F.array(F.col("pos").cast("bigint"))).alias("ord")).join(tables["found"].select("job_id", "url"), ["job_id", "url"], "left_anti")
            level = found.groupBy("job_id", "url").agg(first).select("job_id", "url", "f.domain", "f.ord")
        level = save("found", step, level)
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        ranked = level.withColumn("__n", rank("job_id", "domain")).where(F.col("__n") <= per_domain).withColumns({"__d": F.lit(0), "__j": F.lit(0)})
        if step:
            read = tables["read"]
            ranked = ranked.drop("__d", "__j").join(read.groupBy("job_id", "domain").agg(F.count("*").alias("__d")), ["job_id", "domain"], "left").join(read.groupBy("job_id").agg(F.count("*").alias("__j")), "job_id", "left")
        ranked = ranked.where(F.col("__n") + F.coalesce("__d", F.lit(0)) <= per_domain).withColumn("__m", rank("job_id")).where(F.col("__m") <= per_job)
        place = F.col("__m") + F.coalesce("__j", F.lit(0))
        kept = save("read", step, ranked.withColumn("place", place).where(F.col("place") <= per_job).select("job_id", "url", "domain", "ord", F.lit(step).alias("depth"), F.col("place").cast("int").alias("place")))
    return tables["read"].select("job_id", "url", "depth", "place")
