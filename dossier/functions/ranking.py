"""Page groups, relevance and safety of urls, all of them expressions over columns."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, url

#: Words that tell which group of pages a url belongs to, in order of precedence (fixed values).
PAGE_GROUPS = {
    "about_company_history": ("about", "company", "gioi thieu", "gioithieu", "ve chung toi", "vechungtoi", "history", "lich su", "lichsu", "overview", "profile"),
    "products_services_solutions": ("product", "products", "service", "services", "solution", "solutions", "san pham", "sanpham", "dich vu", "dichvu", "giai phap", "giaiphap"),
    "leadership": ("leadership", "management", "executive", "board", "team", "lanh dao", "lanhdao", "ban dieu hanh", "bandieuhanh"),
    "markets_customers_partners": ("market", "markets", "customer", "customers", "partner", "partners", "thi truong", "thitruong", "khach hang", "khachhang", "doi tac", "doitac"),
    "investor_relations": ("investor", "investors", "investor relations", "ir", "quan he co dong", "quanhecodong"),
    "annual_reports": ("annual report", "annual-report", "annualreports", "report", "reports", "bao cao", "baocao", "tai chinh", "taichinh"),
    "news": ("news", "press", "media", "tin tuc", "tintuc", "bao chi", "baochi"),
    "careers": ("career", "careers", "jobs", "job", "recruit", "recruitment", "tuyen dung", "tuyendung", "viec lam", "vieclam"),
    "contact": ("contact", "contacts", "lien he", "lienhe", "head office", "dia chi", "diachi"),
}

#: What adds to a url's relevance, and what each step away from the start takes off it, up to a limit (fixed values).
BASE, GROUPED, TITLED, REPORT, OFFICIAL = "0.28", "0.28", "0.12", "0.12", "0.16"
BY_ORIGIN = {"official_website": "0.08", "internal_link": "0.06", "sitemap": "0.04"}
PER_STEP, MOST_STEPS = "0.04", "0.20"
REPORTS = (".pdf", ".xlsx", ".xls")

#: Hosts that are never asked, how their names may end, and ranges of addresses that aren't public (fixed values).
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "metadata.google.internal", "instance-data")
BLOCKED_ENDS = (".local", ".localhost", ".internal", ".test")
BLOCKED_RANGES = (
    "127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "0.0.0.0/8", "224.0.0.0/4", "100.64.0.0/10", "198.18.0.0/15",
    "192.0.0.0/24", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
BLOCKED_V6 = r"^(::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*|ff[0-9a-f]{2}:.*|::ffff:.*|2001:db8:.*)$"

RANGES = [(int(n[0]), int(n[-1]), str(n)) for n in map(ipaddress.ip_network, BLOCKED_RANGES)]


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _joined(c: Column) -> Column:
    """The folded text with its words run together: a token stands apart or together in a text if it stands in this."""
    return F.replace(text.fold_text(c), F.lit(" "), F.lit(""))


def joined_token(token: str) -> str:
    """The form in which a token of ASCII letters is looked for."""
    return "".join(x for x in token if x.isalnum())


def where_of(u: Column) -> Column:
    """Path and query, with escapes resolved where they can be."""
    raw = F.concat(url.part(u, 5), F.lit(" "), url.part(u, 7))
    return F.coalesce(F.try_url_decode(raw), raw)


def excluded_token(u: Column) -> Column:
    """The first excluded token that path or query holds, apart or run together; null without one."""
    return let(_joined(where_of(u)), lambda where: F.coalesce(*[F.when(F.contains(where, F.lit(joined_token(t))), F.lit(t)) for t in url.EXCLUDED_TOKENS]))


def page_group(u: Column, title: Column) -> Column:
    """struct(path, title, back, name) of the best group by hits in the path, then in the title, then its order; null without a hit."""
    def count(c: Column, tokens: tuple[str, ...]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(joined_token(t)) for t in tokens]), lambda t: F.contains(c, t)))

    def best(texts: Column) -> Column:
        groups = [F.struct(count(texts["where"], tokens).alias("path"), count(texts["said"], tokens).alias("title"), F.lit(-i).alias("back"), F.lit(name).alias("name")) for i, (name, tokens) in enumerate(PAGE_GROUPS.items())]
        return F.array_max(F.array(*groups))

    found = let(F.struct(_joined(where_of(u)).alias("where"), _joined(title).alias("said")), best)
    return let(found, lambda g: F.when((g["path"] > 0) | (g["title"] > 0), g))


def ranked(u: Column, title: Column, official_domain: Column, origin: Column, depth: Column) -> Column:
    """struct(page_group, relevance, excluded, reason) of urls; title holds the snippet as well."""
    dec = lambda x: F.lit(x).cast("decimal(6,4)")
    own = F.coalesce(official_domain, F.lit(""))
    official = (own != "") & (url.normalize_domain(u) == own)
    is_report = F.lower(url.part(u, 5)).rlike(r"\.(pdf|xlsx?)$")
    steps = F.least(F.greatest(depth, F.lit(0)).cast("decimal(6,0)") * dec(PER_STEP), dec(MOST_STEPS))
    start = dec(BASE) + F.when(official, dec(OFFICIAL)).otherwise(dec("0")) + F.coalesce(*[F.when(origin == k, dec(v)) for k, v in BY_ORIGIN.items()], dec("0")) - steps

    def told(f: Column) -> Column:
        group, token = f["group"], f["token"]
        titled, report = F.coalesce(group["title"] > 0, F.lit(False)), F.coalesce((group["name"] == "annual_reports") & f["report"], F.lit(False))
        score = f["start"] + sum((F.when(c, dec(v)).otherwise(dec("0")) for c, v in ((group.isNotNull(), GROUPED), (titled, TITLED), (report, REPORT))), dec("0"))
        score = F.round(F.greatest(dec("0"), F.least(dec("1"), score)), 4).cast("double")
        parts = [F.when(group.isNotNull(), F.concat(F.lit("page_group:"), group["name"])), F.when(titled, "title_token_match"), F.when(report, "report_document"), F.when(f["official"], "official_domain"), F.when(f["origin"].isin(*BY_ORIGIN), f["origin"])]
        reason = F.coalesce(F.nullif(F.concat_ws(";", *parts), F.lit("")), F.lit("general_public_page"))
        return F.struct(
            F.when(token.isNull(), group["name"]).alias("page_group"), F.when(token.isNull(), score).otherwise(0.0).alias("relevance"), token.isNotNull().alias("excluded"),
            F.when(token.isNotNull(), F.concat(F.lit("excluded_path_token:"), token)).otherwise(reason).alias("reason"),
        )

    facts = F.struct(page_group(u, title).alias("group"), excluded_token(u).alias("token"), start.alias("start"), is_report.alias("report"), official.alias("official"), origin.alias("origin"))
    return let(facts, told)


def unsafe_reason(u: Column) -> Column:
    """Why a url must not be asked, by its text alone; null if nothing speaks against it."""
    u = F.trim(F.coalesce(u, F.lit("")))
    authority = url.part(u, 4)
    bare = F.regexp_replace(authority, "^.*@", "")
    host = F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, ":.*$", ""))
    parts = F.struct(u.alias("url"), F.lower(url.part(u, 2)).alias("scheme"), authority.alias("authority"), bare.startswith("[").alias("v6"), F.regexp_replace(F.lower(host), r"\.+$", "").alias("host"))

    def judged(f: Column) -> Column:
        host = f["host"]
        octets = F.transform(F.split(host, r"\."), lambda x: x.try_cast("bigint"))
        is_v4 = host.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$") & (F.array_max(octets) <= 255)
        address = F.when(is_v4, F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x))
        network = let(address, lambda ip: F.coalesce(*[F.when(ip.between(low, high), F.lit(name)) for low, high, name in RANGES]))
        network = F.coalesce(network, F.when(f["v6"] & host.rlike(BLOCKED_V6), host))
        ends = [host.endswith(e) for e in BLOCKED_ENDS]
        return (
            F.when(f["url"] == "", "EMPTY_URL").when(~f["scheme"].isin("http", "https"), "UNSUPPORTED_SCHEME").when(host == "", "INVALID_HOST").when(F.contains(f["authority"], F.lit("@")), "INVALID_URL")
            .when(host.isin(*BLOCKED_HOSTS) | ends[0] | ends[1] | ends[2] | ends[3], "BLOCKED_HOST").otherwise(F.concat(F.lit("SSRF_BLOCKED:"), network))
        )

    return let(parts, judged)
