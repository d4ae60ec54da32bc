"""URL functions, all of them expressions over columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Path words of pages that never describe a company, in order of precedence (fixed values).
EXCLUDED_TOKENS = ("login", "signin", "sign-in", "account", "register", "privacy", "cookie", "cart", "checkout", "admin", "wp-admin", "password")

#: Parts of a domain that tell its source type and authority tier, first match first (fixed values).
REGISTRIES = ("masothue.com", "thongtindoanhnghiep.co", "hosocongty.vn")
DIRECTORIES = ("yellowpages.vnn.vn", "trangvangvietnam.com")
FINANCE_NEWS = ("finance.vietstock.vn", "cafef.vn")
NEWS = ("vnexpress.net", "tuoitre.vn", "baochinhphu.vn", "vietnamnet.vn")


def part(url: Column, n: int) -> Column:
    """Scheme (2), authority (4), path (5), query (7) or fragment (9), by the pattern of RFC 3986."""
    return F.regexp_extract(url, r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?", n)


def normalize_url(url: Column) -> Column:
    """Scheme and authority in lower case, no default port, no slash at the end of the path, no fragment."""
    bare = F.trim(url)
    scheme, host, query = F.lower(part(bare, 2)), F.lower(part(bare, 4)), part(bare, 7)
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(part(bare, 5), "/+$", "")
    return F.concat(scheme, F.lit(":"), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def normalize_domain(url: Column) -> Column:
    """The host in lower case without port, dot at the end and www."""
    host = F.regexp_extract(F.lower(part(F.trim(url), 4)), r"^(?:[^@]*@)?([^:]*)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^www\.", "")


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    return F.array_contains(F.array(*[F.contains(c, F.lit(p)) for p in parts]), True)


def source_class(domain: Column, url: Column) -> Column:
    """Struct of source_type and authority_tier."""
    d, u = F.lower(domain), F.lower(url)
    pair = lambda kind, tier: F.struct(F.lit(kind).alias("source_type"), F.lit(tier).alias("authority_tier"))
    return (
        F.when(F.contains(d, F.lit("gov.vn")) | F.contains(u, F.lit("dangkykinhdoanh")), pair("registry", 1))
        .when(_any(d, REGISTRIES), pair("registry", 2))
        .when(_any(d, DIRECTORIES), pair("directory", 3))
        .when(F.contains(d, F.lit("wikipedia.org")), pair("web_page", 3))
        .when(_any(d, FINANCE_NEWS), pair("news", 3))
        .when(_any(d, NEWS), pair("news", 4))
        .otherwise(pair("web_page", 3))
    )


def ensure_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))


def robots_path(url: Column) -> Column:
    """False for paths that a static rule closes."""
    return ~(F.contains(url, F.lit("/admin")) | F.contains(url, F.lit("/private")))


#: Query keys that only track visitors, and how such keys begin (fixed values).
TRACKING_KEYS = ("fbclid", "gclid", "dclid", "msclkid")
TRACKING_PREFIX = "utm_"

#: Content types that are read, besides those that end in +json or +xml (fixed values).
CONTENT_TYPES = ("application/json", "application/ld+json", "application/pdf", "application/xhtml+xml", "application/xml", "text/html", "text/plain", "text/xml")


def canonical_url(url: Column) -> Column:
    """An absolute http(s) url without credentials, default port, path parameters, tracking keys and fragment; else empty.

    Null becomes empty. Escapes in the query stay as they are.
    """
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme, authority = F.lower(part(u, 2)), part(u, 4)
    host, port = F.regexp_replace(F.lower(F.regexp_replace(authority, ":[0-9]*$", "")), r"\.+$", ""), F.regexp_extract(authority, ":([0-9]+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.regexp_replace(F.regexp_replace(part(u, 5), ";[^/]*$", ""), "/+$", "")
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    pairs = F.filter(F.split(part(u, 7), "&"), lambda p: (p != "") & ~key(p).isin(*TRACKING_KEYS) & ~F.startswith(key(p), F.lit(TRACKING_PREFIX)))
    query = F.array_join(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (host != "") & ~F.contains(authority, F.lit("@")), whole).otherwise("")


def content_type(header: Column, url: Column) -> Column:
    """The header's type without parameters, else by the path's ending, else html."""
    said, path = F.lower(F.trim(F.substring_index(F.coalesce(header, F.lit("")), ";", 1))), F.lower(part(F.coalesce(url, F.lit("")), 5))
    guessed = F.when(path.endswith(".pdf"), "application/pdf").when(path.endswith(".json") | path.endswith(".jsonld"), "application/json").otherwise("text/html")
    return F.when(said != "", said).otherwise(guessed)


def content_problem(kind: Column, url: Column, content: Column) -> Column:
    """Why a response's type is refused; null if it isn't."""
    pdf, ends = kind == "application/pdf", F.lower(part(F.coalesce(url, F.lit("")), 5)).endswith(".pdf")
    signed = F.coalesce(content, F.lit("")).rlike("^[\\x09-\\x0D ]*%PDF")
    known = kind.isin(*CONTENT_TYPES) | kind.endswith("+json") | kind.endswith("+xml")
    return F.when(~known, "UNSUPPORTED_TYPE").when(ends & ~pdf, "PDF_EXTENSION").when(signed & ~pdf, "PDF_SIGNATURE").when(pdf & ~signed, "NO_PDF_SIGNATURE")


def _without_dots(path: Column) -> Column:
    """A path whose segments . and .. are worked out."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x))),
    )
    joined = F.array_join(kept, "/")
    return F.when(path.rlike(r"(^|/)\.\.?$") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve(href: Column, base: Column) -> Column:
    """The url that a reference on the page of a base url leads to; without a base the reference itself."""
    href, base = F.trim(F.coalesce(href, F.lit(""))), F.trim(F.coalesce(base, F.lit("")))
    scheme, root = part(base, 2), F.regexp_extract(base, r"^([^:/?#]+:(//[^/?#]*)?)", 1)
    folder = F.regexp_replace(part(base, 5), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when((base == "") | href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href == "", F.regexp_replace(base, "#.*$", ""))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), href))
        .when(href.startswith("/"), F.concat(root, _without_dots(path), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def ascii_hosts(rows: DataFrame, column: str) -> DataFrame:
    """rows with the hosts of a column in the letters that name servers know; only hosts beyond ASCII go through Python, once each."""
    @F.pandas_udf("string")
    def encoded(hosts: pd.Series) -> pd.Series:
        def one(host):
            try:
                return host.encode("idna").decode("ascii")
            except UnicodeError:
                return host
        return hosts.map(one)

    odd = rows.select(F.col(column).alias("__host")).where(F.col("__host").rlike(r"[^\x00-\x7F]")).distinct()
    known = odd.select("__host", encoded("__host").alias("__ascii"))
    return rows.join(known, F.col(column) == F.col("__host"), "left").withColumn(column, F.coalesce("__ascii", column)).drop("__host", "__ascii")
