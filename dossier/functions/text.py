"""Text functions, all of them expressions over columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms that a company's name is compared without, in order (fixed values).
LEGAL_FORMS = ("cong ty tnhh", "cong ty co phan", "co phan", "tnhh", "cty", "inc", "corp", "corporation", "ltd", "llc", "plc", "gmbh")

#: Words that tell a text's language (fixed values).
MARKERS = {"vi": ("công ty", "địa chỉ", "mã số thuế", "trụ sở"), "en": ("company", "headquarters", "tax id", "address")}

#: Patterns of text that tries to instruct a model, matched without regard to case (fixed values).
INJECTIONS = (
    r"ignore\s+(all\s+)?previous\s+instructions", r"you\s+are\s+now\s+a", r"system\s*:\s*", r"<\|?system\|?>", r"assistant\s*:\s*",
    r"disregard\s+(the\s+)?instructions", r"new\s+instructions\s*:", r"override\s+(the\s+)?previous",
)

#: Parts of keys whose values are not to be shown (fixed values).
SENSITIVE = ("api_key", "secret", "password", "token", "auth_token", "access_token", "private_key")

SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Control characters that values are rid of (fixed value).
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
NOT_WORD = r"[^\p{L}\p{N}_]+"


def _accent_table() -> tuple[str, str]:
    """Letters with accents and their bare ones, from Unicode's decompositions."""
    plain = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    plain = {c: d[0] for c, d in plain.items() if len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))}
    return "".join(plain), "".join(plain.values())


ACCENTED, BARE = _accent_table()


def without_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, BARE), r"[\x{300}-\x{36F}]", "")


def normalize_name(name: Column) -> Column:
    """A company's name without accents, legal forms and punctuation; the lower-cased name where nothing else is left."""
    out = F.lower(without_accents(name))
    for form in LEGAL_FORMS:
        out = F.regexp_replace(out, rf"\b{form}\b", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return F.coalesce(F.nullif(out, F.lit("")), F.trim(F.lower(name)), F.lit(""))


def fold_text(c: Column) -> Column:
    """Lower case without accents, all but ASCII letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(without_accents(c)), "[^a-z0-9]+", " "))


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def infer_language(c: Column, html: Column | None = None, tag: Column | None = None) -> Column:
    """The tag if one is given, else the html element's, else by marker words, else und."""
    low = F.lower(c)
    out = F.lit("und")
    for language, words in reversed(MARKERS.items()):
        hit = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, language).otherwise(out)
    plain = lambda t: F.nullif(F.substring(F.replace(F.lower(F.trim(t)), F.lit("_"), F.lit("-")), 1, 16), F.lit(""))
    given = [plain(tag)] if tag is not None else []
    if html is not None:
        given.append(plain(F.regexp_extract(html, "(?i)<html[^>]*[ \\t\\n]lang=[\"']?([^\"' >]*)", 1)))
    return F.coalesce(*given, out)


def injection_hits(c: Column) -> Column:
    """The patterns that the text holds, in order, as an array."""
    return F.array_compact(F.array(*[F.when(c.rlike(f"(?i){p}"), F.lit(p)) for p in INJECTIONS]))


def sanitize(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, "")


def redact(key: Column, value: Column) -> Column:
    return F.when(F.lower(key).rlike("|".join(SENSITIVE)), F.lit("[REDACTED]")).otherwise(value)


def needs_render(html: Column, status: Column | None = None, kind: Column | None = None) -> Column:
    """Under 80 visible characters, and a script or root element; also what is gone (404, 410), but nothing that is refused.

    status and kind (the content type) count as 200 and text/html where they aren't given.
    """
    visible = clean_text(F.regexp_replace(html, "<[^>]+>", " "))
    thin = (F.length(visible) < 80) & (F.contains(F.lower(html), F.lit("<script")) | F.contains(F.lower(html), F.lit('id="root"')))
    if kind is not None:
        thin = thin & (kind.startswith("text/html") | kind.startswith("application/xhtml"))
    return thin if status is None else F.when(status.isin(404, 410), True).otherwise((status == 200) & thin)


#: What the test file for virus scanners holds (fixed value).
SIGNATURE = "EICAR-STANDARD-ANTIVIRUS-TEST-FILE"


def malware_flag(content: Column) -> Column:
    return F.contains(content, F.lit(SIGNATURE))


def entity_match(name: Column, tax_id: Column, text: Column) -> Column:
    """Half for the tax id, up to half for the share of the name's longer words that the text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    terms = F.filter(F.split(F.lower(name), NOT_WORD), lambda t: F.length(t) > 2)
    share = F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms) * 0.5).otherwise(0.0)
    tax = F.when((tax_id != "") & F.contains(low, tax_id), 0.5).otherwise(0.0)
    return F.when(low == "", 0.0).otherwise(F.bround(F.least(F.lit(1.0), tax + share), 2))
