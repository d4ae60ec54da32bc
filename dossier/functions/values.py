"""Typed values and labelled lines, all of them expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: Labels of facts on a line of their own, in the order in which they are tried, without regard to case (fixed values).
LABELS = (
    ("identity.legal_name", r"^(?:legal\s+name|company\s+name|tên\s+(?:pháp\s+lý|công\s+ty))\s*[:\-]\s*(.+)$"),
    ("identity.tax_id", r"^(?:tax\s+id|tax\s+identification\s*(?:number|no\.)?|mã\s+số\s+thuế)\s*[:\-]\s*([A-Z0-9\-]+)$"),
    ("identity.registration_number", r"^(?:registration\s+(?:number|no\.)|business\s+registration\s+(?:number|no\.)|số\s+đăng\s+ký)\s*[:\-]\s*(.+)$"),
    ("identity.address", r"^(?:address|headquarters|trụ\s+sở|địa\s+chỉ)\s*[:\-]\s*(.+)$"),
    ("identity.telephone", r"^(?:telephone|phone|tel|điện\s+thoại|hotline)\s*[:\-]\s*(.+)$"),
    ("identity.email", r"^(?:email|e-mail)\s*[:\-]\s*([^\s]+@[^\s]+)$"),
    ("identity.founding_date", r"^(?:founding|founded|incorporation)\s+(?:date|day)?\s*[:\-]\s*(.+)$"),
)

#: Parts of a postal address, in the order in which they are joined (fixed values).
ADDRESS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")


def matches_token(c: Column, token: str) -> Column:
    """Whether the folded text holds the folded token, with its words apart or run together."""
    folded, wanted = text.fold_text(c), text.fold_text(F.lit(token))
    together = F.contains(F.replace(folded, F.lit(" "), F.lit("")), F.replace(wanted, F.lit(" "), F.lit("")))
    return (wanted != "") & (F.contains(folded, wanted) | together)


def labelled(line: Column) -> Column:
    """struct(field_key, value) of the first label that the line begins with; null without one."""
    line = text.clean_text(line)
    found = [F.when(line.rlike("(?iu)" + p), F.struct(F.lit(k).alias("field_key"), F.trim(F.regexp_extract(line, "(?iu)" + p, 1)).alias("value"))) for k, p in LABELS]
    return F.coalesce(*found)


def value_type(json: Column) -> Column:
    """boolean, integer, number, list, object, else string; text that is no JSON counts as a string."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    number = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    return F.when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer").when(number, "number").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").otherwise("string")


def address_text(json: Column, path: str = "$.address") -> Column:
    """The parts of an address that are there, joined by commas; null if none is."""
    parts = [F.nullif(F.trim(F.try_variant_get(F.try_parse_json(json), f"{path}.{p}", "string")), F.lit("")) for p in ADDRESS]
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def authority_for_field(by_field: Column, field: Column, tier: Column) -> Column:
    """The map's tier for the field, else for '*', if it is 1 to 4; else the source's own."""
    said = F.coalesce(F.try_element_at(by_field, field), F.try_element_at(by_field, F.lit("*")))
    return F.when(said.between(1, 4), said).otherwise(tier)


def ai_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """US dollars, at 0.10 a million tokens read and 0.40 a million written."""
    price = lambda c, p: c.cast("decimal(18,0)") * F.lit(p).cast("decimal(4,2)")
    return ((price(tokens_in, "0.10") + price(tokens_out, "0.40")).cast("double") / 1_000_000.0)
