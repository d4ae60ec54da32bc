"""Facts from JSON payloads: companies, their identifiers, addresses, links and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from .json_walk import json_objects

#: Titles that make an employee a member of the board (fixed values).
BOARD = ("ceo", "chief executive officer", "director", "board member")
#: Types of objects that describe an organisation, besides the payload itself; the library's own choice.
ORGANISATIONS = ("Organization", "Corporation", "LocalBusiness", "Company")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, path: str, *kinds: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    out = F.lit(False)
    for k in kinds:
        out = out | kind.startswith(k)
    return F.coalesce(out, F.lit(False))


def _string(v: Column, *paths: str) -> Column:
    """The first of the paths that holds a string with something in it, without outer blanks."""
    return F.coalesce(*[F.when(_is(v, p, "STRING"), F.nullif(F.trim(_get(v, p)), F.lit(""))) for p in paths])


def _scalar(v: Column, *paths: str) -> Column:
    return F.coalesce(*[F.when(_is(v, p, "STRING", "BIGINT", "DECIMAL", "DOUBLE"), F.nullif(F.trim(_get(v, p)), F.lit(""))) for p in paths])


def person_value(v: Column) -> Column:
    """struct(name, role, title) of a person, the role from role or jobTitle; null without a name."""
    return F.when(_string(v, "$.name").isNotNull(), F.struct(_string(v, "$.name").alias("name"), _string(v, "$.jobTitle", "$.role").alias("role"), _string(v, "$.title").alias("title")))


def _list(v: Column, path: str) -> Column:
    """An array of what stands at a path: the elements of a list, a single object as one, else empty."""
    listed = F.try_variant_get(v, path, "array<variant>")
    return F.when(_is(v, path, "ARRAY"), listed).when(_is(v, path, "OBJECT"), F.array(F.try_variant_get(v, path, "variant"))).otherwise(F.array().cast("array<variant>"))


def structured_facts(blocks: DataFrame, id_: list[str], content: str = "text_content", *, strict_reference: bool = False) -> DataFrame:
    """id columns, path, field_key, value (JSON) of the facts that a payload's objects state.

    The payload itself, the elements of its lists and objects typed as organisations speak for the company; with
    strict_reference every object does, persons and products as well.
    """
    v = F.col("value")
    nodes = json_objects(blocks, id_, content)
    if not strict_reference:
        nodes = nodes.where((F.col("path").rlike(r"^\$(\.@graph)?(\[[0-9]+\])?$")) | F.coalesce(F.col("type").isin(*ORGANISATIONS), F.lit(False)))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    address = F.coalesce(_string(v, "$.address"), F.nullif(F.concat_ws(", ", *[F.nullif(F.trim(_get(v, f"$.address.{p}")), F.lit("")) for p in values.ADDRESS]), F.lit("")))
    web = lambda c: c.startswith("http://") | c.startswith("https://")
    number, of = _string(v, "$.identifier.value"), F.lower(F.coalesce(_get(v, "$.identifier.propertyID"), F.lit("")))
    plain = {
        "identity.legal_name": _string(v, "$.legalName", "$.name"), "identity.website": F.when(web(_string(v, "$.url")), _string(v, "$.url")), "identity.tax_id": F.coalesce(_scalar(v, "$.taxID", "$.taxId", "$.tax_id"), F.when(F.contains(of, F.lit("tax")), number)),
        "identity.telephone": _string(v, "$.telephone"), "identity.email": _string(v, "$.email"), "identity.address": address, "identity.country": F.when(address.isNotNull(), _string(v, "$.address.addressCountry")),
        "identity.registration_number": F.coalesce(_string(v, "$.identifier"), F.when(~F.contains(of, F.lit("tax")), number)), "identity.founding_date": _scalar(v, "$.foundingDate", "$.founding_date"),
        "identity.ticker": _string(v, "$.ticker"), "identity.exchange": _string(v, "$.exchange", "$.stockExchange"),
    }
    links = F.filter(F.transform(_list(v, "$.sameAs"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.trim(_get(x, "$")))), lambda x: F.coalesce(web(x), F.lit(False)))
    links = F.when(_is(v, "$.sameAs", "STRING"), F.filter(F.array(_string(v, "$.sameAs")), web)).otherwise(links)
    people = lambda a: F.filter(F.transform(a, person_value), lambda x: x.isNotNull())
    board = F.filter(_list(v, "$.employee"), lambda x: F.lower(F.coalesce(_get(x, "$.jobTitle"), _get(x, "$.role"), F.lit(""))).isin(*BOARD))
    founders = F.when(_is(v, "$.founders", "ARRAY", "OBJECT"), _list(v, "$.founders")).otherwise(_list(v, "$.founder"))
    listed = {"identity.official_social_links": links, "leadership.founders": people(founders), "leadership.board_members": people(board)}
    ceo = F.when(_is(v, "$.ceo", "OBJECT"), person_value(F.try_variant_get(v, "$.ceo", "variant")))
    facts = [F.struct(F.lit(k).alias("field_key"), quoted(c).alias("value")) for k, c in plain.items()]
    facts += [F.struct(F.lit(k).alias("field_key"), F.when(F.size(c) > 0, F.to_json(c)).alias("value")) for k, c in listed.items()]
    facts.append(F.struct(F.lit("leadership.ceo").alias("field_key"), F.to_json(ceo).alias("value")))
    return nodes.select(*id_, "path", F.inline(F.array(*facts))).where("value IS NOT NULL")


def gate_blocks(blocks: DataFrame, companies: DataFrame, content: str = "text_content", least: float = 0.3) -> DataFrame:
    """The blocks whose text matches their company by the least score or more."""
    own = companies.select("workspace_id", "company_id", F.col("company_name").alias("__name"), F.col("tax_id").alias("__tax"))
    rows = blocks.join(own, ["workspace_id", "company_id"])
    return rows.where(text.entity_match(F.col("__name"), F.col("__tax"), F.col(content)) >= least).drop("__name", "__tax")
