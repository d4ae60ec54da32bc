"""Confidence and freshness, in decimals and rounded half up, so that every engine gives the same digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores and thresholds (fixed values).
TIERS = {1: "1.00", 2: "0.85", 3: "0.70", 4: "0.50"}
SUPPORT = {"structured": "1.00", "direct": "0.95", "corroborating": "0.85", "contextual": "0.60", "human_note": "1.00", "contradicting": "0.20"}
REGISTRY_FIELDS = ("identity.legal_name", "identity.tax_id", "identity.registration_number", "identity.country")
SITE_FIELDS = ("overview.description", "products.list", "markets.target_markets")
STALENESS = {"identity": (365, 730), "overview": (180, 365), "products": (90, 180), "size": (180, 365), "markets": (180, 365), "leadership": (180, 365), "innovation": (60, 120)}
CRITICAL_FIELDS = ("identity.legal_name", "identity.tax_id", "identity.registration_number")
HIGH_FIELDS = ("overview.hq_address", "size.employee_count_range", "size.revenue_range")
WEIGHTS = {"authority": "0.40", "support": "0.30", "reliability": "0.15", "freshness": "0.15"}
RECENCY = {30: "1.00", 180: "0.90", 365: "0.80"}
OLDER, CORROBORATED, CONFLICTING = "0.65", "0.10", "0.25"
RATINGS = {"High": 0.8, "Medium": 0.6}
TIER_NAMES = {1: "Tier 1 Official Registry", 2: "Tier 2 Official Site", 3: "Tier 3 News/Directory", 4: "Tier 4 General Web"}
BY_HAND, CORROBORATION, WARNING = "manually verified by human reviewer", "corroborated by %d independent domains", "WARNING: conflicting candidate detected"


def dec(x: str) -> Column:
    return F.lit(x).cast("decimal(4,2)")


def _cases(c: Column, values: dict, otherwise: Column, make=dec) -> Column:
    out = otherwise
    for k, v in values.items():
        out = F.when(c == k, make(v)).otherwise(out)
    return out


def age_days(seen: Column, as_of: Column) -> Column:
    """Whole periods of 24 hours, never negative."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(seen)) / 86400))


def authority(field: Column, tier: Column) -> Column:
    return F.when(field.isin(*REGISTRY_FIELDS) & (tier == 1), dec("1.00")).when(field.isin(*SITE_FIELDS) & tier.isin(1, 2), dec("0.95")).otherwise(_cases(tier, TIERS, dec("0.50")))


def confidence(field: Column, tier: Column, support: Column, seen: Column, origin: Column, hint: Column, as_of: Column, domains: Column | None = None, conflict: Column | None = None) -> Column:
    """0.00 to 1.00 as a double; a missing time of observation counts as new, a missing hint as 0.80."""
    days = F.coalesce(age_days(seen, as_of), F.lit(0))
    fresh = dec(OLDER)
    for limit, value in sorted(RECENCY.items(), reverse=True):
        fresh = F.when(days <= limit, dec(value)).otherwise(fresh)
    hinted = F.least(dec("1.00"), F.greatest(dec("0.50"), F.coalesce(hint.cast("decimal(5,2)"), dec("0.80")) * dec("0.95")))
    reliable = F.when(origin.isin("reviewer", "user", "deterministic"), dec("1.00")).when(origin == "ai", hinted).otherwise(dec("0.80"))
    parts = {"authority": authority(field, tier), "support": _cases(support, SUPPORT, dec("0.80")), "reliability": reliable, "freshness": fresh}
    total = sum((parts[k] * dec(w) for k, w in WEIGHTS.items()), dec("0.00"))
    if domains is not None:
        total = total + F.when(domains >= 2, dec(CORROBORATED)).otherwise(dec("0.00"))
    if conflict is not None:
        total = total - F.when(conflict, dec(CONFLICTING)).otherwise(dec("0.00"))
    return F.round(F.greatest(dec("0.00"), F.least(dec("1.00"), total)), 2).cast("double")


def rating(score: Column) -> Column:
    return F.when(score >= RATINGS["High"], "High").when(score >= RATINGS["Medium"], "Medium").otherwise("Low")


def explanation(score: Column, tier: Column, support: Column, origin: Column, domains: Column | None = None, conflict: Column | None = None) -> Column:
    """The score in words: rating, what supports it, and what adds to it or speaks against it."""
    named = _cases(tier, TIER_NAMES, F.concat(F.lit("Tier "), tier.cast("string")), F.lit)
    said = F.concat(rating(score), F.lit(" confidence ("), F.format_string("%.2f", score), F.lit("): supported by "), named, F.lit(" ("), support, F.lit(" evidence)"))
    more = [F.when(origin.isin("reviewer", "user"), F.lit(BY_HAND))]
    if domains is not None:
        more.append(F.when(domains >= 2, F.format_string(CORROBORATION, domains)))
    if conflict is not None:
        more.append(F.when(conflict, F.lit(WARNING)))
    return F.concat(F.concat_ws("; ", said, *more), F.lit("."))


def freshness(field: Column, seen: Column, as_of: Column) -> Column:
    """fresh, warning or stale by the field's section; a missing time is stale."""
    section, days = F.split_part(field, F.lit("."), F.lit(1)), age_days(seen, as_of)
    limit = lambda i: _cases(section, {k: v[i] for k, v in STALENESS.items()}, F.lit((180, 365)[i]), F.lit)
    return F.when(seen.isNull() | (days > limit(1)), "stale").when(days > limit(0), "warning").otherwise("fresh")


def materiality(field: Column) -> Column:
    return F.when(field.isin(*CRITICAL_FIELDS), "critical").when(field.isin(*HIGH_FIELDS), "high").otherwise("medium")
