"""Association-rule URL filtering, from built-in functions and Spark's FP-growth.

Labelled urls become sets of tokens (runs of ASCII letters and digits, and of anything beyond ASCII), with one item more
for those labelled bad. FP-growth mines the sets that are frequent with that item, which are those frequent among the bad
urls; a rule leads from a set's tokens to it. It is kept if

* ``min_rows`` bad urls have all of its tokens, at every size of the input (the support);
* bad urls are at least ``min_confidence`` of those that have them, and ``min_lift`` times as many as among all;
* their number is ``min_z`` standard deviations above what the share of bad ones among all would give by chance;
* no rule of fewer tokens implies it.

Tokens that ``max_share`` of the labelled urls or more have (the scheme, a common ending) tell nothing and would double the
sets, so they are left out before the mining. A url is blocked if it has all tokens of a rule, which an inverted index
finds: tokens of distinct urls are joined to the rules under one of their tokens each, and a rule matches if the url has
its other tokens as well.

Rules for hosts and paths stated by hand come first: the longest that fits decides.

The mining covers all labelled urls. The index is broadcast only if a count shows that it has at most
``max_broadcast_rows`` rows, else joined by shuffle; so are the urls that rules match.

Defined results: a null url, or one without ``://``, has an empty host and path, no tokens if null, and no hand-written
rule; without labels or without rules that reach the limits everything else is allowed; rows that share a page_id are
judged each by its own url; a labelled id with several urls or labels counts once for each; of rules that match a url the
surest is named (of equal ones that with more rows, then the first by its tokens); urls of any length are taken whole;
columns besides page_id and url are not looked at, so their names can't clash.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, materialise

#: (host, path, verdict)
HAND_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    after = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    out = pages.withColumn("__after", after).withColumn("__host", F.regexp_extract("__after", "^([^/?#]*)", 1))
    out = out.withColumn("path", F.regexp_extract(F.expr("substring(__after, length(__host) + 1)"), "^([^?#]*)", 1))
    return out.withColumn("host", F.translate("__host", _UPPER, _LOWER)).drop("__after", "__host")


def hand_rule(rules=HAND_RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null if none fits. Of equal lengths the first wins."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        which, verdict = F.when(fits, F.lit(host + path)).otherwise(which), F.when(fits, F.lit(said)).otherwise(verdict)
    return which, verdict


def tokens_of(url: Column) -> Column:
    lowered = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    return F.array_distinct(F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda t: t != ""))


RULE = "tokens array<string>, n_bad bigint, n_rows bigint, confidence double, lift double, rule_id bigint"


def mine_rules(
    labelled: DataFrame, *, min_rows: int = 10, min_confidence: float = 0.5, min_lift: float = 1.5, min_z: float = 4.0, max_share: float = 0.9
) -> DataFrame:
    """tokens (sorted), n_bad, n_rows (urls with them), confidence, lift, rule_id; labelled has url and bad (boolean)."""
    spark = labelled.sparkSession
    baskets = labelled.where("url IS NOT NULL AND bad IS NOT NULL").select(tokens_of(F.col("url")).alias("tokens"), "bad")
    n, n_bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
    if n_bad < min_rows:  # no rule can have min_rows bad urls
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in RULE.split(", ")) + " WHERE false")
    common = baskets.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= max_share * n)
    common = [r["token"] for r in common.collect()]  # at most the mean number of tokens by max_share
    kept = F.array_except("tokens", F.array(*map(F.lit, common)).cast("array<string>"))
    # a rule's tokens stand together in min_rows bad urls, so those are mined alone; all urls only count what is found
    bad = baskets.where("bad").select(kept.alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=(min_rows - 0.5) / n_bad).fit(bad).freqItemsets
    sets = materialise(sets.where(F.size("items") > 0).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n_bad"), F.xxhash64(F.array_sort("items")).alias("rule_id")))
    # counted where the urls are read, so that tasks are as many as the scan has
    counts = _met(baskets.withColumn("whose", F.lit(None)), sets).groupBy("rule_id").agg(F.count("*").alias("n_rows"))
    base = n_bad / n
    rules = sets.join(counts, "rule_id").withColumn("confidence", F.col("n_bad") / F.col("n_rows")).withColumn("lift", F.col("confidence") / base)
    beyond = F.col("n_bad") - F.col("n_rows") * base
    sure = (F.col("n_bad") >= min_rows) & (F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift) & (beyond > 0) & (beyond * beyond >= min_z**2 * base * (1 - base) * F.col("n_rows"))
    rules = materialise(rules.where(sure))
    implied = _met(rules.select("tokens", F.col("rule_id").alias("whose")), rules).where("whose <> rule_id").select(F.col("whose").alias("rule_id")).distinct()
    return materialise(rules.join(implied, "rule_id", "left_anti").select(*[c.split()[0] for c in RULE.split(", ")]))


def _met(baskets: DataFrame, rules: DataFrame, max_broadcast_rows: int = 200_000) -> DataFrame:
    """whose, rule_id of the rules of which a basket (whose, tokens) has all tokens.

    A rule stands in the index under the one of its tokens that the fewest rules have, so that a token of many rules brings
    no basket to all of them.
    """
    each = rules.select("rule_id", "tokens", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    index = each.join(often, "token").groupBy("rule_id").agg(F.min(F.struct("often", "token")).alias("key"), F.any_value("tokens").alias("needed")).select("rule_id", "needed", F.col("key.token").alias("token"))
    met = baskets.select("whose", "tokens", F.explode("tokens").alias("token")).join(few(index, max_broadcast_rows), "token")
    return met.where(F.size(F.array_except("needed", "tokens")) == 0).select("whose", "rule_id")


def blocked_urls(urls: DataFrame, rules: DataFrame, **limits) -> DataFrame:
    """url, mined_rule (its tokens), confidence, lift of the urls (distinct) that a rule matches."""
    met = _met(urls.select(F.col("url").alias("whose"), tokens_of(F.col("url")).alias("tokens")), rules, **limits)
    surest = F.struct((-F.col("confidence")).alias("a"), (-F.col("n_rows")).alias("b"), "tokens")
    met = met.join(few(rules), "rule_id").groupBy(F.col("whose").alias("url")).agg(F.min_by(F.struct("tokens", "confidence", "lift"), surest).alias("best"))
    return met.select("url", F.array_join("best.tokens", " ").alias("mined_rule"), "best.confidence", "best.lift")


def judge(pages: DataFrame, labelled: DataFrame, hand_rules=HAND_RULES, **limits) -> DataFrame:
    """page_id, host, path, rule, verdict, and mined_rule, confidence and lift (null without a mined rule) of every row of pages."""
    pages = pages.select("page_id", "url")
    hits = blocked_urls(pages.where("url IS NOT NULL").select("url").distinct(), mine_rules(labelled, **limits))
    which, verdict = hand_rule(hand_rules)
    # pages without a url find nobody, so they needn't meet at one place
    own = F.when(F.col("url").isNull(), F.col("page_id"))
    out = with_host_and_path(pages).withColumn("__own", own)
    hits = few(hits.withColumn("__own", F.lit(None).cast(pages.schema["page_id"].dataType)))
    out = out.join(hits, out.url.eqNullSafe(hits.url) & out["__own"].eqNullSafe(hits["__own"]), "left").drop(hits.url).drop(hits["__own"])
    mined = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", which.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "mined_rule", "confidence", "lift")
