"""Mixing sources to target weights by hash thresholds.

Each source gets a share of the budget by its weight, at most ``at_most`` times its own words; what that leaves over is
shared again. A target holds so many whole passes over its source and a rest. The rest is a threshold on a hash of the
documents: words are summed by source and hash bucket, the bucket in which the running sum meets the rest is the only one
that is refined by further bits of the hash, until it holds one hash value. Documents below the threshold are taken once
more. Nothing is sorted; a document's share depends on its hash and its source's threshold alone, so the mix of a smaller
budget is part of that of a larger one.

A level's histogram has at most ``2 ** LEVEL_BITS`` rows a source, and levels after the first read one bucket of each
source. Sources are levelled by sums over their table, one row a round, so there may be many of them.

Defined results: null texts have no words and are never counted; a null source is a source, the last one; documents equal in
doc_id, source and text have one hash, and if the threshold falls on it, as many of them are taken as come nearest to the
rest; a source without words has the target zero; other columns stay as they are, whatever their names; a text of any length
is counted whole; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, few, materialise, ranked, with_columns_of

WEIGHTS, AT_MOST = (1, 2, 3), 3
LEVELS, LEVEL_BITS, SALTS = 5, 12, 6
_BITS = LEVELS * LEVEL_BITS


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def hash_of(seed: int = 0) -> Column:
    """60 bits of the MD5 of a document's id, source and text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(other)) for c, other in (("doc_id", "-"), ("source", "-"), ("text", ""))]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, _BITS // 4), 16, 10).cast("long")


def keys(docs: DataFrame, seed: int = 0, *carried: str) -> DataFrame:
    """source, size, h of every document, and what else is carried along."""
    return docs.select("source", size_of(F.col("text")).alias("size"), hash_of(seed).alias("h"), *carried)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.0, at_most: float = AT_MOST) -> DataFrame:
    """source, source_size, target of each source in sizes (source, size); weights go round by the sources' order."""
    totals = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [], [F.asc_nulls_last("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double")
    totals = materialise(totals.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(at_most))).alias("cap")))
    whole = (totals.agg(F.sum("source_size")).first()[0] or 0) * float(budget)
    level = 0.0
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        full, open_ = totals.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        last, level = level, (whole - full) / open_ if open_ else math.inf
        if level <= last or not open_:
            break
    shared = F.lit(whole - full) * F.col("weight") / F.lit(open_ or 1.0)
    return totals.select("source", "source_size", F.when(above, F.col("cap")).otherwise(F.least(shared, "cap")).alias("target"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with passes, cut (the hash at which the rest ends), n (rows of that hash) and more (as many of them are taken).

    sizes: source, size, h; read once for each level.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    wanted = materialise(wanted.select("*", passes.alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("rest")))
    open_ = wanted.where("rest > 0").select(F.col("source").alias("of"), F.lit(0).cast("long").alias("prefix"), "rest")
    for level in range(LEVELS):
        shift = _BITS - LEVEL_BITS * (level + 1)
        here = [F.col("source").eqNullSafe(F.col("of")), F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")]
        rows = sizes.join(few(open_.select("of", "prefix")), here) if level else sizes
        bins = rows.groupBy("source", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("h").alias("least"), F.max("h").alias("most"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = bins.withColumn("before", before).join(few(open_.select("of", "rest")), F.col("source").eqNullSafe(F.col("of")))
        met = met.where("before < rest AND rest <= before + words")
        met = materialise(met.select("of", F.col("bin").alias("prefix"), (F.col("rest") - F.col("before")).alias("rest"), "words", "n", "least", "most"))
        open_ = met.select("of", "prefix", "rest")
        if not met.where("least <> most").limit(1).count():
            break
    cuts = met.select("of", F.col("least").alias("cut"), "n", F.floor(F.col("rest") * F.col("n") / F.col("words") + 0.5).alias("more"))
    return wanted.drop("rest").join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def repeated(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (source, size, h, ...) with source_size, target, and repeats: how often the mix takes each.

    The cuts are dealt over some bits of the hash, so that the join by shuffle, where sources are too many to broadcast,
    parts a large source.
    """
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << SALTS) - 1).cast("long"))).alias("salt")
    cuts = few(cuts.withColumnRenamed("source", "of").select("*", salts))
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", _BITS - SALTS) == F.col("salt"))).drop("of", "salt")
    own = ["source_size", "target"]
    whole = joined.where("cut IS NULL OR h <> cut OR more IN (0, n)")
    whole = whole.select(*rows.columns, *own, (F.col("passes") + F.coalesce((F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & (F.col("more") > 0)), F.lit(False)).cast("long")).alias("repeats"))
    if not cuts.where("more > 0 AND more < n").limit(1).count():
        return whole
    parted = ranked(joined.where("h = cut AND more > 0 AND more < n"), ["source"], [])
    return whole.union(parted.select(*rows.columns, *own, (F.col("passes") + (F.col("number") < F.col("more")).cast("long")).alias("repeats")))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.0, at_most: float = AT_MOST, seed: int = 0) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    sizes = materialise(keys(docs, seed))
    cuts = materialise(thresholds(sizes, targets(sizes, weights, budget, at_most)))
    rows = docs.select("doc_id", "source", "text", with_columns_of(docs).alias("row"))
    taken = repeated(keys(rows, seed, "row"), cuts).where("repeats > 0 AND size > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "repeats"))).select("row.*")


def shares(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.0, at_most: float = AT_MOST, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every document."""
    sizes = materialise(keys(docs, seed, "doc_id"))
    cuts = materialise(thresholds(sizes, targets(sizes, weights, budget, at_most)))
    return repeated(sizes, cuts).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))
