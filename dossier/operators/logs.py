"""Logs, usage, sources and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import new_folder, written
from . import extraction


def ai_usage(runs: DataFrame) -> DataFrame:
    return runs.groupBy("workspace_id").agg(F.count("*").alias("n_runs"), F.round(F.sum("cost_usd"), 4).cast("double").alias("cost_usd"))


def within_budget(runs: DataFrame, budget: str = "1.00", reserve: str = "0.10") -> DataFrame:
    """The runs of each job up to its first refusal: spent so far plus a reserve must stay within the budget."""
    w = Window.partitionBy("job_id").orderBy("created_at", "run_id")
    spent = F.coalesce(F.sum("cost_usd").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = runs.withColumn("refused", (spent + F.lit(reserve).cast("decimal(6,2)") > F.lit(budget).cast("decimal(6,2)")).cast("int"))
    return out.withColumn("stopped", F.max("refused").over(w)).where("stopped = 0").select("job_id", "run_id", "cost_usd")


def ai_status(runs: DataFrame) -> DataFrame:
    """completed, partial or unavailable for each job, with its first failed run."""
    out = runs.groupBy("job_id").agg(F.count("*").alias("n"), F.count_if(F.col("validation_outcome") == "failed").alias("n_failed"), F.min(F.when(F.col("validation_outcome") == "failed", F.col("run_id"))).alias("first_failed"))
    status = F.when(F.col("n_failed") == 0, "completed").when(F.col("n_failed") == F.col("n"), "unavailable").otherwise("partial")
    return out.select("job_id", status.alias("status"), "first_failed")


def fetch_stats(attempts: DataFrame) -> DataFrame:
    """Attempts by adapter and outcome, with sums for each adapter and over all, in one pass."""
    out = attempts.rollup("adapter", "outcome_code").agg(F.count("*").alias("n"), F.count_if(F.col("http_status") >= 500).alias("n_server_errors"))
    return out.select(F.coalesce("adapter", F.lit("all")).alias("adapter"), F.coalesce("outcome_code", F.lit("all")).alias("outcome_code"), "n", "n_server_errors")


def source_status(sources: DataFrame, attempts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each source with its latest attempt and its latest snapshot."""
    last = attempts.groupBy("source_id").agg(F.max_by(F.struct("attempt_id", "outcome_code", "http_status"), F.struct("started_at", "attempt_id")).alias("last"))
    seen = snapshots.groupBy("source_id").agg(F.max_by("snapshot_id", F.struct("retrieved_at", "snapshot_id")).alias("snapshot_id"), F.count("*").alias("n_snapshots"))
    out = sources.join(last, "source_id", "left").join(seen, "source_id", "left")
    return out.select("source_id", "last.attempt_id", "last.outcome_code", "last.http_status", "snapshot_id", F.coalesce("n_snapshots", F.lit(0)).alias("n_snapshots"))


def audit_trail(log: DataFrame, *, action: str | None = None, actor_id: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The rows of an action and an actor, newest first: of each workspace those from offset on, at most limit."""
    for column, value in (("action", action), ("actor_id", actor_id)):
        if value is not None:
            log = log.where(F.col(column) == value)
    return recent(log, "workspace_id", "created_at", "audit_id", offset + limit).where(F.col("place") > offset)


def children(rows: DataFrame, parent: str, order: list) -> DataFrame:
    """The rows of each parent with their place in the given order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def recent(rows: DataFrame, key: str, order: str, tie: str, n: int = 50) -> DataFrame:
    """The newest n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def vocab_violations(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    return rows.where(~F.col(column).isin(*allowed)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def key_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def unique_snapshots(snapshots: DataFrame, content_hash: Column) -> DataFrame:
    """The earliest snapshot of each source and content."""
    hashed = snapshots.withColumn("content_hash", content_hash)
    return hashed.groupBy("workspace_id", "source_id", "content_hash").agg(F.min("snapshot_id").alias("snapshot_id"))


def _grams(names: DataFrame, size: Column) -> DataFrame:
    """names (workspace_id, name, ...) with each different piece (gram) of a size."""
    return names.select("*", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - size + 1), lambda i: F.substring("name", i, size)))).alias("gram"))


def names_within(short: DataFrame, long: DataFrame, q: int = 3) -> DataFrame:
    """workspace_id, short, long of the names (workspace_id, name, each once) of which one holds the other.

    A short name is looked for under the one of its pieces of q letters that the fewest long names have; if some piece is in
    none, no name holds it. Shorter names are pieces themselves. The cost is a row for each letter of the names, besides
    the names that share the rarest piece.
    """
    size = F.least(F.length("name"), F.lit(q))
    sizes = short.select("workspace_id", size.alias("size")).distinct()
    pieces = _grams(long.join(sizes, "workspace_id").where("size <= length(name)"), F.col("size"))
    often = pieces.groupBy("workspace_id", "gram").agg(F.count("*").alias("often"))
    keys = _grams(short, size).join(often, ["workspace_id", "gram"], "left").groupBy("workspace_id", "name")
    keys = keys.agg(F.min(F.struct("often", "gram")).alias("key"), F.count_if(F.col("often").isNull()).alias("missing")).where("missing = 0")
    met = keys.select("workspace_id", F.col("name").alias("short"), F.col("key.gram").alias("gram")).join(pieces.select("workspace_id", "gram", F.col("name").alias("long")), ["workspace_id", "gram"])
    return met.where(F.contains("long", "short")).select("workspace_id", "short", "long")


def duplicate_pairs(new: DataFrame, companies: DataFrame, folder: str | None = None) -> DataFrame:
    """workspace_id, new_id, company_id: companies that a new one shares a tax id or registration number with, or its name."""
    return duplicate_candidates(new, companies, folder).select("workspace_id", "new_id", "company_id").distinct()


#: Companies of one name are met in parts of about so many, so that a name that many have is no single task's work.
PART = 1000


def duplicate_candidates(new: DataFrame, companies: DataFrame, folder: str | None = None) -> DataFrame:
    """workspace_id, new_id, company_id, score, reason of the companies that a new one may be.

    Identifiers lead to their first company. Of two names one must hold the other. Names are worked out once, into the
    folder, and compared each once, however many companies have them. Merged companies are found by identifiers only, and
    an empty name finds nobody. Pairs that names find and those that only identifiers do are apart, so no step sorts out
    repeated pairs.
    """
    folder = folder or new_folder(new.sparkSession)
    ids = ["tax_id", "registration_number"]

    def named(rows: DataFrame, *kept: str) -> DataFrame:
        return written(rows.select("workspace_id", *kept, *ids, text.normalize_name(F.col("company_name")).alias("name")), f"{folder}/{kept[0]}")

    wanted, known = named(new, "new_id"), named(companies, "company_id", "status")
    other = known.withColumnsRenamed({c: f"other_{c}" for c in [*ids, "name"]})
    own = lambda rows: rows.where("name <> ''").groupBy("workspace_id", "name").agg(F.ceil(F.count("*") / PART).alias("parts"))
    open_ = known.where("status <> 'merged'")
    each = [own(rows) for rows in (wanted, open_)]
    pairs = names_within(each[0], each[1]).select("workspace_id", F.col("short").alias("name"), F.col("long").alias("other_name")).union(names_within(each[1], each[0]).select("workspace_id", "long", "short")).distinct()

    parts = written(each[1].withColumnRenamed("name", "other_name"), f"{folder}/parts")
    met = wanted.join(pairs.join(parts, ["workspace_id", "other_name"]), ["workspace_id", "name"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    key = ["workspace_id", "other_name", "part"]
    dealt = other.where("status <> 'merged'").join(parts, ["workspace_id", "other_name"]).withColumn("part", F.pmod(F.xxhash64("company_id"), "parts")).drop("parts")
    by_name = met.repartition(4 * new.sparkSession.sparkContext.defaultParallelism, *key).join(dealt, key)

    first = lambda k, to: known.where(F.col(k) != "").groupBy("workspace_id", k).agg(F.min("company_id").alias(to))
    found = wanted.join(first(ids[0], "a"), ["workspace_id", ids[0]], "left").join(first(ids[1], "b"), ["workspace_id", ids[1]], "left")
    found = found.withColumn("company_id", F.explode(F.array_distinct(F.array_compact(F.array("a", "b"))))).join(other, ["workspace_id", "company_id"])
    within = (F.col("status") != "merged") & (F.col("name") != "") & (F.col("other_name") != "") & (F.contains("name", "other_name") | F.contains("other_name", "name"))
    by_id = found.where(~F.coalesce(within, F.lit(False)))
    out = [rows.select("workspace_id", "new_id", "company_id", extraction.match_score(F.col("name"), F.col("other_name")).alias("m")) for rows in (by_name, by_id)]
    return out[0].union(out[1]).select("workspace_id", "new_id", "company_id", "m.score", "m.reason")
