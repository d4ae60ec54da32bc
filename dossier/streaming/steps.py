"""The incremental steps as Structured Streaming jobs. Each runs over what has arrived and returns its table.

Every micro-batch writes a folder of its own, named by the batch and overwritten if the batch is run again, so a restart
from the checkpoint neither loses rows nor doubles them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import blocks, changes, facts, review, structured
from ..sources.scratch import new_folder
from .conflict_state import FOUND, GROUPS, Conflicts


_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in RocksDB: on disk, and written on by its changes."""
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        yield
    finally:
        spark.conf.unset(_STORE[0]) if before is None else spark.conf.set(_STORE[0], before)


def _run(stream: DataFrame, write, mode: str, folder: str) -> None:
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def unique_snapshots(stream: DataFrame, content_hash: Column, *, folder: str | None = None) -> DataFrame:
    """workspace_id, source_id, content_hash, once each.

    The keys seen are keyed state, so a batch reads what is stored of its own keys and not the table, however long that is.
    """
    folder = folder or new_folder(stream.sparkSession)
    rows = stream.select(F.col("workspace_id").cast("int"), F.col("source_id").cast("bigint"), content_hash.alias("content_hash"))
    return _each_once(rows, folder)


def _each_once(stream: DataFrame, folder: str) -> DataFrame:
    """The rows of the stream, each once, as a table below the folder."""
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    with _rocksdb(spark):
        _run(stream.dropDuplicates(), write, "append", folder)
    return spark.read.schema(schema).parquet(f"{folder}/table").select(*schema.names)


def audit_counts(stream: DataFrame, *, folder: str | None = None, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """starts, action, n, n_redacted: events of each tumbling window; rows later than the watermark are dropped.

    A window's counts only grow, so of the updates written the one of the latest batch holds.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark)
    hidden = F.exists(F.map_entries(F.from_json("metadata_json", "map<string,string>")), lambda e: text.redact(e["key"], F.lit("")) != "")
    counts = stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay).groupBy(F.window("created_at", window).alias("w"), "action").agg(F.count("*").alias("n"), F.count_if(hidden).alias("n_redacted"))
    counts = counts.select(F.col("w.start").alias("starts"), "action", "n", "n_redacted")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    _run(counts, write, "update", folder)
    rows = spark.read.schema("starts timestamp, action string, n bigint, n_redacted bigint, batch bigint").parquet(f"{folder}/table")
    return rows.groupBy("starts", "action").agg(F.max_by(F.struct("n", "n_redacted"), "batch").alias("last")).select(F.col("starts").cast("timestamp_ntz").alias("starts"), "action", "last.*")


def page_facts(stream: DataFrame, *, folder: str | None = None) -> DataFrame:
    """page_id, field_key, value of the facts that captured pages (page_id, url, html) state, each once, in the first batch that has it.

    A first stream writes what each batch of pages states; a second one reads that and keeps the facts seen as keyed state.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark)
    keys = ["page_id", "field_key", "value"]

    def write(batch: DataFrame, number: int) -> None:
        made = blocks.html_blocks(batch.select("page_id", "url", "html").dropDuplicates(["page_id"]))
        stated = structured.structured_facts(made.where(F.col("block_key").startswith("json_ld")), ["page_id", "block_key"]).select(*keys)
        lines = changes.label_facts(made.select(F.lit(0).alias("workspace_id"), F.col("page_id").alias("company_id"), "block_key", "text_content"))
        rows = stated.union(lines.select("company_id", "field_key", F.to_json(F.array("value")).alias("value")).select("company_id", "field_key", F.expr("substring(value, 2, length(value) - 2)")))
        rows.select(F.col("page_id").cast("bigint"), "field_key", "value").distinct().write.mode("overwrite").parquet(f"{folder}/stated/batch={number}")

    _run(stream, write, "append", f"{folder}/pages")
    stated = spark.readStream.schema("page_id bigint, field_key string, value string").parquet(f"{folder}/stated/batch=*")
    return _each_once(stated, folder)


def conflicts(stream: DataFrame, *, folder: str | None = None) -> DataFrame:
    """The conflicts among all facts that arrived, a field's first fact by id being the primary.

    stream has the key, fact_id, value_type, value_json and fact_status, and if it is to close conflicts, action (one of the
    statuses of closed ones, on rows without a fact) and seq, the order of events. The result has the key, n_facts,
    n_differing, materiality, status (open, a closed one or reopened), n_attached, and of the last reopening first_new and
    n_new. A field's facts are keyed state, so a batch reads what is stored of its own fields only, many fields a call. Of a
    field's results that of its last batch holds.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark)
    key = list(facts.FACT_KEY)
    events = stream if "action" in stream.columns else stream.withColumns({"action": F.lit(None).cast("string"), "seq": F.lit(0).cast("bigint")})
    kinds = dict(c.split() for c in "workspace_id int, company_id string, field_key string, context_key string, fact_id bigint, value_type string, value_json string, fact_status string, action string, seq bigint".split(", "))
    events = events.select(*[F.col(c).cast(kind) for c, kind in kinds.items()])
    # ids travel as text, as integers with nulls among them would become floats; events without a place come last
    group = F.pmod(F.xxhash64(*key), F.lit(GROUPS)).cast("int")
    events = events.withColumns({"fact_id": F.col("fact_id").cast("string"), "seq": F.coalesce("seq", F.lit((1 << 63) - 1)), "__group": group})
    states = events.groupBy("__group").transformWithStateInPandas(Conflicts(), FOUND, "Update", "none")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    with _rocksdb(spark):
        _run(states, write, "update", folder)
    rows = spark.read.schema(FOUND + ", batch bigint").parquet(f"{folder}/table")
    own = [c.split()[0] for c in FOUND.split(", ")[len(key) :]]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*own), "batch").alias("last")).select(*key, "last.*")
    return last.where("n_differing > 0 OR status IS NOT NULL").withColumn("materiality", scoring.materiality(F.col("field_key")))


def review_states(stream: DataFrame, *, folder: str | None = None) -> DataFrame:
    """task_id, status, assigned_to, row_version, n_refused after all events (task_id, seq, action, actor) that arrived.

    Each batch leaves one row a task that it has events of, which says what they do to whatever state the task is in, so a
    batch reads no state and nothing but itself; a task's state follows from its rows in the order of batches. The events of a
    batch are applied in order of seq. An event that arrives after a later one of an earlier batch is applied where it arrives.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        review.summed(batch).write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    _run(stream.select(F.col("task_id").cast("bigint"), "seq", "action", "actor"), write, "append", folder)
    rows = spark.read.schema(f"task_id bigint, {review.CHANGE}, batch bigint").parquet(f"{folder}/table")
    change = F.struct("batch", *[c.split()[0] for c in review.CHANGE.split(", ")])
    changes = rows.groupBy("task_id").agg(F.array_sort(F.collect_list(change)).alias("changes"))
    return review.shown_state(changes, F.aggregate("changes", review.opened(), review.after))
