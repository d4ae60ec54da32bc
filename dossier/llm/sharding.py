"""Two-pass external shuffle into shards.

Pass one scatters whole records by seeded hashes into buckets small enough for memory; pass two shuffles each bucket by
Fisher-Yates (numpy's permutation) and writes it. A shard is a run of buckets, so its records stand in random order. Each
shard has as many buckets as its own bytes need, and records are dealt over as many tasks as there are buckets.

Law ``key``: the shard is the one of highest seeded hash of (doc_id, shard), so doc_id and the number of shards decide,
and one more shard takes rows only into itself. The bucket within the shard follows from doc_id and text. Rows equal in both
whose bytes together exceed a part of a bucket are dealt over all buckets of their shard by the input partition as well
(which a retried task shares): a record that makes up a third of all rows is no single task. Without such rows the slots
don't depend on how the input is partitioned.

Defined results: a null text has no bytes and stays null; a null doc_id is a key like any other; ids of any type that sorts;
repeated rows each get a slot of their own; a text of any length is one record; an input column named like an output
column is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, materialise

OVERHEAD = 16


def record_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + OVERHEAD).cast("long")


def _weights(first: int, last: int, seed: int) -> Column:
    """The struct (weight, shard) of the shard of highest weight."""
    return F.expr(f"array_max(transform(sequence({first}, {last}), s -> struct(xxhash64({seed}, s, doc_id) AS w, s AS s)))")


def with_shard(docs: DataFrame, n_shards: int = 40, seed: int = 7) -> DataFrame:
    """docs with shard, and grown_shard: the shard that one shard more would give."""
    out = docs.withColumn("__own", _weights(0, n_shards - 1, seed)).withColumn("__new", _weights(n_shards, n_shards, seed))
    out = out.withColumn("shard", F.col("__own.s")).withColumn("grown_shard", F.when(F.col("__new.w") > F.col("__own.w"), F.col("__new.s")).otherwise(F.col("__own.s")))
    return out.drop("__own", "__new")


def shuffled(docs: DataFrame, n_shards: int = 40, *, seed: int = 7, bucket_bytes: int = 32 << 20) -> DataFrame:
    """docs with size, shard, grown_shard, bucket and place (from 0, in its bucket), written to the scratch folder."""
    docs = docs.drop("size", "shard", "grown_shard", "bucket", "place").withColumn("size", record_size(F.col("text")))
    docs = with_shard(docs, n_shards, seed)
    sizes = {r["shard"]: r["bytes"] for r in docs.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}  # one row a shard
    buckets = [max(1, math.ceil(sizes.get(k, 0) / bucket_bytes)) for k in range(n_shards)]
    n_buckets = F.element_at(F.array(*map(F.lit, buckets)), F.col("shard") + 1)
    scattered = docs.withColumn("__of", F.xxhash64(F.lit(seed + 1), "doc_id", "text")).withColumn("__n", n_buckets)
    if max(buckets) > 1:
        heavy = scattered.where("__n > 1").groupBy("__of").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > bucket_bytes / 4).select("__of", F.lit(True).alias("__heavy"))
        scattered = scattered.join(few(heavy), "__of", "left")  # their number is bounded by the bytes of all over a quarter of a bucket
        scattered = scattered.withColumn("__of", F.when(F.col("__heavy"), F.xxhash64("__of", F.spark_partition_id(), F.monotonically_increasing_id())).otherwise(F.col("__of"))).drop("__heavy")
    scattered = scattered.withColumn("bucket", F.pmod("__of", "__n").cast("int")).drop("__of", "__n")

    def fisher_yates(key: tuple, bucket: pa.Table) -> pa.Table:
        # rows arrive in any order: a fixed one first, so that a retried task repeats the same shuffle
        ids, texts = bucket["doc_id"].to_pylist(), bucket["text"].cast(pa.binary()).to_pylist()
        order = sorted(range(bucket.num_rows), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, zlib.crc32(texts[i] or b""), texts[i] is not None, texts[i] or b""))
        rng = np.random.default_rng([seed, *(int(k.as_py()) for k in key)])
        bucket = bucket.take(pa.array(np.asarray(order, dtype=np.int64)[rng.permutation(len(order))]))
        return bucket.append_column("place", pa.array(np.arange(len(order), dtype=np.int64)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scattered.schema) + ", place bigint"
    # keys fall on tasks by hash: where buckets are few, more tasks than buckets keep several from one
    n_tasks = max(sum(buckets), min(4 * sum(buckets), 2000))
    dealt = scattered.repartition(min(n_tasks, 100_000), "shard", "bucket")
    return materialise(dealt.groupBy("shard", "bucket").applyInArrow(fisher_yates, schema))


def with_slots(shuffled_docs: DataFrame) -> DataFrame:
    """Adds slot, the place in the whole shard: the rows of the shard's earlier buckets come before.

    The buckets' starts are broadcast if a count shows that they are few, so that the records don't move again.
    """
    counts = shuffled_docs.groupBy("shard", "bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return shuffled_docs.join(few(starts), ["shard", "bucket"]).withColumn("slot", F.col("__start") + F.col("place")).drop("__start")


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, **how) -> None:
    """Writes docs to path, one folder for each shard, in the order of bucket and place."""
    with_slots(shuffled(docs, n_shards, **how)).repartition("shard", "bucket").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
