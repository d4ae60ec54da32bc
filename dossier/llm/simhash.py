"""SimHash near-dedup by deletion-variant signatures.

Fingerprints link at two or fewer differing bits. The 64 bits are cut into two segments, so that of two such fingerprints
one segment differs by at most one bit. Each fingerprint is indexed under both segments with each one of their bits made a
wildcard, 64 keys; fingerprints that link share a key, and those that share one are verified.

A key that many different fingerprints share would give as many pairs as the square of their number. Those fingerprints
are indexed instead under all their variants with two wildcards among all 64 bits: sharing such a variant is the link
itself, so each variant's fingerprints are linked to their smallest one, without pairs. The limit chooses between two exact
ways; it drops nothing.

The keys have 31 bits, so of n fingerprints some n * n / 2**26 pairs meet by chance: as many as there are fingerprints at
some 67 million, a hundred for each at seven thousand million. Beyond that the keys are crowded, and the other way holds.

Components are found among distinct fingerprints by spreading the smallest label over the links, with pointer jumping,
each round written to the scratch folder. Their joins go by shuffle: the tables grow with the input, and a compressed size
says little about the memory that a broadcast would take.

Defined results: a null or blank text has the fingerprint zero, linked like any other; a null doc_id is never the smallest
while a component has others; equal rows get equal results; a text of any length is read whole; columns besides doc_id and
text are not looked at, so their names can't clash; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MAX_BITS = 2


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """Unsigned 64 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])
    n = max(1, len(w) - words + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, block):
        m = min(block, n - at)
        h = np.fromiter((digest(s, seed) for s, _ in zip(shingles, range(m), strict=False)), "<u8", m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                fps = [fingerprint(t, words, seed) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _without(bits: tuple[int, ...]) -> int:
    """The mask that clears these bits, as a signed long."""
    mask = (1 << 64) - 1
    for b in bits:
        mask &= ~(1 << b)
    return mask - (1 << 64) if mask >> 63 else mask


def _star(keys: DataFrame, by: list[str]) -> DataFrame:
    """Links of all fp of a key to the smallest one; keys has by and fp, each pair once."""
    least = keys.groupBy(*by).agg(F.min("fp").alias("a"), F.max("fp").alias("__hi")).where("a <> __hi").drop("__hi")
    return keys.hint("merge").join(least, by).where("fp <> a").select("a", F.col("fp").alias("b"))


def links(nodes: DataFrame, dense: int = 64) -> DataFrame:
    """a, b: links between different fingerprints, enough to connect all that differ by at most two bits."""
    segment = F.expr("CASE WHEN bit < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END & ~shiftleft(1L, bit % 32)")
    keys = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select("fp", (segment + F.expr("shiftleft(CAST(bit AS BIGINT), 32)")).alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keys.hint("merge").join(counts, "key"))
    sparse, crowded = shared.where(F.col("n") <= dense), shared.where(F.col("n") > dense)
    pairs = sparse.select("key", F.col("fp").alias("a")).join(sparse.select("key", F.col("fp").alias("b")), "key")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    masks = F.array(*[F.lit(_without(c)) for c in combinations(range(64), MAX_BITS)])
    variants = crowded.select("fp").distinct().select("fp", F.posexplode(masks).alias("which", "mask"))
    variants = variants.select("fp", "which", F.col("fp").bitwiseAND(F.col("mask")).alias("variant"))
    return pairs.union(_star(variants, ["which", "variant"])).distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp, label (the same for all fp that edges connect) of every fp in edges (a, b)."""
    edges = materialise(edges)
    both = edges.union(edges.select("b", "a")).hint("merge")
    labels = materialise(both.select(F.col("a").alias("fp")).distinct().withColumn("label", F.col("fp")))
    while True:
        near = both.join(labels, both.b == labels.fp).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.hint("merge").join(near, labels.fp == near.a, "left").select("fp", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        step = materialise(step)
        jump = step.select(F.col("fp").alias("via"), F.col("label").alias("further"))
        step = materialise(step.hint("merge").join(jump, step.label == jump.via).select("fp", "was", F.least("label", "further").alias("label")))
        labels = step.select("fp", "label")
        if step.where("label <> was").limit(1).count() == 0:
            return labels


def group(docs: DataFrame, words: int = 3, seed: int = 42, *, dense: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of every row of docs."""
    prints = materialise(fingerprints(docs, words, seed))
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("fp"), dense))
    nodes = nodes.hint("merge").join(found, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = nodes.select("fp", "label").hint("merge").join(least, "label").select("fp", "component_id")
    return prints.hint("merge").join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
