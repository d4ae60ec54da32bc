"""Near-copies by similarity of word shingles: SimHash and MinHash find candidates, the shingles themselves decide.

Copies at a shingle similarity (Jaccard) of 0.8 differ in about ten of SimHash's 64 bits, too many for keys with one
wildcard. So besides fingerprints at two bits, every text has ``BANDS`` keys, each from the smallest values of ``ROWS`` hash
functions over its shingles: one at 0.8 shares a key with a chance of 0.998. Each pair of candidates is verified on all
shingles, and components are built from verified pairs only.

All pairs of a key are candidates if it has at most ``dense`` texts. In a larger group each text is paired with the smallest,
which brings large groups of copies together without all their pairs. What such groups hold besides, as pages of one site
that share a template and are no copies, is found by an exact join over the texts of all large groups. Their shingles are
ordered by rarity. Of two sets at a similarity t, the smaller one, of n shingles, has one of its ``n - 2t/(1+t) n + 1`` rarest
among the ``m - tm + 1`` rarest of the larger, of m; texts that have such a shingle in common and are not yet in one component
are paired. A template's shingles are common ones and so no key of texts that have a ninth of their own. The pairs grow with
the square of the texts only where many share one of their rarest shingles and are in different components still. The limit
chooses between two ways and loses nothing beside the chance of the keys.

Defined results: words are separated by white space, ASCII letters lower-cased; texts of equal words are one node; one of
fewer words than a shingle has a single shingle, and null or blank texts, which have none, are copies of each other; texts of
any length are sketched whole; other columns stay as they are, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, materialise, with_columns_of
from .simhash import components, links

BANDS, ROWS = 20, 6
_rng = np.random.default_rng(42)
_TIMES = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingle_hashes(w: list[bytes], words: int, block: int = 1 << 12) -> Iterator[np.ndarray]:
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)] if w else [])
    n = max(1, len(w) - words + 1) if w else 0
    for at in range(0, n, block):
        m = min(block, n - at)
        yield np.fromiter((xxhash.xxh64_intdigest(s, 42) for s, _ in zip(shingles, range(m), strict=False)), "<u8", m)


def sketch(text: bytes | None, words: int) -> tuple[int, int, list[int]]:
    """The hash of the text's words, its fingerprint, and its keys, as unsigned 64 bits."""
    w = (text or b"").lower().split()
    ones, n, least = np.zeros(64, np.int64), 0, np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for h in shingle_hashes(w, words):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        np.minimum(least, ((h ^ _FLIP) * _TIMES).min(axis=1), out=least)
    fp = int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)] if n else []
    return xxhash.xxh64_intdigest(b" ".join(w), 0), fp, keys


def _signed(values, kind=np.uint64) -> pa.Array:
    return pa.array(np.array(values, kind).view(np.int64))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc, node, fp, keys."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                nodes, fps, keys = zip(*[sketch(t, words) for t in part.column("text").cast(pa.binary()).to_pylist()], strict=True)
                offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, _signed([k for ks in keys for k in ks]))
                yield pa.RecordBatch.from_arrays([part.column("doc"), _signed(nodes), _signed(fps), lists], ["doc", "node", "fp", "keys"])

    return docs.select("doc", "text").mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, node bigint, fp bigint, keys array<bigint>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """node, shingles (their distinct hashes)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets = []
                for t in part.column("text").cast(pa.binary()).to_pylist():
                    every = list(shingle_hashes((t or b"").lower().split(), words))
                    sets.append(np.unique(np.concatenate(every)).view(np.int64) if every else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def _to_least(groups: DataFrame, by: list[str]) -> DataFrame:
    least = groups.groupBy(*by).agg(F.min("node").alias("a"), F.max("node").alias("__hi")).where("a <> __hi").drop("__hi")
    return groups.join(least, by).where("node <> a").select("a", F.col("node").alias("b"))


def _with_size(groups: DataFrame, by: list[str]) -> DataFrame:
    """The groups' rows with n, their number, written out; groups of one are left out."""
    return materialise(groups.join(groups.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), by))


def _all_pairs(groups: DataFrame, by: list[str]) -> DataFrame:
    """Every pair of each group, for groups of bounded size."""
    return groups.select(*by, F.col("node").alias("a")).join(groups.select(*by, F.col("node").alias("b")), by).where("a < b").select("a", "b")


def candidates(nodes: DataFrame, dense: int) -> tuple[DataFrame, DataFrame]:
    """a, b (a < b) of nodes that share a key, or whose fingerprints differ by at most two bits; each pair once.

    And the nodes of the keys with more than dense, of which the pairs are with the smallest only.
    """
    by = ["band", "key"]
    shared = _with_size(nodes.select("node", F.posexplode("keys").alias("band", "key")), by)
    crowded = shared.where(F.col("n") > dense).drop("n")
    prints = materialise(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    linked = links(prints.select("fp")).join(prints.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    linked = linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    found = _all_pairs(shared.where(F.col("n") <= dense), by).union(_to_least(crowded, by)).union(_to_least(nodes.select("fp", "node"), ["fp"])).union(linked)
    return found.distinct(), crowded.select("node").distinct()


def rare_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """a, b (a < b): nodes of different components that can be at the similarity or above; sets: node, component, shingles.

    Rows of a shingle are joined with those outside its largest component only, so a group of copies gives no pairs.
    """
    size, t = F.size("shingles"), float(similarity)
    rows = sets.select("node", "component", size.alias("n"), F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("df"), F.min("component").alias("__lo"), F.max("component").alias("__hi")).where("df > 1")
    often = materialise(often.select("s", "df", F.expr("__lo <> __hi").alias("apart")))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "s"))
    rows = rows.join(often, "s", "left").withColumn("rank", rank).where("apart")
    n = F.col("n")
    rows = rows.where(F.col("rank") <= n - F.ceil(t * n - 1e-9) + 1).withColumn("short", F.col("rank") <= n - F.ceil(2 * t / (1 + t) * n - 1e-9) + 1)
    rows = materialise(rows.select("s", "node", "component", "n", "short"))
    major = rows.groupBy("s", "component").agg(F.count("*").alias("held")).groupBy("s").agg(F.max_by("component", F.struct("held", "component")).alias("major"), F.count("*").alias("parts"))
    rows = materialise(rows.join(major.where("parts > 1"), "s").withColumn("minor", F.col("component") != F.col("major")).drop("major", "parts"))
    x = rows.select("s", F.col("node").alias("x"), F.col("component").alias("of_x"), F.col("n").alias("n_x"), F.col("minor").alias("minor_x"))
    y = rows.where("short").select("s", F.col("node").alias("y"), F.col("component").alias("of_y"), F.col("n").alias("n_y"), F.col("minor").alias("minor_y"))
    fits = (F.col("of_x") != F.col("of_y")) & (F.col("n_y") <= F.col("n_x")) & (F.col("n_y") >= t * F.col("n_x") - 1e-9)
    met = x.join(y.where("minor_y"), "s").where(fits).select("x", "y").union(x.where("minor_x").join(y.where("NOT minor_y"), "s").where(fits).select("x", "y"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets are at the similarity or above."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.withColumn("met", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("met") >= similarity * (F.size("sa") + F.size("sb") - F.col("met"))).select("a", "b")


def keep_one(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, dense: int = 16) -> DataFrame:
    """The smallest document (by doc_id, then text hash; a null doc_id last) of each component, other columns as they are.

    Rows that share a doc_id but not the text are different documents; of rows that repeat both, the one whose columns have
    the smallest hash stays.
    """
    rows = keyed(docs.select("doc_id", "text", with_columns_of(docs).alias("row")))
    marked = rows.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc.doc_id", "doc.of").alias("doc"), "text")
    prints = materialise(sketches(marked, words))
    nodes = materialise(prints.groupBy("node").agg(F.min("doc").alias("doc"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    pairs, crowded = map(materialise, candidates(nodes, dense))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc"), "node")
    sets = materialise(shingle_sets(marked.join(wanted, "doc").dropDuplicates(["node"]), words))
    edges = materialise(_alike(pairs, sets, similarity))
    if crowded.limit(1).count():
        # every node of a crowded key is paired with its smallest, so its set is there
        found = components(edges).select(F.col("fp").alias("node"), F.col("label").alias("component"))
        large = crowded.join(sets, "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        edges = edges.union(_alike(materialise(rare_pairs(materialise(large), similarity)), sets, similarity))
    labels = nodes.select("node", "doc").join(components(edges).withColumnRenamed("fp", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    kept = labels.groupBy("label").agg(F.min("doc").alias("d")).select(F.struct("d.doc_id", "d.of").alias("doc"))
    return rows.join(kept, "doc", "left_semi").groupBy("doc").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
