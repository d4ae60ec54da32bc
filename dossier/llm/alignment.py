"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes of a text.

Arrow-native pipeline. A task takes chunks of texts of bounded size. A text is cut into stretches at places that no token of
either vocabulary crosses: before a single blank or newline between two characters that are no white space. Both tokenizers
run once for each different stretch of a chunk. Token lists are flattened beside their parents, cumulative sums that start
anew with each parent give the bytes at which tokens end, and an Acero full outer join of both sides on (parent, end) sorts
out the rest: ends that both sides have cut groups, and each row, its gaps filled from the next row, is one overlapping pair
of tokens. ``Table.group_by`` counts a chunk's documents for each pair of ids, and Spark sums those partial counts.

A chunk is written as rows of some documents each: these as lists of stretches, the stretches as lists of pairs, and the
pairs. The second pass reads that, not the texts. It looks up the counts of at most ``frequent`` pairs, those with the highest, in arrays
sent to each task; links of all other pairs go by a shuffle join, and as their counts are lower than those sent, no such
pair is held by many documents. Both ways are exact, and neither drops a link.

Defined results: a null or empty text, and one of which either side's tokens don't give back the bytes, has no tokens;
strings of special tokens are plain text; repeated rows count as documents of their own; a text longer than a chunk is a
chunk of its own, read whole; columns besides doc_id and text are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .packing import _byte_letters

CHUNK_BYTES, PART_BYTES, FREQUENT = 4 << 20, 64 << 10, 1 << 20
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: The pre-tokeniser's pattern of the byte-level vocabulary. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level vocabulary from its JSON file: ids and token bytes.

    Where the merges stand in the order of their ids, as they do in vocabularies that are trained merge by merge, the
    faster encoder gives the same ids and is used for all but very long runs without a cut.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = {letter: b for b, letter in _byte_letters().items()}
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(letters[x] for x in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(file["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        ids = [file["model"]["vocab"][a + b] for a, b in merges]
        self.fast = None
        if ids == sorted(ids) and file["pre_tokenizer"]["type"] == "ByteLevel" and file["normalizer"] is None:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def encode(self, texts: list[str], longest: int) -> list[list[int]]:
        short = (lambda t: self.fast.encode_ordinary(t)) if self.fast else (lambda t: self.whole.encode(t, add_special_tokens=False).ids)
        return [short(t) if len(t) < longest else self.whole.encode(t, add_special_tokens=False).ids for t in texts]

    def flat(self, stretches: list[str], longest: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
        """ids of all stretches in a row, and the number of them of each.

        Stretches that start and end like cuts are encoded in a row; token ends part them again.
        """
        if not self.fast:
            return _flat(self.encode(stretches, longest))
        plain = [len(s) < longest and not s[-1].isspace() and s[:1] in " \n" and not s[1:2].isspace() for s in stretches]
        own = self.fast.encode_ordinary("".join(s for s, p in zip(stretches, plain, strict=True) if p))
        sizes = self.sizes[own] if own else np.zeros(0, np.int64)
        ends = np.cumsum([len(s.encode()) for s, p in zip(stretches, plain, strict=True) if p], dtype=np.int64)
        parts = np.diff(np.searchsorted(np.cumsum(sizes), ends, "right"), prepend=0)
        counts = np.zeros(len(stretches), np.int64)
        counts[np.flatnonzero(plain)] = parts
        odd = {k: ids for k, ids in zip(np.flatnonzero(~np.array(plain, bool)), self.encode([s for s, p in zip(stretches, plain, strict=True) if not p], longest), strict=True)}
        if not odd:
            return np.array(own, np.int32), counts
        out, at, starts = [], 0, np.cumsum(counts)
        for k, ids in sorted(odd.items()):
            out += [own[at : starts[k]], ids]
            at, counts[k] = starts[k], len(ids)
        return np.array([i for part in [*out, own[at:]] for i in part], np.int32), counts


class Pieces:
    """A vocabulary of pieces that marks blanks: ids and token bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]

    def flat(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ByteLevel.flat; the model puts a blank before each text, which is the stretch's own or is left out again."""
        ids = self.model.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        return _flat([own if s[0] == " " else own[1:] for s, own in zip(stretches, ids, strict=True)])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for ids in lists for i in ids], np.int32), np.array([len(ids) for ids in lists], np.int64)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def token_ends(tokens: pa.ListArray, sizes: pa.Array) -> pa.Table:
    """of (the parent list), end (bytes from the parent's start), id, for each token in a row."""
    parents, ids = pc.list_parent_indices(tokens), pc.list_flatten(tokens)
    sums = pc.cumulative_sum(pc.take(sizes, ids))
    before = np.concatenate([[0], sums.to_numpy()])[tokens.offsets.to_numpy()[:-1]]
    return pa.table({"of": pc.cast(parents, pa.int64()), "end": pc.subtract(sums, pc.take(pa.array(before, pa.int64()), parents)), "id": ids})


def align(a: pa.ListArray, b: pa.ListArray, a_sizes: pa.Array, b_sizes: pa.Array) -> pa.Table:
    """of, a, b of each overlapping pair of tokens, in order; a_ends, b_ends: which of the two ends with the overlap.

    The lists of both sides stand for equal bytes. Every byte at which any token ends closes the overlap of one pair, so the
    pairs are the ends of both sides, and a token that goes on is that of its side's next end.
    """
    ends = [token_ends(t, s).rename_columns(["of", "end", name]) for t, s, name in ((a, a_sizes, "a"), (b, b_sizes, "b"))]
    met = ends[0].join(ends[1], ["of", "end"], join_type="full outer", use_threads=False).combine_chunks()
    met = met.take(pc.sort_indices(pc.bit_wise_or(pc.shift_left(met["of"], 32), met["end"])))
    filled = {c: pc.fill_null_backward(met[c]) for c in ("a", "b")}
    return pa.table({"of": met["of"], **filled, "a_ends": pc.is_valid(met["a"]), "b_ends": pc.is_valid(met["b"])}).combine_chunks()


def _bytes_of(table: pa.Array, ids: pa.Array, counts: np.ndarray) -> pa.Array:
    return pc.binary_join(_lists(counts, pc.take(table, ids)), b"")


def _numpy(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _spread(which: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places in a flat array of lists of those lists, in the order of which; counts: the length of each list."""
    n = counts[which]
    return np.arange(n.sum()) + np.repeat((np.cumsum(counts) - counts)[which] - (np.cumsum(n) - n), n)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each list's values."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])


class Aligner:
    """Aligns chunks of texts; one for each worker and pair of vocabularies."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.tables = [pa.array(v.bytes, pa.binary()) for v in (self.a, self.b)]
        self.sizes = [pc.cast(pc.binary_length(t), pa.int64()) for t in self.tables]

    def stretches(self, texts: list[str]) -> dict:
        """For each of some different stretches: n_a, n_b, n_groups, their groups as text, ok; and the pairs of all of them."""
        tokens = [(pa.array(ids, pa.int32()), n) for ids, n in (self.a.flat(texts), self.b.flat(texts))]
        own = pa.array([t.encode() for t in texts], pa.binary())
        ok = _numpy(pc.and_(*[pc.equal(_bytes_of(t, ids, n), own) for t, (ids, n) in zip(self.tables, tokens, strict=True)]))
        if not ok.all():
            tokens = [(ids.filter(pa.array(np.repeat(ok, n))), n * ok) for ids, n in tokens]
        met = align(*[_lists(n, ids) for ids, n in tokens], *self.sizes)
        ends = [_numpy(met[c]) for c in ("a_ends", "b_ends")]
        both = np.flatnonzero(ends[0] & ends[1])
        # a group has the tokens of either side that end after the last common end, up to its own
        sides = [pc.binary_join(_lists(np.diff(np.cumsum(e)[both], prepend=0), pc.cast(ids, pa.string())), ",") for e, (ids, _) in zip(ends, tokens, strict=True)]
        of = _numpy(met["of"])
        n_groups = np.bincount(of[both], minlength=len(texts))
        text = pc.binary_join(_lists(n_groups, pc.binary_join_element_wise(*sides, "|")), ";")
        pairs = pc.dictionary_encode(pc.bit_wise_or(pc.shift_left(pc.cast(met["a"], pa.int64()), 32), pc.cast(met["b"], pa.int64())).combine_chunks())
        counts = {"n_a": tokens[0][1], "n_b": tokens[1][1], "n_groups": n_groups, "n_links": np.bincount(of, minlength=len(texts))}
        return {"counts": counts, "groups": text, "ok": ok, "codes": _numpy(pairs.indices), "pairs": _numpy(pairs.dictionary)}

    def chunk(self, doc_ids: pa.Array, texts: list[str | None], part_bytes: int) -> Iterator[dict[str, pa.Array]]:
        """The columns of a chunk's rows, each with one value; the first row has the chunk's pairs with their documents."""
        cut = [_CUT.split(" " + t) if t else [] for t in texts]
        every = pc.dictionary_encode(pa.array([s for own in cut for s in own], pa.string()))
        found = self.stretches(every.dictionary.to_pylist())
        units, n = _numpy(every.indices), np.array([len(own) for own in cut], np.int64)
        del cut, every
        bad = _sums(~found["ok"][units], n) > 0
        if bad.any():
            units, n = units[np.repeat(~bad, n)], n * ~bad
        text = pc.binary_join(_lists(n, pc.take(found["groups"], pa.array(units))), ";").to_pylist()
        sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
        counts = {c: _sums(v[units], n) for c, v in found["counts"].items()}
        links, codes, pairs = found["counts"]["n_links"], found["codes"], found["pairs"]
        # a document's different stretches, then its different pairs
        keys = _numpy(pc.unique(pa.array(np.repeat(np.arange(len(texts)), n) << 32 | units, pa.int64())))
        docs, which = keys >> 32, keys & 0xFFFFFFFF
        held = pa.table({"doc": np.repeat(docs, links[which]), "pair": codes[_spread(which, links)]})
        held = held.group_by(["doc", "pair"], use_threads=False).aggregate([]).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        counted = [*_halves(pairs[_numpy(held["pair"])]), _numpy(held["count_all"])]
        size = np.cumsum([len(t or "") for t in texts])
        ends = np.concatenate([[0], np.cumsum(n)])
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, part_bytes + (size[at - 1] if at else 0), "right")))
            own, here = np.unique(units[ends[at] : ends[end]], return_inverse=True)
            known, place = np.unique(codes[_spread(own, links)], return_inverse=True)
            yield {
                "doc_id": _one(doc_ids.slice(at, end - at)), **{c: _one(v[at:end], pa.int64()) for c, v in counts.items()}, "groups_sha256": _one(sha[at:end], pa.string()),
                "units": _one(_lists(n[at:end], pa.array(here, pa.int32()))), "links": _one(_lists(links[own], pa.array(place, pa.int32()))),
                **{c: _one(v, pa.int32()) for c, v in zip(("pair_a", "pair_b"), _halves(pairs[known]), strict=True)},
                **{c: _one(v if not at else [], k) for c, v, k in zip(("held_a", "held_b", "held_n"), counted, (pa.int32(), pa.int32(), pa.int64()), strict=True)},
            }
            at = end


def _halves(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pairs >> 32, pairs & 0xFFFFFFFF


def _one(values, kind: pa.DataType | None = None) -> pa.Array:
    """A list array with one list."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_aligners: dict[tuple[str, str], Aligner] = {}


def _cut_up(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most so many bytes of text, or one row."""
    size = np.cumsum(_numpy(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, most + (size[at - 1] if at else 0), "right")))
        yield batch.slice(at, end - at)
        at = end


def chunks(docs: DataFrame, a: str, b: str, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows with the documents' results, stretches and pairs, some for each chunk. a: byte-level JSON file; b: model of pieces."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part bigint, doc_id array<{kind}>, " + "".join(f"{c} array<bigint>, " for c in _COUNTS) + "groups_sha256 array<string>, units array<array<int>>, links array<array<int>>, "
    schema += "pair_a array<int>, pair_b array<int>, held_a array<int>, held_b array<int>, held_n array<bigint>"

    def run(batches):
        aligner = _aligners.get((a, b)) or _aligners.setdefault((a, b), Aligner(a, b))
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for chunk in _cut_up(batch, chunk_bytes):
                for row in aligner.chunk(chunk.column("doc_id"), chunk.column("text").to_pylist(), part_bytes):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int64()), **row})
                    number += 1
                pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked), best (whether no pair of the same a has more), of the chunks' partial counts."""
    pairs = rows.select(F.expr("inline(arrays_zip(held_a, held_b, held_n))").alias("a", "b", "n"))
    counts = materialise(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")))
    # as many rows as the vocabulary has ids
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return materialise(counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def _split(counts: DataFrame, frequent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs with the highest counts, at most so many, and the rest."""
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)  # at most 8 * 64 rows
    least, total = 1 << 10, 0
    for at, n in sizes:
        if total + n > frequent:
            break
        least, total = at, total + n
    return counts.where(step >= least), counts.where(step < least)


def report(docs: DataFrame, a: str, b: str, *, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    # row groups of bounded size, as a reader holds one of them as a whole
    rows = materialise(chunks(docs, a, b, chunk_bytes, part_bytes), **{"parquet.block.size": 16 << 20})
    counts = pair_counts(rows)
    high, low = _split(counts, frequent)
    high = high.select(F.expr("shiftleft(CAST(a AS BIGINT), 32) | b").alias("key"), "n", "best").toArrow().sort_by("key")
    sent = spark.sparkContext.broadcast([_numpy(high[c]) for c in ("key", "n", "best")])
    out = "part bigint, doc int, " + f"doc_id {kind}, " + "".join(f"{c} bigint, " for c in (*_COUNTS, "n_best", "count_sum")) + "groups_sha256 string, low array<struct<a:int,b:int,times:bigint>>"

    def run(batches):
        key, n, best = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                value = lambda c, k=k, batch=batch: batch.column(c)[k].values
                own = np.array(_numpy(value("pair_a")), np.int64) << 32 | _numpy(value("pair_b"))
                at = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
                known = key[at] == own if len(key) else np.zeros(len(own), bool)
                count, top = (np.where(known, v[at], 0) if len(key) else np.zeros(len(own), np.int64) for v in (n, best))
                links, units = value("links"), value("units")
                per_unit, per_doc = (_numpy(pc.list_value_length(x)).astype(np.int64) for x in (links, units))
                links, units = _numpy(links.flatten()), _numpy(units.flatten())
                sums = [_sums(_sums(v[links].astype(np.int64), per_unit)[units], per_doc) for v in (top, count)]
                docs = np.repeat(np.arange(len(per_doc)), per_doc)
                some = (_sums(~known[links], per_unit) > 0)[units]
                spread = links[_spread(units[some], per_unit)]
                table = pa.table({"doc": np.repeat(docs[some], per_unit[units[some]]), "pair": spread}).filter(pa.array(~known[spread]))
                table = table.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
                pair = own[_numpy(table["pair"])]
                low = pa.StructArray.from_arrays([pa.array(pair >> 32, pa.int32()), pa.array(pair & 0xFFFFFFFF, pa.int32()), table["count_all"].combine_chunks()], ["a", "b", "times"])
                size = len(per_doc)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.repeat(batch.column("part")[k], size), "doc": pa.array(np.arange(size), pa.int32()), "doc_id": value("doc_id"), **{c: value(c) for c in _COUNTS},
                    "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": value("groups_sha256"), "low": _lists(np.bincount(_numpy(table["doc"]), minlength=size), low),
                })

    done = materialise(rows.drop("held_a", "held_b", "held_n").mapInArrow(run, out))
    links = done.select("part", "doc", F.expr("inline(low)")).join(low.hint("merge"), ["a", "b"])
    more = links.groupBy("part", "doc").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"))
    done = done.drop("low").join(more, ["part", "doc"], "left")
    total = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return done.select("doc_id", *_COUNTS, total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256")
