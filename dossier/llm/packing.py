"""Best-two-fit packing of tokenised documents into sequences.

Documents are tokenised in parallel and cut into pieces of at most ``capacity`` ids. What to put together depends on the
pieces' lengths alone, so the packing is worked out on the histogram of lengths, at most ``capacity`` rows however large
the input: a bin is filled greedily with the longest pieces that still fit, then its smallest piece is replaced by two
others that fit the widened gap more tightly. The same filling is repeated as often as the counts allow, which is what
filling bin after bin would do. Pieces are then numbered within their length and look up their bin by that number.

Numbering deals each length over as many groups as its count needs (``rows_per_group``), so a length that a third of all
pieces share is no single task.

Defined results: a null or empty text gives one piece, the end id alone; repeated rows are packed each on its own; texts
that contain a special token's string give its id, as the tokeniser does; a text of any length is tokenised whole, and its
pieces may stand in several sequences; columns besides doc_id and text are not looked at, so their names can't clash; an
empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CAPACITY, END_ID = 4096, 1

#: Characters whose normalisation and classes are plain: visible ASCII and the letters of Latin-1.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+\\Z")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache(dict):
    """White-space separated chunk (bytes) -> its ids, as little-endian unsigned 32-bit integers.

    Tokens never cross white space here, so a text's ids are its chunks' ids in a row. Plain chunks are split and mapped
    here and given to the vocabulary's model; all others go through the whole tokeniser. Emptied when full.
    """

    def __init__(self, path: str, most: int = 600_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.letters = Tokenizer.from_file(path), most, _byte_letters()
        self.model, self.parts = self.tokenizer.model, {}

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if _PLAIN.match(text) and "<|" not in text:
            ids = b"".join(self.part(p) for p in _PARTS.findall(text.lower()))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.most:
            self.clear()
        self[chunk] = ids
        return ids

    def part(self, p: str) -> bytes:
        ids = self.parts.get(p)
        if ids is None:
            if len(self.parts) >= self.most:
                self.parts.clear()
            mapped = p if p.isascii() else "".join(self.letters[b] for b in p.encode())
            ids = self.parts[p] = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        return ids

    def ids(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split()))


_caches: dict[str, WordCache] = {}


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit) of every piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        cache = _caches.setdefault(tokenizer, None) or _caches.update({tokenizer: WordCache(tokenizer)}) or _caches[tokenizer]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols = [[] for _ in range(5 + with_ids)]
                whose = []
                for k, t in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    ids = cache.ids(t) + end
                    for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        whose.append(k)
                        for c, v in zip(cols, (n, start // 4, len(own) // 4, zlib.crc32(own), own), strict=False):
                            c.append(v)
                arrays = [part.column("doc_id").take(pa.array(whose, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in one bin, times) from the number of pieces of each length: greedy filling, then best two-fit.

    Each entry uses up some length, so there are at most a few for each length.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while len(there := np.flatnonzero(left)):
        bin_, gap = [int(there[-1])], capacity - int(there[-1])
        left[bin_[0]] -= 1
        while gap and len(fits := np.flatnonzero(left[: gap + 1])):
            # as many of the longest fitting length as go in
            length = int(fits[-1])
            n = min(gap // length, int(left[length]))
            bin_ += [length] * n
            left[length] -= n
            gap -= n * length
        while gap and len(bin_) > 1:
            small, wide = bin_[-1], gap + bin_[-1]
            left[small] += 1
            a = np.flatnonzero(left[:wide])
            at = np.searchsorted(a, wide - a, "right") - 1
            at -= (a[np.maximum(at, 0)] == a) & (left[a] < 2)
            total = np.where(at >= 0, a + a[np.maximum(at, 0)], 0)
            best = int(total.argmax()) if len(a) else -1
            if best < 0 or total[best] <= small:
                left[small] -= 1
                break
            two = sorted((int(a[best]), int(a[at[best]])), reverse=True)
            left[two[0]] -= 1
            left[two[1]] -= 1
            bin_ = sorted(bin_[:-1] + two, reverse=True)
            gap = capacity - sum(bin_)
        uses = {x: bin_.count(x) for x in set(bin_)}
        more = min(int(left[x]) // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= n * more
        out.append((bin_, 1 + more))
    return out


def _lookup(plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length << 44 | first number within the length, sequence, uses in a bin, offset in it), sorted."""
    rows, used, sequence = [], {}, 0
    for bin_, times in plan:
        offset = 0
        for length in dict.fromkeys(bin_):
            n = bin_.count(length)
            rows.append((length << 44 | used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, rows_per_group: int = 1_000_000) -> DataFrame:
    """The pieces with sequence_id and offset (their place in it, gapless from 0)."""
    found = materialise(pieces(docs, tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids))
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most one row for each length
    table = _lookup(plan_bins(counts, capacity))
    groups = max(1, math.ceil(max(counts.values(), default=0) / rows_per_group), 16)
    # by place, so that rows of one id or of none go to all groups; the table is written, so the place is the same if read again
    dealt = found.select("*", F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(groups)).alias("__group"))
    starts = dealt.groupBy("length", "__group").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    number = F.row_number().over(Window.partitionBy("length", "__group").orderBy("doc_id", "piece", "ids_crc32", "start"))
    numbered = dealt.withColumn("__number", number - 1).join(starts, ["length", "__group"]).withColumn("__number", F.col("__number") + F.col("__start")).drop("__group", "__start")

    def place(batches):
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__number"))
            row = table[np.searchsorted(table[:, 0], length << 44 | number, "right") - 1]
            nth = number - (row[:, 0] & ((1 << 44) - 1))
            b = b.drop_columns(["__number"])
            yield b.append_column("sequence_id", pa.array(row[:, 1] + nth // row[:, 2])).append_column("offset", pa.array(row[:, 3] + nth % row[:, 2] * length))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "__number") + ", sequence_id bigint, offset bigint"
    return numbered.mapInArrow(place, schema).select(*found.columns, "sequence_id", "offset")
