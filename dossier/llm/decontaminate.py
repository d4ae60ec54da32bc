"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items go into suffix automata; the words of each text are streamed through them, tracking
the length of the longest suffix read so far that stands in some item. Where that reaches ``window`` words, or all words of
a shorter item, the words matched are hit. Runs of words that can't hold a match, because they are too short or two
neighbours never stand together in an item, are passed over first; this loses nothing.

Items are dealt by hash over blocks of about ``block_bytes``. A task builds each block's automaton once and writes it to
the shared folder as sorted arrays; only the files' names come to the driver. The tasks that read texts gather
``BUFFER_BYTES`` of them and take the blocks one after the other, mapped into memory where the file system can, so the
memory is that of a buffer and of ``CACHE_BYTES`` of blocks however large the benchmark, and the texts move nowhere.

Defined results: words are runs of ASCII letters or digits and of all characters beyond ASCII, A-Z lower-cased; null and
empty texts have none; items without words or with null texts match nothing; words of an item whose id is null are hit, but
it has no id to be listed by; repeated items count once by their id; equal rows get equal results; texts of any length are
read whole; columns named n_words, ranges or items are replaced in hits, all others stay as they are.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch_dir, with_columns_of

BLOCK_BYTES, BUFFER_BYTES, CACHE_BYTES = 1 << 20, 16 << 20, 128 << 20

#: Separators become blanks, capitals small letters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normalised(text: bytes | str | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(_FOLD).split()


class _Numbers(dict):
    """Word -> its number, by first appearance."""

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        return n


class Builder:
    """Suffix automaton of several word sequences, grown word by word."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.vocabulary = window, _Numbers()
        self.next, self.link, self.length = [{}], [-1], [0]
        self.items = [(name, [self.vocabulary[w] for w in words]) for name, words in items if words]
        for _, ids in self.items:
            last = 0
            for w in ids:
                last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, then: dict) -> int:
        self.next.append(then)
        self.link.append(-1)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def windows(self) -> dict[int, set[int]]:
        """state * (window + 1) + n -> items, of every window of n words; a state holds one string of each length."""
        out: dict[int, set[int]] = {}
        for k, (_, ids) in enumerate(self.items):
            n, state, length = min(self.window, len(ids)), 0, 0
            for w in ids:
                state, length = self.next[state][w], length + 1
                while self.length[self.link[state]] >= n:
                    state = self.link[state]
                if length >= n:
                    length = n
                    out.setdefault(state * (self.window + 1) + n, set()).add(k)
        return out

    def table(self) -> pa.Table:
        """One row: the automaton as sorted arrays, its words and the items' names."""
        v, windows = max(1, len(self.vocabulary)), self.windows()
        steps = np.array(sorted((state * v + w, to) for state, then in enumerate(self.next) for w, to in then.items()), np.int64).reshape(-1, 2)
        names = sorted({name for name, _ in self.items if name is not None})
        number = {name: i for i, name in enumerate(names)}
        keys = sorted(windows)
        met = [sorted({number[name] for k in windows[key] if (name := self.items[k][0]) is not None}) for key in keys]
        arrays = {
            "link": np.array(self.link, np.int64), "length": np.array(self.length, np.int64), "step": steps[:, 0].copy(), "to": steps[:, 1].copy(),
            "pair": np.unique(np.array([a * v + b for _, ids in self.items for a, b in zip(ids, ids[1:], strict=False)], np.int64)),
            "key": np.array(keys, np.int64), "first": np.cumsum([0, *map(len, met)], dtype=np.int64), "met": np.array([n for m in met for n in m], np.int64),
        }
        columns = {c: pa.array([a.tobytes()], pa.large_binary()) for c, a in arrays.items()}
        return pa.table(columns | {"words": pa.array([list(self.vocabulary)], pa.list_(pa.binary())), "names": pa.array([names], pa.list_(pa.string()))})


class Automaton:
    """A block's automaton as read back from its table."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.bytes = window, table.nbytes
        arrays = {c: np.frombuffer(table[c].chunk(0)[0].as_buffer(), np.int64) for c in ("link", "length", "step", "to", "pair", "key", "first", "met")}
        # memory views give Python's integers at once, which numpy's elements don't
        self.link, self.length, self.step, self.to, self.key = (memoryview(arrays[c]) for c in ("link", "length", "step", "to", "key"))
        self.pair, self.first, self.met = arrays["pair"], arrays["first"], arrays["met"]
        self.vocabulary = {w: i for i, w in enumerate(table["words"][0].as_py())}
        self.names = table["names"][0].as_py()
        self.sizes = sorted({int(n) for n in np.unique(arrays["key"] % (window + 1))})

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, -1 for those that no item has."""
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))

    def matches(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, last word, items) of every window met in texts, as numbers of their words, laid one after the other from starts on.

        A window's words come in order of their last one.
        """
        if not self.sizes or not (ids >= 0).any():
            return
        known, v = ids >= 0, max(1, len(self.vocabulary))
        joined = known[:-1] & known[1:]
        joined[starts[(starts > 0) & (starts < len(ids))] - 1] = False
        some = np.flatnonzero(joined)
        pairs = ids[some].astype(np.int64) * v + ids[some + 1]
        at = np.searchsorted(self.pair, pairs)
        joined[some] = (self.pair[np.minimum(at, len(self.pair) - 1)] == pairs) if len(self.pair) else False
        # runs of neighbours that may stand together
        first = np.flatnonzero(known & ~np.append(False, joined))
        last = np.flatnonzero(known & ~np.append(joined, False))
        long = last - first + 1 >= self.sizes[0]
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            yield from self._run(ids[a : b + 1].tolist(), a, v)

    def _run(self, ids: list[int], at: int, v: int):
        link, length, step, to, most = self.link, self.length, self.step, self.to, self.sizes[-1]
        state, matched, n_steps = 0, 0, len(step)
        for i, w in enumerate(ids, at):
            while True:
                k = bisect_left(step, state * v + w)
                if k < n_steps and step[k] == state * v + w:
                    state, matched = to[k], matched + 1
                    break
                if not state:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            # longer matches than the longest window tell nothing more
            if matched >= most:
                matched = most
                while length[link[state]] >= most:
                    state = link[state]
            whole = state
            for n in reversed(self.sizes):
                if n <= matched:
                    while length[link[whole]] >= n:
                        whole = link[whole]
                    key = whole * (self.window + 1) + n
                    k = bisect_left(self.key, key)
                    if k < len(self.key) and self.key[k] == key:
                        yield i - n + 1, i, [self.names[m] for m in self.met[self.first[k] : self.first[k + 1]].tolist()]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges sorted, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def build(items: DataFrame, window: int, block_bytes: int) -> list[str]:
    """Builds the automata of the items (item_id, text), one file a block; the files' names."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    root = scratch_dir(items.sparkSession)

    def write(block: pa.Table) -> pa.Table:
        rows = sorted(zip(block["item_id"].to_pylist(), block["text"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        name = f"block-{uuid.uuid4().hex}.arrow"  # no other attempt's
        table = Builder([(name_, normalised(t)) for name_, t in rows], window).table()
        with fs.open_output_stream(f"{folder}/{name}") as out, pa.ipc.new_file(out, table.schema) as w:
            w.write_table(table)
        return pa.table({"file": [f"{root}/{name}"]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return sorted(r["file"] for r in materialise(dealt.groupBy("block").applyInArrow(write, "file string")).collect())  # a name a block


_loaded: OrderedDict[str, Automaton] = OrderedDict()


def automaton(file: str, window: int) -> Automaton:
    """The automaton of a file; a worker keeps those it used last, up to CACHE_BYTES."""
    found = _loaded.pop(file, None)
    if found is None:
        fs, path = pyarrow.fs.FileSystem.from_uri(file)
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            fs = pyarrow.fs.LocalFileSystem(use_mmap=True)
        with fs.open_input_file(path) as source:
            found = Automaton(pa.ipc.open_file(source).read_all(), window)
        while _loaded and found.bytes + sum(a.bytes for a in _loaded.values()) > CACHE_BYTES:
            _loaded.popitem(last=False)
    _loaded[file] = found
    return found


def find(texts: list[bytes | None], files: list[str], window: int) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """(number of words, ranges of hit words, items met) of each text, block after block."""
    blocks = [automaton(file, window) for file in files] if len(files) == 1 else []
    every = _Numbers()
    # with several blocks, words are looked up once each and block
    number = blocks[0].numbers if blocks else lambda w: np.fromiter(map(every.__getitem__, w), np.int32, len(w))
    codes = [number(normalised(t)) for t in texts]
    counts = np.fromiter(map(len, codes), np.int64, len(codes))
    starts, uniques = np.cumsum(counts) - counts, list(every)
    codes = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    met: list[set[str]] = [set() for _ in texts]
    ends = starts + counts
    for file in files:
        k = 0
        block = automaton(file, window)
        for first, last, names in block.matches(codes if blocks else block.numbers(uniques)[codes] if uniques else codes, starts):
            if not starts[k] <= first < ends[k]:
                k = int(np.searchsorted(ends, first, "right"))
            own, base = ranges[k], int(starts[k])
            if own and own[-1][0] <= first - base <= own[-1][1] + 1:
                own[-1] = (own[-1][0], max(own[-1][1], last - base))
            else:
                own.append((first - base, last - base))
            met[k].update(names)
    return [(int(n), merged(r), m) for n, r, m in zip(counts, ranges, met, strict=True)]


HITS = "n_words bigint, ranges array<struct<first:int,last:int>>, items array<string>"


def hits(docs: DataFrame, items: DataFrame, *, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, ranges (of hit words) and items (ids of items with a window in the text)."""
    return _hits(docs.drop("n_words", "ranges", "items"), build(items, window, block_bytes), window)


def _hits(docs: DataFrame, files: list[str], window: int, *, cut: bool = False) -> DataFrame:
    """The hits; with cut, the texts are those without them."""
    names = docs.columns
    kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.string())]

    def judged(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
        found = find(texts, files, window)
        if cut:
            texts = without_hits(texts, found, files, window)
        at = 0
        for b in batches:
            own = found[at : at + b.num_rows]
            kept = {n: b.column(b.schema.get_field_index(n)) for n in names}
            if cut:
                kept["text"] = pa.array(texts[at : at + b.num_rows], pa.binary()).cast(pa.string())
            more = [[n for n, _, _ in own], [[{"first": x, "last": y} for x, y in r] for _, r, _ in own], [sorted(m) for _, _, m in own]]
            yield pa.RecordBatch.from_arrays([*kept.values(), *(pa.array(m, k) for m, k in zip(more, kinds, strict=True))], [*names, "n_words", "ranges", "items"])
            at += b.num_rows

    def run(batches):
        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                held.append(b.slice(at, 256))
                size += held[-1].nbytes
                if size >= BUFFER_BYTES:
                    yield from judged(held)
                    held, size = [], 0
        if held:
            yield from judged(held)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + HITS
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    found = hits(docs.select("doc_id", "text"), items, **how)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"),
    )


def without_words(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text less the given ranges of words; what stood between words of a range goes with them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, last in ranges:
        out.append(text[at : places[first][0]])
        at = places[last][1]
    return b"".join([*out, text[at:]])


def without_hits(texts: list[bytes | None], found: list, files: list[str], window: int) -> list[bytes | None]:
    """The texts less the ranges found, and less what is still found where a removal brought words together."""
    texts, todo = list(texts), {i: r for i, (_, r, _) in enumerate(found) if r}
    while todo:
        for i, r in todo.items():
            texts[i] = without_words(texts[i], r)
        again = find([texts[i] for i in todo], files, window)
        todo = {i: r for i, (_, r, _) in zip(todo, again, strict=True) if r}
    return texts


def clean(docs: DataFrame, items: DataFrame, *, window: int = 10, max_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the hit spans; documents of which more than max_coverage is hit are left out.

    Where a removal brings words together that form a window again, that goes too.
    """
    names = docs.columns
    rows = docs.select("text", with_columns_of(docs, ("text",)).alias("row")) if len(names) > 1 else docs.select("text")
    found = _hits(rows, build(items, window, block_bytes), window, cut=True)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    out = found.where(n_hit <= F.col("n_words") * max_coverage)
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names])
