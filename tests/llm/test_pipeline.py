"""Every stage of the pipeline, and the whole of it, against brute force on the smallest table and on odd rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from dossier.llm.queries import tokenizer_path
from dossier.llm.quality import BOILERPLATE

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def order(row):
    return row[0] is not None, row[0] or 0


def bad_line(x):
    n = len(WORDS.findall(x))
    return bool(
        (not re.search("[.!?…;:]", x) and n >= 10) or (x.upper() == x and x.lower() != x and n >= 5) or 2 * len(re.findall(r"!!|\?\?", x)) >= 6
        or len(re.findall(r"[\x20\x09-\x0D][|»›•·>](?=[\x20\x09-\x0D])", x)) >= 3 or len(re.sub(r"[#*$%&|<>]", "", x)) * 10 <= len(x) * 9
        or re.search("|".join(BOILERPLATE), x, re.I)
    )


def quality(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lost = sum(len(x) for x in lines if bad_line(x))
        if len(w) >= 10 and 100 * len(covered) <= 20 * len(w) and 100 * lost <= 50 * sum(map(len, lines)):
            out.append((i, "\n".join(x for x in t.split("\n") if not (WORDS.search(x) and bad_line(x)))))
    return out


def lines(rows):
    texts = sorted({r for r in rows if r[1] is not None}, key=order)
    every = [((i, t, j), tuple(WORDS.findall(x))) for i, t in texts for j, x in enumerate(t.split("\n")) if WORDS.search(x)]
    first, place = {}, {at: n for n, (at, _) in enumerate(every)}
    for at, w in every:
        first.setdefault(w, at)
    cut = lambda w, k: w[:k] + w[k + 1 :]
    replaced, moved = defaultdict(set), defaultdict(set)
    long = [w for w in first if len(w) >= 5]
    for w in long:
        for k in range(len(w)):
            replaced[k, cut(w, k)].add(w)
            moved[cut(w, k)].add(w)
    gone = set()
    for at, w in every:
        near = set()
        if len(w) >= 5:
            near = set().union(*(replaced[k, cut(w, k)] for k in range(len(w))), moved.get(w, set()), {c for k in range(len(w)) if len(c := cut(w, k)) >= 5} & first.keys())
        if first[w] != at or any(place[first[x]] < place[at] for x in near):
            gone.add(at)
    out = []
    for i, t in rows:
        kept = t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, t, j) not in gone)
        if kept == t or WORDS.search(kept):
            out.append((i, kept))
    return out


def near(rows):
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for _, t in docs:
        w = low(t).encode().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(docs)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)):
                label[max(root(a), root(b))] = min(root(a), root(b))
    return [d for i, d in enumerate(docs) if root(i) == i]


def clean(rows, items):
    windows = set()
    for t in items:
        w = FOLDED.findall(low(t))
        n = min(10, len(w))
        windows |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    sizes = sorted(set(map(len, windows)))

    def hit(t):
        w = FOLDED.findall(low(t))
        return len(w), sorted({j + k for n in sizes for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in windows for k in range(n)})

    out = []
    for i, t in rows:
        n, places = hit(t)
        if len(places) > 0.5 * n:
            continue
        while places:
            spans = [m.span() for m in FOLDED.finditer(low(t))]
            runs = np.split(np.array(places), np.flatnonzero(np.diff(places) > 1) + 1)
            for run in reversed(runs):
                t = t[: spans[run[0]][0]] + t[spans[run[-1]][1] :]
            places = hit(t)[1]
        out.append((i, t))
    return out


def pieces(rows):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((i, n, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 4096)))
    return want


ODD = [
    (None, "Ten words of a text without an id, told apart by what they say."), (None, "Another text of at least ten words without an id, as it happens."), (500, "Two texts of one id: the first has more than ten words in it."),
    (500, "Two texts share this id: the second says quite something else, in more words."), (500, "Two texts share this id: the second says quite something else, in more words."), (501, None), (502, ""), (503, " \n\t\n"),
    (504, "One line of words that is long enough to count, said twice.\nOne line of words that is long enough to count, said twice."), (505, "word " * 3000), (506, "sentence " + " ".join(f"number{i}." for i in range(20000))),
]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Inputs and outputs of the stages over the smallest table with odd rows, each worked out once."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(i, t, "en", "odd", 0) for i, t in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    held, at = {}, spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, path)
        folder = f"{path}/{name}"
        out.write.parquet(folder)
        out = spark.read.parquet(folder)
        held[name], at = (at, out), out
    return path, held


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert Counter(got) == Counter(want)


def test_quality_stage(stages):
    before, after = stages[1]["quality_rules"]
    same(texts(after), quality(texts(before)))
    assert after.columns == before.columns


def test_line_stage(stages):
    before, after = stages[1]["line_dedup"]
    same(texts(after), lines(texts(before)))
    assert after.columns == before.columns


def test_near_stage(stages):
    before, after = stages[1]["simhash_near_dedup"]
    same(texts(after), near(texts(before)))
    assert after.columns == before.columns


def test_decontamination_stage(spark, stages):
    before, after = stages[1]["decontamination"]
    same(texts(after), clean(texts(before), [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]))
    assert after.columns == before.columns


def test_packing_stage_and_the_whole_run(spark, stages):
    path, held = stages
    before, after = held["best_fit_packing"]
    want = pieces(texts(before))
    run = corpus_pipeline.run(spark, path)
    for df in (after, run):
        rows = df.collect()
        same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], want)
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            b.sort()
            assert all(o + n == p for (o, n), (p, _) in zip(b, b[1:], strict=False)) and b[0][0] == 0 and sum(n for _, n in b) <= 4096
        assert len(bins) <= 1.02 * sum(r["length"] for r in rows) / 4096 + 1


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    kind = "doc_id bigint, text string, row string, doc string, gone bigint, n_words string, ranges int, clean_text string, kept int, node int"
    none = spark.createDataFrame([], kind)
    one = spark.createDataFrame([(1, "A text of more than ten words that nobody else has, so it stays.", "r", "d", 2, "n", 3, "c", 4, 5)], kind)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).count() == 0
        assert stage(spark, one, str(tmp_path)).collect() == one.collect()
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, none, str(tmp_path)).count() == 0 and pack(spark, one, str(tmp_path)).count() == 1
