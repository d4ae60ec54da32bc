"""The operators against brute force, on the smallest tables and on odd rows."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from tokenizers import Tokenizer

from dossier.llm import decontaminate, license_scan, line_dedup, packing, quality, sharding, simhash, toxicity, url_filters, warc
from dossier.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def both(spark, odd):
    return documents(spark).select("doc_id", "text").union(odd.selectExpr("doc_id + 100000", "text"))


def test_quality_counts(spark, odd):
    df = both(spark, odd)
    for r in quality.assess(df).collect():
        w = WORDS.findall(r["text"] or "")
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in (r["text"] or "").split("\n") if WORDS.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or ""))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_filter_keeps_columns(odd):
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {4, 6, 7}


def test_line_dedup(spark, odd):
    df = both(spark, odd)
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect()), key=str)
    texts = sorted({(r["doc_id"], r["text"]) for r in df.collect() if r["text"] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = [((i, j), tuple(WORDS.findall(x))) for i, t in texts for j, x in enumerate(t.split("\n")) if len(WORDS.findall(x)) >= 5]
    first = {}
    for at, w in lines:
        first.setdefault(w, at)
    cut = lambda w, k: w[:k] + w[k + 1 :]
    shared = defaultdict(set)
    for w in first:
        for k in range(len(w)):
            shared["r", k, cut(w, k)].add(w)
            shared["m", cut(w, k)].add(w)
    order = {at: n for n, (at, _) in enumerate(lines)}
    gone = set()
    for at, w in lines:
        near = set().union(*(shared["r", k, cut(w, k)] for k in range(len(w))), shared.get(("m", w), set()), ({cut(w, k) for k in range(len(w))} & first.keys()))
        if first[w] != at or any(order[first[x]] < order[at] for x in near):
            gone.add(at)
    want = [(r["doc_id"], r["text"] if r["text"] is None else "\n".join(x for j, x in enumerate(r["text"].split("\n")) if (r["doc_id"], j) not in gone)) for r in df.collect()]
    assert got == sorted(want, key=str)


def test_sharding(spark, odd):
    rows = sharding.with_slots(sharding.shuffled(odd, 5)).collect()
    assert len(rows) == odd.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 16 and r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    six = {r["doc_id"]: r["shard"] for r in sharding.with_shard(odd, 6).collect()}
    assert all(six[r["doc_id"]] == r["grown_shard"] for r in rows)


def test_shards_are_those_of_the_highest_weight(spark):
    def chained(*values):
        h = 42
        for v in values:
            if v is not None:
                h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if abs(v) < 1 << 20 else "<q", v), h)
        return h - (1 << 64) if h >> 63 else h

    # numbers of ids are wide, those of shards narrow
    for kind, ids in (("bigint", [*range(1 << 40, (1 << 40) + 300), None, -(1 << 41)]), ("string", [*(f"é{i}" for i in range(200)), "", None])):
        docs = spark.createDataFrame([(i, "t") for i in ids], f"doc_id {kind}, text string")
        weight = lambda s, i: (chained(7, s, i), s)
        for r in sharding.with_shard(docs, 9).collect():
            assert r["shard"] == max(weight(s, r["doc_id"]) for s in range(9))[1] and r["grown_shard"] == max(weight(s, r["doc_id"]) for s in range(10))[1]
        rows = sharding.with_slots(sharding.shuffled(docs, 9)).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(ids)


def test_toxicity_gradient_and_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id bigint, toxic int")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(r["score"] == 0 for r in rows)
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*rng.choice(words, 60), *(["vile"] if i % 3 == 0 else [])]).encode() for i in range(240)]
    y = np.array([int(i % 3 == 0) for i in range(240)])
    scores = toxicity.Scorer(toxicity.train(texts[:180], y[:180]))(texts[180:])
    assert ((scores >= 0.5) == y[180:]).mean() > 0.9


def brute_fingerprint(t):
    w = WORDS.findall(low(t))
    grams = [] if not w else [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_links(spark, odd):
    got = {(r["doc_id"], r["fingerprint"]) for r in simhash.group(odd).collect()}
    assert got == {(r["doc_id"], format(brute_fingerprint(r["text"]), "016x")) for r in odd.collect()}
    rng = np.random.default_rng(3)
    bits = [int(x) for x in rng.integers(0, 2**62, 40)]
    bits += [b ^ (1 << int(i)) ^ (1 << int(j)) for b in bits[:5] for i, j in rng.integers(0, 62, (30, 2))]
    nodes = spark.createDataFrame([(b,) for b in set(bits)], "fp bigint")
    for dense in (64, 4):  # either exact way gives the same components
        found = {r["fp"]: r["label"] for r in simhash.components(simhash.links(nodes, dense)).collect()}
        label = {b: b for b in bits}
        while True:
            new = {a: min(label[b] for b in label if (a ^ b).bit_count() <= 2) for a in label}
            if new == label:
                break
            label = new
        assert {a: found.get(a, a) for a in label} == label


def test_packing(spark, odd):
    df = both(spark, odd)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(df, tokenizer_path(), capacity=256).collect()
    want = Counter()
    for r in df.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.update((r["doc_id"], n, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 256)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.02 * sum(r["length"] for r in rows) / 256 + 1


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "One"), (2, "c d e f g h i j. a b c d"), (3, None), (4, "..."), (None, "no id"), (1, "x x"), (1, "One")], "item_id bigint, text string").union(spark.read.parquet(f"{SF}/benchmark.parquet"))
    windows = defaultdict(set)
    for r in items.collect():
        w = FOLDED.findall(low(r["text"]))
        n = min(10, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows[tuple(w[j : j + n])] |= {str(r["item_id"])} - {"None"}
    df = both(spark, odd)
    want = Counter()
    for r in df.collect():
        w, hit, met = FOLDED.findall(low(r["text"])), set(), set()
        for n in set(map(len, windows)):
            for j in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[j : j + n]))) is not None:
                    hit.update(range(j, j + n))
                    met |= found
        want[r["doc_id"], len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)] += 1
    for block_bytes in (1 << 20, 2000):  # one automaton, and several
        assert Counter(map(tuple, decontaminate.report(df, items, block_bytes=block_bytes).collect())) == want
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and not decontaminate.report(kept, items).where("contaminated").count()


def test_warc_round_trip(spark):
    big = "<p>" + "long " * 400
    rows = [(1, "http://a/\n\\x", big), (2, None, big), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (None, "u", big), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = warc.round_trip(pages, split_bytes=200).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got) == sorted(
        [("1", "revisit", "2"), ("2", "response", "None"), ("2", "response", "None"), ("3", "response", "None"), ("4", "response", "None"), ("5", "response", "None"), ("None", "revisit", "2")]
    )
    assert {(r["page_id"], r["url"]) for r in got} == {r[:2] for r in rows}
    assert all(r["payload_digest"] == hashlib.sha1((dict((x[0], x[2]) for x in rows)[r["page_id"]] or "").encode()).hexdigest() for r in got)


def test_license_base(spark, odd):
    df = both(spark, odd)
    for r, t in ((r, r["text"]) for r in license_scan.scan(df).join(df.select("doc_id", "text").distinct(), "doc_id").collect()):
        w = FOLDED.findall(low(t))
        places = [j for p in license_scan.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))


def test_url_rules(spark):
    urls = ["http://WWW.Spam.example.ORG/fr/x?y#z", None, "no scheme", "https://a.net", "https://a.net/", "http://x.example.net/en/1", "http://spam-farm.example.com/q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labelled = spark.createDataFrame([("http://spam-farm.example.com/a", True)] * 20 + [("http://ham.example.com/a", False)] * 20, "url string, bad boolean")
    got = [tuple(r)[1:5] for r in url_filters.judge(pages, labelled).orderBy("page_id").collect()]
    assert got == [
        ("www.spam.example.org", "/fr/x", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "", None, "allow"), ("a.net", "/", "net/", "block"),
        ("x.example.net", "/en/1", "example.net/en/", "allow"), ("spam-farm.example.com", "/q", None, "block"),
    ]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(0)
    for df in (quality.assess(none), line_dedup.dedup_lines(none), sharding.with_slots(sharding.shuffled(none)), simhash.group(none), packing.pack(none, tokenizer_path()), decontaminate.report(none, items), license_scan.scan(none)):
        assert df.count() == 0


def test_all_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_clean_leaves_no_hit(spark):
    """Removed spans are gone from the texts, with one block of items or several."""
    words = [f"w{i}" for i in range(12)]
    items = spark.createDataFrame([("a", " ".join(words)), ("b", "q0 q1 q2")], "item_id string, text string")
    rest = " ".join(f"r{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{rest} {' '.join(words)} end"), (2, rest), (3, f"q0 q1 q2 {rest}"), (4, None)], "doc_id bigint, text string")
    for block_bytes in (1 << 20, 5):
        got = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, items, block_bytes=block_bytes).collect()}
        assert " ".join(got[1].split()) == f"{rest} end" and got[2] == rest and got[3].split() == rest.split() and got[4] is None
