"""Mixing against a plain walk over the sorted hashes, planted sources, nested budgets and odd rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dossier.llm import mixing

DOCS = "doc_id bigint, source string, text string"


def brute_targets(sizes: dict, weights=(1, 2, 3), budget=1.0, at_most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()) * budget, set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > at_most * sizes[s]}
        if not full:
            return out | {s: min(level * weight[s], at_most * sizes[s]) for s in open_}
        out |= {s: at_most * sizes[s] for s in full}
        left, open_ = left - sum(at_most * sizes[s] for s in full), open_ - full
    return out


def brute_taken(rows, wanted):
    """Words taken of each row, as (doc_id, source, size, h) -> a list of them for equal rows."""
    of = defaultdict(list)
    for r in rows:
        of[r["source"]].append(r)
    out = defaultdict(list)
    for source, own in of.items():
        total = sum(r["size"] for r in own)
        passes = int(wanted[source] // total) if total else 0
        rest, before = wanted[source] - passes * total, 0
        for r in sorted(own, key=lambda r: r["h"]):
            once_more = rest > 0 and before + r["size"] / 2 <= rest
            before += r["size"]
            out[r["doc_id"], source, r["size"], r["h"]].append(r["size"] * (passes + once_more))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def docs(spark):
    """A large source, small ones, one without words, a null one, repeated rows, and one id for many texts."""
    rows = [(i, "big", f"a{i} " * (1 + i % 40)) for i in range(700)] + [(i, f"s{i % 5}", "one two three " * (i % 7)) for i in range(200)]
    rows += [(i, "empty", None if i % 2 else " \n") for i in range(9)] + [(i, None, "no source here") for i in range(4)]
    rows += [(7, "same", "equal rows all of them")] * 300 + [(None, "noid", f"text {i} of no id") for i in range(50)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize(("weights", "budget"), [((1, 2, 3), 1.0), ((5, 1), 0.3), ((1,), 2.5)])
def test_against_a_walk_over_sorted_hashes(docs, weights, budget):
    keys = mixing.keys(docs, 0, "doc_id").collect()
    sizes = Counter()
    for r in keys:
        sizes[r["source"]] += r["size"]
    wanted = brute_targets(sizes, weights, budget)
    found = mixing.repeated(mixing.keys(docs, 0, "doc_id"), mixing.thresholds(mixing.keys(docs), mixing.targets(mixing.keys(docs), weights, budget))).collect()
    got = defaultdict(list)
    for r in found:
        got[r["doc_id"], r["source"], r["size"], r["h"]].append(r["size"] * r["repeats"])
        assert r["target"] == pytest.approx(wanted[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["repeats"] <= 3
    assert {k: sorted(v) for k, v in got.items()} == brute_taken(keys, wanted)
    taken, largest = Counter(), Counter()
    for r in found:
        taken[r["source"]] += r["size"] * r["repeats"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - wanted[s]) <= largest[s] / 2 + 1e-6 for s in wanted)


def test_shares_and_mix_agree(docs):
    taken = {}
    for r in mixing.shares(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    words = Counter()
    for r in mixing.mix(docs.withColumn("row", F.lit("own")).withColumn("size", F.lit("own"))).collect():
        assert r["row"] == r["size"] == "own"
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_a_smaller_budget_is_part_of_a_larger(docs):
    less, more = (Counter(map(tuple, mixing.mix(docs, budget=b).collect())) for b in (0.4, 0.9))
    assert less and not less - more and more - less


def test_hash_buckets_refine_and_sources_need_no_broadcast(spark, docs, monkeypatch):
    """Many levels of few bits, and cuts that are joined by shuffle, give what the usual ones give."""
    usual = sorted(map(str, mixing.shares(docs).collect()))
    monkeypatch.setattr(mixing, "LEVELS", 6)
    monkeypatch.setattr(mixing, "LEVEL_BITS", 10)
    monkeypatch.setattr(mixing, "few", lambda rows: rows)
    assert sorted(map(str, mixing.shares(docs).collect())) == usual


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.shares(none).count() == 0 and mixing.mix(none).count() == 0
    assert [r["taken"] for r in mixing.shares(spark.createDataFrame([(1, "a", None)], DOCS)).collect()] == [0]
