"""The Merkle manifest against trees built one node after the other, for several fanouts, and odd rows."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from dossier.llm import merkle

DOCS = "doc_id bigint, source string, lang string, n_chars int, text string"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])])


def brute_tree(leaves, fanout):
    """The root, and for each leaf its steps of (before, after)."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, own in enumerate(at):
            run = own // fanout * fanout
            steps[k].append(("".join(level[run:own]), "".join(level[own + 1 : run + fanout])))
        level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [own // fanout for own in at]
    return level[0], steps


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g])], fanout) for g in order}
    root, above = brute_tree([trees[g][0] for g in order], fanout)
    return sorted((leaf, trees[g][0], root, str(steps + above[k])) for k, g in enumerate(order) for (_, _, leaf), steps in zip(sorted(groups[g]), trees[g][1], strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(333)] + [(i, "s", "de", None, "x" * i) for i in range(17)] + [(1, None, None, 3, None), (2, None, None, 3, "")]
    rows += [(5, "s", "fr", 1, "alone"), (None, "s", "été", 1, "no id"), (None, "s", "été", 1, "no id either")] + [(9, "s", "same", 1, "equal rows")] * 50 + [(400, "s", "en", 1, "long " * 50_000)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 4), (2, 1), (3, 2), (16, 1)])
def test_against_trees_built_node_by_node(docs, fanout, levels):
    rows = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("order"), merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("leaf"), F.struct("doc_id").alias("row"))
    got = merkle.manifest(rows, fanout=fanout, levels=levels).collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], str([tuple(s) for s in r["proof"]])) for r in got) == brute(docs.collect(), fanout)


def test_changed_rows_lead_to_other_roots(docs):
    got = merkle.verify(docs, F.col("doc_id") % 4 == 1).collect()
    assert len(got) == docs.count()
    numbered = {(r["doc_id"], brute_leaf(r)): r["n_chars"] is not None for r in docs.collect()}
    for r in got:
        changed = r["doc_id"] is not None and r["doc_id"] % 4 == 1 and numbered[r["doc_id"], r["leaf"]]
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])
    proofs = {(leaf, steps) for leaf, _, _, steps in brute(docs.collect(), 2)}
    assert {(r["leaf"], r["proof_sha256"]) for r in got} == {(leaf, H(*[x for s in eval(steps) for x in s])) for leaf, steps in proofs}


def test_one_row_and_none(spark):
    one = merkle.verify(spark.createDataFrame([(1, "s", "en", 1, "t")], DOCS).withColumn("leaf", F.lit(1)), F.lit(False)).collect()
    leaf = H("1:1", "1:s", "2:en", "1:1", "1:t")
    assert [tuple(r) for r in one] == [(1, leaf, leaf, leaf, H(), leaf, True)]
    assert merkle.verify(spark.createDataFrame([], DOCS), F.lit(True)).count() == 0
