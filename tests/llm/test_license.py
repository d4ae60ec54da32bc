"""License spans against a scan by hand, on the smallest table and on pieces of real license texts."""

from __future__ import annotations

import re
from collections import defaultdict

from dossier.llm import license_scan
from dossier.llm.license_texts import TEMPLATES

SF = "/root/testdata/sf0.001"
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return FOLDED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


INDEX = defaultdict(list)
SIZES = {}
for _i, (_label, _text) in enumerate(TEMPLATES):
    _w = words(_text)
    SIZES[_i] = len(_w)
    for _j in range(len(_w) - 2):
        INDEX[tuple(_w[_j : _j + 3])].append((_i, _j))


def brute_spans(w):
    """(template, first, last, covered) of each span."""
    by_template = defaultdict(set)
    for pos in range(len(w) - 2):
        for template, at in INDEX.get(tuple(w[pos : pos + 3]), ()):
            by_template[template].add((pos - at, pos))
    out = []
    for template, votes in by_template.items():
        bands, last = [], None
        for diagonal, pos in sorted(votes):
            if last is None or diagonal - last > 3:
                bands.append([])
            bands[-1].append(pos)
            last = diagonal
        for band in bands:
            group = []
            for pos in [*sorted(set(band)), None]:
                if group and (pos is None or pos - group[-1] > 8):
                    covered = len({p + j for p in group for j in range(3)})
                    out.append((template, group[0], group[-1] + 2, covered))
                    group = []
                if pos is not None:
                    group.append(pos)
    return out


def brute(text):
    w = words(text)
    base = {label for p, label in license_scan.PHRASES.items() if any(w[j : j + len(p.split())] == p.split() for j in range(len(w)))}
    spans = [(c / max(b - a + 1, min(SIZES[t], 12)), c / SIZES[t], c, a, b, TEMPLATES[t][0]) for t, a, b, c in brute_spans(w)]
    standing = sorted((s for s in spans if s[0] >= 0.75), key=lambda s: s[3])
    groups, end = [], -1
    for s in standing:
        if s[3] > end:
            groups.append([])
        groups[-1].append(s)
        end = max(end, s[4])
    labels = base | {s[5] for g in groups for s in g if s[:3] == max(x[:3] for x in g)}
    return ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else max((s[0] for s in spans), default=0.0)


def cut(template, first, last):
    return " ".join(TEMPLATES[template][1].split()[first:last])


PIECES = {
    "mit": [cut(0, 0, 200), cut(0, 25, 60), "intro words here\n" + cut(0, 80, 140) + "\nmore of it", "Released under the MIT License."],
    "apache-2": [cut(3, 0, 200), "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"],
    "gpl-3": [cut(5, 0, 200), "This work is licensed under the GNU General Public License, version 3."],
    "bsd": [cut(1, 0, 300).replace("copyright holder", "Example Institute of Long Names"), cut(1, 10, 60)],
    "isc": [cut(2, 0, 150)],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "": ["the software is provided for the use of other people", "any person may obtain a copy of the book", "under the terms of the contract", "", "mit"],
}


def test_pieces_of_licenses_are_labelled(spark):
    rows = [(i, text, label) for i, (label, text) in enumerate((k, t) for k, ts in PIECES.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs).collect()}
    assert got == {i: label for i, _, label in rows}


def test_labels_and_scores_equal_brute_force(spark, odd):
    texts = [(10_000 + i, t) for i, t in enumerate(t for ts in PIECES.values() for t in ts)]
    texts += [(20_000, "filler " * 3000 + cut(0, 0, 90) + " filler" * 5000 + cut(3, 0, 70)), (20_001, " ".join(cut(0, i, i + 15) for i in range(0, 150, 7))), (10_000, texts[0][1])]
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(texts, "doc_id bigint, text string"))
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, *brute(r["text"])) for r in df.collect())
    for how in ({}, {"max_broadcast_rows": 0}):  # the index broadcast, and joined by shuffle
        got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["base_labels"], r["labels"], r["score"]) for r in license_scan.scan(df, **how).collect())
        assert got == want


def test_clashing_columns_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, 5, "x"), (2, "", 6, "y")], "doc_id bigint, text string, pos int, label string")
    rows = license_scan.scan(df).collect()
    assert {(r["doc_id"], r["n_words"], r["labels"], r["score"]) for r in rows} == {(1, 0, "", 0.0), (2, 0, "", 0.0)}
    assert license_scan.scan(df.limit(0)).count() == 0
