"""The pipeline's stages on small cases."""

from __future__ import annotations

import random

import corpus_pipeline
from dossier.llm.queries import QUERIES

DOCS = "doc_id bigint, text string"


def test_fully_duplicated_texts_go_and_single_words_stay(spark):
    a, b = "one two three four five six", "alpha beta gamma delta epsilon zeta"
    rows = [(1, f"{a}\n{b}"), (2, f"{a}\n\n{b}"), (3, f"{a}\n \t\n{b}"), (4, f"{a}\nhello"), (5, f"Anhang\n{b}"), (6, None), (7, "")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {1: f"{a}\n{b}", 4: "hello", 5: "Anhang", 6: None, 7: ""}


def test_near_dedup_tells_rows_apart_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, b), (7, a), (7, b), (7, b), (3, c), (9, c), (None, c)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(7, a), (7, b), (3, c)])
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(None, a), (None, b), (None, b)], DOCS), "").collect()
    assert sorted(r["text"] for r in got) == [a, b]


def test_exact_repeats_of_short_lines_go(spark, tmp_path):
    a, b = "one two three four five six", "alpha beta gamma delta epsilon zeta"
    rows = [(1, f"Home\n{a}\n\nsee all of it\nHome "), (2, f"Home\n{b}\n\nsee all of them\n home"), (3, "see all of it\nfresh words"), (4, "Home")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: f"Home\n{a}\n\nsee all of it", 2: f"{b}\n\nsee all of them\n home", 3: "fresh words", 4: ""}
    got = QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and sum(r["n_removed"] for r in got) == 4
    got = corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert {r["doc_id"]: r["text"] for r in got} == {k: v for k, v in want.items() if k != 4}


def test_near_dedup_catches_copies_of_similarity_from_four_fifths(spark):
    rng, rows, planted, far = random.Random(5), [], [], []
    for n in range(120):
        words = [f"v{rng.randrange(3000)}" for _ in range(300)]
        rows.append((n, " ".join(words)))
        copy, m = list(words), (6, 3, 1, 20)[n % 4]
        for i in range(m):
            copy[10 + i * 14] = f"new{n}x{i}"
        sets = [{tuple(w[i : i + 5]) for i in range(296)} for w in (words, copy)]
        (planted if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]) else far).append(1000 + n)
        rows.append((1000 + n, " ".join(copy)))
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert len(planted) == 90 and len(far) == 30 and kept >= {*range(120), *far}
    assert len(kept & {*planted}) <= 2
    # a group above the limit for pairs
    many = [(n, " ".join("other" if i == n % 300 else f"g{i}" for i in range(300))) for n in range(100)]
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame(many, DOCS), "").count() == 1


def template_rows(n: int, planted: int, seed: int = 3):
    """Texts of 300 words that share 262, none a copy of another, and copies of some at a similarity of about 0.82."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(262)]
    rows = [(k, " ".join(template[:100] + [f"own{k}x{i}" for i in range(38)] + template[100:])) for k in range(n)]
    for k in range(planted):
        words = rows[k * (n // planted)][1].split()
        for i, at in enumerate(sorted(rng.sample(range(4, 290), 6))):
            words[at] = f"new{k}x{i}"
        rows.append((1_000_000 + k, " ".join(words)))
    return rows


def test_near_dedup_finds_copies_among_texts_that_share_a_template(spark):
    rows = template_rows(600, 60)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(296)} for i, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    copies = {1_000_000 + k for k in range(60) if like(k * 10, 1_000_000 + k) >= 0.8}
    assert len(copies) > 40 and max(like(a, a + 1) for a in range(500)) < 0.8
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert kept == {i for i, _ in rows} - copies
