"""Names of the caller's that clash with an operator's own, very long texts, repeated rows, ties, and the scratch folders."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from dossier.llm import common, decontaminate, license_scan, line_dedup, near_copies, packing, quality, sharding, simhash
from dossier.llm.queries import tokenizer_path
from test_operators import brute_fingerprint

CLASH = "doc_id bigint, text string, n_words string, kept int, clean_text string, n_lines int, n_removed string, bucket string, place string, shard int, size string, fp int, node string, row string, doc string, items int, ranges string, pos int, __t string, gone int, piece int, sequence_id string"


@pytest.fixture(scope="module")
def clash(spark):
    row = lambda i, t: (i, t, "a", 1, "b", 2, "c", "d", "e", 3, "f", 4, "g", "h", "i", 5, "j", 6, "k", 7, 8, "l")
    texts = ["First line of a text that has its words.\nSecond line of the same text, with other words.", "First line of a text that has its words.\nA third line that nobody else has, really."]
    return spark.createDataFrame([row(1, texts[0]), row(2, texts[1]), row(2, texts[1]), row(None, None)], CLASH)


def test_clashing_columns(spark, clash):
    plain = clash.select("doc_id", "text")
    as_rows = lambda df, columns: sorted(map(str, df.select(*columns).collect()))
    for f, columns in (
        (lambda d: quality.assess(d), ["doc_id", "n_words", "kept", "clean_text", "n_dup_lines"]), (lambda d: line_dedup.dedup_lines(d, exact_words=1), ["doc_id", "text", "n_lines", "n_removed"]),
        (lambda d: sharding.with_slots(sharding.shuffled(d, 3)), ["doc_id", "size", "shard"]), (simhash.group, ["doc_id", "fingerprint", "component_id"]), (lambda d: packing.pack(d, tokenizer_path()), ["doc_id", "piece", "length", "ids_crc32"]),
        (license_scan.scan, ["doc_id", "n_words", "labels", "score"]), (lambda d: decontaminate.report(d, spark.createDataFrame([(1, "a text that has")], "item_id int, text string")), ["doc_id", "n_words", "n_hit", "contaminated"]),
    ):
        assert as_rows(f(clash), columns) == as_rows(f(plain), columns)
    # what is kept of the caller's columns is as it was
    kept = line_dedup.dedup_lines(clash, exact_words=1).where("doc_id = 1").first()
    assert (kept["row"], kept["doc"], kept["gone"], kept["place"]) == ("h", "i", 7, "e")
    assert near_copies.keep_one(clash).columns == clash.columns and quality.filter_documents(clash).columns == clash.columns


def test_very_long_texts(spark):
    words = [f"w{i % 9973}q{i % 11}" for i in range(150_000)]
    long = " ".join(words)
    lined = "\n".join(" ".join(words[i : i + 30]) for i in range(0, len(words), 30))
    docs = spark.createDataFrame([(1, long), (2, lined), (3, long + " more")], "doc_id bigint, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.group(docs).collect()}
    assert prints[1] == prints[2] == format(brute_fingerprint(long), "016x")
    assert {r["doc_id"] for r in near_copies.keep_one(docs).collect()} == {1}
    got = {r["doc_id"]: r for r in quality.assess(docs).collect()}
    assert got[1]["n_words"] == len(words) and got[3]["word_chars"] == sum(map(len, words)) + 4
    rows = packing.pack(docs.where("doc_id = 1"), tokenizer_path()).collect()
    ids = np.array([*Tokenizer.from_file(tokenizer_path()).encode(long, add_special_tokens=False).ids, 1], "<u4")
    assert sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows) == [(s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs, exact_words=1).collect()}
    # the third text is a word longer than the first, whose only line it nearly repeats
    assert out[1] == 0 and out[3] == 1
    hit = decontaminate.report(docs, spark.createDataFrame([("x", " ".join(words[70_000:70_020]))], "item_id string, text string")).where("doc_id = 1").first()
    assert hit["n_hit"] >= 20 and hit["n_words"] == len(words)


def test_benchmark_of_many_blocks(spark):
    """Items by the hundred in blocks of a few kilobytes give what one block gives."""
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(i, " ".join(f"v{x}" for x in rng.integers(0, 400, 40))) for i in range(300)], "item_id bigint, text string")
    own = [r["text"] for r in items.limit(40).collect()]
    docs = spark.createDataFrame([(i, f"start here {t} and there {own[(i * 7) % 40][:60]} end") for i, t in enumerate(own)], "doc_id bigint, text string")
    one, many = (sorted(map(tuple, decontaminate.report(docs, items, block_bytes=b).collect())) for b in (1 << 20, 3000))
    assert one == many and all(r[2] >= 40 for r in one)


def test_a_large_group_of_near_copies_becomes_one(spark):
    """A chain in which neighbours are alike and the ends are not, beside many copies of one text."""
    base = [f"b{i}" for i in range(200)]
    chain = [list(base)]
    for k in range(20):
        step = list(chain[-1])
        for j in range(3):
            step[(k * 9 + j * 60) % 200] = f"c{k}_{j}"
        chain.append(step)
    many = [" ".join("x" if i == n % 200 else w for i, w in enumerate(base)) for n in range(120)]
    rows = [(n, t) for n, t in enumerate([*map(" ".join, chain), *many])]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), dense=8).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_scratch_folders(spark):
    mark = common.handed_out()
    first, second = (common.materialise(spark.range(n)) for n in (3, 5))
    common.release(spark, since=mark, keep=1)
    assert second.count() == 5
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(first.inputFiles()[0]).count()
    common.release(spark, since=mark)
    assert common.handed_out() == mark


def test_texts_of_very_many_lines(spark):
    """Two texts of 60,000 lines, all of them but some in both, and one line that most texts have."""
    own = [f"line {i} has {i * 7} some words of its own" for i in range(60_000)]
    other = [x if i % 1000 else x.replace("some", "other") for i, x in enumerate(own)]
    docs = spark.createDataFrame([(1, "\n".join(own)), (2, "\n".join(other)), *((i, "a footer of five words\nhello") for i in range(3, 300))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["text"] == "\n".join(own)
    assert got[2]["n_removed"] == 60_000 and got[2]["text"] == "" and got[3]["n_removed"] == 0 and got[299]["text"] == "hello"
    usual = sorted(map(tuple, line_dedup.removed_lines(common.keyed(docs.where("doc_id > 2"))).collect()))
    assert usual == sorted(map(tuple, line_dedup.removed_lines(common.keyed(docs.where("doc_id > 2")), often=5).collect())) and len(usual) == 296


def test_one_repeated_id_packs_over_many_groups(spark):
    docs = spark.range(3000).selectExpr("IF(id % 2 = 0, NULL, 7) AS doc_id", "'two words' AS text").repartition(6)
    rows = packing.pack(docs, tokenizer_path(), capacity=16, rows_per_group=100).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == 3000 and all(sorted(b) == [(3 * k, 3) for k in range(len(b))] for b in bins.values()) and len(bins) == 600


def test_what_is_broadcast_is_bounded_in_rows_and_bytes(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    rows = spark.range(100).selectExpr("id", "repeat('x', 1000) AS url")
    assert hinted(common.few(rows)) and not hinted(common.few(rows, max_broadcast_rows=99)) and not hinted(common.few(rows, max_broadcast_bytes=90_000))


def test_rows_are_ranked_without_a_task_for_each_group(spark):
    rows = spark.range(2000).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS g", "IF(id % 2 = 0, 7, id) AS v").repartition(5)
    got = common.ranked(rows, ["g"], [common.F.asc("v")]).collect()
    for g in (None, 1, 2):
        own = sorted((r["number"], r["v"]) for r in got if r["g"] == g)
        assert [n for n, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    assert len(got) == 2000 and common.ranked(rows.limit(0), [], []).count() == 0
