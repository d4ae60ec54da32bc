"""Alignment against both tokenizers on whole texts and a walk over every pair of tokens."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from dossier.llm import alignment
from dossier.llm.packing import _byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "\t", "  two  blanks  and more   ", "line\nline\n\nline \n line\r\nend\n", "<|endoftext|> <s></s><unk> as text", "▁ low line", "a▁b", "<0x41> is text", "Ünïcode wörds ½ ＡＢ é 你好 世界 🙂🙂  nbsp　wide sep",
    "don't we'll I'M they've", "123 45 6,789.0 a1b2", "\x00\x01 control \x1c x \x1d\x1e y\x7f", "x" * 30_000, "ab " * 5000, "one", "one", "مرحبا بالعالم नमस्ते", "    indented\n        code();\n\treturn x;\r\n", "tail \n", "\x85next\x85 line",
]


def brute(rows):
    whole, model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    whole.encode_special_tokens = True
    letters = {letter: b for b, letter in _byte_letters().items()}
    found = []
    for doc_id, text in rows:
        ids, pieces = (whole.encode(" " + text, add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        a = [(i, bytes(letters[x] for x in whole.id_to_token(i))) for i in ids]
        name = model.id_to_piece
        b = [(i, bytes([int(name(i)[3:5], 16)]) if model.is_byte(i) else name(i).replace("▁", " ").encode()) for i in pieces]
        want = (" " + (text or "")).encode()
        if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
            a = b = []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, t in side:
                own.append((at, at + len(t), i))
                at += len(t)
            spans.append(own)
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(i) for s, _, i in side if low <= s < e) for side in spans))
            low = e
        links, k = [], 0
        for s, e, i in spans[0]:
            while k and spans[1][k][0] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][0] < e:
                if spans[1][k][1] > s:
                    links.append((i, spans[1][k][2]))
                k += 1
            k = max(0, k - 1)
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    held = Counter(p for f in found for p in set(f[4]))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return sorted((*f[:4], len(f[4]), sum(held[p] == best[p[0]] for p in f[4]), sum(held[p] for p in f[4]), f[5]) for f in found)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return spark.createDataFrame(rows + [(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def wanted(docs):
    return brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("options", [{}, {"frequent": 0}, {"frequent": 300, "chunk_bytes": 5000, "part_bytes": 700}])
def test_against_whole_texts(docs, wanted, options):
    """All pairs sent, none of them, and some of them, with chunks large and small."""
    got = alignment.report(docs.withColumn("chunk", F.lit("own")).withColumn("low", F.lit("own")), A, B, **options)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == wanted


def test_without_the_faster_encoder(docs, wanted, monkeypatch):
    usual = alignment.ByteLevel(A)
    assert usual.fast
    texts = [s for t in ODD if t for s in alignment._CUT.split(" " + t)]
    ids, counts = usual.flat(texts)
    usual.fast = None
    other = usual.flat(texts)
    assert (ids == other[0]).all() and (counts == other[1]).all()


def test_none_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.report(none, A, B).count() == 0
    got = alignment.report(spark.createDataFrame([(None, "a b"), (None, "a b"), ("x", None)], "doc_id string, text string"), A, B).collect()
    assert sorted((str(r["doc_id"]), r["n_a"], r["count_sum"]) for r in got) == [("None", 2, 4), ("None", 2, 4), ("x", 0, 0)]
