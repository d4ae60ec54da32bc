"""The network against a forward pass word by word and numeric gradients; its sample, windows and odd rows."""

from __future__ import annotations

import zlib

import numpy as np

from dossier.llm import toxicity
from dossier.llm.toxicity import WINDOW, D, H


def soft(x):
    return x / (1 + abs(x))


def parameters(rng, n=6):
    near = lambda *shape: rng.normal(0, 0.5, shape)
    return near(n + 1, 2 * D), {
        "wf": near(2 * D, 3 * H), "wb": near(2 * D, 3 * H), "bf": near(3 * H), "bb": near(3 * H), "uf": near(H, 3 * H), "ub": near(H, 3 * H),
        "wa": near(2 * H, H), "va": near(H), "wo": near(2 * H), "bo": near(1),
    }


def states(xs, w, bias, u):
    h, out = [0.0] * H, []
    for x in xs:
        a = [bias[j] + sum(x[i] * w[i, j] for i in range(2 * D)) for j in range(3 * H)]
        b = [sum(h[i] * u[i, j] for i in range(H)) for j in range(3 * H)]
        r = [0.5 + 0.5 * soft(a[j] + b[j]) for j in range(H)]
        z = [0.5 + 0.5 * soft(a[H + j] + b[H + j]) for j in range(H)]
        n = [soft(a[2 * H + j] + r[j] * b[2 * H + j]) for j in range(H)]
        h = [n[j] + z[j] * (h[j] - n[j]) for j in range(H)]
        out.append(h)
    return out


def scalar_logit(emb, p, ids):
    xs = [emb[i] for i in ids if i >= 0]
    f, b = states(xs, p["wf"], p["bf"], p["uf"]), states(xs[::-1], p["wb"], p["bb"], p["ub"])[::-1]
    hs = [x + y for x, y in zip(f, b, strict=True)]
    e = np.exp([sum(p["va"][k] * soft(sum(h[i] * p["wa"][i, k] for i in range(2 * H))) for k in range(H)) for h in hs])
    pooled = [sum(a * h[i] for a, h in zip(e / e.sum(), hs, strict=True)) for i in range(2 * H)]
    return sum(pooled[i] * p["wo"][i] for i in range(2 * H)) + p["bo"][0]


def test_forward_pass_word_by_word():
    rng = np.random.default_rng(0)
    emb, p = parameters(rng)
    emb[-1] = 0
    ids = rng.integers(0, 6, (3, WINDOW))
    ids[1, 20:] = -1
    ids[2, 1:] = -1
    got = toxicity.forward(p, emb @ p["wf"] + p["bf"], emb @ p["wb"] + p["bb"], ids)
    assert np.allclose(got, [scalar_logit(emb, p, row) for row in ids], atol=1e-4)


def test_gradients_are_the_slopes(monkeypatch):
    monkeypatch.setattr(np, "float32", np.float64)  # differences need the digits
    rng = np.random.default_rng(1)
    emb, p = parameters(rng)
    emb[-1] = 0
    ids, y = rng.integers(0, 6, (4, WINDOW)), np.array([0, 1, 1, 0])
    ids[0, 9:] = -1

    def loss():
        z = toxicity.forward(p, emb @ p["wf"] + p["bf"], emb @ p["wb"] + p["bb"], ids)
        return np.mean(np.log1p(np.exp(-z)) + (1 - y) * z)

    g, demb = toxicity._gradients(p, emb, ids, y)
    for name, (value, slope) in ({k: (p[k], g[k]) for k in p} | {"emb": (emb[:-1], demb[:-1])}).items():
        flat = value.reshape(-1)
        for at in rng.integers(0, flat.size, 6):
            kept, step = flat[at], 1e-6
            flat[at] = kept + step
            above = loss()
            flat[at] = kept - step
            below = loss()
            flat[at] = kept
            assert abs((above - below) / (2 * step) - slope.reshape(-1)[at]) < 1e-5, name


def test_windows_overlap_and_cover_every_word():
    for n in (1, WINDOW - 1, WINDOW, WINDOW + 1, 57, 1000):
        rows = toxicity.windows_of(np.arange(n))
        assert {w for row in rows for w in row if w >= 0} == set(range(n)) and rows.shape[1] == WINDOW
        assert all(b[0] - a[0] <= toxicity.STRIDE for a, b in zip(rows, rows[1:], strict=False)) and (n < WINDOW or rows[-1][-1] == n - 1)


def test_one_bad_window_of_a_long_text_decides():
    rng, words = np.random.default_rng(3), [f"w{i}" for i in range(300)]
    texts = [" ".join([*rng.choice(words, 60), *(["vile"] if i % 3 == 0 else [])]).encode() for i in range(240)]
    scorer = toxicity.Scorer(toxicity.train(texts, np.array([int(i % 3 == 0) for i in range(240)])))
    clean = list(rng.choice(words, 5000))
    for at in (0, 31, 2500, 5000):
        assert scorer([" ".join([*clean[:at], "vile", *clean[at:]]).encode()])[0] >= 0.5
    assert scorer([" ".join(clean).encode()])[0] < 0.5
    a, b = b"vile w1 w2", b"w3 vile w4"
    assert np.allclose(scorer([a, b, a]), [*scorer([a]), *scorer([b]), *scorer([a])])  # neighbours don't matter


def test_sample_is_bounded_and_holds_no_held_out_text(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i % 50} {'x ' * 50}", 9) for i in range(500)] + [(None, "a", 9), (51, None, 9)], "doc_id bigint, text string, y int")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(50)] + [(0, None, 1), (None, 1, 1), (3, 1, 1), (51, 1, 1)], "doc_id bigint, toxic int, quality int")
    rows = toxicity.sample(docs, labels, max_per_class=15).collect()
    kept = {r[0] for r in docs.where(~toxicity.held_out(docs.doc_id)).select("doc_id").collect()}
    assert len(rows) == len({r["doc_id"] for r in rows}) and {r["doc_id"] for r in rows} <= kept and max(sum(r["y"] == k for r in rows) for k in (0, 1)) <= 15
    assert all(bytes(r["text"]).decode() == f"text {r['doc_id']} {'x ' * 50}" for r in rows)
    few = toxicity.sample(docs, labels, max_per_class=15, max_bytes=600).collect()
    assert 0 < sum(len(r["text"]) for r in few) <= 600


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3), (1, "a b", "x", 3), (2, "", "x", 4), (None, None, "x", 4)], "doc_id bigint, text string, score string, predicted int")
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 4 and rows[0]["score"] == rows[1]["score"] and set(rows[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    assert toxicity.score(docs.limit(0), labels).count() == 0 and toxicity.score(docs, labels.limit(0)).count() == 4


def test_a_very_long_labelled_text_is_left_out_and_no_other(spark):
    rows = [(i, f"bad ugly words {i}" if i % 2 else f"kind good words {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(61)], "doc_id bigint, quality int, toxic int")
    docs = lambda more: spark.createDataFrame(rows + more, "doc_id bigint, text string")
    take = lambda df: sorted((r["doc_id"], r["y"]) for r in toxicity.sample(df, labels, max_bytes=10_000).collect())
    first = next(i for i in (61, 63, 65, 67, 69, 71) if zlib.crc32(str(i).encode()) % 5)
    labels = labels.union(spark.createDataFrame([(first, 1, 1)], labels.schema))
    assert take(docs([(first, "long " * 100_000)])) == take(docs([])) and {y for _, y in take(docs([]))} == {0, 1}
