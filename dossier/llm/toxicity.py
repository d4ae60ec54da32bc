"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into overlapping windows of words, and every window of the whole text is scored; the text's logit is that of
its worst window. A word enters by an embedding of its own, if it stands in ``MIN_TEXTS`` texts of the sample, and by the
mean of its character trigrams' embeddings, so unseen forms of a known word still count. Two gated recurrent layers read the window forwards and backwards, attention
weighs their states, and a linear unit gives the logit.

Labels belong to texts, not to windows, so training goes in rounds: each text's worst windows by the model so far (at
first by the words' leaning, which the embeddings start from) become the examples of the next round. A logistic fit on
the training texts' worst windows puts the decision at 0.5.

The fit uses at most ``max_per_class`` labelled texts of each class, those of smallest hash of their id, one text an id, and
of these as many as ``max_bytes`` hold, so what comes to the driver is bounded however often an id is repeated and however
long its text is. Scoring covers all texts, with the weights (about a megabyte) sent to each task.

Defined results: null, empty and wordless texts score 0; a null doc_id counts as held out; labels whose toxic is null are
not learned from; without labels of both classes every text with words scores the share of toxic ones (0 without any);
equal texts score alike; of windows that score alike the score is one; texts of any length are scored whole, in batches of
windows; columns besides doc_id, text and toxic are not looked at, so their names can't clash; an empty table gives an
empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import normalised

WINDOW, STRIDE, H, D, N_CHARS, MIN_TEXTS = 32, 24, 8, 8, 32768, 3


class Vocabulary(dict):
    """Word -> its number; drain() tells of the new words the lexicon's row (0 for none) and the hashed trigrams."""

    def __init__(self, lexicon: dict[bytes, int]):
        super().__init__()
        self.lexicon, self.new = lexicon, []

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        self.new.append(w)
        return n

    def drain(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, trigrams (of all words in a row; ends of words count as letters), number of trigrams of each word."""
        new, self.new = self.new, []
        letters = np.frombuffer(b"^" + b"$^".join(new) + b"$", np.uint8).astype(np.int64)
        counts = np.fromiter(map(len, new), np.int64, len(new))
        at = _ranges(np.cumsum(counts + 2) - counts - 2, counts) if new else np.zeros(0, np.int64)
        hashed = (letters[at] * 961 + letters[at + 1] * 31 + letters[at + 2]) * 2654435761 >> 7 & N_CHARS - 1
        return np.array([self.lexicon.get(w, 0) for w in new], np.int64), hashed, counts


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers first[i] to first[i] + counts[i] - 1, one run after the other."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def windows_of(ids: np.ndarray) -> np.ndarray:
    """Rows of WINDOW word numbers, STRIDE apart; the last ends with the text; -1 fills up a short text."""
    if len(ids) <= WINDOW:
        return np.concatenate([ids, np.full(WINDOW - len(ids), -1, ids.dtype)])[None]
    starts = np.append(np.arange(0, len(ids) - WINDOW, STRIDE), len(ids) - WINDOW)
    return np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[starts]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _soft(x):
    """Softsign, in place of tanh as it costs a fraction of the time; its slope is (1 - |value|) squared."""
    return x / (np.abs(x) + np.float32(1))


def _embed(p: dict, rows, chars, counts) -> np.ndarray:
    """An embedding for each word, and a zero row at the end, which number -1 means."""
    if not len(rows):
        return np.zeros((1, 2 * D), np.float32)
    mean = np.add.reduceat(p["chars"][chars], np.cumsum(counts) - counts, axis=0) / counts[:, None]
    return np.concatenate([np.concatenate([p["words"][rows], mean], axis=1), np.zeros((1, 2 * D))]).astype(np.float32)


def _layer(x, there, u, keep: list | None):
    """States (T, B, H) of one direction; x is (T, B, 3H), there (T, B, 1) is 0 for filling."""
    h, out = np.zeros((x.shape[1], H), np.float32), np.empty((len(x), x.shape[1], H), np.float32)
    for t in range(len(x)):
        a = h @ u
        rz = np.float32(0.5) * _soft(x[t, :, : 2 * H] + a[:, : 2 * H]) + np.float32(0.5)
        r, z, an = rz[:, :H], rz[:, H:], a[:, 2 * H :]
        n = _soft(x[t, :, 2 * H :] + r * an)
        new = n + z * (h - n)
        if keep is not None:
            keep.append((h, r, z, n, an))
        if there is not None:
            new = new * there[t]
        out[t] = h = new
    return out


def forward(p: dict, table_f, table_b, ids, keep: dict | None = None) -> np.ndarray:
    """Logits of windows (B, WINDOW) of word numbers; the tables hold each word's input to either layer."""
    steps = ids.T
    there = (steps >= 0)[..., None].astype(np.float32) if (steps < 0).any() else None
    kf, kb = ([], []) if keep is not None else (None, None)
    f = _layer(table_f[steps], there, p["uf"], kf)
    b = _layer(table_b[steps[::-1]], None if there is None else there[::-1], p["ub"], kb)[::-1]
    h = np.concatenate([f, b], axis=2)
    key = _soft(h @ p["wa"])
    e = key @ p["va"]
    if there is not None:
        e = np.where(there[..., 0] > 0, e, np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    alpha = e / e.sum(axis=0)
    pooled = (alpha[..., None] * h).sum(axis=0)
    if keep is not None:
        keep.update(there=there, kf=kf, kb=kb, h=h, key=key, alpha=alpha, pooled=pooled)
    return pooled @ p["wo"] + p["bo"][0]


def _layer_back(dout, kept, there, u, du):
    dx, dh = np.empty((len(kept), dout.shape[1], 3 * H), np.float32), np.zeros((dout.shape[1], H), np.float32)
    for t in reversed(range(len(kept))):
        h, r, z, n, an = kept[t]
        dh = dh + dout[t]
        if there is not None:
            dh = dh * there[t]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        slope = lambda gate: 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
        da = np.concatenate([dn * an * slope(r), dh * (h - n) * slope(z), dn * r], axis=1)
        dx[t] = np.concatenate([da[:, : 2 * H], dn], axis=1)
        du += h.T @ da
        dh = dh * z + da @ u.T
    return dx


def _gradients(p: dict, emb, ids, y) -> tuple[dict, np.ndarray]:
    """Gradients of the mean logistic loss: by parameter, and of the words' embeddings."""
    keep: dict = {}
    logits = forward(p, emb @ p["wf"] + p["bf"], emb @ p["wb"] + p["bb"], ids, keep)
    d = ((_sigmoid(logits) - y) / len(y)).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["wo"], g["bo"][0] = keep["pooled"].T @ d, d.sum()
    h, key, alpha = keep["h"], keep["key"], keep["alpha"]
    dpool = d[:, None] * p["wo"]
    dalpha = (h * dpool).sum(axis=2)
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
    g["va"] = np.einsum("tbk,tb->k", key, de)
    dkey = de[..., None] * p["va"] * (1 - np.abs(key)) ** 2
    g["wa"] = np.einsum("tbh,tbk->hk", h, dkey)
    dh = alpha[..., None] * dpool + dkey @ p["wa"].T
    there = keep["there"]
    dxf = _layer_back(dh[:, :, :H], keep["kf"], there, p["uf"], g["uf"])
    dxb = _layer_back(dh[::-1, :, H:], keep["kb"], None if there is None else there[::-1], p["ub"], g["ub"])[::-1]
    demb, steps = np.zeros_like(emb), ids.T
    for dx, w, bias in ((dxf, "wf", "bf"), (dxb, "wb", "bb")):
        table = np.zeros((len(emb), 3 * H), np.float32)
        np.add.at(table, steps.ravel(), dx.reshape(-1, 3 * H))
        table[-1] = 0  # filling
        g[w], g[bias] = emb.T @ table, table.sum(axis=0)
        demb += table @ p[w].T
    return g, demb


def _leaning(features: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Of each feature, by how many deviations more texts of class 1 have it than expected, in thirds, from -3 to 3."""
    n = np.zeros((2, size))
    for f, label in zip(features, y, strict=True):
        n[int(label), np.unique(f)] += 1
    expected = n.sum(axis=0) * y.mean()
    return np.clip((n[1] - expected) / np.sqrt(expected + 1) / 3, -3, 3)


def train(texts: list[bytes], y: np.ndarray, *, rounds: int = 3, epochs: int = 4, min_steps: int = 100, batch: int = 128, rate: float = 0.01, seed: int = 1) -> dict:
    """Parameters from texts and labels 0 or 1, at least one of each; every text has a word.

    A small sample is gone through more often, so that each round has min_steps batches or so.
    """
    rng = np.random.default_rng(seed)
    split = [normalised(t) for t in texts]
    in_texts = Counter(w for words in split for w in set(words))
    lexicon = {w: i + 1 for i, w in enumerate(sorted(w for w, n in in_texts.items() if n >= MIN_TEXTS))}
    vocabulary = Vocabulary(lexicon)
    docs = [np.array([vocabulary[w] for w in words], np.int64) for words in split]
    rows, chars, counts = vocabulary.drain()
    first = np.cumsum(counts) - counts
    near = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    p = {
        "words": near(0.1, len(lexicon) + 1, D), "chars": near(0.1, N_CHARS, D), "wf": near(0.3, 2 * D, 3 * H), "wb": near(0.3, 2 * D, 3 * H), "bf": zero(3 * H), "bb": zero(3 * H),
        "uf": near(0.3, H, 3 * H), "ub": near(0.3, H, 3 * H), "wa": near(0.3, 2 * H, H), "va": near(0.3, H), "wo": near(0.3, 2 * H), "bo": zero(1),
    }
    p["words"][:, 0] = _leaning([rows[d] for d in docs], y, len(lexicon) + 1)
    p["words"][0] = 0
    p["chars"][:, 0] = _leaning([chars[_ranges(first[u], counts[u])] for u in map(np.unique, docs)], y, N_CHARS)
    leaning = np.append(p["words"][rows, 0], -9)
    windows = [windows_of(d) for d in docs]
    every, per_text = np.concatenate(windows), np.array([len(w) for w in windows])
    starts = np.cumsum(per_text) - per_text
    owner = np.repeat(np.arange(len(docs)), per_text)
    scores = np.sort(leaning[every], axis=1)[:, -3:].sum(axis=1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    n = np.bincount(y, minlength=2)
    rare, repeat, step = int(n.argmin()), int(np.clip(round(n.max() / n.min()), 1, 8)), 0
    for _ in range(rounds):
        worst = np.lexsort((-scores, owner))[starts]  # each text's highest window
        some = starts + rng.integers(0, per_text)
        chosen = np.unique(np.concatenate([worst, some[y == 0]]))
        chosen = np.concatenate([chosen, *[chosen[y[owner[chosen]] == rare]] * (repeat - 1)])
        for _ in range(max(epochs, -(-min_steps * batch // len(chosen)))):
            rng.shuffle(chosen)
            for at in range(0, len(chosen), batch):
                own = chosen[at : at + batch]
                words, ids = np.unique(every[own], return_inverse=True)
                ids = ids.reshape(len(own), WINDOW)
                if words[0] < 0:
                    words, ids = words[1:], ids - 1
                tri = chars[_ranges(first[words], counts[words])]
                emb = _embed(p, rows[words], tri, counts[words])
                g, demb = _gradients(p, emb, ids, y[owner[own]])
                np.add.at(g["words"], rows[words], demb[:-1, :D])
                np.add.at(g["chars"], tri, np.repeat(demb[:-1, D:] / counts[words][:, None], counts[words], axis=0))
                g["words"][0] = 0
                step += 1
                for k, v in p.items():
                    m, s = moments[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.001 * (g[k] ** 2 - s)
                    v -= (rate / 3 if k in ("words", "chars") else rate) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        emb = _embed(p, rows, chars, counts)
        tf, tb = emb @ p["wf"] + p["bf"], emb @ p["wb"] + p["bb"]
        scores = np.concatenate([forward(p, tf, tb, every[i : i + 4096]) for i in range(0, len(every), 4096)])
    z = np.maximum.reduceat(scores, starts)
    # a logistic fit of the worst windows' logits, by Newton steps with a slight pull to 1 and 0
    a, c = 1.0, 0.0
    for _ in range(30):
        q = _sigmoid(a * z + c)
        w = q * (1 - q)
        ga, gc = ((q - y) * z).sum() + 0.1 * (a - 1), (q - y).sum() + 0.1 * c
        haa, hac, hcc = (w * z * z).sum() + 0.1, (w * z).sum(), w.sum() + 0.1
        det = haa * hcc - hac * hac
        a, c = a - np.clip((hcc * ga - hac * gc) / det, -1, 1), c - np.clip((haa * gc - hac * ga) / det, -1, 1)
    return p | {"calibration": np.array([max(a, 1e-3), c], np.float32), "lexicon": lexicon}


class Scorer:
    """Scores texts; keeps the inputs of words met so far, and forgets them when there are many."""

    def __init__(self, p: dict, most: int = 300_000):
        self.p, self.most = p, most
        self._reset()

    def _reset(self):
        self.vocabulary, self.known = Vocabulary(self.p["lexicon"]), 0
        self.tables = [np.zeros((1024, 3 * H), np.float32) for _ in "fb"]

    def _learn(self) -> None:
        """Inputs of the words met since the last call; the row after the last is that of filling."""
        rows, chars, counts = self.vocabulary.drain()
        emb, end = _embed(self.p, rows, chars, counts), self.known + len(rows)
        for i, side in enumerate("fb"):
            table = self.tables[i]
            if end >= len(table):
                table = self.tables[i] = np.concatenate([table, np.zeros((end + 1, 3 * H), np.float32)])
            table[self.known : end + 1] = emb @ self.p["w" + side] + self.p["b" + side]
        self.known = end

    def __call__(self, texts: list[bytes | None], block: int = 4096) -> np.ndarray:
        """Scores of the texts, in batches of windows of one block at most, however long a text is."""
        if len(self.vocabulary) > self.most:
            self._reset()
        docs = [np.fromiter(map(self.vocabulary.__getitem__, w), np.int64, len(w)) for w in map(normalised, texts)]
        if len(self.vocabulary) > self.known:
            self._learn()
        out = np.zeros(len(texts))
        some = [i for i, d in enumerate(docs) if len(d)]
        if some:
            windows = [windows_of(docs[i]) for i in some]
            counts = np.array([len(w) for w in windows])
            every, f, b = np.concatenate(windows), *(t[: self.known + 1] for t in self.tables)
            z = np.concatenate([forward(self.p, f, b, every[i : i + block]) for i in range(0, len(every), block)])
            a, c = self.p["calibration"]
            out[some] = _sigmoid(a * np.maximum.reduceat(z, np.cumsum(counts) - counts).astype(np.float64) + c)
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, max_per_class: int = 1500, max_bytes: int = 48 << 20) -> DataFrame:
    """doc_id, y, text (binary) of the labelled texts to learn from: not held out, one an id and label, bounded in rows and bytes.

    Of each class the shortest texts are taken that max_bytes / 2 hold together, so a text too long is left out and no other.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    parts = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for k in (0, 1)]
    chosen = parts[0].union(parts[1])  # at most 2 * max_per_class rows, so fit to broadcast
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    shortest = Window.partitionBy("y").orderBy(F.octet_length("text"), F.xxhash64("doc_id"), "doc_id")  # two windows of max_per_class rows
    rows = rows.withColumn("__bytes", F.sum(F.octet_length("text").cast("long")).over(shortest.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("__bytes") <= max_bytes // 2).drop("__bytes")


def fit(docs: DataFrame, labels: DataFrame, *, max_per_class: int = 1500, max_bytes: int = 48 << 20, **how) -> dict:
    """Parameters learned from labelled texts that are not held out; {"share": s} without both classes."""
    rows = sorted(sample(docs, labels, max_per_class, max_bytes).collect(), key=lambda r: (r["doc_id"], r["y"]))  # max_bytes at most
    rows = [r for r in rows if normalised(bytes(r["text"]))]
    y = np.array([r["y"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return {"share": float(y.mean()) if len(y) else 0.0}
    return train([bytes(r["text"]) for r in rows], y, **how)


def score(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    p = fit(docs, labels, **how)

    def run(batches):
        scorer = (lambda texts: np.array([p["share"] * bool(normalised(t)) for t in texts])) if "share" in p else Scorer(p)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                scores = scorer(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
