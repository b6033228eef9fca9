"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a trained word vector (first number: its log-odds among the
labelled texts) and the mean vector of its character pairs, so unseen spellings say
something too. Two gated recurrent layers read a window of words both ways, attention
pools their states, a logistic unit scores the window. All overlapping windows of a
text are scored; the text's score is the highest, calibrated on the training texts.

Labels mark texts, not windows: training takes of each text the window that scores
highest so far (at first: by log-odds) and of texts labelled 0 another one too.
The fit uses about ``PER_LABEL`` labelled texts of each label, chosen by the hash of
their id, whole; every document is scored, whole.

Defined results: a null or empty text has the score of a text without signal; with
one label only, every score is that label's share; equal rows have equal scores;
rows without doc_id are held out; a very long text is scored in all its windows; a
label id that stands twice with different labels counts as both; an empty table gives
no rows; other columns of the input come through ``kept`` unchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.llm.adam import Adam
from turnwise.llm.common import bounded_sample, held_out, slices

PER_LABEL = {0: 1600, 1: 800}
WINDOW = 48
STRIDE = 32
HIDDEN = 10
WORD_DIM, PAIR_DIM, PAIRS = 6, 6, 512
VOCABULARY = 4096
#: Words a worker keeps vectors of; when full, the first half stays.
CACHE_WORDS = 250_000
_PUNCTUATION = b".,;:!?\"'()[]{}*#$%&|-_/"
_SEPARATED = np.zeros(256, bool)
_SEPARATED[[9, 10, 11, 12, 13, 32]] = True


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def starts(n: int) -> list[int]:
    """Window starts; the last window ends with the text."""
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW] if n > WINDOW else [0]


def pair_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character pairs (with the blanks around a word), and where each word's begin."""
    buf = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    at = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
    return (buf[:-1] * 31 + buf[1:]) % PAIRS, at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Network:
    """Parameters and both passes. Arrays are (window, word, ...)."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = params

    @staticmethod
    def fresh(odds: np.ndarray, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + PAIR_DIM, HIDDEN
        draw = lambda *s, by=0.1: (r.standard_normal(s) * by).astype(np.float32)
        p = {"word": draw(len(odds), WORD_DIM), "pair": draw(PAIRS, PAIR_DIM)}
        p["word"][:, 0] = odds
        for way in "fb":
            p |= {f"w{way}": draw(d, 3 * h, by=d**-0.5), f"u{way}": draw(h, 3 * h, by=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32)}
        return Network(p | {"wa": draw(2 * h, 8, by=0.3), "ba": np.zeros(8, np.float32), "va": draw(8, by=0.3), "out": draw(2 * h, by=0.3), "bias": np.zeros(1, np.float32)})

    def _gru(self, x: np.ndarray, way: str, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States (word, window, hidden) for inputs x (word, window, d); mask (word, window, 1)."""
        h3, u = x @ self.p[f"w{way}"] + self.p[f"c{way}"], self.p[f"u{way}"]
        k = HIDDEN
        h, out = np.zeros((x.shape[1], k), np.float32), np.empty((*x.shape[:2], k), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            a = h @ u
            zr = _sigmoid(h3[t, :, : 2 * k] + a[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(h3[t, :, 2 * k :] + r * a[:, 2 * k :])
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[t], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, a[:, 2 * k :]))
            h = out[t] = new
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
        """One number for each window. x: (window, word, d), mask: (window, word)."""
        x = np.ascontiguousarray(x.transpose(1, 0, 2))
        m = None if mask is None else mask.T[:, :, None]
        steps = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        hs = np.concatenate([self._gru(x, w, m, steps[w]) for w in "fb"], axis=2)
        q = np.tanh(hs @ self.p["wa"] + self.p["ba"])
        e = q @ self.p["va"]
        e = np.exp(e - e.max(axis=0)) if m is None else np.where(m[:, :, 0], np.exp(e - e.max(axis=0)), 0)
        alpha = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", alpha, hs)
        if keep is not None:
            keep.update(x=x, m=m, steps=steps, hs=hs, q=q, alpha=alpha, pooled=pooled)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, keep: dict, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of all but the input tables, and of the inputs (word, window, d)."""
        p, k, hs, q, alpha, m = self.p, HIDDEN, keep["hs"], keep["q"], keep["alpha"], keep["m"]
        g = {"out": keep["pooled"].T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["out"]
        dalpha = np.einsum("tbh,bh->tb", hs, dpool)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["va"] = np.einsum("tb,tbk->k", de, q)
        dq = de[:, :, None] * p["va"] * (1 - q * q)
        g["wa"], g["ba"] = np.einsum("tbh,tbk->hk", hs, dq), dq.sum(axis=(0, 1))
        dhs = dq @ p["wa"].T + alpha[:, :, None] * dpool
        dx = np.zeros_like(keep["x"])
        for i, way in enumerate("fb"):
            u, du, d3 = p[f"u{way}"], np.zeros_like(p[f"u{way}"]), np.zeros((*dhs.shape[:2], 3 * k), np.float32)
            dh = np.zeros(dhs.shape[1:2] + (k,), np.float32)
            for t, h, z, r, n, an in reversed(keep["steps"][way]):
                dnew = dh + dhs[t, :, i * k : (i + 1) * k]
                on = dnew if m is None else np.where(m[t], dnew, 0)
                dn = on * (1 - z) * (1 - n * n)
                dz = on * (h - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                d3[t] = np.concatenate((dz, dr, dn), axis=1)
                da = np.concatenate((dz, dr, dn * r), axis=1)
                du += h.T @ da
                dh = da @ u.T + on * z + (0 if m is None else np.where(m[t], 0, dnew))
            g[f"u{way}"], g[f"w{way}"], g[f"c{way}"] = du, np.einsum("tbd,tbk->dk", keep["x"], d3), d3.sum(axis=(0, 1))
            dx += d3 @ p[f"w{way}"].T
        return g, dx


class Model:
    """A network with its vocabulary and calibration."""

    def __init__(self, vocabulary: dict[bytes, int], network: Network, slope: float, shift: float) -> None:
        self.vocabulary, self.net, self.slope, self.shift = vocabulary, network, slope, shift
        self.index: dict[bytes, int] = {}
        self.vectors = np.zeros((1, WORD_DIM + PAIR_DIM), np.float32)

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.vocabulary.get(w.strip(_PUNCTUATION), 0) for w in words], np.int64)

    def make(self, words: list[bytes]) -> np.ndarray:
        buckets, at = pair_buckets(words)
        pair = np.add.reduceat(self.net.p["pair"][buckets], at, axis=0) / np.diff(np.append(at, len(buckets)))[:, None]
        return np.concatenate((self.net.p["word"][self.word_ids(words)], pair), axis=1).astype(np.float32)

    def _rows(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """For each text the rows of its words in ``vectors``."""
        if len(self.index) > CACHE_WORDS:
            self.index = dict(list(self.index.items())[: CACHE_WORDS // 2])
            self.vectors = self.vectors[: len(self.index) + 1].copy()
        new = list(dict.fromkeys(w for ws in docs for w in ws if w not in self.index))
        if new:
            self.index.update(zip(new, range(len(self.index) + 1, len(self.index) + 1 + len(new)), strict=True))
            self.vectors = np.concatenate((self.vectors, self.make(new)))
        get = self.index.__getitem__
        return [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in docs]

    def window_logits(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Logits of all windows of each text."""
        rows = self._rows(docs)
        out = [np.zeros(len(starts(len(r))), np.float32) for r in rows]
        full = [(d, i, s) for d, r in enumerate(rows) if len(r) >= WINDOW for i, s in enumerate(starts(len(r)))]
        short = [(d, 0, 0) for d, r in enumerate(rows) if len(r) < WINDOW]
        for jobs in (full, short):
            for at in range(0, len(jobs), 1024):
                part = jobs[at : at + 1024]
                ids = np.zeros((len(part), WINDOW), np.int64)
                for j, (d, _, s) in enumerate(part):
                    r = rows[d][s : s + WINDOW]
                    ids[j, : len(r)] = r
                got = self.net.logits(self.vectors[ids], None if jobs is full else ids > 0)
                for (d, i, _), v in zip(part, got.tolist(), strict=True):
                    out[d][i] = v
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        top = np.array([x.max() for x in self.window_logits([words_of(t) for t in texts])], np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -50, 50)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit by Newton steps, with a little shrinkage.

    Label 0 weighs more, as a text has many windows that could be highest by chance.
    """
    w = np.where(y == 1, 0.1 / max(1, y.sum()), 0.9 / max(1, (1 - y).sum())) * len(y)
    a = np.array([1.0, 0.0])
    f = np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(f @ a, -30, 30)))
        grad = f.T @ (w * (p - y)) + 0.01 * a
        a = a - np.linalg.solve((f * (w * p * (1 - p))[:, None]).T @ f + 0.01 * np.eye(2), grad)
    return float(a[0]), float(a[1])


def train(rows: list[tuple[int, str | None, int]], batch: int = 64) -> Model | float:
    """A model from rows (doc_id, text, label), or the share of label 1 where there is only one label."""
    rows = sorted(rows, key=lambda r: (r[0], r[1] or "", r[2]))
    labels = np.array([r[2] for r in rows], np.float64)
    if not rows or labels.min() == labels.max():
        return float(labels.mean()) if rows else 0.0
    docs = [words_of(r[1]) for r in rows]
    seen = {1: Counter(), 0: Counter()}
    for ws, y in zip(docs, labels, strict=True):
        seen[int(y)].update({w.strip(_PUNCTUATION) for w in ws})
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    known = sorted((w for w, c in (seen[0] + seen[1]).items() if c > 2), key=lambda w: (-(seen[0][w] + seen[1][w]), w))
    odds = {w: np.log((seen[1][w] + 0.5) / (n1 + 1)) - np.log((seen[0][w] + 0.5) / (n0 + 1)) for w in known}
    chosen = known[: VOCABULARY // 2] + sorted(known[VOCABULARY // 2 :], key=lambda w: (-abs(odds[w]), w))[: VOCABULARY // 2]
    vocabulary = {w: i for i, w in enumerate(chosen, 1)}
    model = Model(vocabulary, Network.fresh(np.array([0.0, *(np.clip(odds[w], -4, 4) / 2 for w in chosen)], np.float32)), 1.0, 0.0)
    guess = [np.array([0.0, *(odds[w] for w in chosen)])[model.word_ids(ws)] for ws in docs]
    best = [int(np.argmax([np.maximum(g[s : s + WINDOW], 0).sum() for s in starts(len(g))])) for g in guess]
    rng, net = np.random.default_rng(11), model.net
    adam = Adam(net.p, 0.01)
    epochs = max(6, min(40, 240 // -(-2 * len(docs) // batch)))  # few texts are read more often
    for epoch in range(epochs):
        if epoch in (epochs // 6, epochs // 2, epochs - 1):  # windows by the network so far
            model.index, model.vectors = {}, np.zeros((1, WORD_DIM + PAIR_DIM), np.float32)
            best = [int(x.argmax()) for x in (y for at in range(0, len(docs), 256) for y in model.window_logits(docs[at : at + 256]))]
        jobs = [(d, starts(len(ws))[b]) for d, (ws, b) in enumerate(zip(docs, best, strict=True))]
        jobs += [(d, starts(len(docs[d]))[int(rng.integers(len(starts(len(docs[d])))))]) for d in np.flatnonzero(labels == 0)]
        order = rng.permutation(len(jobs))
        for at in range(0, len(order), batch):
            part = [jobs[j] for j in order[at : at + batch]]
            texts = [docs[d][s : s + WINDOW] for d, s in part]
            uniq = list(dict.fromkeys(w for ws in texts for w in ws)) or [b"-"]
            place = {w: i for i, w in enumerate(uniq)}
            ids = np.full((len(part), WINDOW), -1, np.int64)
            for j, ws in enumerate(texts):
                ids[j, : len(ws)] = [place[w] for w in ws]
            mask, vec = ids >= 0, model.make(uniq)
            keep: dict = {}
            logit = net.logits(vec[np.maximum(ids, 0)], mask, keep)
            y = np.array([labels[d] for d, _ in part], np.float32)
            weight = np.where(y == 1, 1.0, 0.6).astype(np.float32)
            g, dx = net.gradients(keep, (weight * (_sigmoid(logit) - y) / len(part)).astype(np.float32))
            dword = np.zeros((len(uniq), WORD_DIM + PAIR_DIM), np.float32)
            np.add.at(dword, ids[mask], dx.transpose(1, 0, 2)[mask])
            g["word"], g["pair"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["pair"])
            np.add.at(g["word"], model.word_ids(uniq), dword[:, :WORD_DIM])
            g["word"][0] = 0
            buckets, at0 = pair_buckets(uniq)
            size = np.diff(np.append(at0, len(buckets)))
            np.add.at(g["pair"], buckets, np.repeat(dword[:, WORD_DIM:] / size[:, None], size, axis=0))
            adam.step(g)
    model.index, model.vectors = {}, np.zeros((1, WORD_DIM + PAIR_DIM), np.float32)
    top = np.concatenate([[x.max() for x in model.window_logits(docs[at : at + 256])] for at in range(0, len(docs), 256)])
    model.slope, model.shift = _calibrate(top.astype(np.float64), labels)
    model.index, model.vectors = {}, np.zeros((1, WORD_DIM + PAIR_DIM), np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, per_label: dict[int, int] = PER_LABEL) -> Model | float:
    """Train on labelled texts outside fold 0: about ``per_label`` texts reach the driver."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id"), folds))
    each = [bounded_sample(known.where(F.col("toxic") == y), "doc_id", n, salt="toxicity") for y, n in per_label.items()]
    some = each[0].union(each[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").collect()
    return train([(r["doc_id"], r["text"], r["toxic"]) for r in rows])


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # some 10,000 numbers and words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for b in slices(batch):
                texts = b.column(1).to_pylist()
                out = np.full(len(texts), m) if isinstance(m, float) else m.scores(texts)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, model: Model | float, limit: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below ``limit``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for b in slices(batch):
                texts = b.column(1).to_pylist()
                out = np.full(len(texts), m) if isinstance(m, float) else m.scores(texts)
                yield b.select(["doc"]).filter(pa.array(out < limit))

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"]])).select("doc.*")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score(docs, fit(docs, labels, folds))
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
