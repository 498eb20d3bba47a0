"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding (words of the training vocabulary) plus the mean embedding of its
hashed character pieces: all trigrams, and the beginnings of 4 to 8 characters. Windows of `WINDOW` words, half overlapping, run through a GRU in either
direction; attention over the states gives one logit a window, and a text scores by its highest
window. The logit becomes a probability by logistic calibration over whole labelled texts.

Scoring finds each different word's input products once per worker and runs all windows of a batch
together, one matrix product a step. Every window of every whole text is scored.

Learning: about `sample_docs` labelled documents of each class, chosen by a hash of the id; three
quarters of them train the network in a fixed number of steps, the rest calibrate. Draws are seeded, and matrix
products are made in blocks of so few rows that the linear algebra library doesn't share one among threads, so
that weights don't depend on the number of threads. Training has a fixed cost at the driver, whatever the input.

Defined cases: null, empty and wordless texts are one empty window; repeated rows and null ids are
scored like any other; without documents of both classes every score is the share of toxic labels (0
without any); an empty table gives an empty result; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import WordNumbers, bucket, labelled_sample, map_texts, read, row_weights, utf8
from siltstone.llm.language import logistic

SAMPLE_DOCS = 2500
WINDOW, STRIDE = 32, 16
WIDTH, HIDDEN, ATTENTION = 16, 8, 8
PIECES = 65536
#: Texts of the training sample that a word must occur in to get its own embedding.
MIN_TEXTS = 3
STEPS, ROUNDS, BATCH, RATE = 900, 6, 128, 0.01
#: ASCII characters that are no letters count as white space; A-Z are lower-cased.
PLAIN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else b if b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def pieces(word: bytes) -> list[int]:
    """Buckets of a word's character pieces, its ends marked."""
    marked = f"<{word.decode()}>"
    found = [marked[k : k + 3] for k in range(len(marked) - 2)] + [marked[:k] for k in range(5, min(9, len(marked)) + 1)]
    return [zlib.crc32(x.encode()) % PIECES for x in found]


#: Rows of one matrix product: below what the library shares among threads.
ROWS = 256


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in blocks of rows."""
    return a @ b if len(a) <= ROWS else np.concatenate([a[k : k + ROWS] @ b for k in range(0, len(a), ROWS)])


def folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, the sums of blocks of rows added in their order."""
    total = a[:ROWS].T @ b[:ROWS]
    for k in range(ROWS, len(a), ROWS):
        total += a[k : k + ROWS].T @ b[k : k + ROWS]
    return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of every window: each STRIDE words until a text's last word is covered."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), n)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return text, first


class Network:
    """Weights by name: word and piece embeddings, two GRUs, attention, output."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 7):
        r = np.random.default_rng(seed)
        small = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        self.vocabulary = vocabulary  # numbers from 1; 0: other words
        self.w = {"word": small(len(vocabulary) + 1, WIDTH), "gram": small(PIECES, WIDTH), "A": small(2 * HIDDEN, ATTENTION) * 5, "v": small(ATTENTION), "o": small(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        self.w["word"][0] = 0
        for d in "fb":
            self.w |= {f"W{d}": small(WIDTH, 3 * HIDDEN) * 3, f"U{d}": small(HIDDEN, 3 * HIDDEN) * 3, f"b{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """A row for each word, and what backward() needs."""
        grams = [pieces(w) for w in words]
        sizes = np.array([len(g) for g in grams], np.int64)
        flat = np.fromiter((x for g in grams for x in g), np.int64, int(sizes.sum()))
        own = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        if not len(words):
            return np.zeros((0, WIDTH), np.float32), (own, flat, sizes)
        mean = np.add.reduceat(self.w["gram"][flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)
        return self.w["word"][own] + mean, (own, flat, sizes)

    def run(self, products: dict[str, np.ndarray], codes: np.ndarray, keep: bool = False):
        """Logit of each window; codes: (windows, WINDOW), row numbers of products, -1 beyond the end.

        products: by direction, inputs @ W + b with a last row for -1 (b alone).
        """
        n, h = len(codes), HIDDEN
        states = np.empty((WINDOW, n, 2 * h), np.float32)
        trace = []
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            u, now, part = self.w[f"U{d}"], np.zeros((n, h), np.float32), slice(0, h) if d == "f" else slice(h, 2 * h)
            for t in order:
                x, g = products[d][codes[:, t]], product(now, u)
                gates = sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                cand = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
                if keep:
                    trace.append((d, t, now, z, r, cand, g[:, 2 * h :]))
                now = cand + z * (now - cand)
                states[t, :, part] = now
        real = codes.T >= 0
        real[0] = True
        inner = np.tanh(product(states.reshape(-1, 2 * h), self.w["A"])).reshape(WINDOW, n, -1)
        e = np.where(real, inner @ self.w["v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        share = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        logit = pooled @ self.w["o"] + self.w["c"]
        return (logit, (states, trace, inner, share, pooled)) if keep else logit

    def products(self, x: np.ndarray) -> dict[str, np.ndarray]:
        x = np.concatenate([x, np.zeros((1, WIDTH), np.float32)])
        return {d: product(x, self.w[f"W{d}"]) + self.w[f"b{d}"] for d in "fb"}

    def gradients(self, words: list[bytes], codes: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        x, (own, flat, sizes) = self.inputs(words)
        p = self.products(x)
        logit, (states, trace, inner, share, pooled) = self.run(p, codes, keep=True)
        n, h = len(codes), HIDDEN
        prob = sigmoid(logit)
        d_logit = ((prob - y) / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.w.items() if k not in ("word", "gram")}
        g["o"], g["c"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pool = d_logit[:, None] * self.w["o"]
        d_states = share[:, :, None] * d_pool
        d_share = np.einsum("tnh,nh->tn", states, d_pool)
        d_e = share * (d_share - (share * d_share).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", d_e, inner)
        d_inner = (d_e[:, :, None] * self.w["v"] * (1 - inner**2)).reshape(-1, ATTENTION)
        g["A"] = folded(states.reshape(-1, 2 * h), d_inner)
        d_states += product(d_inner, self.w["A"].T).reshape(states.shape)
        d_x = np.zeros_like(x)
        for d in "fb":
            u, carry, d_p = self.w[f"U{d}"], np.zeros((n, h), np.float32), np.zeros_like(p[d])
            part = slice(0, h) if d == "f" else slice(h, 2 * h)
            for _, t, before, z, r, cand, g_n in reversed([s for s in trace if s[0] == d]):
                d_now = carry + d_states[t, :, part]
                d_cand = d_now * (1 - z) * (1 - cand**2)
                d_z = d_now * (before - cand) * z * (1 - z)
                d_r = d_cand * g_n * r * (1 - r)
                d_pre = np.concatenate([d_z, d_r, d_cand], axis=1)
                d_g = np.concatenate([d_z, d_r, d_cand * r], axis=1)
                g[f"U{d}"] += before.T @ d_g
                carry = d_now * z + d_g @ u.T
                np.add.at(d_p, codes[:, t], d_pre)
            g[f"W{d}"], g[f"b{d}"] = folded(x, d_p[:-1]), d_p.sum(axis=0)
            d_x += product(d_p[:-1], self.w[f"W{d}"].T)
        for name, at, d_row in (("word", own, d_x), ("gram", flat, np.repeat(d_x / sizes[:, None].astype(np.float32), sizes, axis=0))):
            rows, place = np.unique(at, return_inverse=True)
            total = np.zeros((len(rows), WIDTH), np.float32)
            np.add.at(total, place, d_row)
            g[name] = (rows, total)
        loss = float(-np.mean(np.log(np.where(y > 0, prob, 1 - prob) + 1e-9)))
        return g, loss

    def train(self, texts: list[list[bytes]], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam on drawn windows, as many of either label."""
        r = np.random.default_rng(seed)
        counts = np.array([len(t) for t in texts], np.int64)
        text, first = windows(counts)
        sides = [np.flatnonzero(labels[text] == k) for k in (0, 1)]
        even = 1.0 / np.sqrt(np.bincount(text))[text]  # so that long texts don't outweigh the rest
        weight = [even[x] / even[x].sum() for x in sides]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        joined = [b" ".join(t) for t in texts]
        for step in range(1, steps + 1):
            if step % -(-steps // ROUNDS) == 0 and step < steps:
                weight = self.redraw(np.concatenate([Scorer(self).windows_of(joined[at : at + 500]) for at in range(0, len(joined), 500)]), text, sides, even)
            rate = np.float32(RATE * min(1.0, 2.0 * (1 - (step - 1) / steps)))
            chosen = np.concatenate([r.choice(side, BATCH // 2, p=p) for side, p in zip(sides, weight, strict=True)])
            numbers = WordNumbers()
            codes = np.full((BATCH, WINDOW), -1, np.int64)
            for k, c in enumerate(chosen):
                own = texts[text[c]][first[c] : first[c] + WINDOW]
                codes[k, : len(own)] = numbers.codes(own)
            g, _ = self.gradients(list(numbers), codes, labels[text[chosen]].astype(np.float32))
            for k, v in g.items():
                at, v = v if isinstance(v, tuple) else (slice(None), v)
                if k == "word":
                    v[at == 0] = 0  # other words are told by their pieces alone
                m[k][at] = 0.9 * m[k][at] + 0.1 * v
                s[k][at] = 0.999 * s[k][at] + 0.001 * v * v
                self.w[k][at] -= rate * (m[k][at] / (1 - 0.9**step) / (np.sqrt(s[k][at] / (1 - 0.999**step)) + 1e-8) + np.float32(1e-3 if k in ("word", "gram") else 0) * self.w[k][at])

    @staticmethod
    def redraw(logit: np.ndarray, text: np.ndarray, sides: list[np.ndarray], even: np.ndarray) -> list[np.ndarray]:
        """Chances of the windows: clean ones half by their score, toxic texts' by the softmax of theirs."""
        clean, toxic = sides
        hard = sigmoid(logit[clean]).astype(np.float64) + 1e-6
        top = np.full(text.max() + 1, -np.inf)
        np.maximum.at(top, text, logit)
        soft = np.exp(1.5 * (logit - top[text]).astype(np.float64))
        soft = (soft / np.bincount(text, soft)[text])[toxic]
        both = 0.5 * even[clean] / even[clean].sum() + 0.5 * hard / hard.sum()
        return [both / both.sum(), soft / soft.sum()]


class Scorer:
    """Highest window logit of each text, words' input products remembered between batches."""

    def __init__(self, network: Network):
        self.network, self.words = network, WordNumbers(150_000)
        self.clear()

    def clear(self) -> None:
        self.held = {d: np.zeros((0, 3 * HIDDEN), np.float32) for d in "fb"}

    def windows_of(self, texts: list[bytes], block: int = 4096, best: bool = False):
        """The logit of every window; with best=True (highest logit, number of windows) of each text."""
        if self.words.room():
            self.clear()
        codes = [self.words.codes(words_of(t)) for t in texts]
        if new := self.words.fresh():
            found = self.network.products(self.network.inputs(new)[0])
            self.held = {d: np.concatenate([self.held[d], found[d][:-1]]) for d in "fb"}
        products = {d: np.concatenate([self.held[d], self.network.w[f"b{d}"][None, :]]) for d in "fb"}
        counts = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate([*codes, np.full(1, -1)])
        begins = np.cumsum(counts) - counts
        text, first = windows(counts)
        out = np.zeros(len(text), np.float32)
        step = np.arange(WINDOW)
        for at in range(0, len(text), block):
            t = text[at : at + block]
            inside = first[at : at + block, None] + step
            where = np.where(inside < counts[t][:, None], begins[t][:, None] + inside, len(flat) - 1)
            out[at : at + block] = self.network.run(products, flat[where])
        if not best:
            return out
        n = np.bincount(text, minlength=len(texts))
        return np.maximum.reduceat(out, np.cumsum(n) - n) if len(texts) else out, n


def learn(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> dict:
    """labels: (id, label of 0 or 1) of the rows to learn from."""
    sample, rows = labelled_sample(docs, labels, label_col, sample_docs, id_col, text_col)
    total = sum(rows.values())
    if len({y for y, _, _ in sample}) < 2:
        return {"level": rows.get(1, 0) / total if total else 0.0}
    y = np.array([s[0] for s in sample])
    texts = [words_of(s[2].encode()) for s in sample]
    held = np.array([zlib.crc32(s[2].encode()) % 4 == 0 for s in sample])
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    seen = Counter(w for t in {tuple(t) for t, h in zip(texts, held, strict=True) if not h} for w in set(t))
    vocabulary = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n >= MIN_TEXTS), 1)}
    network = Network(vocabulary)
    network.train([t for t, h in zip(texts, held, strict=True) if not h], y[~held], steps)
    check = held if held.any() else ~held
    logit, _ = Scorer(network).windows_of([s[2].encode() for s, h in zip(sample, check, strict=True) if h], best=True)
    weights = logistic(logit[:, None].astype(float), y[check].astype(float), 0.3, each=row_weights(y[check], y.tolist(), rows))
    return {"network": network, "weights": weights}


def score(docs: DataFrame, learned: dict, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """Columns `keep`, score and n_windows of every row."""
    model = docs.sparkSession.sparkContext.broadcast(learned)  # bounded by the sample's vocabulary

    def start():
        m = model.value
        scorer = Scorer(m["network"]) if "network" in m else None

        def work(texts: pa.Array) -> dict[str, object]:
            if scorer is None:
                return {"score": pa.array(np.full(len(texts), float(m["level"]))), "n_windows": pa.array(np.zeros(len(texts), np.int64))}
            logit, n = scorer.windows_of(utf8(texts), best=True)
            p = 1 / (1 + np.exp(-np.clip(logit.astype(np.float64) * m["weights"][0] + m["weights"][1], -30, 30)))
            return {"score": pa.array(p), "n_windows": pa.array(n.astype(np.int64))}

        return work

    return map_texts(docs, text_col, "score double, n_windows bigint", start, keep)


THRESHOLD = 0.7


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(bucket("doc_id", 3) != 1).select("doc_id", "toxic")
    out = score(docs, learn(docs, labels, "toxic"), keep={"doc_id": "doc_id"})
    return out.select("doc_id", F.coalesce(bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_windows")


def kept_rows(docs: DataFrame, learned: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows that score below `threshold`, with the input's columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_col).alias("__source"))
    return score(rows, learned, "__source", {"__row": "__row"}).where(F.col("score") < threshold).select("__row.*")
