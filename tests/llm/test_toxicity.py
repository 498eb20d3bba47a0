"""The network text by text in plain numbers, and training under different numbers of threads."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest

from siltstone.llm import toxicity

TRAIN = """
import hashlib, random
import numpy as np
from siltstone.llm import toxicity
r = random.Random(3)
texts = [[r.choice(WORDS) for _ in range(r.randint(1, 90))] + ([b"grobwort"] if k % 2 else []) for k in range(200)]
network = toxicity.Network({w: k for k, w in enumerate(WORDS, 1)})
network.train(texts, np.array([k % 2 for k in range(200)]), steps=30)
print(hashlib.sha256(b"".join(network.w[k].tobytes() for k in sorted(network.w))).hexdigest())
""".replace("WORDS", repr([f"word{k}".encode() for k in range(3_000)]))


def test_training_gives_the_same_weights_under_any_number_of_threads():
    def run(threads):
        env = os.environ | {name: str(threads) for name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS")} | {"PYTHONPATH": os.pathsep.join(sys.path)}
        return subprocess.run([sys.executable, "-c", TRAIN], env=env, capture_output=True, text=True, check=True).stdout

    assert run(1) == run(2) == run(8) != ""


def plain_logit(network, words):
    """One window, number by number: GRU cells in either direction, attention, output."""
    w, h = {k: v.astype(float).tolist() for k, v in network.w.items()}, toxicity.HIDDEN

    def embedded(word):
        own, grams = w["word"][network.vocabulary.get(word, 0)], [w["gram"][g] for g in toxicity.pieces(word)]
        return [x + sum(g[k] for g in grams) / len(grams) for k, x in enumerate(own)]

    def times(x, m):
        return [sum(a * row[k] for a, row in zip(x, m, strict=True)) for k in range(len(m[0]))]

    def squash(x):
        return 1 / (1 + math.exp(-x))

    inputs = [embedded(x) for x in words] + [[0.0] * toxicity.WIDTH] * (toxicity.WINDOW - len(words))
    states = [[0.0] * (2 * h) for _ in inputs]
    for d, order, at in (("f", range(len(inputs)), 0), ("b", range(len(inputs) - 1, -1, -1), h)):
        now = [0.0] * h
        for t in order:
            x, g = [a + b for a, b in zip(times(inputs[t], w[f"W{d}"]), w[f"b{d}"], strict=True)], times(now, w[f"U{d}"])
            z, r = [squash(x[k] + g[k]) for k in range(h)], [squash(x[h + k] + g[h + k]) for k in range(h)]
            fresh = [math.tanh(x[2 * h + k] + r[k] * g[2 * h + k]) for k in range(h)]
            now = [(1 - z[k]) * fresh[k] + z[k] * now[k] for k in range(h)]
            states[t][at : at + h] = now
    real = states[: max(1, len(words))]
    level = [sum(math.tanh(a) * b for a, b in zip(times(s, w["A"]), w["v"], strict=True)) for s in real]
    share = [math.exp(x - max(level)) for x in level]
    pooled = [sum(p * s[k] for p, s in zip(share, real, strict=True)) / sum(share) for k in range(2 * h)]
    return sum(a * b for a, b in zip(pooled, w["o"], strict=True)) + w["c"][0]


def test_scores_text_by_text():
    r = np.random.default_rng(4)
    name = lambda k: bytes([97 + k // 26, 97 + k % 26, 122])
    vocabulary = {name(k): k for k in range(1, 20)}
    network = toxicity.Network(vocabulary, seed=5)
    for k, v in network.w.items():
        network.w[k] = (v * 3 + r.standard_normal(v.shape) * 0.2).astype(np.float32) if k != "gram" else v
    texts = [[name(k) for k in r.integers(1, 30, n)] for n in (0, 1, 5, 31, 32, 33, 50, 120)]
    got, n = toxicity.Scorer(network).windows_of([b" ".join(t) for t in texts], best=True)
    for k, text in enumerate(texts):
        words = toxicity.words_of(b" ".join(text))
        starts = range(0, max(1, 16 * (-(-(len(words) - 32) // 16) + 1)), 16) if len(words) > 32 else [0]
        windows = [words[s : s + 32] for s in starts]
        assert n[k] == len(windows)
        assert got[k] == pytest.approx(max(plain_logit(network, x) for x in windows), abs=1e-3)
