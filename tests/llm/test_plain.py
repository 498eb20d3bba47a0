"""Piece encoding and the compression classifier, computed anew in plain loops on documents of the tables."""

import heapq
import math

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from siltstone.llm import common, compression, pieces


def best_paths(lattice, text, k):
    """The k best segmentations' scores and ids, position by position, each position keeping its k best."""
    marked = "".join(pieces.MARK + c for c in text.split(" ")) if text else ""
    held = [[(0.0, ())]] + [[] for _ in marked]
    for end in range(1, len(marked) + 1):
        found = []
        for start in range(max(0, end - lattice.longest), end):
            s = lattice.score.get(marked[start:end], lattice.unknown if end == start + 1 else None)
            if s is not None:
                ids = tuple(lattice.ids_of(marked[start:end]))
                found += [(score + s, before + ids) for score, before in held[start]]
        held[end] = heapq.nlargest(k, found, key=lambda x: x[0])
    return held[-1]


def test_nbest_of_documents(spark, sf):
    path, nbest = pieces.default_model(), 4
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text")).orderBy("doc_id").limit(25)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lattice, got = pieces.Encoder(path, nbest).lattice, {}
    for r in pieces.encode(docs, path, nbest).collect():
        got.setdefault(r["doc_id"], {})[r["rank"]] = (r["score"], tuple(r["ids"]))
    for doc_id, text in texts.items():
        want = best_paths(lattice, text, 4 * nbest)
        ours = [got[doc_id][k] for k in sorted(got[doc_id])]
        assert [s for s, _ in ours] == pytest.approx([s for s, _ in want[: len(ours)]]) and len(ours) == min(nbest, len(want))
        scores = dict((ids, s) for s, ids in want)
        assert all(scores[ids] == pytest.approx(s) for s, ids in ours if ids in scores) and len({ids for _, ids in ours}) == len(ours)
        assert ours[0][1] == want[0][1] or want[0][0] == pytest.approx(want[1][0])


def test_compression_scores(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    sample, rows = common.labelled_sample(docs, labels, "y", 10**6)
    learned = compression.learn(docs, labels, "y", sample_docs=10**6)

    def parts(k):
        found = [t.encode()[at : at + 4096] for y, half, t in sample if half == 0 and y == k for at in range(0, len(t.encode()), 4096)]
        return found[:: max(1, math.ceil(sum(map(len, found)) / 8_000_000))]

    made = {k: zstandard.train_dictionary(110 * 1024, parts(k)).as_bytes() for k in (0, 1)}
    assert (made[1], made[0]) == (learned["good"], learned["bad"])
    packers = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(made[k]), write_content_size=False, write_dict_id=False) for k in (0, 1)}

    def features(text):
        raw = (text or "").encode()
        good, bad, n = len(packers[1].compress(raw)), len(packers[0].compress(raw)), len(raw) + 256
        a, b, c = (bad - good) / n, min(good, bad) / n, math.log(1 + len(raw)) / 10
        return np.array([a, b, c, a * c, b * c, b * b])

    rest = [(y, features(t)) for y, half, t in sample if half == 1]
    x, y = np.array([f for _, f in rest]), np.array([k for k, _ in rest], float)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    each = np.array([rows[int(k)] / sum(s == k for s, _, _ in sample) for k in y])
    each /= each.mean()
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = learned["weights"]
    slope = z.T @ (each * (1 / (1 + np.exp(-z @ w)) - y)) + 0.1 * w  # nothing is left to gain
    assert np.abs(slope).max() < 1e-6
    got = {r["doc_id"]: r["score"] for r in compression.score(docs, learned, keep={"doc_id": "doc_id"}).collect()}
    for r in docs.orderBy("doc_id").limit(200).collect():
        p = 1 / (1 + math.exp(-np.clip(np.append((features(r["text"]) - mean) / spread, 1) @ w, -30, 30)))
        assert got[r["doc_id"]] == pytest.approx(p, abs=1e-9)
