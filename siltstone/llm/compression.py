"""Quality classifier by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are trained, on good and on bad labelled texts. A text is compressed with
either; the difference of the compressed sizes over the text's bytes becomes a probability by logistic
calibration on labelled texts that the dictionaries haven't seen. The difference carries the score (a
test holds it alone to an AUC of 0.98); the text's own compression ratio, its length and their products
with the difference, which the compressors give as well, adjust it for short and repetitive texts.

Learning: about `sample_docs` labelled documents of each class, chosen by a hash of the id; half of
them trains the dictionaries, half the calibration. A dictionary is trained on consecutive pieces of
PART bytes of whole texts; beyond `train_bytes` of them, on each k-th piece. Every scored text is
compressed whole, however long.

Defined cases: equal texts have equal scores; null texts are empty texts, and both get the score that the calibration gives to size
zero; repeated rows and null ids are scored like any other; without documents of both classes every
score is the share of good labels (0.5 without any); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import bucket, labelled_sample, map_texts, read, row_weights, utf8
from siltstone.llm.language import logistic

#: Labelled documents of each class that are learned from, in expectation.
SAMPLE_DOCS = 1500
DICTIONARY_BYTES = 110 * 1024
#: Bytes of a piece of a labelled text, and of all pieces that train a dictionary.
PART, TRAIN_BYTES = 4096, 8_000_000
LEVEL = 3
#: Bytes added to a length when sizes are divided by it, which calms the ratios of very short texts.
SMOOTH = 256


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
        dictionary = lambda raw: zstandard.ZstdCompressionDict(raw)
        self.good, self.bad = make(dictionary(good)), make(dictionary(bad))
        self.plain = zstandard.ZstdCompressor(level=1, write_content_size=False)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Columns: size difference over bytes, compression ratio, logarithm of the length."""
        rows = np.zeros((len(texts), 3))
        for k, text in enumerate(texts):
            n = len(text) + SMOOTH
            good, bad = len(self.good.compress(text)), len(self.bad.compress(text))
            rows[k] = (bad - good) / n, min(good, bad) / n, np.log1p(len(text)) / 10
        return rows


def expand(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, x[:, 0] * x[:, 2], x[:, 1] * x[:, 2], x[:, 1] ** 2])


def train_dictionary(texts: list[bytes], train_bytes: int = TRAIN_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from pieces of whole labelled texts; of too few texts their own bytes."""
    parts = [t[at : at + PART] for t in texts for at in range(0, len(t), PART)]
    parts = parts[:: max(1, -(-sum(map(len, parts)) // train_bytes))]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(parts)[-size:]


def learn(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, train_bytes: int = TRAIN_BYTES) -> dict:
    """labels: (id, label of 0 or 1) of the rows to learn from."""
    sample, rows = labelled_sample(docs, labels, label_col, sample_docs, id_col, text_col)
    total = sum(rows.values())
    if len({y for y, _, _ in sample}) < 2:
        return {"level": rows.get(1, 0) / total if total else 0.5}
    fit = [(y, t.encode()) for y, h, t in sample if h == 0]
    rest = [(y, t.encode()) for y, h, t in sample if h == 1]
    if len({y for y, _ in fit}) < 2 or len({y for y, _ in rest}) < 2:
        fit = rest = fit + rest
    good, bad = (train_dictionary([t for y, t in fit if y == k], train_bytes) for k in (1, 0))
    x = expand(Compressors(good, bad).features([t for _, t in rest]))
    y = np.array([y for y, _ in rest], float)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    return {"good": good, "bad": bad, "mean": mean, "spread": spread, "weights": logistic((x - mean) / spread, y, 0.1, each=row_weights(y, [k for k, _, _ in sample], rows))}


def score(docs: DataFrame, learned: dict, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """Columns `keep`, score and size_difference of every row."""
    model = docs.sparkSession.sparkContext.broadcast(learned)  # two dictionaries of fixed size

    def start():
        m = model.value
        pair = Compressors(m["good"], m["bad"]) if "good" in m else None

        def work(texts: pa.Array) -> dict[str, object]:
            if pair is None:
                return {"score": pa.array(np.full(len(texts), m["level"])), "size_difference": pa.array(np.zeros(len(texts)))}
            raw = pair.features(utf8(texts))
            x = (expand(raw) - m["mean"]) / m["spread"]
            p = 1 / (1 + np.exp(-np.clip(x @ m["weights"][:-1] + m["weights"][-1], -30, 30)))
            return {"score": pa.array(p), "size_difference": pa.array(raw[:, 0])}

        return work

    return map_texts(docs, text_col, "score double, size_difference double", start, keep)


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(bucket("doc_id", 5) != 0).select("doc_id", "quality")
    learned = learn(docs, labels, "quality")
    out = score(docs, learned, keep={"doc_id": "doc_id"})
    return out.select("doc_id", F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "size_difference")
