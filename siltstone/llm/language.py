"""Language identification with interpolated Kneser-Ney character models, one per language.

A text's words are its lower-cased runs without ASCII signs, digits and white space; its symbols are
their characters, each word led by start marks and closed by an end mark; contexts reach back to the
word's start. A word's log-probability under every language
is found once per worker and looked up after that; a text gets the language of the lowest
length-normalised cross-entropy. Counts of all orders lie in hash arrays sorted for binary search.

Learning: a bounded sample (about `sample_docs` different documents of each of the `most_langs` commonest
languages, chosen by a hash of id and text), whose n-grams Spark counts. The models are those of the whole
sample. Two further models, each of one half of it, judge the other half: that calibrates the score (the
chance to be right as a logistic function of the margin, over three-word pieces of the whole texts, every
text of weight one, gathered as a histogram of margins) and gives each language's limit of cross-entropy,
beyond which `rejected` is set and the score halved. It is the same for common and rare languages; one
found in one half only is judged wrong there and has no limit.

Defined cases: null texts and texts without a letter get `und` with score 0; very long texts are scored
whole; repeated rows and null ids are scored like any other; ties go to the first language in order
of name; without any labelled document every text gets `und` with score 0; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import WordNumbers, bucket, checkpointed, forget, map_texts, read, sums, valid_text

ORDER = 4
#: Documents of each language that models and calibration are learned from, in expectation.
SAMPLE_DOCS = 600
#: Tasks that count the sample's n-grams: few, so that most of a gram's occurrences are added up before the shuffle.
SAMPLE_TASKS = 8
#: Languages that models are made of, the commonest (ties: first by name).
MOST_LANGS = 256
#: Bins of the margins that a calibration is fitted on, and the margin of the last.
BINS, WIDEST = 2_000, 40.0
WORDLIKE = re.compile(r"[^\W\d_]")
START, END = "\x02", "\x03"
STEP = np.uint64(0x9E3779B97F4A7C15)


#: ASCII characters that are no letters count as white space.
SPACED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(SPACED).split() if text else []


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter; a match of WORDLIKE may be a number sign such as a fraction."""
    found = WORDLIKE.search(text) if text else None
    return bool(found) and (found[0].isalpha() or any(map(str.isalpha, text)))


def symbol_rows(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All words' symbols one after the other, each with order - 1 start marks, and which are to be foretold."""
    text = "".join(START * (order - 1) + w + END for w in words)
    symbols = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return symbols, symbols != ord(START)


def gram_hashes(symbols: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For n = 0 .. order, a hash of the n symbols that end at each place (valid where foretold)."""
    mixed = (symbols + np.uint64(1)) * STEP
    mixed ^= mixed >> np.uint64(29)
    out = [np.zeros(len(symbols), np.uint64)]
    for n in range(1, order + 1):
        back = np.zeros_like(mixed)
        back[n - 1 :] = mixed[: len(mixed) - n + 1]
        h = (out[-1] ^ back) * (STEP + np.uint64(2 * n)) + np.uint64(n)
        out.append(h ^ (h >> np.uint64(32)))
    return out


def gram_counts(words: Counter, order: int = ORDER) -> pd.DataFrame:
    """(n, context, gram, shorter, count): the grams of every length n that end in a foretold symbol."""
    symbols, foretold = symbol_rows(list(words), order)
    ends = np.flatnonzero(foretold)
    times = np.repeat(np.fromiter(words.values(), np.int64), [len(w) + 1 for w in words])
    hashes = gram_hashes(symbols, order)
    frames = []
    for n in range(1, order + 1):
        shorter = hashes[n - 1][ends]
        frame = pd.DataFrame({"n": n, "context": hashes[n - 1][ends - 1].view(np.int64), "gram": hashes[n][ends].view(np.int64), "shorter": shorter.view(np.int64), "count": times})
        frames.append(frame.groupby(["n", "context", "gram", "shorter"], as_index=False)["count"].sum())
    return pd.concat(frames)


class Models:
    """Kneser-Ney terms of all languages on common sorted hash arrays."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER):
        """counts: columns lang, n, context, gram, shorter, count."""
        self.langs = sorted(counts["lang"].unique())
        self.order = order
        self.grams, self.terms, self.contexts, self.weights = [], [], [], []
        at = {x: k for k, x in enumerate(self.langs)}
        self.base = 1.0 / max(2, counts.loc[counts["n"] == 1, "gram"].nunique())
        for n in range(1, order + 1):
            own = counts[counts["n"] == n]
            if n < order:  # lower orders count the different symbols seen before a gram
                longer = counts[counts["n"] == n + 1].groupby(["lang", "shorter"]).size()
                key = pd.MultiIndex.from_arrays([own["lang"], own["gram"]])
                own = own.assign(count=longer.reindex(key).fillna(0).to_numpy())
                own = own[own["count"] > 0]
            grams, contexts = np.unique(own["gram"].to_numpy().view(np.uint64)), np.unique(own["context"].to_numpy().view(np.uint64))
            term = np.zeros((len(grams) + 1, len(self.langs)))
            weight = np.ones((len(contexts) + 1, len(self.langs)))
            for lang, rows in own.groupby("lang"):
                c = rows["count"].to_numpy(np.float64)
                once, twice = (c == 1).sum(), (c == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                where = np.searchsorted(contexts, rows["context"].to_numpy().view(np.uint64))
                total = np.bincount(where, c, len(contexts))
                kinds = np.bincount(where, minlength=len(contexts))
                seen = total > 0
                weight[:-1][seen, at[lang]] = discount * kinds[seen] / total[seen]
                term[np.searchsorted(grams, rows["gram"].to_numpy().view(np.uint64)), at[lang]] = (c - discount) / total[where]
            self.grams.append(grams)
            self.terms.append(term)
            self.contexts.append(contexts)
            self.weights.append(weight)

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of `wanted` in the sorted `keys`; those not there get the last row (nothing known)."""
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return np.where(keys[at] == wanted, at, len(keys)) if len(keys) else np.zeros(len(wanted), np.int64)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word's symbols under each language; the last column counts symbols."""
        symbols, foretold = symbol_rows(words, self.order)
        ends = np.flatnonzero(foretold)
        hashes = gram_hashes(symbols, self.order)
        p = np.full((len(ends), len(self.langs)), self.base)
        for n in range(1, self.order + 1):
            term = self.terms[n - 1][self.find(self.grams[n - 1], hashes[n][ends])]
            p = term + self.weights[n - 1][self.find(self.contexts[n - 1], hashes[n - 1][ends - 1])] * p
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        logs = sums(np.log(p), lengths)
        return np.concatenate([logs, lengths[:, None]], axis=1)


class Scorer:
    """Cross-entropies of texts, words remembered between batches."""

    def __init__(self, models: Models):
        self.models, self.words = models, WordNumbers()
        self.table = np.zeros((0, len(models.langs) + 1), np.float32)

    def totals(self, texts: list[str | None]) -> np.ndarray:
        if self.words.room():
            self.table = self.table[:0]
        codes = [self.words.codes(words_of(t)) for t in texts]
        if new := self.words.fresh():
            self.table = np.concatenate([self.table, self.models.word_scores([w.decode() for w in new]).astype(np.float32)])
        counts = np.array([len(c) for c in codes], np.int64)
        return sums(self.table[np.concatenate([np.zeros(0, np.int64), *codes])], counts)

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        t = self.totals(texts)
        return -t[:, :-1] / np.maximum(1, t[:, -1:])


def margins(entropy: np.ndarray) -> np.ndarray:
    """Second lowest less lowest cross-entropy (with one language: a wide margin)."""
    if entropy.shape[1] < 2:
        return np.full(len(entropy), 5.0)
    two = np.partition(entropy, 1, axis=1)[:, :2]
    return two[:, 1] - two[:, 0]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30, each: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on columns x and a constant, by Newton's method; rows count `each` times."""
    x = np.column_stack([x, np.ones(len(y))])
    each = np.broadcast_to(np.asarray(each, float), len(y))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (each * (p - y)) + ridge * w
        w -= np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
    return w


def learn(
    docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, order: int = ORDER, most_langs: int = MOST_LANGS
) -> tuple[Models, np.ndarray, dict[str, float]] | None:
    """Models, calibration weights and limits, from rows of known language; None if there are none."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_langs).collect()}
    if not rows:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(rows.items()) for x in (k, min(1.0, sample_docs / n))])
    draw = F.pmod(F.xxhash64(id_col, text_col, F.lit("sample")), F.lit(1_000_000)) / F.lit(1_000_000)
    half = F.pmod(F.xxhash64(id_col, text_col, F.lit("half")), F.lit(2)).cast("int")
    picked = known.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), valid_text(text_col).alias("text"), half.alias("half")).distinct()  # copies count once
    picked = checkpointed(picked.coalesce(SAMPLE_TASKS))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[tuple[str, int], Counter] = {}
        for pdf in batches:
            for lang, own, text in zip(pdf["lang"], pdf["half"], pdf["text"], strict=True):
                words.setdefault((lang, own), Counter()).update(words_of(text))
        for (lang, own), found in words.items():
            if found:
                yield gram_counts(Counter({w.decode(): n for w, n in found.items()}), order).assign(lang=lang, half=own)

    keys = ["lang", "n", "context", "gram", "shorter"]
    kinds = "n int, context long, gram long, shorter long, count long, lang string, half int"
    grams = picked.mapInPandas(count, kinds).groupBy(*keys, "half").agg(F.sum("count").alias("count"))
    counts = grams.toPandas()  # bounded by the sample
    if not len(counts):
        return None
    models = Models(counts.groupby(keys, as_index=False)["count"].sum(), order)
    others = {own: Models(counts[counts["half"] != own], order) for own in (0, 1) if (counts["half"] != own).any()}
    shared = docs.sparkSession.sparkContext.broadcast(others)  # bounded by the sample

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A text's entropy under its own language (bin -1), and a row for each bin of its pieces' margins."""
        scorers = {own: Scorer(m) for own, m in shared.value.items()}
        for pdf in batches:
            out = []
            for lang, own, text in zip(pdf["lang"], pdf["half"], pdf["text"], strict=True):
                words = text.split()
                pieces = [" ".join(words[k : k + 3]) for k in range(0, len(words), 3)]  # short, so that some are wrong
                if own not in scorers or not pieces:
                    continue
                langs = scorers[own].models.langs
                entropy, length = scorers[own].entropies(pieces), np.array([len(p) for p in pieces])
                at = np.minimum(BINS - 1, margins(entropy) * np.sqrt(np.maximum(1, length)) / WIDEST * BINS).astype(int)
                right = np.array([lang == x for x in langs])[entropy.argmin(axis=1)]
                out += [(lang, k, 1.0 / len(pieces), ok, 0.0) for k, ok in zip(at.tolist(), right.tolist(), strict=True)]
                if lang in langs:
                    out.append((lang, -1, 0.0, True, float(scorers[own].entropies([text])[0, langs.index(lang)])))
            yield pd.DataFrame(out, columns=["lang", "bin", "weight", "right", "entropy"])

    judged = checkpointed(picked.mapInPandas(judge, "lang string, bin int, weight double, right boolean, entropy double"))
    bins = judged.where("bin >= 0").groupBy("bin", "right").agg(F.sum("weight").alias("weight")).orderBy("bin", "right").collect()  # 2 x BINS at most
    weights = logistic(np.array([(r["bin"] + 0.5) * WIDEST / BINS for r in bins]), np.array([float(r["right"]) for r in bins]), each=20 * np.array([r["weight"] for r in bins])) if bins else np.array([5.0, 0.0])
    high = {r["lang"]: r["q"] for r in judged.where("bin = -1").groupBy("lang").agg(F.percentile("entropy", F.lit(0.999)).alias("q")).collect()}  # one a language
    forget(judged)
    forget(picked)
    return models, weights, {x: 1.25 * high[x] if x in high else np.inf for x in models.langs}


def identify(docs: DataFrame, learned: tuple[Models, np.ndarray, dict[str, float]] | None, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """Columns `keep`, lang_pred, score, entropy and rejected of every row."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learned)  # bounded by the sample of learn()

    def start():
        found = model.value
        scorer = Scorer(found[0]) if found else None

        def work(column: pa.Array) -> dict[str, object]:
            texts = column.to_pylist()
            letters = np.array([has_letter(t) for t in texts], bool)
            n = len(texts)
            if scorer is None:
                return {"lang_pred": pa.array(["und"] * n, pa.string()), "score": pa.array(np.zeros(n)), "entropy": pa.array(np.zeros(n)), "rejected": pa.array(np.ones(n, bool))}
            models, (slope, level), limits = found
            entropy = scorer.entropies(texts)
            best, low = entropy.argmin(axis=1), entropy.min(axis=1)
            length = np.array([len(t or "") for t in texts])
            score = 1 / (1 + np.exp(-np.clip(slope * margins(entropy) * np.sqrt(np.maximum(1, length)) + level, -30, 30)))
            rejected = (low > np.array([limits[x] for x in models.langs])[best]) | ~letters
            score = np.where(letters, np.where(rejected, score / 2, score), 0.0)
            names = [models.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "entropy": pa.array(np.where(letters, low, 0.0)), "rejected": pa.array(rejected)}

        return work

    return map_texts(docs, text_col, "lang_pred string, score double, entropy double, rejected boolean", start, keep)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs, learn(docs.where(bucket("doc_id", 5) != 0)), keep={"doc_id": "doc_id"})
    return out.select("doc_id", F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
