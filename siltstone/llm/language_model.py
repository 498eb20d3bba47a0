"""Cross-entropy difference of matched n-gram models.

A target and a background bigram model share one vocabulary (all words of both corpora; with
`vocabulary`, the most frequent ones, and all others are one unknown word) and one smoothing:
    P0(w)    = the share of w in both corpora together, (c(w) + 1) / (N + V) of the sums
    P(w)     = (c(w) + A P0(w)) / (N + A)
    P(w | h) = (c(h, w) + K P(w)) / (c(h) + K)
so that a word which one corpus happens not to hold is judged by the other. Here h is the word before,
or the start of the text; V is the number of words and the unknown one. A text's losses are the means
of -log P(w | h) over its words under either model, its score the target's loss less the background's:
the lower, the closer to the target.

Every word and bigram has its own exact count (told apart by 63 bits of hash), and what is gathered
grows with the corpora. Rows are taken in blocks of about BLOCK bytes of text. A block hands on each
different word and bigram once, with its count, as sorted runs of hashes, one run for each of the
counting tasks; a counting task adds up a range of hashes and answers each block, by place in its run,
with the totals that differ from the block's own counts (a bigram of no other block needs no answer).
Answers and texts of a block then meet in a task, which looks up every word of whole texts.

The scored table is read twice and has to come in the same partitions both times, as files and
checkpoints do; a checksum of every run fails the job otherwise.

Losses are added up as whole multiples of 2^-32, so that they don't depend on the order of rows.

Words are lower-cased (A-Z) runs without ASCII white space. Defined cases: null, empty and wordless
texts have losses and score 0 and no words; repeated rows count and score as often as they occur;
equal losses are equal scores, there is no order to break; a text beyond BLOCK bytes is a block of its
own and scored whole; a model without a text has no counts and its losses follow from the smoothing;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import WordNumbers, checkpointed, read, slices, text_blocks, utf8

UNIGRAM_PRIOR, CONTEXT_PRIOR = 1000.0, 20.0
#: Words a task counts before it hands its counts on.
HELD = 200_000
#: Bytes of text that share a run of hashes, and bytes of text for each counting task.
BLOCK, TASK_BYTES = 10_000_000, 8_000_000
#: Bits of an id's hash by which rows are left out before they meet the labels.
MARK_BITS = 24
ASKS, BACKGROUND, TARGET = 1, 2, 4
UNIT = 2.0**32
RUNS = "part int, block int, place int, roles int, n int, body binary"
ANSWERS = "part int, block int, place int, n int, sum bigint, body binary, background bigint, target bigint"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text"):
                for text in utf8(part.column("text")):
                    counts.update(words_of(text))
                if len(counts) > HELD:
                    yield out()
        yield out()

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, compressed byte plane by byte plane."""
    planes = b"".join(np.ascontiguousarray(c, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpacked(body: bytes, n: int, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view(np.uint64).reshape(n) for p in planes]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_key(word: bytes) -> int:
    """Keys of words are odd, all others even."""
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little") | 1


#: Stand-ins for the start of a text (counted once a text with words) and for words out of the vocabulary; no word holds a space.
START, UNKNOWN = word_key(b" start"), word_key(b" unknown")


class Block:
    """Counts of one block's words and bigrams by sorted key, and how often a word is a text's last."""

    def __init__(self, known: frozenset[bytes] | None):
        self.known, self.numbers = known, WordNumbers(1 << 62)
        self.codes: list[np.ndarray] = []

    def add(self, texts: list[bytes]) -> None:
        self.codes += [self.numbers.codes(words_of(t)) for t in texts]

    def close(self) -> None:
        """keys, counts n and times last; where words and bigrams are among the keys; each word's bigram."""
        known = self.known
        self.lengths = np.array([len(c) for c in self.codes], np.int64)
        code = np.concatenate([np.zeros(0, np.int64), *self.codes])
        own = np.fromiter((word_key(w) if known is None or w in known else UNKNOWN for w in self.numbers), np.uint64, len(self.numbers))
        own, one = np.unique(own, return_inverse=True)  # all unknown words are one
        code, words, own = one[code], len(own), np.append(own, np.uint64(START))
        before = np.empty_like(code)
        before[1:] = code[:-1]
        some = self.lengths > 0
        ends = np.cumsum(self.lengths)[some]
        before[ends - self.lengths[some]] = words
        pairs, self.pair, pair_n = np.unique(before * max(1, words) + code, return_inverse=True, return_counts=True)
        self.pair_before, self.pair_word = pairs // max(1, words), pairs % max(1, words)
        word_n, last_n = (np.bincount(c, minlength=words + 1) for c in (code, code[ends - 1]))
        word_n[words] = some.sum()
        both = mixed(mixed(own[self.pair_before]) + own[self.pair_word]) & ~np.uint64(1)
        self.keys, where = np.unique(np.concatenate([own, both]), return_inverse=True)
        self.n, self.last = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        np.add.at(self.n, where, np.concatenate([word_n, pair_n]))
        self.word_at, self.pair_at = where[: words + 1], where[words + 1 :]
        self.last[self.word_at] = last_n
        self.pair, self.codes, self.numbers = self.pair.astype(np.int32), [], None  # what a block holds is its task's memory

    def runs(self, places: int) -> Iterator[tuple[int, slice]]:
        """(place, slice of the keys) for every range of keys that isn't empty."""
        place = ((self.keys >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)
        begin = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(place)], strict=True):
            yield int(place[a]), slice(a, b)

    def losses(self, totals: np.ndarray, corpus: np.ndarray, size: int) -> np.ndarray:
        """Sums of each text's losses (background, target) in UNIT; totals: (keys, 4), n of both corpora, then last."""
        word_n, last_n, pair_n = totals[self.word_at, :2].astype(float), totals[self.word_at, 2:], totals[self.pair_at, :2]
        base = UNIGRAM_PRIOR * (word_n.sum(axis=1, keepdims=True) + 1) / (corpus.sum() + size)
        prior = CONTEXT_PRIOR * (word_n + base) / (corpus + UNIGRAM_PRIOR)
        context = np.log(word_n - last_n + CONTEXT_PRIOR)
        loss = context[self.pair_before] - np.log(pair_n + prior[self.pair_word])
        loss = np.rint(loss * UNIT).astype(np.int64)[self.pair]
        total = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(loss, axis=0)])
        ends = np.cumsum(self.lengths)
        return total[ends] - total[ends - self.lengths]


@dataclass
class Models:
    """Two corpora and their vocabulary (None: all words); they are counted when texts are scored."""

    background: DataFrame
    target: DataFrame
    text_col: str
    known: frozenset[bytes] | None


def fit(background: DataFrame, target: DataFrame, text_col: str = "text", vocabulary: int | None = None) -> Models:
    """Models of two corpora. vocabulary: words that are told apart, held by every task."""
    known = None
    if vocabulary is not None:
        both = background.select(F.col(text_col).cast("string").alias("text")).unionAll(target.select(F.col(text_col).cast("string").alias("text")))
        known = frozenset(bytes(r[0]) for r in word_counts(both).orderBy(F.desc("n"), "word").limit(vocabulary).select("word").collect())
    return Models(background, target, text_col, known)


def numbered(df: DataFrame, text_col: str, keep: dict[str, str]) -> DataFrame:
    """(part, text, kept): the rows under the number of their partition."""
    carried = F.struct(F.lit(1).alias("__one"), *[F.col(column).alias(name) for name, column in keep.items()])
    return df.select(F.spark_partition_id().alias("part"), F.col(text_col).cast("string").alias("text"), carried.alias("kept"))


def batch_of(schema: list[str], *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema)


def counted(rows: DataFrame, known: frozenset[bytes] | None, roles: int, places: int) -> DataFrame:
    """Every block's runs (RUNS)."""
    shared = rows.sparkSession.sparkContext.broadcast(known)  # the vocabulary's bounded size
    names = ["part", "block", "place", "roles", "n", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, number), texts in text_blocks(batches, "text", BLOCK, "part"):
            block = Block(shared.value)
            for batch in texts:
                block.add(utf8(batch.column("text")))
            block.close()
            for place, at in block.runs(places):
                keys = block.keys[at]
                row = [part, number, place, roles, len(keys)]
                body = packed(np.diff(keys, prepend=np.uint64(0)), block.n[at], block.last[at])
                yield batch_of(names, *[pa.array([x], pa.int32()) for x in row], pa.array([body], pa.binary()))

    return rows.mapInArrow(run, RUNS)


def added_up(runs: DataFrame, places: int) -> DataFrame:
    """Answers (ANSWERS) to the asking blocks, and for each place a row of part -1: words of either corpus (background, target), different words (n)."""
    names = ["part", "block", "place", "n", "sum", "body", "background", "target"]
    kinds = [pa.int32()] * 4 + [pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, keys, counts = [], [], []
        for batch in batches:
            for part, block, place, roles, n, body in zip(*[batch.column(c).to_pylist() for c in ("part", "block", "place", "roles", "n", "body")], strict=True):
                steps, *own = unpacked(body, n, 3)
                heads.append((part, block, place, roles, n))
                keys.append(np.cumsum(steps, dtype=np.uint64))
                counts.append(np.stack(own, axis=1).astype(np.int64))
        if not heads:
            return
        every = np.concatenate(keys)
        roles = np.repeat(np.array([h[3] for h in heads]), [h[4] for h in heads])
        own = np.concatenate(counts)
        own = np.concatenate([np.where((roles & role)[:, None] > 0, own[:, [k]], 0) for k in (0, 1) for role in (BACKGROUND, TARGET)], axis=1)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        sums = np.add.reduceat(own[order], begin, axis=0)
        totals = np.empty_like(own)
        totals[order] = np.repeat(sums, np.diff(np.append(begin, len(ranked))), axis=0)
        word = (ranked[begin] & np.uint64(1) == 1) & (ranked[begin] != np.uint64(START)) & (sums[:, :2].sum(axis=1) > 0)
        row = [-1, 0, heads[0][2], int(word.sum()), 0, b"", int(sums[word, 0].sum()), int(sums[word, 1].sum())]
        yield batch_of(names, *[pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)])
        at = 0
        for part, block, place, role, n in heads:
            here, at = slice(at, at + n), at + n
            if role & ASKS:
                other = (totals[here] != own[here]).any(axis=1)
                body = packed(np.packbits(np.append(other, np.zeros(-n % 64, bool))).view(np.uint64), *totals[here][other].T)
                row = [part, block, place, n, checked(every[here]), body, int(other.sum()), 0]
                yield batch_of(names, *[pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)])

    return runs.repartitionById(places, "place").mapInArrow(run, ANSWERS)


def checked(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mixed(keys), initial=np.uint64(0)) >> np.uint64(1))


def opened(body: bytes, n: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of n keys have other totals than the block's own counts, these totals) of an answer."""
    width = -(-n // 64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    column = lambda a, size: np.ascontiguousarray(planes[8 * a : 8 * (a + size)].reshape(8, size).T).view(np.uint64).reshape(size)
    bits = np.unpackbits(column(0, width).view(np.uint8))[:n].astype(bool)
    return bits, np.stack([column(width + k * other, other) for k in range(4)], axis=1).astype(np.int64)


def score(docs: DataFrame, models: Models, text_col: str = "text", keep: dict[str, str] | None = None, places: int | None = None) -> DataFrame:
    """Columns `keep`, n_words, target_loss, background_loss and score of every row.

    places: counting tasks; by default one for TASK_BYTES of the scored and the background's texts, so
    name it for a target that is much larger than both.
    """
    keep = keep or {}
    rows = numbered(docs, text_col, keep)
    roles, others, known = ASKS, [], models.known
    for corpus, role in ((models.background, BACKGROUND), (models.target, TARGET)):
        if corpus is docs and models.text_col == text_col:
            roles |= role  # the texts' questions are also their counts
        else:
            others.append((numbered(corpus, models.text_col, {}), role))
    if places is None:
        sized = [rows, *[r for r, role in others if role == BACKGROUND]]
        held = sum(r.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for r in sized)
        places = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // TASK_BYTES))
    runs = counted(rows, known, roles, places)
    for other, role in others:
        runs = runs.unionAll(counted(other, known, role, places))
    answers = checkpointed(added_up(runs, places))
    n, background, target = answers.where("part = -1").agg(F.sum("n"), F.sum("background"), F.sum("target")).first()
    corpus, size = np.array([background or 0, target or 0], float), 1 + (len(known) if known is not None else n or 0)
    shared = docs.sparkSession.sparkContext.broadcast(known)  # the vocabulary's bounded size
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema["kept"].dataType if f.name != "__one"]
    carried = "part int, block int, place int, n int, sum bigint, other bigint, body binary"
    names = ["part", "block", "place", "n", "sum", "other", "body"]
    types = [pa.int32()] * 4 + [pa.int64(), pa.int64(), pa.binary()]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts and kept columns of each block, compressed; place: -1 - the number of the piece."""
        for (part, number), texts in text_blocks(batches, "text", BLOCK, "part"):
            for k, batch in enumerate(texts):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
                    stream.write_batch(batch)
                row = [part, number, -1 - k, 0, 0, 0, sink.getvalue().to_pybytes()]
                yield batch_of(names, *[pa.array([x], kind) for x, kind in zip(row, types, strict=True)])

    def scored(pieces: list[bytes], replies: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        block, batches = Block(shared.value), [b for p in pieces for b in pa.ipc.open_stream(p)]
        for batch in batches:
            block.add(utf8(batch.column("text")))
        block.close()
        totals = np.stack([own if roles & role else np.zeros_like(own) for own in (block.n, block.last) for role in (BACKGROUND, TARGET)], axis=1)
        for place, at in block.runs(places):
            n, total, other, body = replies.pop(place, (0, 0, 0, b""))
            if n != at.stop - at.start or total != checked(block.keys[at]):
                raise RuntimeError("the scored table came in other partitions when it was read again; write or checkpoint it first")
            bits, found = opened(body, n, other)
            totals[at][bits] = found
        loss = block.losses(totals, corpus, size) / UNIT / np.maximum(1, block.lengths)[:, None]
        at = 0
        for batch in batches:
            own, words = loss[at : at + batch.num_rows], block.lengths[at : at + batch.num_rows]
            at += batch.num_rows
            arrays = [batch.column("kept").field(name) for name in keep]
            yield batch_of([*keep, "n_words", "target_loss", "background_loss", "score"], *arrays, words, own[:, 1], own[:, 0], own[:, 1] - own[:, 0])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, replies = None, [], {}
        for batch in batches:
            for part, block, place, n, total, other, body in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if (part, block) != now:
                    if pieces:
                        yield from scored(pieces, replies)
                    now, pieces, replies = (part, block), [], {}
                if place < 0:
                    pieces.append(body)
                else:
                    replies[place] = (n, total, other, body)
        if pieces:
            yield from scored(pieces, replies)

    replies = answers.where("part >= 0").select("part", "block", "place", "n", "sum", F.col("background").alias("other"), "body")
    both = rows.mapInArrow(sent, carried).unionAll(replies)
    dealt = both.repartitionById(places, F.pmod(F.col("part") + 31 * F.col("block"), F.lit(places)).cast("int")).sortWithinPartitions("part", "block", F.desc("place"))
    return dealt.mapInArrow(met, ", ".join([*kinds, "n_words bigint, target_loss double, background_loss double, score double"]))


def labelled(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text) of the rows whose id is among the distinct ids `chosen`.

    Rows whose id's hash is no chosen id's are left out before the join, so that few other texts are
    shuffled; the bits for that are of fixed size, and the join decides.
    """
    mark = F.pmod(F.xxhash64(id_col), F.lit(1 << MARK_BITS)).cast("int")
    marks = np.zeros(1 << MARK_BITS, bool)
    marks[chosen.select(mark.alias("mark")).distinct().toArrow().column("mark").to_numpy()] = True  # 2^MARK_BITS rows at most
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column("mark").to_numpy()])).drop_columns(["mark"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col).cast("string").alias(text_col), mark.alias("mark"))
    kinds = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{text_col}` string"
    return rows.mapInArrow(run, kinds).join(chosen, id_col, "left_semi").select(text_col)


def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much closer each document is to the documents labelled as of good quality than to all documents."""
    docs = read(spark, sf_dir, "documents")
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return score(docs, fit(docs, labelled(docs, good)), keep={"doc_id": "doc_id"})
