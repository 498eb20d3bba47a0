"""Best-fit packing by sums of squares: tokenise documents, cut long ones, fill sequences.

Each piece goes where the sum over residual gaps of (open sequences with that gap)^2 becomes
smallest. Spark deals the pieces out by number, so evenly whatever they hold, into partitions of about
`chunk` pieces, and each partition packs its own from the longest down; a partition leaves a few sequences partly filled,
whatever its size, so the loss is a fixed small share. A task holds the counts per gap and the open
sequences of its partition only.

Defined cases: null text is the empty text (it holds the closing id alone); very long texts are cut into pieces of
the capacity; repeated rows and null ids are packed like any other; pieces of one length go in the order of a hash of
their row's number; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, map_texts, read, utf8

CAPACITY = 4096
CLOSING_ID = 1
#: Pieces a partition packs.
CHUNK = 50_000
#: Words in either half of a Python worker's memory of ids.
KEPT = 350_000
#: ASCII signs that may close a word.
SIGNS = b".,;:!?|#$%&*"
#: Byte-level vocabularies write the bytes that have no visible Latin-1 form as characters from U+0100 on.
VISIBLE = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))}


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit) of each word between white space.

    The vocabulary's splitting rule never joins characters across ASCII white space, so a text's
    ids are its words' ids one after the other. It lower-cases, and parts letters from other signs,
    so that letters and the ASCII signs after them are coded apart. When `KEPT` words are known they
    become the elder half of the memory, from which words in use are taken over.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokens = tokenizer(path)
        self.model = self.tokens.model
        self.elder: dict[bytes, bytes] = {}
        self.closing: dict[bytes, bytes] = {b"": b""}

    def text_ids(self, text: bytes) -> bytes:
        if len(self) > KEPT:
            self.elder = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))

    def __missing__(self, word: bytes) -> bytes:
        ids = self.elder.pop(word, None)
        if ids is None:
            ids = self.coded(word)
        self[word] = ids
        return ids

    def coded(self, word: bytes) -> bytes:
        low = word.lower()
        letters = low.rstrip(SIGNS)
        if not letters.isalpha():  # of bytes: ASCII letters
            plain = normalize("NFC", letters.decode()).lower()
            if not plain.isalpha():
                return self.whole(word)
            letters = plain.encode()
        signs = low[len(low.rstrip(SIGNS)) :]
        if signs not in self.closing:
            if len(self.closing) > 10_000:
                self.closing = {b"": b""}
            self.closing[signs] = self.whole(signs)
        return array("I", [t.id for t in self.model.tokenize(letters.decode("latin-1").translate(VISIBLE))]).tobytes() + self.closing[signs]

    def whole(self, word: bytes) -> bytes:
        return array("I", self.tokens.encode(word.decode(), add_special_tokens=False).ids).tobytes()


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenized_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing_id: int = CLOSING_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): every document's ids and the closing id, cut at `capacity`."""
    closing = np.array([closing_id], "<u4").tobytes()
    width = 4 * capacity
    fields = "pieces array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint" + (",ids:array<bigint>>>" if with_ids else ">>")
    kind = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kind = pa.list_(pa.struct([*kind, ("ids", pa.list_(pa.int64()))] if with_ids else kind))

    def start():
        known = word_ids(path)

        def work(texts: pa.Array) -> dict[str, object]:
            rows = []
            for text in utf8(texts):
                ids = known.text_ids(text) + closing
                cuts = [ids[at : at + width] for at in range(0, len(ids), width)]
                row = [{"piece": k, "start": k * capacity, "length": len(x) // 4, "ids_crc32": zlib.crc32(x)} for k, x in enumerate(cuts)]
                if with_ids:
                    for piece, x in zip(row, cuts, strict=True):
                        piece["ids"] = np.frombuffer(x, "<u4").tolist()
                rows.append(row)
            return {"pieces": pa.array(rows, kind)}

        return work

    out = map_texts(docs, text_col, fields, start, {id_col: id_col})
    return out.select(id_col, F.inline("pieces"))


class Packer:
    """Places lengths one by one by sums of squares; holds the open sequences by gap, no placed rows.

    Into an open sequence of gap g, a piece of length s changes the sum by
    2 (N[g - s] - N[g] + 1), or by 1 - 2 N[g] if it fills the gap; into a new one by
    2 N[capacity - s] + 1 (0 if it fills it). The smallest change wins, ties to the smallest gap left.
    """

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.made = capacity, 0
        self.open_by_gap = np.zeros(capacity + 1, np.int64)
        self.waiting: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence number and offset of each length, in the order given."""
        capacity, open_by_gap, waiting = self.capacity, self.open_by_gap, self.waiting
        number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, size in enumerate(lengths.tolist()):
            left = capacity - size
            best, gap = (2 * open_by_gap[left] + 1 if left else 0), capacity
            if left:
                counts = open_by_gap[size:capacity]
                change = 2 * (open_by_gap[:left] - counts + 1)
                change[0] = 1 - 2 * counts[0]
                change[counts == 0] = np.iinfo(np.int64).max
                at = int(change.argmin())
                if change[at] <= best:
                    gap = at + size
            if gap == capacity:
                own, self.made = self.made, self.made + 1
            else:
                own = waiting[gap].pop()
                open_by_gap[gap] -= 1
            number[k], offset[k] = own, capacity - gap
            if gap > size:
                waiting[gap - size].append(own)
                open_by_gap[gap - size] += 1
        return number, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK, length_col: str = "length") -> DataFrame:
    """Add sequence_id and offset to rows of lengths 1 to `capacity`."""
    pieces = checkpointed(pieces)
    n = max(1, math.ceil(pieces.count() / chunk))
    order = F.xxhash64(F.monotonically_increasing_id())  # of a checkpoint: the same whenever it is read
    dealt = pieces.select(F.struct("*").alias("row"), F.col(length_col).cast("long").alias("__length"), order.alias("__order"))
    dealt = dealt.repartitionById(n, F.pmod("__order", F.lit(n)).cast("int")).sortWithinPartitions(F.desc("__length"), "__order").select("row", "__length", F.spark_partition_id().cast("long").alias("__part"))
    kinds = f"row {dealt.schema['row'].dataType.simpleString()}, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity)
        for b in batches:
            part = b.column("__part").to_numpy(zero_copy_only=False).astype(np.int64)
            number, offset = packer.place(b.column("__length").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array((part << 32) + number), pa.array(offset)], names=["row", "sequence_id", "offset"])

    return dealt.mapInArrow(run, kinds).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, **options) -> DataFrame:
    return pack(tokenized_pieces(docs, path, **options), options.get("capacity", CAPACITY))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), default_vocabulary())
