"""SentencePiece N-best encoding and decoding over the piece lattice.

A text is marked as sentencepiece does: a leading space is added and spaces become U+2581. No scored
piece of the vocabulary holds U+2581 behind its first character, so the lattice falls apart at every
mark (and at line ends, which no piece holds, and before signs behind letters, if no piece has them
so) into chunks, and a text's segmentations are the products of its chunks'. A chunk's forward Viterbi
scores (best score from its start to every place) are exact heuristics for an A-star search from its
end backwards, which yields its segmentations from the best down. Characters outside the vocabulary
are written as byte pieces at a fixed penalty below the lowest score.

The forward pass keeps the two best scores of a chunk and with them the gap between its two best
segmentations. At most nbest - 1 chunks of a text, those of
the smallest gaps, can differ from their best in the text's nbest segmentations, so only these are searched.
Their combinations are taken from the best down with a heap. The result is exact to 10^-6 of score (the
search compares scores rounded so, lest float noise part equal ones); among segmentations of equal
score the order is fixed but arbitrary.

Pieces that the model scores at -10^8 or below (runs of marks) are left out of the lattice; the bare
mark costs as much as an unknown character.

Defined cases: null is the empty text, which has one empty segmentation of score 0 and decodes to the
empty text; very long texts are encoded whole; repeated rows and null ids are encoded like any other; texts with fewer than nbest
segmentations give all they have; an empty table gives an empty result; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import WordNumbers, cuts, map_texts, read

NBEST = 3
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words in either half of a worker's memory of best segmentations.
ATOMS_KEPT = 300_000
#: Ids that are decoded at a time.
DECODED = 500_000


class Lattice:
    """Segmentations of chunks (a mark and the characters up to the next)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes = [0] * 256
        self.text: list[bytes] = []
        for k in range(sp.vocab_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.bytes[int(piece[3:-1], 16)] = k
                self.text.append(bytes([int(piece[3:-1], 16)]))
                continue
            self.text.append(b"" if sp.is_control(k) or sp.is_unknown(k) else piece.replace(MARK, " ").encode())
            if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)) and sp.get_score(k) > -1e8:
                if MARK in piece[1:]:
                    raise ValueError(f"a scored piece crosses a mark: {piece!r}")
                self.score[piece], self.id[piece] = sp.get_score(k), k
        if not sp.is_unknown(bare := sp.piece_to_id(MARK)):
            self.id[MARK] = bare
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        #: Pieces by their characters: nested by the next character, the score under "".
        self.tree: dict = {}
        for piece, score in self.score.items():
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.cuts_lines = not any("\n" in p for p in self.score)
        behind = {b for p in self.score for a, b in zip(p, p[1:], strict=False) if a.isalpha() or a > "\x7f" and a != MARK}
        signs = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in behind)
        #: ASCII signs that no piece holds right behind a letter or non-ASCII character: the lattice falls apart there too.
        self.sign_cut = re.compile(rb"(?<=[A-Za-z\x80-\xfe])(?=[" + re.escape(signs.encode()) + rb"])")

    def best(self, chunk: str) -> tuple[array, float, float]:
        """Best ids, best score, and its gap to the second best (inf if there is none)."""
        n, tree, unknown, least = len(chunk), self.tree, self.unknown, -np.inf
        first, second, came = [least] * (n + 1), [least] * (n + 1), [0] * (n + 1)
        first[0] = 0.0
        for begin in range(n):
            here, next_here = first[begin], second[begin]
            node = tree.get(chunk[begin])
            score = unknown if node is None else node.get("", unknown)
            end = begin + 1
            while True:
                if score is not None:
                    through = here + score
                    if through > first[end]:
                        other = next_here + score
                        second[end] = first[end] if first[end] > other else other
                        first[end], came[end] = through, begin
                    elif through > second[end]:
                        second[end] = through
                if node is None or end == n:
                    break
                node = node.get(chunk[end])
                if node is None:
                    break
                score = node.get("")
                end += 1
        ids, end = [], n
        while end:
            ids += self.ids_of(chunk[came[end] : end])[::-1]
            end = came[end]
        return array("i", ids[::-1]), first[n], first[n] - second[n]

    def ids_of(self, piece: str) -> list[int]:
        known = self.id.get(piece)
        return [known] if known is not None else [self.bytes[b] for b in piece.encode()]

    def search(self, chunk: str, nbest: int) -> list[tuple[float, list[int]]]:
        """The nbest segmentations of a chunk, best first, by A-star from the end backwards."""
        n = len(chunk)
        ahead = [0.0] + [-np.inf] * n
        into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for begin in range(n):
            for end in range(begin + 1, min(n, begin + self.longest) + 1):
                score = self.score.get(chunk[begin:end], self.unknown if end == begin + 1 else None)
                if score is not None:
                    into[end].append((begin, score))
                    ahead[end] = max(ahead[end], ahead[begin] + score)
        found: list[tuple[float, list[int]]] = []
        serial = 0
        # (-(cost behind + exact rest), place, serial, score behind, path): of equal totals the one nearest to the start
        agenda = [(-ahead[n], n, serial, 0.0, None)]
        while agenda and len(found) < nbest:
            total, at, _, behind, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path:
                    ids += self.ids_of(path[0])
                    path = path[1]
                found.append((behind, ids))
                continue
            for begin, score in into[at]:
                serial += 1
                heapq.heappush(agenda, (-round(ahead[begin] + score + behind, 6), begin, serial, behind + score, (chunk[begin:at], path)))
        return found


@cache
def lattice(path: str) -> Lattice:
    return Lattice(path)


def best_ways(options: list[list[tuple[float, np.ndarray]]], most: int) -> list[tuple[float, tuple[int, ...]]]:
    """(change of score, choice of each list) of the `most` combinations with the highest sums, best first.

    Each list is in falling order. A combination's successors move one list on, none before the last moved.
    """
    change = lambda way: sum(option[k][0] - option[0][0] for option, k in zip(options, way, strict=True))
    first = (0,) * len(options)
    agenda, found = [(0.0, first, 0)], []
    while agenda and len(found) < most:
        loss, way, moved = heapq.heappop(agenda)
        found.append((-loss, way))
        for k in range(moved, len(options)):
            if way[k] + 1 < len(options[k]):
                further = (*way[:k], way[k] + 1, *way[k + 1 :])
                heapq.heappush(agenda, (-change(further), further, k))
    return found


class Encoder:
    """Segmentations of texts; chunks are remembered between batches."""

    def __init__(self, path: str, nbest: int = NBEST):
        self.lattice, self.nbest = lattice(path), nbest
        self.numbers = WordNumbers(350_000)
        self.atoms: dict[bytes, bytes] = {}
        self.elder = self.atoms
        self.forget()

    def forget(self) -> None:
        self.pool, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.totals, self.gaps = np.zeros(0), np.zeros(0)
        self.others: dict[int, list[tuple[float, np.ndarray]]] = {}

    def chunks(self, text: str | None) -> list[bytes]:
        """The text's chunks; a leading space stands for the mark."""
        if not text:
            return []
        marked = b"\xff " + text.encode().replace(b" ", b"\xff ")  # no UTF-8 holds 0xff
        if self.lattice.cuts_lines:
            marked = marked.replace(b"\n", b"\xff\n\xff")
        return self.lattice.sign_cut.sub(b"\xff", marked).split(b"\xff")[1:]

    def packed(self, chunk: bytes) -> bytes:
        """Score and gap as two doubles, then the ids, of a chunk's best segmentation."""
        found = self.atoms.get(chunk)
        if found is None:
            found = self.elder.pop(chunk, None)
            if found is None:
                ids, score, gap = self.lattice.best(chunk.decode().replace(" ", MARK))
                found = struct.pack("dd", score, gap) + ids.tobytes()
            self.atoms[chunk] = found
        return found

    def learn(self) -> None:
        if not (new := self.numbers.fresh()):
            return
        if len(self.atoms) > ATOMS_KEPT:
            self.elder, self.atoms = self.atoms, {}
        found = list(map(self.packed, new))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4 - 4
        self.begins = np.concatenate([self.begins, np.cumsum(sizes) - sizes + len(self.pool)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join([f[16:] for f in found]), np.int32)])
        heads = np.frombuffer(b"".join([f[:16] for f in found])).reshape(-1, 2)
        self.totals, self.gaps = np.concatenate([self.totals, heads[:, 0]]), np.concatenate([self.gaps, heads[:, 1]])

    def alternatives(self, code: int, chunk: bytes) -> list[tuple[float, np.ndarray]]:
        if code not in self.others:
            self.others[code] = [(s, np.array(ids, np.int32)) for s, ids in self.lattice.search(chunk.decode().replace(" ", MARK), self.nbest)]
        return self.others[code]

    def encode(self, texts: list[str | None]) -> list[list[tuple[float, np.ndarray]]]:
        """[(score, ids)] of each text, best first."""
        if self.numbers.room():
            self.forget()
        split = [self.chunks(t) for t in texts]
        codes = [self.numbers.codes(c) for c in split]
        self.learn()
        out = []
        for chunks, own in zip(split, codes, strict=True):
            sizes = self.sizes[own]
            ends = np.cumsum(sizes)
            begins = ends - sizes
            ids = self.pool[np.repeat(self.begins[own] - begins, sizes) + np.arange(int(sizes.sum()))]
            total, gaps = float(self.totals[own].sum()), self.gaps[own]
            few = min(self.nbest - 1, len(own))
            places = np.sort(np.argpartition(gaps, few - 1)[:few]).tolist() if few else []
            places = [p for p in places if np.isfinite(gaps[p])]
            options = [self.alternatives(int(own[p]), chunks[p]) for p in places]
            rows = []
            for change, way in best_ways(options, self.nbest):
                parts, at = [], 0
                for p, option, k in zip(places, options, way, strict=True):
                    parts += [ids[at : begins[p]], option[k][1]]
                    at = ends[p]
                rows.append((total + change, np.concatenate([*parts, ids[at:]])))
            out.append(rows)
        return out


def encode(docs: DataFrame, path: str, nbest: int = NBEST, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, columns `keep`, rank from 1, score, ids array<int>): the nbest segmentations of every whole text."""
    kind = pa.list_(pa.struct([("rank", pa.int32()), ("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def start():
        encoder = Encoder(path, nbest)

        def work(texts: pa.Array) -> dict[str, object]:
            found = encoder.encode(texts.to_pylist())
            flat = [x for rows in found for x in rows]
            sizes = np.array([len(rows) for rows in found], np.int64)
            ranks = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            ends = np.concatenate([[0], np.cumsum([len(ids) for _, ids in flat])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *[ids for _, ids in flat]])))
            rows = pa.StructArray.from_arrays([pa.array(ranks.astype(np.int32)), pa.array(np.array([s for s, _ in flat], np.float64)), ids], ["rank", "score", "ids"])
            return {"found": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), rows).cast(kind)}

        return work

    kept = {c: c for c in (id_col, *keep)}
    out = map_texts(docs, text_col, "found array<struct<rank:int,score:double,ids:array<int>>>", start, kept)
    return out.select(*kept, F.inline("found"))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` and `decoded`: the text of each array of ids (null: null; ids of no piece: nothing)."""
    keep = [c for c in encoded.columns if c != ids_col] if keep is None else keep
    source = encoded.select(*keep, F.col(ids_col).alias("__ids"))
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array([*lattice(path).text, b""], pa.binary())
        for whole in batches:
            ends = np.cumsum(pc.fill_null(whole.column("__ids").value_lengths(), 0).to_numpy(zero_copy_only=False))
            for batch in cuts(whole, ends, DECODED):
                rows = batch.column("__ids")
                ids = rows.flatten().to_numpy(zero_copy_only=False)
                ids = np.where((ids >= 0) & (ids < len(table) - 1), ids, len(table) - 1)
                sizes = pc.fill_null(rows.value_lengths(), 0).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), table.take(pa.array(ids.astype(np.int32))))
                raw = pc.binary_join(lists, pa.scalar(b"", pa.binary())).to_pylist()
                texts = [None if x is None else (x[1:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in raw]
                texts = pc.if_else(rows.is_valid(), pa.array(texts, pa.string()), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], texts], names=[*keep, "decoded"])

    return source.mapInArrow(run, f"{kinds}, decoded string" if kinds else "decoded string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_model()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    found = encode(docs, path, keep=["text_hash"])
    digest = found.select("doc_id", "text_hash", "rank", "score", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "ids")
    back = decode(digest, path)
    return back.select("doc_id", "rank", "score", "n_pieces", "ids_hash", (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"))
