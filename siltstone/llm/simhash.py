"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most two bits agree, in one of two 32-bit halves, up to
one bit. Each distinct fingerprint is indexed under its halves as they are and under each half with
one bit blanked; rows that meet under an equal key are verified over all 64 bits inside the join.
A pair that differs in the blanked bit is met from its 0 side and its 1 side only, so it comes once.
Keys of a half that very many fingerprints share are cut by the other half: it differs in at most two bits,
so one of its three parts is equal; keys that are still too large are matched in pairs of blocks.
All copies of a fingerprint are one node; components grow by star contraction over checkpointed edges, those
of the round before deleted. Fingerprints of very many rows, and the hubs of large components, meet their
partners in many tasks.

Defined cases: null and wordless texts have fingerprint 0 and are linked like any other; very long
texts are read whole; ties of the bit vote count as 0; repeated rows are rows of one class; rows without id get their component by the fingerprint, null if no row of it has
an id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, forget, hot_keys, in_blocks, map_texts, read, sent, spread_join, utf8

SHINGLE = 3
SEED = 42
LINK_BITS = 2
#: Edges from which hubs are looked for.
HUB = 10_000
#: Fingerprints with an equal half beyond which its keys are cut, and rows of a block of those still too large.
SHARED, BLOCK = 4_000, 4_000


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number: bit set if over half the shingles' hashes set it."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    hashes = b"".join([xxhash.xxh64_digest(g, SEED) for g in grams])
    n = len(hashes) // 8
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        block = np.frombuffer(hashes, np.uint8, 8 * min(65536, n - at), 8 * at).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, rows: bool = False) -> DataFrame:
    """(id, fp bigint), or with rows=True (row struct, fp), of every whole text."""

    def start():
        def work(texts: pa.Array) -> dict[str, object]:
            found = np.array([text_fingerprint(t, shingle) for t in utf8(texts)], np.uint64)
            return {"fp": pa.array(found.view(np.int64))}

        return work

    if rows:
        docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("__source"))
        return map_texts(docs, "__source", "fp bigint", start, {"row": "row"})
    return map_texts(docs, text_col, "fp bigint", start, {id_col: id_col})


def piece(half: object) -> object:
    """A half of column fp: half 0 is the low bits."""
    return F.when(half == 0, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))


def variant_key(k: str, value: str) -> object:
    """The key of variant k (33 a half; the last leaves the half as it is) of a half's value."""
    bit = F.expr(f"if({k} % 33 = 32, 0L, shiftleft(1L, int({k} % 33)))")
    return F.shiftleft(F.col(k).cast("long"), 32).bitwiseOR(F.col(value).bitwiseAND(F.bitwise_not(bit)))


def shared_keys(nodes: DataFrame, most: int) -> DataFrame:
    """(key, shared): all variants' keys of the halves that over `most` fingerprints have."""
    halves = nodes.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).select("half", piece(F.col("half")).alias("piece"))
    hot = halves.groupBy("half", "piece").count().where(F.col("count") > most)
    variants = hot.select("piece", F.explode(F.sequence(F.col("half") * 33, F.col("half") * 33 + 32)).alias("k"))
    return variants.select(variant_key("k", "piece").alias("key")).distinct().withColumn("shared", F.lit(True))


def parted(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """rows with `part`: -1, or for shared keys three rows, one for each part of fp's other half."""
    if shared is None:
        return rows.withColumn("part", F.lit(-1))
    other = F.when(F.shiftright("key", 32) < 33, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    parts = [(F.shiftrightunsigned(other, 11 * k).bitwiseAND(0x7FF) + F.lit(k << 11)).cast("int") for k in range(3)]
    return rows.join(shared, "key", "left").withColumn("part", F.explode(F.when(F.col("shared"), F.array(*parts)).otherwise(F.array(F.lit(-1))))).drop("shared")


def links(nodes: DataFrame, most: int | None = None, block: int | None = None) -> DataFrame:
    """(u, v), u > v: all pairs of distinct fingerprints `fp` at 1 or 2 differing bits."""
    most, block = most or SHARED, block or BLOCK
    variant = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("k")).withColumn("piece", piece(F.expr("k div 33")))
    keyed = variant.select(
        "fp",
        F.expr("k % 33 = 32").alias("plain"),
        F.expr("k % 33 < 32 and piece & shiftleft(1L, int(k % 33)) <> 0").alias("one"),
        variant_key("k", "piece").alias("key"),
    )
    shared = sent(checkpointed(shared_keys(nodes, most)))
    a = parted(keyed.where("plain or not one").select("key", "plain", "fp"), shared)
    b = parted(keyed.where("plain or one").select("key", "fp"), shared)
    sizes = None
    if shared is not None:
        counts = [side.where("part >= 0").groupBy("key", "part").count() for side in (a, b)]
        sizes = sent(checkpointed(counts[0].unionAll(counts[1]).groupBy("key", "part").agg(F.sum("count").alias("rows")).where(F.col("rows") > block)))
    a, b = (in_blocks(side, sizes, ["key", "part"], "fp", block).alias(name) for side, name in ((a, "a"), (b, "b")))
    c = F.col
    close = F.bit_count(c("a.fp").bitwiseXOR(c("b.fp"))) <= LINK_BITS
    meet = (c("a.key") == c("b.key")) & (c("a.part") == c("b.part")) & (c("a.lo") == c("b.lo")) & (c("a.hi") == c("b.hi"))
    once = ((c("a.own") != c("b.own")) | (c("a.lo") == c("a.hi"))) & (~c("a.plain") | (c("a.fp") < c("b.fp")))
    return a.join(b, meet & close & once).select(F.greatest("a.fp", "b.fp").alias("u"), F.least("a.fp", "b.fp").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node of an edge table u > v with the smallest node it reaches; roots are left out."""

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = checkpointed(edges)
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hubs = hot_keys(both.groupBy("u").count(), "u") if before[0] >= HUB else []
        large = spread_join(both, least, "u", hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        met = hot_keys(large.groupBy("u").count(), "u") if before[0] >= HUB else []
        small = spread_join(large, root, "u", met).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, checkpointed(small.union(root).distinct())
        forget(old)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges


def roots(found: DataFrame) -> DataFrame:
    """`found` (fp, first, count), one row a fingerprint, with root, the class's smallest fingerprint."""
    nodes = checkpointed(found)
    above = components(links(nodes.select("fp")))
    return nodes.join(above.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def copies(found: DataFrame, id_col: str) -> DataFrame:
    """(fp, first, count): each fingerprint's smallest id and rows."""
    return found.groupBy("fp").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("count"))


def classes(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, component_id, count) of every distinct fingerprint of (id, fp)."""
    labelled = roots(copies(found, id_col))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return labelled.select("fp", "root", "count").join(least, "root").select("fp", "component_id", "count")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint hex, component_id) of every row."""
    found = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    known = checkpointed(classes(found, id_col))
    out = spread_join(found, known.drop("count"), "fp", hot_keys(known.select("fp", "count"), "fp"))
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The input's columns, one row of each class: that of the smallest id (of equal or no ids, one)."""
    found = fingerprints(docs, id_col, text_col, shingle)
    labelled = checkpointed(roots(copies(found, id_col)))
    least = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), F.col("fp"))).alias("m")
    chosen = labelled.groupBy("root").agg(least).select(F.col("m.id").alias("chosen_id"), F.col("m.fp").alias("chosen_fp"))
    rows = fingerprints(docs, id_col, text_col, shingle, rows=True)
    met = spread_join(rows, chosen.withColumnRenamed("chosen_fp", "fp"), "fp", hot_keys(labelled.select("fp", "count"), "fp")).where(F.col(f"row.`{id_col}`").eqNullSafe(F.col("chosen_id")))
    return met.groupBy("fp", "chosen_id").agg(F.first("row").alias("row")).select("row.*")  # one row of each task meets


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
