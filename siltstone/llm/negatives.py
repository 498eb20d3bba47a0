"""Hard negatives by inner product, bracketed by a pivot table of distances.

Vectors are turned so that inner products become distances: with R the largest length of all vectors a row
x becomes (x, sqrt(R^2 - |x|^2)) and an anchor q becomes (q, 0), so
    |q' - x'|^2 = R^2 + |q|^2 - 2 q.x.
Every row keeps its distances to a few pivots, rows of its own kind; an anchor's distances to them are
known too. By the triangle inequality
    max |d(q', p) - d(x', p)|  <=  |q' - x'|  <=  min (d(q', p) + d(x', p)),
which brackets each row's score; only rows whose bracket reaches the scores looked for are multiplied out,
in exact integers. The search runs twice: positives are the best rows of the anchor's own label, negatives
the best rows of other labels in the window that each positive's score opens. In a block of rows the k
smallest upper distances give a score that k rows are sure to reach, which is the first bracket's lower end.

Rows go to blocks of about `CHUNK` rows and meet the anchors in blocks of about `ANCHORS`; each block's best
few meet in a window an anchor. Rows of one label lie together in the first search; labels of more
than a block are cut by a hash, small ones share a block. In the second, rows of a nearest pivot lie
together, so that a whole block can fall to its least and largest distances.

Pivots are drawn by hash from all rows (a bounded sample, 8 a pivot in expectation); only speed depends on
them. Where the brackets exclude nothing, as among unit vectors without clusters, all anchors are multiplied
with all rows.

Defined cases: rows with a null label or id, or a vector that is null, empty, holds null or non-finite components,
is of another length than the commonest (of equals the smallest) or is longer than 2^31 once scaled (so
that every score fits 64 bits) take no part; repeated vectors are candidates of their own and tied scores
go to the smaller id; of rows that share an id each is a candidate and an anchor of its own, and only an
anchor's own row is left out; fewer positives or negatives give all; a negative positive score opens no
window; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, forget, read

PIVOTS = 12
#: Rows, and anchors, of a block.
CHUNK = 50_000
ANCHORS = 10_000
#: Anchors' positives, negatives of each, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
SCALE = 256
LONGEST = 2.0**31
#: Relative slack of the brackets for the rounding of floats.
SLACK = 1e-9


def scaled_rows(vectors: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v, width, norm2): floor(scale * x) as little-endian 64-bit numbers, of the rows that take part."""
    x = F.col(f"`{vector_col}`")
    source = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda c: c.cast("double")).alias("x"))
    source = source.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0))

    def scale_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(float(scale) * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # null: NaN
            row = np.repeat(np.arange(len(sizes)), sizes)
            with np.errstate(over="ignore", invalid="ignore"):
                norm2 = np.bincount(row, flat**2, len(sizes))
            good = norm2 < LONGEST**2  # NaN and infinity are not
            whole = np.where(good[row], flat, 0.0).astype("<i8")
            data = pa.BinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(8 * sizes)]).astype(np.int64)), pa.py_buffer(whole)])
            out = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), data.cast(pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(norm2)], names=["vec_id", "label", "v", "width", "norm2"])
            yield out.filter(pa.array(good))

    return source.mapInArrow(scale_all, "vec_id long, label long, v binary, width int, norm2 double")


def matrix(column: pd.Series, kind: str = "<i8") -> np.ndarray:
    """Rows of numbers from a column of byte strings of one length."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def lifted(v: np.ndarray, radius2: float) -> np.ndarray:
    """Rows with the coordinate that brings all of them to one length."""
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(0.0, radius2 - (v**2).sum(axis=1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)))


def spread_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of a sample far from each other: each next one is the farthest from those taken."""
    sample = sample[np.lexsort(sample.T)]
    taken, gap = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(taken) < most and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[taken[-1]]) ** 2).sum(axis=1))
    return sample[taken]


def limits(radius2: float, norm2: float, low: float, high: float) -> tuple[float, float]:
    """The largest and smallest distance at which an anchor of squared length norm2 has a score in [low, high]."""
    whole = radius2 + norm2
    return np.sqrt(max(0.0, whole * (1 + SLACK) - 2 * low)), np.sqrt(max(0.0, whole * (1 - SLACK) - 2 * high))


def beyond(far: np.ndarray, least: np.ndarray, most: np.ndarray, outer: float, inner: float) -> bool:
    """Whether no row with pivot distances between `least` and `most` can be from `inner` to `outer` away."""
    return bool((np.maximum(far - most, least - far) > outer).any() or (far + most < inner).any())


def stacked(parts: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k, c in enumerate(names)})


class Block:
    """Rows of a block with their stored distances to the pivots, to be searched anchor by anchor."""

    def __init__(self, rows: pd.DataFrame, radius2: float):
        self.row, self.id, self.label = (rows[c].to_numpy() for c in ("row", "vec_id", "label"))
        self.v, self.far = matrix(rows["v"]), matrix(rows["d"], "<f8")
        self.radius2 = radius2
        self.floats, self.largest = self.v.astype(np.float64), float(np.abs(self.v).max(initial=0))
        self.least, self.most = self.far.min(axis=0), self.far.max(axis=0)

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products of one anchor with some rows."""
        v = self.v
        if float(np.abs(q).max(initial=0)) * self.largest * len(q) < 2**53:  # every sum is exact in floats
            v, q = self.floats, q.astype(np.float64)
        if 4 * len(at) > len(v):
            return (v @ q)[at].astype(np.int64)
        return (v[at] @ q).astype(np.int64)

    def reach(self, far: np.ndarray, norm2: float, low: float, high: float, at: np.ndarray) -> np.ndarray:
        """Of the rows `at`, those whose bracket of scores meets [low, high], by one pivot after the other."""
        outer, inner = limits(self.radius2, norm2, low, high)
        if beyond(far, self.least, self.most, outer, inner):
            return at[:0]
        for k in range(len(far)):
            d = self.far[at, k]
            fits = np.abs(d - far[k]) <= outer
            if inner > 0:
                fits &= d + far[k] >= inner
            if not fits.all():
                at = at[fits]
        return at

    def sure(self, far: np.ndarray, norm2: float, k: int, at: np.ndarray) -> float:
        """A score that k of the rows `at` are sure to reach."""
        if len(at) <= k:
            return -np.inf
        upper = (self.far[at] + far).min(axis=1)
        kth = np.partition(upper, k - 1)[k - 1]
        return float(self.radius2 + norm2 - kth**2) / 2 - SLACK * (self.radius2 + norm2)


def leading(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(score) > k:
        kept = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        kept = np.arange(len(score))
    return kept[np.lexsort((ids[kept], -score[kept]))][:k]


def mine(
    vectors: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, pivots: int = PIVOTS, chunk: int = CHUNK, anchor_chunk: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors' hard negatives.

    anchors: a Column over vec_id that picks the anchor rows; label: a Column over the table's columns.
    """
    spark = vectors.sparkSession
    kinds = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    whole = checkpointed(scaled_rows(vectors, label, id_col, vector_col, scale))
    points = whole
    width = points.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("r")).orderBy(F.desc("n"), "width").first()
    if width is None:
        return spark.createDataFrame([], kinds)
    points = points.where(F.col("width") == width["width"])
    n, radius2 = width["n"], width["r"] * (1 + 1e-12)
    draw = F.pmod(F.xxhash64("vec_id", "v", F.lit("pivot")), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, 8 * pivots / n)))
    drawn = [r[0] for r in points.where(draw).select("v").distinct().collect()] or [points.select("v").first()[0]]  # 8 a pivot in expectation
    pivot = spread_pivots(lifted(matrix(pd.Series(drawn)), radius2), pivots)

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                far = distances(lifted(matrix(pdf["v"]), radius2), pivot)
                yield pdf.assign(d=[x.tobytes() for x in far], cell=far.argmin(axis=1).astype(np.int32))

    kept = points.select("vec_id", "label", "v", "norm2").mapInPandas(table, "vec_id long, label long, v binary, norm2 double, d binary, cell int")
    kept = checkpointed(kept.withColumn("is_anchor", F.coalesce(anchors, F.lit(False))).withColumn("row", F.monotonically_increasing_id()))
    forget(whole)
    asked = kept.where("is_anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", F.col("label").alias("own"), F.col("v").alias("q"), "norm2")
    spread = lambda row, parts: F.expr(f"int(pmod(xxhash64({row}), {parts}))")

    # Positives: rows and anchors of one label meet; a label of more than a block is cut, the others share blocks.
    large = kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("q")).where((F.col("n") > chunk) | (F.col("q") > anchor_chunk))
    large = large.select("label", F.ceil(F.col("n") / chunk).cast("int").alias("parts"), F.ceil(F.col("q") / anchor_chunk).cast("int").alias("aparts"))
    shared = max(1, -(-n // chunk))

    def placed(rows: DataFrame) -> DataFrame:
        known = rows.join(F.broadcast(large), "label", "left")  # n / chunk + q / anchor_chunk labels at most, three numbers each
        place = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("label"), F.lit(shared))).otherwise(F.xxhash64("label", F.lit("own")))
        return known.withColumns({"place": place, "parts": F.greatest(F.lit(1), F.coalesce("parts", F.lit(1))), "aparts": F.greatest(F.lit(1), F.coalesce("aparts", F.lit(1)))})

    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    rows = placed(kept).select("place", every("aparts").alias("ablock"), spread("row", "parts").alias("block"), "row", "vec_id", "label", "v", "d")
    asks = placed(asked).select("place", spread("anchor", "aparts").alias("ablock"), every("parts").alias("block"), "anchor", "own", "q", "norm2")

    def same(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            block, v = Block(x, radius2), matrix(q["q"])
            q_far = distances(np.column_stack([v, np.zeros(len(v))]), pivot)
            order = np.argsort(block.label, kind="stable")
            ends = np.searchsorted(block.label[order], q["own"].to_numpy(), side="right")
            starts = np.searchsorted(block.label[order], q["own"].to_numpy(), side="left")
            for k, (row, norm2) in enumerate(zip(q["anchor"], q["norm2"], strict=True)):
                at = order[starts[k] : ends[k]]
                at = at[block.row[at] != row]
                at = block.reach(q_far[k], norm2, block.sure(q_far[k], norm2, positives, at), np.inf, at)
                score = block.scores(v[k], at)
                best = leading(score, block.id[at], positives)
                out.append((np.full(len(best), row), block.row[at[best]], block.id[at[best]], score[best]))
        return stacked(out, ["anchor", "positive", "positive_id", "positive_score"])

    keys = ["place", "ablock", "block"]
    met = asks.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(same, "anchor long, positive long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    best = met.withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives)
    found = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("at", "positive_id", "positive_score"))).alias("found"))  # `positives` at most
    wanted = checkpointed(found.join(asked, "anchor"))
    wanted = wanted.where(F.exists("found", lambda p: p["positive_score"] >= 0))

    # Negatives: all rows, by nearest pivot, meet the anchors whose windows their cell can reach.
    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            far = matrix(pdf["d"], "<f8")
            own = [(c, far[at].min(axis=0), far[at].max(axis=0), len(at)) for c, at in pdf.groupby("cell").indices.items()]
            yield pd.DataFrame(own, columns=["cell", "least", "most", "n"])

    size = len(pivot)
    ends = [F.array(*[f(F.col(c)[k]) for k in range(size)]).alias(c) for f, c in ((F.min, "least"), (F.max, "most"))]
    cells = kept.mapInPandas(extremes, "cell int, least array<double>, most array<double>, n long").groupBy("cell").agg(*ends, F.sum("n").alias("n")).orderBy("cell").collect()  # one a pivot
    first, parts, blocks = {}, {}, 0
    for c in cells:
        first[c["cell"]], parts[c["cell"]] = blocks, -(-c["n"] // chunk)
        blocks += parts[c["cell"]]
    least, most = np.array([c["least"] for c in cells]), np.array([c["most"] for c in cells])
    ablocks = max(1, -(-wanted.count() // anchor_chunk))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                v = matrix(part["q"])
                far = distances(np.column_stack([v, np.zeros(len(v))]), pivot)
                picked, block = [], []
                for k, (own, norm2) in enumerate(zip(part["levels"], part["norm2"], strict=True)):
                    outer, inner = limits(radius2, norm2, low * min(own) / 100, high * max(own) / 100)
                    for c, close, wide in zip(cells, least, most, strict=True):
                        if not beyond(far[k], close, wide, outer, inner):
                            picked += [k] * parts[c["cell"]]
                            block += range(first[c["cell"]], first[c["cell"]] + parts[c["cell"]])
                yield part.iloc[picked].assign(block=np.array(block, np.int32))

    asks = wanted.select("anchor", "own", "q", "norm2", F.transform("found", lambda p: p["positive_score"]).alias("levels"), F.expr(f"int(pmod(xxhash64(anchor), {ablocks}))").alias("ablock"))
    asks = asks.mapInPandas(ask, "anchor long, own long, q binary, norm2 double, levels array<bigint>, ablock int, block int") if blocks else asks.withColumn("block", F.lit(0))
    of_cell = lambda known: F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col("cell")]
    rows = kept.select(
        (of_cell(first) + F.pmod(F.xxhash64("row"), of_cell(parts))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(ablocks - 1))).alias("ablock"), "row", "vec_id", "label", "v", "d"
    )

    def others(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            block, v = Block(x, radius2), matrix(q["q"])
            q_far = distances(np.column_stack([v, np.zeros(len(v))]), pivot)
            for k, (anchor, own, norm2, levels) in enumerate(zip(q["anchor"], q["own"], q["norm2"], q["levels"], strict=True)):
                windows = [(at, -(-low * int(p) // 100), high * int(p) // 100) for at, p in enumerate(levels, 1)]
                at = block.reach(q_far[k], norm2, min(w[1] for w in windows), max(w[2] for w in windows), np.flatnonzero(block.label != own))
                score = block.scores(v[k], at)
                for place, bottom, top in windows:
                    fits = np.flatnonzero((score >= bottom) & (score <= top))
                    best = fits[leading(score[fits], block.id[at[fits]], negatives)]
                    out.append((np.full(len(best), anchor), np.full(len(best), place), block.row[at[best]], block.id[at[best]], score[best]))
        return stacked(out, ["anchor", "at", "negative", "negative_id", "negative_score"])

    met = asks.groupBy("ablock", "block").cogroup(rows.groupBy("ablock", "block")).applyInPandas(others, "anchor long, at int, negative long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "at").orderBy(F.desc("negative_score"), "negative_id", "negative")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = wanted.select("anchor", "anchor_id", F.inline("found"))
    return best.join(named, ["anchor", "at"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE = """
with good as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, d.vec_id, a.label = d.label as same,
         cast(list_sum(list_transform(list_zip(a.v, d.v), lambda p: p[1] * p[2])) as bigint) as score
  from good a join good d on a.vec_id % 100 = 0 and a.vec_id <> d.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""
