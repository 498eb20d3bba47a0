"""Exact top-k by inner product as a Voronoi kNN join.

Vectors are dealt to the nearest of a few pivots. Of each data cell a summary stays: rows, and the
k + 1 smallest distances to its pivot. With p, g the pivots of a query and a data cell, r the query
cell's radius and d a vector's distance to its own pivot, Cauchy-Schwarz gives for every query of
the cell
    p.g - |p| d - |g| r - r d  <=  score  <=  p.g + |p| d + |g| r + r d.
The lower bounds of the summaries give a score that k + 1 vectors are sure to reach for each query
cell. Neighbouring query cells form groups of a few thousand queries, and a vector is replicated, once
a group, only to groups with a cell where its upper bound reaches that score. Cells and groups are cut
into chunks by a hash of the row, so no task holds more than about `chunk` vectors or queries at a time,
even if a third of all rows is one vector; the chunks' best k meet in one small window a query.

Pivots are drawn by a hash from the whole table, as many as the cube root of its rows (24 to 512); only
speed depends on them. Where the bounds exclude nothing, n rows and q queries make n q / `QUERY_CHUNK`
copies of vectors and n q / `CHUNK` of queries, which is small beside their n q products.

Defined cases: vectors that are null, empty, of another length than the commonest (of equally common
lengths: the smallest), or that hold null or non-finite components take no part; repeated vectors are
separate candidates, ties go to the smaller id; of rows that share an id each is a candidate and a
query of its own, and only a query's own row is left out; rows without id take no part; fewer than k
candidates give all; very long vectors are compared whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, forget, read

K = 20
FEWEST_PIVOTS, MOST_PIVOTS = 24, 512
#: Vectors of a cell, and queries of a group, that a task works on together.
CHUNK = 50_000
QUERY_CHUNK = 25_000


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(id, v array<bigint>): floor(scale * x) of the vectors that take part."""
    x = F.col(vector_col)
    good = F.expr(f"forall(`{vector_col}`, x -> x is not null and not isnan(x) and abs(double(x)) < double('infinity'))")
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products a @ b.T; floats are used while every sum stays below 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(queries: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of these vectors for each query, its own row left out. queries, rows: numbers of rows."""
    found, block = [], max(1, 4_000_000 // max(1, len(ids)))
    for at in range(0, len(queries), block):
        own = queries[at : at + block]
        score = dots(q[at : at + block], v)
        lowest = np.iinfo(np.int64).min
        score[own[:, None] == rows[None, :]] = lowest
        if len(ids) > k:
            floor = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            row, col = np.nonzero((score >= floor[:, None]) & (score > lowest))
        else:
            row, col = np.nonzero(score > lowest)
        order = np.lexsort((ids[col], -score[row, col], row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = rank < k
        row, col = row[keep], col[keep]
        found.append(pd.DataFrame({"query": own[row], "vec_id": ids[col], "score": score[row, col]}))
    return pd.concat(found)


def grouped(asked: dict[int, int], between: np.ndarray, size: int | None = None) -> dict[int, int]:
    """Cell to group of {query cell: queries}: neighbouring cells share a group of about `size` queries.

    A vector is replicated once a group, so the cells are walked from each to the nearest one left.
    """
    size = size or QUERY_CHUNK
    left, group, number, held, at = sorted(asked), {}, 0, 0, None
    while left:
        squares = {c: between[c, c] - 2 * (between[c, at] if at is not None else 0.0) for c in left}
        at = min(left, key=squares.__getitem__)
        left.remove(at)
        if held and held + asked[at] > size:
            number, held = number + 1, 0
        group[at] = number
        held += asked[at]
    return group


def top_k(vectors: DataFrame, queries: object, k: int = K, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row where `queries` holds.

    queries: a Column over vec_id that picks the query rows.
    """
    spark = vectors.sparkSession
    kinds = "query_id bigint, rank int, vec_id bigint, score bigint"
    whole = checkpointed(quantized(vectors, id_col, vector_col, scale))
    points = whole
    width = points.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return spark.createDataFrame([], kinds)
    points = points.where(F.size("v") == width["width"])
    pivots = pivots or int(min(MOST_PIVOTS, max(FEWEST_PIVOTS, width["count"] ** (1 / 3))))
    draw = F.pmod(F.xxhash64("vec_id", "v", F.lit("pivot")), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, 8 * pivots / width["count"])))
    drawn = points.where(draw).select("v").distinct().collect()  # 8 a pivot in expectation
    chosen = np.array([r[0] for r in drawn or [points.select("v").first()]], np.float64)
    chosen = chosen[np.lexsort(chosen.T)]
    centre = [0]  # spread out: each next pivot is the sample's vector farthest from those taken
    gap = ((chosen - chosen[0]) ** 2).sum(axis=1)
    while len(centre) < pivots and gap.max() > 0:
        centre.append(int(gap.argmax()))
        gap = np.minimum(gap, ((chosen - chosen[centre[-1]]) ** 2).sum(axis=1))
    pivot = chosen[centre]
    squares = (pivot**2).sum(axis=1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                far = np.maximum(0, (v**2).sum(axis=1)[:, None] - 2 * v @ pivot.T + squares)
                cell = far.argmin(axis=1)
                near = np.sqrt(((v - pivot[cell]) ** 2).sum(axis=1)) * (1 + 1e-9)
                yield pdf.assign(cell=cell.astype(np.int32), d=near)

    dealt = points.mapInPandas(deal, "vec_id bigint, v array<bigint>, cell int, d double").withColumn("is_query", F.coalesce(queries, F.lit(False)))
    dealt = checkpointed(dealt.withColumn("row", F.monotonically_increasing_id()))
    forget(whole)
    # Summaries: k + 1 nearest distances of each cell (a partial step per task, then one small window).
    salted = dealt.select("cell", "d", (F.col("row") % 64).alias("salt"))
    for keys in (("cell", "salt"), ("cell",)):
        nearest = Window.partitionBy(*keys).orderBy("d")
        salted = salted.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).drop("n")
    near = [(r.cell, r.d) for r in salted.select("cell", "d").collect()]
    cells = {r.cell: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("is_query").alias("nq"), F.max(F.when(F.col("is_query"), F.col("d"))).alias("r"), F.max("d").alias("far")).collect()}
    if not any(r.nq for r in cells.values()):
        return spark.createDataFrame([], kinds)
    norm, between = np.sqrt(squares), pivot @ pivot.T
    group, least = grouped({c: row.nq for c, row in cells.items() if row.nq}, between), {}
    for c, own in group.items():
        r = cells[c].r
        sure = sorted((between[c, g] - norm[c] * d - norm[g] * r - r * d for g, d in near), reverse=True)
        need = sure[k] if len(sure) > k else -np.inf
        for g in cells:  # a vector of cell g nearer to its pivot than `low` can't reach `need`
            low = (need - between[c, g] - norm[g] * r) / max(norm[c] + r, 1e-12)
            low = float(low) - 1e-6 * max(1.0, abs(float(low))) if np.isfinite(low) else -1.0
            least[own, g] = min(low, least.get((own, g), np.inf))
    parts = {c: max(1, -(-row.n // CHUNK)) for c, row in cells.items()}
    asked = {own: sum(cells[c].nq for c in group if group[c] == own) for own in set(group.values())}
    qparts = {own: max(1, -(-n // QUERY_CHUNK)) for own, n in asked.items()}
    sides = [(int(g), int(own), low, parts[g], qparts[own]) for (own, g), low in least.items() if cells[g].far >= low]
    sides = spark.createDataFrame(sides, "cell int, qgroup int, least double, parts int, qparts int")  # pivots^2 rows at most
    salt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = dealt.join(F.broadcast(sides), "cell").where("d >= least").withColumn("chunk", salt("parts"))
    data = data.select("qgroup", every("qparts").alias("qchunk"), "cell", "chunk", "row", "vec_id", "v")
    own = F.create_map(*[F.lit(int(x)) for pair in group.items() for x in pair])[F.col("cell")]
    asks = dealt.where("is_query").select(own.alias("qgroup"), "row", F.col("v").alias("q")).join(F.broadcast(sides), "qgroup").withColumn("qchunk", salt("qparts"))
    asks = asks.select("qgroup", "qchunk", "cell", every("parts").alias("chunk"), F.col("row").alias("query"), "q")

    keys = ["qgroup", "qchunk", "cell", "chunk"]

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype("int64")
        return best(q["query"].to_numpy(), np.stack(q["q"].to_numpy()), d["row"].to_numpy(), d["vec_id"].to_numpy(), np.stack(d["v"].to_numpy()), k)

    met = asks.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, "query bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = dealt.where("is_query").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return top.join(named, "query").select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op8_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
with good as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, d.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) as bigint) as score
  from good q join good d on q.vec_id % 20 = 0 and q.vec_id <> d.vec_id
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
