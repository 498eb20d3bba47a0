"""Average linkage of any number of curves: nearest pairs of clusters merged in rounds, each a join of stripes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.curves import LOG_SUPPORT
from siltstone.sources.io import checkpointed, written

#: The distance of two curves is the sum of their absolute differences times these: the trapezoid rule.
WEIGHTS = np.convolve(np.diff(LOG_SUPPORT), [0.5, 0.5])
SIZE = len(WEIGHTS)
STRIPE = "g int, asks boolean, c binary, size binary, inner binary, w binary, z binary"
NEAR = "c long, b long, d double"
PART = "c binary, b binary, d binary"
BINS = 32  # steps of a value's distribution that bracket the distance of large clusters
FAR = 65_000  # above all distances in steps
RUN = 32  # curves compared at a time with those of a stripe
ROWS = 256  # large clusters compared at a time with those of a stripe


class Clusters(NamedTuple):
    z: np.ndarray  # curves times WEIGHTS
    w: np.ndarray  # their weights, 1 in each cluster
    at: np.ndarray  # where clusters start
    inner: np.ndarray | None = None  # half the mean distance of a cluster's curves, each with itself too


def sizes(one: Clusters) -> np.ndarray:
    return np.diff(np.append(one.at, len(one.z)))


def halves(one: Clusters) -> np.ndarray:
    """Clusters' inner."""
    z, w, at, _ = one
    if len(at) == len(z):
        return np.zeros(len(z))
    size, last = sizes(one), np.append(at, len(z))[1:] - 1
    of, inner = np.repeat(np.arange(len(at)), size), np.zeros(len(at))
    for k in range(SIZE):
        order = np.lexsort((z[:, k], of))
        below = np.cumsum(w[order])
        below -= np.repeat(np.append(0.0, below[last[:-1]]), size)
        gap = np.append(np.diff(z[order, k]), 0.0)
        gap[last] = 0.0
        inner += np.add.reduceat(below * (1 - below) * gap, at)
    return inner


def runs(size: np.ndarray, alone: int) -> Iterator[tuple[int, int]]:
    """Neighbouring clusters of about RUN curves in all; one of `alone` curves or more by itself."""
    begin = held = 0
    for i, m in enumerate(size.tolist()):
        if i > begin and (held + m > RUN or m >= alone):
            yield begin, i
            begin, held = i, 0
        held = RUN if m >= alone else held + m
    if begin < len(size):
        yield begin, len(size)


def average_distances(one: Clusters, other: Clusters) -> np.ndarray:
    """Mean distance of each cluster of one to each of the other. A large cluster is sorted, and sums below a value are looked up."""
    (z, w, at, _), (z2, w2, at2, _) = one, other
    end = np.append(at, len(z))
    across = np.ascontiguousarray(z2.T)
    out = np.empty((len(at), len(at2)))
    for i, j in runs(sizes(one), 16):
        part, v = z[end[i] : end[j]], w[end[i] : end[j]]
        if len(part) >= 16 and j == i + 1:
            t = np.zeros((1, len(z2)))
            for k in range(SIZE):
                order = np.argsort(part[:, k])
                a, p = part[order, k], v[order]
                below, total = np.append(0.0, np.cumsum(p)), np.append(0.0, np.cumsum(p * a))
                n = np.searchsorted(a, across[k])
                t[0] += across[k] * (2 * below[n] - below[-1]) + (total[-1] - 2 * total[n])
        else:
            t = np.zeros((len(part), len(z2)))
            for x in range(0, len(z2), 1000):
                for k in range(SIZE):
                    gap = part[:, k, None] - across[k, x : x + 1000]
                    t[:, x : x + 1000] += np.abs(gap, out=gap)
            t = np.add.reduceat(t * v[:, None], at[i:j] - at[i], axis=0) if j - i < len(part) else t
        out[i:j] = np.add.reduceat(t * w2, at2, axis=1) if len(at2) < len(z2) else t
    return out.round(9)


def stepped(one: Clusters, other: Clusters) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(from, to, low, width): in some unit, distances of single curves from..to lie in low..low + width. Curves are rounded to 16 bits.

    Each value is off by half a step at most, so that a half distance, the sum of larger values less half of both sums, is
    off by half a step for each value that varies, and by one more for what is rounded here.
    """
    z, z2 = one.z, other.z
    low = np.minimum(z.min(axis=0), z2.min(axis=0))
    reach = np.maximum(z.max(axis=0), z2.max(axis=0)) - low
    live = np.flatnonzero(reach)
    step = reach.sum() / 40_000 or 1.0  # all sums stay below FAR
    q, q2 = (np.rint((v[:, live] - low[live]) / step).astype("u2") for v in (z, z2))
    half = q2.sum(axis=1, dtype="i8") // 2
    rest, across = (half.max() - half).astype("u2"), np.ascontiguousarray(q2.T)
    gap = np.empty((RUN, 1000), "u2")
    for i in range(0, len(z), RUN):
        part = q[i : i + RUN]
        t = np.empty((len(part), len(z2)), "u2")
        for x in range(0, len(z2), 1000):
            s, g = t[:, x : x + 1000], gap[: len(part), : len(z2[x : x + 1000])]
            s[:] = rest[x : x + 1000]
            for k in range(len(live)):
                s += np.maximum(part[:, k, None], across[k, x : x + 1000], out=g)
        yield i, i + len(part), t, len(live) + 4


def spread(one: Clusters, live: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, rest) of clusters: mean heights of each value's distribution between edges, and the length of what they leave out."""
    z, w, at, inner = one
    width, bins = np.diff(edges, axis=1), edges.shape[1] - 1
    of = np.repeat(np.arange(len(at)), sizes(one)) * (bins + 1)
    steps, square = np.empty((len(at), len(live), bins)), -inner
    for k, v in enumerate(z[:, live].T):
        b = np.clip(np.searchsorted(edges[k], v, side="right") - 1, 0, bins - 1)
        above = w * (edges[k, b + 1] - v) / width[k, b]  # of the bin that holds the value
        many = len(at) * (bins + 1)
        rise = np.bincount(of + b, above, many) + np.bincount(of + b + 1, w - above, many)
        steps[:, k] = np.cumsum(rise.reshape(len(at), -1), axis=1)[:, :bins]
        square += np.add.reduceat(w * (edges[k, -1] - v), at) - (steps[:, k] ** 2) @ width[k]
    steps *= np.sqrt(width)
    return steps.reshape(len(at), -1), np.sqrt(np.maximum(square, 0.0))


def bracketed(one: Clusters, other: Clusters) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As stepped, for clusters of many curves.

    The mean distance of two clusters is the sum of their inner halves and of the squared differences of their values'
    distributions. Steps give these from below; by what both steps leave out they are at most so much larger.
    """
    low = np.minimum(one.z.min(axis=0), other.z.min(axis=0))
    high = np.maximum(one.z.max(axis=0), other.z.max(axis=0))
    live = np.append(np.flatnonzero(high[:-1] > low[:-1]), SIZE - 1)
    both = np.concatenate([v[:: max(len(v) // 1000, 1), live] for v in (one.z, other.z)])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1), axis=0).T
    edges[:, 0], edges[:, -1] = low[live], high[live]
    edges += np.arange(BINS + 1) * 1e-9 * max(1.0, np.abs(edges).max())  # no bin is empty
    (a, rest), (a2, rest2) = spread(one, live, edges), spread(other, live, edges)
    middle = a2.mean(axis=0)
    a, a2 = (a - middle).astype("f4"), np.ascontiguousarray((a2 - middle).T.astype("f4"))
    norm, norm2 = np.einsum("ij,ij->i", a, a, dtype="f8"), np.einsum("ij,ij->j", a2, a2, dtype="f8")
    slack = 1e-5 * (1 + norm.max() + one.inner.max() + norm2.max() + other.inner.max())
    base, base2, rest, rest2 = ((v.astype("f4")) for v in (norm + one.inner, norm2 + other.inner, rest, rest2))
    a *= np.float32(-2)
    for i in range(0, len(a), ROWS):
        t = a[i : i + ROWS] @ a2
        t += base[i : i + ROWS, None]
        t += base2
        width = rest[i : i + ROWS, None] + rest2
        width *= width
        width += np.float32(slack)
        yield i, i + len(t), t, width


def pair_distances(i: np.ndarray, j: np.ndarray, one: Clusters, other: Clusters) -> np.ndarray:
    """Mean distances of cluster i[k] of one and j[k] of the other."""
    (z, w, at, _), (z2, w2, at2, _) = one, other
    m, n = sizes(one)[i], sizes(other)[j]
    out, many = np.empty(len(i)), m * n
    large = many > 100_000
    for k in np.flatnonzero(large):
        rows, cols = slice(at[i[k]], at[i[k]] + m[k]), slice(at2[j[k]], at2[j[k]] + n[k])
        out[k] = average_distances(Clusters(z[rows], w[rows], np.zeros(1, int)), Clusters(z2[cols], w2[cols], np.zeros(1, int)))[0, 0]
    rest = np.flatnonzero(~large)
    cut = np.searchsorted(np.cumsum(many[rest]), np.arange(0, many[rest].sum(), 100_000))
    for part in np.split(rest, cut[1:]):
        if len(part):
            start = np.cumsum(many[part]) - many[part]
            at_pair = np.repeat(np.arange(len(part)), many[part])
            r = np.arange(len(at_pair)) - start[at_pair]
            a, b = at[i[part]][at_pair] + r // n[part][at_pair], at2[j[part]][at_pair] + r % n[part][at_pair]
            d = sum(np.abs(z[a, k] - z2[b, k]) for k in range(SIZE))
            out[part] = np.add.reduceat(d * w[a] * w2[b], start)
    return out.round(9)


def nearest(c: np.ndarray, one: Clusters, c2: np.ndarray, other: Clusters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, nearest other one, distance), ties to the smallest; what a bracket leaves open is measured."""
    single = len(one.z) * len(other.z) == len(c) * len(c2)
    found = []
    place = np.searchsorted(c2, c)
    own = np.where(c2[np.minimum(place, len(c2) - 1)] == c, place, -1)
    for i, j, low, width in (stepped if single else bracketed)(one, other):
        has = np.flatnonzero(own[i:j] >= 0)
        low[has, own[i:j][has]] = FAR if low.dtype == "u2" else np.inf
        top = (low + width).min(axis=1) if np.ndim(width) else low.min(axis=1) + np.uint16(width)
        open_ = low <= top[:, None]
        open_[has, own[i:j][has]] = False
        x, y = np.nonzero(open_)
        found.append((x + i, y))
    x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    d = pair_distances(x, y, one, other)
    order = np.lexsort((y, d, x))
    x, y, d = x[order], y[order], d[order]
    first = np.append(True, x[1:] != x[:-1])[: len(x)]
    return c[x[first]], c2[y[first]], d[first]


def side_by_side(rows: DataFrame, stripes: int, made: Callable, schema: str) -> DataFrame:
    """made(i, j, clusters that ask of stripe i, all of stripe j) for all pairs of stripes; rows: (id, n, z, c, ask)."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        s, pdf = int(pdf.s.iloc[0]), pdf.sort_values(["c", "id"])
        c, at, size = np.unique(pdf.c.to_numpy("i8"), return_index=True, return_counts=True)
        n, z = pdf.n.to_numpy(float), np.frombuffer(b"".join(pdf.z)).reshape(-1, SIZE)
        w, ask = n / np.repeat(np.add.reduceat(n, at), size), pdf.ask.to_numpy(bool)
        inner, asks = halves(Clusters(z, w, at)), ask[at]
        all_ = [v.tobytes() for v in (c, size, inner, w, z)]
        some = [v.tobytes() for v in (c[asks], size[asks], inner[asks], w[ask], z[ask])]
        held = [(i * stripes + s, False, *all_) for i in range(stripes)] + [(s * stripes + j, True, *some) for j in range(stripes) if ask.any()]
        return pd.DataFrame(held, columns=[f.split()[0] for f in STRIPE.split(", ")])

    def opened(row) -> tuple[np.ndarray, Clusters]:
        size = np.frombuffer(row.size_, "i8")
        return np.frombuffer(row.c, "i8"), Clusters(np.frombuffer(row.z).reshape(-1, SIZE), np.frombuffer(row.w), np.cumsum(size) - size, np.frombuffer(row.inner))

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = {r.asks: opened(r) for r in pdf.rename(columns={"size": "size_"}).itertuples()}
        got = made(*divmod(int(pdf.g.iloc[0]), stripes), *sides[True], *sides[False]) if len(sides) == 2 else None
        return pd.DataFrame(dict(zip([f.split()[0] for f in schema.split(", ")], got or ([], [], []), strict=True)))

    dealt = rows.withColumn("s", F.pmod(F.xxhash64("c"), F.lit(stripes)).cast("int")).repartition(stripes, "s").groupBy("s").applyInPandas(packed, STRIPE)
    return dealt.repartition(stripes * stripes, "g").groupBy("g").applyInPandas(compared, schema)


def neighbours(rows: DataFrame, stripes: int) -> DataFrame:
    """(c, b, d): the nearest cluster of each that asks."""
    found = side_by_side(rows, stripes, lambda i, j, c, one, c2, other: nearest(c, one, c2, other), NEAR)
    return found.groupBy("c").agg(F.min(F.struct("d", "b")).alias("near")).select("c", "near.b", "near.d")


def matrix(rows: DataFrame, stripes: int) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, their distances), for few clusters."""

    def measured(i, j, c, one, c2, other):
        return ([c.tobytes()], [c2.tobytes()], [average_distances(one, other).tobytes()]) if i <= j else None

    found = [(np.frombuffer(r.c, "i8"), np.frombuffer(r.b, "i8"), np.frombuffer(r.d)) for r in side_by_side(rows, stripes, measured, PART).collect()]
    c = np.unique(np.concatenate([f[0] for f in found]))
    d = np.zeros((len(c), len(c)))
    for one, other, part in found:
        i, j, part = np.searchsorted(c, one), np.searchsorted(c, other), part.reshape(len(one), len(other))
        d[np.ix_(i, j)], d[np.ix_(j, i)] = part, part.T
    return c, d


def merged(d: np.ndarray, weight: np.ndarray, cut: float) -> np.ndarray:
    """Place of each cluster's family: the nearest two are merged until none are within the cut."""
    d, weight, root = d.copy(), weight.copy(), np.arange(len(d))
    np.fill_diagonal(d, np.inf)
    near = d.argmin(axis=1)
    least = d[np.arange(len(d)), near]
    while len(d) > 1:
        a = int(least.argmin())
        if not least[a] <= cut:
            break
        a, b = sorted((a, int(near[a])))
        d[a] = d[:, a] = (weight[a] * d[a] + weight[b] * d[b]) / (weight[a] + weight[b])
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        weight[a] += weight[b]
        root[root == b] = a
        lost = np.union1d(np.flatnonzero((near == a) | (near == b)), [a, b])
        near[lost] = d[lost].argmin(axis=1)
        least[lost] = d[lost, near[lost]]
        closer = (d[:, a] < least) | ((d[:, a] == least) & (a < near))
        near[closer], least[closer] = a, d[closer, a]
    return root


def linkage_families(df: DataFrame, key: str, curve: str, cut: float = 14.0, most: int = 2000) -> DataFrame:
    """(key, family): average linkage on curve distances, cut at `cut`; families are numbered by their smallest keys.

    Equal curves are one, with their number as weight. While there are more than `most` clusters, all pairs that are each
    other's nearest are merged in one round, which gives what merging the nearest pair one at a time does; `most` at most
    are then merged from one matrix. A cluster with none within the cut never gets one, and is left out from then on.
    Equal distances (to nine decimals) go to smaller keys. A curve that is null or holds null or NaN has no family.
    Work is up to the square of the number of different curves.
    """
    spark = df.sparkSession
    rows = checkpointed(df.select(key, F.transform(curve, lambda v: v.cast("double")).alias("y")))
    whole = rows.where(F.col("y").isNotNull() & ~F.exists("y", lambda v: v.isNull() | F.isnan(v)))
    different = whole.groupBy("y").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n")).orderBy("k")

    def first(t) -> tuple:
        row, i = t
        return i, float(row.n), (np.array(row.y) * WEIGHTS).tobytes(), row.y

    made = checkpointed(spark.createDataFrame(different.rdd.zipWithIndex().map(first), "id long, n double, z binary, y array<double>"))
    of, known = made.select("id", F.col("id").alias("c")), None
    n = count = made.count()
    few, least = min(count // 1000 + 1, 6), count // 20_000  # stripes at the end; stripes that keep each to about 20,000 curves

    def clusters() -> DataFrame:
        held = made.select("id", "n", "z").join(of, "id")
        if known is None:
            return held.withColumn("ask", F.lit(True))
        return held.join(known.select("c", "d"), "c", "left").where(F.col("d").isNull() | (F.col("d") <= cut)).select("id", "n", "z", "c", F.col("d").isNull().alias("ask"))

    while n > most:
        found = neighbours(clusters(), max(min(max(n // 4000, few), 24), least))
        known = written(found if known is None else known.union(found))
        back = known.select(F.col("c").alias("b"), F.col("b").alias("c"))
        pairs = written(known.where(F.col("d") <= cut).join(back, ["c", "b"]).where("c < b").select("c", "b"))
        gone = pairs.count()
        if not gone:
            break
        ends = pairs.select(F.explode(F.array("c", "b")).alias("x"))
        of = written(of.join(pairs.select(F.col("b").alias("c"), F.col("c").alias("into")), "c", "left").select("id", F.coalesce("into", "c").alias("c")))
        count -= gone
        n = count - known.where(F.col("d") > cut).count()
        known = known.join(ends, F.col("c") == F.col("x"), "left_anti").join(ends, (F.col("b") == F.col("x")) & (F.col("d") <= cut), "left_anti")
    root = of.select("id", F.col("c").alias("root"))
    if 1 < n <= most:
        live = clusters().withColumn("ask", F.lit(True))
        c, d = matrix(live, max(few, least))
        total = {r.c: r.n for r in live.groupBy("c").agg(F.sum("n").alias("n")).collect()}
        roots = spark.createDataFrame(list(zip(c.tolist(), c[merged(d, np.array([total[k] for k in c.tolist()]), cut)].tolist(), strict=True)), "c long, root long")
        root = of.join(F.broadcast(roots), "c", "left").select("id", F.coalesce("root", "c").alias("root"))
    numbers = spark.createDataFrame(root.select("root").distinct().orderBy("root").rdd.zipWithIndex().map(lambda t: (t[0].root, t[1] + 1)), "root long, family int")
    return rows.join(made.join(root, "id").join(numbers, "root").select("y", "family"), "y", "left").select(key, "family")
