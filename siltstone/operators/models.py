"""Linear algebra on small collected moments: floors, alignment, linkage, normal equations."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.curves import LOG_SUPPORT
from siltstone.operators.heads import emd, projected
from siltstone.operators.linkage import linkage_families  # noqa: F401


def moments(df: DataFrame, column: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and scatter matrix of an array column, summed by Spark."""
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    c = F.col(column)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c[i]).alias(f"s{i}") for i in range(size)], *[F.sum(c[i] * c[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    mean = np.array([row[f"s{i}"] for i in range(size)]) / row["n"]
    scatter = np.zeros((size, size))
    for i, j in pairs:
        scatter[i, j] = scatter[j, i] = row[f"p{i}_{j}"]
    return row["n"], mean, scatter - row["n"] * np.outer(mean, mean)


def rank_floors(df: DataFrame, column: str, size: int, ranks: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(rank, bare, floor): mean distance of curves to their best low-rank forms, as they are and made monotone."""
    _, mean, scatter = moments(df, column, size)
    basis = np.linalg.eigh(scatter)[1][:, ::-1].T

    def distance(frames):
        for pdf in frames:
            y = np.stack(pdf[column].to_numpy()) if len(pdf) else np.zeros((0, size))
            for k in ranks:
                near = (y - mean) @ basis[:k].T @ basis[:k] + mean
                yield pd.DataFrame({"rank": k, "bare": emd(near, y), "floor": emd(projected(near), y)})

    return df.select(column).mapInPandas(distance, "rank int, bare double, floor double").groupBy("rank").agg(F.avg("bare").alias("bare"), F.avg("floor").alias("floor"))


def power(matrix: np.ndarray, exponent: float, least: float = 1e-10) -> np.ndarray:
    values, vectors = np.linalg.eigh(matrix)
    values = np.where(values > least, np.maximum(values, least) ** exponent, 0.0)
    return vectors @ np.diag(values) @ vectors.T


def ledoit_wolf(df: DataFrame, column: str, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance, shrinkage): the covariance drawn to a multiple of 1 by the Ledoit-Wolf weight, from two aggregations."""
    n, mean, scatter = moments(df, column, size)
    if n < 2:
        raise ValueError(f"a covariance needs two rows, not {n}")
    c = scatter / n
    square = sum(((F.col(column)[i] - float(mean[i])) ** 2 for i in range(size)), F.lit(0.0))
    fourth = df.agg(F.sum(square * square)).first()[0]
    middle = np.trace(c) / size
    spread = (np.sum(c**2) - size * middle**2) / size
    noise = min((fourth / n - np.sum(c**2)) / (size * n), spread)
    weight = float(noise / spread) if spread > 0 and noise > 0 else 0.0
    return mean, (1 - weight) * c + weight * middle * np.eye(size), weight


def coral(source: DataFrame, target: DataFrame, column: str, size: int, shrink: float | None = 0.1, match_covariance: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(A, b) with x A + b of the source having the target's mean and covariance; covariances shrunk to a multiple of 1.

    shrink None: by the Ledoit-Wolf weight. match_covariance False: the mean alone, A is 1.
    """

    def covariance(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        if shrink is None:
            return ledoit_wolf(df, column, size)[:2]
        n, mean, scatter = moments(df, column, size)
        c = scatter / n
        return mean, (1 - shrink) * c + shrink * np.trace(c) / size * np.eye(size)

    (m_s, c_s), (m_t, c_t) = covariance(source), covariance(target)
    if not match_covariance:
        return np.eye(size), m_t - m_s
    a = power(c_s, -0.5) @ power(c_t, 0.5)
    return a, m_t - m_s @ a


def alignment_arms(rows: DataFrame, key: str, entity: str, side: str, source: str, target: str, column: str, size: int, shrink: float | None = 0.1, seed: int = 5) -> DataFrame:
    """(arm, mean_gap, covariance_gap, moved): how far each arm's transform leaves the source's rows from the target's.

    rows: one a tile. none: as they are; mean: means alone; tile: moments of tiles; entity: of entities' mean rows, applied
    to tiles; self: the source aligned with itself, which must move nothing; shuffled: sides dealt anew to the rows,
    which should leave the gap. Gaps are lengths of the differences of means and of covariances; moved: the largest entry
    by which a transform differs from none.
    """
    from siltstone.operators.bootstrap import permuted

    def parts(df: DataFrame, named: str) -> tuple[DataFrame, DataFrame]:
        return df.where(F.col(named) == source), df.where(F.col(named) == target)

    rows = rows.where(F.col(side).isin(source, target))
    s, t = parts(rows, side)
    mean = F.array(*[F.avg(F.col(column)[i]) for i in range(size)]).alias(column)
    s_own, t_own = (df.groupBy(entity).agg(mean) for df in (s, t))
    dealt = rows.join(permuted(rows, key, side, 1, seed).where("shuffle = 1").select(key, F.col(side).alias("__side")), key)
    s_mix, t_mix = parts(dealt, "__side")
    fits = {
        "none": (np.eye(size), np.zeros(size)), "mean": coral(s, t, column, size, shrink, False), "tile": coral(s, t, column, size, shrink),
        "entity": coral(s_own, t_own, column, size, shrink), "self": coral(s, s, column, size, shrink), "shuffled": coral(s_mix, t_mix, column, size, shrink),
    }
    (n_s, m_s, c_s), (n_t, m_t, c_t) = moments(s, column, size), moments(t, column, size)
    out = []
    for arm, (a, b) in fits.items():  # a transform moves the source's moments as it moves its rows
        gap = np.linalg.norm(m_s @ a + b - m_t), np.linalg.norm(a.T @ (c_s / n_s) @ a - c_t / n_t)
        out.append((arm, float(gap[0]), float(gap[1]), transform_distance((a, b), (np.eye(size), np.zeros(size)))))
    return rows.sparkSession.createDataFrame(out, "arm string, mean_gap double, covariance_gap double, moved double")


def transformed(df: DataFrame, column: str, a: np.ndarray, b: np.ndarray, out: str) -> DataFrame:
    size = len(b)
    c = F.col(column)
    return df.withColumn(out, F.array(*[sum((c[i] * float(a[i, j]) for i in range(size)), F.lit(float(b[j]))) for j in range(size)]))


def least_squares(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """(term, weight) of y on xs and a constant, from sums over the rows."""
    names = [*xs, y]
    point = df.select(F.array(*[F.col(c).cast("double") for c in names]).alias("v"))
    _, mean, scatter = moments(point, "v", len(names))
    w = np.linalg.solve(scatter[:-1, :-1], scatter[:-1, -1])
    rows = [("constant", float(mean[-1] - mean[:-1] @ w)), *zip(xs, map(float, w), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, weight double")


def kmeans_purity(df: DataFrame, vector: str, label: str, k: int, seed: int = 7, starts: int = 50) -> DataFrame:
    """(k, purity): share of rows that carry their cluster's commonest label, of the clustering of least cost over seeded starts.

    As many starts are fitted at a time as there are cores, so that few partitions keep all of them busy.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = df.sparkSession
    points = df.select(F.col(label).alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")).persist()
    points.count()
    with ThreadPool(min(starts, spark.sparkContext.defaultParallelism)) as pool:
        fits = pool.map(inheritable_thread_target(spark)(lambda n: KMeans(k=k, seed=seed + n).fit(points)), range(starts), chunksize=1)
    assigned = min(fits, key=lambda m: m.summary.trainingCost).transform(points)
    points.unpersist()
    cells = assigned.groupBy("prediction", "label").count().groupBy("prediction").agg(F.max("count").alias("top"), F.sum("count").alias("n"))
    return cells.agg(F.lit(k).alias("k"), (F.sum("top") / F.sum("n")).alias("purity"))


def simplex(objective, start: np.ndarray, step: float = 0.2, rounds: int = 200) -> np.ndarray:
    """Nelder-Mead minimum from a start, for a few parameters."""
    points = [np.asarray(start, float)] + [np.asarray(start, float) + step * e for e in np.eye(len(start))]
    values = [objective(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        centre = np.mean(points[:-1], axis=0)
        reflected = centre + (centre - points[-1])
        value = objective(reflected)
        if value < values[0]:
            wide = centre + 2 * (centre - points[-1])
            wide_value = objective(wide)
            points[-1], values[-1] = (wide, wide_value) if wide_value < value else (reflected, value)
        elif value < values[-2]:
            points[-1], values[-1] = reflected, value
        else:
            near = centre + 0.5 * (points[-1] - centre)
            near_value = objective(near)
            if near_value < values[-1]:
                points[-1], values[-1] = near, near_value
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [objective(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def weibull_fit(df: DataFrame, key: str, curve: str, start_scale: str, start_shape: str) -> DataFrame:
    """(key, log_scale, shape, emd): each curve's best two-parameter form, polished from a grid's best."""
    from siltstone.functions.curves import LOG_SUPPORT

    ln_d = np.array(LOG_SUPPORT) * np.log(10)

    def form(p: np.ndarray) -> np.ndarray:
        return 100 * (1 - np.exp(-np.exp(np.clip(p[1] * (ln_d - p[0]), -50, 50))))

    def polish(frames):
        for pdf in frames:
            rows = []
            for k, y, a, b in zip(pdf[key], pdf[curve], pdf[start_scale], pdf[start_shape], strict=True):
                p = simplex(lambda p, y=np.asarray(y): float(emd(form(p), y)), np.array([a, b]))
                rows.append((k, p[0], p[1], float(emd(form(p), np.asarray(y)))))
            yield pd.DataFrame(rows, columns=[key, "log_scale", "shape", "emd"])

    return df.select(key, curve, start_scale, start_shape).mapInPandas(polish, f"`{key}` {df.schema[key].dataType.simpleString()}, log_scale double, shape double, emd double")


def nelder_mead(objective, starts: np.ndarray, near_x: float, near_f: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, points) of minima, one for each start, until all its corners lie within near_x and their values within near_f.

    objective(points, which): a value for each point; which of the starts each belongs to. All starts move side by side.
    """
    n, size = starts.shape
    corners = np.repeat(starts[:, None, :], size + 1, axis=1)
    for k in range(size):
        corners[:, k + 1, k] = np.where(starts[:, k] != 0, starts[:, k] * 1.05, 0.00025)
    values = np.stack([objective(corners[:, k], np.arange(n)) for k in range(size + 1)], axis=1)

    def ordered(v: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(v, axis=1, kind="stable")  # of equal values the older first
        return np.take_along_axis(v, order, 1), np.take_along_axis(p, order[:, :, None], 1)

    values, corners = ordered(values, corners)
    which = np.arange(n)
    v, p = values, corners
    for _ in range(rounds):
        done = (np.abs(p[:, 1:] - p[:, :1]).max(axis=(1, 2)) <= near_x) & (v[:, -1] - v[:, 0] <= near_f)
        if done.any():
            values[which[done]], corners[which[done]] = v[done], p[done]
            which, v, p = which[~done], v[~done], p[~done]
        if not len(which):
            break
        centre = p[:, :-1].sum(axis=1) / size
        away = centre - p[:, -1]
        point = centre + away
        value = objective(point, which)
        first, poor = value < v[:, 0], value >= v[:, -2]
        outside = poor & (value < v[:, -1])
        again = np.flatnonzero(first | poor)
        step = np.where(first, 2.0, np.where(outside, 0.5, -0.5))[again]
        other = centre[again] + step[:, None] * away[again]
        tried = objective(other, which[again])
        better = np.where(first[again], tried < value[again], np.where(outside[again], tried <= value[again], tried < v[again, -1]))
        value[again[better]], point[again[better]] = tried[better], other[better]
        shrunk = again[~better & poor[again]]
        v, p = v.copy(), p.copy()
        last = p[shrunk, -1]
        v[:, -1], p[:, -1] = value, point
        if len(shrunk):
            p[shrunk, -1] = last
            p[shrunk, 1:] = p[shrunk, :1] + 0.5 * (p[shrunk, 1:] - p[shrunk, :1])
            for k in range(1, size + 1):
                v[shrunk, k] = objective(p[shrunk, k], which[shrunk])
        v, p = ordered(v, p)
    values[which], corners[which] = v, p
    return values[:, 0], corners[:, 0]


def weibull_oracle(df: DataFrame, key: str, curve: str) -> DataFrame:
    """(key, log_scale, shape, emd): each curve's best two-parameter form, made monotone, whatever its scale and shape.

    All 72 x 44 points of a grid from 0.005 to 300 mm and shapes from 0.1 to 8, then the three best polished, then the best of all once more.
    Curves are dealt over all cores, and those of a batch are polished side by side.
    """
    ln_d = np.array(LOG_SUPPORT) * np.log(10)

    def form(scale, shape) -> np.ndarray:
        return projected(100 * (1 - np.exp(-np.exp(np.clip(shape * (ln_d - scale), -50, 50)))))

    def polish(frames):
        scale, shape = (g.ravel()[:, None] for g in np.meshgrid(np.linspace(np.log(0.005), np.log(300.0), 72), np.linspace(0.1, 8.0, 44), indexing="ij"))
        grid, points = form(scale, shape), np.hstack([scale, shape])

        def least(y: np.ndarray) -> list[tuple[float, int]]:
            tried = emd(grid, y)
            rest, found = tried.round(12), []
            for _ in range(3):  # the first of equal ones has the smallest scale, then the smallest shape
                i = int(rest.argmin())
                found.append((tried[i], i))
                rest[i] = np.inf
            return found

        for pdf in frames:
            if not len(pdf):
                continue
            y = np.stack([np.asarray(v, float) for v in pdf[curve]])
            objective = lambda p, which, y=y: emd(form(p[:, :1], p[:, 1:]), y[which])
            seen = np.array([least(v) for v in y])
            starts = points[seen[:, :, 1].astype(int)]
            thrice = lambda p, which: objective(p, which // 3)  # noqa: B023, E731
            value, point = nelder_mead(thrice, starts.reshape(-1, 2), 1e-10, 1e-12, 4000)
            value, point = np.hstack([seen[:, :, 0], value.reshape(-1, 3)]), np.hstack([starts, point.reshape(-1, 3, 2)])
            best, rows = value.argmin(axis=1), np.arange(len(y))
            value, point = value[rows, best], point[rows, best]
            last, polished = nelder_mead(objective, point, 1e-12, 1e-14, 8000)
            better = last < value
            value, point = np.where(better, last, value), np.where(better[:, None], polished, point)
            yield pd.DataFrame({key: pdf[key], "log_scale": point[:, 0], "shape": point[:, 1], "emd": value})

    dealt = df.select(key, curve).repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)
    return dealt.mapInPandas(polish, f"`{key}` {df.schema[key].dataType.simpleString()}, log_scale double, shape double, emd double")


def transform_distance(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Largest difference between two transforms' entries."""
    return float(max(np.abs(a - b).max() for a, b in zip(one, other, strict=True)))


def ridge(df: DataFrame, xs: list[str], y: str, alpha: float) -> DataFrame:
    """(term, value): ridge weights of standardised columns (population spread, a dead column scaled by 1) and the mean of y.

    One aggregation makes all moments; the system has as many equations as columns.
    """
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    centre = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate([*xs, y])]).first()
    x = [F.col(c) - float(centre[i]) for i, c in enumerate(xs)]
    target = F.col(y) - float(centre[len(xs)])
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs], *[F.sum(x[i] * target).alias(f"t{i}") for i in range(len(xs))]).first()
    scatter = np.zeros((len(xs), len(xs)))
    for i, j in pairs:
        scatter[i, j] = scatter[j, i] = row[f"s{i}_{j}"]
    spread = np.sqrt(np.diag(scatter) / row["n"])
    spread[spread == 0] = 1.0
    weights = np.linalg.solve(scatter / np.outer(spread, spread) + alpha * np.eye(len(xs)), np.array([row[f"t{i}"] for i in range(len(xs))]) / spread)
    rows = [(c, float(w)) for c, w in zip(xs, weights, strict=True)] + [("mean", float(centre[len(xs)]))]
    return df.sparkSession.createDataFrame(rows, "term string, value double")


def polynomial_map(df: DataFrame, x: str, curve: str, size: int, degree: int) -> DataFrame:
    """(place, power, value): least-squares polynomial of x for each of a curve's `size` values. One aggregation of x's powers and their products with the curve."""
    kept = df.where(F.col(x).isNotNull() & F.col(curve).isNotNull())
    centre = kept.agg(F.avg(x)).first()[0]
    if centre is None:
        raise ValueError(f"no rows with {x} and {curve}")
    powers = [F.pow(F.col(x) - F.lit(float(centre)), F.lit(float(k))) for k in range(2 * degree + 1)]
    row = kept.agg(*[F.sum(p) for p in powers], *[F.sum(powers[k] * F.col(curve)[i]) for k in range(degree + 1) for i in range(size)]).first()
    gram = np.array([[row[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
    fit = np.linalg.lstsq(gram, np.array(row[2 * degree + 1 :]).reshape(degree + 1, size), rcond=None)[0]
    shift = [np.poly1d(f[::-1])(np.poly1d([1.0, -float(centre)])) for f in fit.T]
    rows = [(i, k, float(p.coeffs[::-1][k]) if k <= p.order else 0.0) for i, p in enumerate(shift) for k in range(degree + 1)]
    return df.sparkSession.createDataFrame(rows, "place int, power int, value double")


def mixture(size: int, k: int, seed: int) -> np.ndarray:
    """A random mixture of `size` columns into k, each of unit length; transformed() applies it."""
    w = np.random.default_rng(seed).normal(size=(size, k))
    return w / np.linalg.norm(w, axis=0)
