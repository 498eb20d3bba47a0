"""More heads on the same moments: partial least squares, Bayesian ridge, kernel ridge by landmarks, trees.

The linear ones are solved from a fold's moments alone and give an affine map as the ridge does, so all of them
judge a row in one pass. Kernel ridge replaces a row's features by its kernel values to a bounded sample of
landmark rows, and is a ridge of those. Trees are fitted by Spark's own learners, one for each leading
component of the curves, on folds of whole families.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.heads import RANK, Moments, applied, emd, projected, settled

Solver = Callable[[float, np.ndarray, np.ndarray, int], np.ndarray]  # (rows, mean, scatter, features): (features + 1, values)

#: Landmark rows of a kernel ridge.
LANDMARKS = 64
# The priors and stopping rule of the evidence iteration.
PRIOR, MOST_ROUNDS, TOLERANCE = 1e-6, 300, 1e-3


def inputs(n: float, scatter: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spread of the features (dead ones: 1), their correlations and cross-products once standardised."""
    own = np.diag(scatter)[:k]
    spread = np.sqrt(np.where(own > 1e-12 * max(own.max(initial=0.0), 1e-300), own, 0.0) / n)
    dead = spread == 0
    spread = np.where(dead, 1.0, spread)
    inner, cross = scatter[:k, :k] / np.outer(spread, spread), scatter[:k, k:] / spread[:, None]
    inner[dead], inner[:, dead], cross[dead] = 0.0, 0.0, 0.0
    return spread, inner, cross


def as_map(slope: np.ndarray, mean: np.ndarray, k: int) -> np.ndarray:
    """(features + 1, values) of a slope on features as they are."""
    return np.vstack([slope, mean[k:] - mean[:k] @ slope])


def pls(components: int) -> Solver:
    """Partial least squares of features and values at unit spread, the cross-moments deflated component by component."""

    def solve(n, mean, scatter, k):
        spread, inner, cross = inputs(n, scatter, k)
        size = np.sqrt(np.diag(scatter)[k:] / n)
        size = np.where(size > 1e-9 * max(size.max(initial=0.0), 1e-300), size, 1.0)
        left, turns, loads, answers = cross / size, [], [], []
        for _ in range(min(components, k)):
            if not np.abs(left).max() > 1e-9 * n:
                break
            w = np.linalg.svd(left, full_matrices=False)[0][:, 0]
            r = w - sum((p @ w) * t for p, t in zip(loads, turns, strict=True))
            length = r @ inner @ r
            p, q = inner @ r / length, left.T @ r / length
            left = left - length * np.outer(p, q)
            turns.append(r)
            loads.append(p)
            answers.append(q)
        slope = sum((np.outer(r, q) for r, q in zip(turns, answers, strict=True)), np.zeros_like(left)) * size / spread[:, None]
        return as_map(slope, mean, k)

    return solve


def bayesian_ridge(rank: int = RANK) -> Solver:
    """Ridge of each leading component whose noise and weight precisions are raised in evidence, from moments alone."""

    def solve(n, mean, scatter, k):
        spread, inner, cross = inputs(n, scatter, k)
        basis = np.linalg.eigh(scatter[k:, k:])[1][:, ::-1].T[:rank]
        values, vectors = np.linalg.eigh(inner)
        values = np.maximum(values, 0.0)
        weights = []
        for b in basis:
            target, square = vectors.T @ (cross @ b), b @ scatter[k:, k:] @ b
            noise, prior, last = 1.0 / (square / n + np.finfo(float).eps), 1.0, None
            for _ in range(MOST_ROUNDS):
                w = target / (values + prior / noise)
                error = max(square - 2 * w @ target + w @ (values * w), 0.0)
                known = np.sum(noise * values / (prior + noise * values))
                prior, noise = (known + 2 * PRIOR) / (w @ w + 2 * PRIOR), (n - known + 2 * PRIOR) / (error + 2 * PRIOR)
                turned = vectors @ w
                if last is not None and np.abs(last - turned).sum() < TOLERANCE:
                    break
                last = turned
            weights.append(vectors @ (target / (values + prior / noise)))
        return as_map(np.array(weights).T @ basis / spread[:, None], mean, k)

    return solve


def ridge_head(alpha: float) -> str:
    return f"ridge {alpha:g}"


def landmark_features(design: DataFrame, gamma: float | None = None, landmarks: int = LANDMARKS, seed: int = 3) -> DataFrame:
    """The design with x replaced by exp(-gamma d^2) to about `landmarks` rows drawn by a hash of the id, features at unit spread.

    gamma None: one over the number of features.
    """
    spark = design.sparkSession
    first = design.select(F.size("x").alias("k")).first()
    if first is None:
        return design
    k = first["k"]
    one = design.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    draw = F.pmod(F.xxhash64(F.lit(seed), "sample_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * landmarks / one["n"]))
    drawn = design.where(draw).select("x").distinct().orderBy("x").limit(landmarks).collect() or design.select("x").limit(1).collect()
    mean, spread = (np.array([one[f"{name}{i}"] for i in range(k)]) for name in "ms")
    spread[spread == 0] = 1.0
    shared = spark.sparkContext.broadcast((np.array([r[0] for r in drawn]), mean, spread, 1.0 / k if gamma is None else gamma))  # `landmarks` rows

    def run(frames):
        marks, m, s, g = shared.value
        marks = (marks - m) / s
        for pdf in frames:
            if len(pdf):
                z = (np.stack(pdf["x"].to_numpy()) - m) / s
                yield pdf.assign(x=list(np.exp(-g * ((z[:, None, :] - marks) ** 2).sum(axis=2))))

    return design.mapInPandas(run, design.schema)


def linear_errors(design: DataFrame, solvers: dict[str, Solver], ridges: Sequence[float] = (), rank: int = RANK) -> DataFrame:
    """(sample_id, family, head, emd) of every row under each head fitted without its family."""
    rows = settled(design)
    moments = Moments(rows, rank)
    shared = rows.sparkSession.sparkContext.broadcast(moments)  # one matrix of features and values a cell
    names = [*map(ridge_head, ridges), *solvers]

    def maps(place: int) -> np.ndarray:
        m = shared.value
        keep = m.chosen({place})
        found = [m.affine(keep, ridges)] if ridges else []
        n, size = m.weight[keep].sum(), m.features
        mean = m.sums[keep].sum(axis=0) / n
        scatter = m.products[keep].sum(axis=0) - n * np.outer(mean, mean)
        return np.concatenate([*found, *[f(n, mean + m.centre, scatter, size)[None] for f in solvers.values()]])

    def run(frames):
        fits = {}
        for pdf in frames:
            for family, own in pdf.groupby("family", sort=False):
                place = shared.value.places[family]
                if place not in fits:
                    fits[place] = maps(place)
                error = emd(projected(applied(fits[place], np.stack(own["x"].to_numpy()))), np.stack(own["y"].to_numpy()))
                for name, e in zip(names, error, strict=True):
                    yield pd.DataFrame({"sample_id": own["sample_id"], "family": family, "head": name, "emd": e})

    return rows.select("sample_id", "family", "x", "y").mapInPandas(run, "sample_id string, family string, head string, emd double")


def tree_errors(design: DataFrame, kind: str = "forest", folds: int = 5, rank: int = RANK, seed: int = 11, **settings) -> DataFrame:
    """(sample_id, family, head, emd) under trees of Spark's own learners, fitted on the families of other folds.

    kind: `forest` or `boosted`. Folds hold whole families by a hash; a fold makes one fit for each leading component.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    learner = {"forest": RandomForestRegressor, "boosted": GBTRegressor}[kind]
    rows = settled(design).withColumn("fold", F.pmod(F.xxhash64("family"), F.lit(folds)).cast("int"))
    out = None
    for fold in [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]:  # `folds` at most
        fit, held = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        moments = Moments(fit, rank)
        if not moments.names:
            continue
        k, n = moments.features, moments.weight.sum()
        mean = moments.sums.sum(axis=0) / n
        basis = np.linalg.eigh((moments.products.sum(axis=0) - n * np.outer(mean, mean))[k:, k:])[1][:, ::-1].T[:rank]
        centre = (mean + moments.centre)[k:]
        score = lambda b: F.aggregate(F.transform("y", lambda v, i: (v - F.element_at(F.array(*map(F.lit, map(float, centre))), i + 1)) * F.element_at(F.array(*map(F.lit, map(float, b))), i + 1)), F.lit(0.0), lambda a, v: a + v)  # noqa: B023, E731
        near = held.withColumn("features", array_to_vector("x"))
        vectors = fit.withColumn("features", array_to_vector("x"))
        for i, b in enumerate(basis):
            model = learner(featuresCol="features", labelCol="target", predictionCol=f"t{i}", seed=seed, **settings).fit(vectors.withColumn("target", score(b)))
            near = model.transform(near)
        level = [F.lit(float(c)) + sum((F.col(f"t{i}") * float(b[j]) for i, b in enumerate(basis)), F.lit(0.0)) for j, c in enumerate(centre)]
        near = near.select("sample_id", "family", F.array(*level).alias("near"), "y")
        out = near if out is None else out.unionAll(near)
    kinds = "sample_id string, family string, head string, emd double"
    if out is None:
        return design.sparkSession.createDataFrame([], kinds)

    def judge(frames):
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame({"sample_id": pdf["sample_id"], "family": pdf["family"], "head": kind, "emd": emd(projected(np.stack(pdf["near"].to_numpy())), np.stack(pdf["y"].to_numpy()))})

    return out.mapInPandas(judge, kinds)
