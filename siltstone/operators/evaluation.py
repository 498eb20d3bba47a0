"""Grouped cross-validation of curve predictors: folds as rows, one grouped pass per protocol.

A design is a DataFrame (sample_id, family, x array<double>, y array<double>); heads.py fits its folds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import bootstrap, heads
from siltstone.operators.heads import ALPHAS, RANK, UNSEEN, emd, projected
from siltstone.operators.resample import hash_rank

def fitted(x: np.ndarray, y: np.ndarray, alphas: Sequence[float], rank: int = RANK):
    """Ridge on the leading curve components, features standardised on x: a function from rows to (alphas, rows, values).

    One eigendecomposition of the features serves all penalties.
    """
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    z, mean = (x - centre) / spread, y.mean(axis=0)
    basis = np.linalg.svd(y - mean, full_matrices=False)[2][:rank]
    values, vectors = np.linalg.eigh(z.T @ z)
    part = vectors.T @ (z.T @ ((y - mean) @ basis.T))
    weights = [vectors @ (part / (values + a)[:, None]) @ basis for a in alphas]
    return lambda new: np.stack([projected((new - centre) / spread @ w + mean) for w in weights])


def predict(x: np.ndarray, y: np.ndarray, new: np.ndarray, alphas: Sequence[float], rank: int = RANK) -> np.ndarray:
    """(alphas, rows, values) of new rows, fitted on x and y."""
    return fitted(x, y, alphas, rank)(new)


def family_out(x: np.ndarray, y: np.ndarray, family: np.ndarray, alphas: Sequence[float]) -> np.ndarray:
    """(alphas, rows): each row's error under a fit without its family."""
    out = np.zeros((len(alphas), len(x)))
    for f in np.unique(family):
        out[:, family == f] = emd(predict(x[family != f], y[family != f], x[family == f], alphas), y[family == f])
    return out


def strict_protocol(design: DataFrame, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """(protocol, sample_id, family, alpha, emd): the penalty of a fold is chosen inside its own fit rows."""
    return named(heads.family_out(design, alphas), "strict")


def fixed_protocol(design: DataFrame, alpha: float = 3.0) -> DataFrame:
    """The same with one penalty for all folds."""
    return named(heads.family_out(design, (alpha,)), "fixed")


def historical_protocol(design: DataFrame, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """The penalty of a family is chosen by the other families' errors in one table of family-out errors."""
    return named(heads.family_out(design, alphas, nested=False), "historical")


def named(errors: DataFrame, protocol: str) -> DataFrame:
    return errors.select(F.lit(protocol).alias("protocol"), "sample_id", "family", "alpha", "emd")


def cluster_bootstrap(errors: DataFrame, cluster: str, value: str, draws: int = 20_000, seed: int = 20260930) -> DataFrame:
    """(mean, lo, hi, p_le_0) of a value's mean when whole clusters are drawn with replacement; bootstrap.py draws them."""
    one = errors.select(F.col(cluster).alias("cluster"), F.col(value).alias("value"), F.lit("value").alias("effect"))
    return bootstrap.effect_intervals(one, "cluster", "effect", "value", draws, seed).select("mean", "lo", "hi", "p_le_0")


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): each distinct value's average rank, counted within buckets between quantiles and added to the buckets before."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).count()
    bounds = sorted(set(df.approxQuantile(value, [k / 256 for k in range(1, 256)], 0.001)))
    bucketed = counts.withColumn("__b", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col(value))) if bounds else F.lit(0))
    sizes = bucketed.groupBy("__b").agg(F.sum("count").alias("__n"))
    before = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # 256 rows at most
    up_to = F.sum("count").over(Window.partitionBy("__b").orderBy(value)) + F.col("__before")
    return bucketed.join(F.broadcast(before), "__b").select(value, (up_to - (F.col("count") - 1) / 2).alias(out))


def permutation_null(df: DataFrame, key: str, x: str, y: str, shuffles: int = 200, seed: int = 7) -> DataFrame:
    """(shuffle, rho): Spearman correlation of x with shuffled y; shuffle 0 is the real order.

    key: a column without repeated values. Shuffle k orders the rows by a hash of k and the key and gives them the values of
    y in a fixed order; rows are ranked within buckets of the hash, so no task holds all rows of a shuffle.
    """
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = full.join(average_rank(full, "x", "a"), "x").join(average_rank(full, "y", "b"), "y").select("key", "a", "b")
    gives = hash_rank(rows, "key", seed, "place").join(rows.select("key", "b"), "key").select("place", "b")
    dealt = rows.select("key", "a", F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("shuffle")).withColumn("__h", F.xxhash64(F.lit(seed), "shuffle", "key")).withColumn("__b", F.shiftrightunsigned("__h", 54))
    sizes = dealt.groupBy("shuffle", "__b").count()
    before = sizes.select("shuffle", "__b", F.coalesce(F.sum("count").over(Window.partitionBy("shuffle").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("shuffle", "__b").orderBy("__h", "key")) + F.col("__before")
    takes = dealt.join(F.broadcast(before), ["shuffle", "__b"]).select("shuffle", "a", place.alias("place"))  # shuffles x 1024 rows
    shuffled = takes.join(gives, "place").groupBy("shuffle").agg(F.corr("a", "b").alias("rho"))
    real = rows.agg(F.corr("a", "b").alias("rho")).select(F.lit(0).alias("shuffle"), "rho")
    return real.unionAll(shuffled).select(F.col("shuffle").cast("bigint").alias("shuffle"), "rho")


def weighted_predict(x: np.ndarray, y: np.ndarray, weight: np.ndarray, new: np.ndarray, alpha: float, rank: int = RANK) -> np.ndarray:
    """Ridge with row weights: weighted centre and spread, weighted curve components."""
    w = weight / weight.sum()
    centre = w @ x
    spread = np.sqrt(w @ (x - centre) ** 2)
    spread[spread == 0] = 1.0
    z, mean = (x - centre) / spread, w @ y
    root = np.sqrt(weight)[:, None]
    basis = np.linalg.svd((y - mean) * root, full_matrices=False)[2][:rank]
    part = np.linalg.solve((z * weight[:, None]).T @ z + alpha * np.eye(x.shape[1]), (z * weight[:, None]).T @ ((y - mean) @ basis.T))
    return projected((new - centre) / spread @ part @ basis + mean)


def family_places(design: DataFrame, seed: int) -> DataFrame:
    """(family, place, x, y): each row's place, from 0, within its family in the order of a hash; ranked within buckets of it."""
    hashed = design.select("sample_id", "family", "x", "y", F.xxhash64(F.lit(seed), "sample_id").alias("__h")).withColumn("__b", F.shiftrightunsigned("__h", 54))
    sizes = hashed.groupBy("family", "__b").count()
    before = sizes.select("family", "__b", F.coalesce(F.sum("count").over(Window.partitionBy("family").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("family", "__b").orderBy("__h", "sample_id")) + F.col("__before") - 1
    return hashed.join(F.broadcast(before), ["family", "__b"]).select("family", place.cast("bigint").alias("place"), "x", "y")  # 1024 rows a family


def learning_curve(design: DataFrame, sizes: Sequence[int], draws: int = 120, alpha: float = 3.0, seed: int = 20260940) -> DataFrame:
    """(n, mean_emd, se): family-out error when only n rows without the family are fitted on, over seeded draws.

    A family's error is the mean over its draws and rows; the mean and its error are over families. A family
    whose others are fewer than n has no error at n. Draws are made in tasks, one row each, and met with the rows
    they name; each is fitted by itself, and its map judges the family's rows, a large family in blocks.
    """
    spark = design.sparkSession
    rows = heads.settled(design)
    counts = rows.where(F.col("family").isNotNull()).groupBy("family").count().orderBy("family").collect()  # one row a family
    names, n = [r["family"] for r in counts], np.array([r["count"] for r in counts], np.int64)
    kinds = "n int, mean_emd double, se double"
    if len(names) < 2:
        return spark.createDataFrame([], kinds)
    places, width = {f: k for k, f in enumerate(names)}, len(sizes) * draws

    def draw(frames):
        for pdf in frames:
            out = []
            for number in pdf["id"]:
                f, rest = divmod(int(number), width)
                size, at = sizes[rest // draws], rest % draws
                others = np.delete(np.arange(len(names)), f)
                ends = np.cumsum(n[others])
                if size <= ends[-1]:
                    took = np.random.default_rng([seed, size, at, f]).choice(int(ends[-1]), size, replace=False)
                    k = np.searchsorted(ends, took, side="right")
                    out.append(pd.DataFrame({"f": f, "n": size, "draw": at, "family": [names[o] for o in others[k]], "place": took - (ends - n[others])[k]}))
            if out:
                yield pd.concat(out)

    picked = spark.range(len(names) * width).mapInPandas(draw, "f int, n int, draw int, family string, place bigint")
    met = picked.join(family_places(rows, seed), ["family", "place"]).select("f", "n", "draw", "x", "y")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        made = affine_fit(np.stack(pdf["x"].to_numpy()), np.stack(pdf["y"].to_numpy()), alpha)
        return pd.DataFrame({"place": [int(pdf["f"].iloc[0])], "n": [int(pdf["n"].iloc[0])], "map": [made.tobytes()]})

    maps = met.groupBy("f", "n", "draw").applyInPandas(fit, "place int, n int, map binary")  # n rows a fit
    features = len(rows.select("x").first()["x"])

    def judge(pdf, x, y, own):
        total = own.assign(s=[float(emd(projected(heads.applied(m, x)[0]), y).sum()) for m in own["map"]]).groupby("n", as_index=False)["s"].sum()
        return total.assign(f=int(pdf["place"].iloc[0]), c=len(x) * draws)[["f", "n", "s", "c"]]

    numbered = rows.join(F.broadcast(spark.createDataFrame(list(places.items()), "family string, place int")), "family").select("place", "sample_id", "x", "y")
    each = heads.judged_by(numbered, maps, features, judge, "f int, n int, s double, c bigint").groupBy("n", "f").agg((F.sum("s") / F.sum("c")).alias("m"))
    return each.groupBy("n").agg(F.avg("m").alias("mean_emd"), (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def affine_fit(x: np.ndarray, y: np.ndarray, alpha: float, rank: int = RANK) -> np.ndarray:
    """fitted() of one penalty as an affine map (1, features + 1, values)."""
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    z, mean = (x - centre) / spread, y.mean(axis=0)
    basis = np.linalg.svd(y - mean, full_matrices=False)[2][:rank]
    slope = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ ((y - mean) @ basis.T)) @ basis / spread[:, None]
    return np.vstack([slope, mean - centre @ slope])[None]


def one_se_alpha(curve: DataFrame) -> DataFrame:
    """(alpha): the largest penalty whose mean error is within one standard error of the least (columns alpha, mean, se)."""
    best = curve.agg(F.min(F.struct("mean", "se")).alias("b")).select((F.col("b.mean") + F.col("b.se")).alias("most"))
    return curve.join(best).where("mean <= most").agg(F.max("alpha").alias("alpha"))  # one row meets a small grid


def transfer_folds(rows: DataFrame, entity: str, family: str, camera: str, source: str, target: str) -> DataFrame:
    """(entity, fold) of the rows to score in the direction source -> target: the entity's family if the source camera saw the entity, else UNSEEN.

    A fold's model is fitted on the source rows of all other families; that of UNSEEN on all source rows.
    """
    seen = rows.groupBy(entity, family).agg(F.bool_or(F.col(camera) == source).alias("s"), F.bool_or(F.col(camera) == target).alias("t"))
    return seen.where("t").select(entity, F.when(F.col("s"), F.col(family).cast("string")).otherwise(UNSEEN).alias("fold"))


def transfer_errors(rows: DataFrame, entity: str, family: str, camera: str, value: str, source: str, target: str) -> DataFrame:
    """(entity, fold, error): a fold's fitted mean against the target camera's value. The means come from families' sums, one row a family."""
    folds = transfer_folds(rows, entity, family, camera, source, target)
    fit = rows.where(F.col(camera) == source).groupBy(F.col(family).cast("string").alias("fold")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = fit.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))  # one row
    held = rows.where(F.col(camera) == target).groupBy(entity).agg(F.avg(value).alias("v"))
    met = held.join(folds, entity).join(fit, "fold", "left").join(F.broadcast(total))
    mean = (F.col("all_s") - F.coalesce("s", F.lit(0.0))) / (F.col("all_n") - F.coalesce("n", F.lit(0)))
    return met.select(entity, "fold", F.abs(F.col("v") - mean).alias("error"))


def factorial_effects(cells: DataFrame, entity: str, first: str, second: str, value: str, levels: tuple[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """(entity, effect, value) of a two by two design, for entities with all four cells: simple, main and interaction effects.

    Effects of one entity come from the same four cells, so a resample of entities is common to all of them.
    """
    (a0, a1), (b0, b1) = levels
    cell = lambda a, b: F.avg(F.when((F.col(first) == a) & (F.col(second) == b), F.col(value)))
    four = cells.groupBy(entity).agg(cell(a0, b0).alias("c00"), cell(a0, b1).alias("c01"), cell(a1, b0).alias("c10"), cell(a1, b1).alias("c11")).na.drop()
    c = F.col
    effects = {
        "first_at_low": c("c10") - c("c00"), "first_at_high": c("c11") - c("c01"), "second_at_low": c("c01") - c("c00"), "second_at_high": c("c11") - c("c10"),
        "first": (c("c10") + c("c11") - c("c00") - c("c01")) / 2, "second": (c("c01") + c("c11") - c("c00") - c("c10")) / 2, "interaction": c("c11") - c("c01") - c("c10") + c("c00"),
    }
    return four.select(entity, F.inline(F.array(*[F.struct(F.lit(n).alias("effect"), e.alias("value")) for n, e in effects.items()])))


def naive_bootstrap(errors: DataFrame, key: str, value: str, draws: int = 4_000, seed: int = 20260930) -> DataFrame:
    """The bootstrap over rows instead of clusters: too narrow where rows of a cluster go together."""
    return cluster_bootstrap(errors, key, value, draws, seed)


def best_of_null(gains: DataFrame, draw: str, arm: str, gain: str, real: float) -> DataFrame:
    """(real, p95, share_at_least, draws): the largest gain over arms of each draw without effect, against the real one."""
    best = gains.groupBy(draw).agg(F.max(gain).alias("best"))
    return best.agg(F.lit(real).alias("real"), F.percentile("best", F.lit(0.95)).alias("p95"), F.avg((F.col("best") >= real).cast("double")).alias("share_at_least"), F.count(F.lit(1)).alias("draws"))


def rulers(cells: DataFrame, family: str, camera: str, view: str, value: str) -> DataFrame:
    """(ruler, n, error): each cell of an entity and condition against the mean of every condition's other families.

    LOGO: the cell's own condition; CAM: another camera; RES: another view; CAM+RES: both. Models come from
    the sums of a family and condition; each cell meets the conditions' totals, one row a camera and view.
    """
    by = lambda *keys: [F.col(k).alias(f"__{k}") for k in keys]
    own = cells.groupBy(*by(family, camera, view)).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    total = own.groupBy(f"__{camera}", f"__{view}").agg(F.sum("__s").alias("__all_s"), F.sum("__n").alias("__all_n"))
    met = cells.join(total).join(own.withColumnRenamed(f"__{family}", family), [family, f"__{camera}", f"__{view}"], "left")
    mean = (F.col("__all_s") - F.coalesce("__s", F.lit(0.0))) / F.nullif(F.col("__all_n") - F.coalesce("__n", F.lit(0)), F.lit(0))
    same_camera, same_view = F.col(camera) == F.col(f"__{camera}"), F.col(view) == F.col(f"__{view}")
    ruler = F.when(same_camera & same_view, "LOGO").when(same_view, "CAM").when(same_camera, "RES").otherwise("CAM+RES")
    error = F.abs(F.col(value) - mean)
    return met.groupBy(ruler.alias("ruler")).agg(F.count(error).alias("n"), F.avg(error).alias("error"))


def inverse_root_curve(curve: DataFrame, n: str, error: str, at: float) -> DataFrame:
    """(level, per_n, per_root, r2, at): least squares of error = level + per_n / n + per_root / sqrt(n), and its value at another n. One aggregation."""
    u, w, e = 1 / F.col(n), 1 / F.sqrt(F.col(n).cast("double")), F.col(error)
    m = curve.agg(
        F.avg(u).alias("u"), F.avg(w).alias("w"), F.avg(e).alias("e"), F.var_pop(u).alias("uu"), F.var_pop(w).alias("ww"), F.var_pop(e).alias("ee"),
        F.covar_pop(u, w).alias("uw"), F.covar_pop(u, e).alias("ue"), F.covar_pop(w, e).alias("we"),
    )
    det = F.nullif(F.col("uu") * F.col("ww") - F.col("uw") * F.col("uw"), F.lit(0.0))
    b, c = (F.col("ue") * F.col("ww") - F.col("we") * F.col("uw")) / det, (F.col("we") * F.col("uu") - F.col("ue") * F.col("uw")) / det
    fit = m.withColumn("per_n", b).withColumn("per_root", c).withColumn("level", F.expr("e - per_n * u - per_root * w"))
    r2 = F.expr("(per_n * ue + per_root * we) / nullif(ee, 0)")
    return fit.select("level", "per_n", "per_root", r2.alias("r2"), (F.col("level") + F.col("per_n") / at + F.col("per_root") / at**0.5).alias("at"))
