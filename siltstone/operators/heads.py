"""Frozen heads from moments: ridge on a curve's leading components, fitted on any families and conditions.

A design is a DataFrame (sample_id, family, x array<double>, y array<double>), with a `condition` (camera, view,
or both) and a `weight` where they are asked for. Spark adds up the weighted moments of each cell (family and
condition); the fit on any set of cells is that of the sum of their moments, so no task and no driver holds
a design. A fit is an affine map; maps are solved in tasks, one row each, and meet the rows they judge by
the rows' family, a large family in blocks. Rows without a family are in no fit and are judged by that of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.curves import LOG_SUPPORT
from siltstone.sources.io import checkpointed

#: The grid of ridge penalties.
ALPHAS = (0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10000.0, 30000.0, 100000.0, 300000.0, 1000000.0)
RANK = 3
#: Rows of a family that are judged together.
BLOCK = 50_000
#: A fold without a family: that of entities the fit rows don't have.
UNSEEN = "__unseen__"


def projected(y: np.ndarray) -> np.ndarray:
    y = np.maximum.accumulate(np.clip(y, 0, 100), axis=-1)
    y[..., -1] = 100.0
    return y


def emd(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.trapezoid(np.abs(p - t), np.array(LOG_SUPPORT), axis=-1)


def settled(design: DataFrame) -> DataFrame:
    """The design's columns that a protocol reads, made once: every protocol passes over them several times."""
    kept = [c for c in ("sample_id", "family", "condition", "weight", "x", "y") if c in design.columns]
    text = [F.col(c).cast("string").alias(c) if c in ("sample_id", "family", "condition") else F.col(c) for c in kept]
    return checkpointed(design.select(*text))


class Moments:
    """Weights, sums and products of (x, y) about a common centre by cell; an affine map from any cells' sums.

    weighted: rows count by their column `weight`, else once each.
    """

    def __init__(self, design: DataFrame, rank: int = RANK, weighted: bool = False):
        self.rank, self.names, self.cells, self.features = rank, [], [], 0
        first = design.select(F.size("x").alias("x"), F.size("y").alias("y")).first()
        if first is None:
            return
        self.features, size = first["x"], first["x"] + first["y"]
        v = F.concat("x", "y")
        centre = np.array(design.agg(F.array(*[F.avg(v[i]) for i in range(size)])).first()[0])
        rows = design.select(
            "family", (F.col("condition") if "condition" in design.columns else F.lit("")).alias("condition"), (F.col("weight").cast("double") if weighted else F.lit(1.0)).alias("weight"), "x", "y"
        )

        def add(frames):
            found = {}
            for pdf in frames:
                for cell, own in pdf.groupby(["family", "condition"], sort=False):
                    d, w = np.hstack([np.stack(own["x"].to_numpy()), np.stack(own["y"].to_numpy())]) - centre, own["weight"].to_numpy()
                    n, total, s, m = found.get(cell, (0, 0.0, 0.0, 0.0))
                    found[cell] = n + len(d), total + w.sum(), s + w @ d, m + (d * w[:, None]).T @ d
            yield pd.DataFrame([(*cell, n, [total, *s, *m.ravel()]) for cell, (n, total, s, m) in found.items()], columns=["family", "condition", "n", "sums"])

        parts = rows.mapInPandas(add, "family string, condition string, n bigint, sums array<double>")
        sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(1 + size + size * size)]).alias("sums")
        each = parts.groupBy("family", "condition").agg(F.sum("n").alias("n"), sums).orderBy("family", "condition").collect()  # one row a cell
        self.centre, self.cells = centre, [(r["family"], r["condition"]) for r in each]
        self.names = list(dict.fromkeys(f for f, _ in self.cells))
        self.places = {f: k for k, f in enumerate(self.names)}
        self.family = np.array([self.places[f] for f, _ in self.cells])
        self.condition = np.array([c for _, c in self.cells])
        self.rows = np.array([r["n"] for r in each])
        found = np.array([r["sums"] for r in each])
        self.weight, self.sums, self.products = found[:, 0], found[:, 1 : size + 1], found[:, size + 1 :].reshape(-1, size, size)

    def chosen(self, without: Iterable[int] = (), condition: str | None = None) -> np.ndarray:
        """Which cells to fit on: all of a condition (None: of all) but some families'."""
        kept = ~np.isin(self.family, list(without))
        return kept if condition is None else kept & (self.condition == condition)

    def affine(self, keep: np.ndarray, alphas: Sequence[float]) -> np.ndarray | None:
        """(alphas, features + 1, values): a map from (x, 1) to curves, not yet projected; None without rows."""
        k, n = self.features, self.weight[keep].sum()
        if not n > 0:
            return None
        mean = self.sums[keep].sum(axis=0) / n
        products = self.products[keep].sum(axis=0)
        scatter = products - n * np.outer(mean, mean)
        own = np.diag(scatter)[:k]
        spread = np.sqrt(np.where(own > 1e-12 * np.maximum(np.diag(products)[:k], 1e-300), own, 0.0) / n)
        flat = spread == 0
        spread[flat] = 1.0
        basis = np.linalg.eigh(scatter[k:, k:])[1][:, ::-1].T[: self.rank]
        inner, cross = scatter[:k, :k] / np.outer(spread, spread), scatter[:k, k:] / spread[:, None]
        inner[flat], inner[:, flat], cross[flat] = 0.0, 0.0, 0.0
        values, vectors = np.linalg.eigh(inner)
        part = vectors.T @ (cross @ basis.T)
        slope = np.stack([vectors @ (part / (values + a)[:, None]) @ basis for a in alphas]) / spread[:, None]
        level = mean[k:] + self.centre[k:] - (mean[:k] + self.centre[:k]) @ slope
        return np.concatenate([slope, level[:, None, :]], axis=1)


def applied(maps: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(maps, rows, values): curves of rows, as the maps give them."""
    return x @ maps[:, :-1] + maps[:, -1:, :]


def solved(moments: Moments, design: DataFrame, wanted: DataFrame, keep: Callable[[Moments, dict], np.ndarray], alphas: Callable[[dict], Sequence[float]]) -> DataFrame:
    """wanted, one row a fit, with its map as bytes; rows without a fit fall out. keep, alphas: of a row's values."""
    shared = design.sparkSession.sparkContext.broadcast(moments)  # one matrix of features and values a cell
    columns = wanted.columns

    def run(frames):
        for pdf in frames:
            found = [shared.value.affine(keep(shared.value, row), alphas(row)) for row in pdf.to_dict("records")]
            yield pdf.assign(map=[None if m is None else m.tobytes() for m in found])[[*columns, "map"]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)
    return wanted.mapInPandas(run, f"{kinds}, map binary").where("map is not null")


def judged_by(rows: DataFrame, maps: DataFrame, features: int, work, kinds: str) -> DataFrame:
    """work(rows, their x, their y, maps) of the rows of a place and the maps for it, a block of rows at a time.

    rows: (place, sample_id, x, y, ...), maps: (place, map, ...); map comes as an array (alphas, features + 1, values).
    """
    each = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    sizes = F.broadcast(checkpointed(rows.groupBy("place").agg(each)))  # one row a family
    left = rows.join(sizes, "place").withColumn("block", F.pmod(F.xxhash64("sample_id"), F.col("blocks")).cast("int"))
    right = maps.join(sizes, "place").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def one(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(own):
            return pd.DataFrame()
        values = len(pdf["y"].iloc[0])
        own = own.assign(map=[np.frombuffer(m).reshape(-1, features + 1, values) for m in own["map"]])
        return work(pdf, np.stack(pdf["x"].to_numpy()), np.stack(pdf["y"].to_numpy()), own)

    return left.groupBy("place", "block").cogroup(right.groupBy("place", "block")).applyInPandas(one, kinds)


def placed(design: DataFrame, moments: Moments) -> DataFrame:
    """The design with `place`, its family's number; rows without a family fall out."""
    numbers = design.sparkSession.createDataFrame(list(moments.places.items()) if moments.names else [], "family string, place int")  # one row a family
    return design.join(F.broadcast(numbers), "family")


def selection(design: DataFrame, moments: Moments, alphas: Sequence[float], condition: str | None = None, nested: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(folds, alphas) sums of errors and (folds) rows that a fold's penalty is chosen by; the last fold is UNSEEN.

    A row of family g is judged for fold f without f and g, and for UNSEEN without g. Each unordered pair of
    families is solved once. nested False: for all folds without g alone, in one table of errors.
    """
    spark, size = design.sparkSession, len(moments.names)
    singles = spark.range(size).select(F.col("id").cast("int").alias("f"), F.col("id").cast("int").alias("g"))
    wanted = singles
    if nested:
        pair = spark.range(size * size).select(F.expr("int(id div %d)" % max(1, size)).alias("f"), F.expr("int(id %% %d)" % max(1, size)).alias("g"))
        wanted = singles.unionAll(pair.where("f < g"))
    maps = solved(moments, design, wanted, lambda m, r: m.chosen({r["f"], r["g"]}, condition), lambda r: alphas)
    either = F.array(F.struct(F.col("f").alias("fold"), F.col("g").alias("place")), F.struct(F.col("g").alias("fold"), F.col("f").alias("place")))
    alone = F.array(F.struct(F.lit(size).alias("fold"), F.col("g").alias("place")))
    maps = maps.select("map", F.inline(F.when(F.col("f") == F.col("g"), alone).otherwise(either)))
    rows = placed(design if condition is None else design.where(F.col("condition") == condition), moments).select("place", "sample_id", "x", "y")

    def work(pdf, x, y, own):
        out = [(fold, len(x), list(emd(projected(applied(m, x)), y).sum(axis=1))) for fold, m in zip(own["fold"], own["map"], strict=True)]
        return pd.DataFrame([(pdf["place"].iloc[0], *r) for r in out], columns=["place", "fold", "n", "sums"])

    parts = judged_by(rows, maps, moments.features, work, "place int, fold int, n bigint, sums array<double>")
    found = parts.groupBy("place", "fold").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(len(alphas))]).alias("sums"))
    if not nested:  # every fold is chosen by the other families' rows
        n, sums = np.zeros(size + 1), np.zeros((size + 1, len(alphas)))
        for r in found.collect():  # one row a family
            n[r["place"]], sums[r["place"]] = r["n"], r["sums"]
        return sums.sum(axis=0) - sums, n.sum() - n
    n, sums = np.zeros(size + 1), np.zeros((size + 1, len(alphas)))
    for r in found.groupBy("fold").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(len(alphas))]).alias("sums")).collect():  # one row a family
        n[r["fold"]], sums[r["fold"]] = r["n"], r["sums"]
    return sums, n


def chosen_alphas(sums: np.ndarray, n: np.ndarray, alphas: Sequence[float]) -> list[float]:
    """The penalty of the least mean error; without rows the first."""
    return [float(alphas[int(np.argmin(s / m))]) if m else float(alphas[0]) for s, m in zip(sums, n, strict=True)]


def status(alpha: float, alphas: Sequence[float]) -> str:
    """Where in the grid a penalty lies."""
    return "FLOOR" if alpha == min(alphas) else "CEILING" if alpha == max(alphas) else "INTERIOR"


def by_family(design: DataFrame, moments: Moments, chosen: Sequence[float]) -> DataFrame:
    """(sample_id, family, alpha, emd): rows under the fit without their family, with its penalty.

    A family that isn't among the moments' is judged by the fit on all, with the last penalty. One fit a family
    and task, one pass without an exchange.
    """
    shared = design.sparkSession.sparkContext.broadcast(moments)  # one matrix of features and values a cell

    def run(frames):
        m, fits = shared.value, {}
        for pdf in frames:
            for name, own in pdf.groupby("family", sort=False, dropna=False):
                place = m.places.get(name, -1) if m.names else -1
                if place not in fits:
                    fits[place] = m.affine(m.chosen({place}), (chosen[place],)) if m.names else None
                if fits[place] is not None:
                    near = projected(applied(fits[place], np.stack(own["x"].to_numpy()))[0])
                    yield pd.DataFrame({"sample_id": own["sample_id"], "family": own["family"], "alpha": float(chosen[place]), "emd": emd(near, np.stack(own["y"].to_numpy()))})

    return design.select("sample_id", "family", "x", "y").mapInPandas(run, "sample_id string, family string, alpha double, emd double")


def family_out(design: DataFrame, alphas: Sequence[float] = ALPHAS, nested: bool = True, rank: int = RANK, weighted: bool = False) -> DataFrame:
    """(sample_id, family, alpha, emd) of every row under the fit without its family; one fit a fold, its penalty chosen in its own fit rows."""
    rows = settled(design)
    moments = Moments(rows, rank, weighted)
    chosen = [float(alphas[0])] * (len(moments.names) + 1)
    if moments.names and len(alphas) > 1:
        if nested and len(moments.names) < 3:
            raise ValueError("a penalty can't be chosen on fewer than two families")
        chosen = chosen_alphas(*selection(rows, moments, alphas, nested=nested), alphas)
    return by_family(rows, moments, chosen)


def transfer(design: DataFrame, source: str, target: str, alphas: Sequence[float] = ALPHAS, rank: int = RANK) -> DataFrame:
    """(sample_id, fold, alpha, status, emd): target rows under heads fitted on the source condition alone.

    An entity that the source condition saw is judged by the fit without its family, any other by the fit on all
    source rows (fold UNSEEN). A fold's penalty is chosen on source rows without the fold's family, each
    judged without its own family too. Families of a target row without source rows are in no fit anyway.
    """
    rows = settled(design.where(F.col("condition").isin(source, target)))
    fit = rows.where(F.col("condition") == source)
    moments = Moments(fit, rank)
    seen = fit.select("sample_id").distinct().withColumn("seen", F.lit(True))
    held = rows.where(F.col("condition") == target).join(seen, "sample_id", "left")
    held = held.withColumn("family", F.when(F.col("seen"), F.col("family")).otherwise(UNSEEN))
    chosen = [float(alphas[0])] * (len(moments.names) + 1)
    if len(alphas) > 1 and moments.names:
        chosen = chosen_alphas(*selection(fit, moments, alphas), alphas)
    out = by_family(held, moments, chosen)
    where = F.when(F.col("alpha") == float(min(alphas)), "FLOOR").when(F.col("alpha") == float(max(alphas)), "CEILING").otherwise("INTERIOR")
    return out.select("sample_id", F.col("family").alias("fold"), "alpha", where.alias("status"), "emd")


def ruler_errors(design: DataFrame, alphas: Sequence[float] = ALPHAS, rank: int = RANK) -> DataFrame:
    """(ruler, alpha, n, error): every row under the heads of every condition's other families.

    A condition is `camera|view`. LOGO: the row's own condition; CAM: another camera; RES: another view; CAM+RES: both.
    """
    rows = settled(design)
    moments = Moments(rows, rank)
    spark, names = rows.sparkSession, sorted(set(moments.condition)) if moments.cells else []
    wanted = spark.range(len(moments.names)).select(F.col("id").cast("int").alias("place"), F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("source"))
    maps = solved(moments, rows, wanted, lambda m, r: m.chosen({r["place"]}, r["source"]), lambda r: alphas)

    def work(pdf, x, y, own):
        out = []
        parts = pdf["condition"].str.split("|", regex=False)
        for source, m in zip(own["source"], own["map"], strict=True):
            camera, view = source.split("|")
            ruler = np.array([("LOGO" if p[1] == view else "RES") if p[0] == camera else ("CAM" if p[1] == view else "CAM+RES") for p in parts])
            error = emd(projected(applied(m, x)), y)
            out += [(name, float(a), int((ruler == name).sum()), float(e[ruler == name].sum())) for name in np.unique(ruler) for a, e in zip(alphas, error, strict=True)]
        return pd.DataFrame(out, columns=["ruler", "alpha", "n", "error"])

    parts = judged_by(placed(rows, moments).select("place", "sample_id", "condition", "x", "y"), maps, moments.features, work, "ruler string, alpha double, n bigint, error double")
    return parts.groupBy("ruler", "alpha").agg(F.sum("n").alias("n"), (F.sum("error") / F.sum("n")).alias("error"))


def aggregation_arms(design: DataFrame, alpha: float, rank: int = RANK) -> DataFrame:
    """(sample_id, arm, emd) of entities with several rows each, by family-out heads of one penalty.

    pooled: one row an entity, its mean features, projected once. raw: a head of all rows, each weighing one over its
    entity's rows; the rows' curves are averaged, then projected. each: of the same head, each row's curve is
    projected, then they are averaged.
    """
    rows = design.withColumn("sample_id", F.col("sample_id").cast("string"))
    size = rows.select(F.size("x").alias("x"), F.size("y").alias("y")).first()
    mean = lambda c, n: F.array(*[F.avg(F.col(c)[i]) for i in range(n)]).alias(c)
    entity = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.first("family").alias("family"), *([mean("x", size["x"]), mean("y", size["y"])] if size else [F.first("x").alias("x"), F.first("y").alias("y")]))
    pooled = family_out(entity, (alpha,), rank=rank).select("sample_id", F.lit("pooled").alias("arm"), "emd")
    weighed = settled(rows.join(entity.select("sample_id", "n"), "sample_id").withColumn("weight", 1 / F.col("n")))
    moments = Moments(weighed, rank, weighted=True)
    wanted = weighed.sparkSession.range(len(moments.names)).select(F.col("id").cast("int").alias("place"))
    maps = solved(moments, weighed, wanted, lambda m, r: m.chosen({r["place"]}), lambda r: (alpha,))

    def work(pdf, x, y, own):
        raw = applied(own["map"].iloc[0], x)[0]
        out = pd.DataFrame({"sample_id": pdf["sample_id"], "raw": list(raw), "each": list(projected(raw.copy())), "y": list(y)})
        found = []
        for sample, part in out.groupby("sample_id", sort=False):  # an entity's rows lie in one block
            target = np.stack(part["y"].to_numpy()).mean(axis=0)
            found += [(sample, "raw", float(emd(projected(np.stack(part["raw"].to_numpy()).mean(axis=0)), target))), (sample, "each", float(emd(np.stack(part["each"].to_numpy()).mean(axis=0), target)))]
        return pd.DataFrame(found, columns=["sample_id", "arm", "emd"])

    return pooled.unionAll(judged_by(placed(weighed, moments).select("place", "sample_id", "x", "y"), maps, moments.features, work, "sample_id string, arm string, emd double"))
