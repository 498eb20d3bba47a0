"""Choices among columns, and group scales with a fallback."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def varying(df: DataFrame, columns: Sequence[str], least: float = 1e-12) -> list[str]:
    """The columns whose standard deviation exceeds `least`, found in one pass."""
    row = df.agg(*[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if (row[f"s{i}"] or 0.0) > least]


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as z-scores (population deviation; a constant column becomes 0)."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def robust_by_group(df: DataFrame, group: str, value: str, out: str, least_rows: int = 4) -> DataFrame:
    """(value - median) / IQR of the row's group; groups under `least_rows` rows take the whole table's scale."""
    q = lambda p: F.percentile(F.col(value), F.lit(p))
    own = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), q(0.5).alias("__m"), (q(0.75) - q(0.25)).alias("__w"))
    whole = df.agg(q(0.5).alias("__m0"), (q(0.75) - q(0.25)).alias("__w0"))
    met = df.join(own, group).join(F.broadcast(whole))  # one row
    few = F.col("__n") < least_rows
    z = (F.col(value) - F.when(few, F.col("__m0")).otherwise(F.col("__m"))) / F.nullif(F.when(few, F.col("__w0")).otherwise(F.col("__w")), F.lit(0.0))
    return met.withColumn(out, z).select(*df.columns, out)


def unit(vector: str, least: float = 1e-12):
    """A vector over its length (at least `least`)."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(length, F.lit(least)))


def exact_quantiles(df: DataFrame, columns: Sequence[str], n: Sequence[int], near: Sequence[Sequence[float] | None], probabilities: Sequence[float]) -> list[list[float | None]]:
    """Each column's exact quantiles, linear between values; null and NaN have no place.

    n: each column's number of values; near: two values for each probability that should lie around it. Both are counted:
    values between them, a small part, are sorted, and ends that turn out to be wrong are dropped.
    """
    sought = {}
    for i, c in enumerate(columns):
        for k, p in enumerate(probabilities if n[i] else ()):
            place = (n[i] - 1) * p
            sought[i, k] = (F.col(c), place, math.floor(place) + 1, math.ceil(place) + 1, near[i][2 * k], near[i][2 * k + 1])
    found: list[list[float | None]] = [[None] * len(probabilities) for _ in columns]
    if not sought:
        return found
    seen = df.agg(*[F.count_if(v < lo) for v, _, _, _, lo, _ in sought.values()], *[F.count_if(v <= hi) for v, _, _, _, _, hi in sought.values()]).first()
    wanted = {}
    for at, ((i, k), (v, place, low, high, lo, hi)) in enumerate(sought.items()):
        below, upto = seen[at], seen[len(sought) + at]
        if below < low and upto >= high and lo == hi:
            found[i][k] = lo
            continue
        bounds = [] if below >= low else [v >= lo]
        bounds += [] if upto < high else [v <= hi]
        wanted[at] = (i, k, v, place, low, high, below if below < low else 0, reduce(lambda a, b: a & b, bounds, v.isNotNull()))
    if wanted:
        inside = [F.when(w[-1], F.struct(F.lit(at).alias("at"), w[2].alias("v"))) for at, w in wanted.items()]
        rows = df.where(reduce(lambda a, b: a | b, [w[-1] for w in wanted.values()])).select(F.explode(F.array_compact(F.array(*inside))).alias("s")).select("s.at", "s.v")
        upto = F.sum("n").over(Window.partitionBy("at").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        places = df.sparkSession.createDataFrame([(at, w[4] - w[6], w[5] - w[6]) for at, w in wanted.items()], "at int, low long, high long")
        ranked = rows.groupBy("at", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto).join(F.broadcast(places), "at")
        for r in ranked.groupBy("at").agg(*[F.min(F.when(F.col("upto") >= F.col(c), F.col("v"))).alias(c) for c in ("low", "high")]).collect():
            i, k, _, place, low, high, _, _ = wanted[r["at"]]
            found[i][k] = r["low"] if r["low"] == r["high"] else (high - 1 - place) * r["low"] + (place - low + 1) * r["high"]
    return found


def census(df: DataFrame, columns: Sequence[str], accuracy: int = 2000) -> DataFrame:
    """(column, n, n_null, n_nan, n_inf, p05, p50, p95) of the finite values.

    One pass counts and sketches, the next count the sketched quantiles' surroundings and sort what lies there, so that no
    task holds all values; accuracy only moves work between them.
    """
    values, parts, levels = {}, [], (0.05, 0.5, 0.95)
    around = [min(max(p + s, 0.0), 1.0) for p in levels for s in (-2 / accuracy, 2 / accuracy)]
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        values[f"v{i}"] = finite.alias(f"v{i}")
        parts += [F.count(F.lit(1)), F.count_if(v.isNull()), F.count_if(F.isnan(v)), F.count_if(F.abs(v) == float("inf")), F.count(finite), F.percentile_approx(finite, around, accuracy)]
    row = df.agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)]).first()
    sets = [row[6 * i : 6 * i + 6] for i in range(len(columns))]
    quantiles = exact_quantiles(df.select(*values.values()), list(values), [s[4] for s in sets], [s[5] for s in sets], levels)
    rows = [(c, *s[:4], *q) for c, s, q in zip(columns, sets, quantiles, strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, n long, n_null long, n_nan long, n_inf long, p05 double, p50 double, p95 double")


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all there: infinite values and NaN count as missing."""
    clean = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in columns}
    return df.withColumns(clean).na.drop(subset=list(columns))
