"""Bootstraps whose draws are common to all effects, and placebo nulls; no task or driver holds all clusters.

A draw picks as many clusters as there are, with replacement. Clusters lie in blocks by a hash; how many picks
of a draw fall to each block is drawn from the draw's number alone, so every block knows its own share and picks
within itself. What leaves a block are its sums of every draw. Draws are seeded by draw and block: results don't
depend on partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Clusters of a block, in expectation, and draws that a task makes of it.
BLOCK = 20_000
RANGE = 1_000


def picks(seed: int, draw: int, block: int, sizes: Sequence[int]) -> np.ndarray:
    """How often a draw picks each cluster of a block; sizes: clusters by block."""
    own = sizes[block]
    total = sum(sizes)
    share = total if len(sizes) == 1 else np.random.default_rng([seed, draw]).multinomial(total, np.array(sizes) / total)[block]
    return np.bincount(np.random.default_rng([seed, draw, block]).integers(0, own, share), minlength=own)


def common_draws(rows: DataFrame, cluster: str, effect: str, value: str, draws: int, seed: int, block: int | None = None) -> tuple[DataFrame, list]:
    """(draw, effect, mean) of every draw, and the effects: the mean of an effect's rows over the picked clusters, null where none has any.

    Rows without a cluster, an effect or a value take no part.
    """
    spark, block = rows.sparkSession, block or BLOCK
    kept = rows.where(F.col(cluster).isNotNull() & F.col(effect).isNotNull() & F.col(value).isNotNull())
    effects = [r[0] for r in kept.select(effect).distinct().orderBy(effect).collect()]  # one row an effect
    own = lambda e: F.col(effect) == F.lit(e)
    s = [F.coalesce(F.sum(F.when(own(e), F.col(value))), F.lit(0.0)).cast("double") for e in effects]
    n = [F.count_if(own(e)).cast("double") for e in effects]
    sums = kept.groupBy(F.col(cluster).cast("string").alias("cluster")).agg(F.array(*s, *n).alias("sums")) if effects else None
    kinds = f"draw int, effect {rows.schema[effect].dataType.simpleString()}, mean double"
    if sums is None:
        return spark.createDataFrame([], kinds), effects
    count = sums.count()
    blocks = max(1, round(count / block))
    placed = sums.withColumn("block", F.pmod(F.xxhash64("cluster"), F.lit(blocks)).cast("int"))
    known = {r["block"]: r["count"] for r in placed.groupBy("block").count().collect()}  # one row a block
    sizes, width = [known.get(k, 0) for k in range(blocks)], 2 * len(effects)
    spread = placed.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // RANGE) - 1))))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        own, at, first = np.stack(pdf["sums"].to_numpy()), int(pdf["block"].iloc[0]), int(pdf["range"].iloc[0]) * RANGE
        made = range(first, min(draws, first + RANGE))
        return pd.DataFrame({"draw": list(made), "sums": [picks(seed, k, at, sizes) @ own for k in made]})

    parts = spread.groupBy("block", "range").applyInPandas(draw, "draw int, sums array<double>")
    total = parts.groupBy("draw").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    each = [F.struct(F.lit(e).alias("effect"), (F.col(f"s{i}") / F.nullif(F.col(f"s{i + len(effects)}"), F.lit(0.0))).alias("mean")) for i, e in enumerate(effects)]
    return total.select("draw", F.inline(F.array(*each))).select("draw", F.col("effect"), "mean"), effects


def effect_intervals(rows: DataFrame, cluster: str, effect: str, value: str, draws: int = 20_000, seed: int = 20260930, block: int | None = None) -> DataFrame:
    """(effect, mean, lo, hi, p_le_0, wins, n) of every effect over draws of whole clusters, the same draws for all effects.

    wins: rows above 0. Differences of effects may be taken draw by draw from common_draws().
    """
    means, _ = common_draws(rows, cluster, effect, value, draws, seed, block)
    drawn = means.groupBy("effect").agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"), F.avg((F.col("mean") <= 0).cast("int")).alias("p_le_0"))
    kept = rows.where(F.col(cluster).isNotNull() & F.col(effect).isNotNull() & F.col(value).isNotNull())
    real = kept.groupBy(F.col(effect).alias("effect")).agg(F.avg(value).alias("mean"), F.count_if(F.col(value) > 0).alias("wins"), F.count(F.lit(1)).alias("n"))
    return real.join(drawn, "effect").select("effect", "mean", "lo", "hi", "p_le_0", "wins", "n")


def permuted(rows: DataFrame, key: str, column: str, shuffles: int, seed: int) -> DataFrame:
    """(shuffle, key, column): the column's values dealt anew to the keys; shuffle 0 is the real table.

    key: without repeated values. Shuffle k orders the keys by a hash and gives them the values in a fixed other order;
    ranks are counted within buckets of the hash, so no task ranks a whole shuffle.
    """

    def ranked(df: DataFrame, by: list[str]) -> DataFrame:
        hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), *by, "key")).withColumn("__b", F.shiftrightunsigned("__h", 54))
        over = [c for c in by if c in df.columns]
        sizes = hashed.groupBy(*over, "__b").count()
        before = sizes.select(*over, "__b", F.coalesce(F.sum("count").over(Window.partitionBy(*over).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
        place = F.row_number().over(Window.partitionBy(*over, "__b").orderBy("__h", "key")) + F.col("__before")
        return hashed.join(F.broadcast(before), [*over, "__b"]).withColumn("place", place)  # 1,024 rows a shuffle

    named = rows.select(F.col(key).alias("key"), F.col(column).alias("column"))
    gives = ranked(named.withColumn("shuffle", F.lit(-1)), ["shuffle"]).select("place", "column")
    takes = ranked(named.select("key", F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("shuffle")), ["shuffle"]).select("shuffle", "key", "place")
    dealt = takes.join(gives, "place").select("shuffle", "key", "column")
    return named.select(F.lit(0).alias("shuffle"), "key", "column").unionAll(dealt).select("shuffle", F.col("key").alias(key), F.col("column").alias(column))


def label_placebo(rows: DataFrame, key: str, label: str, values: Sequence[str], shuffles: int = 200, seed: int = 7) -> DataFrame:
    """(shuffle, arm, gain): the share of each arm's variance that labels explain, under the real labels (shuffle 0) and permuted ones."""
    labels = permuted(rows.where(F.col(label).isNotNull()), key, label, shuffles, seed)
    met = labels.join(rows.select(key, *values), key)
    cells = met.groupBy("shuffle", label).agg(F.count(F.lit(1)).alias("n"), *[f(F.col(v).cast("double") ** p).alias(f"{name}_{v}") for v in values for name, f, p in (("s", F.sum, 1), ("q", F.sum, 2))])
    total = lambda v: F.sum(f"s_{v}") ** 2 / F.sum("n")
    gains = [F.struct(F.lit(v).alias("arm"), ((F.sum(F.col(f"s_{v}") ** 2 / F.col("n")) - total(v)) / F.nullif(F.sum(f"q_{v}") - total(v), F.lit(0.0))).alias("gain")) for v in values]
    return cells.groupBy("shuffle").agg(F.array(*gains).alias("g")).select("shuffle", F.inline("g"))


def placebo_gate(gains: DataFrame) -> DataFrame:
    """(real, p95, share_at_least, draws, passes): the best arm under the real labels against the best of each permutation."""
    best = gains.groupBy("shuffle").agg(F.max("gain").alias("best"))
    real = best.where("shuffle = 0").select(F.col("best").alias("real"))  # one row
    null = best.where("shuffle > 0").join(F.broadcast(real))
    out = null.agg(F.first("real").alias("real"), F.percentile("best", F.lit(0.95)).alias("p95"), F.avg((F.col("best") >= F.col("real")).cast("double")).alias("share_at_least"), F.count(F.lit(1)).alias("draws"))
    return out.withColumn("passes", F.col("real") > F.col("p95"))
