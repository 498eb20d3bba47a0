"""Joins that check what they assume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table broke an assumption that was to hold."""


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    again = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if again:
        raise ContractError(f"{what}: key {again[0]} occurs {again[0]['count']} times")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join after both sides proved unique by key; of shared columns the left one stays."""
    require_unique(left, keys, "left side")
    require_unique(right, keys, "right side")
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in keys]), list(keys))


def no_loss(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails if a left row finds no partner."""
    lost = left.join(right, list(keys), "left_anti").limit(1).collect()
    if lost:
        raise ContractError(f"no partner for {lost[0]}")
    return left.join(right, list(keys))


def once(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The table, whose job fails where a key occurs twice. One exchange by key, which a join by it uses again."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(1)).alias("__row"))
    named = F.concat(F.lit(f"{what}: a key occurs twice: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    ok = F.when(F.col("__n") > 1, F.raise_error(named).cast("boolean")).otherwise(True)
    return one.where(ok).select(*keys, *([F.col(f"__row.`{c}`").alias(c) for c in rest]))


def matched_once(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """one_to_one() with its checks in the plan: one job, which fails where either side repeats a key."""
    right = right.drop(*[c for c in right.columns if c in left.columns and c not in keys])
    return once(left, keys, "left side").join(once(right, keys, "right side"), list(keys))


def matched_all(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """no_loss() with its check in the plan: one job, which fails where a left row finds no partner."""
    met = left.join(right.withColumn("__there", F.lit(True)), list(keys), "left")
    lost = F.concat(F.lit("no partner for "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    return met.where(F.when(F.col("__there").isNull(), F.raise_error(lost).cast("boolean")).otherwise(True)).drop("__there")


def merged_stages(stages: Sequence[DataFrame], key: str) -> DataFrame:
    """The first stage's rows with what later stages add by key; a column that an earlier stage has stays as it was there.

    A later stage may lack keys (its columns are null then), but it fails the job where it repeats one.
    """
    out = stages[0]
    for number, stage in enumerate(stages[1:], 2):
        fresh = [c for c in stage.columns if c == key or c not in out.columns]
        out = out.join(once(stage.select(*fresh), [key], f"stage {number}"), key, "left")
    return out


def drift(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(column, max_drift, n) between two versions of a table."""
    met = left.select(*keys, *[F.col(c).alias(f"l_{i}") for i, c in enumerate(columns)]).join(right.select(*keys, *[F.col(c).alias(f"r_{i}") for i, c in enumerate(columns)]), list(keys))
    one = met.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.abs(F.col(f"l_{i}") - F.col(f"r_{i}"))).alias(f"d_{i}") for i in range(len(columns))])
    return one.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{i}").alias("max_drift")) for i, c in enumerate(columns)])))


def leaks(fit: DataFrame, evaluated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `evaluated` whose key was also fitted on."""
    return evaluated.join(fit.select(*keys).distinct(), list(keys), "left_semi")


def nearest(queries: DataFrame, data: DataFrame, distance: Column, k: int, apart: Column | None = None) -> DataFrame:
    """The k nearest data rows of each query row (columns q_id, d_id, dist, rank), ties to the lowest d_id.

    For a stated, small query set: it is broadcast if Spark finds it small enough, and meets the data
    block by block; a partial top k per task comes before the shuffle.
    """
    met = queries.join(data, apart if apart is not None else F.lit(True)).withColumn("dist", distance)
    order = Window.partitionBy("q_id").orderBy("dist", "d_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_id", "d_id", "dist", "rank")


def left_checked(left: DataFrame, right: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Left join whose job fails where a required column of the right side is null."""
    met = left.join(right, list(keys), "left")
    missing = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"no {c} for key "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))).cast(right.schema[c].dataType)).otherwise(F.col(c))
    return met.withColumns({c: missing(c) for c in required})


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one of two tables holds: empty if both have the same key set."""
    sides = left.select(F.col(key), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(F.col(key), F.lit(0), F.lit(1)))
    found = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r")
    return found.select(key, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def fused(blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Feature blocks side by side by key: their columns must differ, each block must hold each key once, no value may be null or NaN.

    Names are checked at once; rows when the job runs, in the one aggregation by key that puts the blocks together.
    """
    names = [c for b in blocks for c in b.columns if c != key]
    if clash := sorted({c for c in names if names.count(c) > 1}):
        raise ContractError(f"blocks share the columns {clash}")
    wide = None
    for i, b in enumerate(blocks):
        own = b.select(key, F.lit(i).alias("__block"), F.create_map(*[x for c in b.columns if c != key for x in (F.lit(c), F.col(c).cast("double"))]).alias("__values"))
        wide = own if wide is None else wide.unionAll(own)
    value = lambda c: F.max(F.try_element_at("__values", F.lit(c)))
    out = wide.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"), F.count_distinct("__block").alias("__blocks"), *[value(c).alias(c) for c in names])
    bad = (F.col("__rows") != len(blocks)) | (F.col("__blocks") != len(blocks))
    for c in names:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    ok = F.when(bad, F.raise_error(F.concat(F.lit("blocks don't fit together at key "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return out.where(ok).select(key, *names)
