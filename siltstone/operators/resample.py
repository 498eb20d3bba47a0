"""Seeded permutations and paired contrasts as tables that are joined to the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BUCKETS = 1024


def hash_rank(df: DataFrame, key: str, seed: int, out: str) -> DataFrame:
    """(key, out): each row's place, from 1, in the order of a hash of seed and key.

    Rows are ranked within buckets of the hash's leading bits, and the buckets' sizes, BUCKETS rows, give
    the places before them; so no task holds all rows, and the order is the same on any partitions.
    """
    hashed = df.select(key, F.xxhash64(F.lit(seed), F.col(key)).alias("__h")).withColumn("__b", F.shiftrightunsigned("__h", 54))
    before = F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = hashed.groupBy("__b").count().select("__b", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) + F.col("__before")
    return hashed.join(F.broadcast(sizes), "__b").select(key, place.alias(out))


def row_permutation(df: DataFrame, key: str, columns: Sequence[str], seed: int) -> DataFrame:
    """The table with `columns` of another row each, keys kept: whole rows move together."""
    takes, gives = hash_rank(df, key, 2 * seed, "__place"), hash_rank(df, key, 2 * seed + 1, "__place")
    donor = df.select(key, *columns).join(gives, key).drop(key)
    return df.drop(*columns).join(takes, key).join(donor, "__place").select(df.columns)


def column_shuffle(df: DataFrame, key: str, columns: Sequence[str], seed: int) -> DataFrame:
    """Each column shuffled on its own: marginals stay, the joint distribution goes."""
    out = df
    for n, column in enumerate(columns):
        out = row_permutation(out, key, [column], seed + n)
    return out


def contrasts(errors: DataFrame, key: str, arm: str, value: str, pairs: Sequence[tuple[str, str]], floor: float = 0.0) -> DataFrame:
    """(arm_a, arm_b, n, estimate, wins_a, wins_b, verdict) of arms paired by key, found in one pass.

    Differences of at most `floor` are unresolved.
    """
    names = sorted({x for pair in pairs for x in pair})
    wide = errors.groupBy(key).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(f"v{i}") for i, a in enumerate(names)])
    at = {a: F.col(f"v{i}") for i, a in enumerate(names)}
    made, rows = [], []
    for k, (a, b) in enumerate(pairs):
        gap = at[a] - at[b]
        made += [F.count(gap).alias(f"n{k}"), F.avg(gap).alias(f"e{k}"), F.count_if(gap < 0).alias(f"a{k}"), F.count_if(gap > 0).alias(f"b{k}")]
        verdict = F.when(F.col(f"e{k}") < -floor, "A").when(F.col(f"e{k}") > floor, "B").otherwise("UNRESOLVED")
        rows.append(F.struct(F.lit(a).alias("arm_a"), F.lit(b).alias("arm_b"), F.col(f"n{k}").alias("n"), F.col(f"e{k}").alias("estimate"), F.col(f"a{k}").alias("wins_a"), F.col(f"b{k}").alias("wins_b"), verdict.alias("verdict")))
    return wide.agg(*made).select(F.inline(F.array(*rows)))
