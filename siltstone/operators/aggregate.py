"""Hierarchical aggregation: part, item, entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_stage(df: DataFrame, item: Sequence[str], entity: str, features: Sequence[str], how=F.median) -> DataFrame:
    """Aggregate parts to items, then items to entities. The two steps aren't one: each item weighs the same."""
    items = df.groupBy(*item).agg(*[how(f).alias(f) for f in features])
    return items.groupBy(entity).agg(*[how(f).alias(f) for f in features])


def guarded_median(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Medians that skip NaN; a group without a number gives NaN, an infinite value fails the job."""
    bad = lambda f: F.when(F.abs(F.col(f)) == float("inf"), F.raise_error(F.lit(f"infinite value in {f}")))
    return df.groupBy(*keys).agg(*[F.coalesce(F.median(F.coalesce(bad(f).cast("double"), F.nanvl(f, F.lit(None).cast("double")))), F.lit(float("nan"))).alias(f) for f in features])


def balanced_mean(df: DataFrame, item: Sequence[str], entity: str, value: str) -> DataFrame:
    """Mean over entities in which every entity has mass one, shared evenly by its items."""
    items = df.groupBy(*item).agg(F.avg(value).alias("v"))
    entities = items.groupBy(entity).agg(F.avg("v").alias("v"))
    return entities.agg(F.avg("v").alias("balanced_mean"))


def step_curve(df: DataFrame, entity: str, value: str, edges: Sequence[float], name: str = "curve") -> DataFrame:
    """Cumulative percentage of an entity's values up to each edge, the last set to 100: one hash aggregation."""
    n = F.count(value)
    steps = [(F.count_if(F.col(value) <= e) * 100.0 / n) for e in edges[:-1]]
    return df.groupBy(entity).agg(F.array(*steps, F.lit(100.0)).alias(name), n.alias("n"))
