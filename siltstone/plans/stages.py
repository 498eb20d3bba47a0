"""A chain of named DataFrame steps whose results are written, made anew only when out of date, and checked on a rerun."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.contracts import frame_digest
from siltstone.sources.io import fingerprint, kept


@dataclass(frozen=True)
class Stage:
    name: str
    make: Callable[[dict[str, DataFrame]], DataFrame]
    config: dict = field(default_factory=dict)


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest) of a frame, whatever the order of its rows."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(frame_digest(df).cast("string"), F.lit("0")).alias("digest"))


def run(spark: SparkSession, folder: str, inputs: dict[str, DataFrame], stages: list[Stage], watch: bool = False) -> dict[str, DataFrame]:
    """Results by name. A stage is out of date if its settings or those of any stage before it changed.

    watch: it is too if a row of an input did. Beside each result its digest is kept as it was when made.
    """
    results = dict(inputs)
    for stage, settings in histories(inputs, stages, watch):
        results[stage.name] = kept(spark, folder, stage.name, settings, lambda s=stage: s.make(results))
        kept(spark, folder, f"{stage.name}-digest", settings, lambda s=stage: digest(results[s.name]))
    return results


def histories(inputs: dict[str, DataFrame], stages: list[Stage], watch: bool) -> list[tuple[Stage, dict]]:
    """Each stage with the settings that its result is kept under."""
    history: object = {name: tuple(digest(df).first()) for name, df in sorted(inputs.items())} if watch else "inputs"
    out = []
    for stage in stages:
        history = fingerprint({"before": history, "name": stage.name, "config": stage.config})
        out.append((stage, {"history": history}))
    return out


def rerun(spark: SparkSession, folder: str, inputs: dict[str, DataFrame], stages: list[Stage], watch: bool = False) -> DataFrame:
    """(stage, place, rows, rows_kept, rows_again, as_made, repeats): each stage made again from the kept results before it.

    as_made: the kept result still has the digest it was made with; repeats: the rerun has it too. So a file
    changed since and a step that doesn't repeat are told apart, and a stage isn't blamed for one before it.
    """
    results, out = run(spark, folder, inputs, stages, watch), None
    for place, (stage, settings) in enumerate(histories(inputs, stages, watch)):
        made = kept(spark, folder, f"{stage.name}-digest", settings, lambda s=stage: digest(results[s.name]))
        now, again = digest(results[stage.name]), digest(stage.make({k: v for k, v in results.items() if k != stage.name}))
        one = made.join(now.selectExpr("rows as rows_kept", "digest as digest_kept")).join(again.selectExpr("rows as rows_again", "digest as digest_again"))  # one-row frames
        same = lambda side: (F.col("rows") == F.col(f"rows_{side}")) & (F.col("digest") == F.col(f"digest_{side}"))
        row = one.select(F.lit(stage.name).alias("stage"), F.lit(place).alias("place"), "rows", "rows_kept", "rows_again", same("kept").alias("as_made"), same("again").alias("repeats"))
        out = row if out is None else out.unionAll(row)
    return out if out is not None else spark.createDataFrame([], "stage string, place int, rows bigint, rows_kept bigint, rows_again bigint, as_made boolean, repeats boolean")


def changed_rows(spark: SparkSession, folder: str, inputs: dict[str, DataFrame], stages: list[Stage], watch: bool = False) -> DataFrame:
    """(stage, change, row, times) of the rows, as JSON, that a rerun of a stage leaves out (`missing`) or adds (`added`), and how often."""
    results, out = run(spark, folder, inputs, stages, watch), None
    for stage in stages:
        old, new = results[stage.name], stage.make({k: v for k, v in results.items() if k != stage.name})
        text = lambda df: df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("row"))
        both = text(old).withColumn("n", F.lit(-1)).unionAll(text(new).withColumn("n", F.lit(1)))
        gap = both.groupBy("row").agg(F.sum("n").alias("n")).where("n <> 0")
        rows = gap.select(F.lit(stage.name).alias("stage"), F.when(F.col("n") < 0, "missing").otherwise("added").alias("change"), "row", F.abs("n").alias("times"))
        out = rows if out is None else out.unionAll(rows)
    return out if out is not None else spark.createDataFrame([], "stage string, change string, row string, times bigint")
