"""Readers with declared schemas, a write guard, and results kept by what they were made from."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder within spark.checkpoint.dir.

    Without that setting a temporary folder serves, but only in one process, as in tests.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="siltstone-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame made once, its lineage cut by a reliable checkpoint in the shared folder of spark.checkpoint.dir."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As checkpointed, for what is made again and again from itself: read back, files have the size they have.

    A checkpoint keeps the size its plan was estimated at. Of a join that is the product of both sides, so in rounds of
    joins its digits double with each round, until planning takes minutes.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV under a declared schema; a row that doesn't fit it fails the job."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """A CSV file's column names, from its first line."""
    return spark.read.option("header", True).csv(path).columns


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def files(spark: SparkSession, root: str, pattern: str = "*", skip: Sequence[str] = ()) -> DataFrame:
    """(path, length, sha256) of the files below a folder; contents stay in the tasks.

    skip: names of folders or files; what lies in or under them is left out before it is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = F.lit(root.rstrip("/").split(":")[-1])  # a path begins with its scheme, whatever the root does
    below = F.split(F.substring(F.col("path"), F.instr(F.col("path"), base) + F.length(base), F.length("path")), "/")
    for name in skip:
        found = found.where(~F.array_contains(below, name))
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))


def roll_up(listing: DataFrame) -> DataFrame:
    """(files, bytes, digest) of a listing of files, whatever its order: one path, size or content that changes, changes it."""
    own = F.sum(F.xxhash64("path", "length", "sha256").cast("decimal(38,0)"))
    return listing.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sha2(F.coalesce(own.cast("string"), F.lit("")), 256).alias("digest"))


def guard(path: str, read_only: Sequence[str]) -> str:
    for root in read_only:
        if path == root or path.startswith(root.rstrip("/") + "/"):
            raise PermissionError(f"{path} lies under the read-only {root}")
    return path


def write(df: DataFrame, path: str, read_only: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").parquet(guard(path, read_only))


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


def kept(spark: SparkSession, folder: str, name: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The result made under this very configuration, made now if there is none."""
    path = f"{folder}/{name}-{fingerprint(config)}"
    try:
        return spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
    write(make(), path)
    return spark.read.parquet(path)


def shallowest(paths: DataFrame, name: str) -> DataFrame:
    """(path): of the files of a name the one with the shortest path, ties in order of path; none if there is none."""
    hit = paths.where(F.substring_index("path", "/", -1) == name)
    return hit.agg(F.min(F.struct(F.length("path").alias("n"), F.col("path"))).alias("b")).where("b is not null").select("b.path")


def stale(listing: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files on disk that the manifest doesn't name."""
    return listing.join(manifest.select(key), key, "left_anti")


def strict_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Rows as JSON text; a NaN or infinite number fails the job instead of becoming a word."""
    checked = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("double", "float"):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            c = F.when(bad, F.raise_error(F.lit(f"{f.name} is not finite")).cast(f.dataType)).otherwise(c)
        checked.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*checked)).alias(out))


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    lines = ["| " + " | ".join(report.columns) + " |", "|" + "-|" * len(report.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def write_csv(df: DataFrame, path: str, columns: Sequence[str], read_only: Sequence[str] = ()) -> None:
    """CSV with these columns in this order, missing values as NaN, lines ended by \\n."""
    chosen = df.select(*[F.col(f"`{c}`") for c in columns])
    chosen.write.mode("overwrite").option("header", True).option("nullValue", "NaN").option("lineSep", "\n").csv(guard(path, read_only))


def append_jsonl(df: DataFrame, path: str, read_only: Sequence[str] = ()) -> None:
    """More rows for a folder of JSON lines."""
    df.write.mode("append").json(guard(path, read_only))
