"""Checks of a table as rows (check, ok, n_bad), found in one pass, and gates that stop on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.joins import ContractError


def audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rules: name to a condition that every row must meet (null counts as broken)."""
    bad = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"b{i}") for i, rule in enumerate(rules.values())]
    rows = [F.struct(F.lit(name).alias("check"), (F.col(f"b{i}") == 0).alias("ok"), F.col(f"b{i}").alias("n_bad")) for i, name in enumerate(rules)]
    return df.agg(*bad).select(F.inline(F.array(*rows)))


def gate(report: DataFrame) -> None:
    broken = report.where("not ok").orderBy("check").collect()
    if broken:
        raise ContractError("; ".join(f"{r['check']}: {r['n_bad']} rows" for r in broken))


def changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change) of the rows added, missing or changed between two listings."""
    met = before.select(key, F.col(digest).alias("b")).join(after.select(key, F.col(digest).alias("a")), key, "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "missing").when(F.col("a") != F.col("b"), "changed")
    return met.withColumn("change", change).where("change is not null").select(key, "change")


def frame_digest(df: DataFrame) -> Column:
    """Order-free digest of a frame's rows, to be used in df.agg()."""
    return F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)"))


def without(df: DataFrame, banned: Sequence[str]) -> DataFrame:
    """The table without the banned columns, as far as it has them."""
    return df.drop(*[c for c in banned if c in df.columns])


def exposed(df: DataFrame, banned: Sequence[str]) -> list[str]:
    """The banned columns that a table still holds, nested ones by their path."""
    def names(fields, before=""):
        for f in fields:
            yield f"{before}{f.name}", f.name
            kind = getattr(f.dataType, "elementType", f.dataType)
            yield from names(getattr(kind, "fields", []), f"{before}{f.name}.")

    return [path for path, name in names(df.schema.fields) if name in banned]


def vectors(df: DataFrame, vector: str, dead: float = 1e-12) -> DataFrame:
    """One row on a vector column: rows, widths, vectors with a null or non-finite value, smallest and largest length, dimensions that don't vary."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    ok = df.where(v.isNotNull() & finite)
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.min(F.size(v)).alias("least_width"), F.max(F.size(v)).alias("most_width"), F.count_if(v.isNull() | ~finite).alias("bad"))
    size = ok.agg(F.min(norm).alias("least_norm"), F.max(norm).alias("most_norm"))
    spread = ok.select(F.posexplode(v).alias("i", "x")).groupBy("i").agg(F.stddev_pop("x").alias("s")).agg(F.count_if(F.col("s") <= dead).alias("dead"))
    return one.join(size).join(spread)  # one-row frames


def violations(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check, failures) of every check that has failures: all of them, not only the first."""
    out = None
    for name, rows in checks.items():
        own = rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("failures"))
        out = own if out is None else out.unionAll(own)
    return out.where("failures > 0")


def nonfinite_paths(value: object, path: str = "$") -> list[str]:
    """JSON paths of the numbers of a small report that are NaN or infinite."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in nonfinite_paths(v, f"{path}.{k}")]
    if isinstance(value, (list, tuple)):
        return [p for k, v in enumerate(value) for p in nonfinite_paths(v, f"{path}[{k}]")]
    return [path] if isinstance(value, float) and (value != value or abs(value) == float("inf")) else []


def submission_report(delivered: DataFrame, expected: DataFrame, key: str, position: str, columns: Sequence[str]) -> DataFrame:
    """(check, ok, n_bad): a delivered table of curves against the expected keys and their order.

    Checks: its columns are the key and `columns` in that order, no more; no key twice, missing or unknown; every row at its
    position; values there and finite, within 0 and 100, never falling, the last 100.
    """
    shape = [c for c in delivered.columns if c != position]
    wrong = len(set(shape) ^ {key, *columns}) or int(shape != [key, *columns])
    there = [c for c in columns if c in delivered.columns]
    met = delivered.withColumn("__d", F.lit(1)).join(expected.select(key, F.col(position).alias("__at")).withColumn("__e", F.lit(1)), key, "full_outer")
    row = F.col("__d").isNotNull()
    value = [F.col(c).cast("double") for c in there]
    any_of = lambda parts: F.exists(F.array(*parts), lambda x: x) if parts else F.lit(False)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    checks = {
        "missing keys": F.count_if(F.col("__d").isNull()),
        "unknown keys": F.count_if(F.col("__e").isNull()),
        "repeated keys": F.count("__d") - F.count_distinct(F.when(row, F.col(key))),
        "order": F.count_if(row & F.col("__e").isNotNull() & ~F.col(position).eqNullSafe(F.col("__at"))),
        "finite": F.count_if(row & any_of([~finite(v) for v in value])),
        "range": F.count_if(row & any_of([finite(v) & ((v < 0) | (v > 100)) for v in value])),
        "monotone": F.count_if(row & any_of([F.coalesce(b < a, F.lit(False)) & finite(a) & finite(b) for a, b in zip(value, value[1:])])),
        "last is 100": F.count_if(row & ~F.coalesce(value[-1] == 100, F.lit(False))) if value else F.lit(0),
    }
    one = met.agg(*[c.cast("bigint").alias(n) for n, c in checks.items()])
    rows = [F.struct(F.lit("columns").alias("check"), F.lit(wrong).cast("bigint").alias("n_bad"))] + [F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("n_bad")) for n in checks]
    return one.select(F.inline(F.array(*rows))).select("check", (F.col("n_bad") == 0).alias("ok"), "n_bad")
