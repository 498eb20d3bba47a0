"""Digests kept with results, reruns that name the stage and the row, and fingerprints of files."""

import itertools

import pytest
from pyspark.sql import functions as F

from siltstone.plans import stages
from siltstone.plans.stages import Stage
from siltstone.sources import io

CALLS = itertools.count()


def unsteady(results):
    """A step that gives another row each time."""
    return results["double"].withColumn("v", F.when(F.col("k") == 2, F.lit(100 + next(CALLS))).otherwise(F.col("v")))


CHAIN = [
    Stage("double", lambda r: r["rows"].withColumn("v", F.col("v") * 2)),
    Stage("odd", unsteady),
    Stage("total", lambda r: r["odd"].groupBy("g").agg(F.count(F.lit(1)).alias("n"))),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(k, k % 2, k) for k in range(6)], "k int, g int, v int")


def test_a_rerun_names_the_stage_and_the_row(spark, rows, tmp_path):
    got = {r["stage"]: r for r in stages.rerun(spark, str(tmp_path), {"rows": rows}, CHAIN).collect()}
    assert [got[s.name]["repeats"] for s in CHAIN] == [True, False, True] and all(r["as_made"] for r in got.values())
    assert [got[s.name]["place"] for s in CHAIN] == [0, 1, 2] and got["total"]["rows"] == 2
    changed = stages.changed_rows(spark, str(tmp_path), {"rows": rows}, CHAIN).collect()
    assert {(r["stage"], r["change"], r["times"]) for r in changed} == {("odd", "missing", 1), ("odd", "added", 1)}
    assert all('"k":2' in r["row"] for r in changed)


def test_a_result_changed_since_is_told_apart(spark, rows, tmp_path):
    stages.run(spark, str(tmp_path), {"rows": rows}, CHAIN[:1])
    folder = next(p for p in tmp_path.iterdir() if p.name.startswith("double-") and "digest" not in p.name)
    rows.withColumn("v", F.col("v") * 3).write.mode("overwrite").parquet(str(folder))
    one = stages.rerun(spark, str(tmp_path), {"rows": rows}, CHAIN[:1]).first()
    assert not one["as_made"] and one["repeats"]


def test_watched_inputs_make_stages_anew(spark, rows, tmp_path):
    total = lambda df, watch: stages.run(spark, str(tmp_path), {"rows": df}, CHAIN[:1], watch)["double"].agg(F.sum("v")).first()[0]
    other = rows.withColumn("v", F.col("v") + 1)
    assert total(rows, False) == total(other, False) == 30  # only settings count
    assert total(rows, True) == 30 and total(other, True) == 42 and total(rows.orderBy(F.desc("k")), True) == 30


def test_empty_chains_and_frames(spark, rows, tmp_path):
    assert stages.rerun(spark, str(tmp_path), {}, []).count() == 0 == stages.changed_rows(spark, str(tmp_path), {}, []).count()
    got = stages.rerun(spark, str(tmp_path), {"rows": rows.where("false")}, CHAIN[:1]).first()
    assert (got["rows"], got["as_made"], got["repeats"]) == (0, True, True)


def test_files_are_listed_skipped_and_rolled_up(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("sub/b.txt", "two"), ("sub/cache/c.txt", "three"), ("cache.txt", "four")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    every, some = io.files(spark, str(tmp_path)), io.files(spark, str(tmp_path), skip=["cache"])
    assert every.count() == 4 and {r["path"].rsplit("/", 1)[-1] for r in some.collect()} == {"a.txt", "b.txt", "cache.txt"}
    assert io.files(spark, f"file:{tmp_path}", skip=["cache", "a.txt"]).count() == 2
    before = io.roll_up(some).first()
    assert (before["files"], before["bytes"]) == (3, 10) and io.roll_up(some.orderBy(F.desc("path"))).first() == before
    (tmp_path / "a.txt").write_text("One")
    after = io.roll_up(io.files(spark, str(tmp_path), skip=["cache"])).first()
    assert (after["files"], after["bytes"]) == (3, 10) and after["digest"] != before["digest"]
    assert io.roll_up(some.where("false")).first()["files"] == 0
