"""Recorded results of 24 measured samples; data/ holds the recorded features, curves and errors as fixed values."""

import csv
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import curves
from siltstone.operators import evaluation, models

# The features of the recorded design, and the recorded results that the tests compare with.
FEATURES = ("e4", "e8", "e16", "lum_sd", "grad_mean", "R", "G", "B", "sat", "lum_p10", "lum_p50", "lum_p90")


def recorded(name):
    with open(os.path.join(os.path.dirname(__file__), "data", name), newline="") as f:
        return list(csv.DictReader(f))


SAMPLES = recorded("recorded_samples.csv")


@pytest.fixture(scope="module")
def design(spark):
    made = [(r["sample_id"], r["family"], [float(r[c]) for c in FEATURES], [float(v) for k, v in r.items() if k.startswith("d_")]) for r in SAMPLES]
    return spark.createDataFrame(made, "sample_id string, family string, x array<double>, y array<double>").persist()


@pytest.mark.parametrize(
    ("protocol", "expected"),
    [(evaluation.strict_protocol, 43.45322520181157), (evaluation.historical_protocol, 43.02173087964773), (evaluation.fixed_protocol, 41.14751586569822)],
)
def test_protocols(design, protocol, expected):
    got = protocol(design).agg(F.avg("emd"), F.count("*")).first()
    assert got[1] == 24 and got[0] == pytest.approx(expected, abs=1e-9)


def test_errors_of_each_sample(design):
    got = {r["sample_id"]: r["emd"] for r in evaluation.fixed_protocol(design).collect()}
    assert got == pytest.approx({r["sample_id"]: float(r["fixed_error"]) for r in SAMPLES}, abs=1e-9)


def test_metric_checks_itself(design):
    line = curves.doubles([100.0 * (i + 1) / 11 for i in range(11)])
    one = design.agg(F.avg(curves.emd_trapezoid(F.col("y"), line)), F.avg(curves.emd_left(F.col("y"), line))).first()
    rounded = curves.doubles([9.09, 18.18, 27.27, 36.36, 45.45, 54.55, 63.64, 72.73, 81.82, 90.91, 100.0])
    assert one[0] == pytest.approx(100.3132, abs=4e-3) and one[1] == pytest.approx(102.02, abs=6e-3)
    assert abs(one[0] - design.agg(F.avg(curves.emd_trapezoid(F.col("y"), rounded))).first()[0]) < 5e-3


def test_rank_floors(design):
    got = {r["rank"]: r["floor"] for r in models.rank_floors(design, "y", 11).collect()}
    assert got == pytest.approx({1: 19.284197, 2: 9.746232, 3: 6.254267, 4: 3.836961}, abs=1e-6)


def test_linkage_families(design):
    found = models.linkage_families(design, "sample_id", "y").join(design.select("sample_id", F.col("family").alias("recorded")), "sample_id").collect()
    name = next(c for c in found[0].__fields__ if c not in ("sample_id", "recorded"))
    pairs = {(r[name], r["recorded"]) for r in found}
    assert len(pairs) == 16 == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    sizes = sorted([sum(r[name] == a for r in found) for a, _ in pairs], reverse=True)
    assert sizes == [4] + [2] * 5 + [1] * 10


def test_diameters_of_the_samples(design):
    known = {r["sample_id"]: float(r["log_d50"]) for r in SAMPLES}
    rows = design.select("sample_id", curves.diameter_at(F.col("y"), 50.0).alias("d"), curves.diameter_legacy(F.col("y")).alias("old")).collect()
    for r in rows:
        assert r["old"] == pytest.approx(known[r["sample_id"]], abs=1e-5)
        assert r["d"] == pytest.approx(r["old"], abs=1e-5)


def test_cluster_bootstrap_is_wider_than_the_naive_one(spark):
    rows = [(r["sample_id"], r["family"], -float(r["delta"])) for r in SAMPLES]
    df = spark.createDataFrame(rows, "sample_id string, family string, delta double")
    one = evaluation.cluster_bootstrap(df, "family", "delta").first()
    assert one["mean"] == pytest.approx(np.mean([r[2] for r in rows])) and one["lo"] == pytest.approx(-3.876, abs=0.2) and one["hi"] == pytest.approx(4.923, abs=0.2)
    assert one["p_le_0"] == pytest.approx(0.433, abs=0.02)
    assert evaluation.naive_bootstrap(df, "sample_id", "delta").count() == 1


def test_range_audit_of_the_features(spark):
    df = spark.createDataFrame([(r["split"], float(r["e4"])) for r in recorded("recorded_e4.csv")], "split string, e4 double")
    fit = df.where("split = 'train'").agg(F.min("e4"), F.max("e4"), F.avg("e4")).first()
    assert tuple(fit) == pytest.approx((3.3273269534111023, 9.983126401901243, 6.37089387824138))


def test_two_parameter_forms(design):
    got = {r["sample_id"]: r["emd"] for r in models.weibull_oracle(design, "sample_id", "y").collect()}
    assert got == pytest.approx({r["sample_id"]: float(r["weibull_projected"]) for r in SAMPLES}, abs=1e-6)
    assert np.mean(list(got.values())) == pytest.approx(7.328461963442824, abs=1e-7)
