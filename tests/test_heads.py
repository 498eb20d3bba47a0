"""Heads from moments against plain refits on the rows themselves."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import heads
from siltstone.operators.evaluation import predict, weighted_predict
from siltstone.operators.heads import UNSEEN, emd

ALPHAS = (0.1, 1.0, 10.0, 100.0)
KINDS = "sample_id string, family string, condition string, x array<double>, y array<double>"


def rows_of(seed, families=5, entities=4, conditions=("a|1", "b|1", "a|2", "b|2"), missing=0.25):
    r, out = np.random.default_rng(seed), []
    for f, e in itertools.product(range(families), range(entities)):
        base, sample = r.normal(size=3) + f, f"s{f}_{e}"
        for c, name in enumerate(conditions):
            if r.random() >= missing:
                x = base + r.normal(size=3) * 0.3 + c * 0.2
                y = np.maximum.accumulate(np.clip(np.linspace(0, 100, 11) + 8 * x[0] + 3 * r.normal(size=11), 0, 100))
                y[-1] = 100
                out.append((sample, f"f{f}", name, x.tolist(), y.tolist()))
    return out


def arrays(rows):
    return np.array([r[3] for r in rows]), np.array([r[4] for r in rows])


def error(fit, row, alpha):
    x, y = arrays(fit)
    return float(emd(predict(x, y, np.array([row[3]]), (alpha,))[0], np.array([row[4]]))[0])


def best(fit, skip):
    """The penalty for a fold: each fit row outside `skip` judged without its family and `skip`."""
    held = [r for r in fit if r[1] != skip]
    mean = [np.mean([error([o for o in held if o[1] != r[1]], r, a) for r in held]) for a in ALPHAS]
    return ALPHAS[int(np.argmin(mean))]


def test_transfer_by_plain_refits(spark):
    rows = rows_of(1)
    rows.append(("lone", "f1", "b|1", [0.5, 1.0, 2.0], np.linspace(0, 100, 11).tolist()))
    source, target = "a|1", "b|1"
    fit, want = [r for r in rows if r[2] == source], {}
    seen = {r[0] for r in fit}
    for r in rows:
        if r[2] == target:
            fold = r[1] if r[0] in seen else UNSEEN
            alpha = best(fit, fold)
            status = "FLOOR" if alpha == ALPHAS[0] else "CEILING" if alpha == ALPHAS[-1] else "INTERIOR"
            want[r[0]] = (fold, alpha, status, error([o for o in fit if o[1] != fold], r, alpha))
    got = {r["sample_id"]: tuple(r)[1:] for r in heads.transfer(spark.createDataFrame(rows, KINDS), source, target, ALPHAS).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()} and UNSEEN in {v[0] for v in got.values()}
    assert all(got[k][3] == pytest.approx(want[k][3], abs=1e-9) for k in want)


def test_rulers_by_plain_refits(spark):
    rows, names = rows_of(2, families=4, entities=3), {}
    for r, source in itertools.product(rows, ("a|1", "b|1", "a|2", "b|2")):
        fit = [o for o in rows if o[2] == source and o[1] != r[1]]
        camera, view = (x == y for x, y in zip(source.split("|"), r[2].split("|"), strict=True))
        ruler = "LOGO" if camera and view else "CAM" if view else "RES" if camera else "CAM+RES"
        for a in ALPHAS[:2]:
            names.setdefault((ruler, a), []).append(error(fit, r, a))
    got = {(r["ruler"], r["alpha"]): (r["n"], r["error"]) for r in heads.ruler_errors(spark.createDataFrame(rows, KINDS), ALPHAS[:2]).collect()}
    assert got.keys() == names.keys()
    assert all(got[k] == (len(v), pytest.approx(np.mean(v), abs=1e-9)) for k, v in names.items())


def test_whole_weights_are_repeated_rows(spark):
    rows = rows_of(3, conditions=("a|1",), missing=0)
    weight = np.random.default_rng(0).integers(1, 4, len(rows))
    once = spark.createDataFrame([(*r, int(w)) for r, w in zip(rows, weight, strict=True)], KINDS + ", weight int")
    again = spark.createDataFrame([r for r, w in zip(rows, weight, strict=True) for _ in range(w)], KINDS)
    got = {r["sample_id"]: r["emd"] for r in heads.family_out(once, (2.0,), weighted=True).collect()}
    assert got == pytest.approx({r["sample_id"]: r["emd"] for r in heads.family_out(again, (2.0,)).collect()}, abs=1e-9)
    x, y = arrays(rows)
    family = np.array([r[1] for r in rows])
    for r in rows:
        out = family != r[1]
        near = weighted_predict(x[out], y[out], weight[out].astype(float), np.array([r[3]]), 2.0)
        assert got[r[0]] == pytest.approx(float(emd(near, np.array([r[4]]))[0]), abs=1e-9)


def test_aggregation_arms_by_plain_fits(spark):
    rows = rows_of(4, conditions=("1", "2", "3"), missing=0.3)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    mean = {k: (k, v[0][1], "", np.mean([r[3] for r in v], axis=0), np.mean([r[4] for r in v], axis=0)) for k, v in by.items()}
    want = {}
    for k, own in by.items():
        fit = [m for m in mean.values() if m[1] != own[0][1]]
        want[k, "pooled"] = error(fit, mean[k], 3.0)
        out = [r for r in rows if r[1] != own[0][1]]
        (x, y), weight = arrays(out), np.array([1 / len(by[r[0]]) for r in out])
        w, new = weight / weight.sum(), np.array([r[3] for r in own])
        centre = w @ x
        spread, z_mean = np.sqrt(w @ (x - centre) ** 2), w @ y
        z = (x - centre) / spread
        basis = np.linalg.svd((y - z_mean) * np.sqrt(weight)[:, None], full_matrices=False)[2][:3]
        slope = np.linalg.solve((z * weight[:, None]).T @ z + 3.0 * np.eye(3), (z * weight[:, None]).T @ ((y - z_mean) @ basis.T)) @ basis
        raw = (new - centre) / spread @ slope + z_mean
        want[k, "raw"] = float(emd(heads.projected(raw.mean(axis=0)), mean[k][4]))
        want[k, "each"] = float(emd(heads.projected(raw).mean(axis=0), mean[k][4]))
    got = {(r["sample_id"], r["arm"]): r["emd"] for r in heads.aggregation_arms(spark.createDataFrame(rows, KINDS), 3.0).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_a_large_family_is_judged_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(heads, "BLOCK", 3)
    df = spark.createDataFrame(rows_of(5, families=3, entities=9, conditions=("a|1",), missing=0), KINDS)
    cut = {r["sample_id"]: r["emd"] for r in heads.family_out(df, ALPHAS).collect()}
    monkeypatch.undo()
    assert len(cut) == 27 and cut == pytest.approx({r["sample_id"]: r["emd"] for r in heads.family_out(df, ALPHAS).collect()}, abs=1e-9)


def test_empty_tables_and_rows_without_a_family(spark):
    df = spark.createDataFrame(rows_of(6), KINDS)
    none = df.where("false")
    assert heads.family_out(none, ALPHAS).count() == heads.ruler_errors(none, ALPHAS).count() == heads.aggregation_arms(none, 1.0).count() == 0
    assert heads.transfer(none, "a|1", "b|1", ALPHAS).count() == heads.transfer(df, "a|1", "none", ALPHAS).count() == 0
    odd = df.unionAll(df.where("condition = 'a|1'").limit(1).withColumn("family", F.lit(None).cast("string")).withColumn("sample_id", F.lit("x")))
    assert heads.family_out(odd.where("condition = 'a|1'"), (1.0,)).where("sample_id = 'x' and emd >= 0").count() == 1


def test_checks_in_the_plan(spark):
    from siltstone.operators import joins

    one, twice = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, 5), (1, 6)], "k int, u int")
    assert joins.matched_once(one, twice.where("u = 5"), ["k"]).collect() == [(1, "a", 5)]
    assert joins.matched_once(one, one.select("k"), ["k"]).columns == ["k", "v"]
    for bad in (joins.matched_once(one, twice, ["k"]), joins.matched_once(twice, one, ["k"])):
        with pytest.raises(Exception, match="a key occurs twice: 1"):
            bad.collect()
    assert joins.matched_all(one.where("k = 1"), twice, ["k"]).count() == 2
    with pytest.raises(Exception, match="no partner for 2"):
        joins.matched_all(one, twice, ["k"]).collect()


def test_learning_curve_by_plain_draws(spark):
    from siltstone.operators import evaluation

    rows = rows_of(7, families=4, entities=6, conditions=("a|1",), missing=0)
    df = spark.createDataFrame(rows, KINDS)
    place = {(r["family"], r["place"]): r["x"] for r in evaluation.family_places(df, 5).collect()}
    by_x = {tuple(r[3]): r for r in rows}
    names, want = sorted({r[1] for r in rows}), {}
    for size, (f, name) in itertools.product((5, 12), enumerate(names)):
        others, errors = [o for o in names if o != name], []
        for draw in range(3):
            took = np.random.default_rng([5, size, draw, f]).choice(18, size, replace=False)
            fit = [by_x[tuple(place[others[k // 6], k % 6])] for k in took]
            errors += [error(fit, r, 3.0) for r in rows if r[1] == name]
        want.setdefault(size, []).append(np.mean(errors))
    got = {r["n"]: r for r in evaluation.learning_curve(df, (5, 12, 40), draws=3, seed=5).collect()}
    assert set(got) == {5, 12}
    for size, m in want.items():
        assert got[size]["mean_emd"] == pytest.approx(np.mean(m), abs=1e-9) and got[size]["se"] == pytest.approx(np.std(m, ddof=1) / 2, abs=1e-9)


def test_alignment_arms(spark):
    from siltstone.operators import models

    r = np.random.default_rng(8)
    mix = r.normal(size=(3, 3))
    rows = [(k, f"e{k % 20}", "s" if k % 2 else "t", ((r.normal(size=3) @ mix + [5, 0, -2]) if k % 2 else r.normal(size=3) + [1, 1, 1]).tolist()) for k in range(600)]
    df = spark.createDataFrame(rows, "key int, entity string, side string, x array<double>")
    got = {x["arm"]: x for x in models.alignment_arms(df, "key", "entity", "side", "s", "t", "x", 3, shrink=0.0).collect()}
    s, t = (np.array([x for _, _, side, x in rows if side == name]) for name in "st")
    assert got["none"]["mean_gap"] == pytest.approx(np.linalg.norm(s.mean(axis=0) - t.mean(axis=0)))
    assert got["none"]["covariance_gap"] == pytest.approx(np.linalg.norm(np.cov(s.T, ddof=0) - np.cov(t.T, ddof=0))) == pytest.approx(got["mean"]["covariance_gap"])
    assert got["tile"]["mean_gap"] < 1e-9 > got["mean"]["mean_gap"] and got["tile"]["covariance_gap"] < 1e-9 and got["self"]["moved"] < 1e-9
    assert got["shuffled"]["mean_gap"] > 0.8 * got["none"]["mean_gap"] and got["entity"]["mean_gap"] < 1e-9


def test_merged_stages(spark):
    from siltstone.operators import joins

    first, second = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "x", 5), (3, "y", 6)], "k int, v string, u int")
    assert sorted(map(tuple, joins.merged_stages([first, second], "k").collect())) == [(1, "a", 5), (2, "b", None)]
    with pytest.raises(Exception, match="stage 2: a key occurs twice: 1"):
        joins.merged_stages([first, second.unionAll(second)], "k").collect()
