"""Operators against brute force, invariances and misuse."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.functions import curves, geometry, text
from siltstone.operators import aggregate, columns, contracts, evaluation, joins, models, pixels, resample
from siltstone.plans.stages import Stage, run
from siltstone.sources import io
from siltstone.streaming import events

X = np.array(curves.LOG_SUPPORT)


def random_design(n=30, families=6, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 5))
    y = np.sort(np.clip(50 + 20 * x[:, :1] + 15 * r.normal(size=(n, 11)), 0, 100), axis=1)
    y[:, -1] = 100
    return x, y, np.array([f"f{k % families}" for k in range(n)])


def as_frame(spark, x, y, family):
    return spark.createDataFrame([(f"s{k:02d}", family[k], x[k].tolist(), y[k].tolist()) for k in range(len(x))], "sample_id string, family string, x array<double>, y array<double>")


def test_curve_functions_agree_with_numpy(spark):
    _, y, _ = random_design()
    t = y.mean(axis=0)
    df = spark.createDataFrame([(k, v.tolist(), t.tolist()) for k, v in enumerate(y)], "k int, y array<double>, t array<double>").orderBy("k")
    got = df.select(curves.emd_trapezoid(F.col("y"), F.col("t")).alias("a"), curves.emd_left(F.col("y"), F.col("t")).alias("b")).toPandas()
    assert np.allclose(got["a"], np.trapezoid(np.abs(y - t), X, axis=1))
    assert np.allclose(got["b"], (np.abs(y - t)[:, :-1] * np.diff(X)).sum(axis=1))


def test_monotone_is_idempotent_and_valid(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(v.tolist(),) for v in r.normal(50, 60, (20, 11))], "y array<double>")
    once = df.select(curves.monotone(F.col("y")).alias("z"))
    rows = once.select("z", curves.monotone(F.col("z")).alias("again"), curves.valid(F.col("z")).alias("ok")).collect()
    assert all(row["z"] == row["again"] and row["ok"] for row in rows)


def test_diameter_and_curve_are_inverse(spark):
    y = [float(v) for v in (5, 10, 20, 30, 45, 60, 75, 85, 92, 97, 100)]
    df = spark.createDataFrame([(y,)], "y array<double>")
    for q in (7.0, 50.0, 99.0):
        d = df.select(curves.diameter_at(F.col("y"), q).alias("d")).first()["d"]
        assert df.select(curves.curve_at(F.col("y"), d).alias("v")).first()["v"] == pytest.approx(q)
    assert df.select(curves.diameter_at(F.col("y"), 1.0).alias("d")).first()["d"] == pytest.approx(X[0])


def test_two_stages_are_not_one(spark):
    rows = [("e", "a", 1.0), ("e", "a", 2.0), ("e", "a", 3.0), ("e", "b", 10.0)]
    df = spark.createDataFrame(rows, "entity string, item string, v double")
    assert aggregate.two_stage(df, ["item", "entity"], "entity", ["v"]).first()["v"] == 6.0
    assert df.groupBy("entity").agg(F.median("v").alias("v")).first()["v"] == 2.5


def test_guarded_median(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0), ("a", nan), ("a", 3.0), ("b", nan), ("c", None)], "k string, v double")
    got = {r["k"]: r["v"] for r in aggregate.guarded_median(df, ["k"], ["v"]).collect()}
    assert got["a"] == 2.0 and np.isnan(got["b"]) and np.isnan(got["c"])
    with pytest.raises(Exception, match="infinite value"):
        aggregate.guarded_median(df.union(spark.createDataFrame([("a", float("inf"))], df.schema)), ["k"], ["v"]).collect()


def test_joins_refuse_what_breaks_them(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    two = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "k int, w int")
    with pytest.raises(joins.ContractError):
        joins.one_to_one(one, two, ["k"])
    with pytest.raises(joins.ContractError):
        joins.no_loss(one, two.where("k = 1"), ["k"])
    assert joins.one_to_one(one, one.withColumn("u", F.lit(0)), ["k"]).columns == ["k", "v", "u"]


def test_audit_and_gate(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    report = contracts.audit(df, {"positive": F.col("v") > 0, "any": F.lit(True)})
    assert {r["check"]: r["n_bad"] for r in report.collect()} == {"positive": 2, "any": 0}
    with pytest.raises(joins.ContractError, match="positive"):
        contracts.gate(report)


def test_digest_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    a = df.agg(contracts.frame_digest(df)).first()[0]
    mixed = df.orderBy(F.desc("id")).repartition(3)
    assert a == mixed.agg(contracts.frame_digest(mixed)).first()[0]


def ridge(x, y, new, alpha, rank=3):
    """The fit in its plain form."""
    c, s, mean = x.mean(0), x.std(0), y.mean(0)
    v = np.linalg.svd(y - mean, full_matrices=False)[2][:rank]
    z = (x - c) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ ((y - mean) @ v.T))
    return evaluation.projected(((new - c) / s) @ w @ v + mean)


def test_protocols_against_loops(spark):
    x, y, family = random_design()
    alphas = (0.1, 3.0, 100.0)

    def out_errors(rows, a):
        return {i: evaluation.emd(ridge(x[[k for k in rows if family[k] != family[i]]], y[[k for k in rows if family[k] != family[i]]], x[[i]], a), y[[i]])[0] for i in rows}

    everyone = list(range(len(x)))
    strict = {}
    for f in sorted(set(family)):
        fit = [k for k in everyone if family[k] != f]
        best = min(alphas, key=lambda a: np.mean(list(out_errors(fit, a).values())))
        for i in set(everyone) - set(fit):
            strict[f"s{i:02d}"] = evaluation.emd(ridge(x[fit], y[fit], x[[i]], best), y[[i]])[0]
    design = as_frame(spark, x, y, family)
    got = {r["sample_id"]: r["emd"] for r in evaluation.strict_protocol(design, alphas).collect()}
    assert got.keys() == strict.keys() and all(got[k] == pytest.approx(strict[k], abs=1e-9) for k in got)
    table = {a: out_errors(everyone, a) for a in alphas}
    past = {r["sample_id"]: r["emd"] for r in evaluation.historical_protocol(design, alphas).collect()}
    for i in everyone:
        best = min(alphas, key=lambda a: np.mean([e for k, e in table[a].items() if family[k] != family[i]]))
        assert past[f"s{i:02d}"] == pytest.approx(table[best][i], abs=1e-9)
    fixed = evaluation.fixed_protocol(design, 3.0).agg(F.avg("emd")).first()[0]
    assert fixed == pytest.approx(np.mean(list(table[3.0].values())), abs=1e-9)


def test_floors_fall_with_rank_and_reach_zero(spark):
    _, y, family = random_design()
    df = as_frame(spark, y[:, :5], y, family)
    floors = [r["bare"] for r in models.rank_floors(df, "y", 11, (1, 2, 4, 10)).orderBy("rank").collect()]
    assert floors == sorted(floors, reverse=True) and floors[-1] == pytest.approx(0, abs=1e-6)


def test_coral_matches_the_target(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=(400, 3)) @ r.normal(size=(3, 3)), r.normal(size=(400, 3)) @ r.normal(size=(3, 3)) + 5
    frame = lambda m: spark.createDataFrame([(v.tolist(),) for v in m], "x array<double>")
    t, shift = models.coral(frame(a), frame(b), "x", 3, shrink=0.0)
    moved = np.array([row[0] for row in models.transformed(frame(a), "x", t, shift, "z").select("z").collect()])
    assert np.allclose(moved.mean(0), b.mean(0)) and np.allclose(np.cov(moved.T), np.cov(b.T))


def test_linkage_against_plain_average_linkage(spark):
    _, y, family = random_design(20)
    got = {r["sample_id"]: r["family_"] for r in models.linkage_families(as_frame(spark, y[:, :5], y, family).select("sample_id", "y"), "sample_id", "y", 12.0).withColumnRenamed("family", "family_").collect()}
    groups = [[k] for k in range(20)]
    d = lambda a, b: np.mean([evaluation.emd(y[i], y[j]) for i in a for j in b])
    while len(groups) > 1:
        gap, i, j = min((d(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        if gap > 12.0:
            break
        groups[j] += groups.pop(i)
    same = {frozenset(g) for g in groups}
    ours = pd.Series(got).sort_index().reset_index(drop=True)
    assert {frozenset(g.index) for _, g in ours.groupby(ours)} == same


def test_linkage_in_rounds_gives_the_families_of_one_matrix(spark):
    from siltstone.operators import linkage

    curves = np.sort(np.random.default_rng(8).uniform(0, 100, (40, 11)), axis=1)
    curves[:, -1] = 100.0
    y = curves[np.arange(90) % 40]  # some curves twice, some three times
    df = spark.createDataFrame([(f"k{i:02d}", v.tolist()) for i, v in enumerate(y)] + [("none", None)], "k string, y array<double>")
    d = np.stack([evaluation.emd(y, v) for v in y])
    root = linkage.merged(d, np.ones(90), 40.0)
    family = {r: n for n, r in enumerate(np.unique(root), 1)}
    got = {r["k"]: r["family"] for r in models.linkage_families(df, "k", "y", 40.0, most=12).collect()}
    assert 1 < len(family) < 12 and got == {f"k{i:02d}": family[r] for i, r in enumerate(root)} | {"none": None}


def test_linkage_of_many_rounds_ends(spark):
    began = time.monotonic()
    v = 2.2 ** np.arange(20)  # only the two smallest are each other's nearest, so each round merges one pair
    df = spark.createDataFrame([(k, [float(x)] * 10 + [100.0]) for k, x in enumerate(v)], "k int, y array<double>")
    got = {r["k"]: r["family"] for r in models.linkage_families(df, "k", "y", 5 * v[17], most=1).collect()}
    assert got == {k: max(1, k - 16) for k in range(20)}
    assert time.monotonic() - began < 200  # planning took twice as long with each round


def test_linkage_finds_the_nearest_from_brackets():
    from siltstone.operators import linkage

    r = np.random.default_rng(4)

    def clusters(size):
        at = np.cumsum(size) - size
        n = r.integers(1, 4, size.sum()).astype(float)
        z = np.sort(r.integers(0, 12, (size.sum(), 11)) * 4.0, axis=1) * linkage.WEIGHTS  # whole numbers, so that distances tie
        one = linkage.Clusters(z, n / np.repeat(np.add.reduceat(n, at), size), at)
        return one._replace(inner=linkage.halves(one))

    def plain(one, other):
        d = np.abs(one.z[:, None] - other.z[None]).sum(axis=2) * one.w[:, None] * other.w[None]
        return np.add.reduceat(np.add.reduceat(d, one.at, axis=0), other.at, axis=1)

    for low, high in ((1, 2), (1, 5), (1, 90)):
        one, other = clusters(r.integers(low, high, 40)), clusters(r.integers(low, high, 50))
        want, c, c2 = plain(one, other), np.arange(0, 80, 2), np.arange(1, 101, 2)
        assert np.allclose(linkage.average_distances(one, other), want, atol=1e-8)
        for i, j, t, width in linkage.bracketed(one, other):
            assert (t <= want[i:j] + 1e-3).all() and (want[i:j] <= t + width).all()
        got = linkage.nearest(c, one, c2, other)
        assert (got[0] == c).all() and (got[1] == c2[want.round(9).argmin(axis=1)]).all() and np.allclose(got[2], want.min(axis=1), atol=1e-8)
        same = plain(one, one).round(9)
        np.fill_diagonal(same, np.inf)
        assert (linkage.nearest(c, one, c, one)[1] == c[same.argmin(axis=1)]).all()


def test_least_squares(spark):
    r = np.random.default_rng(0)
    m = r.normal(size=(50, 2))
    df = spark.createDataFrame([(float(a), float(b), float(3 + 2 * a - b)) for a, b in m], "a double, b double, y double")
    assert {x["term"]: round(x["weight"], 6) for x in models.least_squares(df, ["a", "b"], "y").collect()} == {"constant": 3.0, "a": 2.0, "b": -1.0}


def test_bootstrap_brackets_the_mean_and_repeats(spark):
    df = spark.createDataFrame([(f"c{k % 7}", float(k % 5)) for k in range(70)], "c string, v double")
    a, b = (evaluation.cluster_bootstrap(df, "c", "v", draws=3000).first() for _ in range(2))
    assert a == b and a["lo"] <= a["mean"] <= a["hi"]


def test_pixel_kernels():
    flat, half = np.full((16, 16), 7.0), np.repeat([[10.0, 200.0]], 16, axis=0).repeat(8, axis=1)
    assert pixels.otsu(flat) == 7.0 and 10 < pixels.otsu(half) < 200
    assert np.allclose(pixels.blurred(flat, 2.0), flat) and pixels.octaves(flat) == [0.0] * 4
    stripes = np.tile(np.sin(np.arange(64) * 2 * np.pi / 8) * 50 + 100, (64, 1))
    assert pixels.radial_spectrum(stripes).argmax() == 4  # period 8 is a quarter of the range to 1/2
    assert np.isnan(pixels.correlation_ratio(flat))


def test_bad_shapes_have_a_status(spark):
    df = spark.createDataFrame([("a", 2, 2, [1.0, 2.0, 3.0, 4.0]), ("b", 2, 2, [1.0]), ("c", 2, 2, None)], "image_id string, h int, w int, pixels array<double>")
    assert {r["image_id"]: r["status"] for r in pixels.features(df).collect()} == {"a": "ok", "b": "bad_shape", "c": "bad_shape"}


def test_text_and_geometry(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(text.slug(F.lit(" Münster  BS-69 (1) "))) == "Muenster_BS_69_1"
    assert value(text.norm_key(F.lit("Münster BS 6,9/0-10m"))) == "muensterbs69010m"
    assert value(text.trailing_index(F.lit("a (12)"))) == 12 and value(text.trailing_index(F.lit("a"))) is None
    assert value(text.json_object(F.lit('ok ```json\n{"a": 1}``` {"b": 2}'))) == '{"a": 1}'
    assert [value(geometry.half_even(F.lit(x))) for x in (0.5, 1.5, 2.5, 2.4, -0.5)] == [0, 2, 2, 2, 0]
    assert [round(value(c), 3) for c in geometry.lab(F.lit(255.0), F.lit(255.0), F.lit(255.0))] == [100.0, 0.0, 0.0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,0.1\n2,NaN\n")
    assert io.csv_columns(spark, str(tmp_path / "a.csv")) == ["k", "v"]
    assert io.csv(spark, str(tmp_path / "a.csv"), "k int, v double").agg(F.sum("k")).first()[0] == 3
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{broken\n')
    assert io.jsonl(spark, str(tmp_path / "a.jsonl"), "k int").where("k = 1").count() == 1
    assert io.files(spark, str(tmp_path), "*.csv").count() == 1
    with pytest.raises(PermissionError):
        io.write(spark.range(1), "/data/raw/x", ["/data/raw"])


def test_stages_run_again_only_when_settings_change(spark, tmp_path):
    made = []

    def step(name):
        return lambda results: made.append(name) or results["start"].withColumn(name, F.lit(1))

    chain = lambda n: [Stage("one", step("one"), {"n": n}), Stage("two", step("two"))]
    for n in (1, 1, 2):
        run(spark, str(tmp_path), {"start": spark.range(3)}, chain(n))
    assert made == ["one", "two", "one", "two"]


def test_stream_agrees_with_batch(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    batch = spark.read.parquet(f"{sf}/events.parquet").coalesce(1)
    batch.write.mode("overwrite").parquet(str(tmp_path / "in"))
    query = events.write_available(events.windowed(events.stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in events.windowed(batch).collect()}
    assert got and all(want[k] == n for k, n in got.items())  # windows still open at the end aren't written
    assert events.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_permutations_keep_marginals(spark):
    df = spark.createDataFrame([(k, k * 10, k * 100) for k in range(300)], "k int, a int, b int")
    whole = resample.row_permutation(df, "k", ["a", "b"], 3).orderBy("k").toPandas()
    assert whole["k"].tolist() == list(range(300)) and sorted(whole["a"]) == [k * 10 for k in range(300)]
    assert (whole["b"] == 10 * whole["a"]).all() and (whole["a"] != 10 * whole["k"]).mean() > 0.9
    again = resample.row_permutation(df.repartition(7), "k", ["a", "b"], 3).orderBy("k").toPandas()
    assert again.equals(whole)
    apart = resample.column_shuffle(df, "k", ["a", "b"], 3).toPandas()
    assert sorted(apart["b"]) == [k * 100 for k in range(300)] and (apart["b"] == 10 * apart["a"]).mean() < 0.1


def test_contrasts(spark):
    df = spark.createDataFrame([("s1", "x", 1.0), ("s1", "y", 3.0), ("s2", "x", 2.0), ("s2", "y", 2.0), ("s3", "x", 5.0)], "s string, arm string, e double")
    row = resample.contrasts(df, "s", "arm", "e", [("x", "y")]).first()
    assert (row["n"], row["estimate"], row["wins_a"], row["wins_b"], row["verdict"]) == (2, -1.0, 1, 0, "A")


def test_json_candidates(spark):
    df = spark.createDataFrame([('a {"k": {"z": 1}} b {"k": 2.5} {"k": NaN}',), ("none } {",), (None,)], "t string")
    got = df.select(text.json_candidates("t").alias("c")).select("c", text.first_valid(F.col("c"), "k double", ["k"]).alias("f")).collect()
    assert got[0]["c"] == ['{"k": {"z": 1}}', '{"k": 2.5}', '{"k": NaN}'] and got[0]["f"]["k"] == 2.5
    assert got[1]["c"] == [] and got[1]["f"] is None and got[2]["c"] == []


def test_weights_act_like_repeated_rows():
    x, y, _ = random_design(12)
    weight = np.array([1.0, 2.0] * 6)
    rows = np.repeat(np.arange(12), weight.astype(int))
    assert np.allclose(evaluation.weighted_predict(x, y, weight, x[:3], 2.0), evaluation.predict(x[rows], y[rows], x[:3], (2.0,))[0])


def test_no_task_holds_a_whole_design(spark):
    x, y, family = random_design(40, 8)
    x[:, 0] = 5.0
    few = as_frame(spark, x, y, family)
    for run in (evaluation.strict_protocol, evaluation.historical_protocol, evaluation.fixed_protocol):
        out = run(few)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and "Join" not in plan and "CartesianProduct" not in plan
        assert out.count() == 40
        got = {r["sample_id"]: r for r in out.collect()}
        for i in range(40):
            held = family == family[i]
            near = evaluation.predict(x[~held], y[~held], x[[i]], (got[f"s{i:02d}"]["alpha"],))[0]
            assert got[f"s{i:02d}"]["emd"] == pytest.approx(evaluation.emd(near, y[[i]])[0], abs=1e-8)


def test_permutations_are_drawn_by_spark(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 40, 300).astype(float)
    y = x + r.integers(0, 30, 300)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k int, x double, y double")
    out = evaluation.permutation_null(df, "k", "x", "y", shuffles=60)
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["shuffle"]: r["rho"] for r in out.collect()}
    assert sorted(got) == list(range(61)) and len(set(got.values())) == 61
    assert got[0] == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank()), abs=1e-9)
    null = np.array([got[k] for k in range(1, 61)])
    assert abs(null.mean()) < 0.03 and 0.03 < null.std() < 0.09


def test_learning_curve_of_all_other_rows_is_the_fixed_protocol(spark):
    x, y, family = random_design(40, 8)
    design = as_frame(spark, x, y, family)
    n = int((family != family[0]).sum())
    fixed = evaluation.fixed_protocol(design, 3.0).groupBy("family").agg(F.avg("emd").alias("m"), F.count(F.lit(1)).alias("c")).where(F.col("c") == 40 - n).agg(F.avg("m")).first()[0]
    got = {r["n"]: r for r in evaluation.learning_curve(design, (n, 41), draws=2).collect()}
    assert set(got) == {n}
    if len({int((family == f).sum()) for f in set(family)}) == 1:
        assert got[n]["mean_emd"] == pytest.approx(fixed, abs=1e-8)


def test_learning_curve_falls(spark):
    x, y, family = random_design(40, 8)
    got = evaluation.learning_curve(as_frame(spark, x, y, family), (8, 30), draws=6).orderBy("n").collect()
    assert got[1]["mean_emd"] < got[0]["mean_emd"]


def test_one_standard_error(spark):
    curve = spark.createDataFrame([(0.1, 5.0, 1.0), (1.0, 4.0, 1.0), (10.0, 4.9, 1.0), (100.0, 6.0, 1.0)], "alpha double, mean double, se double")
    assert evaluation.one_se_alpha(curve).first()["alpha"] == 10.0


def test_spatial_kernels():
    r = np.random.default_rng(0)
    noise = r.random((48, 48)) * 255
    stripes = np.tile(np.sin(np.arange(48) / 2) * 100 + 120, (48, 1))
    assert abs(pixels.structure_ratio(noise)) < 1 < pixels.structure_ratio(stripes)
    assert pixels.variogram_range(noise) == 1.0 < pixels.variogram_range(pixels.blurred(noise, 3.0))
    mixed = pixels.phase_scrambled(stripes, 1)
    assert np.allclose(np.sort(mixed.ravel()), np.sort(stripes.ravel()))
    mask = np.zeros((9, 9), bool)
    mask[1:4, 1:4] = mask[7, 7] = True
    assert pixels.largest_region(mask).sum() == 9 and not pixels.largest_region(mask)[7, 7]
    disc = np.hypot(*np.mgrid[-16:16, -16:16]) < 9
    assert abs(pixels.soil_mask(np.where(disc, 200.0, 20.0)).sum() - disc.sum()) < 0.2 * disc.sum()


def test_column_choices(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert columns.varying(df, ["a", "b"]) == ["a"]
    assert [tuple(r) for r in columns.standardised(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_sinks_and_listings(spark):
    df = spark.createDataFrame([(1, 0.5)], "k int, v double")
    assert io.strict_json(df).first()[0] == '{"k":1,"v":0.5}' and io.markdown(df).splitlines()[2] == "| 1 | 0.5 |"
    with pytest.raises(Exception, match="not finite"):
        io.strict_json(df.withColumn("v", F.lit(float("nan")))).collect()
    paths = spark.createDataFrame([("/a/b/c.csv",), ("/z/c.csv",), ("/c.txt",)], "path string")
    assert io.shallowest(paths, "c.csv").first()[0] == "/z/c.csv" and io.shallowest(paths, "d").count() == 0
    assert io.stale(paths, paths.where("path like '%csv'")).first()[0] == "/c.txt"


def test_simplex_and_weibull(spark):
    assert np.allclose(models.simplex(lambda p: (p[0] - 2) ** 2 + 3 * (p[1] + 1) ** 2, np.zeros(2)), [2, -1], atol=1e-3)
    y = spark.range(1).select(curves.weibull(F.lit(-1.2), F.lit(0.8)).alias("y")).first()["y"]
    df = spark.createDataFrame([(1, y, -1.0, 1.0)], "k int, y array<double>, l double, s double")
    assert models.weibull_fit(df, "k", "y", "l", "s").first()["emd"] < 1e-3


def test_weibull_of_steep_and_coarse_curves(spark):
    true = [(0, -1.2, 0.8), (1, 2.9, 4.5), (2, 4.5, 2.5), (3, -5.0, 0.2)]
    df = spark.createDataFrame(true, "k int, l double, s double").withColumn("y", curves.monotone(curves.weibull(F.col("l"), F.col("s"))))
    got = {r["k"]: r for r in models.weibull_oracle(df, "k", "y").collect()}
    for k, scale, shape in true:
        assert got[k]["emd"] < 1e-6
        assert got[k]["log_scale"] == pytest.approx(scale, abs=1e-4) and got[k]["shape"] == pytest.approx(shape, abs=1e-4)
    assert models.weibull_oracle(df.coalesce(1), "k", "y").rdd.getNumPartitions() > 1


def test_minima_found_side_by_side(spark):
    goals = np.random.default_rng(4).normal(size=(50, 2))
    bowl = lambda p, which: ((p - goals[which]) ** 2 * [1, 3]).sum(axis=1)
    starts = np.vstack([np.zeros((25, 2)), np.full((25, 2), 5.0)])
    value, point = models.nelder_mead(bowl, starts, 1e-10, 1e-12, 4000)
    assert value.max() < 1e-12 and np.allclose(point, goals, atol=1e-6)
    alone = [models.nelder_mead(lambda p, which, k=k: bowl(p, np.full(len(p), k)), starts[k : k + 1], 1e-10, 1e-12, 4000) for k in (0, 30)]
    assert [v[0] for v, _ in alone] == value[[0, 30]].tolist() and (np.vstack([p for _, p in alone]) == point[[0, 30]]).all()


def test_kmeans_of_least_cost(spark):
    r = np.random.default_rng(2)
    rows = [(k % 6, [float(v) for v in 50 * np.array([(k % 6) % 3, (k % 6) // 3]) + r.normal(size=2)]) for k in range(120)]
    df = spark.createDataFrame(rows, "label int, v array<double>")
    assert models.kmeans_purity(df, "v", "label", 6, starts=8).first()["purity"] == 1.0


def test_learning_curve_query_runs_all_sizes_and_draws(spark, sf, monkeypatch):
    from siltstone.operators import evaluation as module
    from siltstone.plans.queries import QUERIES

    asked = {}
    monkeypatch.setattr(module, "learning_curve", lambda design, sizes, draws=120, **more: asked.update(sizes=tuple(sizes), draws=draws))
    QUERIES["learning_curve"](spark, sf)
    assert asked == {"sizes": (4, 6, 8, 10, 12, 14, 16, 18, 20, 21), "draws": 120}


def test_ridge_against_numpy(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(60, 3)), r.normal(size=60)
    x[:, 2] = 4.0
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    got = {k: v for k, v in models.ridge(df, ["a", "b", "c"], "y", 2.5).collect()}
    z = (x[:, :2] - x[:, :2].mean(axis=0)) / x[:, :2].std(axis=0)
    w = np.linalg.solve(z.T @ z + 2.5 * np.eye(2), z.T @ (y - y.mean()))
    assert (got["a"], got["b"], got["c"], got["mean"]) == pytest.approx((*w, 0.0, y.mean()))


def plain_ledoit_wolf(x):
    n, p = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = sum(((np.outer(v, v) - s) ** 2).sum() for v in x) / n**2 / p
    weight = min(beta, delta) / delta
    return (1 - weight) * s + weight * mu * np.eye(p), weight


def test_alignment_carries_covariances(spark):
    r = np.random.default_rng(5)
    a, b = r.normal(size=(40, 4)) @ r.normal(size=(4, 4)), r.normal(size=(30, 4)) * [1, 2, 3, 4] + 7
    frame = lambda m: spark.createDataFrame([(v.tolist(),) for v in m], "v array<double>")
    mean, c, weight = models.ledoit_wolf(frame(a), "v", 4)
    plain, plain_weight = plain_ledoit_wolf(a)
    assert np.allclose(c, plain) and weight == pytest.approx(plain_weight) and np.allclose(mean, a.mean(axis=0))
    t, shift = models.coral(frame(a), frame(b), "v", 4, shrink=None)
    assert np.allclose(t.T @ plain @ t, plain_ledoit_wolf(b)[0])
    itself = models.coral(frame(a), frame(a), "v", 4, shrink=None)
    assert models.transform_distance(itself, (np.eye(4), np.zeros(4))) < 1e-9
    only = models.coral(frame(a), frame(b), "v", 4, match_covariance=False)
    assert np.allclose(only[0], np.eye(4)) and np.allclose(only[1], b.mean(axis=0) - a.mean(axis=0))


def test_fusion_refuses_misuse(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, a double")
    good = spark.createDataFrame([(2, 3.0), (1, 4.0)], "k int, b double")
    assert sorted(map(tuple, joins.fused([a, good], "k").collect())) == [(1, 1.0, 4.0), (2, 2.0, 3.0)]
    with pytest.raises(joins.ContractError, match="share"):
        joins.fused([a, a], "k")
    for rows in ([(1, 1.0)], [(1, 1.0), (2, float("nan"))], [(1, 1.0), (2, None)], [(1, 1.0), (2, 2.0), (2, 3.0)]):
        with pytest.raises(Exception, match="fit together"):
            joins.fused([a, spark.createDataFrame(rows, "k int, b double")], "k").collect()
    with pytest.raises(Exception, match="no b for key 1"):
        joins.left_checked(a, good.where("k = 2"), ["k"], ["b"]).collect()


def test_transfer_never_scores_what_it_fitted(spark):
    rows = spark.createDataFrame([("s1", "f1", "A", 1.0), ("s1", "f1", "B", 2.0), ("s2", "f2", "A", 5.0), ("s3", "f3", "B", 9.0)], "e string, f string, c string, v double")
    got = {r["e"]: (r["fold"], r["error"]) for r in evaluation.transfer_errors(rows, "e", "f", "c", "v", "A", "B").collect()}
    assert got == {"s1": ("f1", 3.0), "s3": (evaluation.UNSEEN, 6.0)}


def test_small_report_checks():
    report = {"a": [1.0, float("nan")], "b": {"c": float("inf"), "d": "x"}, "e": 2}
    assert contracts.nonfinite_paths(report) == ["$.a[1]", "$.b.c"]


def test_blindness_sees_nested_columns(spark):
    df = spark.sql("select 1 as a, struct('x' as camera, 2 as n) as meta, array(struct(3 as gps)) as more")
    assert contracts.exposed(df, ["camera", "gps"]) == ["meta.camera", "more.gps"]
    assert contracts.without(df, ["meta", "nothing"]).columns == ["a", "more"]


def test_best_of_many_arms_without_effect(spark):
    r = np.random.default_rng(9)
    rows = [(k, a, float(v)) for k, row in enumerate(r.normal(size=(200, 5))) for a, v in enumerate(row)]
    one = evaluation.best_of_null(spark.createDataFrame(rows, "draw int, arm int, gain double"), "draw", "arm", "gain", 1.0).first()
    best = np.array([v for *_, v in rows]).reshape(200, 5).max(axis=1)
    assert one["p95"] == pytest.approx(np.quantile(best, 0.95)) and one["share_at_least"] == pytest.approx((best >= 1.0).mean()) and one["draws"] == 200


def test_soil_region_and_crop():
    r = np.random.default_rng(3)
    a = np.full((64, 64), 20.0) + r.normal(size=(64, 64))
    a[8:56, 8:56] += 150  # bright square
    a[30:34, 30:34] = 20  # a hole
    a[2, 60] = 250  # a speckle
    mask = pixels.soil_region(a)
    assert mask[30:34, 30:34].all() and mask[12:52, 12:52].mean() > 0.95 and not mask[2, 60] and not mask[:5].any()
    x0, y0, x1, y1, share, status = pixels.crop_box(mask)
    assert status == "ok" and share > 0.85 and 4 <= x0 <= 14 and 50 <= x1 <= 60 and 4 <= y0 <= 14 and 50 <= y1 <= 60
    small = np.zeros((64, 64), bool)
    small[20:44, 20:44] = True
    assert pixels.crop_box(small) == (0, 0, 64, 64, small.mean(), "fallback_fullframe")
    wide = np.ones((64, 64), bool)
    wide[:, 40:] = False
    assert pixels.crop_box(wide)[:4] == (0, 0, 45, 45) and pixels.crop_box(wide)[5] == "capped"
    assert pixels.crop_box(np.ones((8, 8), bool)) == (0, 0, 8, 8, 1.0, "ok")
    assert not pixels.soil_region(np.full((16, 16), 7.0)).any()


def test_mask_steps_against_brute_force():
    r = np.random.default_rng(4)
    mask = r.random((17, 13)) < 0.5
    near = [(y, x) for y in range(-2, 3) for x in range(-2, 3) if y * y + x * x <= 4]
    at = lambda y, x: 0 <= y < 17 and 0 <= x < 13 and bool(mask[y, x])
    for every, take in ((True, all), (False, any)):
        plain = [[take(at(y + a, x + b) for a, b in near) for x in range(13)] for y in range(17)]
        assert (pixels.swept(mask, 2, every) == np.array(plain)).all()
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert pixels.filled(ring).sum() == 25
    ring[2, 4] = ring[3, 4] = False  # a way out
    assert pixels.filled(ring).sum() == 22
    assert pixels.largest_region(ring, 0.9).sum() == 22


def test_contrast_across_directions():
    y, x = np.mgrid[:32, :32]
    stripes = np.where((x - y) % 6 < 3, 200.0, 10.0)  # equal along 45 degrees
    everywhere = np.ones((32, 32), bool)
    got = pixels.diagonal_contrast(stripes, everywhere, 3)
    mad = np.median(np.abs(stripes - np.median(stripes)))
    share = lambda p, q: (np.abs(p - q) > mad + 1e-12).mean()
    four = share(stripes[:, 3:], stripes[:, :-3]), share(stripes[3:], stripes[:-3]), share(stripes[3:, 3:], stripes[:-3, :-3]), share(stripes[3:, :-3], stripes[:-3, 3:])
    assert got == pytest.approx(np.mean(four) - four[2])
    assert np.isnan(pixels.diagonal_contrast(stripes, x < 2, 3)) and np.isnan(pixels.diagonal_contrast(stripes, x < 0, 3))
    assert pixels.centre_crop(stripes[:31], 30).shape == (28, 28) and pixels.psnr(stripes, stripes) == pytest.approx(10 * np.log10(255**2 / 1e-9))


def test_crops_of_odd_images(spark):
    rows = [("a", 8, 8, [5.0] * 64), ("b", 8, 8, [1.0]), ("c", 8, 8, None)]
    got = {r["image_id"]: r["status"] for r in pixels.crops(spark.createDataFrame(rows, "image_id string, h int, w int, pixels array<double>")).collect()}
    assert got == {"a": "fallback_fullframe", "b": "bad_shape", "c": "bad_shape"}


def test_polynomial_map_is_numpys(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=50)
    y = np.stack([1 + 2 * v - v**3 + r.normal(size=50), v**2], axis=1)
    df = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(v, y, strict=True)] + [(None, [1.0, 2.0])], "v double, y array<double>")
    for degree in (1, 2, 3):
        got = {(p, k): x for p, k, x in models.polynomial_map(df, "v", "y", 2, degree).collect()}
        for place in (0, 1):
            assert np.allclose([got[place, k] for k in range(degree + 1)], np.polyfit(v, y[:, place], degree)[::-1])


def test_inverse_root_curve_finds_its_terms(spark):
    rows = [(n, 3 + 5 / n + 2 / n**0.5) for n in (4, 6, 9, 16, 25, 36)]
    one = evaluation.inverse_root_curve(spark.createDataFrame(rows, "n int, e double"), "n", "e", 100.0).first()
    assert np.allclose(tuple(one), (3, 5, 2, 1, 3 + 0.05 + 0.2))


def test_mixtures_have_unit_length():
    w = models.mixture(7, 3, 11)
    assert w.shape == (7, 3) and np.allclose((w**2).sum(axis=0), 1) and (w == models.mixture(7, 3, 11)).all()


def test_csv_and_json_lines_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, 0.5, "y,z")], "a int, b double, c string")
    io.write_csv(df, str(tmp_path / "t"), ["c", "b", "a"])
    lines = sorted(line for f in (tmp_path / "t").glob("*.csv") for line in f.read_text().split("\n") if line and not line.startswith("c,"))
    assert lines == ['"y,z",0.5,2', "x,NaN,1"] and io.csv_columns(spark, str(tmp_path / "t")) == ["c", "b", "a"]
    for _ in range(2):
        io.append_jsonl(df, str(tmp_path / "j"))
    assert io.jsonl(spark, str(tmp_path / "j"), "a int, b double").count() == 4
    with pytest.raises(PermissionError):
        io.write_csv(df, str(tmp_path / "t"), ["a"], [str(tmp_path)])


@pytest.mark.parametrize("accuracy", [5, 100, 10_000])
def test_census_by_counted_surroundings(spark, accuracy):
    r = np.random.default_rng(6)
    odd = [None, float("nan"), float("inf"), -float("inf")]
    a, b = r.lognormal(size=997), r.integers(0, 7, 997).astype(float)
    rows = [(float(x), float(y), None) for x, y in zip(a, b, strict=True)] + [(v, v, v) for v in odd]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    got = {r["column"]: tuple(r)[1:] for r in columns.census(df, ["a", "b", "c"], accuracy).collect()}
    for name, v in (("a", a), ("b", b)):
        assert got[name] == pytest.approx((1001, 1, 1, 2, *np.quantile(v, [0.05, 0.5, 0.95])), rel=1e-12)
    assert got["c"] == (1001, 998, 1, 2, None, None, None)


def test_quantiles_whatever_the_surroundings(spark):
    v = np.random.default_rng(7).normal(size=500)
    df = spark.createDataFrame([(float(x),) for x in v], "a double").repartition(3)
    for near in ([-9.0, -8.0], [8.0, 9.0], [float(np.median(v))] * 2, [-9.0, 9.0], [9.0, -9.0]):
        assert columns.exact_quantiles(df, ["a"], [500], [near], [0.5]) == [[pytest.approx(np.median(v), rel=1e-12)]]


def test_kmeans_starts_run_side_by_side(spark, monkeypatch):
    import threading

    from pyspark.ml.clustering import KMeans

    seen, fit = set(), KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, data: seen.add(threading.get_ident()) or fit(self, data))
    df = spark.createDataFrame([(k % 2, [float(k % 2), 0.1 * (k % 3)]) for k in range(24)], "label int, v array<double>")
    kept = len(spark.sparkContext._jsc.getPersistentRDDs())
    assert models.kmeans_purity(df, "v", "label", 2, starts=4).first()["purity"] == 1.0
    assert len(seen) > 1 and len(spark.sparkContext._jsc.getPersistentRDDs()) <= kept
