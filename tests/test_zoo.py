"""Heads from moments against plain numpy on the fold's own rows."""

import numpy as np
import pytest

from siltstone.operators import heads, zoo
from siltstone.operators.evaluation import predict
from siltstone.operators.heads import emd, projected


def sample(seed=0, n=48, k=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, k)) * [1, 5, 0.2, 2, 1][:k] + 3
    y = np.maximum.accumulate(np.clip(np.linspace(5, 95, 11) + 6 * x[:, [0]] - 3 * x[:, [1]] / 5 * np.linspace(1, 0, 11) + 4 * r.normal(size=(n, 11)), 0, 100), axis=1)
    y[:, -1] = 100
    return x, y, np.array([f"f{i % 6}" for i in range(n)])


def frame(spark, x, y, family):
    return spark.createDataFrame([(f"s{i}", str(f), a.tolist(), b.tolist()) for i, (a, b, f) in enumerate(zip(x, y, family, strict=True))], "sample_id string, family string, x array<double>, y array<double>")


def nipals(x, y, new, components):
    """Partial least squares on rows: scores found by iteration, both blocks deflated."""
    sx, sy = x.std(axis=0), y.std(axis=0)
    sy[sy == 0] = 1
    a, b, turn = (x - x.mean(axis=0)) / sx, (y - y.mean(axis=0)) / sy, []
    for _ in range(components):
        u = b[:, b.std(axis=0).argmax()]
        for _ in range(5_000):
            w = a.T @ u
            w /= np.linalg.norm(w)
            t = a @ w
            q = b.T @ t / (t @ t)
            u = b @ q / (q @ q)
        p = a.T @ t / (t @ t)
        a, b = a - np.outer(t, p), b - np.outer(t, q)
        turn.append((w, p, q))
    w, p, q = (np.array(v).T for v in zip(*turn, strict=True))
    return (new - x.mean(axis=0)) / sx @ (w @ np.linalg.inv(p.T @ w) @ q.T) * sy + y.mean(axis=0)


def evidence(x, y, new):
    """Bayesian ridge of each leading component on rows."""
    s = x.std(axis=0)
    z, zn, m = (x - x.mean(axis=0)) / s, (new - x.mean(axis=0)) / s, y.mean(axis=0)
    basis, out = np.linalg.svd(y - m, full_matrices=False)[2][:3], m
    for b in basis:
        t = (y - m) @ b
        noise, prior, last = 1 / (t.var() + np.finfo(float).eps), 1.0, None
        solve = lambda: np.linalg.solve(noise * z.T @ z + prior * np.eye(z.shape[1]), noise * z.T @ t)  # noqa: B023, E731
        for _ in range(300):
            w, values = solve(), np.linalg.eigvalsh(z.T @ z)
            known = (noise * values / (prior + noise * values)).sum()
            prior, noise = (known + 2e-6) / (w @ w + 2e-6), (len(t) - known + 2e-6) / (((t - z @ w) ** 2).sum() + 2e-6)
            if last is not None and np.abs(last - w).sum() < 1e-3:
                break
            last = w
        out = out + np.outer(zn @ solve(), b)
    return out


def test_linear_heads(spark):
    x, y, family = sample()
    solvers = {"pls 2": zoo.pls(2), "pls 3": zoo.pls(3), "bayes": zoo.bayesian_ridge()}
    got = {(r["sample_id"], r["head"]): r["emd"] for r in zoo.linear_errors(frame(spark, x, y, family), solvers, (3.0,)).collect()}
    assert len(got) == 4 * len(x)
    for f in sorted(set(family)):
        fit, held = family != f, np.flatnonzero(family == f)
        near = {"pls 2": nipals(x[fit], y[fit], x[held], 2), "pls 3": nipals(x[fit], y[fit], x[held], 3), "bayes": evidence(x[fit], y[fit], x[held]), "ridge 3": predict(x[fit], y[fit], x[held], (3.0,))[0]}
        for head, p in near.items():
            for i, e in zip(held, emd(projected(p), y[held]), strict=True):
                assert got[f"s{i}", head] == pytest.approx(e, abs=1e-6)


def test_all_components_of_partial_least_squares_are_least_squares(spark):
    x, y, family = sample(2)
    got = {r["sample_id"]: r["emd"] for r in zoo.linear_errors(frame(spark, x, y, family), {"pls": zoo.pls(5)}).collect()}
    for f in sorted(set(family)):
        fit, held = family != f, np.flatnonzero(family == f)
        one = lambda a: np.column_stack([a, np.ones(len(a))])
        near = one(x[held]) @ np.linalg.lstsq(one(x[fit]), y[fit], rcond=None)[0]
        assert [got[f"s{i}"] for i in held] == pytest.approx(emd(projected(near), y[held]), abs=1e-7)


def test_kernel_ridge_by_landmarks(spark):
    x, y, family = sample(3)
    design = frame(spark, x, y, family)
    lifted = {r["sample_id"]: r["x"] for r in zoo.landmark_features(design, landmarks=200).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    order = np.lexsort(x.T[::-1])
    kernel = np.exp(-((z[:, None, :] - z[order][None]) ** 2).sum(axis=2) / 5)
    assert all(lifted[f"s{i}"] == pytest.approx(kernel[i]) for i in range(len(x)))
    few = zoo.landmark_features(design, landmarks=10)
    assert len(few.first()["x"]) <= 10 and heads.family_out(few, (1.0,)).count() == len(x)


def test_trees_are_fitted_on_other_families(spark):
    x, y, family = sample(4, n=60)
    design = frame(spark, x, y, family)
    mean = np.mean([emd(projected(y[family != f].mean(axis=0)), y[i]) for i, f in enumerate(family)])
    for kind, settings in (("forest", {"numTrees": 10}), ("boosted", {"maxIter": 5})):
        got = zoo.tree_errors(design, kind, folds=3, **settings).collect()
        assert len(got) == 60 and np.mean([r["emd"] for r in got]) < 1.2 * mean
    assert zoo.tree_errors(design.where("false")).count() == 0 == zoo.linear_errors(design.where("false"), {"bayes": zoo.bayesian_ridge()}).count()
