"""Hard negatives against all pairs compared one by one; brackets; odd rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import negatives, queries
from siltstone.llm.negatives import Block, distances, lifted


def plain_mine(rows, every, low=80, high=100, k=5, m=5):
    """The contract row by row; rows: (id, label, whole-number vector)."""
    out = []
    for a, (anchor, own, q) in enumerate(rows):
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, lab == own) for b, (i, lab, v) in enumerate(rows) if b != a)
        for p, positive, _ in [s for s in scored if s[2]][:k]:
            fits = [s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p][:m]
            out += [(anchor, positive, r, s[1], -p, -s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every, **options):
    df = spark.createDataFrame([(i, lab, [x / 256 for x in v]) for i, lab, v in rows], "vec_id bigint, label int, embedding array<double>")
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % every == 0, F.col("label"), **options).collect()))


@pytest.mark.parametrize(("chunk", "anchor_chunk", "pivots"), [(50_000, 10_000, 12), (40, 3, 4)])
def test_every_row_of_clusters_ties_and_a_hot_label(spark, chunk, anchor_chunk, pivots):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 5)) * 300
    rows = [(k, int(x % 6 if x < 12 else 1), [int(y) for y in centres[x % 6] + r.normal(size=5) * 40]) for k, x in enumerate(r.integers(0, 18, 500))]
    rows = [(i, lab, rows[7][2] if i % 50 == 1 else v) for i, lab, v in rows]  # copies: tied scores
    want = plain_mine(rows, 20)
    assert len(want) > 100
    assert mined(spark, rows, 20, chunk=chunk, anchor_chunk=anchor_chunk, pivots=pivots) == want


def test_query_against_its_sql(same_rows):
    same_rows(queries.QUERIES["op11_hard_negatives"], queries.ORACLE["op11_hard_negatives"])


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.booleans())
def test_brackets_hold_and_exclude(seed, n, clustered):
    r = np.random.default_rng(seed)
    v = np.floor(r.normal(size=(n, 4)) * 50 + (r.integers(0, 3, (n, 1)) * 400 if clustered else 0)).astype(np.int64)
    q = v[0] + r.integers(-3, 4, 4)
    radius2 = float((v**2).sum(axis=1).max())
    pivot = negatives.spread_pivots(lifted(v[: n // 2 + 1], radius2), 5)
    frame = pd.DataFrame({"row": range(n), "vec_id": range(n), "label": 0, "v": [x.astype("<i8").tobytes() for x in v], "d": [x.tobytes() for x in distances(lifted(v, radius2), pivot)]})
    block = Block(frame, radius2)
    far = distances(np.array([[*q, 0.0]]), pivot)[0]
    norm2, score, every = float(q @ q), v @ q, np.arange(n)
    low, high = sorted(r.choice(score, 2).tolist())
    assert set(np.flatnonzero((score >= low) & (score <= high))) <= set(block.reach(far, norm2, low, high, every).tolist())
    for k in (1, 3):
        sure = block.sure(far, norm2, k, every)
        assert (score >= sure).sum() >= min(k, n)
    assert (block.scores(q, every) == score).all()


def test_far_clusters_are_not_multiplied_out():
    r = np.random.default_rng(5)
    v = np.floor(r.normal(size=(3_000, 8)) * 5 + np.repeat(np.eye(3, 8) * 1_000, 1_000, axis=0)).astype(np.int64)
    radius2 = float((v**2).sum(axis=1).max())
    pivot = negatives.spread_pivots(lifted(v[::50], radius2), 6)
    frame = pd.DataFrame({"row": range(3_000), "vec_id": range(3_000), "label": 0, "v": [x.astype("<i8").tobytes() for x in v], "d": [x.tobytes() for x in distances(lifted(v, radius2), pivot)]})
    block, q = Block(frame, radius2), v[0]
    far, every = distances(np.array([[*q, 0.0]]), pivot)[0], np.arange(3_000)
    left = block.reach(far, float(q @ q), block.sure(far, float(q @ q), 5, every), np.inf, every)
    assert 5 <= len(left) <= 1_000 and left.max() < 1_000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, [0.5, 0.0]), (3, 2, [1.0, 0.0]), (3, 2, [1.0, 0.0]), (4, 2, [0.9, 5.0]), (5, 3, [-1.0, 0.0])]
    bad = [(6, None, [1.0, 0.0]), (7, 2, None), (8, 2, []), (9, 2, [None, 1.0]), (10, 2, [nan, 1.0]), (11, 2, [inf, 0.0]), (12, 2, [1.0, 0.0, 0.0]), (None, 2, [1.0, 0.0]), (13, 2, [1e30, 0.0])]
    df = spark.createDataFrame(good + bad, "vec_id bigint, label int, embedding array<double>").selectExpr("*", "1 as v", "2 as row", "3 as cell", "4 as d", "5 as score")
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 20 == 0, F.col("label")).collect()))
    one = 256 * 256
    assert got == [(0, 1, 1, 3, one, one), (0, 1, 2, 3, one, one), (0, 1, 3, 4, one, 230 * 256)]  # below half the score nothing is in the second positive's window
    assert negatives.mine(df.where("false"), F.col("vec_id") % 20 == 0, F.col("label")).count() == 0
    assert negatives.mine(df, F.col("vec_id") < 0, F.col("label")).count() == 0
