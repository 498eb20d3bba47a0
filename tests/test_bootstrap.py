"""Common draws against numpy on the collected clusters, and permuted labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import bootstrap, evaluation

SEED, DRAWS = 5, 400


def clustered(seed=0, clusters=24):
    r, rows = np.random.default_rng(seed), []
    for c in range(clusters):
        for _ in range(r.integers(1, 5)):
            rows += [(f"c{c:03d}", e, float(m + r.normal())) for e, m in (("main", 0.5), ("simple", 0.0), ("interaction", -1.0)) if r.random() < 0.9]
    return rows


def plain_means(rows, sizes, names, blocks_of):
    """Each draw's mean of each effect from the clusters' own rows, picked one by one."""
    effects = sorted({e for _, e, _ in rows})
    s = {(c, e): [v for k, f, v in rows if (k, f) == (c, e)] for c in names for e in effects}
    out = {}
    for draw in range(DRAWS):
        times = {}
        for block, members in enumerate(blocks_of):
            if members:
                times |= dict(zip(members, bootstrap.picks(SEED, draw, block, sizes), strict=True))
        assert sum(times.values()) == len(names)
        for e in effects:
            n = sum(t * len(s[c, e]) for c, t in times.items())
            out[draw, e] = sum(t * sum(s[c, e]) for c, t in times.items()) / n
    return out


@pytest.mark.parametrize("block", [None, 7])
def test_draws_are_those_of_numpy(spark, block):
    rows = clustered()
    df = spark.createDataFrame(rows, "c string, e string, v double")
    names = sorted({c for c, _, _ in rows})
    blocks = max(1, round(len(names) / (block or bootstrap.BLOCK)))
    place = {r["c"]: r["b"] for r in df.select("c", F.pmod(F.xxhash64("c"), F.lit(blocks)).alias("b")).distinct().collect()}
    blocks_of = [[c for c in names if place[c] == b] for b in range(blocks)]
    want = plain_means(rows, [len(m) for m in blocks_of], names, blocks_of)
    got = {(r["draw"], r["effect"]): r["mean"] for r in bootstrap.common_draws(df, "c", "e", "v", DRAWS, SEED, block)[0].collect()}
    assert got == pytest.approx(want, abs=1e-9)
    intervals = {r["effect"]: r for r in bootstrap.effect_intervals(df, "c", "e", "v", DRAWS, SEED, block).collect()}
    for e, r in intervals.items():
        own, drawn = [v for _, f, v in rows if f == e], [want[k, e] for k in range(DRAWS)]
        assert (r["mean"], r["wins"], r["n"]) == (pytest.approx(np.mean(own)), sum(v > 0 for v in own), len(own))
        assert (r["lo"], r["hi"], r["p_le_0"]) == pytest.approx((np.quantile(drawn, 0.025), np.quantile(drawn, 0.975), np.mean(np.array(drawn) <= 0)))


def test_effects_share_a_draw(spark):
    rows = [(c, e, v * (1 if e == "a" else 2)) for c, _, v in clustered(1) for e in ("a", "b")]
    means, _ = bootstrap.common_draws(spark.createDataFrame(rows, "c string, e string, v double"), "c", "e", "v", 50, 3)
    by = {(r["draw"], r["effect"]): r["mean"] for r in means.collect()}
    assert all(by[k, "b"] == pytest.approx(2 * by[k, "a"]) for k in range(50))


def test_many_clusters_meet_in_blocks_of_a_bounded_size(spark):
    df = spark.range(20_000).select(F.col("id").alias("c"), F.lit("e").alias("e"), (F.col("id") % 7).cast("double").alias("v"))
    one = bootstrap.effect_intervals(df, "c", "e", "v", 200, 1, block=1_000).first()
    half = 1.96 * 2 / 20_000**0.5
    assert one["lo"] == pytest.approx(one["mean"] - half, abs=half / 3) and one["hi"] == pytest.approx(one["mean"] + half, abs=half / 3)
    naive = evaluation.naive_bootstrap(df, "c", "v", draws=300).first()
    assert naive["lo"] < naive["mean"] < naive["hi"]


def test_odd_rows(spark):
    df = spark.createDataFrame([("a", "e", 1.0), (None, "e", 5.0), ("b", None, 5.0), ("b", "e", None), ("b", "e", 3.0)], "c string, e string, v double")
    assert bootstrap.effect_intervals(df, "c", "e", "v", 100, 1).first()[1:] == (2.0, 1.0, 3.0, 0.0, 2, 2)
    assert bootstrap.effect_intervals(df.where("false"), "c", "e", "v", 100, 1).count() == 0


def test_permutations_keep_the_labels_and_gains_are_shares_of_variance(spark):
    r = np.random.default_rng(2)
    rows = [(k, f"g{k % 3}", float(k % 3 + r.normal()), float(r.normal())) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, g string, a double, b double")
    dealt = {}
    for x in bootstrap.permuted(df, "k", "g", 3, 9).collect():
        dealt.setdefault(x["shuffle"], {})[x["k"]] = x["g"]
    assert dealt[0] == {k: g for k, g, *_ in rows} and all(sorted(d.values()) == sorted(dealt[0].values()) for d in dealt.values())
    assert len({tuple(sorted(d.items())) for d in dealt.values()}) == 4 and all(sum(d[k] == dealt[0][k] for k in d) < 150 for s, d in dealt.items() if s)
    gains = {(x["shuffle"], x["arm"]): x["gain"] for x in bootstrap.label_placebo(df, "k", "g", ["a", "b"], 3, 9).collect()}
    for s, d in dealt.items():
        for c, arm in ((2, "a"), (3, "b")):
            v = np.array([row[c] for row in rows])
            between = sum(len(x) * (x.mean() - v.mean()) ** 2 for x in (v[[d[row[0]] == g for row in rows]] for g in ("g0", "g1", "g2")))
            assert gains[s, arm] == pytest.approx(between / ((v - v.mean()) ** 2).sum())
    gate = bootstrap.placebo_gate(bootstrap.label_placebo(df, "k", "g", ["a", "b"], 40, 9)).first()
    assert gate["passes"] and gate["draws"] == 40 and gate["share_at_least"] == 0.0
    none = bootstrap.placebo_gate(bootstrap.label_placebo(df, "k", "g", ["b"], 40, 9)).first()
    assert none["share_at_least"] > 0.02
