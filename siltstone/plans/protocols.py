"""Registered queries of the evaluation protocols: heads across conditions, weighted heads, aggregation arms.

Suppliers are the entities, nations their families; a condition is a return flag and a line status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import bootstrap, evaluation, heads, zoo
from siltstone.plans.queries import EDGES, FEATURES, N, P, STEPS, emd_sql, query, r6
from siltstone.sources.io import table

ALPHA = 3.0


def cells(spark, d, keys: list[str], features: tuple[str, ...]) -> DataFrame:
    """(sample_id, family, keys, x, y): each cell's mean features and cumulative curve."""
    line, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    by = ["l_suppkey", *keys]
    steps = [(F.count_if(F.col("l_quantity") <= e) * 100.0 / F.count(F.lit(1))) for e in EDGES[:-1]]
    found = line.groupBy(*by).agg(F.array(*[F.avg(c).cast("double") for c in features]).alias("x"), F.array(*steps, F.lit(100.0)).alias("y"))
    named = found.join(s.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("family")), "l_suppkey")
    return named.select(F.col("l_suppkey").cast("string").alias("sample_id"), "family", *keys, "x", "y")


def cell_sql(keys: str) -> str:
    return f"cells as (select l_suppkey, s_nationkey as f, {keys}, avg(l_discount) as x, {STEPS}, 100.0::double as p10 from lineitem join supplier on l_suppkey = s_suppkey group by l_suppkey, s_nationkey, {keys})"


def moments_sql(weight: str = "1.0::double") -> str:
    """Weighted sums of a fold's fit rows (alias s) of one feature and all curve values."""
    w = weight
    sums = ", ".join(f"sum({w} * s.{p}) as b{i}, sum({w} * s.x * s.{p}) as c{i}" for i, p in enumerate(P))
    return f"sum({w}) as n, sum({w} * s.x) as sx, sum({w} * s.x * s.x) as sxx, {sums}"


def raw_sql(x: str, i: int, alpha: float = ALPHA) -> str:
    """Value i of the one-feature ridge's curve at x, from a fold's sums."""
    return f"(b{i} / n + ({x} - sx / n) * (c{i} - sx * b{i} / n) / (sxx - sx * sx / n) * n / (n + {alpha!r}::double))"


def curve_sql(values: list[str]) -> str:
    """The values as columns m0 .. m10, clipped, rising, ending at 100."""
    clipped = [f"least(greatest({v}, 0.0), 100.0)" for v in values[:-1]]
    return ", ".join(f"greatest({', '.join(clipped[: i + 1])}) as m{i}" if i else f"{c} as m0" for i, c in enumerate(clipped)) + f", 100.0::double as m{N - 1}"


TRANSFER = f"""with {cell_sql('l_returnflag')}, src as (select * from cells where l_returnflag = 'A'), held as (select h.*, case when exists (select 1 from src where src.l_suppkey = h.l_suppkey) then f end as fold from cells h where l_returnflag = 'N'),
folds as (select distinct fold from held), mom as (select fold, {moments_sql()} from folds left join src s on fold is null or s.f <> fold group by fold),
near as (select h.l_suppkey, coalesce(h.fold::varchar, '__unseen__') as fold, {', '.join('h.' + p for p in P)}, {curve_sql([raw_sql('h.x', i) for i in range(N)])} from held h join mom on h.fold is not distinct from mom.fold)
select l_suppkey::varchar as sample_id, fold, round({emd_sql()}, 5) as emd from near"""


@query(TRANSFER)
def transfer_head(spark, d):
    """Heads of one feature fitted under one return flag, judged under another."""
    rows = cells(spark, d, ["l_returnflag"], ("l_discount",)).withColumnRenamed("l_returnflag", "condition")
    return heads.transfer(rows, "A", "N", (ALPHA,), rank=N).select("sample_id", "fold", r6("emd", "emd", 5))


@query()
def transfer_head_nested(spark, d):
    """Heads of four features with a penalty chosen inside each fold, and where in the grid it lies."""
    rows = cells(spark, d, ["l_returnflag"], FEATURES).withColumnRenamed("l_returnflag", "condition")
    return heads.transfer(rows, "A", "N")


RULERS = f"""with {cell_sql('l_returnflag, l_linestatus')}, mom as (select fam.f, s.l_returnflag as cam, s.l_linestatus as view, {moments_sql()} from (select distinct f from cells) fam join cells s on s.f <> fam.f group by all),
near as (select h.l_returnflag as hcam, h.l_linestatus as hview, cam, view, {', '.join('h.' + p for p in P)}, {curve_sql([raw_sql('h.x', i) for i in range(N)])} from cells h join mom on h.f = mom.f),
err as (select case when hcam = cam and hview = view then 'LOGO' when hview = view then 'CAM' when hcam = cam then 'RES' else 'CAM+RES' end as ruler, {emd_sql()} as e from near)
select ruler, count(*) as n, round(avg(e), 5) as error from err group by ruler"""


@query(RULERS)
def ruler_heads(spark, d):
    """Every cell under the heads of every condition, by what the conditions share."""
    rows = cells(spark, d, ["l_returnflag", "l_linestatus"], ("l_discount",)).withColumn("condition", F.concat_ws("|", "l_returnflag", "l_linestatus"))
    return heads.ruler_errors(rows, (ALPHA,), rank=N).select("ruler", "n", r6("error", "error", 5))


@query()
def ruler_heads_by_penalty(spark, d):
    """The rulers of four features at every penalty of the grid."""
    rows = cells(spark, d, ["l_returnflag", "l_linestatus"], FEATURES).withColumn("condition", F.concat_ws("|", "l_returnflag", "l_linestatus"))
    return heads.ruler_errors(rows)


WEIGHTED = f"""with {cell_sql('l_returnflag')}, w as (select *, 1.0::double / count(*) over (partition by l_suppkey) as w from cells), mom as (select fam.f, {moments_sql('s.w')} from (select distinct f from cells) fam join w s on s.f <> fam.f group by fam.f),
near as (select l_suppkey, l_returnflag, {', '.join('h.' + p for p in P)}, {curve_sql([raw_sql('h.x', i) for i in range(N)])} from w h join mom on h.f = mom.f)
select l_suppkey::varchar || '/' || l_returnflag as sample_id, round({emd_sql()}, 5) as emd from near"""


@query(WEIGHTED)
def weighted_head(spark, d):
    """Family-out heads of rows that weigh one over their entity's rows."""
    rows = cells(spark, d, ["l_returnflag"], ("l_discount",))
    n = rows.groupBy("sample_id").agg((1 / F.count(F.lit(1))).alias("weight"))
    rows = rows.join(n, "sample_id").withColumn("sample_id", F.concat_ws("/", "sample_id", "l_returnflag"))
    return heads.family_out(rows, (ALPHA,), rank=N, weighted=True).select("sample_id", r6("emd", "emd", 5))


ARMS = f"""with {cell_sql('l_returnflag')}, w as (select *, 1.0::double / count(*) over (partition by l_suppkey) as w from cells),
ent as (select l_suppkey, f, avg(x) as x, {', '.join(f'avg({p}) as {p}' for p in P)} from cells group by all), fam as (select distinct f from cells),
one as (select fam.f, {moments_sql()} from fam join ent s on s.f <> fam.f group by fam.f), many as (select fam.f, {moments_sql('s.w')} from fam join w s on s.f <> fam.f group by fam.f),
pooled as (select l_suppkey, 'pooled' as arm, {', '.join('h.' + p for p in P)}, {curve_sql([raw_sql('h.x', i) for i in range(N)])} from ent h join one on h.f = one.f),
raw as (select h.l_suppkey, {', '.join(f'avg({raw_sql("h.x", i)}) as r{i}' for i in range(N))} from w h join many on h.f = many.f group by h.l_suppkey),
late as (select l_suppkey, 'raw' as arm, {', '.join('e.' + p for p in P)}, {curve_sql([f'r{i}' for i in range(N)])} from raw join ent e using (l_suppkey)),
single as (select h.l_suppkey, {curve_sql([raw_sql('h.x', i) for i in range(N)])} from w h join many on h.f = many.f),
early as (select l_suppkey, 'each' as arm, {', '.join('e.' + p for p in P)}, {', '.join(f'm{i}' for i in range(N))} from (select l_suppkey, {', '.join(f'avg(m{i}) as m{i}' for i in range(N))} from single group by 1) join ent e using (l_suppkey)),
every as (select * from pooled union all select * from late union all select * from early)
select arm, count(*) as n, round(avg({emd_sql()}), 5) as error from every group by arm"""


@query(ARMS)
def aggregation_head_arms(spark, d):
    """Three orders of projecting and averaging an entity's several rows."""
    arms = heads.aggregation_arms(cells(spark, d, ["l_returnflag"], ("l_discount",)), ALPHA, rank=N)
    return arms.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("emd"), "error", 5))


# Other heads, common resamples, placebos


@query()
def head_zoo(spark, d):
    """Family-out errors of ridge, partial least squares, Bayesian ridge and kernel ridge in one table."""
    design = cells(spark, d, [], FEATURES)
    solvers = {"pls 2": zoo.pls(2), "pls 3": zoo.pls(3), "bayesian ridge": zoo.bayesian_ridge()}
    kernel = heads.family_out(zoo.landmark_features(design), (1.0,)).select(F.lit("kernel ridge").alias("head"), "emd")
    every = zoo.linear_errors(design, solvers, (3.0,)).select("head", "emd").unionAll(kernel)
    return every.groupBy("head").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("emd"), "error", 5))


@query()
def tree_heads(spark, d):
    """Family-out errors of a forest of each leading component."""
    return zoo.tree_errors(cells(spark, d, [], FEATURES), "forest", folds=3, numTrees=10).groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.avg("emd").alias("error"))


@query()
def effect_intervals(spark, d):
    """Simple, main and interaction effects of a two by two design with intervals from common draws of suppliers."""
    x = evaluation.factorial_effects(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice", (("A", "N"), ("F", "O")))
    return bootstrap.effect_intervals(x, "l_suppkey", "effect", "value", 2_000)


@query()
def label_placebo(spark, d):
    """Whether nations explain suppliers' means better than permuted nations do, by the best of three columns."""
    line = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.avg(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    rows = line.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return bootstrap.placebo_gate(bootstrap.label_placebo(rows, "l_suppkey", "s_nationkey", ("l_quantity", "l_discount", "l_tax"), 100))
