"""Registered queries: name to (spark, folder) -> DataFrame, and the SQL that gives the same rows.

The measured hierarchy is lineitem -> order -> supplier; a supplier's curve is the cumulative
percentage of its quantities at eleven edges, set on the engine's eleven diameters; a supplier's family
is its nation. Query sets against all rows (nearest curves, distances) are the suppliers whose key is
divisible by 20.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import curves, geometry, stats, text
from siltstone.operators import aggregate, columns, contracts, evaluation, joins, models, pixels, resample
from siltstone.sources.io import table
from siltstone.streaming import events as stream_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
EDGES = (1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50)
FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
X = curves.LOG_SUPPORT
N = len(X)
P = [f"p{i}" for i in range(N)]


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


def supplier_curve(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.step_curve(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", EDGES).select("l_suppkey", F.col("curve").alias("y"), "n")


STEPS = ", ".join(f"count(*) filter (l_quantity <= {e}) * 100.0::double / count(*) as p{i}" for i, e in enumerate(EDGES[:-1]))
CURVES = f"curves as (select l_suppkey, {STEPS}, 100.0::double as p10, count(*) as n from lineitem group by l_suppkey)"
MEDIANS = "med as (select " + ", ".join(f"median({p}) as m{i}" for i, p in enumerate(P)) + " from curves)"


def emd_sql(a: str = "p", b: str = "m", left: bool = False) -> str:
    g = [f"abs({a}{i} - {b}{i})" for i in range(N)]
    if left:
        return " + ".join(f"{X[i] - X[i - 1]!r}::double * {g[i - 1]}" for i in range(1, N))
    return " + ".join(f"{0.5 * (X[i] - X[i - 1])!r}::double * ({g[i]} + {g[i - 1]})" for i in range(1, N))


def d50_sql(p: str = "p", q: float = 50.0) -> str:
    whens = [f"when {p}0 >= {q} then {X[0]!r}::double"]
    whens += [f"when {p}{i} >= {q} then {X[i - 1]!r}::double + ({q} - {p}{i - 1}) / nullif({p}{i} - {p}{i - 1}, 0) * {X[i] - X[i - 1]!r}::double" for i in range(1, N)]
    return "case " + " ".join(whens) + f" else {X[-1]!r}::double end"


def against_median(spark: SparkSession, d: str) -> DataFrame:
    """Each curve beside the pointwise median curve, which is one row."""
    c = supplier_curve(spark, d)
    return c.join(F.broadcast(c.agg(F.array(*[F.median(F.col("y")[i]) for i in range(N)]).alias("m"))))


# Hierarchical aggregation


@query("""with items as (select l_orderkey, l_suppkey, median(l_quantity) q, median(l_extendedprice) e, median(l_discount) d from lineitem group by all)
select l_suppkey, round(median(q), 6) as quantity, round(median(e), 5) as price, round(median(d), 6) as discount from items group by l_suppkey""")
def two_stage_median(spark, d):
    out = aggregate.two_stage(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], "l_suppkey", ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("l_suppkey", r6("l_quantity", "quantity"), r6("l_extendedprice", "price", 5), r6("l_discount", "discount"))


@query("select l_suppkey, round(median(l_quantity), 6) as quantity, round(median(l_extendedprice), 5) as price from lineitem group by l_suppkey")
def one_stage_median(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(F.median("l_quantity"), "quantity"), r6(F.median("l_extendedprice"), "price", 5))


@query("""select l_returnflag, round(median(l_quantity), 6) as med, round(avg(l_quantity), 6) as mean, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) as iqr,
round(quantile_cont(l_quantity, 0.1), 6) as p10, round(quantile_cont(l_quantity, 0.9), 6) as p90, round(stddev_pop(l_quantity), 6) as sd0, round(stddev_samp(l_quantity), 6) as sd1 from lineitem group by l_returnflag""")
def multi_stat_agg(spark, d):
    q = lambda p: stats.quantile("l_quantity", p)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        r6(q(0.5), "med"), r6(F.avg("l_quantity"), "mean"), r6(q(0.75) - q(0.25), "iqr"), r6(q(0.1), "p10"), r6(q(0.9), "p90"),
        r6(F.stddev_pop("l_quantity"), "sd0"), r6(F.stddev_samp("l_quantity"), "sd1"))


@query("""with m as (select var_samp(a) as b from (select avg(l_quantity) as a from lineitem group by l_suppkey))
select round(b / (select var_samp(l_quantity) from lineitem) * 100, 6) as share_pct from m""")
def variance_share(spark, d):
    return stats.variance_share(table(spark, d, "lineitem"), "l_suppkey", "l_quantity").select(r6("share_pct", "share_pct"))


@query("""select l_returnflag, count(*) filter (l_linestatus = 'F') as "F", count(*) filter (l_linestatus = 'O') as "O" from lineitem group by l_returnflag""")
def crosstab_fill(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


@query("select round(sum(n) / (select count(*) from orders), 6) as purity from (select max(c) as n from (select o_orderpriority, o_orderstatus, count(*) as c from orders group by all) group by o_orderpriority)")
def cluster_purity(spark, d):
    cells = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").count()
    return cells.groupBy("o_orderpriority").agg(F.max("count").alias("n"), F.sum("count").alias("all")).agg(r6(F.sum("n") / F.sum("all"), "purity"))


@query("""with i as (select l_suppkey, l_orderkey, avg(l_quantity) as v from lineitem group by all), e as (select l_suppkey, avg(v) as v from i group by 1) select round(avg(v), 6) as balanced_mean from e""")
def soil_balanced_mean(spark, d):
    return aggregate.balanced_mean(table(spark, d, "lineitem"), ["l_suppkey", "l_orderkey"], "l_suppkey", "l_quantity").select(r6("balanced_mean", "balanced_mean"))


@query("""with f as (select s_nationkey, l_quantity from lineitem join supplier on l_suppkey = s_suppkey), m as (select s_nationkey, avg(l_quantity) as v from f group by 1)
select round((select avg(l_quantity) from f), 6) as pooled, round(avg(v), 6) as fold_mean from m""")
def pooled_vs_fold_mean(spark, d):
    f = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = f.groupBy("s_nationkey").agg(F.sum("l_quantity").alias("s"), F.count("l_quantity").alias("n"))
    return sums.agg(r6(F.sum("s") / F.sum("n"), "pooled"), r6(F.avg(F.col("s") / F.col("n")), "fold_mean"))


@query("""select l_returnflag, l_quantity as x from (select l_returnflag, l_quantity, row_number() over (partition by l_returnflag order by count(*) desc, l_quantity) as k
from lineitem group by l_returnflag, l_quantity) where k = 1""")
def mode_lowest(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.mode("l_quantity", True).alias("x"))


# Curves


@query(f"with {CURVES} select l_suppkey, n, " + ", ".join(f"round({p}, 6) as {p}" for p in P) + " from curves")
def supplier_curves(spark, d):
    return supplier_curve(spark, d).select("l_suppkey", "n", *[r6(F.col("y")[i], P[i]) for i in range(N)])


@query(f"with {CURVES}, {MEDIANS} select l_suppkey, round({emd_sql()}, 6) as emd, round({d50_sql()}, 6) as log_d50 from curves, med")
def curve_emd_trapezoid(spark, d):
    c = against_median(spark, d)
    return c.select("l_suppkey", r6(curves.emd_trapezoid(F.col("y"), F.col("m")), "emd"), r6(curves.diameter_at(F.col("y"), 50.0), "log_d50"))


@query(f"with {CURVES}, {MEDIANS} select l_suppkey, round({emd_sql(left=True)}, 6) as emd from curves, med")
def curve_emd_left(spark, d):
    return against_median(spark, d).select("l_suppkey", r6(curves.emd_left(F.col("y"), F.col("m")), "emd"))


NOISY = ", ".join(f"p{i} + 40 * sin(l_suppkey + {i}) as v{i}" for i in range(N))
RUNNING = ", ".join("100.0::double as z10" if i == N - 1 else f"greatest({', '.join(f'greatest(0.0::double, least(100.0::double, v{j}))' for j in range(i + 1))}, 0.0::double) as z{i}" for i in range(N))


@query(f"with {CURVES}, noisy as (select l_suppkey, {NOISY} from curves), mono as (select l_suppkey, {RUNNING} from noisy) select l_suppkey, " + ", ".join(f"round(z{i}, 6) as z{i}" for i in range(N)) + " from mono")
def monotone_project(spark, d):
    noisy = supplier_curve(spark, d).select("l_suppkey", F.array(*[F.col("y")[i] + F.lit(40) * F.sin(F.col("l_suppkey") + i) for i in range(N)]).alias("v"))
    return noisy.select("l_suppkey", curves.monotone(F.col("v")).alias("z")).select("l_suppkey", *[r6(F.col("z")[i], f"z{i}") for i in range(N)])


@query(f"with {CURVES} select l_suppkey, round({d50_sql(q=10.0)}, 6) as d10, round({d50_sql()}, 6) as d50, round({d50_sql(q=90.0)}, 6) as d90 from curves")
def d50_interp(spark, d):
    return supplier_curve(spark, d).select("l_suppkey", *[r6(curves.diameter_at(F.col("y"), q), n) for n, q in (("d10", 10.0), ("d50", 50.0), ("d90", 90.0))])


def at_sql(log_d: float) -> str:
    i = next(i for i in range(1, N) if log_d <= X[i])
    w = (log_d - X[i - 1]) / (X[i] - X[i - 1])
    return f"p{i - 1} * {1 - w!r}::double + p{i} * {w!r}::double"


@query(f"with {CURVES} select l_suppkey, round({at_sql(math.log10(0.05))}, 6) as fines, round({at_sql(math.log10(1.5))}, 6) as sand, 100.0::double as above from curves")
def curve_at(spark, d):
    y = F.col("y")
    return supplier_curve(spark, d).select("l_suppkey", r6(curves.curve_at(y, math.log10(0.05)), "fines"), r6(curves.curve_at(y, math.log10(1.5)), "sand"), curves.curve_at(y, 3.0).alias("above"))


@query(f"""with {CURVES}, {MEDIANS}, mean as (select {', '.join(f'avg({p}) as a{i}' for i, p in enumerate(P))} from curves)
select round(avg({emd_sql()}), 6) as median_curve, round(avg({emd_sql(b='a')}), 6) as mean_curve from curves, med, mean""")
def constant_baselines(spark, d):
    c = against_median(spark, d)
    mean = supplier_curve(spark, d).agg(F.array(*[F.avg(F.col("y")[i]) for i in range(N)]).alias("a"))
    both = c.join(F.broadcast(mean))  # one row
    return both.agg(r6(F.avg(curves.emd_trapezoid(F.col("y"), F.col("m"))), "median_curve"), r6(F.avg(curves.emd_trapezoid(F.col("y"), F.col("a"))), "mean_curve"))


LINE = [100.0 * (i + 1) / N for i in range(N)]
BLEND = ", ".join(f"m{i} * (1 - w) + {LINE[i]!r}::double * w as b{i}" for i in range(N))


@query(f"""with {CURVES}, {MEDIANS}, grid as (select k * 0.1::double as w, k from unnest(range(0, 11)) as g(k)),
tried as (select k, w, {', '.join(P)}, {BLEND} from curves, med, grid)
select cast(k as int) as k, round(avg({emd_sql(b='b')}), 6) as emd from tried group by k""")
def blend_grid(spark, d):
    c = against_median(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    mixed = curves.blend(F.col("m"), curves.doubles(LINE), F.col("k") * F.lit(0.1))
    return c.withColumn("b", mixed).groupBy("k").agg(r6(F.avg(curves.emd_trapezoid(F.col("y"), F.col("b"))), "emd"))


@query(f"with {CURVES} select l_suppkey, round(({' + '.join(f'(case when abs(p{i}) < 1e-8 or abs(p{i} - 100) < 1e-8 then 1 else 0 end)' for i in range(1, N - 1))}) / 9.0, 6) as share from curves")
def saturation_share(spark, d):
    return supplier_curve(spark, d).select("l_suppkey", r6(curves.saturation(F.col("y")), "share"))


SCALES, SHAPES = [-4.0 + 0.5 * i for i in range(13)], [0.3 + 0.15 * i for i in range(8)]
WEIBULL = ", ".join(f"100.0::double * (1 - exp(-exp(greatest(-50.0, least(50.0, k * ({v * math.log(10.0)!r}::double - l)))))) as m{i}" for i, v in enumerate(X))


@query(f"""with {CURVES}, grid as (select -4.0::double + 0.5::double * i as l, 0.3::double + 0.15::double * j as k, i * 8 + j as g from unnest(range(0, 13)) a(i), unnest(range(0, 8)) b(j)),
w as (select g, {WEIBULL} from grid), tried as (select l_suppkey, g, round({emd_sql()}, 6) as emd from curves, w), best as (select *, row_number() over (partition by l_suppkey order by emd, g) as n from tried)
select l_suppkey, cast(g as int) as g, emd from best where n = 1""")
def weibull_grid_fit(spark, d):
    points = [(i * 8 + j, -4.0 + 0.5 * i, 0.3 + 0.15 * j) for i in range(13) for j in range(8)]
    grid = F.broadcast(spark.createDataFrame(points, "g int, l double, k double").withColumn("m", curves.weibull(F.col("l"), F.col("k"))))  # 104 rows
    tried = supplier_curve(spark, d).join(grid).withColumn("emd", F.round(curves.emd_trapezoid(F.col("y"), F.col("m")), 6))
    return tried.groupBy("l_suppkey").agg(F.min(F.struct("emd", "g")).alias("b")).select("l_suppkey", "b.g", "b.emd")


# Joins and set guards


@query("select s_suppkey, n_name, s_acctbal from supplier join nation on s_nationkey = n_nationkey")
def lookup_join(spark, d):
    return joins.matched_all(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), table(spark, d, "nation"), ["n_nationkey"]).select("s_suppkey", "n_name", "s_acctbal")


@query("with a as (select l_orderkey, count(*) as n from lineitem group by 1) select l_orderkey, n, o_totalprice from a join orders on l_orderkey = o_orderkey")
def validated_join(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return joins.matched_once(a, b.select("l_orderkey", "o_totalprice"), ["l_orderkey"]).select("l_orderkey", "n", "o_totalprice")


@query("""select 'quantity' as "column", round(max(abs(m - a)), 6) as max_drift, count(*) as n from (select median(l_quantity) as m, avg(l_quantity) as a from lineitem group by l_suppkey)
union all select 'tax', round(max(abs(m - a)), 6), count(*) from (select median(l_tax) as m, avg(l_tax) as a from lineitem group by l_suppkey)""")
def drift_report(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_suppkey")
    left = by.agg(F.median("l_quantity").alias("quantity"), F.median("l_tax").alias("tax"))
    right = by.agg(F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"))
    return joins.drift(left, right, ["l_suppkey"], ["quantity", "tax"]).select("column", r6("max_drift", "max_drift"), "n")


@query("""with c as (select c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') as k from customer), s as (select s_suppkey, replace(regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g'), 'supplier', 'customer') as k from supplier)
select c_custkey, s_suppkey from c join s using (k)""")
def folded_key_join(spark, d):
    c = table(spark, d, "customer").select("c_custkey", text.norm_key(F.col("c_name")).alias("k"))
    s = table(spark, d, "supplier").select("s_suppkey", F.replace(text.norm_key(F.col("s_name")), F.lit("supplier"), F.lit("customer")).alias("k"))
    return c.join(s, "k").select("c_custkey", "s_suppkey")


@query("""select l_suppkey, round(avg(l_quantity) filter (l_returnflag = 'A') - avg(l_quantity) filter (l_returnflag = 'R'), 6) as gap from lineitem group by 1
having count(*) filter (l_returnflag = 'A') > 0 and count(*) filter (l_returnflag = 'R') > 0""")
def paired_entities(spark, d):
    arm = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg((arm("A") - arm("R")).alias("g")).where("g is not null").select("l_suppkey", r6("g", "gap"))


PAIR = "a.l_suppkey as q_id, b.l_suppkey as d_id, round(" + " + ".join(f"{0.5 * (X[i] - X[i - 1])!r}::double * (abs(a.p{i} - b.p{i}) + abs(a.p{i - 1} - b.p{i - 1}))" for i in range(1, N)) + ", 6) as dist"


def query_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = supplier_curve(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    side = lambda p: c.select(F.col("l_suppkey").alias(f"{p}_id"), F.col("s_nationkey").alias(f"{p}_family"), F.col("y").alias(f"{p}_y"))
    return side("q").where("q_id % 20 = 0"), side("d")


@query(f"with {CURVES} select {PAIR} from curves a, curves b where a.l_suppkey % 20 = 0 and a.l_suppkey <> b.l_suppkey")
def emd_matrix_pairs(spark, d):
    q, other = query_pairs(spark, d)
    return q.join(other, F.col("q_id") != F.col("d_id")).select("q_id", "d_id", r6(curves.emd_trapezoid(F.col("q_y"), F.col("d_y")), "dist"))


NEAREST = f"""{CURVES}, placed as (select curves.*, s_nationkey as f from curves join supplier on l_suppkey = s_suppkey),
pairs as (select {PAIR} from placed a, placed b where a.l_suppkey % 20 = 0 and a.f <> b.f),
near as (select *, cast(row_number() over (partition by q_id order by dist, d_id) as int) as rank from pairs)"""


@query(f"with {NEAREST} select q_id, d_id, dist, rank from near where rank <= 3")
def knn_cross_family(spark, d):
    q, other = query_pairs(spark, d)
    return joins.nearest(q, other, F.round(curves.emd_trapezoid(F.col("q_y"), F.col("d_y")), 6), 3, F.col("q_family") != F.col("d_family"))


@query(f"with {NEAREST} select q_id, round(avg(p5), 6) as p5, round(avg(dist), 6) as dist from near join curves on d_id = l_suppkey where rank <= 3 group by q_id")
def knn_mean_curve(spark, d):
    q, other = query_pairs(spark, d)
    near = joins.nearest(q, other, F.round(curves.emd_trapezoid(F.col("q_y"), F.col("d_y")), 6), 3, F.col("q_family") != F.col("d_family"))
    return near.join(other, "d_id").groupBy("q_id").agg(r6(F.avg(F.col("d_y")[5]), "p5"), r6(F.avg("dist"), "dist"))


@query("select count(*) as leaks from (select distinct l_orderkey from lineitem where l_linestatus = 'O') a where l_orderkey in (select l_orderkey from lineitem where l_linestatus = 'F')")
def leak_check(spark, d):
    item = table(spark, d, "lineitem")
    fit, held = item.where("l_linestatus = 'F'"), item.where("l_linestatus = 'O'").select("l_orderkey").distinct()
    return joins.leaks(fit, held, ["l_orderkey"]).agg(F.count(F.lit(1)).alias("leaks"))


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_guard_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("select n_nationkey as k from nation except all select s_nationkey from supplier")
def set_guard_except(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").select("s_nationkey"))


@query("select 'supplier' as view, s_acctbal as balance from supplier union all select 'customer', c_acctbal from customer")
def union_views(spark, d):
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("view"), F.col("s_acctbal").alias("balance"))
    return s.unionByName(table(spark, d, "customer").select(F.col("c_acctbal").alias("balance"), F.lit("customer").alias("view")))


# Order, rank and top-k


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 3")
def topk_per_group(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(order)).where("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("select l_partkey, l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_quantity) as k from lineitem) where k = 1")
def dedup_first(spark, d):
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("f")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(first).select("l_partkey", "f.*")


@query("with s as (select s_suppkey, abs(s_acctbal) as v from supplier), k as (select v from s order by v desc, s_suppkey limit 10) select round((select sum(v) from k) / (select sum(v) from s), 6) as share")
def worst_k_share(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("v"))
    top = s.orderBy(F.desc("v"), "s_suppkey").limit(10).agg(F.sum("v").alias("t"))
    return top.join(s.agg(F.sum("v").alias("a"))).select(r6(F.col("t") / F.col("a"), "share"))  # two one-row frames


@query("""with r as (select p_brand, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0::double as a,
rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2.0::double as b from part)
select p_brand, count(*) as n, round(corr(a, b), 6) as rho from r group by p_brand""")
def spearman(spark, d):
    return stats.spearman(table(spark, d, "part"), "p_size", "p_retailprice", "p_brand").select("p_brand", "n", r6("rho", "rho"))


@query("""with s as (select p_brand, median(p_retailprice) as m, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) as w from part group by 1)
select p_partkey, round((p_retailprice - m) / w, 6) as z from part join s using (p_brand) where w > 0""")
def group_robust_z(spark, d):
    part = table(spark, d, "part")
    q = lambda p: stats.quantile("p_retailprice", p)
    scale = part.groupBy("p_brand").agg(q(0.5).alias("m"), (q(0.75) - q(0.25)).alias("w")).where("w > 0")
    return part.join(scale, "p_brand").select("p_partkey", r6((F.col("p_retailprice") - F.col("m")) / F.col("w"), "z"))


GRID = "grid as (select l_returnflag, k, round(avg(abs(l_quantity - k)), 6) as err from lineitem, unnest(range(20, 31)) g(k) group by all)"


def error_grid(spark: SparkSession, d: str) -> DataFrame:
    trials = [F.round(F.avg(F.abs(F.col("l_quantity") - k)), 6).alias(f"e{k}") for k in range(20, 31)]
    one = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*trials)
    return one.select("l_returnflag", F.inline(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"e{k}").alias("err")) for k in range(20, 31)])))


@query(f"with {GRID} select l_returnflag, k, err from (select *, row_number() over (partition by l_returnflag order by err, k) as n from grid) where n = 1")
def argmin_grid(spark, d):
    return error_grid(spark, d).groupBy("l_returnflag").agg(F.min(F.struct("err", "k")).alias("b")).select("l_returnflag", "b.k", "b.err")


@query(f"with {GRID}, best as (select l_returnflag, min(err) as e from grid group by 1) select l_returnflag, max(k) as k from grid join best using (l_returnflag) where err <= e + 0.15 group by 1")
def parsimony_alpha(spark, d):
    grid = error_grid(spark, d)
    best = F.min("err").over(Window.partitionBy("l_returnflag"))
    return grid.withColumn("e", best).where("err <= e + 0.15").groupBy("l_returnflag").agg(F.max("k").alias("k"))


@query("""with a as (select user_id, event_id, value > 50 as up, row_number() over (partition by user_id order by ts, event_id) as n from events),
b as (select user_id, n, n - row_number() over (partition by user_id order by n) as g from a where up), c as (select user_id, min(n) as s, count(*) as len from b group by user_id, g)
select user_id, s as run_start, len as run_length from (select *, row_number() over (partition by user_id order by len desc, s) as k from c) where k = 1""")
def longest_run(spark, d):
    e = table(spark, d, "events").withColumn("up", F.col("value") > 50).withColumn("at", F.struct("ts", "event_id"))
    return stats.longest_run(e, "user_id", "at", "up").select("user_id", F.col("run_start").cast("bigint"), "run_length")


@query("""with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, count(*) over (partition by o_custkey) as n from orders),
p as (select k from unnest(range(0, 6)) g(k)), w as (select distinct o_custkey, n, k, case when n >= 6 then cast(round_even(k * (n - 1) / 5.0, 0) as bigint) else k % n end as i from r, p)
select w.o_custkey, k, o_orderkey from w join r on w.o_custkey = r.o_custkey and w.i = r.i""")
def even_pick(spark, d):
    """Six evenly spaced orders of each customer; with fewer than six they repeat in turn."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(order) - 1).cast("bigint").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("n"))
    at = F.when(F.col("n") >= 6, F.rint(F.col("k") * (F.col("n") - 1) / 5.0).cast("bigint")).otherwise(F.col("k") % F.col("n"))
    wanted = r.where("i = 0").select("o_custkey", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("k")).select("o_custkey", "k", at.alias("i"))
    return wanted.join(r, ["o_custkey", "i"]).select("o_custkey", "k", "o_orderkey")


# Names and keys

KINDS = [("gold metal", "STANDARD.*BRASS"), ("standard", "STANDARD"), ("brass", "BRASS"), ("promo", "PROMO")]


@query("select p_partkey, case " + " ".join(f"when regexp_matches(p_type, '{p}') then '{n}'" for n, p in KINDS) + " else 'other' end as kind from part")
def camera_regex(spark, d):
    return table(spark, d, "part").select("p_partkey", text.first_match(F.col("p_type"), KINDS, "other").alias("kind"))


@query("select s_suppkey, trim(regexp_extract(s_name, '^([^0-9#]*)', 1)) as site, coalesce(nullif(regexp_extract(s_name, '([0-9]+)$', 1), ''), '-') as number from supplier")
def site_family(spark, d):
    s = F.col("s_name")
    return table(spark, d, "supplier").select("s_suppkey", F.trim(F.regexp_extract(s, "^([^0-9#]*)", 1)).alias("site"), F.coalesce(F.nullif(F.regexp_extract(s, "([0-9]+)$", 1), F.lit("")), F.lit("-")).alias("number"))


PLAIN_SQL = "p_name"
for _a, _b in text.UMLAUTS:
    PLAIN_SQL = f"replace({PLAIN_SQL}, '{_a}', '{_b}')"


@query(f"select p_partkey, regexp_replace(regexp_replace({PLAIN_SQL}, '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from part")
def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query(f"select p_partkey, regexp_replace(lower({PLAIN_SQL}), '[^a-z0-9]', '', 'g') as k from part")
def norm_key(spark, d):
    return table(spark, d, "part").select("p_partkey", text.norm_key(F.col("p_name")).alias("k"))


@query("select p_partkey, substr(sha256(p_name), 1, 12) as id from part")
def sha_prefix(spark, d):
    return table(spark, d, "part").select("p_partkey", text.sha_prefix(F.col("p_name")).alias("id"))


@query("select p_partkey, cast(cast('0x' || substr(sha256(p_name), 1, 8) as bigint) % 4 as int) as fold from part")
def hash_fold(spark, d):
    return table(spark, d, "part").select("p_partkey", text.hash_fold(F.col("p_name"), 4).alias("fold"))


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where json_extract(props, '$.k') is not null""")
def tolerant_json(spark, d):
    e = table(spark, d, "events").select("event_id", text.json_object(F.col("props")).alias("o"))
    return e.select("event_id", F.from_json("o", "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k")).where("k is not null")


# Scales, tiles, colours


@query("""with s as (select p_partkey, p_size * 1.0::double as a, p_retailprice / 40 as b from part), t as (select min(least(a, b)) as g from s)
select p_partkey, round(sqrt(a * b), 6) as scale, round(abs(a - b) / ((a + b) / 2) * 100, 6) as off_pct, case when g > sqrt(a * b) then 'up' when g = sqrt(a * b) then 'identity' else 'down' end as direction from s, t""")
def scale_geometry(spark, d):
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("a"), (F.col("p_retailprice") / 40).alias("b"))
    both = s.join(F.broadcast(s.agg(F.min(F.least("a", "b")).alias("g"))))  # one row
    e = geometry.effective_scale(F.col("a"), F.col("b"))
    return both.select("p_partkey", r6(e, "scale"), r6(geometry.disagreement_pct(F.col("a"), F.col("b")), "off_pct"), geometry.direction(e, F.col("g")).alias("direction"))


@query("""select p_partkey, x, y from part, unnest(range(0, 50, 16)) a(x), unnest(range(0, 50, 16)) b(y) where x + 16 <= p_size and y + 16 <= p_size + 10""")
def tile_grid(spark, d):
    p = table(spark, d, "part")
    xs, ys = geometry.tile_origins(F.col("p_size"), 16, 16), geometry.tile_origins(F.col("p_size") + 10, 16, 16)
    return p.select("p_partkey", "p_size", F.explode(xs).alias("x")).select("p_partkey", "x", F.explode(ys).alias("y")).select("p_partkey", F.col("x").cast("bigint"), F.col("y").cast("bigint"))


@query("select l_orderkey, l_linenumber, l_partkey, cast(round_even(l_quantity / 2, 0) as bigint) as q from lineitem")
def half_up_even(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", geometry.half_even(F.col("l_quantity") / 2).alias("q"))


@query("select p_partkey, case when p_size / 10.0 < 0.063 then 'fine' when p_size / 10.0 < 2 then 'sand' when p_size / 10.0 < 63 then 'gravel' else 'cobble' end as g from part")
def size_group(spark, d):
    return table(spark, d, "part").select("p_partkey", geometry.size_group(F.col("p_size") / 10.0).alias("g"))


LINEAR = "case when {0} / 255.0::double <= 0.04045 then {0} / 255.0::double / 12.92 else pow(({0} / 255.0::double + 0.055) / 1.055, 2.4) end"
TONE = "case when {0} > 0.008856451679035631::double then pow({0}, 0.3333333333333333::double) else {0} / 0.12841854934601665::double + 0.13793103448275862::double end"
LAB = f"""with c as (select p_partkey, (p_partkey * 7 % 256)::double as r, (p_partkey * 13 % 256)::double as g, (p_size * 5 % 256)::double as b from part),
l as (select p_partkey, {LINEAR.format('r')} as r, {LINEAR.format('g')} as g, {LINEAR.format('b')} as b from c),
x as (select p_partkey, {', '.join(f"({m[0]} * r + {m[1]} * g + {m[2]} * b)::double / {sum(m)!r}::double as x{i}" for i, m in enumerate(geometry.XYZ))} from l),
f as (select p_partkey, {', '.join(f"{TONE.format(f'x{i}')} as f{i}" for i in range(3))} from x)
select p_partkey, round(116 * f1 - 16, 4) as "L", round(500 * (f0 - f1), 4) as "A", round(200 * (f1 - f2), 4) as "B" from f"""


def colours(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", (k * 7 % 256).cast("double").alias("r"), (k * 13 % 256).cast("double").alias("g"), (F.col("p_size") * 5 % 256).cast("double").alias("b"))


@query(LAB)
def lab_colour(spark, d):
    parts = geometry.lab(F.col("r"), F.col("g"), F.col("b"))
    return colours(spark, d).select("p_partkey", *[F.round(c, 4).alias(n) for n, c in zip("LAB", parts, strict=True)])


@query("""with c as (select p_brand, avg((p_partkey * 7 % 256)::double) as r, avg((p_partkey * 13 % 256)::double) as g, avg((p_size * 5 % 256)::double) as b from part group by 1)
select p_brand, round(pow(r * g * b, 0.3333333333333333::double) / r, 6) as gr, round(pow(r * g * b, 0.3333333333333333::double) / g, 6) as gg, round(pow(r * g * b, 0.3333333333333333::double) / b, 6) as gb from c""")
def grey_gains(spark, d):
    c = colours(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(*[F.avg(x).alias(x) for x in "rgb"])
    return c.select("p_brand", *[r6(g, f"g{n}") for n, g in zip("rgb", geometry.grey_gains(F.col("r"), F.col("g"), F.col("b")), strict=True)])


@query("""with c as (select p_partkey, (p_partkey * 7 % 256)::double as r, (p_partkey * 13 % 256)::double as g, (p_size * 5 % 256)::double as b from part)
select p_partkey, round(coalesce(r / nullif(r + g + b, 0), 1.0::double / 3), 6) as cr, round(coalesce(g / nullif(r + g + b, 0), 1.0::double / 3), 6) as cg from c""")
def chromaticity(spark, d):
    cr, cg = geometry.chromaticity(F.col("r"), F.col("g"), F.col("b"))
    return colours(spark, d).select("p_partkey", r6(cr, "cr"), r6(cg, "cg"))


@query("select p_partkey, round((row_number() over (partition by p_brand order by p_retailprice, p_partkey) - 0.5::double) / count(*) over (partition by p_brand), 6) as q from part")
def rank_normalise(spark, d):
    by = Window.partitionBy("p_brand")
    return table(spark, d, "part").select("p_partkey", r6((F.row_number().over(by.orderBy("p_retailprice", "p_partkey")) - 0.5) / F.count(F.lit(1)).over(by), "q"))


@query("""with s as (select label, i, sum(x::double) as s, count(*) as n from (select label, unnest(embedding) as x, unnest(range(0, len(embedding))) as i from embeddings) group by all)
select label, max(n) as n, round(sqrt(sum(s * s)) / max(n), 5) as cohesion from s group by label""")
def cosine_separation(spark, d):
    """Length of each label's mean unit vector: near 1 if its vectors point one way."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    s = e.groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    return s.groupBy("label").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).select("label", "n", F.round(F.sqrt("q") / F.col("n"), 5).alias("cohesion"))


# Evaluation


@query("""with f as (select distinct s_nationkey as fold from supplier) select fold, count(*) filter (s_nationkey = fold) as n_eval, count(*) filter (s_nationkey <> fold) as n_fit from f, supplier group by fold""")
def lofo_folds(spark, d):
    sizes = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("fold")).agg(F.count(F.lit(1)).alias("n_eval"))
    total = sizes.agg(F.sum("n_eval").alias("t"))
    return sizes.join(F.broadcast(total)).select("fold", "n_eval", (F.col("t") - F.col("n_eval")).alias("n_fit"))


@query(f"with {GRID}, b as (select l_returnflag, k from (select *, row_number() over (partition by l_returnflag order by err, k) as n from grid) where n = 1) select l_returnflag, case when k = 20 then 'FLOOR' when k = 30 then 'CEILING' else 'INTERIOR' end as status from b")
def alpha_status(spark, d):
    return argmin_grid(spark, d).select("l_returnflag", F.when(F.col("k") == 20, "FLOOR").when(F.col("k") == 30, "CEILING").otherwise("INTERIOR").alias("status"))


@query("""select a.l_returnflag as source, b.l_returnflag as target, count(*) as n from (select distinct l_suppkey, l_returnflag from lineitem) a join (select distinct l_suppkey, l_returnflag from lineitem) b using (l_suppkey)
where a.l_returnflag <> b.l_returnflag group by all""")
def transfer_directions(spark, d):
    seen = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()
    a, b = seen.withColumnRenamed("l_returnflag", "source"), seen.withColumnRenamed("l_returnflag", "target")
    return a.join(b, "l_suppkey").where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("""with t as (select sum(s_acctbal) as s, count(*) as n from supplier), f as (select s_nationkey, sum(s_acctbal) as s, count(*) as n from supplier group by 1)
select s_suppkey, round(abs(s_acctbal - (t.s - f.s) / (t.n - f.n)), 4) as err from supplier join f using (s_nationkey), t""")
def family_out_constant_error(spark, d):
    s = table(spark, d, "supplier")
    f = s.groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("fs"), F.count(F.lit(1)).alias("fn"))
    t = f.agg(F.sum("fs").alias("ts"), F.sum("fn").alias("tn"))
    return s.join(f, "s_nationkey").join(F.broadcast(t)).select("s_suppkey", F.round(F.abs(F.col("s_acctbal") - (F.col("ts") - F.col("fs")) / (F.col("tn") - F.col("fn"))), 4).alias("err"))


@query("with t as (select sum(s_acctbal) as s, count(*) as n from supplier) select s_suppkey, round((s - s_acctbal) / (n - 1) - s / n, 6) as influence from supplier, t")
def leave_one_influence(spark, d):
    s = table(spark, d, "supplier")
    t = s.agg(F.sum("s_acctbal").alias("s"), F.count(F.lit(1)).alias("n"))
    return s.join(F.broadcast(t)).select("s_suppkey", r6((F.col("s") - F.col("s_acctbal")) / (F.col("n") - 1) - F.col("s") / F.col("n"), "influence"))


@query("select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as level, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem")
def ridge_normal_eq(spark, d):
    x, y = "l_quantity", "l_extendedprice"
    return table(spark, d, "lineitem").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("level"), r6(F.regr_r2(y, x), "r2"))


@query("""with c as (select p_size, count(*) as n, avg(p_retailprice) as e from part group by 1) select round(regr_intercept(e, 1.0::double / p_size), 3) as a, round(regr_slope(e, 1.0::double / p_size), 3) as b, count(*) as n from c""")
def learning_curve_fit(spark, d):
    c = table(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("e")).withColumn("x", F.lit(1.0) / F.col("p_size"))
    return c.agg(F.round(F.regr_intercept("e", "x"), 3).alias("a"), F.round(F.regr_slope("e", "x"), 3).alias("b"), F.count(F.lit(1)).alias("n"))


@query("""with m as (select p_brand, median(p_retailprice) as m from part group by 1), a as (select p_brand, median(abs(p_retailprice - m)) as mad from part join m using (p_brand) group by 1)
select p_partkey, round(abs(p_retailprice - m) / mad, 6) as score from part join m using (p_brand) join a using (p_brand) where mad > 0 and abs(p_retailprice - m) > 1.5 * mad""")
def mad_outliers(spark, d):
    part = table(spark, d, "part")
    dev = part.join(part.groupBy("p_brand").agg(F.median("p_retailprice").alias("m")), "p_brand").withColumn("dev", F.abs(F.col("p_retailprice") - F.col("m")))
    mad = dev.groupBy("p_brand").agg(F.median("dev").alias("mad")).where("mad > 0")
    return dev.join(mad, "p_brand").where("dev > 1.5 * mad").select("p_partkey", r6(F.col("dev") / F.col("mad"), "score"))


@query("""with a as (select l_linestatus as g, avg(l_discount) as m, var_samp(l_discount) as v, count(*) as n from lineitem group by 1)
select round((x.m - y.m) / sqrt(x.v / x.n + y.v / y.n), 5) as t, round((x.m - y.m) / sqrt((x.v + y.v) / 2), 6) as d from a x, a y where x.g = 'F' and y.g = 'O'""")
def welch_t(spark, d):
    side = lambda s, c: F.when(F.col("l_linestatus") == s, F.col(c))
    one = table(spark, d, "lineitem").agg(*[f(side(s, "l_discount")).alias(f"{n}{s}") for s in "FO" for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    gap = F.col("mF") - F.col("mO")
    return one.select(F.round(gap / F.sqrt(F.col("vF") / F.col("nF") + F.col("vO") / F.col("nO")), 5).alias("t"), r6(gap / F.sqrt((F.col("vF") + F.col("vO")) / 2), "d"))


@query("""with a as (select avg(l_quantity) filter (l_linestatus = 'F') as m, stddev_samp(l_quantity) filter (l_linestatus = 'F') as s, avg(l_quantity) filter (l_linestatus = 'O') as t from lineitem) select round((t - m) / s, 6) as shift from a""")
def mechanism_shift(spark, d):
    q = lambda s: F.when(F.col("l_linestatus") == s, F.col("l_quantity"))
    return table(spark, d, "lineitem").agg(r6((F.avg(q("O")) - F.avg(q("F"))) / F.stddev_samp(q("F")), "shift"))


RANGE = " union all ".join(
    f"""select '{f}' as feature, count(*) filter (l_linestatus = 'O' and ({f} < lo or {f} > hi)) as n_outside, round(max(greatest(lo - {f}, {f} - hi, 0)) filter (l_linestatus = 'O') / nullif(max(hi - lo), 0), 6) as excess
from lineitem, (select min({f}) as lo, max({f}) as hi from lineitem where l_linestatus = 'F' and l_quantity between 5 and 45)""" for f in FEATURES)  # fmt: skip


@query(RANGE)
def range_audit(spark, d):
    """Test rows outside the range of a set of training rows, by feature."""
    item = table(spark, d, "lineitem")
    box = item.where("l_linestatus = 'F' and l_quantity between 5 and 45").agg(*[g(f).alias(f"{n}_{f}") for f in FEATURES for n, g in (("lo", F.min), ("hi", F.max))])
    met = item.where("l_linestatus = 'O'").join(F.broadcast(box))  # one row
    over = lambda f: F.greatest(F.col(f"lo_{f}") - F.col(f), F.col(f) - F.col(f"hi_{f}"), F.lit(0.0))
    one = met.agg(*[x for f in FEATURES for x in (F.count_if(over(f) > 0).alias(f"n_{f}"), (F.max(over(f)) / F.nullif(F.max(F.col(f"hi_{f}") - F.col(f"lo_{f}")), F.lit(0.0))).alias(f"x_{f}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("n_outside"), F.round(F.col(f"x_{f}"), 6).alias("excess")) for f in FEATURES])))


@query("select round(corr(abs(l_quantity - 25), abs(l_discount - 0.05)), 6) as rho, count(*) as n from lineitem")
def error_correlation(spark, d):
    return table(spark, d, "lineitem").agg(r6(F.corr(F.abs(F.col("l_quantity") - 25), F.abs(F.col("l_discount") - 0.05)), "rho"), F.count(F.lit(1)).alias("n"))


@query("""with g as (select p_brand, avg(p_retailprice) as m, stddev_samp(p_retailprice) / sqrt(count(*)) as se, (select avg(p_retailprice) from part) as a from part group by 1)
select p_brand, case when m - 1.96 * se > a then 'ABOVE' when m + 1.96 * se < a then 'BELOW' else 'UNRESOLVED' end as verdict from g""")
def verdict_table(spark, d):
    part = table(spark, d, "part")
    g = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), (F.stddev_samp("p_retailprice") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    both = g.join(F.broadcast(part.agg(F.avg("p_retailprice").alias("a"))))  # one row
    return both.select("p_brand", F.when(F.expr("m - 1.96D * se > a"), "ABOVE").when(F.expr("m + 1.96D * se < a"), "BELOW").otherwise("UNRESOLVED").alias("verdict"))


@query("""with e as (select l_suppkey, avg(abs(l_quantity - 25)) filter (l_returnflag = 'A') as a, avg(abs(l_quantity - 25)) filter (l_returnflag = 'N') as n, avg(abs(l_quantity - 25)) filter (l_returnflag = 'R') as r from lineitem group by 1),
c as (select 'A' as arm_a, 'N' as arm_b, a - n as g from e union all select 'A', 'R', a - r from e union all select 'N', 'R', n - r from e)
select arm_a, arm_b, count(g) as n, round(avg(g), 6) as estimate, count(*) filter (g < 0) as wins_a, count(*) filter (g > 0) as wins_b, case when avg(g) < -0.05 then 'A' when avg(g) > 0.05 then 'B' else 'UNRESOLVED' end as verdict from c group by all""")
def paired_contrasts(spark, d):
    e = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg(F.abs(F.col("l_quantity") - 25)).alias("v"))
    return resample.contrasts(e, "l_suppkey", "l_returnflag", "v", [("A", "N"), ("A", "R"), ("N", "R")], 0.05).withColumn("estimate", F.round("estimate", 6))


@query(f"with {CURVES} select l_suppkey, round({d50_sql(q=60.0)}, 6) as d60, round({d50_sql(q=60.0)} - ({d50_sql(q=10.0)}), 6) as log_uniformity from curves")
def diameter_at(spark, d):
    at = lambda q: curves.diameter_at(F.col("y"), q)
    return supplier_curve(spark, d).select("l_suppkey", r6(at(60.0), "d60"), r6(at(60.0) - at(10.0), "log_uniformity"))


@query("select o_orderpriority, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem join orders on l_orderkey = o_orderkey group by 1")
def no_loss_join(spark, d):
    item = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    met = joins.matched_all(item, table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    return met.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity"), "quantity", 2))


@query(f"with {CURVES}, {MEDIANS} " + " union all ".join(f"select {i} as place, round(avg(abs(p{i} - m{i})), 6) as mean_gap from curves, med" for i in range(N)))
def error_profile(spark, d):
    """Mean distance from the median curve at each diameter."""
    gaps = against_median(spark, d).agg(*[F.avg(F.abs(F.col("y")[i] - F.col("m")[i])).alias(f"g{i}") for i in range(N)])
    return gaps.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.round(f"g{i}", 6).alias("mean_gap")) for i in range(N)])))


FAMILY = "join supplier on l_suppkey = s_suppkey group by s_nationkey"


@query(f"""with {CURVES}, noisy as (select l_suppkey, {NOISY} from curves), mono as (select l_suppkey, {RUNNING} from noisy),
a as (select s_nationkey, {", ".join(f"avg(z{i}) as a{i}" for i in range(N))} from mono {FAMILY}), mean as (select s_nationkey, {", ".join(f"avg(v{i}) as v{i}" for i in range(N))} from noisy {FAMILY}),
b as (select s_nationkey, {RUNNING} from mean) select s_nationkey, round({emd_sql("a.a", "b.z")}, 6) as gap from a join b using (s_nationkey)""")
def aggregation_arms(spark, d):
    """By family: the mean of monotone curves against the monotone form of the mean curve."""
    noisy = supplier_curve(spark, d).select("l_suppkey", F.array(*[F.col("y")[i] + F.lit(40) * F.sin(F.col("l_suppkey") + i) for i in range(N)]).alias("v"))
    rows = noisy.withColumn("z", curves.monotone(F.col("v"))).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    mean = lambda c: F.array(*[F.avg(F.col(c)[i]) for i in range(N)]).alias(c)
    both = rows.groupBy("s_nationkey").agg(mean("z"), mean("v")).withColumn("once", curves.monotone(F.col("v")))
    return both.select("s_nationkey", r6(curves.emd_trapezoid(F.col("z"), F.col("once")), "gap"))


@query("""with a as (select o_orderpriority as arm, o_orderstatus as c, avg(o_totalprice) as v from orders group by all), w as (select arm, max(v) filter (c = 'F') as main, max(v) as worst from a group by 1)
select (select arm from w order by main, arm limit 1) as primary_arm, (select arm from w order by worst, arm limit 1) as minimax_arm""")
def primary_arm(spark, d):
    """The arm best under the main condition, and the one whose worst condition is best; ties to the first name."""
    a = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("c")).agg(F.avg("o_totalprice").alias("v"))
    w = a.groupBy("arm").agg(F.max(F.when(F.col("c") == "F", F.col("v"))).alias("main"), F.max("v").alias("worst"))
    return w.agg(*[F.min_by("arm", F.struct(by, "arm")).alias(name) for by, name in (("main", "primary_arm"), ("worst", "minimax_arm"))])


@query(" union all ".join(f"""select '{f}' as feature, round((avg({f}) filter (l_linestatus = 'O') - avg({f}) filter (l_linestatus = 'F')) / stddev_samp({f}) filter (l_linestatus = 'F'), 5) as shift from lineitem""" for f in FEATURES))
def domain_shift(spark, d):
    """Shift of each feature's mean between two splits, in standard deviations of the first."""
    side = lambda s, f: F.when(F.col("l_linestatus") == s, F.col(f))
    one = table(spark, d, "lineitem").agg(*[((F.avg(side("O", f)) - F.avg(side("F", f))) / F.stddev_samp(side("F", f))).alias(f) for f in FEATURES])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f, 5).alias("shift")) for f in FEATURES])))


LEGACY = [1e-6 + (1.0 - 1e-6) * i / (N - 1) for i in range(N)]


@query(f"with {CURVES}, up as (select l_suppkey, {', '.join(f'greatest(p{i}, {LEGACY[i]!r}::double) as u{i}' for i in range(N))} from curves) select l_suppkey, round({d50_sql('u')}, 6) as log_d50 from up")
def d50_legacy(spark, d):
    return supplier_curve(spark, d).select("l_suppkey", r6(curves.diameter_legacy(F.col("y")), "log_d50"))


@query(f"with {CURVES}, {MEDIANS}, b as (select l_suppkey, {', '.join(f'm{i} + 2.0::double * (p{i} - m{i}) as v{i}' for i in range(N))} from curves, med), z as (select l_suppkey, {RUNNING} from b) select l_suppkey, round(z0, 6) as z0, round(z4, 6) as z4, round(z9, 6) as z9 from z")
def expansion(spark, d):
    c = against_median(spark, d).select("l_suppkey", curves.expanded(F.col("y"), F.col("m"), 2.0).alias("z"))
    return c.select("l_suppkey", *[r6(F.col("z")[i], f"z{i}") for i in (0, 4, 9)])


@query("select p_partkey, round(sqrt(greatest(power(p_size / 4.0::double, 2) - 25, 0) / 12), 6) as sigma, p_size / 10.0::double >= 7 / 3.0::double as resolved from part")
def antialias_resolvable(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", r6(geometry.antialias_sigma(size / 4.0, F.lit(5.0)), "sigma"), geometry.resolvable(size / 10.0, F.lit(7.0)).alias("resolved"))


@query("select count(*) as n, round(sum(l_quantity), 4) as total, count(distinct l_suppkey) as keys from (select l_suppkey, sum(l_quantity) as l_quantity from lineitem group by 1)")
def row_permutation(spark, d):
    """What a permutation keeps: rows, keys and the permuted column's total."""
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("l_quantity"))
    mixed = resample.row_permutation(s, "l_suppkey", ["l_quantity"], 7)
    return mixed.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("total"), F.countDistinct("l_suppkey").alias("keys"))


@query("select event_id, 1 as n_candidates, cast(json_extract(props, '$.k') as double) as k from events")
def json_replies(spark, d):
    """Replies in prose and code fences: candidates, and the first that has its key as a number."""
    reply = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    e = table(spark, d, "events").select("event_id", text.json_candidates(reply).alias("c"))
    return e.select("event_id", F.size("c").alias("n_candidates"), text.first_valid(F.col("c"), "k double", ["k"])["k"].alias("k"))


# Contracts

RULES = {"quantity positive": "l_quantity > 0", "discount below 5 percent": "l_discount < 0.05", "ship date known": "l_shipdate is not null"}


@query(" union all ".join(f"""select '{n}' as "check", count(*) filter (not coalesce({c}, false)) = 0 as ok, count(*) filter (not coalesce({c}, false)) as n_bad from lineitem""" for n, c in RULES.items()))
def audit_checks(spark, d):
    return contracts.audit(table(spark, d, "lineitem"), {n: F.expr(c) for n, c in RULES.items()})


@query(f"with {CURVES} select l_suppkey, {' and '.join(f'p{i} >= p{i - 1}' for i in range(1, N))} and p0 >= 0 and p10 = 100 as valid from curves")
def submission_contract(spark, d):
    return supplier_curve(spark, d).select("l_suppkey", curves.valid(F.col("y")).alias("valid"))


@query("""with b as (select p_partkey, sha256(p_name) as h from part where p_size > 5), a as (select p_partkey, sha256(case when p_retailprice > 1500 then p_name || '!' else p_name end) as h from part where p_size < 45)
select coalesce(b.p_partkey, a.p_partkey) as p_partkey, case when b.h is null then 'added' when a.h is null then 'missing' else 'changed' end as change from b full outer join a on b.p_partkey = a.p_partkey where b.h is distinct from a.h""")
def source_integrity(spark, d):
    """Two listings of parts: small ones came, large ones went, dear ones were renamed."""
    part = table(spark, d, "part")
    digest = lambda c: F.sha2(c.cast("binary"), 256).alias("h")
    before = part.where("p_size > 5").select("p_partkey", digest(F.col("p_name")))
    after = part.where("p_size < 45").select("p_partkey", digest(F.when(F.col("p_retailprice") > 1500, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))))
    return contracts.changes(before, after, "p_partkey", "h")


@query("select l_orderkey, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def contract_violations(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("l_orderkey", "n")


CENSUS = " union all ".join(
    f"""select '{f}' as "column", count(*) as n, count(*) filter ({f} is null) as n_null, count(*) filter (isnan({f})) as n_nan, count(*) filter (isinf({f})) as n_inf,
round(quantile_cont({f}, 0.05), 4) as p05, round(quantile_cont({f}, 0.5), 4) as p50, round(quantile_cont({f}, 0.95), 4) as p95 from lineitem""" for f in FEATURES)  # fmt: skip


@query(CENSUS)
def census(spark, d):
    out = columns.census(table(spark, d, "lineitem"), FEATURES)
    return out.select("column", "n", "n_null", "n_nan", "n_inf", *[F.round(c, 4).alias(c) for c in ("p05", "p50", "p95")])


@query("""with s as (select s_nationkey, count(*) as n, median(s_acctbal) as m, quantile_cont(s_acctbal, 0.75) - quantile_cont(s_acctbal, 0.25) as w from supplier group by 1),
t as (select median(s_acctbal) as m0, quantile_cont(s_acctbal, 0.75) - quantile_cont(s_acctbal, 0.25) as w0 from supplier)
select s_suppkey, round((s_acctbal - case when n < 4 then m0 else m end) / nullif(case when n < 4 then w0 else w end, 0), 6) as z from supplier join s using (s_nationkey), t""")
def group_scale_fallback(spark, d):
    return columns.robust_by_group(table(spark, d, "supplier"), "s_nationkey", "s_acctbal", "z").select("s_suppkey", r6("z", "z"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) as length, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as first from embeddings")
def unit_vectors(spark, d):
    e = table(spark, d, "embeddings").withColumn("u", columns.unit("embedding"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("vec_id", F.round(length, 4).alias("length"), F.round(F.col("u")[0], 5).alias("first"))


# Windows over events


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, d):
    return stream_events.windowed(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


# What SQL can't express: checked against golden values and brute force in the tests


def design(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with their features, curves and families, for the evaluation protocols."""
    y = supplier_curve(spark, d)
    x = aggregate.two_stage(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], "l_suppkey", FEATURES).select("l_suppkey", F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("family"))
    return y.join(x, "l_suppkey").join(s, "l_suppkey").select(F.col("l_suppkey").cast("string").alias("sample_id"), "family", "x", "y")


@query()
def frozen_head_lofo(spark, d):
    return evaluation.strict_protocol(design(spark, d))


@query()
def historical_head_lofo(spark, d):
    return evaluation.historical_protocol(design(spark, d))


@query()
def pca_floors(spark, d):
    return models.rank_floors(supplier_curve(spark, d), "y", N)


@query()
def linkage_families(spark, d):
    return models.linkage_families(supplier_curve(spark, d), "l_suppkey", "y", 14.0)


@query()
def coral_align(spark, d):
    item = table(spark, d, "lineitem").select("l_linestatus", F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x"))
    source = item.where("l_linestatus = 'F'")
    a, b = models.coral(source, item.where("l_linestatus = 'O'"), "x", len(FEATURES))
    moved = models.transformed(source, "x", a, b, "z")
    return moved.agg(*[F.avg(F.col("z")[i]).alias(f) for i, f in enumerate(FEATURES)])


@query()
def cluster_bootstrap(spark, d):
    gaps = paired_entities(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return evaluation.cluster_bootstrap(gaps, "s_nationkey", "gap")


@query()
def permutation_null(spark, d):
    s = supplier_curve(spark, d).select("l_suppkey", F.col("y")[4].alias("a"), F.col("y")[5].alias("b"))
    return evaluation.permutation_null(s, "l_suppkey", "a", "b")


@query()
def poly2_shape_fit(spark, d):
    c = supplier_curve(spark, d).select(curves.diameter_at(F.col("y"), 50.0).alias("v"), F.col("y")[6].alias("t")).withColumn("v2", F.col("v") * F.col("v"))
    return models.least_squares(c, ["v", "v2"], "t")


@query()
def pixel_features(spark, d):
    """Features of each vector seen as a square grey image."""
    side = F.sqrt(F.size("embedding")).cast("int")
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x.cast("double") * 255 + 128)))
    images = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), side.alias("h"), side.alias("w"), grey.alias("pixels"))
    return pixels.features(images)


@query()
def learning_curve(spark, d):
    return evaluation.learning_curve(design(spark, d), (4, 6, 8, 10, 12, 14, 16, 18, 20, 21))


@query()
def kmeans_purity(spark, d):
    return models.kmeans_purity(table(spark, d, "embeddings"), "embedding", "label", 10)


@query()
def weibull_polish(spark, d):
    """Two-parameter forms, from the whole grid and three starts."""
    return models.weibull_oracle(supplier_curve(spark, d), "l_suppkey", "y")
