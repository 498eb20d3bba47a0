"""Registered queries of contracts, readouts and choices that other modules' queries don't cover."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import stats, text
from siltstone.operators import columns, contracts
from siltstone.plans.queries import CURVES, FEATURES, N, P, query, r6, supplier_curve
from siltstone.sources.io import table

SENT = f"""{CURVES}, sent as (select case when l_suppkey % 9 = 0 then -l_suppkey else l_suppkey end as k, case when l_suppkey % 4 = 0 then l_suppkey + 1 else l_suppkey end as pos,
{', '.join('case when l_suppkey % 7 = 0 then null else p3 + 0.0 end as p3' if i == 3 else 'p2 + case when l_suppkey % 5 = 0 then 90 else 0 end as p2' if i == 2 else p for i, p in enumerate(P[:-1]))},
p10 - case when l_suppkey % 11 = 0 then 1 else 0 end as p10 from curves where l_suppkey % 10 <> 9)"""


@query(f"""with {SENT}, bad as (select (select count(*) from curves where l_suppkey not in (select k from sent)) as missing, count(*) filter (k not in (select l_suppkey from curves)) as unknown,
count(*) filter (k in (select l_suppkey from curves) and pos <> k) as misplaced, count(*) filter (p3 is null) as nulls, count(*) filter (greatest({', '.join(f'coalesce({p}, 0)' for p in P)}) > 100) as beyond,
count(*) filter ({' or '.join(f'coalesce({b} < {a}, false)' for a, b in zip(P, P[1:]))}) as falling, count(*) filter (p10 <> 100) as short from sent)
select unnest(['columns', 'missing keys', 'unknown keys', 'repeated keys', 'order', 'finite', 'range', 'monotone', 'last is 100']) as "check", unnest([0, missing, unknown, 0, misplaced, nulls, beyond, falling, short]) as n_bad,
unnest([true, missing = 0, unknown = 0, true, misplaced = 0, nulls = 0, beyond = 0, falling = 0, short = 0]) as ok from bad""")
def submission_checks(spark, d):
    """A delivered table with keys missing and unknown, rows out of place, and values missing, too large, falling or short at the end."""
    c, k = supplier_curve(spark, d).select("l_suppkey", *[F.col("y")[i].alias(p) for i, p in enumerate(P)]), F.col("l_suppkey")
    sent = c.where(k % 10 != 9).select(
        F.when(k % 4 == 0, k + 1).otherwise(k).alias("at"), F.when(k % 9 == 0, -k).otherwise(k).alias("k"), *[F.when(k % 7 != 0, F.col(p)).alias(p) if i == 3 else (F.col(p) + F.when(k % 5 == 0, 90).otherwise(0)).alias(p) if i == 2 else (F.col(p) - F.when(k % 11 == 0, 1).otherwise(0)).alias(p) if i == N - 1 else p for i, p in enumerate(P)]
    )
    return contracts.submission_report(sent, c.select(k.alias("k"), k.alias("at")), "k", "at", P)


@query("""with r as (select p_brand, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0::double as a,
rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2.0::double as b from part), s as (select p_brand, count(*) as n, corr(a, b) as rho from r group by 1)
select p_brand, n, round(rho, 6) as rho, round(2.5 / sqrt(n - 1), 6) as noise_floor, abs(rho) > 2.5 / sqrt(n - 1) as above from s where n > 1""")
def rank_correlation_floor(spark, d):
    """Rank correlations against the level that as many rows without one hardly exceed."""
    s = stats.spearman(table(spark, d, "part"), "p_size", "p_retailprice", "p_brand").where("n > 1").withColumn("f", stats.noise_floor(F.col("n")))
    return s.select("p_brand", "n", r6("rho", "rho"), r6("f", "noise_floor"), (F.abs("rho") > F.col("f")).alias("above"))


def shift_sql(f: str, column: str, a: str, b: str) -> str:
    return f"(avg({f}) filter ({column} = '{b}') - avg({f}) filter ({column} = '{a}')) / stddev_samp({f}) filter ({column} = '{a}')"


@query(" union all ".join(f"select '{f}' as feature, round({shift_sql(f, 'l_linestatus', 'F', 'O')}, 5) as observed, round({shift_sql(f, 'l_returnflag', 'A', 'R')}, 5) as made, sign({shift_sql(f, 'l_linestatus', 'F', 'O')}) = sign({shift_sql(f, 'l_returnflag', 'A', 'R')}) as agree from lineitem" for f in FEATURES))
def shift_agreement(spark, d):
    """Whether a second split shifts each feature the same way as the first, in one aggregation."""
    side = lambda c, v, f: F.when(F.col(c) == v, F.col(f))
    shift = lambda f, c, a, b: (F.avg(side(c, b, f)) - F.avg(side(c, a, f))) / F.stddev_samp(side(c, a, f))
    rows = [F.struct(F.lit(f).alias("feature"), shift(f, "l_linestatus", "F", "O").alias("o"), shift(f, "l_returnflag", "A", "R").alias("m")) for f in FEATURES]
    one = table(spark, d, "lineitem").agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return one.select("feature", r6("o", "observed", 5), r6("m", "made", 5), (F.signum("o") == F.signum("m")).alias("agree"))


COUNTS = {"a": 5, "b": 3, "c": 2, "d": 2}
LEVEL = {"a": 25, "b": 26, "c": 26, "d": 20}


@query(f"""with g as (select l_returnflag as ruler, arm, k, nf, avg(abs(l_quantity - k)) as err from lineitem, (values {', '.join(f"('{a}', {LEVEL[a]}, {COUNTS[a]})" for a in COUNTS)}) t(arm, k, nf) group by all),
w as (select arm, nf, round(max(err), 6) as worst, round(max(err) filter (ruler = 'A'), 6) as main from g group by all)
select arm, nf as features, main, worst, row_number() over (order by main, nf, arm) = 1 as is_primary, row_number() over (order by worst, nf, arm) = 1 as is_minimax from w""")
def arm_choice_by_features(spark, d):
    """The arm best by its main ruler and that of the best worst ruler; ties go to fewer features, then by name."""
    err = [F.avg(F.abs(F.col("l_quantity") - LEVEL[a])).alias(a) for a in COUNTS]
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*err)
    long = g.select("l_returnflag", F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(n).alias("features"), F.col(a).alias("err")) for a, n in COUNTS.items()])))
    w = long.groupBy("arm", "features").agg(r6(F.max("err"), "worst"), r6(F.max(F.when(F.col("l_returnflag") == "A", F.col("err"))), "main"))  # one row an arm
    first = lambda by: F.row_number().over(Window.orderBy(by, "features", "arm")) == 1
    return w.select("arm", "features", "main", "worst", first("main").alias("is_primary"), first("worst").alias("is_minimax"))


@query("""with q as (select l_suppkey, quantile_cont(l_quantity, 0.1) as d10, case when l_suppkey % 6 = 0 then 0 else quantile_cont(l_quantity, 0.5) end as d50, quantile_cont(l_quantity, 0.9) as d90,
count(*) filter (l_quantity < 10) * 100.0::double / count(*) as a, count(*) filter (l_quantity between 10 and 30) * 100.0::double / count(*) as b, count(*) filter (l_quantity > 30) * 100.0::double / count(*) + l_suppkey % 3 as c from lineitem group by 1)
select l_suppkey, l_suppkey % 5 <> 0 as valid, case when l_suppkey % 5 <> 0 then round(a + b + c, 6) end as sum_pct, case when l_suppkey % 5 <> 0 then abs(a + b + c - 100) <= 1 + 1e-9 end as whole, case when l_suppkey % 5 <> 0 then d10 <= d50 and d50 <= d90 end as monotone_d from q""")
def reply_notes(spark, d):
    """Replies in prose with six numbers: the first whole one, and notes on its shares and diameters."""
    q, n = lambda p: stats.quantile("l_quantity", p), F.count(F.lit(1))
    k = F.col("l_suppkey")
    share = lambda c: F.count_if(c) * 100.0 / n
    quantity = F.col("l_quantity")
    e = table(spark, d, "lineitem").groupBy("l_suppkey").agg(q(0.1).alias("d10_mm"), q(0.5).alias("d50_mm"), q(0.9).alias("d90_mm"), share(quantity < 10).alias("fines_pct"), share(quantity.between(10, 30)).alias("sand_pct"), share(quantity > 30).alias("gravel_pct"))
    e = e.withColumn("d50_mm", F.when(k % 6 == 0, 0.0).otherwise(F.col("d50_mm"))).withColumn("gravel_pct", F.col("gravel_pct") + k % 3)
    keys = ["d10_mm", "d50_mm", "d90_mm", "fines_pct", "sand_pct", "gravel_pct"]
    said = F.concat(F.lit('I think {"d10_mm": 1} no:\\n```json\\n'), F.when(k % 5 != 0, F.to_json(F.struct(*keys))).otherwise("{}"), F.lit("\\n```"))
    first = text.first_valid(text.json_candidates(said), ", ".join(f"{c} double" for c in keys), keys)
    out = e.select("l_suppkey", first.alias("r")).withColumn("n", text.reply_notes(F.col("r"), keys[3:], keys[:3], 1 + 1e-9))
    there = F.col("r").isNotNull()
    return out.select("l_suppkey", there.alias("valid"), F.when(there, F.round("n.sum_pct", 6)).alias("sum_pct"), F.when(there, F.col("n.whole")).alias("whole"), F.when(there, F.col("n.monotone_d")).alias("monotone_d"))


@query("""with e as (select label, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from embeddings), m as (select label, list(x order by i) as c from (select label, i, avg(x) as x from e group by all) group by label)
select vec_id, round(list_cosine_distance(list_transform(embedding, lambda x: x::double), c), 6) as distance from embeddings join m using (label)""")
def centroid_distance(spark, d):
    """Each vector's cosine distance from the mean of its label."""
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))  # one value a dimension
    return e.join(centre, "label").select("vec_id", r6(stats.cosine_distance(F.col("embedding"), F.col("c")), "distance"))


@query("select p_partkey, upper(left(regexp_extract(p_brand, '([A-Za-z])[^0-9]*([0-9])', 1), 1)) || regexp_extract(p_brand, '([A-Za-z])[^0-9]*([0-9])', 2) as family from part")
def letter_families(spark, d):
    return table(spark, d, "part").select("p_partkey", text.letter_family(F.col("p_brand")).alias("family"))


@query("""select l_orderkey, l_linenumber, round(l_tax / abs(l_quantity - 25), 8) as rate from lineitem where l_quantity <> 25""")
def finite_rates(spark, d):
    """A quotient with a divisor that may be zero, its infinite and missing values left out."""
    rate = F.when(F.col("l_quantity") != 25, F.col("l_tax") / F.abs(F.col("l_quantity") - 25)).otherwise(F.when(F.col("l_tax") > 0, float("inf")).otherwise(float("nan")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rate.alias("r"))
    return columns.finite_rows(rows, ["r"]).select("l_orderkey", "l_linenumber", r6("r", "rate", 8))
