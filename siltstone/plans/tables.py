"""More registered queries: checked joins, contracts, names, geometry, protocols of evaluation.

They use the hierarchy of `queries` and register in its dictionaries.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import curves, geometry, stats, text
from siltstone.operators import contracts, evaluation, imaging, joins, masked, models, pixels
from siltstone.plans.queries import CURVES, LINE, MEDIANS, N, NEAREST, P, WEIBULL, against_median, emd_sql, query, query_pairs, r6, supplier_curve
from siltstone.sources.io import table

# Filters, names and keys


@query("select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def members_of_a_set(spark, d):
    return table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("select s_suppkey, s_nationkey from supplier")
def banned_columns_dropped(spark, d):
    return contracts.without(table(spark, d, "supplier"), ["s_name", "s_acctbal", "not_there"])


@query("select o_orderkey, o_custkey, cast(n as bigint) as n from (select o_orderkey, o_custkey, count(*) over (partition by o_custkey, o_orderpriority, o_orderstatus) as n from orders) where n > 1")
def repeated_rows(spark, d):
    again = F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "o_orderpriority", "o_orderstatus"))
    return table(spark, d, "orders").withColumn("n", again).where("n > 1").select("o_orderkey", "o_custkey", "n")


@query("select l_orderkey, l_linenumber, l_partkey, l_linenumber as x0, l_linenumber * 2 as y0, l_linenumber + 10 as x1, l_linenumber * 3 + 20 as y1 from lineitem where l_linenumber < 5")
def parsed_rectangles(spark, d):
    n = F.col("l_linenumber")
    packed = F.when(n < 5, F.concat_ws(", ", n, n * 2, n + 10, n * 3 + 20)).otherwise(F.concat_ws(",", n, n))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.rectangle(packed).alias("rect"))
    return rows.where("rect is not null").select("l_orderkey", "l_linenumber", "l_partkey", "rect.*")


@query("""select s_suppkey, case when s_nationkey % 3 = 0 then 'N' || s_nationkey when s_nationkey % 3 = 1 then 'N1' end as sample, 'site ' || s_nationkey as name, split_part(trim(s_name), '#', 1) as plain from supplier""")
def names_taken_apart(spark, d):
    s, nation = table(spark, d, "supplier"), F.col("s_nationkey").cast("string")
    file = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("IMG_N"), nation, F.lit("-top"))).when(F.col("s_nationkey") % 3 == 1, F.concat(F.lit("N1/xN"), nation)).otherwise(F.concat(F.lit("aN"), nation))
    ids = F.array(F.concat(F.lit("N"), F.when(F.col("s_nationkey") % 3 == 0, nation).otherwise(F.lit("none"))), F.lit("N1"))
    named = text.stripped_name(F.concat(F.lit("Phone16_HPC_site "), nation, F.lit(" (3)")), "Phone1[46]_HPC_")
    first = text.without_nul(F.replace(F.col("s_name"), F.lit("#"), F.lit("\0 ")))
    return s.select("s_suppkey", text.sample_token(file, ids).alias("sample"), named.alias("name"), text.first_token(first).alias("plain"))


@query("""select f, round(median(m), 6) as price, count(*) as n from (select split_part(p_type, ' ', 1) as f, p_brand, median(p_retailprice) as m from part group by all) group by f""")
def median_by_first_token(spark, d):
    part = table(spark, d, "part").withColumn("f", text.first_token(F.col("p_type")))
    return part.groupBy("f", "p_brand").agg(F.median("p_retailprice").alias("m")).groupBy("f").agg(r6(F.median("m"), "price"), F.count(F.lit(1)).alias("n"))


# Counts and running shares


@query("""select o_orderpriority as value, count(*) as n, cast(row_number() over (order by count(*) desc, o_orderpriority) as int) as place from orders group by 1""")
def value_counts(spark, d):
    counted = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")))  # one row a priority


@query("""select count(s_acctbal) as n, round(avg(s_acctbal), 6) as mean, round(stddev_samp(s_acctbal), 6) as sd, min(s_acctbal) as least, round(quantile_cont(s_acctbal, 0.25), 6) as q25,
round(quantile_cont(s_acctbal, 0.5), 6) as q50, round(quantile_cont(s_acctbal, 0.75), 6) as q75, max(s_acctbal) as most from supplier""")
def described(spark, d):
    q = lambda p, n: r6(stats.quantile("s_acctbal", p), n)
    return table(spark, d, "supplier").agg(F.count("s_acctbal").alias("n"), r6(F.avg("s_acctbal"), "mean"), r6(F.stddev_samp("s_acctbal"), "sd"), F.min("s_acctbal").alias("least"), q(0.25, "q25"), q(0.5, "q50"), q(0.75, "q75"), F.max("s_acctbal").alias("most"))


@query("""with m as (select p_brand, p_size, avg(p_retailprice) / 100 as l from part group by all), w as (select *, exp(l - max(l) over (partition by p_brand)) as e from m)
select p_brand, p_size, round(sum(e) over (partition by p_brand order by p_size rows unbounded preceding) / sum(e) over (partition by p_brand) * 100, 6) as cdf from w""")
def softmax_cdf(spark, d):
    m = table(spark, d, "part").groupBy("p_brand", "p_size").agg((F.avg("p_retailprice") / 100).alias("l"))
    return stats.softmax_cdf(m, "p_brand", "p_size", "l", "cdf").select("p_brand", "p_size", r6("cdf", "cdf"))


@query("select c_custkey, cast(row_number() over (partition by c_nationkey order by c_mktsegment, c_custkey desc) as int) as place from customer")
def submission_order(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment", F.desc("c_custkey"))).alias("place"))


@query("""with t as (select *, p_size <= 25 as train from part)
select p_partkey, round(case when train then (sum(train::int) over (partition by p_brand order by p_retailprice, p_partkey rows unbounded preceding) - 0.5) / sum(train::int) over (partition by p_brand)
else (sum(train::int) over (partition by p_brand order by p_retailprice) - sum(train::int) over (partition by p_brand, p_retailprice)) * 1.0::double / sum(train::int) over (partition by p_brand) end, 6) as q from t""")
def rank_normalise_test(spark, d):
    return stats.train_quantile(table(spark, d, "part").withColumn("train", F.col("p_size") <= 25), "p_brand", "p_retailprice", "train", "p_partkey", "q").select("p_partkey", r6("q", "q"))


MAD = """with x as (select o_orderpriority as g, case when o_orderpriority like '1%' then 5.0::double else o_totalprice end as v from orders), m as (select g, median(v) as m, median(ln(v)) as lm from x where v > 0 group by g),
e as (select g, abs(v - m) as a, abs(ln(v) - lm) as b from x join m using (g)), s as (select g, median(a) as sa, median(b) as sb from e group by g)
select g, count(*) as n, round(max(sa), 4) as mad, case when max(sa) > 0 then 'ok' else 'degenerate' end as status, case when max(sa) > 0 then count(*) filter (a > 2 * sa) end as outliers, case when max(sb) > 0 then count(*) filter (b > 2 * sb) end as log_outliers from e join s using (g) group by g"""


@query(MAD)
def mad_report(spark, d):
    v = F.when(F.col("o_orderpriority").startswith("1"), F.lit(5.0)).otherwise(F.col("o_totalprice"))
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), v.alias("v"))
    return stats.mad_report(rows, "g", "v", 2.0).withColumn("mad", F.round("mad", 4))


# Joins that check


@query("select a.n_nationkey as i, b.n_nationkey as j from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def pairs_below(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("i")), n.select("n_regionkey", F.col("n_nationkey").alias("j"))
    return a.join(b, "n_regionkey").where("i < j").select("i", "j")


@query("select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey")
def left_join_checked(spark, d):
    return joins.left_checked(table(spark, d, "customer"), table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"], ["n_name"]).select("c_custkey", "n_name")


@query("""select coalesce(a.k, b.k) as k, case when b.k is null then 'left' else 'right' end as side from (select distinct o_custkey as k from orders where o_orderstatus = 'F') a
full join (select distinct o_custkey as k from orders where o_orderstatus = 'O') b on a.k = b.k where a.k is null or b.k is null""")
def key_set_difference(spark, d):
    keys = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return joins.key_difference(keys("F"), keys("O"), "k")


@query("""with a as (select l_suppkey as k, avg(l_quantity) as quantity, avg(l_discount) as discount from lineitem group by 1), b as (select s_suppkey as k, s_acctbal as balance from supplier where s_suppkey in (select k from a))
select k, round(quantity, 6) as quantity, round(discount, 6) as discount, balance from a join b using (k)""")
def fused_blocks(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance")).join(a.select("k"), "k", "left_semi")
    return joins.fused([a, b], "k").select("k", r6("quantity", "quantity"), r6("discount", "discount"), "balance")


# Contracts


@query("""with v as (select embedding as e from embeddings), n as (select min(sqrt(list_sum(list_transform(e, lambda x: x::double * x::double)))) as a, max(sqrt(list_sum(list_transform(e, lambda x: x::double * x::double)))) as b from v),
s as (select i, stddev_pop(x::double) as sd from (select unnest(e) as x, unnest(range(0, len(e))) as i from v) group by i)
select count(*) as rows, min(len(e)) as least_width, max(len(e)) as most_width, count(*) filter (len(list_filter(e, lambda x: not isfinite(x))) > 0) as bad,
round((select a from n), 5) as least_norm, round((select b from n), 5) as most_norm, (select count(*) from s where sd <= 1e-12) as dead from v""")
def embedding_contract(spark, d):
    one = contracts.vectors(table(spark, d, "embeddings"), "embedding")
    return one.select("rows", F.col("least_width").cast("long"), F.col("most_width").cast("long"), "bad", r6("least_norm", "least_norm", 5), r6("most_norm", "most_norm", 5), "dead")


@query("""select * from (select 'no_order' as "check", count(*) as failures from (select distinct l_orderkey from lineitem) where l_orderkey not in (select o_orderkey from orders) union all
select 'idle_customer', count(*) from customer where c_custkey not in (select o_custkey from orders) union all select 'low_balance', count(*) from supplier where s_acctbal < 5000 union all select 'no_size', count(*) from part where p_size is null) where failures > 0""")
def verify_all(spark, d):
    t = lambda n: table(spark, d, n)
    orders = t("orders")
    return contracts.violations({
        "no_order": t("lineitem").select("l_orderkey").distinct().join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "idle_customer": t("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti"),
        "low_balance": t("supplier").where("s_acctbal < 5000"), "no_size": t("part").where("p_size is null")})


@query("""with m as (select l_orderkey as k, count(*) as n, max(l_linenumber) as top, count(distinct l_linenumber) as kinds from lineitem group by 1)
select count(*) as items, count(*) filter (n <> top) as gaps, count(*) filter (kinds <> n) as twice, round(avg(n), 6) as mean_lines from m""")
def rederived_guarantee(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("top"), F.count_distinct("l_linenumber").alias("kinds"))
    return m.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("n") != F.col("top")).alias("gaps"), F.count_if(F.col("kinds") != F.col("n")).alias("twice"), r6(F.avg("n"), "mean_lines"))


@query("""with t as (select conv_id, turn, text, lag(turn) over (partition by conv_id order by turn) as before from conversations)
select count(*) as replies, count(*) - count(distinct (conv_id, turn)) as repeated, count(*) filter (before is not null and turn <> before + 1) as gaps, round(avg(case when text is null or trim(text) = '' then 1.0 else 0.0 end), 6) as empty_rate from t""")
def reply_audit(spark, d):
    t = table(spark, d, "conversations").withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    empty = F.col("text").isNull() | (F.trim("text") == "")
    one = t.agg(F.count(F.lit(1)).alias("replies"), F.count_if(F.col("turn") != F.col("before") + 1).alias("gaps"), r6(F.avg(empty.cast("double")), "empty_rate"))
    distinct = t.select("conv_id", "turn").distinct().agg(F.count(F.lit(1)).alias("kinds"))
    return one.join(distinct).select("replies", (F.col("replies") - F.col("kinds")).alias("repeated"), "gaps", "empty_rate")  # one-row frames


# Geometry and colour


@query("""with s as (select p_partkey, p_size * 37 as px, p_retailprice / 40 as s from part), t as (select min(s) as g from s), c as (select p_partkey, px, s, g, cast(round_even(px * g / s, 0) as bigint) as n from s, t)
select p_partkey, n, round((n / g) / (px / s) * 100 - 100, 5) as error_pct from c""")
def canvas_error(spark, d):
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37).alias("px"), (F.col("p_retailprice") / 40).alias("s"))
    n, error = geometry.canvas(F.col("px"), F.col("s"), F.col("g"))
    return s.join(F.broadcast(s.agg(F.min("s").alias("g")))).select("p_partkey", n.alias("n"), r6(error, "error_pct", 5))  # one row


@query("""select p_partkey, abs((greatest(p_size, 30) * 1.0::double / least(p_size, 30)) / (greatest(p_partkey % 50 + 1, 30) * 1.0::double / least(p_partkey % 50 + 1, 30)) - 1) > 0.01 as mismatch from part""")
def aspect_flags(spark, d):
    flag = geometry.aspect_mismatch(F.col("p_size"), F.lit(30), F.col("p_partkey") % 50 + 1, F.lit(30))
    return table(spark, d, "part").select("p_partkey", flag.alias("mismatch"))


@query("""with g as (select p_partkey, x, y from part, unnest(range(0, 50, 16)) a(x), unnest(range(0, 50, 16)) b(y) where x + 16 <= p_size and y + 16 <= p_size)
select p_partkey || '_' || lpad((y // 16)::varchar, 2, '0') || '_' || lpad((x // 16)::varchar, 2, '0') as tile_id, p_partkey, cast(x // 16 as int) as col, cast(y // 16 as int) as row, round(16 / (1 + p_partkey % 7 * 1.0::double), 6) as width_mm from g""")
def tile_rows(spark, d):
    o = geometry.tile_origins(F.col("p_size"), 16, 16)
    g = table(spark, d, "part").select("p_partkey", o.alias("o"), F.explode(o).alias("x")).select("p_partkey", "x", F.explode("o").alias("y"))
    col, row = (F.col("x") / 16).cast("int"), (F.col("y") / 16).cast("int")
    name = F.concat_ws("_", F.col("p_partkey").cast("string"), F.lpad(row.cast("string"), 2, "0"), F.lpad(col.cast("string"), 2, "0"))
    return g.select(name.alias("tile_id"), "p_partkey", col.alias("col"), row.alias("row"), r6(F.lit(16) / (F.lit(1) + F.col("p_partkey") % 7), "width_mm"))


@query("""select p_partkey, round(greatest(0.0::double, least(255.0::double, p_size * 5.0::double * case when p_partkey % 100 < 64 then 1.0::double else 1.4::double end)), 6) as v from part""")
def gains_applied(spark, d):
    v = geometry.gained(F.col("p_size") * 5.0, F.lit(1.4), F.col("p_partkey") % 100)
    return table(spark, d, "part").select("p_partkey", r6(v, "v"))


# Curves


def project_sql(p: str, out: str) -> str:
    clip = [f"greatest(0.0::double, least(100.0::double, {p}{i}))" for i in range(N)]
    return ", ".join("100.0::double as " + out + str(i) if i == N - 1 else f"greatest({', '.join(clip[: i + 1])}, 0.0::double) as {out}{i}" for i in range(N))


BLENDED = ", ".join(f"m{i} * (1 - w) + (130 - {LINE[N - 1 - i]!r}::double) * w as b{i}" for i in range(N))


@query(f"""with {CURVES}, {MEDIANS}, grid as (select k, k * 0.05::double as w from unnest(range(0, 21)) as g(k)),
tried as (select k, {', '.join(P)}, {BLENDED} from curves, med, grid), mono as (select k, {', '.join(P)}, {project_sql('b', 'z')} from tried),
errors as (select k, avg({emd_sql(b='z')}) as emd from mono group by k), base as (select emd as e from errors where k = 0)
select cast(arg_min(k, (round(emd, 9), k)) as int) as k, round(min(emd), 5) as emd, min(emd) < (select e from base) - 1e-9 as accepted from errors""")
def blend_choice(spark, d):
    """The blend weight of the smallest mean distance after projecting, and whether it is better than no blend."""
    c = against_median(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20))))
    other = curves.doubles([130 - v for v in LINE[::-1]])
    mixed = curves.monotone(curves.blend(F.col("m"), other, F.col("k") * F.lit(0.05)))
    errors = c.withColumn("b", mixed).groupBy("k").agg(F.avg(curves.emd_trapezoid(F.col("y"), F.col("b"))).alias("emd"))
    best = errors.agg(F.min(F.struct(F.round("emd", 9).alias("r"), "k")).alias("s"), F.min("emd").alias("best"), F.max(F.when(F.col("k") == 0, F.col("emd"))).alias("base"))
    return best.select(F.col("s.k").alias("k"), r6("best", "emd", 5), (F.col("best") < F.col("base") - 1e-9).alias("accepted"))


# Models and protocols


@query("""with e as (select l_suppkey, avg(l_quantity) as a, avg(l_discount) as b, avg(l_extendedprice) as y from lineitem group by 1), m as (select avg(a) as ma, avg(b) as mb, avg(y) as my, stddev_pop(a) as sa, stddev_pop(b) as sb, count(*) as n from e),
z as (select (a - ma) / sa as u, (b - mb) / sb as v, y - my as t from e, m), s as (select sum(u * u) + 10 as uu, sum(u * v) as uv, sum(v * v) + 10 as vv, sum(u * t) as ut, sum(v * t) as vt from z),
w as (select (vv * ut - uv * vt) / (uu * vv - uv * uv) as x, (uu * vt - uv * ut) / (uu * vv - uv * uv) as y from s)
select 'quantity' as term, round(x, 4) as value from w union all select 'discount', round(y, 4) from w union all select 'mean', round(my, 4) from m""")
def ridge_penalised(spark, d):
    e = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_extendedprice").alias("price"))
    return models.ridge(e, ["quantity", "discount"], "price", 10.0).select("term", r6("value", "value", 4))


FACED = "with r as (select o_custkey as e, c_nationkey as f, o_orderpriority as c, o_totalprice as v from orders join customer on o_custkey = c_custkey where o_orderpriority in ('1-URGENT', '5-LOW'))"


@query(f"""{FACED}, folds as (select e, f, bool_or(c = '1-URGENT') as s, avg(v) filter (c = '5-LOW') as v from r group by e, f having count(*) filter (c = '5-LOW') > 0),
fam as (select f, sum(v) as s, count(*) as n from r where c = '1-URGENT' group by f), tot as (select sum(s) as s, sum(n) as n from fam)
select e, case when folds.s then folds.f::varchar else '__unseen__' end as fold, round(abs(v - case when folds.s then (tot.s - fam.s) / (tot.n - fam.n) else tot.s / tot.n end), 3) as error from folds left join fam using (f), tot""")
def transfer_errors(spark, d):
    r = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    r = r.select(F.col("o_custkey").alias("e"), F.col("c_nationkey").alias("f"), F.col("o_orderpriority").alias("c"), F.col("o_totalprice").alias("v"))
    return evaluation.transfer_errors(r, "e", "f", "c", "v", "1-URGENT", "5-LOW").select("e", "fold", r6("error", "error", 3))


CELLS = """with c as (select l_suppkey as e, avg(l_extendedprice) filter (l_returnflag = 'A' and l_linestatus = 'F') as c00, avg(l_extendedprice) filter (l_returnflag = 'A' and l_linestatus = 'O') as c01,
avg(l_extendedprice) filter (l_returnflag = 'N' and l_linestatus = 'F') as c10, avg(l_extendedprice) filter (l_returnflag = 'N' and l_linestatus = 'O') as c11 from lineitem group by 1), k as (select * from c where c00 + c01 + c10 + c11 is not null)"""


@query(f"""{CELLS}, x as (select unnest(['first_at_low', 'first_at_high', 'second_at_low', 'second_at_high', 'first', 'second', 'interaction']) as effect,
unnest([c10 - c00, c11 - c01, c01 - c00, c11 - c10, (c10 + c11 - c00 - c01) / 2, (c01 + c11 - c00 - c10) / 2, c11 - c01 - c10 + c00]) as v from k)
select effect, round(avg(v), 3) as mean, count(*) filter (v > 0) as wins, count(*) as n from x group by effect""")
def factorial_effects(spark, d):
    x = evaluation.factorial_effects(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice", (("A", "N"), ("F", "O")))
    return x.groupBy("effect").agg(r6(F.avg("value"), "mean", 3), F.count_if(F.col("value") > 0).alias("wins"), F.count(F.lit(1)).alias("n"))


@query("""with b as (select p_size as x, avg(p_retailprice) as e from part group by 1), r as (select *, rank() over (order by x) as a, rank() over (order by e) + (count(*) over (partition by e) - 1) / 2.0::double as b, lag(e) over (order by x) as before from b)
select round(corr(a, b), 6) as rho, bool_and(before is null or e >= before) as rising, count(*) as n from r""")
def trend_rho(spark, d):
    b = table(spark, d, "part").groupBy(F.col("p_size").alias("x")).agg(F.avg("p_retailprice").alias("e")).withColumn("one", F.lit(1))  # one row a size
    ranked = stats.average_rank(stats.average_rank(b, "x", "one", "a"), "e", "one", "b")
    ranked = ranked.withColumn("before", F.lag("e").over(Window.partitionBy("one").orderBy("x")))
    return ranked.agg(r6(F.corr("a", "b"), "rho"), F.bool_and(F.col("before").isNull() | (F.col("e") >= F.col("before"))).alias("rising"), F.count(F.lit(1)).alias("n"))


@query("""with g as (select l_suppkey as e, k, avg(abs(l_quantity - k)) as err from lineitem, unnest([24, 25, 26, 27]) t(k) group by all), f as (select k, avg(err) as m from g group by k), own as (select e, min(err) as m from g group by e)
select round((select min(m) from f), 6) as best_fixed, round((select avg(m) from own), 6) as chosen, round((select avg(m) from own) - (select min(m) from f), 6) as regret""")
def selection_regret(spark, d):
    err = lambda k: F.avg(F.abs(F.col("l_quantity") - k))
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[err(k).alias(f"e{k}") for k in (24, 25, 26, 27)])
    one = g.agg(F.least(*[F.avg(f"e{k}") for k in (24, 25, 26, 27)]).alias("f"), F.avg(F.least("e24", "e25", "e26", "e27")).alias("c"))
    return one.select(r6("f", "best_fixed"), r6("c", "chosen"), r6(F.col("c") - F.col("f"), "regret"))


GAIN = "(select var_pop(m) from (select avg(o_totalprice) as m from orders join customer on o_custkey = c_custkey group by {}))"


@query(f"select round({GAIN.format('c_nationkey')}, 2) as real, round({GAIN.format('c_custkey % 25')}, 2) as placebo_a, round({GAIN.format('o_orderkey % 25')}, 2) as placebo_b, "
       f"{GAIN.format('c_nationkey')} > 0 and {GAIN.format('c_nationkey')} > {GAIN.format('c_custkey % 25')} and {GAIN.format('c_nationkey')} > {GAIN.format('o_orderkey % 25')} as separable")  # fmt: skip
def separability_gate(spark, d):
    """The spread between real families against that between two placebo families of the same number."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keys = {"real": F.col("c_nationkey").cast("long"), "placebo_a": F.col("c_custkey") % 25, "placebo_b": F.col("o_orderkey") % 25}
    spread = lambda k: rows.groupBy(k.alias("k")).agg(F.avg("o_totalprice").alias("m")).agg(F.var_pop("m").alias("v"))
    one = None
    for name, k in keys.items():
        own = spread(k).withColumnRenamed("v", name)
        one = own if one is None else one.join(own)  # one-row frames
    gate = (F.col("real") > 0) & (F.col("real") > F.col("placebo_a")) & (F.col("real") > F.col("placebo_b"))
    return one.select(*[r6(n, n, 2) for n in keys], gate.alias("separable"))


AUDITED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
FAMILY = {"l_quantity": "size", "l_extendedprice": "size", "l_discount": "rate", "l_tax": "rate"}
ONE_AUDIT = """select '{f}' as family, min({c}) filter (l_linestatus = 'F') as lo, max({c}) filter (l_linestatus = 'F') as hi, count(*) filter (l_linestatus = 'O' and ({c} < (select min({c}) from lineitem where l_linestatus = 'F') or {c} > (select max({c}) from lineitem where l_linestatus = 'F'))) as outside,
(avg({c}) filter (l_linestatus = 'O') - avg({c}) filter (l_linestatus = 'F')) / stddev_samp({c}) filter (l_linestatus = 'F') as shift from lineitem"""


@query(f"""with a as ({' union all '.join(ONE_AUDIT.format(c=c, f=FAMILY[c]) for c in AUDITED)}) select family, count(*) as features, cast(sum(outside) as bigint) as outside, round(max(abs(shift)), 5) as largest_shift, round(max(hi - lo), 4) as widest from a group by family""")
def range_audit_rollup(spark, d):
    item = table(spark, d, "lineitem")
    fit = F.col("l_linestatus") == "F"
    own = item.where(fit).agg(*[f(c).alias(f"{n}_{c}") for c in AUDITED for n, f in (("lo", F.min), ("hi", F.max), ("m", F.avg), ("s", F.stddev_samp))])
    met = item.where("l_linestatus = 'O'").join(F.broadcast(own))  # one row
    parts = [F.struct(F.lit(FAMILY[c]).alias("family"), F.count_if((F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}"))).alias("outside"), ((F.avg(c) - F.first(f"m_{c}")) / F.first(f"s_{c}")).alias("shift"), (F.first(f"hi_{c}") - F.first(f"lo_{c}")).alias("wide")) for c in AUDITED]
    rows = met.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("features"), F.sum("outside").alias("outside"), r6(F.max(F.abs("shift")), "largest_shift", 5), r6(F.max("wide"), "widest", 4))


ARMS = "with g as (select l_returnflag as ruler, k as arm, avg(abs(l_quantity - k)) as err from lineitem, unnest([20, 25, 26, 30]) t(k) group by all)"


@query(f"""{ARMS}, v as (select ruler, arm_min.arm as arm from (select ruler, arg_min(arm, (round(err, 6), arm)) as arm from g group by ruler) arm_min), w as (select arm, round(max(err), 6) as worst from g group by arm)
select arm, worst, cast((select count(*) from v where v.arm = w.arm) as bigint) as votes, row_number() over (order by worst, arm) = 1 as minimax from w""")
def minimax_arm(spark, d):
    """Each arm's worst ruler, the rulers that vote for it, and the arm of the smallest worst; ties to the smaller arm."""
    arms = (20, 25, 26, 30)
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.avg(F.abs(F.col("l_quantity") - k)).alias(f"e{k}") for k in arms])
    long = g.select("l_returnflag", F.array_min(F.array(*[F.struct(F.round(f"e{k}", 6).alias("e"), F.lit(k).alias("arm")) for k in arms])).alias("best"), F.inline(F.array(*[F.struct(F.lit(k).alias("arm"), F.col(f"e{k}").alias("err")) for k in arms])))
    w = long.groupBy("arm").agg(r6(F.max("err"), "worst"), F.count_if(F.col("best.arm") == F.col("arm")).alias("votes"))  # one row an arm
    return w.select("arm", "worst", "votes", (F.row_number().over(Window.orderBy("worst", "arm")) == 1).alias("minimax"))


@query("""with m as (select l_suppkey, l_returnflag as c, median(l_quantity) as v from lineitem group by all), s as (select c, case when v < 20 then 'FLOOR' when v > 30 then 'CEILING' else 'INTERIOR' end as status from m)
select c as direction, count(*) filter (status = 'INTERIOR') * 2 > count(*) as interior, count(*) filter (status = 'FLOOR') as floors, count(*) filter (status = 'CEILING') as ceilings, count(*) as folds from s group by c""")
def direction_status(spark, d):
    """A direction is interior if a strict majority of its folds is."""
    m = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.median("l_quantity").alias("v"))
    s = m.withColumn("status", F.when(F.col("v") < 20, "FLOOR").when(F.col("v") > 30, "CEILING").otherwise("INTERIOR"))
    n = lambda x: F.count_if(F.col("status") == x)
    return s.groupBy(F.col("l_returnflag").alias("direction")).agg((n("INTERIOR") * 2 > F.count(F.lit(1))).alias("interior"), n("FLOOR").alias("floors"), n("CEILING").alias("ceilings"), F.count(F.lit(1)).alias("folds"))


@query("""with a as (select l_returnflag as g, avg(l_quantity) as q, avg(l_tax) as t, avg(l_discount) as d from lineitem group by 1), r as (select unnest(['quantity', 'tax', 'discount']) as ruler, unnest([(select q from a where g = 'A') < (select q from a where g = 'R'), (select t from a where g = 'A') < (select t from a where g = 'R'), (select d from a where g = 'A') < (select d from a where g = 'R')]) as credible, unnest([1, 2, 3]) as place)
select ruler, credible, coalesce(place = (select min(place) from r where credible), false) as chosen from r""")
def ruler_credibility(spark, d):
    """A ruler is credible if it puts a known pair in order; the first credible one by preference is chosen."""
    mean = lambda c, g: F.avg(F.when(F.col("l_returnflag") == g, F.col(c)))
    rulers = [F.struct(F.lit(n).alias("ruler"), (mean(c, "A") < mean(c, "R")).alias("credible"), F.lit(i).alias("place")) for i, (n, c) in enumerate((("quantity", "l_quantity"), ("tax", "l_tax"), ("discount", "l_discount")))]
    one = table(spark, d, "lineitem").agg(F.array(*rulers).alias("r"))
    first = F.array_min(F.transform(F.filter("r", lambda x: x["credible"]), lambda x: x["place"]))
    return one.withColumn("first", first).select("first", F.inline("r")).select("ruler", "credible", F.coalesce(F.col("place") == F.col("first"), F.lit(False)).alias("chosen"))


@query("""with g as (select s_suppkey, s_nationkey as f, row_number() over (partition by s_nationkey order by s_suppkey) as place from supplier)
select f, s_suppkey from g where place = 1""")
def first_of_family(spark, d):
    first = F.min("s_suppkey").alias("s_suppkey")
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("f")).agg(first)


# Wider grids, weighted neighbours, rulers, fits


SCALE_0, SCALE_STEP, SHAPE_STEP = math.log(0.005), (math.log(300.0) - math.log(0.005)) / 71, 7.9 / 43


@query(f"""with {CURVES}, grid as (select {SCALE_0!r}::double + i * {SCALE_STEP!r}::double as l, 0.1::double + j * {SHAPE_STEP!r}::double as k, i * 44 + j as g from unnest(range(0, 72)) a(i), unnest(range(0, 44)) b(j)),
w as (select g, {WEIBULL} from grid), p as (select * replace (100.0::double as m{N - 1}) from w), best as (select l_suppkey, min((round({emd_sql()}, 6), g)) as b from curves, p group by 1)
select l_suppkey, cast(b[2] as int) as g, b[1] as emd from best""")
def weibull_grid_full(spark, d):
    """The best of all 72 x 44 two-parameter forms from 0.005 to 300 mm and shapes from 0.1 to 8, made curves; ties to the smaller point."""
    i, j = F.expr("id div 44"), F.expr("id % 44")
    form = curves.monotone(curves.weibull(F.lit(SCALE_0) + i * F.lit(SCALE_STEP), F.lit(0.1) + j * F.lit(SHAPE_STEP)))
    grid = F.broadcast(spark.range(72 * 44).select(F.col("id").cast("int").alias("g"), form.alias("m")))  # 3,168 rows
    tried = supplier_curve(spark, d).join(grid).withColumn("emd", F.round(curves.emd_trapezoid(F.col("y"), F.col("m")), 6))
    return tried.groupBy("l_suppkey").agg(F.min(F.struct("emd", "g")).alias("b")).select("l_suppkey", "b.g", "b.emd")


WEIGHTED = ", ".join(f"round(case when min(dist) = 0 then avg({p}) filter (dist = 0) else sum({p} / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) end, 6) as {p}" for p in P)


@query(f"with {NEAREST} select q_id, {WEIGHTED} from near join curves on d_id = l_suppkey where rank <= 4 group by q_id")
def knn_weighted_curve(spark, d):
    """The mean of the four nearest curves of other families, weighted by one over the distance; those at distance 0 alone, if there are any."""
    q, other = query_pairs(spark, d)
    near = joins.nearest(q, other, F.round(curves.emd_trapezoid(F.col("q_y"), F.col("d_y")), 6), 4, F.col("q_family") != F.col("d_family"))
    met, weight = near.join(other, "d_id"), 1 / F.nullif(F.col("dist"), F.lit(0.0))
    mean = lambda v: F.when(F.min("dist") == 0, F.avg(F.when(F.col("dist") == 0, v))).otherwise(F.sum(v * weight) / F.sum(weight))
    return met.groupBy("q_id").agg(*[r6(mean(F.col("d_y")[i]), p) for i, p in enumerate(P)])


@query("""with c as (select l_suppkey, s_nationkey as f, l_returnflag as cam, l_linestatus as view, avg(l_quantity) as v from lineitem join supplier on l_suppkey = s_suppkey group by all),
t as (select e.cam as ecam, e.view as eview, s.cam as scam, s.view as sview, abs(e.v - (sum(s.v) / count(*))) as err from c e join c s on e.f <> s.f group by e.l_suppkey, e.f, e.v, e.cam, e.view, s.cam, s.view)
select case when ecam = scam and eview = sview then 'LOGO' when eview = sview then 'CAM' when ecam = scam then 'RES' else 'CAM+RES' end as ruler, count(*) as n, round(avg(err), 6) as error from t group by 1""")
def rulers(spark, d):
    line, s = table(spark, d, "lineitem"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("f"))
    cells = line.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("v")).join(s, "l_suppkey")
    return evaluation.rulers(cells, "f", "l_returnflag", "l_linestatus", "v").select("ruler", "n", r6("error", "error"))


@query("""with c as (select 1.0::double / p_size as u, 1 / sqrt(p_size::double) as w, avg(p_retailprice) as e from part group by p_size), m as (select avg(u) as u, avg(w) as w, avg(e) as e, var_pop(u) as uu, var_pop(w) as ww, var_pop(e) as ee,
covar_pop(u, w) as uw, covar_pop(u, e) as ue, covar_pop(w, e) as we from c), f as (select *, (ue * ww - we * uw) / (uu * ww - uw * uw) as b, (we * uu - ue * uw) / (uu * ww - uw * uw) as c from m)
select round(e - b * u - c * w, 3) as level, round(b, 2) as per_n, round(c, 2) as per_root, round((b * ue + c * we) / ee, 6) as r2, round(e - b * u - c * w + b / 100 + c / 10, 3) as at_100 from f""")
def inverse_root_curve(spark, d):
    c = table(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("e"))
    fit = evaluation.inverse_root_curve(c, "p_size", "e", 100.0)
    return fit.select(r6("level", "level", 3), r6("per_n", "per_n", 2), r6("per_root", "per_root", 2), r6("r2", "r2"), r6("at", "at_100", 3))


@query("select event_id, user_id, max(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as top from events")
def running_maximum(spark, d):
    return stats.running_max(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", "top").select("event_id", "user_id", "top")


@query("""with f as (select p_partkey, 'samples/' || regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g') || '/img_' || p_size || '.jpg' as dest_path from part)
select p_partkey, dest_path, count(*) over (partition by dest_path) as sources from f""")
def organised_files(spark, d):
    """Where each file belongs, and how many files claim that place."""
    path = F.concat(F.lit("raw/"), F.col("p_partkey").cast("string"), F.lit("/img_"), F.col("p_size").cast("string"), F.lit(".jpg"))
    f = table(spark, d, "part").select("p_partkey", text.destination("samples", F.col("p_brand"), path).alias("dest_path"))
    return f.withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("dest_path")))


@query("""with t as (select event_id, case when event_id % 3 <> 0 then cast(json_extract(props, '$.k') as double) end as a, case when value > 50 then value end as b from events)
select event_id, a is null as retry_fired, a is null and b is not null as recovered, coalesce(a, b) as value from t""")
def retry_bookkeeping(spark, d):
    first = F.when(F.col("event_id") % 3 != 0, F.get_json_object("props", "$.k").cast("double"))
    fired, recovered, value = text.retried(first, F.when(F.col("value") > 50, F.col("value")))
    return table(spark, d, "events").select("event_id", fired.alias("retry_fired"), recovered.alias("recovered"), value.alias("value"))


@query()
def shape_polynomials(spark, d):
    """Polynomials of degree 1 to 3 that map a curve's log median diameter to each of its values."""
    c = supplier_curve(spark, d).select(curves.diameter_at(F.col("y"), 50.0).alias("v"), "y")
    fits = [models.polynomial_map(c, "v", "y", N, k).withColumn("degree", F.lit(k)) for k in (1, 2, 3)]
    return fits[0].unionAll(fits[1]).unionAll(fits[2])


@query()
def image_crops(spark, d):
    """The rectangle of even soil of each vector seen as a square image, every value four by four pixels; lengths that are no square are of bad shape."""
    side = F.floor(F.sqrt(F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0)))).cast("int")
    square, wide = F.size("embedding") == side * side, 4 * side
    place = lambda i: F.floor(i / (4 * wide)) * side + F.floor(i % wide / 4)
    grey = F.transform(F.when(square & (side > 0), F.sequence(F.lit(0), wide * wide - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get("embedding", place(i).cast("int")).cast("double") * 255 + 128)
    images = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), wide.alias("h"), wide.alias("w"), grey.alias("pixels"))
    return pixels.crops(images)


# Images: masked kernels, colour tiles, resampling, mosaics, projections

GREY = "least(255.0::double, greatest(0.0::double, x::double * 255 + 128))"


def grey_images(spark, d):
    """Each vector as a square grey image; lengths that are no square have no fitting size."""
    side = F.floor(F.sqrt(F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0)))).cast("int")
    grey = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), x.cast("double") * 255 + 128)))
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), side.alias("h"), side.alias("w"), grey.alias("pixels"), "label", "vec_id")


@query(f"""with p as (select vec_id, {GREY} as v from (select vec_id, unnest(embedding) as x from embeddings)), t as (select vec_id, quantile_cont(v, 0.12) as low from p group by 1), k as (select p.vec_id, v from p join t using (vec_id) where v > low)
select vec_id::varchar as image_id, round(avg(v), 5) as mean, round(stddev_pop(v), 5) as sd, round(quantile_cont(v, 0.1), 5) as p10, round(quantile_cont(v, 0.5), 5) as p50, round(quantile_cont(v, 0.9), 5) as p90 from k group by vec_id""")
def masked_percentiles(spark, d):
    """Statistics of each image's pixels above its darkest 12 per cent."""
    found = masked.spatial(grey_images(spark, d)).where("status = 'ok'")
    return found.select("image_id", *[r6(s, s, 5) for s in masked.STATS])


@query()
def masked_kernels(spark, d):
    """Structure, correlation, variogram and contrast of each image under its mask, or why not."""
    return masked.spatial(grey_images(spark, d))


COLOURS = "r as (select vec_id, label, list_transform(embedding, lambda x: least(255.0::double, greatest(0.0::double, x::double * 255 + 128))) as g from embeddings)"


@query(f"""with {COLOURS}, c as (select vec_id, g, list_transform(g, lambda x: x * 0.5 + label) as u, list_transform(g, lambda x: 200 - x * 0.25) as v from r), s as (select *, list_avg(g) as mg, list_avg(u) as mu, list_avg(v) as mv from c),
n as (select vec_id, list_transform(g, lambda x: x * ((mg + mu + mv) / 3 / mg)) as g, list_transform(u, lambda x: x * ((mg + mu + mv) / 3 / mu)) as u, list_transform(v, lambda x: x * ((mg + mu + mv) / 3 / mv)) as v from s),
p as (select vec_id, unnest(g) as g, unnest(u) as u, unnest(v) as v from n), y as (select *, (g + u + v) / 3 as y from p), t as (select vec_id, quantile_cont(y, 0.12) as low from y group by 1), k as (select y.* from y join t using (vec_id) where y.y > low)
select vec_id::varchar as image_id, round(avg(g), 4) as red, round(avg(u), 4) as green, round(avg(v), 4) as blue, round(stddev_pop(y), 4) as lum_sd, round(quantile_cont(y, 0.5), 4) as lum_p50 from k group by vec_id""")
def colour_tiles(spark, d):
    """Channel means and luminance of three made planes at equal channel means, over the pixels above the darkest 12 per cent."""
    images = grey_images(spark, d).withColumnRenamed("pixels", "r")
    images = images.withColumn("g", F.transform("r", lambda x: x * 0.5 + F.col("label"))).withColumn("b", F.transform("r", lambda x: 200 - x * 0.25))
    return imaging.colour_features(images, "gw").where("status = 'ok'").select("image_id", *[r6(c, c, 4) for c in ("red", "green", "blue", "lum_sd", "lum_p50")])


@query()
def resampled_images(spark, d):
    """Every image brought to half its size by a windowed sinc, with its agreement with box means."""
    return imaging.resample(grey_images(spark, d), 4, 4)


@query("""with p as (select label, vec_id, list_transform(embedding, lambda x: x::double) as g, row_number() over (partition by label order by vec_id) - 1 as at, count(*) over (partition by label) as n from embeddings where len(embedding) = 64),
c as (select label, n, cell, case when n >= 6 then cast(round_even(cell * (n - 1) / 5.0::double, 0) as bigint) else cell % n end as at from (select distinct label, n from p) s, range(6) t(cell))
select c.label, c.n as n_tiles, cast(greatest(0, 6 - c.n) as bigint) as n_repeats, round(sum(list_sum(g) * (1 + cell)), 5) as checksum, sum(vec_id) as picked from c join p on p.label = c.label and p.at = c.at group by all""")
def mosaic_of_labels(spark, d):
    """Six evenly picked images of each label put together; the checksum weighs each cell's pixels by its place."""
    tiles = table(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("pixels"))
    whole = imaging.mosaics(tiles.where("label is not null"), "label", "vec_id", 8)
    weight = lambda x, i: x * (1 + F.floor(i / (24 * 8)) * 3 + F.floor(i % 24 / 8))
    total = F.aggregate(F.transform("pixels", weight), F.lit(0.0), lambda a, x: a + x)
    ids = imaging.mosaics(tiles.where("label is not null").withColumn("pixels", F.transform("pixels", lambda x: F.col("vec_id").cast("double"))), "label", "vec_id", 8)
    picked = F.aggregate(F.col("pixels"), F.lit(0.0), lambda a, x: a + x) / 64
    return whole.select("label", "n_tiles", F.col("n_repeats").cast("bigint"), r6(total, "checksum", 5)).join(ids.select("label", F.round(picked).cast("bigint").alias("picked")), "label")


@query()
def projected_images(spark, d):
    """Each image's unit vector under one seeded projection, box means of two by two."""
    return imaging.projected_vectors(grey_images(spark, d), 16, box=2)


@query()
def crop_ratios(spark, d):
    return imaging.crop_ratios(grey_images(spark, d), (4, 6))


@query(f"""with p as (select vec_id, {GREY} as v, i % 8 as x, i // 8 as y from (select vec_id, unnest(embedding) as x, unnest(range(64)) as i from embeddings where len(embedding) = 64)), t as (select vec_id, quantile_cont(v, 0.12) as low from p group by 1)
select vec_id::varchar as image_id, cast(x // 4 as int) as grid_col, cast(y // 4 as int) as grid_row, round(count(*) filter (v > low) / 16.0::double, 6) as share, round(avg(v) filter (v > low), 5) as mean from p join t using (vec_id) group by all having count(*) filter (v > low) >= 14""")
def tile_rows(spark, d):
    """Tiles of four by four pixels that are bright for seven eighths or more."""
    return imaging.tile_rows(grey_images(spark, d).where("h = 8"), 4, 0.875).select("image_id", "grid_col", "grid_row", r6("share", "share"), r6("mean", "mean", 5))


@query("""with o as (select o_custkey, count(*) as n, max(o_totalprice) as top from orders group by 1), l as (select o_custkey, count(*) as parts, 0 as n from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R' group by 1)
select c_custkey, c_acctbal, o.n, top, parts from customer left join o on o.o_custkey = c_custkey left join l on l.o_custkey = c_custkey""")
def stage_chain(spark, d):
    """Three stages by key; a column that two of them have is the earlier one's."""
    orders = table(spark, d, "orders")
    o = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"), F.lit(0.0).alias("c_acctbal"))
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    l = orders.join(back, "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("parts"), F.lit(0).alias("n"))  # noqa: E741
    return joins.merged_stages([table(spark, d, "customer").select("c_custkey", "c_acctbal"), o, l], "c_custkey")


@query()
def alignment_arms(spark, d):
    """Transforms between two line states by moments of tiles and of entities, with the arms that must change nothing."""
    x = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")])
    rows = table(spark, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"), "l_suppkey", "l_linestatus", x.alias("x"))
    return models.alignment_arms(rows, "key", "l_suppkey", "l_linestatus", "F", "O", "x", 3)
