"""Statistics over groups as window and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile(column: str, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(F.col(column), F.lit(q))


def average_rank(df: DataFrame, column: str, by: str, out: str) -> DataFrame:
    """Ranks within `by`, ties sharing the mean of their places."""
    order = Window.partitionBy(by).orderBy(column)
    same = Window.partitionBy(by, column)
    return df.withColumn(out, F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2.0)


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, n, rho) from average ranks."""
    ranked = average_rank(average_rank(df, x, by, "__x"), y, by, "__y")
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.corr("__x", "__y").alias("rho"))


def variance_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """100 var(group means) / var(all): one row. Means and the total meet as two one-row frames."""
    means = df.groupBy(group).agg(F.avg(value).alias("m")).agg(F.var_samp("m").alias("between"))
    total = df.agg(F.var_samp(value).alias("total"))
    return means.join(total).select((F.col("between") / F.col("total") * 100).alias("share_pct"))


def longest_run(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """(key, run_start, run_length) of the longest stretch of true flags, the first of equals."""
    by = Window.partitionBy(key).orderBy(order)
    numbered = df.withColumn("__at", F.row_number().over(by)).where(flag)
    island = F.col("__at") - F.row_number().over(by)
    runs = numbered.withColumn("__island", island).groupBy(key, "__island").agg(F.min("__at").alias("run_start"), F.count(F.lit(1)).alias("run_length"))
    best = F.max(F.struct("run_length", (-F.col("run_start")).alias("back"))).alias("best")
    return runs.groupBy(key).agg(best).select(key, (-F.col("best.back")).alias("run_start"), F.col("best.run_length").alias("run_length"))


def softmax_cdf(df: DataFrame, by: str, order: str, logit: str, out: str) -> DataFrame:
    """Running percentage of the softmax of `logit` within `by`, in order."""
    weight = F.exp(F.col(logit) - F.max(logit).over(Window.partitionBy(by)))
    running = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("__w").over(running) / F.sum("__w").over(Window.partitionBy(by)) * 100
    return df.withColumn("__w", weight).withColumn(out, share).drop("__w")


def train_quantile(df: DataFrame, by: str, value: str, is_train: str, key: str, out: str) -> DataFrame:
    """Quantile of each value among its group's training values: of training rows (place - 1/2) / n, of others the share below.

    Places are running counts over the ordered group, so training and other rows meet without a join.
    """
    train = F.when(F.col(is_train), 1).otherwise(0)
    n = F.sum(train).over(Window.partitionBy(by))
    place = F.sum(train).over(Window.partitionBy(by).orderBy(value, key).rowsBetween(Window.unboundedPreceding, 0))
    upto = F.sum(train).over(Window.partitionBy(by).orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    same = F.sum(train).over(Window.partitionBy(by, value))
    return df.withColumn(out, F.when(F.col(is_train), (place - 0.5) / n).otherwise((upto - same) / n))


def mad_report(df: DataFrame, by: str, value: str, limit: float) -> DataFrame:
    """(by, n, mad, status, outliers, log_outliers): rows beyond `limit` MADs of the median, on the values and on the logarithms of single-signed groups.

    A group of MAD 0 is reported as such with no count, never divided by.
    """
    x = F.col(value).cast("double")
    signed = F.when(F.min(x).over(Window.partitionBy(by)) > 0, F.log(x)).when(F.max(x).over(Window.partitionBy(by)) < 0, F.log(-x))
    both = df.select(by, x.alias("v"), signed.alias("l"))
    middle = both.groupBy(by).agg(F.median("v").alias("vm"), F.median("l").alias("lm"))
    dev = both.join(middle, by).select(by, F.abs(F.col("v") - F.col("vm")).alias("v"), F.abs(F.col("l") - F.col("lm")).alias("l"))
    mad = dev.groupBy(by).agg(F.median("v").alias("mad"), F.median("l").alias("log_mad"))
    far = lambda v, m: F.when(F.max(m) > 0, F.count_if(F.col(v) > limit * F.col(m)))
    return dev.join(mad, by).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.max("mad").alias("mad"), F.when(F.max("mad") > 0, "ok").otherwise("degenerate").alias("status"),
        far("v", "mad").alias("outliers"), far("l", "log_mad").alias("log_outliers"),
    )


def running_max(df: DataFrame, by: str, order: list[str], value: str, out: str) -> DataFrame:
    """The largest value so far within a group; the last key of `order` must tell rows apart."""
    return df.withColumn(out, F.max(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def noise_floor(n: Column) -> Column:
    """The rank correlation that n rows without one hardly exceed: 2.5 / sqrt(n - 1)."""
    return F.lit(2.5) / F.sqrt(F.nullif(n - 1, F.lit(0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine of two arrays of one length; null where either is null, of another length or of length zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.lit(1.0) - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))
