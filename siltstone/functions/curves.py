"""Curve algebra on ARRAY<DOUBLE> columns: cumulative percentages at fixed diameters.

All of it is higher-order SQL functions, so it stays in the JVM beside the aggregation that makes the
curves. Curves are non-null arrays of len(SUPPORT) values; a null curve gives null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The diameters in mm at which curves are given.
SUPPORT = (0.002, 0.0063, 0.02, 0.063, 0.2, 0.63, 2.0, 6.3, 20.0, 63.0, 200.0)
LOG_SUPPORT = tuple(math.log10(d) for d in SUPPORT)


def doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def fold(positions: range, term) -> Column:
    """Sum of term(i) over fixed positions."""
    total = term(positions[0])
    for i in positions[1:]:
        total = total + term(i)
    return total


def emd_trapezoid(p: Column, t: Column, x: Sequence[float] = LOG_SUPPORT) -> Column:
    """Area between two curves over log10 diameter, trapezoid rule."""
    gap = [F.abs(p[i] - t[i]) for i in range(len(x))]
    return fold(range(1, len(x)), lambda i: F.lit(0.5 * (x[i] - x[i - 1])) * (gap[i] + gap[i - 1]))


def emd_left(p: Column, t: Column, x: Sequence[float] = LOG_SUPPORT) -> Column:
    """The same area with each interval at its left end's height."""
    return fold(range(1, len(x)), lambda i: F.lit(x[i] - x[i - 1]) * F.abs(p[i - 1] - t[i - 1]))


def monotone(y: Column) -> Column:
    """Clip to [0, 100], take the running maximum, set the last value to 100."""
    clipped = F.transform(y, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(100.0), v)))
    start = F.struct(F.expr("cast(array() as array<double>)").alias("out"), F.lit(0.0).alias("top"))
    grown = F.aggregate(clipped, start, lambda a, v: F.struct(F.array_append(a["out"], F.greatest(a["top"], v)).alias("out"), F.greatest(a["top"], v).alias("top")), lambda a: a["out"])
    return F.concat(F.slice(grown, 1, F.size(y) - 1), F.array(F.lit(100.0)))


def diameter_at(y: Column, q: float, x: Sequence[float] = LOG_SUPPORT) -> Column:
    """log10 of the diameter where a curve first reaches q, linear in between, ends clamped."""
    found = F.lit(x[-1])
    for i in range(len(x) - 1, 0, -1):
        rise = y[i] - y[i - 1]
        inside = F.lit(x[i - 1]) + (F.lit(q) - y[i - 1]) / F.nullif(rise, F.lit(0.0)) * F.lit(x[i] - x[i - 1])
        found = F.when(y[i] >= q, inside).otherwise(found)
    return F.when(y[0] >= q, F.lit(x[0])).otherwise(found)


def curve_at(y: Column, log_d: float, x: Sequence[float] = LOG_SUPPORT) -> Column:
    """The curve's value at a diameter, linear in log10 diameter, 0 below and 100 above the support."""
    if log_d < x[0]:
        return F.lit(0.0)
    for i in range(1, len(x)):
        if log_d <= x[i]:
            share = (log_d - x[i - 1]) / (x[i] - x[i - 1])
            return y[i - 1] * F.lit(1 - share) + y[i] * F.lit(share)
    return F.lit(100.0)


def weibull(log_scale: Column, shape: Column, x: Sequence[float] = LOG_SUPPORT) -> Column:
    """100 (1 - exp(-(d / scale)^shape)) at the support, exponents clipped to +-50."""
    ln = math.log(10.0)
    exponent = [F.greatest(F.lit(-50.0), F.least(F.lit(50.0), shape * (F.lit(v * ln) - log_scale))) for v in x]
    return F.array(*[F.lit(100.0) * (F.lit(1.0) - F.exp(-F.exp(e))) for e in exponent])


def blend(p: Column, t: Column, weight: Column) -> Column:
    return F.zip_with(p, t, lambda a, b: a * (F.lit(1.0) - weight) + b * weight)


def valid(y: Column) -> Column:
    """Non-decreasing, within [0, 100], last value 100."""
    steps = F.zip_with(F.slice(y, 1, F.size(y) - 1), F.slice(y, 2, F.size(y) - 1), lambda a, b: b >= a)
    return F.forall(y, lambda v: (v >= 0) & (v <= 100)) & F.forall(steps, lambda s: s) & (F.element_at(y, -1) == 100.0)


def saturation(y: Column) -> Column:
    """Share of the inner values that are 0 or 100."""
    inner = F.slice(y, 2, F.size(y) - 2)
    hits = F.filter(inner, lambda v: (F.abs(v) < 1e-8) | (F.abs(v - 100.0) < 1e-8))
    return F.size(hits) / F.size(inner)


def diameter_legacy(y: Column, q: float = 50.0, x: Sequence[float] = LOG_SUPPORT) -> Column:
    """The older crossing: values first raised to a slight ramp, so that plateaus have one crossing."""
    ramp = [1e-6 + (1.0 - 1e-6) * i / (len(x) - 1) for i in range(len(x))]
    raised = [F.greatest(y[i], F.lit(ramp[i])) for i in range(len(x))]
    found = F.lit(x[-1])
    for i in range(len(x) - 1, 0, -1):
        rise = raised[i] - raised[i - 1]
        inside = F.lit(x[i - 1]) + (F.lit(q) - raised[i - 1]) / F.nullif(rise, F.lit(0.0)) * F.lit(x[i] - x[i - 1])
        found = F.when(raised[i] >= q, inside).otherwise(found)
    return F.when(raised[0] >= q, F.lit(x[0])).otherwise(found)


def expanded(y: Column, mean: Column, factor: float) -> Column:
    """A curve's deviation from the mean curve times a factor, made monotone."""
    return monotone(F.zip_with(mean, y, lambda m, v: m + F.lit(factor) * (v - m)))
