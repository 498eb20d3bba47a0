"""Scales, tiles and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear sRGB to XYZ (D65), row by row.
XYZ = (
    (0.41239079926595934, 0.357584339383878, 0.1804807884018343),
    (0.21263900587151027, 0.715168678767756, 0.07219231536073371),
    (0.01933081871559182, 0.11919477979462598, 0.9505321522496607),
)


def half_even(x: Column) -> Column:
    """Round half up, but exact halves to the even neighbour."""
    half = F.abs(x - F.floor(x) - 0.5) < 1e-9
    low = F.floor(x)
    even = F.when(low % 2 == 0, low).otherwise(low + 1)
    return F.when(half, even).otherwise(F.floor(x + 0.5)).cast("bigint")


def effective_scale(short: Column, long: Column) -> Column:
    return F.sqrt(short * long)


def disagreement_pct(short: Column, long: Column) -> Column:
    return F.abs(short - long) / ((short + long) / 2) * 100


def direction(source: Column, target: Column) -> Column:
    return F.when(target > source, "up").when(target == source, "identity").otherwise("down")


def tile_origins(extent: Column, tile: int, stride: int) -> Column:
    """Origins of the whole tiles along an axis; none if the extent is shorter than a tile."""
    return F.when(extent >= tile, F.sequence(F.lit(0), (extent - tile).cast("int"), F.lit(stride))).otherwise(F.expr("cast(array() as array<int>)"))


def size_group(mm: Column) -> Column:
    return F.when(mm < 0.063, "fine").when(mm < 2.0, "sand").when(mm < 63.0, "gravel").otherwise("cobble")


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """CIELAB of 8-bit sRGB; the white point is the matrix's row sums."""
    linear = []
    for c in (r, g, b):
        v = c / 255.0
        linear.append(F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))))
    f = []
    for row in XYZ:
        t = (F.lit(row[0]) * linear[0] + F.lit(row[1]) * linear[1] + F.lit(row[2]) * linear[2]) / F.lit(sum(row))
        f.append(F.when(t > (6 / 29) ** 3, F.pow(t, F.lit(1 / 3))).otherwise(t / F.lit(3 * (6 / 29) ** 2) + F.lit(4 / 29)))
    return [F.lit(116.0) * f[1] - 16.0, F.lit(500.0) * (f[0] - f[1]), F.lit(200.0) * (f[1] - f[2])]


def grey_gains(r: Column, g: Column, b: Column) -> list[Column]:
    """Gains that make the channel means equal, of geometric mean one."""
    mean = F.pow(r * g * b, F.lit(1 / 3))
    return [mean / r, mean / g, mean / b]


def chromaticity(r: Column, g: Column, b: Column) -> list[Column]:
    total = F.nullif(r + g + b, F.lit(0.0))
    return [F.coalesce(c / total, F.lit(1 / 3)) for c in (r, g)]


def antialias_sigma(target: Column, source: Column) -> Column:
    """Gaussian width that brings a box of `source` pixels to one of `target` pixels; 0 if none is needed."""
    return F.sqrt(F.greatest(target * target - source * source, F.lit(0.0)) / 12.0)


def resolvable(d50_mm: Column, patch_mm: Column, divisor: float = 3.0) -> Column:
    """A grain is resolved if it spans the divisor-th part of a patch."""
    return d50_mm >= patch_mm / divisor


def canvas(pixels: Column, scale: Column, target: Column) -> list[Column]:
    """Pixels of an axis after resampling from `scale` to `target` pixels per mm (half to even), and the field of view's error in percent."""
    resampled = half_even(pixels * target / scale)
    return [resampled, (resampled / target) / (pixels / scale) * 100 - 100]


def aspect_mismatch(width: Column, height: Column, other_width: Column, other_height: Column, tolerance: float = 0.01) -> Column:
    """Whether two frames' long to short sides differ by more than a share of one of them."""
    ratio = lambda a, b: F.greatest(a, b) / F.least(a, b)
    return F.abs(ratio(width, height) / ratio(other_width, other_height) - 1) > tolerance


def gained(channel: Column, gain: Column, pixels: Column, least: int = 64) -> Column:
    """A channel under its gain, clipped to [0, 255]; with fewer than `least` pixels the gain is 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), channel * F.when(pixels < least, F.lit(1.0)).otherwise(gain)))
