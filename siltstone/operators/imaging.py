"""Colour tiles, resampling, mosaics and projections of images as rows.

A colour image is a row (image_id, h, w, r, g, b) of planes array<double> from 0 to 255, a grey one has `pixels`.
Images whose planes don't fit their size, or aren't finite, have status `bad_shape`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.masked import as_image, bright
from siltstone.operators.pixels import blurred, psnr

# What colours are brought to, and the smooth base that bands leave out.
SPREAD, LEVEL, CLIP = 40.0, 128.0, (1, 99)
BANDS, BASE_SIGMA, BASE_STEP = (1, 2, 4, 8, 16), 55.0, 8
MODES = ("none", "gw", "gw+std", "gw+std+sat")


def normalised(a: np.ndarray, mode: str) -> np.ndarray:
    """Colours as they are, at equal channel means (gw), at one mean and spread too (gw+std), or from their 1st to 99th percentile (gw+std+sat)."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    if mode == "none":
        return a
    mean = a.mean(axis=(0, 1))
    a = a * (mean.mean() / np.maximum(mean, 1e-6))
    if mode == "gw":
        return a
    if mode == "gw+std":
        return (a - a.mean(axis=(0, 1))) / (a.std(axis=(0, 1)) + 1e-6) * SPREAD + LEVEL
    low, high = np.percentile(a, CLIP, axis=(0, 1))
    return (a - low) / (high - low + 1e-6) * 255


def linear_resize(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Linear interpolation to a size, corners kept."""
    for axis, n in enumerate(shape):
        at = np.linspace(0, a.shape[axis] - 1, n)
        low = np.minimum(at.astype(int), max(0, a.shape[axis] - 2))
        part = np.expand_dims(at - low, 1 - axis)
        a = np.take(a, low, axis) * (1 - part) + np.take(a, np.minimum(low + 1, a.shape[axis] - 1), axis) * part
    return a


def illumination(a: np.ndarray, sigma: float = BASE_SIGMA, step: int = BASE_STEP) -> np.ndarray:
    """The smooth base of an image, blurred on a coarse grid."""
    coarse = linear_resize(a, (max(4, a.shape[0] // step), max(4, a.shape[1] // step)))
    return linear_resize(blurred(coarse, max(0.5, sigma / step)), a.shape)


def bands(a: np.ndarray, mask: np.ndarray) -> list[float]:
    """Masked deviation of each octave band of the image without its base."""
    low, out = a - illumination(a), []
    rest = low
    for scale in BANDS:
        wide = blurred(rest, float(scale))
        out.append(float((low - wide)[mask].std()) if mask.any() else np.nan)
        low = wide
    return out


def saturation(a: np.ndarray, mask: np.ndarray) -> float:
    """Mean share by which the weakest channel is below the strongest, over the masked pixels."""
    high, low = a.max(axis=2)[mask], a.min(axis=2)[mask]
    return float(((high - low) / np.maximum(high, 1e-6)).mean()) if mask.any() else np.nan


COLOUR = ", ".join(["image_id string", "status string", *[f"{c} double" for c in ("lum_p10", "lum_p50", "lum_p90", "lum_sd", "grad_mean", "red", "green", "blue", "sat", *[f"e{b}" for b in BANDS])]])


def colour_features(images: DataFrame, mode: str = "none") -> DataFrame:
    """One row of features a colour image in a mode, over its pixels above the darkest 12 per cent of grey."""

    def one(a: np.ndarray) -> list[float]:
        a = normalised(a, mode)
        grey = a.mean(axis=2)
        mask = bright(grey)
        lum = grey[mask]
        levels = np.percentile(lum, [10, 50, 90]) if len(lum) else [np.nan] * 3
        means = a[mask].mean(axis=0) if len(lum) else [np.nan] * 3
        return [*levels, lum.std() if len(lum) else np.nan, np.hypot(*np.gradient(grey))[mask].mean() if len(lum) else np.nan, *means, saturation(a, mask), *bands(grey, mask)]

    if mode not in MODES:
        raise ValueError(f"no mode {mode}")

    def run(frames):
        for pdf in frames:
            made = [(i, as_image(h, w, *planes)) for i, h, w, *planes in zip(pdf["image_id"], pdf["h"], pdf["w"], pdf["r"], pdf["g"], pdf["b"], strict=True)]
            rows = [(i, "bad_shape", *[np.nan] * (9 + len(BANDS))) if a is None else (i, "ok", *map(float, one(a))) for i, a in made]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLOUR.split(", ")])

    return images.select("image_id", "h", "w", "r", "g", "b").mapInPandas(run, COLOUR)


# Resampling


def windowed_sinc(size: int, wanted: int, lobes: int = 3) -> np.ndarray:
    """(wanted, size) weights of each new sample: a sinc under a sinc window, as wide as the ratio asks for, of sum 1."""
    ratio = size / wanted
    reach = max(1.0, ratio)
    x = (np.arange(size)[None, :] + 0.5 - (np.arange(wanted)[:, None] + 0.5) * ratio) / reach
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image at no larger size, each axis by its own windowed sinc, rounded into 0 .. 255."""
    if height > a.shape[0] or width > a.shape[1]:
        raise ValueError(f"{a.shape[1]}x{a.shape[0]} can't be enlarged to {width}x{height}")
    for axis, n in ((0, height), (1, width)):
        if n != a.shape[axis]:
            a = np.moveaxis(np.tensordot(windowed_sinc(a.shape[axis], n), a, (1, axis)), 0, axis)
    return np.clip(np.rint(a), 0, 255)


def boxed(a: np.ndarray, factor: int) -> np.ndarray:
    """Means of squares of pixels."""
    h, w = (n // factor * factor for n in a.shape)
    return a[:h, :w].reshape(h // factor, factor, w // factor, factor).mean(axis=(1, 3))


def stop_band(source: np.ndarray, made: np.ndarray) -> float:
    """Decibels of the deviation that is left of a source, 20 log10: a grating above the new limit must nearly vanish."""
    return float(20 * np.log10(max(made.std(), 1e-9) / max(source.std(), 1e-9)))


def clipped(a: np.ndarray) -> float:
    return float(((a <= 0.5) | (a >= 254.5)).mean())


RESAMPLED = "image_id string, status string, h int, w int, rotation int, clipped double, clipped_more double, mean_before double, mean_after double, box_psnr double, pixels array<double>"


def resample(images: DataFrame, long_side: int, short_side: int) -> DataFrame:
    """Grey images turned by a quarter, clockwise, so that the long side lies flat, and brought to one size.

    status: `ok`, `identity` (of that size already), `enlarging` (refused), `bad_shape`. clipped_more: the share of
    clipped pixels that the resampling added. box_psnr: agreement with box means where the factor is a whole number.
    """

    def run(frames):
        for pdf in frames:
            rows = []
            for i, h, w, p in zip(pdf["image_id"], pdf["h"], pdf["w"], pdf["pixels"], strict=True):
                a = as_image(h, w, p)
                if a is None:
                    rows.append((i, "bad_shape", 0, 0, 0, *[np.nan] * 5, None))
                    continue
                a = a[..., 0]
                turn = 90 if a.shape[0] > a.shape[1] else 0
                a = np.rot90(a, -1) if turn else a
                if short_side > a.shape[0] or long_side > a.shape[1]:
                    rows.append((i, "enlarging", *a.shape, turn, clipped(a), np.nan, a.mean(), np.nan, np.nan, None))
                    continue
                same = a.shape == (short_side, long_side)
                out = a if same else resized(a, short_side, long_side)
                factor = a.shape[0] // short_side
                agrees = psnr(out, boxed(a, factor)) if a.shape == (factor * short_side, factor * long_side) else np.nan
                rows.append((i, "identity" if same else "ok", *out.shape, turn, clipped(a), max(0.0, clipped(out) - clipped(a)), a.mean(), out.mean(), agrees, out.ravel().tolist()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESAMPLED.split(", ")])

    return images.select("image_id", "h", "w", "pixels").mapInPandas(run, RESAMPLED)


# Mosaics


def mosaics(tiles: DataFrame, parent: str, order: str, side: int, columns: int = 3, lines: int = 2) -> DataFrame:
    """(parent, n_tiles, n_repeats, h, w, pixels): tiles of each parent, picked evenly by `order`, put together row by row.

    With fewer tiles than cells they are repeated from the first on. Tiles without side x side pixels take no part. Only
    picked tiles are shuffled with their pixels: a parent's tiles are counted and placed without them.
    """
    cells = columns * lines
    fit = tiles.where(F.size("pixels") == side * side)
    numbered = fit.select(parent, order, (F.row_number().over(Window.partitionBy(parent).orderBy(order)) - 1).alias("at"))
    sizes = numbered.groupBy(parent).agg(F.count(F.lit(1)).alias("n_tiles"))
    even = F.rint(F.col("cell") * (F.col("n_tiles") - 1) / F.lit(float(max(1, cells - 1))))
    wanted = sizes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("at", F.when(F.col("n_tiles") >= cells, even).otherwise(F.col("cell") % F.col("n_tiles")).cast("int"))
    picked = wanted.join(numbered, [parent, "at"]).join(fit.select(parent, order, "pixels"), [parent, order])
    each = picked.groupBy(parent, "n_tiles").agg(F.array_sort(F.collect_list(F.struct("cell", "pixels"))).alias("t"))  # `cells` tiles
    tile = lambda y, c: F.get("t", (F.floor(y / side) * columns + c).cast("int"))["pixels"]
    row = lambda y: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.slice(tile(y, c), y % side * side + 1, F.lit(side))))
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(lines * side - 1)), row))
    return each.select(parent, F.col("n_tiles"), F.greatest(F.lit(0), F.lit(cells) - F.col("n_tiles")).alias("n_repeats"), F.lit(lines * side).alias("h"), F.lit(columns * side).alias("w"), whole.alias("pixels"))


# Projections and crops


def projection_matrix(inputs: int, size: int, seed: int) -> np.ndarray:
    """A random matrix that depends on its shape and seed alone."""
    start = int.from_bytes(hashlib.sha256(f"projection|{inputs}|{size}|{seed}".encode()).digest()[:8], "little")
    return np.random.default_rng(start).standard_normal((inputs, size)) / np.sqrt(inputs)


def projected_vectors(images: DataFrame, size: int = 384, seed: int = 0, box: int = 4) -> DataFrame:
    """(image_id, status, vector): box means of a grey image at mean 0 and spread 1 under a random projection, of unit length.

    Every task makes the same matrix from the seed. A flat image gives zeros; sides that the box doesn't divide, `bad_shape`.
    """

    def run(frames):
        made: dict[int, np.ndarray] = {}
        for pdf in frames:
            rows = []
            for i, h, w, p in zip(pdf["image_id"], pdf["h"], pdf["w"], pdf["pixels"], strict=True):
                a = as_image(h, w, p)
                if a is None or h % box or w % box:
                    rows.append((i, "bad_shape", None))
                    continue
                v = boxed(a[..., 0], box).ravel()
                v = (v - v.mean()) / (v.std() if v.std() >= 1e-9 else 1.0)
                if len(v) not in made:
                    made[len(v)] = projection_matrix(len(v), size, seed)
                out = v @ made[len(v)]
                norm = np.linalg.norm(out)
                rows.append((i, "ok", (out / (norm if norm >= 1e-12 else 1.0)).tolist()))
            yield pd.DataFrame(rows, columns=["image_id", "status", "vector"])

    return images.select("image_id", "h", "w", "pixels").mapInPandas(run, "image_id string, status string, vector array<double>")


def crop_ratios(images: DataFrame, sides: tuple[int, ...]) -> DataFrame:
    """(side, ratio, p05, p95, below_half, n): how much of a centre crop is bright, against the whole image.

    Images that are smaller than a crop, or of bad shape, have no row for it.
    """

    def run(frames):
        for pdf in frames:
            rows = []
            for h, w, p in zip(pdf["h"], pdf["w"], pdf["pixels"], strict=True):
                a = as_image(h, w, p)
                if a is None:
                    continue
                mask = bright(a[..., 0])
                for side in sides:
                    if side <= min(mask.shape):
                        y, x = ((n - side) // 2 for n in mask.shape)
                        own = mask[y : y + side, x : x + side].mean()
                        rows.append((side, float(own / max(mask.mean(), 1e-9)), float(own)))
            yield pd.DataFrame(rows, columns=["side", "ratio", "own"])

    each = images.select("h", "w", "pixels").mapInPandas(run, "side int, ratio double, own double")
    level = lambda q: F.percentile("ratio", F.lit(q))
    return each.groupBy("side").agg(F.avg("ratio").alias("ratio"), level(0.05).alias("p05"), level(0.95).alias("p95"), F.count_if(F.col("own") < 0.5).alias("below_half"), F.count(F.lit(1)).alias("n"))


TILES = "image_id string, grid_col int, grid_row int, tile_x int, tile_y int, share double, mean double"


def tile_rows(images: DataFrame, side: int, least: float = 0.0) -> DataFrame:
    """One row a whole square tile of an image: its place, the share of bright pixels (or of `mask`) and their mean grey, null without any.

    Tiles under a share of `least` are left out, as are what remains at the right and lower edges and images of bad shape.
    """
    masked = "mask" in images.columns

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                a = as_image(r["h"], r["w"], r["pixels"])
                mask = None if a is None else bright(a[..., 0]) if not masked or r["mask"] is None else as_image(r["h"], r["w"], r["mask"])
                if mask is None or min(a.shape[:2]) < side:
                    continue
                inside = np.asarray(mask, float).reshape(a.shape[:2])
                share, total = boxed(inside, side), boxed(inside * a[..., 0], side)
                for (y, x), s in np.ndenumerate(share):
                    if s >= least:
                        rows.append((r["image_id"], x, y, x * side, y * side, float(s), float(total[y, x] / s) if s > 0 else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TILES.split(", ")])

    return images.select("image_id", "h", "w", "pixels", *(["mask"] if masked else [])).mapInPandas(run, TILES)
