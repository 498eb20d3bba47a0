"""Spatial kernels of a masked grey image: each says why it can't be measured instead of giving a stand-in.

An image is a row (image_id, h, w, pixels array<double>) with an optional `mask` array<boolean> of the pixels that
count; without one the darkest `DARKEST` per cent don't. Kernels of a full mask are those of the whole image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from siltstone.operators.pixels import diagonal_contrast

# Limits below which a direction or a lag isn't measured, and what a range is.
LEAST_LINES, LEAST_PAIRS = 4, 8
LAG_SHARE, SILL_SHARE, SILL_TAIL, HALF = 0.5, 0.9, 0.10, 0.5
DARKEST, TINY = 12, 1e-12


class Unmeasured(ValueError):
    """A kernel has no value here; the message is the reason."""


def line_means(a: np.ndarray, mask: np.ndarray, axis: int) -> np.ndarray:
    """Mean of the masked pixels of each line across an axis, NaN for lines without any. axis 1: a value a column."""
    n = mask.sum(axis=1 - axis)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, np.where(mask, a, 0.0).sum(axis=1 - axis) / n, np.nan)


def folding_length(a: np.ndarray, mask: np.ndarray, axis: int) -> float:
    """Lag, between whole lags by a line, at which the line means' autocorrelation falls below 1/e; missing lines are in no pair."""
    line = line_means(a, mask, axis)
    there = np.isfinite(line)
    if there.sum() < LEAST_LINES:
        raise Unmeasured(f"{there.sum()} lines of {LEAST_LINES}")
    p = np.where(there, line - line[there].mean(), 0.0)
    energy = p @ p
    if not energy > 0:
        raise Unmeasured("no variance between lines")
    lags = max(1, int(LAG_SHARE * len(p)))
    share = np.correlate(p, p, "full")[len(p) - 1 :][:lags] / (energy + TINY)
    below = np.flatnonzero(share < 1 / np.e)
    if not len(below):
        raise Unmeasured(f"no decay within {lags} lags")
    k = int(below[0])
    gap = share[k - 1] - share[k]
    length = k - 1 + ((share[k - 1] - 1 / np.e) / gap if gap > TINY else 0.0)
    if length < 1:
        raise Unmeasured("decay within one lag")
    return float(length)


def folding_ratio(a: np.ndarray, mask: np.ndarray) -> float:
    """Folding length along x over that along y."""
    return (folding_length(a, mask, 1) + TINY) / (folding_length(a, mask, 0) + TINY)


def paired(x: np.ndarray, y: np.ndarray, axis: int, lags: int) -> np.ndarray:
    """Sums over all pixels of x times y `lag` further along an axis, for lags 1 .. lags, by one transform."""
    n = x.shape[axis]
    f, g = (np.fft.rfft(v, 2 * n, axis=axis) for v in (x, y))
    return np.take(np.fft.irfft(np.conj(f) * g, 2 * n, axis=axis), np.arange(1, lags + 1), axis=axis).sum(axis=1 - axis)


def semivariances(a: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Half the mean squared difference of masked pairs at lags 1, 2, .., the mean of both directions; NaN unless both have pairs enough.

    Pairs are counted by the mask's own correlation.
    """
    lags = max(1, a.shape[0] // 2 - 1)
    m = mask.astype(float)
    centred = np.where(mask, a - (a[mask].mean() if mask.any() else 0.0), 0.0)
    both = []
    for axis in (0, 1):
        if lags >= a.shape[axis]:
            return np.full(lags, np.nan)
        n = np.rint(paired(m, m, axis, lags))
        square = paired(centred**2, m, axis, lags) + paired(m, centred**2, axis, lags) - 2 * paired(centred, centred, axis, lags)
        with np.errstate(invalid="ignore", divide="ignore"):
            both.append(np.where(n >= LEAST_PAIRS, np.maximum(square, 0.0) / n / 2, np.nan))
    return (both[0] + both[1]) / 2


def sill_range(a: np.ndarray, mask: np.ndarray) -> float:
    """First lag that reaches 0.9 of the sill, the mean of the last tenth of lags, over half the image's height."""
    gamma = semivariances(a, mask)
    tail = gamma[-max(1, int(SILL_TAIL * len(gamma))) :]
    if np.isnan(tail).any():
        raise Unmeasured(f"{np.isnan(tail).sum()} of the sill's {len(tail)} lags not measured")
    sill = tail.mean()
    if sill <= TINY:
        raise Unmeasured("no sill")
    hit = np.flatnonzero(gamma >= SILL_SHARE * sill)
    if not len(hit):
        raise Unmeasured("the sill isn't reached")
    if np.isnan(gamma[: hit[0]]).any():
        raise Unmeasured("a lag before the range isn't measured")
    return float((hit[0] + 1) / (HALF * a.shape[0]))


def tensor_ratio(a: np.ndarray, mask: np.ndarray) -> float:
    """Log ratio of the smaller to the larger eigenvalue of the masked mean structure tensor: 0 without a direction."""
    if not mask.any():
        raise Unmeasured("no pixel in the mask")
    dy, dx = (g[mask] for g in np.gradient(a))
    low, high = np.linalg.eigvalsh([[np.mean(dx * dx), np.mean(dx * dy)], [np.mean(dx * dy), np.mean(dy * dy)]])
    return float(np.log((max(low, 0.0) + TINY) / (high + TINY)))


def contrast(a: np.ndarray, mask: np.ndarray, lag: int = 2) -> float:
    value = diagonal_contrast(a, mask, lag)
    if np.isnan(value):
        raise Unmeasured("a direction has too few pairs")
    return value


def percentiles(a: np.ndarray, mask: np.ndarray) -> list[float]:
    """Mean, deviation and the 10th, 50th and 90th percentile of the masked pixels."""
    v = a[mask]
    return [float(v.mean()), float(v.std()), *map(float, np.percentile(v, [10, 50, 90]))] if len(v) else [np.nan] * 5


def bright(a: np.ndarray) -> np.ndarray:
    """Pixels above the darkest per cent."""
    return a > np.percentile(a, DARKEST)


KERNELS = {"structure": tensor_ratio, "correlation": folding_ratio, "variogram": sill_range, "contrast": contrast}
STATS = ("mean", "sd", "p10", "p50", "p90")
SCHEMA = ", ".join(["image_id string", "status string", "mask_share double", *[f"{s} double" for s in STATS], *[f"{k} double, {k}_reason string" for k in KERNELS]])


def as_image(h: int, w: int, *planes: object) -> np.ndarray | None:
    """Planes of one size as an array; None if they don't fit it."""
    if h is None or w is None or h < 2 or w < 2 or any(p is None or len(p) != h * w for p in planes):
        return None
    found = np.stack([np.asarray(p, float).reshape(int(h), int(w)) for p in planes], axis=-1)
    return found if np.isfinite(found).all() else None


def spatial(images: DataFrame) -> DataFrame:
    """One row of masked statistics and kernels an image, null with a reason where one can't be measured.

    status: `ok`, `bad_shape` (pixels or mask don't fit h x w, or aren't finite), `empty_mask`.
    """
    masked = "mask" in images.columns

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                a = as_image(r["h"], r["w"], r["pixels"])
                mask = None if a is None else bright(a[..., 0]) if not masked or r["mask"] is None else as_image(r["h"], r["w"], r["mask"])
                if mask is None:
                    rows.append((r["image_id"], "bad_shape", *[np.nan] * 6, *[np.nan, "bad_shape"] * len(KERNELS)))
                    continue
                a, mask = a[..., 0], np.asarray(mask, bool).reshape(a.shape[:2])
                found = []
                for kernel in KERNELS.values():
                    try:
                        found += [kernel(a, mask), None]
                    except Unmeasured as why:
                        found += [np.nan, str(why)]
                rows.append((r["image_id"], "ok" if mask.any() else "empty_mask", float(mask.mean()), *percentiles(a, mask), *found))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return images.select("image_id", "h", "w", "pixels", *(["mask"] if masked else [])).mapInPandas(run, SCHEMA)
