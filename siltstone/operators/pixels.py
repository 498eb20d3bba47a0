"""Pixel kernels over images as rows (image_id, h, w, pixels array<double> of grey values 0-255)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian with mirrored edges."""
    reach = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(reach, reach) if x == axis else (0, 0) for x in (0, 1)]
        wide, n = np.pad(a, pad, mode="symmetric"), a.shape[axis]
        a = sum(w * np.take(wide, range(i, i + n), axis) for i, w in enumerate(k))  # whole images, a weight at a time
    return a


def otsu(a: np.ndarray, span: tuple[float, float] = (0, 256)) -> float:
    """Threshold that parts a 256-bin histogram with the largest variance between the sides."""
    n, edges = np.histogram(a, 256, span)
    mid = (edges[:-1] + edges[1:]) / 2
    low, mass = np.cumsum(n), np.cumsum(n * mid)
    high = low[-1] - low
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (mass / low - (mass[-1] - mass) / high) ** 2
    if not np.isfinite(between).any():  # all in one bin
        return float(a.flat[0])
    return float(mid[np.nanargmax(between)])


def octaves(a: np.ndarray, levels: int = 4) -> list[float]:
    """Standard deviation of each band of a difference-of-Gaussians stack."""
    out, last = [], a
    for k in range(levels):
        wide = blurred(a, 2.0**k)
        out.append(float((last - wide).std()))
        last = wide
    return out


def radial_spectrum(a: np.ndarray, bins: int = 16) -> np.ndarray:
    """Mean spectral power in rings of frequency, under a Hann window."""
    window = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    power = np.abs(np.fft.fft2((a - a.mean()) * window)) ** 2
    radius = np.hypot(*np.meshgrid(np.fft.fftfreq(a.shape[1]), np.fft.fftfreq(a.shape[0])))
    ring = np.minimum((radius / 0.5 * bins).astype(int), bins)
    total, n = np.bincount(ring.ravel(), power.ravel(), bins + 1), np.bincount(ring.ravel(), minlength=bins + 1)
    return (total / np.maximum(1, n))[:bins]


def correlation_ratio(a: np.ndarray) -> float:
    """Lag where the autocorrelation falls below 1/e, along rows over along columns; NaN if it never does."""

    def reach(x: np.ndarray) -> float:
        x = x - x.mean(axis=1, keepdims=True)
        f = np.fft.rfft(x, 2 * x.shape[1])
        c = np.fft.irfft(np.abs(f) ** 2)[:, : x.shape[1]].mean(axis=0)
        below = np.flatnonzero(c < c[0] / np.e)
        return float(below[0]) if c[0] > 0 and len(below) else np.nan

    return reach(a) / reach(a.T)


def structure_ratio(a: np.ndarray, sigma: float = 2.0) -> float:
    """Log ratio of the structure tensor's eigenvalues, averaged over the image: 0 without a direction."""
    dy, dx = np.gradient(a)
    xx, yy, xy = (blurred(p, sigma).mean() for p in (dx * dx, dy * dy, dx * dy))
    gap = np.hypot(xx - yy, 2 * xy)
    low, high = (xx + yy - gap) / 2, (xx + yy + gap) / 2
    return float(np.log((high + 1e-12) / (low + 1e-12))) if high > 0 else float("nan")


def variogram_range(a: np.ndarray, share: float = 0.9) -> float:
    """First lag at which the half mean squared difference reaches a share of the variance; NaN if none does."""
    sill = a.var()
    for lag in range(1, min(a.shape) // 2 + 1):
        gamma = (((a[:, lag:] - a[:, :-lag]) ** 2).mean() + ((a[lag:] - a[:-lag]) ** 2).mean()) / 4
        if sill > 0 and gamma >= share * sill:
            return float(lag)
    return float("nan")


def phase_scrambled(a: np.ndarray, seed: int) -> np.ndarray:
    """Random phases under the same spectrum, then the original values by rank: same histogram, no structure."""
    noise = np.random.default_rng(seed).random(a.shape)
    phase = np.fft.fft2(noise)
    mixed = np.fft.ifft2(np.abs(np.fft.fft2(a)) * phase / np.maximum(np.abs(phase), 1e-12)).real
    out = np.empty(a.size)
    out[np.argsort(mixed.ravel(), kind="stable")] = np.sort(a.ravel())
    return out.reshape(a.shape)


def regions(mask: np.ndarray) -> np.ndarray:
    """A number for each four-connected region of a mask, 0 outside, by spreading the least number until nothing changes."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    far = mask.size + 1
    while True:
        wide = np.pad(np.where(mask, label, far), 1, constant_values=far)
        least = np.minimum.reduce([wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]])
        spread = np.where(mask, least, 0)
        if (spread == label).all():
            return label
        label = spread


def largest_region(mask: np.ndarray, share: float = 0.0) -> np.ndarray:
    """The largest region; the mask itself if it has but one or none with that share of the image."""
    label = regions(mask)
    size = np.bincount(label.ravel())[1:]
    if np.count_nonzero(size) < 2 or size.max() < share * mask.size:
        return mask
    return label == size.argmax() + 1


def swept(mask: np.ndarray, radius: int, every: bool) -> np.ndarray:
    """Pixels with all (every) or any of the disc around them inside the mask; beyond the frame is outside."""
    reach = np.arange(-radius, radius + 1) ** 2
    wide, (h, w) = np.pad(mask, radius), mask.shape
    out = np.full(mask.shape, every)
    for y, x in np.argwhere(reach[:, None] + reach <= radius**2):
        view = wide[y : y + h, x : x + w]
        out = out & view if every else out | view
    return out


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask and its holes: all that the frame doesn't reach around it."""
    around = regions(np.pad(~mask, 1, constant_values=True))
    return (around != around[0, 0])[1:-1, 1:-1]


def soil_region(a: np.ndarray) -> np.ndarray:
    """Pixels bright against their surround: Otsu's threshold, closed and opened by a disc, holes filled, the largest region if it has 0.5 % of the image."""
    side = min(a.shape)
    flat = a / (blurred(a, max(2.0, 0.08 * side)) + 1e-6)
    mask, radius = flat > otsu(flat, (flat.min(), flat.max())), max(2, int(0.004 * side))
    for every in (False, True, True, False):
        mask = swept(mask, radius, every)
    return filled(largest_region(filled(mask), 0.005))


def dense_span(cover: np.ndarray) -> tuple[int, int]:
    """The first longest span whose smoothed density is at least 0.85 of the middle half's median; all of it if that is empty."""
    n, width = len(cover), max(3, int(0.05 * len(cover)) | 1)
    density = np.convolve(np.pad(cover, width // 2, mode="edge"), np.full(width, 1 / width), "valid")
    level = np.median(density[n // 4 : max(n // 4 + 1, 3 * n // 4)])
    if level <= 1e-6:
        return 0, n
    step = np.diff(np.concatenate([[0], (density >= 0.85 * level).astype(int), [0]]))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return 0, 0
    k = int((ends - starts).argmax())
    return int(starts[k]), int(ends[k])


def crop_box(mask: np.ndarray) -> tuple[int, int, int, int, float, str]:
    """(x0, y0, x1, y1, soil share, status) of the rectangle of even soil.

    Under 16 pixels a side it is the frame. At most 30 % of an axis may go, else the status is `capped`;
    a rectangle with under 85 % soil falls back to the whole frame.
    """
    h, w = mask.shape
    (x0, x1), (y0, y1) = dense_span(mask.mean(axis=0)), dense_span(mask.mean(axis=1))
    if min(x1 - x0, y1 - y0) < 16:
        x0, y0, x1, y1 = 0, 0, w, h
    status, least_w, least_h = "ok", round(0.7 * w), round(0.7 * h)
    if x1 - x0 < least_w or y1 - y0 < least_h:
        x0, y0, status = min(x0, w - least_w), min(y0, h - least_h), "capped"
        x1, y1 = x0 + least_w, y0 + least_h
    share = float(mask[y0:y1, x0:x1].mean())
    if share < 0.85:
        return 0, 0, w, h, float(mask.mean()), "fallback_fullframe"
    return x0, y0, x1, y1, share, status


def diagonal_contrast(a: np.ndarray, mask: np.ndarray, lag: int, diagonal: int = 3, least: int = 8) -> float:
    """Share of pixel pairs further apart in grey than the masked median deviation: the mean of four directions less that of 45 degrees.

    NaN if a direction has under `least` pairs inside the mask.
    """
    if not mask.any():
        return float("nan")
    mad = np.median(np.abs(a[mask] - np.median(a[mask]))) + 1e-12

    def share(grey: np.ndarray, inside: np.ndarray, down: int, right: int) -> float:
        h, w = grey.shape
        both = inside[down:, right:] & inside[: max(0, h - down), : max(0, w - right)]
        gap = np.abs(grey[down:, right:] - grey[: max(0, h - down), : max(0, w - right)])[both]
        return float((gap > mad).mean()) if len(gap) >= least else float("nan")

    tilted = share(a, mask, diagonal, diagonal)
    others = share(a, mask, 0, lag), share(a, mask, lag, 0), share(a[:, ::-1], mask[:, ::-1], diagonal, diagonal)
    return (tilted + sum(others)) / 4 - tilted


def centre_crop(a: np.ndarray, side: int, step: int = 4) -> np.ndarray:
    """The middle of an image, each side at most `side` and a multiple of `step`."""
    h, w = (min(side, n) // step * step for n in a.shape[:2])
    y, x = (a.shape[0] - h) // 2, (a.shape[1] - w) // 2
    return a[y : y + h, x : x + w]


def psnr(a: np.ndarray, b: np.ndarray, peak: float = 255.0) -> float:
    """Agreement of two images of one size in decibels."""
    return float(10 * np.log10(peak**2 / max(((np.asarray(a, float) - b) ** 2).mean(), 1e-9)))


def soil_mask(a: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Pixels above the Otsu threshold of the smoothed image, largest region only."""
    smooth = blurred(a, sigma)
    return largest_region(smooth > otsu(smooth))


SCHEMA = "image_id string, status string, mean double, sd double, grad_mean double, otsu double, e1 double, e2 double, e4 double, e8 double, centroid double, corr_ratio double, direction double, variogram double, mask_share double"


def features(images: DataFrame) -> DataFrame:
    """One row of features an image; an image whose pixels don't fit its size has status `bad_shape`."""

    def run(frames):
        for pdf in frames:
            rows = []
            for i, h, w, pixels in zip(pdf["image_id"], pdf["h"], pdf["w"], pdf["pixels"], strict=True):
                if pixels is None or len(pixels) != h * w or h < 2 or w < 2:
                    rows.append((i, "bad_shape", *[np.nan] * 13))
                    continue
                a = np.asarray(pixels, float).reshape(h, w)
                spectrum = radial_spectrum(a)
                centroid = float((spectrum * np.arange(len(spectrum))).sum() / spectrum.sum()) if spectrum.sum() > 0 else np.nan
                rows.append((i, "ok", a.mean(), a.std(), np.hypot(*np.gradient(a)).mean(), otsu(a), *octaves(a), centroid, correlation_ratio(a), structure_ratio(a), variogram_range(a), float(soil_mask(a).mean())))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return images.mapInPandas(run, SCHEMA)


CROPS = "image_id string, status string, x0 int, y0 int, x1 int, y1 int, soil double, contrast double"


def crops(images: DataFrame, lag: int = 2) -> DataFrame:
    """Each image's rectangle of even soil, the share of soil in it and the contrast across directions within; `bad_shape` as in features()."""

    def run(frames):
        for pdf in frames:
            rows = []
            for i, h, w, pixels in zip(pdf["image_id"], pdf["h"], pdf["w"], pdf["pixels"], strict=True):
                if pixels is None or len(pixels) != h * w or h < 2 or w < 2:
                    rows.append((i, "bad_shape", 0, 0, 0, 0, np.nan, np.nan))
                    continue
                a = np.asarray(pixels, float).reshape(h, w)
                mask = soil_region(a)
                x0, y0, x1, y1, soil, status = crop_box(mask)
                rows.append((i, status, x0, y0, x1, y1, soil, diagonal_contrast(a[y0:y1, x0:x1], mask[y0:y1, x0:x1], lag)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CROPS.split(", ")])

    return images.mapInPandas(run, CROPS)
