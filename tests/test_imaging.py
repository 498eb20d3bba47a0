"""Masked kernels, colour tiles, resampling, mosaics, projections and profile tags against plain loops."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import imaging, masked, pixels
from siltstone.sources import profiles


def noise(seed, h=32, w=32, smooth=1.5):
    return pixels.blurred(np.random.default_rng(seed).random((h, w)) * 255, smooth)


def value(kernel, a, mask):
    try:
        return kernel(a, mask)
    except masked.Unmeasured as why:
        return str(why)


def plain_semivariances(a, mask):
    out = []
    for lag in range(1, a.shape[0] // 2):
        both = []
        for dy, dx in ((0, lag), (lag, 0)):
            gaps = [(a[y, x] - a[y + dy, x + dx]) ** 2 / 2 for y in range(a.shape[0] - dy) for x in range(a.shape[1] - dx) if mask[y, x] and mask[y + dy, x + dx]]
            both.append(np.mean(gaps) if len(gaps) >= 8 else np.nan)
        out.append(np.mean(both))
    return out


def plain_length(a, mask, axis):
    lines = [[a[k, j] for j in range(a.shape[1]) if mask[k, j]] if axis == 0 else [a[j, k] for j in range(a.shape[0]) if mask[j, k]] for k in range(a.shape[axis])]
    means = [np.mean(v) if v else None for v in lines]
    there = [m for m in means if m is not None]
    p = [0.0 if m is None else m - np.mean(there) for m in means]
    share = [sum(p[i] * p[i + k] for i in range(len(p) - k)) / sum(v * v for v in p) for k in range(len(p) // 2)]
    k = next(k for k, s in enumerate(share) if s < 1 / np.e)
    return k - 1 + (share[k - 1] - 1 / np.e) / (share[k - 1] - share[k])


@pytest.mark.parametrize("seed", range(4))
def test_masked_kernels_by_plain_loops(seed):
    r, a = np.random.default_rng(seed), noise(seed)
    for mask in (np.ones(a.shape, bool), r.random(a.shape) < 0.6, np.arange(32)[:, None] + np.zeros(32) > 11):
        assert masked.semivariances(a, mask) == pytest.approx(plain_semivariances(a, mask), nan_ok=True, abs=1e-8)
        got = value(masked.folding_ratio, a, mask)
        if isinstance(got, float):
            assert got == pytest.approx(plain_length(a, mask, 1) / plain_length(a, mask, 0))
        assert masked.percentiles(a, mask)[2:] == pytest.approx(np.quantile(a[mask], [0.1, 0.5, 0.9]))


def test_a_full_mask_is_no_mask_and_what_lies_outside_counts_for_nothing():
    a, r = noise(7), np.random.default_rng(7)
    full = np.ones(a.shape, bool)
    whole = {k: value(f, a, full) for k, f in masked.KERNELS.items()}
    gy, gx = np.gradient(a)
    low, high = np.linalg.eigvalsh([[np.mean(gx * gx), np.mean(gx * gy)], [np.mean(gx * gy), np.mean(gy * gy)]])
    assert whole["structure"] == pytest.approx(np.log(low / high))
    mask = r.random(a.shape) < 0.7
    other = np.where(mask, a, r.random(a.shape) * 1e4)
    for k in ("correlation", "variogram", "contrast"):
        assert value(masked.KERNELS[k], other, mask) == value(masked.KERNELS[k], a, mask) or value(masked.KERNELS[k], other, mask) == pytest.approx(value(masked.KERNELS[k], a, mask), rel=1e-6)


def test_reasons_instead_of_stand_ins(spark):
    a, none, thin = noise(8), np.zeros((32, 32), bool), np.zeros((32, 32), bool)
    thin[:, 5:7] = True
    images = [("fine", a, np.ones((32, 32), bool)), ("none", a, none), ("thin", a, thin), ("flat", np.full((32, 32), 9.0), np.ones((32, 32), bool))]
    rows = [(i, 32, 32, p.ravel().tolist(), m.ravel().tolist()) for i, p, m in images] + [("short", 32, 32, [1.0], [True]), ("null", 32, 32, None, None), ("nan", 2, 2, [1.0, float("nan"), 1.0, 2.0], [True] * 4)]
    got = {r["image_id"]: r for r in masked.spatial(spark.createDataFrame(rows, "image_id string, h int, w int, pixels array<double>, mask array<boolean>")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"fine": "ok", "none": "empty_mask", "thin": "ok", "flat": "ok", "short": "bad_shape", "null": "bad_shape", "nan": "bad_shape"}
    assert got["thin"]["correlation_reason"] == "2 lines of 4" and got["thin"]["correlation"] is None
    assert got["thin"]["variogram_reason"].endswith("lags not measured") and got["flat"]["variogram_reason"] == "no sill"
    assert got["flat"]["correlation_reason"] == "no variance between lines" and got["none"]["structure_reason"] == "no pixel in the mask"
    assert got["fine"]["structure_reason"] is None and got["fine"]["mask_share"] == 1.0
    bare = masked.spatial(spark.createDataFrame([r[:4] for r in rows[:1]], "image_id string, h int, w int, pixels array<double>")).first()
    assert bare["mask_share"] == pytest.approx(0.88, abs=0.01)


def test_colour_modes():
    r = np.random.default_rng(1)
    a = r.random((24, 24, 3)) * [100, 200, 50] + [50, 10, 5]
    assert imaging.normalised(a, "none") is a
    gw = imaging.normalised(a, "gw")
    assert np.ptp(gw.mean(axis=(0, 1))) < 1e-9 and gw.mean() == pytest.approx(a.mean())
    std = imaging.normalised(a, "gw+std")
    assert std.mean(axis=(0, 1)) == pytest.approx([128] * 3) and std.std(axis=(0, 1)) == pytest.approx([40] * 3, abs=1e-3)
    sat = imaging.normalised(a, "gw+std+sat")
    assert np.percentile(sat, 1, axis=(0, 1)) == pytest.approx([0] * 3, abs=1e-6) and np.percentile(sat, 99, axis=(0, 1)) == pytest.approx([255] * 3, abs=1e-3)
    with pytest.raises(ValueError, match="no mode"):
        imaging.normalised(a, "other")


def test_colour_features_by_numpy(spark):
    a = np.stack([noise(k, 40, 48) for k in range(3)], axis=-1)
    planes = [a[..., k].ravel().tolist() for k in range(3)]
    rows = [("a", 40, 48, *planes), ("bad", 40, 48, planes[0], planes[1], None)]
    df = spark.createDataFrame(rows, "image_id string, h int, w int, r array<double>, g array<double>, b array<double>")
    for mode in imaging.MODES:
        got = {x["image_id"]: x for x in imaging.colour_features(df, mode).collect()}
        n = imaging.normalised(a, mode)
        grey = n.mean(axis=2)
        mask = grey > np.percentile(grey, 12)
        assert got["bad"]["status"] == "bad_shape"
        one = got["a"]
        assert [one["lum_p10"], one["lum_p50"], one["lum_p90"], one["lum_sd"]] == pytest.approx([*np.percentile(grey[mask], [10, 50, 90]), grey[mask].std()])
        assert [one["red"], one["green"], one["blue"]] == pytest.approx(n[mask].mean(axis=0).tolist())
    flat = imaging.illumination(np.full((64, 64), 7.0))
    assert np.allclose(flat, 7.0)
    fine, coarse = (np.tile(np.sin(np.arange(128) * 2 * np.pi / p) * 50 + 100, (128, 1)) for p in (4, 40))
    mask = np.ones((128, 128), bool)
    assert np.argmax(imaging.bands(fine, mask)) <= 1 < 3 <= np.argmax(imaging.bands(coarse, mask))


def test_resampling(spark):
    constant = imaging.resized(np.full((60, 90), 77.0), 17, 31)
    assert (constant == 77).all() and imaging.windowed_sinc(90, 31).sum(axis=1) == pytest.approx(np.ones(31))
    x = np.arange(300)
    grating = lambda period: np.tile(np.sin(x * 2 * np.pi / period) * 100 + 127, (300, 1))
    assert imaging.stop_band(grating(4), imaging.resized(grating(4), 100, 100)) < -30  # beyond the new limit of 6 pixels
    assert imaging.stop_band(grating(30), imaging.resized(grating(30), 100, 100)) > -0.5
    assert grating(4)[:, ::3].std() > 60  # what leaving pixels out would give
    with pytest.raises(ValueError, match="enlarged"):
        imaging.resized(np.zeros((10, 10)), 10, 11)
    smooth = noise(3, 90, 60, 4)
    rows = [("tall", 90, 60, smooth.ravel().tolist()), ("same", 20, 30, [5.0] * 600), ("small", 10, 30, [5.0] * 300), ("bad", 3, 3, [1.0])]
    got = {r["image_id"]: r for r in imaging.resample(spark.createDataFrame(rows, "image_id string, h int, w int, pixels array<double>"), 30, 20).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"tall": "ok", "same": "identity", "small": "enlarging", "bad": "bad_shape"}
    turned = np.array([[smooth[89 - j, i] for j in range(90)] for i in range(60)])  # clockwise by a quarter
    assert got["tall"]["rotation"] == 90 and got["tall"]["pixels"] == imaging.resized(turned, 20, 30).ravel().tolist()
    assert got["tall"]["box_psnr"] > 35 and got["tall"]["clipped_more"] == 0.0 and (got["tall"]["h"], got["tall"]["w"]) == (20, 30)
    edge = np.repeat([[1.0, 254.0]], 60, axis=0).repeat(45, axis=1)
    assert imaging.clipped(edge) == 0 < imaging.clipped(imaging.resized(edge, 20, 30))  # overshoot beside the edge is cut off


def test_mosaics(spark):
    tile = lambda k: [float(100 * k + j) for j in range(4)]
    rows = [("many", f"t{k:02d}", tile(k)) for k in range(11)] + [("few", f"t{k:02d}", tile(k)) for k in range(4)] + [("few", "t99", [1.0])]
    got = {r["parent"]: r for r in imaging.mosaics(spark.createDataFrame(rows, "parent string, tile string, pixels array<double>"), "parent", "tile", 2).collect()}
    for name, n, index in (("many", 11, np.rint(np.linspace(0, 10, 6)).astype(int)), ("few", 4, [0, 1, 2, 3, 0, 1])):
        canvas = np.zeros((4, 6))
        for cell, k in enumerate(index):
            canvas[cell // 3 * 2 : cell // 3 * 2 + 2, cell % 3 * 2 : cell % 3 * 2 + 2] = np.array(tile(k)).reshape(2, 2)
        r = got[name]
        assert (r["n_tiles"], r["n_repeats"], r["h"], r["w"], r["pixels"]) == (n, max(0, 6 - n), 4, 6, canvas.ravel().tolist())


def test_projections_are_the_same_on_any_partitions(spark):
    rows = [(f"i{k}", 16, 16, noise(k, 16, 16).ravel().tolist()) for k in range(12)] + [("flat", 16, 16, [3.0] * 256), ("odd", 5, 5, [1.0] * 25)]
    df = spark.createDataFrame(rows, "image_id string, h int, w int, pixels array<double>")
    one, many = ({r["image_id"]: r["vector"] for r in imaging.projected_vectors(df.repartition(n), 20).collect()} for n in (1, 7))
    assert one == many and one["odd"] is None and set(one["flat"]) == {0.0}
    assert all(np.linalg.norm(one[f"i{k}"]) == pytest.approx(1) for k in range(12))
    brighter = df.withColumn("pixels", F.transform("pixels", lambda x: x + 20))
    assert {r["image_id"]: r["vector"] for r in imaging.projected_vectors(brighter, 20).collect()}["i3"] == pytest.approx(one["i3"])


def test_crop_ratios(spark):
    pictures = [noise(k, 20, 24) for k in range(5)]
    df = spark.createDataFrame([(20, 24, p.ravel().tolist()) for p in pictures] + [(2, 2, None)], "h int, w int, pixels array<double>")
    got = {r["side"]: r for r in imaging.crop_ratios(df, (8, 20, 22)).collect()}
    mask = [p > np.percentile(p, 12) for p in pictures]
    want = [m[6:14, 8:16].mean() / m.mean() for m in mask]
    assert set(got) == {8, 20} and got[8]["ratio"] == pytest.approx(np.mean(want)) and got[8]["p95"] == pytest.approx(np.quantile(want, 0.95)) and got[8]["n"] == 5


def profile(description, red=(0.4361, 0.2225, 0.0139), kind="desc"):
    text = description.encode("latin1") + b"\0"
    body = b"desc" + bytes(4) + struct.pack(">I", len(text)) + text if kind == "desc" else b"mluc" + bytes(4) + struct.pack(">II", 1, 12) + b"enUS" + struct.pack(">II", 2 * len(description), 28) + description.encode("utf-16-be")
    xyz = b"XYZ " + bytes(4) + struct.pack(">3i", *[round(v * 65536) for v in red])
    first = 132 + 24
    table = struct.pack(">I", 2) + b"desc" + struct.pack(">II", first, len(body)) + b"rXYZ" + struct.pack(">II", first + len(body), len(xyz))
    return bytes(16) + b"RGB XYZ " + bytes(104) + table + body + xyz


def test_profile_tags(spark):
    good, other = profile("Display P3"), profile("Größe", kind="mluc")
    broken = bytearray(good)
    broken[140:144] = struct.pack(">I", 10**6)
    rows = [("plain", good), ("several", other), ("cut", good[:170]), ("offset", bytes(broken)), ("short", b"abc"), ("empty", b""), ("null", None), ("count", good[:128] + struct.pack(">I", 2**31))]
    got = {r["name"]: r for r in profiles.profile_tags(spark.createDataFrame(rows, "name string, icc binary"), "icc", ["name"]).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"plain": "ok", "several": "ok", "cut": "bad_offset", "offset": "bad_offset", "short": "short", "empty": "none", "null": "none", "count": "bad_offset"}
    one = got["plain"]
    assert (one["description"], one["colour_space"], one["connection_space"], one["n_tags"], one["bytes"]) == ("Display P3", "RGB ", "XYZ ", 2, len(good))
    assert [one["red_x"], one["chroma_x"]] == pytest.approx([0.4361, 0.4361 / 0.6725], abs=1e-4)
    assert got["several"]["description"] == "Größe" and got["offset"]["reason"] == "bytes 156 to 1000156 of 199" and got["null"]["n_tags"] == 0


def test_tile_rows(spark):
    a = noise(9, 10, 13)
    mask = a > np.percentile(a, 12)
    got = imaging.tile_rows(spark.createDataFrame([("a", 10, 13, a.ravel().tolist()), ("b", 3, 3, [1.0] * 9), ("c", 1, 1, None)], "image_id string, h int, w int, pixels array<double>"), 4).collect()
    want = {(x, y): mask[4 * y : 4 * y + 4, 4 * x : 4 * x + 4] for y in range(2) for x in range(3)}
    assert {(r["grid_col"], r["grid_row"]): r["share"] for r in got} == pytest.approx({k: m.mean() for k, m in want.items()})
    for r in got:
        own = a[r["tile_y"] : r["tile_y"] + 4, r["tile_x"] : r["tile_x"] + 4][want[r["grid_col"], r["grid_row"]]]
        assert r["mean"] == pytest.approx(own.mean()) if len(own) else r["mean"] is None
