"""Kernels on rasters beyond one group, against dense versions."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from selenic.operators import cells as ops
from selenic.operators import kernels


def table(spark, a: np.ndarray):
    r, q = np.indices(a.shape)
    pdf = pd.DataFrame({"raster_id": 1, "row": r.ravel(), "col": q.ravel(), "z": a.ravel().astype(object)})
    pdf["z"] = pdf["z"].where(np.isfinite(a).ravel(), None)
    return spark.createDataFrame(pdf, "raster_id long, row int, col int, z double")


def dense(df, shape):
    pdf, out = df.toPandas(), np.full(shape, np.nan)
    out[pdf["row"], pdf["col"]] = pdf["z"].astype(float)
    return out


@pytest.fixture(scope="module")
def image():
    r = np.random.default_rng(4)
    return np.add.outer(np.sin(np.arange(1300) / 40), np.cos(np.arange(90) / 9)) * 50 + r.normal(size=(1300, 90))


def test_lowpass(spark, image, monkeypatch):
    monkeypatch.setattr(kernels.along, "__defaults__", (*kernels.along.__defaults__[:-1], 20_000))
    f = np.fft.fft2(image)
    for axis, n in enumerate(image.shape):
        m = max(4, int(n * 0.15) // 2)
        f[(slice(None),) * axis + (slice(m, n - m),)] = 0
    assert np.allclose(dense(kernels.fourier_lowpass(table(spark, image)), image.shape), np.fft.ifft2(f).real, atol=1e-6)


def test_fill_wide_hole(spark, image):
    a = image.copy()
    a[300:420, 5:85] = np.nan  # farther than one pass reaches
    got = dense(kernels.inpaint(table(spark, a), reach=16, tile=64), a.shape)
    want, todo = a.copy(), np.isnan(a)
    while todo.any():
        ring = {}
        for i, j in zip(*np.nonzero(todo)):
            near = [want[y, x] for y, x in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= y < a.shape[0] and 0 <= x < a.shape[1] and not np.isnan(want[y, x])]
            if near:
                ring[i, j] = np.mean(near)
        for (i, j), v in ring.items():
            want[i, j] = v
            todo[i, j] = False
    assert np.allclose(got, want)


def plain_cubic(n_in: int, n_out: int) -> np.ndarray:
    """Weights out x in from the kernel's definition, one by one."""
    out = np.zeros((n_out, n_in))
    for o in range(n_out):
        at = (o + 0.5) * n_in / n_out - 0.5
        for i in range(int(np.floor(at)) - 1, int(np.floor(at)) + 3):
            d = abs(at - i)
            w = 1.25 * d ** 3 - 2.25 * d ** 2 + 1 if d <= 1 else -0.75 * d ** 3 + 3.75 * d ** 2 - 6 * d + 3
            out[o, min(max(i, 0), n_in - 1)] += w
    return out


def plain_area(n_in: int, n_out: int) -> np.ndarray:
    step = n_in / n_out
    return np.array([[max(0.0, min((o + 1) * step, i + 1) - max(o * step, i)) / step for i in range(n_in)] for o in range(n_out)])


def test_cubic(spark, image):
    up = plain_cubic(1300, 64) @ image @ plain_cubic(90, 64).T
    assert np.allclose(dense(kernels.upsample_cubic(table(spark, image), 64), (64, 64)), up, atol=1e-6)


@pytest.mark.parametrize("n", [1, 7, 64, 89, 90, 91, 200])
def test_resampling_equals_dense_weights(image, n):
    assert np.allclose(kernels.resample_area(image[:40], n), image[:40] @ plain_area(90, n).T, atol=1e-9)
    assert np.allclose(kernels.resample_cubic(image[:40], n), image[:40] @ plain_cubic(90, n).T, atol=1e-9)


def test_resampling_of_a_long_line_needs_memory_for_the_line_only():
    line = np.sin(np.arange(90_148) / 500)[None] + 1000
    tracemalloc.start()
    up = kernels.resample_area(line, 225_370)
    assert np.allclose(kernels.resample_area(up, 90_148), line, atol=1e-2) and up.mean() == pytest.approx(line.mean())
    kernels.resample_cubic(line, 225_370)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_sweep_floor_and_largest_side(spark, image):
    strip, frame = table(spark, image[:100]), table(spark, image[:120])
    kept = kernels.scale_sweep(strip, frame, factors=(0.2, 1.0), min_overlap=16).first()
    assert kept.factor == 1.0 and kept.ncc == pytest.approx(1.0)
    none = kernels.scale_sweep(strip, frame, factors=(1.0,), min_overlap=16, max_side=99).first()
    assert none.factor is None and none.ncc is None


def test_template_over_several_tiles(spark, image):
    found = kernels.template_ncc(table(spark, image[610:690, 17:77]), table(spark, image), tile=48).first()
    assert (found.row, found.col) == (610, 17) and found.ncc == pytest.approx(1.0)
    assert kernels.template_ncc(table(spark, image), table(spark, image[:50])).first().ncc is None


def test_windows_over_absent_cells(spark):
    """Shares from the two levels equal plain counts, with rows, tiles and whole tile lines absent."""
    rng = np.random.default_rng(5)
    there = rng.random((300, 200)) < 0.7
    there[40:50] = False
    there[64:128, 64:128] = False
    there[192:256] = False
    rows, cols = np.nonzero(there)
    good = rng.random(len(rows)) < 0.6
    grid = np.zeros(there.shape, int)
    grid[rows, cols] = good
    cells = spark.createDataFrame(pd.DataFrame({"raster_id": 1, "row": rows, "col": cols, "ok": good}))
    r0, c0 = rng.integers(0, 290, 120), rng.integers(0, 190, 120)
    r1, c1 = r0 + rng.integers(0, 130, 120), c0 + rng.integers(0, 90, 120)  # some without an area, some beyond the raster
    windows = spark.createDataFrame(pd.DataFrame({"window_id": range(120), "raster_id": 1, "r0": r0, "c0": c0, "r1": r1, "c1": c1}))
    want = [None if a == b or d == e else grid[a:b, d:e].sum() / ((b - a) * (e - d)) for a, b, d, e in zip(r0, r1, c0, c1, strict=True)]
    got = {r["window_id"]: r["valid_fraction"] for r in ops.window_valid(ops.summed_area(cells, F.col("ok"), windows), windows).collect()}
    for i, w in enumerate(want):
        assert got[i] is None if w is None else got[i] == pytest.approx(w), i
