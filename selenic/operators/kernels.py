"""Array kernels on bounded pieces of rasters, one Arrow group per piece.

Stencils run on tiles with a halo, separable kernels on strips of lines, template search
on tiles of both sides, so a raster of any size is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenic.operators.cells import ID, PLATEAU_M, SWEEP, by_tiles, correlation, gaussian_radius, gaussian_weights
from selenic.operators.stats import with_group
from selenic.session import materialise

c, lit = F.col, F.lit
#: cells of a strip of lines
STRIP = 1 << 18
#: side of rasters that a scale sweep takes whole
SWEEP_SIDE = 256


# ------------------------------------------------------------ stencils

def stencil(cells: DataFrame, halo: int, fn, outputs: list[str], border: str = "symmetric", tile: int = 256,
            value: str = "z", sized: bool = False) -> DataFrame:
    """Apply ``fn(padded_array) -> arrays`` tile by tile, with the raster's lines and samples if ``sized``.

    ``fn`` gets the tile with ``halo`` extra cells on every side (NaN for nodata) and
    returns one array per output for the tile itself. At the raster border the halo is
    a reflection (nodata with ``border="nan"``), inside it holds the neighbours.
    """
    x = with_group(cells.select("raster_id", "row", "col", value), ID, _h=F.max("row") + 1, _w=F.max("col") + 1)

    def span(axis):
        return F.sequence(F.greatest(lit(0), F.floor((c(axis) - halo) / tile)).cast("int"), F.floor((c(axis) + halo) / tile).cast("int"))
    x = x.withColumn("_tr", F.explode(span("row"))).withColumn("_tc", F.explode(span("col")))
    x = x.where((c("_tr") * tile < c("_h")) & (c("_tc") * tile < c("_w")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc, h, w = (int(pdf[k].iat[0]) for k in ("_tr", "_tc", "_h", "_w"))
        y0, y1, x0, x1 = tr * tile, min(h, (tr + 1) * tile), tc * tile, min(w, (tc + 1) * tile)
        by0, by1, bx0, bx1 = max(0, y0 - halo), min(h, y1 + halo), max(0, x0 - halo), min(w, x1 + halo)
        block = np.full((by1 - by0, bx1 - bx0), np.nan)
        rr, cc = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        block[rr - by0, cc - bx0] = pdf[value].to_numpy(dtype=float)
        pad = ((halo - (y0 - by0), halo - (by1 - y1)), (halo - (x0 - bx0), halo - (bx1 - x1)))
        block = np.pad(block, pad, constant_values=np.nan) if border == "nan" else np.pad(block, pad, mode=border)
        arrays = fn(block, h, w) if sized else fn(block)
        own = (rr >= y0) & (rr < y1) & (cc >= x0) & (cc < x1)
        out = {"raster_id": pdf["raster_id"].to_numpy()[own], "row": rr[own], "col": cc[own]}
        for name, arr in zip(outputs, arrays):
            v = arr[rr[own] - y0, cc[own] - x0]
            out[name] = pd.array(np.where(np.isfinite(v), v, 0.0), dtype="Float64")
            out[name][~np.isfinite(v)] = pd.NA
        return pd.DataFrame(out)

    ident = cells.schema["raster_id"].dataType.simpleString()
    schema = f"raster_id {ident}, row int, col int, " + ", ".join(f"{n} double" for n in outputs)
    return x.groupBy("raster_id", "_tr", "_tc").applyInPandas(run, schema)


def _separable(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    k = len(w) // 2
    a = sum(w[i] * a[..., :, i:a.shape[-1] - 2 * k + i] for i in range(2 * k + 1))
    return sum(w[i] * a[..., i:a.shape[-2] - 2 * k + i, :] for i in range(2 * k + 1))


class Sized(NamedTuple):
    """A width that follows the raster's size: of(lines, samples), and its upper bound."""

    of: Callable[[int, int], float]
    most: float


def gaussian_smooth(cells: DataFrame, sigma: float | Sized, tile: int = 256, value: str = "z") -> DataFrame:
    """Gaussian mean over the valid cells (radius 4 sigma, mirrored border)."""
    halo = gaussian_radius(sigma.most if isinstance(sigma, Sized) else sigma)

    def fn(a, h, w):
        w = np.array(gaussian_weights(sigma.of(h, w) if isinstance(sigma, Sized) else sigma))
        cut = halo - len(w) // 2
        a = a[cut:a.shape[0] - cut, cut:a.shape[1] - cut]
        ok = np.isfinite(a)
        den = _separable(ok.astype(float), w)
        return [_separable(np.where(ok, a, 0.0), w) / np.where(den > 1e-12, den, np.nan)]
    return stencil(cells, halo, fn, [value], tile=tile, value=value, sized=True)


def _blurred(a: np.ndarray) -> np.ndarray:
    w = np.array([0.25, 0.5, 0.25])
    ok = np.isfinite(a)
    den = _separable(ok.astype(float), w)
    return _separable(np.where(ok, a, 0.0), w) / np.where(den > 1e-12, den, np.nan)


def blur3(cells: DataFrame, tile: int = 256) -> DataFrame:
    """The light 3 x 3 smoothing of upsampled grids."""
    return stencil(cells, 1, lambda a: [_blurred(a)], ["z"], border="reflect", tile=tile)


def sobel_magnitude(cells: DataFrame, value: str, tile: int = 256) -> DataFrame:
    smooth, edge = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])

    def fn(a):
        def two(wr, wc):
            m = sum(wc[i] * a[:, i:a.shape[1] - 2 + i] for i in range(3))
            return sum(wr[i] * m[i:m.shape[0] - 2 + i, :] for i in range(3))
        return [np.hypot(two(smooth, edge), two(edge, smooth))]
    return stencil(cells, 1, fn, ["mag"], border="reflect", tile=tile, value=value)


def gradient_consistency(grid: DataFrame, floor: float = 0.02, min_cells: int = 1000) -> DataFrame:
    """Correlation of the gradient magnitudes of ``a`` and ``b`` where both exceed the floor."""
    key = ["raster_id", "row", "col"]
    ga = sobel_magnitude(grid, "a").withColumnRenamed("mag", "_ma")
    gb = sobel_magnitude(grid, "b").withColumnRenamed("mag", "_mb")
    x = grid.where((c("a") > floor) & (c("b") > floor)).join(ga, key).join(gb, key)
    out = x.groupBy("raster_id").agg(correlation(c("_ma"), c("_mb")).alias("gradient_corr"), F.count("*").alias("n"))
    return out.withColumn("gradient_corr", F.when(c("n") > min_cells, c("gradient_corr")))


# ------------------------------------------------------------ strips

def along(cells: DataFrame, axis: str, fn, inputs: list[str], outputs: list[str], keep: list[str] = ID, strip: int = STRIP) -> DataFrame:
    """Apply ``fn(arrays, first, size) -> arrays`` to whole lines of every raster.

    ``axis`` is ``row`` or ``col``: the lines run along it, so separable work takes one pass
    for each axis. A group is a strip of adjacent lines of about ``strip`` cells (one line at
    least), whatever the raster's size. Arrays are (lines, length) with NaN for NULL and
    absent cells; ``first`` is the strip's first line, ``size`` the raster's (lines, samples).
    The lines that come back may have another length; ``_h`` and ``_w`` carry the new size
    on to the next pass.
    """
    other = "row" if axis == "col" else "col"
    if "_h" in cells.columns:  # an earlier pass has told the size
        x = cells.select(*keep, "row", "col", "_h", "_w", *inputs)
    else:
        x = with_group(cells.select(*keep, "row", "col", *inputs), keep, _h=F.max("row") + 1, _w=F.max("col") + 1)
    length = c("_w") if axis == "col" else c("_h")
    x = x.withColumn("_n", F.greatest(lit(1), F.floor(lit(strip) / length)).cast("int")).withColumn("_s", F.floor(c(other) / c("_n")).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w, n, k = (int(pdf[v].iat[0]) for v in ("_h", "_w", "_n", "_s"))
        size, first = (w, h) if axis == "col" else (h, w), k * n
        count = min(n, size[1] - first)
        line, at = pdf[other].to_numpy() - first, pdf[axis].to_numpy()
        blocks = []
        for v in inputs:
            blocks.append(np.full((count, size[0]), np.nan))
            blocks[-1][line, at] = pdf[v].to_numpy(dtype=float)
        arrays = fn(blocks, first, (h, w))
        i, j = np.indices(arrays[0].shape)
        out = {v: pdf[v].iat[0] for v in keep} | {other: i.ravel() + first, axis: j.ravel()}
        out |= {"_h": h, "_w": arrays[0].shape[1]} if axis == "col" else {"_h": arrays[0].shape[1], "_w": w}
        return pd.DataFrame(out | {v: b.ravel() for v, b in zip(outputs, arrays, strict=True)})[[*keep, "row", "col", "_h", "_w", *outputs]]

    ident = ", ".join(f"{v} {cells.schema[v].dataType.simpleString()}" for v in keep)
    return x.groupBy(*keep, "_s").applyInPandas(run, f"{ident}, row int, col int, _h int, _w int, " + ", ".join(f"{v} double" for v in outputs))


def _linear_taps(size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two source positions of each of ``n`` targets and the weight of the second."""
    at = (np.arange(n) + 0.5) * size / n - 0.5
    base = np.floor(at)
    return *(np.clip(base + k, 0, size - 1).astype(int) for k in (0, 1)), at - base


def upsample_linear(cells: DataFrame, n: int) -> DataFrame:
    """Linear resampling to n x n, one pass along each axis; weights are shared out over the valid cells."""
    def mixed(block: np.ndarray) -> np.ndarray:
        first, second, w = _linear_taps(block.shape[1], n)
        return block[:, first] * (1 - w) + block[:, second] * w

    def cols(blocks, *_):
        return [mixed(np.nan_to_num(blocks[0])), mixed(np.isfinite(blocks[0]).astype(float))]

    def rows(blocks, *_):
        # absent lines hold nothing
        z, w = (mixed(np.nan_to_num(b)) for b in blocks)
        return [z / np.where(w > 0, w, 1.0), w]

    half = along(cells.select(*ID, "row", "col", "z"), "col", cols, ["z"], ["z", "w"])
    return along(half, "row", rows, ["z", "w"], ["z", "w"]).where("w > 0").select(*ID, "row", "col", "z")


def upsample_labels(cells: DataFrame, n: int) -> DataFrame:
    """Class grid at n x n, one pass along each axis: the class with the largest interpolated weight, lowest id
    on ties. Cells of no class (NULL) vote together and lose ties; absent ones have no vote."""
    def cols(blocks, *_):
        first, second, w = _linear_taps(blocks[0].shape[1], n)
        return [blocks[0][:, first], blocks[0][:, second], np.broadcast_to(w, (len(blocks[0]), n))]

    def rows(blocks, *_):
        first, second, w = _linear_taps(blocks[0].shape[1], n)
        # the weight of the second column is the same on every line, but absent lines lack it
        across = np.nan_to_num(blocks[2].max(axis=1, initial=0, where=np.isfinite(blocks[2])))[:, None]
        votes = [(blocks[k][:, src], wr * wc) for src, wr in ((first, 1 - w), (second, w)) for k, wc in ((0, 1 - across), (1, across))]
        best, most = np.full(votes[0][0].shape, np.nan), np.full(votes[0][0].shape, -1.0)
        for k, _ in votes:
            total = np.round(sum(np.where(k == other, x, 0.0) for other, x in votes), 9)
            better = ~np.isnan(k) & ((total > most) | ((total == most) & (k < best)))
            best, most = np.where(better, k, best), np.where(better, total, most)
        return [best]

    kind = cells.schema["class_id"].dataType
    coded = cells.select(*ID, "row", "col", F.coalesce(c("class_id").cast("double"), lit(float("inf"))).alias("k"))
    half = along(coded, "col", cols, ["k"], ["k0", "k1", "w"])
    out = along(half, "row", rows, ["k0", "k1", "w"], ["k"]).where(c("k").isNotNull() & ~F.isnan("k"))
    return out.select(*ID, "row", "col", F.when(c("k") < float("inf"), c("k")).cast(kind).alias("class_id"))


def fourier_lowpass(cells: DataFrame, keep: float = 0.15) -> DataFrame:
    """Truncated Fourier series: low rows and columns of the spectrum on both ends.

    One pass along each axis; NULL cells count as 0 and the raster's own cells come back.
    """
    def low(block: np.ndarray) -> np.ndarray:
        n = block.shape[1]
        m = max(4, int(n * keep) // 2)
        high = np.arange(n)
        spectrum = np.fft.fft(block, axis=1)
        spectrum[:, (high >= m) & (high < n - m)] = 0
        return np.fft.ifft(spectrum, axis=1)

    def first(blocks, *_):
        z = low(np.nan_to_num(blocks[0]))
        return [z.real, z.imag]

    half = along(cells, "col", first, ["z"], ["re", "im"])
    full = along(half, "row", lambda b, *_: [low(b[0] + 1j * b[1]).real], ["re", "im"], ["z"]).drop("_h", "_w")
    return full.join(cells.select("raster_id", "row", "col"), ["raster_id", "row", "col"], "left_semi")


def poisson_integrate(slopes: DataFrame, cell_m: float = 1.0, rms_slope_deg: float = 8.0, legacy: bool = False) -> DataFrame:
    """Heights whose slopes are (p, q) in the least-squares sense, of zero mean and the stated RMS slope.

    p is the slope along columns and q along rows; ``legacy=True`` differentiates the two
    along the other axis, as the older products did. Slopes are tapered by a Hann window.
    The periodic equation is diagonal in frequencies, and the transforms are separable: the
    divergence and the transform down the columns, the division between two transforms
    along the rows, the transform back, each a pass over strips of lines.
    """
    across, down = ("q", "p") if legacy else ("p", "q")

    def taper(block, first, n_other):
        return np.nan_to_num(block) * np.hanning(n_other)[first:first + len(block), None] * np.hanning(block.shape[1])

    def rows(blocks, first, size):
        return [np.gradient(taper(blocks[0], first, size[0]), axis=1)]

    def columns(blocks, first, size):
        spectrum = np.fft.fft(np.nan_to_num(blocks[0]) + np.gradient(taper(blocks[1], first, size[1]), axis=1), axis=1)
        return [spectrum.real, spectrum.imag]

    def divide(blocks, first, size):
        w2 = [(2 * np.pi * np.fft.fftfreq(n)) ** 2 for n in size]
        total = w2[0][first:first + len(blocks[0]), None] + w2[1]
        spectrum = np.fft.fft(blocks[0] + 1j * blocks[1], axis=1)
        out = np.fft.ifft(np.divide(-spectrum, total, out=np.zeros_like(spectrum), where=total > 0), axis=1)
        return [out.real, out.imag]

    def back(blocks, *_):
        z = np.fft.ifft(blocks[0] + 1j * blocks[1], axis=1).real
        return [z, np.gradient(z / cell_m, axis=1) ** 2]

    key = [*ID, "row", "col"]
    part = along(slopes, "col", rows, [across], ["g"]).join(slopes.select(*key, c(down).alias("s")), key, "left")
    z = along(along(part, "row", columns, ["g", "s"], ["re", "im"]), "col", divide, ["re", "im"], ["re", "im"])
    z = along(z, "row", back, ["re", "im"], ["z", "gy"])
    z = along(z, "col", lambda b, *_: [b[0], b[1] + np.gradient(b[0] / cell_m, axis=1) ** 2], ["z", "gy"], ["z", "g"])
    z = materialise(z.drop("_h", "_w"), "poisson")  # read twice below
    # the zero frequency was left out, so the mean is zero already but for rounding
    z = with_group(z, ID, _m=F.avg("z"), _g=F.avg("g"))
    z = z.select(*key, ((c("z") - c("_m")) * np.tan(np.radians(rms_slope_deg)) / F.greatest(F.sqrt("_g"), lit(1e-9))).alias("z"))
    return z.join(slopes.select(*key), key, "left_semi")


def _spread(known: np.ndarray, rounds: int) -> np.ndarray:
    """Rings around the known cells: a cell takes the mean of its neighbours in the ring before."""
    value, seen = np.nan_to_num(known), np.isfinite(known)
    for _ in range(rounds):
        total, count = np.zeros_like(value), np.zeros(value.shape, dtype=int)
        for axis in (0, 1):
            for to, of in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
                to, of = ((..., to, slice(None)), (..., of, slice(None))) if axis == 0 else ((..., to), (..., of))
                total[to] += value[of]
                count[to] += seen[of]
        ring = ~seen & (count > 0)
        if not ring.any():
            break
        value[ring] = total[ring] / count[ring]
        seen |= ring
    return np.where(seen, value, np.nan)


def inpaint(cells: DataFrame, reach: int = 32, tile: int = 256) -> DataFrame:
    """NULL cells become the mean of their 4-neighbours one ring nearer to the valid cells; 0 if there are none.

    A pass fills ``reach`` rings tile by tile with a halo as wide, which holds all that they
    depend on; passes go on until none of the cells that can be filled is left.
    """
    own = cells.select("raster_id", "row", "col", "z")
    left = None
    while True:
        open_cells = own.groupBy("raster_id").agg(F.count_if(c("z").isNull()).alias("h"), F.count("z").alias("n")).where("n > 0").agg(F.sum("h")).first()[0] or 0
        if not open_cells or open_cells == left:
            return own.withColumn("z", F.coalesce("z", lit(0.0)))
        left = open_cells
        own = materialise(stencil(own, reach, lambda a: [_spread(a, reach)[reach:-reach, reach:-reach]], ["z"], border="nan", tile=tile), "inpaint")


def resample_cubic(lines: np.ndarray, n: int) -> np.ndarray:
    """Cubic convolution (a = -0.75) of each line to n cells, replicated border: four taps a cell."""
    at, a = (np.arange(n) + 0.5) * lines.shape[1] / n - 0.5, -0.75
    base, out = np.floor(at).astype(int), np.zeros((len(lines), n))
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        w = np.where(d <= 1, (a + 2) * d ** 3 - (a + 3) * d ** 2 + 1, a * (d ** 3 - 5 * d ** 2 + 8 * d - 4))
        out += lines[:, np.clip(base + k, 0, lines.shape[1] - 1)] * w
    return out


def resample_area(lines: np.ndarray, n: int) -> np.ndarray:
    """Mean of the cells under each of n cells of a line, by running sums: memory grows with the line."""
    m = lines.shape[1]
    if m == n:
        return lines.astype(float)
    middle = lines.mean(axis=1, keepdims=True)
    total = np.zeros((len(lines), m + 1))
    np.cumsum(lines - middle, axis=1, out=total[:, 1:])
    edge = np.minimum(np.arange(n + 1) * (m / n), m)
    whole = np.minimum(np.floor(edge).astype(int), m - 1)
    at = total[:, whole] + (lines - middle)[:, whole] * (edge - whole)
    return np.diff(at, axis=1) * (n / m) + middle


def upsample_cubic(cells: DataFrame, n: int = 192) -> DataFrame:
    """Bicubic resampling to n x n with nodata-aware area weights, one pass along each axis.

    ``w`` is the valid share under a cell; cells with hardly any are 0.
    """
    def first(blocks, *_):
        z = blocks[0]
        return [resample_cubic(np.nan_to_num(z), n), resample_area(np.isfinite(z), n)]

    def second(blocks, *_):
        v, w = resample_cubic(np.nan_to_num(blocks[0]), n), resample_area(np.nan_to_num(blocks[1]), n)
        return [np.where(w < 1e-3, 0.0, v / np.maximum(w, 1e-6)), w]

    return along(along(cells, "col", first, ["z"], ["v", "w"]), "row", second, ["v", "w"], ["z", "w"]).drop("_h", "_w")


def upsample_smoothed(cells: DataFrame, n: int = 192) -> DataFrame:
    """``upsample_cubic`` with a light smoothing that leaves the cells without data at 0."""
    up = materialise(upsample_cubic(cells, n), "upsampled")
    smooth = blur3(up).join(up.select("raster_id", "row", "col", "w"), ["raster_id", "row", "col"])
    return smooth.select("raster_id", "row", "col", F.when(c("w") < 1e-3, 0.0).otherwise(c("z")).alias("z"))


# ------------------------------------------------------------ grids of many windows

def _resampled(z: np.ndarray, n: int) -> np.ndarray:
    """``upsample_smoothed`` of a stack of windows of one size."""
    def both(fn, a):
        a = fn(a.reshape(-1, a.shape[2]), n).reshape(*a.shape[:2], n).transpose(0, 2, 1)
        return fn(a.reshape(-1, a.shape[2]), n).reshape(*a.shape[:2], n).transpose(0, 2, 1)
    v, w = both(resample_cubic, np.nan_to_num(z)), both(resample_area, np.isfinite(z))
    up = np.where(w < 1e-3, 0.0, v / np.maximum(w, 1e-6))
    return np.where(w < 1e-3, 0.0, _blurred(np.pad(up, ((0, 0), (1, 1), (1, 1)), mode="reflect")))


def _averaged(z: np.ndarray, seen: np.ndarray, n: int) -> np.ndarray:
    """``block_average`` of a stack of windows of one size; NaN where a block has no cell."""
    start = [-(-np.arange(n) * size // n) for size in z.shape[1:]]
    s, v, k = (np.add.reduceat(np.add.reduceat(a, start[0], axis=1), start[1], axis=2)
               for a in (np.nan_to_num(z), np.isfinite(z).astype(float), seen.astype(float)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(k == 0, np.nan, np.where(v / k < 1e-3, 0.0, s / v))


def _unclamped(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stack of grids without their clamped plateaus (see ``cells.clamp_plateau``) and the plateaus' shares, NaN for none."""
    ok = np.isfinite(grid)
    size, high = ok.sum((1, 2)), np.where(ok, grid, -np.inf).max((1, 2))
    top = ok & (grid >= (high - PLATEAU_M)[:, None, None])
    top &= (top.sum((1, 2)) > size * 0.01)[:, None, None]
    near = np.pad(top, ((0, 0), (3, 3), (3, 3)))
    near = np.logical_or.reduce([near[:, i:i + grid.shape[1]] for i in range(7)])
    near = np.logical_or.reduce([near[:, :, j:j + grid.shape[2]] for j in range(7)])
    count = near.sum((1, 2))
    return np.where(near, np.nan, grid), np.where(count > 0, count / np.maximum(size, 1), np.nan)


def window_grids(cells: DataFrame, windows: DataFrame, n: int, tile: int = 256, filled: bool = True) -> DataFrame:
    """Every window as an n x n grid: ``(window_id, z, valid, relief, plateau_share)``.

    ``windows(window_id, raster_id, r0, c0, r1, c1)`` have no side over ``tile``. Windows below n are interpolated,
    larger ones averaged; plateaus are filled in and the minimum becomes zero. ``z`` holds the rows of the grid,
    ``valid`` the valid cells of the window, ``relief`` the grid's standard deviation; without ``filled`` there is no ``z``. The windows that start in a
    tile are cut into groups of about 2 ** 22 grid cells at most; a group meets the cells of four tiles, which hold
    all of its windows, and works on arrays of many windows at once: no window's cell is a row.
    """
    most = max(1, min(4096, (1 << 22) // (n * n)))
    own, x = by_tiles(cells.select("raster_id", "row", "col", "z"), windows, tile, most)
    ident = windows.schema["window_id"].dataType.simpleString()
    schema = f"window_id {ident}, " + ("z array<double>, " if filled else "") + "valid bigint, relief double, plateau_share double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame({k: [] for k in names})
        top, side = int(a["_tr"].iat[0]) * tile, int(a["_tc"].iat[0]) * tile
        r0, c0, r1, c1 = (a[k].to_numpy() - o for k, o in (("r0", top), ("c0", side), ("r1", top), ("c1", side)))
        block = np.full((r1.max(), c1.max()), np.nan)
        seen = np.zeros(block.shape, dtype=bool)
        row, col = b["row"].to_numpy() - top, b["col"].to_numpy() - side
        at = (row < block.shape[0]) & (col < block.shape[1])
        block[row[at], col[at]], seen[row[at], col[at]] = b["z"].to_numpy(dtype=float)[at], True
        valid = np.zeros(len(a), dtype="int64")
        grid = np.full((len(a), n, n), np.nan)
        for h, w, of in _alike(r1 - r0, c1 - c0):
            view = [np.lib.stride_tricks.sliding_window_view(m, (h, w)) for m in (block, seen)]
            for part in np.array_split(of, -(-len(of) * h * w // (1 << 20))):
                z, there = (m[r0[part], c0[part]] for m in view)
                valid[part] = np.isfinite(z).sum((1, 2))
                if min(h, w) >= n:
                    grid[part] = _averaged(z, there, n)
                    continue
                # a window reaches as far as there are cells
                ends = [there.shape[k] - there.any(3 - k)[:, ::-1].argmax(1) for k in (1, 2)]
                for hh, ww, some in _alike(*ends):
                    grid[part[some]] = _resampled(z[some][:, :hh, :ww], n)
        open_grid, share = _unclamped(grid)
        full = np.nan_to_num(_spread(open_grid, 2 * n))
        full -= full.min((1, 2), keepdims=True)
        z = {"z": list(full.reshape(len(a), -1))} if filled else {}
        return pd.DataFrame({"window_id": a["window_id"].to_numpy(), **z, "valid": valid, "relief": full.std((1, 2)),
                             "plateau_share": pd.array(share, dtype="Float64")})

    group = ["raster_id", "_tr", "_tc", "_g"]
    out = own.groupBy(*group).cogroup(x.groupBy(*group)).applyInPandas(run, schema)
    return out.withColumn("plateau_share", F.nanvl("plateau_share", lit(None).cast("double")))


def _alike(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """The places of each pair of values."""
    order = np.lexsort((b, a))
    cut = np.flatnonzero((np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)) + 1
    for part in np.split(order, cut):
        yield int(a[part[0]]), int(b[part[0]]), part


# ------------------------------------------------------------ template search

def window_sums(image: np.ndarray, tpl: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of image, image squared and image times template under the template at every placement."""
    h, w = tpl.shape
    shape = [image.shape[i] + tpl.shape[i] - 1 for i in (0, 1)]
    full = np.fft.irfft2(np.fft.rfft2(image, shape) * np.fft.rfft2(tpl[::-1, ::-1], shape), shape)

    def box(a):
        s = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]
    return box(image), box(image ** 2), full[h - 1:image.shape[0], w - 1:image.shape[1]]


def template_ncc(templates: DataFrame, images: DataFrame, key: str | list[str] = "raster_id", tile: int = 256) -> DataFrame:
    """Best placement of a template in an image, per pair: (row, col, ncc); NULLs if it doesn't fit.

    Placements and the template are cut into tiles. A group holds one tile of each and the
    image cells between; sums over the template's tiles are partial aggregates, so a pair
    of any size is spread over many tasks. NULL and absent cells count as 0.
    """
    keys = [key] if isinstance(key, str) else key
    size = lambda **aggs: templates.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])
    t = size(_r=F.min("row"), _c=F.min("col"), _th=F.max("row") - F.min("row") + 1, _tw=F.max("col") - F.min("col") + 1, _ts=F.sum(F.coalesce("z", lit(0.0))))
    t = t.withColumn("_tm", c("_ts") / (c("_th") * c("_tw")))
    i = images.groupBy(*keys).agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"), F.avg(F.coalesce("z", lit(0.0))).alias("_im"))
    both = t.join(i, keys).withColumns({"_ph": c("_h") - c("_th") + 1, "_pw": c("_w") - c("_tw") + 1})
    fits = both.where("_ph > 0 and _pw > 0")

    def steps(a: Column, b: Column):
        return F.sequence(F.floor(F.greatest(a, lit(0)) / tile).cast("int"), F.floor(b / tile).cast("int"))

    tpl = templates.join(fits, keys).select(*keys, (c("row") - c("_r")).alias("row"), (c("col") - c("_c")).alias("col"),
                                            (F.coalesce("z", lit(0.0)) - c("_tm")).alias("z"), "_ph", "_pw", "_th", "_tw", "_tm", "_im")
    tpl = tpl.withColumns({"_a": F.floor(c("row") / tile).cast("int"), "_b": F.floor(c("col") / tile).cast("int"),
                           "_y": F.explode(steps(lit(0), c("_ph") - 1))}).withColumn("_x", F.explode(steps(lit(0), c("_pw") - 1)))
    # image rows of placement tile y under template tile a: (y + a) * tile up to two tiles on
    img = images.join(fits, keys).select(*keys, "row", "col", (F.coalesce("z", lit(0.0)) - c("_im")).alias("z"), "_ph", "_pw", "_th", "_tw")
    for axis, a, y, p, n in (("row", "_a", "_y", "_ph", "_th"), ("col", "_b", "_x", "_pw", "_tw")):
        img = img.withColumn(y, F.explode(steps(lit(0), c(p) - 1))).withColumn(a, F.explode(steps(lit(0), c(n) - 1)))
        img = img.where(c(axis).between((c(y) + c(a)) * tile, (c(y) + c(a) + 2) * tile - 2))
    group = [*keys, "_y", "_x", "_a", "_b"]
    # fresh column identities, so that two pieces of one table can be grouped together
    tpl, img = (d.select(*[c(v).alias(v) for v in d.columns]) for d in (tpl, img))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "row", "col", "s", "ss", "st"]
        if a.empty or b.empty:
            return pd.DataFrame({k: [] for k in cols})
        ph, pw, th, tw, y, x, ta, tb = (int(a[k].iat[0]) for k in ("_ph", "_pw", "_th", "_tw", "_y", "_x", "_a", "_b"))
        n, m = min(tile, ph - y * tile), min(tile, pw - x * tile)
        h, w = min(tile, th - ta * tile), min(tile, tw - tb * tile)
        piece, block = np.full((h, w), -a["_tm"].iat[0]), np.full((n + h - 1, m + w - 1), -a["_im"].iat[0])
        piece[a["row"].to_numpy() - ta * tile, a["col"].to_numpy() - tb * tile] = a["z"].to_numpy()
        r, q = b["row"].to_numpy() - (y + ta) * tile, b["col"].to_numpy() - (x + tb) * tile
        ok = (r < block.shape[0]) & (q < block.shape[1])
        block[r[ok], q[ok]] = b["z"].to_numpy()[ok]
        s, ss, st = window_sums(block, piece)
        i, j = np.indices(s.shape)
        out = {k: a[k].iat[0] for k in keys} | {"row": i.ravel() + y * tile, "col": j.ravel() + x * tile}
        return pd.DataFrame(out | {"s": s.ravel(), "ss": ss.ravel(), "st": st.ravel()})[cols]

    ident = ", ".join(f"{k} {images.schema[k].dataType.simpleString()}" for k in keys)
    sums = tpl.groupBy(*group).cogroup(img.groupBy(*group)).applyInPandas(run, f"{ident}, row int, col int, s double, ss double, st double")
    sums = sums.groupBy(*keys, "row", "col").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("st").alias("st"))
    power = tpl.where("_y = 0 and _x = 0").groupBy(*keys).agg(
        F.sum(c("z") * c("z")).alias("_tt"), F.count(lit(1)).alias("_tn"))
    x = sums.join(fits.select(*keys, "_th", "_tw", "_tm").join(power, keys), keys)
    x = x.withColumn("_tt", c("_tt") + (c("_th") * c("_tw") - c("_tn")) * c("_tm") * c("_tm"))  # absent cells of the template
    den = F.sqrt(F.greatest(c("ss") - c("s") * c("s") / (c("_th") * c("_tw")), lit(0.0)) * c("_tt"))
    # placements that agree to nine digits are ties: the first one wins
    x = x.withColumn("ncc", F.when(den > 1e-9, c("st") / den).otherwise(0.0))
    best = x.groupBy(*keys).agg(F.max_by(F.struct("row", "col", "ncc"), F.struct(F.round("ncc", 9), -c("row"), -c("col"))).alias("_b"))
    return both.select(*keys).join(best, keys, "left").select(*keys, "_b.row", "_b.col", "_b.ncc")


def scale_sweep(strips: DataFrame, images: DataFrame, base_scale: float = 1.0, factors: tuple[float, ...] = SWEEP,
                max_tpl: int | None = 512, min_overlap: int = 128, key: str = "raster_id", floor: int = 64,
                max_side: int | None = 4096) -> DataFrame:
    """Resample a strip by each factor, search its centre in the image, keep the best factor.

    The strip is resampled by area to ``base_scale``, and from there once per factor, one pass along
    each axis; no side gets below ``floor``, factors with a side over ``max_side`` are skipped. The
    template is the largest even square that strip and image allow (at most ``max_tpl``); factors whose
    square is below ``min_overlap`` are skipped, and a pair without any gets NULLs. Pairs of bounded
    sides are worked on as arrays, larger ones in pieces. The sampling distance is 0.5 / factor;
    (dx, dy) is the shift against the image centre.
    """
    images = images.select(c(key).alias("raster_id"), "row", "col", "z")
    strips = strips.select(c(key).alias("raster_id"), "row", "col", "z")
    frame = images.groupBy("raster_id").agg((F.max("row") + 1).alias("_ih"), (F.max("col") + 1).alias("_iw"))
    rule = (base_scale, factors, max_tpl, min_overlap, floor, max_side)
    size = strips.groupBy("raster_id").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w")).join(frame, "raster_id")
    size = materialise(size.withColumn("_wide", F.greatest("_h", "_w", "_ih", "_iw") > (SWEEP_SIDE if base_scale * max(factors) <= 4 else 0)), "sweep-sizes")
    wide = size.where("_wide").select("raster_id")
    if wide.isEmpty():
        tries = _sweep_arrays(strips, images, *rule)
    else:
        tries = _sweep_arrays(strips.join(wide, "raster_id", "left_anti"), images.join(wide, "raster_id", "left_anti"), *rule).unionByName(
            _sweep_cells(strips.join(wide, "raster_id", "left_semi"), images.join(wide, "raster_id", "left_semi"), *rule))
    tries = tries.withColumns({"dx": (c("col") - F.floor((c("_iw") - c("_t")) / 2)).cast("int"),
                               "dy": (c("row") - F.floor((c("_ih") - c("_t")) / 2)).cast("int"), "gsd_m": 0.5 / c("factor")})
    best = tries.groupBy("raster_id").agg(F.max_by(F.struct("factor", "ncc", "dx", "dy", "gsd_m"), F.struct(F.round("ncc", 9), -c("ord"))).alias("_b"))
    return size.select("raster_id").join(best, "raster_id", "left").select(c("raster_id").alias(key), "_b.*")


SWEEP_COLUMNS = ["raster_id", "factor", "ord", "row", "col", "ncc", "_t", "_ih", "_iw"]


def _sweep_arrays(strips: DataFrame, images: DataFrame, base_scale: float, factors: tuple[float, ...], max_tpl: int | None,
                  min_overlap: int, floor: int, max_side: int | None) -> DataFrame:
    """The best placement of each factor, pairs of bounded size: a strip and its image are a group, resampled and searched as arrays."""
    parts = int(strips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # little is read and much is made of it, so small partitions are not merged
    strips, images = (d.select(*[c(v).alias(v) for v in d.columns]).repartition(parts, "raster_id") for d in (strips, images))

    def dense(pdf: pd.DataFrame, absent: float = 0.0) -> np.ndarray:
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        out = np.full((row.max() + 1, col.max() + 1), absent)
        out[row, col] = np.nan_to_num(pdf["z"].to_numpy(dtype=float))
        return out

    def resized(z: np.ndarray, side) -> np.ndarray:
        return resample_area(resample_area(z, side(z.shape[1])).T, side(z.shape[0])).T

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if not a.empty and not b.empty:
            image = dense(b)
            image -= np.nan_to_num(b["z"].to_numpy(dtype=float)).mean()
            (ih, iw), base = image.shape, resized(dense(a), lambda n: max(floor, round(n * base_scale)))
            for k, f in enumerate(factors):
                if max_side and int(max(base.shape) * f) > max_side:
                    continue
                body = resized(base, lambda n: max(floor, int(n * f)))
                h, w = body.shape
                t = min(min(h, ih) // 2 * 2, min(w, iw) // 2 * 2, *([max_tpl] if max_tpl else []))
                if t < max(min_overlap, 1):
                    continue
                top, side = (h - t) // 2, (w - t) // 2
                tpl = body[top:top + t, side:side + t]
                tpl = tpl - tpl.sum() / (t * t)
                s, ss, st = window_sums(image, tpl)
                den = np.sqrt(np.maximum(ss - s * s / (t * t), 0.0) * (tpl * tpl).sum())
                ncc = np.where(den > 1e-9, st / np.where(den > 1e-9, den, 1.0), 0.0)
                # placements that agree to nine digits are ties: the first one wins
                y, x = np.unravel_index(np.round(ncc, 9).argmax(), ncc.shape)
                rows.append((a["raster_id"].iat[0], f, k, int(y), int(x), float(ncc[y, x]), t, ih, iw))
        return pd.DataFrame(rows, columns=SWEEP_COLUMNS)

    ident = strips.schema["raster_id"].dataType.simpleString()
    return strips.groupBy("raster_id").cogroup(images.groupBy("raster_id")).applyInPandas(
        run, f"raster_id {ident}, factor double, ord int, row int, col int, ncc double, _t int, _ih int, _iw int")


def _sweep_cells(strips: DataFrame, images: DataFrame, base_scale: float, factors: tuple[float, ...], max_tpl: int | None,
                 min_overlap: int, floor: int, max_side: int | None) -> DataFrame:
    """The best placement of each factor, pairs of any size, cell by cell."""
    def resampled(cells: DataFrame, side) -> DataFrame:
        step = lambda b, *_: [resample_area(np.nan_to_num(b[0]), side(b[0].shape[1]))]
        return along(along(cells, "col", step, ["z"], ["z"]), "row", step, ["z"], ["z"])

    frame = images.groupBy("raster_id").agg((F.max("row") + 1).alias("_ih"), (F.max("col") + 1).alias("_iw"))
    base = materialise(resampled(strips, lambda n: max(floor, round(n * base_scale))), "base")
    keys, parts = ["raster_id", "factor", "ord"], []
    for k, f in enumerate(factors):
        fits = base.where(F.floor(F.greatest("_h", "_w") * lit(float(f))) <= max_side) if max_side else base
        body = resampled(fits, lambda n, f=f: max(floor, int(n * f))).drop("_h", "_w")
        parts.append(body.withColumns({"factor": lit(float(f)), "ord": lit(k)}))
    body = parts[0]
    for p in parts[1:]:
        body = body.unionByName(p)
    body = materialise(body, "sweep")
    dims = body.groupBy(*keys).agg((F.max("row") + 1).alias("_sh"), (F.max("col") + 1).alias("_sw")).join(frame, "raster_id")
    even = lambda a, b: F.floor(F.least(a, b) / 2) * 2
    t = F.least(even(c("_sh"), c("_ih")), even(c("_sw"), c("_iw")), *([lit(max_tpl)] if max_tpl else []))
    dims = dims.withColumn("_t", t.cast("int")).where(c("_t") >= min_overlap)
    top, side = F.floor((c("_sh") - c("_t")) / 2), F.floor((c("_sw") - c("_t")) / 2)
    tpl = body.join(dims, keys).where((c("row") >= top) & (c("row") < top + c("_t")) & (c("col") >= side) & (c("col") < side + c("_t")))
    pairs = images.join(dims.select(*keys), "raster_id").select(*keys, "row", "col", "z")
    tries = template_ncc(tpl.select(*keys, "row", "col", "z"), pairs, keys).where("ncc is not null").join(dims, keys)
    return tries.select(*SWEEP_COLUMNS)
