"""Raster algebra on tiles: one row holds a packed array of cells.

A tile table has ``(raster_id, tile_r, tile_c, row0, col0, n_rows, n_cols, data)``, as ``rasters.read_raster_tiles``
gives it, and with ``framed`` the raster's ``lines`` and ``samples``; nodata is NULL within ``data``. Results are new
array columns beside it, so a chain of operators never takes a tile apart.

* Pointwise operators and partial aggregates run on Arrow arrays and shuffle no cell.
* A stencil needs its neighbours' edges only: each tile sends the strips along its border (``halo`` cells
  wide) to the tiles beside it, and the strips of a tile, eight at most, are joined to it. Tiles dealt once
  with ``deal`` stay where they are for every stencil of a chain, with ``keep`` between two of them; only
  strips are shuffled.
* Exact percentiles come from counts of 16 bits a pass over the ordered 64-bit form of a double, so
  every pass narrows whatever the values, and a window holds 65,536 counts at most.

Every tile but those at a raster's end has ``tile`` rows and columns, and a halo is no wider than that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from selenic.operators.cells import gaussian_radius, gaussian_weights
from selenic.session import materialise, workdir

c, lit = F.col, F.lit
KEY = ["raster_id", "tile_r", "tile_c"]
SHAPE = ["row0", "col0", "n_rows", "n_cols"]
OUTSIDE = {"nan": np.nan, "beyond": np.inf}


# ------------------------------------------------------------ arrays

def arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column as double arrays, NaN for NULL."""
    flat = column.values.to_numpy(zero_copy_only=False).astype("float64", copy=False)
    ends = column.offsets.to_numpy()
    for i in range(len(column)):
        yield flat[ends[i]:ends[i + 1]]


def packed(found: list[np.ndarray]) -> pa.Array:
    """Arrays as a list column, NULL for what is not finite."""
    flat = np.concatenate([a.ravel() for a in found]) if found else np.zeros(0)
    offsets = np.concatenate([[0], np.cumsum([a.size for a in found])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64(), mask=~np.isfinite(flat)))


def pointwise(fn: Callable[..., np.ndarray], data: Column, *args: Column) -> Column:
    """``fn(cells, *scalars)`` for each tile."""
    def run(data: pa.Array, *args: pa.Array) -> pa.Array:
        scalars = [x.to_pylist() for x in args]
        return packed([fn(a, *(s[i] for s in scalars)) for i, a in enumerate(arrays(data))])
    run.__annotations__ = {"data": pa.Array, "args": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<double>")(data, *args)


# ------------------------------------------------------------ form

def from_cells(cells: DataFrame, tile: int = 256, value: str = "z") -> DataFrame:
    """Tiles of a cell table; absent cells are nodata. A Python group is one tile."""
    x = cells.select("raster_id", "row", "col", c(value).cast("double").alias("z"))
    size = x.groupBy("raster_id").agg((F.max("row") + 1).cast("int").alias("lines"), (F.max("col") + 1).cast("int").alias("samples"))
    x = x.withColumn("tile_r", F.floor(c("row") / tile).cast("int")).withColumn("tile_c", F.floor(c("col") / tile).cast("int"))
    spot = (c("row") - c("tile_r") * tile) * tile + (c("col") - c("tile_c") * tile)
    x = x.groupBy(*KEY).agg(F.collect_list(spot).alias("_at"), F.collect_list(F.coalesce("z", lit(float("nan")))).alias("_z")).join(size, "raster_id")
    x = x.withColumns({"row0": c("tile_r") * tile, "col0": c("tile_c") * tile}).withColumns(
        {"n_rows": F.least(lit(tile), c("lines") - c("row0")), "n_cols": F.least(lit(tile), c("samples") - c("col0"))})

    def run(at: pa.Array, z: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        out = []
        for spot, cell, n, m in zip(arrays(at), arrays(z), h.to_pylist(), w.to_pylist(), strict=True):
            a = np.full((n, m), np.nan)
            spot = spot.astype(int)
            a[spot // tile, spot % tile] = cell
            out.append(a)
        return packed(out)
    run.__annotations__ = dict.fromkeys(["at", "z", "h", "w", "return"], pa.Array)
    return x.withColumn("data", F.arrow_udf(run, "array<double>")("_at", "_z", "n_rows", "n_cols")).drop("_at", "_z")


def to_cells(tiles: DataFrame, *values: str) -> DataFrame:
    """(raster_id, row, col, values...) of every cell of the tiles."""
    values = values or ("data",)
    zipped = F.arrays_zip(*values) if len(values) > 1 else F.transform(values[0], lambda v: F.struct(v.alias(values[0])))
    x = tiles.select("raster_id", *SHAPE, F.posexplode(zipped).alias("_i", "_v"))
    return x.select("raster_id", (c("row0") + F.floor(c("_i") / c("n_cols"))).cast("int").alias("row"),
                    (c("col0") + c("_i") % c("n_cols")).cast("int").alias("col"), *[c(f"_v.{v}").alias(v) for v in values])


def framed(tiles: DataFrame) -> DataFrame:
    """Tiles with the lines and samples of their raster, from the tiles' places."""
    size = tiles.groupBy("raster_id").agg(F.max(c("row0") + c("n_rows")).alias("lines"), F.max(c("col0") + c("n_cols")).alias("samples"))
    return tiles.join(size, "raster_id")


def deal(tiles: DataFrame) -> DataFrame:
    """Tiles spread by their key, once, as a bucketed table in the shared folder."""
    return keep(tiles.repartition(_buckets(tiles), *KEY))


def keep(tiles: DataFrame) -> DataFrame:
    """The result of a stencil as a bucketed table: its rows lie where they are, so nothing is shuffled.

    A scan of the table tells Spark how the tiles lie, which a plan with Python in it does not.
    """
    spark, name = tiles.sparkSession, f"selenic_tiles_{uuid.uuid4().hex}"
    tiles.write.format("parquet").bucketBy(_buckets(tiles), *KEY).option("path", workdir(spark, "tiles")).saveAsTable(name)
    return spark.table(name)


def _buckets(tiles: DataFrame) -> int:
    return int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------ pointwise and aggregates

def mask(tiles: DataFrame, missing: float | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """``data`` with the missing value, values of -32000 or less, and values outside (low, high) as nodata."""
    def fn(a: np.ndarray) -> np.ndarray:
        bad = a <= -32000
        if missing is not None:
            bad |= a == missing
        if low is not None:
            bad |= a <= low
        if high is not None:
            bad |= a >= high
        return np.where(bad, np.nan, a)
    return tiles.withColumn("data", pointwise(fn, c("data")))


def stretch(tiles: DataFrame, lo: float = .01, hi: float = .99, out: str = "dn") -> DataFrame:
    """Percentile stretch to 0..255, truncated."""
    s = percentiles(tiles, {"_lo": lo, "_hi": hi})

    def fn(a: np.ndarray, x: float | None, y: float | None) -> np.ndarray:
        return a if x is None else np.trunc(np.clip((a - x) / (y - x + 1e-9) * 255.0, 0.0, 255.0))
    return tiles.join(s, "raster_id", "left").withColumn(out, pointwise(fn, c("data"), c("_lo"), c("_hi"))).drop("_lo", "_hi")


def histogram(tiles: DataFrame, low: float, width: float, bins: int) -> DataFrame:
    """(raster_id, bin, n): valid cells by ``floor((z - low) / width)`` clipped to the bins."""
    def fn(data: pa.Array) -> pa.Array:
        out = []
        for a in arrays(data):
            a = a[np.isfinite(a)]
            out.append(np.bincount(np.clip(np.floor((a - low) / width), 0, bins - 1).astype(int), minlength=bins))
        return pa.array([x.tolist() for x in out], pa.list_(pa.int64()))
    fn.__annotations__ = {"data": pa.Array, "return": pa.Array}
    x = tiles.select("raster_id", F.posexplode(F.arrow_udf(fn, "array<long>")("data")).alias("bin", "n"))
    return x.groupBy("raster_id", "bin").agg(F.sum("n").alias("n")).where("n > 0")


PARTIAL = "array<struct<row: int, col: int, s: double, v: long, n: long>>"


def block_average(tiles: DataFrame, n: int) -> DataFrame:
    """Nodata-aware mean per block of an n x n grid (framed tiles); a tile gives one partial sum for each block it meets."""
    def fn(data: pa.Array, row0: pa.Array, col0: pa.Array, h: pa.Array, w: pa.Array, lines: pa.Array, samples: pa.Array) -> pa.Array:
        out = []
        for a, y, x, p, q, ln, sm in zip(arrays(data), *(v.to_pylist() for v in (row0, col0, h, w, lines, samples)), strict=True):
            a = a.reshape(p, q)
            ok = np.isfinite(a)
            r, k = np.arange(y, y + p) * n // ln, np.arange(x, x + q) * n // sm
            rs, ks = np.flatnonzero(np.diff(r, prepend=-1)), np.flatnonzero(np.diff(k, prepend=-1))
            add = lambda m, rs=rs, ks=ks: np.add.reduceat(np.add.reduceat(m, rs, axis=0), ks, axis=1)
            s, v, t = add(np.where(ok, a, 0.0)), add(ok.astype("int64")), add(np.ones(a.shape, "int64"))
            out.append([{"row": int(r[i]), "col": int(k[j]), "s": float(s[ii, jj]), "v": int(v[ii, jj]), "n": int(t[ii, jj])}
                        for ii, i in enumerate(rs) for jj, j in enumerate(ks)])
        kind = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("s", pa.float64()), ("v", pa.int64()), ("n", pa.int64())]))
        return pa.array(out, kind)
    fn.__annotations__ = dict.fromkeys(["data", "row0", "col0", "h", "w", "lines", "samples", "return"], pa.Array)
    parts = F.arrow_udf(fn, PARTIAL)("data", *SHAPE, "lines", "samples")
    x = tiles.select("raster_id", F.explode(parts).alias("_p")).select("raster_id", "_p.*")
    x = x.groupBy("raster_id", "row", "col").agg(F.sum("s").alias("s"), F.sum("v").alias("v"), F.sum("n").alias("n"))
    return x.select("raster_id", "row", "col", F.when(c("v") / c("n") < 1e-3, 0.0).otherwise(c("s") / c("v")).alias("z"))


def ordered(a: np.ndarray) -> np.ndarray:
    """Doubles as unsigned words in the same order (-0.0 as 0.0)."""
    b = (a + 0.0).view(np.uint64)
    return np.where(b >> np.uint64(63), ~b, b | np.uint64(1 << 63))


def unordered(k: np.ndarray) -> np.ndarray:
    """The doubles of ordered words."""
    return np.where(k >> np.uint64(63), k ^ np.uint64(1 << 63), ~k).view(np.float64)


COUNTS = "array<struct<prefix: long, digit: int, n: long>>"


def percentiles(tiles: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per raster by radix selection."""
    def valid(data: pa.Array) -> pa.Array:
        return pa.array([int(np.isfinite(a).sum()) for a in arrays(data)], pa.int64())
    valid.__annotations__ = {"data": pa.Array, "return": pa.Array}

    def digits(data: pa.Array, prefixes: pa.Array, shift: pa.Array) -> pa.Array:
        out = []
        for a, want, s in zip(arrays(data), prefixes.to_pylist(), shift.to_pylist(), strict=True):
            k = ordered(a[np.isfinite(a)])
            head = (k >> np.uint64(s) >> np.uint64(16)).astype(np.int64) if s < 48 else np.zeros(len(k), np.int64)
            found = []
            for p in want or ():
                d, n = np.unique((k[head == p] >> np.uint64(s)) & np.uint64(0xFFFF), return_counts=True)
                found += [{"prefix": p, "digit": int(x), "n": int(y)} for x, y in zip(d, n, strict=True)]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("prefix", pa.int64()), ("digit", pa.int32()), ("n", pa.int64())])))
    digits.__annotations__ = dict.fromkeys(["data", "prefixes", "shift", "return"], pa.Array)

    size = tiles.groupBy("raster_id").agg(F.sum(F.arrow_udf(valid, "long")("data")).alias("_n")).where("_n > 0")
    marks = []
    for name, p in probs.items():
        pos = (c("_n") - 1) * lit(float(p))
        marks += [F.struct(lit(name).alias("name"), lit(side).alias("side"), rank.alias("rank"), (pos - F.floor(pos)).alias("frac"))
                  for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos)))]
    # two rows a percentile and raster from here on
    at = materialise(size.select("raster_id", F.explode(F.array(*marks)).alias("_m")).select("raster_id", "_m.*", lit(0).cast("long").alias("prefix")), "ranks")
    for shift in (48, 32, 16, 0):
        want = at.groupBy("raster_id").agg(F.collect_set("prefix").alias("_w"))
        x = tiles.select("raster_id", "data").join(want, "raster_id")
        x = x.select("raster_id", F.explode(F.arrow_udf(digits, COUNTS)("data", "_w", lit(shift))).alias("_d")).select("raster_id", "_d.*")
        n = x.groupBy("raster_id", "prefix", "digit").agg(F.sum("n").alias("n"))
        to = F.sum("n").over(W.partitionBy("raster_id", "prefix").orderBy("digit"))
        n = n.withColumn("_to", to).withColumn("_from", c("_to") - c("n"))
        hit = at.join(n, ["raster_id", "prefix"]).where("rank >= _from and rank < _to")
        at = materialise(hit.select("raster_id", "name", "side", (c("rank") - c("_from")).alias("rank"), "frac",
                                    F.shiftleft("prefix", 16).bitwiseOR(c("digit").cast("long")).alias("prefix")), "ranks")

    def value(k: pa.Array) -> pa.Array:
        return pa.array(unordered(k.to_numpy().view(np.uint64)))
    value.__annotations__ = {"k": pa.Array, "return": pa.Array}
    at = at.withColumn("_v", F.arrow_udf(value, "double")("prefix"))

    def pick(name: str) -> Column:
        side = lambda s: F.max(F.when((c("name") == name) & (c("side") == s), c("_v")))
        return (side("lo") + (side("hi") - side("lo")) * F.max(F.when(c("name") == name, c("frac")))).alias(name)
    return at.groupBy("raster_id").agg(*[pick(n) for n in probs])


# ------------------------------------------------------------ stencils

def part_of_row(value: str, width: Column, first: Column, n: Column) -> Callable[[Column], Column]:
    return lambda y: F.slice(value, y * width + first + 1, n)


def strips(tiles: DataFrame, halo: int, value: str = "data") -> DataFrame:
    """(key of the receiving tile, strips): what the tiles around a tile hold within ``halo`` cells of it."""
    h, w = c("n_rows"), c("n_cols")
    sent = []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            if not i and not j:
                continue
            # the neighbour below gets the last rows, the one above the first
            r0, n = (F.greatest(lit(0), h - halo), F.least(lit(halo), h)) if i == 1 else (lit(0), F.least(lit(halo), h) if i else h)
            k0, m = (F.greatest(lit(0), w - halo), F.least(lit(halo), w)) if j == 1 else (lit(0), F.least(lit(halo), w) if j else w)
            cut = F.flatten(F.transform(F.sequence(r0, r0 + n - 1), part_of_row(value, w, k0, m)))
            there = {1: c("row0") + h < c("lines"), 0: lit(True), -1: c("row0") > 0}[i] & {1: c("col0") + w < c("samples"), 0: lit(True), -1: c("col0") > 0}[j]
            sent.append(F.when(there, F.struct((c("tile_r") + i).alias("tile_r"), (c("tile_c") + j).alias("tile_c"), (c("row0") + r0).alias("y"),
                                               (c("col0") + k0).alias("x"), n.alias("h"), m.alias("w"), cut.alias("v"))))
    x = tiles.select("raster_id", F.explode(F.array_compact(F.array(*sent))).alias("_s"))
    part = F.struct("_s.y", "_s.x", "_s.h", "_s.w", "_s.v")
    return x.groupBy("raster_id", c("_s.tile_r").alias("tile_r"), c("_s.tile_c").alias("tile_c")).agg(F.collect_list(part).alias("_strips"))


def stencil(tiles: DataFrame, halo: int, fn: Callable[[np.ndarray], list[np.ndarray]], outputs: list[str], border: str = "symmetric",
            value: str = "data") -> DataFrame:
    """Framed tiles with ``fn(block) -> arrays`` as new columns.

    ``fn`` gets a tile with ``halo`` more cells on every side, NaN for nodata, and returns an array per output for
    the tile itself. Beyond the raster the halo is a reflection, nodata with ``border="nan"``, or infinite with
    ``border="beyond"``.
    """
    def blocks(data: pa.Array, strips: pa.Array, row0: pa.Array, col0: pa.Array, h: pa.Array, w: pa.Array, lines: pa.Array, samples: pa.Array):
        ends, s = strips.offsets.to_numpy(), strips.values
        place = {k: s.field(k).to_numpy(zero_copy_only=False) for k in ("y", "x", "h", "w")}
        edge = list(arrays(s.field("v")))
        for i, (a, y, x, p, q, ln, sm) in enumerate(zip(arrays(data), *(v.to_pylist() for v in (row0, col0, h, w, lines, samples)), strict=True)):
            top, left, low, right = min(halo, y), min(halo, x), min(halo, ln - y - p), min(halo, sm - x - q)
            block = np.full((top + p + low, left + q + right), np.nan)
            block[top:top + p, left:left + q] = a.reshape(p, q)
            for k in range(ends[i], ends[i + 1]):
                r, m = int(place["y"][k]) - y + top, int(place["x"][k]) - x + left
                part = edge[k].reshape(int(place["h"][k]), int(place["w"][k]))
                # a strip may be longer than the halo reaches
                r0, m0 = max(0, -r), max(0, -m)
                part = part[r0:, m0:][:block.shape[0] - r - r0, :block.shape[1] - m - m0]
                block[r + r0:r + r0 + part.shape[0], m + m0:m + m0 + part.shape[1]] = part
            pad = ((halo - top, halo - low), (halo - left, halo - right))
            yield np.pad(block, pad, constant_values=OUTSIDE[border]) if border in OUTSIDE else np.pad(block, pad, mode=border)

    def run(data: pa.Array, strips: pa.Array, row0: pa.Array, col0: pa.Array, h: pa.Array, w: pa.Array, lines: pa.Array, samples: pa.Array) -> pa.Array:
        made = [fn(b) for b in blocks(data, strips, row0, col0, h, w, lines, samples)]
        return pa.StructArray.from_arrays([packed([m[k] for m in made]) for k in range(len(outputs))], outputs)
    run.__annotations__ = dict.fromkeys(["data", "strips", "row0", "col0", "h", "w", "lines", "samples", "return"], pa.Array)
    kind = "struct<" + ", ".join(f"{o}: array<double>" for o in outputs) + ">"
    near = strips(tiles, halo, value)
    x = tiles.join(near.hint("shuffle_hash"), KEY, "left").withColumn("_strips", F.coalesce("_strips", F.array().cast(near.schema["_strips"].dataType)))
    x = x.withColumn("_out", F.arrow_udf(run, kind)(value, "_strips", *SHAPE, "lines", "samples")).drop("_strips")
    return x.withColumns({o: c(f"_out.{o}") for o in outputs}).drop("_out")


def gradient(tiles: DataFrame, cell_m: float = 1.0, value: str = "data") -> DataFrame:
    """``gx`` and ``gy``: central differences, one-sided at the raster's edges, nodata beside nodata."""
    def fn(a: np.ndarray) -> list[np.ndarray]:
        z = a[1:-1, 1:-1]

        def diff(prev: np.ndarray, nxt: np.ndarray) -> np.ndarray:
            # infinity marks what lies beyond the raster
            first, last = np.isinf(prev), np.isinf(nxt)
            with np.errstate(invalid="ignore"):
                both = (nxt - prev) / 2.0
                return np.where(first & last, np.nan, np.where(first, nxt - z, np.where(last, z - prev, both))) / cell_m
        return [diff(a[1:-1, :-2], a[1:-1, 2:]), diff(a[:-2, 1:-1], a[2:, 1:-1])]
    return stencil(tiles, 1, fn, ["gx", "gy"], border="beyond", value=value)


def gaussian_smooth(tiles: DataFrame, sigma: float, value: str = "data", out: str = "smooth") -> DataFrame:
    """Gaussian mean over the valid cells (radius 4 sigma, mirrored border)."""
    w, k = np.array(gaussian_weights(sigma)), gaussian_radius(sigma)

    def separable(a: np.ndarray) -> np.ndarray:
        a = sum(w[i] * a[:, i:a.shape[1] - 2 * k + i] for i in range(2 * k + 1))
        return sum(w[i] * a[i:a.shape[0] - 2 * k + i, :] for i in range(2 * k + 1))

    def fn(a: np.ndarray) -> list[np.ndarray]:
        ok = np.isfinite(a)
        den = separable(ok.astype(float))
        return [separable(np.where(ok, a, 0.0)) / np.where(den > 1e-12, den, np.nan)]
    return stencil(tiles, k, fn, [out], value=value)
