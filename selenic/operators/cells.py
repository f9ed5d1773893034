"""Raster algebra on cell tables ``(raster_id, row, col, z)``; nodata is NULL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from selenic.functions import geo, predicates
from selenic.operators.stats import exact_percentiles, with_group
from selenic.session import materialise

c, lit = F.col, F.lit
ID = ["raster_id"]
TILE_KEY = ["raster_id", "tile_r", "tile_c"]
SUM_TILE = 64  # side of the tiles of summed areas
SEARCH_SIDE = 256  # side of what is searched for a valid window as arrays

# fixed values of the grid products
GRID_N = 192
PLATEAU_M = 0.25
SWEEP = (1.0, 0.8, 1.25, 0.63, 1.58, 0.5, 2.0, 0.4, 2.5)


def _along_row():
    return W.partitionBy("raster_id", "row").orderBy("col")


def _along_col():
    return W.partitionBy("raster_id", "col").orderBy("row")


# ------------------------------------------------------------ windows

def window_cells(cells: DataFrame, windows: DataFrame, tile: int = 256) -> DataFrame:
    """Cells inside half-open windows ``(window_id, raster_id, r0, c0, r1, c1)``.

    Windows are exploded to the tiles they touch, so the join is on (raster, tile)
    and a large raster is spread over many keys.
    """
    def span(a, b):
        return F.sequence(F.floor(c(a) / tile).cast("int"), F.floor((c(b) - 1) / tile).cast("int"))

    w = windows.where("r1 > r0 and c1 > c0").withColumn("_tr", F.explode(span("r0", "r1"))).withColumn("_tc", F.explode(span("c0", "c1")))
    x = cells.withColumn("_tr", F.floor(c("row") / tile).cast("int")).withColumn("_tc", F.floor(c("col") / tile).cast("int"))
    hit = x.join(w, ["raster_id", "_tr", "_tc"])
    return hit.where(predicates.in_window(c("row"), c("col"), c("r0"), c("c0"), c("r1"), c("c1"))).drop("_tr", "_tc")


def valid_fraction(cells: DataFrame, windows: DataFrame, pred: Column, tile: int = 256) -> DataFrame:
    inside = window_cells(cells, windows, tile)
    return inside.groupBy("window_id").agg(F.avg(F.coalesce(pred, lit(False)).cast("int")).alias("valid_fraction"))


def _tiles_of(windows: DataFrame) -> DataFrame:
    """Tiles that windows ``(raster_id, r0, c0, r1, c1)`` and the corners before them touch, once each."""
    def span(a, b):
        return F.sequence(F.floor(F.greatest(c(a) - 1, lit(0)) / SUM_TILE).cast("int"), F.floor((c(b) - 1) / SUM_TILE).cast("int"))
    w = windows.where("r1 > greatest(r0, 0) and c1 > greatest(c0, 0)").select("raster_id", "r0", "c0", "r1", "c1").distinct()
    w = w.select("raster_id", F.explode(span("r0", "r1")).alias("tile_r"), "c0", "c1")
    return w.select("raster_id", "tile_r", F.explode(span("c0", "c1")).alias("tile_c")).distinct()


def _inner_sums(at: pd.Series) -> pd.Series:
    """Running counts along both axes of a tile from the places of its valid cells."""
    def sums(x):
        grid = np.bincount(x, minlength=SUM_TILE * SUM_TILE).reshape(SUM_TILE, SUM_TILE)
        return grid.cumsum(0).cumsum(1).astype("int32").ravel()
    return at.map(sums)


def summed_area(cells: DataFrame, pred: Column, near: DataFrame) -> DataFrame:
    """Two levels of running counts of valid cells, for windows within the windows ``near``.

    ``inner`` counts within a tile, ``left``, ``above`` and ``corner`` the tiles before it, see
    ``_outer_sums``. Only cells of the tiles that ``near`` touches are shuffled: a difference of
    sums needs no others. Absent cells are not valid. The result is a table, since it is
    looked into more than once.
    """
    need = _tiles_of(near)
    x = cells.withColumns({"tile_r": F.floor(c("row") / SUM_TILE).cast("int"), "tile_c": F.floor(c("col") / SUM_TILE).cast("int")})
    x = x.where(F.coalesce(pred, lit(False))).join(need, TILE_KEY, "left_semi")
    spot = (c("row") - c("tile_r") * SUM_TILE) * SUM_TILE + (c("col") - c("tile_c") * SUM_TILE)
    x = x.groupBy(*TILE_KEY).agg(F.collect_list(spot.cast("int")).alias("_at"))
    x = x.select(*TILE_KEY, F.pandas_udf(_inner_sums, "array<int>")("_at").alias("inner"))
    # a frame without gaps, so that every sum over lines of tiles finds all of them
    frame = need.groupBy("raster_id").agg(F.collect_set("tile_r").alias("_r"), F.collect_set("tile_c").alias("_c"))
    frame = frame.select("raster_id", F.explode("_r").alias("tile_r"), "_c").select("raster_id", "tile_r", F.explode("_c").alias("tile_c"))
    tiles = materialise(frame.join(x, TILE_KEY, "left"), "tile-sums")
    # counts compress well, so the size of the table's files does not tell what a broadcast would hold
    return materialise(tiles.join(_outer_sums(tiles).hint("shuffle_hash"), TILE_KEY), "summed-areas")


def _outer_sums(tiles: DataFrame) -> DataFrame:
    """``left``, ``above`` and ``corner`` for each tile: the second level.

    ``left[k]`` counts rows 0 to k of the tiles to the left, ``above[k]`` columns 0 to k of
    the tiles above, ``corner`` all tiles above and to the left. Windows hold one line of
    tiles each, and rows are the tiles' edges only.
    """
    to = (W.unboundedPreceding, -1)
    edge = tiles.withColumn("_k", F.explode(F.sequence(lit(0), lit(SUM_TILE - 1))))
    at = lambda i: F.coalesce(F.get("inner", i), lit(0)).cast("long")
    edge = edge.select(*TILE_KEY, "_k", at(c("_k") * SUM_TILE + SUM_TILE - 1).alias("_right"), at(lit(SUM_TILE * (SUM_TILE - 1)) + c("_k")).alias("_bottom"))
    zero = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(*to)), lit(0))
    edge = edge.withColumn("_left", zero("_right", W.partitionBy("raster_id", "tile_r", "_k").orderBy("tile_c")))
    down = W.partitionBy("raster_id", "tile_c", "_k").orderBy("tile_r")
    edge = edge.withColumns({"_above": zero("_bottom", down), "_corner": zero("_left", down)})
    line = F.array_sort(F.collect_list(F.struct("_k", "_left", "_above")))
    sums = edge.groupBy(*TILE_KEY).agg(line.alias("_line"), F.max(F.when(c("_k") == SUM_TILE - 1, c("_corner"))).alias("corner"))
    return sums.select(*TILE_KEY, c("_line._left").alias("left"), c("_line._above").alias("above"), "corner")


def window_valid(sat: DataFrame, windows: DataFrame) -> DataFrame:
    """Valid share of every window from its corners' sums; a window without an area has none.

    A window is one row for each tile that holds some of its corners, mostly one. Windows are often
    made from few rows by a generator, which Spark's size check does not see, hence the hint: the
    tiles are what a task holds, never the windows. ``window_id`` is unique.
    """
    def tiles(lo, hi):
        first, last = [F.floor((e - 1) / SUM_TILE).cast("int") for e in (lo, hi)]
        return F.when((first >= 0) & (first < last), F.array(first, last)).when(last >= 0, F.array(last))

    some = (c("r1") > c("r0")) & (c("c1") > c("c0")) & (c("c1") > 0)
    own = windows.columns
    # a window without a tile keeps a row and counts nothing
    probe = windows.withColumn("_tr", F.explode_outer(F.when(some, tiles(c("r0"), c("r1"))))).withColumn("_tc", F.explode_outer(tiles(c("c0"), c("c1"))))
    near = probe.join(sat.select(c("raster_id").alias("_of"), "tile_r", "tile_c", "inner", "left", "above", "corner").hint("shuffle_hash"),
                      (c("raster_id") == c("_of")) & (c("_tr") == c("tile_r")) & (c("_tc") == c("tile_c")), "left")

    def part(row, col):
        i, j = row - 1 - c("_tr") * SUM_TILE, col - 1 - c("_tc") * SUM_TILE
        count = F.coalesce(F.get("inner", i * SUM_TILE + j), lit(0)) + F.get("left", i) + F.get("above", j) + c("corner")
        return F.when(i.between(0, SUM_TILE - 1) & j.between(0, SUM_TILE - 1), count).otherwise(0)
    n = part(c("r1"), c("c1")) - part(c("r0"), c("c1")) - part(c("r1"), c("c0")) + part(c("r0"), c("c0"))
    count = near.select(*own, n.alias("_n")).groupBy(*own).agg(F.sum("_n").alias("_n"))
    return count.select(*own, F.try_divide(F.coalesce("_n", lit(0)), (c("r1") - c("r0")) * (c("c1") - c("c0"))).alias("valid_fraction"))


def dealt(requests: DataFrame) -> DataFrame:
    """Requests spread over the tasks before they are multiplied: their table is small, often one file."""
    return requests.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request_id")


def search_reach(requests: DataFrame, steps: int = 12, step_m: float = 500.0) -> DataFrame:
    """Windows around all that ``nearest_valid_window`` may try."""
    m = F.ceil(lit(step_m * steps) / c("gsd_m")).cast("int") + 1
    return requests.select("raster_id", *[F.greatest(lit(0), c(e) - m).alias(e) for e in ("r0", "c0")],
                           (c("r1") + m).alias("r1"), (c("c1") + m).alias("c1"))


def by_tiles(cells: DataFrame, windows: DataFrame, tile: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(windows, cells) for a cogroup by ``(raster_id, _tr, _tc, _g)``.

    The windows that start in a tile are cut into groups of about ``most``; a group meets the cells of four
    tiles, which hold all of its windows where these have no side over ``tile``.
    """
    own = windows.withColumns({"_tr": F.floor(c("r0") / tile).cast("int"), "_tc": F.floor(c("c0") / tile).cast("int")})
    place = ["raster_id", "_tr", "_tc"]
    size = own.groupBy(*place).agg(F.ceil(F.count("*") / most).cast("int").alias("_k"))
    own = own.join(size.hint("shuffle_hash"), place).withColumn("_g", F.pmod(F.xxhash64("window_id"), c("_k")).cast("int")).drop("_k")
    x = cells.withColumn("_i", F.explode(F.array(lit(0), lit(1)))).withColumn("_j", F.explode(F.array(lit(0), lit(1))))
    x = x.withColumns({"_tr": F.floor(c("row") / tile).cast("int") - c("_i"), "_tc": F.floor(c("col") / tile).cast("int") - c("_j")})
    rest = [v for v in cells.columns if v != "raster_id"]
    x = x.join(size, place).withColumn("_g", F.explode(F.sequence(lit(0), c("_k") - 1))).select(*place, "_g", *rest)
    # fresh column identities: both sides hold the sizes; many tasks, since little is read and much is made of it
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, x = (d.select(*[c(v).alias(v) for v in d.columns]).repartition(parts, *place, "_g") for d in (own, x))
    return own, x


def nearest_valid_window(sat: DataFrame, requests: DataFrame, steps: int = 12, step_m: float = 500.0, valid: DataFrame | None = None) -> DataFrame:
    """The requested window, or the nearest one of its size with 90 % valid cells.

    ``requests(request_id, raster_id, r0, c0, r1, c1, gsd_m, lines, samples)``. Offsets
    go in steps of 500 m in both axes and all four directions, nearest first, and are
    only tried where the requested window is less than half valid. ``sat`` must cover
    ``search_reach(requests)``. With ``valid(raster_id, row, col)``, the cells behind ``sat``, what lies
    within ``SEARCH_SIDE`` with its reach is searched as arrays, and no try is a row.
    """
    base = materialise(window_valid(sat, requests.withColumn("window_id", c("request_id"))), "windows-asked")
    good = base.where("valid_fraction >= 0.5").select(
        "request_id", "r0", "c0", "r1", "c1", lit(0.0).alias("offset_km"), lit("exact").alias("status"))
    poor = base.where("valid_fraction < 0.5").drop("valid_fraction")
    if valid is None:
        return good.unionByName(_moved(sat, poor, steps, step_m))
    reach = F.ceil(lit(step_m * steps) / c("gsd_m")) + 1
    bounded = F.coalesce((c("gsd_m") > 0) & (F.greatest(c("r1") - c("r0"), c("c1") - c("c0")) + reach * 2 <= SEARCH_SIDE), lit(False))
    out = good.unionByName(_moved_in_arrays(valid, poor.where(bounded), steps, step_m))
    wide = poor.where(~bounded)
    return out if wide.isEmpty() else out.unionByName(_moved(sat, wide, steps, step_m))


def _moved(sat: DataFrame, poor: DataFrame, steps: int, step_m: float) -> DataFrame:
    """The windows that ``nearest_valid_window`` moves, each place that is tried a row."""
    def px(i):
        return F.rint(lit(step_m) * i / c("gsd_m")).cast("int")
    # of the steps to one place only the first can be chosen
    step = F.filter(F.sequence(lit(1), lit(steps)), lambda i: (i == 1) | (px(i) != px(i - 1)))
    grid = F.flatten(F.transform(step, lambda i: F.flatten(F.transform(
        step, lambda j: F.array(*[
            F.struct((px(i) * a).alias("dr"), (px(j) * b).alias("dc"), ((i * 100 + j) * 4 + k).alias("ord"))
            for k, (a, b) in enumerate(((1, 1), (-1, 1), (1, -1), (-1, -1)))])))))
    grid = F.filter(grid, lambda o: ((o["ord"] % 2 == 0) | (o["dr"] != 0)) & ((o["ord"] % 4 < 2) | (o["dc"] != 0)))
    tries = dealt(poor).withColumn("_o", F.explode(grid)).select(
        "request_id", "raster_id", "gsd_m", "lines", "samples", "_o.*",
        *[(c(e) + c(f"_o.{d}")).alias(e) for e, d in (("r0", "dr"), ("c0", "dc"), ("r1", "dr"), ("c1", "dc"))])
    tries = tries.where("r0 >= 0 and c0 >= 0 and r1 <= lines and c1 <= samples")
    tries = tries.withColumn("window_id", F.struct("request_id", "ord"))
    ok = window_valid(sat, tries).where("valid_fraction >= 0.9")
    first = ok.groupBy("request_id").agg(F.min_by(
        F.struct("r0", "c0", "r1", "c1", (F.hypot(c("dr") * c("gsd_m"), c("dc") * c("gsd_m")) / 1000.0).alias("offset_km")),
        F.struct((c("dr") * c("dr") + c("dc") * c("dc")).alias("d2"), c("ord"))).alias("_b"))
    return poor.select("request_id").join(first, "request_id", "left").select(
        "request_id", "_b.r0", "_b.c0", "_b.r1", "_b.c1", "_b.offset_km",
        F.when(c("_b").isNull(), "no_valid_data").otherwise("moved").alias("status"))


def _offsets(gsd: float, steps: int, step_m: float) -> list[tuple[int, int]]:
    """(rows, columns) of the places that are tried, nearest first."""
    px = [int(np.rint(step_m * i / gsd)) for i in range(1, steps + 1)]
    order: dict[tuple[int, int], tuple[int, int]] = {}
    for i, p in enumerate(px):
        for j, q in enumerate(px):
            for k, (a, b) in enumerate(((1, 1), (-1, 1), (1, -1), (-1, -1))):
                order.setdefault((p * a, q * b), (p * p + q * q, (i * 100 + j) * 4 + k))
    return sorted(order, key=order.get)


def _moved_in_arrays(valid: DataFrame, poor: DataFrame, steps: int, step_m: float) -> DataFrame:
    """What ``_moved`` gives, for windows that lie within ``SEARCH_SIDE`` with their reach: groups of them meet the valid cells around."""
    reach = (F.ceil(lit(step_m * steps) / c("gsd_m")) + 1).cast("int")
    sides = ["r0", "c0", "r1", "c1"]
    near = poor.select(c("request_id").alias("window_id"), "raster_id", "gsd_m", "lines", "samples", *[c(e).alias(f"_{e}") for e in sides],
                       *[F.greatest(lit(0), c(e) - reach).alias(e) for e in ("r0", "c0")])
    own, x = by_tiles(valid.select("raster_id", "row", "col"), near, SEARCH_SIDE, 4096)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        keep = ["window_id", "gsd_m", *[f"_{e}" for e in sides]]
        if a.empty:
            return pd.DataFrame({k: [] for k in (*keep, "dr", "dc")})
        top, side = int(a["_tr"].iat[0]) * SEARCH_SIDE, int(a["_tc"].iat[0]) * SEARCH_SIDE
        count = np.zeros((2 * SEARCH_SIDE + 1,) * 2, dtype="int64")
        np.add.at(count, (b["row"].to_numpy() - top + 1, b["col"].to_numpy() - side + 1), 1)
        count = count.cumsum(0).cumsum(1)
        r0, c0, r1, c1 = (a[f"_{e}"].to_numpy().astype("int64") for e in sides)
        lines, samples, gsd = a["lines"].to_numpy(), a["samples"].to_numpy(), a["gsd_m"].to_numpy()
        dr, dc, found = np.zeros(len(a), "int32"), np.zeros(len(a), "int32"), np.zeros(len(a), bool)
        for g in np.unique(gsd):
            left = np.flatnonzero(gsd == g)
            for i, j in _offsets(float(g), steps, step_m):
                p0, q0, p1, q1 = r0[left] + i, c0[left] + j, r1[left] + i, c1[left] + j
                at = np.flatnonzero((p0 >= 0) & (q0 >= 0) & (p1 <= lines[left]) & (q1 <= samples[left]))
                p0, q0, p1, q1 = p0[at] - top, q0[at] - side, p1[at] - top, q1[at] - side
                n = count[p1, q1] - count[p0, q1] - count[p1, q0] + count[p0, q0]
                hit = at[n / ((p1 - p0) * (q1 - q0)) >= 0.9]
                if len(hit):
                    dr[left[hit]], dc[left[hit]], found[left[hit]] = i, j, True
                    left = np.delete(left, hit)
                    if not len(left):
                        break
        return a[keep].assign(dr=pd.array(np.where(found, dr, 0), "Int32"), dc=pd.array(np.where(found, dc, 0), "Int32")).assign(
            dr=lambda t: t["dr"].mask(~found), dc=lambda t: t["dc"].mask(~found))

    kinds = dict(near.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in ("window_id", "gsd_m", *[f"_{e}" for e in sides])) + ", dr int, dc int"
    group = ["raster_id", "_tr", "_tc", "_g"]
    got = own.groupBy(*group).cogroup(x.groupBy(*group)).applyInPandas(run, schema)
    return got.select(c("window_id").alias("request_id"), *[(c(f"_{e}") + c(d)).alias(e) for e, d in zip(sides, ("dr", "dc", "dr", "dc"), strict=True)],
                      (F.hypot(c("dr") * c("gsd_m"), c("dc") * c("gsd_m")) / 1000.0).alias("offset_km"),
                      F.when(c("dr").isNull(), "no_valid_data").otherwise("moved").alias("status"))


def densest_window(sat: DataFrame, requests: DataFrame, side: int = 6) -> DataFrame:
    """Centre of the fullest window on a 6 x 6 grid of the valid box, where the matched
    place is less than 60 % valid.

    ``requests(request_id, raster_id, cx, cy, half, x0, x1, y0, y1, lines, samples)``.
    """
    def boxed(df):
        return df.withColumns({
            "r0": F.greatest(lit(0), c("cy") - c("half")), "c0": F.greatest(lit(0), c("cx") - c("half")),
            "r1": F.least(c("lines"), c("cy") + c("half")), "c1": F.least(c("samples"), c("cx") + c("half"))})

    base = materialise(window_valid(sat, boxed(requests).withColumn("window_id", c("request_id"))), "windows-asked")
    keep = base.where("valid_fraction >= 0.6").select("request_id", "cx", "cy", "valid_fraction")
    steps = [0.1 + 0.8 * i / (side - 1) for i in range(side)]
    grid = F.array(*[F.struct(
        (c("x0") + (c("x1") - c("x0")) * fx).cast("int").alias("cx"), (c("y0") + (c("y1") - c("y0")) * fy).cast("int").alias("cy"),
        lit(i * side + j).alias("ord")) for i, fy in enumerate(steps) for j, fx in enumerate(steps)])
    # requests of one frame try the same places, so these are judged once
    frame = ["raster_id", "half", "x0", "x1", "y0", "y1", "lines", "samples"]
    poor = base.where("valid_fraction < 0.6").select("request_id", *frame)
    tries = poor.select(*frame).distinct().withColumn("_g", F.explode(grid)).select(*frame, "_g.*")
    tries = boxed(tries).withColumn("window_id", F.struct(*frame, "ord"))
    best = window_valid(sat, tries).groupBy(*frame).agg(
        F.min_by(F.struct("cx", "cy", "valid_fraction"), F.struct((-c("valid_fraction")).alias("v"), c("ord"))).alias("_b"))
    # the requests of a frame stay where they are; neither side is broadcast, since compressed files hide their size
    best = poor.join(best.hint("shuffle_hash"), frame)
    return keep.unionByName(best.select("request_id", "_b.*"))


def best_variance_window(cells: DataFrame, crop: int, n: int = 5, stride: int = 4) -> DataFrame:
    """Origin of the crop with the largest strided deviation; the first one wins ties.

    All candidate windows are conditional aggregates of one pass over the cells, which
    must carry ``lines`` and ``samples``.
    """
    across = max(1, n // 2)

    def start(size, i, m):
        room = F.greatest(lit(0), size - crop)
        return (room * i / (m - 1)).cast("int") if m > 1 else lit(0)

    spots = [(start(c("lines"), i, n), start(c("samples"), j, across)) for i in range(n) for j in range(across)]
    aggs, origins = [], []
    for k, (r0, c0) in enumerate(spots):
        inside = (predicates.in_window(c("row"), c("col"), r0, c0, r0 + crop, c0 + crop)
                  & ((c("row") - r0) % stride == 0) & ((c("col") - c0) % stride == 0))
        aggs.append(F.stddev_pop(F.when(inside, c("z"))).alias(f"_s{k}"))
        origins.append(F.struct(c(f"_s{k}").alias("sd"), lit(-k).alias("ord"), r0.alias("r0"), c0.alias("c0")))
    stats = cells.groupBy("raster_id", "lines", "samples").agg(*aggs)
    best = F.array_max(F.filter(F.array(*origins), lambda s: s["sd"].isNotNull()))
    whole = (c("lines") <= crop) & (c("samples") <= crop)
    return stats.select("raster_id", F.when(whole, 0).otherwise(best["r0"]).alias("r0"),
                        F.when(whole, 0).otherwise(best["c0"]).alias("c0"), best["sd"].alias("sd"))


def valid_bbox(cells: DataFrame, pred: Column) -> DataFrame:
    """Half-open box (x0, x1, y0, y1) of rows and columns more than a quarter valid; the
    whole frame when nearly all is valid or fewer than eight rows or columns remain."""
    x = cells.select("raster_id", "row", "col", F.coalesce(pred, lit(False)).cast("int").alias("_v"))
    frame = x.groupBy("raster_id").agg((F.max("row") + 1).alias("lines"), (F.max("col") + 1).alias("samples"), F.avg("_v").alias("share"))

    def side(axis, other, lo, hi):
        per = x.groupBy("raster_id", axis).agg(F.sum("_v").alias("_n")).join(frame, "raster_id").where(c("_n") > c(other) * 0.25)
        return per.groupBy("raster_id").agg(F.min(axis).alias(lo), (F.max(axis) + 1).alias(hi), F.count("*").alias(f"_{axis}s"))

    out = frame.join(side("row", "samples", "y0", "y1"), "raster_id", "left").join(side("col", "lines", "x0", "x1"), "raster_id", "left")
    whole = ((c("share") >= 0.97) | (F.coalesce("_rows", lit(0)) < 8) | (F.coalesce("_cols", lit(0)) < 8))
    pick = {"x0": lit(0), "x1": c("samples"), "y0": lit(0), "y1": c("lines")}
    return out.select("raster_id", *[F.when(whole, d).otherwise(c(k)).cast("int").alias(k) for k, d in pick.items()])


def content_square(cells: DataFrame, pred: Column) -> DataFrame:
    """Square around the content, 1.6 times its extent plus eight; the whole frame when it
    is more than half content or holds fewer than 400 content cells."""
    v = F.coalesce(pred, lit(False))
    b = cells.groupBy("raster_id").agg(
        (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.avg(v.cast("int")).alias("share"), F.count_if(v).alias("n"),
        F.min(F.when(v, c("row"))).alias("r0"), (F.max(F.when(v, c("row"))) + 1).alias("r1"),
        F.min(F.when(v, c("col"))).alias("c0"), (F.max(F.when(v, c("col"))) + 1).alias("c1"))
    b = b.withColumn("side", (F.greatest(c("r1") - c("r0"), c("c1") - c("c0")) * 1.6).cast("int") + 8)
    half = F.floor(c("side") / 2)

    def lo(a, z, size):
        return F.greatest(lit(0), F.least(F.floor((c(a) + c(z)) / 2) - half, c(size) - c("side")))
    b = b.withColumn("sr0", lo("r0", "r1", "h")).withColumn("sc0", lo("c0", "c1", "w"))
    b = b.withColumn("sr1", F.least(c("h"), c("sr0") + c("side"))).withColumn("sc1", F.least(c("w"), c("sc0") + c("side")))
    whole = (c("share") > 0.5) | (c("n") < 400)
    pick = {"r0": ("sr0", lit(0)), "c0": ("sc0", lit(0)), "r1": ("sr1", c("h")), "c1": ("sc1", c("w"))}
    return b.select("raster_id", *[F.when(whole, d).otherwise(c(s)).cast("int").alias(k) for k, (s, d) in pick.items()])


# ------------------------------------------------------------ aggregates

def robust_stats(cells: DataFrame, keys: list[str] = ID) -> DataFrame:
    """Percentiles 1/2/98/99, median, extremes and population deviation."""
    pct = exact_percentiles(cells, keys, "z", {"p01": .01, "p02": .02, "median": .5, "p98": .98, "p99": .99})
    base = cells.groupBy(*keys).agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.stddev_pop("z").alias("sd"))
    return base.join(pct, keys)


def mutual_information(pairs: DataFrame, bins: int = 64, keys: list[str] = ID) -> DataFrame:
    """I(A;B) in nats from a joint histogram of ``a`` and ``b``.

    Only the joint counts, at most bins x bins rows per raster, reach the windows.
    """
    x = pairs.where("a is not null and b is not null").select(*keys, "a", "b")
    x = with_group(x, keys, _a0=F.min("a"), _a1=F.max("a"), _b0=F.min("b"), _b1=F.max("b"))

    def slot(v, lo, hi):
        return ((c(v) - c(lo)) / (c(hi) - c(lo) + 1e-9) * (bins - 1)).cast("int")
    joint = x.groupBy(*keys, slot("a", "_a0", "_a1").alias("_i"), slot("b", "_b0", "_b1").alias("_j")).agg(F.count("*").alias("_n"))
    joint = joint.withColumns({
        "_t": F.sum("_n").over(W.partitionBy(*keys)), "_ni": F.sum("_n").over(W.partitionBy(*keys, "_i")),
        "_nj": F.sum("_n").over(W.partitionBy(*keys, "_j"))})
    term = c("_n") / c("_t") * F.log(c("_n").cast("double") * c("_t") / (c("_ni").cast("double") * c("_nj")))
    return joint.groupBy(*keys).agg(F.sum(term).alias("mi"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson r as an aggregate; 0 for a flat input."""
    flat = (F.stddev_pop(a) <= 1e-6) | (F.stddev_pop(b) <= 1e-6)
    return F.when(flat, 0.0).otherwise(F.corr(a, b))


def grid_correlation(pairs: DataFrame, keys: list[str] = ID, min_cells: int = 0) -> DataFrame:
    """r, mean and largest difference of two grids rebased to 0 and scaled to their maxima."""
    x = pairs.where("a is not null and b is not null")
    x = with_group(x, keys, _a0=F.min("a"), _a1=F.max("a"), _b0=F.min("b"), _b1=F.max("b"))
    a = (c("a") - c("_a0")) / F.nullif(c("_a1") - c("_a0"), lit(0.0))
    b = (c("b") - c("_b0")) / F.nullif(c("_b1") - c("_b0"), lit(0.0))
    out = x.select(*keys, a.alias("a"), b.alias("b")).groupBy(*keys).agg(
        correlation(c("a"), c("b")).alias("r"), F.avg(F.abs(c("a") - c("b"))).alias("mae"),
        F.max(F.abs(c("a") - c("b"))).alias("max_dev"), F.count("*").alias("n"))
    return out.withColumn("r", F.when(c("n") > min_cells, c("r")))


def block_average(cells: DataFrame, n: int = GRID_N, rebase: bool = True) -> DataFrame:
    """Nodata-aware mean per block of an n x n grid, 0 where almost nothing is valid.

    Cells carry ``lines`` and ``samples``. All columns are covered, remainders included.
    """
    r = F.floor(c("row").cast("long") * n / c("lines")).cast("int")
    q = F.floor(c("col").cast("long") * n / c("samples")).cast("int")
    g = cells.groupBy("raster_id", r.alias("row"), q.alias("col")).agg(
        F.sum("z").alias("_s"), F.count("z").alias("_v"), F.count("*").alias("_n"))
    g = g.select("raster_id", "row", "col", F.when(c("_v") / c("_n") < 1e-3, 0.0).otherwise(c("_s") / c("_v")).alias("z"))
    return rebased(g) if rebase else g


def rebased(grid: DataFrame) -> DataFrame:
    return with_group(grid, ID, _lo=F.min("z")).withColumn("z", c("z") - c("_lo")).drop("_lo")


def normalise(cells: DataFrame, keys: list[str] = ID) -> DataFrame:
    """Min-max scaling to [0, 1] per raster."""
    x = with_group(cells, keys, _lo=F.min("z"), _hi=F.max("z"))
    return x.withColumn("z", (c("z") - c("_lo")) / (c("_hi") - c("_lo") + 1e-9)).drop("_lo", "_hi")


def class_histogram(cells: DataFrame) -> DataFrame:
    """Cells per class, the set of classes and the majority class (lowest id on ties)."""
    n = cells.groupBy("raster_id", "class_id").agg(F.count("*").alias("n"))
    return n.groupBy("raster_id").agg(
        F.array_sort(F.collect_set("class_id")).alias("classes"),
        F.max_by("class_id", F.struct("n", (-c("class_id")).alias("k"))).alias("majority"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_id", "n")))).alias("counts"))


def clamp_plateau(grid: DataFrame) -> DataFrame:
    """Cells of a clamped plateau, grown by three cells, with the share of the grid.

    A raster is flagged when more than 1 % of it lies within 0.25 m of its maximum.
    Only plateau cells are exploded to their 7 x 7 surroundings.
    """
    x = with_group(grid.where("z is not null"), ID, _hi=F.max("z"), _n=F.count("*"))
    top = x.where(c("z") >= c("_hi") - PLATEAU_M)
    flagged = top.groupBy("raster_id", "_n").agg(F.count("*").alias("_k")).where(c("_k") > c("_n") * 0.01)
    near = F.array(*[F.struct((c("row") + i).alias("row"), (c("col") + j).alias("col")) for i in range(-3, 4) for j in range(-3, 4)])
    grown = (top.select("raster_id", "row", "col").join(flagged, "raster_id", "left_semi")
             .select("raster_id", F.explode(near).alias("_o")).select("raster_id", "_o.row", "_o.col").distinct())
    grown = grown.join(grid.select("raster_id", "row", "col"), ["raster_id", "row", "col"], "left_semi")
    share = grown.groupBy("raster_id").agg(F.count("*").alias("_k")).join(flagged.select("raster_id", "_n"), "raster_id")
    return grown.join(share.select("raster_id", (c("_k") / c("_n")).alias("share")), "raster_id")


def contour_levels(cells: DataFrame, k: int = 8) -> DataFrame:
    lim = cells.groupBy("raster_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    lim = lim.withColumn("level_no", F.explode(F.sequence(lit(1), lit(k))))
    return lim.select("raster_id", "level_no", (c("lo") + (c("hi") - c("lo")) * c("level_no") / (k + 1)).alias("level"))


# ------------------------------------------------------------ neighbourhoods

def gradient(cells: DataFrame, cell_m: Column | float = 1.0) -> DataFrame:
    """(gx, gy): central differences, one-sided at the edges.

    A window partition is one row or one column of a raster.
    """
    step = cell_m if isinstance(cell_m, Column) else lit(float(cell_m))

    def diff(w, axis):
        nxt, prv = F.lead(axis).over(w), F.lag(axis).over(w)
        zn, zp = F.lead("z").over(w), F.lag("z").over(w)
        return (F.when(nxt.isNull() & prv.isNull(), lit(None)).when(prv.isNull(), zn - c("z"))
                .when(nxt.isNull(), c("z") - zp).otherwise((zn - zp) / 2.0)) / step
    return cells.withColumn("gx", diff(_along_row(), "col")).withColumn("gy", diff(_along_col(), "row"))


def corner_heights(cells: DataFrame) -> DataFrame:
    """The four corners z00, z01, z11, z10 of every grid cell, clockwise from its origin."""
    right = F.when(F.lead("col").over(_along_row()) == c("col") + 1, F.lead("z").over(_along_row()))
    x = cells.withColumn("_r", right)
    w = _along_col()
    down = F.lead("row").over(w) == c("row") + 1
    x = x.withColumns({"z00": c("z"), "z01": c("_r"), "z11": F.when(down, F.lead("_r").over(w)), "z10": F.when(down, F.lead("z").over(w))})
    return x.drop("_r").where("z00 is not null and z01 is not null and z11 is not null and z10 is not null")


def contours(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """Marching-squares segments per level: the first two crossed edges of each grid cell."""
    per = levels.groupBy("raster_id").agg(F.array_sort(F.collect_list(F.struct("level_no", "level"))).alias("_l"))
    quad = corner_heights(cells).join(per, "raster_id")
    # a level outside the heights of the four corners cannot cross an edge
    low, high = F.least("z00", "z01", "z11", "z10"), F.greatest("z00", "z01", "z11", "z10")
    quad = quad.withColumn("_k", F.explode(F.filter("_l", lambda s: (s["level"] > low) & (s["level"] <= high))))
    h = [c(k) - c("_k.level") for k in ("z00", "z01", "z11", "z10")]
    at = [(0, 0), (1, 0), (1, 1), (0, 1)]
    edges = []
    for i in range(4):
        (x1, y1), (x2, y2), z1, z2 = at[i], at[(i + 1) % 4], h[i], h[(i + 1) % 4]
        t = F.try_divide(z1, z1 - z2)
        point = F.struct((c("col") + x1 + t * (x2 - x1)).alias("x"), (c("row") + y1 + t * (y2 - y1)).alias("y"))
        edges.append(F.when((z1 < 0) != (z2 < 0), point))
    pts = quad.withColumn("_p", F.filter(F.array(*edges), lambda p: p.isNotNull())).where(F.size("_p") >= 2)
    return pts.select("raster_id", c("_k.level_no").alias("level_no"), c("_k.level").alias("level"),
                      c("_p")[0]["x"].alias("x1"), c("_p")[0]["y"].alias("y1"), c("_p")[1]["x"].alias("x2"), c("_p")[1]["y"].alias("y2"))


def lambert_slopes(cells: DataFrame, sun: Column, legacy: bool = False, shadow: bool = False) -> DataFrame:
    """Cells with slopes p and q; ``shadow`` adds the flag of the cells too dark to carry one."""
    stats = exact_percentiles(cells, ID, "z", {"_med": .5, "_p01": .01})
    x = cells.join(stats, "raster_id").withColumn("_s", sun)
    return x.withColumn("_pq", geo.lambert_slope(c("z"), c("_med"), c("_p01"), c("_s"), legacy=legacy)).select(
        *cells.columns, "_pq.p", "_pq.q", *([geo.in_shadow(c("z"), c("_p01")).alias("shadow")] if shadow else []))


def hillshade(cells: DataFrame, az: Column, el: Column, albedo: Column | float = 0.12, cell_m: float = 1.0) -> DataFrame:
    """Shaded relief scaled by the brightest cell of each raster."""
    alb = albedo if isinstance(albedo, Column) else lit(albedo)
    x = gradient(cells, cell_m).withColumn("_sun", geo.sun_vector(az, el))
    x = x.withColumn("_b", geo.shade(c("gx"), c("gy"), c("_sun"), alb))
    return with_group(x, ID, _hi=F.max("_b")).withColumn("shade", c("_b") / (c("_hi") + 1e-8)).drop("_b", "_hi", "_sun", "gx", "gy")


def stretch(cells: DataFrame, lo: float = .01, hi: float = .99) -> DataFrame:
    s = exact_percentiles(cells, ID, "z", {"_lo": lo, "_hi": hi})
    return cells.join(s, "raster_id").withColumn("dn", geo.stretch_u8(c("z"), c("_lo"), c("_hi"))).drop("_lo", "_hi")


def stretch_centred(cells: DataFrame) -> DataFrame:
    """2-98 % stretch with a gain of at most 1.7 and the mean moved to 128."""
    s = exact_percentiles(cells, ID, "z", {"_lo": .02, "_hi": .98}).join(cells.groupBy(*ID).agg(F.avg("z").alias("_mz")), ID)
    # the stretch is linear, so its mean follows from the mean of z
    mean = geo.stretch_gain(c("_mz"), c("_lo"), c("_hi"))
    x = cells.join(s, "raster_id").withColumn("_g", geo.stretch_gain(c("z"), c("_lo"), c("_hi")) + 128.0 - mean)
    moved = F.greatest(lit(0.0), F.least(lit(255.0), c("_g"))).cast("int")
    dn = F.when(c("z").isNull(), lit(None)).when(c("_hi") - c("_lo") > 1e-6, moved).otherwise(c("z").cast("int"))
    return x.withColumn("dn", dn).drop("_lo", "_hi", "_mz", "_g")


# ------------------------------------------------------------ resampling

def upsample_linear(cells: DataFrame, n: int = GRID_N) -> DataFrame:
    """Linear resampling to n x n; weights are shared out over the valid cells."""
    from selenic.operators import kernels

    return kernels.upsample_linear(cells, n)


def upsample_labels(cells: DataFrame, n: int = GRID_N) -> DataFrame:
    """Class grid at n x n: the class with the largest interpolated weight, lowest id on ties."""
    from selenic.operators import kernels

    return kernels.upsample_labels(cells, n)


def gaussian_radius(sigma: float) -> int:
    return int(4.0 * sigma + 0.5)


def gaussian_weights(sigma: float) -> list[float]:
    k = gaussian_radius(sigma)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-k, k + 1)]
    return [v / sum(w) for v in w]


def grid_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two grids cell by cell."""
    return a.join(b, ["raster_id", "row", "col"])


def frames(cells: DataFrame) -> DataFrame:
    """Cells with the size of their raster as ``lines`` and ``samples``."""
    return with_group(cells, ID, lines=F.max("row") + 1, samples=F.max("col") + 1)
