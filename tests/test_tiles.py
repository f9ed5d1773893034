"""Tiles against the cell versions, and what their plans shuffle."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from selenic.functions import predicates
from selenic.operators import cells, kernels, tiles


@pytest.fixture(scope="module")
def raster(spark):
    """Two rasters whose last tiles are thin, with nodata."""
    r = np.random.default_rng(5)
    rows = []
    for k, (h, w) in enumerate([(43, 37), (16, 33)]):
        a = r.normal(100, 30, (h, w)).round(3)
        a[r.random((h, w)) < 0.05] = np.nan
        rows += [(k, y, x, None if np.isnan(a[y, x]) else float(a[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "raster_id long, row int, col int, z double").cache()


def table(df, *values):
    return {(r.raster_id, r.row, r.col): tuple(None if r[v] is None else round(r[v], 6) for v in values) for r in df.collect()}


def test_round_trip(raster):
    t = tiles.from_cells(raster, 16)
    assert t.count() == 9 + 3
    assert table(tiles.to_cells(t).withColumnRenamed("data", "z"), "z") == table(raster, "z")
    again = tiles.framed(t.drop("lines", "samples")).select("raster_id", "lines", "samples").distinct().collect()
    assert {tuple(r) for r in again} == {(0, 43, 37), (1, 16, 33)}


def test_mask_and_stretch(raster):
    t = tiles.from_cells(raster, 16)
    got = tiles.to_cells(tiles.mask(t, low=60.0, high=140.0))
    want = raster.withColumn("data", F.when((F.col("z") > 60) & (F.col("z") < 140), F.col("z")))
    assert table(got, "data") == table(want, "data")
    odd = raster.withColumn("z", F.when(F.col("col") == 3, -32768.0).when(F.col("col") == 4, 7.0).otherwise(F.col("z")))
    got = tiles.to_cells(tiles.mask(tiles.from_cells(odd, 16), missing=7.0))
    assert table(got, "data") == table(odd.withColumn("data", predicates.mask_nodata(F.col("z"), 7.0)), "data")
    got = tiles.to_cells(tiles.stretch(t), "data", "dn").where("data is not null")
    want = cells.stretch(raster.where("z is not null")).withColumn("dn", F.col("dn").cast("double"))
    assert table(got, "dn") == table(want, "dn")


@pytest.mark.parametrize("outlier", [None, 1e300, -1e300, float(2**60)])
def test_percentiles_whatever_the_outliers(spark, raster, outlier):
    df = raster if outlier is None else raster.withColumn("z", F.when((F.col("row") == 2) & (F.col("col") == 2), outlier).otherwise(F.col("z")))
    df = df.withColumn("z", F.when(F.col("col") % 5 == 0, F.lit(-0.0)).when(F.col("col") % 7 == 0, -F.col("z")).otherwise(F.col("z")))
    got = {r.raster_id: r for r in tiles.percentiles(tiles.from_cells(df, 16), {"a": .01, "b": .5, "c": .98, "d": 1.0, "e": 0.0}).collect()}
    for k in (0, 1):
        z = np.array([r.z for r in df.where(f"raster_id = {k} and z is not null").collect()])
        assert [got[k][n] for n in "abcde"] == pytest.approx(np.percentile(z, [1, 50, 98, 100, 0]).tolist(), rel=1e-12)


def test_ordered_words():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 1e-310, 1.0, 3.0, np.inf])
    k = tiles.ordered(x)
    assert (np.diff(k.astype(object)) >= 0).all() and k[4] == k[5]
    assert np.array_equal(tiles.unordered(k), x + 0.0)


def test_histogram_and_blocks(raster):
    t = tiles.from_cells(raster, 16)
    got = {(r.raster_id, r.bin): r.n for r in tiles.histogram(t, 0.0, 25.0, 8).collect()}
    slot = F.greatest(F.lit(0), F.least(F.lit(7), F.floor(F.col("z") / 25))).cast("int")
    want = raster.where("z is not null").groupBy("raster_id", slot.alias("bin")).count().collect()
    assert got == {(r.raster_id, r.bin): r["count"] for r in want}
    got = table(tiles.block_average(t, 5), "z")
    assert got == table(cells.block_average(cells.frames(raster), 5, rebase=False), "z")


@pytest.mark.parametrize("tile", [16, 64])
def test_stencils(raster, tile):
    t = tiles.deal(tiles.from_cells(raster, tile))
    got = tiles.to_cells(tiles.gradient(t, 2.0), "data", "gx", "gy")
    assert table(got, "gx", "gy") == table(cells.gradient(raster, 2.0), "gx", "gy")
    got = tiles.to_cells(tiles.gaussian_smooth(t, 1.2), "smooth")
    assert table(got, "smooth") == table(kernels.gaussian_smooth(raster, 1.2, tile=16).withColumnRenamed("z", "smooth"), "smooth")


def test_only_strips_are_shuffled(spark, raster):
    """A chain of two stencils: the tiles are dealt once, and no exchange holds a cell of a tile's inside."""
    size = 64
    big = spark.range(4).select((F.col("id")).alias("raster_id"), F.lit(0).alias("tile_r"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("tile_c"))
    big = big.withColumns({"row0": F.lit(0), "col0": F.col("tile_c") * size, "n_rows": F.lit(size), "n_cols": F.lit(size), "lines": F.lit(size),
                           "samples": F.lit(8 * size), "data": F.transform(F.sequence(F.lit(1), F.lit(size * size)), lambda i: (i % 97).cast("double"))})
    dealt = tiles.deal(big)
    smooth = tiles.gaussian_smooth(dealt, 0.5)
    chain = tiles.gradient(tiles.keep(smooth), value="smooth")
    for step in (smooth, chain):
        plan = spark._jvm.PythonSQLUtils.explainString(step._jdf.queryExecution(), "formatted")
        sent = re.findall(r"Exchange\nInput \[\d+\]: (\[.*?\])", plan)
        assert sent and not any("data#" in x or "smooth#" in x or "gx#" in x for x in sent)
        assert plan.count("ShuffledHashJoin") and "SortMergeJoin" not in plan
    rows = chain.select("raster_id", "tile_c", F.size("gx").alias("n"))
    assert {r.n for r in rows.collect()} == {size * size} and rows.count() == 32
    strip = tiles.strips(dealt, 2)
    cells_sent = strip.select(F.explode("_strips").alias("s")).agg(F.sum(F.size("s.v"))).first()[0]
    assert cells_sent == 4 * 7 * 2 * 2 * size  # two columns each way over each of the seven seams
