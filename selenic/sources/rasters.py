"""Raster bytes to tables: only the byte ranges that are needed are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selenic.sources import datasource
from selenic.sources.labels import STRIP_HEADER_BYTES, parse_strip_headers

c = F.col


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime) of every file; contents are never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
            .select("path", c("length").alias("size"), c("modificationTime").alias("mtime")))


def read_attached_headers(spark: SparkSession, path: str, glob: str = "*.IMG|*.img") -> DataFrame:
    """Strip catalog from the fixed-size text header at the front of each raster."""
    return parse_strip_headers(datasource.read_heads(spark, path, glob, STRIP_HEADER_BYTES).select("path", "text"))


def read_raster_tiles(products: DataFrame, tile: int = 256) -> DataFrame:
    """Tile rows ``(raster_id, tile_r, tile_c, row0, col0, n_rows, n_cols, data)`` of raw rasters.

    ``products(raster_id, path, lines, samples, dtype, offset, missing)`` and optionally a
    window ``r0, c0, r1, c1``. Only the bytes of the windows, and of predicates on raster_id,
    tile_r and tile_c, are read. Nodata becomes NULL.
    """
    return datasource.read_catalog(products, "tiles", tile=tile)


def read_raster_cells(products: DataFrame) -> DataFrame:
    """Cells ``(raster_id, row, col, z)``; predicates on raster_id, row and col decide what is read."""
    return datasource.read_catalog(products, "cells")


def tiles_to_cells(tiles: DataFrame) -> DataFrame:
    x = tiles.select("raster_id", "row0", "col0", "n_cols", F.posexplode("data").alias("_i", "z"))
    return x.select("raster_id", (c("row0") + F.floor(c("_i") / c("n_cols"))).cast("int").alias("row"),
                    (c("col0") + c("_i") % c("n_cols")).cast("int").alias("col"), c("z").cast("double").alias("z"))


def read_spectra(cubes: DataFrame) -> DataFrame:
    """One spectrum per pixel ``(cube_id, line, sample, refl)`` of band-sequential cubes.

    ``cubes(cube_id, path, bands, lines, samples, dtype, offset)``, optionally with a window
    and strides ``row_step, col_step``. Predicates on cube_id, line and sample decide what is read.
    """
    return datasource.read_catalog(cubes, "spectra", "cube_id")


def read_bands(cubes: DataFrame) -> DataFrame:
    """One row per band and line ``(cube_id, band, line, sample0, data)``; predicates on cube_id, band and line prune."""
    return datasource.read_catalog(cubes, "bands", "cube_id")
