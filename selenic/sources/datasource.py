"""Rasters, cubes and text headers as Spark data sources that open only what a query asks for.

``RasterSource`` (format ``selenic_raster``) reads headerless or attached-header rasters in four forms:

======== ============================================================== =======================
form     a row                                                          predicates that prune
======== ============================================================== =======================
cells    one pixel: id, row, col, z                                     id, row, col
tiles    one tile: id, tile_r, tile_c, row0, col0, n_rows, n_cols, data id, tile_r, tile_c
spectra  one pixel of a cube: id, line, sample, refl                    id, line, sample
bands    one line of a band: id, band, line, sample0, data              id, band, line
======== ============================================================== =======================

Its catalog is a Parquet folder with a row per raster (id, path, lines, samples, dtype, and where they
apply bands, offset, missing, r0, c0, r1, c1, row_step, col_step). ``pushFilters`` takes the predicates
of the table, so planning already leaves out rasters, line ranges and bands, and a task seeks to the
bytes of its window: neighbouring lines are read at once unless the gap between the wanted samples
is over ``GAP`` bytes. Decoding is done by array, rows leave as Arrow, nodata becomes NULL.

``HeadSource`` (format ``selenic_heads``) lists a folder and reads the first ``bytes`` of each file, or all
of it (path, product_id, size, text); predicates on product_id decide which files are opened.

A partition holds about ``partition_bytes`` of a raster, or ``FILES`` files; it is planned from the catalog
alone and can be read again anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
                                    LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith)
from pyspark.sql.pandas.types import to_arrow_type

from selenic.session import workdir

GAP = 64 << 10
FILES = 64
PARTITION_BYTES = 64 << 20
BATCH_VALUES = 1 << 20
#: columns whose predicates prune, in the order id, then the axes
AXES = {"cells": ("row", "col"), "tiles": ("tile_r", "tile_c"), "spectra": ("line", "sample"), "bands": ("band", "line")}
SCHEMAS = {"cells": "row int, col int, z double",
           "tiles": "tile_r int, tile_c int, row0 int, col0 int, n_rows int, n_cols int, data array<float>",
           "spectra": "line int, sample int, refl array<float>", "bands": "band int, line int, sample0 int, data array<float>"}


def open_input(path: str):
    """A seekable stream for any path a cluster uses (local, hdfs, object store)."""
    system, name = _system(path)
    return system.open_input_file(name)


def _system(path: str):
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class Part(InputPartition):
    """One raster, or a list of files, and the lines of it."""

    def __init__(self, what: Any, first: int = 0, stop: int = 0):
        super().__init__((what, first, stop))


class Window:
    """Ranges [low, high) of whole-number columns and a set of ids, narrowed by predicates."""

    def __init__(self, ident: str, axes: tuple[str, ...]):
        self.ident, self.ids = ident, None
        self.low, self.high = dict.fromkeys(axes, 0), dict.fromkeys(axes, 1 << 62)

    def take(self, f: Filter) -> bool:
        """Whether the predicate is covered in full, so that Spark need not test it again."""
        name = f.attribute[0] if len(f.attribute) == 1 else ""
        if isinstance(f, IsNotNull):
            return name == self.ident or name in self.low
        if name == self.ident and isinstance(f, (EqualTo, In)):
            ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.ids = ids if self.ids is None else self.ids & ids
            return True
        if name not in self.low or isinstance(f, In):
            return False
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.high[name] = min(self.high[name], f.value + (not isinstance(f, LessThan)))
        return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))


def ranges(offset: int, samples: int, size: int, lines: range, c0: int, c1: int) -> Iterator[tuple[int, int, range]]:
    """(first byte, bytes, lines) of each read for samples [c0, c1) of the lines."""
    gap = (samples - (c1 - c0)) * size
    if not len(lines) or c1 <= c0:
        return
    if lines.step == 1 and gap <= GAP:
        yield offset + (lines[0] * samples + c0) * size, ((len(lines) - 1) * samples + c1 - c0) * size, lines
        return
    for y in lines:
        yield offset + (y * samples + c0) * size, (c1 - c0) * size, range(y, y + 1)


def block(f, offset: int, samples: int, kind: np.dtype, lines: range, c0: int, c1: int) -> np.ndarray:
    """Samples [c0, c1) of the lines."""
    out = np.empty((len(lines), c1 - c0), kind)
    at = 0
    for first, n, part in ranges(offset, samples, kind.itemsize, lines, c0, c1):
        f.seek(first)
        raw = np.frombuffer(f.read(n), kind)
        if len(part) == 1:
            out[at] = raw
        else:
            flat = np.zeros(len(part) * samples, kind)
            flat[:len(raw)] = raw
            out[at:at + len(part)] = flat.reshape(len(part), samples)[:, :c1 - c0]
        at += len(part)
    return out


def nodata(a: np.ndarray, missing: float | None) -> np.ndarray:
    """True where a sample has no value: not finite, the missing value, or far below zero in whole numbers."""
    bad = ~np.isfinite(a) if a.dtype.kind == "f" else np.zeros(a.shape, dtype=bool)
    if a.dtype.kind in "iu":
        bad |= a.astype("int64") <= -32000
    if missing is not None and np.isfinite(missing):
        bad |= a == missing
    return bad


def lists(values: np.ndarray, mask: np.ndarray | None, lengths: np.ndarray) -> pa.Array:
    """A list column over flat values, without an object for any of them."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype("float32").ravel(), mask=None if mask is None else mask.ravel()))


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str], ident: str, kind: pa.DataType | None = None):
        self.catalog, self.form, self.ident, self.kind = options["catalog"], options.get("form", "cells"), ident, kind or pa.int64()
        self.tile, self.bytes = int(options.get("tile", 256)), int(options.get("partition_bytes", PARTITION_BYTES))
        self.window = Window(ident, AXES[self.form])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.window.take(f):
                yield f

    def rasters(self) -> Iterator[dict]:
        """Catalog rows with their window cut to the predicates."""
        import pyarrow.dataset as ds

        system, name = _system(self.catalog)
        data = ds.dataset(name, filesystem=system, format="parquet")
        ids = self.window.ids
        for b in data.to_batches(filter=None if ids is None else ds.field(self.ident).isin([x for x in ids if x is not None])):
            for row in b.to_pylist():
                row = {"r0": 0, "c0": 0, "r1": row["lines"], "c1": row["samples"], "row_step": 1, "col_step": 1, "bands": 1, "offset": 0, "missing": None} | row
                yield row | {"b0": 0, "b1": row["bands"]} | self._cut(row)

    def _cut(self, row: dict) -> dict:
        low, high = self.window.low, self.window.high
        a, b = AXES[self.form]
        if self.form == "tiles":
            t = self.tile
            return {"r0": max(row["r0"], low[a] * t), "r1": min(row["r1"], high[a] * t), "c0": max(row["c0"], low[b] * t), "c1": min(row["c1"], high[b] * t)}
        if self.form == "bands":
            return {"b0": max(0, low[a]), "b1": min(row["bands"], high[a]), "r0": _next(row["r0"], low[b], row["row_step"]), "r1": min(row["r1"], high[b])}
        return {"r0": _next(row["r0"], low[a], row["row_step"]), "r1": min(row["r1"], high[a]),
                "c0": _next(row["c0"], low[b], row["col_step"]), "c1": min(row["c1"], high[b])}

    def partitions(self) -> list[Part]:
        out = []
        for x in self.rasters():
            if x["r1"] <= x["r0"] or x["c1"] <= x["c0"] or x["b1"] <= x["b0"]:
                continue
            line = (x["c1"] - x["c0"]) * np.dtype(x["dtype"]).itemsize * (x["b1"] - x["b0"])
            n = max(1, self.bytes // max(line, 1))
            unit = self.tile if self.form == "tiles" else x["row_step"]
            step = max(1, n // unit) * unit if self.form == "tiles" else n * unit
            start = x["r0"] // unit * unit if self.form == "tiles" else x["r0"]
            out += [Part(x, max(y, x["r0"]), min(y + step, x["r1"])) for y in range(start, x["r1"], step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        x, y0, y1 = partition.value
        kind = np.dtype(x["dtype"])
        with open_input(x["path"]) as f:
            yield from getattr(self, f"_{self.form}")(f, x, kind, y0, y1)

    def _id(self, x: dict, n: int) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, "int32")), pa.array([x[self.ident]], self.kind)).dictionary_decode()

    def _cells(self, f, x: dict, kind: np.dtype, y0: int, y1: int) -> Iterator[pa.RecordBatch]:
        rows = max(1, BATCH_VALUES // (x["c1"] - x["c0"]))
        for y in range(y0, y1, rows * x["row_step"]):
            lines = range(y, min(y1, y + rows * x["row_step"]), x["row_step"])
            a = block(f, x["offset"], x["samples"], kind, lines, x["c0"], x["c1"])[:, ::x["col_step"]]
            cols = np.arange(x["c0"], x["c1"], x["col_step"], dtype="int32")
            yield pa.RecordBatch.from_arrays([self._id(x, a.size), pa.array(np.repeat(np.array(lines, dtype="int32"), len(cols))), pa.array(np.tile(cols, len(lines))),
                                              pa.array(a.astype("float64").ravel(), mask=nodata(a, x["missing"]).ravel())], [self.ident, "row", "col", "z"])

    def _tiles(self, f, x: dict, kind: np.dtype, y0: int, y1: int) -> Iterator[pa.RecordBatch]:
        t = self.tile
        for tr in range(y0 // t, (y1 - 1) // t + 1):
            lines = range(max(y0, tr * t), min(y1, (tr + 1) * t))
            a = block(f, x["offset"], x["samples"], kind, lines, x["c0"], x["c1"])
            bad = nodata(a, x["missing"])
            tc = np.arange(x["c0"] // t, (x["c1"] - 1) // t + 1)
            left, right = np.maximum(tc * t, x["c0"]), np.minimum((tc + 1) * t, x["c1"])
            cut = [slice(p - x["c0"], q - x["c0"]) for p, q in zip(left, right, strict=True)]
            data = lists(np.concatenate([a[:, s].ravel() for s in cut]), np.concatenate([bad[:, s].ravel() for s in cut]), len(lines) * (right - left))
            n = len(tc)
            full = lambda v, n=n: pa.array(np.full(n, v, "int32"))
            yield pa.RecordBatch.from_arrays([self._id(x, n), full(tr), pa.array(tc.astype("int32")), full(lines[0]), pa.array(left.astype("int32")), full(len(lines)),
                                              pa.array((right - left).astype("int32")), data],
                                             [self.ident, "tile_r", "tile_c", "row0", "col0", "n_rows", "n_cols", "data"])

    def _spectra(self, f, x: dict, kind: np.dtype, y0: int, y1: int) -> Iterator[pa.RecordBatch]:
        cols = np.arange(x["c0"], x["c1"], x["col_step"], dtype="int32")
        rows = max(1, BATCH_VALUES // (len(cols) * x["bands"]))
        for y in range(y0, y1, rows * x["row_step"]):
            lines = range(y, min(y1, y + rows * x["row_step"]), x["row_step"])
            cube = np.empty((x["bands"], len(lines), len(cols)), "float32")
            for k in range(x["bands"]):
                cube[k] = block(f, x["offset"] + k * x["lines"] * x["samples"] * kind.itemsize, x["samples"], kind, lines, x["c0"], x["c1"])[:, ::x["col_step"]]
            n = len(lines) * len(cols)
            yield pa.RecordBatch.from_arrays([self._id(x, n), pa.array(np.repeat(np.array(lines, dtype="int32"), len(cols))), pa.array(np.tile(cols, len(lines))),
                                              lists(cube.reshape(x["bands"], n).T, None, np.full(n, x["bands"]))], [self.ident, "line", "sample", "refl"])

    def _bands(self, f, x: dict, kind: np.dtype, y0: int, y1: int) -> Iterator[pa.RecordBatch]:
        lines = range(y0, y1, x["row_step"])
        for k in range(x["b0"], x["b1"]):
            a = block(f, x["offset"] + k * x["lines"] * x["samples"] * kind.itemsize, x["samples"], kind, lines, x["c0"], x["c1"])[:, ::x["col_step"]]
            n = len(lines)
            yield pa.RecordBatch.from_arrays([self._id(x, n), pa.array(np.full(n, k, "int32")), pa.array(np.array(lines, dtype="int32")), pa.array(np.full(n, x["c0"], "int32")),
                                              lists(a, nodata(a, x["missing"]), np.full(n, a.shape[1]))], [self.ident, "band", "line", "sample0", "data"])


def _next(start: int, low: int, step: int) -> int:
    """First of start, start + step, ... that is not below ``low``."""
    return start + max(0, -(-(low - start) // step)) * step


class RasterSource(DataSource):
    """See the module; options catalog, form, id (name and type), tile, partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "selenic_raster"

    def schema(self) -> str:
        return f"{self.options.get('id', 'raster_id long')}, {SCHEMAS[self.options.get('form', 'cells')]}"

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options), schema.fields[0].name, to_arrow_type(schema.fields[0].dataType))


class HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.globs, self.bytes = options["path"], options.get("glob", "*").split("|"), int(options.get("bytes", 0))
        self.tests: list[tuple[str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "start", StringEndsWith: "end", StringContains: "part"}
        for f in filters:
            if f.attribute == ("product_id",) and type(f) in kinds:
                self.tests.append((kinds[type(f)], f.value))
            elif not isinstance(f, IsNotNull):
                yield f

    def wanted(self, product: str) -> bool:
        told = {"eq": lambda v: product == v, "in": lambda v: product in v, "start": product.startswith, "end": product.endswith, "part": lambda v: v in product}
        return all(told[k](v) for k, v in self.tests)

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        system, name = _system(self.path)
        found = [(i.path, i.base_name, i.size) for i in system.get_file_info(fs.FileSelector(name, recursive=True)) if i.is_file]
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        kept = sorted((prefix + p, b.rsplit(".", 1)[0], n) for p, b, n in found if any(fnmatch(b, g) for g in self.globs) and self.wanted(b.rsplit(".", 1)[0]))
        return [Part(kept[i:i + FILES]) for i in range(0, len(kept), FILES)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        for path, product, size in partition.value[0]:
            with open_input(path) as f:
                raw = f.read(self.bytes) if self.bytes else f.read()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([product]), pa.array([size], pa.int64()), pa.array([raw.decode("utf-8", "replace")])],
                                             ["path", "product_id", "size", "text"])


class HeadSource(DataSource):
    """See the module; options path, glob (several parted by ``|``), bytes (0: all)."""

    @classmethod
    def name(cls) -> str:
        return "selenic_heads"

    def schema(self) -> str:
        return "path string, product_id string, size long, text string"

    def reader(self, schema) -> HeadReader:
        return HeadReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both formats known to the session and let predicates reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    spark.dataSource.register(HeadSource)


def read_heads(spark: SparkSession, path: str, glob: str = "*", n_bytes: int = 0) -> DataFrame:
    register(spark)
    return spark.read.format("selenic_heads").option("path", path).option("glob", glob).option("bytes", n_bytes).load()


def read_catalog(catalog: DataFrame, form: str, ident: str = "raster_id", tile: int = 256, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The rasters of a catalog in one of the forms; the catalog is written where executors see it."""
    spark = catalog.sparkSession
    register(spark)
    path = workdir(spark, "raster-catalog")
    catalog.where(F.col("path").isNotNull()).write.parquet(path)
    kind = catalog.schema[ident].dataType.simpleString()
    return (spark.read.format("selenic_raster").option("catalog", path).option("form", form).option("id", f"{ident} {kind}").option("tile", tile)
            .option("partition_bytes", partition_bytes).load())
