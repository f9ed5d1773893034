"""What the raster and header sources open, and what they return."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from selenic.sources import datasource, labels, rasters
from selenic.sources.datasource import RasterReader, block, ranges

CATALOG = "raster_id long, path string, lines int, samples int, dtype string, offset long, missing double"
CUBES = "cube_id int, path string, bands int, lines int, samples int, dtype string, offset long"


@pytest.fixture()
def three(spark, tmp_path):
    """Three rasters of which only the second may be opened."""
    a = np.arange(60 * 40, dtype="<i2").reshape(60, 40)
    a[3, 4] = -32768
    (tmp_path / "two.img").write_bytes(b"h" * 8 + a.tobytes())
    rows = [(1, str(tmp_path / "gone1.img"), 60, 40, "<i2", 8, None), (2, str(tmp_path / "two.img"), 60, 40, "<i2", 8, 7.0),
            (3, str(tmp_path / "gone3.img"), 60, 40, "<i2", 8, None)]
    return a, spark.createDataFrame(rows, CATALOG), tmp_path


def test_product_predicate_opens_one_file(three):
    a, df, _ = three
    got = rasters.read_raster_cells(df).where("raster_id = 2").toPandas().sort_values(["row", "col"])
    want = a.astype(float)
    want[(a == 7) | (a <= -32000)] = np.nan
    assert np.array_equal(got.z.to_numpy(float).reshape(60, 40), want, equal_nan=True)
    with pytest.raises(Exception, match="gone"):
        rasters.read_raster_cells(df).where("raster_id <= 2").count()


def test_window_predicate_reads_its_bytes(three):
    a, df, folder = three
    # all but the bytes of lines 10 to 12 is cut off or made unreadable
    raw = bytearray((folder / "two.img").read_bytes()[:8 + 13 * 40 * 2])
    raw[:8 + 10 * 40 * 2] = b"\xff" * (8 + 10 * 40 * 2)
    (folder / "two.img").write_bytes(raw)
    cells = rasters.read_raster_cells(df).where("raster_id = 2 AND row >= 10 AND row < 13 AND col BETWEEN 5 AND 9")
    got = {(r.row, r.col): r.z for r in cells.collect()}
    assert got == {(y, x): float(a[y, x]) for y in (10, 11, 12) for x in range(5, 10)}
    assert ") Filter" not in cells._jdf.queryExecution().executedPlan().toString()


def planned(df, form, ident="raster_id", push=(), **options):
    """(reader, its partitions) after the predicates."""
    path = str(options.pop("folder"))
    df.write.mode("overwrite").parquet(path)
    reader = RasterReader({"catalog": path, "form": form, **{k: str(v) for k, v in options.items()}}, ident)
    assert list(reader.pushFilters(list(push))) == []
    return reader, reader.partitions()


def test_bytes_of_a_plan(three, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    _, df, _ = three
    push = [EqualTo(("raster_id",), 2), GreaterThanOrEqual(("row",), 10), LessThan(("row",), 30), EqualTo(("col",), 4)]
    reader, parts = planned(df, "cells", push=push, folder=tmp_path / "c", partition_bytes=10)
    assert len(parts) == 4 and sum(p.value[2] - p.value[1] for p in parts) == 20
    read = 0
    for p in parts:
        x, y0, y1 = p.value
        read += sum(n for _, n, _ in ranges(x["offset"], x["samples"], 2, range(y0, y1), x["c0"], x["c1"]))
    assert read <= 20 * 80  # the gap between samples is small, so lines are read at once, no more than whole ones
    wide = list(ranges(0, 1_000_000, 2, range(5, 8), 100, 200))
    assert [n for _, n, _ in wide] == [200] * 3 and wide[0][0] == (5_000_000 + 100) * 2


def test_block_steps(tmp_path):
    a = np.arange(300, dtype=">u2").reshape(30, 10)
    (tmp_path / "b").write_bytes(a.tobytes())
    with datasource.open_input(str(tmp_path / "b")) as f:
        assert np.array_equal(block(f, 0, 10, np.dtype(">u2"), range(3, 9), 2, 7), a[3:9, 2:7])
        assert np.array_equal(block(f, 0, 10, np.dtype(">u2"), range(3, 20, 4), 2, 7), a[3:20:4, 2:7])
        assert np.array_equal(block(f, 0, 10, np.dtype(">u2"), range(28, 30), 5, 10), a[28:30, 5:10])


def test_tiles_prune(spark, three):
    a, df, _ = three
    tiles = rasters.read_raster_tiles(df, tile=16).where("raster_id = 2 AND tile_r = 1 AND tile_c >= 2")
    got = rasters.tiles_to_cells(tiles).toPandas().sort_values(["row", "col"])
    assert np.array_equal(got.z.to_numpy().reshape(16, 8), a[16:32, 32:40].astype(float))


@pytest.mark.parametrize("partition_bytes", [64, 1 << 20])
def test_cube_forms(spark, tmp_path, partition_bytes):
    cube = np.random.default_rng(0).random((6, 20, 9)).astype("<f4")
    (tmp_path / "cube").write_bytes(b"x" * 4 + cube.tobytes())
    df = spark.createDataFrame([(1, str(tmp_path / "cube"), 6, 20, 9, "<f4", 4), (2, str(tmp_path / "gone"), 6, 20, 9, "<f4", 4)], CUBES)
    source = datasource.read_catalog(df, "spectra", "cube_id", partition_bytes=partition_bytes)
    rows = source.where("cube_id = 1 AND line > 3 AND line <= 11 AND sample = 4").collect()
    assert {r.line for r in rows} == set(range(4, 12))
    assert all(np.allclose(r.refl, cube[:, r.line, 4]) for r in rows)
    bands = datasource.read_catalog(df, "bands", "cube_id", partition_bytes=partition_bytes).where("cube_id IN (1) AND band = 3 AND line >= 18").collect()
    assert sorted((r.band, r.line) for r in bands) == [(3, 18), (3, 19)]
    assert all(np.allclose(r.data, cube[3, r.line]) for r in bands)
    stepped = df.withColumns({"r0": F.lit(1), "c0": F.lit(0), "r1": F.lit(20), "c1": F.lit(9), "row_step": F.lit(4), "col_step": F.lit(3)})
    rows = rasters.read_spectra(stepped).where("cube_id = 1 AND line >= 6 AND sample > 0").collect()
    assert {(r.line, r.sample) for r in rows} == {(y, x) for y in (9, 13, 17) for x in (3, 6)}


def test_empty_catalog_and_null_path(spark, three):
    _, df, _ = three
    assert rasters.read_raster_cells(df.where("false")).count() == 0
    assert rasters.read_raster_cells(df.where("raster_id = 2").withColumn("path", F.lit(None).cast("string"))).count() == 0
    assert rasters.read_raster_cells(df).where("raster_id = 99").count() == 0


def test_heads_open_what_is_asked(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for k in ("a", "b"):
        (tmp_path / "sub" / f"ch2_{k}.xml").write_text(f"<axis_name>Line</axis_name> <elements>{3 if k == 'a' else 5}</elements>")
    (tmp_path / "ch2_c.xml").write_text("<lines>7</lines>")
    (tmp_path / "other.txt").write_text("x")
    got = labels.read_labels(spark, str(tmp_path), pruned=True).where("product_id IN ('ch2_a', 'ch2_b')")
    assert {r.product_id: r.lines for r in got.collect()} == {"ch2_a": 3, "ch2_b": 5}
    from pyspark.sql.datasource import In

    reader = datasource.HeadReader({"path": str(tmp_path), "glob": "*.xml"})
    assert list(reader.pushFilters([In(("product_id",), ("ch2_a", "ch2_b"))])) == []
    assert [p for part in reader.partitions() for _, p, _ in part.value[0]] == ["ch2_a", "ch2_b"]
    heads = datasource.read_heads(spark, str(tmp_path), "*.txt|*.xml", 4).where("product_id LIKE 'ch2_a%'").collect()
    assert [(r.product_id, r.text) for r in heads] == [("ch2_a", "<axi")] and heads[0].size > 4
    assert datasource.read_heads(spark, str(tmp_path), "*.none").count() == 0
