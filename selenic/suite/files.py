"""Source, sink and incremental-catalog queries over files derived from the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from selenic.operators import catalog
from selenic.session import materialise, workdir
from selenic.sources import labels, rasters, tables
from selenic.sources.catalog_log import CatalogLog
from selenic.streaming import streams
from selenic.suite.registry import query, r

c, lit = F.col, F.lit


def label_rows(inp):
    return inp.fx("label_texts").select(F.concat(lit("/labels/"), "product_id", lit(".xml")).alias("path"), "xml")


LABEL_SQL = """
SELECT product_id, CAST(regexp_extract(xml, 'Line</axis_name>\\s*<elements>(\\d+)', 1) AS INT) AS lines, CAST(regexp_extract(xml, 'Sample</axis_name>\\s*<elements>(\\d+)', 1) AS INT) AS samples,
  '<i2' AS dtype, CAST(regexp_extract(xml, '.*<offset unit="byte">(\\d+)', 1) AS BIGINT) AS byte_offset, CAST(regexp_extract(xml, 'missing_constant>([^<]+)', 1) AS DOUBLE) AS missing,
  regexp_extract(xml, 'Area><name>([^<]+)', 1) AS mission, regexp_extract(xml, 'Component><name>([^<]+)</name><type>Instr', 1) AS instrument,
  CAST(regexp_extract(xml, 'sun_elevation[^>]*>([^<]+)', 1) AS DOUBLE) AS sun_el, epoch_ms(CAST(regexp_extract(xml, 'start_date_time>([^<]+)', 1) AS TIMESTAMPTZ)) AS start_ms,
  round((CAST(regexp_extract(xml, 'upper_left_latitude[^>]*>([^<]+)', 1) AS DOUBLE) + CAST(regexp_extract(xml, 'upper_right_latitude[^>]*>([^<]+)', 1) AS DOUBLE)
   + CAST(regexp_extract(xml, 'lower_left_latitude[^>]*>([^<]+)', 1) AS DOUBLE) + CAST(regexp_extract(xml, 'lower_right_latitude[^>]*>([^<]+)', 1) AS DOUBLE)) / 4, 6) + 0.0 AS clat
FROM {fx:label_texts}"""


def _label_view(df):
    return df.select("product_id", "lines", "samples", "dtype", c("offset").alias("byte_offset"), "missing", "mission", "instrument",
                     c("sun_elevation_deg").alias("sun_el"), F.unix_millis("start_time").alias("start_ms"), r(c("center.lat_deg")).alias("clat"))


@query("src_01_labels", LABEL_SQL)
def _(inp):
    return _label_view(labels.parse_labels(label_rows(inp)))


@query("str_02_incremental_catalog", LABEL_SQL)
def _(inp):
    feed = inp.streamed("label_texts", "supplier").select(
        F.concat(lit("/labels/"), "product_id", lit(".xml")).alias("path"), "xml", F.length("xml").alias("version"))
    base = workdir(inp.spark, "catalog")
    q = streams.incremental_catalog(feed, labels.parse_labels, f"{base}/catalog", f"{base}/bad", f"{base}/checkpoint")
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    return _label_view(streams.current_catalog(inp.spark, f"{base}/catalog"))


# ------------------------------------------------------------ raster files

DN = "CASE WHEN z IS NULL THEN -32768 ELSE CAST(floor(z) AS INT) END"


def write_strips(inp) -> str:
    """Strips derived from the cells: a text header, then little-endian samples."""
    base = workdir(inp.spark, "strips")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        from pyarrow import fs

        rid, h, w = int(pdf["raster_id"].iat[0]), int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
        a = np.full((h, w), -32768, "<i2")
        a[pdf["row"].to_numpy(), pdf["col"].to_numpy()] = pdf["dn"].to_numpy()
        head = f'PDS_VERSION_ID = PDS3\r\nLINES = {h}\r\nLINE_SAMPLES = {w}\r\nSTART_TIME = "2023-11-0{rid % 9 + 1}T06:03:56"\r\nEND\r\n'
        system, name = fs.FileSystem.from_uri(base if "://" in base else "file://" + base.removeprefix("file:"))
        system.create_dir(name, recursive=True)
        with system.open_output_stream(f"{name}/strip_{rid}.IMG") as f:
            f.write(head.encode().ljust(5064) + a.tobytes())
        return pd.DataFrame({"raster_id": [rid]})
    cells = inp.fx("heights").select("raster_id", "row", "col", F.expr(DN).alias("dn"))
    cells.groupBy("raster_id").applyInPandas(run, "raster_id long").write.format("noop").mode("overwrite").save()
    return base


SIZES = "SELECT raster_id, max(row) + 1 AS lines, max(col) + 1 AS samples FROM {fx:cells} GROUP BY raster_id"


@query("src_02_attached_headers", f"""
SELECT concat('strip_', CAST(raster_id AS VARCHAR)) AS product_id, lines, samples, concat('2023-11-0', CAST(raster_id % 9 + 1 AS VARCHAR), 'T06:03:56') AS start_text, 5064::BIGINT AS byte_offset FROM ({SIZES}) s""")
def _(inp):
    h = rasters.read_attached_headers(inp.spark, write_strips(inp))
    return h.select("product_id", "lines", "samples", "start_text", c("offset").alias("byte_offset"))


@query("src_03_raster_tiles", f"""
SELECT c.raster_id, c.row, c.col, CAST(floor(z) AS DOUBLE) AS z FROM {{fx:heights}} c JOIN ({SIZES}) s ON c.raster_id = s.raster_id WHERE c.row >= 5 AND c.row < least(50, lines) AND c.col >= 3 AND c.col < 60 AND z IS NOT NULL""")
def _(inp):
    strips = rasters.read_attached_headers(inp.spark, write_strips(inp)).withColumn(
        "raster_id", F.regexp_extract("product_id", r"(\d+)$", 1).cast("long"))
    window = strips.withColumns({"r0": lit(5), "r1": F.least(lit(50), c("lines")), "c0": lit(3), "c1": lit(60)})
    return rasters.tiles_to_cells(rasters.read_raster_tiles(window, tile=16)).where("z is not null")


BANDS, SIDE = 64, 10


def write_cubes(inp):
    """(cube_id, path, bands, lines, samples, dtype, offset): cubes of 10 x 10 spectra, band after band as float32."""
    base = workdir(inp.spark, "cubes")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        from selenic.sources.datasource import _system

        k = int(pdf["cube_id"].iat[0])
        cube = np.zeros((BANDS, SIDE * SIDE), "<f4")
        cube[:, (pdf["px_id"] % (SIDE * SIDE)).to_numpy()] = np.array(pdf["refl"].tolist()).T
        system, name = _system(base)
        system.create_dir(name, recursive=True)
        with system.open_output_stream(f"{name}/cube_{k}.qub") as f:
            f.write(cube.tobytes())
        return pd.DataFrame({"cube_id": [k], "path": [f"{base}/cube_{k}.qub"]})

    px = inp.fx("spectra").withColumn("cube_id", F.floor(c("px_id") / (SIDE * SIDE)))
    made = materialise(px.groupBy("cube_id").applyInPandas(run, "cube_id long, path string"), "cube-catalog")
    return made.withColumns({"bands": lit(BANDS), "lines": lit(SIDE), "samples": lit(SIDE), "dtype": lit("<f4"), "offset": lit(0).cast("long")})


# spectra as the cubes hold them
STORED = "SELECT px_id, list_transform(refl, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE)) AS refl FROM {fx:spectra}"


@query("src_03_cube_spectra", f"""
SELECT px_id // 100 AS cube_id, CAST(px_id % 100 // 10 AS INT) AS line, CAST(px_id % 10 AS INT) AS sample, round(list_sum(refl), 4) AS total, round(refl[3], 6) AS third
FROM ({STORED}) s WHERE px_id // 100 <> 1 AND px_id % 100 // 10 BETWEEN 3 AND 7 AND px_id % 10 > 4""")
def _(inp):
    px = rasters.read_spectra(write_cubes(inp)).where("(cube_id < 1 OR cube_id > 1) AND line >= 3 AND line <= 7 AND sample > 4 AND refl[0] > 0")
    total = F.aggregate("refl", lit(0.0), lambda s, v: s + v.cast("double"))
    return px.select("cube_id", "line", "sample", r(total, 4).alias("total"), r(c("refl")[2].cast("double")).alias("third"))


@query("src_03_cube_bands", f"""
SELECT px_id // 100 AS cube_id, CAST(b AS INT) AS band, CAST(px_id % 100 // 10 AS INT) AS line, round(sum(refl[b + 1]), 4) AS total
FROM ({STORED}) s, (SELECT unnest([5, 40]) AS b) k WHERE px_id % 100 // 10 < 4 GROUP BY 1, 2, 3""")
def _(inp):
    rows = rasters.read_bands(write_cubes(inp)).where("(band = 5 OR band = 40) AND line < 4")
    rows = rows.select("cube_id", "band", "line", r(F.aggregate("data", lit(0.0), lambda s, v: s + v.cast("double")), 4).alias("total"))
    return rows.where("total > 0")


@query("src_08_list_files", f"SELECT concat('strip_', CAST(raster_id AS VARCHAR), '.IMG') AS name, CAST(5064 + lines * samples * 2 AS BIGINT) AS size FROM ({SIZES}) s")
def _(inp):
    from selenic.functions import text

    files = rasters.list_files(inp.spark, write_strips(inp), "*.IMG")
    return files.select(text.basename(c("path")).alias("name"), "size")


@query("src_04_geometry_grid", """
SELECT raster_id, round(z2 / 100, 6) + 0.0 AS lon_deg, round(z2 / 200, 6) + 0.0 AS lat_deg, col * 100 AS pixel, row * 100 AS scan FROM {fx:heights}""")
def _(inp):
    path = workdir(inp.spark, "grid")
    rows = inp.fx("heights").select(F.round(c("z2") / 100, 6).alias("Longitude"), F.round(c("z2") / 200, 6).alias("Latitude"),
                                    (c("col") * 100).alias("Pixel"), (c("row") * 100).alias("Scan"), "raster_id")
    rows.write.csv(path, header=True)
    return tables.read_geometry_grid(inp.spark, path, tables.GRID + ", raster_id long").withColumns(
        {"lon_deg": c("lon_deg") + 0.0, "lat_deg": c("lat_deg") + 0.0})


@query("src_05_sun_records", """
SELECT scene_id, round(abs(lat_deg), 3) AS phase, round(cell_m + 0.5, 3) AS aspect, round(lon_deg, 3) AS az, round(abs(lat_deg) / 2, 3) AS el, round(90 - round(abs(lat_deg) / 2, 3), 3) AS incidence FROM {fx:scenes}""")
def _(inp):
    s = inp.fx("scenes")
    line = F.concat_ws("  ", lit("REC 2021-04-01T23:57:37 1.5"), F.round(F.abs("lat_deg"), 3), F.round(c("cell_m") + 0.5, 3),
                       F.round("lon_deg", 3), F.round(F.abs("lat_deg") / 2, 3), lit("\n9.9 8.8"))
    rec = labels.parse_sun_records(s.select(c("scene_id").alias("path"), line.alias("text")))
    return rec.select(c("path").alias("scene_id"), c("phase_deg").alias("phase"), c("sun_aspect_deg").alias("aspect"),
                      c("sun_azimuth_deg").alias("az"), c("sun_elevation_deg").alias("el"), F.round("solar_incidence_deg", 3).alias("incidence"))


@query("src_06_envi_headers", "SELECT product_id, CAST(256 AS INT) AS bands, CAST(lines AS INT) AS lines, CAST(samples AS INT) AS samples FROM {fx:products}")
def _(inp):
    p = inp.fx("products")
    body = F.concat(lit("ENVI\nBands = 256\nLINES="), "lines", lit("\n samples   =  "), "samples", lit("\ninterleave = bsq\n"))
    return labels.parse_envi_headers(p.select(c("product_id").alias("path"), body.alias("text"))).withColumnRenamed("path", "product_id")


@query("src_07_json_documents", """
SELECT CAST(scene_id AS VARCHAR) AS scene_id, concat('scene_', CAST(scene_id AS VARCHAR)) AS folder, lat_deg + 0.0 AS lat, lon_deg AS lon, cell_m, CAST(NULL AS VARCHAR) AS tmc_status FROM {fx:scenes}""")
def _(inp):
    s = inp.fx("scenes").withColumn("id", c("scene_id").cast("string"))
    entry = F.struct(F.concat(lit("C:\\data\\scene_"), "id", lit("\\")).alias("dir"), c("id").alias("slug"), c("id").alias("name"),
                     lit("derived").alias("subtitle"), lit("user").alias("kind"))
    reg = tables.parse_registry(s.select(F.to_json(F.create_map("id", entry)).alias("text")))
    path = workdir(inp.spark, "docs")
    doc = s.select("id", c("id").alias("product_id"), F.struct(c("n"), c("cell_m").alias("cell_meters")).alias("analysis_grid"),
                   F.struct("lat_deg", "lon_deg").alias("source_footprint_center"))
    doc.write.json(path)
    meta = inp.spark.read.schema(tables.METADATA).json(path)
    return reg.join(meta, reg.scene_id == meta.product_id).select(
        "scene_id", "folder", (c("source_footprint_center.lat_deg") + 0.0).alias("lat"), c("source_footprint_center.lon_deg").alias("lon"),
        c("analysis_grid.cell_meters").alias("cell_m"), c("tmc_reference.status").alias("tmc_status"))


# ------------------------------------------------------------ sinks

@query("snk_01_append_results", "SELECT job_id, scene_id, stage, status FROM {fx:jobs}")
def _(inp):
    path = workdir(inp.spark, "jobs")
    jobs = inp.fx("jobs").select("job_id", "scene_id", "stage", "status")
    tables.append_results(jobs.where("status = 'failed'"), path)
    tables.append_results(jobs.where("status <> 'failed'"), path)
    return inp.spark.read.parquet(path)


@query("snk_02_upsert", """
SELECT product_id, src, prio, size FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY prio DESC) AS rn FROM {fx:sources}) q WHERE rn = 1""")
def _(inp):
    root, s = workdir(inp.spark, "scenes"), inp.fx("sources")
    table = None
    for n, src in enumerate(("tar", "zip", "dir")):
        table = tables.write_version(tables.upsert(table, s.where(c("src") == src), "product_id", "prio"), root, n)
    return table


@query("snk_02_upsert_log", """
SELECT product_id, src, prio, size FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY prio DESC) AS rn FROM {fx:sources}) q WHERE rn = 1""")
def _(inp):
    log, s = CatalogLog(inp.spark, workdir(inp.spark, "scene-log"), "product_id", "prio", buckets=8), inp.fx("sources")
    for n, src in enumerate(("tar", "zip", "dir")):
        log.upsert(s.where(c("src") == src))
        if n == 1:
            log.compact(n)
    return log.read().select("product_id", "src", "prio", "size")


@query("snk_03_scene_docs", "SELECT CAST(scene_id AS INT) AS scene_id, cand_id, radius_px FROM {fx:candidates}")
def _(inp):
    path = workdir(inp.spark, "craters")
    tables.write_scene_docs(inp.fx("candidates").select("scene_id", "cand_id", "radius_px"), path)
    return inp.spark.read.schema("cand_id long, radius_px double, scene_id int").json(path)


@query("snk_04_write_grid", """
SELECT CAST(raster_id AS INT) AS product_id, concat(CAST(raster_id * 100 AS VARCHAR), '_', CAST(raster_id * 7 AS VARCHAR)) AS geo_key, row, col,
  CASE WHEN raster_id % 2 = 0 THEN z2 + 1 ELSE z2 END AS z FROM {fx:heights}""")
def _(inp):
    path = workdir(inp.spark, "grids")
    h = inp.fx("heights").select(c("raster_id").alias("product_id"), F.format_string("%d_%d", c("raster_id") * 100, c("raster_id") * 7).alias("geo_key"),
                                 "row", "col", c("z2").alias("z"))
    tables.write_grid(h, path)
    # a second run replaces only the keys it writes
    tables.write_grid(h.where("product_id % 2 = 0").withColumn("z", c("z") + 1), path)
    return inp.spark.read.schema("row int, col int, z double, product_id int, geo_key string").parquet(path)


@query("snk_05_cap_payload", """
SELECT vec_id, label % 2 = 0 AS cached_trimmed, CAST(CASE WHEN label % 2 = 0 THEN 50 ELSE 64 END AS INT) AS n_kept, 50 AS n_stored FROM {embeddings}""")
def _(inp):
    e = inp.table("embeddings").select("vec_id", "embedding", F.when(c("label") % 2 == 0, F.repeat(lit("x"), 3000)).otherwise("").alias("pad"))
    cached = tables.cap_payload(e, ["embedding"], 50, 3000).select("vec_id", "cached_trimmed", F.size("embedding").alias("n_kept"))
    stored = tables.cap_payload(e.drop("pad"), ["embedding"], 50).select("vec_id", F.size("embedding").alias("n_stored"))
    return cached.join(stored, "vec_id")
