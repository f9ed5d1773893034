"""Raster queries: FIL, AGG, WIN, SRT and TIL over cell tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenic.functions import geo, predicates
from selenic.operators import cells as ops
from selenic.operators import kernels, tiles
from selenic.suite.registry import query, r

c, lit = F.col, F.lit
KEY = ["raster_id", "row", "col"]
DIMS = "SELECT raster_id, max(row) + 1 AS lines, max(col) + 1 AS samples FROM {fx:cells} GROUP BY raster_id"
DENSE = f"""dims AS ({DIMS}), dense AS (SELECT d.raster_id, d.lines, d.samples, y.row, x.col, coalesce(h.z, 0) AS z, coalesce(h.z2, 0) AS z2
  FROM dims d, LATERAL (SELECT unnest(range(0, d.lines)) AS row) y, LATERAL (SELECT unnest(range(0, d.samples)) AS col) x
  LEFT JOIN {{fx:heights}} h ON h.raster_id = d.raster_id AND h.row = y.row AND h.col = x.col)"""


@query("fil_01_mask_nodata", """
SELECT raster_id, row, col, CASE WHEN z = -32768 OR z <= -32000 THEN NULL ELSE z END AS z FROM {fx:cells}""")
def _(inp):
    return inp.fx("cells").select(*KEY, predicates.mask_nodata(c("z"), -32768.0).alias("z"))


@query("fil_02_strided", "SELECT raster_id, row, col, z FROM {fx:cells} WHERE row % 4 = 0 AND col % 4 = 0")
def _(inp):
    return inp.fx("cells").where(predicates.strided(c("row"), c("col"), 4)).select(*KEY, "z")


@query("fil_03_in_window", """
SELECT raster_id, row, col, z FROM {fx:cells} WHERE row >= 8 AND row < 40 AND col >= 16 AND col < 60""")
def _(inp):
    return inp.fx("cells").where(predicates.in_window(c("row"), c("col"), 8, 16, 40, 60)).select(*KEY, "z")


@query("fil_04_valid_range", """
SELECT raster_id, row, col, z > -5000 AND z < 12000 AS height_ok, abs(z) % 256 > 10 AND abs(z) % 256 < 245 AS browse_ok,
  abs(z) % 256 > 12 AS content FROM {fx:cells}""")
def _(inp):
    dn = F.abs("z") % 256
    return inp.fx("cells").select(*KEY, predicates.valid_height(c("z")).alias("height_ok"),
                                  predicates.valid_browse(dn).alias("browse_ok"), predicates.has_content(dn).alias("content"))


SUN = "cos(radians(30.0)) * sin(radians(250.0)) AS sx, -cos(radians(30.0)) * cos(radians(250.0)) AS sy, sin(radians(30.0)) AS sz"


@query("prj_11_lambert_slope", f"""
SELECT raster_id, row, col, round(sx * t, 6) + 0.0 AS p, round(sy * t, 6) + 0.0 AS q FROM (
  SELECT *, CASE WHEN z < greatest(3.0, p01) THEN 0 ELSE -greatest(-tan(radians(35.0)), least(tan(radians(35.0)),
    (z - a * sz) / (a * (sx * sx + sy * sy)))) END AS t
  FROM (SELECT h.*, p01, med / greatest(sz, 1e-6) AS a, sx, sy, sz FROM {{fx:heights}} h JOIN (
    SELECT raster_id, quantile_cont(z, 0.5) AS med, quantile_cont(z, 0.01) AS p01, {SUN} FROM {{fx:heights}} GROUP BY raster_id) s
    ON h.raster_id = s.raster_id WHERE z IS NOT NULL) q) q2""")
def _(inp):
    sun = geo.sun_vector(lit(250.0), lit(30.0))
    out = ops.lambert_slopes(inp.fx("heights").where("z is not null"), sun)
    return out.select(*KEY, r("p").alias("p"), r("q").alias("q"))


GRAD = """SELECT raster_id, row, col, z,
  CASE WHEN nc IS NULL AND pc IS NULL THEN NULL WHEN pc IS NULL THEN nz - z WHEN nc IS NULL THEN z - pz ELSE (nz - pz) / 2 END AS gx,
  CASE WHEN nr IS NULL AND pr IS NULL THEN NULL WHEN pr IS NULL THEN mz - z WHEN nr IS NULL THEN z - qz ELSE (mz - qz) / 2 END AS gy
FROM (SELECT *, lead(col) OVER rw AS nc, lag(col) OVER rw AS pc, lead(z) OVER rw AS nz, lag(z) OVER rw AS pz,
    lead(row) OVER cw AS nr, lag(row) OVER cw AS pr, lead(z) OVER cw AS mz, lag(z) OVER cw AS qz FROM {fx:heights}
  WINDOW rw AS (PARTITION BY raster_id, row ORDER BY col), cw AS (PARTITION BY raster_id, col ORDER BY row)) g"""


@query("win_04_gradient", f"SELECT raster_id, row, col, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy FROM ({GRAD}) g2")
def _(inp):
    return ops.gradient(inp.fx("heights")).select(*KEY, r("gx").alias("gx"), r("gy").alias("gy"))


@query("prj_12_hillshade", f"""
SELECT raster_id, row, col, round(b / (max(b) OVER (PARTITION BY raster_id) + 1e-8), 6) AS shade FROM (
  SELECT raster_id, row, col, 0.12::DOUBLE * ci / (ci + 1.0 + 1e-8) AS b FROM (
    SELECT *, greatest(0.0, least(1.0, (-gx / 500 * sx - gy / 500 * sy + sz) / (sqrt(power(gx / 500, 2) + power(gy / 500, 2) + 1) + 1e-8))) AS ci
    FROM (SELECT *, {SUN} FROM ({GRAD}) g2 WHERE gx IS NOT NULL AND gy IS NOT NULL) g3) g4) g5""")
def _(inp):
    out = ops.hillshade(inp.fx("heights"), lit(250.0), lit(30.0), cell_m=500.0)
    return out.where("shade is not null").select(*KEY, r("shade").alias("shade"))


@query("prj_19_stretch_u8", """
SELECT h.raster_id, row, col, CAST(trunc(greatest(0.0, least(255.0, (z - lo1) / (hi1 - lo1 + 1e-9) * 255.0))) AS INT) AS dn,
  CAST(trunc(greatest(0.0, least(255.0, g + 128.0 - avg(g) OVER (PARTITION BY h.raster_id)))) AS INT) AS dn_centred
FROM (SELECT *, (z - lo2) * least(255.0 / (hi2 - lo2), 1.7) AS g FROM {fx:heights} JOIN (
  SELECT raster_id AS rid, quantile_cont(z, 0.01) AS lo1, quantile_cont(z, 0.99) AS hi1, quantile_cont(z, 0.02) AS lo2, quantile_cont(z, 0.98) AS hi2
  FROM {fx:heights} GROUP BY raster_id) s ON raster_id = rid WHERE z IS NOT NULL) h""")
def _(inp):
    x = inp.fx("heights").where("z is not null")
    return ops.stretch_centred(ops.stretch(x).withColumnRenamed("dn", "dn1")).select(
        *KEY, c("dn1").alias("dn"), c("dn").alias("dn_centred"))


@query("agg_01_mutual_information", """
WITH b AS (SELECT h.raster_id, CAST(trunc((z - z0) / (z1 - z0 + 1e-9) * 31) AS INT) AS i, CAST(trunc((z2 - y0) / (y1 - y0 + 1e-9) * 31) AS INT) AS j
  FROM {fx:heights} h JOIN (SELECT raster_id, min(z) AS z0, max(z) AS z1, min(z2) AS y0, max(z2) AS y1 FROM {fx:heights} WHERE z IS NOT NULL GROUP BY raster_id) s
  ON h.raster_id = s.raster_id WHERE z IS NOT NULL),
n AS (SELECT raster_id, i, j, count(*)::DOUBLE AS n FROM b GROUP BY ALL)
SELECT raster_id, round(sum(n / t * ln(n * t / (ni * nj))), 6) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY raster_id) AS t,
  sum(n) OVER (PARTITION BY raster_id, i) AS ni, sum(n) OVER (PARTITION BY raster_id, j) AS nj FROM n) q GROUP BY raster_id""")
def _(inp):
    pairs = inp.fx("heights").select("raster_id", c("z").alias("a"), c("z2").alias("b"))
    return ops.mutual_information(pairs, 32).withColumn("mi", r("mi"))


CORR = """SELECT raster_id, round(CASE WHEN stddev_pop(a) <= 1e-6 OR stddev_pop(b) <= 1e-6 THEN 0 ELSE corr(a, b) END, 6) + 0.0 AS r,
  round(avg(abs(a - b)), 6) AS mae, round(max(abs(a - b)), 6) AS max_dev, count(*) AS n
FROM (SELECT h.raster_id, (z - z0) / (z1 - z0) AS a, (z2 - y0) / (y1 - y0) AS b FROM {fx:heights} h JOIN (
  SELECT raster_id, min(z) AS z0, max(z) AS z1, min(z2) AS y0, max(z2) AS y1 FROM {fx:heights} WHERE z IS NOT NULL GROUP BY raster_id) s
  ON h.raster_id = s.raster_id WHERE z IS NOT NULL) q GROUP BY raster_id"""


@query("agg_02_grid_correlation", CORR)
def _(inp):
    pairs = inp.fx("heights").select("raster_id", c("z").alias("a"), c("z2").alias("b"))
    return ops.grid_correlation(pairs).select("raster_id", r("r").alias("r"), r("mae").alias("mae"), r("max_dev").alias("max_dev"), "n")


@query("agg_03_robust_stats", """
SELECT raster_id, round(min(z), 6) AS zmin, round(max(z), 6) AS zmax, round(stddev_pop(z), 6) AS sd, round(quantile_cont(z, 0.01), 6) AS p01,
  round(quantile_cont(z, 0.02), 6) AS p02, round(quantile_cont(z, 0.5), 6) AS median, round(quantile_cont(z, 0.98), 6) AS p98,
  round(quantile_cont(z, 0.99), 6) AS p99 FROM {fx:heights} GROUP BY raster_id""")
def _(inp):
    s = ops.robust_stats(inp.fx("heights"))
    return s.select("raster_id", *[r(k).alias(k) for k in ("zmin", "zmax", "sd", "p01", "p02", "median", "p98", "p99")])


BLOCKS = f"""SELECT raster_id, row, col, z - min(z) OVER (PARTITION BY raster_id) AS z FROM (
  SELECT h.raster_id, CAST(row * 16 // lines AS INT) AS row, CAST(col * 16 // samples AS INT) AS col,
    CASE WHEN count(z) / count(*)::DOUBLE < 1e-3 THEN 0 ELSE sum(z) / count(z) END AS z
  FROM {{fx:heights}} h JOIN ({DIMS}) d ON h.raster_id = d.raster_id GROUP BY 1, 2, 3) g"""


@query("agg_04_block_average", f"SELECT raster_id, row, col, round(z, 9) AS z FROM ({BLOCKS}) b")
def _(inp):
    return ops.block_average(ops.frames(inp.fx("heights")), 16).withColumn("z", r("z", 9))


@query("agg_05_best_variance_window", f"""
SELECT raster_id, r0, c0, round(sd, 6) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY sd DESC, i, j) AS rn FROM (
  SELECT h.raster_id, i, j, r0, c0, stddev_pop(z) AS sd FROM {{fx:heights}} h JOIN (
    SELECT raster_id, i, j, CAST(trunc(greatest(0, lines - 32) * i / 4.0) AS INT) AS r0, CAST(trunc(greatest(0, samples - 32) * j / 1.0) AS INT) AS c0
    FROM ({DIMS}) d, (VALUES (0), (1), (2), (3), (4)) a(i), (VALUES (0), (1)) b(j)) w
  ON h.raster_id = w.raster_id AND row >= r0 AND row < r0 + 32 AND col >= c0 AND col < c0 + 32 AND (row - r0) % 4 = 0 AND (col - c0) % 4 = 0
  GROUP BY ALL) q WHERE sd IS NOT NULL) q2 WHERE rn = 1""")
def _(inp):
    return ops.best_variance_window(ops.frames(inp.fx("heights")), 32).withColumn("sd", r("sd"))


@query("agg_06_valid_fraction", """
SELECT raster_id * 100 + k AS window_id, round(avg(CASE WHEN z % 100 < 70 THEN 1 ELSE 0 END), 6) AS valid_fraction
FROM {fx:heights} h JOIN (SELECT DISTINCT raster_id AS rid, k FROM {fx:cells}, (SELECT unnest(range(0, 9)) AS k) g) w
ON raster_id = rid AND row >= k * 5 AND row < k * 5 + 17 AND col >= k * 3 AND col < k * 3 + 29 GROUP BY 1""")
def _(inp):
    h = inp.fx("heights")
    k = F.explode(F.sequence(lit(0), lit(8))).alias("k")
    w = h.select("raster_id").distinct().select("raster_id", k).select(
        (c("raster_id") * 100 + c("k")).alias("window_id"), "raster_id", (c("k") * 5).alias("r0"), (c("k") * 3).alias("c0"),
        (c("k") * 5 + 17).alias("r1"), (c("k") * 3 + 29).alias("c1"))
    return ops.valid_fraction(h, w, c("z") % 100 < 70, tile=16).withColumn("valid_fraction", r("valid_fraction"))


@query("agg_07_valid_bbox", """
WITH v AS (SELECT raster_id, row, col, CASE WHEN z > 1500 + (row % 9) * 150 AND col > 3 AND row > 4 THEN 1 ELSE 0 END AS v FROM {fx:heights}),
f AS (SELECT raster_id, max(row) + 1 AS lines, max(col) + 1 AS samples, avg(v) AS share FROM v GROUP BY raster_id),
rs AS (SELECT raster_id, min(row) AS y0, max(row) + 1 AS y1, count(*) AS n FROM (
  SELECT v.raster_id, row FROM v JOIN f ON v.raster_id = f.raster_id GROUP BY v.raster_id, row, samples HAVING sum(v) > samples * 0.25) a GROUP BY raster_id),
cs AS (SELECT raster_id, min(col) AS x0, max(col) + 1 AS x1, count(*) AS n FROM (
  SELECT v.raster_id, col FROM v JOIN f ON v.raster_id = f.raster_id GROUP BY v.raster_id, col, lines HAVING sum(v) > lines * 0.25) a GROUP BY raster_id)
SELECT raster_id, CASE WHEN whole THEN 0 ELSE x0 END AS x0, CASE WHEN whole THEN samples ELSE x1 END AS x1,
  CASE WHEN whole THEN 0 ELSE y0 END AS y0, CASE WHEN whole THEN lines ELSE y1 END AS y1 FROM (
  SELECT f.raster_id, lines, samples, x0, x1, y0, y1, share >= 0.97 OR coalesce(rs.n, 0) < 8 OR coalesce(cs.n, 0) < 8 AS whole
  FROM f LEFT JOIN rs ON f.raster_id = rs.raster_id LEFT JOIN cs ON f.raster_id = cs.raster_id) q""")
def _(inp):
    return ops.valid_bbox(inp.fx("heights"), (c("z") > 1500 + (c("row") % 9) * 150) & (c("col") > 3) & (c("row") > 4))


@query("agg_07_content_square", """
SELECT raster_id, CASE WHEN w THEN 0 ELSE sr END AS r0, CASE WHEN w THEN 0 ELSE sc END AS c0,
  CASE WHEN w THEN h ELSE least(h, sr + side) END AS r1, CASE WHEN w THEN wd ELSE least(wd, sc + side) END AS c1 FROM (
  SELECT *, greatest(0, least((r0 + r1) // 2 - side // 2, h - side)) AS sr, greatest(0, least((c0 + c1) // 2 - side // 2, wd - side)) AS sc FROM (
    SELECT *, CAST(trunc(greatest(r1 - r0, c1 - c0) * 1.6) AS INT) + 8 AS side, share > 0.5 OR n < 400 AS w FROM (
      SELECT raster_id, max(row) + 1 AS h, max(col) + 1 AS wd, avg(CASE WHEN v THEN 1 ELSE 0 END) AS share, count(*) FILTER (WHERE v) AS n,
        min(row) FILTER (WHERE v) AS r0, max(row) FILTER (WHERE v) + 1 AS r1, min(col) FILTER (WHERE v) AS c0, max(col) FILTER (WHERE v) + 1 AS c1
      FROM (SELECT *, coalesce(z > 500 AND row BETWEEN 20 AND 40 AND col BETWEEN 30 AND 55, false) AS v FROM {fx:heights}) a GROUP BY raster_id) b) d) e""")
def _(inp):
    inside = c("row").between(20, 40) & c("col").between(30, 55)
    return ops.content_square(inp.fx("heights"), (c("z") > 500) & inside)


@query("agg_08_template_ncc", f"""
WITH {DENSE}, t AS (SELECT raster_id, row - 16 AS tr, col - 16 AS tc, z2 FROM dense WHERE row BETWEEN 16 AND 39 AND col BETWEEN 16 AND 47),
td AS (SELECT raster_id, max(tr) + 1 AS th, max(tc) + 1 AS tw FROM t GROUP BY raster_id)
SELECT raster_id, row, col, round(ncc, 4) AS ncc FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY ncc DESC, row, col) AS rn FROM (
  SELECT d.raster_id, d.row - tr AS row, d.col - tc AS col, corr(d.z, t.z2) AS ncc FROM dense d JOIN td ON d.raster_id = td.raster_id
  JOIN t ON t.raster_id = d.raster_id AND d.row - tr >= 0 AND d.row - tr <= lines - th AND d.col - tc >= 0 AND d.col - tc <= samples - tw
  GROUP BY 1, 2, 3) q) q2 WHERE rn = 1""")
def _(inp):
    h = inp.fx("heights")
    tpl = h.where(predicates.in_window(c("row"), c("col"), 16, 16, 40, 48)).select(*KEY, c("z2").alias("z"))
    return kernels.template_ncc(tpl, h.select(*KEY, "z")).withColumn("ncc", r("ncc", 4))


def _area_sql(sizes: str) -> str:
    """Shares of input cells in output cells for each pair of sizes (n, m)."""
    lo, hi = "greatest(o * (n::DOUBLE / m), i)", "least((o + 1) * (n::DOUBLE / m), i + 1)"
    return (f"SELECT n, m, CAST(o AS INT) AS o, CAST(i AS INT) AS i, ({hi} - {lo}) * (m::DOUBLE / n) AS w FROM ({sizes}) s, "
            f"LATERAL (SELECT unnest(range(0, m)) AS o) a, LATERAL (SELECT unnest(range(0, n)) AS i) b WHERE {hi} > {lo}")


def _resized_sql(source: str, key: str) -> str:
    """``source`` (key, row, col, z, h, w, h2, w2) resized by area, the new sizes as h and w."""
    wide = (f"SELECT {key}, row, t.o AS col, h, h2, w2, sum(z * t.w) AS z FROM {source} s JOIN area t ON t.n = s.w AND t.m = w2 AND t.i = col GROUP BY {key}, row, t.o, h, h2, w2")
    return (f"SELECT {key}, t.o AS row, col, h2 AS h, w2 AS w, sum(z * t.w) AS z FROM ({wide}) q JOIN area t ON t.n = h AND t.m = h2 AND t.i = row GROUP BY {key}, t.o, col, h2, w2")


SIZE0 = "CAST(greatest(8, round({0} * 0.9::DOUBLE)) AS INT)"


@query("agg_10_scale_sweep", f"""
WITH {DENSE}, fac AS (SELECT CAST(f AS DOUBLE) AS factor, ord FROM (VALUES (1.0, 0), (0.8, 1), (1.25, 2), (0.63, 3), (1.58, 4), (0.5, 5), (2.0, 6), (0.4, 7), (2.5, 8)) t(f, ord)),
d0 AS (SELECT raster_id, lines AS h, samples AS w, {SIZE0.format('lines')} AS h2, {SIZE0.format('samples')} AS w2 FROM dims),
d1 AS (SELECT raster_id, factor, ord, h2 AS h, w2 AS w, CAST(greatest(8, floor(h2 * factor)) AS INT) AS h2, CAST(greatest(8, floor(w2 * factor)) AS INT) AS w2 FROM d0, fac),
area AS ({_area_sql("SELECT h AS n, h2 AS m FROM d0 UNION SELECT w, w2 FROM d0 UNION SELECT h, h2 FROM d1 UNION SELECT w, w2 FROM d1")}),
s0 AS (SELECT dense.raster_id, row, col, z, h, w, h2, w2 FROM dense JOIN d0 ON dense.raster_id = d0.raster_id),
base AS ({_resized_sql("s0", "raster_id")}),
s1 AS (SELECT b.raster_id, factor, ord, row, col, z, b.h, b.w, h2, w2 FROM base b JOIN d1 ON b.raster_id = d1.raster_id),
body AS ({_resized_sql("s1", "raster_id, factor, ord")}),
t AS (SELECT d1.raster_id, factor, ord, lines, samples, h2, w2, CAST(least(h2 // 2 * 2, lines // 2 * 2, w2 // 2 * 2, samples // 2 * 2) AS INT) AS t FROM d1 JOIN dims ON d1.raster_id = dims.raster_id),
tpl AS (SELECT b.raster_id, b.factor, b.ord, t, lines, samples, row - (h2 - t) // 2 AS tr, col - (w2 - t) // 2 AS tc, z FROM body b JOIN t ON b.raster_id = t.raster_id AND b.factor = t.factor
  WHERE t >= 16 AND row >= (h2 - t) // 2 AND row < (h2 - t) // 2 + t AND col >= (w2 - t) // 2 AND col < (w2 - t) // 2 + t),
place AS (SELECT tpl.raster_id, factor, ord, t, tpl.lines, tpl.samples, d.row - tr AS y, d.col - tc AS x, corr(d.z, tpl.z) AS ncc FROM tpl JOIN dense d ON d.raster_id = tpl.raster_id
  AND d.row >= tr AND d.row <= tpl.lines - t + tr AND d.col >= tc AND d.col <= tpl.samples - t + tc GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY raster_id, factor ORDER BY round(ncc, 9) DESC, y, x) AS k FROM place)
SELECT dims.raster_id, factor, round(ncc, 4) AS ncc, CAST(x - (b.samples - t) // 2 AS INT) AS dx, CAST(y - (b.lines - t) // 2 AS INT) AS dy, 0.5::DOUBLE / factor AS gsd_m
FROM dims LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY round(ncc, 9) DESC, ord) AS rn FROM best WHERE k = 1) b ON b.raster_id = dims.raster_id AND rn = 1
WHERE rn = 1 OR rn IS NULL""")
def _(inp):
    h = inp.fx("heights").select(*KEY, "z")
    return kernels.scale_sweep(h, h, base_scale=0.9, min_overlap=16, max_tpl=None, floor=8).withColumn("ncc", r("ncc", 4))


@query("agg_11_class_histogram", """
WITH n AS (SELECT raster_id, CAST(floor(z) % 6 AS INT) AS k, count(*) AS n FROM {fx:heights} WHERE z IS NOT NULL GROUP BY ALL)
SELECT raster_id, string_agg(concat(CAST(k AS VARCHAR), ':', CAST(n AS VARCHAR)), ',' ORDER BY k) AS counts, arg_max(k, n * 10 - k) AS majority
FROM n GROUP BY raster_id""")
def _(inp):
    x = inp.fx("heights").where("z is not null").withColumn("class_id", (F.floor("z") % 6).cast("int"))
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return ops.class_histogram(x).select("raster_id", F.array_join(pairs, ",").alias("counts"), "majority")


@query("agg_12_clamp_plateau", """
WITH g AS (SELECT raster_id, row, col, least(z, 3800) AS z FROM {fx:heights} WHERE z IS NOT NULL),
m AS (SELECT raster_id, max(z) AS hi, count(*) AS n FROM g GROUP BY raster_id),
t AS (SELECT g.raster_id, row, col, n FROM g JOIN m ON g.raster_id = m.raster_id WHERE z >= hi - 0.25),
f AS (SELECT raster_id, n FROM t GROUP BY raster_id, n HAVING count(*) > n * 0.01),
d AS (SELECT DISTINCT t.raster_id, t.row + i AS row, t.col + j AS col, t.n FROM t JOIN f ON t.raster_id = f.raster_id,
  (SELECT unnest(range(-3, 4)) AS i) a, (SELECT unnest(range(-3, 4)) AS j) b)
SELECT d.raster_id, d.row, d.col, round(count(*) OVER (PARTITION BY d.raster_id) / d.n::DOUBLE, 6) AS share
FROM d JOIN g ON d.raster_id = g.raster_id AND d.row = g.row AND d.col = g.col""")
def _(inp):
    g = inp.fx("heights").where("z is not null").select(*KEY, F.least("z", lit(3800.0)).alias("z"))
    return ops.clamp_plateau(g).withColumn("share", r("share"))


@query("agg_14_gradient_consistency", """
WITH g AS (SELECT raster_id, row, col, z / 5000 AS a, z2 / 9000 AS b FROM {fx:heights}), d AS (SELECT raster_id, max(row) + 1 AS h, max(col) + 1 AS w FROM g GROUP BY raster_id),
k AS (SELECT * FROM (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) v(dr, dc, kx, ky)),
s AS (SELECT g.raster_id, g.row, g.col, g.a AS a0, g.b AS b0, sum(n.a * kx) AS ax, sum(n.a * ky) AS ay, count(n.a) AS na, sum(n.b * kx) AS bx, sum(n.b * ky) AS by_, count(n.b) AS nb
  FROM g JOIN d ON g.raster_id = d.raster_id CROSS JOIN k
  JOIN g n ON n.raster_id = g.raster_id AND n.row = CASE WHEN g.row + dr < 0 THEN -(g.row + dr) WHEN g.row + dr >= h THEN 2 * h - 2 - (g.row + dr) ELSE g.row + dr END
    AND n.col = CASE WHEN g.col + dc < 0 THEN -(g.col + dc) WHEN g.col + dc >= w THEN 2 * w - 2 - (g.col + dc) ELSE g.col + dc END GROUP BY ALL)
SELECT raster_id, CASE WHEN count(*) > 100 THEN round(corr(ma, mb), 6) + 0.0 END AS gradient_corr, count(*) AS n FROM (
  SELECT raster_id, CASE WHEN na = 8 AND g_ok THEN sqrt(ax * ax + ay * ay) END AS ma, CASE WHEN nb = 8 THEN sqrt(bx * bx + by_ * by_) END AS mb
  FROM (SELECT *, true AS g_ok FROM s WHERE a0 > 0.02 AND b0 > 0.02) s2) q GROUP BY raster_id""")
def _(inp):
    g = inp.fx("heights").select(*KEY, (c("z") / 5000).alias("a"), (c("z2") / 9000).alias("b"))
    return kernels.gradient_consistency(g, min_cells=100).withColumn("gradient_corr", r("gradient_corr"))


@query("agg_16_contour_levels", """
SELECT raster_id, CAST(k AS INT) AS level_no, round(min(z) + (max(z) - min(z)) * k / 9, 6) AS level FROM {fx:heights}, (SELECT unnest(range(1, 9)) AS k) g GROUP BY raster_id, k""")
def _(inp):
    return ops.contour_levels(inp.fx("heights")).withColumn("level", r("level"))


REFL = "CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"


SMOOTH = f"""
WITH d AS ({DIMS}), w AS (SELECT o, exp(-0.5 * power(o / 1.2::DOUBLE, 2)) AS w FROM (SELECT unnest(range(-5, 6)) AS o) g),
cx AS (SELECT raster_id, t, w, {REFL.format(i='t + o', n='samples')} AS src FROM d, LATERAL (SELECT unnest(range(0, samples)) AS t) g, w),
cy AS (SELECT raster_id, t, w, {REFL.format(i='t + o', n='lines')} AS src FROM d, LATERAL (SELECT unnest(range(0, lines)) AS t) g, w),
a AS (SELECT h.raster_id, h.row, cx.t AS col, sum(w * z) AS num, sum(w) AS den FROM {{fx:heights}} h JOIN cx ON cx.raster_id = h.raster_id AND cx.src = h.col WHERE z IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT a.raster_id, cy.t AS row, a.col, sum(w * num) / sum(w * den) AS z FROM a JOIN cy ON cy.raster_id = a.raster_id AND cy.src = a.row GROUP BY 1, 2, 3)
SELECT h.raster_id, h.row, h.col, round(b.z, 6) AS z FROM {{fx:heights}} h JOIN b ON b.raster_id = h.raster_id AND b.row = h.row AND b.col = h.col"""


@query("win_05_gaussian_smooth", SMOOTH)
def _(inp):
    return kernels.gaussian_smooth(inp.fx("heights"), 1.2, tile=32).withColumn("z", r("z"))


QUAD = """SELECT a.raster_id, a.row, a.col, a.z AS z00, b.z AS z01, d.z AS z11, e.z AS z10 FROM {fx:heights} a
  JOIN {fx:heights} b ON b.raster_id = a.raster_id AND b.row = a.row AND b.col = a.col + 1
  JOIN {fx:heights} d ON d.raster_id = a.raster_id AND d.row = a.row + 1 AND d.col = a.col + 1
  JOIN {fx:heights} e ON e.raster_id = a.raster_id AND e.row = a.row + 1 AND e.col = a.col
  WHERE a.z IS NOT NULL AND b.z IS NOT NULL AND d.z IS NOT NULL AND e.z IS NOT NULL"""


@query("joi_13_neighbours", f"SELECT raster_id, row, col, round(z00 + 2 * z01 + 3 * z11 + 4 * z10, 6) AS mix FROM ({QUAD}) q")
def _(inp):
    q = ops.corner_heights(inp.fx("heights"))
    return q.select(*KEY, r(c("z00") + 2 * c("z01") + 3 * c("z11") + 4 * c("z10")).alias("mix"))


def contour_sql(quad: str, levels: str) -> str:
    return f"""SELECT raster_id, level_no, p[1].x AS x1, p[1].y AS y1, p[2].x AS x2, p[2].y AS y2 FROM (
  SELECT raster_id, level_no, list_filter([
    CASE WHEN (a < 0) <> (b < 0) THEN {{'x': col + a / (a - b), 'y': row + 0.0::DOUBLE}} END, CASE WHEN (b < 0) <> (d < 0) THEN {{'x': col + 1.0::DOUBLE, 'y': row + b / (b - d)}} END,
    CASE WHEN (d < 0) <> (e < 0) THEN {{'x': col + 1 - d / (d - e), 'y': row + 1.0::DOUBLE}} END, CASE WHEN (e < 0) <> (a < 0) THEN {{'x': col + 0.0::DOUBLE, 'y': row + 1 - e / (e - a)}} END],
    lambda s: s IS NOT NULL) AS p FROM (SELECT q.raster_id, row, col, level_no, z00 - level AS a, z01 - level AS b, z11 - level AS d, z10 - level AS e
    FROM ({quad}) q JOIN ({levels}) l ON q.raster_id = l.raster_id) z) z2 WHERE len(p) >= 2"""


LEVELS = "SELECT raster_id, CAST(k AS INT) AS level_no, min(z) + (max(z) - min(z)) * k / 9 AS level FROM {fx:heights}, (SELECT unnest(range(1, 9)) AS k) g GROUP BY raster_id, k"


@query("win_08_contours", f"""
SELECT raster_id, level_no, round(x1, 5) AS x1, round(y1, 5) AS y1, round(x2, 5) AS x2, round(y2, 5) AS y2 FROM ({contour_sql(QUAD, LEVELS)}) s""")
def _(inp):
    h = inp.fx("heights")
    s = ops.contours(h, ops.contour_levels(h))
    return s.select("raster_id", "level_no", *[r(k, 5).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("win_09_normalise", """
SELECT raster_id, row, col, round((z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w + 1e-9), 6) AS z FROM {fx:heights} WINDOW w AS (PARTITION BY raster_id)""")
def _(inp):
    return ops.normalise(inp.fx("heights").select(*KEY, "z")).withColumn("z", r("z"))


@query("joi_07_grid_join", "SELECT raster_id, row, col, round(z - z2, 6) + 0.0 AS diff FROM {fx:heights} WHERE z IS NOT NULL")
def _(inp):
    h = inp.fx("heights")
    a, b = h.where("z is not null").select(*KEY, "z"), h.select(*KEY, "z2")
    return ops.grid_join(a, b).select(*KEY, r(c("z") - c("z2")).alias("diff"))


FULL = "SELECT raster_id AS rid, CAST(max(row) + 1 AS INT) AS lines FROM {fx:cells} GROUP BY raster_id"
REQ = f"""SELECT rid * 1000000 + (r0 // 3) * 1000 + c0 // 3 AS request_id, rid, lines, CAST(r0 AS INT) AS r0, CAST(c0 AS INT) AS c0
  FROM (SELECT rid, lines, unnest(range(0, lines - 3, 3)) AS r0 FROM ({FULL}) f) a, (SELECT unnest(range(0, 61, 3)) AS c0) g"""


def _requests(inp, size: int, step: int = 3):
    """A window every few rows and columns of the whole raster."""
    full = inp.fx("cells").groupBy("raster_id").agg((F.max("row") + 1).cast("int").alias("lines")).where(c("lines") >= size)
    k = full.withColumn("r0", F.explode(F.sequence(lit(0), c("lines") - size, lit(step)))).withColumn("c0", F.explode(F.sequence(lit(0), lit(64 - size), lit(step))))
    number = c("raster_id") * 1000000 + F.floor(c("r0") / step) * 1000 + F.floor(c("c0") / step)
    return k.select(number.alias("request_id"), "raster_id", "r0", "c0", (c("r0") + size).alias("r1"),
                    (c("c0") + size).alias("c1"), "lines", lit(64).alias("samples"))


@query("srt_04_nearest_valid_window", f"""
WITH req AS ({REQ}), v AS (SELECT raster_id, row, col, CASE WHEN z % 100 < 70 THEN 1 ELSE 0 END AS v FROM {{fx:heights}}),
base AS (SELECT request_id, rid, lines, r0, c0, sum(v) / 16.0 AS share FROM req JOIN v ON v.raster_id = rid AND row >= r0 AND row < r0 + 4 AND col >= c0 AND col < c0 + 4 GROUP BY ALL),
o AS (SELECT CAST(i * a AS INT) AS dr, CAST(j * b AS INT) AS dc, (i * 100 + j) * 4 + k AS ord FROM (SELECT unnest(range(1, 13)) AS i) x, (SELECT unnest(range(1, 13)) AS j) y,
  (VALUES (0, 1, 1), (1, -1, 1), (2, 1, -1), (3, -1, -1)) s(k, a, b)),
tried AS (SELECT request_id, r0 + dr AS r0, c0 + dc AS c0, dr, dc, ord, sum(v) / 16.0 AS share FROM (SELECT * FROM base WHERE share < 0.5) p, o
  JOIN v ON v.raster_id = rid AND row >= r0 + dr AND row < r0 + dr + 4 AND col >= c0 + dc AND col < c0 + dc + 4
  WHERE r0 + dr >= 0 AND c0 + dc >= 0 AND r0 + dr + 4 <= lines AND c0 + dc + 4 <= 64 GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY dr * dr + dc * dc, ord) AS rn FROM tried WHERE share >= 0.9) q WHERE rn = 1)
SELECT request_id, r0, c0, r0 + 4 AS r1, c0 + 4 AS c1, 0.0::DOUBLE AS offset_km, 'exact' AS status FROM base WHERE share >= 0.5
UNION ALL SELECT b.request_id, coalesce(s.r0, -1), coalesce(s.c0, -1), coalesce(s.r0 + 4, -1), coalesce(s.c0 + 4, -1), round(sqrt(power(dr * 500.0, 2) + power(dc * 500.0, 2)) / 1000, 6),
  CASE WHEN s.request_id IS NULL THEN 'no_valid_data' ELSE 'moved' END FROM base b LEFT JOIN best s ON b.request_id = s.request_id WHERE b.share < 0.5""")
def _(inp):
    req = _requests(inp, 4).withColumn("gsd_m", lit(500.0))
    sat = ops.summed_area(inp.fx("heights"), c("z") % 100 < 70, ops.search_reach(req))
    out = ops.nearest_valid_window(sat, req).withColumn("offset_km", r("offset_km"))
    return out.fillna(-1, ["r0", "c0", "r1", "c1"])


@query("srt_05_densest_window", f"""
WITH req AS (SELECT request_id, rid, lines, r0 AS cy, c0 AS cx FROM ({REQ}) r1),
v AS (SELECT raster_id, row, col, CASE WHEN z % 100 < 55 THEN 1 ELSE 0 END AS v FROM {{fx:heights}}),
base AS (SELECT request_id, rid, lines, cx, cy, sum(v) / ((least(lines, cy + 4) - greatest(0, cy - 4)) * (least(64, cx + 4) - greatest(0, cx - 4)))::DOUBLE AS share
  FROM req JOIN v ON v.raster_id = rid AND row >= cy - 4 AND row < least(lines, cy + 4) AND col >= cx - 4 AND col < cx + 4 GROUP BY request_id, rid, lines, cx, cy),
o AS (SELECT 0.1::DOUBLE + 0.8::DOUBLE * i / 5 AS fy, 0.1::DOUBLE + 0.8::DOUBLE * j / 5 AS fx, i * 6 + j AS ord FROM (SELECT unnest(range(0, 6)) AS i) x, (SELECT unnest(range(0, 6)) AS j) y),
tried AS (SELECT DISTINCT rid, lines, CAST(trunc(64 * fx) AS INT) AS gx, CAST(trunc(lines * fy) AS INT) AS gy, ord FROM base, o WHERE share < 0.6),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY share DESC, ord) AS rn FROM (
  SELECT rid, gx, gy, ord, sum(v) / ((least(lines, gy + 4) - greatest(0, gy - 4)) * (least(64, gx + 4) - greatest(0, gx - 4)))::DOUBLE AS share
  FROM tried JOIN v ON v.raster_id = rid AND row >= gy - 4 AND row < least(lines, gy + 4) AND col >= gx - 4 AND col < gx + 4 GROUP BY rid, gx, gy, ord, lines) q) q2 WHERE rn = 1)
SELECT request_id, cx, cy, round(share, 6) AS valid_fraction FROM base WHERE share >= 0.6
UNION ALL SELECT b.request_id, gx, gy, round(s.share, 6) FROM base b JOIN best s ON b.rid = s.rid WHERE b.share < 0.6""")
def _(inp):
    req = _requests(inp, 4).select("request_id", "raster_id", c("r0").alias("cy"), c("c0").alias("cx"), lit(4).alias("half"), lit(0).alias("x0"),
                                   lit(64).alias("x1"), lit(0).alias("y0"), c("lines").alias("y1"), "lines", "samples")
    whole = req.select("raster_id", lit(0).alias("r0"), lit(0).alias("c0"), c("lines").alias("r1"), c("samples").alias("c1"))
    sat = ops.summed_area(inp.fx("heights"), c("z") % 100 < 55, whole)
    return ops.densest_window(sat, req).withColumn("valid_fraction", r("valid_fraction"))


@query("til_01_inpaint", """
WITH RECURSIVE d AS (SELECT raster_id, max(row) + 1 AS h, max(col) + 1 AS w FROM {fx:heights} GROUP BY 1),
v AS (SELECT raster_id, row, col, z FROM {fx:heights} WHERE z IS NOT NULL),
frame AS (SELECT raster_id, row, col FROM d, LATERAL (SELECT unnest(range(0, h)) AS row) a, LATERAL (SELECT unnest(range(0, w)) AS col) b),
hole AS MATERIALIZED (SELECT f.raster_id, f.row, f.col, min(abs(f.row - v.row) + abs(f.col - v.col)) AS k FROM (
  SELECT * FROM frame ANTI JOIN v USING (raster_id, row, col)) f JOIN v ON v.raster_id = f.raster_id GROUP BY 1, 2, 3),
ring AS (SELECT raster_id, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, z, CAST(0 AS BIGINT) AS k FROM v
  UNION ALL SELECT h.raster_id, h.row, h.col, avg(r.z), h.k FROM ring r JOIN hole h ON h.raster_id = r.raster_id AND h.k = r.k + 1
    AND abs(h.row - r.row) + abs(h.col - r.col) = 1 GROUP BY h.raster_id, h.row, h.col, h.k)
SELECT c.raster_id, c.row, c.col, round(coalesce(ring.z, 0), 6) + 0.0 AS z FROM {fx:heights} c LEFT JOIN ring ON ring.raster_id = c.raster_id AND ring.row = c.row AND ring.col = c.col""")
def _(inp):
    return kernels.inpaint(inp.fx("heights")).withColumn("z", r("z"))


@query("til_02_poisson_integrate")
def _(inp):
    s = ops.lambert_slopes(inp.fx("heights"), geo.sun_vector(lit(250.0), lit(30.0)))
    return kernels.poisson_integrate(s).withColumn("z", r("z"))


def _dirichlet(i: str, j: str, n: str) -> str:
    m = f"greatest(4, CAST(floor({n} * 0.18) AS INT) // 2)"
    return f"SELECT raster_id, {n} AS n, i, j, sum(cos(2 * pi() * f * (i - j) / {n})) / {n} AS re, sum(sin(2 * pi() * f * (i - j) / {n})) / {n} AS im FROM (" \
           f"SELECT raster_id, {n}, i, j, f FROM dims, LATERAL (SELECT unnest(range(0, {n})) AS i) a, LATERAL (SELECT unnest(range(0, {n})) AS j) b, " \
           f"LATERAL (SELECT unnest(range(0, {n})) AS f) e WHERE f < {m} OR f >= {n} - {m}) q GROUP BY raster_id, {n}, i, j"


@query("til_03_fourier_lowpass", f"""
WITH dims AS ({DIMS}), dr AS ({_dirichlet('i', 'j', 'lines')}), dc AS ({_dirichlet('i', 'j', 'samples')}),
p AS (SELECT h.raster_id, h.row, dc.i AS col, sum(h.z * dc.re) AS re, sum(h.z * dc.im) AS im FROM {{fx:heights}} h JOIN dc ON dc.raster_id = h.raster_id AND dc.j = h.col WHERE h.z IS NOT NULL GROUP BY 1, 2, 3),
o AS (SELECT p.raster_id, CAST(dr.i AS INT) AS row, CAST(p.col AS INT) AS col, sum(p.re * dr.re - p.im * dr.im) AS z FROM p JOIN dr ON dr.raster_id = p.raster_id AND dr.j = p.row GROUP BY 1, 2, 3)
SELECT o.raster_id, o.row, o.col, round(o.z, 4) + 0.0 AS z FROM o JOIN {{fx:cells}} k ON k.raster_id = o.raster_id AND k.row = o.row AND k.col = o.col""")
def _(inp):
    return kernels.fourier_lowpass(inp.fx("heights"), 0.18).withColumn("z", r("z", 4))


def _taps_sql(n: int) -> str:
    def ax(i, size, a):
        return (f"SELECT raster_id, i AS {a}_out, CAST(greatest(0, least({size} - 1, b + k)) AS INT) AS {a}, CASE WHEN k = 0 THEN 1 - f ELSE f END AS {a}_w FROM ("
                f"SELECT raster_id, {size}, i, floor((i + 0.5::DOUBLE) * {size} / {n} - 0.5) AS b, (i + 0.5::DOUBLE) * {size} / {n} - 0.5 - floor((i + 0.5::DOUBLE) * {size} / {n} - 0.5) AS f "
                f"FROM ({DIMS}) d, (SELECT unnest(range(0, {n})) AS i) g) q, (VALUES (0), (1)) t(k)")
    return (f"SELECT y.raster_id, CAST(row_out AS INT) AS out_row, CAST(col_out AS INT) AS out_col, row, col, row_w * col_w AS w "
            f"FROM ({ax('i', 'lines', 'row')}) y JOIN ({ax('i', 'samples', 'col')}) x ON y.raster_id = x.raster_id")


@query("til_04_upsample_labels", f"""
WITH t AS ({_taps_sql(96)}), v AS (SELECT t.raster_id, out_row, out_col, k, round(sum(w), 9) AS w FROM t JOIN (
  SELECT raster_id, row, col, CAST(floor(z2) % 6 + 6 AS INT) % 6 AS k FROM {{fx:heights}}) h ON h.raster_id = t.raster_id AND h.row = t.row AND h.col = t.col GROUP BY 1, 2, 3, 4)
SELECT raster_id, out_row AS row, out_col AS col, k AS class_id FROM (SELECT *, row_number() OVER (PARTITION BY raster_id, out_row, out_col ORDER BY w DESC, k) AS rn FROM v) q WHERE rn = 1""")
def _(inp):
    x = inp.fx("heights").withColumn("class_id", F.pmod(F.floor("z2") % 6 + 6, lit(6)).cast("int"))
    return ops.upsample_labels(x, 96)


@query("til_05_upsample_linear", f"""
SELECT t.raster_id, out_row AS row, out_col AS col, round(sum(w * sin(z2)) / sum(w), 6) + 0.0 AS z FROM ({_taps_sql(96)}) t JOIN {{fx:heights}} h
ON h.raster_id = t.raster_id AND h.row = t.row AND h.col = t.col WHERE w > 0 GROUP BY 1, 2, 3""")
def _(inp):
    return ops.upsample_linear(inp.fx("heights").select(*KEY, F.sin("z2").alias("z")), 96).withColumn("z", r("z"))


def _cubic_sql(size: str, n: int) -> str:
    """Cubic taps and weights (a = -0.75) of a line's cells, border replicated: (raster_id, o, i, w)."""
    at = f"((o + 0.5::DOUBLE) * {size} / {n} - 0.5)"
    return f"""SELECT raster_id, o, i, sum(CASE WHEN d <= 1 THEN 1.25 * d * d * d - 2.25 * d * d + 1 ELSE -0.75 * (d * d * d - 5 * d * d + 8 * d - 4) END) AS w FROM (
  SELECT raster_id, CAST(o AS INT) AS o, CAST(greatest(0, least({size} - 1, floor({at}) + k)) AS INT) AS i, abs({at} - floor({at}) - k) AS d
  FROM ({DIMS}) d, (SELECT unnest(range(0, {n})) AS o) g, (SELECT unnest(range(-1, 3)) AS k) t) q GROUP BY 1, 2, 3"""


@query("til_05_upsample_cubic", f"""
WITH {DENSE}, holes AS (SELECT d.raster_id, d.row, d.col, d.lines, d.samples, d.z, CASE WHEN h.z IS NULL THEN 0 ELSE 1 END AS v FROM dense d
  LEFT JOIN {{fx:heights}} h ON h.raster_id = d.raster_id AND h.row = d.row AND h.col = d.col),
area AS ({_area_sql("SELECT lines AS n, 96 AS m FROM dims UNION SELECT samples, 96 FROM dims")}),
rows_w AS ({_cubic_sql('lines', 96)}), cols_w AS ({_cubic_sql('samples', 96)}),
v1 AS (SELECT h.raster_id, row, o AS col, sum(z * w) AS z FROM holes h JOIN cols_w c ON c.raster_id = h.raster_id AND c.i = col GROUP BY 1, 2, 3),
v2 AS (SELECT v1.raster_id, o AS row, col, sum(z * w) AS z FROM v1 JOIN rows_w c ON c.raster_id = v1.raster_id AND c.i = row GROUP BY 1, 2, 3),
w1 AS (SELECT raster_id, row, lines, o AS col, sum(v * w) AS v FROM holes JOIN area ON n = samples AND i = col GROUP BY 1, 2, 3, 4),
w2 AS (SELECT raster_id, o AS row, col, sum(v * w) AS v FROM w1 JOIN area ON n = lines AND i = row GROUP BY 1, 2, 3),
up AS (SELECT v2.raster_id, v2.row, v2.col, v AS w, CASE WHEN v < 1e-3 THEN 0 ELSE z / v END AS z FROM v2 JOIN w2 ON v2.raster_id = w2.raster_id AND v2.row = w2.row AND v2.col = w2.col),
near AS (SELECT a.raster_id, a.row, a.col, a.w, a.row + i AS r0, a.col + j AS c0, (2 - abs(i)) * (2 - abs(j)) / 16.0::DOUBLE AS k
  FROM up a, (SELECT unnest(range(-1, 2)) AS i) x, (SELECT unnest(range(-1, 2)) AS j) y)
SELECT n.raster_id, n.row, n.col, round(CASE WHEN any_value(n.w) < 1e-3 THEN 0 ELSE sum(u.z * k) END, 6) + 0.0 AS z FROM near n
JOIN up u ON u.raster_id = n.raster_id AND u.row = CASE WHEN r0 < 0 THEN -r0 WHEN r0 > 95 THEN 190 - r0 ELSE r0 END AND u.col = CASE WHEN c0 < 0 THEN -c0 WHEN c0 > 95 THEN 190 - c0 ELSE c0 END
GROUP BY 1, 2, 3""")
def _(inp):
    return kernels.upsample_smoothed(inp.fx("heights"), 96).withColumn("z", r("z"))


# ------------------------------------------------------------ the same on tiles

def tiled(inp, tile: int = 16):
    return tiles.from_cells(inp.fx("heights"), tile)


@query("fil_01_mask_tiles", "SELECT raster_id, row, col, CASE WHEN z > 12 AND z < 900 THEN z END AS z FROM {fx:heights} WHERE z IS NOT NULL")
def _(inp):
    t = tiles.mask(tiled(inp).withColumn("raw", c("data")), low=12.0, high=900.0)
    return tiles.to_cells(t, "raw", "data").where("raw is not null").select(*KEY, c("data").alias("z"))


@query("prj_19_stretch_tiles", """
SELECT h.raster_id, row, col, trunc(greatest(0.0, least(255.0, (z - lo) / (hi - lo + 1e-9) * 255.0))) AS dn FROM {fx:heights} h JOIN (
  SELECT raster_id, quantile_cont(z, 0.01) AS lo, quantile_cont(z, 0.99) AS hi FROM {fx:heights} GROUP BY raster_id) s ON h.raster_id = s.raster_id WHERE z IS NOT NULL""")
def _(inp):
    return tiles.to_cells(tiles.stretch(tiled(inp)), "data", "dn").where("data is not null").select(*KEY, "dn")


@query("agg_03_percentile_tiles", """
SELECT raster_id, round(quantile_cont(z, 0.01), 6) AS p01, round(quantile_cont(z, 0.5), 6) AS median, round(quantile_cont(z, 0.99), 6) AS p99 FROM {fx:heights} WHERE z IS NOT NULL GROUP BY raster_id""")
def _(inp):
    s = tiles.percentiles(tiled(inp), {"p01": .01, "median": .5, "p99": .99})
    return s.select("raster_id", *[r(k).alias(k) for k in ("p01", "median", "p99")])


@query("agg_04_block_average_tiles", f"""
SELECT h.raster_id, CAST(row * 16 // lines AS INT) AS row, CAST(col * 16 // samples AS INT) AS col, round(sum(z) / count(z), 9) AS z
FROM {{fx:heights}} h JOIN ({DIMS}) d ON h.raster_id = d.raster_id GROUP BY 1, 2, 3 HAVING count(z) > 0""")
def _(inp):
    # absent cells are nodata here, so blocks that hold little are told by their sum alone
    return tiles.block_average(tiled(inp), 16).where("z <> 0").withColumn("z", r("z", 9))


@query("agg_11_histogram_tiles", """
SELECT raster_id, CAST(greatest(0, least(39, floor(z / 25))) AS INT) AS bin, count(*) AS n FROM {fx:heights} WHERE z IS NOT NULL GROUP BY 1, 2""")
def _(inp):
    return tiles.histogram(tiled(inp), 0.0, 25.0, 40)


@query("win_04_gradient_tiles", f"""
WITH d AS ({DIMS}) SELECT h.raster_id, h.row, h.col,
  round(CASE WHEN h.col = 0 THEN e.z - h.z WHEN h.col = samples - 1 THEN h.z - w.z ELSE (e.z - w.z) / 2 END, 6) + 0.0 AS gx,
  round(CASE WHEN h.row = 0 THEN s.z - h.z WHEN h.row = lines - 1 THEN h.z - n.z ELSE (s.z - n.z) / 2 END, 6) + 0.0 AS gy
FROM {{fx:heights}} h JOIN d ON d.raster_id = h.raster_id LEFT JOIN {{fx:heights}} e ON e.raster_id = h.raster_id AND e.row = h.row AND e.col = h.col + 1
LEFT JOIN {{fx:heights}} w ON w.raster_id = h.raster_id AND w.row = h.row AND w.col = h.col - 1 LEFT JOIN {{fx:heights}} s ON s.raster_id = h.raster_id AND s.row = h.row + 1 AND s.col = h.col
LEFT JOIN {{fx:heights}} n ON n.raster_id = h.raster_id AND n.row = h.row - 1 AND n.col = h.col WHERE h.z IS NOT NULL""")
def _(inp):
    t = tiles.gradient(tiles.deal(tiled(inp)))
    return tiles.to_cells(t, "data", "gx", "gy").where("data is not null").select(*KEY, r("gx").alias("gx"), r("gy").alias("gy"))


@query("win_05_gaussian_smooth_tiles", SMOOTH + " WHERE h.z IS NOT NULL")
def _(inp):
    t = tiles.gaussian_smooth(tiles.deal(tiled(inp)), 1.2)
    return tiles.to_cells(t, "data", "smooth").where("data is not null").select(*KEY, r("smooth").alias("z"))
