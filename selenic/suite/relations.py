"""JOI, SET and the catalog WIN queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenic.functions import geo
from selenic.operators import catalog, spatial
from selenic.suite.registry import query, r
from selenic.suite.scalars import HAV, products_fp

c, lit = F.col, F.lit

PAIR_SQL = f"""
SELECT *, row_number() OVER (PARTITION BY scene_id, kind ORDER BY score DESC, km, product_id) AS rank FROM (
  SELECT s.scene_id, s.kind, s.product_id, km, ncc, 0.6 * (1.0 / (1.0 + km / 50.0)) + 0.4 * greatest(0.0, coalesce(ncc, -1.0)) AS score
  FROM (SELECT a.scene_id, b.kind, b.product_id, {HAV.format(a='a', b='b')} AS km
    FROM {{fx:scenes}} a CROSS JOIN {{fx:centres}} b) s
  LEFT JOIN {{fx:measured}} m ON s.scene_id = m.scene_id AND s.product_id = m.product_id) q"""


@query("joi_01_candidate_pairs", f"""
SELECT scene_id, kind, product_id, round(km, 4) AS km, round(score, 6) AS score, rank FROM ({PAIR_SQL}) p WHERE rank <= 5""")
def _(inp):
    pairs = spatial.candidate_pairs(inp.fx("scenes"), inp.fx("centres"), inp.fx("observed"))
    return pairs.select("scene_id", "kind", "product_id", r("km", 4).alias("km"), r("score").alias("score"), "rank")


# every fifth scene and every fourth product without a position
BARE_SCENES = """SELECT scene_id, CASE WHEN scene_id % 5 <> 0 THEN lat_deg END AS lat_deg, CASE WHEN scene_id % 5 <> 0 THEN lon_deg END AS lon_deg FROM {fx:scenes}"""
BARE_CENTRES = """SELECT product_id, kind, CASE WHEN CAST(substr(product_id, 14, 6) AS BIGINT) % 4 <> 1 THEN lat_deg END AS lat_deg,
  CASE WHEN CAST(substr(product_id, 14, 6) AS BIGINT) % 4 <> 1 THEN lon_deg END AS lon_deg FROM {fx:centres}"""


@query("joi_01_pairs_without_positions", f"""
SELECT scene_id, kind, product_id, round(km, 4) AS km, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY scene_id, kind ORDER BY score DESC, km NULLS LAST, product_id) AS rank FROM (
    SELECT s.scene_id, s.kind, s.product_id, km, coalesce(0.6 * (1.0 / (1.0 + km / 50.0)), 0.0) + 0.4 * greatest(0.0, coalesce(ncc, -1.0)) AS score
    FROM (SELECT a.scene_id, b.kind, b.product_id, CASE WHEN a.lat_deg IS NOT NULL AND b.lat_deg IS NOT NULL THEN {HAV.format(a='a', b='b')} END AS km
      FROM ({BARE_SCENES}) a CROSS JOIN ({BARE_CENTRES}) b) s
    LEFT JOIN {{fx:measured}} m ON s.scene_id = m.scene_id AND s.product_id = m.product_id) q) p WHERE rank <= 5""")
def _(inp):
    pairs = spatial.candidate_pairs(inp.sql(BARE_SCENES), inp.sql(BARE_CENTRES), inp.fx("observed"))
    return pairs.select("scene_id", "kind", "product_id", r("km", 4).alias("km"), r("score").alias("score"), "rank")


@query("joi_01_nearest_products", f"""
SELECT scene_id, kind, product_id, round(km, 4) AS km FROM (
  SELECT *, row_number() OVER (PARTITION BY scene_id, kind ORDER BY km, product_id) AS rn FROM (
    SELECT a.scene_id, b.kind, b.product_id, {HAV.format(a='a', b='b')} AS km
    FROM {{fx:scenes}} a CROSS JOIN {{fx:centres}} b) q) w WHERE rn <= 3""")
def _(inp):
    return spatial.nearest_products(inp.fx("scenes"), inp.fx("centres"), 3).withColumn("km", r("km", 4))


@query("win_01_rank_references", f"""
SELECT scene_id, kind, product_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY scene_id, kind ORDER BY score DESC, km, product_id) AS rank FROM (
    SELECT m.scene_id, b.kind, m.product_id, {HAV.format(a='a', b='b')} AS km,
      0.6 * (1.0 / (1.0 + {HAV.format(a='a', b='b')} / 50.0)) + 0.4 * greatest(0.0, ncc) AS score
    FROM {{fx:measured}} m JOIN {{fx:scenes}} a ON m.scene_id = a.scene_id JOIN {{fx:centres}} b ON m.product_id = b.product_id) q) w
WHERE rank <= 5""")
def _(inp):
    pairs = spatial.best_pairs(spatial.measured_pairs(inp.fx("observed"), inp.fx("scenes"), inp.fx("centres")))
    pairs = pairs.withColumn("score", geo.blend_score(c("km"), c("ncc")))
    return spatial.rank_references(pairs).select("scene_id", "kind", "product_id", r("score").alias("score"), "rank")


def _rel(lon: str, target: str = "s.lon_deg") -> str:
    return f"((({lon} - {target} + 180) % 360 + 360) % 360 - 180)"


COVER_SQL = f"""
SELECT scene_id, product_id, kind, lat_deg, lon_deg, cell_m, n, lines, samples, clat, clon, fx, fy FROM (
  SELECT *, CASE WHEN in1 THEN u1 WHEN in2 THEN u2 END AS fx, CASE WHEN in1 THEN v1 WHEN in2 THEN v2 END AS fy FROM (
    SELECT *, u1 BETWEEN 0 AND 1 AND v1 BETWEEN 0 AND 1 AS in1, u2 BETWEEN 0 AND 1 AND v2 BETWEEN 0 AND 1 AS in2 FROM (
      SELECT *,
        CASE WHEN abs(bx + v1 * dx) >= abs(by_ + v1 * dy) THEN -(ax + v1 * cx) / (bx + v1 * dx) ELSE -(ay + v1 * cy) / (by_ + v1 * dy) END AS u1,
        CASE WHEN abs(bx + v2 * dx) >= abs(by_ + v2 * dy) THEN -(ax + v2 * cx) / (bx + v2 * dx) ELSE -(ay + v2 * cy) / (by_ + v2 * dy) END AS u2
      FROM (SELECT *, -2 * q0 / nullif(t, 0) AS v1, -t / nullif(2 * q2, 0) AS v2
        FROM (SELECT *, q1 + CASE WHEN q1 >= 0 THEN 1 ELSE -1 END * sqrt(greatest(q1 * q1 - 4 * q2 * q0, 0)) AS t FROM (
          SELECT *, cx * dy - cy * dx AS q2, ax * dy - ay * dx + cx * by_ - cy * bx AS q1, ax * by_ - ay * bx AS q0 FROM (
            SELECT *, ulx AS ax, uly AS ay, urx - ulx AS bx, ury - uly AS by_, llx - ulx AS cx, lly - uly AS cy,
              ulx - urx - llx + lrx AS dx, uly - ury - lly + lry AS dy FROM (
              SELECT s.*, p.product_id, p.kind, p.lines, p.samples, p.clat, p.clon,
                {_rel('p.ul_lon')} AS ulx, p.ul_lat - s.lat_deg AS uly, {_rel('p.ur_lon')} AS urx, p.ur_lat - s.lat_deg AS ury,
                {_rel('p.ll_lon')} AS llx, p.ll_lat - s.lat_deg AS lly, {_rel('p.lr_lon')} AS lrx, p.lr_lat - s.lat_deg AS lry
              FROM {{fx:scenes}} s CROSS JOIN {{fx:products}} p) r0
            WHERE greatest(ulx, urx, llx, lrx) - least(ulx, urx, llx, lrx) <= 180) r1) r2) r3
        WHERE q1 * q1 - 4 * q2 * q0 >= 0) r4) r5) r6 WHERE in1 OR in2) r7"""


@query("joi_02_coverage_join", f"""
SELECT scene_id, product_id, round(fx, 7) + 0.0 AS fx, round(fy, 7) + 0.0 AS fy FROM ({COVER_SQL}) z""")
def _(inp):
    cov = spatial.coverage_join(inp.fx("scenes"), products_fp(inp))
    return cov.select("scene_id", "product_id", r("fx", 7).alias("fx"), r("fy", 7).alias("fy"))


# a box across the 0/360 meridian is two boxes
BOX_SQL = """SELECT box_id, lat_lo, lat_hi, CASE WHEN k = 0 THEN greatest(0, w) WHEN w < 0 THEN w + 360 ELSE 0 END AS lon_lo,
  CASE WHEN k = 0 THEN least(360, e) WHEN w < 0 THEN 360 ELSE e - 360 END AS lon_hi
  FROM (SELECT scene_id AS box_id, lat_deg - 0.5 AS lat_lo, lat_deg + 0.5 AS lat_hi, lon_deg - 2.5 AS w, lon_deg + 2.5 AS e FROM {fx:scenes}) q
  JOIN (VALUES (0), (1)) s(k) ON k = 0 OR w < 0 OR e > 360"""


@query("joi_03_corner_in_box", f"""
SELECT DISTINCT box_id, product_id FROM ({BOX_SQL}) b JOIN {{fx:products}} p ON
  (ul_lat BETWEEN lat_lo AND lat_hi AND ul_lon BETWEEN lon_lo AND lon_hi) OR
  (ur_lat BETWEEN lat_lo AND lat_hi AND ur_lon BETWEEN lon_lo AND lon_hi) OR
  (ll_lat BETWEEN lat_lo AND lat_hi AND ll_lon BETWEEN lon_lo AND lon_hi) OR
  (lr_lat BETWEEN lat_lo AND lat_hi AND lr_lon BETWEEN lon_lo AND lon_hi)""")
def _(inp):
    return spatial.corner_in_box(products_fp(inp), inp.sql(BOX_SQL))


GRID_SQL = """SELECT raster_id, row * 100 AS scan, col * 100 AS pixel, round(20 + CAST(col AS DOUBLE) * 0.003 + CAST(row AS DOUBLE) * 0.0001, 6) AS lon_deg,
  round(5 - CAST(row AS DOUBLE) * 0.003, 6) AS lat_deg FROM {fx:cells} WHERE z > -32000"""
POINT_SQL = """SELECT CAST(floor(o_orderkey / 4096) AS BIGINT) AS raster_id, o_orderkey AS point_id,
  o_totalprice % 6400 AS line, (o_totalprice * 3) % 6400 AS sample FROM {orders}"""


@query("joi_04_geo_lookup", f"""
SELECT p.point_id, b.lon_deg, b.lat_deg FROM ({POINT_SQL}) p LEFT JOIN (
  SELECT point_id, lon_deg, lat_deg FROM (
    SELECT q.point_id, g.lon_deg, g.lat_deg, row_number() OVER (PARTITION BY q.point_id ORDER BY
      power(g.scan - q.line, 2) + power(g.pixel - q.sample, 2), o.k) AS rn
    FROM ({POINT_SQL}) q CROSS JOIN (VALUES (0, 0, 0), (1, 0, 100), (2, 0, -100), (3, 100, 0), (4, 100, 100), (5, 100, -100)) o(k, ds, dp)
    JOIN ({GRID_SQL}) g ON g.raster_id = q.raster_id AND g.scan = CAST(round_even(q.line / 100, 0) AS INT) * 100 + o.ds
      AND g.pixel = CAST(round_even(q.sample / 100, 0) AS INT) * 100 + o.dp) w WHERE rn = 1) b ON p.point_id = b.point_id""")
def _(inp):
    out = spatial.geo_lookup(inp.sql(POINT_SQL), inp.sql(GRID_SQL), ["raster_id"])
    return out.select("point_id", "lon_deg", "lat_deg")


@query("joi_08_pick_reference", """
WITH scene AS (SELECT c_custkey AS scene_id, CASE WHEN c_custkey % 3 = 0 THEN product_id END AS reference_id,
    CASE c_custkey % 4 WHEN 0 THEN concat('crop_', product_id, '_n', CAST(c_custkey AS STRING)) WHEN 1 THEN substr(product_id, 5, 18)
      WHEN 2 THEN concat('other_', CAST(c_custkey AS STRING)) ELSE substr(product_id, 5, 7) END AS own_id
  FROM {customer} JOIN {fx:products} ON CAST(substr(product_id, 14, 6) AS BIGINT) - 100000 = c_custkey % (SELECT count(*) FROM {fx:products}))
SELECT s.scene_id, coalesce(s.reference_id, f.product_id) AS product_id,
  CASE WHEN s.reference_id IS NOT NULL THEN 'recorded' WHEN f.product_id IS NOT NULL THEN 'substring' END AS how
FROM scene s LEFT JOIN (SELECT scene_id, min(p.product_id) AS product_id FROM scene JOIN {fx:products} p
  ON contains(own_id, p.product_id) OR contains(p.product_id, own_id) GROUP BY scene_id) f ON s.scene_id = f.scene_id""")
def _(inp):
    prods = inp.fx("products").select("product_id")
    k = (F.substring("product_id", 14, 6).cast("long") - 100000).alias("_k")
    n = prods.agg(F.count("*").alias("_n"))  # one row
    scenes = inp.table("customer").crossJoin(F.broadcast(n)).withColumn("_k", c("c_custkey") % c("_n")).join(prods.select(k, "product_id"), "_k")
    m = c("c_custkey") % 4
    own = (F.when(m == 0, F.concat(lit("crop_"), "product_id", lit("_n"), "c_custkey"))
           .when(m == 1, F.substring("product_id", 5, 18)).when(m == 2, F.concat(lit("other_"), "c_custkey"))
           .otherwise(F.substring("product_id", 5, 7)))
    scenes = scenes.select(c("c_custkey").alias("scene_id"),
                           F.when(c("c_custkey") % 3 == 0, c("product_id")).alias("reference_id"), own.alias("own_id"))
    return catalog.pick_reference(scenes, prods)


@query("joi_09_decode_class", """
SELECT event_id, class_id, CASE class_id WHEN 0 THEN 'pyroxene-rich (mafic)' WHEN 1 THEN 'olivine-rich (mafic)'
  WHEN 2 THEN 'feldspathic (highland-like)' WHEN 3 THEN 'mixed / immature regolith' WHEN 4 THEN '3 um OH/H2O-bearing'
  WHEN 5 THEN 'low signal / uncertain' END AS name, CASE class_id WHEN 0 THEN 'deep 1 um + deep 2 um crystal-field bands' WHEN 1 THEN 'broad 1 um band, weak 2 um band'
  WHEN 2 THEN 'shallow 1 um and 2 um bands (low Fe bearing phases)' WHEN 3 THEN 'intermediate band depths' WHEN 4 THEN 'distinct absorption drop near 3 um'
  WHEN 5 THEN 'reflectance too low or saturated for band-depth analysis' END AS rule, CASE class_id WHEN 0 THEN '#d64545' WHEN 1 THEN '#3fa66a' WHEN 2 THEN '#cccccc'
  WHEN 3 THEN '#c8a24a' WHEN 4 THEN '#4a7fc8' WHEN 5 THEN '#333333' END AS color
FROM (SELECT event_id, CAST(event_id % 7 AS INT) AS class_id FROM {events}) q""")
def _(inp):
    df = inp.table("events").select("event_id", (c("event_id") % 7).cast("int").alias("class_id"))
    return catalog.decode_class(df).select("event_id", df.class_id, "name", "color", "rule")


@query("joi_10_purge_stale", """
SELECT p.p_partkey AS scene_id, CASE WHEN e.product_id IS NULL THEN 'dropped' ELSE 'kept' END AS state
FROM {part} p LEFT JOIN (SELECT DISTINCT product_id FROM {fx:sources}) e ON p.p_partkey = e.product_id""")
def _(inp):
    reg = inp.table("part").select(c("p_partkey").alias("scene_id"))
    kept, gone = catalog.purge_stale(reg, inp.fx("sources").select(c("product_id").alias("scene_id")), "scene_id")
    return kept.withColumn("state", lit("kept")).unionByName(gone.withColumn("state", lit("dropped")))


@query("joi_11_carry_over", """
SELECT product_id, size, src AS source FROM {fx:sources} WHERE src = 'tar'
UNION ALL SELECT o.product_id, o.size, 'cached label' FROM {fx:sources} o WHERE o.src = 'zip'
  AND o.product_id NOT IN (SELECT product_id FROM {fx:sources} WHERE src = 'tar')
  AND o.product_id IN (SELECT product_id FROM {fx:sources} WHERE src = 'dir')""")
def _(inp):
    cat = inp.fx("sources").select("product_id", "size", c("src").alias("source"))
    return catalog.carry_over(cat.where("source = 'zip'"), cat.where("source = 'tar'"), cat.where("source = 'dir'"))


@query("joi_12_scene_payload", f"""
WITH refs AS (SELECT scene_id, string_agg(concat(kind, ':', CAST(rank AS VARCHAR), ':', product_id), ',' ORDER BY kind, rank) AS refs
  FROM ({PAIR_SQL}) p WHERE rank <= 5 GROUP BY scene_id),
cr AS (SELECT scene_id, string_agg(CAST(cand_id AS VARCHAR), ',' ORDER BY rn) AS craters FROM (
  SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY radius_px DESC, cand_id) AS rn FROM {{fx:candidates}}) q WHERE rn <= 25 GROUP BY scene_id)
SELECT s.scene_id, refs.refs, cr.craters FROM {{fx:scenes}} s LEFT JOIN refs ON s.scene_id = refs.scene_id LEFT JOIN cr ON s.scene_id = cr.scene_id""")
def _(inp):
    from selenic.operators.logs import top_k

    refs = spatial.candidate_pairs(inp.fx("scenes"), inp.fx("centres"), inp.fx("observed"))
    craters = top_k(inp.fx("candidates"), ["scene_id"], [F.desc("radius_px"), "cand_id"], 25)
    out = catalog.scene_payload(inp.fx("scenes"), refs, craters)
    ref = F.array_join(F.transform("references", lambda x: F.concat_ws(":", x["kind"], x["rank"], x["product_id"])), ",")
    return out.select("scene_id", ref.alias("refs"),
                      F.array_join(F.transform("craters", lambda x: x["cand_id"].cast("string")), ",").alias("craters"))


@query("set_02_union_catalogs", "SELECT product_id, src, prio, size FROM {fx:sources}")
def _(inp):
    s = inp.fx("sources")
    return catalog.union_catalogs(*[s.where(c("src") == x) for x in ("tar", "zip", "dir")])


@query("win_02_first_wins", """
SELECT product_id, src, prio, size, 'first' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY prio, src) AS rn FROM {fx:sources}) q WHERE rn = 1
UNION ALL SELECT product_id, src, prio, size, 'last' FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY prio DESC, src DESC) AS rn FROM {fx:sources}) q WHERE rn = 1""")
def _(inp):
    s = inp.fx("sources")
    return (catalog.first_wins(s, ["product_id"], "prio", "src").withColumn("rule", lit("first"))
            .unionByName(catalog.last_wins(s, ["product_id"], "prio", "src").withColumn("rule", lit("last"))))


@query("set_03_changed_files", """
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM {fx:files_old} o FULL OUTER JOIN {fx:files_new} n ON o.path = n.path
WHERE o.path IS NULL OR n.path IS NULL OR o.size <> n.size OR o.mtime <> n.mtime""")
def _(inp):
    return catalog.changed_files(inp.fx("files_old"), inp.fx("files_new"))


@query("set_04_required_minus_present", """
SELECT p_partkey AS product_id FROM {part} EXCEPT SELECT product_id FROM {fx:sources}""")
def _(inp):
    return catalog.required_minus_present(inp.table("part").select(c("p_partkey").alias("product_id")),
                                          inp.fx("sources").select("product_id"))


@query("agg_15_edge_margin", f"""
SELECT scene_id, product_id, round(least({', '.join("2 * 1737.4 * asin(least(1.0, sqrt(power(sin(radians(" + k + "_lat - lat_deg) / 2), 2) + cos(radians(lat_deg)) * cos(radians(" + k + "_lat)) * power(sin(radians(((" + k + "_lon - lon_deg) % 360 + 360) % 360) / 2), 2))))" for k in ("ul", "ur", "ll", "lr"))}), 4) AS margin_km
FROM {{fx:measured}} m JOIN {{fx:scenes}} s USING (scene_id) JOIN {{fx:products}} p USING (product_id)""")
def _(inp):
    pairs = inp.fx("measured").join(inp.fx("scenes"), "scene_id").join(products_fp(inp), "product_id")
    return pairs.select("scene_id", "product_id", r(spatial.edge_margin_km(c("fp"), c("lat_deg"), c("lon_deg")), 4).alias("margin_km"))
