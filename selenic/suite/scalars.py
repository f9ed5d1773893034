"""PRJ, FUN and FIL queries: one row in, one row out."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenic.fixtures import Inputs
from selenic.functions import geo, predicates, spectra, text
from selenic.suite.registry import query, r

c, lit = F.col, F.lit

# great-circle distance in DuckDB for columns of two aliases
HAV = ("2 * 1737.4 * asin(least(1.0, sqrt(power(sin(radians({b}.lat_deg - {a}.lat_deg) / 2), 2) + "
       "cos(radians({a}.lat_deg)) * cos(radians({b}.lat_deg)) * "
       "power(sin(radians((({b}.lon_deg - {a}.lon_deg) % 360 + 360) % 360) / 2), 2))))")


def products_fp(inp: Inputs):
    return inp.fx("products").withColumn("fp", geo.corners(
        "ul_lat", "ul_lon", "ur_lat", "ur_lon", "ll_lat", "ll_lon", "lr_lat", "lr_lon"))


@query("prj_01_wrap_lon", """
SELECT event_id, round(((value - 500) % 360 + 360) % 360, 6) + 0.0 AS lon,
  round(((value - 500 - 200 + 180) % 360 + 360) % 360 - 180, 6) + 0.0 AS rel FROM {events}""")
def _(inp):
    lon = c("value") - 500
    return inp.table("events").select("event_id", r(geo.wrap_lon(lon)).alias("lon"),
                                      r(geo.rel_lon(lon, lit(200.0))).alias("rel"))


@query("prj_02_great_circle", f"""
SELECT a.scene_id, round({HAV.format(a='a', b='b')}, 4) AS km
FROM {{fx:scenes}} a JOIN (SELECT product_id, lat_deg, lon_deg,
  CAST(substr(product_id, 14, 6) AS BIGINT) - 100000 AS k FROM {{fx:centres}}) b
ON a.scene_id % (SELECT count(*) FROM {{supplier}}) = b.k""".replace("FROM {{fx", "FROM {fx"))
def _(inp):
    scenes, prods = inp.fx("scenes"), inp.fx("centres")
    n = inp.table("supplier").agg(F.count("*").alias("n_products"))
    b = prods.select((F.substring("product_id", 14, 6).cast("long") - 100000).alias("k"),
                     c("lat_deg").alias("plat"), c("lon_deg").alias("plon"))
    # the count is one row
    keyed = scenes.crossJoin(F.broadcast(n)).withColumn("k", c("scene_id") % c("n_products"))
    return keyed.join(b, "k").select(
        "scene_id", r(geo.great_circle_km(c("lat_deg"), c("lon_deg"), c("plat"), c("plon")), 4).alias("km"))


@query("prj_03_footprint_center", """
SELECT product_id, round((ul_lat + ur_lat + ll_lat + lr_lat) / 4, 6) + 0.0 AS lat,
  round((ul_lon + ur_lon + ll_lon + lr_lon) / 4, 6) AS lon FROM {fx:products}""")
def _(inp):
    ctr = geo.footprint_center(c("fp"))
    return products_fp(inp).select("product_id", r(ctr["lat_deg"]).alias("lat"), r(ctr["lon_deg"]).alias("lon"))


@query("prj_04_crop_center", """
SELECT product_id,
  round((ul_lat * (1 - fx) + ur_lat * fx) * (1 - fy) + (ll_lat * (1 - fx) + lr_lat * fx) * fy, 6) + 0.0 AS lat,
  round((ul_lon * (1 - fx) + ur_lon * fx) * (1 - fy) + (ll_lon * (1 - fx) + lr_lon * fx) * fy, 6) AS lon
FROM (SELECT *, least(1.0, (1700 + 512.0) / samples) AS fx, least(1.0, (lines - 300 + 512.0) / lines) AS fy
  FROM {fx:products}) q""")
def _(inp):
    ctr = geo.crop_center(c("fp"), c("lines"), c("samples"), c("lines") - 300, lit(1700), lit(1024))
    return products_fp(inp).select("product_id", r(ctr["lat_deg"]).alias("lat"), r(ctr["lon_deg"]).alias("lon"))


@query("prj_05_pixel_window", """
SELECT product_id, r0, c0, r1, c1 FROM (
  SELECT product_id, CAST(trunc(greatest(0.0, py - half)) AS INT) AS r0, CAST(trunc(least(lines, py + half)) AS INT) AS r1,
    CAST(trunc(greatest(0.0, px - half)) AS INT) AS c0, CAST(trunc(least(samples, px + half)) AS INT) AS c1
  FROM (SELECT *, (lines % 11) / 10.0 * (lines - 1) AS py, (lines % 7) / 6.0 * (samples - 1) AS px,
    greatest(2.0, (lines - 1000) / 2.0 / 18.0) AS half FROM {fx:products}) q) w
WHERE r1 - r0 >= 2 AND c1 - c0 >= 2""")
def _(inp):
    win = geo.pixel_window((c("lines") % 7) / 6.0, (c("lines") % 11) / 10.0, c("lines"), c("samples"),
                           c("lines") - 1000, lit(18.0))
    return inp.fx("products").withColumn("w", win).filter("w is not null").select("product_id", "w.*")


@query("prj_06_gsd_from_id", r"""
SELECT product_id, coalesce(CAST(nullif(regexp_extract(product_id, '_d(\d+)(?:_\D*)?$', 1), '') AS DOUBLE), 24.0) AS gsd,
  coalesce(CAST(nullif(regexp_extract(product_id, '_[dn](\d+)(?:_\D*)?$', 1), '') AS DOUBLE), 24.0) AS gsd_any
FROM {fx:products}""")
def _(inp):
    return inp.fx("products").select("product_id", geo.gsd_from_id(c("product_id")).alias("gsd"),
                                     geo.gsd_from_id(c("product_id"), include_n=True).alias("gsd_any"))


@query("prj_07_acq_date", """
SELECT product_id, right(split_part(product_id, 'T', 1), 8) AS ymd FROM {fx:products}""")
def _(inp):
    return inp.fx("products").select("product_id", geo.acq_date(c("product_id")).alias("ymd"))


@query("prj_08_geo_key", """
SELECT scene_id, CAST(CAST(round_even(lat_deg * 1000, 0) AS BIGINT) AS VARCHAR) || '_' ||
  CAST(CAST(round_even(lon_deg * 1000, 0) AS BIGINT) AS VARCHAR) AS geo_key FROM {fx:scenes}""")
def _(inp):
    return inp.fx("scenes").select("scene_id", geo.geo_key(c("lat_deg"), c("lon_deg")).alias("geo_key"))


PX = {"x": "CAST((scene_id * 37) % 1024 AS DOUBLE)", "y": "CAST((scene_id * 91) % 1024 AS DOUBLE)"}


@query("prj_09_pixel_to_geo", f"""
SELECT scene_id, round(lat_deg + (n / 2.0 - {PX['y']}) * cell_m / (1737400.0 * pi() / 180), 5) + 0.0 AS lat,
  round(((lon_deg + ({PX['x']} - n / 2.0) * cell_m / (1737400.0 * pi() / 180 * cos(radians(abs(lat_deg))))) % 360 + 360)
    % 360, 5) + 0.0 AS lon FROM {{fx:scenes}}""".replace("{{", "{").replace("}}", "}"))
def _(inp):
    g = geo.pixel_to_geo(F.expr(PX["x"]), F.expr(PX["y"]), c("lat_deg"), c("lon_deg"), c("cell_m"), c("n"))
    return inp.fx("scenes").select("scene_id", (g["lat_deg"] + 0.0).alias("lat"), (g["lon_deg"] + 0.0).alias("lon"))


@query("prj_10_sun_vector", """
SELECT scene_id, round(cos(radians(lat_deg)) * sin(radians(lon_deg)), 8) + 0.0 AS east,
  round(-cos(radians(lat_deg)) * cos(radians(lon_deg)), 8) + 0.0 AS south, round(sin(radians(lat_deg)), 8) + 0.0 AS up
FROM {fx:scenes}""")
def _(inp):
    s = geo.sun_vector(c("lon_deg"), c("lat_deg"))
    return inp.fx("scenes").select("scene_id", r(s["east"], 8).alias("east"), r(s["south"], 8).alias("south"),
                                   r(s["up"], 8).alias("up"))


@query("prj_13_ransac_budget", """
SELECT event_id, CASE WHEN power(w, 4) < 1 THEN CAST(ceil(ln(1 - 0.99::DOUBLE) / ln(1 - power(w, 4))) AS BIGINT)
  ELSE 1 END AS k FROM (SELECT event_id, greatest((event_id % 101) / 100.0::DOUBLE, 0.001::DOUBLE) AS w FROM {events}) q""")
def _(inp):
    return inp.table("events").select("event_id", geo.ransac_budget((c("event_id") % 101) / 100.0).alias("k"))


H0 = (1.01, 0.002, 5.0, -0.001, 0.99, -3.0, 1e-6, 2e-6, 1.0)


@query("prj_14_apply_homography", """
SELECT point_id, round((1.01::DOUBLE * sx + 0.002::DOUBLE * sy + 5.0::DOUBLE) / w, 4) AS px,
  round((-0.001::DOUBLE * sx + 0.99::DOUBLE * sy - 3.0::DOUBLE) / w, 4) + 0.0 AS py,
  round(sqrt(power((1.01::DOUBLE * sx + 0.002::DOUBLE * sy + 5.0::DOUBLE) / w - rx, 2)
    + power((-0.001::DOUBLE * sx + 0.99::DOUBLE * sy - 3.0::DOUBLE) / w - ry, 2)), 4) AS residual
FROM (SELECT *, 0.000001::DOUBLE * sx + 0.000002::DOUBLE * sy + 1.0::DOUBLE AS w FROM {fx:corr}) q""")
def _(inp):
    h = [lit(v) for v in H0]
    px, py = geo.project(h, c("sx"), c("sy"))
    res = geo.residual(h, c("sx"), c("sy"), c("rx"), c("ry"))
    return inp.fx("corr").select("point_id", r(px, 4).alias("px"), r(py, 4).alias("py"), r(res, 4).alias("residual"))


@query("prj_15_blend_score", """
SELECT event_id, round(0.6 * (CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1.0 / (1.0 + value / 50.0) END)
  + 0.4 * greatest(0.0, (event_id % 21) / 10.0::DOUBLE - 1), 6) AS score FROM {events}""")
def _(inp):
    km = F.when(c("event_id") % 5 != 0, c("value"))
    return inp.table("events").select("event_id", r(geo.blend_score(km, (c("event_id") % 21) / 10.0 - 1)).alias("score"))


@query("prj_16_wavelength", """
SELECT event_id, round(0.8 + (event_id % 256) * (4.2 / 255.0), 6) AS um,
  CAST(round_even((0.8::DOUBLE + (value % 42) / 10 - 0.8::DOUBLE) / (4.2::DOUBLE / 255), 0) AS INT) AS band FROM {events}""")
def _(inp):
    return inp.table("events").select("event_id", r(spectra.wavelength(c("event_id") % 256)).alias("um"),
                                      spectra.band_for(lit(0.8) + (c("value") % 42) / 10).alias("band"))


@query("prj_17_mineral_class", """
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 5 WHEN d3 > 0.25 THEN 4 WHEN d2 > 0.12 AND d1 > 0.08 THEN 0
  WHEN d1 > 0.10 AND d2 <= 0.12 THEN 1 WHEN d1 < 0.05 AND d2 < 0.06 THEN 2 ELSE 3 END AS mineral
FROM (SELECT event_id, (event_id % 20) / 100.0::DOUBLE AS d1, (event_id % 23) / 100.0::DOUBLE AS d2,
  (event_id % 31) / 100.0::DOUBLE AS d3 FROM {events}) q""")
def _(inp):
    d = [(c("event_id") % m) / 100.0 for m in (20, 23, 31)]
    return inp.table("events").select("event_id", spectra.mineral_class(*d, c("event_id") % 17 != 0).alias("mineral"))


@query("prj_18_render_report", """
SELECT pair_id, printf('Scene %s: %.1f%% matched, %d of %d correspondences verified, RMSE %.2f px, inlier share %.2f, budget %d draws.',
  CAST(pair_id AS VARCHAR), 100.0 * i / n, i, n, coalesce(rmse, 0), i / n::DOUBLE,
  CASE WHEN power(w, 4) < 1 THEN CAST(ceil(ln(1 - 0.99::DOUBLE) / ln(1 - power(w, 4))) AS BIGINT) ELSE 1 END) AS report
FROM (SELECT *, greatest(i / n::DOUBLE, 0.001::DOUBLE) AS w FROM (
  SELECT pair_id, count(*) AS n, count(*) FILTER (WHERE point_id % 3 <> 0) AS i,
    sqrt(avg(power(rx - sx, 2)) FILTER (WHERE point_id % 3 <> 0)) AS rmse FROM {fx:corr} GROUP BY pair_id) q) q2""")
def _(inp):
    good = c("point_id") % 3 != 0
    m = inp.fx("corr").groupBy("pair_id").agg(
        F.count("*").alias("n"), F.count_if(good).alias("i"),
        F.sqrt(F.avg(F.when(good, F.pow(c("rx") - c("sx"), 2)))).alias("rmse"))
    w = c("i") / c("n")
    return m.select("pair_id", text.render_report(c("pair_id").cast("string"), w * 100.0, c("i"), c("n"), c("rmse"), w,
                                                  geo.ransac_budget(w)).alias("report"))


@query("prj_20_effective_sun", """
SELECT scene_id, CASE WHEN pin THEN az ELSE laz END AS az, CASE WHEN pin THEN el ELSE lel END AS el,
  90.0 - CASE WHEN pin THEN el ELSE lel END AS incidence
FROM (SELECT scene_id, scene_id % 3 = 0 OR scene_id % 7 = 0 AS pin, CASE WHEN scene_id % 3 = 0 THEN 100.5::DOUBLE ELSE 270.8::DOUBLE END AS az,
  10.0::DOUBLE AS el, lon_deg AS laz, abs(lat_deg) AS lel FROM {fx:scenes}) q""")
def _(inp):
    s = inp.fx("scenes")
    az = F.when(c("scene_id") % 3 == 0, 100.5).otherwise(270.8)
    has = c("scene_id") % 7 != 0
    sun = geo.effective_sun(az, lit(10.0), F.when(has, c("lon_deg")), F.when(has, F.abs("lat_deg")))
    return s.select("scene_id", sun["az_deg"].alias("az"), sun["el_deg"].alias("el"), sun["incidence_deg"].alias("incidence"))


@query("fil_05_is_product_id", """
SELECT page_id, regexp_matches(id, '^ch[12]_tmc_') AS ok, (n_lines > 0 AND dtype IS NOT NULL) AS readable
FROM (SELECT page_id, concat(CASE page_id % 3 WHEN 0 THEN 'ch1_tmc_' WHEN 1 THEN 'ch2_ohr_' ELSE 'x_ch2_tmc_' END, url) AS id,
  page_id % 4 AS n_lines, CASE WHEN page_id % 5 > 0 THEN '<i2' END AS dtype FROM {pages}) q""")
def _(inp):
    k = c("page_id")
    ident = F.concat(F.when(k % 3 == 0, "ch1_tmc_").when(k % 3 == 1, "ch2_ohr_").otherwise("x_ch2_tmc_"), c("url"))
    return inp.table("pages").select(
        "page_id", predicates.is_product_id(ident).alias("ok"),
        predicates.readable_label(k % 4, F.when(k % 5 > 0, "<i2")).alias("readable"))


@query("fil_07_accept_reference", """
SELECT event_id, CASE WHEN ok THEN 'selected' ELSE 'rejected' END AS status,
  CASE WHEN ok THEN 'registered reference accepted' ELSE printf('best registration NCC %.2f below 0.35', ncc) END AS note
FROM (SELECT *, (event_id % 3 = 0 AND event_id % 20 >= 10) OR ncc >= 0.35 AS ok
  FROM (SELECT event_id, (event_id % 61) / 61.0::DOUBLE AS ncc FROM {events}) q) q2""")
def _(inp):
    k = c("event_id")
    a = predicates.accept_reference(k % 3 == 0, k % 20, (k % 61) / 61.0)
    return inp.table("events").select("event_id", a["status"].alias("status"), a["note"].alias("note"))


@query("fun_01_slug", """
SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 48) AS slug48,
  substr(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 60) AS slug60 FROM {pages}""")
def _(inp):
    return inp.table("pages").select("page_id", text.slug(c("url")).alias("slug48"), text.slug(c("url"), 60).alias("slug60"))


CLEAN_DUCK = """trim(regexp_replace(list_aggregate(list_transform(string_split(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(replace(replace({s}, '$', ''), '`', ''), '**', ''), '__', ''),
  '\\%', '%'), '\\(', ''), '\\)', ''), '\\[', ''), '\\]', ''),
  '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)),
  lambda x: regexp_replace(x, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '')),
  'string_agg', chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ' || chr(9) || chr(160))"""


@query("fun_02_clean_text", f"""
SELECT doc_id, md5({CLEAN_DUCK.format(s='text')}) AS digest FROM {{documents}}
UNION ALL SELECT conv_id * 1000 + turn + 1000000000, md5({CLEAN_DUCK.format(s="concat('**a** $x$ ', text, ' 2.5\\% ', chr(10), ' ', chr(10), chr(10), 'end')")})
FROM {{conversations}}""")
def _(inp):
    docs = inp.table("documents").select("doc_id", F.md5(text.clean_text(c("text"))).alias("digest"))
    marked = F.concat(lit("**a** $x$ "), c("text"), lit(" 2.5\\% \n \n\nend"))
    conv = inp.table("conversations").select((c("conv_id") * 1000 + c("turn") + 1000000000).alias("doc_id"),
                                             F.md5(text.clean_text(marked)).alias("digest"))
    return docs.unionByName(conv)


@query("fun_03_basename", r"""
SELECT page_id, regexp_extract(url, '([^/\\]+)[/\\]*$', 1) AS base,
  regexp_replace(regexp_extract(replace(url, '/', '\'), '([^/\\]+)[/\\]*$', 1), '\.[^.]*$', '') AS stem FROM {pages}""")
def _(inp):
    win = F.replace(c("url"), lit("/"), lit("\\"))
    return inp.table("pages").select("page_id", text.basename(c("url")).alias("base"),
                                     text.strip_extension(text.basename(win)).alias("stem"))


@query("fun_04_parse_list", """
SELECT event_id, list_aggregate(list_filter([concat('u', user_id, '/', event_type), CASE WHEN user_id % 2 = 0 THEN concat('v/', event_type) END],
  lambda x: x IS NOT NULL), 'string_agg', '|') AS items FROM {events}""")
def _(inp):
    a = F.concat(lit("u"), c("user_id"), lit("/"), c("event_type"))
    b = F.when(c("user_id") % 2 == 0, F.concat(lit(", /v/"), c("event_type"), lit("/"))).otherwise(lit(" , plain"))
    return inp.table("events").select("event_id", F.array_join(text.parse_list(F.concat(a, b, lit("  "), a)), "|").alias("items"))


def _depth_duck(lo: float, hi: float, n: int) -> str:
    i0, i1 = spectra.band_index(lo, n), spectra.band_index(hi, n)
    return (f"SELECT px_id, list_transform(range(0, {i1 - i0 + 1}), lambda i: seg[i + 1] / greatest(0.000001::DOUBLE, "
            f"seg[1] + (seg[{i1 - i0 + 1}] - seg[1]) / {i1 - i0}.0::DOUBLE * i)) AS ratio "
            f"FROM (SELECT px_id, refl[{i0 + 1}:{i1 + 1}] AS seg FROM {{fx:spectra}}) s"), i0


def depth_cte(n: int = 64) -> str:
    parts = []
    for j, (lo, hi) in enumerate(spectra.FEATURES_UM):
        sql, i0 = _depth_duck(lo, hi, n)
        parts.append(f"d{j + 1} AS (SELECT px_id, 1 - list_min(ratio) AS depth, 0.8 + ({i0} + list_position(ratio, "
                     f"list_min(ratio)) - 1) * (4.2 / {n - 1}.0) AS centre FROM ({sql}) q{j})")
    return "WITH " + ", ".join(parts)


@query("fun_05_band_depth", depth_cte() + """
SELECT px_id, round(d1.depth, 6) + 0.0 AS depth1, round(d1.centre, 6) AS centre1, round(d2.depth, 6) + 0.0 AS depth2,
  round(d2.centre, 6) AS centre2, round(d3.depth, 6) + 0.0 AS depth3, round(d3.centre, 6) AS centre3
FROM d1 JOIN d2 USING (px_id) JOIN d3 USING (px_id)""")
def _(inp):
    df = inp.fx("spectra")
    out = ["px_id"]
    for j, (lo, hi) in enumerate(spectra.FEATURES_UM, 1):
        df = df.withColumn(f"f{j}", spectra.band_depth(c("refl"), lo, hi, 64))
        out += [r(c(f"f{j}.depth")).alias(f"depth{j}"), r(c(f"f{j}.centre_um")).alias(f"centre{j}")]
    return df.select(*out)


@query("fun_06_vectors", """
SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 5) + 0.0 AS cos,
  round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: power(a[i] - b[i], 2)))), 5) AS l2,
  round(a[1] / (sqrt(list_dot_product(a, a)) + 0.00000001::DOUBLE), 5) + 0.0 AS first
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a,
  list_reverse(list_transform(embedding, lambda x: x::DOUBLE)) AS b FROM {embeddings}) q""")
def _(inp):
    a, b = c("embedding"), F.reverse("embedding")
    return inp.table("embeddings").select("vec_id", r(spectra.cosine(a, b), 5).alias("cos"), r(spectra.l2(a, b), 5).alias("l2"),
                                          r(F.get(spectra.l2_normalise(a), lit(0)), 5).alias("first"))


@query("fun_07_timestamps", """
SELECT event_id, epoch_us(ts) // 1000 AS ms, CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) AS parsed_ms,
  round((epoch_us(ts) // 1000 - 1672531200000) / 1000.0, 3) AS elapsed_s FROM {events}""")
def _(inp):
    ms = text.epoch_ms(c("ts"))
    iso = F.when(c("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.0000Z'")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return inp.table("events").select("event_id", ms.alias("ms"), text.epoch_ms(text.parse_time(iso)).alias("parsed_ms"),
                                      F.round((ms - 1672531200000) / 1000.0, 3).alias("elapsed_s"))


@query("fun_08_json_fields", """
SELECT event_id, coalesce(json_extract_string(props, '$.ref'), 'none') AS ref,
  coalesce(json_extract_string(props, '$.missing'), 'unknown') AS missing, kept FROM (
  SELECT event_id, props, event_type AS kept FROM {events}) q""")
def _(inp):
    m = F.create_map(lit("type"), c("event_type"), lit("ranked"), lit("x"))
    return inp.table("events").select(
        "event_id", text.json_get(c("props"), "ref", "none").alias("ref"),
        text.json_get(c("props"), "missing", "unknown").alias("missing"),
        F.element_at(F.map_values(text.drop_keys(m, ["ranked"])), 1).alias("kept"))


@query("fun_09_maths", """
SELECT event_id, round(tan(radians(value % 80)) + exp(-value / 100) + ln(value + 1), 6) AS mixed,
  round(sqrt(power(value, 2) + power(event_id % 10, 2)), 6) AS hyp, greatest(1.0, least(5.0, value)) AS clipped,
  CAST(ceil(value) AS BIGINT) AS up FROM {events}""")
def _(inp):
    v = c("value")
    return inp.table("events").select(
        "event_id", r(F.tan(F.radians(v % 80)) + F.exp(-v / 100) + F.log(v + 1)).alias("mixed"),
        r(F.hypot(v, c("event_id") % 10)).alias("hyp"), F.greatest(lit(1.0), F.least(lit(5.0), v)).alias("clipped"),
        F.ceil(v).alias("up"))


@query("fun_10_grounding_context", """
SELECT conv_id, turn AS position, concat('=== DOCUMENT: ', role, '-', CAST(turn AS VARCHAR), ' ===', chr(10), text) AS block,
  substr(trim(text), 1, 600) AS question FROM {conversations}""")
def _(inp):
    name = F.concat("role", lit("-"), "turn")
    return inp.table("conversations").select("conv_id", c("turn").alias("position"),
                                             text.context_block(name, c("text")).alias("block"),
                                             text.question(c("text")).alias("question"))


@query("fun_10_grounding_texts", """
SELECT conv_id, md5(string_agg(concat('=== DOCUMENT: ', role, '-', CAST(turn AS VARCHAR), ' ===', chr(10), text), chr(10) || chr(10) ORDER BY concat(role, '-', CAST(turn AS VARCHAR)))) AS digest
FROM {conversations} GROUP BY conv_id""")
def _(inp):
    from selenic.operators.catalog import grounding_context

    docs = inp.table("conversations").select("conv_id", F.concat("role", lit("-"), "turn").alias("name"), c("text").alias("body"))
    return grounding_context(docs, "conv_id").select("conv_id", F.md5("context").alias("digest"))
