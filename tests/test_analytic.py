"""Analytic truths and published values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from selenic.fixtures import Inputs
from selenic.functions import geo, predicates, spectra, text
from selenic.operators import cells, kernels, spatial, stats
from selenic.suite.scalars import products_fp

c, lit = F.col, F.lit


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def grid(spark, a, rid=0):
    r, q = np.meshgrid(np.arange(a.shape[0]), np.arange(a.shape[1]), indexing="ij")
    pdf = pd.DataFrame({"raster_id": rid, "row": r.ravel(), "col": q.ravel(), "z": a.ravel()})
    return spark.createDataFrame(pdf, "raster_id long, row int, col int, z double").withColumn("z", F.when(~F.isnan("z"), c("z")))


def dense(df, name="z"):
    pdf = df.toPandas()
    a = np.full((pdf["row"].max() + 1, pdf["col"].max() + 1), np.nan)
    a[pdf["row"], pdf["col"]] = pdf[name].astype(float)
    return a


def test_ransac_budget(spark):
    k = [value(spark, geo.ransac_budget(lit(w))) for w in (0.2, 0.3, 0.5, 0.9, 1.0)]
    assert 560 <= k[1] <= 575 and k == sorted(k, reverse=True) and k[-1] == 1


# fixed values: (km, coarse correlation, score) as published for three scenes
SCORES = [(2760.5, .841, .347), (2761.8, .816, .337), (2776.9, .799, .330), (2745.2, .729, .302), (2968.4, .184, .083),
          (639.7, .813, .369), (586.5, .771, .356), (591.5, .754, .348), (711.1, .434, .213), (860.0, .376, .183)]


@pytest.mark.parametrize("km,ncc,score", SCORES)
def test_published_scores(spark, km, ncc, score):
    assert value(spark, geo.blend_score(lit(km), lit(ncc))) == pytest.approx(score, abs=0.0015)


# fixed values: (x, y, shadow, depth, lat, lon) of polar craters, sun elevation 6.270646
CRATERS = [(799.8, 127.8, 3.0, .3, -84.20823, 312.37248), (540.6, 682.2, 5.0, .5, -84.22651, 312.28759),
           (257.4, 696.6, 4.0, .4, -84.22699, 312.19484), (126.6, 919.8, 3.0, .3, -84.23435, 312.152)]


@pytest.mark.parametrize("x,y,shadow,depth,lat,lon", CRATERS)
def test_published_craters(spark, x, y, shadow, depth, lat, lon):
    at = value(spark, geo.pixel_to_geo(lit(x), lit(y), lit(-84.2209), lit(312.27822), lit(1.0), lit(1024)))
    assert at["lat_deg"] == pytest.approx(lat, abs=2e-5) and at["lon_deg"] == pytest.approx(lon, abs=2e-5)
    assert shadow * math.tan(math.radians(6.270646)) == pytest.approx(depth, abs=0.07)


def test_missing_coordinates_stay_missing(spark):
    none = lit(None).cast("double")
    assert value(spark, geo.great_circle_km(none, lit(1.0), lit(2.0), lit(3.0))) is None
    assert value(spark, geo.pixel_window(none, none, lit(100), lit(100), lit(1000.0), lit(18.0))) is None
    assert value(spark, geo.blend_score(none, lit(0.5))) == pytest.approx(0.2)
    assert value(spark, geo.stretch_u8(none, lit(0.0), lit(1.0))) is None


def test_mutual_information(spark):
    n = spark.range(256 * 256).select(lit(0).alias("raster_id"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    own = cells.mutual_information(n.select("raster_id", "a", c("a").alias("b"))).first()["mi"]
    cross = cells.mutual_information(n).first()["mi"]
    assert own > 2 and -0.05 < cross < 0.1


def test_contour_length(spark):
    y, x = np.mgrid[0:200, 0:200]
    g = grid(spark, ((x - 100) ** 2 + (y - 100) ** 2 - 3600).astype(float))
    lv = spark.createDataFrame([(0, 1, 0.0)], "raster_id long, level_no int, level double")
    s = cells.contours(g, lv).agg(F.sum(F.hypot(c("x2") - c("x1"), c("y2") - c("y1"))).alias("v")).first()["v"]
    assert 350 < s < 405


def test_lowpass_removes_noise(spark):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:128, 0:128] / 128
    clean = np.sin(2 * np.pi * 2 * x) + np.cos(2 * np.pi * 3 * y)
    noisy = clean + rng.normal(0, .5, clean.shape)
    out = dense(kernels.fourier_lowpass(grid(spark, noisy), .15))
    assert np.abs(out - clean).mean() < np.abs(noisy - clean).mean() / 2


def test_poisson_recovers_hill_and_flat_stays_flat(spark):
    y, x = np.mgrid[0:128, 0:128]
    hill = 20 * np.exp(-((x - 64) ** 2 + 2 * (y - 60) ** 2) / 400.0)
    qy, px = np.gradient(hill)
    g = grid(spark, hill).join(grid(spark, px).withColumnRenamed("z", "p"), ["raster_id", "row", "col"]).join(
        grid(spark, qy).withColumnRenamed("z", "q"), ["raster_id", "row", "col"])
    out = dense(kernels.poisson_integrate(g))
    assert np.corrcoef(out.ravel(), hill.ravel())[0, 1] > 0.95
    zero = kernels.poisson_integrate(g.withColumns({"p": lit(0.0), "q": lit(0.0)})).agg(F.max(F.abs("z"))).first()[0]
    assert zero < 1e-6


def test_lambert_slope_of_a_tilted_plane(spark):
    sun = geo.sun_vector(lit(270.0), lit(45.0))
    s = value(spark, sun)
    # a plane rising to the east faces west, towards the sun, and is brighter than flat ground
    p = 0.1
    bright = 100 * (-p * s["east"] + s["up"])
    out = value(spark, geo.lambert_slope(lit(bright), lit(100 * s["up"]), lit(0.0), sun))
    assert out["p"] == pytest.approx(p, abs=1e-9) and abs(out["q"]) < 1e-9


@pytest.mark.parametrize("kind", ["uniform", "outlier", "ties"])
def test_exact_percentiles(spark, kind):
    rng = np.random.default_rng(1)
    v = rng.random(5000)
    v = np.append(v, 1e12) if kind == "outlier" else np.floor(v * 7) if kind == "ties" else v
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "z": v}))
    row = stats.exact_percentiles(df, ["k"], "z", {"a": .01, "b": .5, "d": .99}).first()
    assert [row["a"], row["b"], row["d"]] == pytest.approx(list(np.percentile(v, [1, 50, 99])))


def brute_nearest(scenes, prods, k):
    out = []
    for s in scenes.itertuples():
        p1, p2 = np.radians(s.lat_deg), np.radians(prods.lat_deg.to_numpy())
        dl = np.radians((prods.lon_deg.to_numpy() - s.lon_deg) % 360)
        a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
        km = 2 * 1737.4 * np.arcsin(np.minimum(1, np.sqrt(a)))
        t = prods.assign(km=km.round(9)).sort_values(["km", "product_id"])
        for kind, g in t.groupby("kind"):
            out += [(s.scene_id, kind, p) for p in g.product_id.head(k)]
    return sorted(out)


def test_nearest_products_with_a_hot_spot(spark):
    rng = np.random.default_rng(2)
    n = 600
    lat, lon = rng.uniform(-90, 90, n), rng.uniform(0, 360, n)
    lat[:200], lon[:200] = 12.5, 359.9                       # a third of all products at one position
    lat[200:350], lon[200:350] = rng.uniform(-89.9, -88, 150), rng.uniform(0, 360, 150)
    prods = pd.DataFrame({"product_id": [f"p{i:04d}" for i in range(n)], "kind": np.where(rng.random(n) < .2, "iirs", "tmc"), "lat_deg": lat, "lon_deg": lon})
    scenes = pd.DataFrame({"scene_id": range(60), "lat_deg": np.r_[rng.uniform(-90, 90, 40), [12.5] * 10, rng.uniform(-90, -87, 10)],
                           "lon_deg": np.r_[rng.uniform(0, 360, 40), [0.1] * 10, rng.uniform(0, 360, 10)]})
    for levels in (None, (45.0, 11.25, 2.8125, 0.703125)):
        got = spatial.nearest_products(spark.createDataFrame(scenes), spark.createDataFrame(prods), 4, levels=levels)
        assert sorted((r.scene_id, r.kind, r.product_id) for r in got.collect()) == brute_nearest(scenes, prods, 4)


def test_newton_agrees_with_the_closed_form(spark):
    inp = Inputs(spark, "/root/testdata/sf0.01")
    sc, pr = inp.fx("scenes"), products_fp(inp)
    a = {(r.scene_id, r.product_id): (r.fx, r.fy) for r in spatial.coverage_join(sc, pr).collect()}
    b = {(r.scene_id, r.product_id): (r.fx, r.fy) for r in spatial.coverage_join(sc, pr, method="newton").collect()}
    assert len(a) > 100 and len(set(a) ^ set(b)) <= len(a) * 0.01
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in set(a) & set(b))


def test_polar_swath_coverage(spark):
    # corners of a swath across the south pole
    fp = geo.corners(*[lit(v) for v in (-87.751893, 83.203496, -87.731931, 100.164986, -60.339438, 270.469442, -60.338792, 269.232231)])
    prods = spark.range(1).select(lit("swath").alias("product_id"), fp.alias("fp"))
    pts = spark.createDataFrame([(1, -70.0, 269.9), (2, -70.0, 200.0), (3, 10.0, 269.9)], "scene_id long, lat_deg double, lon_deg double")
    assert [r.scene_id for r in spatial.coverage_join(pts, prods).collect()] == [1]


def test_far_side_is_not_covered(spark):
    fp = geo.corners(*[lit(v) for v in (5.0, 10.0, 5.0, 20.0, -5.0, 10.0, -5.0, 20.0)])
    prods = spark.range(1).select(lit("p").alias("product_id"), fp.alias("fp"))
    pts = spark.createDataFrame([(1, 0.0, 15.0), (2, 0.0, 195.0)], "scene_id long, lat_deg double, lon_deg double")
    assert sorted(r.scene_id for r in spatial.coverage_join(pts, prods).collect()) == [1]
    assert sorted(r.scene_id for r in spatial.coverage_join(pts, prods, legacy=True).collect()) == [1, 2]


def test_inpaint_matches_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    a = rng.random((20, 17))
    a[5:12, 3:9] = np.nan
    a[0, 0] = np.nan
    want = a.copy()
    while np.isnan(want).any():
        nxt = want.copy()
        for r, q in zip(*np.where(np.isnan(want))):
            near = [want[min(max(r + i, 0), 19), min(max(q + j, 0), 16)] for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))]
            near = [v for v in near if not np.isnan(v)]
            if near:
                nxt[r, q] = np.mean(near)
        want = nxt
    assert dense(kernels.inpaint(grid(spark, a))) == pytest.approx(want)


def test_template_and_scale_search(spark):
    rng = np.random.default_rng(4)
    img = kernels._separable(np.pad(rng.random((96, 96)), 2, mode="reflect"), np.array([1, 4, 6, 4, 1]) / 16)
    best = kernels.template_ncc(grid(spark, img[30:54, 41:70]), grid(spark, img)).first()
    assert (best["row"], best["col"]) == (30, 41) and best["ncc"] == pytest.approx(1.0)
    strip = img.repeat(2, axis=0).repeat(2, axis=1)
    found = kernels.scale_sweep(grid(spark, strip), grid(spark, img), max_tpl=64, min_overlap=32).first()
    assert found["factor"] == 0.5 and (found["dx"], found["dy"]) == (0, 0) and found["gsd_m"] == 1.0


def test_gaussian_is_independent_of_the_tiling(spark):
    rng = np.random.default_rng(5)
    g = grid(spark, rng.random((70, 50)))
    a, b = dense(kernels.gaussian_smooth(g, 2.0, tile=16)), dense(kernels.gaussian_smooth(g, 2.0, tile=256))
    assert a == pytest.approx(b)


def test_clean_text(spark):
    raw = "**Bold** $w=0.02$ `x`  \nline 2.5\\%\t\n\n\n \nend\\)  "
    assert value(spark, text.clean_text(lit(raw))) == "Bold w=0.02 x\nline 2.5%\n\nend"


def test_parse_list_and_slug(spark):
    assert value(spark, text.parse_list(lit("a/b, /c/d/  a/b plain"))) == ["a/b", "c/d"]
    assert value(spark, text.slug(lit("Crater #1/x" + "y" * 80), 48)) == ("Crater__1_x" + "y" * 80)[:48]


def test_band_depth_guards(spark):
    flat = F.array(*[lit(1.0)] * 256)
    assert value(spark, spectra.band_depth(flat, .85, 1.35))["depth"] == pytest.approx(0)
    assert value(spark, spectra.band_depth(F.slice(flat, 1, 20), .85, 1.35)) == (0.0, 0.0)
    assert value(spark, spectra.band_depth(F.transform(flat, lambda v: v * 0), .85, 1.35)) == (0.0, 0.0)


def test_accept_reference(spark):
    pick = [value(spark, predicates.accept_reference(lit(a), lit(b), lit(n)))["status"] for a, b, n in ((True, 10, .1), (True, 9, .1), (False, 0, .35))]
    assert pick == ["selected", "rejected", "selected"]


def test_ranking_without_positions(spark):
    """No distance: correlations rank, then ids; a place is only filled by what has none."""
    scenes = spark.createDataFrame([(1, 10.0, 20.0), (2, None, None)], "scene_id long, lat_deg double, lon_deg double")
    products = spark.createDataFrame([("a", "tmc", None, None), ("b", "tmc", None, None), ("c", "tmc", 11.0, 20.0), ("d", "tmc", None, 5.0)],
                                     "product_id string, kind string, lat_deg double, lon_deg double")
    measured = spark.createDataFrame([(1, "d", 0.9), (2, "c", 0.5), (2, "d", -0.2)], "scene_id long, product_id string, ncc double")
    got = spatial.candidate_pairs(scenes, products, measured, k=3).orderBy("scene_id", "rank").collect()
    assert [(r["scene_id"], r["product_id"]) for r in got] == [
        (1, "c"), (1, "d"), (1, "a"), (2, "c"), (2, "a"), (2, "b")]
    assert all(r["score"] == pytest.approx(0.6 * (0 if r["km"] is None else 1 / (1 + r["km"] / 50)) + 0.4 * max(0, {
        (1, "d"): 0.9, (2, "c"): 0.5}.get((r["scene_id"], r["product_id"]), 0))) for r in got)
    assert all(x["score"] >= y["score"] for x, y in zip(got, got[1:]) if x["scene_id"] == y["scene_id"])


def test_a_corner_counts_whatever_rounding_does(spark):
    # the scene is the product's upper left corner, written with another rounding
    fp = geo.corners(*[lit(v) for v in (39.56, 238.40999999999997, 39.06, 256.40999999999997, 27.560000000000002, 239.40999999999997, 28.060000000000002, 257.40999999999997)])
    prods = spark.range(1).select(lit("p").alias("product_id"), fp.alias("fp"))
    scenes = spark.createDataFrame([(0, 39.56, 238.41), (1, 39.56, 238.4), (2, 39.57, 238.41)], "scene_id int, lat_deg double, lon_deg double")
    for method in ("closed", "newton"):
        assert [(r.scene_id, r.fx, r.fy) for r in spatial.coverage_join(scenes, prods, method=method).collect()] == [(0, pytest.approx(0, abs=1e-9), pytest.approx(0, abs=1e-9))]
    judged = spatial.within_footprint(scenes.crossJoin(prods)).collect()
    assert {r.scene_id: r.covered for r in judged} == {0: True, 1: False, 2: False}
