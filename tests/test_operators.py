"""Operators against brute force, with hot keys and copies."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from selenic.operators import catalog, logs, matching
from selenic.plans import jobs
from selenic.sources import labels, rasters, tables

c, lit = F.col, F.lit


def events(spark, n=3000, span_ms=4_000_000, seed=0):
    rnd = random.Random(seed)
    rows = [(i, 1 if i % 3 == 0 else rnd.randint(2, 30), 1_700_000_000_000 + rnd.randint(0, span_ms)) for i in range(n)]
    pdf = pd.DataFrame(rows, columns=["event_id", "key", "ms"])
    return pdf, spark.createDataFrame(pdf).withColumn("ts", F.timestamp_millis("ms"))


def test_sliding_count(spark):
    pdf, df = events(spark)
    got = {r.event_id: (r.n_window, r.allowed) for r in logs.sliding_count(df, "key", "ts", 60_000, 10).collect()}
    for key, g in pdf.groupby("key"):
        t = np.sort(g.ms.to_numpy())
        for e in g.itertuples():
            n = np.searchsorted(t, e.ms, "right") - np.searchsorted(t, e.ms - 60_000, "right")
            assert got[e.event_id] == (n, n <= 10)


def test_ttl_gate(spark):
    pdf, df = events(spark)
    got = {(r.key, r.t): r.state for r in logs.ttl_gate(df, "key", "ts", 300_000).collect()}
    for key, g in pdf.groupby("key"):
        last = None
        for t in sorted(set(g.ms)):
            fresh = last is None or t >= last + 300_000
            last = t if fresh else last
            assert got[(key, t)] == ("fresh" if fresh else "hit")


def test_longest_run_across_segments(spark):
    rnd = random.Random(5)
    rows = [(k, i, rnd.random() < 0.8) for k in range(6) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, pos int, dark boolean")
    got = {r.k: r.longest for r in logs.longest_run(df, ["k"], "pos", "pos", c("dark"), F.floor(c("pos") / 7)).collect()}
    for k in range(6):
        best = run = 0
        for kk, _, d in rows:
            if kk == k:
                run = run + 1 if d else 0
                best = max(best, run)
        assert got[k] == best


def test_containing_pairs(spark):
    rnd = random.Random(1)
    longs = ["ch2_tmc_ndn_" + "".join(rnd.choice("ab12") for _ in range(14)) for _ in range(80)]
    shorts = sorted({s[i:i + n] for s in longs[:40] for i, n in ((0, 15), (5, 12), (3, 4), (12, 14))} | {"zz", "nothing_like_it"})
    got = catalog.containing_pairs(spark.createDataFrame([(s,) for s in shorts], "short string"), spark.createDataFrame([(s,) for s in longs], "long string"))
    assert sorted((r.short, r.long) for r in got.collect()) == sorted({(s, t) for s in shorts for t in longs if s in t})


@pytest.mark.parametrize("first", [False, True])
def test_prefix_ranges_that_span_tasks(spark, first):
    rnd = random.Random(7)
    texts = [("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 6))), f"owner{k % 300:03d}") for k in range(2000)]
    texts += [("aaaa", f"copy{k:04d}") for k in range(1500)]  # one text under many owners
    marks = ["a", "aa", "aaaa", "ab", "abab", "b", "bbbbbb", "c", "é"]
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = catalog.prefix_ranges(spark.createDataFrame([(m,) for m in marks], "short string"),
                                    spark.createDataFrame(texts, "text string, long string"), 6, first).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {(m, o) for m in marks for t, o in texts if t.startswith(m)}
    if first:
        want = {(m, min(o for n, o in want if n == m)) for m, _ in want}
    assert {(r.short, r.long) for r in got} == want
    if first:
        assert len(got) == len(want)


def test_containing_pairs_without_short_texts(spark):
    none = spark.createDataFrame([], "short string")
    longs = spark.createDataFrame([("abc",), ("",), (None,)], "long string")
    assert catalog.containing_pairs(none, longs).count() == 0
    assert [tuple(r) for r in catalog.containing_pairs(spark.createDataFrame([("b",), ("",), (None,)], "short string"), longs).collect()] == [("b", "abc")]


def vectors(spark, seed=2):
    rng = np.random.default_rng(seed)
    pair = np.where(np.arange(240) < 80, 0, np.arange(240) % 7)       # one pair holds a third
    v = rng.normal(size=(240, 16))
    v[60:80] = v[60]                                                   # copies
    w = v + rng.normal(scale=.1, size=v.shape)
    def frame(m):
        return spark.createDataFrame(pd.DataFrame({"pair_id": pair, "id": range(240), "vec": list(m)}))
    return pair, v, w, frame(v), frame(w)


def test_matching_does_not_depend_on_blocks(spark):
    pair, v, w, src, ref = vectors(spark)
    want = set()
    for i in range(240):
        d = sorted((np.linalg.norm(v[i] - w[j]), j) for j in np.where(pair == pair[i])[0])
        if len(d) > 1 and d[0][0] < .8 * d[1][0]:
            want.add((i, d[0][1]))
    for size in (16, 4096):
        assert {(r.src_id, r.ref_id) for r in matching.knn_ratio_join(src, ref, block=size).collect()} == want
    runs = [{(r.src_id, r.ref_id, r.used) for r in matching.mutual_nn_join(src, ref, block=s).collect()} for s in (16, 4096)]
    assert runs[0] == runs[1] and len(runs[0]) > 100


def test_homography_is_recovered(spark):
    rng = np.random.default_rng(3)
    s = rng.uniform(0, 1024, (300, 2))
    h = np.array([[1.02, .01, 12], [-.02, .98, -7], [1e-5, -2e-5, 1]])
    p = np.c_[s, np.ones(300)] @ h.T
    r = p[:, :2] / p[:, 2:] + rng.normal(0, .2, (300, 2))
    r[:120] = rng.uniform(0, 1024, (120, 2))
    df = spark.createDataFrame(pd.DataFrame({"pair_id": 0, "point_id": range(300), "sx": s[:, 0], "sy": s[:, 1], "rx": r[:, 0], "ry": r[:, 1], "method": "sift"}))
    v = matching.homography_vote(df)
    m = matching.match_summary(v).first()
    assert 178 <= m["inlier_count"] <= 186 and m["rmse_px"] < .5 and m["status"] == "ok"
    few = matching.match_summary(matching.homography_vote(df.where("point_id < 5"))).first()
    assert few["status"] == "insufficient_candidates" and few["match_percentage"] == 0


LABEL = """<Product><isda:System_Level_Coordinates><isda:upper_left_latitude unit="deg">1.5</isda:upper_left_latitude>
<isda:upper_left_longitude unit="deg">2.5</isda:upper_left_longitude></isda:System_Level_Coordinates>
<isda:Refined_Corner_Coordinates><isda:upper_left_latitude unit="deg">9.5</isda:upper_left_latitude>
<isda:upper_left_longitude unit="deg">8.5</isda:upper_left_longitude></isda:Refined_Corner_Coordinates>
<start_date_time>2023-11-09T06:03:56.7692Z</start_date_time><offset unit="byte">12</offset><data_type>UnsignedMSB2</data_type>
<axis_name>Line</axis_name> <elements>3</elements><axis_name>Sample</axis_name><elements>4</elements></Product>"""


def test_label_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "ch2_tmc_a.xml").write_text(LABEL)
    (tmp_path / "broken.xml").write_text("PK..")
    rows = {r.product_id: r for r in labels.read_labels(spark, str(tmp_path)).collect()}
    a = rows["ch2_tmc_a"]
    assert (a.lines, a.samples, a.dtype, a.offset, a.error) == (3, 4, ">u2", 12, None)
    assert (a.center.lat_deg, a.center.lon_deg, a.footprint.upper_right.lat_deg) == (1.5, 2.5, None)
    assert rows["broken"].error == "not a label"
    fine = {r.product_id: r for r in labels.read_labels(spark, str(tmp_path), "Refined_Corner_Coordinates").collect()}
    assert fine["ch2_tmc_a"].center.lat_deg == 9.5


@pytest.mark.parametrize("code", ["<i2", ">u2", "u1", "<f4"])
def test_raster_tiles(spark, tmp_path, code):
    a = (np.arange(37 * 23).reshape(37, 23) % 200).astype(code)
    path = tmp_path / "r.img"
    path.write_bytes(b"h" * 10 + a.tobytes())
    prods = spark.createDataFrame([(7, str(path), 37, 23, code, 10, 5.0)], "raster_id long, path string, lines int, samples int, dtype string, offset long, missing double")
    got = rasters.tiles_to_cells(rasters.read_raster_tiles(prods, tile=8)).toPandas()
    want = np.where(a == 5, np.nan, a.astype(float))
    assert len(got) == a.size
    assert np.array_equal(got.sort_values(["row", "col"]).z.to_numpy(float).reshape(a.shape), want, equal_nan=True)


def test_spectra_window(spark, tmp_path):
    cube = np.random.default_rng(0).random((5, 20, 9)).astype("<f4")
    path = tmp_path / "cube.qub"
    path.write_bytes(cube.tobytes())
    df = spark.createDataFrame([(1, str(path), 5, 20, 9, "<f4", 0, 3, 2, 17, 8, 2, 3)],
                               "cube_id int, path string, bands int, lines int, samples int, dtype string, offset long, r0 int, c0 int, r1 int, c1 int, row_step int, col_step int")
    rows = rasters.read_spectra(df).collect()
    assert {(r.line, r.sample) for r in rows} == {(y, x) for y in range(3, 17, 2) for x in range(2, 8, 3)}
    assert all(np.allclose(r.refl, cube[:, r.line, r.sample]) for r in rows)


def test_json_documents(spark, tmp_path):
    (tmp_path / "registry.json").write_text(json.dumps({"s1": {"dir": "c:\\x\\s1", "slug": "s1", "name": "n", "subtitle": "t", "kind": "user"}}, indent=1))
    assert tables.read_registry(spark, str(tmp_path / "registry.json")).first().folder == "s1"
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "metadata.json").write_text(json.dumps({"product_id": "p", "analysis_grid": {"n": 8, "cell_meters": 2.0}}, indent=1))
    (tmp_path / "s1" / "craters.json").write_text(json.dumps([{"x_px": 1.0, "radius_m": 2.0}, {"x_px": 3.0, "radius_m": 1.0}], indent=1))
    m = tables.read_metadata(spark, str(tmp_path)).first()
    assert (m.scene_id, m.analysis_grid.n, m.tmc_reference) == ("s1", 8, None)
    assert tables.read_craters(spark, str(tmp_path)).groupBy("scene_id").count().first()["count"] == 2


def test_first_and_last_win(spark):
    df = spark.createDataFrame([(1, "tar", 1), (1, "dir", 3), (2, "zip", 2)], "id int, src string, prio int")
    assert sorted(r.src for r in catalog.first_wins(df, ["id"], "prio").collect()) == ["tar", "zip"]
    assert sorted(r.src for r in catalog.last_wins(df, ["id"], "prio").collect()) == ["dir", "zip"]


def test_height_grids(spark):
    r, q = np.meshgrid(np.arange(64), np.arange(64), indexing="ij")
    z = (r * 5 + q * 7).astype(float)
    hole = z.copy()
    hole[22:40, 22:40] = np.nan                    # nothing valid in the wanted window
    void = np.full_like(z, np.nan)
    pdf = pd.concat([pd.DataFrame({"raster_id": i, "row": r.ravel(), "col": q.ravel(), "z": a.ravel()}) for i, a in enumerate((z, hole, void))])
    cells = spark.createDataFrame(pdf, "raster_id long, row int, col int, z double").withColumn("z", F.when(~F.isnan("z"), c("z")))
    rows = [(f"s{i}", "p", i, .5, .5, 64, 64, n * 500.0, 500.0) for i, n in ((0, 32), (1, 16), (2, 16))]
    cov = spark.createDataFrame(rows, "scene_id string, product_id string, raster_id long, fx double, fy double, lines int, samples int, extent_m double, gsd_m double")
    grid, status = jobs.height_grids(cov, cells, 16)
    state = {x.request_id: x for x in status.collect()}
    assert [state[f"s{i}|p"].status for i in range(3)] == ["exact", "moved", "no_valid_data"]
    assert state["s1|p"].offset_km > 0
    g = grid.where("request_id = 's0|p'").toPandas().sort_values(["row", "col"]).z.to_numpy().reshape(16, 16)
    want = z[15:47, 15:47].reshape(16, 2, 16, 2).mean((1, 3))
    assert g == pytest.approx(want - want.min())


def test_terrain_product(spark):
    y, x = np.mgrid[0:64, 0:64]
    hill = 100 * np.exp(-((x - 32) ** 2 + (y - 32) ** 2) / 300.0)
    pdf = pd.DataFrame({"raster_id": 1, "row": y.ravel(), "col": x.ravel(), "z": hill.ravel()})
    grid, lines = jobs.terrain_product(spark.createDataFrame(pdf, "raster_id long, row int, col int, z double"), 32, keep=0.5)
    top = grid.agg(F.min("z"), F.max("z")).first()
    assert top[0] == 0 and 90 < top[1] < 101
    # every level circles the summit once
    per = {r.level_no: (r.a, r.b) for r in lines.groupBy("level_no").agg(F.avg("x1").alias("a"), F.avg("y1").alias("b")).collect()}
    assert len(per) == 8 and all(abs(a - 15.75) < 0.5 and abs(b - 15.75) < 0.5 for a, b in per.values())


def test_match_report(spark):
    _, v, w, src, ref = vectors(spark)
    src, ref = [d.withColumn("response", c("id") * 1.0) for d in (src, ref.withColumn("id", c("id") + 1000))]
    xy = np.random.default_rng(9).uniform(0, 1000, (240, 2))
    pts = pd.DataFrame({"id": np.r_[np.arange(240), 1000 + np.arange(240)], "x": np.r_[xy[:, 0], xy[:, 0] * 1.01 + 5], "y": np.r_[xy[:, 1], xy[:, 1] * .99 - 3]})
    verified, report = jobs.match_report(src, ref, spark.createDataFrame(pts))
    rows = {x.pair_id: x for x in report.collect()}
    assert len(rows) == 7 and all(x.inlier_ratio > .8 and x.rmse_px < .1 for x in rows.values() if x.status == "ok")
    assert verified.select("method").distinct().count() == 2 and rows[0].report.startswith("Scene 0:")


def test_registered_references(spark):
    """The best alignment wins, not the best rank; the gate, unregistered candidates and scenes without any."""
    scenes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "scene_id long")
    ranked = spark.createDataFrame([(1, "nac", "a"), (1, "nac", "b"), (2, "nac", "a"), (3, "nac", "a")], "scene_id long, kind string, product_id string")
    registered = spark.createDataFrame([(1, "a", 0.4, False, 0), (1, "b", 0.6, False, 0), (1, "z", 0.9, True, 99), (2, "a", 0.1, True, 3), (3, "a", None, None, None)],
                                       "scene_id long, product_id string, ncc double, refined boolean, inliers long")
    got = jobs.registered_references(ranked, registered, scenes).orderBy("scene_id").collect()
    assert [(r["product_id"], r["candidates"], r["status"]) for r in got] == [
        ("b", 2, "selected"), ("a", 1, "rejected"), (None, 1, "unavailable"), (None, 0, "empty")]
