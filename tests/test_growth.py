"""What the operators keep or multiply must not outgrow their input."""

import numpy as np
from pyspark.sql import functions as F

from selenic.functions import geo
from selenic.operators import cells, kernels, matching, spatial
from selenic.plans import jobs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def footprints(spark, rows):
    """(product_id, ul, ur, ll, lr) with corners as (lat, lon)."""
    flat = [(i, *[float(v) for corner in c for v in corner]) for i, *c in rows]
    names = [f"{k}_{x}" for k in ("ul", "ur", "ll", "lr") for x in ("lat", "lon")]
    return spark.createDataFrame(flat, ["product_id", *names]).select("product_id", geo.corners(*names).alias("fp"))


def test_cells_are_finer_than_the_footprint(spark):
    box = spark.range(1).select(F.explode(spatial._cells_of_box(F.lit(10.0), F.lit(22.0), F.lit(350.0), F.lit(372.0))).alias("k"))
    cells = box.select("k.*").collect()
    side = 360.0 / 2 ** cells[0]["j"]
    assert side <= 22.0 / 2 and len(cells) <= 25


def test_coverage_does_not_broadcast_multiplied_footprints(spark):
    p = footprints(spark, [(f"p{i}", (5, i % 360), (5, (i + 20) % 360), (-5, i % 360), (-5, (i + 20) % 360)) for i in range(0, 720, 7)])
    s = spark.createDataFrame([(i, float(i % 11 - 5), float(i * 37 % 360) + 0.25) for i in range(200)], ["scene_id", "lat_deg", "lon_deg"])
    got = spatial.coverage_join(s, p)
    assert "BroadcastHashJoin" not in plan(got)
    inside = {(a.scene_id, b) for a in s.collect() for i, b in ((i, f"p{i}") for i in range(0, 720, 7)) if (a.lon_deg - i) % 360 <= 20}
    assert {(r.scene_id, r.product_id) for r in got.collect()} == inside


def test_box_pairs_come_once_without_a_distinct(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{k % 40}", *[(rng.uniform(-3, 3), rng.uniform(0, 12) % 360) for _ in range(4)]) for k in range(60)]  # some ids twice
    p = footprints(spark, rows)
    boxes = [(k % 30, float(a), float(a + 2), float(b), float(b + 5)) for k, (a, b) in enumerate(zip(rng.uniform(-3, 2, 50), rng.uniform(0, 9, 50)))]
    got = spatial.corner_in_box(p, spark.createDataFrame(boxes, ["box_id", "lat_lo", "lat_hi", "lon_lo", "lon_hi"]))
    assert "Aggregate" not in plan(got).split("SortMergeJoin")[0]
    want = {(b, i) for b, s, n, w, e in boxes for i, *c in rows if any(s <= y <= n and w <= x <= e for y, x in c)}
    pairs = [(r.box_id, r.product_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def noisy(spark, rasters=3, side=70, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(k, i, j, float(v)) for k in range(rasters) for (i, j), v in np.ndenumerate(rng.random((side, side)))]
    return spark.createDataFrame(rows, "raster_id long, row int, col int, z double")


def test_window_shares_do_not_broadcast_windows(spark):
    z = noisy(spark)
    w = spark.range(3 * 400).select("id", (F.col("id") % 3).alias("raster_id"), (F.col("id") % 37 * 2 - 4).cast("int").alias("r0"), (F.col("id") % 41 - 2).cast("int").alias("c0"))
    w = w.select(F.col("id").alias("window_id"), "raster_id", "r0", "c0", (F.col("r0") + 6).alias("r1"), (F.col("c0") + F.col("id") % 40).cast("int").alias("c1"))
    got = cells.window_valid(cells.summed_area(z, F.col("z") < 0.6, w), w)
    assert "BroadcastHashJoin" not in plan(got) and "BroadcastExchange" not in plan(got)
    grid = np.zeros((3, 200, 200))
    for r in z.collect():
        grid[r.raster_id, r.row, r.col] = r.z < 0.6
    rows = got.collect()
    assert len(rows) == 1200
    for r in rows:
        area = (r.r1 - r.r0) * (r.c1 - r.c0)
        inside = grid[r.raster_id, max(0, r.r0):max(0, r.r1), max(0, r.c0):max(0, r.c1)].sum()
        assert r.valid_fraction is None if area <= 0 else abs(r.valid_fraction - inside / area) < 1e-12


def test_places_of_a_frame_are_judged_once(spark, monkeypatch):
    z, seen = noisy(spark, 1), []
    real = cells.window_valid
    monkeypatch.setattr(cells, "window_valid", lambda sat, w: seen.append(w.count()) or real(sat, w))
    req = spark.range(100).select(F.col("id").alias("request_id"), F.lit(0).cast("long").alias("raster_id"), *[F.lit(v).alias(k) for k, v in (
        ("cx", 20), ("cy", 20), ("half", 4), ("x0", 0), ("x1", 70), ("y0", 0), ("y1", 70), ("lines", 70), ("samples", 70))])
    whole = req.select("raster_id", F.lit(0).alias("r0"), F.lit(0).alias("c0"), F.lit(70).alias("r1"), F.lit(70).alias("c1"))
    out = cells.densest_window(cells.summed_area(z, F.col("z") < 0.3, whole), req).collect()
    assert seen == [100, 36] and len(out) == 100


def plain_taps(size, n):
    for i in range(n):
        at = (i + 0.5) * size / n - 0.5
        b = int(np.floor(at))
        yield [(min(max(b, 0), size - 1), 1 - (at - b)), (min(max(b + 1, 0), size - 1), at - b)]


def test_resampling_moves_cells_not_taps(spark):
    rng = np.random.default_rng(8)
    h, w, n = 9, 13, 20
    rows = [(0, i, j, None if rng.random() < 0.2 else float(rng.random()), None if rng.random() < 0.2 else int(rng.integers(4)))
            for i in range(h) for j in range(w) if i != 4 and (i in (0, h - 1) or rng.random() < 0.7)]
    x = spark.createDataFrame(rows, "raster_id long, row int, col int, z double, class_id int")
    lin, lab = cells.upsample_linear(x, n), cells.upsample_labels(x, n)
    assert "Generate" not in plan(lin) and "Generate" not in plan(lab)
    at = {(i, j): (z, k) for _, i, j, z, k in rows}
    want, named = {}, {}
    for i, ys in enumerate(plain_taps(h, n)):
        for j, xs in enumerate(plain_taps(w, n)):
            hit = [(at[y, q], wy * wx) for y, wy in ys for q, wx in xs if (y, q) in at]
            den = sum(v for (z, _), v in hit if z is not None)
            if den > 0:
                want[i, j] = sum(z * v for (z, _), v in hit if z is not None) / den
            votes = {}
            for (_, k), v in hit:
                votes[k] = votes.get(k, 0) + v
            if votes:
                named[i, j] = min(votes, key=lambda k: (-round(votes[k], 9), k is None, k or 0))
    got = {(r.row, r.col): r.z for r in lin.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {(r.row, r.col): r.class_id for r in lab.collect()} == named


def test_walk_to_the_nearest_grows_with_blocks_not_scenes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n, seen = 9000, []
    real = spatial._with_bounds
    monkeypatch.setattr(spatial, "_with_bounds", lambda df, *a: seen.append(df) or real(df, *a))
    # more products in one cell and more scenes in one block than are compared at once
    at = np.r_[rng.uniform(10, 11, (n - 300, 2)), np.c_[rng.uniform(-90, 90, 300), rng.uniform(0, 360, 300)]]
    prods = [(f"p{i:05d}", "a" if i % 3 else "b", float(y), float(x)) for i, (y, x) in enumerate(at)]
    spots = [(i, float(y), float(x)) for i, (y, x) in enumerate(np.r_[rng.uniform(9, 12, (2000, 2)), np.c_[rng.uniform(-90, 90, 20), rng.uniform(0, 360, 20)]])]
    s, p = spark.createDataFrame(spots, ["scene_id", "lat_deg", "lon_deg"]), spark.createDataFrame(prods, ["product_id", "kind", "lat_deg", "lon_deg"])
    rows = spatial.nearest_products(s, p, 3, levels=(45.0, 11.25)).collect()
    assert all(df.count() < 10000 for df in seen)  # 2020 scenes times the occupied cells would be over 100,000
    got = {}
    for r in rows:
        got.setdefault((r.scene_id, r.kind), set()).add(r.product_id)
    assert len(rows) == len(spots) * 2 * 3
    y, x = np.radians(at[:, 0]), np.radians(at[:, 1])
    kind, name = np.array([r[1] for r in prods]), np.array([r[0] for r in prods])
    for i, lat, lon in spots[::97] + spots[-20:]:
        a = np.sin((y - np.radians(lat)) / 2) ** 2 + np.cos(y) * np.cos(np.radians(lat)) * np.sin((x - np.radians(lon)) / 2) ** 2
        for k in "ab":
            assert got[i, k] == set(name[kind == k][np.argsort(a[kind == k])[:3]])


def test_runs_of_a_key_are_measured_by_segment(spark):
    from selenic.operators import logs

    rng = np.random.default_rng(6)
    rows = [(k, int(p), i, bool(rng.random() < 0.7 if k else i % 2)) for k in range(4) for i, p in enumerate(np.sort(rng.integers(0, 300, 400)))]
    rows += [(4, i, i, True) for i in range(50)] + [(5, i, i, None) for i in range(5)]
    got = logs.longest_run(spark.createDataFrame(rows, "k int, p int, t int, ok boolean"), ["k"], "p", "t", F.col("ok"), F.floor(F.col("p") / 20))
    # a key is dealt by segment, and runs are no rows to be grouped
    assert any("hashpartitioning(k" in x and "_s#" in x for x in plan(got).splitlines()) and "_g#" not in plan(got)
    want = {}
    for k in range(6):
        run = best = 0
        for *_, ok in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            run = run + 1 if ok else 0
            best = max(best, run)
        want[k] = best
    assert {r.k: r.longest for r in got.collect()} == want


def test_draws_of_a_pair_are_dealt_by_runs_of_rounds(spark):
    x = spark.range(64).select(F.lit(1).alias("pair_id"), F.col("id").alias("point_id"), *[
        (F.xxhash64("id", F.lit(k)) % 1000).cast("double").alias(n) for k, n in enumerate(("sx", "sy", "rx", "ry"))])
    few, many = (matching.sample_hypotheses(x, rounds=n) for n in (64, 8192))
    # a pair's points lay in one task, joined tasks too, and were multiplied there by all rounds
    assert "REPARTITION_BY_NUM" in plan(many)
    # the first rounds do not depend on how many follow
    first = many.where(F.col("hyp_id") < 64 * 64)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, first.collect()))


def test_windows_as_arrays_give_the_grids_of_the_cell_path(spark):
    """A window was a row for each of its cells, and more for each step."""
    r = np.random.default_rng(3)
    row, col = (a.ravel() for a in np.indices((70, 60)))
    z = np.where(r.random(row.size) < 0.1, np.nan, np.minimum(r.normal(100, 30, row.size) + row, 160))
    there = (row < 62) | (col < 20)  # a raster with a ragged end
    x = spark.createDataFrame([(1, int(a), int(b), None if np.isnan(v) else float(v)) for a, b, v, k in zip(row, col, z, there) if k],
                              "raster_id long, row int, col int, z double")
    flat = spark.range(64 * 64).selectExpr("2L as raster_id", "int(id / 64) as row", "int(id % 64) as col", "5D as z")
    windows = [(f"w{i}", 1, a, b, min(70, a + h), min(60, b + w)) for i, (a, b, h, w) in enumerate(r.integers((0, 0, 2, 2), (60, 50, 40, 40), (40, 4)).tolist())]
    use = spark.createDataFrame([*windows, ("flat", 2, 3, 3, 9, 9)], "window_id string, raster_id long, r0 int, c0 int, r1 int, c1 int")
    far, notes = jobs.wide_grids(x.unionByName(flat), use, 8)
    got = kernels.window_grids(x.unionByName(flat), use, 8, tile=32).toPandas().set_index("window_id")
    assert sorted(got.index) == sorted(w.window_id for w in use.collect())
    for w in notes.toPandas().itertuples():
        a = got.loc[w.request_id]
        assert w.valid == a.valid and np.isclose(w.relief, a.relief, atol=1e-9)
        assert np.isclose(w.plateau_share, a.plateau_share, equal_nan=True)
    for name, g in far.toPandas().groupby("request_id"):
        assert np.allclose(g.sort_values(["row", "col"]).z, got.loc[name].z, atol=1e-9)


def test_measured_pairs_are_dealt_by_scene_and_ranked_there(spark):
    """The aggregate of measured pairs was as large as the pairs, in a shuffle partition each and once more before the shuffle."""
    scenes = spark.range(50).selectExpr("id as scene_id", "double(id % 80) as lat_deg", "double(id * 7 % 360) as lon_deg")
    products = spark.range(40).selectExpr("concat('p', id) as product_id", "if(id % 2 = 0, 'a', 'b') as kind", "double(id) as lat_deg", "double(id * 9) as lon_deg")
    seen = scenes.crossJoin(products.select("product_id")).selectExpr("scene_id", "product_id", "(scene_id * 13 + length(product_id)) % 7 / 7D as ncc")
    twice = seen.unionByName(seen.selectExpr("scene_id", "product_id", "ncc - 0.5 as ncc"))
    at = scenes.select("scene_id", "lat_deg", "lon_deg")
    one, two = (spatial.candidate_pairs(at, products, m) for m in (seen.select("scene_id", "product_id", "ncc"), twice))
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle by scene into small parts; the aggregate and the ranking find their rows there
    text = plan(two)
    dealt = text.index(f"{parts}), REPARTITION_BY_NUM")
    assert text[:dealt].count("Exchange") == 1 and "HashAggregate(keys=[scene_id" in text[:dealt]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_bounded_rasters_are_swept_as_arrays(spark, monkeypatch):
    """Every factor's cells were rows, resampled and searched in shuffles of their own."""
    r = np.random.default_rng(5)

    def raster(i, h, w, cut=0):
        row, col = (a.ravel() for a in np.indices((h, w)))
        z = np.where(r.random(row.size) < 0.05, np.nan, r.normal(50, 10, row.size) + 5 * np.sin(row / 5) + 5 * np.cos(col / 7))
        return [(i, int(a), int(b), None if np.isnan(v) else float(v)) for a, b, v in zip(row, col, z) if not (a >= h - cut and b > 9)]
    strips, images = (spark.createDataFrame(rows, "raster_id long, row int, col int, z double") for rows in (
        raster(1, 40, 44, 3) + raster(2, 30, 60) + raster(3, 10, 10), raster(1, 50, 48) + raster(2, 33, 41, 4) + raster(3, 9, 9) + raster(4, 20, 20)))

    def sweep(**more):
        out = kernels.scale_sweep(strips, images, base_scale=0.9, min_overlap=16, floor=8, **more).orderBy("raster_id").toPandas()
        assert out.raster_id.tolist() == [1, 2, 3]
        return out.round(9)
    with monkeypatch.context() as m:
        m.setattr(kernels, "SWEEP_SIDE", 0)
        cells_path = [sweep(), sweep(max_tpl=20, max_side=64)]
    monkeypatch.setattr(kernels, "template_ncc", None)
    assert all(a.equals(b) for a, b in zip(cells_path, [sweep(), sweep(max_tpl=20, max_side=64)]))
    assert cells_path[0].factor.isna().tolist() == [False, False, True]


def test_valid_windows_found_in_arrays_are_those_found_by_rows(spark):
    """A try is no row: places over tile borders, frames of one side, empty rasters, steps that end at one place."""
    r = np.random.default_rng(8)
    places = [(k, int(i), int(j)) for k in range(3) for i, j in zip(*np.nonzero(r.random((340, 300)) < (0.55 + 0.2 * k)), strict=True)]
    valid = spark.createDataFrame(places, "raster_id long, row int, col int")
    rows = []
    for i in range(400):
        h, w, gsd = int(r.integers(1, 9)), int(r.integers(1, 9)), float(r.choice([300.0, 1000.0, 2500.0]))
        a, b = int(r.integers(0, 330)), int(r.integers(0, 290))
        rows.append((f"q{i}", int(r.integers(0, 4)), a, b, a + h, b + w, gsd, 340 - (i % 2) * 40, 300))
    req = spark.createDataFrame(rows, "request_id string, raster_id long, r0 int, c0 int, r1 int, c1 int, gsd_m double, lines int, samples int")
    sat = cells.summed_area(valid, F.lit(True), cells.search_reach(req))
    by_rows, found = (cells.nearest_valid_window(sat, req, valid=v) for v in (None, valid))
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().toString() and found.dtypes == by_rows.dtypes
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted(map(tuple, by_rows.collect()), key=str) and {x[-1] for x in got} == {"exact", "moved", "no_valid_data"}


def shuffled_rows(df):
    """Rows that the exchanges of a frame's last plan wrote."""
    df.collect()
    found, queue = 0, [df._jdf.queryExecution().executedPlan()]
    while queue:
        p = queue.pop()
        kinds = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan"}
        if (name := p.getClass().getSimpleName()) in kinds:
            queue.append(getattr(p, kinds[name])())
            continue
        if name == "ShuffleExchangeExec":
            found += p.metrics().apply("shuffleRecordsWritten").value()
        children = p.children()
        queue += [children.apply(i) for i in range(children.size())]
    return found


def test_audit_shuffles_no_pair(spark):
    """Pairs grow with scenes times products; ids that come twice count as joined rows do."""
    corner = "struct<lat_deg:double,lon_deg:double>"
    r = np.random.default_rng(2)
    scenes = [(i, float(a), float(b % 360)) for i, (a, b) in enumerate(zip(r.uniform(-3, 3, 300), r.uniform(-4, 4, 300), strict=True))]
    products = []
    for i in range(200):
        a, b, x = *r.uniform(-1, 1, 2), (10, 4)[i % 2]
        products.append((f"p{i}", tuple((float(a + u * x), float((b + v * x) % 360)) for u, v in ((1, -1), (1, 1), (-1, -1), (-1, 1)))))
    schemas = "scene_id long, lat_deg double, lon_deg double", "product_id string, fp struct<" + ",".join(f"{n}:{corner}" for n in geo.CORNERS) + ">"
    s, p = (spark.createDataFrame(x, y) for x, y in zip((scenes, products), schemas, strict=True))
    found = jobs.coverage_audit(s, p)
    want = jobs._joined_audit(s, p, 0.5, 2.5)
    names = ["scene_id", "product_id", "covers_center", "corner_in_box", "edge_margin_km"]
    got = found.collect()
    assert sorted(tuple(x[:5]) for x in got) == sorted(map(tuple, want.select(*names).collect()))
    assert shuffled_rows(found) < len(got) / 4 and len(got) > 30_000
    best = {x.scene_id: x for x in sorted(got, key=lambda x: (-x.edge_margin_km, x.product_id), reverse=True) if x.covers_center}
    assert {(x.scene_id, x.product_id) for x in got if x.best} == {(k, x.product_id) for k, x in best.items()}
    # rows that repeat an id, at other places, and no id
    s2 = s.where("scene_id < 20").union(spark.createDataFrame([(3, 1.0, 1.0), (3, 1.0, 1.0), (None, 0.0, 0.0)], schemas[0]))
    p2 = p.limit(20).union(p.where("product_id = 'p7'"))
    got, want = jobs.coverage_audit(s2, p2), jobs._joined_audit(s2, p2, 0.5, 2.5)
    assert sorted(tuple(x[:5]) for x in got.collect()) == sorted(map(tuple, want.select(*names).collect()))
