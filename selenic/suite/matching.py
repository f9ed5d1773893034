"""Descriptor and verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenic.functions import predicates, spectra
from selenic.operators import logs, matching
from selenic.suite.registry import query, r

c, lit = F.col, F.lit


def sides(inp):
    """Even vectors of a pair are the source image, odd ones the reference."""
    d = inp.fx("descriptors").select("pair_id", c("vec_id").alias("id"), "vec", "side")
    return d.where("side = 0").drop("side"), d.where("side = 1").drop("side")


KNN = """SELECT pair_id, src_id, ref_id, d, row_number() OVER (PARTITION BY src_id ORDER BY d, ref_id) AS rn, lead(d) OVER (PARTITION BY src_id ORDER BY d, ref_id) AS d2
  FROM (SELECT s.pair_id, s.vec_id AS src_id, t.vec_id AS ref_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(s.vec[i] - t.vec[i], 2)))) AS d
  FROM {fx:descriptors} s JOIN {fx:descriptors} t ON s.pair_id = t.pair_id AND s.side = 0 AND t.side = 1) q"""
COS = """SELECT pair_id, src_id, ref_id, cos, row_number() OVER (PARTITION BY src_id ORDER BY cos DESC, ref_id) AS r1, row_number() OVER (PARTITION BY ref_id ORDER BY cos DESC, src_id) AS r2
  FROM (SELECT s.pair_id, s.vec_id AS src_id, t.vec_id AS ref_id, list_dot_product(s.vec, t.vec) / ((sqrt(list_dot_product(s.vec, s.vec)) + 1e-8) * (sqrt(list_dot_product(t.vec, t.vec)) + 1e-8)) AS cos
  FROM {fx:descriptors} s JOIN {fx:descriptors} t ON s.pair_id = t.pair_id AND s.side = 0 AND t.side = 1) q"""


@query("joi_05_knn_ratio", f"""
SELECT pair_id, src_id, ref_id, round(d, 5) AS dist, round(d2, 5) AS dist2 FROM ({KNN}) k WHERE rn = 1 AND d < 0.98 * d2""")
def _(inp):
    out = matching.knn_ratio_join(*sides(inp), ratio=0.98, block=40)
    return out.select("pair_id", "src_id", "ref_id", r("dist", 5).alias("dist"), r("dist2", 5).alias("dist2"))


@query("joi_06_mutual_nn", f"SELECT pair_id, src_id, ref_id, round(cos, 5) AS cos, cos > 0.5 AS used FROM ({COS}) k WHERE r1 = 1 AND r2 = 1")
def _(inp):
    return matching.mutual_nn_join(*sides(inp), block=40).withColumn("cos", r("cos", 5))


UNION = f"""SELECT pair_id, src_id, ref_id, 'sift' AS method FROM ({KNN}) k WHERE rn = 1 AND d < 0.98 * d2
UNION ALL SELECT pair_id, src_id, ref_id, 'learned' FROM ({COS}) k WHERE r1 = 1 AND r2 = 1 AND cos > 0.2"""


@query("set_01_union_branches", UNION)
def _(inp):
    src, ref = sides(inp)
    return matching.union_branches(matching.knn_ratio_join(src, ref, 0.98), matching.mutual_nn_join(src, ref, 0.2))


@query("srt_02_top_keypoints", """
SELECT pair_id, kp_id, rank FROM (SELECT pair_id, point_id AS kp_id, row_number() OVER (PARTITION BY pair_id ORDER BY sx DESC, point_id) AS rank FROM {fx:corr}) q WHERE rank <= 400""")
def _(inp):
    k = inp.fx("corr").select("pair_id", c("point_id").alias("kp_id"), c("sx").alias("response"))
    return matching.top_keypoints(k, ["pair_id"]).select("pair_id", "kp_id", "rank")


@query("srt_01_top_craters", """
SELECT scene_id, cand_id, row_number() OVER (PARTITION BY scene_id ORDER BY radius_px DESC, cand_id) AS rank FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY cand_id) AS rn FROM {fx:candidates}) q WHERE rn <= 80) q2
QUALIFY rank <= 25""")
def _(inp):
    first = logs.top_k(inp.fx("candidates"), ["scene_id"], ["cand_id"], 80).drop("rank")
    return logs.top_k(first, ["scene_id"], [F.desc("radius_px"), "cand_id"], 25).select("scene_id", "cand_id", "rank")


@query("srt_03_best_candidate", """
SELECT scene_id, product_id, round(ncc, 6) AS ncc, scope FROM (
  SELECT scene_id, product_id, ncc, 'all' AS scope, row_number() OVER (PARTITION BY scene_id ORDER BY (ncc * 7) % 1 DESC, product_id) AS rn FROM {fx:measured}
  UNION ALL SELECT scene_id, product_id, ncc, 'top4', row_number() OVER (PARTITION BY scene_id ORDER BY (ncc * 7) % 1 DESC, product_id) FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY ncc DESC, product_id) AS k FROM {fx:measured}) q WHERE k <= 4) q2) q3 WHERE rn = 1""")
def _(inp):
    m = inp.fx("measured").withColumn("aligned", c("ncc") * 7 % 1)
    every = matching.best_candidate(m, ["scene_id"], "aligned", "product_id").withColumn("scope", lit("all"))
    four = matching.best_candidate(m, ["scene_id"], "aligned", "product_id", 4, "ncc").withColumn("scope", lit("top4"))
    return every.unionByName(four).select("scene_id", "product_id", r("ncc").alias("ncc"), "scope")


SUMMARY = """SELECT pair_id, count(*) AS candidates, count(*) FILTER (WHERE method = 'sift') AS sift_candidates, count(*) FILTER (WHERE method = 'learned') AS learned_pairs_used,
  CASE WHEN count(*) >= 8 THEN count(*) FILTER (WHERE res < 3) ELSE 0 END AS inlier_count,
  CASE WHEN count(*) >= 8 THEN count(*) FILTER (WHERE res < 3) / count(*)::DOUBLE ELSE 0 END AS inlier_ratio,
  CASE WHEN count(*) >= 8 THEN sqrt(avg(res * res) FILTER (WHERE res < 3)) END AS rmse_px,
  CASE WHEN count(*) < 8 THEN 'insufficient_candidates' ELSE 'ok' END AS status
FROM (SELECT *, sqrt(power(sx * 1.01 + 5.5 - rx, 2) + power(sy * 0.99 - 2.5 - ry, 2)) AS res FROM {fx:corr}) q GROUP BY pair_id"""


def _judged(inp):
    res = F.hypot(c("sx") * 1.01 + 5.5 - c("rx"), c("sy") * 0.99 - 2.5 - c("ry"))
    return inp.fx("corr").withColumn("residual", res).withColumn("inlier", c("residual") < 3)


@query("agg_09_match_summary", f"""
SELECT pair_id, candidates, sift_candidates, learned_pairs_used, inlier_count, round(inlier_ratio, 6) AS inlier_ratio, round(100 * inlier_ratio, 4) AS match_percentage,
  round(rmse_px, 6) AS rmse_px, status FROM ({SUMMARY}) s""")
def _(inp):
    s = matching.match_summary(_judged(inp)).drop("ransac_k")
    return s.withColumns({"inlier_ratio": r("inlier_ratio"), "match_percentage": r("match_percentage", 4), "rmse_px": r("rmse_px")})


@query("fil_06_min_support", """
SELECT user_id, CASE WHEN n < 8 THEN 'insufficient_candidates' ELSE 'ok' END AS status, i >= 10 AS enough FROM (
  SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 50) AS i FROM {events} GROUP BY user_id) q""")
def _(inp):
    n = inp.table("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(c("value") > 50).alias("i"))
    return n.select("user_id", predicates.support_status(c("n")).alias("status"), predicates.enough_inliers(c("i")).alias("enough"))


@query("agg_13_ranking_accuracy", """
SELECT round(avg(CASE WHEN dp < dn THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(greatest(0.0, dp - dn + 0.2)), 6) AS hinge, count(*) AS n FROM (
  SELECT sqrt(list_sum(list_transform(range(1, 65), lambda i: power(a.vec[i] - p.vec[i], 2)))) AS dp, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(a.vec[i] - n.vec[i], 2)))) AS dn
  FROM {fx:descriptors} a JOIN {fx:descriptors} p ON p.vec_id = a.vec_id + 10 JOIN {fx:descriptors} n ON n.vec_id = a.vec_id + 1) q""")
def _(inp):
    d = inp.fx("descriptors")
    a = d.select("vec_id", c("vec").alias("va"))
    p = d.select((c("vec_id") - 10).alias("vec_id"), c("vec").alias("vp"))
    n = d.select((c("vec_id") - 1).alias("vec_id"), c("vec").alias("vn"))
    t = a.join(p, "vec_id").join(n, "vec_id").select(spectra.l2(c("va"), c("vp")).alias("dp"), spectra.l2(c("va"), c("vn")).alias("dn"))
    return matching.ranking_accuracy(t, c("dp"), c("dn")).select(r("accuracy").alias("accuracy"), r("hinge").alias("hinge"), "n")


HYPS = """SELECT pair_id, CAST(k AS INT) AS hyp_id, CAST(1 + k * 0.002 AS DOUBLE) AS h0, CAST(0 AS DOUBLE) AS h1, CAST(5.5 AS DOUBLE) AS h2, CAST(0 AS DOUBLE) AS h3, CAST(0.99 AS DOUBLE) AS h4,
  CAST(-2.5 - (pair_id % 3) AS DOUBLE) AS h5, CAST(0 AS DOUBLE) AS h6, CAST(k * 0.000001 AS DOUBLE) AS h7, CAST(1 AS DOUBLE) AS h8
FROM (SELECT DISTINCT pair_id FROM {fx:corr}) p"""


@query("agg_17_score_homographies", f"""
SELECT c.pair_id, hyp_id, count(*) FILTER (WHERE sqrt(power((h0 * sx + h1 * sy + h2) / (h6 * sx + h7 * sy + h8) - rx, 2) + power((h3 * sx + h4 * sy + h5) / (h6 * sx + h7 * sy + h8) - ry, 2)) < 3) AS inliers
FROM {{fx:corr}} c JOIN ({HYPS}, (SELECT unnest(range(0, 9)) AS k) g) h ON c.pair_id = h.pair_id GROUP BY 1, 2""")
def _(inp):
    hyps = inp.sql(HYPS + " LATERAL VIEW explode(sequence(0, 8)) g AS k")
    return matching.score_homographies(inp.fx("corr"), hyps)


# two thirds of the points follow one model, up to a small jitter
@query("agg_17_homography_vote", """
SELECT pair_id, count(*) AS candidates, count(*) FILTER (WHERE point_id % 3 <> 0) AS inliers FROM {fx:corr} GROUP BY pair_id""")
def _(inp):
    v = matching.homography_vote(inp.fx("corr"))
    return v.groupBy("pair_id").agg(F.count("*").alias("candidates"), F.count_if("inlier").alias("inliers"))
