"""Descriptor matching and geometric verification over whole tables of image pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenic.functions import geo, predicates
from selenic.operators.logs import top_k
from selenic.session import materialise

c, lit = F.col, F.lit

# fixed values of the matcher
RATIO, MIN_COSINE, KEYPOINTS = 0.8, 0.5, 400
INLIER_PX = 3.0
MAX_DRAWS = 5000
#: points times rounds of a run of draws, of which a task holds some
DRAW_ROWS = 1 << 17


def top_keypoints(kps: DataFrame, keys: list[str], k: int = KEYPOINTS, response: str = "response", tie: str = "kp_id") -> DataFrame:
    """Strongest keypoints per image."""
    return top_k(kps, keys, [F.desc(response), tie], k)


# ------------------------------------------------------------ nearest neighbours

def _block_pairs(src: DataFrame, ref: DataFrame, size: int):
    """Both sides cut into blocks of about ``size`` descriptors, each block meeting every
    block of the other image of its pair. A pair of any size becomes many bounded groups."""
    def cut(df, name):
        df = df.select("pair_id", c("id").alias(f"{name}_id"), c("vec").alias("vec"))
        n = df.groupBy("pair_id").agg(F.ceil(F.count("*") / size).cast("int").alias(f"_n{name}"))
        return df, n
    (s, ns), (t, nt) = cut(src, "src"), cut(ref, "ref")
    blocks = ns.join(nt, "pair_id")

    def spread(df, own, other):
        df = df.join(blocks, "pair_id")
        df = df.withColumn(f"_{own}", F.pmod(F.xxhash64(f"{own}_id"), c(f"_n{own}")).cast("int"))
        df = df.withColumn(f"_{other}", F.explode(F.sequence(lit(0), c(f"_n{other}") - 1)))
        # fresh column identities: both sides may come from one table
        return df.select(*[c(x).alias(x) for x in ("pair_id", "_src", "_ref", f"{own}_id", "vec")])
    keys = ["pair_id", "_src", "_ref"]
    return spread(s, "src", "ref").groupBy(*keys), spread(t, "ref", "src").groupBy(*keys)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in col])


def knn_ratio_join(src: DataFrame, ref: DataFrame, ratio: float = RATIO, block: int = 4096) -> DataFrame:
    """Nearest reference descriptor per source descriptor if clearly nearer than the second.

    Inputs ``(pair_id, id, vec)``. Every block pair yields two rows per source row, the
    rest stays inside a matrix product; the two best over all blocks are then merged.
    """
    pid = src.schema["pair_id"].dataType.simpleString()
    a, b = _block_pairs(src, ref, block)

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"pair_id": [], "src_id": [], "ref_id": [], "dist": []})
        y = y.sort_values("ref_id")
        m, n = _matrix(x["vec"]), _matrix(y["vec"])
        d2 = (m ** 2).sum(1)[:, None] + (n ** 2).sum(1)[None, :] - 2 * m @ n.T
        k = min(2, n.shape[0])
        near = np.argsort(d2, axis=1, kind="stable")[:, :k]
        # distances of the chosen ones from the differences, exact for copies
        dist = np.sqrt(((m[:, None, :] - n[near]) ** 2).sum(2))
        return pd.DataFrame({"pair_id": np.repeat(x["pair_id"].to_numpy(), k), "src_id": np.repeat(x["src_id"].to_numpy(), k),
                             "ref_id": y["ref_id"].to_numpy()[near].ravel(), "dist": dist.ravel()})
    cand = a.cogroup(b).applyInPandas(run, f"pair_id {pid}, src_id bigint, ref_id bigint, dist double")
    best = cand.groupBy("pair_id", "src_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("dist", "ref_id"))), 1, 2).alias("_b")).where(F.size("_b") == 2)
    near, second = c("_b")[0], c("_b")[1]
    return best.where(near["dist"] < second["dist"] * ratio).select(
        "pair_id", "src_id", near["ref_id"].alias("ref_id"), near["dist"].alias("dist"), second["dist"].alias("dist2"))


def mutual_nn_join(src: DataFrame, ref: DataFrame, min_cos: float = MIN_COSINE, block: int = 4096) -> DataFrame:
    """Pairs that are each other's best by cosine, with ``used`` telling whether the
    cosine also exceeds the threshold."""
    pid = src.schema["pair_id"].dataType.simpleString()
    a, b = _block_pairs(src, ref, block)

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"pair_id": [], "src_id": [], "ref_id": [], "cos": [], "of_src": []})
        x, y = x.sort_values("src_id"), y.sort_values("ref_id")
        m, n = _matrix(x["vec"]), _matrix(y["vec"])
        sim = (m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)) @ (n / (np.linalg.norm(n, axis=1, keepdims=True) + 1e-8)).T
        js, iq = sim.argmax(axis=1), sim.argmax(axis=0)
        i, j = np.arange(len(x)), np.arange(len(y))
        s, r = x["src_id"].to_numpy(), y["ref_id"].to_numpy()
        return pd.DataFrame({"pair_id": x["pair_id"].iat[0], "src_id": np.concatenate([s, s[iq]]), "ref_id": np.concatenate([r[js], r]),
                             "cos": np.concatenate([sim[i, js], sim[iq, j]]), "of_src": np.r_[np.ones(len(i), bool), np.zeros(len(j), bool)]})
    cand = a.cogroup(b).applyInPandas(run, f"pair_id {pid}, src_id bigint, ref_id bigint, cos double, of_src boolean")
    fwd = cand.where("of_src").groupBy("pair_id", "src_id").agg(
        F.max_by(F.struct("ref_id", "cos"), F.struct("cos", (-c("ref_id")).alias("k"))).alias("_b"))
    back = cand.where("not of_src").groupBy("pair_id", "ref_id").agg(F.max_by("src_id", F.struct("cos", (-c("src_id")).alias("k"))).alias("src_id"))
    fwd = fwd.select("pair_id", "src_id", c("_b.ref_id").alias("ref_id"), c("_b.cos").alias("cos"))
    return fwd.join(back, ["pair_id", "src_id", "ref_id"]).withColumn("used", c("cos") > min_cos)


def union_branches(sift: DataFrame, learned: DataFrame) -> DataFrame:
    """All correspondences of both branches, tagged; duplicates stay."""
    cols = ["pair_id", "src_id", "ref_id"]
    return (sift.select(*cols).withColumn("method", lit("sift"))
            .unionByName(learned.where("used").select(*cols).withColumn("method", lit("learned"))))


def ranking_accuracy(triplets: DataFrame, d_pos: Column, d_neg: Column, margin: float = 0.2) -> DataFrame:
    return triplets.agg(F.avg((d_pos < d_neg).cast("int")).alias("accuracy"),
                        F.avg(F.greatest(lit(0.0), d_pos - d_neg + margin)).alias("hinge"), F.count("*").alias("n"))


# ------------------------------------------------------------ verification

H = [f"h{i}" for i in range(9)]
H_SCHEMA = ", ".join(f"{h} double" for h in H)


def sample_hypotheses(corr: DataFrame, buckets: int = 64, rounds: int = 4, start: int = 0) -> DataFrame:
    """Homographies from minimal samples ``(pair_id, hyp_id, h0..h8)``.

    Points are dealt into buckets by hash, four per bucket make a sample: up to
    ``buckets * rounds`` draws per pair, repeatable, and no point list is gathered. ``start``
    is the first round's number.
    """
    n = corr.groupBy("pair_id").agg(F.count("*").alias("_n")).where("_n >= 4")
    points = n.agg(F.sum("_n")).first()[0] or 0  # one row
    # rounds are dealt out before the points are multiplied by them; tasks follow the number of rows that come of it
    runs = n.withColumn("_size", F.greatest(lit(1), F.least(lit(rounds), F.floor(lit(DRAW_ROWS) / c("_n")))).cast("int"))
    runs = runs.withColumn("_run", F.explode(F.sequence(lit(0), F.floor((lit(rounds) - 1) / c("_size")).cast("int"))))
    parts = max(int(corr.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points * rounds // (8 * DRAW_ROWS)))
    x = corr.join(runs, "pair_id").repartition(parts, "pair_id", "_run")
    first = c("_run") * c("_size") + start
    x = x.withColumn("_seed", F.explode(F.sequence(first, F.least(first + c("_size"), lit(start + rounds)) - 1)))
    x = x.withColumn("_draw", F.xxhash64("point_id", "_seed"))
    x = x.withColumn("_bucket", F.pmod(F.xxhash64("_draw", lit(17)), F.least(lit(buckets), F.floor(c("_n") / 4))).cast("int"))
    four = top_k(x, ["pair_id", "_run", "_seed", "_bucket"], ["_draw", "point_id"], 4)
    sample = four.groupBy("pair_id", "_run", "_seed", "_bucket").agg(F.sort_array(F.collect_list(
        F.struct("rank", "sx", "sy", "rx", "ry"))).alias("_p")).where(F.size("_p") == 4)
    sample = sample.select("pair_id", (c("_seed") * buckets + c("_bucket")).alias("hyp_id"),
                           *[c(f"_p.{k}").alias(k) for k in ("sx", "sy", "rx", "ry")])
    return sample.mapInPandas(_solve_samples, f"pair_id {corr.schema['pair_id'].dataType.simpleString()}, hyp_id int, {H_SCHEMA}")


def _solve_samples(batches):
    for pdf in batches:
        if pdf.empty:
            continue
        x, y, u, v = (np.stack(pdf[k]) for k in ("sx", "sy", "rx", "ry"))
        o, z = np.ones_like(x), np.zeros_like(x)
        a = np.concatenate([np.stack([x, y, o, z, z, z, -x * u, -y * u], 2), np.stack([z, z, z, x, y, o, -x * v, -y * v], 2)], 1)
        b = np.concatenate([u, v], 1)
        ok = np.abs(np.linalg.det(a / 1024.0)) > 1e-12
        h = np.linalg.solve(np.where(ok[:, None, None], a, np.eye(8)), b[:, :, None])[:, :, 0]
        out = pdf[["pair_id", "hyp_id"]].copy()
        for i in range(8):
            out[H[i]] = h[:, i]
        out[H[8]] = 1.0
        yield out[ok & np.isfinite(h).all(1)]


def score_homographies(corr: DataFrame, hyps: DataFrame, px: float = INLIER_PX) -> DataFrame:
    """Inliers per candidate homography ``(pair_id, hyp_id)``.

    The candidates of a pair, bounded by the draws of a pass, travel as one array; the counts are
    partially aggregated next to the scan, so points times candidates is never shuffled.
    """
    packed = hyps.groupBy("pair_id").agg(F.collect_list(F.struct("hyp_id", *H)).alias("_h"))
    x = corr.join(packed, "pair_id").select("pair_id", "sx", "sy", "rx", "ry", F.explode("_h").alias("_h"))
    res = geo.residual([c(f"_h.{h}") for h in H], c("sx"), c("sy"), c("rx"), c("ry"))
    return x.groupBy("pair_id", c("_h.hyp_id").alias("hyp_id")).agg(F.count_if(res < px).alias("inliers"))


def refit(inliers: DataFrame, scale: float = 1024.0) -> DataFrame:
    """Least-squares homography per pair from moment sums: one aggregate, then 8 x 8 solves."""
    x, y, u, v = (c(k) / scale for k in ("sx", "sy", "rx", "ry"))
    one, zero = lit(1.0), lit(0.0)
    top = [x, y, one, zero, zero, zero, -x * u, -y * u]
    low = [zero, zero, zero, x, y, one, -x * v, -y * v]
    aggs = [F.sum(top[i] * top[j] + low[i] * low[j]).alias(f"a{i}{j}") for i in range(8) for j in range(i, 8)]
    aggs += [F.sum(top[i] * u + low[i] * v).alias(f"b{i}") for i in range(8)]
    sums = inliers.groupBy("pair_id").agg(*aggs)

    def solve(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                a = np.array([[rec[f"a{min(i, j)}{max(i, j)}"] for j in range(8)] for i in range(8)])
                h = np.append(np.linalg.lstsq(a, np.array([rec[f"b{i}"] for i in range(8)]), rcond=None)[0], 1.0).reshape(3, 3)
                s = np.diag([1 / scale, 1 / scale, 1.0])
                h = np.linalg.inv(s) @ h @ s
                rows.append([rec["pair_id"], *(h / h[2, 2]).ravel()])
            yield pd.DataFrame(rows, columns=["pair_id", *H])
    return sums.mapInPandas(solve, f"pair_id {inliers.schema['pair_id'].dataType.simpleString()}, {H_SCHEMA}")


def homography_vote(corr: DataFrame, buckets: int = 64, rounds: int = 4, px: float = INLIER_PX, confidence: float = 0.99,
                    max_draws: int = MAX_DRAWS) -> DataFrame:
    """Verified correspondences: the best sampled homography per pair, refitted on its
    inliers, with residual and inlier flag for every candidate.

    Draws go on, four times as many rounds each time, for the pairs whose draws are fewer
    than the best share so far asks for at ``confidence``, up to ``max_draws`` a pair.
    """
    size = corr.groupBy("pair_id").agg(F.count("*").alias("n")).where("n >= 4")
    size = size.withColumn("_each", F.least(lit(buckets), F.floor(c("n") / 4)))
    active, best, start = size.select("pair_id"), None, 0
    while True:
        hyps = materialise(sample_hypotheses(corr.join(active, "pair_id", "left_semi"), buckets, rounds, start), "hypotheses")
        # the best draw is told by its votes, its matrix is looked up afterwards
        votes = score_homographies(corr, hyps, px)
        top = F.max_by(F.struct("hyp_id", "inliers"), F.struct("inliers", (-c("hyp_id")).alias("k")))
        votes = votes.groupBy("pair_id").agg(top.alias("_b")).select("pair_id", "_b.*").join(hyps, ["pair_id", "hyp_id"])
        if best is not None:
            votes = votes.unionByName(best)
        top = F.max_by(F.struct("hyp_id", "inliers", *H), F.struct("inliers", (-c("hyp_id")).alias("k")))
        best = materialise(votes.groupBy("pair_id").agg(top.alias("_b")).select("pair_id", "_b.*"), "models")
        start += rounds
        drawn = F.least(c("_each") * start, lit(max_draws))
        share = F.coalesce(c("inliers") / c("n"), lit(0.0))
        active = size.join(best, "pair_id", "left").where(drawn < F.least(lit(max_draws), geo.ransac_budget(share, confidence))).select("pair_id")
        if start >= max_draws or active.isEmpty():
            break
        rounds = min(3 * start, max_draws - start)
    model = best.select("pair_id", *H)

    def judged(m, size):
        res = geo.residual([c(h) for h in H], c("sx"), c("sy"), c("rx"), c("ry"))
        return corr.join(m, "pair_id", "left").withColumn("residual", res).withColumn("inlier", F.coalesce(c("residual") < size, lit(False)))
    fitted = refit(judged(model, px).where("inlier").drop(*H))
    return judged(fitted, px)


def match_summary(verified: DataFrame, keys: list[str] | None = None, minimum: int = 8) -> DataFrame:
    """Counts per method, inliers, share over all candidates, RMSE, budget and status."""
    keys = keys or ["pair_id"]
    n, good = c("candidates"), c("inlier")
    m = verified.groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.count_if(c("method") == "sift").alias("sift_candidates"),
        F.count_if(c("method") == "learned").alias("learned_pairs_used"), F.count_if(good).alias("_in"),
        F.sqrt(F.avg(F.when(good, c("residual") * c("residual")))).alias("_rmse"))
    enough = n >= minimum
    share = F.when(enough, c("_in") / n).otherwise(0.0)
    return m.select(*keys, "candidates", "sift_candidates", "learned_pairs_used",
                    F.when(enough, c("_in")).otherwise(0).alias("inlier_count"), share.alias("inlier_ratio"),
                    (share * 100.0).alias("match_percentage"), F.when(enough, c("_rmse")).alias("rmse_px"),
                    F.when(enough, geo.ransac_budget(share)).alias("ransac_k"),
                    predicates.support_status(n, minimum).alias("status"))


def best_candidate(scored: DataFrame, keys: list[str], score: str, tie: str, top: int | None = None, coarse: str | None = None) -> DataFrame:
    """Best candidate by its score after alignment, among the ``top`` by coarse score or all."""
    if top:
        scored = top_k(scored, keys, [F.desc(coarse), tie], top).drop("rank")
    rest = [x for x in scored.columns if x not in keys]
    # ids may be text, so the tie is broken by an ordered pair with the score negated
    best = scored.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-c(score)).alias("s"), c(tie))).alias("_b"))
    return best.select(*keys, *[c(f"_b.{x}").alias(x) for x in rest])


