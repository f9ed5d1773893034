"""Hard-negative mining by anchor-clustered shared lists.

Anchors are a stated query set; every other row is a candidate for each of them. A row's score is
the inner product of whole-number vectors with the anchor. An anchor's positives are its first
``positives`` other rows of the same label; a positive's negatives are the first ``negatives`` rows
of another label whose score lies between ``share`` percent of the positive's and the positive's.

1. Anchors are clustered by direction: spherical k-means on at most ``FIT`` of them (and ``FIT_BYTES``)
   finds the centroids, every anchor joins its nearest, and a cluster keeps the widest angle of its members.
   Clusters of over ``MEMBERS`` anchors are cut into parts.
2. For every member of a cluster, ``|anchor| * |row| * cos(max(0, angle to the centroid - widest))``
   bounds a row's score. A row goes to those clusters where the bound reaches what a member still needs.
3. Parts and rows meet in blocks of about ``BLOCK`` rows, one Python group each. A block sorts its
   rows by the bound once; its members walk that list together, in steps, and leave it as soon as
   the bound of the next row is below what they need: certified, so results are exact.
4. Three walks: over each row's nearest cluster alone, for a first floor of the fifth positive's
   score; over all clusters for the positives; and for the negatives within the known intervals.
   Blocks return five rows for an anchor (and positive); the best of them are the result.

Of rows with equal label and vector only the first few ids can be anybody's positive or negative, so
the others stay out of the lists (exact: equal vectors have equal scores); no copy group is held.

Rows with a null id, label or vector, or with any null or non-finite component, take no part. Rows
that repeat id, label and vector count once, and a row of the anchor's own id is never its positive or
negative. Vectors of different length have no score with each other. Ties go to the smaller id.
Scores are exact below 2**53. A positive with a negative score has no negatives. An anchor without
results gives no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenic.llm.common import settle

FIT = 8_192
ANCHORS_A_CLUSTER = 256
MAX_CLUSTERS = 1_024
#: anchors and rows of a Python group at most on average, and bytes of their vectors
MEMBERS, MEMBER_BYTES = 2_048, 4 << 20
BLOCK, BLOCK_BYTES = 4_096, 16 << 20
#: bytes of the vectors that k-means sees in the driver
FIT_BYTES = 64 << 20
STEP = 512
#: share of the bound that rounding may cost
SLACK = 1e-9


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Directions of spherical k-means; the start is spread by farthest points, so it needs no luck."""
    norm = np.linalg.norm(x, axis=1)
    x = x[norm > 0] / norm[norm > 0, None]
    if not len(x):
        return np.zeros((0, x.shape[1]))
    start, near = [0], x @ x[0]
    while len(start) < min(k, len(x)):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], c)
    return c


def angles(x: np.ndarray, norm: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Angle of each vector to each centroid; 0 for a zero vector, whose bound is 0 anyway."""
    cos = (x @ c.T) / np.where(norm > 0, norm, 1)[:, None]
    return np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0.0)


def bounds(norm: np.ndarray, angle: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """Upper bound of a row's score with a unit vector of the cluster, with room for rounding."""
    gap = np.maximum(0, angle - widest - 1e-7)
    return norm * np.cos(gap) + norm * SLACK


def unpack(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), "<f8").reshape(len(col), dim)


class Best:
    """For each list its first ``k`` (score, id), scores descending and ids ascending."""

    def __init__(self, lists: int, k: int):
        self.score, self.id = np.full((lists, k), -np.inf), np.full((lists, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Rows ``at`` of the lists get the candidates ``ident`` with ``score`` (lists x candidates; -inf: none)."""
        k = self.score.shape[1]
        hit = np.flatnonzero((score >= self.score[at, -1:]).any(axis=1) & (score > -np.inf).any(axis=1))
        for i in hit:
            j = np.flatnonzero((score[i] >= self.score[at[i], -1]) & (score[i] > -np.inf))
            s, d = np.append(self.score[at[i]], score[i, j]), np.append(self.id[at[i]], ident[j])
            order = np.lexsort((d, -s))[:k]
            self.score[at[i]], self.id[at[i]] = s[order], d[order]


def walk_positives(members: pd.DataFrame, u: np.ndarray, rows: pd.DataFrame, v: np.ndarray, bound: np.ndarray, k: int, step: int = STEP) -> Best:
    """First ``k`` rows of each member's label, of those that reach its ``need``."""
    best = Best(len(members), k)
    need, norm = members["need"].to_numpy(float), np.linalg.norm(u, axis=1)
    label, ident = members["label"].to_numpy(), members["id"].to_numpy()
    of, row = rows["label"].to_numpy(), rows["id"].to_numpy()
    at = np.arange(len(members))
    for i in range(0, len(rows), step):
        least = np.maximum(need[at], best.score[at, -1])
        at = at[(norm[at] * bound[i] >= least) | (norm[at] == 0)]
        if not len(at):
            break
        part = slice(i, i + step)
        score = u[at] @ v[part].T
        fits = (label[at, None] == of[None, part]) & (ident[at, None] != row[None, part]) & (score >= need[at, None])
        best.add(at, np.where(fits, score, -np.inf), row[part])
    return best


def walk_negatives(members: pd.DataFrame, u: np.ndarray, rows: pd.DataFrame, v: np.ndarray, bound: np.ndarray, k: int, share: int,
                   step: int = STEP) -> Best:
    """First ``k`` rows of other labels in the interval of each of a member's positives; lists lie member by member."""
    top = np.array(members["scores"].tolist(), dtype=float)
    m, p = top.shape
    best = Best(m * p, k)
    norm, label, ident = np.linalg.norm(u, axis=1), members["label"].to_numpy(), members["id"].to_numpy()
    of, row = rows["label"].to_numpy(), rows["id"].to_numpy()
    floor = np.where(top >= 0, share * top / 100, np.inf)
    at = np.arange(m)
    for i in range(0, len(rows), step):
        least = np.maximum(floor, best.score[:, -1].reshape(m, p)).min(axis=1)[at]
        at = at[(norm[at] * bound[i] >= least - 1e-6) | (norm[at] == 0)]
        if not len(at):
            break
        part = slice(i, i + step)
        score = u[at] @ v[part].T
        fits = (label[at, None] != of[None, part]) & (ident[at, None] != row[None, part])
        for j in range(p):
            inside = fits & (score <= top[at, j, None]) & (100 * score >= share * top[at, j, None])
            best.add(at * p + j, np.where(inside, score, -np.inf), row[part])
    return best


def vectors(df: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, dim, v): the rows that take part, v being the packed doubles of the whole-number vector."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(~bad, F.lit(True)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.floor(256 * np.array(x, dtype=np.float64)) + 0.0 for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([len(x) for x in v], pa.int32()),
                                              pa.array([x.astype("<f8").tobytes() for x in v], pa.binary())], ["id", "label", "dim", "v"])

    kind = dict(rows.dtypes)["label"]
    return rows.mapInArrow(pack, f"id long, label {kind}, dim int, v binary")


def assigned(anchors: DataFrame, fit: int) -> tuple[DataFrame, dict[int, np.ndarray], dict[int, np.ndarray]]:
    """The anchors with ``cluster`` and ``part``, the centroids and widest angles by length of the vectors."""
    spark = anchors.sparkSession
    total, longest = anchors.agg(F.count(F.lit(1)), F.max("dim")).first()
    fit = max(1, min(fit, FIT_BYTES // (8 * max(longest or 0, 1))))
    drawn = anchors.orderBy(F.xxhash64("id", F.lit("centroid sample"))).limit(fit).select("dim", "v").toPandas()
    found = {}
    for dim, g in drawn.groupby("dim"):
        share = total * len(g) / max(len(drawn), 1)
        k = int(min(MAX_CLUSTERS, max(1, np.ceil(share / ANCHORS_A_CLUSTER))))
        if dim and len(c := centroids(unpack(g["v"], dim), k)):
            found[int(dim)] = c
    shared = spark.sparkContext.broadcast(found)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(cluster=0, angle=np.pi)
            for dim, g in pdf.groupby("dim"):
                if dim in shared.value:
                    x = unpack(g["v"], dim)
                    a = angles(x, np.linalg.norm(x, axis=1), shared.value[dim])
                    pdf.loc[g.index, "cluster"] = a.argmin(axis=1)
                    pdf.loc[g.index, "angle"] = a.min(axis=1)
            yield pdf

    placed = settle(anchors.mapInPandas(near, f"id long, label {dict(anchors.dtypes)['label']}, dim int, v binary, cluster int, angle double"))
    sizes = placed.groupBy("dim", "cluster").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("widest"))
    wide = {}
    for r in sizes.where(F.col("dim").isin([*found])).collect():  # MAX_CLUSTERS rows for a length at most
        wide.setdefault(r["dim"], np.zeros(len(found[r["dim"]])))[r["cluster"]] = r["widest"]
    parts = F.ceil(F.col("n") * F.greatest(F.lit(1 / MEMBERS), F.col("dim") * (8 / MEMBER_BYTES)))
    placed = placed.join(sizes.select("dim", "cluster", parts.alias("parts")), ["dim", "cluster"])
    return placed.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("angle", "parts"), found, wide


GROUP = ["dim", "cluster", "part", "block"]


def routed(rows: DataFrame, members: DataFrame, found: dict[int, np.ndarray], wide: dict[int, np.ndarray],
           nearest: bool) -> tuple[DataFrame, DataFrame]:
    """The rows for each part of every cluster whose least need their bound reaches, and the members, both by ``GROUP``."""
    spark = rows.sparkSession
    unit = F.when(F.col("length") > 0, F.col("need") / F.col("length")).otherwise(float("-inf"))
    shared = spark.sparkContext.broadcast((found, wide))
    by_cluster = members.groupBy("dim", "cluster").agg(F.min(unit).alias("least"), F.max("part").alias("last"))
    # MAX_CLUSTERS rows for a length of the fitted lengths at most
    low = {dim: np.full(len(c), np.inf) for dim, c in found.items()}
    for r in by_cluster.where(F.col("dim").isin([*found])).collect():
        low[r["dim"]][r["cluster"]] = r["least"]
    needs = spark.sparkContext.broadcast(low)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, w = shared.value
        for pdf in batches:
            for dim, g in pdf.groupby("dim"):
                if dim not in c:  # no centroid was fitted for this length: its norm is the bound
                    yield g.assign(cluster=0, bound=np.inf)
                    continue
                x = unpack(g["v"], dim)
                norm = np.linalg.norm(x, axis=1)
                angle = angles(x, norm, c[dim])
                bound = bounds(norm[:, None], angle, w[dim])
                goes = bound >= needs.value[dim] - 1e-6
                if nearest:
                    goes &= np.arange(len(c[dim])) == angle.argmin(axis=1)[:, None]
                i, k = np.nonzero(goes)
                yield g.iloc[i].assign(cluster=k, bound=bound[i, k])

    kind = dict(rows.dtypes)["label"]
    sent = rows.mapInPandas(route, f"id long, label {kind}, dim int, v binary, cluster int, bound double")
    blocks = F.ceil(F.count(F.lit(1)) * F.greatest(F.lit(1 / BLOCK), F.col("dim") * (8 / BLOCK_BYTES))).cast("int")
    blocks = sent.groupBy("dim", "cluster").agg(blocks.alias("blocks"))
    shape = by_cluster.select("dim", "cluster", "last").join(blocks, ["dim", "cluster"])
    sent = sent.join(shape, ["dim", "cluster"])
    sent = sent.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), "blocks").cast("int"))
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), "last"))).drop("last", "blocks")
    own = members.join(shape.select("dim", "cluster", "blocks"), ["dim", "cluster"])
    return sent, own.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def _walked(rows: DataFrame, members: DataFrame, found, wide, nearest: bool, lists) -> DataFrame:
    """Run ``lists(members, u, rows, v, bound)`` in every group of a part and a block."""
    sent, own = routed(rows, members, found, wide, nearest)

    def walk(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return lists(a.iloc[:0], np.zeros((0, 0)), b.iloc[:0], np.zeros((0, 0)), np.zeros(0))
        dim = int(a["dim"].iat[0])
        b = b.iloc[np.argsort(-b["bound"].to_numpy(), kind="stable")]
        return lists(a, unpack(a["v"], dim), b, unpack(b["v"], dim), b["bound"].to_numpy())

    return own.groupBy(*GROUP).cogroup(sent.groupBy(*GROUP)).applyInPandas(walk, "anchor long, place long, score double, id long")


def mine(df: DataFrame, anchor: Column | None = None, label: Column | None = None, positives: int = 5, negatives: int = 5, share: int = 80,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", fit: int = FIT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchor`` picks the anchors by ``id``."""
    anchor = F.col("id") % 100 == 0 if anchor is None else anchor
    rows = vectors(df, id_col, vec_col, F.col(label_col) if label is None else label).dropDuplicates(["label", "v", "id"])
    rows = settle(rows)
    keep = max(positives, negatives) + 1  # and one for the anchor itself
    first = F.row_number().over(Window.partitionBy("dim", "v", "label").orderBy("id"))
    listed = settle(rows.withColumn("_n", first).where(F.col("_n") <= keep).drop("_n"))
    members, found, wide = assigned(rows.where(anchor), fit)
    length = F.pandas_udf(lambda v: pd.Series([float(np.linalg.norm(np.frombuffer(x, "<f8"))) for x in v]), "double")
    members = settle(members.withColumn("length", length("v")))

    def positive_lists(a, u, b, v, bound) -> pd.DataFrame:
        best = walk_positives(a, u, b, v, bound, positives)
        i, j = np.nonzero(best.score > -np.inf)
        return pd.DataFrame({"anchor": a["id"].to_numpy()[i], "place": a["slot"].to_numpy()[i] if len(a) else i, "score": best.score[i, j], "id": best.id[i, j]})

    members = settle(members.withColumn("slot", F.monotonically_increasing_id()))
    order = Window.partitionBy("place").orderBy(F.desc("score"), "id")
    near = _walked(listed, members.withColumn("need", F.lit(0.0)), found, wide, True, positive_lists)
    # the fifth best of some rows is no better than the fifth best of all
    floor = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == positives).select(F.col("place").alias("slot"), F.col("score").alias("need"))
    needy = settle(members.join(floor, "slot", "left").withColumn("need", F.coalesce("need", F.lit(0.0))))
    found_pos = _walked(listed, needy, found, wide, False, positive_lists)
    pos = settle(found_pos.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives))

    scores = pos.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("s"))
    padded = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda k: F.coalesce(F.try_element_at("s", k.cast("int"))["score"], F.lit(-1.0)))
    scores = scores.select(F.col("place").alias("slot"), padded.alias("scores"), (F.element_at("s", -1)["score"] * share / 100).alias("need"))

    def negative_lists(a, u, b, v, bound) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"anchor": [], "place": [], "score": [], "id": []})
        best = walk_negatives(a, u, b, v, bound, negatives, share)
        i, j = np.nonzero(best.score > -np.inf)
        k = i // positives
        return pd.DataFrame({"anchor": a["id"].to_numpy()[k], "place": a["slot"].to_numpy()[k] * positives + i % positives, "score": best.score[i, j], "id": best.id[i, j]})

    neg = _walked(listed, settle(members.join(scores, "slot")), found, wide, False, negative_lists)
    neg = neg.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= negatives)
    neg = neg.select(F.floor(F.col("place") / positives).alias("slot"), (F.col("place") % positives + 1).cast("int").alias("rank"), F.col("nth").alias("nth"),
                     F.col("id").alias("negative_id"), F.col("score").cast("long").alias("negative_score"))
    pos = pos.select(F.col("place").alias("slot"), F.col("rank").cast("int").alias("rank"), F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"),
                     F.col("score").cast("long").alias("positive_score"))
    out = pos.join(neg, ["slot", "rank"])
    return out.select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def relabelled() -> Column:
    """The label of the query: every seventh id moves on to the next of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


ORACLE = """
WITH rows0 AS MATERIALIZED (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM rows0 a JOIN rows0 b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) <= 5
"""
