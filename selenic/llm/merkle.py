"""Merkle manifest of a dataset, built and proved by cogrouped subtree exchange.

Each row is a leaf: the SHA-256 of its columns, each ``-`` if null, else its UTF-8 byte count, ``:``
and its value. Within a group the leaves ascend by id; every ``ARITY`` consecutive nodes (the last
run may be shorter, even one) become their hash, level by level, until one is left: the group's
root. The group roots, in the order of their names, make the tree above in the same way.

1. Leaves are hashed in SQL (texts go no further), dealt by ranges of (group, id) and sorted, so a
   row's place is its rank in its range plus the ranges before it: no window over a group.
2. A superblock is ``ARITY ** HEIGHT`` consecutive leaves of a large group, or the small groups that
   start within as many places; it is one Python group whatever the data. Each large group's
   superblocks are reduced to one node each; these nodes are the leaves of an outer tree, which is
   built by the same step again until one superblock holds a group.
3. Back down, the leaves of a superblock are cogrouped with the outer nodes that it requires (the
   siblings on the path from its top to the root) in one ``applyInPandas``: it reduces the
   superblock, joins inner and outer siblings to each leaf's proof, and folds the presented leaf.

A proof is text: levels from the leaf upwards, parted by ``/``; in each the digests left of the
path, ``.``, and those right of it. ``fold`` recomputes a root from it in SQL.

Nulls: a null id or group sorts first and counts as a value of its own. Rows that repeat an id
stand in the order of their leaves; equal rows are leaves of their own and may swap places, which
gives the same rows. One row alone is its own root with an empty proof. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenic.llm.common import settle

ARITY = 3
HEIGHT = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A column's part of a leaf's input."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    def up(h: Column, level: Column) -> Column:
        sides = F.split(level, "\\.")
        return F.sha2(F.concat(sides[0], h, sides[1]).cast("binary"), 256)
    return F.when(proof == "", start).otherwise(F.aggregate(F.split(proof, "/"), start, up))


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str], most: int | None) -> list[list[str]]:
    """Levels of a tree from its leaves upwards: ``most`` steps, or until one node is left."""
    out = [nodes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        low = out[-1]
        out.append([digest(low[i:i + ARITY]) for i in range(0, len(low), ARITY)])
    return out


def proofs(tree: list[list[str]]) -> list[str]:
    """Proof of each leaf within the levels given."""
    tails = [""]
    for low in reversed(tree[:-1]):
        new = []
        for i in range(len(low)):
            first = i - i % ARITY
            side = "".join(low[first:i]) + "." + "".join(low[i + 1:first + ARITY])
            above = tails[i // ARITY]
            new.append(side + "/" + above if above else side)
        tails = new
    return tails


def climb(start: str, proof: str) -> str:
    if proof:
        for level in proof.split("/"):
            left, right = level.split(".")
            start = digest([left, start, right])
    return start


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``idx`` (place in their group from 0), ``n`` (rows of the group) and ``start``.

    ``start`` grows along the groups in their order and differs by the rows between, within a range.
    """
    spot = rows.withColumn("_tie", F.monotonically_increasing_id())
    spot = spot.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    spot = settle(spot.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    # one row for each range and group that it holds
    runs = spot.groupBy(group, "_range").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    runs = runs.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_low",
                       (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_before"),
                       F.sum("_n").over(whole).alias("n"), F.min("_low").over(whole).alias("start"))
    out = spot.join(runs, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("idx", F.col("_at") - F.col("_low") + F.col("_before")).drop("_g", "_r", "_range", "_low", "_before", "_at")


def superblocks(nodes: DataFrame, span: int) -> DataFrame:
    """``block`` (place of the superblock in its tree) and the key ``large``, ``part`` of its Python group.

    ``large`` is the tree if it has more than ``span`` nodes, else -1.
    """
    large = F.col("n") > span
    block = F.when(large, F.floor(F.col("idx") / span)).otherwise(0).cast("long")
    return nodes.select("*", block.alias("block"), F.when(large, F.col("tree")).otherwise(-1).alias("large"),
                        F.when(large, block).otherwise(F.floor(F.col("start") / span)).cast("long").alias("part"))


KEY = ["large", "part"]


def _trees(pdf: pd.DataFrame):
    """(tree, its rows of this superblock in order)."""
    return pdf.sort_values(["tree", "idx"]).groupby("tree", sort=False)


def _own(g: pd.DataFrame, height: int) -> list[list[str]]:
    return levels(g["h"].tolist(), height if g["n"].iat[0] > ARITY ** height else None)


def tops(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, idx, h): the node on top of each superblock; idx is the superblock's place."""
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(t, g["block"].iat[0], _own(g, height)[-1][0]) for t, g in _trees(pdf)], columns=["tree", "idx", "h"])
    return nodes.select("tree", "idx", "n", "h", "block", *KEY).groupBy(*KEY).applyInPandas(reduce, "tree long, idx long, h string")


def outer_nodes(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, path, top, large, part): what the superblocks of large trees require from above them."""
    span = ARITY ** height
    large = nodes.where("large >= 0")
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= span:
        return nodes.sparkSession.createDataFrame([], "tree long, path string, top string, large long, part long")
    sizes = large.where("idx = 0").select("tree", F.ceil(F.col("n") / span).cast("long").alias("n"), "start")
    above = settle(tops(large, height).join(sizes, "tree"))
    return paths(above, height).select("tree", "path", "top", F.col("tree").alias("large"), F.col("idx").alias("part"))


def paths(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, idx, path, top) of nodes (tree, idx, n, start, h): siblings up to the tree's root, and the root."""
    nodes = superblocks(nodes, ARITY ** height)

    def exchange(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        above = {x.tree: (x.path, x.top) for x in outer.itertuples()}
        out = [pd.DataFrame({"tree": [], "idx": [], "path": [], "top": []})]
        for tree, g in _trees(leaves):
            own = _own(g, height)
            path, top = above.get(tree, ("", own[-1][0]))
            out.append(pd.DataFrame({"tree": tree, "idx": g["idx"], "path": [joined(p, path) for p in proofs(own)], "top": top}))
        return pd.concat(out[1:] or out)

    rows = nodes.select("tree", "idx", "n", "h", *KEY)
    return rows.groupBy(*KEY).cogroup(outer_nodes(nodes, height).groupBy(*KEY)).applyInPandas(exchange, "tree long, idx long, path string, top string")


def joined(*paths: str) -> str:
    return "/".join(p for p in paths if p)


def manifest(docs: DataFrame, presented: Column | None = None, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id",
             group_col: str = "source", height: int = HEIGHT) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof, presented, folded.

    ``presented`` is the leaf to verify, the row's own where it is null or absent; ``folded`` is the
    root that it gives with the row's proof.
    """
    span = ARITY ** height
    seen = F.lit(None).cast("string") if presented is None else presented
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf([F.col(c) for c in columns]).alias("h"), seen.alias("seen"))
    rows = settle(superblocks(placed(rows, "grp", ["id", "h"]).withColumn("tree", F.col("start")), span))
    outer = outer_nodes(rows, height)

    # group roots, then the tree above them in the order of the groups' names
    roots = tops(rows.where("large < 0"), height).select("tree", "h").unionByName(outer.select("tree", F.col("top").alias("h")).distinct())
    roots = roots.join(rows.where("idx = 0").select("tree", "grp"), "tree")
    upper = placed(roots.select("grp", "h", F.col("tree").alias("group"), F.lit(0).alias("all")), "all", ["grp"])
    upper = settle(upper.withColumn("tree", F.col("start")))
    high = paths(upper, height).select("idx", F.col("path").alias("high"), F.col("top").alias("root"))
    high = high.join(upper.select("idx", "group", F.col("h").alias("subroot")), "idx").drop("idx")

    # what each superblock requires: siblings above it in its group, then those above the group
    need = rows.where(f"idx % {span} = 0").select("tree", *KEY).join(outer.drop("top"), ["tree", *KEY], "left")
    need = need.select(*[F.col(c).alias(c) for c in ("tree", *KEY)], F.coalesce("path", F.lit("")).alias("path")).join(high, F.col("tree") == F.col("group")).drop("group")

    def finish(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        above = {x.tree: x for x in outer.itertuples()}
        out = []
        for tree, g in _trees(leaves):
            up = above[tree]
            proof = [joined(p, up.path, up.high) for p in proofs(_own(g, height))]
            seen = g["seen"].where(g["seen"].notna(), g["h"])
            out.append(pd.DataFrame({"id": g["id"], "leaf": g["h"], "subroot": up.subroot, "root": up.root, "proof": proof, "presented": seen,
                                     "folded": [climb(s, p) for s, p in zip(seen, proof, strict=True)]}))
        return pd.concat(out)

    # ids travel as text, since pandas has no null whole number
    leaves = rows.select(F.col("id").cast("string").alias("id"), "h", "seen", "tree", "idx", "n", *KEY)
    made = leaves.groupBy(*KEY).cogroup(need.groupBy(*KEY)).applyInPandas(
        finish, "id string, leaf string, subroot string, root string, proof string, presented string, folded string")
    return made.withColumn("id", F.col("id").cast(rows.schema["id"].dataType)).withColumnRenamed("id", id_col)


def tampered(id_col: str = "doc_id") -> Column:
    """The leaf of a row whose text lost its line ends, for every row whose id has an even CRC-32."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    text = F.translate("text", "\n", "")
    return F.when(even & F.col("text").contains("\n"), leaf([F.col(c) if c != "text" else text for c in COLUMNS]))


def digests(made: DataFrame) -> DataFrame:
    """The columns of the query: proof as a hash of its siblings in order."""
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(F.translate("proof", "./", "").cast("binary"), 256).alias("proof_sha256"),
                       F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _input(text: str) -> str:
    return " || ".join(f"COALESCE(CAST(STRLEN({c}) AS VARCHAR) || ':' || {c}, '-')" for c in
                       (text if x == "text" else f"CAST({x} AS VARCHAR)" for x in COLUMNS))


#: The manifest level by level; CRC-32 by its remainder, as DuckDB has no function for it.
ORACLE = f"""
WITH RECURSIVE crc_table AS MATERIALIZED (SELECT LIST(CAST(c AS BIGINT) ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c
    FROM (SELECT range AS i FROM range(256)))),
leaves AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (ORDER BY source, doc_id, leaf) AS k, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS idx,
        COUNT(*) OVER (PARTITION BY source) AS n
    FROM (SELECT doc_id, source, sha256({_input('text')}) AS leaf,
          CASE WHEN xor(list_reduce(list_transform(range(1, LENGTH(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)),
               lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 2 = 0
               THEN sha256({_input("REPLACE(text, chr(10), '')")}) END AS seen
          FROM (SELECT *, HEX(CAST(doc_id AS VARCHAR)) AS x FROM documents), crc_table)),
low AS (SELECT source, 0 AS lvl, idx, leaf AS h, n FROM leaves
        UNION ALL SELECT source, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), CAST(CEIL(n / 3) AS BIGINT)
        FROM low WHERE n > 1 GROUP BY source, lvl, idx // 3, n),
roots AS MATERIALIZED (SELECT source, h, ROW_NUMBER() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, COUNT(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, idx, h, n FROM roots
         UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), CAST(CEIL(n / 3) AS BIGINT)
         FROM high WHERE n > 1 GROUP BY lvl, idx // 3, n),
nodes AS MATERIALIZED (SELECT 0 AS tree, COALESCE('s' || source, '-') AS source, * EXCLUDE (source) FROM low UNION ALL SELECT 1, '', * FROM high),
runs AS MATERIALIZED (SELECT a.tree, a.source, a.lvl, a.idx, a.n, COALESCE(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
        COALESCE(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
    FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.source = b.source AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3
    WHERE a.n > 1 GROUP BY a.tree, a.source, a.lvl, a.idx, a.n),
starts AS MATERIALIZED (SELECT k, s.source, COALESCE('s' || s.source, '-') AS name, s.idx, COALESCE(seen, leaf) AS h, r.idx AS top, s.n, r.n AS tops
    FROM leaves s JOIN roots r ON s.source IS NOT DISTINCT FROM r.source),
walk AS (SELECT k, 0 AS tree, name AS source, 0 AS lvl, idx, h, '' AS sib, top, n, tops FROM starts
         UNION ALL
         SELECT w.k, CASE WHEN w.n = 1 THEN 1 ELSE w.tree END, CASE WHEN w.n = 1 THEN '' ELSE w.source END, CASE WHEN w.n = 1 THEN 0 ELSE w.lvl + 1 END,
                CASE WHEN w.n = 1 THEN w.top ELSE w.idx // 3 END, CASE WHEN w.n = 1 THEN w.h ELSE sha256(u.l || w.h || u.r) END,
                w.sib || COALESCE(u.l || u.r, ''), w.top, CASE WHEN w.n = 1 THEN w.tops ELSE CAST(CEIL(w.n / 3) AS BIGINT) END, w.tops
         FROM walk w LEFT JOIN runs u ON w.n > 1 AND u.tree = w.tree AND u.source = w.source AND u.lvl = w.lvl AND u.idx = w.idx
         WHERE w.n > 1 OR w.tree = 0),
done AS (SELECT k, h, sib FROM walk WHERE tree = 1 AND n = 1),
top AS (SELECT h AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.leaf, r.h AS subroot, root, sha256(d.sib) AS proof_sha256, d.h AS folded_root, d.h = root AS verified
FROM leaves l JOIN done d ON d.k = l.k JOIN roots r ON r.source IS NOT DISTINCT FROM l.source, top
"""
