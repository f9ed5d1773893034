"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in SQL only.

The ring has ``CELLS`` cells. A key lies in a cell by its hash; the cell belongs to the
virtual node met next clockwise. A shard keeps its own keys, in ring order, up to its
bound; the keys beyond it continue clockwise and take the free places that they meet.
The bounds add up to the number of rows and differ by one at most, so counts are at most
one apart (law ``rows``), while only the overflow of the full shards moves.

Everything about the ring is decided on one row per cell, whatever the input's size: the
walk of the overflow is a queue along the ring, whose departures are a running minimum
(arrivals ``O``, free places ``G``: departed = G + min(0, min(O - G))), in two laps. Rows
only need their rank within their cell, so the one shuffle of rows has ``CELLS`` keys of
even size and carries five numbers a row, no text.

Null ids hash as an empty string, null texts count as empty; equal rows may swap their
slots, which gives the same result. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from selenic.llm.common import settle

CELLS = 8192
NODES = 100

#: The ring as SQL. Dialects differ in what stands in braces.
RING = """
node AS (SELECT {cell:'node-' || CAST(CAST(FLOOR(i / NODES) AS BIGINT) AS STRING) || '-' || CAST(MOD(i, NODES) AS STRING)} AS cell,
                {hash:'node-' || CAST(CAST(FLOOR(i / NODES) AS BIGINT) AS STRING) || '-' || CAST(MOD(i, NODES) AS STRING)} AS h, CAST(FLOOR(i / NODES) AS BIGINT) AS shard
         FROM {range:SHARDS * NODES}),
own AS (SELECT cell, MIN_BY(shard, h) AS shard FROM node GROUP BY cell),
ring AS (SELECT c.i AS cell,
                COALESCE({first:o.shard} OVER (ORDER BY c.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                         {first:o.shard} OVER (ORDER BY c.i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS shard,
                COALESCE(k.n, 0) AS n
         FROM {range:CELLS} c LEFT JOIN own o ON o.cell = c.i LEFT JOIN {table:counts} k ON k.cell = c.i),
load AS (SELECT s.i AS shard, COALESCE(SUM(r.n), 0) AS n, COUNT(r.cell) AS cells
         FROM {range:SHARDS} s LEFT JOIN ring r ON r.shard = s.i GROUP BY s.i),
cap AS (SELECT shard, cells, CAST(FLOOR(SUM(n) OVER () / SHARDS) AS BIGINT)
               + CASE WHEN ROW_NUMBER() OVER (ORDER BY n DESC, shard) <= MOD(SUM(n) OVER (), SHARDS) THEN 1 ELSE 0 END AS cap
        FROM load),
kept AS (SELECT r.cell, r.shard, r.n, c.cap, c.cells,
                SUM(r.n) OVER (PARTITION BY r.shard ORDER BY r.cell) - r.n AS before,
                ROW_NUMBER() OVER (PARTITION BY r.shard ORDER BY r.cell) AS k
         FROM ring r JOIN cap c ON c.shard = r.shard),
kept2 AS (SELECT *, GREATEST(0, LEAST(n, cap - before)) AS keep FROM kept),
kept3 AS (SELECT *, SUM(keep) OVER (PARTITION BY shard) AS home FROM kept2),
lap AS (SELECT *, n - keep AS excess,
               CAST(FLOOR((cap - home) / cells) AS BIGINT) + CASE WHEN k <= MOD(cap - home, cells) THEN 1 ELSE 0 END AS room
        FROM kept3),
sums AS (SELECT *, SUM(excess) OVER (ORDER BY cell) AS o, SUM(room) OVER (ORDER BY cell) AS g FROM lap),
walk AS (SELECT *, g + LEAST(0, MIN(o - g) OVER (ORDER BY cell)) AS d FROM sums),
walk2 AS (SELECT *, COALESCE(LAG(d) OVER (ORDER BY cell), 0) AS d0, MAX(o) OVER () AS all_o, MAX(d) OVER () AS all_d FROM walk),
walk3 AS (SELECT *, SUM(room - (d - d0)) OVER (ORDER BY cell) AS g2 FROM walk2),
walk4 AS (SELECT *, all_d + LEAST(all_o - all_d, g2) AS e,
                 all_d + LEAST(all_o - all_d, g2 - (room - (d - d0))) AS e0 FROM walk3)"""

#: The second half: the walk's takes and the overflow cut into pieces of one cell and one shard.
PIECES = """
visit AS (SELECT 1 AS lap, cell, shard, home, d0 AS lo, d AS hi FROM {table:walk4}
          UNION ALL SELECT 2 AS lap, cell, shard, home, e0 AS lo, e AS hi FROM {table:walk4}),
take AS (SELECT lo, shard, home + SUM(hi - lo) OVER (PARTITION BY shard ORDER BY lap, cell) - (hi - lo) AS slot, hi - lo AS n FROM visit),
mark AS (SELECT o - excess AS pos, cell, keep, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS shard, CAST(NULL AS BIGINT) AS slot
         FROM {table:walk4} WHERE excess > 0
         UNION ALL SELECT lo AS pos, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), lo, shard, slot FROM take WHERE n > 0),
spot AS (SELECT pos, MAX(cell) AS cell, MAX(keep) AS keep, MAX(CASE WHEN cell IS NOT NULL THEN pos END) AS o0,
                MAX(lo) AS lo, MAX(shard) AS shard, MAX(slot) AS slot FROM mark GROUP BY pos),
fill AS (SELECT pos, {last:cell} OVER w AS cell, {last:keep} OVER w AS keep, {last:o0} OVER w AS o0,
                {last:lo} OVER w AS lo, {last:shard} OVER w AS shard, {last:slot} OVER w AS slot,
                COALESCE(LEAD(pos) OVER (ORDER BY pos), (SELECT MAX(all_o) FROM {table:walk4})) AS nxt
         FROM spot WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
seg AS (SELECT cell, CAST(0 AS BIGINT) AS lo, CAST(keep AS BIGINT) AS hi, CAST(shard AS INT) AS shard, CAST(before AS BIGINT) AS slot
        FROM {table:walk4} WHERE keep > 0
        UNION ALL SELECT cell, CAST(keep + pos - o0 AS BIGINT), CAST(keep + nxt - o0 AS BIGINT), CAST(shard AS INT), CAST(slot + pos - lo AS BIGINT)
        FROM fill)
"""


def ring_sql(dialect: str, part: str, shards: int, cells: int = CELLS, nodes: int = NODES) -> str:
    """Common table expressions, from ``counts(cell, n)`` to ``walk4`` and on to ``seg``: which ranks of a cell go where."""

    spark = dialect == "spark"

    def put(m: re.Match) -> str:
        kind, x = m[1], m[2]
        if kind == "hash":
            return hash_sql(dialect, x)
        if kind == "cell":
            return f"CAST(FLOOR({hash_sql(dialect, x)} / {2 ** 48 // cells}) AS BIGINT)"
        if kind == "table":
            return f"{{{x}}}" if spark else x
        if kind == "range":
            return f"(SELECT id AS i FROM range({x}))" if spark else f"(SELECT range AS i FROM range({x}))"
        return f"{kind.upper()}_VALUE({x}) IGNORE NULLS" if spark else f"{kind.upper()}_VALUE({x} IGNORE NULLS)"

    text = re.sub(r"\{(\w+):([^}]*)\}", put, part)
    text = text.replace("SHARDS", str(shards)).replace("NODES", str(nodes)).replace("CELLS", str(cells))
    return text if spark else text.replace("AS STRING", "AS VARCHAR")


def hash_sql(dialect: str, text: str) -> str:
    """48 bits of MD5 as a number."""
    head = f"SUBSTR(MD5({text}), 1, 12)"
    return f"CAST(CONV({head}, 16, 10) AS BIGINT)" if dialect == "spark" else f"CAST('0x' || {head} AS BIGINT)"


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cell = F.floor(h / F.lit(2 ** 48 // CELLS)).cast("bigint")
    counts = docs.select(cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    # CELLS rows, read several times below
    walk = settle(spark.sql(f"WITH {ring_sql('spark', RING, shards)} SELECT * FROM walk4", counts=counts))
    seg = spark.sql(f"WITH {ring_sql('spark', PIECES, shards)} SELECT * FROM seg", walk4=walk)
    # at most three rows a cell, so the table's size is bounded by CELLS
    seg = seg.groupBy("cell").agg(F.collect_list(F.struct("lo", "hi", "shard", "slot")).alias("segs"))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), h.alias("_h"), cell.alias("cell"))
    order = W.partitionBy("cell").orderBy("_h", "_id", "size", "text_crc32")
    rows = rows.withColumn("_r", (F.row_number().over(order) - 1).cast("bigint"))
    rows = rows.join(F.broadcast(seg), "cell")
    at = F.filter("segs", lambda x: (x["lo"] <= F.col("_r")) & (F.col("_r") < x["hi"]))[0]
    return (rows.withColumn("_s", at)
            .select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("_s.shard").alias("shard"),
                    (F.col("_s.slot") + F.col("_r") - F.col("_s.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


#: CRC-32 over the hex digits of the bytes; DuckDB has no function for it
CRC_SQL = """
crc_table AS MATERIALIZED (SELECT LIST(CAST(c AS BIGINT) ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c
    FROM (SELECT range AS i FROM range(256)))),
crc AS (SELECT doc_id, xor(list_reduce(list_transform(range(1, LENGTH(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)),
               lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS text_crc32
        FROM (SELECT doc_id, HEX(COALESCE(text, '')) AS x FROM documents), crc_table)
"""

ORACLE = f"""
WITH rows0 AS (SELECT doc_id, CAST(STRLEN(COALESCE(text, '')) + 16 AS BIGINT) AS size,
               {hash_sql('duckdb', "COALESCE(CAST(doc_id AS VARCHAR), '')")} AS h FROM documents),
keyed AS (SELECT *, CAST(FLOOR(h / {2 ** 48 // CELLS}) AS BIGINT) AS cell FROM rows0),
counts AS (SELECT cell, COUNT(*) AS n FROM keyed GROUP BY cell),
{ring_sql('duckdb', RING, 40)},
{ring_sql('duckdb', PIECES, 40)},
{CRC_SQL},
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY h, doc_id, size) - 1 AS r FROM keyed)
SELECT r.doc_id, r.size, CAST(c.text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, s.shard, CAST(s.slot + r.r - s.lo AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM ranked r JOIN seg s ON s.cell = r.cell AND r.r >= s.lo AND r.r < s.hi JOIN crc c ON c.doc_id = r.doc_id
"""
