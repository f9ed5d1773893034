"""Adapters that shape the benchmark tables into catalogs, cells and logs.

The SQL runs unchanged in Spark and DuckDB; ``{table}`` is the table reference
and ``{fx:name}`` another adapter. Every adapter covers its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FX: dict[str, str] = {}

FX["scenes"] = """
SELECT c_custkey AS scene_id,
  CAST((c_custkey * 853) % 17001 AS DOUBLE) / 100 - 85 AS lat_deg,
  CAST((c_custkey * 911) % 36000 AS DOUBLE) / 100 AS lon_deg,
  CAST(1 + c_nationkey AS DOUBLE) AS cell_m, 1024 AS n
FROM {customer}"""

FX["products"] = """
SELECT product_id, kind, clat, clon, lines, samples,
  clat + dlat AS ul_lat, (clon - dlon + 360) % 360 AS ul_lon,
  clat + dlat - 0.5 AS ur_lat, (clon + dlon) % 360 AS ur_lon,
  clat - dlat AS ll_lat, (clon - dlon + 361) % 360 AS ll_lon,
  clat - dlat + 0.5 AS lr_lat, (clon + dlon + 1) % 360 AS lr_lon
FROM (SELECT concat('prd_', CAST(20230101 + s_suppkey % 28 AS STRING), 'T',
    CAST(100000 + s_suppkey AS STRING),
    CASE s_suppkey % 3 WHEN 0 THEN '_d_dtm_d18' WHEN 1 THEN '_d_dtm_d32' ELSE '_d_dtm_n18' END) AS product_id,
  CASE s_suppkey % 4 WHEN 0 THEN 'iirs' ELSE 'tmc' END AS kind,
  CAST((s_suppkey * 1709) % 14001 AS DOUBLE) / 100 - 70 AS clat,
  CAST((s_suppkey * 4999) % 36000 AS DOUBLE) / 100 AS clon,
  CAST(4 + s_nationkey % 5 AS DOUBLE) AS dlat, CAST(6 + s_nationkey % 7 AS DOUBLE) AS dlon,
  2000 + s_nationkey * 100 AS lines, 3000 AS samples FROM {supplier}) q"""

# product centres as the catalog publishes them: the plain mean of the corners
FX["centres"] = """
SELECT product_id, kind, (ul_lat + ur_lat + ll_lat + lr_lat) / 4 AS lat_deg,
  (ul_lon + ur_lon + ll_lon + lr_lon) / 4 AS lon_deg FROM {fx:products}"""

# measured coarse correlations of some scene/product pairs
FX["measured"] = """
SELECT scene_id, product_id, max(ncc) AS ncc FROM (
  SELECT o_custkey AS scene_id, concat('prd_', CAST(20230101 + l_suppkey % 28 AS STRING), 'T',
    CAST(100000 + l_suppkey AS STRING),
    CASE l_suppkey % 3 WHEN 0 THEN '_d_dtm_d18' WHEN 1 THEN '_d_dtm_d32' ELSE '_d_dtm_n18' END) AS product_id,
    CAST(l_discount AS DOUBLE) * 10 - 0.3 AS ncc
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) q
GROUP BY scene_id, product_id"""

# the single measurements behind them, for the operator that keeps the best of a pair
FX["observed"] = """
  SELECT o_custkey AS scene_id, concat('prd_', CAST(20230101 + l_suppkey % 28 AS STRING), 'T',
    CAST(100000 + l_suppkey AS STRING),
    CASE l_suppkey % 3 WHEN 0 THEN '_d_dtm_d18' WHEN 1 THEN '_d_dtm_d32' ELSE '_d_dtm_n18' END) AS product_id,
    CAST(l_discount AS DOUBLE) * 10 - 0.3 AS ncc
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

FX["cells"] = """
SELECT CAST(floor(o_orderkey / 4096) AS BIGINT) AS raster_id,
  CAST(floor((o_orderkey % 4096) / 64) AS INT) AS row, CAST(o_orderkey % 64 AS INT) AS col,
  CASE WHEN o_orderkey % 97 = 0 THEN CAST(-32768 AS DOUBLE) ELSE o_totalprice / 100 END AS z,
  c_acctbal AS z2
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

# the same cells with nodata as NULL
FX["heights"] = """
SELECT raster_id, row, col, CASE WHEN z > -32000 THEN z END AS z, z2 FROM {fx:cells}"""

FX["corr"] = """
SELECT pair_id, point_id, sx, sy, sx * 1.01 + 5 + jit AS rx, sy * 0.99 - 3 + jit AS ry,
  CASE WHEN point_id % 4 = 0 THEN 'learned' ELSE 'sift' END AS method
FROM (SELECT o_orderkey % 50 AS pair_id, o_orderkey AS point_id,
  o_totalprice % 1024 AS sx, (o_totalprice / 7) % 1024 AS sy,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(200 AS DOUBLE) ELSE CAST(o_orderkey % 7 AS DOUBLE) / 5 END AS jit
  FROM {orders}) q"""

FX["requests"] = "SELECT event_id, user_id AS key, ts, event_type FROM {events}"
FX["samples"] = "SELECT user_id AS ray_id, ts AS pos, value AS dn, event_id FROM {events}"

FX["jobs"] = """
SELECT event_id AS job_id, user_id AS scene_id, event_type AS stage,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, ts AS created_at FROM {events}"""

FX["sources"] = """
SELECT p_partkey AS product_id, 'tar' AS src, 1 AS prio, p_retailprice AS size FROM {part} WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'zip', 2, p_retailprice + 1 FROM {part} WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'dir', 3, p_retailprice + 2 FROM {part} WHERE p_partkey % 5 = 0"""

FX["files_old"] = """
SELECT o_orderkey AS path, o_totalprice AS size, o_orderdate AS mtime FROM {orders} WHERE o_orderkey % 10 <> 0"""

FX["files_new"] = """
SELECT o_orderkey AS path, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS size,
  o_orderdate AS mtime FROM {orders} WHERE o_orderkey % 11 <> 0"""

FX["candidates"] = """
SELECT p_partkey AS cand_id, p_partkey % 40 AS scene_id, CAST(p_size AS DOUBLE) * 2 AS radius_px,
  CAST(p_partkey % 23 AS DOUBLE) AS shadow_px, CAST(5 + p_partkey % 30 AS DOUBLE) AS sun_el FROM {part}"""

FX["label_texts"] = """
SELECT product_id, concat('<Product><file_name>', product_id, '.img</file_name><start_date_time>2023-11-',
  CAST(10 + lines % 20 AS STRING), 'T06:03:56.7692Z</start_date_time><Investigation_Area><name>Orbiter ',
  kind, '</name></Investigation_Area><Observing_System_Component><name>Bus</name><type>Host</type>',
  '</Observing_System_Component><Observing_System_Component><name>', kind, ' camera</name><type>Instrument</type>',
  '</Observing_System_Component><isda:sun_azimuth unit="deg">', CAST(lines % 360 AS STRING),
  '.5</isda:sun_azimuth><isda:sun_elevation unit="deg">', CAST(lines % 60 AS STRING),
  '.25</isda:sun_elevation><isda:upper_left_latitude unit="deg">', CAST(ul_lat AS STRING),
  '</isda:upper_left_latitude><isda:upper_left_longitude unit="deg">', CAST(ul_lon AS STRING),
  '</isda:upper_left_longitude><isda:upper_right_latitude unit="deg">', CAST(ur_lat AS STRING),
  '</isda:upper_right_latitude><isda:upper_right_longitude unit="deg">', CAST(ur_lon AS STRING),
  '</isda:upper_right_longitude><isda:lower_left_latitude unit="deg">', CAST(ll_lat AS STRING),
  '</isda:lower_left_latitude><isda:lower_left_longitude unit="deg">', CAST(ll_lon AS STRING),
  '</isda:lower_left_longitude><isda:lower_right_latitude unit="deg">', CAST(lr_lat AS STRING),
  '</isda:lower_right_latitude><isda:lower_right_longitude unit="deg">', CAST(lr_lon AS STRING),
  '</isda:lower_right_longitude><offset unit="byte">0</offset><offset unit="byte">', CAST(lines * 2 AS STRING),
  '</offset><data_type>SignedLSB2</data_type><axis_name>Line</axis_name> <elements>', CAST(lines AS STRING),
  '</elements><axis_name>Sample</axis_name> <elements>', CAST(samples AS STRING),
  '</elements><missing_constant>-32768</missing_constant></Product>') AS xml
FROM {fx:products}"""

# arrays need one wording per engine
FX_SPARK = {
    "spectra": "SELECT vec_id AS px_id, transform(embedding, x -> abs(CAST(x AS DOUBLE)) + 0.05D) AS refl FROM {embeddings}",
    "descriptors": "SELECT vec_id, CAST(floor(vec_id / 128) AS BIGINT) AS pair_id, vec_id % 2 AS side, label, "
                   "transform(embedding, x -> CAST(x AS DOUBLE)) AS vec FROM {embeddings}",
}
FX_DUCK = {
    "spectra": "SELECT vec_id AS px_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) + CAST(0.05 AS DOUBLE)) "
               "AS refl FROM {embeddings}",
    "descriptors": "SELECT vec_id, CAST(floor(vec_id / 128) AS BIGINT) AS pair_id, vec_id % 2 AS side, label, "
                   "list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM {embeddings}",
}

_REF = re.compile(r"\{fx:(\w+)\}")


def _needs(sql: str, texts: dict[str, str], seen: list[str]) -> list[str]:
    for name in _REF.findall(sql):
        if name not in seen:
            _needs(texts[name], texts, seen)
            seen.append(name)
    return seen


def duck(sql: str) -> str:
    """Oracle text with the adapters it names as leading CTEs."""
    texts = {**FX, **FX_DUCK}
    parts = [f"fx_{n} AS ({_plain(texts[n])})" for n in _needs(sql, texts, [])]
    body = _plain(sql).strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


def _plain(sql: str) -> str:
    sql = _REF.sub(lambda m: f"fx_{m.group(1)}", sql)
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


class Inputs:
    """Tables and adapters of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        # the tables hold zone-less times; the oracle reads them as UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def fx(self, name: str) -> DataFrame:
        return self.spark.sql(self._expand({**FX, **FX_SPARK}[name]))

    def sql(self, text: str) -> DataFrame:
        """Adapter-level SQL for a test input shared with the oracle."""
        return self.spark.sql(self._expand(text))

    def streamed(self, name: str, table: str) -> DataFrame:
        """An adapter over a file stream of one table."""
        stream = (self.spark.readStream.schema(self.table(table).schema)
                  .option("pathGlobFilter", f"{table}.parquet").parquet(self.dir))
        return self.spark.sql(self._expand(FX[name], {table: "{stream}"}), stream=stream)

    def _expand(self, sql: str, swap: dict[str, str] | None = None) -> str:
        texts = {**FX, **FX_SPARK}
        sql = _REF.sub(lambda m: "(" + self._expand(texts[m.group(1)], swap) + ") fx_" + m.group(1), sql)
        for t in TABLES:
            sql = sql.replace("{" + t + "}", (swap or {}).get(t, f"parquet.`{self.dir}/{t}.parquet`"))
        return sql
