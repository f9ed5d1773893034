"""CSV and JSON documents, and the result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selenic.functions import text
from selenic.operators.catalog import last_wins

c, lit = F.col, F.lit

GRID = "Longitude double, Latitude double, Pixel int, Scan int"
REGISTRY = "map<string, struct<dir: string, slug: string, name: string, subtitle: string, kind: string>>"
CENTER = "struct<lat_deg: double, lon_deg: double>"
RANKED = "array<struct<product_id: string, mission: string, instrument: string, footprint_km: double, coarse_ncc: double, score: double>>"
METADATA = (
    "product_id string, instrument string, mission string, start_time_utc string, "
    "sun struct<sun_azimuth_deg: double, sun_elevation_deg: double, solar_incidence_deg: double>, "
    "analysis_grid struct<n: int, cell_meters: double>, dem_range_m array<double>, source_footprint_center " + CENTER + ", "
    "footprint_corners struct<upper_left: " + CENTER + ", upper_right: " + CENTER + ", lower_left: " + CENTER + ", lower_right: " + CENTER + ">, "
    "tmc_reference struct<status: string, product_id: string, footprint_km: double, note: string>, "
    "iirs_reference struct<status: string, product_id: string, footprint_km: double, note: string>, "
    "tmc_reference_ranked " + RANKED + ", iirs_reference_ranked " + RANKED + ", craters_detected int")
CRATERS = ("x_px double, y_px double, radius_px double, radius_m double, lon_deg double, lat_deg double, "
           "shadow_len_m double, depth_est_m double")


def read_geometry_grid(spark: SparkSession, path: str, schema: str = GRID) -> DataFrame:
    """Longitude and latitude per 100 px."""
    return spark.read.csv(path, header=True, schema=schema).withColumnsRenamed(
        {"Longitude": "lon_deg", "Latitude": "lat_deg", "Pixel": "pixel", "Scan": "scan"})


def parse_registry(raw: DataFrame) -> DataFrame:
    """Scene rows from registry documents (``text`` holds a map of entries)."""
    entries = raw.select(F.explode(F.from_json("text", REGISTRY)).alias("scene_id", "_e"))
    return entries.select("scene_id", "_e.*").withColumn("folder", text.basename(c("dir")))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return parse_registry(spark.read.text(path, wholetext=True).select(c("value").alias("text")))


def read_metadata(spark: SparkSession, path: str, schema: str = METADATA) -> DataFrame:
    """Scene metadata documents; absent fields are NULL."""
    return (spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "metadata.json").json(path)
            .withColumn("scene_id", F.regexp_extract(c("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)))


def read_craters(spark: SparkSession, path: str, schema: str = CRATERS) -> DataFrame:
    return (spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "craters.json").json(path)
            .withColumn("scene_id", F.regexp_extract(c("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)))


# ------------------------------------------------------------ sinks

def append_results(df: DataFrame, path: str) -> None:
    """Insert result rows (jobs, matches, metrics)."""
    df.write.mode("append").parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    df.write.mode("append").jdbc(url, table, properties=properties)


def upsert(current: DataFrame | None, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Current rows with those of equal key replaced; the highest version per key wins."""
    rows = updates if current is None else current.unionByName(updates, allowMissingColumns=True)
    return last_wins(rows, [key], version)


def write_version(df: DataFrame, root: str, number: int) -> DataFrame:
    """A table version in its own folder: readers of the old one are not disturbed and a
    lost write is simply repeated."""
    path = f"{root}/v{number}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_scene_docs(df: DataFrame, path: str) -> None:
    """One folder of JSON rows per scene."""
    df.repartition("scene_id").sortWithinPartitions("scene_id").write.partitionBy("scene_id").mode("overwrite").json(path)


def write_grid(df: DataFrame, path: str) -> None:
    """Grid cells keyed by product and scene position; only written keys are replaced."""
    keys = ["product_id", "geo_key"]
    (df.repartition(*keys).sortWithinPartitions(*keys, "row", "col").write.partitionBy(*keys)
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))


def cap_payload(df: DataFrame, cols: list[str], n: int = 500, max_chars: int | None = None) -> DataFrame:
    """First n elements of array columns: always, or only for rows whose JSON is too long,
    which are then flagged ``cached_trimmed``."""
    if max_chars is None:
        return df.withColumns({k: F.slice(k, 1, n) for k in cols})
    big = F.length(F.to_json(F.struct(*df.columns))) > max_chars
    df = df.withColumn("cached_trimmed", big)
    return df.withColumns({k: F.when(c("cached_trimmed"), F.slice(k, 1, n)).otherwise(c(k)) for k in cols})
