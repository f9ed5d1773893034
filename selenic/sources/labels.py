"""Product labels and small text headers as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from selenic.functions import geo, text

c, lit = F.col, F.lit

# fixed values: sample type codes of the labels, and the strip format
DTYPES = {"SignedLSB2": "<i2", "UnsignedLSB2": "<u2", "UnsignedMSB2": ">u2", "UnsignedByte": "u1", "SignedMSB2": ">i2"}
STRIP_HEADER_BYTES = 5064
STRIP_SCALING = 3.05185094759972e-05
STRIP_MISSING = -32768
NUMBER = r"([-\d.eE+]+)"


def _first(pattern: str, src: Column) -> Column:
    """First group of the first match, NULL without one."""
    return F.nullif(F.trim(F.regexp_extract(src, pattern, 1)), lit(""))


def _number(pattern: str, src: Column) -> Column:
    return _first(pattern, src).try_cast("double")


def parse_labels(raw: DataFrame, block: str | None = None) -> DataFrame:
    """Product rows from ``(path, xml)``.

    Labels repeat the corners for the system, refined and corrected solutions; the first
    match is taken unless ``block`` names the enclosing element. Labels that carry
    neither a raster size nor a footprint get an ``error`` text instead of failing the job.
    """
    xml = c("xml")
    scope = xml if block is None else F.regexp_extract(xml, f"(?s)<isda:{block}>(.*?)</isda:{block}>", 1)
    raw_pts = {f"_{name}_{k}": _number(f"<isda:{name}_{k}itude[^>]*>{NUMBER}", scope) for name in geo.CORNERS for k in ("lat", "long")}
    pts = {}
    for name in geo.CORNERS:
        lat, lon = c(f"_{name}_lat"), c(f"_{name}_long")
        both = lat.isNotNull() & lon.isNotNull()
        pts[name] = F.struct(F.when(both, lat).alias("lat_deg"), F.when(both, lon).alias("lon_deg"))

    def axis(name, tag):
        size = _first(f"<axis_name>{name}</axis_name>\\s*<elements>(\\d+)", xml)
        plain = _first(f"<{tag}>\\s*(\\d+)", xml)
        return F.coalesce(size, plain, lit("0")).cast("int")

    parts = F.regexp_extract_all(xml, lit("(?s)<Observing_System_Component>.*?</Observing_System_Component>"), lit(0))
    device = F.get(F.filter(parts, lambda b: b.contains("<type>Instrument</type>")), lit(0))
    offsets = F.regexp_extract_all(xml, lit('<offset unit="byte">(\\d+)</offset>'), lit(1))
    code = F.coalesce(_first("<data_type[^>]*>([^<]+)", xml), lit("UnsignedByte"))
    dtype = F.create_map(*[lit(x) for kv in DTYPES.items() for x in kv])
    # a source that knows the id keeps it, so that predicates on it reach the source
    df = raw if "product_id" in raw.columns else raw.withColumn("product_id", text.strip_extension(text.basename(c("path"))))
    df = df.withColumns(raw_pts).withColumn("footprint", F.struct(*[pts[n].alias(n) for n in geo.CORNERS]))
    df = df.withColumns({
        "center": geo.footprint_center(c("footprint")),
        "sun_azimuth_deg": _number(f"<isda:sun_azimuth[^>]*>{NUMBER}", xml),
        "sun_elevation_deg": _number(f"<isda:sun_elevation[^>]*>{NUMBER}", xml),
        "start_text": _first("<start_date_time>([^<]+)", xml), "stop_text": _first("<stop_date_time>([^<]+)", xml),
        "mission": _first("(?s)<Investigation_Area>.*?<name>([^<]+)", xml), "instrument": _first("<name>([^<]+)", device),
        "lines": axis("Line", "lines"), "samples": axis("Sample", "samples"), "bands": axis("Band", "bands"),
        "dtype": F.try_element_at(dtype, code), "offset": F.coalesce(F.try_element_at(offsets, lit(-1)).cast("long"), lit(0).cast("long")),
        "missing": _number("<missing_constant[^>]*>([^<]+)", xml), "scaling": _number("<scaling_factor[^>]*>([^<]+)", xml)})
    df = df.withColumn("start_time", text.parse_time(c("start_text")))
    # told from the text alone: a filter on the error is pushed to the scan side
    empty = ~F.coalesce(xml, lit("")).rlike("<axis_name>Line<|<lines>|<isda:(upper|lower)_(left|right)_latitude")
    return df.withColumn("error", F.when(xml.isNull() | ~F.coalesce(xml, lit("")).contains("<"), "not a label")
                         .when(empty, "neither raster size nor footprint")).drop("xml", *raw_pts)


def read_labels(spark: SparkSession, path: str, block: str | None = None, pruned: bool = False) -> DataFrame:
    """Catalog of every XML label below a folder.

    ``pruned`` lists the folder on the driver and opens only labels whose product_id satisfies the
    query's predicates; without it Spark's text reader opens all of them, on any file system it knows.
    """
    if pruned:
        from selenic.sources import datasource

        return parse_labels(datasource.read_heads(spark, path, "*.xml").select("path", "product_id", c("text").alias("xml")), block)
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").text(path, wholetext=True)
           .select(c("_metadata.file_path").alias("path"), c("value").alias("xml")))
    return parse_labels(raw, block)


def parse_sun_records(raw: DataFrame) -> DataFrame:
    """The last four decimals of the first line: phase, aspect, azimuth, elevation."""
    line = F.get(F.split("text", "\r?\n"), lit(0))
    nums = F.regexp_extract_all(line, lit(r"-?\d+\.\d+"), lit(0))
    def at(i):
        return F.try_element_at(nums, lit(i)).cast("double")
    return raw.select("path", at(-4).alias("phase_deg"), at(-3).alias("sun_aspect_deg"), at(-2).alias("sun_azimuth_deg"),
                      at(-1).alias("sun_elevation_deg"), geo.solar_incidence(at(-1)).alias("solar_incidence_deg"))


def read_sun_records(spark: SparkSession, path: str) -> DataFrame:
    return parse_sun_records(_texts(spark, path))


def parse_envi_headers(raw: DataFrame) -> DataFrame:
    """bands, lines and samples of ``key = integer`` headers; 0 when absent."""
    def size(key):
        return F.coalesce(_first(rf"(?i){key}\s*=\s*(\d+)", c("text")), lit("0")).cast("int").alias(key)
    return raw.select("path", size("bands"), size("lines"), size("samples"))


def read_envi_headers(spark: SparkSession, path: str) -> DataFrame:
    return parse_envi_headers(_texts(spark, path))


def parse_strip_headers(raw: DataFrame) -> DataFrame:
    """Strip rows from the text of attached headers; headers without a size are left out."""
    def field(key):
        return _first(rf'\b{key}\s*=\s*"?([^"\s]+)', c("text"))
    df = raw.select(
        text.strip_extension(text.basename(c("path"))).alias("product_id"), "path",
        field("LINES").try_cast("int").alias("lines"), field("LINE_SAMPLES").try_cast("int").alias("samples"),
        field("START_TIME").alias("start_text"), field("STOP_TIME").alias("stop_text"))
    df = df.withColumns({"offset": lit(STRIP_HEADER_BYTES).cast("long"), "scaling": lit(STRIP_SCALING),
                         "missing": lit(float(STRIP_MISSING)), "dtype": lit("<i2")})
    return df.where("lines > 0 and samples > 0")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(c("_metadata.file_path").alias("path"), c("value").alias("text"))
