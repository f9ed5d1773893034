"""Spherical, pixel and sun geometry as Column expressions (Moon, R = 1737.4 km)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the data model
RADIUS_KM = 1737.4
CORNERS = ("upper_left", "upper_right", "lower_left", "lower_right")
DEFAULT_SUN = (270.8, 10.0)

_METRES_PER_DEG = RADIUS_KM * 1000.0 * math.pi / 180.0


def wrap_lon(lon: Column) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(lon, F.lit(360.0))


def rel_lon(lon: Column, centre: Column) -> Column:
    """Longitude relative to ``centre`` in [-180, 180)."""
    return F.pmod(lon - centre + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(F.pmod(lon2 - lon1, F.lit(360.0))) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    # not least(): it would turn a missing coordinate into the largest distance
    return F.lit(2 * RADIUS_KM) * F.asin(F.when(a >= 1.0, 1.0).otherwise(F.sqrt(a)))


def corners(ul_lat, ul_lon, ur_lat, ur_lon, ll_lat, ll_lon, lr_lat, lr_lon) -> Column:
    """Footprint struct from eight columns."""
    flat = [F.col(c) if isinstance(c, str) else c
            for c in (ul_lat, ul_lon, ur_lat, ur_lon, ll_lat, ll_lon, lr_lat, lr_lon)]
    return F.struct(*[
        F.struct(flat[2 * i].alias("lat_deg"), flat[2 * i + 1].alias("lon_deg")).alias(name)
        for i, name in enumerate(CORNERS)
    ])


def footprint_center(fp: Column, circular: bool = False) -> Column:
    """Mean of the corners that are present.

    The plain mean is not wrap-aware, as the published centres are not;
    ``circular=True`` averages unit vectors of the longitudes instead.
    """
    present = [fp[c]["lat_deg"].isNotNull() & fp[c]["lon_deg"].isNotNull() for c in CORNERS]
    count = sum((F.when(p, 1).otherwise(0) for p in present), F.lit(0))

    def mean(pick):
        total = sum((F.when(p, pick(c)).otherwise(0.0) for p, c in zip(present, CORNERS)), F.lit(0.0))
        return F.when(count > 0, total / count)

    lat = mean(lambda c: fp[c]["lat_deg"])
    if circular:
        east = mean(lambda c: F.cos(F.radians(fp[c]["lon_deg"])))
        north = mean(lambda c: F.sin(F.radians(fp[c]["lon_deg"])))
        lon = wrap_lon(F.degrees(F.atan2(north, east)))
    else:
        lon = mean(lambda c: fp[c]["lon_deg"])
    return F.when(count > 0, F.struct(lat.alias("lat_deg"), lon.alias("lon_deg")))


def crop_center(fp: Column, lines: Column, samples: Column, r0: Column, c0: Column, size: Column) -> Column:
    """Centre of a crop: bilinear over the corners, else the product centre."""
    fx = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(c0 + size / 2.0, samples)))
    fy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(r0 + size / 2.0, lines)))

    def interp(key):
        top = fp["upper_left"][key] * (1 - fx) + fp["upper_right"][key] * fx
        low = fp["lower_left"][key] * (1 - fx) + fp["lower_right"][key] * fx
        return top * (1 - fy) + low * fy

    lat, lon = interp("lat_deg"), interp("lon_deg")
    usable = lat.isNotNull() & lon.isNotNull() & (lines > 0) & (samples > 0)
    return F.when(usable, F.struct(lat.alias("lat_deg"), lon.alias("lon_deg"))).otherwise(footprint_center(fp))


def pixel_window(fx: Column, fy: Column, lines: Column, samples: Column, extent_m: Column, gsd_m: Column) -> Column:
    """Window (r0, c0, r1, c1) around a footprint position; NULL if thinner than 2 px."""
    half = F.greatest(F.lit(2.0), F.try_divide(extent_m / 2.0, gsd_m))
    px, py = fx * (samples - 1), fy * (lines - 1)
    r0 = F.greatest(F.lit(0.0), py - half).cast("int")
    r1 = F.least(lines.cast("double"), py + half).cast("int")
    c0 = F.greatest(F.lit(0.0), px - half).cast("int")
    c1 = F.least(samples.cast("double"), px + half).cast("int")
    return F.when(
        fx.isNotNull() & fy.isNotNull() & (lines > 0) & (samples > 0) & (r1 - r0 >= 2) & (c1 - c0 >= 2),
        F.struct(r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1")),
    )


def pixel_to_geo(x: Column, y: Column, lat0: Column, lon0: Column, cell_m: Column, n: Column) -> Column:
    """Tangent-plane position of a pixel, north up; NULL without a centre."""
    lat = lat0 + (n / 2.0 - y) * cell_m / F.lit(_METRES_PER_DEG)
    lon = wrap_lon(lon0 + (x - n / 2.0) * cell_m / (F.lit(_METRES_PER_DEG) * F.cos(F.radians(F.abs(lat0)))))
    return F.when(
        lat0.isNotNull() & lon0.isNotNull(),
        F.struct(F.round(lat, 5).alias("lat_deg"), F.round(lon, 5).alias("lon_deg")),
    )


def geo_key(lat: Column, lon: Column) -> Column:
    """Cache key of a scene position in thousandths of a degree (half-even)."""
    return F.format_string("%d_%d", F.rint(lat * 1000).cast("long"), F.rint(lon * 1000).cast("long"))


def gsd_from_id(pid: Column, include_n: bool = False, default_m: float = 24.0) -> Column:
    """Metres per pixel from the ``_d<digits>`` tail of a product id."""
    tail = F.regexp_extract(pid, r"_[dn](\d+)(?:_\D*)?$" if include_n else r"_d(\d+)(?:_\D*)?$", 1)
    return F.when(pid.isNull() | (tail == ""), F.lit(default_m)).otherwise(tail.cast("double"))


def acq_date(pid: Column) -> Column:
    """The eight characters before the first ``T``."""
    return F.substring(F.split(pid, "T")[0], -8, 8)


def sun_vector(az_deg: Column, el_deg: Column) -> Column:
    """Sun direction in the (east, south, up) image frame."""
    az, el = F.radians(az_deg), F.radians(el_deg)
    return F.struct(
        (F.cos(el) * F.sin(az)).alias("east"),
        (-F.cos(el) * F.cos(az)).alias("south"),
        F.sin(el).alias("up"),
    )


def solar_incidence(el_deg: Column) -> Column:
    return F.lit(90.0) - el_deg


def effective_sun(az_deg: Column, el_deg: Column, label_az: Column, label_el: Column) -> Column:
    """The label's sun replaces the default pair, never values a caller pinned."""
    use_label = (
        label_az.isNotNull() & label_el.isNotNull()
        & (az_deg == DEFAULT_SUN[0]) & (el_deg == DEFAULT_SUN[1])
    )
    az = F.when(use_label, label_az).otherwise(az_deg)
    el = F.when(use_label, label_el).otherwise(el_deg)
    return F.struct(az.alias("az_deg"), el.alias("el_deg"), solar_incidence(el).alias("incidence_deg"))


def in_shadow(z: Column, p01: Column) -> Column:
    """Cells darker than any lit one: below three counts or the first percentile."""
    return F.coalesce(z < F.greatest(F.lit(3.0), p01), F.lit(False))


def lambert_slope(z: Column, median: Column, p01: Column, sun: Column, max_slope_deg: float = 35.0,
                  legacy: bool = False) -> Column:
    """Sun-parallel slope (p, q) of a Lambertian surface, zero in shadow.

    From I = A(-p sx - q sy + sz) the minimum-norm slope is
    -(I - A sz) / (A |s_h|^2) times (sx, sy). ``legacy=True`` gives the opposite
    sign, which older products carry.
    """
    sx, sy, sz = sun["east"], sun["south"], sun["up"]
    scale = median / F.greatest(sz, F.lit(1e-6))
    limit = math.tan(math.radians(max_slope_deg))
    raw = F.try_divide(z - scale * sz, scale * (sx * sx + sy * sy))
    t = F.greatest(F.lit(-limit), F.least(F.lit(limit), raw))
    t = F.when(in_shadow(z, p01), 0.0).when(z.isNotNull(), t if legacy else -t)
    return F.struct((sx * t).alias("p"), (sy * t).alias("q"))


def shade(p: Column, q: Column, sun: Column, albedo: Column) -> Column:
    """Lommel-Seeliger radiance for slopes (p, q), viewed from above, before scaling."""
    norm = F.sqrt(p * p + q * q + 1.0) + F.lit(1e-8)
    dot = (-p * sun["east"] - q * sun["south"] + sun["up"]) / norm
    cos_i = F.when(dot.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)))
    return albedo * cos_i / (cos_i + F.lit(1.0 + 1e-8))


def ransac_budget(w: Column, confidence: float = 0.99, sample: int = 4) -> Column:
    """Draws needed to hit one all-inlier sample with the given confidence."""
    hit = F.pow(F.greatest(w, F.lit(1e-3)), F.lit(sample))
    return F.when(hit < 1, F.ceil(F.lit(math.log(1 - confidence)) / F.log(1 - hit))).otherwise(F.lit(1)).cast("long")


def project(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a row-major 3x3 homography."""
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def residual(h: list[Column], sx: Column, sy: Column, rx: Column, ry: Column) -> Column:
    px, py = project(h, sx, sy)
    return F.hypot(px - rx, py - ry)


def blend_score(km: Column, ncc: Column) -> Column:
    """0.6 of the proximity score plus 0.4 of the non-negative correlation."""
    near = F.when(km.isNull(), 0.0).otherwise(F.lit(1.0) / (F.lit(1.0) + km / 50.0))
    return F.lit(0.6) * near + F.lit(0.4) * F.greatest(F.lit(0.0), F.coalesce(ncc, F.lit(-1.0)))


def stretch_u8(z: Column, lo: Column, hi: Column) -> Column:
    """Percentile stretch to 0..255 (truncated)."""
    dn = F.greatest(F.lit(0.0), F.least(F.lit(255.0), (z - lo) / (hi - lo + F.lit(1e-9)) * 255.0)).cast("int")
    return F.when(z.isNotNull(), dn)


def stretch_gain(z: Column, lo: Column, hi: Column, max_gain: float = 1.7) -> Column:
    """Gain-capped stretch, before its mean is moved to 128."""
    return (z - lo) * F.least(F.try_divide(F.lit(255.0), hi - lo), F.lit(max_gain))
