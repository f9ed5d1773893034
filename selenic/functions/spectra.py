"""Spectral features and vector arithmetic over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the mineral legend (id, name, colour, rule)
LEGEND = (
    (0, "pyroxene-rich (mafic)", "#d64545", "deep 1 um + deep 2 um crystal-field bands"),
    (1, "olivine-rich (mafic)", "#3fa66a", "broad 1 um band, weak 2 um band"),
    (2, "feldspathic (highland-like)", "#cccccc", "shallow 1 um and 2 um bands (low Fe bearing phases)"),
    (3, "mixed / immature regolith", "#c8a24a", "intermediate band depths"),
    (4, "3 um OH/H2O-bearing", "#4a7fc8", "distinct absorption drop near 3 um"),
    (5, "low signal / uncertain", "#333333", "reflectance too low or saturated for band-depth analysis"),
)
FIRST_UM, SPAN_UM = 0.8, 4.2
FEATURES_UM = ((0.85, 1.35), (1.9, 2.6), (2.8, 3.1))


def wavelength(band: Column, channels: int = 256) -> Column:
    return F.lit(FIRST_UM) + band * F.lit(SPAN_UM / (channels - 1))


def band_for(um: Column, channels: int = 256) -> Column:
    """Nearest channel (half-even)."""
    return F.rint((um - FIRST_UM) / F.lit(SPAN_UM / (channels - 1))).cast("int")


def band_index(um: float, channels: int) -> int:
    return int(round((um - FIRST_UM) / (SPAN_UM / (channels - 1))))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def usable_spectrum(refl: Column) -> Column:
    return F.forall(refl, finite) & (F.array_max(refl) > 0)


def band_depth(refl: Column, lo_um: float, hi_um: float, channels: int = 256) -> Column:
    """(depth, centre) below the straight line between the shoulders."""
    i0, i1 = band_index(lo_um, channels), band_index(hi_um, channels)
    none = F.struct(F.lit(0.0).alias("depth"), F.lit(0.0).alias("centre_um"))
    if i1 - i0 < 3:
        return none
    seg = F.transform(F.slice(refl, i0 + 1, i1 - i0 + 1), lambda v: v.cast("double"))
    first, last = F.get(seg, F.lit(0)), F.get(seg, F.lit(i1 - i0))
    step = (last - first) / F.lit(float(i1 - i0))
    ratio = F.transform(seg, lambda v, i: v / F.greatest(F.lit(1e-6), first + step * i))
    low = F.array_min(ratio)
    centre = wavelength(F.lit(i0) + F.array_position(ratio, low) - 1, channels)
    ok = (F.size(refl) > i1) & usable_spectrum(seg)
    return F.when(ok, F.struct((1 - low).alias("depth"), centre.alias("centre_um"))).otherwise(none)


def mineral_class(d1: Column, d2: Column, d3: Column, valid: Column) -> Column:
    """Ordered band-depth rules; 5 for an unusable spectrum."""
    return (
        F.when(~F.coalesce(valid, F.lit(False)), 5)
        .when(d3 > 0.25, 4)
        .when((d2 > 0.12) & (d1 > 0.08), 0)
        .when((d1 > 0.10) & (d2 <= 0.12), 1)
        .when((d1 < 0.05) & (d2 < 0.06), 2)
        .otherwise(3)
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalise(a: Column) -> Column:
    size = norm(a) + F.lit(1e-8)
    return F.transform(a, lambda v: v.cast("double") / size)
