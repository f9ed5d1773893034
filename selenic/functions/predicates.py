"""Row predicates and status rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_nodata(z: Column, missing: Column | float | None = None, floor: float | None = -32000.0) -> Column:
    """NULL for the missing value, the integer fill range and non-finite samples."""
    bad = F.isnan(z) | (F.abs(z) == float("inf"))
    if missing is not None:
        bad = bad | (z == (missing if isinstance(missing, Column) else F.lit(missing)))
    if floor is not None:
        bad = bad | (z <= floor)
    return F.when(~bad, z)


def strided(row: Column, col: Column, k: int) -> Column:
    return (row % k == 0) & (col % k == 0)


def in_window(row: Column, col: Column, r0, c0, r1, c1) -> Column:
    """Half-open pixel window."""
    return (row >= r0) & (row < r1) & (col >= c0) & (col < c1)


def valid_height(z: Column) -> Column:
    return (z > -5000) & (z < 12000)


def valid_browse(dn: Column) -> Column:
    """Neither the black frame nor the white margin of a thumbnail."""
    return (dn > 10) & (dn < 245)


def has_content(dn: Column) -> Column:
    return dn > 12


def is_product_id(pid: Column) -> Column:
    return pid.rlike("^ch[12]_tmc_")


def readable_label(lines: Column, dtype: Column) -> Column:
    return (F.coalesce(lines, F.lit(0)) > 0) & dtype.isNotNull()


def support_status(candidates: Column, minimum: int = 8) -> Column:
    return F.when(candidates < minimum, "insufficient_candidates").otherwise("ok")


def enough_inliers(inliers: Column, minimum: int = 10) -> Column:
    return F.coalesce(inliers, F.lit(0)) >= minimum


def accept_reference(refined: Column, inliers: Column, ncc: Column, min_ncc: float = 0.35) -> Column:
    """Status and note of a registered reference candidate."""
    ok = (F.coalesce(refined, F.lit(False)) & enough_inliers(inliers)) | (F.coalesce(ncc, F.lit(0.0)) >= min_ncc)
    return F.struct(
        F.when(ncc.isNull() & refined.isNull(), "unavailable").when(ok, "selected").otherwise("rejected").alias("status"),
        F.when(ncc.isNull() & refined.isNull(), "no strip could be registered")
        .when(ok, "registered reference accepted")
        .otherwise(F.format_string("best registration NCC %.2f below %.2f", F.coalesce(ncc, F.lit(0.0)), F.lit(min_ncc)))
        .alias("note"),
    )
