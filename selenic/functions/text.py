"""String, date and JSON helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: markers removed from narration text, and the line breaks and
# blanks that count as white space
REMOVED_MARKERS = ("$", "`", "**", "__", "\\(", "\\)", "\\[", "\\]")
ESCAPED_PERCENT = "\\%"
LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def slug(s: Column, n: int = 48) -> Column:
    """Only letters, digits, ``_`` and ``-``; at most n characters."""
    return F.substring(F.regexp_replace(s, "[^A-Za-z0-9_-]", "_"), 1, n)


def basename(path: Column) -> Column:
    """Last path component for either slash style."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def parse_list(s: Column) -> Column:
    """Comma/space list: entries with a ``/`` inside, first occurrence kept."""
    parts = F.transform(F.split(F.trim(s), r"[,\s]+"), lambda p: F.regexp_replace(p, "^/+|/+$", ""))
    return F.array_distinct(F.filter(parts, lambda p: p.contains("/")))


def clean_text(s: Column) -> Column:
    """Plain text: markup markers out, lines right-trimmed, blank runs collapsed."""
    for marker in REMOVED_MARKERS[:4]:
        s = F.replace(s, F.lit(marker))
    s = F.replace(s, F.lit(ESCAPED_PERCENT), F.lit("%"))
    for marker in REMOVED_MARKERS[4:]:
        s = F.replace(s, F.lit(marker))
    lines = F.split(F.regexp_replace(s, LINE_BREAKS, "\n"), "\n")
    lines = F.transform(lines, lambda x: F.rtrim(x, F.lit(BLANKS)))
    # a line break run of three or more is a run of blank lines
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), F.lit(BLANKS))


def parse_time(s: Column) -> Column:
    """ISO text with or without a zone and fraction; NULL when unreadable."""
    return F.try_to_timestamp(s)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def json_get(doc: Column, key: str, default: str | None = None) -> Column:
    """``doc[key]`` of a JSON text with a default."""
    value = F.get_json_object(doc, f"$.{key}")
    return value if default is None else F.coalesce(value, F.lit(default))


def drop_keys(m: Column, keys: list[str]) -> Column:
    """A map without the given keys."""
    return F.map_filter(m, lambda k, _: ~k.isin(keys))


def render_report(scene: Column, pct: Column, inliers: Column, candidates: Column, rmse: Column,
                  w: Column, k: Column) -> Column:
    """One plain sentence built only from computed numbers."""
    return F.format_string(
        "Scene %s: %.1f%% matched, %d of %d correspondences verified, RMSE %.2f px, inlier share %.2f, budget %d draws.",
        scene, F.coalesce(pct, F.lit(0.0)), F.coalesce(inliers, F.lit(0)), F.coalesce(candidates, F.lit(0)),
        F.coalesce(rmse, F.lit(0.0)), F.coalesce(w, F.lit(0.0)), F.coalesce(k, F.lit(0)),
    )


def context_block(name: Column, body: Column) -> Column:
    """A document under its header line."""
    return F.concat(F.lit("=== DOCUMENT: "), name, F.lit(" ===\n"), body)


def question(s: Column, n: int = 600) -> Column:
    return F.substring(F.trim(F.coalesce(s, F.lit("")), F.lit(BLANKS)), 1, n)
