"""Catalog maintenance: unions, precedence, change detection, lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from selenic.functions.spectra import LEGEND

c, lit = F.col, F.lit


def union_catalogs(*catalogs: DataFrame) -> DataFrame:
    out = catalogs[0]
    for other in catalogs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def _extreme(df: DataFrame, keys: list[str], order: Column, pick) -> DataFrame:
    rest = [x for x in df.columns if x not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, *[c(f"_r.{x}").alias(x) for x in rest])


def first_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the smallest by ``order``: a partial aggregate, no sort of the group."""
    return _extreme(df, keys, F.struct(*order), F.min_by)


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return _extreme(df, keys, F.struct(*order), F.max_by)


def latest_status(jobs: DataFrame, key: str = "scene_id", ts: str = "created_at", tie: str = "job_id") -> DataFrame:
    return last_wins(jobs, [key], ts, tie)


def carry_over(old: DataFrame, new: DataFrame, cached: DataFrame, key: str = "product_id",
               note: str = "cached label") -> DataFrame:
    """New entries plus old ones that are gone but whose label is still cached."""
    kept = old.join(new.select(key), key, "left_anti").join(cached.select(key), key, "left_semi")
    return new.unionByName(kept.withColumn("source", lit(note)), allowMissingColumns=True)


def purge_stale(registry: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) registry rows by whether their data exists."""
    present = existing.select(key)
    return registry.join(present, key, "left_semi"), registry.join(present, key, "left_anti")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and changed paths of two (path, size, mtime) listings."""
    o = old.select("path", c("size").alias("_s0"), c("mtime").alias("_m0"), lit(True).alias("_in0"))
    n = new.select("path", c("size").alias("_s1"), c("mtime").alias("_m1"), lit(True).alias("_in1"))
    same = c("_s0").eqNullSafe(c("_s1")) & c("_m0").eqNullSafe(c("_m1"))
    change = (F.when(c("_in0").isNull(), "added").when(c("_in1").isNull(), "removed").when(~same, "changed"))
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def required_minus_present(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.join(present.distinct(), present.columns, "left_anti").distinct()


def legend(spark) -> DataFrame:
    """The six mineral classes; a fixed size, safe to broadcast."""
    return spark.createDataFrame([tuple(x) for x in LEGEND], "class_id int, name string, color string, rule string")


def decode_class(df: DataFrame, col: str = "class_id") -> DataFrame:
    names = F.broadcast(legend(df.sparkSession).withColumnRenamed("class_id", "_id"))
    return df.join(names, df[col] == c("_id"), "left").drop("_id")


def _grams(s: Column, q: int) -> Column:
    n = F.greatest(lit(1), F.length(s) - q + 1)
    return F.array_distinct(F.transform(F.sequence(lit(1), n), lambda i: F.substr(s, i, lit(q))))


def prefix_ranges(markers: DataFrame, texts: DataFrame, longest: int, first: bool = False) -> DataFrame:
    """(short, long) where ``text`` begins with ``short``; with ``first`` the smallest long of each short.

    ``markers(short)`` of at most ``longest`` characters, ``texts(text, long)``. Both are dealt to ranges
    of (text, long) and sorted, so the texts under a marker are one range that may span any number of
    tasks, and copies of one text are split as well. A task walks its range with the stack of markers
    that the current text begins with. Markers of earlier ranges are guessed from the first text of a
    task; the guesses that are no markers go in the last join.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[str] = []
        least: dict[str, str] = {}
        begun = False
        for b in batches:
            short, long = [], []
            for text, owner in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not begun:
                    begun, stack = True, [text[:n] for n in range(1, min(longest, len(text)) + 1)]
                while stack and not text.startswith(stack[-1]):
                    gone = stack.pop()
                    if gone in least:
                        short.append(gone)
                        long.append(least.pop(gone))
                if owner is None:
                    if not stack or stack[-1] != text:
                        stack.append(text)
                elif first:
                    for m in stack:
                        least[m] = min(owner, least.get(m, owner))
                else:
                    short += stack
                    long += [owner] * len(stack)
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.string()), pa.array(long, pa.string())], ["short", "long"])
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.string()), pa.array(list(least.values()), pa.string())], ["short", "long"])

    if first:  # copies of a text are one row
        texts = texts.groupBy("text").agg(F.min("long").alias("long"))
    rows = texts.select("text", "long").unionByName(markers.select(c("short").alias("text"), lit(None).cast("string").alias("long")))
    rows = rows.repartitionByRange(c("text"), c("long").asc_nulls_first()).sortWithinPartitions(c("text"), c("long").asc_nulls_first())
    found = rows.mapInArrow(walk, "short string, long string")
    if first:
        found = found.groupBy("short").agg(F.min("long").alias("long"))
    return found.join(markers.select("short"), "short", "left_semi")


def containing_pairs(short: DataFrame, long: DataFrame, q: int = 8, first: bool = False) -> DataFrame:
    """(short, long) where the text ``long`` contains ``short``; with ``first`` a text shorter
    than q meets the smallest of its long texts only.

    Every short text is anchored on its rarest q-gram and joined only with the long
    texts that hold this gram. Frequencies are counted by a partial aggregate, so a prefix
    that all ids share never becomes a join key. Texts shorter than q are prefix ranges of the
    sorted suffixes, of which q - 1 characters decide; only suffixes that begin with the first
    character of such a text are sorted.
    """
    s = short.select("short").where(F.length("short") > 0).distinct()
    big = long.select("long").distinct()
    tiny, rest = s.where(F.length("short") < q), s.where(F.length("short") >= q)

    grams = big.select("long", F.explode(_grams(c("long"), q)).alias("g"))
    freq = grams.groupBy("g").agg(F.count("*").alias("_f"))
    owned = rest.select("short", F.explode(_grams(c("short"), q)).alias("g")).join(freq, "g", "left")
    anchor = owned.groupBy("short").agg(F.min_by("g", F.struct(F.coalesce("_f", lit(0)), "g")).alias("g"))
    hits = anchor.join(grams, "g").where(c("long").contains(c("short"))).select("short", "long")

    suffix = big.where(F.length("long") > 0).select("long", F.explode(F.array_distinct(F.transform(
        F.sequence(lit(1), F.length("long")), lambda i: F.substr(c("long"), i, lit(q - 1))))).alias("text"))
    initial = tiny.select(F.substring("short", 1, 1).alias("_a")).distinct()
    suffix = suffix.withColumn("_a", F.substring("text", 1, 1)).join(initial, "_a", "left_semi").select("text", "long")
    return hits.unionByName(prefix_ranges(tiny, suffix, q - 1, first).distinct())


def pick_reference(scenes: DataFrame, products: DataFrame, q: int = 8) -> DataFrame:
    """The recorded product of a scene, else the first one whose id contains, or is
    contained in, the scene's own product id.

    ``scenes(scene_id, reference_id, own_id)``, ``products(product_id)``.
    """
    ids = products.select("product_id").distinct()
    exact = scenes.join(ids, scenes.reference_id == c("product_id"), "left")
    missing = exact.where(c("product_id").isNull()).select("scene_id", "own_id")
    own = missing.select("own_id").where("own_id is not null and own_id <> ''").distinct()
    inside = containing_pairs(ids.select(c("product_id").alias("short")), own.select(c("own_id").alias("long")), q)
    around = containing_pairs(own.select(c("own_id").alias("short")), ids.select(c("product_id").alias("long")), q, first=True)
    match = (inside.select(c("long").alias("own_id"), c("short").alias("product_id"))
             .unionByName(around.select(c("short").alias("own_id"), c("long").alias("product_id"))))
    first = match.groupBy("own_id").agg(F.min("product_id").alias("fallback"))
    return (exact.join(first, "own_id", "left")
            .select("scene_id", F.coalesce("product_id", "fallback").alias("product_id"),
                    F.when(c("product_id").isNotNull(), "recorded").when(c("fallback").isNotNull(), "substring").alias("how")))


def scene_payload(scenes: DataFrame, refs: DataFrame, craters: DataFrame) -> DataFrame:
    """Scene with nested references and craters; missing parts stay empty.

    Both inputs are top-k tables (five references, 25 craters per scene), which
    bounds the nested arrays.
    """
    ref = refs.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "product_id", "score"))).alias("references"))
    crater = craters.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cand_id", "radius_px"))).alias("craters"))
    return scenes.join(ref, "scene_id", "left").join(crater, "scene_id", "left")


def grounding_context(docs: DataFrame, key: str, part_chars: int | None = None) -> DataFrame:
    """Context texts per key: (key, part, n_chars, context), documents in name order, each under its header.

    ``docs(key, name, body)``. With ``part_chars`` the text of a key comes in numbered parts that
    begin with a new document once the text so far has reached that length, so no group
    grows with the data and nothing is lost. Without it a key is one part.
    """
    from selenic.functions.text import context_block

    blocks = docs.select(key, "name", context_block(c("name"), c("body")).alias("block"))
    if part_chars:
        before = F.sum(F.length("block") + 2).over(W.partitionBy(key).orderBy("name", "block").rowsBetween(W.unboundedPreceding, -1))
        blocks = blocks.withColumn("part", F.floor(F.coalesce(before, lit(0)) / part_chars).cast("int"))
    else:
        blocks = blocks.withColumn("part", lit(0))
    return blocks.groupBy(key, "part").agg(
        F.sum(F.length("block") + 2).alias("n_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "block"))), lambda d: d["block"]), "\n\n").alias("context"))
