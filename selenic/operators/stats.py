"""Group statistics that never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def with_group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Attach per-group aggregates.

    A partial aggregate plus a join, not a window: a window over the group key
    would sort every row of the group in one task. AQE broadcasts the small side
    when its measured size allows and splits skewed keys otherwise.
    """
    return df.join(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      bins: int = 4096) -> DataFrame:
    """Exact linear-interpolated percentiles, one column per entry of ``probs``.

    Counts per value bin find the bin of every wanted rank; only the values in
    those bins are counted one by one. Both steps are partial aggregates, and the
    windows run over at most ``bins`` rows or over the distinct values of one bin.
    """
    df = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    span = df.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    width = F.col("_hi") - F.col("_lo")
    slot = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / width * bins))).otherwise(0)
    binned = df.join(span.select(*keys, "_lo", "_hi"), keys).select(*keys, "_v", slot.cast("int").alias("_b"))
    counts = binned.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    order = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    cum = counts.withColumn("_end", F.sum("_c").over(order)).withColumn("_start", F.col("_end") - F.col("_c"))

    marks = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            marks.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.alias("rank"),
                                  (pos - F.floor(pos)).alias("frac")))
    wanted = span.select(*keys, F.explode(F.array(*marks)).alias("_m"))
    hit = wanted.join(cum, keys).where((F.col("_m.rank") >= F.col("_start")) & (F.col("_m.rank") < F.col("_end")))
    hit = hit.select(*keys, "_b", "_start", "_m")

    inside = binned.join(hit.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
    values = inside.groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_c"))
    run = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    values = values.withColumn("_to", F.sum("_c").over(run)).withColumn("_from", F.col("_to") - F.col("_c"))
    at = hit.join(values, [*keys, "_b"]).where(
        (F.col("_m.rank") - F.col("_start") >= F.col("_from")) & (F.col("_m.rank") - F.col("_start") < F.col("_to")))

    def pick(name):
        def side(s):
            return F.max(F.when((F.col("_m.name") == name) & (F.col("_m.side") == s), F.col("_v")))
        frac = F.max(F.when(F.col("_m.name") == name, F.col("_m.frac")))
        return (side("lo") + (side("hi") - side("lo")) * frac).alias(name)

    return at.groupBy(*keys).agg(*[pick(n) for n in probs])
