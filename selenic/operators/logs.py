"""Ordered event data: sliding counts, time-to-live gates, runs and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from selenic.session import materialise

c, lit = F.col, F.lit


def top_k(df: DataFrame, keys: list[str], order: list, k: int | None) -> DataFrame:
    """First k rows per key, or all with their rank. Spark cuts each task's rows to k before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked.where(c("rank") <= k) if k else ranked


def sliding_count(events: DataFrame, key: str, ts: str, window_ms: int, limit: int) -> DataFrame:
    """Requests of a key in (t - window, t], itself and rejected ones included.

    Equal milliseconds are counted first, so a busy key costs one row per millisecond.
    The time line is cut into buckets of one window; each bucket also sees the one
    before it. A window partition therefore holds two window lengths of distinct
    milliseconds however hot the key is.
    """
    ms = F.unix_millis(c(ts).cast("timestamp"))
    keyed = events.withColumn("_ms", ms)
    ticks = keyed.groupBy(key, "_ms").agg(F.count("*").alias("_n"))
    # a tick counts from its time on and no longer one window later: one running sum a bucket
    home = F.floor(c("_ms") / window_ms)
    both = F.array(F.struct(c("_ms").alias("_at"), lit(1).alias("_own"), c("_n").alias("_d"), home.alias("_b")),
                   F.struct(c("_ms").alias("_at"), lit(2).alias("_own"), c("_n").alias("_d"), (home + 1).alias("_b")),
                   F.struct((c("_ms") + window_ms).alias("_at"), lit(0).alias("_own"), (-c("_n")).alias("_d"), (home + 1).alias("_b")))
    steps = ticks.select(key, F.explode(both).alias("_s")).select(key, "_s.*")
    w = W.partitionBy(key, "_b").orderBy("_at", "_own").rowsBetween(W.unboundedPreceding, 0)
    total = steps.withColumn("n_window", F.sum("_d").over(w)).where("_own = 1").withColumnRenamed("_at", "_ms")
    total = total.select(key, "_ms", "n_window", (c("n_window") <= limit).alias("allowed"))
    return keyed.join(total, [key, "_ms"]).drop("_ms")


def ttl_gate(events: DataFrame, key: str, ts: str, ttl_ms: int) -> DataFrame:
    """``fresh`` or ``hit`` per (key, millisecond): a fresh event opens a ttl, events
    inside it are hits, the first one at or after its end is fresh again.

    The fold is sequential per key, but the successor of a fresh event is a local
    lookup: the first event at or after t + ttl. Successors are found in time buckets
    of two ttl, a gap of a ttl or more always starts anew, and reachability from those
    starts is closed by pointer doubling. No key is gathered in one task and the number
    of rounds grows with the logarithm of the longest chain.
    """
    ms = F.unix_millis(c(ts).cast("timestamp"))
    ticks = events.select(key, ms.alias("t")).groupBy(key, "t").agg(F.count("*").alias("n_events"))
    # events and, one ttl after each, the question for the next event; time runs backwards in a bucket
    bucket = lambda t: F.floor(t / (2 * ttl_ms))
    marks = F.array(F.struct(c("t").alias("at"), lit(0).alias("ask"), bucket(c("t")).alias("_b"), c("t").alias("event")),
                    F.struct(c("t").alias("at"), lit(0).alias("ask"), (bucket(c("t")) - 1).alias("_b"), c("t").alias("event")),
                    F.struct((c("t") + ttl_ms).alias("at"), lit(1).alias("ask"), bucket(c("t") + ttl_ms).alias("_b"), lit(None).cast("long").alias("event")))
    back = W.partitionBy(key, "_b").orderBy(F.desc("at"), "ask").rowsBetween(W.unboundedPreceding, 0)
    asked = ticks.select(key, "t", F.explode(marks).alias("_m")).select(key, "t", "_m.*")
    asked = asked.withColumn("nxt", F.last("event", ignorenulls=True).over(back)).where("ask = 1")
    asked = asked.select(key, "t", F.when(c("nxt") < c("t") + 2 * ttl_ms, c("nxt")).alias("nxt"))
    home = bucket(c("t"))
    near = ticks.withColumn("_home", home).withColumn("_b", F.explode(F.array(home, home + 1)))
    near = near.withColumn("_prev", F.lag("t").over(W.partitionBy(key, "_b").orderBy("t"))).where(c("_b") == c("_home"))
    nodes = near.join(asked, [key, "t"]).select(
        key, "t", "n_events", F.coalesce(c("_prev") <= c("t") - ttl_ms, lit(True)).alias("start"), "nxt")
    # without a predecessor inside a ttl an event starts anew, so chains never need a longer reach
    nodes = materialise(nodes, "ttl-nodes")
    # a chain may end where the next event lies beyond 2 ttl: that event is a start by itself
    fresh = nodes.where("start").select(key, "t")
    jump = nodes.where("nxt is not null").select(key, "t", "nxt")
    while True:
        reached = fresh.join(jump, [key, "t"]).select(key, c("nxt").alias("t"))
        grown = materialise(fresh.unionByName(reached).distinct(), "ttl-fresh")
        leap = jump.select(c(key), c("t").alias("nxt"), c("nxt").alias("_far"))
        jump = materialise(jump.join(leap, [key, "nxt"]).select(key, "t", c("_far").alias("nxt")), "ttl-jump")
        fresh = grown
        if jump.isEmpty():
            break
    marked = fresh.withColumn("_f", lit(True))
    return nodes.join(marked, [key, "t"], "left").select(
        key, "t", "n_events", F.when(c("_f"), "fresh").otherwise("hit").alias("state"))


def longest_run(samples: DataFrame, keys: list[str], pos: str, tie: str, pred: Column, segment: Column) -> DataFrame:
    """Longest run of consecutive samples that satisfy ``pred``, per key.

    ``segment`` is a non-decreasing function of the position. Runs are measured inside
    a segment first and then joined across segments, so a key with very many samples
    is split over tasks.
    """
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = samples.select(*keys, c(pos).alias("_at"), c(tie).alias("_tie"), F.coalesce(pred, lit(False)).alias("_p"), segment.alias("_s"))
    # by segment, and narrow rows: a key's segments lie in many tasks
    s = s.repartition(parts, *keys, "_s")
    inner = W.partitionBy(*keys, "_s").orderBy("_at", "_tie")
    s = s.withColumn("_i", F.row_number().over(inner))
    # a sample that breaks a run knows the break before it, so runs need no rows of their own
    stop = F.when(~c("_p"), c("_i"))
    s = s.withColumn("_gap", c("_i") - 1 - F.coalesce(F.max(stop).over(inner.rowsBetween(W.unboundedPreceding, -1)), lit(0)))
    seg = s.groupBy(*keys, "_s").agg(
        F.count("*").alias("_n"), F.count_if(~c("_p")).alias("_breaks"), F.min(stop).alias("_from"), F.max(stop).alias("_to"),
        F.max(F.when(~c("_p"), c("_gap"))).alias("_best"))
    seg = seg.withColumns({"_head": F.coalesce(c("_from").cast("long") - 1, c("_n")), "_tail": c("_n") - F.coalesce("_to", lit(0))})
    seg = seg.withColumn("_best", F.greatest("_best", "_tail"))
    # a segment without a break carries the run on; one with a break closes it and opens another
    outer = W.partitionBy(*keys).orderBy("_s")
    seg = seg.withColumn("_open", F.when(c("_breaks") > 0, 1).otherwise(0))
    seg = seg.withColumn("_r", F.sum("_open").over(outer.rowsBetween(W.unboundedPreceding, 0)))
    carried = seg.select(*keys, "_best",
                         c("_r").alias("_run"), F.when(c("_open") == 1, c("_tail")).otherwise(c("_tail")).alias("_part"))
    closing = seg.where("_open = 1").select(*keys, lit(0).cast("long").alias("_best"), (c("_r") - 1).alias("_run"), c("_head").alias("_part"))
    joined = carried.unionByName(closing).groupBy(*keys, "_run").agg(F.max("_best").alias("_best"), F.sum("_part").alias("_sum"))
    return joined.groupBy(*keys).agg(F.max(F.greatest("_best", "_sum")).alias("longest"))
