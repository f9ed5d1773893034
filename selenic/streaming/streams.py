"""Stateful event operators as Structured Streaming jobs.

Each has a batch twin in ``operators.logs`` with the same result on the same events,
whatever batches they arrive in; rows behind the watermark are dropped. State lies in
``keyed``: by bucket of event time, with timers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selenic.operators.catalog import last_wins
from selenic.sources.catalog_log import CatalogLog
from selenic.streaming import keyed

c, lit = F.col, F.lit

# fixed values of the services
RATE_WINDOW_MS, STATUS_TTL_MS = 60_000, 600_000
MATCH_TTL_MS, TERRAIN_TTL_MS, COOLDOWN_MS = 1_800_000, 600_000, 300_000
LATENESS = "10 minutes"


def event_time(events: DataFrame, ts: str = "ts", late: str = LATENESS) -> DataFrame:
    """TIMESTAMP event time with a watermark; later rows are dropped."""
    return events.withColumn(ts, c(ts).cast("timestamp")).withWatermark(ts, late)


def rate_limit_stream(events: DataFrame, key: str = "key", ts: str = "ts", window_ms: int = RATE_WINDOW_MS, limit: int = 10) -> DataFrame:
    """Sliding count per key: (key, ms, n_events, n_window, allowed, version).

    A row that arrives out of order but before the watermark changes the counts after it;
    those milliseconds are given again with a higher version (see ``newest``).
    """
    ktype = events.schema[key].dataType.simpleString()
    return keyed.run(event_time(events, ts).select(key, ts), keyed.SlidingCount(key, ts, window_ms, limit),
                     f"{key} {ktype}, ms bigint, n_events bigint, n_window bigint, allowed boolean, version bigint")


def ttl_gate_stream(events: DataFrame, key: str = "key", ts: str = "ts", ttl_ms: int = MATCH_TTL_MS) -> DataFrame:
    """``fresh`` or ``hit`` per key and millisecond, with a version as in ``rate_limit_stream``."""
    ktype = events.schema[key].dataType.simpleString()
    return keyed.run(event_time(events, ts).select(key, ts), keyed.TtlGate(key, ts, ttl_ms),
                     f"{key} {ktype}, t bigint, n_events bigint, state string, version bigint")


def newest(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each answer of a rate or gate stream."""
    rest = [x for x in answers.columns if x not in keys]
    best = answers.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_b"))
    return best.select(*keys, *[c(f"_b.{x}").alias(x) for x in rest if x != "version"])


def job_status_stream(jobs: DataFrame, key: str = "scene_id", ts: str = "created_at", tie: str = "job_id", ttl_ms: int = STATUS_TTL_MS,
                      late: str = LATENESS) -> DataFrame:
    """(key, stage, status, alive, tie, ts): the latest status of a key when it changes, and once more, not alive, when it expires.

    A status lives ``ttl_ms`` of event time; its timer then drops the state (see ``present``).
    """
    ktype = jobs.schema[key].dataType.simpleString()
    return keyed.run(event_time(jobs, ts, late).select(key, ts, tie, "stage", "status"), keyed.JobStatus(key, ts, tie, ttl_ms),
                     f"{key} {ktype}, stage string, status string, alive boolean, tie string, {ts} timestamp")


def present(answers: DataFrame, key: str = "scene_id", ts: str = "created_at") -> DataFrame:
    """The newest status of each key in what a status stream has given, with whether it is still alive."""
    # the row that says a status is over follows the one that gave it
    order = F.struct(c(ts), c("tie"), ~c("alive"))
    return answers.groupBy(key).agg(*[F.max_by(x, order).alias(x) for x in ("stage", "status", "alive")], F.max(ts).alias(ts))


def incremental_catalog(labels: DataFrame, parse: Callable[[DataFrame], DataFrame], target: str, quarantine: str,
                        checkpoint: str, key: str = "product_id", version: str = "version", compact_every: int = 16):
    """Keep a catalog current from a stream of label files.

    ``labels`` is a stream of (path, xml, version). Unreadable labels go to the
    quarantine table and never stop the stream. A batch is parsed once and writes its own
    rows to the ``CatalogLog`` at ``target``, which is compacted every few batches; a rerun of a batch
    changes nothing, so a lost driver loses nothing.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        parsed = parse(batch).persist()
        parsed.where("error is not null").select("path", "error").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        log = CatalogLog(batch.sparkSession, target, key, version, "path")
        log.append(parsed.where("error is null").drop("error"), batch_id)
        parsed.unpersist()
        if (batch_id + 1) % compact_every == 0:
            log.compact(batch_id)
    return labels.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def current_catalog(spark: SparkSession, target: str, key: str = "product_id", version: str = "version") -> DataFrame:
    """The catalog that a finished or running stream has kept so far."""
    return CatalogLog(spark, target, key, version, "path").read()


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain the available input into a parquet table and return it."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    else:
        # update and complete results replace the earlier rows of their key
        q = stream.writeStream.outputMode(mode).foreachBatch(
            lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
