"""Event-log queries: sliding windows, runs, status, and the streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from selenic.operators import catalog, logs
from selenic.session import workdir
from selenic.streaming import streams
from selenic.suite.registry import query, r

c, lit = F.col, F.lit
HOUR = 3_600_000
MS = "epoch_us(ts) // 1000"


@query("win_03_longest_run", """
SELECT ray_id, max(n) AS longest FROM (
  SELECT ray_id, g, count(*) FILTER (WHERE p) AS n FROM (SELECT *, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (PARTITION BY ray_id ORDER BY pos, event_id) AS g
    FROM (SELECT s.*, dn < 0.95 * m AS p FROM {fx:samples} s JOIN (SELECT ray_id, avg(dn) AS m FROM {fx:samples} GROUP BY ray_id) a ON s.ray_id = a.ray_id) q) q2
  GROUP BY ray_id, g) q3 GROUP BY ray_id""")
def _(inp):
    from selenic.operators.stats import with_group

    s = with_group(inp.fx("samples"), ["ray_id"], rim=F.avg("dn"))
    return logs.longest_run(s, ["ray_id"], "pos", "event_id", c("dn") < 0.95 * c("rim"), F.to_date("pos"))


@query("win_06_sliding_count", f"""
SELECT event_id, key, n AS n_window, n <= 2 AS allowed FROM (
  SELECT event_id, key, CAST(count(*) OVER (PARTITION BY key ORDER BY ms RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS n
  FROM (SELECT *, {MS} AS ms FROM {{fx:requests}}) q) q2""")
def _(inp):
    return logs.sliding_count(inp.fx("requests"), "key", "ts", 6 * HOUR, 2).select("event_id", "key", "n_window", "allowed")


@query("win_07_latest_status", """
SELECT scene_id, stage, status FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY created_at DESC, job_id DESC) AS rn FROM {fx:jobs}) q WHERE rn = 1""")
def _(inp):
    return catalog.latest_status(inp.fx("jobs")).select("scene_id", "stage", "status")


def _event_stream(inp):
    """The events table as a file stream."""
    schema = inp.table("events").schema
    return inp.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(inp.dir)


def _drain(inp, stream, name, mode="append"):
    base = workdir(inp.spark, name)
    return streams.run_available(stream, f"{base}/out", f"{base}/checkpoint", mode)


@query("str_01_rate_limit", f"""
SELECT key, ms, count(*) AS n_events, max(n) AS n_window, max(n) <= 2 AS allowed FROM (
  SELECT key, ms, CAST(count(*) OVER (PARTITION BY key ORDER BY ms RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS n
  FROM (SELECT *, {MS} AS ms FROM {{fx:requests}}) q) q2 GROUP BY key, ms""")
def _(inp):
    ev = _event_stream(inp).select(c("user_id").alias("key"), "ts")
    return streams.newest(_drain(inp, streams.rate_limit_stream(ev, window_ms=6 * HOUR, limit=2), "rate-limit"), ["key", "ms"])


# the chain of fresh events per key, one hop of a recursion per fresh event
TTL = f"""WITH RECURSIVE e AS (SELECT key, {MS} AS t, count(*) AS n_events FROM {{fx:requests}} GROUP BY 1, 2),
n AS (SELECT a.key, a.t, min(b.t) AS nxt FROM e a LEFT JOIN e b ON a.key = b.key AND b.t >= a.t + {24 * HOUR} GROUP BY 1, 2),
f AS (SELECT key, min(t) AS t FROM e GROUP BY key UNION ALL SELECT f.key, n.nxt FROM f JOIN n ON f.key = n.key AND f.t = n.t WHERE n.nxt IS NOT NULL)
SELECT e.key, e.t, n_events, CASE WHEN f.t IS NULL THEN 'hit' ELSE 'fresh' END AS state FROM e LEFT JOIN f ON e.key = f.key AND e.t = f.t"""


@query("str_03_ttl_gate_batch", TTL)
def _(inp):
    return logs.ttl_gate(inp.fx("requests"), "key", "ts", 24 * HOUR)


@query("str_03_ttl_gate", TTL)
def _(inp):
    ev = _event_stream(inp).select(c("user_id").alias("key"), "ts")
    return streams.newest(_drain(inp, streams.ttl_gate_stream(ev, ttl_ms=24 * HOUR), "ttl-gate"), ["key", "t"])


# a status is over once the watermark, ten minutes behind the last event, is ten minutes past it
@query("str_04_job_status", f"""
SELECT scene_id, stage, status, epoch_us(created_at) // 1000 AS ms, epoch_us(created_at) // 1000 > (SELECT max(epoch_us(created_at) // 1000) FROM {{fx:jobs}}) - 1200000 AS alive
FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY created_at DESC, job_id DESC) AS rn FROM {{fx:jobs}}) q WHERE rn = 1""")
def _(inp):
    ev = _event_stream(inp).select(
        c("event_id").alias("job_id"), c("user_id").alias("scene_id"), c("event_type").alias("stage"),
        F.when(c("event_type") == "error", "failed").otherwise("done").alias("status"), c("ts").alias("created_at"))
    latest = streams.present(_drain(inp, streams.job_status_stream(ev), "job-status"))
    return latest.select("scene_id", "stage", "status", F.unix_millis("created_at").alias("ms"), "alive")
