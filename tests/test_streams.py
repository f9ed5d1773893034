"""Event order across micro-batches: streams against their batch twins."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from selenic.operators import logs
from selenic.streaming import keyed, streams

FILES = [[100], [50, 110], [200_000], [60]]


def _source(spark, tmp_path, files):
    """One file per batch, in order of modification."""
    folder = str(tmp_path / "in")
    for i, seconds in enumerate(files):
        df = spark.createDataFrame([("k", s * 1000) for s in seconds], "key string, ms long").select("key", F.timestamp_millis("ms").alias("ts"))
        df.coalesce(1).write.mode("append").json(folder)
        for name in os.listdir(folder):
            if name.endswith(".json") and not os.path.exists(f"{folder}/.seen-{name}"):
                os.utime(f"{folder}/{name}", (1_600_000_000 + i, 1_600_000_000 + i))
                open(f"{folder}/.seen-{name}", "w").close()
    return spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).json(folder)


def test_rate_limit_out_of_order(spark, tmp_path):
    out = streams.run_available(streams.rate_limit_stream(_source(spark, tmp_path, FILES), window_ms=60_000, limit=2), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {r.ms // 1000: (r.n_window, r.allowed) for r in streams.newest(out, ["key", "ms"]).collect()}
    # the row at 60 s is behind the watermark when it comes
    assert got == {50: (1, True), 100: (2, True), 110: (2, True), 200_000: (1, True)}
    on_time = spark.createDataFrame([("k", s * 1000) for f in FILES[:3] for s in f], "key string, ms long").select("key", F.timestamp_millis("ms").alias("ts"))
    twin = {r.s: r.n_window for r in logs.sliding_count(on_time, "key", "ts", 60_000, 2).select((F.unix_millis("ts") / 1000).cast("int").alias("s"), "n_window").collect()}
    assert twin == {s: n for s, (n, _) in got.items()}


def test_gate_out_of_order(spark, tmp_path):
    out = streams.run_available(streams.ttl_gate_stream(_source(spark, tmp_path, FILES), ttl_ms=55_000), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {r.t // 1000: r.state for r in streams.newest(out, ["key", "t"]).collect()}
    assert got == {50: "fresh", 100: "hit", 110: "fresh", 200_000: "fresh"}


def test_hot_key_is_linear(spark):
    ev = spark.range(100_000).select(F.lit("k").alias("key"), F.timestamp_millis(F.col("id") * 3).alias("ts"))
    got = logs.sliding_count(ev, "key", "ts", 600_000, 10).agg(F.max("n_window"), F.count("*")).first()
    assert tuple(got) == (100_000, 100_000)
    gate = logs.ttl_gate(ev, "key", "ts", 100_000).where("state = 'fresh'").orderBy("t").collect()
    assert [r.t for r in gate] == [0, 100_002, 200_004]


class Map:
    """A state map in memory that counts its reads."""

    def __init__(self):
        self.d, self.reads = {}, 0

    def getValue(self, k):  # noqa: N802
        self.reads += 1
        return self.d.get(k)

    def containsKey(self, k):  # noqa: N802
        return k in self.d

    def updateValue(self, k, v):  # noqa: N802
        self.d[k] = v

    def removeKey(self, k):  # noqa: N802
        self.d.pop(k, None)

    def keys(self):
        return iter(list(self.d))

    def iterator(self):
        return iter(list(self.d.items()))


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Handle:
    """State and timers of one key, and the watermark."""

    def __init__(self, processor):
        self.maps, self.timers, self.mark, self.processor = {}, set(), 0, processor
        processor.init(self)

    def getValueState(self, name, schema):  # noqa: N802
        return self.maps.setdefault(name, Value())

    def getMapState(self, name, *schema):  # noqa: N802
        return self.maps.setdefault(name, Map())

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.discard(ms)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.mark

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.now

    def batch(self, times, **columns):
        frame = pd.DataFrame({"ts": pd.to_datetime(times, unit="ms"), **columns})
        out = list(self.processor.handleInputRows(("k",), iter([frame]), self))
        return pd.concat(out) if out else pd.DataFrame()

    def advance(self, mark):
        """Fire the timers that a new watermark passes."""
        self.mark, out = mark, []
        while due := sorted(t for t in self.timers if t <= mark):
            self.timers.discard(due[0])
            self.now = due[0]
            out += self.processor.handleExpiredTimer(("k",), self, self)
        return out


def batches(seed, n=12):
    """Events out of order by up to 300 ms, with watermarks that follow."""
    r = np.random.default_rng(seed)
    start = 0
    for _ in range(n):
        start += int(r.integers(0, 400))
        yield (start + r.integers(-300, 300, int(r.integers(1, 30)))).clip(0).tolist(), max(0, start - 300)
        if r.random() < 0.2:
            start += 3000


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("window", [1, 50, 640])
def test_sliding_state_against_plain(seed, window):
    handle, seen, answers = Handle(keyed.SlidingCount("key", "ts", window, 5)), [], {}
    for times, mark in batches(seed):
        seen += [t for t in times if t >= handle.mark]
        for r in handle.batch(times).itertuples():
            answers[r.ms] = (r.n_events, r.n_window, r.allowed)
        for t in set(seen):
            n = sum(t - window < s <= t for s in seen)
            assert answers[t] == (seen.count(t), n, n <= 5)
        handle.advance(mark)
    handle.advance(10**9)
    assert not handle.maps["ticks"].d and not handle.maps["index"].exists() and not handle.timers


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("ttl", [1, 70, 640])
def test_gate_state_against_plain(seed, ttl):
    handle, seen, answers = Handle(keyed.TtlGate("key", "ts", ttl)), [], {}
    for times, mark in batches(seed):
        seen += [t for t in times if t >= handle.mark]
        for r in handle.batch(times).itertuples():
            answers[r.t] = (r.n_events, r.state)
        last = None
        for t in sorted(set(seen)):
            fresh = last is None or t >= last + ttl
            last = t if fresh else last
            assert answers[t] == (seen.count(t), "fresh" if fresh else "hit")
        handle.advance(mark)
    handle.advance(10**9)
    assert not handle.maps["ticks"].d and not handle.maps["index"].exists() and not handle.timers


@pytest.mark.parametrize("processor", [keyed.SlidingCount("key", "ts", 600_000, 5), keyed.TtlGate("key", "ts", 600_000)])
def test_hot_key_costs_its_new_ticks(processor):
    handle = Handle(processor)
    for k in range(10):
        handle.batch(range(100_000 * k, 100_000 * (k + 1)))
    ticks = handle.maps["ticks"]
    assert sum(len(v[0]) for v in ticks.d.values()) == 1_000_000
    before = ticks.reads
    out = handle.batch(range(1_000_000, 1_000_010))
    assert len(out) == 10 and ticks.reads - before <= 4
    if "n_window" in out:
        assert out.n_window.tolist() == [600_000] * 10


def test_status_expires_by_its_timer():
    handle = Handle(keyed.JobStatus("key", "ts", "tie", 600_000))
    row = lambda times, *status: handle.batch(times, tie=range(len(times)), stage=["s"] * len(times), status=list(status))
    assert row([1000, 2000], "run", "done").status.tolist() == ["done"]
    assert row([1500], "late but on time").empty
    assert not handle.advance(601_999)
    assert row([602_000], "again").status.tolist() == ["again"] and handle.timers == {1_202_000}
    assert not handle.advance(602_001)  # the first timer was taken back
    over = handle.advance(1_202_000)
    assert [(x.status.iat[0], bool(x.alive.iat[0])) for x in over] == [("again", False)] and not handle.maps["now"].exists()


def test_status_stream_expires(spark, tmp_path):
    source = _source(spark, tmp_path, [[100], [150], [3000], [3001]]).withColumnsRenamed({"key": "scene_id", "ts": "created_at"})
    source = source.withColumns({"job_id": F.unix_millis("created_at"), "stage": F.lit("fit"), "status": F.lit("done")})
    source = source.withColumn("scene_id", F.when(F.unix_millis("created_at") < 1_000_000, "old").otherwise("new"))
    out = streams.run_available(streams.job_status_stream(source), str(tmp_path / "o"), str(tmp_path / "c"))
    rows = sorted((r.scene_id, r.created_at.timestamp() % 100_000, r.alive) for r in out.collect())
    assert {(s, a) for s, _, a in rows} == {("old", True), ("old", False), ("new", True)}
    got = {r.scene_id: r.alive for r in streams.present(out).collect()}
    assert got == {"old": False, "new": True}


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("page", [1, 3, 20])
def test_pages_of_any_size_give_the_same_answers(seed, page, monkeypatch):
    monkeypatch.setattr(keyed, "PAGE", page)
    for span in (50, 640):
        test_sliding_state_against_plain(seed, span)
        test_gate_state_against_plain(seed, span)


@pytest.mark.parametrize("processor", [keyed.SlidingCount("key", "ts", 600_000, 5), keyed.TtlGate("key", "ts", 600_000)])
def test_few_ticks_cost_one_entry(processor):
    handle = Handle(processor)
    # one entry for each bucket of time, however few ticks it held
    assert len(handle.batch(range(0, 100 * 900_000, 900_000))) == 100 and len(handle.maps["ticks"].d) == 1
    handle.batch(range(100 * 900_000, 1000 * 900_000, 900_000))
    assert len(handle.maps["ticks"].d) == 2 and all(len(v[0]) <= keyed.PAGE for v in handle.maps["ticks"].d.values())
