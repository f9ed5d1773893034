"""Keyed event state with timers: sliding counts, time-to-live gates and job status.

The processors run under ``transformWithStateInPandas`` on the RocksDB store, so state is read and written by
entry. The ticks of a key (events by millisecond) lie in buckets of event time. Neighbouring buckets share a
page, a map entry, of at most ``PAGE`` ticks; a fuller bucket is a page by itself. A batch touches the pages of
its own ticks and what their answers depend on: a key that has seen a million ticks costs its new ones and a
bounded number of page totals, a key with few ticks one entry. The first page has an event-time timer and is
dropped when the watermark has passed all that can still ask for it; so is a gate or a status once its time is over.

Rows behind the watermark change nothing. Out-of-order rows that are on time change later answers; those are
given again with a higher version (see ``streams.newest``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: buckets of a window or time to live
SPLIT = 64
#: ticks of a page of several buckets
PAGE = 512


def ticks_of(batches: Iterator[pd.DataFrame], ts: str, mark: int) -> dict[int, int]:
    """Events per millisecond in order, without late ones. Arrow batches are reduced one by one."""
    total: dict[int, int] = {}
    for b in batches:
        ms = b[ts].to_numpy().astype("datetime64[ms]").astype("int64")
        for k, v in zip(*(a.tolist() for a in np.unique(ms[ms >= mark], return_counts=True)), strict=True):
            total[k] = total.get(k, 0) + v
    return dict(sorted(total.items()))


class Buckets:
    """Ticks of one key by page; a map entry is (ticks' ms, their counts, a number that the owner keeps).

    A page is named after its first bucket and reaches to the next page; the first one also takes what comes
    before it. The index, one value, holds the pages' names, totals and last buckets, so a whole page counts
    without being opened.
    """

    def __init__(self, entries: Any, width: int, ids: list[int], sums: list[int], lasts: list[int]):
        self.entries, self.width, self.loaded = entries, width, {}
        self.ids = [int(b) for b in ids]
        self.sums = dict(zip(self.ids, map(int, sums), strict=True))
        self.lasts = dict(zip(self.ids, map(int, lasts), strict=True))

    def of(self, ms: int) -> int:
        return self.ids[max(0, bisect_right(self.ids, ms // self.width) - 1)] if self.ids else ms // self.width

    def end(self, b: int) -> int:
        return (self.lasts[b] + 1) * self.width

    def get(self, b: int) -> tuple[list[int], list[int], int | None]:
        if b not in self.loaded:
            v = self.entries.getValue((b,))
            self.loaded[b] = ([int(x) for x in v[0]], [int(x) for x in v[1]], None if v[2] is None else int(v[2]))
        return self.loaded[b]

    def put(self, b: int, ms: list[int], n: list[int], kept: int | None) -> None:
        self.loaded[b], self.sums[b], self.lasts[b] = (ms, n, kept), sum(n), ms[-1] // self.width
        self.entries.updateValue((b,), (ms, n, kept))

    def merged(self, ticks: dict[int, int], least: int | None = None) -> dict[int, tuple[list[int], list[int], int | None]]:
        """The pages of new ticks with them, without ticks before ``least``; a new page keeps nothing yet."""
        parts: dict[int, dict[int, int]] = {}
        if not self.ids:
            parts[next(iter(ticks)) // self.width] = ticks
        else:
            for ms, n in ticks.items():
                parts.setdefault(self.of(ms), {})[ms] = n
        out = {}
        for b, new in parts.items():
            ms, n, kept = self.get(b) if b in self.sums else ([], [], None)
            part = {k: v for k, v in zip(ms, n, strict=True) if least is None or k >= least}
            for k, v in new.items():
                part[k] = part.get(k, 0) + v
            low = min(part) // self.width
            if b in self.sums and low < b:
                self.drop(b)  # the first page has a new first bucket
                b = low
            for i, page in enumerate(self.pages(sorted(part))):
                # what no longer fits follows in pages of its own
                out[page[0] // self.width if i else b] = (page, [part[k] for k in page], None if i else kept)
        self.ids = sorted({*self.ids, *out})
        return out

    def pages(self, ms: list[int]) -> Iterator[list[int]]:
        """Runs of whole buckets of at most ``PAGE`` ticks, or one bucket of more."""
        start = edge = 0
        for i in range(1, len(ms)):
            if i - start >= PAGE and edge > start:
                yield ms[start:edge]
                start = edge
            if ms[i] // self.width != ms[i - 1] // self.width:
                if i - start >= PAGE:
                    yield ms[start:i]
                    start = i
                edge = i
        if len(ms) - start > PAGE and edge > start:
            yield ms[start:edge]
            start = edge
        yield ms[start:]

    def between(self, low: int, high: int) -> list[int]:
        return self.ids[bisect_left(self.ids, low):bisect_right(self.ids, high)]

    def drop(self, b: int) -> None:
        self.entries.removeKey((b,))
        del self.sums[b], self.lasts[b]
        self.ids.remove(b)

    def index(self) -> tuple[list[int], list[int], list[int]]:
        return self.ids, [self.sums[b] for b in self.ids], [self.lasts[b] for b in self.ids]


INDEX = "ids array<bigint>, sums array<bigint>, lasts array<bigint>, version bigint"
MAP = ("bucket bigint", "ms array<bigint>, n array<bigint>, kept bigint")


def frame(name: str, key: Any, columns: tuple[str, ...], rows: list[tuple], version: int) -> pd.DataFrame:
    """Answers of one key; ``version`` is the last column."""
    parts = zip(*rows, strict=True) if rows else [()] * (len(columns) - 1)
    return pd.DataFrame({name: [key] * len(rows), **dict(zip(columns, map(list, parts))), columns[-1]: version})


class SlidingCount(StatefulProcessor):
    """Events of a key in (t - window, t] for each of its milliseconds."""

    columns = ("ms", "n_events", "n_window", "allowed", "version")

    def __init__(self, key: str, ts: str, window_ms: int, limit: int):
        self.key, self.ts, self.window, self.limit = key, ts, window_ms, limit
        self.width = max(1, window_ms // SPLIT)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getValueState("index", INDEX)
        self.ticks = handle.getMapState("ticks", *MAP)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        ticks = ticks_of(rows, self.ts, mark)
        if not ticks:
            return
        *index, version = self.index.get() if self.index.exists() else ([], [], [], 0)
        held = Buckets(self.ticks, self.width, *index)
        due = self.due(held)
        for b, entry in held.merged(ticks, mark - self.window).items():
            held.put(b, *entry)
        if self.due(held) != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(self.due(held))
        self.index.update((*held.index(), int(version) + 1))
        out = []
        for run in self.changed(sorted(ticks)):
            out += self.answers(held, *run)
        yield frame(self.key, key[0], self.columns, out, int(version) + 1)

    def due(self, held: Buckets) -> int | None:
        """When the first page is dropped: rows on time may ask for it until the watermark is a window past its end."""
        return held.end(held.ids[0]) + self.window if held.ids else None

    def changed(self, new: list[int]) -> Iterator[tuple[int, int]]:
        """Runs [first, last] of time whose answers new ticks change."""
        first, last = new[0], new[0] + self.window - 1
        for ms in new[1:]:
            if ms > last:
                yield first, last
                first = ms
            last = ms + self.window - 1
        yield first, last

    def answers(self, held: Buckets, first: int, last: int) -> list[tuple[int, int, int, bool]]:
        ask = [(ms, n) for b in held.between(held.of(first), held.of(last)) for ms, n in zip(*held.get(b)[:2], strict=True) if first <= ms <= last]
        # what lies before: the ticks of the page that the window's edge cuts, totals of the whole ones between
        low = first - self.window + 1
        edge, own = held.of(low), held.of(first)
        live = [(ms, n) for b in held.between(edge, edge) for ms, n in zip(*held.get(b)[:2], strict=True) if low <= ms < first]
        total = sum(n for _, n in live) + sum(held.sums[b] for b in held.between(edge + 1, own - 1))
        if own > edge:
            total += sum(n for b in held.between(own, own) for ms, n in zip(*held.get(b)[:2], strict=True) if ms < first)
        # as the window moves on, the pages behind it are opened in turn, and not before
        rest = ((ms, n) for b in held.between(edge + 1, own) for ms, n in zip(*held.get(b)[:2], strict=True) if ms < first)
        queue = chain(live, rest, ask)
        out, rows = next(queue, None), []
        for at, n in ask:
            total += n
            while out and out[0] <= at - self.window:
                total -= out[1]
                out = next(queue, None)
            rows.append((at, n, total, total <= self.limit))
        return rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        *index, version = self.index.get()
        held, mark = Buckets(self.ticks, self.width, *index), timerValues.getCurrentWatermarkInMs()
        while held.ids and self.due(held) <= mark:
            held.drop(held.ids[0])
        if held.ids:
            self.index.update((*held.index(), int(version)))
            self.handle.registerTimer(self.due(held))
        else:
            self.index.clear()
        return iter([])

    def close(self) -> None:
        pass


class TtlGate(StatefulProcessor):
    """``fresh`` or ``hit`` per millisecond; a page keeps the last fresh time before it."""

    columns = ("t", "n_events", "state", "version")

    def __init__(self, key: str, ts: str, ttl_ms: int):
        self.key, self.ts, self.ttl = key, ts, ttl_ms
        self.width = max(1, ttl_ms // SPLIT)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.index = handle.getValueState("index", INDEX + ", fresh bigint")
        self.ticks = handle.getMapState("ticks", *MAP)

    def read(self) -> tuple[Buckets, int, int | None]:
        """Buckets, version, and the last fresh time that no row on time can change any more."""
        *index, version, fresh = self.index.get() if self.index.exists() else ([], [], [], 0, None)
        return Buckets(self.ticks, self.width, *index), int(version), None if fresh is None else int(fresh)

    def due(self, held: Buckets, settled: int | None) -> int | None:
        """When something can be forgotten: the first page settles, or the gate is open again."""
        return held.end(held.ids[0]) if held.ids else None if settled is None else settled + self.ttl

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ticks = ticks_of(rows, self.ts, timerValues.getCurrentWatermarkInMs())
        if not ticks:
            return
        held, version, settled = self.read()
        before, due = set(held.ids), self.due(held, settled)
        new = held.merged(ticks)
        out, enter = [], None
        follow = False  # whether the last fresh time before the page at hand is known to have changed
        for i, b in enumerate(held.ids):
            if b not in new and not follow:
                continue  # nothing before the first new tick changes
            ms, n, kept = new.get(b) or held.get(b)
            if not follow:
                enter = kept if b in before else settled if not i else self.run(*held.get(held.ids[i - 1])[::2])
            elif b not in new and kept == enter:
                follow = False  # the chain is as it was from here on
                continue
            held.put(b, ms, n, enter)
            start = min((t for t in ms if t in ticks), default=ms[-1] + 1) if not follow else ms[0]
            for t, k in zip(ms, n, strict=True):
                fresh = enter is None or t >= enter + self.ttl
                enter = t if fresh else enter
                if t >= start:
                    out.append((t, k, "fresh" if fresh else "hit"))
            follow = True
        if self.due(held, settled) != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(self.due(held, settled))
        self.index.update((*held.index(), version + 1, settled))
        yield frame(self.key, key[0], self.columns, out, version + 1)

    def run(self, ms: list[int], last: int | None) -> int | None:
        for t in ms:
            if last is None or t >= last + self.ttl:
                last = t
        return last

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, version, settled = self.read()
        mark = timerValues.getCurrentWatermarkInMs()
        while held.ids and held.end(held.ids[0]) <= mark:
            settled = self.run(*held.get(held.ids[0])[::2])
            held.drop(held.ids[0])
        if not held.ids and (settled is None or settled + self.ttl <= mark):
            self.index.clear()  # the gate is open again and no tick is waiting: nothing is left to know
        else:
            self.index.update((*held.index(), version, settled))
            self.handle.registerTimer(self.due(held, settled))
        return iter([])

    def close(self) -> None:
        pass


class JobStatus(StatefulProcessor):
    """The latest stage and status of a key, given when it changes; ``alive`` turns false when its time is over."""

    columns = ("stage", "status", "alive", "tie")

    def __init__(self, key: str, ts: str, tie: str, ttl_ms: int):
        self.key, self.ts, self.tie, self.ttl = key, ts, tie, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "ms bigint, tie string, stage string, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        old = self.now.get() if self.now.exists() else None
        best = old
        for b in rows:
            ms = b[self.ts].astype("datetime64[ms]").astype("int64")
            for t, tie, stage, status in zip(ms, b[self.tie], b["stage"], b["status"], strict=True):
                if t >= mark and (best is None or (int(t), padded(tie)) > (int(best[0]), best[1])):
                    best = (int(t), padded(tie), stage, status)
        if best is not None and best != old:
            if old is not None:
                self.handle.deleteTimer(int(old[0]) + self.ttl)
            self.now.update(best)
            self.handle.registerTimer(best[0] + self.ttl)
            yield self.row(key, best, True)

    def row(self, key, now, alive: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], now[2], now[3], alive, now[1], pd.Timestamp(int(now[0]), unit="ms"))], columns=[self.key, *self.columns, self.ts])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.now.exists() and int(self.now.get()[0]) + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
            yield self.row(key, self.now.get(), False)
            self.now.clear()

    def close(self) -> None:
        pass


def padded(tie: Any) -> str:
    """Whole numbers as text in their order, other values as they are."""
    return f"{int(tie) + (1 << 63):020d}" if isinstance(tie, (int,)) or hasattr(tie, "__index__") else str(tie)


def rocksdb(spark: SparkSession) -> None:
    """The store that the processors need, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def run(events: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    rocksdb(events.sparkSession)
    return events.groupBy(processor.key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")
