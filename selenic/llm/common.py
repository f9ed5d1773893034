"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of an Arrow batch; texts can be long, so batches stay small
BATCH_ROWS = 1000
#: bytes of a filter of keys, a power of two
FILTER = 1 << 24


def small_batches(spark: SparkSession) -> None:
    """Keep an Arrow batch of texts to some megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share.

    The folder is ``spark.checkpoint.dir``. Only a local session that names none gets a
    folder of its own. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark
    deletes the files when the frame is no longer used.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="selenic-llm-")
        sc.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of settled steps.

    It does so once their plans are collected; the events of a step that has just ended
    still hold its plan for a moment.
    """
    for _ in range(2):
        time.sleep(0.5)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a list of sizes into consecutive index ranges of at most ``limit`` in sum (one item at least)."""
    start, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words (the finaliser of splitmix64, a public constant set)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches sorted by the keys; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i, k in enumerate(rows):
            if k != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, k
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _marks(h: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte, bit) of three marks of each hash in a filter of ``size`` bytes, a power of two."""
    for k in range(3):
        at = mix64(h.astype(np.int64).view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        yield (at >> np.uint64(3) & np.uint64(size - 1)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)


def told_apart(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose ``key`` may be among those of ``keys``, the other rows), without a shuffle of ``df``.

    No row with such a key is among the others, and few without one among the first while a filter of about two bytes
    for a key, ``FILTER`` at most, holds them: what follows on the first must be exact. ``keys`` is read twice.
    """
    spark = df.sparkSession
    n = keys.count()
    size = min(FILTER, max(1 << 13, 1 << (2 * n - 1).bit_length())) if n else 1 << 13

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, dtype=np.uint8)
        for b in batches:
            for at, bit in _marks(b.column(0).to_numpy(zero_copy_only=False), size):
                np.bitwise_or.at(held, at, bit)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["held"])

    # a few tasks, so that few filters reach the driver
    marked = keys.select(F.xxhash64(key).alias("h")).coalesce(min(4, -(-n // 1_000_000) or 1)).mapInArrow(mark, "held binary")
    held = np.zeros(size, dtype=np.uint8)
    for r in marked.toLocalIterator():
        held |= np.frombuffer(r["held"], np.uint8)
    shared = spark.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        found = np.ones(len(h), dtype=bool)
        for at, bit in _marks(h.to_numpy(), size):
            found &= shared.value[at] & bit != 0
        return pd.Series(found)

    told = maybe(F.xxhash64(key))
    return df.where(told), df.where(~told)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            deeper = new[new]
            if (deeper == new).all():
                break
            new = deeper
        new = new[root]
        if (new == root).all():
            break
        root = new
    return root
