"""Distributed connected components: local contraction, then large-star and small-star steps.

First the edges of each task, about ``PART`` of them, are contracted to stars, which leaves an
edge for each node at most. If more than one task is needed, alternating large-star and
small-star steps join the tasks' stars: each step is a minimum per node (a partial aggregate)
and an equi-join on the node, so a hub of any size is never gathered, and AQE splits its
rows in the join. Edges never get more, and the rounds grow with the logarithm of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selenic.llm.common import local_roots, settle

PART = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = local_roots(len(node), at[:len(u)], at[len(u):])
    away = root != np.arange(len(node))
    yield pa.RecordBatch.from_arrays([pa.array(node[away]), pa.array(node[root[away]])], ["u", "v"])


def _mark(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _stars(e: DataFrame) -> DataFrame:
    """A large-star step and a small-star step."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
    return small.select("x.u", "x.v").where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", part: int = PART) -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node reachable."""
    e = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v"))
    tasks = -(-e.count() // part)
    if tasks:
        e = settle(e.coalesce(tasks).mapInArrow(_contract, "u long, v long"))
    if tasks > 1:
        seen = None
        while (now := _mark(e)) != seen:
            e, seen = settle(_stars(e)), now
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
