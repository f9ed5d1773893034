"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors of a label become one class first. Each class gets ``BITS`` signs in each of
``TABLES`` tables; classes with equal signs meet in a bucket, where cosines are computed
in double precision. A pair of angle a meets with probability 1 - (1 - (1 - a/pi)^BITS)^TABLES:
0.97 at the threshold, more above it. A pair counts in the first table in which it meets,
so links need no distinct pass.

A bucket of over ``BLOCK`` classes is cut into blocks and each pair of blocks is a group of its
own, so no group grows with the data and no pair is lost. A group returns one count a class
and one edge a class at most (to the smallest class of its local component), never its
pairs. Labels, codes and block pairs are shuffled; buckets of one class are dropped before.

Vectors that are null, empty, zero or hold null or non-finite components, or whose label
is null, link with nothing; vectors of different length never meet. Repeated rows count as
vectors of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenic.llm.common import grouped, local_roots, settle
from selenic.llm.graph import components

BITS = 12
TABLES = 14
BLOCK = 512
SEED = 20_240_601
SIGNED = T.StructType([T.StructField("rep", T.LongType()), T.StructField("label", T.LongType()), T.StructField("m", T.LongType()),
                       T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("vec", T.BinaryType())])


def planes(dim: int, bits: int = BITS, tables: int = TABLES) -> np.ndarray:
    """Normals of the hyperplanes, the same on every worker."""
    return np.random.default_rng((SEED, dim)).standard_normal((dim, tables * bits))


def sign_codes(x: np.ndarray, bits: int = BITS, tables: int = TABLES) -> np.ndarray:
    """One whole number of ``bits`` bits per row and table."""
    signs = (x @ planes(x.shape[1], bits, tables) >= 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vectors = b.column("v").to_pylist()
        codes: list = [None] * len(vectors)
        raw = [np.array(v, dtype="<f8") for v in vectors]
        for dim in {len(v) for v in raw}:
            at = [i for i, v in enumerate(raw) if len(v) == dim]
            x = np.stack([raw[i] for i in at])
            for i, c in zip(at, sign_codes(x / np.abs(x).max(axis=1, keepdims=True)), strict=True):
                codes[i] = c
        yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("label"), b.column("m"), pa.array(codes, pa.list_(pa.int32())),
                                          pa.array([v.tobytes() for v in raw], pa.binary())], ["rep", "label", "m", "codes", "vec"])


def bucket_links(rep: np.ndarray, m: np.ndarray, codes: np.ndarray, x: np.ndarray, block: np.ndarray, table: int,
                 first: int, second: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each class that this group finds first, root class of each class) in one group of two blocks."""
    if first == second:
        i, j = np.nonzero(np.triu(x @ x.T >= threshold - 1e-9, 1))
    else:
        p, q = np.flatnonzero(block == first), np.flatnonzero(block == second)
        i, j = np.nonzero(x[p] @ x[q].T >= threshold - 1e-9)
        i, j = p[i], q[j]
    keep = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
    i, j = i[keep], j[keep]
    keep = ~(codes[i, :table] == codes[j, :table]).any(axis=1) if table else np.ones(len(i), dtype=bool)
    i, j = i[keep], j[keep]
    links = np.bincount(i, weights=m[j], minlength=len(rep)) + np.bincount(j, weights=m[i], minlength=len(rep))
    return links.astype(np.int64), local_roots(len(rep), i, j)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.col(label_col).cast("long").alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("k1", F.when(valid, F.xxhash64("label", "v"))).withColumn("k2", F.when(valid, F.xxhash64(F.lit("second"), "v", "label")))
    classes = rows.where(valid).groupBy("label", "k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    signed = settle(classes.select("rep", "label", "m", "v").mapInArrow(_sign, SIGNED))

    met = signed.select("*", F.posexplode("codes").alias("table", "code"))
    key = ["label", "table", "code"]
    size = met.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = met.join(size, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.select("*", other.alias("_o")).withColumn("first", F.least("block", "_o")).withColumn("second", F.greatest("block", "_o"))
    group = [*key, "first", "second"]
    met = met.select(*group, "rep", "m", "codes", "vec", "block").repartition(*group).sortWithinPartitions(*group)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in grouped(batches, group):
            vec = g.column("vec").to_pylist()
            dims = np.array([len(v) for v in vec])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if len(at) < 2:
                    continue
                x = np.frombuffer(b"".join(vec[i] for i in at), "<f8").reshape(len(at), -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                take = lambda c: np.array(g.column(c).to_pylist())[at]  # noqa: E731, B023
                rep = take("rep")
                ends = [g.column(c)[0].as_py() for c in ("table", "first", "second")]
                links, root = bucket_links(rep, take("m"), take("codes"), x, take("block"), *ends, threshold)
                out += [(int(rep[i]), int(rep[root[i]]), int(links[i])) for i in np.flatnonzero((links > 0) | (root != np.arange(len(rep))))]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "n"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "n"])

    found = settle(met.mapInArrow(link, "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(found.where("a <> b")).withColumnRenamed("node", "rep")
    kinds = classes.select("k1", "k2", "rep", "m").join(counts, "rep", "left").join(comp, "rep", "left")
    kinds = kinds.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "k1", "k2").join(kinds, ["k1", "k2"], "left")
    cid = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), cid.alias("component_id"),
                      (F.col("id") == cid).alias("kept"))
