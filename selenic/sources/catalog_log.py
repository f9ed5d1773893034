"""A log-structured catalog: bucketed delta files by batch, resolved on read, compacted now and then.

Below the root lie

* ``delta/batch=N/_bucket=B``: the rows that batch N brought, one per key;
* ``base/upto=K/_bucket=B``: the resolved rows of a bucket after batch K, only for buckets that batches
  up to K had touched since their last compaction;
* ``marks/kind=.../id=N``: a row once the folder of that batch or compaction is whole, with its buckets.

A writer first writes the folder (overwriting what a lost attempt left there), then its mark; readers look at
marked folders only. A batch or compaction that is marked is not written again, so a step that runs twice
changes nothing, and a lost driver repeats its last step. A batch writes its own rows and no others; an upsert
touches the buckets of its keys.

Marks number one a batch and compaction, with a list of at most ``buckets`` numbers each; they are the only
thing that reaches the driver. The highest (version, tie, batch) of a key wins. One writer at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenic.operators.catalog import last_wins

c, lit = F.col, F.lit
MARK = "buckets array<int>, kind string, id long"


class CatalogLog:
    """One catalog; ``key`` names a row, ``version`` and ``tie`` say which row of a key is the newest."""

    def __init__(self, spark: SparkSession, root: str, key: str = "product_id", version: str = "version", tie: str | None = None, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.order = [version, *([tie] if tie else []), "_batch"]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(c(self.key).cast("string")), lit(self.buckets)).cast("int")

    def marks(self) -> list[tuple[str, int, list[int]]]:
        """(kind, id, buckets) of every whole batch and compaction."""
        try:
            rows = self.spark.read.schema(MARK).parquet(f"{self.root}/marks").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted((r["kind"], r["id"], list(r["buckets"])) for r in rows)

    def _mark(self, kind: str, number: int, buckets: list[int]) -> None:
        row = self.spark.createDataFrame([(buckets,)], "buckets array<int>").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.root}/marks/kind={kind}/id={number}")

    def _has(self, kind: str, number: int) -> bool:
        return any((k, n) == (kind, number) for k, n, _ in self.marks())

    # -------------------------------------------------------- writing

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write a batch; nothing happens if it is there already."""
        if self._has("delta", batch):
            return
        new = last_wins(rows.withColumn("_batch", lit(batch).cast("long")), [self.key], *self.order).withColumn("_bucket", self.bucket())
        path = f"{self.root}/delta/batch={batch}"
        new.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        self._mark("delta", batch, self._written(path))

    def upsert(self, rows: DataFrame) -> int:
        """Append as the next batch; its number."""
        batch = max((n for k, n, _ in self.marks() if k == "delta"), default=-1) + 1
        self.append(rows, batch)
        return batch

    def _written(self, path: str) -> list[int]:
        """Buckets of a folder, told by its folders' names."""
        try:
            rows = self.spark.read.parquet(path)
        except AnalysisException as e:  # a batch without rows
            if e.getCondition() in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                return []
            raise
        return [] if "_bucket" not in rows.columns else sorted(r[0] for r in rows.select("_bucket").distinct().collect())

    def compact(self, upto: int) -> list[int]:
        """Resolve the buckets that batches up to ``upto`` touched since their last compaction; these buckets."""
        if self._has("base", upto):
            return []
        marks = [m for m in self.marks() if m[1] <= upto]
        base = self._bases(marks)
        due = sorted({b for k, n, bs in marks if k == "delta" for b in bs if n > base.get(b, -1)})
        if due:
            rows = self._resolved(marks, due)
            path = f"{self.root}/base/upto={upto}"
            rows.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
            self._mark("base", upto, due)
        return due

    # -------------------------------------------------------- reading

    @staticmethod
    def _bases(marks: list[tuple[str, int, list[int]]]) -> dict[int, int]:
        """The last compaction of each bucket."""
        out: dict[int, int] = {}
        for kind, n, buckets in marks:
            if kind == "base":
                out |= {b: max(n, out.get(b, -1)) for b in buckets}
        return out

    def _resolved(self, marks: list[tuple[str, int, list[int]]], buckets: list[int] | None = None) -> DataFrame | None:
        """The newest row of each key with ``_batch`` and ``_bucket``, from the folders that are needed for these buckets."""
        base, parts = self._bases(marks), []
        wanted = lambda bs: [b for b in bs if buckets is None or b in buckets]
        for kind, n, found in marks:
            live = [b for b in wanted(found) if (base.get(b) == n if kind == "base" else n > base.get(b, -1))]
            if live:
                folder = f"{self.root}/{'base/upto' if kind == 'base' else 'delta/batch'}={n}"
                parts.append(self.spark.read.option("basePath", folder).parquet(*[f"{folder}/_bucket={b}" for b in live]))
        if not parts:
            return None
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return last_wins(rows, [self.key], *self.order)

    def read(self, keys: list | None = None) -> DataFrame | None:
        """The catalog, or its rows of the given keys, for which only their buckets are opened; None before the first batch with rows."""
        buckets = None
        if keys is not None:
            text = self.spark.createDataFrame([(str(k),) for k in keys], T.StructType([T.StructField(self.key, T.StringType())]))
            buckets = [r[0] for r in text.select(self.bucket()).distinct().collect()]
        rows = self._resolved(self.marks(), buckets)
        if rows is None:
            return None
        rows = rows.drop("_batch", "_bucket")
        return rows if keys is None else rows.where(c(self.key).cast("string").isin([str(k) for k in keys]))
