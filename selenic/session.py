"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# folders made in local mode, by application
_local_base: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "selenic", **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    ``master`` is left to spark-submit on a cluster; tests pass ``local[n]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workdir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` for a table written by a job.

    Executors must all see it, so a machine-local folder is only taken in local
    mode and only when the cluster names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_base.get(spark.sparkContext.applicationId)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="selenic-")
        _local_base[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str):
    """Cut the lineage with a parquet table in the shared folder."""
    spark = df.sparkSession
    path = workdir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
