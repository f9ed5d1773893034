"""The log-structured catalog: what a step writes, what a repeated step changes, and its result."""

import os
import random

from pyspark.sql import functions as F

from selenic.operators.catalog import last_wins
from selenic.sources import labels
from selenic.sources.catalog_log import CatalogLog
from selenic.streaming import streams

ROWS = "product_id string, version long, size long"


def files(root):
    """{file: (size, time)} of all data files."""
    return {os.path.join(d, f): (os.path.getsize(os.path.join(d, f)), os.path.getmtime(os.path.join(d, f)))
            for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def batch(spark, seed, n=40):
    r = random.Random(seed)
    rows = [(f"p{r.randrange(60)}", r.randrange(1000), r.randrange(10**6)) for _ in range(n)]
    return spark.createDataFrame(list({(p, v): (p, v, s) for p, v, s in rows}.values()), ROWS)


def plain(frames):
    best = {}
    for i, f in enumerate(frames):
        for r in f.collect():
            if r.product_id not in best or (r.version, i) >= best[r.product_id][0]:
                best[r.product_id] = ((r.version, i), r["size"])
    return {k: (v[0][0], v[1]) for k, v in best.items()}


def table(df):
    return {r.product_id: (r.version, r["size"]) for r in df.collect()}


def test_batches_and_compactions(spark, tmp_path):
    log, frames = CatalogLog(spark, str(tmp_path), buckets=8), [batch(spark, s) for s in range(6)]
    assert log.read() is None
    for i, f in enumerate(frames):
        before = files(tmp_path / "base") | files(tmp_path / "delta")
        log.append(f, i)
        new = {k for k in files(tmp_path / "delta") if k not in before}
        assert all(f"batch={i}/" in k for k in new)  # its own rows and no more
        assert spark.read.parquet(str(tmp_path / f"delta/batch={i}")).count() == f.select("product_id").distinct().count()
        assert table(log.read()) == plain(frames[:i + 1])
        if i in (2, 4):
            log.compact(i)
            assert table(log.read()) == plain(frames[:i + 1])
        assert {k: v for k, v in files(tmp_path).items() if k in before} == before
    assert {r[0] for r in log.read(["p3", "p7", "none"]).select("product_id").collect()} <= {"p3", "p7"}
    assert table(log.read(["p3"])) == {k: v for k, v in plain(frames).items() if k == "p3"}


def test_a_step_twice_changes_nothing(spark, tmp_path):
    log, f = CatalogLog(spark, str(tmp_path), buckets=4), batch(spark, 1)
    log.append(f, 0)
    log.append(batch(spark, 2), 1)
    log.compact(1)
    before, rows = files(tmp_path), table(log.read())
    log.append(f, 0)
    assert log.compact(1) == []
    assert files(tmp_path) == before and table(log.read()) == rows


def test_a_lost_step_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    log, frames = CatalogLog(spark, str(tmp_path), buckets=4), [batch(spark, 1), batch(spark, 2)]
    log.append(frames[0], 0)
    monkeypatch.setattr(log, "_mark", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    for step in (lambda: log.append(frames[1], 1), lambda: log.compact(0)):
        try:
            step()
        except RuntimeError:
            pass
    monkeypatch.undo()
    assert table(log.read()) == plain(frames[:1])
    log.append(frames[1], 1)
    log.compact(1)
    assert table(log.read()) == plain(frames)


def test_upsert_touches_the_buckets_of_its_keys(spark, tmp_path):
    log = CatalogLog(spark, str(tmp_path), buckets=16)
    log.upsert(batch(spark, 1, 200))
    log.compact(0)
    one = spark.createDataFrame([("p5", 10**6, 1)], ROWS)
    assert log.upsert(one) == 1
    bucket = one.select(log.bucket()).first()[0]
    assert [m for m in log.marks() if m[:2] == ("delta", 1)] == [("delta", 1, [bucket])]
    assert log.compact(1) == [bucket]
    assert os.listdir(tmp_path / "base/upto=1").count(f"_bucket={bucket}") == 1
    assert sum(x.startswith("_bucket=") for x in os.listdir(tmp_path / "base/upto=1")) == 1
    assert table(log.read(["p5"])) == {"p5": (10**6, 1)}
    scanned = log.read(["p5"]).inputFiles()
    assert scanned and all(f"_bucket={bucket}/" in x for x in scanned)


def test_empty_batches_and_new_columns(spark, tmp_path):
    log = CatalogLog(spark, str(tmp_path), buckets=4)
    log.append(spark.createDataFrame([], ROWS), 0)
    assert log.read() is None and log.compact(0) == []
    log.append(batch(spark, 1), 1)
    log.append(spark.createDataFrame([("p1", 5000, 1, "x"), (None, 1, 2, "y")], ROWS + ", note string"), 2)
    got = {r.product_id: r.note for r in log.read().collect()}
    assert got["p1"] == "x" and got[None] == "y" and None in {v for k, v in got.items() if k != "p1"}


def test_stream_compacts_as_it_goes(spark, tmp_path):
    xml = "<axis_name>Line</axis_name> <elements>{}</elements>"
    rows = [(f"/l/p{i % 5}.xml", xml.format(i), i) for i in range(20)] + [("/l/bad.xml", "no label", 1)]
    for k, part in enumerate(spark.createDataFrame(rows, "path string, xml string, version long").randomSplit([1.0] * 5, 3)):
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema("path string, xml string, version long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = streams.incremental_catalog(source, labels.parse_labels, str(tmp_path / "cat"), str(tmp_path / "bad"), str(tmp_path / "c"), compact_every=2)
    q.trigger(availableNow=True).start().awaitTermination()
    got = streams.current_catalog(spark, str(tmp_path / "cat"))
    assert {r.product_id: r.lines for r in got.collect()} == {f"p{i}": 15 + i for i in range(5)}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    assert any(m[0] == "base" for m in CatalogLog(spark, str(tmp_path / "cat")).marks())
