"""Toxicity, hard negatives and the Merkle manifest against plain versions."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from selenic.llm import merkle, negatives, toxicity
from tests.llm.conftest import A, B, prose

VECTORS = "vec_id long, embedding array<float>, label int, score string, n int, cluster long"


def plain_negatives(rows):
    """(anchor, positive, rank, negative, scores) by sorting all rows for each anchor."""
    seen = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        seen[i, y, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)] = 1
    out = set()
    for i, y, v in [k for k in seen if k[0] % 100 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in seen if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            fit = [(t, k) for t, k, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out |= {(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit)}
    return out


def vector_rows():
    r = np.random.default_rng(3)
    near = r.standard_normal((6, 8))
    rows = [(i, (near[i % 6] + 0.15 * r.standard_normal(8)).tolist(), int(r.integers(0, 3))) for i in range(900)]
    rows += [(1000 + i, [0.5, 0.25] + [0.0] * 6, i % 2) for i in range(120)]  # equal vectors, with two anchors
    rows += [(2000 + 10 * i, r.standard_normal(3).tolist(), 1 + i % 2) for i in range(40)]  # another length
    rows += [(3000, [0.0] * 8, 1), (3001, [0.0] * 8, 1), (3002, None, 1), (3100, [1.0] * 8, None), (3200, [1.0, float("nan")] * 4, 1), (3300, [1.0, None] * 4, 1),
             (3400, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (3500, [], 2), (3501, [], 2), (3502, [], 1), rows[100], rows[100], rows[7], (8, [1.0] * 8, 2)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_negatives(spark, monkeypatch, small):
    if small:  # several clusters, parts and blocks
        for name, value in (("ANCHORS_A_CLUSTER", 3), ("MEMBERS", 2), ("BLOCK", 40)):
            monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame([(*x, "x", 1, 2) for x in vector_rows()], VECTORS)
    got = [tuple(r) for r in negatives.mine(df, label=negatives.relabelled()).collect()]
    want = plain_negatives(vector_rows())
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.mine(empty, label=negatives.relabelled()).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1, "x", 1, 2)], VECTORS)
    assert negatives.mine(alone, label=negatives.relabelled()).count() == 0


def test_walk_ends_early():
    """A member leaves the shared list once the bound is below what it needs."""
    v = np.array([[100.0 - i, 0.0] for i in range(100)])
    rows = pd.DataFrame({"id": range(100), "label": 1})
    members = pd.DataFrame({"id": [1000], "label": [1], "need": [0.0]})
    seen = []
    real = negatives.Best.add
    try:
        negatives.Best.add = lambda self, at, score, ident: (seen.append(len(ident)), real(self, at, score, ident))[1]
        best = negatives.walk_positives(members, np.array([[1.0, 0.0]]), rows, v, v[:, 0], 5, step=10)
    finally:
        negatives.Best.add = real
    assert best.id[0].tolist() == [0, 1, 2, 3, 4] and sum(seen) == 10


def test_bounds_hold():
    r = np.random.default_rng(1)
    u, v = r.standard_normal((50, 6)), r.standard_normal((400, 6)) * r.random((400, 1)) * 9
    c = negatives.centroids(u, 4)
    nu, nv = np.linalg.norm(u, axis=1), np.linalg.norm(v, axis=1)
    a = negatives.angles(u, nu, c)
    own = a.argmin(axis=1)
    wide = np.array([a[own == k, k].max(initial=0) for k in range(len(c))])
    b = negatives.bounds(nv[:, None], negatives.angles(v, nv, c), wide)
    assert (nu[:, None] * b[:, own].T >= u @ v.T).all()


def plain_manifest(rows):
    """{(id, leaf): sorted (subroot, root, siblings, folded)} of rows (doc_id, source, lang, n_chars, text)."""
    def h(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def tree(nodes):
        paths, at, low = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(low) > 1:
            for i, k in enumerate(at):
                run = low[k // 3 * 3:k // 3 * 3 + 3]
                paths[i].append((run[:k % 3], run[k % 3 + 1:]))
            at, low = [k // 3 for k in at], [h(low[i:i + 3]) for i in range(0, len(low), 3)]
        return low[0], paths

    groups, out = {}, []
    for r in rows:
        leaf = h([field(x) for x in r])
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        seen = h([field(x) for x in (*r[:4], r[4].replace("\n", "") if r[4] is not None and even else r[4])])
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf, seen))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in names}
    root, high = tree([trees[s][0] for s in names])
    for s, up in zip(names, high, strict=True):
        for (has, i, leaf, seen), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            folded = seen
            for left, right in path + up:
                folded = h([*left, folded, *right])
            out.append((i if has else None, leaf, trees[s][0], root, h([x for a, b in path + up for x in a + b]), folded, folded == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, h string, tree int, idx string, n int"


def manifest_rows():
    rows = [(i, f"s{i % 3}" if i % 7 else "hot", "en", 5, f"line {i}\nnext\n") for i in range(1, 160)]
    rows += [(i, f"only{i}", "en", 5, "x\ny") for i in range(300, 312)] + [(5, None, None, None, None), (6, None, "en", 1, "null\n"), (None, "s1", "en", 1, "no\nid"),
             (9, "s0", "en", 5, "line 9\nnext\n"), (9, "s0", "en", 5, "other"), (400, "", "", 0, ""), (401, "é", "日本", -3, "ü\n" * 3000)]
    return rows + [rows[3]] * 40


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height):
    docs = spark.createDataFrame([(*r, "h", 1, "i", 2) for r in manifest_rows()], DOCS).repartition(5)
    made = merkle.manifest(docs, merkle.tampered(), height=height)
    got = sorted((tuple(r) for r in merkle.digests(made).collect()), key=str)
    assert got == plain_manifest(manifest_rows())
    assert {r[-1] for r in got} == {True, False}
    assert made.where(merkle.fold(F.col("presented"), F.col("proof")) != F.col("folded")).count() == 0


def test_manifest_of_little(spark):
    docs = spark.createDataFrame([(*r, "h", 1, "i", 2) for r in manifest_rows()], DOCS)
    assert merkle.digests(merkle.manifest(docs.where("false"), merkle.tampered())).count() == 0
    one = merkle.manifest(docs.where("doc_id = 400")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded"] and one["proof"] == ""


def test_manifest_oracle(spark):
    rows = [r for r in dict.fromkeys(manifest_rows()) if r[0] is not None and r[4] != "other"]
    docs = pd.DataFrame(rows, columns=["doc_id", "source", "lang", "n_chars", "text"]).astype({"n_chars": "Int64"})
    con = duckdb.connect()
    con.register("documents", docs)
    got = sorted(map(str, con.execute(merkle.ORACLE).fetchall()))
    assert got == sorted(map(str, plain_manifest(rows)))


BAD = ["zorgal", "mikthu", "praxo"]


def toxic_rows(n=400):
    rows = []
    for i in range(n):
        words = prose(i, 30 + i % 90, A if i % 2 else B).split()
        if i % 5 == 0:
            words.insert(i % len(words), BAD[i % 3].upper() if i % 2 else BAD[i % 3] + "!")
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, y string, id int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_learns(spark):
    rows = toxic_rows()
    got = {r.doc_id: r for r in toxicity.judge(*tables(spark, rows)).collect()}
    assert len(got) == len(rows)
    right = [got[i].predicted == y for i, _, y in rows if got[i].held_out]
    assert len(right) > 50 and np.mean(right) >= 0.97
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3)


def test_held_out_labels_teach_nothing(spark):
    rows = toxic_rows(200)
    docs, labels = tables(spark, rows)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.judge(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_toxicity_edges(spark, edge_docs, no_docs):
    rows = toxic_rows(200)
    docs, labels = tables(spark, rows)
    odd = labels.union(spark.createDataFrame([(5, 1, None), (7, 0, 9), (None, 1, 1), (10, 1, 0), (99_999, 1, 1)], labels.schema))
    model = toxicity.train(toxicity.labelled(docs, odd))
    got = toxicity.predict(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text, r.score) == r.score
    assert by_text[None] == by_text[""] == by_text["..."] == pytest.approx(1 / (1 + np.exp(-model.intercept)))
    assert toxicity.judge(no_docs.select("doc_id", "text"), labels).count() == 0
    for r in toxicity.judge(docs, labels.where("false")).collect():
        assert r.score == pytest.approx(1e-6) and r.predicted == 0


def plain_grams(text):
    t = "".join(c if c.isalnum() else " " for c in (" " + text.lower() + " "))
    t = " " + " ".join(t.split()) + " "
    return {t[i:i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)} if t.strip() else set()


def test_slots_are_those_of_whole_texts(monkeypatch):
    seen = toxicity.Seen()
    for text in ["", "...", "a", "A b", "Zwölf ÄPFEL, 12 x!", prose(1, 3000), "日本語 \U0001f600 ﬁ"]:
        whole = set(seen.of(text).tolist())
        cut = set(np.concatenate([toxicity.slots(w) for w in toxicity.windows(toxicity.codes(text), 50)]).tolist())
        assert whole == cut
        assert len(plain_grams(text)) * 0.99 <= len(whole) <= len(plain_grams(text))


def test_log_count_ratios_and_fit():
    has = np.array([[8, 1, 0, 2], [1, 9, 0, 2]])
    at, r = toxicity.log_count_ratios(has, np.array([10.0, 10.0]), alpha=1.0, min_texts=3)
    assert at.tolist() == [0, 1, 3]
    assert r == pytest.approx(np.log(np.array([2 / 9, 10 / 2, 3 / 3])))
    rows = [[0], [0], [1], [1], [0, 1], [2]]
    y = np.array([0, 0, 1, 1, 1, 0.0])
    starts = np.cumsum([0, *map(len, rows)])[:-1]
    w, c = toxicity.fit_logistic(starts, np.concatenate(rows), y, r, steps=3000)
    x = np.zeros((6, 3))
    for i, f in enumerate(rows):
        x[i, f] = r[f]
    v, d = np.zeros(3), 0.0
    for _ in range(60):  # Newton on the same loss
        p = 1 / (1 + np.exp(-(x @ v + d)))
        g = np.append(x.T @ (p - y) + v, (p - y).sum())
        z = np.hstack([x, np.ones((6, 1))])
        s = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([1, 1, 1, 0]), g)
        v, d = v - s[:3], d - s[3]
    assert w == pytest.approx(v * r, abs=1e-4) and c == pytest.approx(d, abs=1e-4)
