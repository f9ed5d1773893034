"""Joins, near-duplicates, suffixes, URLs and shards against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from selenic.llm import common, jaccard, neardup, repeats, sharding, suffixes, urls
from selenic.llm.graph import components
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest(ids, links):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("part", [200_000, 20])
def test_components(spark, part):
    edges = [(1, 2), (2, 3), (9, 8), (3, 1), (5, 5), *[(100 + i, 101 + i) for i in range(40)], *[(200, 300 + i) for i in range(50)]]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), part=part).collect()}
    want = smallest({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [128, 2])
def test_jaccard(spark, edge_docs, no_docs, block):
    rows = []
    for i in range(30):  # chains of copies with more and more changes, at the threshold and around it
        w = prose(i, 40 + i).split()
        for k in range(4):
            rows.append((1000 + 10 * i + k, " ".join(w[:len(w) - 3 * k] + [f"e{i}{k}"] * k)))
    docs = edge_docs.select("doc_id", "text", "component", "n").union(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component string, n int"))
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    sets = {i: shingles(t) for i, t in text.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest(sets, links)
    got = jaccard.jaccard_components(docs, block=block).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.component_id is None) if r.doc_id is None else (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert jaccard.jaccard_components(no_docs).count() == 0


@pytest.mark.parametrize("most", [1 << 24, 8])
def test_told_apart(spark, monkeypatch, most):
    """No row with a key of the others is lost; only a full filter lets many others through."""
    monkeypatch.setattr(common, "FILTER", most)
    rows = spark.createDataFrame([(i % 4000 if i % 50 else None, f"t{i}") for i in range(9000)], "k long, t string")
    first, other = common.told_apart(rows, "k", spark.range(0, 4000, 10).select(F.col("id").alias("k")))
    a, b = ([r.t for r in x.collect()] for x in (first, other))
    assert sorted(a + b) == sorted(r.t for r in rows.collect()) and other.where("k % 10 = 0").count() == 0
    assert len(a) < 1200 or most == 8
    none, all_rows = common.told_apart(rows, "k", rows.where("false").select("k"))
    assert none.count() == 0 and all_rows.count() == 9000


def written(spark, df):
    """Bytes that the exchanges of a frame's plan wrote."""
    df.collect()
    found, queue = 0, [df._jdf.queryExecution().executedPlan()]
    while queue:
        p = queue.pop()
        kinds = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan"}
        if (name := p.getClass().getSimpleName()) in kinds:
            queue.append(getattr(p, kinds[name])())
            continue
        if name == "ShuffleExchangeExec":
            found += p.metrics().apply("shuffleBytesWritten").value()
        children = p.children()
        queue += [children.apply(i) for i in range(children.size())]
    return found


def test_texts_that_meet_no_other_are_not_shuffled(spark):
    rows = [(i, prose(3 * i, 900), "x") for i in range(300)]
    rows += [(1000 + i, rows[i][1] + f" more{i}", "x") for i in range(4)] + rows[:2] + [(None, "alone", "x"), (7, "other text of an id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert written(spark, kept) < sum(len(r[1]) for r in rows) / 8
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect()) == sorted((r[0] is None, r[0], r[1]) for r in [*rows[:300], *rows[-2:]])


def test_matrix_bound_keeps_every_link():
    """Two linked sets share ``level`` leading tokens in either order of the tokens."""
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(1, 60))
        a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
        b = a.copy()
        b[:int(len(a) * r.random() * 0.2)] = r.integers(0, 1 << 62, dtype=np.uint64)
        b = np.unique(b)
        if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        for frequent in (np.zeros(0, dtype=np.uint64), np.sort(r.choice(a, len(a) // 2, replace=False))):
            common = np.intersect1d(jaccard.leading_tokens(a, frequent), jaccard.leading_tokens(b, frequent))
            steps = jaccard.size_step(len(a)), jaccard.size_step(len(b))
            assert abs(steps[0] - steps[1]) <= jaccard.REACH and len(common) >= min(map(jaccard.step_level, steps))


@pytest.mark.parametrize("block", [512, 3])
def test_neardup(spark, block):
    r = np.random.default_rng(2)
    rows = []
    for c in range(12):
        center = r.normal(size=16)
        for k in range(9):
            rows.append((len(rows), (center + r.normal(size=16) * 0.05 * k).tolist(), c % 2))
    rows += [(len(rows) + k, rows[3][1], rows[3][2]) for k in range(4)]
    n = len(rows)
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(n + k, v, 0) for k, v in enumerate(bad)] + [(n + 20, rows[0][1], None), (n + 21, rows[0][1], 7)]
    df = spark.createDataFrame([(*x, "t", "v") for x in rows], "vec_id long, embedding array<double>, label int, k1 string, v string")
    good = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows[:n]}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and good[a][0] @ good[b][0] >= 0.93]
    got = {x.vec_id: x for x in neardup.near_duplicates(df, block=block).collect()}
    assert len(got) == len(rows)
    count = dict.fromkeys(got, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    total = sum(x.n_links for x in got.values())
    assert all(x.n_links <= count[i] for i, x in got.items()) and total >= 0.9 * sum(count.values())
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _, _ in rows[n:])
    if total == sum(count.values()):
        assert {i: x.component_id for i, x in got.items()} == smallest(got, links)
    assert neardup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("alphabet", [1, 2, 4, 250])
def test_suffix_array(alphabet):
    r = np.random.default_rng(alphabet)
    for n in (1, 2, 3, 7, 50, 400):
        t = r.integers(0, alphabet, n).astype(np.uint8)
        order, b = suffixes.suffix_array(t), t.tobytes()
        head = [b[i:i + suffixes.DEPTH] for i in order]
        assert sorted(order.tolist()) == list(range(n)) and head == sorted(head)


def plain_repeats(docs):
    """{(id, text): (bytes, removed, spans, sha)} by counting all 50-byte strings."""
    first: dict[bytes, int] = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k:k + 50]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i, t] = len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


def test_repeats(spark, edge_docs, no_docs):
    line = "this line of more than fifty bytes é stands in many documents ñ of all kinds"
    rows = [(500 + i, prose(i, 30) + "\n" + line + "\n" + prose(50 + i, i) + line[i:] + line[:60 - i]) for i in range(25)]
    rows += [(400, line * 4), (401, "z" * 300), (402, "z" * 120 + "y" + "z" * 49), (403, line[:50].encode()[:50].decode(errors="ignore"))]
    docs = edge_docs.select("doc_id", "text", "n").union(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int"))
    docs = docs.where("doc_id IS NULL OR doc_id NOT IN (12, 13)").union(spark.createDataFrame([(12, prose(1, 900), 1), (13, prose(1, 900) + " t", 1)], docs.schema))
    plain = plain_repeats([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    for r in repeats.remove_repeats(docs.where("doc_id IS NOT NULL")).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in {v for (i, _), v in plain.items() if i == r.doc_id}, r.doc_id
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == docs.count() and [r.n_removed for r in got if r.doc_id is None] == [0]
    assert repeats.remove_repeats(no_docs).count() == 0


def test_repeats_with_copies_in_descending_order(spark):
    """A copy with a larger id before the smallest one, in one batch: the smallest still gets its keys."""
    copy, other = prose(1, 30) + " " + prose(2, 40), prose(1, 30) + " " + prose(3, 40)
    rows = [(10, copy), (7, copy), (5, copy), (8, prose(2, 40) + " " + prose(4, 20)), (2, other)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
        assert got == {(i, *v) for (i, _), v in plain_repeats(order).items()}


URLS = [None, "", "no scheme", "http://A.Example.ORG/es/1", "https://x.example.org/en/12?q=1", "https://example.org", "http://a.com/fr/x", "http://b.com/de/porn",
        "http://c.net/porn", "http://c.net/porno", "http://c.net/casino-bet", "http://c.net/casino/casino", "http://notorg/x", "http://c.net?x=://d.org/", "HTTP://C.NET/XXX/",
        "https://m.ads-track.example.net/en/1", "http://d.net/sex\nads"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [got[i].rule for i in (3, 4, 5, 6, 7)] == ["example.org/es/", "example.org/en/1", None, "com/fr/", "com/de/"]
    assert [got[i].verdict for i in range(len(URLS))] == ["allow", "allow", "allow", "block", "block", "allow", "allow", "block", "block", "allow", "block", "allow",
                                                            "allow", "allow", "block", "block", "block"]
    assert (got[13].host, got[13].path, got[0].host, got[2].path) == ("c.net", "", "", "")
    assert urls.judge(df.where("false")).count() == 0


def plain_ring(keys, shards):
    """The same walk, one row after another."""
    h = {k: int(hashlib.md5(str("" if k[0] is None else k[0]).encode()).hexdigest()[:12], 16) for k in keys}
    width = 2 ** 48 // sharding.CELLS
    node = {}
    for s in range(shards):
        for v in range(sharding.NODES):
            x = int(hashlib.md5(f"node-{s}-{v}".encode()).hexdigest()[:12], 16)
            node.setdefault(x // width, []).append((x, s))
    owner, nxt = {}, None
    for c in [*range(sharding.CELLS), *range(sharding.CELLS)][::-1]:
        nxt = min(node[c])[1] if c in node else nxt
        owner[c] = nxt
    cells = {c: [] for c in owner}
    for k in sorted(keys, key=lambda k: (h[k], -1 if k[0] is None else k[0], k[1])):
        cells[h[k] // width].append(k)
    home = {s: sum(len(cells[c]) for c in cells if owner[c] == s) for s in range(shards)}
    order = sorted(home, key=lambda s: (-home[s], s))
    cap = {s: len(keys) // shards + (order.index(s) < len(keys) % shards) for s in home}
    out, size, excess = {}, dict.fromkeys(home, 0), {}
    for c in sorted(cells):
        s = owner[c]
        for k in cells[c]:
            if size[s] < cap[s]:
                out[k] = s
                size[s] += 1
            else:
                excess.setdefault(c, []).append(k)
    room, places = {}, {s: [c for c in sorted(cells) if owner[c] == s] for s in home}
    for s, own in places.items():
        free = cap[s] - size[s]
        room |= {c: free // len(own) + (i < free % len(own)) for i, c in enumerate(own)}
    queue = []
    for lap in (1, 2):
        for c in sorted(cells):
            queue += excess.get(c, []) if lap == 1 else []
            while queue and room[c]:
                out[queue.pop(0)] = owner[c]
                room[c] -= 1
    return out


def test_ring(spark, edge_docs, no_docs):
    docs = edge_docs.select("doc_id", "text", "n").union(spark.createDataFrame([(1000 + i, "t", 1) for i in range(317)], "doc_id long, text string, n int"))
    rows = sharding.shard_rows(docs, 7).collect()
    size = {}
    for r in rows:
        size.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == docs.count() and all(sorted(v) == list(range(len(v))) for v in size.values())
    assert len(size) == 7 and max(map(len, size.values())) - min(map(len, size.values())) <= 1
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 16, zlib.crc32(text[r.doc_id].encode())) for r in rows)
    keys = [(r.doc_id, r.size, i) for i, r in enumerate(rows)]
    want = plain_ring(keys, 7)
    assert sorted((str(k[0]), s) for k, s in want.items()) == sorted((str(r.doc_id), r.shard) for r in rows)
    assert sharding.shard_rows(no_docs).count() == 0


def test_ring_moves_little(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "'t' text")
    few, more = ({r.doc_id: r.shard for r in sharding.shard_rows(docs, n).collect()} for n in (10, 11))
    assert sum(few[i] != more[i] for i in few) < 0.45 * len(few)
