"""Language, packing, leaks, token counts and personal data against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from selenic.llm import decontam, langid, packing, pii, tokens
from tests.llm.conftest import A, B, edge_texts, prose

SP, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def test_token_counts(spark, edge_docs, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(edge_docs, SP).collect()}
    want = {(r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in edge_docs.collect()}
    assert got == want
    assert tokens.count_tokens(no_docs, SP).count() == 0


def test_whole_tokens_are_proven():
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    tokens.check_splits(sp)
    whole = tokens.whole_tokens(sp)
    assert len(whole) > 10_000 and all(len(sp.encode(k[1:])) == 1 for k in list(whole)[:500] if k[0] == " ")


def test_token_windows(monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", 100)
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    c = tokens.Counter(open(SP, "rb").read(), tokens.whole_tokens(sp))
    for t in edge_texts():
        assert c.count(t) == len(sp.encode(t or ""))


def test_packing(spark, edge_docs, no_docs):
    tok = Tokenizer.from_file(BPE)
    cut = packing.pieces(edge_docs, BPE)
    got = packing.harmonic_pack(cut, workers=2).toPandas()
    for r in edge_docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        own = got[got.doc_id.isna() if r.doc_id is None else got.doc_id == r.doc_id].drop_duplicates("start").sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
    assert packing.harmonic_pack(packing.pieces(no_docs, BPE)).count() == 0


def test_packing_fills_bins(spark):
    rows = [(i, 0, n, 0, n) for i, n in enumerate([n for k in range(4000) for n in packing.cuts(1 + (k * 7919) % 6000)])]
    got = packing.harmonic_pack(spark.createDataFrame(rows, packing.PIECE), workers=4).toPandas()
    assert len(got) == len(rows)
    assert got.length.sum() > 0.97 * 4096 * got.sequence_id.nunique()


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000, 2048, 3000, 4095, 4096, 4097, 99_999])
def test_cuts(n):
    parts = packing.cuts(n)
    assert sum(parts) == n and all(4096 // p * p > 4096 * 30 // 32 or p == parts[-1] for p in parts)


def test_language_held_out(spark):
    rows = [(i, prose(i, 5 + i % 40, (A, B)[i % 2]), ("aa", "bb")[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out for i in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_scores_match_plain_counts(monkeypatch):
    texts = [prose(9, 50), "Ab c", "1 2"]
    r = np.random.default_rng(0)
    matrix = np.vstack([r.normal(size=(langid.FEATURES, 2)), np.zeros((1, 2))]).astype(np.float32)
    whole = langid.score_texts(texts, matrix, np.zeros(2))
    alone = [langid.score_texts([t], matrix, np.zeros(2)) for t in texts]
    assert whole[0].tolist() == [a[0][0] for a in alone] and whole[0][2] == -1
    total = np.zeros(2)
    for _, _, f in langid.grams([texts[1]]):
        for x in f:
            total += matrix[x]
    want = np.exp(total - total.max())
    assert whole[1][1] == pytest.approx(1 / want.sum(), rel=1e-5)


def test_language_edges(spark, edge_docs, no_docs):
    got = {r.doc_id: r for r in langid.identify(edge_docs).collect()}
    letters = {i: any(c.isalpha() for c in t or "") for i, t in enumerate(edge_texts())}
    assert all((got[i].lang_pred == "und") != has for i, has in letters.items())
    assert langid.identify(edge_docs).count() == edge_docs.count() and langid.identify(no_docs).count() == 0
    unlabelled = langid.identify(edge_docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def plain_pii(t: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


HARD = ["a@b@c.com", "x@y..z a@b.c.", "@a.b", "a@@b.c", "1.2.3.4.5.6.7.8", "1.2.3.999 01.002.3.4", "4041 8949-7460 8795", "+1 (988) 555-2485 +1", "+12",
        "é a.b@c.de\n ñ 4444333322221111 é", "0000.1.1.1", "1" * 4000 + ".1.1.1", "a@b.c@d.e", "+1+1234567890", "ab-@x-.y--"]


def test_base_spans():
    for t in HARD:
        assert sorted((a, k, b) for k, a, b in pii.base_spans(t)) == plain_pii(t), t


def test_pii_query(spark, edge_docs, no_docs):
    secrets = [f"mail a{i}@b.org password=ab12cd34ef56ab78{i:02d} and order 123456789 room12345 token = \"0123456789abcdef{i:02d}cd\"" for i in range(30)]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(HARD + secrets)], "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.digest(pii.find(docs)).collect():
        want = plain_pii(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        if r.doc_id is not None and r.doc_id >= 100 + len(HARD):
            found = [text[r.doc_id][int(a):int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",")) if k == "secret"]
            assert len(found) == 2 and all(f[0] in "a0" for f in found)
    assert pii.digest(pii.find(no_docs)).count() == 0


def test_em_finds_the_bad_labeler():
    r = np.random.default_rng(3)
    truth = r.random(4000) < 0.3
    good = [np.where(r.random(4000) < 0.9, truth, ~truth) * 2 - 1 for _ in range(3)]
    votes = np.stack([*good, r.integers(0, 2, 4000) * 2 - 1], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    post = pii.expectation_maximisation(patterns, n)
    of = {tuple(p): v for p, v in zip(patterns.tolist(), post, strict=True)}
    assert np.mean([(of[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth, strict=True)]) > 0.95


def test_redact():
    assert pii.redact_text("a b c d", [(0, 0, 3), (2, 1, 5)]) == "[EMAIL] d"


def plain_lcs(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_common_subsequence():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = r.integers(0, 6, r.integers(1, 80)).tolist(), r.integers(0, 6, r.integers(0, 90)).tolist()
        assert decontam.common_length(len(a), decontam.places(a), b) == plain_lcs(a, b) <= decontam.shared_words(*np.unique(np.array(a), return_counts=True), np.array(b))


def test_leaks(spark, edge_docs, no_docs):
    words = [f"w{i}" for i in range(500)]
    items = [(i, prose(1000 + i, 20 + i, words) + ". " + prose(2000 + i, 6, words) + ".") for i in range(20)]
    changed = items[5][1].split()
    changed[3::6] = ["other"] * len(changed[3::6])
    docs = [(100 + i, prose(i, 150, words)) for i in range(40)]
    docs += [(200, prose(90, 70, words) + " " + items[2][1] + " " + prose(91, 33, words)), (201, items[3][1]), (202, prose(92, 70, words) + " " + " ".join(changed)),
             (203, prose(93, 40, words) + " " + " ".join(items[7][1].split()[:7]) + " " + prose(94, 40, words)), (204, items[2][1].upper() + items[3][1])]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (None, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(200, 2), (201, 3), (202, 5), (204, 2), (204, 3)}
    assert decontam.leaks(no_docs, bench).count() == 0 and decontam.leaks(docs, bench.where("false")).count() == 0


@pytest.mark.parametrize("most", [512, 25])
def test_leaks_beyond_the_rank(spark, monkeypatch, most):
    """Many items of words of their own: every copy is found, as by the cosine of the whole vectors, at a rank far below their number."""
    monkeypatch.setattr(decontam, "PASSAGES", most)
    items = [(i, " ".join(f"x{i}y{k}" for k in range(24)) + ". " + " ".join(f"x{i}z{k}" for k in range(4)) + ".") for i in range(60)]
    docs = [(100 + i, prose(i, 40) + " " + t + " " + prose(500 + i, 40)) for i, t in items] + [(i, prose(900 + i, 90)) for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), rank=8).collect()}
    assert got == {(100 + i, i) for i, _ in items}


def test_no_pair_is_lost_by_the_subspace():
    """With few vectors, and none for the residuals, a copy still reaches the check; completed vectors hold the passages."""
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, prose(3000 + i, 30, words)) for i in range(300)]
    items = decontam.Items(rows, np.ones(decontam.FEATURES))
    few = np.linalg.qr(np.random.default_rng(0).standard_normal((len(items.vocabulary), 5)))[0].astype(np.float32)
    table = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    full = decontam.completed(items, few)
    own = decontam._dense(items, items.passages)
    assert np.allclose(full.T @ full, np.eye(full.shape[1]), atol=1e-3)
    assert (np.linalg.norm(own @ full, axis=1) >= 0.97 * np.linalg.norm(own, axis=1)).all()
    for v in (few, full):
        got = {(d, i) for b in decontam._search([table], items, v) for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        assert {(i, i) for i, _ in rows} <= got


def test_common_words_among_rare_ones_are_searched():
    """An item with 6 % of a passage's squared weight reaches a cosine of 0.24."""
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(64)]
    idf = np.full(decontam.FEATURES, 6.13)
    for _, h, _ in decontam._each(decontam.words_of([" ".join(common)])):
        idf[decontam.features(h)] = 2.0
    items = decontam.Items([(1, " ".join(common))], idf)
    basis = decontam.completed(items, np.eye(len(items.vocabulary), 1, dtype=np.float32))
    table = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([" ".join(rare[:34] + common + rare[34:])])], ["doc_id", "text"])
    got = [tuple(x[c][0].as_py() for c in ("doc_id", "item_id", "cosine")) for x in decontam._search([table], items, basis)]
    assert got == [(5, 1, pytest.approx(0.24, abs=0.01))]


def test_singular_vectors(spark):
    """The subspace holds the benchmark's passages as well as the best one of its rank, nearly."""
    items = decontam.Items([(i, prose(i, 40)) for i in range(30)], np.ones(decontam.FEATURES))
    docs = spark.createDataFrame([(i, prose(100 + i, 90)) for i in range(50)], "doc_id long, text string")
    v = decontam.singular_vectors(docs, items, rank=20)
    own = decontam._dense(items, items.passages)
    best = np.sqrt((np.linalg.svd(own)[1][:20] ** 2).sum())
    assert np.allclose(v.T @ v, np.eye(20), atol=1e-3) and np.linalg.norm(own @ v) > 0.9 * best


@pytest.mark.parametrize("most", [2048, 0])
def test_fit_covers_all_passages(spark, monkeypatch, most):
    """Every passage of every document is a row of the matrix: the middle of a long text, and the last of many texts."""
    monkeypatch.setattr(decontam, "GRAM", most)
    monkeypatch.setattr(decontam, "RUN", 100)
    r = np.random.default_rng(4)
    items = decontam.Items([(i, prose(i, 25)) for i in range(12)], r.random(decontam.FEATURES) + 0.5)
    texts = [prose(100, 2000), None, "", "x", prose(3, 16), prose(4, 17), prose(5, 33), *(prose(200 + i, 30 + 9 * i) for i in range(40))]
    rows = [items.row[decontam.features(h[s:s + decontam.PASSAGE])] for _, h, _ in decontam._each(decontam.words_of(texts)) for s in decontam.passage_starts(len(h))]
    full = np.zeros((len(rows), len(items.vocabulary)))
    for out, row in zip(full, rows, strict=True):
        w = items.weight[items.vocabulary[row[row >= 0]]].astype(float)
        np.add.at(out, row[row >= 0], w / max(np.sqrt((w ** 2).sum()), 1e-9))
    own = decontam._dense(items, items.passages)
    own = own / np.linalg.norm(own, axis=1, keepdims=True)
    own = np.concatenate([full * np.sqrt(len(own) / len(rows)), own])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    v = decontam.singular_vectors(docs, items, rank=len(items.vocabulary), rounds=1)
    # of full rank the columns span all; a round's product is told by a round of a lower rank
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)
    monkeypatch.setattr(decontam, "SPARE", 2)
    few = decontam.singular_vectors(docs, items, rank=4, rounds=1).astype(float)
    start = np.linalg.qr(np.random.default_rng(17).standard_normal((len(items.vocabulary), 6)))[0].astype(np.float32)
    basis = np.linalg.qr(own.T @ (own @ start))[0]
    assert np.allclose(np.linalg.norm(basis.T @ few, axis=0), 1, atol=1e-4)


def test_language_windows_hold_the_n_grams_of_the_whole_text(monkeypatch):
    r = np.random.default_rng(11)
    parts = ["ab", "É", " ", ". ", "12-3", "z", "Straße", "\n\n", "ж", "  --  ", "İ"]
    texts = ["".join(r.choice(parts, 300)) for _ in range(6)] + ["", None, "x", "." * 400, "ab" * 200, ". " * 90 + "a" + "! " * 90]
    matrix = np.vstack([r.normal(size=(langid.FEATURES, 3)), np.zeros((1, 3))])
    whole = langid.score_texts(texts, matrix, np.zeros(3))
    counts = langid.count_features([t or "" for t in texts], [i % 3 for i in range(len(texts))], 3)
    for block in (5, 7, 64):
        monkeypatch.setattr(langid, "BLOCK", block)
        cut = langid.score_texts(texts, matrix, np.zeros(3))
        assert cut[0].tolist() == whole[0].tolist() and cut[1] == pytest.approx(whole[1])
        assert (langid.count_features([t or "" for t in texts], [i % 3 for i in range(len(texts))], 3) == counts).all()
