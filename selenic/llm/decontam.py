"""Benchmark decontamination by latent semantic retrieval.

1. Words (runs of letters and digits, lower case) are hashed to ``FEATURES`` slots; document
   frequencies of all documents give the IDF weights.
2. The benchmark's passages and all passages of the corpus are the rows of a TF-IDF matrix over
   the benchmark's words. Its leading right singular vectors are found by randomised subspace
   iteration. The products of words (the matrix's transpose times itself) are summed in one pass
   over the corpus, by partition and block; beyond ``GRAM`` words a pass for each round sums their
   products with the current vectors instead. Only the orthonormalisation runs in the driver, on as
   many rows as the benchmark has words. Passages of which the subspace holds less than ``HELD``
   add their residuals to it; the columns are then turned to the benchmark's own directions and cut to these.
3. Every passage of every document (``PASSAGE`` words, half overlapping) is projected, unless too
   little of its weight lies on the benchmark's words for any match, and compared by
   cosine with all benchmark passages in blocks. What both have outside the subspace adds the
   product of its norms at most, so no pair of cosine ``COSINE`` in full is lost at any rank.
4. A candidate is confirmed on the document's own words around the passage: the longest common
   subsequence must hold ``STRONG`` of the item's words, or ``WEAK`` of them together with the answer,
   which is the item's last sentence.

The benchmark is read into the driver in slices of ``SLICE`` items, which are searched in runs of
``PASSAGES`` passages (one item at least), so what is broadcast is bounded whatever its size. Frequencies, fit, search and checks cover all rows.
Null or empty texts and items match nothing; a document matches an item once, with its best
passage; repeated rows give repeated results; empty tables give no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selenic.llm.common import mix64, runs, small_batches

FEATURES = 1 << 18
PASSAGE = 32
STEP = 16
RANK = 256
SPARE = 16
GRAM = 4096
WAVES = 2
STRIPE = 128
COSINE = 0.2
STRONG = 0.65
WEAK = 0.5
ANSWER = 0.8
SLICE = 2_000
PASSAGES = 512
HELD = 0.95  # of a passage's squared norm; it changes the cost, never a match
BLOCK = 1 << 20
RUN = 1 << 13  # words of the passages that are projected at once
PAIRS = 1 << 16  # pairs of words that are added at once
PARTS = 64
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(11_000_027).integers(1, 1 << 63, 256, dtype=np.uint64)
_INNER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_tables: tuple[np.ndarray, np.ndarray] | None = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _tables
    if _tables is None or len(_tables[0]) < n:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, BLOCK + (1 << 18)), base, dtype=np.uint64)
            x[0] = 1
            both.append(np.cumprod(x))
        _tables = both[0], both[1]
    return _tables


def words_of(texts: list[str | None]) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(texts of the block, word hashes, end of each text in words) block by block."""
    data = [(t or "").lower().encode() for t in texts]
    for a, b in runs(map(len, data), BLOCK):
        x = np.frombuffer(b" ".join(data[a:b]) + b" ", dtype=np.uint8)
        inner = _INNER[x]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]])))
        starts, ends = edge[::2], edge[1::2]
        power, inverse = _powers(len(x) + 1)
        total = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[x] * power[:len(x)], out=total[1:])
        h = mix64(((total[ends] - total[starts]) * inverse[starts]) ^ (ends - starts).astype(np.uint64))
        yield range(a, b), h, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in data[a:b]]))


def features(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _block_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A partial sum in ``PARTS`` pieces, to be added up by piece."""
    for k, part in enumerate(np.array_split(total.ravel(), PARTS)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype("<f8").tobytes()], pa.binary())], ["part", "total"])


def _add_up(df: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the partitions' partial sums; each piece is added up in a task of its own, two at a time."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v, "<f8")
                held[k] = held[k] + x if k in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["part", "total"])

    rows = df.repartition("part").mapInArrow(add, "part int, total binary").collect()
    out = np.zeros(int(np.prod(shape)))
    for k, part in enumerate(np.array_split(out, PARTS)):
        for r in rows:
            if r["part"] == k:
                part += np.frombuffer(r["total"], "<f8")
    return out.reshape(shape)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF of each feature over all documents (column text)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(FEATURES + 1), np.zeros(FEATURES, dtype=np.int32)
        for b in batches:
            for texts, h, ends in words_of(b.column(0).to_pylist()):
                f, first = features(h), 0
                for e in ends:
                    part, place = f[first:e], np.arange(e - first, dtype=np.int32)
                    at[part] = place
                    total[part[at[part] == place]] += 1  # each feature of a document once
                    first = e
                total[FEATURES] += len(texts)
        yield from _block_rows(total)

    total = _add_up(docs.select("text").mapInArrow(count, "part int, total binary"), (FEATURES + 1,))
    return np.log((total[FEATURES] + 1) / (total[:FEATURES] + 1)) + 0.01


def passage_starts(n: int) -> range:
    """First words of the passages of a text of ``n`` words."""
    return range(0, max(n - PASSAGE + STEP, 1) if n > STEP else min(n, 1), STEP)


class Items:
    """Benchmark items of a slice with their passages, vocabulary and answers."""

    def __init__(self, rows: list[tuple[int, str]], idf: np.ndarray):
        self.ids = [i for i, _ in rows]
        self.words, self.answers = [], []
        passages, self.of, self.at = [], [], []
        whole = [h for _, h, _ in _each(words_of([t for _, t in rows]))]
        last = [h for _, h, _ in _each(words_of([_last_sentence(t) for _, t in rows]))]
        for k, (w, a) in enumerate(zip(whole, last, strict=True)):
            self.words.append(w.tolist())
            self.answers.append(a.tolist())
            for s in passage_starts(len(w)):
                passages.append(features(w[s:s + PASSAGE]))
                self.of.append(k)
                self.at.append(s)
        self.passages = passages
        self.counts = [np.unique(w, return_counts=True) for w in whole]
        self.places, self.answer_places = [places(w) for w in self.words], [places(w) for w in self.answers]
        self.vocabulary = np.unique(np.concatenate(passages)) if passages else np.zeros(0, dtype=np.int64)
        self.row = np.full(FEATURES, -1, dtype=np.int32)
        self.row[self.vocabulary] = np.arange(len(self.vocabulary))
        self.weight = idf.astype(np.float32)


def _each(blocks) -> Iterator[tuple[int, np.ndarray, None]]:
    for texts, h, ends in blocks:
        first = 0
        for i, e in zip(texts, ends, strict=True):
            yield i, h[first:e], None
            first = e


def _last_sentence(text: str) -> str:
    parts = [p for p in re.split(r"[.!?]+(?:\s|$)", text) if p.strip()]
    return parts[-1] if parts else ""


def _dense(items: Items, passages: list[np.ndarray]) -> np.ndarray:
    """TF-IDF rows over the vocabulary."""
    out = np.zeros((len(passages), len(items.vocabulary)), dtype=np.float32)
    for i, p in enumerate(passages):
        r = items.row[p]
        np.add.at(out[i], r[r >= 0], items.weight[p[r >= 0]])
    return out


def passage_bounds(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, text) of the passages of texts that end at these words."""
    begin = np.concatenate([[0], ends[:-1]])
    count = np.where(ends - begin > STEP, np.maximum(-(-(ends - begin - PASSAGE + STEP) // STEP), 1), ends > begin)
    doc = np.repeat(np.arange(len(ends)), count)
    starts = begin[doc] + STEP * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    return starts, np.minimum(starts + PASSAGE, ends[doc]), doc


def _halves(row: np.ndarray, square: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(words of the vocabulary, the half passage of each, a scale of the passage that each half begins, passages).

    A passage is scaled by the inverse of its words' squared weights. Half ``k`` lies in the passages ``k - 1`` and
    ``k``; a text's last half begins none, and half 0 and one between texts are empty.
    """
    starts, stops, doc = passage_bounds(ends)
    begin = np.concatenate([[0], ends[:-1]])
    count = np.bincount(doc, minlength=len(ends))
    first = 1 + np.cumsum(count + 2) - (count + 2)
    total = np.concatenate([[0.0], np.cumsum(np.where(row >= 0, square, 0))])
    weight = total[stops] - total[starts]
    scale = np.zeros(1 + int((count + 2).sum()))
    scale[first[doc] + (starts - begin[doc]) // STEP] = np.where(weight > 1e-12, 1 / np.maximum(weight, 1e-12), 0)
    at = np.flatnonzero(row >= 0)
    of = np.searchsorted(ends, at, side="right")
    return at, first[of] + (at - begin[of]) // STEP, scale, len(doc)


def _word_products(batches: Iterator[pa.RecordBatch], row: np.ndarray, weight: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Upper triangle of the products of the vocabulary's words in all passages, and the number of passages."""
    total, passages = np.zeros(n * n), 0
    for b in batches:
        for _, h, ends in words_of(b.column(0).to_pylist()):
            f = features(h)
            r, w = row[f], weight[f].astype(np.float64)
            at, half, scale, count = _halves(r, w * w, ends)
            r, w, passages = r[at].astype(np.int64), w[at], passages + count
            both = w * (scale[half] + scale[half - 1])  # for two words of one half
            np.add.at(total, r * (n + 1), w * both / 2)
            # each word meets the words after it in its half, then those of the next half
            place = np.arange(len(r))
            own, further = np.searchsorted(half, half, side="right"), np.searchsorted(half, half + 1, side="right")
            first, count = np.concatenate([place + 1, own]), np.concatenate([own - place - 1, further - own])
            left, scaled = np.concatenate([r, r]) * n, np.concatenate([both, w * scale[half]])
            cuts = np.searchsorted(np.cumsum(count), np.arange(PAIRS, count.sum(), PAIRS))
            for x, y in itertools.pairwise([0, *cuts, len(count)]):
                of = count[x:y]
                right = np.arange(of.sum()) + np.repeat(first[x:y] - np.cumsum(of) + of, of)
                np.add.at(total, np.repeat(left[x:y], of) + r[right], np.repeat(scaled[x:y], of) * w[right])
    total = total.reshape(n, n)
    for a in range(0, n, STRIPE):
        total[a:a + STRIPE, a:] += total[a:, a:a + STRIPE].T.copy()
    yield from _block_rows(np.concatenate([*(total[i, i:] for i in range(n)), [passages]]))


def _vector_products(batches: Iterator[pa.RecordBatch], row: np.ndarray, weight: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sum of all passages times their products with the columns ``v``, and the number of passages."""
    total, passages = np.zeros(v.shape), 0
    for b in batches:
        for _, h, ends in words_of(b.column(0).to_pylist()):
            f = features(h)
            r, w = row[f], weight[f].astype(np.float64)
            at, half, scale, count = _halves(r, w * w, ends)
            r, w, passages = r[at], w[at].astype(v.dtype), passages + count
            x = 0
            while x < len(r):
                # a run of whole halves; the one before and the two after it are projected too, for their share in its passages
                y = int(np.searchsorted(half, min(half[min(x + RUN, len(r)) - 1], half[x] + RUN), side="right"))
                low, high = half[x] - 1, half[y - 1] + 1
                p, q = np.searchsorted(half, low), np.searchsorted(half, high, side="right")
                place, first = np.unique(half[p:q], return_index=True)
                latent = np.zeros((high - low + 1, v.shape[1]))
                latent[place - low] = np.add.reduceat(w[p:q, None] * v[r[p:q]], first, axis=0)
                passage = (latent[:-1] + latent[1:]) * scale[low:high, None]
                back = w[x:y, None] * (passage[:-1] + passage[1:])[half[x:y] - low - 1]
                order = np.argsort(r[x:y], kind="stable")
                words, first = np.unique(r[x:y][order], return_index=True)
                total[words] += np.add.reduceat(back[order], first, axis=0)
                x = y
    yield from _block_rows(np.append(total, passages))


def singular_vectors(docs: DataFrame, items: Items, rank: int = RANK, rounds: int = 2) -> np.ndarray:
    """Leading right singular vectors (vocabulary x rank) of the TF-IDF passages, scaled to orthonormal columns.

    All passages of the corpus together weigh as much as those of the benchmark.
    """
    spark = docs.sparkSession
    n = len(items.vocabulary)
    width = min(n, rank + SPARE)
    shared = spark.sparkContext.broadcast((items.row, items.weight))
    # a partial sum is large, so there are a few for each core, whatever the number of files
    texts = docs.select("text").coalesce(WAVES * spark.sparkContext.defaultParallelism)
    own = _dense(items, items.passages)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    basis = np.linalg.qr(np.random.default_rng(17).standard_normal((n, width)))[0].astype(np.float32)
    words = None
    if n <= GRAM:
        summed = _add_up(texts.mapInArrow(lambda x: _word_products(x, *shared.value, n), "part int, total binary"), (n * (n + 1) // 2 + 1,))
        words, at = np.zeros((n, n), dtype=np.float32), 0
        for i in range(n):
            words[i, i:] = words[i:, i] = summed[at:at + n - i]
            at += n - i
    for _ in range(rounds):
        if words is None:
            current = spark.sparkContext.broadcast(basis)
            summed = _add_up(texts.mapInArrow(lambda x, current=current: _vector_products(x, *shared.value, current.value), "part int, total binary"), (basis.size + 1,))
            current.unpersist()
        product = summed[:-1].reshape(basis.shape) if words is None else words @ basis
        z = len(items.passages) / max(summed[-1], 1) * product + own.T @ (own @ basis)
        basis = np.linalg.qr(z)[0].astype(np.float32)
    _, _, turn = np.linalg.svd(own @ basis, full_matrices=False)
    return basis @ turn[:rank].T


def completed(items: Items, vectors: np.ndarray, held: float = HELD, most: int = PASSAGES) -> np.ndarray:
    """The orthonormal columns and at most ``most`` more, for the residuals of passages of which they hold less than ``held``."""
    own = _dense(items, items.passages)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    inner = own @ vectors
    poor = (inner ** 2).sum(axis=1) < held
    if not poor.any():
        return vectors
    _, size, more = np.linalg.svd(own[poor] - inner[poor] @ vectors.T, full_matrices=False)
    more = more[:most][size[:most] > 1e-3].T
    more -= vectors @ (vectors.T @ more)
    return np.concatenate([vectors, np.linalg.qr(more)[0]], axis=1).astype(np.float32)


def turned(items: Items, vectors: np.ndarray) -> np.ndarray:
    """The columns turned to the directions in which the passages lie, and cut to as many as these have; the passages lose nothing."""
    own = _dense(items, items.passages)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    _, size, turn = np.linalg.svd(own @ vectors, full_matrices=False)
    return (vectors @ turn[size > 1e-4 * size[0]].T).astype(np.float32)


def places(words: list[int]) -> dict[int, int]:
    """One bit for each place of each word."""
    at: dict[int, int] = {}
    for i, x in enumerate(words):
        at[x] = at.get(x, 0) | 1 << i
    return at


def common_length(n: int, at: dict[int, int], b: list[int]) -> int:
    """Length of the longest common subsequence of ``n`` words, given by their places, and ``b``."""
    row = full = (1 << n) - 1
    for x in b:
        hit = row & at.get(x, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def shared_words(known: np.ndarray, counts: np.ndarray, b: np.ndarray) -> int:
    """Words that a text of the ``known`` words with their ``counts`` shares with ``b`` in any order; no common subsequence is longer."""
    at = np.minimum(np.searchsorted(known, b), len(known) - 1)
    return int(np.minimum(np.bincount(at[known[at] == b], minlength=len(known)), counts).sum())


def confirm(items: Items, k: int, region: np.ndarray) -> tuple[float, float] | None:
    """(share of item k, share of its answer) in the region if they prove a leak."""
    n, m = len(items.words[k]), len(items.answers[k])
    if shared_words(*items.counts[k], region) < WEAK * n:
        return None
    region = region.tolist()
    share = common_length(n, items.places[k], region) / n
    if share < WEAK:
        return None
    told = common_length(m, items.answer_places[k], region) / m if m else 0.0
    return (share, told) if share >= STRONG or told >= ANSWER else None


def _search(batches: Iterator[pa.RecordBatch], items: Items, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    targets = _dense(items, items.passages)
    norm = np.array([np.sqrt((items.weight[p] ** 2).sum()) for p in items.passages], dtype=np.float32)
    whole = (targets ** 2).sum(axis=1)
    # the most that a unit of a word's weight adds to any passage's cosine
    most = (targets / np.maximum(norm, 1e-9)[:, None]).max(axis=0, initial=0).astype(np.float64)
    targets = targets @ vectors
    rest = np.sqrt(np.maximum(whole - (targets ** 2).sum(axis=1), 0)) / np.maximum(norm, 1e-9)
    targets /= np.maximum(norm, 1e-9)[:, None]
    padded = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), dtype=np.float32)]).astype(np.float32)
    for b in batches:
        ids = b.column(0).to_pylist()
        best: dict[tuple[int, int], tuple] = {}
        tried: set[tuple[int, int, int]] = set()
        for texts, h, ends in words_of(b.column(1).to_pylist()):
            f = features(h)
            row = items.row[f]
            square = (items.weight[f] ** 2).astype(np.float64)
            total = np.concatenate([[0.0], np.cumsum(square)])
            inside = np.concatenate([[0.0], np.cumsum(np.where(row >= 0, items.weight[f].astype(np.float64), 0))])
            bound = np.concatenate([[0.0], np.cumsum(np.where(row >= 0, items.weight[f] * most[row], 0))])
            begin = np.concatenate([[0], ends[:-1]])
            starts, stops, doc = passage_bounds(ends)
            if not len(doc):
                continue
            weight = total[stops] - total[starts]
            # no cosine in full is above that of a passage in which each word weighs what it weighs at most in any
            live = np.flatnonzero(bound[stops] - bound[starts] >= (COSINE - 2e-5) * np.sqrt(np.maximum(weight, 1e-9)))
            for x, y in runs([PASSAGE] * len(live), RUN):
                at = live[x:y]
                # each half passage is projected once and serves the two passages that share it
                half, of = np.unique(np.concatenate([starts[at], starts[at] + STEP]), return_inverse=True)
                end = np.zeros(len(half), dtype=np.int64)
                np.maximum.at(end, of, np.concatenate([stops[at], stops[at]]))
                place = half[:, None] + np.arange(STEP)
                none = place >= end[:, None]
                place = np.minimum(place, len(f) - 1)
                none |= row[place] < 0
                r = np.where(none, len(items.vocabulary), row[place])  # the last row is zero
                w = np.where(none, 0, items.weight[f[place]])
                projected = np.matmul(w[:, None, :], padded[r])[:, 0, :]
                latent = projected[of[:len(at)]] + projected[of[len(at):]]
                # what a passage has outside is no more than its words' weights in sum
                apart = inside[stops[at]] - inside[starts[at]]
                scale = np.sqrt(np.maximum(weight[at], 1e-9))[:, None]
                cosine = (latent @ targets.T) / scale
                for i, t in zip(*np.nonzero(cosine + apart[:, None] * rest / scale >= COSINE - 1e-5), strict=True):
                    d, k = int(doc[at[i]]), items.of[t]
                    first = int(starts[at[i]]) - items.at[t]
                    reach = STEP + len(items.words[k]) // 4
                    key = texts[d], k
                    if (*key, first) in tried or key in best and best[key][1] == 1.0:
                        continue
                    tried.add((*key, first))  # two passages of an item may ask for the same words
                    region = h[max(int(begin[d]), first - reach):min(int(ends[d]), first + len(items.words[k]) + reach)]
                    proof = confirm(items, k, region)
                    if proof and (key not in best or proof > best[key][1:]):
                        best[key] = (float(cosine[i, t]), *proof)
        c = [(ids[i], items.ids[k], *v) for (i, k), v in best.items()]
        c = list(zip(*c, strict=True)) if c else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *[pa.array(x, pa.float64()) for x in c[2:]]],
                                         ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", rank: int = RANK) -> DataFrame:
    """(id, item_id, cosine, lcs_share, answer_share) for each document and benchmark item that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    idf, out = inverse_frequencies(docs), spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t IS NOT NULL AND i IS NOT NULL")
    slices = -(-rows.count() // SLICE)
    for k in range(slices):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k) if slices > 1 else rows
        held = sorted((r["i"], r["t"]) for r in part.collect())
        sizes = [len(passage_starts(len(h))) for _, h, _ in _each(words_of([t for _, t in held]))]
        for a, b in runs(sizes, PASSAGES):
            items = Items(held[a:b], idf)
            if not items.passages:
                continue
            shared = spark.sparkContext.broadcast((items, turned(items, completed(items, singular_vectors(docs, items, rank)))))
            out = out.unionByName(docs.mapInArrow(lambda x, shared=shared: _search(x, *shared.value), out.schema))
    return out.withColumnRenamed("doc_id", id_col)
