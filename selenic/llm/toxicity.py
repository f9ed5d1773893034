"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, everything but letters and digits becomes a space, runs of spaces become
one, and a space stands at both ends. Its n-grams of ``ORDERS`` characters are hashed into
``FEATURES`` slots; a text has a slot or has it not, so its length does not dilute a hit.

Training, on labelled rows only, about ``sample`` of them at most, drawn by a hash of the id (before
the join with the texts, so no others are shuffled):

1. The texts with each slot are counted by label, within the tasks first; partial counts travel packed.
2. The log-count ratio of slot f is r = log((p + alpha) / (n + alpha)), p and n being the shares
   of the two labels' texts that have it. Slots in fewer than ``MIN_TEXTS`` texts stay out, and of
   the rest the ``KEPT`` whose counts differ most for their size (a chi-square score) take part.
3. A logistic regression on r of the slots present is fitted by gradient steps with momentum; the
   kept slots of the drawn rows meet in the driver (at most ``sample`` times ``MAX_SLOTS`` numbers,
   checked). Texts count alike.

The model is one weight for each kept slot, broadcast (``FEATURES`` words at most). Scoring sees
the text alone; a text is read in windows that overlap by the longest order less one, which gives
the same slots as the whole. A null or empty text has no slot and gets the score of the intercept,
as does every text if a label is missing from the training rows (one in a million if label 1 is).
Labels other than 0 and 1, null labels and labels of ids that repeat with two values are not
learned from. Equal texts get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenic.llm.common import settle

FEATURES = 1 << 20
ORDERS = (3, 4, 5)
MIN_TEXTS = 3
KEPT = 5_000
SAMPLE = 30_000
MAX_SLOTS = 500
WINDOW = 1 << 18
PARTS = 16
THRESHOLD = 0.3

_plain: np.ndarray | None = None


def _letters() -> np.ndarray:
    """The code point that stands for each code point: itself for letters and digits, else a space."""
    global _plain
    if _plain is None:
        _plain = np.array([i if chr(i).isalnum() else 32 for i in range(0x110000)], dtype=np.uint32)
    return _plain


def codes(text: str | None) -> np.ndarray:
    """Code points of the normalised text with a space at both ends; empty without letters and digits."""
    x = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = _letters()[x]
    keep = x != 32
    keep[1:] |= x[:-1] != 32
    keep[0] = True
    x = x[keep]
    return x if len(x) > 1 else x[:0]


def slots(x: np.ndarray) -> np.ndarray:
    """Hashed slot of every n-gram of every order, repeats included."""
    out, h = [], np.zeros(len(x), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = (h[:m] + x[n - 1:] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h = h ^ (h >> np.uint32(15))
        if n in ORDERS:
            out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(12))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def windows(x: np.ndarray, size: int = WINDOW) -> Iterator[np.ndarray]:
    """The code points in runs that overlap by the longest order less one."""
    step = size - max(ORDERS) + 1
    for k in range(0, max(1, len(x) - max(ORDERS) + 1), step):
        yield x[k:k + size]


class Seen:
    """Distinct slots of a text; the scratch is held by the caller and bounded by ``FEATURES``."""

    def __init__(self):
        self.at = np.zeros(FEATURES, dtype=np.int32)

    def distinct(self, f: np.ndarray) -> np.ndarray:
        place = np.arange(len(f), dtype=np.int32)
        self.at[f] = place
        return f[self.at[f] == place]

    def of(self, text: str | None) -> np.ndarray:
        parts = [self.distinct(slots(w)) for w in windows(codes(text))]
        return parts[0] if len(parts) == 1 else self.distinct(np.concatenate(parts))


def log_count_ratios(has: np.ndarray, texts: np.ndarray, alpha: float = 1.0, kept: int = KEPT, min_texts: int = MIN_TEXTS) -> tuple[np.ndarray, np.ndarray]:
    """(slots that take part, their log-count ratios) from texts with each slot (2 x slots) and texts by label."""
    total = has.sum(axis=0)
    share = texts[1] / texts.sum()
    chi = (has[1] - total * share) ** 2 / np.maximum(total * share * (1 - share), 1e-12)
    able = np.flatnonzero(total >= min_texts)
    best = able[np.argsort(-chi[able], kind="stable")[:kept]]
    best.sort()
    odds = (has[:, best] + alpha) / (texts[:, None] + 2 * alpha)
    return best, np.log(odds[1] / odds[0])


def fit_logistic(starts: np.ndarray, index: np.ndarray, y: np.ndarray, r: np.ndarray, ridge: float = 1.0,
                 steps: int = 200) -> tuple[np.ndarray, float]:
    """(weight of each slot, intercept) of the logistic regression on r of the slots of each row.

    ``index`` holds the slots row after row, ``starts`` where each row begins. Nesterov steps with
    a step length from the largest eigenvalue, found by power iteration.
    """
    n = len(y)
    row = np.repeat(np.arange(n), np.diff(np.append(starts, len(index))))
    value = r[index]

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=value * w[index], minlength=n)

    def back(e: np.ndarray) -> np.ndarray:
        return np.bincount(index, weights=value * e[row], minlength=len(r))

    v, b, top = np.ones(len(r)), 1.0, 1.0
    for _ in range(12):
        e = times(v) + b
        v, b = back(e), e.sum()
        top = np.sqrt(v @ v + b * b) or 1.0
        v, b = v / top, b / top
    rate = 1 / (0.25 * top * 1.05 + ridge)
    w, c = np.zeros(len(r)), 0.0
    pw, pc = w, c
    for k in range(steps):
        m = k / (k + 3)
        aw, ac = w + m * (w - pw), c + m * (c - pc)
        pw, pc = w, c
        e = 1 / (1 + np.exp(-np.clip(times(aw) + ac, -40, 40))) - y
        w, c = aw - rate * (back(e) + ridge * aw), ac - rate * e.sum()
    return w * r, float(c)


class Model:
    """Weight by slot (zero for those that do not take part) and the intercept."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, intercept: float):
        self.at, self.weight, self.intercept = at.astype(np.int32), weight.astype(np.float32), intercept

    def dense(self) -> np.ndarray:
        out = np.zeros(FEATURES, dtype=np.float32)
        out[self.at] = self.weight
        return out


def score_texts(texts: list[str | None], weight: np.ndarray, intercept: float, seen: Seen) -> np.ndarray:
    """Probability of label 1 of each text."""
    out = np.full(len(texts), intercept)
    active = weight != 0
    for i, t in enumerate(texts):
        found = []
        for w in windows(codes(t)):
            f = slots(w)
            found.append(seen.distinct(f[active[f]]))
        f = found[0] if len(found) == 1 else seen.distinct(np.concatenate(found))
        out[i] += weight[f].sum(dtype=float)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def held_out(id_col: Column) -> Column:
    """True for the quarter of the ids whose labels training never reads."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, y) of the documents that one label, 0 or 1, stands for; about ``sample`` of them at most."""
    y = F.col(label_col).cast("int")
    one = labels.select(F.col(id_col).alias("id"), y.alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    share = min(1.0, sample / max(one.count(), 1))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("toxicity sample")), F.lit(1_000_000)) < share * 1_000_000
    one = one.where(drawn).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y").select("id", "y")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & drawn)
    return texts.join(one, "id").select("text", "y")


def pack(has: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(label, part, packed slots and counts) of texts by label and slot."""
    width = has.shape[1] // PARTS
    for y in (0, 1):
        for k in range(PARTS):
            part = has[y, k * width:(k + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                yield y, k, zlib.compress(at.astype("<u4").tobytes() + part[at].astype("<u4").tobytes(), 1)


def unpack(has: np.ndarray, y: int, k: int, packed: bytes) -> None:
    """Add packed counts."""
    at, n = np.frombuffer(zlib.decompress(packed), "<u4").reshape(2, -1)
    has[y, k * (has.shape[1] // PARTS) + at] += n


def counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(texts with each slot by label, texts by label) of rows (text, y)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, has, n = Seen(), np.zeros((2, FEATURES), dtype=np.int64), [0, 0]
        for b in batches:
            for t, y in zip(b.column(0), b.column(1), strict=True):
                has[y.as_py(), seen.of(t.as_py())] += 1
                n[y.as_py()] += 1
        out = [*pack(has), *((y, -1, n[y].to_bytes(8, "little")) for y in (0, 1))]
        y, part, packed = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(part, pa.int32()), pa.array(packed, pa.binary())], ["y", "part", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, n = np.zeros((2, FEATURES), dtype=np.int64), [0, 0]
        for b in batches:
            for y, k, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k < 0:
                    n[y] += int.from_bytes(packed, "little")
                else:
                    unpack(has, y, k, packed)
        out = [*pack(has), *((y, -1, n[y].to_bytes(8, "little")) for y in (0, 1))]
        y, part, packed = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(part, pa.int32()), pa.array(packed, pa.binary())], ["y", "part", "packed"])

    kind = "y int, part int, packed binary"
    # a part is added up in one task, so each slot comes once: a table of 2 x FEATURES counts at most
    total = rows.select("text", "y").mapInArrow(count, kind).repartition(PARTS, "part").mapInArrow(add, kind).collect()
    has, n = np.zeros((2, FEATURES)), np.zeros(2)
    for r in total:
        if r["part"] < 0:
            n[r["y"]] += int.from_bytes(r["packed"], "little")
        else:
            unpack(has, r["y"], r["part"], r["packed"])
    return has, n


def train(rows: DataFrame, alpha: float = 1.0, ridge: float = 1.0) -> Model:
    """Fit on rows of (text, y), a bounded number of them (see ``labelled``)."""
    spark = rows.sparkSession
    rows = settle(rows)
    has, texts = counts(rows)
    if not texts.all():
        share = texts[1] / texts.sum() if texts.sum() else 0.0
        return Model(np.zeros(0), np.zeros(0), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    at, r = log_count_ratios(has, texts, alpha)
    place = np.full(FEATURES, -1, dtype=np.int32)
    place[at] = np.arange(len(at), dtype=np.int32)
    shared = spark.sparkContext.broadcast(place)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, where = Seen(), shared.value
        for b in batches:
            kept = [where[seen.of(t.as_py())] for t in b.column(0)]
            kept = [np.sort(x[x >= 0]).astype("<i4").tobytes() for x in kept]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(kept, pa.binary())], ["y", "slots"])

    part = settle(rows.select("text", "y").mapInArrow(features, "y int, slots binary"))
    size = part.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
    if size > 4 * MAX_SLOTS * SAMPLE:
        raise ValueError("the drawn rows have too many slots for the driver; lower sample or KEPT")
    drawn = sorted((r["y"], bytes(r["slots"])) for r in part.collect())  # the same order and so the same sums in each run
    index = np.frombuffer(b"".join(x for _, x in drawn), "<i4")
    starts = np.cumsum([0, *(len(x) // 4 for _, x in drawn)])[:-1]
    weight, intercept = fit_logistic(starts, index, np.array([y for y, _ in drawn], dtype=float), r, ridge)
    return Model(at, weight, intercept)


def predict(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``df`` with the probability ``out``."""
    shared = df.sparkSession.sparkContext.broadcast((model.at, model.weight, model.intercept))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weight, intercept = shared.value
        dense, seen = Model(at, weight, intercept).dense(), Seen()
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), dense, intercept, seen))

    return df.withColumn(out, F.pandas_udf(score, "double")(F.col(text_col)))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted; the held-out quarter is never learned from."""
    model = train(labelled(docs, labels.where(~held_out(F.col(id_col))), SAMPLE, id_col, text_col, label_col))
    rows = predict(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text", "_score")
    return rows.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"),
                       (F.col("_score") >= threshold).cast("int").alias("predicted"))
