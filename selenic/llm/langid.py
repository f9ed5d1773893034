"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters becomes a space, runs of spaces become one.
Its n-grams (one to three characters) are hashed into ``FEATURES`` slots and counted per
language over labelled rows. The log-probability matrix (features x languages, its size is
checked) is broadcast; a batch of texts is scored as the sparse sum of the matrix rows of
its n-grams, in blocks of bounded size whatever the length of a text.

Training reads at most about ``sample`` labelled rows of each language, taken by a hash of
the id, which bounds the counts that meet in the driver by features x languages.
Predictions see the text alone. A null text, or one without any letter, is ``und`` with
score 0, as is every text if no row is labelled. Ties go to the first language in
alphabetical order; equal texts get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenic.llm.common import runs, small_batches

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE = 20_000
BLOCK = 1 << 19
MAX_MATRIX = 256 << 20
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def windows(texts: list[str | None]) -> list[tuple[int, str, int]]:
    """(row, lower-case text of about ``BLOCK`` characters, characters at its end that belong to the next one).

    A text is padded at its own ends only. What a window borrows from the next one are the few characters
    that n-grams across the cut need, so the windows' n-grams together are those of the whole text.
    """
    out: list[tuple[int, str, int]] = []
    for i, t in enumerate(texts):
        if not t:
            continue
        whole, ahead, parts = f" {t.lower()} ", "", []
        for k in range((len(whole) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            part = whole[k:k + BLOCK]
            if k and not whole[k - 1].isalpha():  # more of a gap that the window before holds already
                part = part[next((x for x, ch in enumerate(part) if ch.isalpha()), len(part)):]
            if part:
                parts.append((i, part + ahead, len(ahead)))
                ahead = _head(part + ahead) if k else ""
        out += reversed(parts)
    return out


def _head(text: str) -> str:
    """The first characters that count, as many as an n-gram may reach over."""
    out = text[0]
    for before, ch in zip(text, text[1:], strict=False):
        if len(out) == max(ORDERS) - 1:
            break
        if ch.isalpha() or before.isalpha():
            out += ch
    return out


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``window_grams`` of whole texts, one window each."""
    return window_grams([f" {t.lower()} " for t in texts], [0] * len(texts))


def window_grams(texts: list[str], borrowed: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window starts, letters per window, feature of each position) per order; feature ``FEATURES`` stands for none."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    letter = _letter_table()[codes]
    first = np.zeros(len(codes), dtype=bool)
    first[starts] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep |= first
    place = np.concatenate([[0], np.cumsum(keep)])
    codes = np.where(letter, codes, np.uint32(32))[keep]
    starts, ends = place[starts], place[ends]
    left = np.repeat(ends, ends - starts) - np.arange(len(codes))  # characters from here to the window's end
    own = left > np.repeat(borrowed, ends - starts)
    n_letters = np.add.reduceat(letter[keep] & own, starts, dtype=np.int64)
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(codes), dtype=np.uint32)
        shifted[:len(codes) - n + 1] = codes[n - 1:]
        h = (h + shifted + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            yield starts, n_letters, np.where((left >= n) & own, (h * np.uint32(0x85EBCA6B)) >> np.uint32(16), np.uint32(FEATURES))


def count_features(texts: list[str], labels: list[int], languages: int) -> np.ndarray:
    """Feature counts by language."""
    out = np.zeros((languages, FEATURES + 1), dtype=np.int64)
    parts = windows(texts)
    for a, b in runs((len(t) for _, t, _ in parts), BLOCK):
        of = np.array([labels[i] for i, _, _ in parts[a:b]])
        for starts, _, feature in window_grams([t for _, t, _ in parts[a:b]], [n for _, _, n in parts[a:b]]):
            row = np.repeat(of, np.diff(np.append(starts, len(feature))))
            out += np.bincount(row * (FEATURES + 1) + feature, minlength=out.size).reshape(out.shape)
    return out[:, :FEATURES]


def score_texts(texts: list[str | None], matrix: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language or -1, its posterior) of each text."""
    total, letters = np.tile(prior.astype(float), (len(texts), 1)), np.zeros(len(texts), dtype=np.int64)
    parts = windows(texts)
    for a, b in runs((len(t) for _, t, _ in parts), BLOCK):
        rows = np.array([i for i, _, _ in parts[a:b]])
        for k, (starts, n, feature) in enumerate(window_grams([t for _, t, _ in parts[a:b]], [n for _, _, n in parts[a:b]])):
            np.add.at(total, rows, np.add.reduceat(matrix[feature], starts, axis=0, dtype=float))
            if k == 0:
                np.add.at(letters, rows, n)
    best = total.argmax(axis=1) if total.shape[1] else np.zeros(len(texts), dtype=np.int64)
    share = np.exp(total - total.max(axis=1, keepdims=True)) if total.shape[1] else np.zeros((len(texts), 0))
    known = letters > 0 if total.shape[1] else np.zeros(len(texts), dtype=bool)
    score = 1 / np.maximum(share.sum(axis=1), 1)
    return np.where(known, best, -1), np.where(known, score, 0.0)


class Model:
    """Languages in order, log priors, and the matrix with a last row of zeros for no feature."""

    def __init__(self, languages: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.languages, self.prior, self.matrix = languages, prior, matrix


def held_out(id_col: Column) -> Column:
    """True for the fifth of the ids that training never reads."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(rows: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
          sample: int = SAMPLE, alpha: float = 0.05) -> Model:
    """Fit on the labelled rows given, about ``sample`` of each language at most."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(0), np.zeros((FEATURES + 1, 0), dtype=np.float32))
    if (FEATURES + 1) * len(languages) * 4 > MAX_MATRIX:
        raise ValueError(f"{len(languages)} languages need a matrix of more than {MAX_MATRIX} bytes")
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))])
    drawn = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {k: i for i, k in enumerate(languages)}
        total = np.zeros((len(languages), FEATURES), dtype=np.int64)
        for b in batches:
            total += count_features(b.column(0).to_pylist(), [index[x] for x in b.column(1).to_pylist()], len(languages))
        lang, feature = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(feature, pa.int64()), pa.array(total[lang, feature])],
                                         ["lang", "feature", "n"])

    counted = rows.where(drawn).select("text", "lang").mapInArrow(count, "lang long, feature long, n long")
    counted = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((FEATURES, len(languages)))
    counts[counted["feature"].to_numpy(dtype=np.int64), counted["lang"].to_numpy(dtype=np.int64)] = counted["n"]
    matrix = np.zeros((FEATURES + 1, len(languages)), dtype=np.float32)
    matrix[:FEATURES] = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * FEATURES))
    n = np.array([sizes[k] for k in languages], dtype=float)
    return Model(languages, np.log(n / n.sum()), matrix)


def predict(df: DataFrame, model: Model, text_col: str = "text", out: str = "prediction") -> DataFrame:
    """All columns of ``df`` with the struct ``out`` (lang, score)."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.matrix))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, prior, matrix = shared.value
        names = np.array([*languages, UNKNOWN], dtype=object)
        for texts in batches:
            best, value = score_texts(texts.tolist(), matrix, prior)
            yield pd.DataFrame({"lang": names[best], "score": value})

    return df.withColumn(out, F.pandas_udf(score, "lang string, score double")(F.col(text_col)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(F.col(id_col))), text_col, label_col, id_col)
    rows = predict(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text")
    return rows.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"),
                       F.col("prediction.lang").alias("lang_pred"), F.col("prediction.score").alias("score"))
