"""Personal data: fixed patterns, and further spans found by weak supervision.

The four base kinds (email, ip, card, phone) are matched leftmost and without overlap per
kind; a match that fails its check is dropped. Further candidates are runs of identifier
characters with a digit, of any length, that overlap no base span. Six labelers vote on each of them (1
personal, -1 not, 0 abstain): key shapes and plain shapes by regex, known key prefixes by
gazetteer, naming words before the candidate by context, character mix, and length.

All candidates of all documents are counted by vote pattern and feature row, tables that
the labelers' and features' value ranges bound, whatever the input's size.
Expectation-maximisation over these counts estimates each labeler's reliability on both
classes and the prior; the posteriors are the soft labels on which a logistic span
classifier is trained. Its weights judge every candidate.

The text is scanned once; offsets, votes and features are kept in a checkpoint, so the
result of a lost task can be made again. Every pattern scans in linear time, whatever the
text. Null texts count as empty; equal rows give equal results; an empty table no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenic.llm.common import settle, small_batches

KINDS = ("email", "ip", "card", "phone", "secret")
# Patterns of the contract; the guards before them only keep the scan linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Candidates and what the labelers look for.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z_+/-]*+[0-9][A-Za-z0-9_+/-]*+")
KEY_SHAPE = re.compile(r"(?=[0-9]*[a-f])[0-9a-f]{16,}|[A-Z]{4}[0-9A-Z]{16}|[A-Za-z0-9]{2,5}_[A-Za-z0-9]{20,}")
PLAIN_SHAPE = re.compile(r"[0-9]+|[0-9]+[/-][0-9/-]+|[A-Za-z]+[0-9]{1,4}|[0-9]+[a-z]{1,3}")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza")
NAMING = re.compile(r"(?:password|passwd|pwd|token|secret|api[_ -]?key|access[_ -]?key|credential|ssn)\W{1,4}$", re.IGNORECASE)
CONTEXT = 24
LABELERS = 6
FEATURES = 8

ROW = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("base", T.ArrayType(T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
    T.StructField("found", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
        T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("features", T.ArrayType(T.IntegerType()))])))])


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: a match holds exactly one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by start and kind."""
    out = [(0, *s) for s in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


def votes_of(word: str, before: str) -> list[int]:
    """The labelers' votes on a candidate and the text before it."""
    n, digits = len(word), sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    return [1 if KEY_SHAPE.fullmatch(word) else 0,
            -1 if PLAIN_SHAPE.fullmatch(word) else 0,
            1 if word.startswith(PREFIXES) else 0,
            1 if NAMING.search(before) else -1,
            1 if digits >= 3 and letters >= 3 and digits + letters >= 0.9 * n else -1,
            1 if n >= 16 else -1]


def features_of(word: str, before: str) -> list[int]:
    """Bounded whole-number features of the span classifier, the first a constant."""
    n, digits = len(word), sum(c.isdigit() for c in word)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:], strict=False))
    return [1, min(n, 40) // 8, 4 * digits // n, min(turns, 12) // 3, int(word.startswith(PREFIXES)), int(bool(NAMING.search(before))),
            int(all(c in "0123456789abcdef" for c in word)), int(word.upper() == word)]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, list[int], list[int]]]]:
    """Base spans and voted candidates of one text."""
    base, found, k = base_spans(text), [], 0
    far = 0  # the furthest end of the base spans that begin before the candidate's end
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][1] < m.end():
            far = max(far, base[k][2])
            k += 1
        if far <= m.start():
            before = text[max(0, m.start() - CONTEXT):m.start()]
            found.append((m.start(), m.end(), votes_of(m[0], before), features_of(m[0], before)))
    return base, found


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
    found = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]))
    for b in batches:
        scanned = [scan(t or "") for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            b.column(0),
            pa.array([[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in x] for x, _ in scanned], kinds),
            pa.array([[dict(zip(("start", "stop", "votes", "features"), s, strict=True)) for s in y] for _, y in scanned], found),
        ], ["doc_id", "base", "found"])


def expectation_maximisation(votes: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of the positive class for each vote pattern; labelers are independent given the class.

    The start takes every labeler for better than chance and the classes for equally frequent.
    """
    one = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeler, vote
    start = votes.sum(axis=1)
    post = 1 / (1 + np.exp(-start.astype(float)))
    for _ in range(rounds):
        logs = []
        for p in (post, 1 - post):
            w = weight * p
            share = (np.einsum("i,ijk->jk", w, one) + 0.1) / (w.sum() + 0.3)
            prior = (w.sum() + 1) / (weight.sum() + 2)
            logs.append(np.log(prior) + np.einsum("ijk,jk->i", one, np.log(share)))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


def train_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on weighted rows with soft labels."""
    w = np.zeros(x.shape[1])
    scale = weight / max(weight.sum(), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (scale * (p - y)) + ridge * 1e-2 * w
        hess = (x * (scale * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(scanned: DataFrame) -> list[float]:
    """Weights of the span classifier; zero weights (no span) if there is no candidate."""
    counts = (scanned.select(F.explode("found").alias("f")).groupBy("f.votes", "f.features").agg(F.count("*").alias("n"))
              .orderBy("votes", "features").collect())  # bounded by the ranges of votes and features
    if not counts:
        return [-1.0] + [0.0] * (FEATURES - 1)
    votes, x = np.array([r["votes"] for r in counts]), np.array([r["features"] for r in counts], float)
    n = np.array([r["n"] for r in counts], float)
    return [float(v) for v in train_logistic(x, expectation_maximisation(votes, n), n)]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and all spans as array of struct(start, kind, stop), kinds as indexes of ``KINDS``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = settle(rows.mapInArrow(_scan_batches, ROW))
    w = train(scanned)
    score = lambda f: sum((f["features"][i] * F.lit(w[i]) for i in range(1, FEATURES)), F.lit(w[0]))
    extra = F.transform(F.filter("found", lambda f: score(f) > 0),
                        lambda f: F.struct(f["start"].alias("start"), F.lit(KINDS.index("secret")).alias("kind"), f["stop"].alias("stop")))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return scanned.select(F.col("doc_id").alias(id_col), base.alias("base"), F.array_sort(F.concat(base, extra)).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, each span of the text replaced by its kind in brackets; null texts stay null."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    w = train(settle(rows.mapInArrow(_scan_batches, ROW).select("found")))

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: t if t is None else redact_text(t, all_spans(t, w)))

    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col)))


def all_spans(text: str, w: list[float]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans and of the candidates that the weights accept."""
    base, found = scan(text)
    spans = [(a, k, b) for k, a, b in base]
    spans += [(a, KINDS.index("secret"), b) for a, b, _, f in found if sum(x * y for x, y in zip(f, w, strict=True)) > 0]
    return sorted(spans)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(id_col, *[count(k) for k in range(4)], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"))


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for start, kind, stop in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, stop)
    return "".join(out) + text[done:]
