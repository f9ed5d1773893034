"""Harmonic packing: pieces in reciprocal-capacity classes, a fixed number of pieces a bin.

A piece of length n belongs to class j = capacity // n; a bin of class j takes exactly j of
them, which always fit. A document's tokens are cut into whole sequences, then the
remainder is kept whole if its class wastes at most ``1 / TOLERANCE`` of its share of a
bin; otherwise a piece that fills its share is cut off first.

Bins are filled independently: a piece goes to one of ``WORKERS`` groups of its class by
hash, and the group's rank decides its bin. What is left of all groups (under j pieces
each) is filled once more by class; what is left then, under j pieces a class and so
a bounded number whatever the input, is packed first-fit decreasing.

Texts are read once. A piece's row (ids, lengths, checksum) is kept in a checkpoint, so
each later step reads numbers only. Null texts count as empty and hold the end id alone;
equal rows may swap their places, which gives the same result; an empty table no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from selenic.llm.common import settle, small_batches

CAPACITY = 4096
END_ID = 2
TOLERANCE = 32
WORKERS = 64
#: bytes that an encoder remembers pre-tokens in, about
REMEMBER = 32 << 20
#: bytes of an entry beside its word and ids, and the longest word with its ids that is remembered
ENTRY, LONG = 190, 1000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: Texts of these characters only, in which normalising is lower case and splitting is plain.
_LAST = 0x12F
_LETTERS = "".join(c for c in map(chr, range(0x80, _LAST + 1)) if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1)
_NUMBERS = "".join(c for c in map(chr, range(0x80, _LAST + 1)) if unicodedata.category(c)[0] == "N")
_OTHER = "".join(c for c in map(chr, range(0xA1, _LAST + 1)) if unicodedata.category(c)[0] in "PS")
PLAIN = re.compile(f"[\\t\\n\\r\\x20-\\x7e{re.escape(_LETTERS + _NUMBERS + _OTHER)}]*")
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z{_LETTERS}]+|[0-9{_NUMBERS}]|[^\\s0-9a-zA-Z{re.escape(_LETTERS + _NUMBERS)}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordIds(dict):
    """Ids of pre-tokens as little-endian bytes; those of two generations of at most ``REMEMBER`` / 2 bytes are remembered."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters, self.old, self.size = model, byte_letters(), {}, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            mapped = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(word) + len(ids) > LONG:
            return ids
        if self.size >= REMEMBER // 2:
            self.old, self.size = dict(self), 0
            self.clear()
        self[word] = ids
        self.size += ENTRY + len(word) + len(ids)
        return ids


class Encoder:
    """Ids of texts as little-endian bytes, the same as the tokenizer gives.

    Pre-tokens are merged by the tokenizer's model once and remembered; texts with other
    characters or with special strings go through the tokenizer whole.
    """

    def __init__(self, config: str):
        self.tokenizer = Tokenizer.from_str(config)
        self.known = WordIds(self.tokenizer.model)

    def encode(self, text: str) -> bytes:
        if "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.known.__getitem__, SPLIT.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def encoder(config: str) -> Encoder:
    """One encoder a worker process; what it remembers serves its later tasks."""
    return Encoder(config)


def cuts(n: int, capacity: int = CAPACITY, tolerance: int = TOLERANCE) -> list[int]:
    """Lengths of the pieces of ``n`` tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        j = capacity // n
        share = capacity // j
        if (share - n) * tolerance <= share:
            out.append(n)
            break
        out.append(capacity // (j + 1))
        n -= out[-1]
    return out


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens."""
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(config.value).encode
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, at = ids_of(text or "") + end, 0
                n = len(ids) // 4
                for length in cuts(n, capacity):
                    out.append((doc_id, at, length, zlib.crc32(ids[4 * at:4 * (at + length)]), n))
                    at += length
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE)


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each length, longest first."""
    out = [0] * len(lengths)
    room = np.zeros(0, dtype=np.int64)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = int(np.argmax(room >= lengths[i])) if len(room) else 0
        if at >= len(room) or room[at] < lengths[i]:
            at = len(room)
            room = np.append(room, capacity)
        room[at] -= lengths[i]
        out[i] = at
    return out


def _fill(rows: DataFrame, group: list[str], level: int, salt) -> DataFrame:
    """Rank in the group, and the sequence unless the rank lies in the group's last, partial bin."""
    w = W.partitionBy(*group)
    rows = rows.withColumn("_rank", F.row_number().over(w.orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_bin", F.expr("_rank div _j"))
    whole = F.col("_rank") < F.expr("_n - _n % _j")
    seq = F.lit(level << 58).bitwiseOR(F.shiftleft("_j", 44)).bitwiseOR(F.shiftleft(salt, 38)).bitwiseOR(F.col("_bin"))
    return rows.withColumn("sequence_id", F.when(whole, seq))


def harmonic_pack(cut: DataFrame, capacity: int = CAPACITY, workers: int = WORKERS) -> DataFrame:
    """``cut`` (see ``pieces``) with sequence_id and offset, gapless from 0 in each sequence."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = settle(cut.select(*names)).withColumn("_j", F.expr(f"{capacity}L div length"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(workers)))
    keep = [*names, "_j", "_salt", "_bin", "sequence_id"]

    def offsets(df: DataFrame, *group: str) -> DataFrame:
        before = F.sum("length").over(W.partitionBy(*group).orderBy("doc_id", "start", "ids_crc32", "doc_tokens").rowsBetween(W.unboundedPreceding, 0))
        return df.withColumn("offset", before - F.col("length")).select(*names, "sequence_id", "offset")

    first = _fill(rows, ["_j", "_salt"], 1, F.col("_salt")).select(*keep)
    left = settle(first.where("sequence_id IS NULL").select(*names, "_j", "_salt"))
    second = _fill(left, ["_j"], 2, F.lit(0).cast("long")).select(*keep)
    rest = second.where("sequence_id IS NULL").select(*names, "_j").repartition(1)  # under j pieces a class

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            pdf = pd.concat(parts).sort_values(names, ignore_index=True)
            pdf["sequence_id"] = np.array(first_fit(pdf["length"].tolist(), capacity), "int64") | (3 << 58)
            pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
            yield pdf[[*names, "sequence_id", "offset"]]

    third = rest.mapInPandas(fit, f"{PIECE}, sequence_id long, offset long")
    return (offsets(first.where("sequence_id IS NOT NULL"), "_j", "_salt", "_bin")
            .unionByName(offsets(second.where("sequence_id IS NOT NULL"), "_j", "_bin")).unionByName(third))
