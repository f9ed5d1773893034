"""Token counts with a whole-token shortcut.

The tokenizer's merges never cross the start of a run of spaces or a line break, because no
vocabulary string holds a space mark after another character, or a line break. So a text
falls into pre-tokens (spaces or one line break, then the characters up to the next), whose
counts add up. For each vocabulary string the driver proves, by encoding it alone as a
pre-token, whether it stays one token. These strings, as many as the vocabulary at most,
are broadcast; a pre-token among them is counted without merging, the rest are merged once
per distinct string and task and remembered in a table of bounded size.

Null texts count as empty (no tokens); long texts are read in windows that end at a
pre-token; equal rows give equal counts; an empty table gives no rows. Only the id and
the text of the input are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selenic.llm.common import small_batches

PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")
CUT = re.compile(r"(?<! )[ \n]")
MARK = "▁"
WINDOW = 1 << 20
#: remembered pre-tokens of a task
REMEMBER = 400_000


def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def check_splits(sp: sentencepiece.SentencePieceProcessor) -> None:
    """Refuse a model whose merges could cross a pre-token's end."""
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i):
            continue
        if "\n" in piece or MARK in piece.lstrip(MARK):
            raise ValueError(f"the vocabulary string {piece!r} crosses pre-tokens")
    if sp.encode("a  \n b") != sp.encode("a") + sp.encode("a  ")[1:] + sp.encode("\n")[1:] + sp.encode("b"):
        raise ValueError("the model normalises white space")


def whole_tokens(sp: sentencepiece.SentencePieceProcessor) -> dict[str, int]:
    """Pre-tokens proven to need no merging, with their counts: a word of one token, after a space or a line break."""
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    words = [p[1:] for p in pieces if p.startswith(MARK) and MARK not in p[1:] and p != MARK]
    inner = [p for p in pieces if MARK not in p]
    out = {" " + w: 1 for w, ids in zip(words, sp.encode(words), strict=True) if len(ids) == 1}
    # after a line break: the space mark that the model puts first, the break, the word
    return out | {"\n" + w: 2 for w, ids in zip(inner, sp.encode(["\n" + w for w in inner]), strict=True) if len(ids) == 3}


def merge_counts(sp: sentencepiece.SentencePieceProcessor, keys: list[str]) -> dict[str, int]:
    """Counts of pre-tokens by merging."""
    blank = [k for k in keys if not k.strip(" ")]
    rest = [k for k in keys if k.strip(" ")]
    out = {k: len(ids) - (k[0] == "\n") for k, ids in zip(rest, sp.encode([k[1:] if k[0] == " " else k for k in rest], num_threads=1), strict=True)}
    return out | {k: len(sp.encode("a" + k)) - 1 for k in blank}


class Counter:
    """Counts texts; holds the proven strings and what it has merged so far."""

    def __init__(self, model: bytes, proven: dict[str, int]):
        self.sp, self.proven, self.known = processor(model), proven, dict(proven)

    def _add(self, pieces: list[str]) -> int:
        known = self.known
        new = [k for k in set(pieces) if k not in known]
        if new:
            if len(known) + len(new) > REMEMBER + len(self.proven):
                known = self.known = dict(self.proven)
                new = [k for k in set(pieces) if k not in known]
            known.update(merge_counts(self.sp, new))
        return sum(map(known.__getitem__, pieces))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text, total, at = " " + text, 0, 0
        while at < len(text):
            end = len(text)
            if at + WINDOW < end and (m := CUT.search(text, at + WINDOW)):
                end = m.start()
            total += self._add(PRE_TOKEN.findall(text, at, end))
            at = end
        return total


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:
        model = f.read()
    sp = processor(model)
    check_splits(sp)
    shared = spark.sparkContext.broadcast((model, whole_tokens(sp)))  # as large as the vocabulary

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(*shared.value)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    n_tokens = F.pandas_udf(count, "long")
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.select("_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return rows.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
