"""Repeated 50-byte strings across documents, removed but for their first document.

1. Equal texts are one text; its smallest id stands for it.
2. Every window of ``LENGTH`` bytes has a key, the smallest hash of the ``GRAM``-byte strings in it.
   Equal windows have equal keys, and a run of windows with one key is one piece of text.
   Keys of two different texts at least are found by bucket of keys; other pieces can't
   hold a repeat and go no further.
3. The pieces with such keys are dealt to shards by key, so equal windows meet in one shard,
   whatever documents they are in. A shard sorts its suffixes by induced sorting, computes
   the permuted common prefixes, and takes the smallest id of each run of equal windows.
4. A document's bytes under windows whose smallest id is below its own are removed.

A shard never receives one entry per document of a hot string: within a batch of documents only
the smallest id of a piece goes on, since the others' bytes are decided then and there; the
same holds for keys. The number of shards follows the bytes of the input.

Null texts count as empty; texts under ``LENGTH`` bytes keep everything; of equal texts all
but the smallest id lose everything; rows that repeat an id and text are judged alike;
an empty table gives no rows. A null id stands behind all others and is never removed from.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selenic.llm.common import free, grouped, mix64, runs, settle, small_batches
from selenic.llm.suffixes import permuted_common, suffix_array

LENGTH = 50
GRAM = 20
LONGEST = 192  # windows of a piece
SHARD_BYTES = 4 << 20
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7_000_003).integers(1, 1 << 63, 256, dtype=np.uint64)
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


def short(key: np.ndarray, buckets: int) -> np.ndarray:
    """The high 32 bits of a key and those of its bucket; keys that differ in the rest only cost work."""
    return key & np.uint64(0xFFFFFFFF00000000 | buckets - 1)


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, number of windows, key) of each run of windows with one key."""
    out: list[tuple[np.ndarray, ...]] = []
    for a, b in runs(map(len, texts), BLOCK):
        data = np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8)
        if len(data) < LENGTH:
            continue
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[:len(data)], out=total[1:])
        low = mix64((total[GRAM:] - total[:-GRAM]) * inverse[:len(data) - GRAM + 1])
        width, span = LENGTH - GRAM + 1, 1
        n = len(data) - LENGTH + 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:n], low[width - span:][:n])
        size = np.array([len(t) for t in texts[a:b]])
        end = np.cumsum(size)
        text = np.repeat(np.arange(b - a), size)[:n]
        whole = np.arange(n) + LENGTH <= end[text]
        new = np.ones(n, dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, n))
        start, count = start[whole[start]], count[whole[start]]
        if len(count) and count.max() > LONGEST:  # cut long runs; their windows stay as they are
            parts = -(-count // LONGEST)
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start, left = np.repeat(start, parts) + step * LONGEST, np.repeat(count, parts) - step * LONGEST
            count = np.minimum(left, LONGEST)
        out.append((text[start] + a, start - (end - size)[text[start]], count, low[start]))
    if not out:
        zero = np.zeros(0, dtype=np.int64)
        return zero, zero, zero, zero.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _high(key: np.ndarray) -> bytes:
    return (key >> np.uint64(32)).astype("<u4").tobytes()


def _texts(b: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [t or b"" for t in b.column(column).cast(pa.binary()).to_pylist()]


def _cuts(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, dtype=np.int64)


def _key_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Keys by bucket: one document for each key of the batch; keys of two texts of the batch are decided at once."""
    for b in batches:
        ids, texts = b.column("doc_id").to_numpy(zero_copy_only=False), _texts(b)
        least: dict[bytes, int] = {}
        for i, t in enumerate(texts):
            if ids[i] < ids[least.setdefault(t, i)]:
                least[t] = i
        only = list(least.values())  # the smallest id of equal texts, which alone may stand for them
        text, _, _, key = pieces([texts[i] for i in only])
        key = short(key, buckets)
        doc = ids[np.array(only, dtype=np.int64)][text]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[new], doc[new]
        cut = _cuts(key)[:-1]
        count = np.diff(np.append(cut, len(key)))
        shared = np.repeat(count > 1, count)
        lead = np.zeros(len(key), dtype=bool)
        lead[cut] = True
        bucket = (key[lead] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        k, d, s, bucket = key[lead][order], doc[lead][order], shared[lead][order], bucket[order]
        ends = _cuts(bucket)
        rows = [(int(bucket[x]), _high(k[x:y]), d[x:y].astype("<i8").tobytes(), s[x:y].astype(np.uint8).tobytes()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        k, d = key[shared & ~lead], doc[shared & ~lead]
        if len(k):
            rows.append((int(d[0] % buckets), k.tobytes(), d.astype("<i8").tobytes(), b""))
        if rows:
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *[pa.array(x, pa.binary()) for x in c[1:]]], ["bucket", "keys", "docs", "shared"])


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key) for the keys of two documents at least."""
    def out(doc: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(key.view(np.int64))], ["doc_id", "key"])

    for g in grouped(batches, ["bucket"]):
        keys, docs, flags = (g.column(c).to_pylist() for c in ("keys", "docs", "shared"))
        for k, d, f in zip(keys, docs, flags, strict=True):
            if not f:
                yield out(np.frombuffer(d, "<i8"), np.frombuffer(k, "<u8").astype(np.uint64))
        key = np.frombuffer(b"".join(k for k, f in zip(keys, flags, strict=True) if f), "<u4").astype(np.uint64) << np.uint64(32)
        key |= np.uint64(g.column("bucket")[0].as_py())
        doc = np.frombuffer(b"".join(d for d, f in zip(docs, flags, strict=True) if f), "<i8")
        flag = np.frombuffer(b"".join(flags), np.uint8).astype(bool)
        order = np.argsort(key, kind="stable")
        key, doc, flag = key[order], doc[order], flag[order]
        cut = _cuts(key)[:-1]
        if len(cut):
            many = (np.diff(np.append(cut, len(key))) > 1) | np.logical_or.reduceat(flag, cut)
            keep = np.repeat(many, np.diff(np.append(cut, len(key))))
            yield out(doc[keep], key[keep])


def _piece_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Pieces with shared keys by shard, the smallest id for each piece of the batch; the others' spans are decided at once."""
    for b in batches:
        ids, texts = b.column("doc_id").to_numpy(zero_copy_only=False), _texts(b)
        wanted = [np.frombuffer(x, "<i8").view(np.uint64) for x in b.column("keys").to_pylist()]
        mark = [zlib.crc32(t) for t in texts]
        text, start, count, key = pieces(texts)
        key = short(key, buckets)
        keep = np.zeros(len(key), dtype=bool)
        for i, (x, y) in enumerate(zip(*(np.searchsorted(text, np.arange(len(texts)), side=s) for s in ("left", "right")), strict=True)):
            keep[x:y] = np.isin(key[x:y], wanted[i])
        least: dict[bytes, tuple[int, list[int], int]] = {}
        spans: list[tuple[int, int, int]] = []
        for i, s, n, k in zip(text[keep].tolist(), start[keep].tolist(), count[keep].tolist(), (key[keep] % np.uint64(buckets)).tolist(), strict=True):
            piece, doc, s = texts[i][s:s + n + LENGTH - 1], int(ids[i]), s << 32 | mark[i]
            held = least.get(piece)
            if held is None or doc < held[0]:
                if held:
                    spans += [(held[0], x, x + (len(piece) << 32)) for x in held[1]]
                least[piece] = (doc, [s], k)
            elif doc > held[0]:
                spans.append((doc, s, s + (len(piece) << 32)))
            else:
                held[1].append(s)
        by_shard: dict[int, list[tuple[bytes, int, int]]] = {}
        for piece, (doc, starts, k) in least.items():
            by_shard.setdefault(k, []).extend((piece, doc, s) for s in starts)
        pack = zstandard.ZstdCompressor(level=1).compress
        rows = [(k, pack(b"\xff".join(p for p, _, _ in v)), np.array([x[1:] for x in v], "<i8").tobytes()) for k, v in by_shard.items()]
        if spans:
            rows.append((spans[0][0] % buckets, b"", np.array(spans, "<i8").tobytes()))
        if rows:
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary())], ["bucket", "pieces", "docs"])


def smallest_ids(texts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of distinct texts with one smallest id: (text index, first window, windows, id)."""
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    end = np.cumsum(size)
    text = np.repeat(np.arange(len(texts)), size)
    order = suffix_array(joined)
    order = order[order + LENGTH < end[text[order]]]
    fresh = ~permuted_common(joined, order, LENGTH)
    starts = np.flatnonzero(fresh)
    least = np.repeat(np.minimum.reduceat(ids[text[order]], starts), np.diff(np.append(starts, len(order)))) if len(order) else order
    by_place = np.argsort(order, kind="stable")
    place, least = order[by_place], least[by_place]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (least[1:] != least[:-1])
    cut = np.flatnonzero(new)
    at = text[place[cut]]
    return at, place[cut] - (end - size)[at], np.diff(np.append(cut, len(place))), least[cut]


def _shard_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, crc32 of the text, start, stop) to remove."""
    def out(spans: np.ndarray) -> pa.RecordBatch:
        doc, start, stop = spans.T
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, start & 0xFFFFFFFF, start >> 32, stop >> 32)],
                                          ["doc_id", "mark", "start", "stop"])

    for g in grouped(batches, ["bucket"]):
        texts, docs, unpack = g.column("pieces").to_pylist(), g.column("docs").to_pylist(), zstandard.ZstdDecompressor().decompress
        index: dict[bytes, int] = {}
        of, doc, start = [], [], []
        for t, d in zip(texts, docs, strict=True):
            if not t:
                yield out(np.frombuffer(d, "<i8").reshape(-1, 3))
                continue
            held = np.frombuffer(d, "<i8").reshape(-1, 2)
            of += [index.setdefault(p, len(index)) for p in unpack(t).split(b"\xff")]
            doc.append(held[:, 0])
            start.append(held[:, 1])
        if not index:
            continue
        item, doc, start = np.array(of), np.concatenate(doc), np.concatenate(start)
        ids = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(ids, item, doc)
        text, first, count, least = smallest_ids(list(index), ids)
        # every occurrence meets the runs of its piece
        lo, hi = np.searchsorted(text, np.arange(len(index))), np.searchsorted(text, np.arange(len(index)), side="right")
        n = (hi - lo)[item]
        occurrence = np.repeat(np.arange(len(item)), n)
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[item][occurrence]
        bad = least[run] < doc[occurrence]
        occurrence, run = occurrence[bad], run[bad]
        begin = start[occurrence] + (first[run].astype(np.int64) << 32)
        if len(begin):
            yield out(np.stack([doc[occurrence], begin, begin + ((count[run].astype(np.int64) + LENGTH - 1) << 32)], axis=1))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes under spans (start, stop)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans.tolist()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def keep_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join(out) + data[at:]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, text (bytes as string), copy (an equal text has a smaller id) and spans, flat starts and stops, unmerged."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    names = known.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), F.octet_length("text").alias("bytes"), F.crc32(F.col("text").cast("binary")).alias("mark"))
    reps = names.groupBy("h1", "h2", "bytes").agg(F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark"))
    reps = settle(reps.where(f"bytes >= {LENGTH}").select("doc_id", "mark", "bytes"))
    total = reps.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(64, 1 << (int(total) // SHARD_BYTES).bit_length())

    wanted = settle(_shared_by_text(known, reps, buckets))
    free(spark)
    spans = settle(_spans(known, wanted, buckets))
    free(spark)
    verdict = reps.join(spans, ["doc_id", "mark"], "left").select("doc_id", "mark", "spans", F.lit(True).alias("rep"))
    out = docs.withColumn("mark", F.crc32(F.col("text").cast("binary"))).join(verdict, ["doc_id", "mark"], "left")
    copy = F.col("rep").isNull() & (F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "text", copy.alias("copy"), "spans")


def _shared_by_text(known: DataFrame, reps: DataFrame, buckets: int) -> DataFrame:
    keyed = known.mapInArrow(lambda x: _key_rows(x, buckets), "bucket long, keys binary, docs binary, shared binary")
    keyed = keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_keys, "doc_id long, key long")
    keyed = keyed.join(reps.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    return keyed.mapInArrow(_pack_keys, "doc_id long, keys binary")


def _spans(known: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    found = known.join(wanted, "doc_id").mapInArrow(lambda x: _piece_rows(x, buckets), "bucket long, pieces binary, docs binary")
    spans = found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shard_spans, "doc_id long, mark long, start long, stop long")
    return spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _pack_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [np.unique(np.array(k, dtype="<i8")).tobytes() for k in b.column("keys").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "keys"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for data, copy, spans in zip(_texts(b), b.column("copy").to_pylist(), b.column("spans").to_pylist(), strict=True):
            cut = [(0, len(data))] if copy else merged(np.array([(s["start"], s["stop"]) for s in spans])) if spans else []
            rows.append((len(data), sum(y - x for x, y in cut), len(cut), hashlib.sha256(keep_bytes(data, cut)).hexdigest()))
        c = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in c[:3]], pa.array(c[3], pa.string())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = repeated_spans(docs, id_col, text_col).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)
