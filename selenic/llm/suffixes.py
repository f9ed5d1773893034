"""Suffix arrays of byte strings by induced sorting, with numpy on whole buckets.

Suffixes are classified as S (smaller than the next suffix) or L. The leftmost S suffixes
(LMS) are sorted by their substrings, named, and the string of names is sorted in turn;
from their order all L suffixes are induced in one pass over the buckets and all S
suffixes in another. A bucket's entries are handled together; only runs of one character
need several rounds.

Orders are exact for the first ``DEPTH`` bytes at least; that bounds the doubling steps over
names, since LMS positions lie two bytes apart or more.
"""

from __future__ import annotations

import numpy as np

DEPTH = 50


def s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the end counts as smallest."""
    cut = np.flatnonzero(t[1:] != t[:-1]) + 1
    starts = np.concatenate([[0], cut])
    char = t[starts]
    up = np.concatenate([char[:-1] < char[1:], [False]])
    return np.repeat(up, np.diff(np.append(starts, len(t))))


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, from LMS suffixes in order (a stable order by first character at least)."""
    n = len(t)
    count = np.bincount(t, minlength=256)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    end = start + count
    sa = np.full(n, -1, dtype=np.int64)
    first = t[lms]
    by_char = np.argsort(first, kind="stable")
    lms = lms[by_char]
    lms_end = np.cumsum(np.bincount(first, minlength=256))
    lms_start = np.concatenate([[0], lms_end[:-1]])
    fill = start.copy()

    def put_left(j: np.ndarray) -> None:
        c = t[j]
        order = np.argsort(c, kind="stable")
        c = c[order]
        k = np.bincount(c, minlength=256)
        offset = np.concatenate([[0], np.cumsum(k)[:-1]])
        sa[fill[c] + np.arange(len(c)) - offset[c]] = j[order]
        fill[:] += k

    put_left(np.array([n - 1]))
    for c in np.flatnonzero(count):
        at = start[c]
        while at < fill[c]:
            j, at = sa[at:fill[c]] - 1, fill[c]
            j = j[j >= 0]
            j = j[~is_s[j]]
            if len(j):
                put_left(j)
        j = lms[lms_start[c]:lms_end[c]] - 1
        if len(j):
            put_left(j)
    left_end = fill.copy()
    fill = end.copy()

    def put_right(j: np.ndarray) -> None:
        c = t[j]
        order = np.argsort(c, kind="stable")
        c = c[order]
        k = np.bincount(c, minlength=256)
        offset = np.concatenate([[0], np.cumsum(k)[:-1]])
        sa[fill[c] - 1 - (np.arange(len(c)) - offset[c])] = j[order]
        fill[:] -= k

    for c in np.flatnonzero(count)[::-1]:
        at = end[c]
        while at > fill[c]:
            j, at = sa[fill[c]:at][::-1] - 1, fill[c]
            j = j[j >= 0]
            j = j[is_s[j]]
            if len(j):
                put_right(j)
        j = sa[start[c]:left_end[c]][::-1] - 1
        j = j[j >= 0]
        j = j[is_s[j]]
        if len(j):
            put_right(j)
    return sa


def words_at(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, zeros beyond the end."""
    padded = np.zeros(len(t) + 8, dtype=np.uint8)
    padded[:len(t)] = t
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(t), 8), (1, 1)).copy().view("<u8").ravel()


def same_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length`` bytes from a and from b are equal."""
    same = np.ones(len(a), dtype=bool)
    live = np.arange(len(a))
    offset = 0
    while len(live):
        left = length[live] - offset
        live, left = live[left > 0], left[left > 0]
        mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        x, y = np.minimum(a[live] + offset, len(words) - 1), np.minimum(b[live] + offset, len(words) - 1)
        ok = ((words[x] ^ words[y]) & mask) == 0
        same[live[~ok]] = False
        live = live[ok]
        offset += 8
    return same


def _name_order(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling."""
    rank, step = names.astype(np.int64), 1
    while True:
        nxt = np.zeros(len(rank), dtype=np.int64)
        nxt[:len(rank) - step] = rank[step:] + 1
        key = rank * (rank.max() + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.zeros(len(rank), dtype=np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, step = new, 2 * step
        if 2 * step > DEPTH or step >= len(rank) or rank[order[-1]] == len(rank) - 1:
            return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of a byte array in order."""
    if not len(t):
        return np.zeros(0, dtype=np.int64)
    is_s = s_types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        sa = _induce(t, is_s, lms)
        mark = np.zeros(len(t), dtype=bool)
        mark[lms] = True
        by_substring = sa[mark[sa]]
        size = np.zeros(len(t), dtype=np.int64)
        size[lms] = np.append(np.diff(lms) + 1, len(t) - lms[-1])
        a, b = by_substring[:-1], by_substring[1:]
        equal = size[a] == size[b]
        at = np.flatnonzero(equal)
        equal[at] = same_bytes(words_at(t), a[at], b[at], size[a[at]])
        equal &= (a != lms[-1]) & (b != lms[-1])
        name = np.zeros(len(t), dtype=np.int64)
        name[by_substring[1:]] = np.cumsum(~equal)
        if name[by_substring[-1]] < len(lms) - 1:
            lms = lms[_name_order(name[lms])]
        else:
            lms = by_substring
    return _induce(t, is_s, lms)


def permuted_common(t: np.ndarray, order: np.ndarray, length: int = DEPTH) -> np.ndarray:
    """For each entry of a suffix order: whether it shares ``length`` bytes with the entry before it."""
    out = np.zeros(len(order), dtype=bool)
    if len(order) > 1:
        out[1:] = same_bytes(words_at(t), order[:-1], order[1:], np.full(len(order) - 1, length))
    return out
