"""Repeated strings of ids that hold several texts, against a plain version."""

import hashlib
import random

from selenic.llm import repeats


def plain(rows):
    """The digest of each row; a text's own id never removes from it."""
    first: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for k in range(len(t) - 49):
            if i is not None:
                first[t[k:k + 50]] = min(i, first.get(t[k:k + 50], i))
    out = []
    for i, t in data:
        bad = [False] * len(t)
        for k in range(len(t) - 49):
            if i is not None and first[t[k:k + 50]] < i:
                bad[k:k + 50] = [True] * 50
        kept = bytes(b for b, x in zip(t, bad, strict=True) if not x)
        runs = sum(x and not (k and bad[k - 1]) for k, x in enumerate(bad))
        out.append((i, len(t), sum(bad), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_one_id_with_several_texts(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared, other = word(90), word(70)
    rows = [(1, word(60) + shared + word(40)), (5, word(30) + shared + word(80)), (5, other + word(55)), (3, other + word(20)),
            (5, word(120)), (7, shared), (7, other), (7, shared), (9, word(50)), (9, None), (2, word(49)), (None, shared + word(9))]
    rows += [(4, rows[1][1]), (6, rows[2][1])]
    for order in (rows, rows[::-1]):
        got = repeats.remove_repeats(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
