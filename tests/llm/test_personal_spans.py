"""All spans of personal data against a plain loop over the texts."""

from collections import Counter

import numpy as np

from selenic.llm import pii


def plain(texts):
    """Spans by the whole model fitted in one process."""
    counts = Counter((tuple(v), tuple(f)) for t in texts for _, _, v, f in pii.scan(t or "")[1])
    keys = sorted(counts)
    votes, x = np.array([k[0] for k in keys]), np.array([k[1] for k in keys], float)
    n = np.array([counts[k] for k in keys], float)
    w = pii.train_logistic(x, pii.expectation_maximisation(votes, n), n)
    return [",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(pii.all_spans(t or "", list(w)))) for t in texts]


def test_spans_equal_the_plain_loop(spark):
    """Short candidates vote too; keys are found, numbers and plain words with digits are not."""
    rng = np.random.default_rng(9)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    texts = [f"see 12 of item{i % 7} in 2024-01-0{i % 9} b2" for i in range(60)] + [f"api_key: {key()} for host 10.0.0.{i}" for i in range(30)]
    texts += [None, "", "a1", "x9 " * 500, texts[0], "write to someone@example.org or +44 20 7946 0958"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(docs)).collect()}
    want = plain(texts)
    assert got == dict(enumerate(want))
    assert all("secret" in want[i] and "ip" in want[i] for i in range(60, 90))
    assert all("secret" not in s for i, s in enumerate(want) if not 60 <= i < 90)


def test_candidates_of_any_length():
    assert [(a, b) for a, b, _, _ in pii.scan("b2 and x9y, not ab")[1]] == [(0, 2), (7, 10)]
