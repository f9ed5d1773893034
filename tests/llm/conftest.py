import random

import pytest

# Words of two invented languages, and what tables may hold besides plain prose.
A, B = ["tan", "rel", "osti", "hend", "alor", "sibe", "thon", "wer"], ["qui", "vexa", "lué", "fôra", "jin", "pol", "zeu", "ñac"]


def prose(seed: int, n: int, words=A) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(words, k=r.randint(1, 3))) for _ in range(n))


def edge_texts() -> list[str | None]:
    long = prose(1, 30_000)
    base = prose(2, 120)
    near = base.split()
    near[60] = "changed"
    return [None, "", " \n\t ", "a", "word", "...", "1234 5678", base, base, base, " ".join(near), base + " " + prose(3, 9), long, long + " tail",
            prose(4, 60, B), prose(4, 60, B).upper(), "x" * 20_000, "ab" * 9_000, "  two  spaces \n\n and\r\nbreaks ", "İstanbul ǅ ﬁ ½ ß 日本語 \U0001f600",
            "<s> <|endoftext|> <0x0A> ▁x", prose(5, 200) + "\n" + base, base + "\n" + prose(6, 200), "one two three four", "one two three four five"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge cases with a repeated row, a null id and columns whose names the operators use inside."""
    rows = [(i, t, "aa" if i % 3 else None, "s", None if t is None else len(t), "x", 1, "y") for i, t in enumerate(edge_texts())]
    rows += [(7, edge_texts()[7], "aa", "s", 1, "x", 1, "y"), (None, "null id", "aa", "s", 1, "x", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component string, n int, label string")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
