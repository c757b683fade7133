import random

import pytest

ODD = [
    None, "", " ", "\n\t ", "a", "123 456", "same text", "same text", "Ünïcödé straße ☃ 🎉", "x " * 3000, "word " * 60, "tab\tnew\nline\r\x0b\x0cend", "    lots   of    blanks  ", "<s> </s> <0x41> ▁ ▁▁", "日本語 のテキスト", "nul \x00 byte",
]


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): odd texts, prose, exact and near copies, shared passages, copies within a text, a very long text."""
    texts = list(ODD)
    passage = " ".join(prose(1, 120))
    for k in range(30):
        words = prose(100 + k, 40 + 17 * k)
        texts.append(" ".join(words))
        if k % 3 == 0:
            texts.append(" ".join(words))
        if k % 4 == 0:
            near = list(words)
            for i in range(0, len(near), 60):
                near[i] = "Changed"
            texts.append(" ".join(near))
        if k % 5 == 0:
            texts.append(" ".join(words[:30] + [passage] + words[30:]))
    base = prose(7, 90)
    for k in range(40):  # a large group of near copies
        texts.append(" ".join(base[: 88 - k % 3] + [f"tail{k}"]))
    texts.append(" ".join(prose(9, 100) * 3))
    texts.append(" ".join(prose(11, 20000, 10**9)))
    texts.append("To " * 700)
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names operators use themselves, and one row twice."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s0", "S2", None][i % 4], i, "d") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, digest string").repartition(5)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
