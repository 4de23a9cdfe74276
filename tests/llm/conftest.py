from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id_ string, key_ string, w string, fp string, hits string, h string, kept_ string, left_ string, cut string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def rows(texts):
    return [(i, t, "en", "s", None if t is None else len(t), *["clash"] * 9) for i, t in texts]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, clashing names."""
    rng = random.Random(3)
    long = "\n".join(" ".join(words(rng, 40)) for _ in range(500))
    plain = " ".join(words(rng, 90))
    texts = [(1, None), (2, ""), (3, " \t\n\r\v\f \n"), (4, "one"), (5, long), (6, plain), (6, plain), (7, plain), (8, "É\u00a0ü 漢字 \x00 <|endoftext|> x"), (None, plain), (None, None), (6, "another text under the same id")]
    return spark.createDataFrame(rows(texts) + [(9, *[None] * 13)], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with copies, near copies, repeated lines and shared passages."""
    rng = random.Random(11)
    passage = words(rng, 60)
    line = " ".join(words(rng, 9))
    texts = []
    for i in range(60):
        lines = [" ".join(words(rng, rng.randrange(3, 25))) for _ in range(rng.randrange(1, 7))]
        if i % 5 == 0:
            lines.insert(rng.randrange(len(lines) + 1), " ".join(passage))
        if i % 4 == 0:
            lines.append(line if i % 8 else line[:-1])
        if i % 6 == 0:
            lines.append(line[:7] + "Q" + line[7:])
        texts.append((i, "\n".join(lines)))
    for i in range(60, 75):
        source = texts[rng.randrange(60)][1]
        at = rng.randrange(len(source))
        texts.append((i, source if i % 3 else source[:at] + "z" + source[at + 1 :]))
    return spark.createDataFrame(rows(texts), SCHEMA)
