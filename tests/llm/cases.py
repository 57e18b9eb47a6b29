from __future__ import annotations

import random
import re

import pytest

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Columns of documents, and some whose names operators use inside.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, hash int, content string, size int,"
    " class string, part int, doc string, target double, body string, block int, id int, n int,"
    " label string, copies int, `a.b` int, prefix string, bits string, line string, pos int"
)
EXTRA = SCHEMA.count(",") - 3


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def documents() -> list[tuple]:
    """Copies, near copies, shared passages and lines, nulls, empty and long texts, twins."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé Ωß".replace(" ", ""), k=rng.randint(1, 7))) for _ in range(900)]

    def prose(n: int) -> list[str]:
        return rng.choices(vocabulary, k=n)

    texts: list[str | None] = [None, None, "", "", " \t\n", "\n\n", "one", "Two words", "two WORDS", "ß 1 !"]
    base = prose(120)
    for k in range(30):  # a chain of near copies: the ends are unlike each other
        base = base.copy()
        for at in rng.sample(range(len(base)), 1):
            base[at] = f"x{k}"
        texts.append(" ".join(base))
    passage = " ".join(prose(60))
    line = "The same Line of more than forty letters, Ever and ever"
    for k in range(25):
        words = " ".join(prose(rng.randint(3, 90)))
        texts.append(f"{words} {passage}\n  {line.upper() if k % 2 else line}\t\n{' '.join(prose(9))}")
    texts += [" ".join(prose(40))] * 9 + [f"{line}\n{line}\nshort\nshort"] * 2
    texts += [" ".join(prose(rng.randint(1, 60))) for _ in range(25)]
    texts += [" ".join(prose(6000)), " ".join(["again"] * 200), "x" * 3000, "a\x0bb\x0cc\rd"]
    rows = [(k, t, "aa", f"s{k % 4}" if k % 7 else None) for k, t in enumerate(texts)]
    rows += [rows[12], rows[12], rows[0], (None, "no id", None, None), (None, texts[12], None, "s1")]
    rows += [(None, None, None, None), (20, "another text of the same id", "bb", "é")]
    return [r + (None,) * EXTRA for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])
