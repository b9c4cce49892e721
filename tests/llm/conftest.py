from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk long, blob string, score double, base int"


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return ["".join(chr(97 + (k * 7 + j * j) % 26) for j in range(2 + k % 6)) + str(k) for k in (min(int(rng.paretovariate(0.9)), size) for _ in range(n))]


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Documents with copies, near copies, shared passages, edges of all kinds, and columns whose names clash."""
    rng = random.Random(42)
    texts: list[str | None] = [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(60)]
    base = words(rng, 150, 5000)
    passage = " ".join(words(rng, 60, 9000))
    for k in range(12):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(near))
    for _ in range(6):
        texts.append(" ".join(words(rng, 30)) + "\n" + passage + "\t" + " ".join(words(rng, 30)))
    texts += [texts[0], texts[1], texts[1], texts[70], None, None, "", " \t\n\x0b", "one", "One", "ONE two", "one TWO", "a b", "ß É 中文 😀 é", "x" * 5000, " ".join(["same"] * 300), " ".join(words(rng, 6000)), "\x1c a\x85b c  d\n\n e", passage]
    out = [(i, t, "en", "s", len(t or ""), i * 3, "b", 0.5, 1) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, "null id here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (3, "another text of document three", "en", "s", 3, 0, "b", 0.0, 0)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
