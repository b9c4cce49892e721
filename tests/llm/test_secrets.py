"""Secret scans: the battery against a plain version, planted tokens by alphabet and length, long texts, clashing names."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prismtab.llm import secrets

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")


def tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def fisher(ps: list[float]) -> float:
    h = -sum(math.log(max(1e-300, min(1.0, p))) for p in ps)
    return min(1.0, math.exp(-h) * sum(h**j / math.factorial(j) for j in range(len(ps))))


def battery(token: str) -> tuple[str, float, float]:
    """encoding, p_random, p_text, straight from the definitions."""
    name, letters, sort, rho, change = next(e for e in secrets.ENCODINGS if set(token) <= set(e[1]))
    m, n = len(letters), len(token)
    at = [letters.index(c) + 1 for c in token]
    chi2 = sum((k - n / m) ** 2 / (n / m) for k in Counter(at).values()) + (m - len(set(at))) * n / m
    middle = (m + 1) / 2
    high = [a > middle for a in at]
    halves = sum(a != b for a, b in zip(high, high[1:], strict=False))
    serial = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:], strict=False)) / ((m * m - 1) / 12) / math.sqrt(n - 1)
    cube = ((chi2 / (m - 1)) ** (1 / 3) - (1 - 2 / (9 * (m - 1)))) / math.sqrt(2 / (9 * (m - 1)))
    h, low = sum(high), n - sum(high)
    if h and low:
        e = 2 * h * low / n + 1
        p_runs = 2 * tail(abs(halves + 1 - e) / math.sqrt(max(1e-9, (e - 1) * (e - 2) / (n - 1))))
    else:
        p_runs = 0.5 ** (n - 1)
    p_random = fisher([tail(cube), p_runs, 2 * tail(abs(serial))])
    kind = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "+" for c in token]
    changes = halves if sort != secrets.MIXED else sum(a != b for a, b in zip(kind, kind[1:], strict=False))
    s2, s3 = secrets.SAME2[sort], secrets.SAME3[sort]
    mean = m * (1 + (n - 1) * s2) - n
    spread = m / n * math.sqrt(2 * n * (n - 1) * (s2 - s2 * s2) + 4 * n * (n - 1) * (n - 2) * (s3 - s2 * s2))
    p_text = fisher([tail(-(chi2 - mean) / spread), tail((changes - 0.5 - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change))), tail(-(serial - rho * math.sqrt(n - 1)))])
    return name, p_random, p_text


def made(rng: random.Random, letters: str, n: int) -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def test_battery_is_what_its_definitions_say(spark):
    rng = random.Random(4)
    tokens = [made(rng, e[1], n) for e in secrets.ENCODINGS for n in (16, 33, 150)] + ["a" * 20, "antidisestablishmentarianism", "thisIsACamelCaseNameOfAThing", "0" * 40, "1234567890" * 3, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "internal-server-error_500"]
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(tokens)], "doc_id long, text string")
    got = {r["doc_id"]: r["t"] for r in secrets.scanned(df).select("doc_id", F.explode("__tokens").alias("t")).collect()}
    assert set(got) == set(range(len(tokens)))
    for i, t in enumerate(tokens):
        name, p_random, p_text = battery(t)
        assert got[i]["encoding"] == name
        assert (got[i]["p_random"], got[i]["p_text"]) == (pytest.approx(p_random, rel=1e-4, abs=1e-9), pytest.approx(p_text, rel=1e-4, abs=1e-12)), t


def test_threshold_is_step_up_control(spark):
    """The p-values that count are those of the plain step-up rule over classes of p-values."""
    rng = random.Random(5)
    rows = [(c, rng.randrange(0, 30) if rng.random() < 0.9 else rng.randrange(60, 300)) for c in (0, 1, 102, 203) for _ in range(rng.randrange(5, 400))]
    got = secrets.thresholds(spark.createDataFrame(rows, "cls int, level int"))
    for cls in {c for c, _ in rows}:
        levels = [lv for c, lv in rows if c == cls]
        ok = [lv for lv in set(levels) if 10 ** (-lv / secrets.PER_TEN) <= sum(x >= lv for x in levels) / len(levels) * secrets.RATE]
        assert got.get(cls) == (min(ok) if ok else None)


#: Of 200 planted tokens of each alphabet and length among 2800 documents, the share that is found at least. Letters of one case look
#: like text unless they are many; digits and small hexadecimals of 24 letters and more are known shapes already.
PLANTED = {("base62", 16): 0.85, ("base62", 40): 0.9, ("base64", 24): 0.9, ("UPPER36", 32): 0.6, ("decimal", 23): 0.3, ("HEX", 40): 0.85, ("base32", 40): 0.7}


def test_planted_tokens(spark):
    rng = random.Random(31)
    plain = ["Donaudampfschifffahrtsgesellschaft", "internationalization", "this_is_a_long_function_name_here", "aaaaaaaaaaaaaaaaaaaaaa", "getElementByIdOrThrowError", "AbstractSingletonProxyFactoryBean", "2024-01-01-00-00-00-000", "00000000000000000000"]
    rows = [(i, f"some words {rng.choice(plain)} and more {rng.choice(plain)}") for i in range(2800)]
    at = {}
    for k, (name, n) in enumerate(PLANTED):
        letters = next(e[1] for e in secrets.ENCODINGS if e[0] == name)
        at[name, n] = range(10_000 * (k + 1), 10_000 * (k + 1) + 200)
        rows += [(i, f"key {made(rng, letters, n)} end") for i in at[name, n]]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i]["n_random"] > 0 for i in range(2800)) == 0
    share = {k: sum(got[i]["spans"] == f"random:4:{4 + k[1]}" for i in ids) / 200 for k, ids in at.items()}
    assert all(share[k] >= least for k, least in PLANTED.items()), share


def test_letters_of_one_case_are_found_when_they_are_many(spark):
    """Random small letters are told from text by their counts alone: not at 40 letters, mostly at 400."""
    rng = random.Random(2)
    rows = [(1000 * n + i, f"a {'internationalization' * (n // 20)} b") for n in (40, 400) for i in range(50)]
    rows += [(1000 * n + 100 + i, f"key {made(rng, 'abcdefghijklmnopqrstuvwxyz', n)} end") for n in (40, 400) for i in range(50)]
    got = {r["doc_id"]: r["n_random"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[1000 * n + i] for n in (40, 400) for i in range(50)) == 0
    found = {n: sum(got[1000 * n + 100 + i] for i in range(50)) for n in (40, 400)}
    assert found[40] < 10 and found[400] > 40


def test_many_matches_in_one_text_take_time_in_proportion(spark):
    took = {}
    for n in (1_000, 8_000):
        text = "token=abcdef12 word " * n
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        r = secrets.scan(df).first()
        assert r["n_assign"] == n
        out = secrets.redacted(df).first()["text"]
        took[n] = time.perf_counter() - began
        assert out == "[secret] word " * n
    assert took[8_000] < 16 * took[1_000] + 5


def test_columns_of_any_name_stay(spark):
    columns = "doc_id long, text string, __base string, __tokens int, __spans double, c0 string, __chars int, __text string"
    df = spark.createDataFrame([(1, "é token=abcdef12 ü", "a", 1, 0.5, "x", 2, "y"), (None, None, None, None, None, None, None, None)], columns)
    out = secrets.redacted(df)
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == {(1, "é [secret] ü", "a", 1, 0.5, "x", 2, "y"), (None,) * 8}
