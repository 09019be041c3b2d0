import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowproof.llm import periodic


def brute(words, least=12):
    """All runs by definition: each lag, each stretch, kept if no smaller period fits it."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(least, 2 * q) and not any(all(words[k] == words[k + d] for k in range(start, end - d)) for d in range(1, q)):
                out.append((start, end - start, q))
            i = j
    return sorted(out)


def structured(rng, depth=0):
    """Words nested by repetition, with flaws: runs of many periods that meet, overlap and are cut."""
    if depth == 4 or rng.random() < 0.2:
        return [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
    part = structured(rng, depth + 1)
    out = part * rng.choice([1, 2, 2, 3, 5])
    out = out[: rng.randrange(max(1, len(out) // 2), len(out) + 1)]
    return out + structured(rng, depth + 1) if rng.random() < 0.6 else out


@pytest.mark.parametrize("scale", [4, 16])
def test_equals_brute_force(scale, monkeypatch):
    """scale 4 sends periods from 8 on through minimizers (runs and small runs as short as 4 words count there)."""
    if scale == 4:
        monkeypatch.setattr(periodic, "GRAM", 2)
    rng = random.Random(scale)
    least = 12 if scale == 16 else 1
    longest = 0
    for k in range(260):
        words = (structured(rng) * (1 + k % 3))[: 420 if k % 9 else 900]
        if k % 4 == 0:
            half = len(words) // 2
            words = words[:half] + [99] + words[:half] + [98]
        got = periodic.runs(np.array(words), least=least, scale=scale)
        assert got == brute(words, least), (k, words)
        longest = max([longest, *(q for _, _, q in got)])
    assert longest > 100


@pytest.mark.parametrize("make", [lambda m: ["x", "y"] * m + ["x"] + ["x", "y"] * m, lambda m: (["a"] * m + ["b"]) * 2, lambda m: ["a"] * m + ["b"] * m + ["a"] * m + ["b"] * m + ["c"], lambda m: list("abcabcab") * m + list("cabcab") * m, lambda m: ["w"] * (6 * m), lambda m: (list(range(5 * m)) * 3)[2 : 11 * m]])
def test_small_runs_inside_long_periods(make):
    numbers = {}
    for m in (20, 33, 64, 100):
        words = [numbers.setdefault(x, len(numbers)) for x in make(m)]
        assert periodic.runs(np.array(words)) == brute(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=30, max_size=70), st.integers(1, 6))
def test_binary_words(words, times):
    words = words * times
    assert periodic.runs(np.array(words)) == brute(words)


def rows():
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(200)}" for _ in range(n))
    out = [(i, prose(rng.randrange(0, 300))) for i in range(120)]
    line = prose(90)
    out += [(200, None), (201, ""), (202, " \t\n "), (203, "a b " * 30), (204, "\x1c x" * 12), (205, (line + "\n") * 7 + "end"), (206, f"{line} {line} x {line}"), (205, "other text"), (205, "other text"), (None, "z " * 40), (-7, "y " * 13)]
    return out


def expected(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
    found = brute(words)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (i, len(found), *longest, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    data = rows()
    spark.createDataFrame([(i, t, 9, 1) for i, t in data], "doc_id long, text string, period int, n_runs int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for together in (periodic.TOGETHER, 500):
        monkeypatch.setattr(periodic, "TOGETHER", together)
        got = [tuple(r) for r in periodic.op12_periodic_runs(spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted((expected(i, t) for i, t in data), key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_given_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in periodic.op12_periodic_runs(spark, d).collect()}
    short = [r for r in docs if len((r.text or "").split()) < 400]
    assert len(got) == len(docs) and len(short) > 100
    assert all(got[r.doc_id] == expected(r.doc_id, r.text) for r in short)


def test_empty_table_and_long_text(spark):
    schema = "doc_id long, text string"
    assert periodic.periodic_runs(spark.createDataFrame([], schema)).count() == 0
    got = periodic.periodic_runs(spark.createDataFrame([(1, "x y " * 60_000 + "x " + "x y " * 2_000)], schema)).first()
    assert (got.start, got.length, got.period) == (0, 120_001, 2) and got.n_runs > 900


def test_seeds_stay_few():
    """Words of one value, nested repeats and noise: the seeds that are extended are few for each word."""
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 50_000, 20_000)
    for words in (np.zeros(20_000, np.int64), np.tile(noise[:37], 540), np.tile(np.concatenate((noise[:300], np.tile(noise[:5], 80))), 30), noise):
        tried = []
        whole, periodic.extended = periodic.extended, lambda *a: tried.append(a[2]) or whole(*a)  # noqa: B023
        try:
            periodic.runs(words)
        finally:
            periodic.extended = whole
        assert len(tried) < len(words) / 4
