import random
import re
import zlib
from collections import Counter

import pytest

from rowproof.llm import spelling


def variants_of(word, letters):
    for k in range(len(word) + 1):
        if k < len(word):
            yield word[:k] + word[k + 1 :]
        for c in letters:
            yield word[:k] + c + word[k:]
            if k < len(word):
                yield word[:k] + c + word[k + 1 :]


def brute(rows, spoil=0, least=5, times=5):
    """Word counts and near words by making all words that are one edit away."""
    n = Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{i}:{word}".encode())
            if spoil and i is not None and h % spoil == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    letters = sorted({c for w in n for c in w})
    near = {w: {v for v in variants_of(w, letters) if v in n and v != w} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdeinrstéß×") for _ in range(rng.randrange(5, 10))) for _ in range(150)]
    words = base + [w[:k] + rng.choice("abnxÉ") + w[k + rng.randrange(2) :] for w in base for k in (1, 4)] + [w[:3] + w[4:] for w in base]
    words += ["aaaaaa", "aaaaaaa", "aaaaab", "aaaaba", "aaabaa", "baaaaa", "abcdef", "fedcba", "abcdeff"]
    times = [1, 4, 5, 6, 25, 26, 130, 650]
    text = [w for w in words for _ in range(rng.choice(times))]
    rng.shuffle(text)
    out = [(k, ", ".join(text[k * 700 : (k + 1) * 700])) for k in range(len(text) // 700 + 1)]
    return out + [(900, None), (901, ""), (902, "UPPERCASE uppercase UpperCase ÉCOLES écoles " * 9), (902, "uppercase " * 7), (None, "nameless " * 8 + "namelesss " * 300), (903, "w" * 100_000 + " 12 " + "short x " * 50), (904, "word_with-marks3inside " * 20 + "ĀĀĀ Łódzkie")]


@pytest.mark.parametrize(("shard", "spoil"), [(2048, 199), (40, 3), (2, 0)])
def test_equals_brute_force(spark, shard, spoil):
    data = rows()
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in data], "doc_id long, text string, word string, n int").repartition(5)
    got = sorted(tuple(r) for r in spelling.variants(df, spoil=spoil, shard=shard).collect())
    assert got == brute(data, spoil)
    assert sum(r[1] is not None for r in got) > 50 and len({r[2] for r in got if r[1] is not None and r[1] != r[2]}) > 0


def test_few_words_are_counted_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 3)
    data = rows()[:4]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {(r.word, r.n) for r in spelling.counts(df).collect()} == {(w, n) for w, _, _, n, _, _ in brute(data, least=1)}


def test_budget():
    """All near words are within the budget, and `smaller` finds each such vector from one side."""
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9)))
        other = rng.choice(list(variants_of(word, "eazß")))
        assert spelling.near(word, other) == (word != other)
        a, b = (tuple(spelling.vector(w)[:5]) for w in (word, other))
        assert a == b or a in spelling.smaller(b) or b in spelling.smaller(a)
    assert not spelling.near("abcdef", "abdcef") and not spelling.near("abc", "abcde") and not spelling.near("abc", "xbcd")


def test_empty_table_and_given_documents(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in spelling.op11_spelling_variants(spark, d).collect()) == brute(docs, 199)
