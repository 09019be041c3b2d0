import hashlib
import random

import pytest

from rowproof.llm import run_length as rl


def brute(rows, length=rl.LENGTH):
    """rows: (doc_id, text), distinct ids -> {doc_id: removed spans}."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                covered[i : i + length] = b"\1" * length
            else:
                seen.add(s)
        spans, i = [], 0
        while i < len(b):
            if covered[i]:
                j = i
                while j < len(b) and covered[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out[doc_id] = spans
    return out


def words(r, n):
    return " ".join(r.choice(["alpha", "béta", "gamma", "delta", "eps", "zeta", "eta😀", "theta"]) + str(r.randint(0, 40)) for _ in range(n))


def rows():
    r = random.Random(4)
    passage, line = words(r, 60), words(r, 18)
    out = [(i, words(r, r.randint(0, 120))) for i in range(0, 60, 2)]
    out += [(i, words(r, 20) + passage + words(r, 30)) for i in range(1, 31, 2)]
    out += [(100 + i, out[i][1]) for i in range(10)]
    out += [(200 + i, line + "\n" + words(r, 10) + "\n" + line) for i in range(5)]
    out += [(300, None), (301, ""), (302, "a" * 700), (303, "ab" * 400), (304, "x" * 99), (305, "x" * 99), (306, passage[:99]), (None, passage[10:220])]
    base = words(r, 100).split()
    for i in range(8):
        near = list(base)
        near[r.randrange(len(near))] = "changed"
        out.append((400 + i, " ".join(near)))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(rl, "GROUP", group)
    data = rows()
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in data], "doc_id long, text string, start int, h string").repartition(3)
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in rl.spans(df).collect()}
    assert got == brute(data)


def test_index_ranks_and_matches():
    """Against sorted suffixes, terminators smaller than any byte and in text order."""
    r = random.Random(3)
    contexts = [bytes(r.choice(b"ab\0\xff") for _ in range(r.randint(1, 40))) for _ in range(12)] + [b"abab" * 9, b"abab" * 8, b"a"]
    index = rl.RunLengthIndex(contexts)
    suffixes, at = [], 0
    for number, c in enumerate(contexts):
        suffixes += [([x + len(contexts) for x in c[i:]] + [number], at + i) for i in range(len(c) + 1)]
        at += len(c) + 1
    order = [p for _, p in sorted(suffixes)]
    symbols = dict((p, s) for s, p in suffixes)
    common = lambda x, y: next(i for i in range(len(x)) if x[i] != y[i])
    match = {q: common(symbols[p], symbols[q]) for p, q in zip(order, order[1:], strict=False)} | {order[0]: 0}
    assert index.matches().tolist() == [match[p] for p in range(at)]
    places, ranks = index.ranks(3)
    assert sorted(places.tolist()) == [p for p in range(at) if len(symbols[p]) > 3]
    assert [order[k] for k in ranks.tolist()] == places.tolist()
    assert index.runs < at


def test_repeated_rows_and_empty_table(spark):
    t = words(random.Random(1), 40)
    df = spark.createDataFrame([(2, t), (2, t), (1, t)], "doc_id long, text string")
    got = sorted((r.doc_id, len(r.kept)) for r in rl.spans(df).collect())
    assert got == [(1, len(t.encode())), (2, 0), (2, 0)]
    assert rl.spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(rl, "SEGMENT", 1000)
    r = random.Random(8)
    a = words(r, 900)
    data = [(1, a), (2, words(r, 300) + a[700:5000] + words(r, 300))]
    got = {r_.doc_id: [(s.start, s.end) for s in r_.removed] for r_ in rl.spans(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute(data)


def test_query_digest(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    expected = brute(texts.items())
    got = rl.op2_run_length(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        b, s = texts[r.doc_id].encode(), expected[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), sum(y - x for x, y in s), len(s))
        assert r.kept_sha256 == hashlib.sha256(rl.kept(b, s)).hexdigest()
