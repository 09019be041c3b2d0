import random
import re

import pytest

from rowproof.llm import minhash
from rowproof.llm.components import components


def brute(rows, k, percent=80):
    """{doc_id: (n, component)} with full pairwise comparison; ids are distinct."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def words(r, n):
    return [r.choice("abcdefghij") + r.choice("klmnopqrst") + str(r.randint(0, 30)) for _ in range(n)]


def rows():
    r = random.Random(2)
    out = [(i, " ".join(words(r, r.randint(1, 60)))) for i in range(40)]
    base = words(r, 120)
    for i in range(30):
        near = list(base)
        for _ in range(r.randint(0, 9)):
            near[r.randrange(len(near))] = words(r, 1)[0]
        out.append((100 + i, " ".join(near)))
    chain = words(r, 80)
    for i in range(12):  # neighbours are alike, ends are not
        chain = list(chain)
        for j in range(3):
            chain[(5 * i + j) % 80] = words(r, 1)[0]
        out.append((200 + i, " ".join(chain)))
    out += [(300, None), (301, ""), (302, "One"), (303, "oNE"), (304, "one two"), (305, "ÉA b"), (306, "éa b"), (307, " \t\x0b "), (308, out[3][1].upper()), (309, "one two")]
    return out


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("block", [1000, 4])
def test_equals_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 60 * block)
    data = rows()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in data], "doc_id long, text string, node string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, k=k).collect()}
    assert got == brute(data, k)


def test_edges(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(False, None, None, True), (True, 4, 4, True), (True, 4, 4, True), (True, 9, 4, False)]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(40)] + [(700, 700 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    expected = {x: find(x) for x in parent if find(x) != x}
    got = {r_.node: r_.component for r_ in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
