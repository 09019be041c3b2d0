import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from rowproof.llm import toxicity as tox


def test_segments_equal_definition():
    r = random.Random(1)
    for _ in range(200):
        x = [r.choice([-0.125, -0.125, -1.5, 0.25, 1.0, 0.1875, -0.5]) for _ in range(r.randint(0, 40))]
        at = [i for i, v in enumerate(x) if v > 0]
        before = [sum(x[:i]) for i in at]
        got = sorted((s, e) for s, e, _ in tox.segments(at, before, [b + x[i] for b, i in zip(before, at, strict=True)]))
        score = lambda spans: sorted(round(sum(x[s:e]), 6) for s, e in spans)
        assert score(got) == score(maximal(x, 0, len(x)))


def maximal(x, lo, hi):
    """The definition: the best segment, then both sides of it."""
    best = None
    for s in range(lo, hi):
        total = 0.0
        for e in range(s, hi):
            total += x[e]
            if total > 1e-12 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) <= 1e-9 and e + 1 - s < best[2] - best[1])):
                best = (total, s, e + 1)
    return [] if best is None else [*maximal(x, lo, best[1]), (best[1], best[2]), *maximal(x, best[2], hi)]


def test_extreme_values_and_scores_by_brute_force(spark):
    rows = data(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = tox.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert (model.weights < 0).any() or (model.weights > 0).any()
    found = [(5, [0.5, 1.25, 2.0, 0.25]), (100, [0.5] * 6), (7, []), (0, [3.0, 1.0])]
    lam, k = tox.extreme_values(spark.createDataFrame(found, "n long, found array<double>"))
    s = sorted(x for _, f in found for x in f)
    tail = [x for x in s if x > np.median(s)]
    assert lam == 1 / np.mean([x - np.median(s) for x in tail]) and abs(k - (len(tail) + 1) / 112 * math.exp(lam * np.median(s))) < 1e-12

    def word_score(w):
        ws = [float(model.weights[b]) for b in tox.features(w)]
        return max(ws, key=abs) - tox.DRIFT

    got = {r.doc_id: r for r in tox.scored(docs, model).collect()}
    for i, text, _ in rows[:40]:
        x = [word_score(w) for w in text.split()]
        spans = maximal(x, 0, len(x))
        values = [sum(x[s:e]) for s, e in spans]
        normal = [max(-12.0, model.lam * v - math.log(model.k * len(x) + 1e-12)) for v in values]
        sure = [(s, e) for (s, e), v in zip(spans, values, strict=True) if v > (math.log(model.k * len(x) + 1e-12) - math.log(tox.SIGNIFICANT)) / model.lam]
        assert sorted((s.start, s.end) for s in got[i].segments) == sorted(sure)
        evidence = [1.0, max(normal, default=-12.0) / 4, math.log1p(sum(max(0, v) for v in normal)), math.log1p(sum(v > -math.log(tox.SIGNIFICANT) for v in normal)), math.log1p(max(values, default=0.0)), math.log1p(sum(values)) - 0.5 * math.log1p(len(x) / 100)]
        z = sum(a * b for a, b in zip(model.coefficients, evidence, strict=True))
        assert abs(got[i].score - 1 / (1 + math.exp(-max(-35, min(35, z))))) < 1e-9


def test_equal_texts_with_different_labels(spark):
    rows = data(200)
    docs = spark.createDataFrame([(i + 1000 * c, t) for i, t, _ in rows for c in (0, 1)], "doc_id long, text string")
    labels = spark.createDataFrame([(i + 1000 * c, y * c) for i, _, y in rows for c in (0, 1)], "doc_id long, toxic int")
    a, b = tox.fit(docs.repartition(5), labels), tox.fit(docs.repartition(2, "text"), labels.repartition(3))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.coefficients, b.coefficients)


def data(n=600):
    r = random.Random(3)
    clean = ["".join(r.choice(["ta", "lo", "mi", "re", "su", "ka"]) for _ in range(r.randint(1, 4))) for _ in range(500)]
    rude = ["grubnok", "zzvile", "hatewort", "scumble"]
    rows = []
    for i in range(n):
        w = [r.choice(clean) for _ in range(r.randint(5, 300))]
        toxic = int(i % 6 == 0)
        if toxic:
            p = r.randrange(len(w))
            w[p:p] = [r.choice(rude + clean[:2]) for _ in range(6)]
        rows.append((i, " ".join(w), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = data()
    docs = spark.createDataFrame([(i, t, 0.5, "clash") for i, t, _ in rows] + [(9000, None, 0.5, ""), (9001, "", 0.5, ""), (0, rows[0][1], 0.5, "")], "doc_id long, text string, score double, n_words string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (77777, 1)], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    got = [(r.doc_id, r.score) for r in tox.scored(docs, model).collect()]
    assert len(got) == len(rows) + 3
    assert all(0 <= s <= 1 for _, s in got)
    held = {i: y for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    by = dict(got)
    right = np.mean([(by[i] >= 0.7) == bool(y) for i, y in held.items()])
    assert right > 0.95
    assert by[9000] < 0.5 and by[9001] < 0.5
    assert {r.doc_id for r in tox.clean(docs, model).select("doc_id").collect()} == {i for i, s in got if s < 0.7}


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = data(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    a = tox.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = tox.fit(docs, spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, _, y in rows], "doc_id long, toxic int"))
    assert np.array_equal(a.weights, b.weights) and np.allclose(a.coefficients, b.coefficients)


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.scored(docs, tox.fit(docs, labels)).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.score < 1e-9 for r in tox.scored(some, tox.fit(some, labels)).collect()] == [True]


def test_query_on_given_labels(spark):
    d = "/root/testdata/sf0.1"
    y = spark.read.parquet(f"{d}/labels.parquet")
    got = tox.op1_toxicity(spark, d).join(y, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    hit = sum(r.predicted for r in got if r.toxic) / max(1, sum(r.toxic for r in got))
    wrong = sum(r.predicted for r in got if not r.toxic) / max(1, sum(1 - r.toxic for r in got))
    s = np.array([r.score for r in got])
    t = np.array([r.toxic for r in got])
    auc = (s[t == 1][:, None] > s[t == 0][None, :]).mean() + 0.5 * (s[t == 1][:, None] == s[t == 0][None, :]).mean()
    print("held out: recall", hit, "false positives", wrong, "auc", auc)
    assert hit > 0.85 and wrong < 0.02 and auc > 0.95 and math.isfinite(auc)
