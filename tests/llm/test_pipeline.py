"""Each stage against plain Python on the smallest tables, and on awkward rows."""

import random

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as cp
from rowproof.llm import minhash
from rowproof.llm.common import numbered, picked, settings
from rowproof.llm.words import load

D = "/root/testdata/sf0.001"


def docs(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["ta", "lo", "mi", "re", "su"]) for _ in range(3))
    base = [word() for _ in range(80)]
    near = list(base)
    near[40] = "other"
    rows = [(100 + i, " ".join(word() for _ in range(40)), "en", f"s{i % 3}", 5) for i in range(30)]
    rows += [(7, " ".join(base), "en", "s0", 5), (5, " ".join(near), "en", "s1", 5), (9, " ".join(base), "en", "s0", 5), (9, " ".join(base), "en", "s0", 5)]
    rows += [(50, None, None, None, None), (51, "", "de", "s2", 0), (52, "token=abcdefghij end " + word(), "de", "s2", 3), (None, "a row without id " + word(), "en", "s1", 3), (53, "x" * 30000, "en", "s1", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_dedup_keeps_one(spark):
    x = docs(spark)
    got = cp.near_dedup(spark, x, D)
    assert got.columns == x.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.doc_id for r in x.collect() if r.doc_id not in (None, 7, 9)}) and ids.count(None) == 1


def test_secrets_are_redacted_and_rows_stay(spark):
    x = docs(spark)
    got = {r.doc_id: r for r in cp.secrets(spark, x, D).collect()}
    assert len(got) == x.select("doc_id").distinct().count()
    assert got[52].text.startswith("[SECRET] end ") and got[52].n_chars == len(got[52].text)
    assert got[50].text is None and got[100].text == x.where("doc_id = 100").first().text


def test_mix_repeats_whole_documents(spark):
    x = docs(spark).dropDuplicates(["doc_id"])
    got = cp.mix(spark, x, D)
    assert got.columns == x.columns
    texts = {r.doc_id: r.text for r in x.collect()}
    counts = {}
    for r in got.collect():
        assert r.text == texts[r.doc_id]
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 2


def test_mix_takes_rows_not_ids(spark):
    rows = [(None, f"no id {i} ta lo mi", "en", "s0", 5) for i in range(12)] + [(7, f"same id {i} ta lo mi", "en", f"s{i % 2}", 5) for i in range(8)] + [(i, f"own id {i} lo", "en", "s1", 5) for i in range(20, 40)]
    x = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    counts = {}
    for r in cp.mix(spark, x, D).collect():
        counts[tuple(r)] = counts.get(tuple(r), 0) + 1
    assert set(counts) <= set(rows) and max(counts.values()) <= 2
    words = sum(len(r[1].split()) * n for r, n in counts.items())
    assert abs(words - 1.5 * sum(len(r[1].split()) for r in rows)) <= 2 * 6  # half a document of each source at most


def test_near_dedup_takes_rows_not_ids(spark):
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choice(["ta", "lo", "mi", "re", "su"]) for _ in range(4)) for _ in range(30))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (None, c), (None, c), (None, d), (8, d), (3, ""), (3, ""), (4, None), (None, ""), (None, "")]
    x = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in cp.near_dedup(spark, x, D).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, c), (8, d), (3, ""), (4, None), (None, ""), (None, "")], key=str)


def test_near_dedup_shuffles_no_texts(spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):  # as on tables too large to broadcast
        plan = cp.near_dedup(spark, docs(spark), D)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row#" not in plan and "hashpartitioning(chunk#" not in plan


def test_picked_rows_are_those_of_a_semi_join(spark):
    x = spark.range(0, 9000, 1, 3).select(F.concat(F.lit("t"), F.col("id")).alias("a.b"), (F.col("id") % 7).alias("picked"))
    rows = numbered(x, "test-rows", "n", "c")
    assert rows.drop("n", "c").exceptAll(x).count() == 0 and rows.select("n").distinct().count() == rows.count() == 9000
    assert rows.groupBy("c").count().agg(F.max("count")).first()[0] == 2048
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rowproof_rows")]
    for some in (rows.where("picked = 3"), rows.limit(0), rows):
        got = picked(rows, some.select("n"), "n", "c")
        assert got.columns == rows.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(some.select("n"), "n", "left_semi").select(*[f"`{c}`" for c in rows.columns]).collect()))


def test_near_duplicates_by_chunk_are_the_same(spark):
    rows = numbered(docs(spark).repartition(3), "test-rows", "n", "c")
    by_chunk, plain = (sorted(map(tuple, minhash.near_duplicates(rows, id_col="n", chunk_col=c).collect())) for c in ("c", None))
    assert by_chunk == plain and len(plain) == docs(spark).count()


def test_columns_with_clashing_and_dotted_names(spark):
    names = ["row", "_row", "spans", "masked", "a.b", "times", "number", "component_id", "key"]
    x = docs(spark).select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    for stage in (cp.near_dedup, cp.secrets, cp.mix, cp.toxicity):
        y = stage(spark, x, D)
        assert y.columns == x.columns
        assert {tuple(r[5:]) for r in y.collect()} == {tuple(range(len(names)))}
    assert {r.doc_id for r in cp.tokens(spark, x, D).collect()} == {r.doc_id for r in x.select("doc_id").collect()}


def test_toxicity_only_filters(spark):
    x = spark.read.parquet(f"{D}/documents.parquet").withColumn("extra", F.lit("x"))
    got = cp.toxicity(spark, x, D)
    assert got.columns == x.columns and 0 < got.count() <= x.count()
    assert got.exceptAll(x).count() == 0


def test_run_equals_its_stages_in_plain_python(spark):
    library = load(public_tokenizers.path("word_bpe_49k.json"))
    x = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        x = stage(spark, x, D)
    expected = sorted((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in x.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, D).collect()) == expected


def test_empty_table(spark):
    x = docs(spark).limit(0)
    for _, stage in cp.STAGES:
        y = stage(spark, x, D)
        assert y.count() == 0
