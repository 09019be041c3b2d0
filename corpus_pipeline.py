"""From documents to a deduplicated, scrubbed, mixed and tokenised corpus.

Each stage takes (spark, docs, sf_dir) and returns a data frame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm import bpe, minhash, mixing, secret_scan
from rowproof.llm import toxicity as tox
from rowproof.llm.common import dropped, n_words, numbered, own_name, picked, quoted, table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7.

    Null and empty texts have no evidence and stay; equal texts share their fate; repeated rows and ids stay as they
    are; a null id is never learned from. An empty table stays empty.
    """
    return tox.clean(docs, tox.fit(docs, table(spark, sf_dir, "labels")), 0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that of the smallest id,
    one without an id only if none has one.

    Different texts that share an id are documents of their own; of equal ones (ties) the first read stays. Rows
    without words are like nothing: they stay, once for each id, and all of those without an id. An empty table stays
    empty.
    """
    row, chunk = own_name("row", docs.columns), own_name("chunk", docs.columns)
    rows = numbered(docs, "pipeline-rows", row, chunk)
    found = minhash.near_duplicates(rows, k=5, percent=80, id_col=row, chunk_col=chunk).select(F.col("doc_id").alias("number"), "component_id")
    named = rows.select(F.col(row).alias("number"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "number"))
    kept = written(found.join(named, "number").groupBy("component_id").agg(first.alias("first")).select(F.col("first.number").alias(row)), "pipeline-kept")
    dropped(found)
    rows = picked(rows, kept, row, chunk).select(*quoted(docs.columns))
    wordless = (n_words(F.col("text")) == 0) & F.col("doc_id").isNotNull()
    return rows.where(~wordless).unionByName(rows.where(wordless).dropDuplicates(["doc_id"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret span is replaced by a mark, and n_chars follows.

    Null and empty texts are as they were (n_chars of a null text is null); spans that overlap are one mark; repeated
    rows stay repeated. An empty table stays empty.
    """
    spans = own_name("spans", docs.columns)
    found = secret_scan.scan(docs, into=spans)
    found = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col(spans)))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*quoted(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: complete epochs, and once more where the fractional selection
    takes at least half of the document's words (whole texts only).

    Texts without words are taken 0 times and go; a null source is a source of its own; ties in the sampling key go by
    id and size, and repeated rows are drawn one by one. An empty table stays empty.
    """
    more = F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)
    times = mixing.mix(docs, carry=True).select("row", (F.col("epochs") + more).cast("int").alias("times")).where("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of ids and digests of its ids and of the decoded text.

    Null and empty texts have 0 ids and the digests of nothing; a row for every row, repeated ones too. An empty table
    gives no rows.
    """
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secret_scan", secrets), ("mixing", mix), ("bpe", tokens)]

#: Log-odds segments, MinHash and BPE are not for SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
