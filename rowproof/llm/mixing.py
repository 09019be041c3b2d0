"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Each document gets an exponential key -ln(u) / w, u a fixed hash of its id and text and w its quality weight, so that
taking documents in key order is weighted sampling without replacement. Within a source, sizes are summed in
key order up to the source's budget. Complete epochs come first; the rest is a fractional selection whose last
document may be taken in part.

No source is ordered as a whole: documents are cut into key buckets (so many per source that each holds a
bounded number on average), the bucket sums are ordered, and only the bucket in which the budget ends is ordered
document by document. One very large source is thus summed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowproof.llm.common import n_words, quoted, table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
BUCKET_DOCS = 256


def quality(size: Column, n_chars: Column) -> Column:
    """Quality weight of a document: 1 halved for each sign of junk (odd mean word length, very short text)."""
    mean = n_chars / F.greatest(size, F.lit(1))
    return F.when(mean.between(3.0, 12.0), F.lit(1.0)).otherwise(F.lit(0.5)) * F.when(size >= 20, F.lit(1.0)).otherwise(F.lit(0.5))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A fixed number in (0, 1) for each id and text, the same in every run; rows that share an id differ by their texts."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))), 1, 12), 16, 10).cast("double")
    return (h + 1) / F.lit(float(2**48 + 1))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Add each source's target to (source, source_size): weights repeat over the sources by code point (null
    last); `share` of all sizes is dealt by weight; none gets above `most` times its size, and what it can't
    take is dealt to the others by weight. One row per source: the windows over all of them run in one task, which
    is meant for thousands of sources, not millions.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    x = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * most)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    x = x.withColumn("k", F.row_number().over(order))
    full_before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    x = x.withColumn("level", (F.lit(share) * F.sum("source_size").over(all_rows) - full_before) / rest)
    free = F.col("most") / F.col("weight") >= F.col("level")
    x = x.withColumn("first_free", F.min(F.when(free, F.col("k"))).over(all_rows))
    x = x.withColumn("final", F.max(F.when(F.col("k") == F.col("first_free"), F.col("level"))).over(all_rows))
    target = F.when(F.col("k") < F.col("first_free"), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("final") * F.col("weight")))
    return x.select("source", "source_size", "n_docs", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: int = 7, carry: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, part, taken): taken = epochs * size + part.

    Null text has size 0 and is taken 0 times; null source is a source of its own; ties in the key go by id,
    then size; of equal rows any may be the one taken in part. An empty table gives no rows. `weight` is a
    quality column over (size, n_chars); by default quality(). With `carry`, a column "row" has each row of docs.
    """
    text, doc_id = F.col(text_col), F.col(id_col)
    carried = ["row"] if carry else []
    row = [F.struct(*quoted(docs.columns)).alias("row")] if carry else []
    sized = docs.select(*row, doc_id.alias("doc_id"), uniform(doc_id, text, seed).alias("u"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    w = quality(F.col("size"), F.col("n_chars")) if weight is None else weight
    key = -F.log("u") / w
    sized = written(sized.select(*carried, "doc_id", "source", "size", key.alias("key"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name")), "mix-sized")

    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = targets(sources)
    whole = F.round("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    plan = plan.withColumn("epochs", F.floor(whole / size)).withColumn("budget", whole - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("buckets", F.ceil(F.col("n_docs") / BUCKET_DOCS))
    plan = written(plan.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target", "epochs", "budget", "buckets"), "mix-targets")

    bucket = F.least(F.col("buckets") - 1, F.floor(F.col("key") / (F.col("key") + 1) * F.col("buckets")))
    dealt = sized.join(plan, ["no_source", "name"]).withColumn("bucket", bucket)
    sums = dealt.groupBy("no_source", "name", "budget", "bucket").agg(F.sum("size").alias("held"))
    order = Window.partitionBy("no_source", "name").orderBy("bucket")
    sums = sums.withColumn("before", F.sum("held").over(order) - F.col("held"))
    last = sums.where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("held") >= F.col("budget")))
    last = written(last.select("no_source", "name", F.col("bucket").alias("last"), (F.col("budget") - F.col("before")).alias("left")), "mix-last")

    cut = dealt.join(last, ["no_source", "name"], "left")
    out = [*carried, "doc_id", "source", "size", "source_size", "target", "epochs"]
    clear = cut.where(~F.col("bucket").eqNullSafe(F.col("last"))).select(*out, F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(0).cast("long").alias("part"))
    within = Window.partitionBy("no_source", "name").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = cut.where(F.col("bucket") == F.col("last")).withColumn("upto", F.sum("size").over(within))
    edge = edge.select(*out, F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - (F.col("upto") - F.col("size")))).cast("long").alias("part"))
    return clear.unionByName(edge).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of the sources by weights 5, 2, 1 takes."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS n_chars,
         (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 1) / (281474976710656::DOUBLE + 1) AS u
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln(u) / ((CASE WHEN n_chars / greatest(size, 1)::DOUBLE BETWEEN 3 AND 12 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) * (CASE WHEN size >= 20 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)) AS key
  FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighted AS (
  SELECT source, source_size, source_size * 2 AS most,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT]::BIGINT AS weight FROM sources),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, source ASC NULLS LAST) AS k,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
firsts AS (SELECT min(k) AS first_free FROM ordered WHERE most / weight >= level),
plan AS (
  SELECT o.source, o.source_size,
         CASE WHEN o.k < f.first_free THEN o.most::DOUBLE ELSE least(o.most::DOUBLE, (SELECT max(level) FROM ordered, firsts WHERE k = first_free) * o.weight) END AS target
  FROM ordered o, firsts f),
budget AS (
  SELECT *, floor(round(target) / greatest(source_size, 1))::BIGINT AS epochs,
         (round(target) - floor(round(target) / greatest(source_size, 1)) * source_size)::BIGINT AS rest FROM plan),
summed AS (
  SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.epochs, b.rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM keyed d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken, source
FROM summed
"""
