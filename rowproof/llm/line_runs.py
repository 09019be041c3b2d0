"""Exact line deduplication by levelled sorted runs of line hashes (DataFrame functions only).

Documents come in batches. A batch's distinct line keys (two 64-bit hashes of a normalised line) are merge-joined with
the runs of all earlier batches; keys no run has become a run of their own. Every `fan` runs of a level are compacted
into one of the next, so a batch meets a few runs only and each key is rewritten once a level.

A run is a table bucketed and sorted by its key: a batch is shuffled once and meets every run where it lies, run rows
are never shuffled for a look-up. Only keys travel between the steps; texts are read again at the end.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm.common import dropped, scratch, settings, table, written

#: White space stripped from both ends of a line, and the letters that fold.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shortest key that counts, batches of a table, runs of a level that are compacted together.
LEAST_CHARS, BATCHES, FAN = 10, 6, 3
_KEY = ("h", "g")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case and all other letters as they are."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(docs: DataFrame, *more: Column, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, of, pos, h, g, more): a row per line of docs (doc_id, text) whose key has `least` code points.

    `of` is a hash of the whole text, so that different texts of one id are told apart; h and g are hashes of the key
    with different seeds.
    """
    line = docs.select("doc_id", F.xxhash64("text").alias("of"), *more, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    named = line.withColumn("line", line_key(F.col("line"))).where(F.length("line") >= least)
    return named.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit("second"), "line")).drop("line")


class LineRuns:
    """Keys of all lines seen so far, in levels of runs (tables named rowproof_run_..., files in the shared folder)."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def look_up(self, keys: DataFrame) -> DataFrame:
        """keys (h, g, ...: one row a key) with `known`: is the key in a run?"""
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            held = self.spark.table(run).where("not known").select(*_KEY, F.lit(True).alias(f"in_{i}"))
            keys = keys.join(held, list(_KEY), "left")
            known = known | F.coalesce(f"in_{i}", F.lit(False))
        return keys.withColumn("known", known).drop(*(f"in_{i}" for i in range(len(self.runs()))))

    def add(self, lines: DataFrame) -> DataFrame:
        """(doc_id, of, pos) of the lines (doc_id, of, pos, h, g) that repeat an earlier batch's line or, within the
        batch, the line of a smaller doc_id (a null id is the largest). Keys that are new make a run."""
        self.compact()
        held = lines.groupBy(*_KEY).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("nulls"))
        keys = self.look_up(held)
        path = self._store(keys, 0)
        # by its path it is no bucketed table: both sides are shuffled, and a very common line can be split
        again = self.spark.read.schema(keys.schema).parquet(path).where("known or first < last or (nulls and first is not null)")
        found = lines.join(again, list(_KEY)).where("known or doc_id > first or (doc_id is null and first is not null)")
        return written(found.select("doc_id", "of", "pos"), "lines-again")

    def compact(self) -> None:
        """Merge the runs of each level that has `fan` of them."""
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fan:
                self.levels[level] = []
                parts = [self.spark.table(run).where("not known").select(*_KEY) for run in runs]
                self._store(reduce(DataFrame.unionAll, parts).repartition(self.buckets, *_KEY).withColumn("known", F.lit(False)), level + 1)
                self._drop(runs)

    def close(self) -> None:
        """Delete all runs."""
        self._drop(self.runs())
        self.levels = [[]]

    def _store(self, keys: DataFrame, level: int) -> str:
        name = f"rowproof_run_{uuid.uuid4().hex}"
        path = scratch(self.spark, f"line-run-{level}")
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
            keys.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.buckets, *_KEY).sortBy(*_KEY).saveAsTable(name)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        return path

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            dropped(self.spark.table(run))
            self.spark.sql(f"drop table if exists {run}")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fan: int = FAN, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped), one row per input row: text without the lines whose key a smaller doc_id holds.

    Lines are parted by line feeds; null or empty text is one empty line. Keys shorter than `least` code points never
    go. Batches are ranges of the (numeric) id, so the smallest id holding a key comes first. Rows of one id count as
    one document: they take no lines from each other, and repeated rows stay repeated. A null id is larger than any
    other, and all rows without an id are one document. An empty table gives no rows.
    """
    spark = docs.sparkSession
    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = sorted(set(x.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    batch = reduce(lambda n, cut: n + F.coalesce((F.col("doc_id") > cut).cast("int"), F.lit(1)), cuts, F.lit(0))
    path = scratch(spark, "lines")
    lines_of(x, batch.alias("batch"), least=least).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id %s, of long, pos int, h long, g long, batch int" % x.schema["doc_id"].dataType.simpleString()).parquet(path)
    index = LineRuns(spark, fan=fan)
    again = [index.add(lines.where(F.col("batch") == i).drop("batch")) for i in range(len(cuts) + 1)]
    index.close()
    dropped(lines)
    gone = reduce(DataFrame.unionAll, again).groupBy(F.col("doc_id").alias("of_id"), "of").agg(F.collect_set("pos").alias("gone"))
    x = x.withColumn("text_hash", F.xxhash64("text"))
    x = x.join(gone, x.doc_id.eqNullSafe(gone.of_id) & (F.col("text_hash") == F.col("of")), "left")
    parts = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone")  # by hashing, in order
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    return x.select("doc_id", kept.alias("text"), F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them smaller documents hold, and a digest of the rest."""
    x = dedup(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(f.first < k.doc_id, false) AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
