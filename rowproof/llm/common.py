"""What the operators of this subpackage share: scratch tables and session settings."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Low bits of a row's number within its chunk: 2,048 rows at most.
CHUNK_BITS = 11


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by spark.checkpoint.dir.

    Where that is unset a local session gets a folder of its own; on a cluster that is an error, as executors do not
    see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rowproof-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rowproof/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as two underscores) for a while; the caller's come back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage: what follows survives the loss of executors. The shuffle files of what came before go
    when the table is written.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, row: str, chunk: str) -> DataFrame:
    """df, written as written() does, with two columns more: a number for each row and the number of the row's chunk.

    Chunks are neighbouring rows of a partition. The table is bucketed by chunk, which moves no row when it is written,
    so picked() finds rows in it without a shuffle of the table. The catalog's entry goes at once, the files stay.
    """
    spark = df.sparkSession
    path, entry = scratch(spark, name), f"rowproof_rows_{uuid.uuid4().hex}"
    x = df.withColumn(row, F.monotonically_increasing_id())
    x = x.withColumn(chunk, F.shiftright(F.col(row), CHUNK_BITS))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        x.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, chunk).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"drop table {entry}")
    return out


def picked(rows: DataFrame, numbers: DataFrame, row: str, chunk: str) -> DataFrame:
    """The rows of a numbered() table whose number is in numbers (one column, named as row; none twice).

    Numbers are gathered by chunk and go to the bucket that has it; the rows stay where they lie, at any size.
    """
    own = own_name("picked", rows.columns)
    some = numbers.groupBy(F.shiftright(F.col(row), CHUNK_BITS).alias(chunk)).agg(F.collect_list(row).alias(own))
    return rows.join(some.hint("shuffle_hash"), chunk).where(F.array_contains(own, F.col(row))).select(*quoted(rows.columns))


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made and nothing needs any more."""
    for x in tables:
        spark = x.sparkSession
        for folder in {f.rpartition("/")[0] for f in x.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep the Arrow batches that go to Python small, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column's name can clash; null text becomes empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def own_name(name: str, columns: list[str]) -> str:
    """The name, or where a column has it (in either case) the name with underscores before it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(columns: list[str]) -> list[str]:
    """Column names that may hold dots or backquotes, for F.col and select."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
