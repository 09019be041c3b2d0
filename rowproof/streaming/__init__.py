"""The same checks over streams: windowed counts behind a watermark, and deduplication of keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.sources.shared import shared_folder


def read_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over a Parquet table of a folder: a single file or a folder of files."""
    table = spark.read.parquet(f"{folder}/{name}")
    files = spark.readStream.schema(table.schema)
    if table.inputFiles()[0].rstrip("/").endswith(f"/{name}"):  # a stream's source is a folder
        return files.option("pathGlobFilter", name).parquet(folder)
    return files.parquet(f"{folder}/{name}")


def window_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, keys, n) per tumbling window; rows later than `late` behind the newest are left out."""
    w = F.window(F.col(at).cast("timestamp"), width)
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def first_rows(events: DataFrame, at: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """The first row of each key, as it arrives."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, into a table in the shared folder, and read that table."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/rowproof/stream-{uuid.uuid4().hex[:12]}"

    def keep(batch: DataFrame, number: int) -> None:
        # a complete result replaces the one before; a repeated batch replaces itself
        batch.write.mode("overwrite").parquet(f"{path}/table" if mode == "complete" else f"{path}/table/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/table")
    if not made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(made):
        return spark.createDataFrame([], stream.schema)  # no batch: nothing has come
    out = spark.read.schema(stream.schema).parquet(f"{path}/table")
    return out.select(*stream.columns)
