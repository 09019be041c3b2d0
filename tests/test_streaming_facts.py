"""Stateful facts: the drained stream says what one batch over the same rows says."""

import datetime
import random

from pyspark.sql import functions as F

from rowproof.streaming import drain
from rowproof.streaming.facts import late_parents, repeated_keys


def stream(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(path)


def test_repeated_keys(spark, tmp_path):
    rng = random.Random(2)
    batches = [[(rng.choice([None, *range(40)]), rng.choice("ab")) for _ in range(25)] for _ in range(3)]
    got = drain(repeated_keys(stream(spark, f"{tmp_path}/in", batches, "k int, v string"), ["k", "v"]), "update")
    whole = spark.createDataFrame([r for b in batches for r in b], "k int, v string").where("k is not null").groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    most = {(r.k, r.v): r.n for r in got.groupBy("k", "v").agg(F.max("n").alias("n")).collect()}
    assert most == {(r.k, r.v): r.n for r in whole.collect()} and len(most) > 5


def test_late_parents(spark, tmp_path):
    hour = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)
    # 1: parent first; 2: parent in time; 3: never; 4: too late; 5: still waiting at the end; 6: parent alone
    batches = [[(1, hour(0), "p"), (1, hour(1), "c"), (2, hour(1), "c"), (3, hour(2), "c"), (4, hour(2), "c"), (None, hour(2), "c")], [(2, hour(9), "p"), (3, hour(10), "c"), (6, hour(11), "p")], [(7, hour(60), "p"), (1, hour(60), "c")], [(4, hour(61), "p"), (5, hour(70), "c")]]
    x = stream(spark, f"{tmp_path}/in", batches, "k int, at timestamp, kind string")
    got = drain(late_parents(x.where("kind = 'c'"), x.where("kind = 'p'"), ["k"], "at", datetime.timedelta(hours=24), "1 hour"))
    assert sorted(tuple(r) for r in got.collect()) == [(3, 2), (4, 1)]
