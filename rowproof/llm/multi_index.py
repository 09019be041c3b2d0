"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own (fitted on a bounded sample); every vector is
entered in the cell of its two nearest centroids. A query goes through the pairs of centroids in order of their
summed score, kept in a heap, until the cells passed hold enough vectors. The sum at which it stops says which cells
it has passed; their entries, and no others, are scored by the exact measure.

Cells that follow each other make blocks of about BLOCK vectors, and a cell with more is cut into several, so that one
with a third of all vectors is many tasks. A query is sent to the blocks that hold a cell it passes, with its stopping
sum. A task takes a block's entries and then streams the queries past them. While blocks hold many cells, nearly all
blocks have one that a query passes, in whatever order cells are put; where cells fill blocks, a query's share of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowproof.llm.common import small_batches, table, written
from rowproof.llm.vectors import matrix, sample, usable

#: Rows to fit codebooks on at most, centroids of each half, vectors of a block about.
SAMPLE, CENTROIDS, BLOCK = 16_384, 512, 4096
#: Queries that meet a block in one task about; the block is there once for each so many of all queries.
QUERIES = 32_768
#: A query passes cells until they hold this share of all vectors, and this many at least. Vectors without any
#: structure, as most here, need this much for a recall of 0.9: neither half says much about the other.
SHARE, LEAST = 0.25, 200
#: Centroids of a half, in a query's order, that are taken from the heap together.
TILE = 32
#: A stopping sum is lowered by this, so that a cell at the sum itself is passed whatever the rounding.
SLACK = 1e-9


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means centroids, ordered along their widest direction; empty ones keep their place."""
    x = np.unique(x, axis=0)
    if len(x) > k:
        c = x[np.random.default_rng(5).permutation(len(x))[:k]]
        for _ in range(rounds):
            at = _nearest(x, c)
            counts = np.bincount(at, minlength=len(c))
            order = np.argsort(at, kind="stable")
            sums = np.add.reduceat(x[order], np.minimum(np.cumsum(counts) - counts, len(x) - 1))
            c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        x = c
    if not x.shape[1]:
        return x
    widest = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]
    return x[np.argsort(x @ widest, kind="stable")]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2.0 * (x @ c.T)).argmin(axis=1)


def passed(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> tuple[np.ndarray, float]:
    """(cells passed, as i * columns + j, and the stopping sum): pairs of centroids in order of first + second, largest
    first, until their cells hold enough vectors (all cells if they don't).

    The heap holds tiles of TILE by TILE pairs by their largest sum; what is taken from it is in order once no tile left
    can hold a larger sum.
    """
    order_a, order_b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[order_a], second[order_b]
    tiles_a, tiles_b = range(0, len(a), TILE), range(0, len(b), TILE)
    heap, seen = [(-float(a[0] + b[0]), 0, 0)], {(0, 0)}
    sums, sizes, cells, held, check = [], [], [], 0, enough
    while heap:
        bound, p, q = heapq.heappop(heap)
        if held >= check:
            known = np.concatenate(sums) >= -bound
            if int(np.concatenate(sizes)[known].sum()) >= enough:
                break
            check = held + max(1, enough // 16)
        i, j = tiles_a[p], tiles_b[q]
        own = order_a[i : i + TILE, None] * counts.shape[1] + order_b[None, j : j + TILE]
        n = counts.ravel()[own.ravel()]
        full = np.flatnonzero(n)
        sums.append((a[i : i + TILE, None] + b[None, j : j + TILE]).ravel()[full])
        sizes.append(n[full])
        cells.append(own.ravel()[full])
        held += int(n.sum())
        for x, y in ((p + 1, q), (p, q + 1)):
            if x < len(tiles_a) and y < len(tiles_b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-float(a[tiles_a[x]] + b[tiles_b[y]]), x, y))
    sum_, size, cell = np.concatenate(sums), np.concatenate(sizes), np.concatenate(cells)
    order = np.argsort(-sum_, kind="stable")
    last = min(int(np.searchsorted(np.cumsum(size[order]), enough)), len(order) - 1)
    stop = float(sum_[order[last]]) - SLACK
    return cell[sum_ >= stop], stop


class MultiIndex:
    """An index over all usable vectors of df, a part for each length (vectors of different lengths have no product)."""

    def __init__(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS):
        self.spark = df.sparkSession
        small_batches(self.spark)
        x = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        x = x.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
        lengths = x.select(F.size("v").alias("dims")).distinct().orderBy("dims").collect()  # few: a model gives one length
        self.parts = [_Part(x.where(F.size("v") == r["dims"]), r["dims"], centroids) for r in lengths]

    def search(self, queries: Column, k: int = 20, share: float = SHARE, least: int = LEAST) -> DataFrame:
        """(query_id, rank, vec_id, score): for entries where `queries` holds, the k with the largest inner product.

        Rows with the query's own id are no candidates; ties go to the smaller id; a query with fewer candidates
        gets all of them. Cells count their different ids; where different vectors of few ids still fill the cells that
        a query passes and fewer than k ids come back, it passes all cells. Rows that are null, zero or not finite, or have no id, take no part. An id is listed once:
        of repeated rows, or different vectors of one id (as query or as candidate), the largest product counts.
        Scores are computed in double precision on the original vectors. An empty table gives no rows.
        """
        if not self.parts:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        best = self._best(queries, k, lambda part: int(max(least, share * part.n)) + k + 1)
        best = written(best, "multi-found")
        enough = best.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
        short = reduce(DataFrame.unionAll, (part.entries.where(queries).select("vec_id") for part in self.parts)).distinct().join(enough, "vec_id", "left_anti")
        short = written(short, "multi-short")
        if short.isEmpty():
            return best
        more = self._best(queries, k, lambda part: part.n, short)
        return best.join(short.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti").select(*more.columns).unionByName(more)

    def _best(self, queries: Column, k: int, enough, only: DataFrame | None = None) -> DataFrame:
        """The k best of what the queries (of the ids in `only`) meet in cells with enough(part) ids."""
        best = reduce(DataFrame.unionByName, (part.scored(queries, k, enough(part), only) for part in self.parts))
        best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Part:
    """The index of the vectors of one length."""

    def __init__(self, x: DataFrame, dims: int, centroids: int):
        self.spark = x.sparkSession
        cut = self.cut = max(1, dims // 2)
        some = sample(x, "vec_id", "v", SAMPLE)
        books = self.books = codebook(some[:, :cut], centroids), codebook(some[:, cut:], centroids) if dims > cut else np.zeros((1, 0))

        def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch.column("v"))
                i, j = (_nearest(half, book) for half, book in zip((v[:, :cut], v[:, cut:]), books, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array((i * len(books[1]) + j).astype(np.int32))], ["vec_id", "v", "cell"])

        self.entries = written(x.mapInArrow(enter, "vec_id long, v array<double>, cell int"), "multi-index")
        got = self.entries.groupBy("cell").agg(F.count("*").alias("rows"), F.count_distinct("vec_id").alias("ids")).toArrow()  # a row per pair of centroids at most
        counts, ids = np.zeros((2, len(books[0]) * len(books[1])), np.int64)
        counts[got.column("cell").to_numpy()] = got.column("rows").to_numpy()
        ids[got.column("cell").to_numpy()] = got.column("ids").to_numpy()
        self.counts = ids.reshape(len(books[0]), -1)
        self.n = int(ids.sum())
        # cells in order make blocks; a cell larger than a block is one of its own, in several pieces
        before = (np.cumsum(counts) - counts) // BLOCK
        large = counts > BLOCK
        self.block = np.cumsum(np.diff(before, prepend=0).astype(bool) | large | np.append(False, large[:-1])).astype(np.int32)
        self.pieces = np.ones(int(self.block[-1]) + 1, np.int64)
        self.pieces[self.block[large]] = -(-counts[large] // BLOCK)

    def scored(self, queries: Column, k: int, enough: int, only: DataFrame | None = None) -> DataFrame:
        """(query_id, vec_id, score): from each block that a query is sent to, its k best; queries with ids in `only`."""
        books, cut, counts, block, pieces = self.books, self.cut, self.counts, self.block, self.pieces
        width = counts.shape[1]
        asked = self.entries.where(queries).select("vec_id", "v")
        asked = asked if only is None else asked.join(only, "vec_id")
        shares = max(1, -(-asked.count() // QUERIES))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch.column("v"))
                first, second = v[:, :cut] @ books[0].T, v[:, cut:] @ books[1].T
                for row, (a, b) in enumerate(zip(first, second, strict=True)):
                    cells, stop = passed(a, b, counts, enough)
                    at = np.unique(block[cells])
                    n = pieces[at]
                    piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    same = pa.array(np.full(len(piece), row))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, n)), pa.array(piece), batch.column("vec_id").take(same), batch.column("v").take(same), pa.array(np.full(len(piece), stop))], ["block", "piece", "vec_id", "v", "stop"])

        used = np.flatnonzero(counts.ravel())
        places = self.spark.createDataFrame(pa.table({"cell": used.astype(np.int32), "block": block[used], "pieces": pieces[block[used]]}))
        entries = self.entries.join(F.broadcast(places), "cell")  # a row per pair of centroids at most
        entries = entries.select("block", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).alias("piece"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "vec_id", "v", "cell", F.lit(None).cast("double").alias("stop"))
        routed = asked.repartition(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(route, "block int, piece long, vec_id long, v array<double>, stop double")
        routed = routed.select("block", "piece", F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("kind"), "vec_id", "v", F.lit(None).cast("int").alias("cell"), "stop")
        key = ["block", "piece", "share"]
        return entries.unionByName(routed).repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(lambda it: _met(it, books, cut, width, k), "query_id long, vec_id long, score double")


def _met(batches: Iterator[pa.RecordBatch], books: tuple, cut: int, width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Blocks, each with its entries and then the queries sent to it -> each query's best among the cells it passes."""
    key, rows, held = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "piece", "share", "kind")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if a == b:
                continue
            part, own = batch.slice(a, b - a), tuple(keys[a, :3].tolist())
            if own != key:
                key, rows, held = own, [], None
            if keys[a, 3] == 0:
                rows.append(part)
                continue
            if held is None:
                held = _Block(pa.Table.from_batches(rows), books, width) if rows else None
            if held is not None:
                yield held.best(part, cut, k)


class _Block:
    """A block's entries, in memory."""

    def __init__(self, t: pa.Table, books: tuple, width: int):
        ids, cell = t.column("vec_id").to_numpy(), t.column("cell").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.v, self.ids, self.books = matrix(t.column("v"))[order], ids[order], books
        cells, self.cell = np.unique(cell[order], return_inverse=True)
        self.i, self.j = cells // width, cells % width

    def best(self, asked: pa.RecordBatch, cut: int, k: int) -> pa.RecordBatch:
        q_rows = matrix(asked.column("v"))
        first, second = q_rows[:, :cut] @ self.books[0].T, q_rows[:, cut:] @ self.books[1].T
        found: list[tuple[np.ndarray, ...]] = []
        for query_id, q, a, b, stop in zip(asked.column("vec_id").to_pylist(), q_rows, first, second, asked.column("stop").to_pylist(), strict=True):
            within = a[self.i] + b[self.j] >= stop
            place = np.flatnonzero(within[self.cell] & (self.ids != query_id))
            if not len(place):
                continue
            scores = self.v[place] @ q
            starts = np.flatnonzero(np.concatenate(([True], self.ids[place[1:]] != self.ids[place[:-1]])))
            if len(starts) > k:  # ties at the cut, and rounding of the product, are settled exactly
                least = np.partition(np.maximum.reduceat(scores, starts), len(starts) - k)[len(starts) - k]
                place = place[scores >= least - 1e-9 * max(1.0, abs(least))]
                starts = np.flatnonzero(np.concatenate(([True], self.ids[place[1:]] != self.ids[place[:-1]])))
            exact = np.maximum.reduceat((self.v[place] * q).sum(axis=1), starts)
            ids = self.ids[place[starts]]
            keep = np.lexsort((ids, -exact))[:k]
            found.append((np.full(len(keep), query_id), ids[keep], exact[keep]))
        a, b, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    return MultiIndex(table(spark, sf_dir, "embeddings")).search(F.col("vec_id") % 20 == 0)
