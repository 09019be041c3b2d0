"""MinHash near-duplicates.

1. Every document becomes a set of word shingles (64-bit hashes), its digest, and the minima of PERMUTATIONS
   universal hashes, cut into BANDS bands. Equal sets are one class from here on.
2. Classes that share a band value are a bucket. A bucket's smallest member is its hub; hub and member are a
   candidate pair. All 16-bit signatures are compared first, then full sets confirm.
3. Connected components by large-star and small-star. Pairs within a component need no more work, which is what
   keeps a group of thousands of near copies linear.
4. Buckets whose members are still in several components are compared in blocks of bounded size, between
   components only, each pair in the first bucket it shares: signatures first, then full sets, best pairs first.
   A link joins two components for the rest of the block, so a task returns fewer links than it has members. No
   bucket is capped and no link that the bands find is lost.

With 5 rows and 32 bands a pair at similarity 0.8 shares no band with probability 3e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm.common import documents, dropped, picked, small_batches, table, written
from rowproof.llm.components import components

BANDS, ROWS = 32, 5
PERMUTATIONS = BANDS * ROWS
#: Signatures may understate the similarity by this much (4.7 standard deviations at 0.8).
MARGIN = 0.15
BLOCK = 1000
#: Shingles of a block about (8 bytes each), so that long texts make smaller blocks.
BLOCK_SHINGLES = 250_000
REMEMBERED = 200_000

_random = np.random.Generator(np.random.PCG64(20))
_A = _random.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_MIX = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_words = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles, A-Z lower-cased; fewer words are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = _mixed(x + h[i : len(h) - k + 1 + i])
    return np.unique(x)


def minima(x: np.ndarray) -> np.ndarray:
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 2048):
        np.minimum(out, ((x[None, i : i + 2048] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out


def band_values(m: np.ndarray) -> np.ndarray:
    x = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        x = _mixed(x * _MIX[2] + m.reshape(BANDS, ROWS)[:, i])
    return x.view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield batch.column(0), (x.as_py() for x in batch.column(1))


def _profiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in _texts(batches):
        digests, sizes, bands = [], [], []
        for text in texts:
            x = shingles(text, k)
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            sizes.append(len(x))
            bands.append(band_values(minima(x)) if len(x) else [])
        yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in _texts(batches):
        sizes, signatures, bands, sets = [], [], [], []
        for text in texts:
            x = shingles(text, k)
            m = minima(x)
            sizes.append(len(x))
            signatures.append(m.astype(np.uint16).tobytes())
            bands.append(band_values(m).tobytes())
            sets.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (signatures, bands, sets))], ["node", "n", "signature", "bands", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with signatures sa, sb: those that may reach the threshold, with the estimate."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, PERMUTATIONS) for c in ("sa", "sb"))
        estimate = (a == b).mean(axis=1)
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        good = (estimate >= percent / 100 - MARGIN) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
        out = batch.select(["a", "b"]).filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(estimate[good])], ["a", "b", "estimate"])


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _across(percent: int):
    """Links between the components that a bucket's block pair holds: as many as it takes to join them."""

    def links(t: pa.Table) -> pa.Table:
        value, i, j = (t.column(c)[0].as_py() for c in ("value", "i", "j"))
        block, node, comp, n = (t.column(c).to_numpy() for c in ("block", "node", "comp", "n"))
        s = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)
        bands = np.frombuffer(b"".join(t.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for x in left.tolist():
            y = right[(comp[right] != comp[x]) & (node[right] > node[x] if i == j else node[right] != node[x])]
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            y = y[bands[x][(bands[y] == bands[x]).argmax(axis=1)] == value]  # the first bucket that both are in
            e = (s[y] == s[x]).mean(axis=1)
            good = e >= percent / 100 - MARGIN
            found.append((np.full(int(good.sum()), x), y[good], e[good]))
        xs, ys, e = (np.concatenate([np.zeros(0, kind), *c]) for c, kind in zip(zip(*found, strict=True) if found else ((), (), ()), (np.int64, np.int64, float), strict=True))
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := joined.get(c, c)) != c:
                joined[c] = c = joined.get(up, up)
            return c

        out = []
        order = np.argsort(-e, kind="stable")
        for x, y in zip(xs[order].tolist(), ys[order].tolist(), strict=True):
            p, q = root(int(comp[x])), root(int(comp[y]))
            if p != q and _similar(sets[x], sets[y], percent):
                joined[q] = p
                out.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return links


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row; ids are whole numbers.

    Documents are linked where 100 * |intersection| >= percent * |union| of their shingle sets. component_id is
    the smallest id that links reach, kept says that it is the document's own. Texts without words (null, empty)
    and rows without an id are linked with nothing; rows that share an id count as one document, linked to what
    any of them is linked to. An empty table gives no rows. Where docs is a numbered() table and id_col its rows'
    number, chunk_col spares a shuffle of the texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    x = documents(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = written(x.mapInArrow(lambda it: _profiles(it, k), "doc_id long, digest binary, n long, bands array<long>"), "minhash-profiles")
    real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = written(profiles.where(real).groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "minhash-classes")

    dealt = classes.select("node", "n", F.explode("bands").alias("value"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    hubs = dealt.groupBy("value").agg(F.min("node").alias("hub"), F.count("*").alias("held"), blocks.alias("blocks")).where("held > 1")
    members = written(dealt.join(hubs, "value").select("value", "hub", "blocks", "node"), "minhash-buckets")

    candidates = members.select(F.col("node").alias("doc_id")).distinct()
    if chunk_col is None:
        texts = x.join(candidates, "doc_id", "left_semi")
    else:
        lying = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(chunk_col).alias("chunk"))
        texts = documents(picked(lying, candidates, "doc_id", "chunk"))
    sets = texts.mapInArrow(lambda it: _sets(it, k), "node long, n long, signature binary, bands binary, shingles binary")
    sets = written(sets, "minhash-sets")

    def side(c: str, *columns: tuple[str, str]) -> DataFrame:
        return sets.select(F.col("node").alias(c), *(F.col(name).alias(alias) for name, alias in columns))

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("b", ("n", "nb"), ("signature", "sb")), "b").join(side("a", ("n", "na"), ("signature", "sa")), "a")
        return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lambda it: _alike(it, percent), "a long, b long, estimate double")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("b", ("shingles", "xb")), "b").join(side("a", ("shingles", "xa")), "a").select("a", "b", "xa", "xb")
        return written(both.mapInArrow(lambda it: _confirmed(it, percent), "a long, b long").distinct(), "minhash-links")

    stars = written(alike(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()), "minhash-stars")
    best = stars.groupBy("b").agg(F.max(F.struct("estimate", -F.col("a"))).alias("x")).select((-F.col("x.col2")).alias("a"), "b")
    links = confirmed(best)
    comps = components(links)

    # buckets whose members lie in several components: every pair between components, by blocks
    placed = members.join(comps, "node", "left").select("value", "blocks", "node", F.coalesce("component", "node").alias("comp"))
    split = placed.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("value")
    open_ = placed.join(split, "value").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    open_ = open_.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    cross = open_.join(sets, "node").groupBy("value", "i", "j").applyInArrow(_across(percent), "a long, b long")
    comps = components(links.unionByName(written(cross, "minhash-cross")))
    dropped(sets)

    out = profiles.join(classes.select("digest", "node"), "digest", "left").select("doc_id", "n", F.when(real, F.col("node")).alias("node"))
    out = out.join(comps, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates by two-word shingles at a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)
