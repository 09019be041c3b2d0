"""Toxicity by maximum-scoring segments of token log-odds.

1. Word features (the word and its longer prefixes, hashed into BUCKETS buckets, which bounds every table here)
   are counted over all documents: these counts are the informative part of the Dirichlet priors.
2. Labelled documents give counts per class. A feature's log-odds, for or against, is brought WARY standard deviations
   nearer to zero; a word's score is that of its surest feature less DRIFT (the odds against toxicity where nothing is
   known), so that clean text drifts down.
3. A linear-time scan finds all maximal scoring segments of every text (Ruzzo and Tompa).
4. Extreme-value statistics make segment scores of texts of any length comparable: with lambda from the score
   distribution of clean text and K from its segments, lambda S - ln(K n) is the normalised score of a segment.
   A logistic curve over a text's best, summed and significant segments gives the score. Statistics and curve are
   fitted on labelled texts that the log-odds were not learned from.

Labels are the only thing learned from; at most LABELLED labelled documents are used, picked by a hash of the id.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm.common import documents, small_batches, table, written

BUCKETS = 1 << 20
LABELLED = 20_000
#: Weight of the corpus in the prior, and its flat part per feature.
PRIOR, FLAT = 1000.0, 0.5
WARY, DRIFT = 3.5, 0.1
PREFIXES = (5, 6, 7, 8)
REMEMBERED = 200_000
#: Expected number of such segments by chance at which one is significant.
SIGNIFICANT = 0.05
_WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Buckets of a lower-cased word and of its prefixes."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for x in (word, *("^" + word[:n] for n in PREFIXES if len(word) > n))]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def segments(places: list[int], before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text, in one pass over its words with a score above zero.

    before and after are the sums of all words' scores up to each of these words, without and with it.
    """
    out: list[list] = []  # start, end, left sum, right sum, index of the nearest earlier one with a smaller left sum
    for place, left, right in zip(places, before, after, strict=True):
        start = place
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append([start, place + 1, left, right, j])
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
    return [(s, e, r - x) for s, e, x, r, _ in out]


class _Scores(dict):
    """From a word to its score, by the table of feature scores."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = x = max((float(self.weights[b]) for b in features(word)), key=abs) - DRIFT
        return x


def scored_segments(text: str, scores: dict) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words of a text and its segments."""
    x = np.fromiter(map(scores.__getitem__, words(text)), float)
    at = np.flatnonzero(x > 0)
    sums = np.cumsum(x)
    return len(x), segments(at.tolist(), (sums[at] - x[at]).tolist(), sums[at].tolist()) if len(at) else []


def learns(doc_id: Column) -> Column:
    """Rows whose labels may be learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def _summed(rows: DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """Sums per bucket on the driver: BUCKETS rows at most."""
    got = rows.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    out = np.zeros((len(columns), BUCKETS))
    for i, c in enumerate(columns):
        out[i, got.column("bucket").to_numpy()] = got.column(c).to_numpy()
    return out


class Model:
    """Fitted scores. `weights` has a row per bucket; the rest are a few numbers."""

    def __init__(self, weights: np.ndarray, lam: float, k: float, coefficients: np.ndarray):
        self.weights, self.lam, self.k, self.coefficients = weights, lam, k, coefficients

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> list[float]:
        """Inputs of the logistic curve for a text with n words.

        A constant; of scores normalised for the text's length (extreme-value law) the best, the sum of the positive
        ones and the number of significant ones; and, not normalised, the best segment and all segments' sum against
        the length. The curve weighs the latter two by itself.
        """
        s = np.array([self.lam * x[2] for x in found]) - math.log(self.k * max(n, 1) + 1e-12)
        s = np.maximum(s, -12.0)
        best = float(s.max()) if len(s) else -12.0
        raw = max([0.0, *(x[2] for x in found)])
        return [1.0, best / 4.0, math.log1p(float(np.maximum(s, 0).sum())), math.log1p(float((s > -math.log(SIGNIFICANT)).sum())), math.log1p(raw), math.log1p(sum(x[2] for x in found)) - 0.5 * math.log1p(n / 100)]

    def score(self, n: int, found: list[tuple[int, int, float]]) -> float:
        z = float(np.dot(self.coefficients, self.evidence(n, found)))
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> Model:
    """Fit on all documents (counts) and on at most `labelled` labelled ones among the rows learns() allows.

    Several labels of an id count as its largest, and so do those of equal texts, which are learned from once; null
    labels are none.
    Without documents of both classes every score is 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    x = documents(docs, id_col, text_col)

    def corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: np.ndarray | None = None
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                seen.update(words(text.as_py()))
            counts = np.zeros(BUCKETS, np.int64) if counts is None else counts
            for word, n in seen.items():
                for b in features(word):
                    counts[b] += n
        if counts is not None:
            at = np.flatnonzero(counts)
            for i in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000], pa.int32()), pa.array(counts[at[i : i + 50_000]])], ["bucket", "n"])

    background = _summed(x.select("text").mapInArrow(corpus, "bucket int, n long"), ("n",))[0]

    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y is not null and doc_id is not null")
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).where(learns(F.col("doc_id")))
    some = written(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "toxic-labels")
    known = x.join(F.broadcast(some), "doc_id").groupBy("text").agg(F.max("y").alias("y"))  # at most `labelled` rows are broadcast
    known = written(known.select("y", "text", (F.pmod(F.xxhash64("text"), F.lit(10)) < 3).alias("checks")), "toxic-known")

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, list[int]] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for b in {b for w in set(words(text.as_py())) for b in features(w)}:
                    counts.setdefault(b, [0, 0])[label] += 1
        if counts:
            n = np.array(list(counts.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(n[:, 0]), pa.array(n[:, 1])], ["bucket", "clean", "toxic"])

    label = F.when(F.col("y") > 0, 1).otherwise(0)
    sizes = {r["y"]: r["n"] for r in known.where("not checks").groupBy(label.alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 1.0, 1.0, np.array([-40.0, 0, 0, 0, 0, 0]))
    clean, toxic = _summed(known.where("not checks").select(label.alias("y"), "text").mapInArrow(by_class, "bucket int, clean long, toxic long"), ("clean", "toxic"))
    prior = FLAT + PRIOR * background / max(1.0, background.sum())
    whole = prior.mean() * 2

    def log_odds(hits: np.ndarray, n: int) -> np.ndarray:
        return np.log(hits + prior) - np.log(np.maximum(n - hits, 0) + prior + whole)

    delta = log_odds(toxic, sizes[1]) - log_odds(clean, sizes[0])
    spread = np.sqrt(1.0 / (toxic + prior) + 1.0 / (clean + prior))
    weights = (np.sign(delta) * np.maximum(0.0, np.abs(delta) - WARY * spread)).astype(np.float32)

    shared = spark.sparkContext.broadcast(weights)  # BUCKETS numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value)
        for batch in batches:
            out = [scored_segments(t.as_py(), scores) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in out], pa.int64()), pa.array([[s[2] for s in f] for _, f in out], pa.list_(pa.float64()))], ["y", "checks", "n", "found"])

    found = written(known.select(label.alias("y"), "checks", "text").mapInArrow(scan, "y int, checks boolean, n long, found array<double>"), "toxic-segments")
    used = found.where("checks")
    if used.agg(F.count_distinct("y")).first()[0] < 2:
        used = found
    lam, k = extreme_values(used.where("y = 0"))
    model = Model(weights, lam, k, np.zeros(6))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.evidence(n, [(0, 0, s) for s in f]) for n, f in zip(batch.column("n").to_pylist(), batch.column("found").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    rows = used.mapInArrow(weigh, "y int, x array<double>").toArrow()  # six numbers for each of `labelled` rows at most
    order = np.lexsort(np.array(rows.column("x").to_pylist()).T)  # sums do not depend on the order of tasks
    model.coefficients = _logistic(np.array(rows.column("x").to_pylist())[order], rows.column("y").to_numpy().astype(float)[order])
    return model


def extreme_values(found: DataFrame) -> tuple[float, float]:
    """lambda and K of P(best > s) = 1 - exp(-K n exp(-lambda s)) from clean texts (n, found: scores of their segments).

    Scores above their median are taken to be exponential there.
    """
    n = max(1, found.agg(F.sum("n")).first()[0] or 0)
    s = found.select(F.explode("found").alias("s"))
    count, lower = s.agg(F.count("*"), F.percentile("s", 0.5)).first()
    if count < 10:
        return 1.0, (count + 1.0) / n
    held, mean = s.where(F.col("s") > lower).agg(F.count("*"), F.avg(F.col("s") - lower)).first()
    lam = min(20.0, 1.0 / max(1e-3, round(mean, 9))) if held else 1.0
    return lam, (held + 1.0) / n * math.exp(min(50.0, lam * lower))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, score, segments array<struct<start, end, score>>) for every row, whole texts.

    segments are the significant ones, by word positions. Null and empty texts have none and get the score of
    a text without evidence; repeated rows stay repeated; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    x = documents(docs, id_col, text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = _Scores(model.weights)
        for batch in batches:
            lengths, values, kept = [], [], []
            for text in batch.column(1):
                n, found = scored_segments(text.as_py(), scores)
                cut = (math.log(model.k * max(n, 1) + 1e-12) - math.log(SIGNIFICANT)) / model.lam
                lengths.append(n)
                values.append(model.score(n, found))
                kept.append([{"start": s, "end": e, "score": v} for s, e, v in found if v > cut])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(values, pa.float64()), pa.array(kept, kind)], ["doc_id", "n_words", "score", "segments"])

    id_type = x.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(scan, f"doc_id {id_type}, n_words long, score double, segments array<struct<start:long,end:long,score:double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of two thirds of the ids; the others are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("segments").cast("long").alias("n_segments"))


def clean(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns.

    Null and empty texts have no evidence and stay (unless most texts are toxic); equal texts share their fate;
    repeated rows stay repeated; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = _Scores(model.weights)
        for batch in batches:
            good = [model.score(*scored_segments(t.as_py() or "", scores)) < threshold for t in batch.column(place)]
            yield batch.filter(pa.array(good, pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # a name may hold a dot
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
