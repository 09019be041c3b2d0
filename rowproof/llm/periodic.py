"""Runs of periodic repetition in sequences of words, by multi-scale minimizers.

A run is a stretch with smallest period q and length at least 2 q that no neighbouring word extends. Short periods are
found by scanning each lag. A longer period q belongs to the scale w (a power of two) with 2 w <= q < 4 w: the window
minima of w hashed word groups repeat at distance q inside the run, so equal minimizers (by the fingerprint of the w
words from there on) at such a distance are seeds, which are extended word by word.

Inside a run of a small period (w / 2 at most) minimizers are as dense as that period and their pairs tell nothing.
They are left out, and the small run's two ends stand for them; where two small runs of one period meet, all longer
periods across their border follow from their phases. Either way a run of period q has a seed (its first w word groups
have a minimizer; if that lies in a small run, Fine and Wilf's theorem says that the small run ends or begins within
reach, or fills the run's first period up to the border). Seeds per word are bounded by a constant.

Documents are independent of each other, so tasks work through them where they lie; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm.common import small_batches, table

#: Shortest run, the scale from which minimizers are used (lags below twice that are scanned), words of a hashed group.
LEAST, SCALE, GRAM = 12, 16, 4
#: Words that are searched together about; one document is never parted.
TOGETHER = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)


def stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of at least `least` true values."""
    at = np.flatnonzero(equal)
    if len(at) < least or not (at[least - 1 :] - at[: len(at) - least + 1] == least - 1).any():
        return []
    cuts = np.flatnonzero(np.diff(at) != 1)
    start, end = at[np.concatenate(([0], cuts + 1))], at[np.concatenate((cuts, [len(at) - 1]))] + 1
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def runs(words: np.ndarray, longest: int | None = None, least: int = LEAST, scale: int = SCALE) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of length >= max(least, 2 * period), by start and period.

    `words` are whole numbers; where several sequences follow each other, different negative numbers part them and
    `longest` is the length of the longest. Numbers that part sequences never repeat, so no run crosses them.
    """
    longest = len(words) if longest is None else longest
    found: dict[tuple[int, int], int] = {}  # the first period entered for a stretch is the smallest: they come in order
    for q in range(1, min(2 * scale, longest // 2 + 1)):
        for start, end in stretches(words[q:] == words[:-q], max(least - q, q)):
            found.setdefault((start, end + q), q)
    if longest >= 4 * scale:
        _long_periods(words, longest, scale, found)
    return sorted((start, end - start, q) for (start, end), q in found.items() if end - start >= max(least, 2 * q))


def _long_periods(words: np.ndarray, longest: int, w: int, found: dict[tuple[int, int], int]) -> None:
    n = len(words)
    with np.errstate(over="ignore"):
        x = words.astype(np.uint64) * _ODD
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _ODD))))
        back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, np.uint64(pow(int(_ODD), -1, 1 << 64))))))
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * power[:n])))

        def prints(at: np.ndarray, length: int) -> np.ndarray:
            return (prefix[at + length] - prefix[at]) * back[at]

        groups = prints(np.arange(max(0, n - GRAM + 1)), GRAM)
        groups = (groups ^ (groups >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    least_at, width = np.arange(len(groups)), 1
    while 4 * w <= longest:
        while width < w:
            # the leftmost minimum of twice the width, from those of the halves
            a, b = least_at[: len(least_at) - width], least_at[width:]
            least_at, width = np.where(groups[a] <= groups[b], a, b), 2 * width
        at = least_at[np.concatenate(([True], least_at[1:] != least_at[:-1]))] if len(least_at) else least_at
        small = sorted((s, e, q) for (s, e), q in found.items() if 2 * q <= w and e - s >= w)
        if small:
            edge = np.zeros(n + 1, np.int32)
            s, e = np.array([r[0] for r in small]), np.array([r[1] for r in small])
            np.add.at(edge, s, 1)
            np.add.at(edge, e - w + 1, -1)
            at = np.concatenate((at[np.cumsum(edge)[at] == 0], s, e - w))
        at = np.unique(at[at + w <= n])
        seeds = _pairs(at, prints(at, w), w) + _borders(words, small, prints, w)
        reach, lag = 0, 0
        for q, p in sorted(set(seeds)):
            if q == lag and p < reach:
                continue
            start, reach = extended(words, p, q)
            lag = q
            if reach - start >= q:
                found.setdefault((start, reach + q), q)
        w *= 2


def _pairs(at: np.ndarray, mark: np.ndarray, w: int) -> list[tuple[int, int]]:
    """(distance, first place) of the places with equal marks at distances of 2 w to 4 w - 1."""
    order = np.lexsort((at, mark))
    at, mark = at[order], mark[order]
    out, step = [], 1
    while step < len(at):
        far = at[step:] - at[:-step]
        near = (mark[step:] == mark[:-step]) & (far < 4 * w)
        if not near.any():
            break
        hit = np.flatnonzero(near & (far >= 2 * w))
        out += zip(far[hit].tolist(), at[hit].tolist(), strict=True)
        step += 1
    return out


def _borders(words: np.ndarray, small: list[tuple[int, int, int]], prints, w: int) -> list[tuple[int, int]]:
    """Seeds across the border of two small runs of one period that meet or overlap: distances that bring the first
    into the phase of the second."""
    out = []
    small = sorted(small, key=lambda r: (r[2], r[0]))
    for (s, e, q), (s2, e2, q2) in zip(small, small[1:], strict=False):
        most = min(4 * w - 1, e - s, e2 - s2)
        if q == q2 and s2 <= e and most >= 2 * w:
            from_ = e - q
            same = np.flatnonzero(prints(np.arange(s2, s2 + q), q) == prints(np.array([from_]), q))
            for shift in (s2 - from_ + same).tolist():
                first = shift + -(-(2 * w - shift) // q) * q
                # the place of the first run's last words that meets the second run's first ones
                out += [(lag, max(s, s2 - lag)) for lag in range(first, most + 1, q)]
    return out


def extended(words: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """(start, end) of the stretch around p in which words at distance q are equal; (p, p) where they differ at p."""
    n, end, chunk = len(words) - q, p, 64
    while end < n:
        size = min(chunk, n - end)
        differ = words[end : end + size] != words[end + q : end + q + size]
        k = int(differ.argmax())
        if differ[k]:
            end += k
            break
        end, chunk = end + size, 2 * chunk
    if end == p:
        return p, p
    start, chunk = p, 64
    while start:
        size = min(chunk, start)
        differ = words[start - size : start][::-1] != words[start + q - size : start + q][::-1]
        k = int(differ.argmax())
        if differ[k]:
            start -= k
            break
        start, chunk = start - size, 2 * chunk
    return start, end


def search(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    order = sorted((i for i, words in enumerate(texts) if len(words) >= LEAST), key=lambda i: -len(texts[i]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for group in _groups(order, [len(x) for x in texts]):
        parts, starts, at = [], [], 0
        for k, i in enumerate(group):
            parts += [np.fromiter(map(numbers.__getitem__, texts[i]), np.int64, len(texts[i])), np.array([-1 - k])]
            starts.append(at)
            at += len(texts[i]) + 1
        found = runs(np.concatenate(parts), len(texts[group[0]]))
        for k, (start, length, period) in zip(np.searchsorted(starts, [r[0] for r in found], "right") - 1, found, strict=True):
            out[group[k]].append((start - starts[k], length, period))
    return out


def _groups(order: list[int], sizes: list[int]) -> Iterator[list[int]]:
    """Documents together that are half as long as the group's longest at least; all of those too short for minimizers."""
    group: list[int] = []
    held = 0
    for i in order:
        longest = sizes[group[0]] if group else 0
        if group and (held + sizes[i] > TOGETHER or (longest >= 4 * SCALE and sizes[i] < longest // 2)):
            yield group
            group, held = [], 0
        group.append(i)
        held += sizes[i]
    if group:
        yield group


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with their end made periodic, for each tenth id by its checksum (for tests of the search at scale)."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * -(-(n - a) // p))[: n - a]


def collapsed(words: list[bytes], found: Iterable[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return words if keep.all() else [words[i] for i in np.flatnonzero(keep)]


_OUT = [("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs_sha256", "string"), ("text", "string")]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tails: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, text): per row of docs its runs.

    Words are parted by ASCII white space and numbered from 0. start, length, period and exponent_milli are those of
    the longest run (ties: smaller start, then period) and null without runs. runs_sha256 is the digest of all runs as
    lines `start,length,period`. text has the words that no run contains after its first period, joined by a space.
    Null and empty texts have no words and no runs. Repeated rows stay repeated, and each is searched for itself; an
    empty table gives no rows. With `tails`, texts are changed by repeated_tail() first (not those of a null id).
    """
    spark = docs.sparkSession
    small_batches(spark)
    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = x.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            # bytes.split() parts at ASCII white space, and at nothing else
            texts = [t.split() for t in batch.column(1).to_pylist()]
            if tails:
                texts = [repeated_tail(t, i) for t, i in zip(texts, ids.to_pylist(), strict=True)]
            rows = [_row(words, found) for words, found in zip(texts, search(texts), strict=True)]
            columns = [pa.array(c, pa.string() if kind_ == "string" else pa.int64()) for c, (_, kind_) in zip(zip(*rows, strict=True), _OUT, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *(name for name, _ in _OUT)])

    return x.mapInArrow(of, f"doc_id {kind}, " + ", ".join(f"{name} {kind_}" for name, kind_ in _OUT))


def _row(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(found), *longest, listed, b" ".join(collapsed(words, found)).decode())


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document (a tenth of them with a periodic end), and digests of all runs and of what is left."""
    x = periodic_runs(table(spark, sf_dir, "documents"), tails=True)
    return x.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("text", 256).alias("collapsed_sha256"))
