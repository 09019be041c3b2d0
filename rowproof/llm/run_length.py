"""Exact substring dedup with run-length indexes (run-compressed Burrows-Wheeler transforms).

A byte is removed where a string of LENGTH bytes that covers it starts earlier too. To let equal strings meet
without comparing all texts with all:

1. Exact copies of a whole text are settled by their digest.
2. Every string of LENGTH bytes has an anchor: of the ANCHOR-byte strings inside it the one with the least hash
   (the leftmost of equal ones). Equal strings have equal anchors, so only strings whose anchor occurs at least
   twice can repeat. The strings of one anchor occurrence are a stretch of text, its context. Texts are hashed once;
   from then on stretches are known by their places.
3. Equal contexts are one, with their first place. The distinct contexts of an anchor then go to one batch (many
   anchors to a batch), which becomes a run-length index: of its transform only the runs are kept, with the text
   place and match length of each run's first suffix. All contexts are streamed through the runs from their ends, a
   byte at a time: that gives each string its rank, and the samples give its match length. Strings whose match is
   at least LENGTH long are equal to the one ranked before; the first of each group is kept.
4. An anchor with more than GROUP distinct contexts is split: its strings are dealt by their distance from the anchor
   in steps of WIDTHS, and by the bytes that all strings of a step share, until no group has more. Equal strings
   have equal distances and bytes, so none are parted; at the last step a group is a single string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.llm.common import documents, dropped, small_batches, table, written

LENGTH, ANCHOR = 100, 32
#: Distinct contexts of a group at most, and the steps of distance that a larger one is split by.
GROUP, WIDTHS = 4096, (32, 16, 8, 4, 2, 1)
#: Bytes that are hashed at a time, and bytes of contexts in a batch at least.
SEGMENT, BATCH = 1 << 20, 1 << 17
_U = np.uint64
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], _U)


def _anchor_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all ANCHOR-byte strings of b."""
    w = b.astype(_U)
    w = w[:-1] | (w[1:] << _U(8))
    w = w[:-2] | (w[2:] << _U(16))
    w = w[:-4] | (w[4:] << _U(32))
    n = len(b) - ANCHOR + 1
    h = w[:n] * _C[0]
    for i in range(1, ANCHOR // 8):
        h += w[8 * i : 8 * i + n] * _C[i]
        h ^= h >> _U(29)
    h *= _C[4]
    h ^= h >> _U(32)
    h *= _C[5]
    return h ^ (h >> _U(29))


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes the place of the least (by its upper 40 bits; the leftmost of equal ones)."""
    m = (h & _U(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=_U)
    size = 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(h) - width + 1], m[width - size :][: len(h) - width + 1])
    return (m & _U(0xFFFFFF)).astype(np.int64)


def stretches(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text number, places, anchor hashes): strings of LENGTH bytes by anchor occurrence, in text order.

    A stretch is a number of strings at consecutive starts with the same anchor occurrence; see place(). Short texts
    are hashed together, long ones in overlapping segments; a stretch may be cut where segments meet.
    """
    group: list[tuple[int, int, bytes]] = []
    held = 0

    def work(parts: list[tuple[int, int, bytes]]):
        joined = b"".join(p for _, _, p in parts)
        if len(joined) < LENGTH:
            return
        h = _anchor_hashes(np.frombuffer(joined, np.uint8))
        at = _leftmost_least(h, LENGTH - ANCHOR + 1)
        begin = 0
        for number, offset, part in parts:
            n = len(part) - LENGTH + 1
            if n > 0:
                own = at[begin : begin + n]
                starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
                yield number, place(starts + offset, np.diff(np.append(starts, n)), own[starts] - begin - starts), h[own[starts]].view(np.int64)
            begin += len(part)

    for number, text in enumerate(texts):
        if len(text) > SEGMENT:
            for offset in range(0, len(text) - LENGTH + 1, SEGMENT):
                yield from work([(number, offset, text[offset : offset + SEGMENT + LENGTH - 1])])
            continue
        if held + len(text) > SEGMENT:
            yield from work(group)
            group, held = [], 0
        group.append((number, 0, text))
        held += len(text)
    yield from work(group)


def place(start, count, anchor):
    """A stretch in one number: its first string's start, how many strings, and where the anchor is from that start."""
    return (start << 14) | (count << 7) | anchor


def placed(x):
    """(start, count, anchor) of a place."""
    return x >> 14, (x >> 7) & 127, x & 127


class RunLengthIndex:
    """The run-compressed transform of several byte strings (contexts), each ended by a terminator of its own.

    starts: where each run begins; base: where the transform's symbols of a run are among the sorted suffixes (so
    that a step to the left is base + distance from the run's start); sample_place and sample_length: for each run
    the text place of its first suffix and the length of that suffix's match with the one sorted before it.
    Nothing else of the sorted suffixes is kept.
    """

    def __init__(self, contexts: list[bytes]):
        lengths = np.array([len(c) for c in contexts], np.int64)
        n = int(lengths.sum()) + len(contexts)
        self.lengths, self.n = lengths, n
        self.ends = np.cumsum(lengths + 1) - 1  # places of the terminators, each smaller than any byte and than those after it
        code = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.ends] = False
        code[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 1
        left = np.repeat(self.ends, lengths + 1) - np.arange(n)  # bytes up to the terminator
        order = _sorted_suffixes(code, left, np.repeat(np.arange(len(contexts)), lengths + 1))

        before = np.where(order > 0, code[order - 1], 0)
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)  # terminators differ from each other
        self.starts = heads = np.flatnonzero(head)
        a, b = order[heads], order[np.maximum(heads - 1, 0)]
        self.sample_place, self.sample_length = a, _common(a, b, code, left)
        self.sample_length[heads == 0] = 0
        symbol = before[heads]
        size = np.diff(np.append(heads, n))
        by_symbol = np.argsort(symbol, kind="stable")  # runs of a symbol, in order, make up the suffixes that begin with it
        by_symbol = by_symbol[symbol[by_symbol] > 0]
        self.base = np.zeros(len(heads), np.int64)
        self.base[by_symbol] = len(contexts) + np.cumsum(size[by_symbol]) - size[by_symbol]

    @property
    def runs(self) -> int:
        return len(self.starts)

    def matches(self) -> np.ndarray:
        """Of each text place the length of its match with the suffix sorted before it.

        One pass over the text: a sample says how far a match reaches, and up to there it shortens by one per byte.
        """
        reach = np.zeros(self.n, np.int64)
        reach[self.sample_place] = self.sample_place + self.sample_length
        return np.maximum.accumulate(reach) - np.arange(self.n)

    def ranks(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, ranks among the suffixes) of all places with `length` bytes ahead of them.

        All contexts at once are walked through the runs from their terminators, one byte to the left a step.
        """
        long_ = np.flatnonzero(self.lengths >= length)
        by_length = long_[np.argsort(-self.lengths[long_], kind="stable")]
        most, ends = self.lengths[by_length], self.ends[by_length]
        rank = by_length.copy()  # terminators come first, in text order
        places, ranks = [], []
        for step in range(1, int(most.max(initial=0)) + 1):
            live = int(np.searchsorted(-most, -step, side="right"))
            run = np.searchsorted(self.starts, rank[:live], side="right") - 1
            rank = self.base[run] + rank[:live] - self.starts[run]
            if step >= length:
                places.append(ends[:live] - step)
                ranks.append(rank)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *ranks])

    def first(self, length: int) -> np.ndarray:
        """For every place with `length` bytes ahead of it: does that string start nowhere earlier?"""
        places, ranks = self.ranks(length)
        out = np.zeros(self.n, bool)
        if len(places):
            heads = np.sort(ranks[self.matches()[places] < length])  # a shorter match begins a group of equal strings
            group = np.searchsorted(heads, ranks, side="right") - 1
            earliest = np.full(len(heads), self.n)
            np.minimum.at(earliest, group, places)
            out[earliest] = True
        return out


def _sorted_suffixes(code: np.ndarray, left: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, by doubling; only what is still tied is sorted again.

    code has 0 for terminators, left the bytes up to the terminator, number the context's number.
    """
    n = len(code)

    def ahead(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[: n - k] = x[k:]
        out[left < k] = 0
        return out

    two = (code << 9) | ahead(code, 1)
    four = (two << 18) | ahead(two, 2)
    key = (four << 27) | (ahead(two, 4) << 9) | ahead(code, 6)
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    tied, values, size = np.arange(n), key[order], 7
    while True:
        head = np.ones(len(tied), bool)
        head[1:] = values[1:] != values[:-1]
        first = np.flatnonzero(head)
        rank[order[tied]] = np.repeat(tied[first], np.diff(np.append(first, len(tied))))
        single = head & np.append(head[1:], True)
        tied = tied[~single]
        if not len(tied):
            return order
        own = order[tied]
        # suffixes that end within `size` bytes are told apart by their terminators
        after = np.where(left[own] < size, number[own], n + rank[np.minimum(own + size, n - 1)])
        values = rank[own] * (2 * n + 1) + after
        by = np.argsort(values)
        order[tied], values = own[by], values[by]
        size *= 2


def _common(a: np.ndarray, b: np.ndarray, code: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of the suffixes at a and b."""
    most = np.minimum(left[a], left[b])
    done = np.zeros(len(a), np.int64)
    word = np.zeros(len(code), np.uint64)  # eight symbols from each place on, without their ninth bit, which only tells a terminator
    for i in range(8):
        word[: len(code) - i] |= (code[i:] & 255).astype(np.uint64) << np.uint64(8 * i)
    live = np.flatnonzero(most > 0)
    while len(live):
        x = word[a[live] + done[live]] ^ word[b[live] + done[live]]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.floor(np.log2(np.maximum(low, np.uint64(1)).astype(float))).astype(np.int64) >> 3)
        done[live] = np.minimum(done[live] + same, most[live])
        live = live[(same == 8) & (done[live] < most[live])]
    return done


def _texts(column) -> list[bytes]:
    return [x.as_py().encode("utf-8", "surrogatepass") for x in column]


_LONGS = pa.list_(pa.int64())


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tie, places, hs) of each text; a long text has several rows."""
    for batch in batches:
        where, places, hs = [], [], []
        for number, at, h in stretches(_texts(batch.column(2))):
            where.append(number)
            places.append(at)
            hs.append(h)
        rows = pa.array(where, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(places, _LONGS), pa.array(hs, _LONGS)], ["doc_id", "tie", "places", "hs"])


_GROUPED = "h long, doc_id long, tie long, start long, anchor int, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tie, text, repeated stretches) -> a row per stretch with its bytes."""
    for batch in batches:
        for row, text in enumerate(_texts(batch.column(2))):
            found = batch.column(3)[row].values
            start, count, anchor = placed(found.field("place").to_numpy())
            parts = [text[s:e] for s, e in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)]
            where = pa.array(np.full(len(parts), row))
            columns = [found.field("h"), batch.column(0).take(where), batch.column(1).take(where), pa.array(start), pa.array(anchor.astype(np.int32)), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "tie", "start", "anchor", "context"])


def _split(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Contexts cut into those of strings whose distance from the anchor is in the same step, grouped by what these share."""
    for batch in batches:
        out: list[tuple] = []
        for row, (h, start, anchor, context) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("h", "start", "anchor", "context")), strict=True)):
            nearest = anchor - (len(context) - LENGTH)  # distances go from there up to `anchor`
            for step in range(nearest // width, anchor // width + 1):
                low, high = max(nearest, step * width), min(anchor, step * width + width - 1)
                begin, common = anchor - high, anchor - step * width
                part, shared = context[begin : anchor - low + LENGTH], context[common : common + LENGTH - width + 1]
                key = hashlib.blake2b(b"%d %d %d " % (h, width, step) + shared, digest_size=8).digest()
                out.append((int.from_bytes(key, "little", signed=True), row, start + begin, high, part))
        hs, rows, starts, anchors, parts = zip(*out, strict=True) if out else ((),) * 5
        where = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), batch.column("doc_id").take(where), batch.column("tie").take(where), pa.array(starts, pa.int64()), pa.array(anchors, pa.int32()), pa.array(parts, pa.binary())], ["h", "doc_id", "tie", "start", "anchor", "context"])


def _first_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by group and place -> runs of strings that start nowhere earlier."""
    rows: list[pa.RecordBatch] = []
    held = 0

    def index(t: pa.Table) -> pa.RecordBatch:
        h, start = t.column("h").to_numpy(), t.column("start").to_numpy()
        alone = np.append(h[1:] != h[:-1], True) & np.append(True, h[1:] != h[:-1])  # the only context of its group: nothing to match
        own, begin, n = np.flatnonzero(alone), start[alone], pc.binary_length(t.column("context")).to_numpy()[alone] - LENGTH + 1
        if not alone.all():
            other = np.flatnonzero(~alone)
            contexts = t.column("context").take(pa.array(other)).to_pylist()
            built = RunLengthIndex(contexts)
            edge = np.diff(np.concatenate([[0], built.first(LENGTH).view(np.int8), [0]]))
            from_, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            starts = built.ends - built.lengths
            at = np.searchsorted(starts, from_, side="right") - 1
            own, begin, n = np.concatenate([own, other[at]]), np.concatenate([begin, start[other[at]] + from_ - starts[at]]), np.concatenate([n, to - from_])
        where = pa.array(own)
        return pa.RecordBatch.from_arrays([t.column("doc_id").take(where).combine_chunks(), t.column("tie").take(where).combine_chunks(), pa.array(begin, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "tie", "start", "n"])

    for batch in batches:
        rows.append(batch)
        held += batch.column("context").nbytes
        if held < BATCH:
            continue
        t = pa.Table.from_batches(rows)
        h = t.column("h").to_numpy()
        cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0  # the last group may go on in the next batch
        if cut:
            yield index(t.slice(0, cut))
            rest = t.slice(cut)
            rows, held = rest.to_batches(), rest.column("context").nbytes
    if rows:
        yield index(pa.Table.from_batches(rows))


def removed_spans(n: int, repeated: np.ndarray, first: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed byte runs (start, end) of n bytes: strings of the repeated places but for those that come first."""
    if n < LENGTH or not len(repeated):
        return []
    step = np.zeros(n - LENGTH + 2, np.int64)
    start, count, _ = placed(repeated)
    np.add.at(step, start, 1)
    np.add.at(step, start + count, -1)
    gone = np.cumsum(step[:-1]) > 0
    for s, k in first:
        gone[s : s + k] = False
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(gone)
    change[at] += 1
    change[at + LENGTH] -= 1
    covered = np.cumsum(change[:n]) > 0
    edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _distinct(contexts: DataFrame) -> DataFrame:
    """Equal contexts of a group as one, with the first place; pre-aggregated, so a very common passage is no hot group."""
    x = contexts.groupBy("h", "context").agg(F.min(F.struct("doc_id", "tie", "start", "anchor")).alias("at"))
    return written(x.select("h", "at.doc_id", "at.tie", "at.start", "at.anchor", "context"), "repeat-contexts")


def _bounded(distinct: DataFrame) -> DataFrame:
    """The same strings in groups of at most GROUP contexts."""
    out = None
    for width in WIDTHS:
        large = written(distinct.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("h"), "repeat-large")
        if large.isEmpty():
            break
        small = distinct.join(large, "h", "left_anti")
        out = small if out is None else out.unionByName(small)
        distinct = _distinct(distinct.join(large, "h").select("h", "doc_id", "tie", "start", "anchor", "context").mapInArrow(lambda it, w=width: _split(it, w), _GROUPED))
    return distinct if out is None else out.unionByName(distinct)


def repeats(docs: DataFrame, finish, fields: str, types: list[tuple[str, pa.DataType]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, *finish(text bytes, removed spans)), one per input row.

    Earlier means a smaller id, or an earlier start in the same document; null ids come before all others. Null
    text is empty; texts shorter than LENGTH bytes lose nothing. Rows with the same id and text count as one
    document and get the same result; of other rows with the same id the one with the smaller text hash comes
    first. Matches never cross documents. An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    lowest = F.lit(-(2**63))
    x = documents(docs, id_col, text_col)
    x = x.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("doc_id"), F.xxhash64("text").alias("tie"), "text", F.col("doc_id").isNull().alias("no_id"))

    digests = x.where(F.octet_length("text") >= LENGTH).select("doc_id", "tie", F.md5(F.col("text").cast("binary")).alias("digest"))
    firsts = written(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeat-digests")
    copies = written(digests.join(firsts, "digest").where("doc_id <> first").select("doc_id", "tie").distinct(), "repeat-copies")
    own = x.where(F.octet_length("text") >= LENGTH).join(copies, ["doc_id", "tie"], "left_anti").select("doc_id", "tie", "text")

    hashed = written(own.mapInArrow(_anchors, "doc_id long, tie long, places array<long>, hs array<long>"), "repeat-hashes")
    # a table of its own, so that a join with a very common anchor can be split
    often = written(hashed.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeat-often")
    anchors = hashed.select("doc_id", "tie", F.explode(F.arrays_zip("hs", "places")).alias("x")).select("doc_id", "tie", F.col("x.hs").alias("h"), F.col("x.places").alias("place"))
    marked = written(anchors.join(often, "h").groupBy("doc_id", "tie").agg(F.collect_set(F.struct("h", "place")).alias("repeated")), "repeat-anchors")
    dropped(hashed)

    contexts = own.join(marked, ["doc_id", "tie"]).select("doc_id", "tie", "text", "repeated").mapInArrow(_contexts, _GROUPED)
    groups = _bounded(_distinct(contexts))
    first = groups.repartition("h").sortWithinPartitions("h", "doc_id", "tie", "start").mapInArrow(_first_strings, "doc_id long, tie long, start long, n long")
    first = written(first.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("first")), "repeat-firsts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, repeated, first, copy in zip(_texts(batch.column("text")), batch.column("repeated"), batch.column("first"), batch.column("copy").to_pylist(), strict=True):
                if copy:
                    spans = [(0, len(text))]
                elif repeated.is_valid:
                    n = first.values
                    spans = removed_spans(len(text), repeated.values.to_numpy(), list(zip(n.field("start").to_pylist(), n.field("n").to_pylist(), strict=True)) if first.is_valid else [])
                else:
                    spans = []
                rows.append(finish(text, spans))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in types]
            ids = pa.array([None if no else i for i, no in zip(batch.column("doc_id").to_pylist(), batch.column("no_id").to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, kind) for c, (_, kind) in zip(columns, types, strict=True))], ["doc_id", *(name for name, _ in types)])

    known = marked.select("doc_id", "tie", F.transform("repeated", lambda r: r.place).alias("repeated")).join(first, ["doc_id", "tie"], "left")
    known = known.select("doc_id", "tie", "repeated", "first", F.lit(False).alias("copy"))
    known = known.unionByName(copies.select("doc_id", "tie", F.lit(None).cast("array<long>").alias("repeated"), F.lit(None).cast("array<struct<start:long,n:long>>").alias("first"), F.lit(True).alias("copy")))
    return x.join(known, ["doc_id", "tie"], "left").select("doc_id", "no_id", "text", "repeated", "first", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(work, f"doc_id long, {fields}")


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The remaining bytes, concatenated."""
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, removed array<struct<start, end>>, kept binary), by bytes; see repeats() for the cases."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return repeats(docs, lambda t, s: ([{"start": a, "end": b} for a, b in s], kept(t, s)), "removed array<struct<start:long,end:long>>, kept binary", [("removed", span), ("kept", pa.binary())], id_col, text_col)


def op2_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that strings of 100 bytes starting earlier cover, removed: counts and a digest of the rest."""
    def digest(text: bytes, s: list[tuple[int, int]]) -> tuple:
        return len(text), sum(b - a for a, b in s), len(s), hashlib.sha256(kept(text, s)).hexdigest()

    return repeats(table(spark, sf_dir, "documents"), digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", [*((n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string())])
