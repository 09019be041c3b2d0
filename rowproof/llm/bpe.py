"""BPE encoding and decoding through a table of distinct words.

1. Tasks split the texts into words and pack them: a pack has its own words once each, and each document as a
   sequence of positions in that list. Packs are bounded by the text in them and are written to a table.
2. The packs' words are dealt out by a hash of the word. Each part of that table encodes its distinct words once
   each and returns the ids to every pack that holds them.
3. A pack's task puts the ids of each document together by position, and joins every id with the table of pieces
   (as many rows as the tokenizer has ids, so it fits beside any task), which decodes it.

Words meet in a shuffle once per pack and not once per occurrence, so a very common word is no hot key; they travel
in compressed columns, and the texts themselves are never shuffled. A row per word instead took more disk than there
is (see the README). A tokenizer whose tokens can cross white space, or which decodes by rules of its own, has the
library encode and decode whole texts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rowproof.llm.common import documents, small_batches, table, written
from rowproof.llm.words import Encoder, chunks, encoder, folded, load

#: Characters of text in a pack at most (one longer document is a pack of its own).
PACK_CHARS = 32_000_000


class _Positions(dict):
    """From a word to its place in the pack's list, counted from 1; new words are added."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit integers, compressed byte by byte."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    parts = [squeeze(a.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()) for a in arrays]
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def _plain(data: bytes) -> list[np.ndarray]:
    import zstandard

    plain, out, at = zstandard.ZstdDecompressor().decompress, [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        out.append(np.frombuffer(np.frombuffer(plain(data[at + 4 : at + 4 + n]), "u1").reshape(4, -1).T.tobytes(), "<u4"))
        at += 4 + n
    return out


def _squeezed_sequence(x: np.ndarray) -> bytes:
    """Numbers of which most are small: one byte below 192, else a byte for the range and 14 bits within it."""
    over = x.astype(np.int64) - 192
    range_ = np.minimum(over >> 14, 63)
    lead = np.where(over < 0, x, 192 + range_)
    within, far = over[(over >= 0) & (range_ < 63)], over[range_ == 63]
    return _bytes(lead, within & 0xFF, (within & 0x3FFF) >> 8) + _squeezed(far)


def _plain_sequence(data: bytes) -> np.ndarray:
    import zstandard

    plain, parts, at = zstandard.ZstdDecompressor().decompress, [], 0
    for _ in range(3):
        (n,) = struct.unpack_from("<I", data, at)
        parts.append(np.frombuffer(plain(data[at + 4 : at + 4 + n]), "u1").astype(np.int64))
        at += 4 + n
    lead, low, high = parts
    (far,) = _plain(data[at:])
    out = lead.copy()
    near = (lead >= 192) & (lead < 255)
    out[near] = 192 + ((lead[near] - 192) << 14) + (high << 8) + low
    out[lead == 255] = 192 + far.astype(np.int64)
    return out


def _bytes(*arrays: np.ndarray) -> bytes:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=6).compress
    parts = [squeeze(a.astype("u1").tobytes()) for a in arrays]
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def _packs(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row with the documents of each pack (bucket -1), and one with its words of each bucket."""
    from pyspark import TaskContext
    import zstandard

    partition, k = TaskContext.get().partitionId(), 0
    squeeze = zstandard.ZstdCompressor(level=3).compress
    types = [pa.int64(), pa.int32(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def full() -> pa.RecordBatch:
        at = np.concatenate(seqs)
        uses = np.bincount(at, minlength=len(positions))
        uses[0] = len(at) + 1  # the empty word stays the first
        by_use = np.argsort(-uses, kind="stable")  # frequent words get small numbers, which compress better
        number = np.empty(len(by_use), np.int64)
        number[by_use] = np.arange(len(by_use))
        words = list(positions)
        words = [words[i] for i in by_use.tolist()]
        bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int64, len(words))
        bucket[0] = -1  # the empty word
        order = np.argsort(bucket, kind="stable")[1:]
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
        pack = (partition << 24) + k
        rows = [(pack, -1, ids, lengths, _squeezed_sequence(number[at]), None)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[a:b]
            rows.append((pack, int(bucket[own[0]]), None, None, _squeezed(np.diff(own, prepend=0)), squeeze("\n".join([words[i] for i in own.tolist()]).encode("utf-8", "surrogatepass"))))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["pack", "bucket", "ids", "lengths", "places", "words"])

    positions, ids, lengths, seqs, held = _Positions({"": 0}), [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if held and held + len(text) > PACK_CHARS:
                yield full()
                positions, ids, lengths, seqs, held, k = _Positions({"": 0}), [], [], [], 0, k + 1
            words = chunks(folded(text))
            at = np.fromiter(map(positions.__getitem__, words), "<u4", len(words))
            at = at[at > 0]
            ids.append(doc_id)
            lengths.append(len(at))
            seqs.append(at)
            held += len(text)
    if ids:
        yield full()


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Words by bucket (sorted) -> for each pack the places, numbers of ids and ids of its words of the bucket."""
    import zstandard

    encode, plain = encoder(path), zstandard.ZstdDecompressor().decompress
    known: dict[str, list[int]] = {}
    bucket = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                known, bucket = {}, row["bucket"]  # the distinct words of this bucket, each encoded once
            found = []
            for word in plain(row["words"]).decode("utf-8", "surrogatepass").split("\n"):
                ids = known.get(word)
                if ids is None:
                    known[word] = ids = encode.ids(word)
                found.append(ids)
            n = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for x in found for i in x), np.int64, int(n.sum()))
            data = struct.pack("<I", len(row["places"])) + row["places"] + _squeezed(n, ids)
            yield pa.RecordBatch.from_arrays([pa.array([row["pack"]], pa.int64()), pa.array([data], pa.binary())], ["in_pack", "found"])


def _by_position(found: pa.Table, packs: pa.Table) -> Iterator[tuple]:
    """(doc id, array of its ids) for each document of a pack."""
    parts = []
    for x in found.column("found").to_pylist():
        (k,) = struct.unpack_from("<I", x)
        (gaps,) = _plain(x[4 : 4 + k])
        parts.append((np.cumsum(gaps, dtype=np.int64), *_plain(x[4 + k :])))
    for row in range(packs.num_rows):
        seq = _plain_sequence(packs.column("places")[row].as_py())
        size = 1 + max([0, *(int(p[0].max()) for p in parts if len(p[0])), *([int(seq.max())] if len(seq) else [])])
        count, first = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = 0
        for place, n, ids in parts:
            count[place] = n
            first[place] = at + np.cumsum(n, dtype=np.int64) - n
            at += len(ids)
        ids = np.concatenate([np.zeros(0, "<u4"), *(p[2] for p in parts)])
        end = 0
        for doc_id, length in zip(packs.column("ids")[row].as_py(), packs.column("lengths")[row].as_py(), strict=True):
            own = seq[end : end + length]
            end += length
            n = count[own]
            yield doc_id, ids[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def piece_list(path: str) -> list[str]:
    """The piece of every id of a tokenizer."""
    vocabulary = load(path).get_vocab(with_added_tokens=True)
    out = [""] * (1 + max(vocabulary.values()))
    for piece, i in vocabulary.items():
        out[i] = piece
    return out


def _whole(batches: Iterator[pa.RecordBatch], path: str, finish, types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole texts by the library."""
    tokenizer = load(path)
    numbers = [str(i) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = tokenizer.encode(text.as_py(), add_special_tokens=False).ids
            rows.append((doc_id, len(ids), *finish(ids, numbers, tokenizer.decode(ids, skip_special_tokens=False))))
        columns = zip(*rows, strict=True) if rows else [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def _joined(docs: DataFrame, path: str, id_col: str, text_col: str, fields: list[tuple[str, str]], finish) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    x = documents(docs, id_col, text_col)
    id_type = x.schema["doc_id"].dataType
    arrow_type = to_arrow_type(id_type)
    schema = ", ".join(f"{name} {kind}" for name, kind in [("doc_id", id_type.simpleString()), ("n_tokens", "long"), *fields])
    types = [arrow_type, pa.int64(), *({"string": pa.string(), "array<int>": pa.list_(pa.int32())}[kind] for _, kind in fields)]
    names = ["doc_id", "n_tokens", *(name for name, _ in fields)]
    known = Encoder(path)
    if not known.parts or known.tokenizer.decoder is not None:
        return x.mapInArrow(lambda it: _whole(it, path, finish, types, names), schema)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packs = written(x.mapInArrow(lambda it: _packs(it, arrow_type, buckets), f"pack long, bucket int, ids array<{id_type.simpleString()}>, lengths array<long>, places binary, words binary"), "bpe-packs")
    words = packs.where("bucket >= 0").select("pack", "bucket", "places", "words").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = words.mapInArrow(lambda it: _encoded(it, path), "in_pack long, found binary")
    pieces = spark.sparkContext.broadcast(piece_list(path))  # a string per id of the tokenizer
    numbers = spark.sparkContext.broadcast([str(i) for i in range(len(pieces.value))])

    def together(own: pa.Table, own_packs: pa.Table) -> pa.Table:
        if not own_packs.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        rows = []
        for doc_id, ids in _by_position(own, own_packs):
            at = ids.tolist()
            rows.append((doc_id, len(at), *finish(at, numbers.value, _text(at, pieces.value))))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    documents_ = packs.where("bucket < 0").select("pack", "ids", "lengths", "places")
    return found.groupBy("in_pack").cogroup(documents_.groupBy("pack")).applyInArrow(together, schema)


def _text(ids: list[int], pieces: list[str]) -> str:
    return " ".join(map(pieces.__getitem__, ids))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded string), one row per input row.

    Null and empty texts have no ids and decode to an empty text; repeated rows and ids stay repeated; an empty
    table gives no rows; other columns are not looked at. Special tokens written in a text are encoded as the library does it.
    """
    return _joined(docs, path, id_col, text_col, [("ids", "array<int>"), ("decoded", "string")], lambda ids, numbers, decoded: (ids, decoded))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode(), with SHA-256 digests of the ids (decimal, joined by one space) and of the decoded text."""

    def finish(ids: list[int], numbers: list[str], decoded: str) -> tuple[str, str]:
        return hashlib.sha256(_text(ids, numbers).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()

    return _joined(docs, path, id_col, text_col, [("ids_sha256", "string"), ("decoded_sha256", "string")], finish)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of rows with arrays of ids, by a join of the ids with the tokenizer's pieces.

    For tokenizers without a decoder of their own (others raise ValueError). Null and empty arrays decode to an empty
    text; ids that the tokenizer does not have are passed over; rows with the same id and ids are one.
    """
    if load(path).decoder is not None:
        raise ValueError("this tokenizer decodes by rules of its own; use encode_decode()")
    pieces = encoded.sparkSession.createDataFrame(list(enumerate(piece_list(path))), "id int, piece string")
    x = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids")).distinct()
    one = x.select("doc_id", "ids", F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(pieces), "id", "left")  # a row per id of the tokenizer
    one = one.groupBy("doc_id", "ids").agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))).alias("x"))
    return one.select("doc_id", F.concat_ws(" ", F.transform("x", lambda y: y.piece)).alias("decoded"))


def op10_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of ids, and digests of its ids and of the text decoded from them."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
