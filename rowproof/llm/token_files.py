"""Token ids in seekable zstandard files.

A file holds documents in order. Its frames are independent zstandard frames (with zstandard's own content
checksum) of unsigned 32-bit little-endian ids; a frame has whole documents, up to FRAME_BYTES unless one document
is longer. Then come a skippable frame with the documents' ids, frames and lengths, and a skippable frame with the
seek table of the public seekable format: compressed size, decompressed size and a checksum (low half of XXH64) of
each frame. A reader takes the tail, then only the frames that hold the documents it wants.

Files are written by the tasks that encode, through Arrow's file systems (any store, not only local disks), under
a temporary name first, so that a repeated task replaces its own file with the same bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowproof.llm.common import documents, scratch, small_batches, table, written
from rowproof.llm.words import encoder

FRAME_BYTES = 1 << 20
# fixed values of the zstandard seekable format
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: Skippable frame of the documents' index.
SKIPPABLE_INDEX = 0x184D2A50


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes one file to an open stream."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.squeeze = out, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int, int]] = []
        self.held: list[bytes] = []
        self.n_held = self.n_tokens = self.n_bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.n_held and self.n_held + len(ids) > FRAME_BYTES:
            self.end_frame()
        self.docs.append((doc_id or 0, doc_id is not None, len(self.frames), len(ids) // 4))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids) // 4

    def _put(self, frame: bytes, plain: int, checksum: int) -> None:
        self.out.write(frame)
        self.frames.append((len(frame), plain, checksum))
        self.n_bytes += len(frame)

    def end_frame(self) -> None:
        if self.held:
            data = b"".join(self.held)
            self._put(self.squeeze(data), len(data), _checksum(data))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self.end_frame()
        ids, known, frames, lengths = (np.array(x) for x in zip(*self.docs, strict=True))
        index = struct.pack("<Q", len(ids)) + ids.astype("<i8").tobytes() + known.astype("u1").tobytes() + frames.astype("<u4").tobytes() + lengths.astype("<u4").tobytes()
        index = self.squeeze(index)
        self._put(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index, 0, 0)
        entries = b"".join(struct.pack("<III", *x) for x in self.frames)
        tail = entries + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(tail)) + tail)


class Reader:
    """Reads one file from a seekable stream; raises ValueError where a checksum or the format is wrong."""

    def __init__(self, stream, size: int):
        import zstandard

        self.stream, self.plain = stream, zstandard.ZstdDecompressor().decompress
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table")
        table_ = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.plain_sizes, self.checksums = table_.T
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        index = self.plain(self._at(int(self.offsets[n - 1]), int(self.sizes[n - 1]))[8:])
        (k,) = struct.unpack_from("<Q", index)
        self.doc_ids = np.frombuffer(index, "<i8", k, 8)
        self.known = np.frombuffer(index, "u1", k, 8 + 8 * k).astype(bool)
        self.frame_of = np.frombuffer(index, "<u4", k, 8 + 9 * k).astype(np.int64)
        self.lengths = np.frombuffer(index, "<u4", k, 8 + 13 * k).astype(np.int64)

    def _at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(n)

    def frame(self, k: int) -> bytes:
        data = self.plain(self._at(int(self.offsets[k]), int(self.sizes[k])))
        if len(data) != self.plain_sizes[k] or _checksum(data) != self.checksums[k]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def read(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc id, ids) of the documents at the wanted places (all by default), frame by frame."""
        at = np.arange(len(self.doc_ids)) if wanted is None else np.sort(wanted)
        before = np.cumsum(self.lengths) - self.lengths
        first_of = np.searchsorted(self.frame_of, np.arange(len(self.sizes)))
        k, data = -1, b""
        for i in at.tolist():
            if self.frame_of[i] != k:
                k = int(self.frame_of[i])
                data = self.frame(k)
            start = 4 * int(before[i] - before[first_of[k]])
            yield (int(self.doc_ids[i]) if self.known[i] else None), data[start : start + 4 * int(self.lengths[i])]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class TokenFiles:
    """Files of one run: manifest(part, path, n_docs, n_tokens, n_bytes, first_id, last_id), a row per file in order."""

    manifest: DataFrame

    def _read(self, rows: DataFrame, wanted: tuple[int, ...] | None = None) -> DataFrame:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    store, name = _open(row["path"])
                    with store.open_input_file(name) as f:
                        reader = Reader(f, f.size())
                        start = row["start"] + np.cumsum(reader.lengths) - reader.lengths
                        places = np.arange(len(start)) if wanted is None else np.flatnonzero(np.isin(reader.doc_ids, wanted) & reader.known)
                        out: list[tuple] = []
                        n = 0
                        for place, (doc_id, ids) in zip(places.tolist(), reader.read(places), strict=True):
                            out.append((doc_id, int(start[place]), ids))
                            n += len(ids)
                            if n > 4 * FRAME_BYTES:
                                yield _rows(out)
                                out, n = [], 0
                        if out:
                            yield _rows(out)

        n = max(1, rows.count())
        return rows.repartition(n).mapInArrow(read, "doc_id long, start long, ids binary")

    def documents(self) -> DataFrame:
        """(doc_id, start, ids binary) of all documents, read from the files; start counts the ids before it."""
        order = Window.orderBy("part")  # a row per file
        return self._read(self.manifest.select("path", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("start")))

    def fetch(self, doc_ids: list[int]) -> DataFrame:
        """As documents(), for a short list of ids; only frames that hold them are read."""
        wanted = tuple(doc_ids)
        order = Window.orderBy("part")
        rows = self.manifest.withColumn("start", F.sum("n_tokens").over(order) - F.col("n_tokens"))
        near = F.exists(F.array(*(F.lit(x).cast("long") for x in wanted)), lambda x: x.between(F.col("first_id"), F.col("last_id")))
        return self._read(rows.where(near).select("path", "start"), wanted)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    ids, starts, data = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode every text, end it with end_id and write the ids in ascending order of the (whole-number) ids.

    Null ids come first; null and empty texts have the end id alone; of equal ids the text's hash decides the
    order; repeated rows are written repeatedly; an empty table gives no file. One file per range partition.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch(spark, "token-files")
    x = documents(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    x = x.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, words, writer = TaskContext.get(), encoder(tokenizer_path), None
        part = task.partitionId()
        final = f"{folder}/part-{part:06d}.zst"
        early = f"{folder}/_part-{part:06d}-{task.taskAttemptId()}"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    store, name = _open(early)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    writer = Writer(store.open_output_stream(name))
                writer.add(doc_id, words.encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            writer.out.close()
            store.move(name, _open(final)[1])
            known = [d[0] for d in writer.docs if d[1]]
            row = [part, final, len(writer.docs), writer.n_tokens, writer.n_bytes, known[0] if known else None, known[-1] if known else None]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k == 1 else pa.int64()) for k, v in enumerate(row)], ["part", "path", "n_docs", "n_tokens", "n_bytes", "first_id", "last_id"])

    return TokenFiles(written(x.mapInArrow(encode, "part long, path string, n_docs long, n_tokens long, n_bytes long, first_id long, last_id long"), "token-manifest"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document as read back from the files that were written."""
    import public_tokenizers

    read = write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).documents()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            columns = [batch.column("doc_id"), batch.column("start"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
