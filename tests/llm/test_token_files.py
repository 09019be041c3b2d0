import zlib

import numpy as np
import public_tokenizers
import pytest

from rowproof.llm import token_files as tf
from rowproof.llm.words import load

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tokenizer, start, out = load(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    rows = [(5, "Hello, world's <|endoftext|> end"), (2, None), (9, ""), (7, "a b　c d\x1ce\x0bf"), (11, "é é ́x İß"), (3, "word " * 5000), (8, "x" * 70_000), (10, "Hello")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, start string")
    files = tf.write(df, PATH)
    got = sorted((r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(bytes(r.ids))) for r in files.documents().collect())
    assert got == expected(rows)
    some = {r.doc_id: (r.start, bytes(r.ids)) for r in files.fetch([3, 9, 1000]).collect()}
    whole = {r.doc_id: (r.start, bytes(r.ids)) for r in files.documents().collect()}
    assert some == {k: whole[k] for k in (3, 9)}


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tf.write(empty, PATH).documents().count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = sorted(tf.write(twice, PATH).documents().collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start) for r in got] == [(None, 0), (1, 2), (1, 5)]


def test_damage_is_noticed(tmp_path):
    path = tmp_path / "x.zst"
    with open(path, "wb") as f:
        w = tf.Writer(f)
        for i in range(1000):
            w.add(i, np.arange(i, dtype="<u4").tobytes())
        w.close()
    data = bytearray(path.read_bytes())
    with open(path, "rb") as f:
        assert [len(x) // 4 for _, x in tf.Reader(f, len(data)).read()] == list(range(1000))
        assert [(i, len(x) // 4) for i, x in tf.Reader(f, len(data)).read(np.array([999, 3]))] == [(3, 3), (999, 999)]
    data[100] ^= 1
    path.write_bytes(data)
    with open(path, "rb") as f, pytest.raises(Exception):
        list(tf.Reader(f, len(data)).read())


def test_plain_zstandard_reads_it(tmp_path):
    import io

    import zstandard

    out = io.BytesIO()
    w = tf.Writer(out)
    w.add(1, np.arange(500_000, dtype="<u4").tobytes())
    w.add(2, np.arange(7, dtype="<u4").tobytes())
    w.close()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert plain == np.concatenate([np.arange(500_000), np.arange(7)]).astype("<u4").tobytes()


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in tf.op5_token_files(spark, d).collect())
    assert got == sorted(expected(rows))
