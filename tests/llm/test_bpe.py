import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from rowproof.llm import bpe
from rowproof.llm.words import Encoder, load

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "É", "ß", "'s", "'", "s", "don't", "!", "|", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "İ", "Σ", "ΑΣ", "1", "½", "ª", "\x1c", "é", "ŉ", "ſ", "_", "ﬁ", "😀", "​", "K", "Å", " ", "\n", "\x0b", "\r", "Hello,", "wörld"]


def texts():
    r = random.Random(6)
    return [None, "", " \n ", "word " * 3000, "x" * 50_000, "Hello, World's <|endoftext|>", *("".join(r.choice(PARTS) for _ in range(r.randint(1, 30))) for _ in range(300))]


def test_encoder_equals_library():
    one, library = Encoder(PATH), load(PATH)
    assert one.fits
    for t in texts():
        assert np.frombuffer(one.encode(t or ""), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("pack", [32_000_000, 500])
def test_equals_library(spark, monkeypatch, pack):
    monkeypatch.setattr(bpe, "PACK_CHARS", pack)
    library = load(PATH)
    data = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in data] + [(5, data[5][1], 1, "clash")], "doc_id long, text string, bucket int, pack string").repartition(3)
    rows = bpe.encode_decode(df, PATH).collect()
    assert len(rows) == len(data) + 1
    for r in rows:
        ids = library.encode(data[r.doc_id][1] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))


def test_tokenizer_of_another_kind(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, one = load(path), Encoder(path)
    data = list(enumerate([None, "", "Two Words\n\n and  more\t", "It's É straße", "Two Words"]))
    assert all(np.frombuffer(one.encode(t or ""), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids for _, t in data)
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_decode(spark.createDataFrame(data, "doc_id long, text string"), path).collect()}
    for i, t in data:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False))
    with pytest.raises(ValueError):
        bpe.decode(spark.createDataFrame([(1, [2])], "doc_id long, ids array<int>"), path)


def test_sequences_round_trip():
    x = np.array([0, 1, 191, 192, 193, 192 + 16383, 192 + 16384, 192 + 63 * 16384 - 1, 192 + 63 * 16384, 4_000_000_000], np.int64)
    assert bpe._plain_sequence(bpe._squeezed_sequence(x)).tolist() == x.tolist()
    assert len(bpe._plain_sequence(bpe._squeezed_sequence(x[:0]))) == 0


def test_decode_join(spark):
    library = load(PATH)
    data = [(1, library.encode("Some plain words, here", add_special_tokens=False).ids), (2, []), (3, None), (4, [49407, 320])]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(data, "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {i: library.decode(ids or [], skip_special_tokens=False) for i, ids in data}


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    library = load(PATH)
    data = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in bpe.op10_bpe_words(spark, d).collect():
        ids = library.encode(data[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
