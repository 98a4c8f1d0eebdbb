import zlib

import numpy as np
import pytest
from helpers import COLUMNS, awkward, docs_of
from pyspark.sql import functions as F

from isthmus.llm import packing


def check(rows, texts_by_id, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts_by_id)
    for doc, pieces in by_doc.items():
        ids = np.array(tok.encode(texts_by_id[doc] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        pieces.sort(key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return sum(r.length for r in rows), len(by_seq)


def test_round_trip_and_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    tokens, sequences = check(packing.packed(docs).collect(), texts, 4096)
    assert sequences * 4096 <= tokens * 1.03 + 4096


@pytest.mark.parametrize("capacity", [4, 33, 128])
def test_awkward(spark, capacity):
    texts = awkward(3)
    rows = packing.packed(docs_of(spark, texts).withColumn("start", F.lit(7)).withColumn("k", F.lit("x")), capacity=capacity).collect()
    check(rows, dict(enumerate(texts)), capacity)


def test_words_apart_equal_whole_texts(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["<|endoftext|> a <|startoftext|>b", "A <|ENDOFTEXT|> x<|EndOfText|>Y. Z<|startoftext|>Q", "<| Foo <|x|> it'S<|endoftext|>.DEF", "it's we'll x", "é ́x", "ΑΣ ΣΑΣ", "a\x0bb\x0cc\x1cd", "…... ,.", "日本 語", "élève ÉTÉ straße ÷x naïve2 ÿþß œuvre cafe\u0301 É\u0301 à"] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()]
    got = packing.WordIds(packing.default_tokenizer(), None)([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_latin_texts_equal_whole_texts():
    import random

    from tokenizers import Tokenizer

    tok, r = Tokenizer.from_file(packing.default_tokenizer()), random.Random(3)
    few = "abzABZ'sStT re'vemlld09. ,-!?\t\n\x0b\x1c\x00\x7f\x80\x85\xa0\xa1«»¿ª²³¹ºµ¼ÀÉÞß×÷éñÿ<|>"
    texts = ["".join(r.choice(few) for _ in range(r.randint(1, 60))) for _ in range(3000)] + ["".join(map(chr, range(256)))]
    got = packing.WordIds(packing.default_tokenizer(), None)([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_and_repeated_ids(spark):
    assert packing.packed(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = packing.packed(docs_of(spark, ["a b", "c", None], ids=[5, 5, None])).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 2), (False, 3), (True, 1)]


def test_pieces_fit_their_class():
    for n in range(1, 9000, 7):
        ps = packing.pieces_of(n)
        assert sum(x for x, _ in ps) == n and all(0 < x <= 4096 // k for x, k in ps)
