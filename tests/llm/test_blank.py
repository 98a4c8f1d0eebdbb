"""Tables of blank texts only, and of one text: every operator gives a row for each row."""

import pytest
from helpers import docs_of

from isthmus.llm import align, bwt_dedup, decontaminate, imatch, linedup, lm, packing, quality, recompress, rollup, simhash

CASES = {"blank": [None, "", "  \n"], "null": [None, None], "one": ["a single text"], "same": ["x y z"] * 5}


@pytest.mark.parametrize("case", CASES)
def test_rows(spark, case):
    texts = CASES[case]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    for got in (
        lm.scored(docs), decontaminate.contaminated_spans(docs, items), packing.packed(docs), recompress.removed(docs), bwt_dedup.removed(docs), imatch.matched(docs),
        simhash.near_duplicates(docs), simhash.similar(docs), linedup.deduplicated(docs), quality.scored(docs, labels), align.linked(docs),
    ):
        assert got.count() == len(texts)
    assert rollup.counted(docs).count() == 2 * len(texts)


def test_the_driver_gives_freed_native_memory_back(spark, tmp_path, monkeypatch):
    from isthmus.llm import common

    assert common.trimmed(spark).startswith("Trim native heap")
    said = []
    monkeypatch.setattr(common, "trimmed", lambda s: said.append(s))
    common.discard(common.written(spark.range(3), "some"))
    assert said
