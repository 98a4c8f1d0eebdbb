"""One text of 50 MB among short ones, through every operator."""

import random

import pytest
from helpers import docs_of

import corpus_pipeline as cp
from isthmus.llm import align, bwt_dedup, decontaminate, imatch, linedup, lm, packing, quality, recompress, rollup, simhash

OPERATORS = {"lm": lm.scored, "packing": packing.packed, "imatch": imatch.matched, "simhash": simhash.near_duplicates, "counts": rollup.counted, "align": align.linked}


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(20_000)]
    lines = [" ".join(r.choices(words, k=12)) for _ in range(700_000)]
    short = ["a short text", None, "\n".join(lines[5000:5100])]
    return docs_of(spark, ["\n".join(lines)[: 50 << 20], *short]).persist()


@pytest.mark.parametrize("name", OPERATORS)
def test_row_for_each_row(docs, name):
    found = OPERATORS[name](docs)
    ids = {x.doc_id for x in found.select("doc_id").distinct().collect()}
    assert ids == {0, 1, 2, 3}


def test_results(spark, docs):
    third = {x.doc_id: x for x in linedup.deduplicated(docs).drop("text").collect()}
    assert third[3].n_removed == 100 and third[0].n_lines > 600_000
    words = {x.doc_id: (x.n_words, x.n_removed) for x in recompress.removed(docs).select("doc_id", "n_words", "n_removed").collect()}
    assert words[3] == (1200, 1200)
    gone = {x.doc_id: (x.n_bytes, x.n_removed) for x in bwt_dedup.removed(docs).select("doc_id", "n_bytes", "n_removed").collect()}
    assert gone[0][0] == 50 << 20 and gone[3][0] == gone[3][1]
    items = spark.createDataFrame([(7, docs.where("doc_id = 3").first().text[:200])], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.contaminated_spans(docs, items).where("size(spans) > 0").collect()} == {0, 3}
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.scored(docs, labels).select("score").count() == 4
    assert cp.without_near_duplicates(spark, docs, "").select("doc_id").count() == 4
