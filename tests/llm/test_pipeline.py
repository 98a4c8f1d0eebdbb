import random

from helpers import COLUMNS, docs_of
from pyspark.sql import functions as F

import corpus_pipeline as cp
from isthmus.llm import decontaminate


def test_stages_on_planted_documents(spark, sf):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    clean = [" ".join(word() for _ in range(80)) for _ in range(8)]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    texts = [*clean, clean[0], clean[1] + " one more word", clean[2] + " " + item, "a\nb\n" + clean[3], "a\nb\n" + clean[4][::-1], None, "", ""]
    docs = docs_of(spark, texts)
    kept = {x.doc_id: x.text for x in cp.without_near_duplicates(spark, docs, sf).collect()}
    assert set(range(8)) <= set(kept) and not {8, 9, 14, 15} & set(kept) and 13 in kept
    lines = {x.doc_id: x for x in cp.without_copied_lines(spark, docs, sf).collect()}
    assert lines[12].text == clean[4][::-1] and lines[12].n_chars == len(clean[4]) and lines[13].text is None
    assert lines[11].text == "a\nb" and 8 not in lines  # a long line that occurred before goes by itself, and with it a document that is no more than that
    found = {x.doc_id for x in cp.without_benchmark(spark, docs, sf).collect()}
    assert found == set(range(len(texts))) - {10}
    for f in (cp.without_copied_lines, cp.without_near_duplicates, cp.without_benchmark, cp.good_quality):
        assert f(spark, spark.createDataFrame([], COLUMNS), sf).count() == 0
        assert f(spark, docs, sf).columns == cp.COLUMNS


def test_every_removed_line_keeps_one_copy(spark, sf):
    lines = [f"line {i} of a long original" for i in range(100)]
    new = ["a passage that is new", "and has two lines"]
    texts = ["\n".join(lines), "\n".join(lines[:85] + new), "\n".join(new + ["and a line of its own"]), "\n".join(lines)]
    kept = {x.doc_id: x.text for x in cp.without_copied_lines(spark, docs_of(spark, texts), sf).collect()}
    assert kept == {0: texts[0], 1: "\n".join(new), 2: "and a line of its own"}


def test_repeated_rows_and_null_ids(spark, sf):
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "q r s t u v w", "q r s t u v w", "m n o p q r"], ids=[1, 1, None, None, 1])
    kept = cp.without_near_duplicates(spark, docs, sf).collect()
    assert sorted((str(x.doc_id), x.text[0]) for x in kept) == [("1", "a"), ("1", "m"), ("None", "q")]


def test_rows_of_one_id_fare_by_their_texts(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    texts = ["a clean text " * 5, f"some words {item}", "another clean one " * 5, f"more words {item}", None, f"some words {item}"]
    docs = docs_of(spark, texts, ids=[1, 1, None, None, None, 1])
    assert sorted((str(x.doc_id), x.text or "") for x in cp.without_benchmark(spark, docs, sf).collect()) == sorted((str(i), t or "") for i, t in ((1, texts[0]), (None, texts[2]), (None, None)))
    twice = docs.unionByName(docs)
    assert cp.without_benchmark(spark, twice, sf).count() == 6
    assert cp.good_quality(spark, twice, sf).count() == 2 * cp.good_quality(spark, docs, sf).count()
    pieces = cp.sequences(spark, twice, sf).collect()
    assert len(pieces) == 12 and sum(x.length for x in pieces) == 2 * sum(x.length for x in cp.sequences(spark, docs, sf).collect())


def test_clashing_columns(spark, sf):
    """Columns named like those the stages work with, in any case, change nothing."""
    texts = ["one line\nand two", "one line\nand two", "x y z " * 9, "x y z " * 9, None]
    plain = docs_of(spark, texts)
    odd = plain
    for n in ("cut_id", "cut_th", "STARTS", "runs", "keep_id", "Keep_Th", "hit", "th", "row", "o", "tag", "z", "unit", "y", "place", "Score", "block", "part", "edge", "k", "at", "g"):
        odd = odd.withColumn(n, F.lit(n))
    from isthmus.llm import bwt_dedup, imatch, linedup, lm, packing, quality, recompress, simhash

    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "y z x y z", "q")], "item_id long, text string, spans string")
    for f in (
        lm.scored, packing.packed, recompress.removed, bwt_dedup.removed, imatch.matched, simhash.near_duplicates, simhash.similar, simhash.representatives,
        linedup.deduplicated, lambda d: quality.scored(d, labels), lambda d: decontaminate.contaminated_spans(d, items),
    ):
        a, b = f(plain), f(odd)
        same = [c for c in a.columns if c != "sequence_id"]
        key = lambda df: sorted(str(tuple(r)) for r in df.select(*same).collect())  # noqa: B023, E731
        assert key(a) == key(b)


def test_whole_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = cp.run(spark, sf).collect()
    ids = {x.doc_id for x in rows}
    good = {x.doc_id for x in cp.good_quality(spark, docs, sf).collect()}
    assert ids <= good and len(ids) > 0.5 * docs.count()
    hit = {x.doc_id for x in decontaminate.contaminated_spans(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("size(spans) > 0").collect()}
    by_text = {}
    for x in docs.collect():
        by_text.setdefault(x.text, []).append(x.doc_id)
    assert all(len(ids & set(g)) <= 1 for g in by_text.values())
    assert len(ids & hit) <= 0.3 * len(hit)
