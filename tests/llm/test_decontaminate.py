import random
import re

import numpy as np
import pytest
from helpers import COLUMNS, awkward, docs_of
from pyspark.sql import functions as F

from isthmus.llm import decontaminate as dc

ITEMS = "item_id long, text string"


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(texts, items, width=10):
    out = []
    phrases = []
    for item, text in items:
        w = words(text)
        phrases += [(item, tuple(w[i : i + width])) for i in range(max(1, len(w) - width + 1) if w else 0)]
    for t in texts:
        w = words(t)
        hit, found = set(), set()
        for item, p in phrases:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= {item} - {None}
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def same(spark, texts, items, **how):
    docs = docs_of(spark, texts).withColumn("spans", F.lit(1)).withColumn("items", F.lit("x"))
    got = {r.doc_id: r for r in dc.contaminated_spans(docs, spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(3)), **how).collect()}
    assert len(got) == len(texts)
    for i, (n, hit, found) in enumerate(slow(texts, items, how.get("width", 10))):
        assert got[i].n_words == n
        assert [x for s in got[i].spans for x in range(s.start, s.end)] == hit
        assert list(got[i].items) == found


def planted(seed):
    r = random.Random(seed)
    texts = awkward(seed, 40, ["a", "b", "c", "the", "of", "q7", "é", "x-y"])
    full = [t for t in texts if t and len(words(t)) > 25]
    items = [(i, " ".join(words(r.choice(full))[s : s + r.choice([4, 10, 12, 20])])) for i, s in enumerate(r.randrange(12) for _ in range(12))]
    return texts, [*items, (3, "a b"), (None, "the of the"), (50, None), (51, "..."), (52, "never seen words at all in any of these texts here")]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    same(spark, *planted(seed))


def test_one_word_items_and_blocks(spark):
    texts, items = planted(4)
    same(spark, texts, [*items, (60, "q7")])
    same(spark, texts, items, block_bytes=60)


def test_small_shards(monkeypatch):
    texts, items = planted(5)
    monkeypatch.setattr(dc, "SHARD_WORDS", 30)
    p, got = dc.Phrases(items), []
    shard = dc.Shard(p)
    for i, t in enumerate(texts):
        shard.add([(0, i)], [(t or "").encode()])
        if shard.full():
            got += shard.results()
            shard = dc.Shard(p)
    got += shard.results()
    for (_, n, spans, found), want in zip(got, slow(texts, items), strict=True):
        assert (n, [x for a, b in spans for x in range(a, b)], found) == want


def test_index_counts_and_locates():
    text = np.random.default_rng(1).integers(1, 6, 500)
    index = dc.FmIndex(text)
    for k in (1, 2, 3):
        for start in range(0, 480, 37):
            p = text[start : start + k]
            low, high = index.search(p[None, :], np.array([k]))
            places = [i for i in range(len(text) - k + 1) if (text[i : i + k] == p).all()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == places


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert dc.contaminated_spans(spark.createDataFrame([], COLUMNS), none).count() == 0
    row = dc.contaminated_spans(docs_of(spark, ["a b"], ids=[None]), none).first()
    assert (row.doc_id, row.n_words, row.spans, row["items"]) == (None, 2, [], [])
