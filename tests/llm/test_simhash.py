import random

import numpy as np
import pytest
import xxhash
from helpers import COLUMNS, awkward, docs_of
from pyspark.sql import functions as F

from isthmus.llm import simhash


def slow_print(text, width):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    sh = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(values, budget):
    comp = {v: v for v in values}

    def root(v):
        while comp[v] != v:
            v = comp[v]
        return v

    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                comp[root(a)] = root(b)
    return {v: root(v) for v in vs}


@pytest.mark.parametrize("width", [3, 5])
def test_fingerprints(width):
    texts = awkward(1) + ["word" * 20 + " " + "w" * 31 + " b " + "c" * 32]
    got = simhash.fingerprint_batch([(t or "").encode() for t in texts], width)
    assert got.tolist() == [slow_print(t, width) for t in texts]


def test_majority_over_chunks():
    h = np.random.default_rng(0).integers(0, 1 << 63, 600_000).astype(np.uint64)
    counts = np.array([0, 5, 300_000, 0, 299_994, 1])
    got, at = simhash.majority(h, counts), 0
    for g, c in zip(got.tolist(), counts, strict=True):
        part, at = h[at : at + c], at + c
        assert g == sum(1 << b for b in range(64) if c and 2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) > c)


@pytest.mark.parametrize("subtrie", [4, 10_000])
def test_links_find_the_components(spark, subtrie):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for v in list(values)[:30]:
        for _ in range(r.randint(1, 4)):
            for _ in range(r.randint(1, 3)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    label = {x.node: x.label for x in simhash.components(simhash.links(df, 2, subtrie)).collect()}
    want = slow_groups(values, 2)
    got = {}
    for v, s in zip(values, signed, strict=True):
        got.setdefault(label.get(s, s), set()).add(v)
    groups = {}
    for v, g in want.items():
        groups.setdefault(g, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_near_duplicates(spark):
    texts = awkward(2, 60)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts).withColumn("fp", F.lit(1)).withColumn("label", F.lit(2))).collect()}
    prints = {i: slow_print(t, 3) for i, t in enumerate(texts)}
    groups = slow_groups(set(prints.values()), 2)
    for i in prints:
        assert found[i].fp % (1 << 64) == prints[i]
        assert found[i].component_id == min(j for j in prints if groups[prints[j]] == groups[prints[i]])


def test_empty_null_and_repeated(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = simhash.near_duplicates(docs_of(spark, ["a b c d", "a b c d", None, ""], ids=[3, 3, None, 9])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 9), (3, 3), (3, 3), (9, 9)]


def jaccard_pairs(texts, width, low):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= low * max(1, len(sets[i] | sets[j]))]


def test_similar_meets_near_copies_and_leaves_others(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(60):
        w = [word() for _ in range(r.randint(5, 400))]
        texts.append(" ".join(w))
        for _ in range(2):
            v = list(w)
            for _ in range(len(v) // 80):
                v[r.randrange(len(v))] = word()
            texts.append(" ".join(v))
    texts += [None, "", "short one", "Short  one"]
    got = {x.doc_id: x.component_id for x in simhash.similar(docs_of(spark, texts)).collect()}
    near, loose = jaccard_pairs(texts, 5, 0.83), set(jaccard_pairs(texts, 5, 0.5))
    assert sum(got[i] == got[j] for i, j in near) >= 0.95 * len(near)
    wrong = [(i, j) for i in got for j in got if i < j and got[i] == got[j] and (i, j) not in loose and i < 180]
    assert not wrong
    assert got[180] == got[181] == 180 and got[182] == got[183] == 182


def test_similar_decides_at_the_threshold(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for k in range(120):
        w = [word() for _ in range(300)]
        texts.append(" ".join(w))
        for at in range(6 + k % 2):
            w[20 + 40 * at] = word()
        texts.append(" ".join(w))
    texts += [f"{'again and again and so on ' * 60}{' '.join(word() for _ in range(100))}" for _ in range(2)]  # most shingles in common, few distinct ones
    got = {x.doc_id: x.component_id for x in simhash.similar(docs_of(spark, texts)).collect()}
    near = set(jaccard_pairs(texts, 5, 0.8))
    assert len(near) == 60 and not set(jaccard_pairs(texts, 5, 0.83))
    assert sum(got[i] == got[j] for i, j in near) >= 0.95 * len(near)
    assert {(i, j) for i in got for j in got if i < j and got[i] == got[j]} <= near


def test_units_keep_their_size():
    for n in (0, 1, 63, 1000, 40_000, 10**6, 10**9, 10**12):
        m, unit = simhash.prefix_bits(n)
        assert unit <= m <= 40 and n / 2**unit <= simhash.UNIT and (unit == 0 or n / 2**unit > simhash.UNIT / 2) and n / 2**m <= simhash.SHARED


def test_recall_with_many_units(spark, monkeypatch):
    """1,000 pairs at similarities just above 0.8, dealt over many small units."""
    import random

    monkeypatch.setattr(simhash, "UNIT", 128)
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    texts, wanted = [], 0
    for _ in range(1000):
        words = [word() for _ in range(204)]
        other = list(words)
        for at in range(20, 200, 45):  # 4 replaced words change 20 of 200 shingles: 180 / 220
            other[at] = word()
        texts += [" ".join(words), " ".join(other)]
    rows = {x.doc_id: x.component_id for x in simhash.similar(docs_of(spark, texts).repartition(6)).collect()}
    met = sum(rows[2 * i] == rows[2 * i + 1] for i in range(1000))
    assert met >= 900 and len(set(rows.values())) == 2000 - met
