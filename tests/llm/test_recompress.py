import random

import numpy as np
import pytest
from helpers import COLUMNS, awkward, docs_of
from pyspark.sql import functions as F

from isthmus.llm import recompress


def slow(texts, w, ids=None):
    ids = ids if ids is not None else list(range(len(texts)))
    key = lambda i: float("inf") if ids[i] is None else ids[i]
    least = {}
    split = [(t or "").encode().split() for t in texts]
    for i, s in enumerate(split):
        for p in range(len(s) - w + 1):
            k = tuple(s[p : p + w])
            least[k] = min(least.get(k, float("inf")), key(i))
    out = []
    for i, s in enumerate(split):
        gone = set()
        for p in range(len(s) - w + 1):
            if least[tuple(s[p : p + w])] < key(i):
                gone |= set(range(p, p + w))
        out.append((ids[i], len(s), len(gone), b" ".join(x for j, x in enumerate(s) if j not in gone).decode()))
    return out


def same(spark, texts, w, ids=None, rounds=4):
    docs = docs_of(spark, texts, ids).withColumn("o", F.lit(1)).withColumn("at", F.lit("x"))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in recompress.removed(docs, w, rounds).collect()]
    assert sorted(got, key=str) == sorted(slow(texts, w, ids), key=str)


def passages(seed, n=40, vocabulary=30):
    """Documents put together from shared passages, with runs, periods and seams."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    pool = [[word() for _ in range(r.randint(5, 60))] for _ in range(10)] + [["is"] * 70, ["a", "b"] * 40]
    out = []
    for _ in range(n):
        t = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            t += p[a:] if r.random() < 0.3 else p if r.random() < 0.7 else [word() for _ in range(r.randint(1, 30))]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("w", "rounds"), [(50, 8), (8, 3), (20, 5)])
def test_against_brute_force(spark, w, rounds):
    same(spark, passages(w) + awkward(1), w, rounds=rounds)


def test_few_words(spark):
    same(spark, passages(9, 40, 2) + ["w1 " * 60, "w1 " * 61, "x " + "w1 " * 60], 10, rounds=4)


def test_ids_out_of_order_repeated_and_null(spark):
    texts = passages(3, 12)
    same(spark, texts + texts[:4] + [texts[0] + " tail", None], 10, ids=[9, 3, 3, 8, None, 1, 7, 7, 2, 30, 31, 32, 5, 3, None, 0, 3, 4])


def test_a_symbol_occurs_in_every_window_that_holds_what_it_depends_on():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 6, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    name, _, low, high = recompress.symbols(h, np.zeros(400, np.int64), 5)
    other = np.concatenate([rng.integers(0, 6, 30).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)])
    for k in np.flatnonzero((low >= 0) & (high <= 400)):
        part = np.concatenate([other, h[low[k] : high[k]], other])
        again, _, alow, ahigh = recompress.symbols(part, np.zeros(len(part), np.int64), 5)
        assert any(n == name[k] and a >= 30 and b <= 30 + high[k] - low[k] for n, a, b in zip(again, alow, ahigh))


def test_empty(spark):
    assert recompress.removed(spark.createDataFrame([], COLUMNS)).count() == 0


def test_rows_of_one_id_whose_hashes_share_32_bits(spark):
    """Two texts of null id that the low half of a hash doesn't tell apart, through both substring operators."""
    import xxhash

    from isthmus.llm import bwt_dedup

    tail = " ".join(f"w{i}" for i in range(70))
    seen, pair = {}, None
    for i in range(1_000_000):
        text = f"{i} {'x ' * (i % 3)}{tail}"
        low = xxhash.xxh64(text.encode(), seed=42).intdigest() & 0xFFFFFFFF
        if low in seen:
            pair = seen[low], text
            break
        seen[low] = text
    texts = [*pair, tail + " more words", "short"]
    docs = docs_of(spark, texts, ids=[None, None, 3, 4])
    got = recompress.removed(docs).collect()
    assert sorted((r.n_removed, r.kept) for r in got if r.doc_id is None) == sorted((70, " ".join(t.split()[:-70])) for t in pair)
    assert [r.n_removed for r in got if r.doc_id == 3] == [0] and bwt_dedup.removed(docs).where("doc_id is null and n_removed > 0").count() == 2


def test_words_that_collide_under_one_seed(spark):
    rest = " ".join(f"v{i}" for i in range(49))
    got = {r.doc_id: r.n_removed for r in recompress.removed(docs_of(spark, [f"KDZw {rest}", f"WkXoasVF {rest}", f"KDZw {rest}"])).collect()}
    assert got == {0: 0, 1: 0, 2: 50}


def test_seeds_part():
    from isthmus.llm.common import hashed, joined

    r = np.random.default_rng(1)
    # Words of one eight-byte step that collide under a seed: the step's input solved for the other length.
    from isthmus.llm import common

    inverse = pow(int(common._C2), -1, 1 << 64)
    short = r.integers(97, 123, (200, 4), dtype=np.uint8)

    def base(n, seed):
        h = np.array([n], np.uint64) * common._C1
        return int((common.mixed(h + common.mixed(np.array([seed], np.uint64))))[0])

    for w in short:
        c = int.from_bytes(w.tobytes(), "little")
        other = (((c * int(common._C2)) & ((1 << 64) - 1)) ^ base(4, 1) ^ base(8, 1)) * inverse & ((1 << 64) - 1)
        buf, off = joined([w.tobytes(), other.to_bytes(8, "little")])
        one, two = (hashed(buf, off[:-1], off[1:] - 1, seed) for seed in (1, 2))
        assert one[0] == one[1] and two[0] != two[1]


def test_windows_marked_by_both_hashes():
    from isthmus.llm.recompress import Parsed

    p = Parsed([b"a b c a b d a b c"], 0, 3)
    assert p.equal(0, [0], 3).tolist() == [0, 6] and p.equal(0, [2], 3).tolist() == [2]
    p.windows = lambda i, window: np.zeros(7, np.int64)
    assert p.equal(0, [0], 3).tolist() == [0, 6]
