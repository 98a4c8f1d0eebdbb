import random

import numpy as np
import pytest
from helpers import COLUMNS, awkward, docs_of
from pyspark.sql import functions as F

from isthmus.llm import bwt_dedup


def slow(texts, w, order=None):
    order = order or range(len(texts))
    seen, out = set(), {}
    for i in order:
        t = (texts[i] or "").encode()
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - w + 1):
            k = t[p : p + w]
            if k in seen:
                gone[p : p + w] = True
            seen.add(k)
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out[i] = (len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


def same(spark, texts, **how):
    docs = docs_of(spark, texts).withColumn("o", F.lit(1)).withColumn("piece", F.lit("x")).withColumn("runs", F.lit(0))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in bwt_dedup.removed(docs, **how).collect()}
    assert got == slow(texts, how.get("window", 100))


def passages(seed, n=30):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdé \n") for _ in range(r.randint(20, 400))) for _ in range(8)] + ["z" * 350, "ab" * 200, "line\n" * 60]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(r.randint(1, 5)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            t += r.choice([p, p[a:], p[:a], "".join(r.choice("abcd") for _ in range(40))])
        out.append(t)
    return out


def test_against_brute_force(spark):
    same(spark, passages(1) + awkward(1))


@pytest.mark.parametrize(("window", "step", "gram"), [(20, 5, 8), (12, 4, 12)])
def test_other_windows(spark, window, step, gram):
    same(spark, passages(2, 15) + ["", None, "ab", "z" * 30], window=window, step=step, gram=gram)


def test_hot_grams_by_windows(spark):
    same(spark, passages(3) + awkward(2), hot=1)
    same(spark, passages(4, 15) + ["z" * 30], window=20, step=5, gram=8, hot=3)


def test_self_overlap_within_one_run(spark):
    same(spark, ["x" * 103])
    texts = [(unit * n)[:n] for unit in ("-", "ab", "abcdefg ", "0123456789" * 5 + "uvwxyz") for n in (101, 103, 176, 200)]
    other = "".join(random.Random(5).choice("abcdefgh") for _ in range(150))
    same(spark, texts + texts[5:9] + [other + "_" * 120 + "end of the text"])


def test_null_and_repeated_ids(spark):
    r = random.Random(4)
    a, b = ("".join(r.choice("abcdefgh") for _ in range(150)) for _ in range(2))
    rows = bwt_dedup.removed(docs_of(spark, [a, a, a + "x", b, b, None], ids=[7, 7, None, 3, 9, None])).collect()
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed) for x in rows) == [("3", 150, 0), ("7", 150, 0), ("7", 150, 0), ("9", 150, 150), ("None", 0, 0), ("None", 151, 150)]
    assert bwt_dedup.removed(spark.createDataFrame([], COLUMNS)).count() == 0


def test_merging_equals_sorting():
    r = random.Random(2)
    chains = [[r.randint(1, 3) for _ in range(r.randint(1, 6))] for _ in range(40)]

    def transform(part):
        symbol, following, previous = [], [], []
        for c in part:
            for i, x in enumerate(c):
                symbol.append(x)
                following.append(len(symbol) if i + 1 < len(c) else -1)
                previous.append(len(symbol) - 2 if i else -1)
        return bwt_dedup.Transform.of(np.array(symbol), np.array(following), np.array(previous))

    a, b = transform(chains[:17]), transform(chains[17:])
    flat = [(tuple(c[i:])) for c in chains for i in range(len(c))]
    b.place = np.where(b.place >= 0, b.place + sum(map(len, chains[:17])), -1)
    both, common = bwt_dedup.merged(a, b)
    got = [flat[p] if p >= 0 else () for p in both.place]
    assert got == sorted(got) and len(got) == len(flat) + len(chains)
    for i in range(1, len(got)):
        shared = 0
        while shared < min(len(got[i]), len(got[i - 1])) and got[i][shared] == got[i - 1][shared]:
            shared += 1
        assert common[i] == shared or got[i] == got[i - 1]
