"""Product codes against plain loops over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from isthmus.llm import product_codes as pc

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts)) * parts
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    if not kept:
        return []
    d = width // parts
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    start = [first[i] for i in sorted(first, key=lambda i: (i is None, i))[:entries]]
    books = [[v[p * d : p * d + d] for v in start] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p * d : p * d + d], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * d : p * d + d] for (_, v, _), g in zip(kept, got, strict=True) if g[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    got = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(f for f, _ in g) for g in got]
    total = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, lab, "".join(f"{k:02x}" for _, k in g), e, total[lab], sha) for (i, _, lab), g, e in zip(kept, got, errors, strict=True)), key=str)


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, pc.product_codes(df, **more).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("labels", [pc.LOOKUP_LABELS, 0])
def test_awkward(spark, labels):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(16)], r.choice([None, 1, 2])) for i in range(300)]
    rows += [(300 + i, rows[0][1], 1) for i in range(200)] + rows[5:9]
    rows += [(-1, None, 1), (-2, [1.0] * 15 + [None], 1), (-3, [math.nan] * 16, 1), (-4, [math.inf] + [0.0] * 15, None), (None, [0.5] * 16, None), (None, None, None)]
    check(spark, rows, lookup_labels=labels)


def test_ties_repeated_ids_and_lengths(spark):
    r = random.Random(4)
    rows = [(i % 11, [float(r.randint(-2, 2)) / 4096 for _ in range(r.choice([16, 16, 13, 0]))], i % 3) for i in range(150)]
    check(spark, rows)


def test_few_and_no_rows(spark):
    check(spark, [(9, [0.25] * 8, None), (3, [-0.1] * 8, 4)])
    check(spark, [(9, [], None)])
    none = pc.product_codes(spark.createDataFrame([(1, None, 2)], SCHEMA))
    assert none.count() == 0 and none.columns == pc.product_codes(spark.createDataFrame([(1, [0.0] * 8, 2)], SCHEMA)).columns
    assert pc.product_codes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_components_and_clashing_columns(spark):
    rows = [(i, [3e38, -3e38] * 32, "a") for i in range(3)] + [(i, [0.0] * 64, "b") for i in range(3, 30)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, label string, code int, error int")
    got = pc.product_codes(df).collect()
    assert len(got) == 30 and all(x.error >= 0 and x.label_error is not None for x in got)
    assert pc.limit(64) == 1 << 27 and all((2 * pc.limit(n)) ** 2 * n < 1 << 63 for n in range(1, 3000))


def test_search_equals_all_distances():
    r = np.random.default_rng(5)
    for n, k, d, top in ((400, 16, 8, 500), (400, 16, 8, 3), (50, 1, 4, 9), (1, 5, 1, 9), (0, 16, 8, 4), (300, 7, 2, 2)):
        x, book = r.integers(-top, top + 1, (n, d)), r.integers(-top, top + 1, (k, d))
        far = ((x[:, None] - book) ** 2).sum(axis=2)
        code, error = pc.nearest(x, book)
        assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


def test_given_vectors_and_sql(spark, sf):
    import duckdb

    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = sorted(map(tuple, pc.product_codes(df).collect()), key=str)
    assert got == plain([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    rows = con.execute(pc.oracle()).fetchall()
    assert sorted((r[0], *r[1:]) for r in rows) == sorted((g[0], *g[2:]) for g in got)
