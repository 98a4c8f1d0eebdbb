import random

import pytest
from helpers import COLUMNS, docs_of
from pyspark.sql import functions as F

from isthmus.llm import linedup


def slow(texts, k, ids=None, size=200):
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0) if ids else i)
    first, alone, out = {}, {}, {}
    for d in order:
        lines = (texts[d] or "").split("\n")
        gone = [False] * len(lines)
        for i in range(len(lines) - k + 1):
            if first.setdefault(tuple(lines[i : i + k]), (d, i)) != (d, i):
                gone[i : i + k] = [True] * k
        for i, x in enumerate(lines):
            if len(x.encode()) >= size and alone.setdefault(x, (d, i)) != (d, i):
                gone[i] = True
        kept = [x for x, g in zip(lines, gone, strict=True) if not g]
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(lines), sum(gone), runs, "\n".join(kept) if kept else None)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_against_brute_force(spark, k):
    r = random.Random(k)
    texts = ["\n".join(r.choice(["a", "b", "c", "", "long line é"]) for _ in range(r.randint(1, 12))) for _ in range(25)]
    texts += [None, "", "\n\n\n\n\n", "a\nb\nc\nd\ne\nf", "a\nb\nc\nd\ne\nf", "x", "x", "same\n" * 300]
    docs = docs_of(spark, texts).withColumn("line", F.lit(1)).withColumn("starts", F.lit(2)).withColumn("rank", F.lit(3)).withColumn("n_runs", F.lit(4))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept) for r in linedup.deduplicated(docs, k, 12).collect()}
    assert got == slow(texts, k, size=12)


def test_long_lines_go_by_themselves(spark):
    long, short = "é" * 100, "é" * 99 + "e"
    texts = [f"{long}\n{short}\na", f"b\n{long}\nc\n{short}", f"{short}\n{long}\n{long}"]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept) for r in linedup.deduplicated(docs_of(spark, texts)).collect()}
    assert got == slow(texts, 2) and [got[i][1] for i in range(3)] == [0, 1, 2]


def suffix_array(spark, texts):
    """(document, line) and common prefix of the repeated suffixes, in order, as the operator finds them."""
    array = linedup.SuffixArray(linedup.written(linedup.line_table(docs_of(spark, texts)), "lines"))
    number = {r.number: r.doc_id for r in array.documents.collect()}
    rows = sorted(array.neighbours().collect(), key=lambda r: r.n)
    return [((number[r.pos >> linedup.LINE_BITS], r.pos & ((1 << linedup.LINE_BITS) - 1)), r.common) for r in rows]


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array_and_common_prefixes(spark, seed):
    r = random.Random(seed)
    texts = ["\n".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) for _ in range(12)] + ["x\n" * 21, "a\nb\nc\nd\ne\nf\na"] + ["q\nr\ns\nt\nu"] * 3 + ["only here"]
    lines = [t.split("\n") for t in texts]
    everywhere = [x for t in lines for x in t]
    got = suffix_array(spark, texts)
    places = [p for p, _ in got]
    assert sorted(places) == sorted((d, i) for d, t in enumerate(lines) for i, x in enumerate(t) if everywhere.count(x) > 1)

    def common(p, q):
        n = 0
        for x, y in zip(lines[p[0]][p[1] :], lines[q[0]][q[1] :]):
            if x != y:
                break
            n += 1
        return n

    assert got[0][1] == 0
    for (p, _), (q, n) in zip(got, got[1:]):
        assert n == common(p, q)
    # Sorted: whoever shares most of a suffix's lines stands beside it.
    for i, p in enumerate(places):
        best = max(common(p, q) for q in places if q != p)
        assert best == max([got[i][1]] + [c for _, c in got[i + 1 : i + 2]])


def test_nulls_repeats_and_empty_tables(spark):
    got = linedup.deduplicated(docs_of(spark, ["a\nb", "a\nb", "a\nb", "q"], ids=[None, 5, 5, 7])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("5", 0), ("5", 0), ("7", 0), ("None", 2)]
    assert linedup.deduplicated(spark.createDataFrame([], COLUMNS)).count() == 0


def test_ranks_count_lesser_suffixes(spark):
    keys = spark.createDataFrame([(i % 7, i, 1 + i % 3) for i in range(50)], "a long, b long, n long")
    got = {(r.a, r.b): r["rank"] for r in linedup.ranked(keys.repartition(3), ["a", "b"], "t").collect()}
    at = 0
    for a, b, n in sorted((i % 7, i, 1 + i % 3) for i in range(50)):
        assert got[a, b] == at
        at += n
