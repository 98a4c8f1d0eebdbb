import hashlib

import numpy as np
from helpers import COLUMNS, awkward, docs_of
from pyspark.sql import functions as F

from isthmus.llm import imatch


def slow(rows):
    """doc_id -> (n_chars, sha256 of the edited text), by the descending order of ids."""
    low = -(1 << 63)
    rows = sorted(rows, key=lambda r: r[1] or "", reverse=True)
    rows = sorted(rows, key=lambda r: low if r[0] is None else r[0], reverse=True)
    out = []
    for i, (doc, text) in enumerate(rows):
        t, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        out.append((doc, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest(), t, after))
    return out


def compare(spark, texts, ids=None, **how):
    docs = docs_of(spark, texts, ids).withColumn("key", F.lit("k")).withColumn("g", F.lit(1))
    got = imatch.matched(docs, **how).collect()
    want = slow(list(zip(ids if ids else range(len(texts)), texts, strict=True)))
    flat = lambda xs: sorted(xs, key=str)
    assert flat((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == flat(w[:3] for w in want)
    return got, want


def test_edited_texts_in_groups(spark):
    texts = awkward(1, 60)
    for size in (1 << 20, 900):
        got, want = compare(spark, texts, group_bytes=size)
        by_text = {}
        text_of = {w[0]: w for w in want}
        for r in got:
            assert by_text.setdefault(text_of[r.doc_id][3], r.fingerprint) == r.fingerprint
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            assert (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint)
        prints = {w[0]: by_text[w[4]] for w in want}
        for r in got:
            assert r.near_next == imatch.likeness(r.fingerprint, prints[r.doc_id])


def test_groups_do_not_change_the_fingerprints(spark):
    texts = awkward(2, 30)
    one = {r.doc_id: r for r in imatch.matched(docs_of(spark, texts)).collect()}
    many = {r.doc_id: r for r in imatch.matched(docs_of(spark, texts), group_bytes=300).collect()}
    assert one == many


def test_repeated_and_null_ids(spark):
    compare(spark, ["abc def ghi", "zz yy xx ww", None, "abc def ghi", "é" * 10], ids=[4, 4, None, 9, None], group_bytes=8)
    compare(spark, ["only one text here"])


def test_empty(spark):
    assert imatch.matched(spark.createDataFrame([], COLUMNS)).count() == 0


def test_frequencies(spark):
    texts = awkward(4)
    count, n = imatch.frequencies(docs_of(spark, texts), 16)
    want = np.zeros(1 << 16, int)
    for t in texts:
        for h in {int(x) for x in imatch.terms_of([(t or "").encode()])[1]}:
            want[h >> 48] += 1
    assert n == len(texts) and (count == want).all()


def test_edits_stay_near_and_others_far(spark, sf):
    rows = imatch.matched(spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 600")).collect()
    assert np.mean([r.near_edited > 0.05 for r in rows]) > 0.9
    assert np.mean([r.near_next < 0.05 for r in rows]) > 0.9
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


def plain_results(rows):
    """The whole result for (doc_id, text) rows, term by term in Python integers."""
    import hashlib
    import math
    import re

    from plain import BITS, C1, mixed, word_hash

    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    terms = lambda t: {word_hash(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().translate(low))}
    n, df = len(rows), {}
    for _, t in rows:
        for h in terms(t or ""):
            df[h >> 43] = df.get(h >> 43, 0) + 1
    known = {b for b, c in df.items() if n > 1 and 0.2 <= math.log(n / c) / math.log(n) <= 0.9}

    def fingerprint(t):
        every = terms(t)
        own = {h for h in every if h >> 43 in known} or every
        out = (f"{mixed(sum(map(mixed, own)) & BITS):016x}" if own else "0" * 16) + f"{min(len(own), 65535):04x}"
        for level in range(12):
            for seed in range(8):
                kept = [u for u in (mixed(h + (seed + 1) * C1 & BITS) for h in own) if u < 1 << (63 - level)]
                out += f"{mixed(sum(mixed(u + 1 & BITS) for u in kept) & BITS) % 65535 + 1:04x}" if kept else "0000"
        return out

    def like(a, b):
        if a == b:
            return 1.0
        size = max(int(a[16:20], 16), int(b[16:20], 16))
        levels = [k for k in range(12) if 0.4 <= size / 2 ** (k + 1) <= 5.0] or ([0] if size < 2 else [11])
        slots = [(a[i : i + 4], b[i : i + 4]) for k in levels for s in range(8) for i in [20 + 4 * (8 * k + s)]]
        some = [(x, y) for x, y in slots if (x, y) != ("0000", "0000")]
        return sum(x == y for x, y in some) / len(some) if some else 0.0

    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0], r[1].encode()), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, c)))
    return sorted(out)


def test_whole_result_against_brute_force(spark, sf):
    texts = awkward(21)
    rows = list(enumerate(texts))
    assert sorted(map(tuple, imatch.matched(docs_of(spark, texts).repartition(3), group_bytes=4000).collect())) == plain_results(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, imatch.matched(docs).collect())) == plain_results(given)
