"""Cross-tokenizer alignment against a plain reading of its definition."""

import hashlib
import random

import pytest
from helpers import COLUMNS, awkward, docs_of
from pyspark.sql import functions as F

from isthmus.llm import align


def plain(texts):
    """Whole texts coded at once, groups cut where both end, links counted in dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = align.default_tokenizers()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    v = align.Vocabularies.of(path_a, path_b)
    docs = []
    for t in texts:
        if not t:
            docs.append([])
            continue
        xs, ys = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        raw = (" " + t).encode()
        if b"".join(v.bytes_a[i] for i in xs) != raw or b"".join(v.bytes_b[i] for i in ys) != raw:
            docs.append([])
            continue
        groups, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
        while i < len(xs) or j < len(ys):
            if at_a == at_b and at_a:
                groups.append(([], []))
            if at_a <= at_b:
                groups[-1][0].append(xs[i])
                at_a += len(v.bytes_a[xs[i]])
                i += 1
            else:
                groups[-1][1].append(ys[j])
                at_b += len(v.bytes_b[ys[j]])
                j += 1
        docs.append(groups)
    links = [[(x, y) for p, q in g for x in p for y in q] for g in docs]
    count, top = {}, {}
    for ls in links:
        for pair in set(ls):
            count[pair] = count.get(pair, 0) + 1
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for g, ls in zip(docs, links, strict=True):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        out.append((sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(ls), sum(count[x] == top[x[0]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


COLS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(df, texts):
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in df.collect()}
    assert got == dict(enumerate(plain(texts)))


@pytest.mark.parametrize("limit", [align.LOOKUP_PAIRS, 0])
def test_awkward(spark, limit):
    texts = awkward(5) + ["a▁b c", "<|endoftext|> x </s><unk> <0x41>", "trailing ", " ", "  ", "　᠎ x", "1,234.56 it's", "\x00\x1c \x1f y", "日本語 テキスト 😀👍🏽", "x" * 300 + " " * 90 + "\n\n \n z"]
    docs = docs_of(spark, texts).withColumn("row", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    check(align.linked(docs, lookup_pairs=limit), texts)


def test_random_strings(spark):
    r = random.Random(7)
    few = list("aAbeé  \n\t\r.,'-_19ßçñ") + [" ", "▁", "​", "日", "😀", "\x85", "\x1e", "　", "ing", "the", " of", "  ", "s'", "'s", "́"]
    weights = [6] * len(few)
    weights[few.index("▁")] = 1
    texts = ["".join(r.choices(few, weights, k=r.randint(1, 80))) for _ in range(1500)]
    check(align.linked(docs_of(spark, texts)), texts)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(len(rows)))
    check(align.linked(docs), [r.text for r in rows])


def test_repeats_and_empty(spark):
    assert align.linked(spark.createDataFrame([], COLUMNS)).count() == 0
    got = align.linked(docs_of(spark, ["two words", "two words", None], ids=[4, 4, None]), groups=True).collect()
    a = [r for r in got if r.doc_id == 4]
    assert len(a) == 2 and a[0] == a[1] and a[0].count_sum == 2 * a[0].n_links and a[0].groups.count("|") == a[0].n_groups
    assert [r.n_a for r in got if r.doc_id is None] == [0]


def test_long_groups_count_ids_first():
    chunks = align.Chunks(align.Vocabularies.of(*align.default_tokenizers()))
    a, b = [5] * 4000 + [6], [7] * 3000
    v = chunks.vocabularies
    a, b = [v.bytes_a.index(b"ab")] * 4000 + [v.bytes_a.index(b"a")], [v.bytes_b.index(b"a"), v.bytes_b.index(b"ba")] + [v.bytes_b.index(b"ba")] * 3999
    texts, sizes, n_keys, keys, times = chunks._aligned([[], a, a[:1]], [[], b, [b[0], v.bytes_b.index(b"b")]])
    assert [x.tolist() for x in sizes] == [[0, 4001, 1], [0, 4001, 2], [0, 1, 1], [0, 4001 * 4001, 2]]
    assert n_keys.tolist() == [0, 4, 2] and sorted(times) == [1, 1, 1, 4000, 4000, 4000 * 4000] and texts[1].count("|") == 1 and texts[0] == ""


def test_forgetting_chunks_changes_nothing(spark, monkeypatch):
    texts = awkward(8)
    monkeypatch.setattr(align, "AT_ONCE", 10)
    v = align.Vocabularies.of(*align.default_tokenizers())
    one, two = align.Chunks(v), align.Chunks(v, limit=3)
    for t in filter(None, texts):
        cut = align._CHUNK.findall(" " + t)
        assert "".join(cut) == " " + t
        if len(two.text) > two.limit:
            two.forget()
        assert [one.text[n] for n in one.numbers(cut)] == [two.text[n] for n in two.numbers(cut)]
