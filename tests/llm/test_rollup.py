import os
import random
import re

import pytest
from helpers import COLUMNS, awkward, docs_of
from pyspark.sql import functions as F

from isthmus.llm import rollup

CHANGES = "op string, doc_id long, version string, source string, lang string, tokens long, seq int"


def test_counts(spark):
    texts = awkward(1)
    low = {c: c + 32 for c in range(65, 91)}
    got = {(r.doc_id, r.version): r.tokens for r in rollup.counted(docs_of(spark, texts).withColumn("tokens", F.lit(1))).collect()}
    assert len(got) == 2 * len(texts)
    for i, t in enumerate(texts):
        assert got[i, "spaced-1"] == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert got[i, "alnum-1"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low)))


@pytest.mark.parametrize("every", [rollup.COMPACT_EVERY, 1, 2])
def test_signed_batches_against_a_dictionary(spark, tmp_path, every):
    r = random.Random(1)
    ledger, state = rollup.TokenLedger(spark, str(tmp_path), every), {}
    for b in range(5):
        rows = [(r.choice(["insert", "revise", "delete"]), r.choice([None, *range(12)]), r.choice(["a", "b"]), r.choice(["s", "t", None]), r.choice(["en", None]), r.randint(0, 9), i) for i in range(25)]
        assert ledger.commit(f"b{b}", spark.createDataFrame(rows, CHANGES).withColumn("known", F.lit(0)))
        last = {}
        for op, doc, version, source, lang, tokens, _ in rows:
            last[doc, version] = (op, source, lang, tokens)
        for key, (op, *row) in last.items():
            state.pop(key, None)
            if op != "delete":
                state[key] = row
        want = {}
        for (_, version), (source, lang, tokens) in state.items():
            d, n = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (d + 1, n + tokens)
        for df in (ledger.totals(), ledger.recounted()):
            assert {(x.source, x.lang, x.version): (x.docs, x.tokens) for x in df.collect()} == want
        assert not ledger.commit(f"b{b}", spark.createDataFrame(rows, CHANGES))  # delivered again


def test_an_unfinished_batch_counts_for_nothing(spark, tmp_path):
    ledger = rollup.TokenLedger(spark, str(tmp_path))
    row = [("insert", 1, "a", "s", "en", 5, 0)]
    spark.createDataFrame([(9, "a", "s", "en", 7, 1, 3)], rollup.LOG).write.parquet(f"{tmp_path}/log/batch=x/attempt=dead")
    assert ledger.totals().count() == 0 and ledger.live().count() == 0
    assert ledger.commit("x", spark.createDataFrame(row, CHANGES))
    assert [tuple(x) for x in ledger.totals().collect()] == [("s", "en", "a", 1, 5)]


def test_empty(spark, tmp_path):
    ledger = rollup.TokenLedger(spark, str(tmp_path))
    assert ledger.commit("none", spark.createDataFrame([], CHANGES)) and ledger.totals().count() == 0
    assert rollup.counted(spark.createDataFrame([], COLUMNS)).count() == 0


def test_two_writers_of_one_batch(spark, tmp_path, monkeypatch):
    """The one that commits first counts; the other takes its rows back."""
    one, two = (rollup.TokenLedger(spark, str(tmp_path)) for _ in range(2))
    a, b = (spark.createDataFrame([("insert", 1, "a", "s", "en", n, 0)], CHANGES) for n in (5, 8))
    real = two._claim
    monkeypatch.setattr(two, "_claim", lambda *x: (one.commit("x", a), real(*x))[1])
    assert not two.commit("x", b)
    assert [tuple(x) for x in two.totals().collect()] == [("s", "en", "a", 1, 5)] and len(os.listdir(f"{tmp_path}/log/batch=x")) == 1


def test_a_writer_that_died_while_committing(spark, tmp_path, monkeypatch):
    ledger = rollup.TokenLedger(spark, str(tmp_path))
    assert ledger._claim(f"{tmp_path}/commits/x", "")
    rows = spark.createDataFrame([("insert", 1, "a", "s", "en", 5, 0)], CHANGES)
    assert ledger.totals().count() == 0
    with pytest.raises(RuntimeError, match="another writer"):
        ledger.commit("x", rows)
    monkeypatch.setattr(rollup, "STALE_S", -1)
    assert ledger.commit("x", rows) and not ledger.commit("x", rows) and ledger.totals().count() == 1


def test_a_commit_reads_its_own_buckets_of_the_last_snapshot(spark, tmp_path):
    ledger = rollup.TokenLedger(spark, str(tmp_path), 2)
    rows = lambda ids: spark.createDataFrame([("insert", i, "a", "s", "en", 1, 0) for i in ids], CHANGES)
    for k in range(4):
        ledger.commit(f"b{k}", rows(range(100 * k, 100 * k + 100)))
    assert ledger._snapshot()[1] == ["b0", "b1", "b2", "b3"] and ledger.live().count() == 400
    few = ledger.live(rows([7, 8]).select("doc_id", "version"))
    assert few.count() == 2
    files = {f.rsplit("/", 2)[1] for f in few.inputFiles()}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0], files
    ledger.commit("b4", rows([7]).withColumn("op", F.lit("delete")))
    ledger.compact()
    assert ledger.live().count() == 399 and len([n for n in os.listdir(f"{tmp_path}/live") if n.isdigit()]) == 2
