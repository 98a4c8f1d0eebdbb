"""Delta-maintained token counts: signed rows in, additive totals out, each batch committed once.

A ledger is a folder:

* ``log/batch=B/attempt=A``: signed rows (doc_id, version, source, lang, tokens, sign, bucket). An insert
  adds a row with +1, a delete repeats the live row with -1, a revision does both.
* ``totals/batch=B/attempt=A``: what a batch adds to documents and tokens by source, language and
  tokenizer version. Reading the totals sums these few rows; no document is counted again.
* ``commits/B``: a small file that names the attempt which counts. It is created only if it isn't there, so of two writers
  of one batch, or of a run and its repetition, the first one to get so far counts and the
  other takes its attempt back. What a run that died left without a commit is never read.
* ``live/N``: after every COMPACT_EVERY batches the live rows, by bucket of their keys, and the batches that they
  stand for. A commit reads the last of these and the logs since, of its own keys' buckets only, so that what it
  reads follows the batch, not the history.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, SPACED, discard, joined, prepared, texts_of, words_in, written
from .imatch import chunks
from .packing import WordIds

KEYS, GROUP = ["doc_id", "version"], ["source", "lang", "version"]
LOG = "doc_id long, version string, source string, lang string, tokens long, sign int, bucket int"
TOTALS = "source string, lang string, version string, docs long, tokens long"

#: Tokenizer versions: the bytes that make words, and whether the text is lower-cased first; or the path of a tokenizer for which WordIds holds.
VERSIONS = {"spaced-1": (SPACED, False), "alnum-1": (ALNUM, True)}
_NAME = re.compile(r"[A-Za-z0-9._-]+")


def counted(docs: DataFrame, versions: dict | None = None) -> DataFrame:
    """doc_id, source, lang, version, tokens: a row for each document and tokenizer version; a null text has no tokens."""
    versions = versions or VERSIONS

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = texts_of(batch.column(3))
            for version, how in versions.items():
                n = []
                for a, b in chunks(texts):
                    if isinstance(how, str):
                        coder = WordIds(how, None)
                        n.append(np.array([len(x) // 4 for x in coder(texts[a:b])], dtype=np.int64))
                        continue
                    table, lower = how
                    buf, offsets = joined([t.translate(LOWER) if lower else t for t in texts[a:b]])
                    n.append(np.diff(words_in(buf, offsets, table)[2]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * batch.num_rows, pa.string()), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], names=["doc_id", "source", "lang", "version", "tokens"])

    prepared(docs.sparkSession)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text"))]
    return docs.select(*cols).mapInArrow(run, "doc_id long, source string, lang string, version string, tokens long")


#: Buckets of keys; batches after which live rows are written down.
BUCKETS, COMPACT_EVERY = 64, 16
#: Seconds after which a commit without content is taken for a dead writer's.
STALE_S = 600


class TokenLedger:
    """Totals by source, language and tokenizer version, kept up to date by signed batches in a shared folder."""

    def __init__(self, spark: SparkSession, root: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every

    def _files(self, path: str):
        """A path and its file system, of whatever store it is in."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._files(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _claim(self, path: str, text: str) -> bool:
        """Creates a small file unless it is there; False if it is."""
        fs, p = self._files(path)
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _text(self, path: str) -> str:
        fs, p = self._files(path)
        stream = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def _drop(self, path: str) -> None:
        fs, p = self._files(path)
        fs.delete(p, True)

    def batches(self) -> list[str]:
        """Committed batches."""
        return [n for n in self._names("commits") if not n.startswith(".")]

    def _attempts(self, batches: list[str]) -> dict[str, str]:
        """The attempt that counts of each batch; a commit just created and not yet written is no commit yet."""
        found = {b: self._text(f"{self.root}/commits/{b}") for b in batches}
        return {b: a for b, a in found.items() if a}

    def _committed(self, batch: str) -> bool:
        """Whether a batch counts. A commit that a writer has created but not written yet may still come: RuntimeError. One that stays so for STALE_S seconds is of a writer that died, and goes."""
        if batch not in self.batches():
            return False
        path = f"{self.root}/commits/{batch}"
        if self._text(path):
            return True
        fs, p = self._files(path)
        if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 < STALE_S:
            raise RuntimeError(f"another writer is about to commit {batch}; try again")
        self._drop(path)
        return False

    def _read(self, table: str, schema: str, batches: list[str]) -> DataFrame:
        paths = [f"{self.root}/{table}/batch={b}/attempt={a}" for b, a in self._attempts(batches).items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _snapshot(self) -> tuple[str | None, list[str]]:
        """The last folder of live rows that was finished, and its batches."""
        done = [int(n.removesuffix(".batches")) for n in self._names("live") if n.endswith(".batches") and not n.startswith(".")]
        if not done:
            return None, []
        folder = f"{self.root}/live/{max(done)}"
        return folder, self._text(f"{folder}.batches").split()

    def live(self, keys: DataFrame | None = None) -> DataFrame:
        """The current row of each document and version; keys (doc_id, version): of these only, from their buckets."""
        folder, old = self._snapshot()
        log = self._read("log", LOG, [b for b in self.batches() if b not in set(old)])
        if folder:
            log = log.unionByName(self.spark.read.schema(LOG).parquet(folder))
        if keys is not None:
            k = keys.select(*(F.col(c).alias(f"key_{c}") for c in KEYS))
            wanted = [r["b"] for r in keys.select(_bucket().alias("b")).distinct().collect()]  # BUCKETS at most
            log = log.where(F.col("bucket").isin(*wanted) if wanted else F.lit(False))
            log = log.join(k, F.col("doc_id").eqNullSafe(F.col("key_doc_id")) & F.col("version").eqNullSafe(F.col("key_version")), "left_semi")
        return log.groupBy(*KEYS, "source", "lang", "tokens").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def compact(self) -> None:
        """Writes down the live rows of all batches committed so far."""
        batches = list(self._attempts(self.batches()))
        folder = f"{self.root}/live/{len(batches)}"
        if not batches or f"{len(batches)}.batches" in self._names("live"):
            return
        before, _ = self._snapshot()
        rows = self.live().select(*KEYS, "source", "lang", "tokens", F.lit(1).alias("sign")).withColumn("bucket", _bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        self._claim(f"{folder}.batches", "\n".join(batches))
        # The one before last may still be read by others; older ones are not.
        for n in self._names("live"):
            if n.isdigit() and before and int(n) < int(before.rsplit("/", 1)[1]):
                self._drop(f"{self.root}/live/{n}.batches")
                self._drop(f"{self.root}/live/{n}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch of changes (op, doc_id, version, source, lang, tokens, and optionally seq); False if it was committed before, or by another writer meanwhile.

        op is insert, revise or delete. An insert of a live key is a revision, a
        revision of an unknown key an insert, a delete of an unknown key nothing. Of
        several changes to a key the one with the highest seq holds, then the one with the most tokens, then the last by op, source and language.
        A null doc_id is a key like any other; null sources, languages and versions are groups of their own; null tokens count 0.
        Batches that touch the same keys are to be committed one after another.
        """
        if not _NAME.fullmatch(batch):
            raise ValueError("a batch's name is made of letters, digits, dots, underscores and hyphens")
        if self._committed(batch):
            return False
        attempt = uuid.uuid4().hex
        if "seq" not in changes.columns:
            changes = changes.withColumn("seq", F.lit(0))
        row = F.struct(F.col("seq"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "op", "source", "lang")
        new = changes.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version").agg(F.max(row).alias("r")).select(*KEYS, "r.*")
        new = written(new, "changes")
        live = self.live(new).select(*(F.col(c).alias(f"old_{c}") for c in [*KEYS, "source", "lang", "tokens"]), F.lit(True).alias("known"))
        both = new.join(live, F.col("doc_id").eqNullSafe(F.col("old_doc_id")) & F.col("version").eqNullSafe(F.col("old_version")), "left")
        old = F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_tokens").alias("tokens"), F.lit(-1).alias("sign"))
        now = F.struct("source", "lang", "tokens", F.lit(1).alias("sign"))
        rows = F.concat(F.when(F.col("known"), F.array(old)).otherwise(F.array().cast("array<struct<source:string,lang:string,tokens:bigint,sign:int>>")),
                        F.when(F.col("op") != "delete", F.array(now)).otherwise(F.array().cast("array<struct<source:string,lang:string,tokens:bigint,sign:int>>")))
        signed = both.select(*KEYS, F.inline(rows)).withColumn("bucket", _bucket())
        log, totals = (f"{self.root}/{t}/batch={batch}/attempt={attempt}" for t in ("log", "totals"))
        signed.write.parquet(log)
        delta = self.spark.read.schema(LOG).parquet(log).groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        delta.coalesce(1).write.parquet(totals)
        discard(new)
        if not self._claim(f"{self.root}/commits/{batch}", attempt):
            self._drop(log)
            self._drop(totals)
            return not self._committed(batch) and self.commit(batch, changes)
        if len(self.batches()) - len(self._snapshot()[1]) >= self.compact_every:
            self.compact()
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens of all committed batches; groups without documents are left out."""
        return self._read("totals", TOTALS, self.batches()).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")

    def recounted(self) -> DataFrame:
        """The same from the live rows, for audits."""
        return self.live().groupBy(*GROUP).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))


def _bucket():
    """Of a key."""
    return F.pmod(F.xxhash64("doc_id", "version"), F.lit(BUCKETS)).cast("int")
