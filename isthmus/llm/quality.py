"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), whose
pairwise part is taken in linear time as half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.
Features are the distinct hashed words of the whole text (each 1 / sqrt(their number)) and
structure statistics, each spread over two neighbouring steps of a fixed scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, SPACED, besides, crc_side, discard, hashed, joined, prepared, released, texts_of, words_in, written
from .imatch import chunks

WORD_BITS = 15
FACTORS = 8
#: Labelled rows the machine is fitted on, at most: those with the least hash of their id.
FIT_ROWS = 12_000
#: Feature slots of fitted rows the driver holds, at most (8 bytes each); a row has one for each distinct word bucket. Of the sample, rows count in the order of their ids' hashes until the next one would not fit.
FIT_SLOTS = 8_000_000
THRESHOLD = 0.3
STEPS = 12
EPOCHS, BATCH, RATE = 12, 128, 0.05

#: Lower and upper end of the scale of each statistic of structure().
SCALES = [(0, 13), (0, 10), (0, 30), (0, 1), (0, 1), (0, 1), (0, 0.5), (0, 0.5), (0, 1), (0, 1), (0, 1), (0, 1), (0, 10), (0, 1)]


def _class_table(text: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(text)] = True
    return out


_UPPER, _DIGIT = _class_table(bytes(range(65, 91))), _class_table(bytes(range(48, 58)))
_SENTENCE, _LETTER = _class_table(b".,;:!?'\"-()"), _class_table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_SPACE = ~SPACED


class Features:
    """Sparse features of texts: for row i, slots index[first[i]:first[i + 1]] and their values."""

    def __init__(self, texts: list[bytes]):
        n = len(texts)
        buf, offsets = joined(texts)
        starts, ends, first = words_in(buf, offsets, SPACED)
        counts = np.diff(first)
        doc = np.repeat(np.arange(n), counts)
        lower = np.frombuffer(bytes(buf).translate(LOWER), dtype=np.uint8)
        h = hashed(lower, starts, ends)
        bucket = (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        code, mult = np.unique(doc << WORD_BITS | bucket, return_counts=True)
        row, slot = code >> WORD_BITS, code & ((1 << WORD_BITS) - 1)
        distinct = np.bincount(row, minlength=n)
        value = 1 / np.sqrt(np.maximum(distinct, 1))[row]
        stats = self.structure(buf, offsets, starts, ends, counts, doc, h, distinct, np.maximum.reduceat(np.append(mult, 0), np.minimum(np.searchsorted(row, np.arange(n)), len(mult))) * (distinct > 0))
        scale = np.array(SCALES, dtype=float)
        at = np.clip((stats - scale[:, 0]) / (scale[:, 1] - scale[:, 0]), 0, 1) * (STEPS - 1)
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        base = (1 << WORD_BITS) + np.arange(len(SCALES)) * STEPS + low
        k = len(SCALES)
        row = np.concatenate([row, np.repeat(np.arange(n), 2 * k)])
        slot = np.concatenate([slot, np.stack([base, base + 1], axis=2).reshape(-1)])
        value = np.concatenate([value, np.stack([1 - (at - low), at - low], axis=2).reshape(-1) / np.sqrt(k)])
        order = np.argsort(row, kind="stable")
        self.first = np.searchsorted(row[order], np.arange(n + 1))
        self.index, self.value = slot[order], value[order]

    @staticmethod
    def structure(buf, offsets, starts, ends, counts, doc, h, distinct, most) -> np.ndarray:
        """Statistics of each text, a column for each entry of SCALES."""
        n = len(counts)
        size = np.diff(offsets) - 1
        body = buf[: offsets[-1]]

        def share(table, of=None):
            total = np.concatenate([[0], np.cumsum(table[body], dtype=np.int64)])
            return total[offsets[1:]] - total[offsets[:-1]]

        chars = np.maximum(size, 1)
        words = np.maximum(counts, 1)
        lens = (ends - starts).astype(float)
        mean = np.bincount(doc, lens, minlength=n) / words
        spread = np.sqrt(np.maximum(np.bincount(doc, lens**2, minlength=n) / words - mean**2, 0))
        letters = _LETTER[body[np.minimum(ends - 1, len(body) - 1)]] if len(ends) else np.zeros(0, bool)
        closed = np.bincount(doc, ~(letters | _SENTENCE[body[ends - 1]]) if len(ends) else None, minlength=n) / words if len(ends) else np.zeros(n)
        alone = np.bincount(doc, (lens == 1) & ~_LETTER[body[starts]], minlength=n) / words if len(ends) else np.zeros(n)
        again = np.zeros(n)
        if len(h) > 1:
            again = np.bincount(doc[1:], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), minlength=n) / words
        lines = np.concatenate([[0], np.cumsum(body == 10, dtype=np.int64)])
        lines = lines[offsets[1:]] - lines[offsets[:-1]]
        other = chars - np.minimum(share(_LETTER | _DIGIT | _SENTENCE | _SPACE) - 1, chars)
        return np.stack([
            np.log1p(size), np.log1p(counts), np.minimum(mean, 30), share(_LETTER) / chars, distinct / words, most / words, share(_UPPER) / chars, share(_DIGIT) / chars,
            other / chars, closed, alone, again, np.log1p(lines), np.minimum(spread / np.maximum(mean, 1), 1),
        ], axis=1)


SLOTS = (1 << WORD_BITS) + len(SCALES) * STEPS


class Machine:
    """The fitted weights; score() takes Features."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(SLOTS)
        self.v = rng.normal(0, 0.01, (SLOTS, FACTORS))

    def parts(self, index, value, first):
        vx = self.v[index] * value[:, None]
        cut = first[:-1]
        linear = np.add.reduceat(self.w[index] * value, cut)
        s = np.add.reduceat(vx, cut, axis=0)
        q = np.add.reduceat(vx**2, cut, axis=0)
        return self.bias + linear + 0.5 * (s**2 - q).sum(axis=1), vx, s

    def score(self, x: Features) -> np.ndarray:
        z = self.parts(x.index, x.value, x.first)[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, index: np.ndarray, value: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Machine:
        """Mini-batches of the logistic loss with adaptive steps."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(SLOTS, 1e-6), np.full((SLOTS, FACTORS), 1e-6), 1e-6
        share = np.clip(y.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                n = first[rows + 1] - first[rows]
                cut = np.concatenate([[0], np.cumsum(n)])
                at = np.repeat(first[rows] - cut[:-1], n) + np.arange(cut[-1])
                idx, val = index[at].astype(np.int64), value[at].astype(float)
                z, vx, s = self.parts(idx, val, cut)
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                each = np.repeat(d, n)
                u, back = np.unique(idx, return_inverse=True)
                dw = np.bincount(back, each * val)
                dv = np.zeros((len(u), FACTORS))
                both = (np.repeat(s, n, axis=0) - vx) * (each * val)[:, None]
                for f in range(FACTORS):
                    dv[:, f] = np.bincount(back, both[:, f])
                dw += 1e-6 * self.w[u]
                dv += 1e-6 * self.v[u]
                gw[u] += dw**2
                gv[u] += dv**2
                gb += d.sum() ** 2
                self.w[u] -= RATE * dw / np.sqrt(gw[u])
                self.v[u] -= RATE * 0.3 * dv / np.sqrt(gv[u])
                self.bias -= RATE * d.sum() / np.sqrt(gb)
        return self


def sample(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, y: at most `rows` labelled documents of the training side, those with the least hash of their id; an id labelled several times takes the majority, good at a draw."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).where("doc_id is not null and q is not null").where(crc_side() != 0)
    return good.groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def content(column) -> np.ndarray:
    """The bytes of an Arrow binary array, one value after another, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, slots: int = FIT_SLOTS) -> Machine:
    """A machine fitted on the sample; without any labelled document it gives one half to every text.

    What it is fitted on depends on the rows alone, not on how the table is split.
    """
    chosen = sample(labels, rows)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, y, ids = texts_of(batch.column(1)), batch.column(2), batch.column(0)
            for a, b in chunks(texts):
                x = Features(texts[a:b])
                packed = [pa.array([arr[i:j].tobytes() for i, j in zip(x.first[:-1], x.first[1:], strict=True)], pa.binary()) for arr in (x.index.astype("<i4"), x.value.astype("<f4"))]
                yield pa.RecordBatch.from_arrays([ids[a:b], y[a:b], pa.array(np.diff(x.first)), *packed], names=["doc_id", "y", "n", "index", "value"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    got = written(found.mapInArrow(run, "doc_id long, y int, n long, index binary, value binary").withColumn("place", F.xxhash64("doc_id")), "features")
    # Repeated ids follow each other by their features.
    order = [F.col("place"), F.col("doc_id"), F.col("n"), F.xxhash64("index")]
    upto = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over the sample only
    held = got.select("*", upto.alias("upto")).where(F.col("upto") <= slots).orderBy(*order).select("y", "n", "index", "value").toArrow().combine_chunks()
    discard(got)
    if not held.num_rows:
        blank = Machine()
        blank.v[:] = 0
        return blank
    # The columns' own buffers, without copies: they are the most that the driver holds.
    index, value = (content(held.column(c).combine_chunks()).view(t) for c, t in (("index", "<i4"), ("value", "<f4")))
    first = np.concatenate([[0], np.cumsum(held.column("n").to_numpy())])
    machine = Machine().fit(index, value, first, held.column("y").to_numpy().astype(float))
    del held, index, value
    released()
    return machine


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS, slots: int = FIT_SLOTS) -> DataFrame:
    """All columns of docs with held_out, score (0 to 1) and predicted; such columns of docs are replaced.

    Fitted on at most `rows` labelled documents with `slots` features together, scored everywhere.
    The score depends on the text alone: a null text scores as an empty one,
    equal texts score alike. A null doc_id is not held out. Labels of unknown documents and
    null labels are ignored; without any usable label every score is 0.5. An empty
    table gives no rows.
    """
    spark = prepared(docs.sparkSession)
    held = spark.sparkContext.broadcast(fitted(docs, labels, rows, slots))
    keep = besides(docs.columns, "held_out", "score", "predicted")
    docs = docs.select(*keep)
    at = keep.index("text")
    types = [f.dataType for f in docs.schema]
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([StructField(c, t) for c, t in zip(keep, types, strict=True)] + [StructField("score", DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, score = texts_of(batch.column(at)), []
            for a, b in chunks(texts):
                score.append(held.value.score(Features(texts[a:b])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(score) if score else np.zeros(0))], names=[*keep, "score"])
        released()

    out = docs.mapInArrow(run, schema)
    return out.withColumn("held_out", crc_side() == 0).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
