"""Substring dedup over words by recompression.

Every round names pairs of neighbouring symbols: each symbol falls on a left or right side by
its own hash, and a left one merges with a right one that follows it. The
first round names runs of one token. A name is a hash of what it is made of, so all
workers give equal content the same name and a round needs no shuffle; Spark gathers
names once, after the last round. A symbol remembers which words its name and its bounds
depend on. A window that contains all of these contains the symbol wherever
it occurs, so a window of which one such symbol occurs in no other document is new.

The windows left are compared as a whole, by 128 bits of two independent hashes of their words; what
long repeats share falls out of that, seams between different sources included. They are compared in PASSES parts by
hash, one after another, so that disk holds the shuffle of one part. Names and windows are
first reduced to the least document that has them, then joined back, so that a
passage of very many documents can be split between tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, discard, doubled, hashed, joined, mixed, prepared, released, texts_of, words_in, written
from .imatch import chunks

WINDOW = 50
#: Rounds of pairing; the mean symbol then has about (4/3)^ROUNDS words.
ROUNDS = 8
#: Parts in which windows are compared.
PASSES = 4
_FAR = np.int64(1) << np.int64(50)
_C = np.uint64(0x9E3779B97F4A7C15)


def symbols(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """name, doc, low, high of the symbols of consecutive documents, given as word hashes and document indices.

    [low, high) are the words on which the symbol depends; it reaches beyond
    all words where a document's end decides.
    """
    if not len(h):
        return h, doc, np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.ones(len(h), dtype=bool)
    head[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, len(h)))
    name, doc = h[at], doc[at]
    name = np.where(length > 1, mixed(name * _C + length.astype(np.uint64)), name)
    low, high = at - 1, at + length + 1

    def outer(doc):
        first = np.ones(len(doc), dtype=bool)
        first[1:] = doc[1:] != doc[:-1]
        return first, np.append(first[1:], True)

    first, last = outer(doc)
    low[first], high[last] = -_FAR, _FAR
    for r in range(rounds):
        right = (mixed(name + np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
        first, last = outer(doc)
        pair = np.zeros(len(name), dtype=bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~last[:-1]
        second = np.append(False, pair[:-1])
        nlow, nhigh = low.copy(), high.copy()
        ahead = np.flatnonzero(~right & ~last)  # a left symbol depends on what follows, merged or not
        nlow[ahead], nhigh[ahead] = np.minimum(low[ahead], low[ahead + 1]), np.maximum(high[ahead], high[ahead + 1])
        back = np.flatnonzero(right & ~first & ~second)  # a right one on what comes before
        nlow[back], nhigh[back] = np.minimum(low[back], low[back - 1]), np.maximum(high[back], high[back - 1])
        nlow[right & first], nhigh[~right & last] = -_FAR, _FAR
        merged = np.flatnonzero(pair)
        new = name.copy()
        new[merged] = mixed(mixed(name[merged]) * _C + name[merged + 1] + np.uint64(r + 1))
        keep = ~second
        name, doc, low, high = new[keep], doc[keep], nlow[keep], nhigh[keep]
    return name, doc, low, high


class Parsed:
    """A few documents: word hashes, and for each its symbols that a window can hold, by order of first occurrence."""

    def __init__(self, texts: list[bytes], rounds: int, window: int):
        self.buf, self.offsets = joined(texts)
        self.starts, self.ends, self.first = words_in(self.buf, self.offsets, SPACED)
        n = np.diff(self.first)
        self.hash = hashed(self.buf, self.starts, self.ends, 1)
        name, doc, low, high = symbols(self.hash, np.repeat(np.arange(len(texts)), n), rounds)
        good = (low >= 0) & (high - low <= window)
        self.name, self.doc, self.low, self.high = name[good], doc[good], low[good], high[good]
        self.cut = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def names(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct names of document i, and for each of its symbols which it has."""
        return np.unique(self.name[self.cut[i] : self.cut[i + 1]], return_inverse=True)

    def candidates(self, i: int, shared: list[int], window: int) -> np.ndarray:
        """Starts of the windows of document i all of whose symbols have names with indices in `shared`."""
        a, b = self.first[i], self.first[i + 1]
        m = b - a - window + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        names, of = self.names(i)
        new = np.ones(len(names), dtype=bool)
        new[shared] = False
        k = self.cut[i] + np.flatnonzero(new[of])
        lo, hi = np.maximum(self.high[k] - a - window, 0), np.minimum(self.low[k] - a, m - 1)
        some = lo <= hi
        gone = np.bincount(lo[some], minlength=m + 1) - np.bincount(hi[some] + 1, minlength=m + 1)
        return np.flatnonzero(np.cumsum(gone[:m]) == 0)

    def windows(self, i: int, window: int) -> np.ndarray:
        """The hash of each window of document i."""
        return doubled(self.hash[self.first[i] : self.first[i + 1]], window).view(np.int64)

    def checks(self, i: int, window: int) -> np.ndarray:
        """A second hash of each window of document i, from other hashes of its words."""
        a, b = self.first[i], self.first[i + 1]
        return doubled(hashed(self.buf, self.starts[a:b], self.ends[a:b], 2), window).view(np.int64)

    def equal(self, i: int, starts: list[int], window: int) -> np.ndarray:
        """Starts of the windows of document i that equal one of those at `starts`, by both hashes."""
        h, h2 = self.windows(i, window), self.checks(i, window)
        found = set(zip(h[starts].tolist(), h2[starts].tolist(), strict=True))
        hit = np.flatnonzero(np.isin(h, h[starts]))
        return hit[[pair in found for pair in zip(h[hit].tolist(), h2[hit].tolist(), strict=True)]]


def keyed(docs: DataFrame) -> DataFrame:
    """o (doc_id, null as the greatest), tag (a 64-bit hash of the text, which tells rows of equal id apart), tag2 (another one), doc_id, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return base.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), F.xxhash64("text").alias("tag"), F.xxhash64(F.lit(7), "text").alias("tag2"), "doc_id", "text")


def squeezed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with the text as zstd: what is shuffled with documents."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        for batch in batches:
            z = zstandard.ZstdCompressor(level=1)
            texts = texts_of(batch.column(len(columns)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array([z.compress(t) for t in texts], pa.binary())], names=[*columns, "z"])

    return docs.select(*columns, "text").mapInArrow(run, ", ".join(f"{c} long" for c in columns) + ", z binary")


def several(rows: DataFrame, keys: list[str], of: str | Column = "o") -> DataFrame:
    """The rows whose key belongs to several values of a column, with the least of them."""
    least = rows.groupBy(*keys).agg(F.min(of).alias("least"), F.max(of).alias("most")).where("least < most").drop("most")
    return rows.join(least, keys)


def removed(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by spaces) of every row of docs.

    A word goes if a window of `window` consecutive words that covers it also starts
    in a document with a smaller doc_id, judged on the input. A null text has no words; rows of
    equal doc_id don't remove from each other; a null doc_id is greater than
    any other. An empty table gives no rows; columns besides doc_id and text are ignored.
    """
    prepared(docs.sparkSession)
    docs = keyed(docs)
    # Whole copies: all their windows also start in the first of them.
    ids = written(docs.select("o", "tag", "tag2"), "ids")
    copies = ids.groupBy("tag", "tag2").agg(F.min("o").alias("first"), F.max("o").alias("last")).where("first < last")
    copies = ids.join(copies, ["tag", "tag2"]).where("o > first").select("o", "tag", F.lit(True).alias("copy")).distinct()

    def name_rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = texts_of(batch.column(1))
            o, tag = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, b in chunks(texts):
                p = Parsed(texts[a:b], rounds, window)
                found = [p.names(i)[0] for i in range(b - a)]
                n = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(o[a:b], n)), pa.array(np.repeat(tag[a:b], n)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])),
                ], names=["name", "o", "tag", "i"])
        released()

    names = written(docs.select("o", "text", "tag").mapInArrow(name_rows, "name long, o long, tag long, i int"), "names")
    shared = several(names, ["name"]).groupBy("o", "tag").agg(F.collect_set("i").alias("shared"))

    def window_rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        for batch in batches:
            z = zstandard.ZstdDecompressor()
            texts = [z.decompress(x) for x in batch.column(2).to_pylist()]
            o, tag, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            for a, b in chunks(texts):
                p = Parsed(texts[a:b], rounds, window)
                rows: list[list] = [[] for _ in range(5)]
                for i in range(b - a):
                    start = p.candidates(i, lists[a + i] or [], window)
                    if len(start):
                        h, h2 = p.windows(i, window)[start], p.checks(i, window)[start]
                        # Once for each distinct window of the document.
                        order = np.lexsort((h2, h))
                        once = order[np.append(True, (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1]))]
                        n = len(once)
                        for col, v in zip(rows, (h[once], h2[once], np.full(n, o[a + i]), np.full(n, tag[a + i]), start[once].astype(np.int32)), strict=True):
                            col.append(v)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows], names=["h", "h2", "o", "tag", "i"])
        released()

    whole = squeezed(docs, ["o", "tag"])
    left = whole.join(shared, ["o", "tag"], "left").join(copies, ["o", "tag"], "left_anti").select("o", "tag", "z", "shared")
    windows = written(left.mapInArrow(window_rows, "h long, h2 long, o long, tag long, i int"), "windows")
    discard(names)
    parts = []
    for k in range(PASSES):
        one = several(windows.where(F.pmod("h", F.lit(PASSES)) == k), ["h", "h2"]).where("o > least")
        parts.append(written(one.groupBy("o", "tag").agg(F.collect_set("i").alias("at")), "found"))
        discard()
    discard(windows)
    found = functools.reduce(DataFrame.unionByName, parts).groupBy("o", "tag").agg(F.flatten(F.collect_list("at")).alias("at"))
    marks = found.join(copies, ["o", "tag"], "full")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        for batch in batches:
            z = zstandard.ZstdDecompressor()
            texts = [z.decompress(x) for x in batch.column(1).to_pylist()]
            lists, copy = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, starts, whole_copy in zip(texts, lists, copy, strict=True):
                words = text.split()
                n, gone = len(words), 0
                if whole_copy and n >= window:
                    words, gone = [], n
                elif starts and not whole_copy:
                    p = Parsed([text], 0, window)
                    hit = p.equal(0, starts, window)
                    mark = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(mark, hit, 1)
                    np.add.at(mark, hit + window, -1)
                    mask = np.cumsum(mark)[:n] > 0
                    gone = int(mask.sum())
                    words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                n_words.append(n)
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    final = squeezed(docs, ["o", "tag", "doc_id"]).join(marks, ["o", "tag"], "left").select("doc_id", "z", "at", "copy")
    return final.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
