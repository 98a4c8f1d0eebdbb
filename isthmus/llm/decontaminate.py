"""Benchmark decontamination with an FM-index for each shard of the training texts.

A task reads its documents into shards. A shard keeps the word runs that could hold a
test phrase at all (every word and every neighbouring pair known to the
benchmark, which loses nothing), sorts their suffixes, and stores the Burrows-Wheeler
transform as a wavelet matrix with prefix counts. All test phrases are then searched backwards together, a
word at a time; rows of the matching intervals are walked to the next sampled
suffix position; and the occurrences become merged removal spans of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, prepared, texts_of, written

#: Consecutive item words that make a phrase; an item of fewer words is one phrase.
PHRASE = 10
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 4 << 20
#: Words a shard's index holds, and documents, at most (the last document may exceed the first).
SHARD_WORDS, SHARD_DOCS = 400_000, 20_000
#: Every so many text positions, the suffix position is stored.
SAMPLED = 8

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: what is not a word byte becomes a space.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in LOWER)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Phrases:
    """The phrases of a block of benchmark items: word ids, distinct phrases, and the items each phrase belongs to."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int = PHRASE):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words_of((text or "").encode())]
            for i in range(max(1, len(w) - width + 1) if w else 0):
                found.setdefault(tuple(w[i : i + width]), set()).add(item)
        self.lengths = np.array([len(p) for p in found], dtype=np.int64)
        self.words = np.zeros((len(found), width), dtype=np.int64)
        for i, p in enumerate(found):
            self.words[i, : len(p)] = p
        self.items = [sorted(x for x in s if x is not None) for s in found.values()]
        self.shortest = int(self.lengths.min()) if len(found) else 0
        pairs = {p[i] << 32 | p[i + 1] for p in found for i in range(len(p) - 1)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of an array of small integers, by prefix doubling; a suffix is less than what continues it."""
    n, k = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - k] = rank[k:] if k < n else 0
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate([[1], np.cumsum(key[1:] != key[:-1]) + 1])
        rank[order] = fresh
        if fresh[-1] == n:
            return order
        k *= 2


class WaveletMatrix:
    """Rank and access over an integer sequence, a bit at a time from the highest; all arguments are arrays."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros, v = [], [], values
        for level in range(self.levels - 1, -1, -1):
            bit = (v >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before i."""
        low = np.zeros_like(i)
        for n, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, zeros = self.ones[n], self.zeros[n]
            bit = ((symbol >> level) & 1).astype(bool)
            a, b = ones[low], ones[i]
            low = np.where(bit, zeros + a, low - a)
            i = np.where(bit, zeros + b, i - b)
        return i - low

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it occurs before i."""
        low, symbol = np.zeros_like(i), np.zeros_like(i)
        for n in range(self.levels):
            ones, zeros = self.ones[n], self.zeros[n]
            bit = ones[i + 1] - ones[i]
            a, b = ones[low], ones[i]
            low = np.where(bit == 1, zeros + a, low - a)
            i = np.where(bit == 1, zeros + b, i - b)
            symbol = symbol << 1 | bit
        return symbol, i - low


class FmIndex:
    """Backward search and location in a text of positive integers; 0 ends the text."""

    def __init__(self, text: np.ndarray):
        text = np.concatenate([text, [0]])
        order = suffix_array(text)
        last = text[order - 1]
        top = int(text.max())
        self.n, self.top = len(text), top
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bwt = WaveletMatrix(last, top)
        kept = order % SAMPLED == 0
        self.kept, self.place, self.samples = kept, np.cumsum(kept) - 1, order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each phrase (rows of a matrix, filled from the left); empty where low >= high."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - step]
            known = c <= self.top
            high[live[~known]] = 0
            at, c = live[known], c[known]
            low[at], high[at] = self.before[c] + self.bwt.rank(c, low[at]), self.before[c] + self.bwt.rank(c, high[at])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps = np.zeros(len(rows), dtype=np.int64), 0
        left, at = np.arange(len(rows)), rows
        while len(left):
            hit = self.kept[at]
            out[left[hit]] = self.samples[self.place[at[hit]]] + steps
            left, at = left[~hit], at[~hit]
            c, r = self.bwt.access_rank(at)
            at, steps = self.before[c] + r, steps + 1
        return out


class Shard:
    """Documents with their word runs that may hold phrases; equal runs are indexed once."""

    def __init__(self, phrases: Phrases):
        self.p, self.docs, self.n_words, self.words = phrases, [], [], 0
        self.runs: dict[bytes, list[tuple[int, int]]] = {}

    def add(self, keys: list[tuple], texts: list[bytes]) -> None:
        p, get = self.p, self.p.ids.get
        for key, text in zip(keys, texts, strict=True):
            w = words_of(text)
            doc = len(self.docs)
            self.docs.append(key)
            self.n_words.append(len(w))
            if not p.shortest or len(w) < p.shortest:
                continue
            ids = np.fromiter((get(x, 0) for x in w), dtype=np.int64, count=len(w))
            if p.shortest == 1:
                inside = ids > 0
            else:
                both = np.flatnonzero((ids[1:] > 0) & (ids[:-1] > 0))
                code = ids[both] << 32 | ids[both + 1]
                at = np.minimum(np.searchsorted(p.pairs, code), len(p.pairs) - 1)
                both = both[p.pairs[at] == code]
                # A run of known pairs; runs that only touch at one word stay apart.
                cut = np.flatnonzero(np.diff(both) != 1)
                for a, b in zip(np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(both) - 1]]), strict=True) if len(both) else ():
                    self._run(doc, ids, int(both[a]), int(both[b]) + 2)
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
            for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                self._run(doc, ids, a, b)

    def _run(self, doc: int, ids: np.ndarray, a: int, b: int) -> None:
        if b - a >= self.p.shortest:
            places = self.runs.setdefault(ids[a:b].astype("<u4").tobytes(), [])
            if not places:
                self.words += b - a + 1
            places.append((doc, a))

    def full(self) -> bool:
        return self.words >= SHARD_WORDS or len(self.docs) >= SHARD_DOCS

    def results(self) -> Iterator[tuple]:
        """(key, n_words, spans, items) of each document: merged [start, end) word spans, and sorted ids of items found."""
        spans: list[list[tuple[int, int]]] = [[] for _ in self.docs]
        items: list[set] = [set() for _ in self.docs]
        if self.runs:
            runs = [np.frombuffer(r, dtype="<u4").astype(np.int64) for r in self.runs]
            starts = np.cumsum([0] + [len(r) + 1 for r in runs])
            text = np.ones(starts[-1], dtype=np.int64)
            for s, r in zip(starts.tolist(), runs, strict=False):
                text[s : s + len(r)] = r + 1
            index = FmIndex(text)
            low, high = index.search(self.p.words + 1, self.p.lengths)
            n = np.maximum(high - low, 0)
            phrase = np.repeat(np.arange(len(n)), n)
            rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(phrase))
            at = index.locate(rows)
            run = np.searchsorted(starts, at, side="right") - 1
            by_run: dict[int, list[tuple[int, int]]] = {}
            for r, ph, off in zip(run.tolist(), phrase.tolist(), (at - starts[run]).tolist(), strict=True):
                by_run.setdefault(r, []).append((off, ph))
            for r, places in enumerate(self.runs.values()):
                if r in by_run:
                    merged: list[list[int]] = []
                    for off, ph in sorted(by_run[r]):
                        end = off + int(self.p.lengths[ph])
                        if merged and off <= merged[-1][1]:
                            merged[-1][1] = max(end, merged[-1][1])
                        else:
                            merged.append([off, end])
                    names = {x for _, ph in by_run[r] for x in self.p.items[ph]}
                    for doc, start in places:
                        spans[doc] += [(start + a, start + b) for a, b in merged]
                        items[doc] |= names
        for key, n_words, s, x in zip(self.docs, self.n_words, spans, items, strict=True):
            yield key, n_words, united(s), sorted(x)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RESULT = "row long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def _searched(docs: DataFrame, items: list[tuple], width: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        phrases = Phrases(held.value, width)
        shard = Shard(phrases)

        def out(shard):
            got = list(shard.results())
            for i in range(0, len(got), 5000):
                part = got[i : i + 5000]
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0][0] for g in part], pa.int64()), pa.array([g[0][1] for g in part], pa.int64()), pa.array([g[1] for g in part], pa.int64()),
                     pa.array([[{"start": a, "end": b} for a, b in g[2]] for g in part], span), pa.array([g[3] for g in part], pa.list_(pa.int64()))],
                    names=["row", "doc_id", "n_words", "spans", "items"])

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            texts = texts_of(batch.column(2))
            for i in range(0, len(keys), 100):
                shard.add(keys[i : i + 100], texts[i : i + 100])
                if shard.full():
                    yield from out(shard)
                    shard = Shard(phrases)
        yield from out(shard)

    return docs.mapInArrow(run, RESULT)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, width: int = PHRASE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (merged [start, end) word positions inside occurrences of phrases), items (sorted ids of the items found).

    One row for each row of docs; a null text has no words. Items that share an id
    count as one; an item with a null id marks words but isn't listed; a null or
    wordless item has no phrase. An empty benchmark finds nothing, empty
    docs give no rows. Columns besides doc_id, text and item_id, text are ignored. A
    benchmark of over block_bytes is searched in blocks, whose spans are united.
    """
    spark = prepared(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    docs = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if n == 1:
        return _searched(docs, [tuple(r) for r in items.collect()], width).drop("row")
    docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    parts = [written(_searched(docs, [tuple(r) for r in items.where(block == b).collect()], width), "spans") for b in range(n)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    span = "struct<start:bigint,end:bigint>"
    merged = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    join = f"""aggregate(s, cast(array() as array<{span}>), (acc, x) -> if(size(acc) > 0 and x.start <= element_at(acc, -1).end,
        concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))), concat(acc, array(x))))"""
    return merged.select("doc_id", "n_words", F.expr(join).alias("spans"), "items")
