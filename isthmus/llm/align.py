"""Alignment of two tokenizers: which tokens of one cover which tokens of the other, and how often in the corpus.

A encodes a space and the text by a byte-level vocabulary, B encodes the text by a
vocabulary of pieces with byte fallback, which adds that space itself. Both then give
the same bytes. The tokens of B are a static index of intervals, sorted by their
starts and ends; each token of A stabs it by bisection and finds the B tokens it
overlaps. A gap between two B tokens that no A token spans is a boundary of groups.

Neither tokenizer joins anything over a space that follows a character other than white
space, so that every text falls apart there into chunks which are coded and aligned
once each, all new chunks of a batch in one index; a text's result is that of its chunks put together.

Links are counted once for a document and pair of ids: tasks sum their own documents,
Spark sums the tasks. The counts come back by broadcast while there are at most
``LOOKUP_PAIRS`` pairs of ids, else by a join; both ways give the same rows.

Rows: nulls, empty texts, and texts whose bytes the tokenizers don't give back (those that
hold U+2581) have no tokens, thus zeros and an empty string. Each row is a document of
its own, also if ids or texts repeat. Extra columns are left aside.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepared, released, written

#: Pairs of ids whose counts are broadcast (16 bytes each); more are joined.
LOOKUP_PAIRS = 4_000_000
#: Chunks that a worker remembers, pairs that a task sums before it lets them go, chunks of documents put together at once.
CACHE_CHUNKS, HELD_PAIRS, AT_ONCE = 400_000, 1_000_000, 300_000

#: Links of a group from which on its ids are counted before they are paired.
LONG_GROUP = 64

_SIZES = ("n_a", "n_b", "n_groups", "n_links")

#: From a space on, up to the next space that stands behind a character which no tokenizer takes for white space.
_CHUNK = re.compile(r" [^ ]*+(?:(?<=[\s᠎]) [^ ]*+)*+")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def pieces_in(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write bytes as characters: printable ones as themselves, the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Vocabularies:
    """Both tokenizers of a worker process and the bytes of their tokens."""

    loaded: dict[tuple[str, str], Vocabularies] = {}

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of, n_a = _byte_of(), self.a.get_vocab_size()
        self.bytes_a = [b""] * n_a
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.n_b = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        # Ids as text with what may follow them.
        self.comma, self.bar, self.semicolon = (np.array([f"{i}{mark}" for i in range(max(n_a, self.n_b))], object) for mark in ",|;")
        self.space = self.b.piece_to_id("▁")
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that go over a space cannot be aligned by chunks")

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Vocabularies:
        if (path_a, path_b) not in cls.loaded:
            cls.loaded[path_a, path_b] = cls(path_a, path_b)
        return cls.loaded[path_a, path_b]

    def coded(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for chunks, which begin with the space that B adds."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        return a, [x if len(c) > 1 else [self.space] for c, x in zip(chunks, b, strict=True)]


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token; both lists of token ends cover the same bytes from 0 on."""
    starts_a, starts_b = np.concatenate([[0], ends_a[:-1]]), np.concatenate([[0], ends_b[:-1]])
    first = np.searchsorted(ends_b, starts_a, "right")  # the least B token that ends behind the start
    last = np.searchsorted(starts_b, ends_a, "left") - 1  # the greatest one that starts before the end
    # Gap g lies behind B token g; an A token spans the gaps first .. last - 1.
    over = np.bincount(first, minlength=len(ends_b) + 1) - np.bincount(last, minlength=len(ends_b) + 1)
    free = np.cumsum(over)[: len(ends_b)] == 0
    of_b = np.concatenate([[0], np.cumsum(free)[:-1]])
    return of_b[first], of_b


class Grown:
    """A flat array of longs that grows at its end."""

    def __init__(self):
        self.data, self.n = np.zeros(1 << 12, np.int64), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(more)), np.int64)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then those from start[1] on, and so forth."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(n.sum())


class Chunks:
    """Aligned chunks, each coded when it first occurs: sizes, groups as text, and linked pairs with how often."""

    #: What a worker process remembers, from task to task.
    shared: dict[tuple[str, str], Chunks] = {}

    def __init__(self, vocabularies: Vocabularies, limit: int = CACHE_CHUNKS):
        self.vocabularies, self.limit = vocabularies, limit
        self.forget()

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Chunks:
        if (path_a, path_b) not in cls.shared:
            cls.shared[path_a, path_b] = cls(Vocabularies.of(path_a, path_b))
        return cls.shared[path_a, path_b]

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str | None] = []
        self.sizes = [Grown() for _ in _SIZES]
        self.first, self.keys, self.times = Grown(), Grown(), Grown()
        self.first.add(np.zeros(1, np.int64))

    def numbers(self, chunks: list[str]) -> list[int]:
        number = self.number
        fresh = list({c: None for c in chunks if c not in number})
        if fresh:
            self._add(fresh)
        return [number[c] for c in chunks]

    def _add(self, fresh: list[str]) -> None:
        v = self.vocabularies
        ids_a, ids_b = v.coded(fresh)
        raw = [c.encode() for c in fresh]
        good = [b"".join(map(v.bytes_a.__getitem__, a)) == r == b"".join(map(v.bytes_b.__getitem__, b)) for r, a, b in zip(raw, ids_a, ids_b, strict=True)]
        if not all(good):
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
        texts, sizes, n_keys, keys, times = self._aligned(ids_a, ids_b)
        self.number.update(zip(fresh, range(len(self.text), len(self.text) + len(fresh)), strict=True))
        self.text.extend(texts if all(good) else [t if ok else None for t, ok in zip(texts, good, strict=True)])
        for held, more in zip(self.sizes, sizes, strict=True):
            held.add(more)
        self.first.add(self.keys.n + np.cumsum(n_keys))
        self.keys.add(keys)
        self.times.add(times)

    def _aligned(self, ids_a: list[list[int]], ids_b: list[list[int]]) -> tuple:
        """For chunks coded both ways: groups as text, sizes, number of linked pairs, and all linked pairs (A id times the size of B's vocabulary plus B id) with how often. A pair may stand several times in a chunk, but ids of long groups are counted first, so that such groups don't make all pairs of occurrences."""
        v = self.vocabularies
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        a, b = (np.fromiter(itertools.chain.from_iterable(x), np.int64, n.sum()) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        if not len(a):
            zero = np.zeros(len(ids_a), np.int64)
            return [""] * len(ids_a), (zero,) * 4, zero, a, a
        of_a, of_b = groups_of(np.cumsum(v.lengths_a[a]), np.cumsum(v.lengths_b[b]))
        total = int(of_b[-1]) + 1
        in_a, in_b = np.bincount(of_a, minlength=total), np.bincount(of_b, minlength=total)
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        # Groups in order, each with its A tokens, then its B tokens; what stands behind a token tells the form in which it is written.
        last_a, last_b = (np.append(x[1:] != x[:-1], True) for x in (of_a, of_b))
        place_a, place_b = np.arange(len(a)) + from_b[of_a], np.arange(len(b)) + (from_a + in_a)[of_b]
        form = np.empty(len(a) + len(b), object)
        form[place_a] = np.where(last_a, v.bar[a], v.comma[a])
        form[place_b] = np.where(last_b, v.semicolon[b], v.comma[b])
        form = form.tolist()
        cuts = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        texts = ["".join(form[i:j])[:-1] for i, j in itertools.pairwise(cuts)]
        links = in_a * in_b
        chunk = np.repeat(np.arange(len(ids_a)), n_a)[from_a]
        sizes = n_a, n_b, np.bincount(chunk, minlength=len(ids_a)), np.zeros(len(ids_a), np.int64)
        np.add.at(sizes[3], chunk, links)
        small = links <= LONG_GROUP
        mine = np.flatnonzero(small[of_a])
        often = in_b[of_a[mine]]
        keys = np.repeat(a[mine] * v.n_b, often) + b[ranges(from_b[of_a[mine]], often)]
        group, times = np.repeat(of_a[mine], often), np.ones(len(keys), np.int64)
        if not small.all():
            parts = [(group, keys, times)]
            for g in np.flatnonzero(~small).tolist():
                x, m = np.unique(a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
                y, n = np.unique(b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
                parts.append((np.full(len(x) * len(y), g), (x[:, None] * v.n_b + y).ravel(), (m[:, None] * n).ravel()))
            group, keys, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(group, kind="stable")
            group, keys, times = group[order], keys[order], times[order]
        return texts, sizes, np.bincount(chunk[group], minlength=len(ids_a)), keys, times

    def documents(self, numbers: list[list[int]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each document, given as the numbers of its chunks: sizes (n_a, n_b, n_groups, n_links), distinct pairs in order, and how often each is linked."""
        lens = np.fromiter(map(len, numbers), np.int64, len(numbers))
        flat = np.fromiter(itertools.chain.from_iterable(numbers), np.int64, lens.sum())
        all_chunks = max(1, len(self.text))
        # A chunk once for each document, with how often.
        chunk, often = np.unique(np.repeat(np.arange(len(numbers)), lens) * all_chunks + flat, return_counts=True)
        doc, chunk = chunk // all_chunks, chunk % all_chunks
        sizes = np.zeros((len(numbers), 4), np.int64)
        for i, held in enumerate(self.sizes):
            np.add.at(sizes[:, i], doc, held.data[chunk] * often)
        start = self.first.data[chunk]
        n = self.first.data[chunk + 1] - start
        place = ranges(start, n)
        doc, key, often = np.repeat(doc, n), self.keys.data[place], self.times.data[place] * np.repeat(often, n)
        order = np.lexsort((key, doc))
        doc, key, often = doc[order], key[order], often[order]
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
        often = np.add.reduceat(often, head) if len(head) else often
        cuts = np.searchsorted(doc[head], np.arange(1, len(numbers)))
        return sizes, np.split(key[head], cuts), np.split(often, cuts)


_ALIGNED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: bool = False) -> DataFrame:
    """doc_id, row (a number of the row's own), n_a, n_b, n_groups, n_links, groups_sha256, and the row's linked pairs of ids in order: pairs (little-endian longs, A id times the size of B's vocabulary plus B id) and times. groups: also the groups themselves, as ``a1,a2|b1;a3|b2,b3``."""
    a, b = default_tokenizers()
    a, b = path_a or a, path_b or b
    schema = _ALIGNED + (", groups string" if groups else "")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        chunks, row = Chunks.of(a, b), TaskContext.get().partitionId() << 40
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                began, numbers, found, size = at, [], [], 0
                while at < len(texts) and (size < AT_ONCE or at == began):
                    cut = _CHUNK.findall(" " + texts[at]) if texts[at] else []
                    found.append(cut)
                    size += len(cut)
                    at += 1
                if len(chunks.text) > chunks.limit:
                    chunks.forget()
                flat = chunks.numbers([c for cut in found for c in cut])
                spot = 0
                for cut in found:
                    mine = flat[spot : spot + len(cut)]
                    spot += len(cut)
                    numbers.append([] if any(chunks.text[n] is None for n in set(mine)) else mine)
                whole = [";".join([chunks.text[n] for n in x]) for x in numbers]
                if any(numbers):
                    sizes, keys, times = chunks.documents(numbers)
                else:
                    sizes, keys, times = np.zeros((len(numbers), 4), np.int64), [np.zeros(0, np.int64)] * len(numbers), [np.zeros(0, np.int64)] * len(numbers)
                columns = [
                    ids.slice(began, at - began), pa.array(np.arange(row, row + len(numbers))), *(pa.array(sizes[:, i]) for i in range(4)),
                    pa.array([hashlib.sha256(w.encode()).hexdigest() if x else "" for w, x in zip(whole, numbers, strict=True)]),
                    pa.array([k.astype("<i8").tobytes() for k in keys], pa.binary()), pa.array([t.astype("<i8").tobytes() for t in times], pa.binary()),
                ]
                row += len(numbers)
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(whole)] if groups else []), names=names)
        released()

    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """key, n: in how many documents each pair of ids is linked; found: rows of aligned()."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []
        fresh, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            parts = [np.unique(np.concatenate(fresh), return_counts=True)] if fresh else []
            keys, n = (np.concatenate(x) for x in zip(*held, *parts, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                fresh.append(np.frombuffer(raw, "<i8"))
                size += len(raw) // 8
                if size > HELD_PAIRS:
                    held, fresh, size = [merged()], [], 0
                    if len(held[0][0]) > HELD_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["key", "n"])
                        held = []
        if held or fresh:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["key", "n"])

    return found.select("pairs").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _best(keys: np.ndarray, n: np.ndarray, n_b: int) -> np.ndarray:
    """Whether a pair's count is the highest of its A id; keys in order."""
    a = keys // n_b
    head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return n == np.repeat(np.maximum.reduceat(n, head), np.diff(np.append(head, len(a))))


def _looked_up(found: DataFrame, counts: DataFrame, n_b: int) -> DataFrame:
    """n_best, count_sum by broadcast counts."""
    table = counts.toArrow()
    keys, n = (table.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    held = found.sparkSession.sparkContext.broadcast((keys, n, _best(keys, n, n_b) if len(keys) else np.zeros(0, bool)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, n, best = held.value
        for batch in batches:
            pairs, times = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pairs", "times"))
            lens = np.array([len(x) // 8 for x in pairs])
            at = np.searchsorted(keys, np.frombuffer(b"".join(pairs), "<i8"))
            often, ends = np.frombuffer(b"".join(times), "<i8"), np.concatenate([[0], np.cumsum(lens)])
            sums = [np.concatenate([[0], np.cumsum(often * x[at])]) for x in (best, n)]
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("pairs", "times")]
            kept_names = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)], names=[*kept_names, "n_best", "count_sum"])

    kept = ", ".join(f"{c} {t}" for c, t in found.dtypes if c not in ("pairs", "times"))
    return found.mapInArrow(run, f"{kept}, n_best long, count_sum long")


def _joined(found: DataFrame, counts: DataFrame, n_b: int) -> DataFrame:
    """n_best, count_sum by a join of all links with the counts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, row in enumerate(batch.column(0).to_pylist()):
                keys, times = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in (1, 2))
                for at in range(0, len(keys), 100_000):
                    part = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row)), pa.array(part), pa.array(times[at : at + 100_000])], names=["row", "key", "times"])

    a = F.floor(F.col("key") / n_b)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    known = written(counts.withColumn("a", a).join(top, "a").select("key", "n", (F.col("n") == F.col("top")).alias("best")), "known")
    links = found.select("row", "pairs", "times").mapInArrow(run, "row long, key long, times long").join(known, "key")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return found.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def linked(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: bool = False, lookup_pairs: int = LOOKUP_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups). n_best: links whose pair is in as many documents as any pair of its A id; count_sum: documents of a link's pair, summed over links."""
    a, b = default_tokenizers()
    a, b = path_a or a, path_b or b
    found = written(aligned(docs, a, b, groups), "aligned")
    counts = written(pair_counts(found), "pair-counts")
    n_b = pieces_in(b)
    if counts.count() <= lookup_pairs:
        out = _looked_up(found, counts, n_b)
        discard(counts)
    else:
        out = _joined(found, counts, n_b)
    return out.select("doc_id", *_SIZES, "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []))
