"""Exact substring dedup over bytes by merging Burrows-Wheeler transforms.

1. Every window of `window` bytes is represented by the least hash of the grams in
   it. Only windows whose gram hash occurs elsewhere, or twice within one window, can repeat;
   the rest leaves. Consecutive windows with one gram hash are a segment, and all segments of a
   gram hash, from the whole corpus, meet.
2. Of equal segments all but the first in the corpus are copies as a whole.
3. The distinct segments of a group of gram hashes are dealt into shards. A shard's
   suffixes are sorted once, over symbols of STEP bytes (a window is a whole
   number of symbols, and every byte starts a chain of symbols), which gives its Burrows-Wheeler transform.
   Shards merge in pairs by refining an interleaving: each round sorts the interleaved
   transforms by symbol, stably, and so orders suffixes by one symbol more,
   until nothing moves. Where rounds split neighbours gives the common prefixes. Suffixes that share a
   window's symbols are a repeated interval; all but the first window in it are copies.
   Gram hashes with more segments than a task should take have their windows compared by 128 bits of digest instead.
4. Copies become spans of their documents, which are cut out.

The order of the corpus is doc_id, then hash of the text, then position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, doubled, lanes, prepared, released, texts_of, written
from .imatch import chunks
from .recompress import keyed, several, squeezed

WINDOW, STEP = 100, 50
GRAM = 24
#: Windows in a segment at most; a longer stretch with one gram hash makes several.
SEGMENT = 256
#: UTF-8 bytes worked on at once (in the cache), and bytes of distinct segments in a group.
CHUNK, GROUP_BYTES = 1 << 17, 2 << 20
#: Distinct segments of a gram hash that one task takes; beyond, their windows are compared one by one, by a sum that Spark may split.
HOT = 20_000
#: Suffixes that are merged at once, where gram hashes allow (16-bit symbols), and shards they are dealt into.
SMALL, SHARDS = 48_000, 4
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def least_grams(buf: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, the least hash of the grams in the window that starts there (the buffer has 16 spare bytes at least); and the bytes whose own gram is their window's least and occurs in it again.

    If two equal windows overlap by a gram at least, and all windows between have one
    least hash, such a byte lies between them: the text there has their distance as a period.
    """
    n = len(buf) - 8
    if gram == GRAM:
        x = lanes(buf)
        m = len(x) - 16
        h = x[:m] * _C1 + (x[8 : m + 8] ^ np.uint64(0x5BD1E995)) * _C2 + (x[16 : m + 16] ^ np.uint64(0x1B873593)) * _C3
    else:
        h = doubled(buf[:n].astype(np.uint64) + np.uint64(1), gram)
    h ^= h >> np.uint64(32)
    h *= _C1
    h ^= h >> np.uint64(29)
    k, width, own = window - gram + 1, 1, h
    if k == 1:
        return h, np.zeros(0, np.int64)
    while 2 * width < k:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    least = np.minimum(h[: len(h) - (k - width)], h[k - width :])
    lead = np.flatnonzero(own[: len(least)] == least)
    return least, lead[np.minimum(h[lead + 1], h[lead + k - width]) == own[lead]]


def joined_wide(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(texts) + b" " * 160, dtype=np.uint8)
    return buf, np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))])


class Grams:
    """A few documents: the gram hash of each window, and each document's distinct ones."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        self.buf, self.offsets = joined_wide(texts)
        self.window = window
        self.least, self.again = least_grams(self.buf, window, gram)

    def of(self, i: int) -> np.ndarray:
        a, b = self.offsets[i], self.offsets[i + 1] - 1
        return self.least[a : max(a, b - self.window + 1)]

    def runs(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs of equal gram hashes over the windows of document i: first window, length, and which of the distinct hashes; and the distinct hashes, and how many runs each has."""
        h = self.of(i)
        if not len(h):
            none = np.zeros(0, np.int64)
            return none, none, none, h, none
        head = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        name, of, count = np.unique(h[head], return_inverse=True, return_counts=True)
        return head, np.diff(np.append(head, len(h))), of, name, count

    def twice(self, i: int, head: np.ndarray) -> np.ndarray:
        """Which of the runs of document i, given by their first windows, have their gram twice within a window."""
        a, b = self.offsets[i], self.offsets[i + 1] - 1
        lo, hi = np.searchsorted(self.again, [a, max(a, b - self.window + 1)])
        out = np.zeros(len(head), dtype=bool)
        out[np.searchsorted(head, self.again[lo:hi] - a, side="right") - 1] = True
        return out


def segments(head: np.ndarray, n: np.ndarray, of: np.ndarray, twice: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, hash index and twice() of the segments whose distinct hash is wanted (a mask)."""
    good = wanted[of]
    head, n, of, twice = head[good], n[good], of[good], twice[good]
    parts = -(-n // SEGMENT)
    if (parts == 1).all():
        return head, n, of, twice
    at = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    return head[at] + k * SEGMENT, np.minimum(SEGMENT, n[at] - k * SEGMENT), of[at], twice[at]


class Transform:
    """A Burrows-Wheeler transform of chains of symbols: for sorted suffixes, the symbol before (0: none), and where they start. The first `ends` suffixes are the empty ones, in the order of the chains."""

    def __init__(self, before: np.ndarray, place: np.ndarray, ends: int):
        self.before, self.place, self.ends = before, place, ends

    @classmethod
    def of(cls, symbol: np.ndarray, following: np.ndarray, previous: np.ndarray) -> Transform:
        """From the symbol at each place, and the index of the next and the previous place of its chain (-1: none)."""
        n = len(symbol)
        tails = np.flatnonzero(following < 0)
        # Equal suffixes stand in the order of their chains' ends, as the empty ones do.
        chain = np.zeros(n, dtype=np.uint16 if len(tails) < 65_000 else np.int64)
        at, k = tails, np.arange(len(tails))
        while len(at):
            chain[at] = k
            back = previous[at]
            at, k = back[back >= 0], k[back >= 0]
        keys, place = [], np.arange(n)
        while (place >= 0).any():
            keys.append(np.where(place >= 0, symbol[place], 0).astype(symbol.dtype))
            place = np.where(place >= 0, following[place], -1)
        # A pass for each symbol of the longest chain, the last one first.
        order = np.argsort(chain, kind="stable")
        for key in reversed(keys):
            order = order[np.argsort(key[order], kind="stable")]
        ahead = previous[order]
        before = np.where(ahead >= 0, symbol[ahead], 0)
        return cls(np.concatenate([symbol[tails], before]).astype(symbol.dtype), np.concatenate([np.full(len(tails), -1), order]), len(tails))


def merged(a: Transform, b: Transform) -> tuple[Transform, np.ndarray]:
    """The transform of both collections (places of b come after those of a as given), and for each suffix how many of its first symbols its predecessor shares.

    Rounds of refinement: after round r the interleaving is sorted by the first r symbols.
    """
    n = len(a.before) + len(b.before)
    top = np.concatenate([np.zeros(a.ends, dtype=bool), np.ones(b.ends, dtype=bool)])
    side = np.concatenate([np.zeros(len(a.before), dtype=bool), np.ones(len(b.before), dtype=bool)])
    group = np.zeros(n, dtype=np.int64)
    common = np.full(n, -1, dtype=np.int64)
    common[:1] = 0
    symbols, rounds = np.empty(n, dtype=np.promote_types(a.before.dtype, b.before.dtype)), 0
    while True:
        symbols[~side], symbols[side] = a.before, b.before
        real = np.flatnonzero(symbols)
        order = real[np.argsort(symbols[real], kind="stable")]
        new_side = np.concatenate([top, side[order]])
        c, g = symbols[order], group[order]
        split = np.zeros(n, dtype=bool)
        split[len(top) :] = True
        if len(order):
            split[len(top) + 1 :] = (c[1:] != c[:-1]) | (g[1:] != g[:-1])
        common[split & (common < 0)] = rounds
        new_group = np.cumsum(split)
        still = (new_side == side).all() and new_group[-1] == group[-1] if n else True
        side, group, rounds = new_side, new_group, rounds + 1
        if still and rounds > 1:
            break
    before, place = np.empty(n, dtype=symbols.dtype), np.empty(n, dtype=np.int64)
    before[~side], before[side] = a.before, b.before
    place[~side], place[side] = a.place, b.place
    common[common < 0] = rounds
    return Transform(before, place, a.ends + b.ends), common


def interval_copies(texts: list[bytes], windows: np.ndarray, key: list[np.ndarray], window: int, step: int) -> np.ndarray:
    """Which windows of some segments are copies, over all windows in order; key: arrays that order the segments' first windows (the last one advances by 1 with each window)."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    start = np.cumsum(lens) - lens
    buf = np.frombuffer(b"".join(texts) + b" " * 160, dtype=np.uint8)
    h = doubled(buf[: len(buf) - 8].astype(np.uint64) + np.uint64(1), step)
    # Places: bytes at which a whole symbol starts; a chain goes on `step` bytes further.
    n = lens - step + 1
    seg = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    name = np.unique(h[start[seg] + off], return_inverse=True)[1] + 1
    name = name.astype(np.uint16 if len(name) < 65_000 else np.int64)
    # Shards are runs of segments; each is sorted by itself.
    bounds = np.unique(np.linspace(0, len(n), min(SHARDS, len(n)) + 1).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    parts = []
    for a, b in zip(first[bounds[:-1]], first[bounds[1:]], strict=True):
        here = np.arange(b - a)
        following = np.where(off[a:b] + step < n[seg[a:b]], here + step, -1)
        previous = np.where(off[a:b] >= step, here - step, -1)
        t = Transform.of(name[a:b], following, previous)
        t.place = np.where(t.place >= 0, t.place + a, -1)
        parts.append(t)
    if len(parts) == 1:
        parts.append(Transform(parts[0].before[:0], parts[0].place[:0], 0))
    while len(parts) > 1:
        pairs = [merged(parts[i], parts[i + 1]) if i + 1 < len(parts) else (parts[i], None) for i in range(0, len(parts), 2)]
        parts, common = [p for p, _ in pairs], pairs[0][1]
    place = parts[0].place
    # Intervals of suffixes that share a whole window.
    interval = np.cumsum(common < window // step)
    some = place >= 0
    place, interval = place[some], interval[some]
    whole = off[place] < windows[seg[place]]
    place, interval = place[whole], interval[whole]
    s = seg[place]
    order = np.lexsort((key[-1][s] + off[place], *(k[s] for k in reversed(key[:-1])), interval))
    place, interval = place[order], interval[order]
    later = np.zeros(len(place), dtype=bool)
    later[1:] = interval[1:] == interval[:-1]
    out = np.zeros(int(windows.sum()), dtype=bool)
    at = (np.cumsum(windows) - windows)[seg[place]] + off[place]
    out[at] = later
    return out


def removed(docs: DataFrame, window: int = WINDOW, step: int = STEP, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of docs.

    A byte goes if a string of `window` bytes that covers it also starts earlier in the corpus, overlaps
    included; all is judged on the input and no match crosses documents. A null text
    is empty; a null doc_id is greater than any other; rows that share a doc_id follow each
    other by the hash of their texts, and equal rows are one document. An empty table
    gives no rows; columns besides doc_id and text are ignored.
    """
    assert window % step == 0 and gram <= window
    prepared(docs.sparkSession)
    docs = keyed(docs)
    ids = written(docs.select("o", "tag", "tag2"), "ids")
    order = F.struct("o", "tag")
    copies = ids.groupBy("tag", "tag2").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last")
    copies = ids.join(copies, ["tag", "tag2"]).where(order > F.col("first")).select("o", "tag", F.lit(True).alias("copy")).distinct()

    def name_rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = texts_of(batch.column(1))
            o, tag = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for s, e in chunks(texts, 1 << 20):
                found, n = [], []
                for a, b in chunks(texts[s:e], CHUNK):
                    g = Grams(texts[s + a : s + b], window, gram)
                    found += [g.runs(i)[3] for i in range(b - a)]
                n = [len(x) for x in found]
                at = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(o[s:e], n)), pa.array(np.repeat(tag[s:e], n)), pa.array(at)], names=["name", "o", "tag", "i"])
        released()

    names = written(docs.select("o", "text", "tag").mapInArrow(name_rows, "name long, o long, tag long, i int"), "grams")
    elsewhere = several(names, ["name"], F.xxhash64("o", "tag")).select("o", "tag", "i")
    shared = elsewhere.groupBy("o", "tag").agg(F.collect_set("i").alias("shared"))

    def segment_rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        import zstandard

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            z = zstandard.ZstdDecompressor()
            texts = [z.decompress(x) for x in batch.column(2).to_pylist()]
            o, tag, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            cols: list[list] = [[] for _ in range(6)]
            digests: list[bytes] = []
            for s, e in chunks(texts, CHUNK):
                g = Grams(texts[s:e], window, gram)
                for i in range(e - s):
                    head, n, of, name, count = g.runs(i)
                    # Gram hashes of other documents, and those the document itself has in several places.
                    wanted = count > 1
                    twice = g.twice(i, head)
                    wanted[of[(n > window - gram + 1) | twice]] = True
                    if lists[s + i]:
                        wanted[lists[s + i]] = True
                    if not wanted.any():
                        continue
                    p, n, of, twice = segments(head, n, of, twice, wanted)
                    text = texts[s + i]
                    digests += [digest(text[a:b]) for a, b in zip(p.tolist(), (p + n + window - 1).tolist(), strict=True)]
                    for col, v in zip(cols, (name[of].view(np.int64), np.full(len(p), o[s + i]), np.full(len(p), tag[s + i]), p, n, twice), strict=True):
                        col.append(v)
            if digests:
                d = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                name_, o_, tag_, p_, n_, twice_ = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name_, d[:, 0].copy(), d[:, 1].copy(), o_, tag_, p_.astype(np.int32), n_.astype(np.int32), twice_)], names=["name", "d1", "d2", "o", "tag", "p", "n", "twice"])
        released()

    left = squeezed(docs, ["o", "tag"]).join(shared, ["o", "tag"], "left").join(copies, ["o", "tag"], "left_anti").select("o", "tag", "z", "shared")
    pieces = written(left.mapInArrow(segment_rows, "name long, d1 long, d2 long, o long, tag long, p int, n int, twice boolean"), "segments")
    discard(names)
    # Of equal segments the earliest goes on; the others are copies as a whole.
    at = F.struct("o", "tag", "p")
    firsts = written(pieces.groupBy("d1", "d2").agg(F.min(at).alias("f"), F.count("*").alias("c"), F.first("name").alias("name"), F.first("n").alias("n"), F.max("twice").alias("twice")), "firsts")
    equal = pieces.select("d1", "d2", "o", "tag", "p", "n").join(firsts.where("c > 1").select("d1", "d2", "f"), ["d1", "d2"]).where(at > F.col("f"))
    equal = written(equal.select("o", "tag", "p", "n"), "equal")
    discard(pieces)
    # Gram hashes with one distinct segment that holds its gram at one place have nothing left to find.
    busy = firsts.groupBy("name").agg(F.count("*").alias("k"), F.max("n").alias("m"), F.max("twice").alias("t")).where((F.col("k") > 1) | (F.col("m") > window - gram + 1) | F.col("t")).select("name", (F.col("k") > hot).alias("hot"))
    alone = written(firsts.join(busy, "name").select("name", "f.*", "n", "hot"), "distinct")
    size = alone.where("not hot").agg(F.sum(F.col("n") + window)).first()[0] or 0
    groups = max(1, -(-int(size) // GROUP_BYTES))

    def wanted(rows: DataFrame) -> DataFrame:
        """The rows' segments with their documents' texts."""
        lists = rows.groupBy("o", "tag").agg(F.collect_list(F.struct("name", "p", "n")).alias("wanted"))
        return squeezed(docs, ["o", "tag"]).join(lists, ["o", "tag"]).select("o", "tag", "z", "wanted")

    discard(firsts)

    def cut_pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        for batch in batches:
            z = zstandard.ZstdDecompressor()
            rows: list[list] = [[] for _ in range(6)]
            for o, tag, raw, want in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = z.decompress(raw)
                for w in want:
                    for col, v in zip(rows, (w["name"], o, tag, w["p"], w["n"], text[w["p"] : w["p"] + w["n"] + window - 1]), strict=True):
                        col.append(v)
            kinds = [pa.int64()] * 3 + [pa.int32(), pa.int32(), pa.binary()]
            for i in range(0, len(rows[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], t) for c, t in zip(rows, kinds, strict=True)], names=["name", "o", "tag", "p", "n", "piece"])

    def hot_windows(batches: Iterator) -> Iterator:
        """Two halves of the digest of each window, and where it is."""
        import pyarrow as pa
        import xxhash
        import zstandard

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            z = zstandard.ZstdDecompressor()
            for o, tag, raw, want in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = z.decompress(raw)
                at = np.unique(np.concatenate([np.arange(w["p"], w["p"] + w["n"]) for w in want]))
                d = np.frombuffer(b"".join([digest(text[a : a + window]) for a in at.tolist()]), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[:, 0].copy(), d[:, 1].copy(), np.full(len(at), o), np.full(len(at), tag), at.astype(np.int32))], names=["d1", "d2", "o", "tag", "p"])

    alone_bytes = wanted(alone.where("not hot")).mapInArrow(cut_pieces, "name long, o long, tag long, p int, n int, piece binary").withColumn("g", F.pmod(F.xxhash64("name"), F.lit(groups)))

    def merge_group(key, table):
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in ("name", "o", "tag", "p")])
        same = np.ones(table.num_rows, dtype=bool)  # rows of equal id and text bring their segments twice
        same[1:] = ~np.logical_and.reduce([table.column(c).to_numpy()[1:] == table.column(c).to_numpy()[:-1] for c in ("name", "o", "tag", "p")])
        table = table.filter(pa.array(same))
        name, n = table.column("name").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        piece = table.column("piece").to_pylist()
        o, tag, p = (table.column(c).to_numpy().astype(np.int64) for c in ("o", "tag", "p"))
        cut = np.append(np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])), len(name))
        out: list[list] = [[], [], [], []]
        a = 0
        total = np.concatenate([[0], np.cumsum(n + window)])
        while a < len(name):
            # As many gram hashes as fit, one at least.
            ends = cut[cut > a]
            b = int(ends[max(0, np.searchsorted(total[ends], total[a] + SMALL, side="right") - 1)])
            later = interval_copies(piece[a:b], n[a:b], [o[a:b], tag[a:b], p[a:b]], window, step)
            base = np.cumsum(n[a:b]) - n[a:b]
            flags = np.concatenate([[0], later.view(np.int8), [0]])
            # Runs of copies, cut where segments end.
            up = np.zeros(len(later) + 1, dtype=bool)
            up[base] = True
            run = later & (~flags[:-2].astype(bool) | up[:-1])
            first = np.flatnonzero(run)
            if len(first):
                ids = np.cumsum(run)[later] - 1
                count = np.bincount(ids, minlength=len(first))
                s = np.searchsorted(base, first, side="right") - 1
                for col, v in zip(out, (o[a:b][s], tag[a:b][s], p[a:b][s] + first - base[s], count), strict=True):
                    col.append(v)
            a = b
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table({"o": cols[0], "tag": cols[1], "p": pa.array(cols[2].astype(np.int32)), "n": pa.array(cols[3].astype(np.int32))})

    found = alone_bytes.select("g", "name", "o", "tag", "p", "n", "piece").groupBy("g").applyInArrow(merge_group, "o long, tag long, p int, n int")
    if alone.where("hot").limit(1).count():
        windows = written(wanted(alone.where("hot")).mapInArrow(hot_windows, "d1 long, d2 long, o long, tag long, p int"), "windows")
        least = windows.groupBy("d1", "d2").agg(F.min(at).alias("f"), F.max(at).alias("most")).where("f < most").drop("most")
        found = found.unionByName(windows.join(least, ["d1", "d2"]).where(at > F.col("f")).select("o", "tag", "p", F.lit(1).alias("n")))
    runs = written(equal.unionByName(found).groupBy("o", "tag").agg(F.collect_list(F.struct("p", "n")).alias("runs")), "runs")
    discard(alone, equal)
    marks = runs.join(copies, ["o", "tag"], "full")

    def cut_out(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        for batch in batches:
            z = zstandard.ZstdDecompressor()
            rows: list[list] = [[] for _ in range(4)]
            for raw, runs, copy in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = z.decompress(raw)
                size, spans, kept = len(text), [], text
                if copy and size >= window:
                    spans = [(0, size)]
                elif runs and not copy:
                    for p, k in sorted((r["p"], r["n"]) for r in runs):
                        if spans and p <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], p + k + window - 1))
                        else:
                            spans.append((p, p + k + window - 1))
                if spans:
                    edges = [0, *(x for s in spans for x in s), size]
                    kept = b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
                for col, v in zip(rows, (size, size - len(kept), len(spans), kept), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    final = squeezed(docs, ["o", "tag", "doc_id"]).join(marks, ["o", "tag"], "left").select("doc_id", "z", "runs", "copy")
    return final.mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
