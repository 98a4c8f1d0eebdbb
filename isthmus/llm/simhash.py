"""SimHash fingerprints and a self-join of their binary trie.

A fingerprint bit is 1 if it is set in over half of the XXH64 values of a text's
word shingles. The join works on distinct fingerprints. Their bits are dealt into one block more than the budget
has bits, and a trie is made for each block, with its bits first: values within the budget agree in a block, so they meet in
one subtrie below its first bits. A subtrie is one unit of work. It
is walked together with itself, a level at a time, over sorted arrays: node
pairs add up the bits that differ and die when they exceed the budget. Each unit
returns a spanning forest of its links, never all pairs of a dense group, and the
forests are merged into components by rounds of large and small stars.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, fresh, hashed, mixed, prepared, released, texts_of, written

SEED, BUDGET = 42, 2
#: Fingerprints in one subtrie, on average.
SUBTRIE = 2048

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Unsigned XXH64 of each piece buf[start:end]: pieces under 32 bytes in numpy, a lane at a time; longer ones one by one. The buffer needs 8 spare bytes."""
    lens = ends - starts
    out = np.empty(len(lens), dtype=np.uint64)
    long = np.flatnonzero(lens >= 32)
    if len(long):
        import xxhash

        raw = buf.tobytes()
        out[long] = [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    words = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    for n in np.unique(lens[lens < 32]).tolist():
        at = np.flatnonzero(lens == n)
        p = starts[at]
        acc = np.full(len(at), np.uint64((seed + int(_P5) + n) & 0xFFFFFFFFFFFFFFFF))
        off = 0
        while off + 8 <= n:
            acc = _rotl(acc ^ (_rotl(words[p + off] * _P2, 31) * _P1), 27) * _P1 + _P4
            off += 8
        if off + 4 <= n:
            acc = _rotl(acc ^ ((words[p + off] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            off += 4
        while off < n:
            acc = _rotl(acc ^ (buf[p + off].astype(np.uint64) * _P5), 11) * _P1
            off += 1
        acc = (acc ^ (acc >> np.uint64(33))) * _P2
        acc = (acc ^ (acc >> np.uint64(29))) * _P3
        out[at] = acc ^ (acc >> np.uint64(32))
    return out


def shingle_spans(spans_per_doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the shingles of consecutive documents, and how many each has; fewer words than width make one shingle."""
    counts = np.where(spans_per_doc >= width, spans_per_doc - width + 1, np.minimum(spans_per_doc, 1))
    first = np.concatenate([[0], np.cumsum(spans_per_doc)])[:-1]
    doc = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    word = first[doc] + within
    return starts[word], ends[np.minimum(word + width - 1, (first + spans_per_doc)[doc] - 1)], counts


#: For each byte, its bits as the eight bytes of a word.
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8")[:, 0]).astype(np.uint64)


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] values, the bits set in over half of them; 0 for an empty run."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    # Up to 255 values are added with eight counters to a word, then these sums as numbers.
    n = counts[some].astype(np.int64)
    parts = -(-n // 255)
    run = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = (np.cumsum(n) - n)[run] + 255 * k
    sums = np.zeros((len(n), 64), dtype=np.int64)
    at = 0
    while at < len(cuts):
        to = min(len(cuts), at + 4096)
        a, b = cuts[at], cuts[to] if to < len(cuts) else len(h)
        words = _SPREAD[h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)]
        part = np.add.reduceat(words, cuts[at:to] - a, axis=0).astype("<u8").view(np.uint8).reshape(to - at, 64)
        first = np.flatnonzero(np.concatenate([[True], run[at + 1 : to] != run[at : to - 1]]))
        sums[run[at:to][first]] += np.add.reduceat(part, first, axis=0, dtype=np.int64)
        at = to
    out[some] = np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_batch(texts: list[bytes], width: int, seed: int = SEED) -> np.ndarray:
    """Fingerprints of whole texts."""
    split = [t.translate(LOWER).split() for t in texts]
    n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = list(itertools.chain.from_iterable(split))
    buf = np.frombuffer(b" ".join(flat) + b" " * 16, dtype=np.uint8)
    lens = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    ends = np.cumsum(lens + 1) - 1
    a, b, counts = shingle_spans(n_words, ends - lens, ends, width)
    return majority(xxh64(buf, a, b, seed), counts)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row of docs; a null or blank text has fingerprint 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = fingerprint_batch(texts_of(batch.column(1)), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        released()

    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def labelled(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Component label (its least member) of each of n nodes, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while not (label[label] == label).all():
            label = label[label]


#: Node pairs walked at once, and pairs of leaves compared without going further down.
FRONTIER, LEAVES = 20_000, 16


def trie_links(a: np.ndarray, b: np.ndarray, budget: int, same: bool, bits: int = 64, roots: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) of sorted 64-bit values that differ in at most `budget` bits; bits: how many low bits the subtries span. same: a is b, and each pair comes once. roots: bounds of the subtries of a to be walked each with itself, instead of the whole."""
    if roots is not None:
        whole = (roots[:-1], roots[1:], roots[:-1], roots[1:], np.zeros(len(roots) - 1, dtype=np.int64))
    else:
        whole = tuple(np.array([x]) for x in (0, len(a), 0, len(b), 0))
    stack = [(bits - 1, whole)] if len(a) and len(b) else []
    while stack:
        bit, (a0, a1, b0, b1, used) = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(bit, tuple(x[:half] for x in (a0, a1, b0, b1, used))), (bit, tuple(x[half:] for x in (a0, a1, b0, b1, used)))]
            continue
        small = (a1 - a0) * (b1 - b0) <= LEAVES if bit >= 0 else np.ones(len(a0), bool)
        if small.any():
            na, nb = (a1 - a0)[small], (b1 - b0)[small]
            n = na * nb
            at = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            i, j = a0[small][at] + k // nb[at], b0[small][at] + k % nb[at]
            ok = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                ok &= i < j
            if ok.any():
                yield i[ok], j[ok]
            a0, a1, b0, b1, used = (x[~small] for x in (a0, a1, b0, b1, used))
        if not len(a0):
            continue
        low = np.uint64(bit)
        am = np.clip(np.searchsorted(a, ((a[a0] >> low) | np.uint64(1)) << low), a0, a1)
        bm = np.clip(np.searchsorted(b, ((b[b0] >> low) | np.uint64(1)) << low), b0, b1)
        # zero-zero, one-one, zero-one, one-zero
        nxt = [np.concatenate(x) for x in ((a0, am, a0, am), (am, a1, am, a1), (b0, bm, bm, b0), (bm, b1, b1, bm), (used, used, used + 1, used + 1))]
        alive = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget)
        if same:
            alive &= nxt[0] < nxt[3]  # the pair of a later with an earlier node has been walked as its mirror image
        if alive.any():
            stack.append((bit - 1, tuple(x[alive] for x in nxt)))


def forest(a: np.ndarray, b: np.ndarray, budget: int, same: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The links between two subtries as (value, least value linked to it), one for each value that has a lesser."""
    both = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    label = np.arange(len(both))
    for i, j in trie_links(a, b, budget, same, bits):
        x, y = label[i], label[j + shift]
        u, back = np.unique(np.concatenate([x, y]), return_inverse=True)
        low = u[labelled(back[: len(x)], back[len(x) :], len(u))]
        move = np.arange(len(both))
        move[u] = low
        label = move[label]
    child = np.flatnonzero(label != np.arange(len(label)))
    return both[child], both[label[child]]


def blocks_of(order: list[int], budget: int) -> list[list[int]]:
    """Orders of the bits, each led by another block of them. Two values that differ in at most `budget` bits agree in all bits of one block at least, as there are more blocks than such bits."""
    dealt = [order[i :: budget + 1] for i in range(budget + 1)]  # each with its share of the most even bits, these first
    return [block + [b for other in dealt if other is not block for b in other] for block in dealt]


def links(values: DataFrame, budget: int = BUDGET, subtrie: int = SUBTRIE) -> DataFrame:
    """u, v: links that connect whatever is connected at `budget` differing bits. values: distinct longs in column fp.

    One trie for each order of blocks_of(); the first bits of the leading block name a subtrie, which is joined with itself. A value
    goes to budget + 1 subtries, at any size.
    """
    row = values.agg(F.count("*").alias("n"), *(F.sum(F.shiftright("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64))).first()
    n = row["n"]
    orders = blocks_of(sorted(range(64), key=lambda i: (abs(2 * (row[f"b{i}"] or 0) - n), -i)), budget)  # the most even bits first
    depth = 0
    while n >> depth > subtrie and depth < 64 // (budget + 1):
        depth += 1

    def turned(values: np.ndarray, order: list[int]) -> np.ndarray:
        out = np.zeros_like(values)
        for i in order:
            out = (out << np.uint64(1)) | ((values >> np.uint64(i)) & np.uint64(1))
        return out

    def spread(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, order in enumerate(orders):
                p = turned(fp, order)
                own = (p >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(p), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), t << 40) | own), pa.array(p.view(np.int64))], names=["unit", "p"])

    def unit(key, table):
        import pyarrow as pa

        a = np.sort(np.ascontiguousarray(table.column("p").to_numpy()).view(np.uint64))
        back = [0] * 64  # places of the bits in p
        for k, i in enumerate(orders[key[0].as_py() >> 40]):
            back[i] = 63 - k
        u, v = forest(a, a, budget, True, 64 - depth)
        return pa.table({"u": turned(u, back[::-1]).view(np.int64), "v": turned(v, back[::-1]).view(np.int64)})

    return values.select("fp").mapInArrow(spread, "unit long, p long").groupBy("unit").applyInArrow(unit, "u long, v long")


#: 64-bit words of a long signature; seeds of their hashes are derived from the first. With 1,024 bits the similarity is known to 0.03.
WORDS = 16
SIGNATURE = [f"s{i}" for i in range(WORDS)]
#: Share of the pairs at exactly the wanted similarity that some trie brings together.
RECALL = 0.97
#: Values that share a subtrie of a permuted trie, on average, and values in a unit of work, at any size: neighbouring subtries of one trie.
SHARED, UNIT = 64, 1 << 15

def long_signatures(docs: DataFrame, width: int, seed: int = SEED) -> DataFrame:
    """doc_id, th (hash of the text), s0 .. s15 (a 1,024-bit SimHash) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            s = signature_batch(texts_of(batch.column(2)), width, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(np.ascontiguousarray(s[:, i]).view(np.int64)) for i in range(WORDS))], names=["doc_id", "th", *SIGNATURE])
        released()

    prepared(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id long, th long, " + ", ".join(f"{c} long" for c in SIGNATURE))


def shingle_sets(texts: list[bytes], width: int, seed: int = SEED) -> list[np.ndarray]:
    """The hashes of each text's distinct shingles, sorted."""
    split = [t.translate(LOWER).split() for t in texts]
    n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = list(itertools.chain.from_iterable(split))
    buf = np.frombuffer(b" ".join(flat) + b" " * 16, dtype=np.uint8)
    lens = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    ends = np.cumsum(lens + 1) - 1
    # Hashes of shingles from hashes of their words: the words need hashing once only.
    word = hashed(buf, ends - lens, ends, seed)
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    _, _, counts = shingle_spans(n_words, ends - lens, ends, width)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = (first + n_words)[doc]
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        there = at + k < last
        h[there] = mixed(h[there] * np.uint64(0x9E3779B97F4A7C15) + word[(at + k)[there]])
    return [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])] if texts else []


def signature_batch(texts: list[bytes], width: int, seed: int = SEED) -> np.ndarray:
    """A row of WORDS 64-bit words for each text, in which each distinct shingle counts once."""
    sets = shingle_sets(texts, width, seed)
    counts = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    h = np.concatenate([np.zeros(0, np.uint64), *sets])
    return np.stack([majority(mixed(h + np.uint64((i + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)), counts) for i in range(WORDS)], axis=1)


def bit_share(similarity: float) -> float:
    """Share of SimHash bits in which shingle sets of a Jaccard similarity differ, as expected."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def prefix_bits(n: int) -> tuple[int, int]:
    """How many first bits of a permuted trie name a subtrie of n values, and how many of them a unit of work, so that a unit has from UNIT / 2 to UNIT values on average, or all if there are fewer."""
    return max(0, math.ceil(math.log2(max(n, 1) / SHARED))), max(0, math.ceil(math.log2(max(n, 1) / UNIT)))


def permuted_pairs(classes: DataFrame, n: int, similarity: float, nearest: bool, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """u, v: candidate pairs of signatures (columns node, s0 .. s15, label) of different labels whose long signatures differ in no more bits than the similarity makes them differ on average, two deviations added (98 % of the pairs at exactly that similarity). nearest: of each signature's pairs with those before it in a unit, only the one with the fewest differing bits.

    Each of several tries orders 64 of the 1,024 bits anew; subtries below the
    first m bits are joined with themselves under a budget, and what they find is held against the
    whole signatures. m follows the logarithm of n and the number of tries follows m, so that the
    share of pairs met stays at `recall` at any size. A unit of work is a trie and so many of its first
    bits as keep it at UNIT values on average.
    """
    p = bit_share(similarity)
    m, coarse = prefix_bits(n)
    met = (1 - p) ** m
    tries = 1 if met > recall else math.ceil(math.log(1 - recall) / math.log(1 - met))
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(64 * WORDS)[:64] for _ in range(tries)]
    allowed = lambda bits, deviations: math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))
    budget, most = allowed(64 - m, 3) if m < 64 else 0, allowed(64 * WORDS, 2)

    def spread(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            node = batch.column(0)
            words = [batch.column(i + 1).to_numpy().view(np.uint64) for i in range(WORDS)]
            for t, order in enumerate(orders):
                c = np.zeros(len(node), dtype=np.int64)
                for bit in order[:coarse].tolist():
                    c = c << 1 | ((words[bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), t << coarse) | c), *batch.columns], names=["unit", "node", *SIGNATURE, "label"])

    def unit(key, table):
        import pyarrow as pa

        order = orders[key[0].as_py() >> coarse]
        words = [np.ascontiguousarray(table.column(f"s{i}").to_numpy()).view(np.uint64) for i in range(WORDS)]
        p = np.zeros(table.num_rows, dtype=np.uint64)
        for bit in order.tolist():
            p = p << np.uint64(1) | ((words[bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1))
        by = np.argsort(p, kind="stable")
        p, words = p[by], [w[by] for w in words]
        node, label = (table.column(c).to_numpy()[by] for c in ("node", "label"))
        head = p >> np.uint64(64 - m) if m else np.zeros(len(p), np.uint64)
        roots = np.concatenate([[0], np.flatnonzero(head[1:] != head[:-1]) + 1, [len(p)]])
        least, mate = np.full(len(p), 64 * WORDS + 1), np.full(len(p), -1)
        u, v = [node[:0]], [node[:0]]
        for i, j in trie_links(p, p, budget, True, 64 - m, roots):
            far = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words)
            ok = (far <= most) & (label[i] != label[j])
            if nearest:
                ok &= far < least[j]
            i, j, far = i[ok], j[ok], far[ok]
            if nearest:
                down = np.argsort(-far, kind="stable")  # the nearest is written last
                least[j[down]], mate[j[down]] = far[down], i[down]
            else:
                u.append(node[i])
                v.append(node[j])
        if nearest:
            some = np.flatnonzero(mate >= 0)
            u, v = [node[mate[some]]], [node[some]]
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    signed = classes.select("node", *SIGNATURE, "label")
    kinds = ", ".join(f"{c} long" for c in ["unit", "node", *SIGNATURE, "label"])
    return signed.mapInArrow(spread, kinds).groupBy("unit").applyInArrow(unit, "u long, v long").distinct()


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, similarity: float, seed: int = SEED) -> DataFrame:
    """The pairs (u, v) of classes (columns node, f: a document of it) whose sets of shingles have the Jaccard similarity at least."""
    pairs = written(pairs, "pairs")
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    of = classes.join(nodes, "node").select("node", F.col("f.doc_id").alias("own_id"), F.col("f.th").alias("own_th"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    texts = texts.join(of, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th"))).select("node", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = shingle_sets(texts_of(batch.column(1)), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"])
        released()

    # Rows of equal id and text bring their set twice.
    sets = written(texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")
    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v")
    common = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("total"))
    out = written(common.where(F.col("common") >= F.lit(similarity) * (F.col("total") - F.col("common"))).select("u", "v"), "links")
    discard(pairs, sets)
    return out


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = SEED) -> DataFrame:
    """doc_id, th (hash of the text), label (names the group), component_id of every row of docs: near duplicates by word shingles at a Jaccard similarity. SimHash finds the candidates, and what links is held against the sets of shingles.

    First each signature's nearest candidates are held against it; of the other candidates only
    pairs that are not connected by then, so that a dense group does not bring all its pairs.
    Nulls, blanks, repeated ids and empty tables fare as in near_duplicates(); all
    texts without words are one group.
    """
    sig = written(long_signatures(docs, width, seed), "signatures")
    words = SIGNATURE
    classes = written(sig.groupBy(*words).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("f")).withColumn("node", F.xxhash64(*words)).withColumn("least", F.col("f.doc_id")), "classes")
    n = classes.count()
    near = verified(docs, classes, permuted_pairs(classes.withColumn("label", F.col("node")), n, similarity, True, seed=seed), width, similarity, seed)
    met = classes.join(components(near), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = verified(docs, classes, permuted_pairs(met, n, similarity, False, seed=seed), width, similarity, seed)
    label = components(near.unionByName(rest))
    of = classes.withColumnRenamed("node", "own").join(label, F.col("own") == F.col("node"), "left").select(*words, "least", F.coalesce("label", "own").alias("label"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = of.join(least, "label").select(*words, "label", "component_id")
    return sig.join(of, words).select("doc_id", "th", "label", "component_id")


def representatives(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of similar(): the one with the least doc_id (null last), then the least hash of its text."""
    groups = written(similar(docs, width, similarity), "groups")
    own, mark = fresh("keep_id", docs.columns), fresh("keep_th", docs.columns)
    first = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("f")).select(F.col("f.doc_id").alias(own), F.col("f.th").alias(mark))
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = docs.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (th == F.col(mark)), "left_semi")
    again = groups.groupBy("doc_id", "th").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """node, label (the least node reachable) of every node of edges(u, v), by alternating large and small stars until nothing moves."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, old = written(small, name), edges
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u"), F.count_if(F.col("v").isNull())).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id of every row of docs.

    component_id is the least doc_id reachable over links of at most `budget`
    differing bits, the row's own included. Null and blank texts have fingerprint
    0, linked like any other. Rows with equal doc_id each get a row; a null doc_id is kept and never
    a component's id unless the component has no other. An empty table
    gives no rows. Columns besides doc_id and text are ignored.
    """
    fps = written(fingerprints(docs, width, seed), "fingerprints")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    label = components(links(reps, budget))
    of = reps.join(label, reps.fp == label.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = of.join(least, "label").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")
