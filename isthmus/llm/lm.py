"""Language-model scoring: a causal self-attention model in numpy over subword ids, with counts of the whole corpus beside it.

A text's tokens are its words and one end. The model sees a token as a symbol: one of the
corpus's most frequent words, or else the word's first subword id. A layer
of causal self-attention over the last symbols yields weights of a few mixture components, each a
distribution over symbols; the word within its symbol follows from its count in the corpus, or from the
subwords it is spelled with where it has none. The unigram distribution of all counts has a fixed
share in every token's probability.

Data flow. Documents are dealt into blocks of about BLOCK_BYTES. Each block reports its distinct words with
their counts and subword ids; counts are added up by word and go back to the
blocks that asked, so nothing that grows with the corpus is ever broadcast. Training
takes every window of every text to learn from: a round has its share of the blocks, each of its tasks
goes through its texts from a common start, parameters are averaged by the tokens seen, and the
next round starts from the mean. Scoring takes a
block's texts together with the counts of its words: overlapping windows of
symbols, each token scored once, in batches of masked attention.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACED, crc_side, hashed, joined, prepared, released, texts_of, words_in, written
from .packing import WordIds, default_tokenizer

BLOCK_BYTES = 16 << 20
#: Symbols: the most frequent words, the most frequent first subwords, and one for any other word, the end, and the start.
WORDS, FIRSTS = 4096, 4096
OTHER, END, START = WORDS + FIRSTS, WORDS + FIRSTS + 1, WORDS + FIRSTS + 2
SYMBOLS = WORDS + FIRSTS + 3
WIDTH, COMPONENTS = 16, 16
#: Symbols a query sees at most, and tokens scored by one window: the others are context.
WINDOW, STRIDE = 32, 16
#: Steps that a task takes at least, windows in a step at most and (where there are few) at least, rounds.
STEPS, STEP_WINDOWS, FEW_WINDOWS, ROUNDS, RATE = 40, 1024, 64, 2, 0.04
#: Windows that a task holds and shuffles, those whose numbers stay in a core's cache, and parameters that do.
HELD_WINDOWS, IN_CACHE, ADAM_SLICE = 64 << 10, 32, 16 << 10
#: Share of the unigram distribution in a token's probability.
UNIGRAM = 0.1
#: Subwords told apart in spelling: the most frequent ones, one for any other, and the bound of a word.
SPELLING = 1024
REST, BOUND = SPELLING - 2, SPELLING - 1
CHUNKS = 32
#: Words whose ids are remembered while words of a bucket are coded, and bits of the slots for first subwords in training (18 bytes a slot).
CODED, SLOT_BITS = 150_000, 20


def softened(m: np.ndarray, most: float, least: float) -> None:
    """Exponentials of the last axis, in place, as far as only their ratios count. most: the largest value; least: no row's largest value lies below. Near zero no row needs its maximum taken off."""
    if most > 60 or least < -60:
        m -= m.max(axis=-1, keepdims=True)
    np.exp(m, out=m)


@functools.cache
def one_place(n: int) -> np.ndarray:
    return np.ones((1, n), np.float32)


@functools.lru_cache(maxsize=2)
def room(of: str, windows: int, places: int) -> np.ndarray:
    """Memory that steps of one size use again: pages new to a process cost more than what is written to them."""
    return np.empty((COMPONENTS if of == "y" else WIDTH, windows, places))


class Attention:
    """The parameters, by name, and the arithmetic on them."""

    SHAPES = {"e": (SYMBOLS, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "z": (WIDTH, COMPONENTS), "zb": (COMPONENTS,), "r": (WINDOW,), "b": (SYMBOLS, COMPONENTS)}

    def __init__(self, counts: np.ndarray | None = None, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {n: (rng.normal(0, 0.3, s) if n in "eqkvoz" else np.zeros(s)).astype(np.float32) for n, s in self.SHAPES.items()}
        n = np.ones(SYMBOLS) if counts is None else counts + 0.5
        self.p["b"] = (np.log(n / n.sum())[:, None] + rng.normal(0, 0.2, self.SHAPES["b"])).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.SHAPES])

    def load(self, flat: np.ndarray) -> Attention:
        at = 0
        for n, s in self.SHAPES.items():
            k = math.prod(s)
            self.p[n] = flat[at : at + k].reshape(s).astype(np.float32)
            at += k
        return self

    def table(self) -> np.ndarray:
        """P(symbol | component); the start is never a target."""
        b = self.p["b"]
        b = np.exp(b - b.max(axis=0))
        b[START] = 0
        return b / b.sum(axis=0, dtype=np.float64).astype(b.dtype)

    @staticmethod
    def _offsets(queries: int) -> tuple[np.ndarray, np.ndarray]:
        """How far each key lies behind each of the last `queries` places of a window, and which lie ahead."""
        d = np.arange(WINDOW - queries, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
        return np.maximum(d, 0), d < 0

    def prepare(self) -> None:
        p = self.p
        # A row for each symbol: what it is as a key, and as a query.
        self.seen = np.concatenate([p["e"] @ p["k"], p["e"] @ p["v"] @ p["o"]], axis=1)
        self.asking = np.concatenate([(p["e"] @ p["q"]) / np.float32(math.sqrt(WIDTH)), p["e"]], axis=1)
        self.dist = self.table()
        d, ahead = self._offsets(STRIDE)
        self.bias = np.where(ahead, np.float32(-1e9), p["r"][d]).astype(np.float32)

    def probabilities(self, inputs: np.ndarray, absent: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """P(target) for the last STRIDE places of windows of symbols; absent: places before the text."""
        n = len(inputs)
        key = self.seen.take(inputs.ravel(), axis=0).reshape(n, WINDOW, 2 * WIDTH)
        own = self.asking.take(inputs[:, WINDOW - STRIDE :].ravel(), axis=0).reshape(n, STRIDE, 2 * WIDTH)
        s = np.matmul(own[..., :WIDTH], key[..., :WIDTH].transpose(0, 2, 1))
        s += self.bias
        if absent.any():
            s += absent[:, None, :] * np.float32(-1e9)
        softened(s, s.max(), np.einsum("btt->bt", s[:, :, WINDOW - STRIDE :]).min())
        u = np.matmul(s, key[..., WIDTH:])
        u /= s @ np.ones((WINDOW, 1), np.float32)
        u += own[..., WIDTH:]
        u = np.tanh(u, out=u).reshape(-1, WIDTH)
        z = u @ self.p["z"]
        z += self.p["zb"]
        softened(z, z.max(), z.min())
        one = np.ones((COMPONENTS, 1), np.float32)
        total = z @ one
        z *= self.dist.take(targets.ravel(), axis=0)
        return ((z @ one) / total).reshape(n, STRIDE)

    def gradients(self, x_id: np.ndarray, y_id: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the predictions at all places of windows, and its gradients; weight 0 leaves a place out."""
        p, root, t = self.p, np.float32(1 / math.sqrt(WIDTH)), self.table()
        n = np.float32(max(float(weight.sum()), 1.0))
        d, ahead = self._offsets(WINDOW)
        bias = np.where(ahead, np.float32(-1e9), p["r"][d]).astype(np.float32)
        qkv = np.concatenate([p["q"] * root, p["k"], p["v"]], axis=1)
        out, back, mixed = np.ascontiguousarray(p["o"].T), np.ascontiguousarray(qkv.T), np.ascontiguousarray(p["z"].T)
        g = {name: np.zeros(self.SHAPES[name], np.float32) for name in ("o", "z", "zb")}
        grown, offsets, loss = np.zeros_like(qkv), np.zeros((WINDOW, WINDOW), np.float32), 0.0
        x_id, y_id = x_id.astype(np.int64), y_id.astype(np.int64)
        dty, dx = (room(m, *x_id.shape) for m in ("y", "x"))
        one_key, one_component = np.ones((WINDOW, 1), np.float32), np.ones((COMPONENTS, 1), np.float32)
        for i in range(0, len(x_id), IN_CACHE):
            # One row for each place, so that products with parameters are single ones; only keys and queries meet window by window.
            w = weight[i : i + IN_CACHE]
            k, shape = len(w), (len(w), WINDOW, WIDTH)
            x, ty = p["e"].take(x_id[i : i + IN_CACHE].ravel(), axis=0), t.take(y_id[i : i + IN_CACHE].ravel(), axis=0)
            parts = (x @ qkv).reshape(k, WINDOW, 3 * WIDTH)
            q, key, v = parts[..., :WIDTH], parts[..., WIDTH : 2 * WIDTH], parts[..., 2 * WIDTH :]
            a = np.matmul(q, key.transpose(0, 2, 1))
            a += bias
            if ((w[:, :-1] == 0) & (w[:, 1:] != 0)).any():  # at the end of a window such places lie ahead of all others
                a += (w == 0)[:, None, :] * np.float32(-1e9) * (np.eye(WINDOW, dtype=np.float32) == 0)
            # Every place sees itself.
            softened(a, a.max(), np.einsum("btt->bt", a).min())
            a /= a @ one_key
            o = np.matmul(a, v).reshape(-1, WIDTH)
            u = o @ p["o"]
            u += x
            np.tanh(u, out=u)
            mix = u @ p["z"]
            mix += p["zb"]
            softened(mix, mix.max(), mix.min())
            mix /= mix @ one_component
            ty *= mix
            prob = np.maximum(ty @ one_component, np.float32(1e-12))
            w = w.reshape(-1, 1)
            loss -= float((w * np.log(prob)).sum())
            dp = w / prob
            dp /= -n
            ty *= dp  # the gradient by the probability of each component, times it
            dy = mix * dp
            dty[:, i : i + IN_CACHE] = dy.T.reshape(COMPONENTS, k, WINDOW)
            mix *= ty @ one_component
            ty -= mix
            g["z"] += u.T @ ty
            g["zb"] += (one_place(len(ty)) @ ty)[0]
            pre = ty @ mixed
            u *= u
            np.subtract(np.float32(1), u, out=u)
            pre *= u
            g["o"] += o.T @ pre
            do = pre @ out
            dparts = np.empty_like(parts)
            do3 = do.reshape(shape)
            np.matmul(a.transpose(0, 2, 1), do3, out=dparts[..., 2 * WIDTH :])
            ds = np.matmul(do3, v.transpose(0, 2, 1))
            do *= o
            ds -= (do @ one_component).reshape(k, WINDOW, 1)  # the sum of a * ds over the keys
            ds *= a
            offsets += ds.sum(axis=0)
            np.matmul(ds, key, out=dparts[..., :WIDTH])
            np.matmul(ds.transpose(0, 2, 1), q, out=dparts[..., WIDTH : 2 * WIDTH])
            dparts = dparts.reshape(-1, 3 * WIDTH)
            grown += x.T @ dparts
            pre += dparts @ back
            dx[:, i : i + IN_CACHE] = pre.T.reshape(WIDTH, k, WINDOW)
        g["q"], g["k"], g["v"] = grown[:, :WIDTH] * root, grown[:, WIDTH : 2 * WIDTH], grown[:, 2 * WIDTH :]
        summed = lambda ids, m: np.stack([np.bincount(ids.ravel(), c.ravel(), minlength=SYMBOLS) for c in m], axis=1)
        dt = summed(y_id, dty)
        g["b"], g["e"] = t * (dt - (dt * t).sum(axis=0)), summed(x_id, dx)
        g["r"] = np.bincount(d[~ahead], offsets[~ahead], minlength=WINDOW)
        return loss / float(n), {name: m.astype(np.float32) for name, m in g.items()}

    def train(self, symbols: np.ndarray, texts: np.ndarray, steps: int = STEPS, seed: int = 0) -> float:
        """At least so many steps on all windows of a sequence of symbols; texts: number of the text at each place. Returns the last loss."""
        return Learning(self, seed).learn(*windows_of(symbols, texts), steps)


def windows_of(symbols: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of WINDOW + 1 symbols, each text cut from its start so that every place is to be predicted in one window, after the symbol before it (START before a text), and how many places a row has."""
    if not len(symbols):
        return np.zeros((0, WINDOW + 1), np.uint16), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, texts[1:] != texts[:-1]))
    lengths = np.diff(np.append(starts, len(symbols)))
    n = -(-lengths // WINDOW)
    within = WINDOW * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    at = np.repeat(starts, n) + within
    rows = symbols[np.clip(at[:, None] + np.arange(-1, WINDOW), 0, len(symbols) - 1)].astype(np.uint16)
    rows[within == 0, 0] = START
    return rows, np.minimum(np.repeat(lengths, n) - within, WINDOW)


class Learning:
    """Steps of Adam over windows, each of which is learnt from."""

    def __init__(self, net: Attention, seed: int = 0):
        self.net, self.rng, self.taken = net, np.random.default_rng(seed), 0
        # The net's parameters become views of one vector.
        self.flat = net.flat().astype(np.float32)
        self.m, self.v, self.g = (np.zeros_like(self.flat) for _ in range(3))
        at = 0
        for n, s in net.SHAPES.items():
            net.p[n] = self.flat[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)

    def learn(self, rows: np.ndarray, places: np.ndarray, least: int = 0) -> float:
        """Steps on all windows in a random order, once, and again until at least so many steps are taken in all. Few windows go in smaller steps. Returns the last loss."""
        loss, size = 0.0, min(STEP_WINDOWS, max(FEW_WINDOWS, len(rows) // STEPS))
        first = True
        while len(rows) and (first or self.taken < least):
            order = self.rng.permutation(len(rows))
            for part in np.array_split(order, -(-len(rows) // size)):
                loss = self.step(rows[part], places[part])
            first = False
        return loss

    def step(self, rows: np.ndarray, places: np.ndarray) -> float:
        self.taken += 1
        weight = (np.arange(WINDOW) < places[:, None]).astype(np.float32)
        loss, g = self.net.gradients(rows[:, :-1], rows[:, 1:], weight)
        np.concatenate([g[n].ravel() for n in self.net.SHAPES], out=self.g)
        one, two = 1 - 0.9**self.taken, 1 - 0.99**self.taken
        for i in range(0, len(self.flat), ADAM_SLICE):  # stays in a core's cache
            p, m, v, g = (x[i : i + ADAM_SLICE] for x in (self.flat, self.m, self.v, self.g))
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.01)
            v *= np.float32(0.99)
            v += g
            np.multiply(v, np.float32(1 / two), out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= np.float32(RATE / one)
            p -= g
        return loss


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of each word of lower-cased texts, which tell words apart together, first word of each text (one more than texts), and what is needed to cut words out."""
    low = [t.translate(LOWER) for t in texts]
    buf, offsets = joined(low)
    starts, ends, first = words_in(buf, offsets, SPACED)
    return hashed(buf, starts, ends, 3).view(np.int64), hashed(buf, starts, ends, 4).view(np.int64), first, buf, starts, ends


def told_apart(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct pairs in their order, and for each row which pair it has. Pairs mostly differ in h already."""
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    odd = h2 != h2[first[back]]
    if not odd.any():
        return first, back
    order = np.lexsort((h2, h))
    head = np.append(True, (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1]))
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(head) - 1
    return order[head], back


class Vocabulary:
    """What is known of the corpus in bounded tables: which word hashes and first subwords are symbols, counts and numbers of distinct words of the symbols, and how words are spelled."""

    def __init__(self, words: np.ndarray, firsts: np.ndarray, counts: np.ndarray, types: np.ndarray, sub: np.ndarray, total: float, distinct: int):
        order = np.argsort(words)
        self.words, self.word_symbol = words[order], order
        self.first_symbol = np.full(1 << 16, OTHER, dtype=np.int64)
        self.first_symbol[firsts] = WORDS + np.arange(len(firsts))
        self.counts, self.types, self.total, self.distinct = counts, types, total, distinct
        self.place = np.full(1 << 16, REST, dtype=np.int64)
        often = np.lexsort((np.arange(len(sub)), -sub))[:REST]
        self.place[often] = np.arange(len(often))
        rest = np.where(self.place == REST, sub + 0.5, 0)
        self.rest = np.where(self.place == REST, np.log10(np.maximum(rest, 0.5) / rest.sum()), 0.0)
        self.pairs(np.zeros((SPELLING, SPELLING)))

    def pairs(self, n: np.ndarray) -> None:
        """Takes counts of neighbouring subwords in distinct words."""
        one = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * SPELLING)
        kinds = (n > 0).sum(axis=1, keepdims=True) + 1.0
        self.next = np.log10((n + kinds * one) / (n.sum(axis=1, keepdims=True) + kinds)).astype(np.float32)

    def neighbours(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subword before and after each place between subwords of words, bounds included, and the number of places of each word; flat: the ids of all words, lens: how many each has."""
        n = lens + 1
        ends = np.cumsum(n)
        after = np.full(int(n.sum()), BOUND, dtype=np.int64)
        inner = np.ones(len(after), dtype=bool)
        inner[ends - 1] = False
        after[inner] = self.place[flat]
        before = np.concatenate([[BOUND], after[:-1]])
        return before, after, n

    def symbols(self, h: np.ndarray, first: np.ndarray | None) -> np.ndarray:
        """Symbols of words by hash and first subword; without first subwords, -1 for those that aren't symbols of their own."""
        at = np.minimum(np.searchsorted(self.words, h), max(len(self.words) - 1, 0))
        out = np.full(len(h), -1, dtype=np.int64) if first is None else self.first_symbol[first]
        if len(self.words):
            own = self.words[at] == h
            out[own] = self.word_symbol[at[own]]
        return out

    def within(self, symbol: np.ndarray, c: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(word | its symbol), and P(word) by spelling alone.

        Twice as many tokens as a symbol has distinct words go to spelling (about what is new among rare words).
        """
        if not len(lens):
            return np.zeros(0), np.zeros(0)
        before, after, n = self.neighbours(flat, lens)
        step = self.next[before, after].astype(np.float64)
        ends = np.cumsum(n)
        inner = np.ones(len(step), dtype=bool)
        inner[ends - 1] = False
        step[inner] += self.rest[flat]
        total = np.concatenate([[0.0], np.cumsum(step)])
        whole = total[ends] - total[ends - n]
        spelled = 10.0 ** np.where(symbol == OTHER, whole, whole - step[ends - n])
        kinds = 2 * self.types[symbol] + 1
        return np.where(symbol < WORDS, 1.0, (c + kinds * spelled) / (self.counts[symbol] + kinds)), 10.0**whole


class Lookup:
    """Places of pairs of 64-bit hashes in sorted arrays, by a table of the leading bits of the first one; every pair looked up must be there."""

    def __init__(self, known: np.ndarray, second: np.ndarray):
        self.known, self.second = known, second
        self.shift = np.uint64(64 - max(1, int(len(known)).bit_length()))
        self.start = np.searchsorted(known >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64))

    def __call__(self, h: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.start[(h >> self.shift).astype(np.int64)]
        left = np.flatnonzero((self.known[at] != h) | (self.second[at] != h2))
        while len(left):
            at[left] += 1
            left = left[(self.known[at[left]] != h[left]) | (self.second[at[left]] != h2[left])]
        return at


class Firsts:
    """First subword ids of words by their two hashes, kept by a worker process from batch to batch and task to task. A word's slot is where its hash leads; the last one there stays."""

    shared: dict[str, Firsts] = {}

    def __init__(self, tokenizer: str):
        self.coder = WordIds(tokenizer, None, CODED)
        self.h, self.h2, self.first = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS, np.uint16)

    @classmethod
    def of(cls, tokenizer: str) -> Firsts:
        if tokenizer not in cls.shared:
            cls.shared[tokenizer] = cls(tokenizer)
        return cls.shared[tokenizer]

    def __call__(self, h: np.ndarray, h2: np.ndarray, cut) -> np.ndarray:
        """The ids of words; cut gives the bytes of the words at some places of h."""
        at = (h.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out, new = self.first[at], np.flatnonzero((self.h[at] != h) | (self.h2[at] != h2))
        if len(new):
            one, back = told_apart(h[new], h2[new])
            one = new[one]
            ids = np.array(self.coder.firsts(cut(one)), dtype=np.uint16)
            out[new] = ids[back]
            slot = at[one]
            self.h[slot], self.h2[slot], self.first[slot] = h[one], h2[one], ids
        return out


def ids_of(tokenizer: WordIds, words: list[bytes]) -> list[bytes]:
    """Little-endian 16-bit subword ids of words; a word without any has id 0."""
    coded = tokenizer.words(words)
    n = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 2
    flat = np.frombuffer(b"".join(coded), "<u4").astype("<u2").tobytes()
    ends = np.cumsum(n).tolist()
    return [flat[a:b] or b"\0\0" for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def flat_ids(column) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit ids in a binary column, one after another, and how many each row has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u2").astype(np.int64), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 2


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, tokenizer: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Learns from the rows whose crc32(doc_id as text) mod 5 is not 1; a null
    doc_id is learnt from. A null text is empty: its one token is the end. Equal
    texts score alike. Without rows to learn from, every count is 0. An empty
    table gives no rows; columns besides doc_id and text are ignored. The tokenizer is one for
    which WordIds holds, with ids under 65,536.
    """
    spark = prepared(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (crc_side() == 1).alias("held_out"))
    size = base.agg(F.sum(F.octet_length("text").cast("long")).alias("b"), F.count("*").alias("n"), F.count_if(~F.col("held_out")).alias("t")).first()
    if not size["n"]:
        return spark.createDataFrame([], RESULT)
    blocks = max(1, -(-int(size["b"]) // block_bytes))

    def squeeze(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        for batch in batches:
            z = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([z.compress(t) for t in texts_of(batch.column(3))], pa.binary())], names=["block", "doc_id", "held_out", "z"])

    # By the row's place in the input, so that equal rows part.
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")
    blocked = base.select(block, "doc_id", "held_out", "text").mapInArrow(squeeze, "block int, doc_id long, held_out boolean, z binary")
    blocked = written(blocked.repartition(blocks, "block"), "blocks")

    def word_rows(batches: Iterator) -> Iterator:
        """Distinct words of each block with their training count."""
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdDecompressor()
        held: dict[int, list] = {}  # by block: hashes, counts and words of each batch

        def flush(b: int) -> Iterator:
            h, h2, counts = (np.concatenate(x) for x in held[b][:3])
            words = pa.concat_arrays(held.pop(b)[3])
            first, back = told_apart(h, h2)
            n = np.bincount(back, counts).astype(np.int64)
            for i in range(0, len(first), 100_000):
                at = first[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b, np.int32)), pa.array(h[at]), pa.array(h2[at]), pa.array(n[i : i + 100_000]), words.take(pa.array(at))], names=["block", "h", "h2", "n", "word"])

        for batch in batches:
            own, hold, raw = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), [z.decompress(x) for x in batch.column(3).to_pylist()]
            for b in np.unique(own).tolist():
                rows = np.flatnonzero(own == b)
                h, h2, first, buf, starts, ends = text_words([raw[i] for i in rows])
                learn = np.repeat(~hold[rows].astype(bool), np.diff(first))
                if not len(h):
                    continue
                at, back = told_apart(h, h2)
                mine, text = held.setdefault(b, [[], [], [], []]), buf.tobytes()
                words = pa.array([text[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary())
                for col, v in zip(mine, (h[at], h2[at], np.bincount(back, learn, minlength=len(at)).astype(np.int32), words), strict=True):
                    col.append(v)
                if sum(map(len, mine[0])) > 1_500_000:
                    yield from flush(b)
            for b in [b for b in held if b not in own]:  # blocks come one after another
                yield from flush(b)
        for b in list(held):
            yield from flush(b)
        released()

    def count_group(key, table):
        """Adds up the counts of each word over the blocks that have it and codes it; lead marks one row of each word."""
        import pyarrow as pa

        h, h2, n = (table.column(c).to_numpy() for c in ("h", "h2", "n"))
        first, back = told_apart(h, h2)
        lead = np.zeros(len(h), dtype=bool)
        lead[first] = True
        c = np.bincount(back, n, minlength=len(first)).astype(np.int64)
        coder = WordIds(tokenizer, None, CODED)
        ids = pa.array(ids_of(coder, table.column("word").take(pa.array(first)).to_pylist()), pa.binary()).take(pa.array(back))
        coder.trim()
        released()
        return pa.table({"block": table.column("block"), "h": table.column("h"), "h2": table.column("h2"), "c": c[back], "lead": lead, "ids": ids})

    rows = blocked.mapInArrow(word_rows, "block int, h long, h2 long, n long, word binary")
    buckets = blocks
    counted = written(rows.withColumn("g", F.pmod("h", F.lit(buckets))).groupBy("g").applyInArrow(count_group, "block int, h long, h2 long, c long, lead boolean, ids binary"), "counts")
    words = counted.where("lead and c > 0")
    top = [r["h"] for r in words.orderBy(F.desc("c"), "h").limit(WORDS).select("h").collect()]
    known = spark.sparkContext.broadcast(np.sort(np.array(top, dtype=np.int64)))

    def sub_rows(batches: Iterator) -> Iterator:
        """Counts of rare words by first subword, and of all subwords of rare words as spelled once."""
        import pyarrow as pa

        first, kinds, sub, total, n = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16), 0, 0
        for batch in batches:
            h, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, lens = flat_ids(batch.column(2))
            total, n = total + int(c.sum()), n + len(c)
            rare = ~np.isin(h, known.value)
            lead = flat[np.cumsum(lens) - lens]
            first += np.bincount(lead[rare], c[rare], minlength=1 << 16)
            kinds += np.bincount(lead[rare], minlength=1 << 16)
            sub += np.bincount(flat, minlength=1 << 16)
        some = np.flatnonzero((first > 0) | (sub > 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(first[some], total)), pa.array(np.append(sub[some], n)), pa.array(np.append(kinds[some], 0))], names=["id", "first", "sub", "kinds"])

    stats = words.select("h", "c", "ids").mapInArrow(sub_rows, "id long, first double, sub double, kinds double").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("first", "sub", "kinds"))).toPandas().set_index("id")
    total = float(stats["first"].get(-1, 0.0)) + size["t"]
    distinct = int(stats["sub"].get(-1, 0.0)) + (1 if size["t"] else 0)
    first, kinds, sub = (np.zeros(1 << 16) for _ in range(3))
    real = stats[stats.index >= 0]
    first[real.index], kinds[real.index], sub[real.index] = real["first"], real["kinds"], real["sub"]
    firsts = np.lexsort((np.arange(1 << 16), -first))[:FIRSTS]
    firsts = firsts[first[firsts] > 0]
    symbol_counts = np.zeros(SYMBOLS)
    top_counts = {r["h"]: r["c"] for r in words.join(F.broadcast(spark.createDataFrame([(int(x),) for x in top] or [(0,)], "h long")), "h").select("h", "c").collect()}
    symbol_counts[: len(top)] = [top_counts.get(x, 0) for x in top]
    symbol_counts[WORDS : WORDS + len(firsts)] = first[firsts]
    symbol_counts[OTHER], symbol_counts[END] = first.sum() - first[firsts].sum(), size["t"]
    types = np.zeros(SYMBOLS)
    types[WORDS : WORDS + len(firsts)], types[OTHER] = kinds[firsts], kinds.sum() - kinds[firsts].sum()
    v = Vocabulary(np.array(top, dtype=np.int64), firsts, symbol_counts, types, sub, total, distinct)

    def pair_rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = np.zeros(SPELLING * SPELLING, dtype=np.int64)
        for batch in batches:
            before, after, _ = v.neighbours(*flat_ids(batch.column(0)))
            n += np.bincount(before * SPELLING + after, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["pair", "n"])

    found = words.select("ids").mapInArrow(pair_rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SPELLING * SPELLING)
    n[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    v.pairs(n.reshape(SPELLING, SPELLING))
    vocabulary = spark.sparkContext.broadcast(v)
    flat = trained(blocked, vocabulary, tokenizer, Attention(symbol_counts).flat())
    model = spark.sparkContext.broadcast(flat)

    def score_block(left, right):
        import pyarrow as pa
        import zstandard

        v, z = vocabulary.value, zstandard.ZstdDecompressor()
        net = Attention().load(model.value)
        net.prepare()
        h, h2 = right.column("h").to_numpy().view(np.uint64), right.column("h2").to_numpy()
        order = np.argsort(h)
        # A word that was reported twice by one block has two equal rows.
        c = right.column("c").to_numpy()[order].astype(float)
        flat, lens = flat_ids(right.column("ids").take(pa.array(order)))
        h = h[order]
        place_of = Lookup(h, h2[order])
        symbol = v.symbols(h.view(np.int64), flat[np.cumsum(lens) - lens])
        within, whole = v.within(symbol, c, flat, lens)
        floor = v.total + 0.5 * (v.distinct + 1)
        base = np.log10((c + 0.5) / floor)
        # Unigram: counts, and spelling for what was not seen.
        uni = (c + (v.distinct + 1) * whole) / (v.total + v.distinct + 1)
        ends_seen = v.counts[END]
        end_base, end_uni = math.log10(ends_seen + 0.5) - math.log10(floor), ends_seen / (v.total + v.distinct + 1)
        out = [[] for _ in range(4)]
        texts = [z.decompress(x) for x in left.column("z").to_pylist()]
        for a in range(0, len(texts), 200):
            hw, hw2, first, *_ = text_words(texts[a : a + 200])
            at = place_of(hw.view(np.uint64), hw2)
            n = np.diff(first)
            docs_n = len(n)
            ends = np.cumsum(n + 1) - 1
            place = np.arange(len(hw)) + np.repeat(np.arange(docs_n), n)
            total = len(hw) + docs_n
            y = np.full(total, END, dtype=np.int64)
            y[place] = symbol[at]
            rest = np.ones(total)
            rest[place] = within[at]
            plain = np.full(total, end_uni)
            plain[place] = uni[at]
            lm = window_probabilities(net, y, n + 1)
            logp = np.log10(np.maximum(UNIGRAM * plain + (1 - UNIGRAM) * lm * rest, 1e-300))
            upto = np.concatenate([[0.0], np.cumsum(logp)])
            doc = np.repeat(np.arange(docs_n), n)
            out[0].append(n + 1)
            out[1].append(np.bincount(doc, c[at] > 0, minlength=docs_n).astype(np.int64) + int(ends_seen > 0))
            out[2].append(np.bincount(doc, base[at], minlength=docs_n) + end_base)
            out[3].append(np.add.reduceat(logp, ends - n) if docs_n else upto[:0])
        cols = [np.concatenate(x) for x in out]
        del texts, place_of, flat, lens, order
        released()
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(cols[0].astype(np.int64)), "n_known": pa.array(cols[1]),
            "train_tokens": pa.array(np.full(len(cols[0]), int(v.total))), "base_score": pa.array(cols[2]), "score": pa.array(cols[3]),
        })

    def score_cogroup(left, right):
        if not left.num_rows:
            import pyarrow as pa

            return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        return score_block(left, right)

    return blocked.groupBy("block").cogroup(counted.select("block", "h", "h2", "c", "ids").groupBy("block")).applyInArrow(score_cogroup, RESULT)


def window_probabilities(net: Attention, y: np.ndarray, lengths: np.ndarray, batch: int = 4 * IN_CACHE) -> np.ndarray:
    """P(symbol | symbols before) at every place of consecutive texts, by overlapping windows that each score STRIDE places once."""
    out = np.zeros(len(y), dtype=np.float64)
    starts = np.cumsum(lengths) - lengths
    n = -(-lengths // STRIDE)
    text = np.repeat(np.arange(len(lengths)), n)
    at = starts[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    grid = np.arange(STRIDE - WINDOW, STRIDE)
    for i in range(0, len(text), batch):
        a, s, e = at[i : i + batch], starts[text[i : i + batch]], (starts + lengths)[text[i : i + batch]]
        place = a[:, None] + grid  # the place whose symbol is predicted
        before = place - 1
        absent = place < s[:, None]
        x = np.where(before < s[:, None], START, y[np.clip(before, 0, len(y) - 1)])
        own = place[:, WINDOW - STRIDE :]
        real = own < e[:, None]
        p = net.probabilities(x, absent, y[np.minimum(own, len(y) - 1)])
        out[own[real]] = p[real]
    return out


def trained(blocked: DataFrame, vocabulary, tokenizer: str, flat: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after training on every window of the rows to learn from: each round takes its share of the blocks, in every task from the mean of the last round. Tasks without rows to learn from leave them as they are."""
    spark = blocked.sparkSession

    def learner(start, seed):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa
            import zstandard
            from pyspark import TaskContext

            v, firsts, z = vocabulary.value, Firsts.of(tokenizer), zstandard.ZstdDecompressor()
            net, learning, total, held = None, None, 0, []

            def symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
                """The symbols of texts, ends included, and the number of the text at each place."""
                h, h2, first, buf, starts, ends = text_words(texts)
                n = np.diff(first)
                known = v.symbols(h, None)
                rare = np.flatnonzero(known < 0)
                if len(rare):
                    text = buf.tobytes()
                    cut = lambda at: [text[i:j] for i, j in zip(starts[rare[at]].tolist(), ends[rare[at]].tolist(), strict=True)]
                    known[rare] = v.first_symbol[firsts(h[rare], h2[rare], cut)]
                y = np.full(len(h) + len(n), END, dtype=np.int64)
                y[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = known
                return y, np.repeat(np.arange(len(n)), n + 1)

            def learn() -> None:
                nonlocal net, learning
                if net is None:
                    net = Attention().load(start.value)
                    learning = Learning(net, [seed, TaskContext.get().partitionId()])
                learning.learn(*(np.concatenate(c) for c in zip(*held, strict=True)), STEPS)
                held.clear()

            for batch in batches:
                if not batch.num_rows:
                    continue
                rows, places = windows_of(*symbols_of([z.decompress(raw) for raw in batch.column(0).to_pylist()]))
                held.append((rows, places))
                total += int(places.sum())
                if sum(len(r) for r, _ in held) >= HELD_WINDOWS:
                    learn()
            if held:
                learn()
            firsts.coder.trim()
            released()
            if net is None:
                return
            parts = np.array_split(net.flat(), CHUNKS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([total] * CHUNKS, pa.int64()), pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())], names=["chunk", "n", "data"])

        return run

    def mean(key, table):
        import pyarrow as pa

        n = table.column("n").to_numpy().astype(np.float64)
        rows = np.stack([np.frombuffer(x, "<f4") for x in table.column("data").to_pylist()]).astype(np.float64)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([int(n.sum())]), "data": pa.array([((rows * n[:, None]).sum(axis=0) / n.sum()).astype("<f4").tobytes()], pa.binary())})

    kinds = "chunk int, n long, data binary"
    for r in range(rounds):
        start = spark.sparkContext.broadcast(flat)
        got = blocked.where(~F.col("held_out") & (F.col("block") % rounds == r)).select("z").mapInArrow(learner(start, r), kinds)
        # Two levels, so that no task takes the parameters of all others.
        got = got.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("chunk", "salt").applyInArrow(mean, kinds).groupBy("chunk").applyInArrow(mean, kinds)
        parts = {x["chunk"]: np.frombuffer(x["data"], "<f4") for x in got.collect()}
        if len(parts) == CHUNKS:
            flat = np.concatenate([parts[c] for c in range(CHUNKS)])
    return flat
