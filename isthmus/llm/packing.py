"""Harmonic packing of token sequences.

Capacity C. Class k holds pieces of at most floor(C / k) tokens, k to a bin, so
a class's bins fill without comparing one piece with another: workers number the
pieces of a class independently and piece number i goes to bin i div k. Documents
may be cut, which lets nearly every piece fill its class's width exactly:
a document gives whole sequences of C, then pieces of exactly C div k (the
smallest k that fits) until what rounding the rest up into its class would waste
is little, or ``cuts`` such pieces are made.

The bins a worker cannot fill are emptied again; their pieces (under k for a
class and worker) are packed by decreasing length, a group of them at a time.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, prepared, released, texts_of, written

CAPACITY, END_ID, CUTS = 4096, 2, 3
#: Words whose ids a task remembers, and those, the short ones, that a worker takes on to its next task; beyond either it starts anew.
CACHE_WORDS, KEPT_WORDS = 600_000, 60_000
#: Pieces that one task of a class numbers at most, on average.
GROUP_PIECES = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


#: a-z and the small letters U+00DF to U+00FF in UTF-8.
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _byte_chars() -> dict[int, str]:
    """Byte-level vocabularies write bytes as characters: printable ones as themselves, the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(odd)}


_BYTE_CHARS = _byte_chars()


#: Latin-1 in small letters, and the pre-tokens in it: contractions, letters, single digits, anything else but white space.
_SMALL = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_LETTERS, _DIGITS, _SPACES = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\x09-\x0d\x20\x85\xa0"
_PRE_TOKEN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[%b]+|[%b]|[^%b%b%b]+" % (_LETTERS, _DIGITS, _SPACES, _LETTERS, _DIGITS))


def cased(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased but for those that hold the start of a special token."""
    return [w if b"<|" in w else w.translate(LOWER) for w in text.split()]


class _Pieces(dict):
    """The ids of pre-tokens in Latin-1, each looked up in the model when it is first asked for."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode("latin-1").encode().decode("latin-1").translate(_BYTE_CHARS)
        ids = self[piece] = array("I", [t.id for t in self.model(text)]).tobytes()
        return ids


class WordIds:
    """Ids of texts by a tokenizer that lower-cases and whose pre-tokens never hold ASCII white space: each distinct word, without what punctuation follows it, is encoded once.

    A word in which a special token may stand ("<|") keeps its case: such tokens are told before lower-casing.
    """

    #: What a worker process has encoded, kept from task to task.
    shared: dict[tuple, dict[bytes, bytes]] = {}

    #: The tokenizer a worker process has loaded.
    loaded: dict[str, object] = {}

    def __init__(self, path: str, end_id: int | None, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        if path not in self.loaded:
            self.loaded[path] = Tokenizer.from_file(path)
        self.tokenizer, self.limit = self.loaded[path], limit
        self.end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        self.model = self.tokenizer.model.tokenize
        self.known = self.shared.setdefault((path,), {})
        self.pieces = self.shared.setdefault((path, "latin"), _Pieces(self.model))

    def _coded(self, word: bytes) -> bytes | None:
        """Ids of a word not yet known, without the tokenizer's whole path: small Latin letters are one pre-token in normal form, and what punctuation follows an ASCII letter is another word. None if the word needs that path. Strings of special tokens do."""
        if _LATIN.fullmatch(word):
            text = word.decode() if word.isascii() else word.decode("latin-1").translate(_BYTE_CHARS)
            return array("I", [t.id for t in self.model(text)]).tobytes()
        stem = word.rstrip(_PUNCTUATION)
        if len(stem) == len(word) or not stem or not 97 <= stem[-1] <= 122 or b"<|" in word:
            return None
        known, tail = self.known, word[len(stem) :]
        for part in (stem, tail):
            if part not in known:
                got = self._coded(part)
                known[part] = self._whole([part])[0] if got is None else got
        return known[stem] + known[tail]

    def trim(self) -> None:
        """Forgets all but short words, the frequent ones."""
        for held in (self.known, self.pieces):
            few = dict(itertools.islice(((w, c) for w, c in held.items() if len(w) < 7), KEPT_WORDS))
            held.clear()
            held.update(few)

    def _whole(self, words: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in coded]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of lower-cased words."""
        if len(self.known) > self.limit:
            self.trim()
        known, coded_of = self.known, self._coded
        coded = []
        for w in words:
            c = known.get(w)
            if c is None:
                c = coded_of(w)
                if c is not None:
                    known[w] = c
            coded.append(c)
        later = [i for i, c in enumerate(coded) if c is None]
        for i, c in zip(later, self._whole([words[i] for i in later]), strict=True):
            coded[i] = known[words[i]] = c
        return coded

    def firsts(self, words: list[bytes]) -> list[int]:
        """The first id of each lower-cased word, 0 if it has none. In Latin-1 a word's first pre-token alone goes to the model."""
        out, rest, model = [0] * len(words), [], self.model
        for i, w in enumerate(words):
            try:
                if b"<|" in w:
                    raise ValueError
                piece = _PRE_TOKEN.search(w if w.isascii() else w.decode().encode("latin-1").translate(_SMALL))
            except ValueError:  # beyond Latin-1, or a special token perhaps
                rest.append(i)
                continue
            if piece:
                text = piece.group().decode("latin-1")
                out[i] = model(text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_CHARS))[0].id
        for i, ids in zip(rest, self.words([words[i] for i in rest]), strict=True):
            out[i] = int.from_bytes(ids[:4], "little")
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        out: list = [None] * len(texts)
        rest, small = [], []
        for i, t in enumerate(texts):
            try:
                if b"<|" in t:
                    raise ValueError
                small.append((i, (t if t.isascii() else t.decode().encode("latin-1")).translate(_SMALL)))
            except ValueError:  # beyond Latin-1, or a special token perhaps
                rest.append(i)
        for i, coded in zip(rest, self._by_word([texts[i] for i in rest]), strict=True):
            out[i] = coded
        # Latin-1: the pre-tokens are found here, and each distinct one goes to the model once.
        split = [_PRE_TOKEN.findall(t) for _, t in small]
        if len(self.pieces) > self.limit:
            self.trim()
        known = self.pieces
        for (i, _), ps in zip(small, split, strict=True):
            out[i] = b"".join(map(known.__getitem__, ps)) + self.end
        return out

    def _by_word(self, texts: list[bytes]) -> list[bytes]:
        """The same for any text, by words between white space."""
        split = [cased(t) if b"<|" in t else t.translate(LOWER).split() for t in texts]
        flat = itertools.chain.from_iterable(split)
        coded = dict(zip(new := list(set(flat)), self.words(new), strict=True))
        return [b"".join(map(coded.__getitem__, ws)) + self.end for ws in split]


def pieces_of(n: int, capacity: int = CAPACITY, cuts: int = CUTS) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens, in order; the last may be shorter than its class is wide."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    for _ in range(cuts):
        if not rest or capacity // (capacity // rest) - rest <= max(4, n // 256):
            break
        k = -(-capacity // rest)
        if capacity // k > rest:
            k += 1
        width = capacity // k
        out.append((width, k))
        rest -= width
    if rest:
        out.append((rest, capacity // rest))
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, at long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, cuts: int) -> DataFrame:
    """The pieces of every document with their classes; ids are computed here only and leave as check sums."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        ids = WordIds(tokenizer, end_id)
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            names = batch.schema.names
            docs_ids, texts = batch.column(names.index("doc_id")).to_pylist(), texts_of(batch.column(names.index("text")))
            rows: list[tuple] = []
            for doc, coded in zip(docs_ids, ids(texts), strict=True):
                n, start = len(coded) // 4, 0
                for length, k in pieces_of(n, capacity, cuts):
                    rows.append((doc, start, length, zlib.crc32(coded[4 * start : 4 * (start + length)]), n, k, at))
                    start, at = start + length, at + 1
            del texts
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "at"])
        ids.trim()
        released()

    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = END_ID, capacity: int = CAPACITY, cuts: int = CUTS) -> DataFrame:
    """Packs doc_id, text into sequences of at most `capacity` tokens.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A null text counts as empty: a piece with the end
    id alone. Rows with equal doc_id are packed as documents of their own;
    a null doc_id stays null. An empty table gives no rows; other columns are ignored.
    """
    found = written(pieces(docs, tokenizer or default_tokenizer(), end_id, capacity, cuts), "pieces")
    spark = found.sparkSession
    # Classes with several groups: as many as keep a group's pieces bounded, whatever the corpus.
    counts = {r["k"]: r["n"] for r in found.groupBy("k").agg(F.count("*").alias("n")).collect()}
    salts = [max(1, -(-counts.get(k, 0) // GROUP_PIECES)) for k in range(capacity + 1)]
    spread = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "at"), F.get(F.lit(salts), F.col("k")).cast("long")))

    def fill(key, table):
        import pyarrow as pa

        k, n = key[0].as_py(), table.num_rows
        length = table.column("length").to_numpy()
        i = np.arange(n)
        full = i < n - n % k
        seq, off = i // k, np.zeros(n, dtype=np.int64)
        ends = np.cumsum(length)
        off = ends - length
        off -= off[seq * k] if n else off
        seq = np.where(full, seq, -1)
        return table.append_column("bin", pa.array(seq)).append_column("offset", pa.array(off))

    # Full sequences are bins of their own; only the others are numbered.
    schema = f"{PIECES}, salt long, bin long, offset long"
    several = spread.where("k > 1").groupBy("k", "salt").applyInArrow(fill, schema)
    several = written(several, "bins")
    rest = several.where("bin < 0").drop("bin", "offset")

    def finish(key, table):
        import pyarrow as pa

        length = table.column("length").to_numpy()
        order = np.argsort(-length, kind="stable")
        bins, offs, room = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), []
        slot: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room left
        rooms = 0  # bit r: a bin with room r is open
        for i in order:
            want = int(length[i])
            fits = rooms >> want
            if fits:
                at = want + (fits & -fits).bit_length() - 1
                b = slot[at].pop()
                if not slot[at]:
                    rooms ^= 1 << at
            else:
                b, at = len(room), capacity
                room.append(0)
            bins[i], offs[i] = b, capacity - at
            if at > want:
                slot[at - want].append(b)
                rooms |= 1 << (at - want)
        return table.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offs))

    # A group leaves under k pieces of class k, whatever it held, and a capacity has few classes (k = capacity div length): left-over
    # pieces of one salt are some ten thousand at most, for any corpus.
    last = rest.groupBy("salt").applyInArrow(finish, schema)
    out = (
        spread.where("k = 1").select("*", F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit("one").alias("kind"))
        .unionByName(several.where("bin >= 0").withColumn("kind", F.lit("class")))
        .unionByName(last.withColumn("kind", F.lit("last")))
    )
    # An id from what names the bin: a full sequence's one piece (task and number), or class, salt and number.
    out = out.withColumn(
        "sequence_id",
        F.when(F.col("kind") == "one", F.col("at") + F.lit(1 << 62))
        .when(F.col("kind") == "class", F.shiftleft(F.col("k").cast("long"), 48) + F.shiftleft(F.col("salt"), 28) + F.col("bin"))
        .otherwise(F.lit(-1) - F.shiftleft(F.col("salt"), 30) - F.col("bin")),
    )
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
