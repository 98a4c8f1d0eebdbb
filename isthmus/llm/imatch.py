"""I-Match fingerprints: document frequency, a band of it, sorted distinct terms, and hashes of several randomised lexicon subsets.

Terms are runs of letters and digits, lower-cased. Document frequencies are
counted over all documents in a fixed number of hash buckets, so that what is broadcast has
one size whatever the corpus. The lexicon is the terms whose relative
inverse document frequency lies in a band. A document's distinct lexicon terms, sorted by
term hash, give one hash for the whole lexicon and one for each randomised
subset: subset (level, seed) keeps a 2^-level share of all terms. Sparse subsets
keep a few terms of a long text and dense ones a few of a short text, so texts that
share most terms agree in part of the hashes at any length.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, hashed, joined, mixed, prepared, released, texts_of, words_in, written

BUCKET_BITS = 21
#: Relative inverse document frequency, log(N / df) / log(N): below are the commonest terms, above the rarest.
BAND = (0.2, 0.9)
LEVELS, SEEDS = 12, 8
#: Levels whose subsets keep about so many of a document's terms are compared.
KEEP = (0.4, 5.0)
#: UTF-8 bytes of text in a range of neighbouring documents, on average; a range is read as a stream, however much it has.
GROUP_BYTES = 32 << 20
#: UTF-8 bytes of text that are turned into terms at once.
CHUNK_BYTES = 1 << 20


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hash of each distinct term of each text, sorted by both."""
    buf, offsets = joined([t.translate(LOWER) for t in texts])
    starts, ends, first = words_in(buf, offsets, ALNUM)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    h = hashed(buf, starts, ends)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[fresh], h[fresh]


def chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about `size` bytes."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def frequencies(docs: DataFrame, bits: int = BUCKET_BITS) -> tuple[np.ndarray, int]:
    """Document frequency by term bucket over all documents, and their number; at most 2^bits rows reach the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = np.zeros(1 << bits, dtype=np.int32)
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in chunks(texts):
                _, h = terms_of(texts[a:b])
                np.add.at(count, (h >> np.uint64(64 - bits)).astype(np.int64), 1)
        some = np.flatnonzero(count)
        for i in range(0, len(some), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 200_000].astype(np.int32)), pa.array(count[some[i : i + 200_000]].astype(np.int64))], names=["bucket", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out, docs.count()


def lexicon(count: np.ndarray, n: int, band: tuple[float, float] = BAND) -> np.ndarray:
    """Which buckets hold terms of the lexicon."""
    if n < 2:
        return np.zeros(len(count), dtype=bool)
    with np.errstate(divide="ignore"):
        rel = np.log(n / np.maximum(count, 1e-9)) / np.log(n)
    return (rel >= band[0]) & (rel <= band[1]) & (count > 0)


def prints(texts: list[bytes], inside: np.ndarray, bits: int = BUCKET_BITS) -> list[str]:
    """Fingerprints: 16 digits for all terms, 4 for how many, then 4 for each subset by level and seed (0000: no term).

    A text without lexicon terms uses all its terms; one without terms has digits of 0 only.
    """
    out: list[str] = []
    for a, b in chunks(texts):
        part = texts[a:b]
        doc, h = terms_of(part)
        good = inside[(h >> np.uint64(64 - bits)).astype(np.int64)]
        bare = np.bincount(doc[good], minlength=len(part)) == 0
        good |= bare[doc]
        doc, h = doc[good], h[good]
        cut = np.arange(len(part) + 1)

        def sums(values, doc=doc, cut=cut):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
            at = np.searchsorted(doc, cut)
            return total[at[1:]] - total[at[:-1]]

        whole = mixed(sums(mixed(h)))
        n = np.bincount(doc, minlength=len(part))
        slots = np.zeros((len(part), LEVELS, SEEDS), dtype=np.uint16)
        for seed in range(SEEDS):
            u, d = mixed(h + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), doc
            for level in range(LEVELS):
                keep = u < np.uint64(1 << (63 - level))
                u, d = u[keep], d[keep]
                total = sums(mixed(u + np.uint64(1)), d)
                some = np.bincount(d, minlength=len(part)) > 0
                slots[:, level, seed] = np.where(some, (mixed(total) % np.uint64(65535)).astype(np.uint16) + 1, 0)
        rows = slots.reshape(len(part), -1).astype(">u2")
        out += [(f"{w:016x}" if k else "0" * 16) + f"{min(k, 65535):04x}" + r.tobytes().hex() for w, k, r in zip(whole.tolist(), n.tolist(), rows, strict=True)]
    return out


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints; else the share of equal hashes among the subsets that keep a few terms of either text."""
    if a == b:
        return 1.0
    n = max(int(a[16:20], 16), int(b[16:20], 16))
    x, y = (np.frombuffer(bytes.fromhex(s[20:]), dtype=">u2").reshape(LEVELS, SEEDS) for s in (a, b))
    kept = n / 2.0 ** np.arange(1, LEVELS + 1)
    use = (kept >= KEEP[0]) & (kept <= KEEP[1])
    if not use.any():
        use[0 if n < 2 else -1] = True
    x, y = x[use], y[use]
    some = ((x > 0) | (y > 0)).sum()
    return float(((x == y) & (x > 0)).sum() / some) if some else 0.0


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def matched(docs: DataFrame, band: tuple[float, float] = BAND, bits: int = BUCKET_BITS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses.

    The edited text has its last third of code points replaced by the first as many of the next
    document by descending doc_id (the last takes the first's; one document alone takes its own). Rows that share a
    doc_id follow each other by descending text; a null doc_id comes last and stays
    null. A null text is empty. An empty table gives no rows; columns besides doc_id and text are ignored.
    """
    spark = prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("b"), F.count("*").alias("n")).first()
    if not size["n"]:
        return spark.createDataFrame([], RESULT)
    count, n = frequencies(docs, bits)
    inside = spark.sparkContext.broadcast(np.packbits(lexicon(count, n, band)))

    def results(ids: list, texts: list[str]) -> dict:
        """The columns of RESULT for all texts but the last, each held against the one after it."""
        known = np.unpackbits(inside.value).astype(bool)
        edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in itertools.pairwise(texts)]
        raw = [t.encode() for t in edited]
        plain, changed = prints([t.encode() for t in texts], known, bits), prints(raw, known, bits)
        return {
            "doc_id": ids, "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t).hexdigest() for t in raw],
            "fingerprint": plain[:-1], "edited_fingerprint": changed,
            "near_edited": [likeness(a, b) for a, b in zip(plain[:-1], changed, strict=True)], "near_next": [likeness(a, b) for a, b in itertools.pairwise(plain)],
        }

    kind = pa_schema(f"part int, edge int, text string, {RESULT}")

    def run(batches: Iterator) -> Iterator:
        """A partition's rows in order; its first text leaves as edge 1 and its last row, whose next is elsewhere, as edge 2."""
        import pyarrow as pa
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None

        def edge(number: int, doc, text: str):
            return pa.RecordBatch.from_pylist([{"part": part, "edge": number, "doc_id": doc, "text": text}], schema=kind)

        for batch in batches:
            for a, b in chunks(texts_of(batch.column(1))):
                ids, texts = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
                if last is None:
                    yield edge(1, ids[0], texts[0])
                else:
                    ids, texts = [last[0], *ids], [last[1], *texts]
                if len(texts) > 1:
                    cols = results(ids[:-1], texts)
                    rows = len(ids) - 1
                    cols |= {"part": [part] * rows, "edge": [0] * rows, "text": [None] * rows}
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in kind], schema=kind)
                last = ids[-1], texts[-1]
        if last is not None:
            yield edge(2, *last)
        released()

    # In descending order; a key's rows may be split by how their texts begin.
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    parts = max(1, -(-int(size["b"]) // group_bytes))
    ranged = docs.repartitionByRange(parts, order.desc(), F.substring("text", 1, 64).desc()).sortWithinPartitions(order.desc(), F.col("text").desc())
    out = written(ranged.select("doc_id", "text").mapInArrow(run, f"part int, edge int, text string, {RESULT}"), "fingerprints")
    # The last row of each partition goes with the first text of the next one that has any (after the last: the first).
    have = sorted(r["part"] for r in out.where("edge = 1").select("part").collect())
    following = spark.createDataFrame(list(zip(have, [*have[1:], have[0]], strict=True)), "part int, next int")
    heads = out.where("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("after"))
    tails = out.where("edge = 2").select("part", "doc_id", "text").join(following, "part").join(heads, "next").select("doc_id", "text", "after")

    def edges(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for doc, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cols = results([doc], [text, after])
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in list(kind)[3:]], names=[f.name for f in list(kind)[3:]])

    return out.where("edge = 0").drop("part", "edge", "text").unionByName(tails.mapInArrow(edges, RESULT))


def pa_schema(text: str):
    """An Arrow schema from "name type, ..."."""
    import pyarrow as pa

    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(f.split()[0], types[f.split()[1]]) for f in text.split(", ")])
