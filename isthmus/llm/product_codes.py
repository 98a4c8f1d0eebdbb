"""Product codes of vectors: eight parts, each replaced by the number of its nearest codebook entry.

Components become integers, so that sums and distances are exact and don't depend on how rows
are dealt to tasks. Codebooks are fitted by rounds over the whole table: tasks assign
their rows and send sums and counts of each entry, a few thousand numbers, which Spark adds
up; only the codebooks pass through the driver. An assignment is a partial-distance
search: dimensions in descending variance of the codebook, and an entry is dropped once its
distance so far strictly exceeds the best complete distance known for the row.

Rows: those whose vector is null or holds a null or non-finite component are left aside. Vectors of
unequal length count as if zeros stood behind them, up to the longest one and a multiple of
the number of parts. Integers are held to what squared distances in 64 bits allow (``limit()``; with 64
dimensions 2^27, components of 32,768). Codebooks start from the smallest distinct ids, a null id last;
of several vectors of one id the least starts. Repeated rows count as often as they stand. A total over a label
that 64 bits don't hold is null. Without rows there is no result row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, prepared, released, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose totals are broadcast; more are joined.
LOOKUP_LABELS = 200_000
#: Dimensions, counted from 0 in the order of the search, after which the most promising entry of each row is completed.
COMPLETED_AT = (0, 2)


def limit(dimensions: int) -> int:
    """The greatest absolute integer of a component, a power of two: all squared differences of a row then sum up to less than 2^63."""
    return 1 << (62 - max(1, dimensions - 1).bit_length()) // 2 - 1


def variances(book: np.ndarray) -> np.ndarray:
    """The variance of a codebook (entries x dimensions) in each dimension, times the squared number of entries."""
    return len(book) * (book * book).sum(axis=0) - book.sum(axis=0) ** 2


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers the number of the nearest entry, the lower one of equally near ones, and its squared distance."""
    order = np.argsort(-variances(book), kind="stable")
    rows = np.arange(len(x))
    best = np.full(len(x), np.iinfo(np.int64).max)
    row, entry = (g.ravel() for g in np.meshgrid(rows, np.arange(len(book)), indexing="ij"))
    far = np.zeros(len(row), np.int64)
    for step, j in enumerate(order):
        d = x[row, j] - book[entry, j]
        far += d * d
        if step in COMPLETED_AT and step + 1 < len(order):
            lead = entry[_least(far, row)]
            d = x - book[lead]
            best = np.minimum(best, (d * d).sum(axis=1))
        kept = far <= best[row]
        row, entry, far = row[kept], entry[kept], far[kept]
    at = _least(far, row)
    return entry[at], far[at]


def _least(far: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each row, in order, the place of its first least distance; every row is there."""
    if not len(row):
        return row
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = np.flatnonzero(far == np.repeat(np.minimum.reduceat(far, head), np.diff(np.append(head, len(row)))))
    return least[np.append(True, row[least][1:] != row[least][:-1])]


def _integers(column, width: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the kept rows of an Arrow list column, their integers with zeros behind them, and their lengths."""
    import pyarrow.compute as pc

    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    there = ~np.isnan(n.astype(float))
    n = np.where(there, n, 0).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(n)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = np.flatnonzero(there & (odd[ends] == odd[ends - n]))
    n, start = n[kept], (ends - n)[kept]
    width = max(int(n.max(initial=0)), 1) if width is None else width
    out = np.zeros((len(kept), width), np.int64)
    row = np.repeat(np.arange(len(kept)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    top = float(1 << 60)  # held further once the dimension is known
    out[row, at] = np.clip(np.floor(flat[np.repeat(start, n) + at] * SCALE), -top, top)
    return kept, out, n


def _bounded(x: np.ndarray) -> np.ndarray:
    top = limit(x.shape[1])
    return np.clip(x, -top, top)


def start_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks to start with (parts x entries x dimensions of a part); vectors: vec_id, embedding. Without a kept row there are no entries."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        first: dict = {}
        longest = 0
        key = lambda i: (i is None, i)
        for batch in batches:
            kept, x, n = _integers(batch.column(1), None)
            longest = max(longest, int(n.max(initial=0)))
            ids = batch.column(0).take(pa.array(kept)).to_pylist()
            last = key(max(first, key=key)) if len(first) == entries else None
            for i, row in zip(ids, x, strict=True):
                if last is not None and key(i) > last:
                    continue
                row = row.tolist()
                old = first.get(i)
                first[i] = row if old is None else min(old, row, key=lambda v: v + [0] * (longest - len(v)))
                if len(first) > entries:
                    del first[max(first, key=key)]
                    last = key(max(first, key=key))
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int64()), pa.array(list(first.values()), pa.list_(pa.int64())), pa.array([longest] * len(first))], names=["vec_id", "x", "longest"])
        released()

    found = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, x array<long>, longest long"), "starts")
    longest = found.agg(F.max("longest").alias("n")).first()["n"]
    if longest is None:
        discard(found)
        return np.zeros((parts, 0, 1), np.int64)
    width = max(1, -(-longest // parts)) * parts
    whole = F.slice(F.concat("x", F.array_repeat(F.lit(0).cast("long"), width)), 1, width)
    least = found.groupBy("vec_id").agg(F.min(whole).alias("x")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    discard(found)
    x = _bounded(np.array([r["x"] for r in least], np.int64))
    return np.ascontiguousarray(x.reshape(len(x), parts, width // parts).transpose(1, 0, 2))


def moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: every entry at the componentwise floor of the mean of its parts; one without parts stays."""
    parts, entries, d = books.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums, counts = np.zeros((parts, entries, d), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, x, _ = _integers(batch.column(0), parts * d)
            x = _bounded(x).reshape(len(x), parts, d)
            for p in range(parts):
                code, _ = nearest(x[:, p], books[p])
                np.add.at(sums[p], code, x[:, p])
                counts[p] += np.bincount(code, minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            # Position d carries the count.
            total = np.concatenate([sums, counts[:, :, None]], axis=2)[part, entry]
            columns = [np.repeat(part, d + 1), np.repeat(entry, d + 1), np.tile(np.arange(d + 1), len(part)), total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "position", "total"])
        released()

    found = vectors.select("embedding").mapInArrow(run, "part long, entry long, position long, total long").groupBy("part", "entry", "position").agg(F.sum("total").alias("total"))
    total = np.zeros((parts, entries, d + 1), np.int64)
    for r in found.collect():
        total[r["part"], r["entry"], r["position"]] = r["total"]
    n = total[:, :, d:]
    return np.where(n > 0, total[:, :, :d] // np.maximum(n, 1), books)


def fitted(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after all rounds; when one round moves nothing the others would not either."""
    books = start_books(vectors, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        before, books = books, moved(vectors, books)
        if (before == books).all():
            break
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The kept rows with code (two hex digits a part, the entries' numbers) and error (squared distances summed over parts) instead of embedding."""
    parts, _, d = books.shape
    names = rows.columns
    code_name, error_name = fresh("code", names), fresh("error", names)
    others = [c for c in names if c != "embedding"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kept, x, _ = _integers(batch.column(names.index("embedding")), parts * d)
            x = _bounded(x).reshape(len(x), parts, d)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            text = codes.tobytes().hex()
            held = batch.take(pa.array(kept))
            columns = [held.column(names.index(c)) for c in others]
            columns += [pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(sum(e for _, e in found))]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, code_name, error_name])
        released()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "embedding")
    return rows.mapInArrow(run, f"{kinds}, {code_name} string, {error_name} long")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, lookup_labels: int = LOOKUP_LABELS) -> DataFrame:
    """vec_id, label, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256; vectors: vec_id, embedding, label."""
    if entries > 256:
        raise ValueError("a part's number has two hex digits: at most 256 entries")
    prepared(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", "embedding")
    books = fitted(rows.select("vec_id", "embedding"), parts, entries, rounds)
    if not books.shape[1]:
        empty = rows.where(F.lit(False))
        none = F.lit(0).cast("long")
        return empty.select("vec_id", "label", F.lit("").alias("code"), none.alias("error"), none.alias("label_error"), F.lit("").alias("codebooks_sha256"))
    found = written(encoded(rows, books), "codes")
    # Totals by label are summed within tasks first, so that a label may hold any share of the rows.
    totals = written(found.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    if totals.count() <= lookup_labels:
        totals = F.broadcast(totals)
    out = found.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rows in SQL for vectors of one length, a multiple of the number of parts, and distinct ids."""
    steps = [f"""WITH r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rn, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS xs
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS MATERIALIZED (SELECT rn, (i - 1) // (n // {parts}) AS part, (i - 1) % (n // {parts}) AS pos, x FROM (SELECT rn, len(xs) AS n, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM r)),
b0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, pos, x FROM v WHERE rn <= {entries})"""]  # fmt: skip
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT v.rn, v.part, entry, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS far FROM v JOIN b{k} b ON b.part = v.part AND b.pos = v.pos GROUP BY v.rn, v.part, entry),
a{k} AS MATERIALIZED (SELECT rn, part, entry, far FROM (SELECT *, row_number() OVER (PARTITION BY rn, part ORDER BY far, entry) AS k FROM d{k}) WHERE k = 1)""")  # fmt: skip
        if k < rounds:
            steps.append(f"""s{k} AS MATERIALIZED (SELECT v.part, entry, pos, sum(v.x)::BIGINT AS total, count(*) AS n FROM v JOIN a{k} a ON a.rn = v.rn AND a.part = v.part GROUP BY v.part, entry, pos),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CASE WHEN n IS NULL THEN b.x ELSE (total - ((total % n) + n) % n) // n END AS x FROM b{k} b LEFT JOIN s{k} s ON s.part = b.part AND s.entry = b.entry AND s.pos = b.pos)""")  # fmt: skip
    steps.append(f"""c AS (SELECT rn, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY rn),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN c USING (rn), h""")
    return ",\n".join(steps)
