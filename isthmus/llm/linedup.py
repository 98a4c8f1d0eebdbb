"""Line dedup: repeated runs of lines by a suffix array over line ids, sorted by distributed prefix doubling.

A suffix is a place: a document, in corpus order, and a line. Its rank to depth 1 is its line's place among the
sorted lines; ranks to depth k give those to depth 2k, by ranking the pairs (rank at the place, rank k lines
further on) within each rank. Ranking is a range-partitioned sort of distinct pairs with running counts, so no key's
suffixes meet in one task. A suffix whose next 2k lines nobody shares has found its place and leaves (its place ranks it from then on); doubling goes on
until all have. The common prefix of neighbours in the suffix array follows from the ranks of all depths, the deepest
first. Neighbours whose common prefix is long enough form intervals: the first place of an interval in the corpus keeps its
lines, the later ones lose theirs. Overlapping runs unite into maximal ones.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import besides, discard, fresh, prepared, released, texts_of, written
from .imatch import chunks

MIN_LINES, MIN_BYTES = 2, 200
PLACE = ["doc_id", "th", "line"]
#: A place is one number: the document's number in the corpus, and this many bits for the line.
LINE_BITS = 29


def line_table(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, th (hash of the text), line, h1, h2 (128 bits that name the line), long (whether it has min_bytes bytes) of every line."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts, th = texts_of(batch.column(1)), batch.column(2)
            for a, b in chunks(texts):
                split = [t.split(b"\n") for t in texts[a:b]]
                flat = list(itertools.chain.from_iterable(split))
                n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
                size = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
                names = np.frombuffer(b"".join(map(digest, flat)), dtype="<i8").reshape(-1, 2)
                doc = np.repeat(np.arange(a, b), n)
                line = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), th.take(pa.array(doc)), pa.array(line), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(size >= min_bytes)], names=["doc_id", "th", "line", "h1", "h2", "long"])
        released()

    prepared(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(run, "doc_id long, th long, line long, h1 long, h2 long, long boolean")


def running(df: DataFrame, order: list[str], sums: list[str], table: str) -> DataFrame:
    """The rows of df (longs only) with, for each column c of `sums`, before_c: the sum of c over all rows that come earlier by `order`, whose columns tell all rows apart. A range-partitioned sort; each task adds up its own rows, and what earlier tasks hold is added after."""
    names, m = df.columns, len(sums)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), np.zeros(m, dtype=np.int64)
        for batch in batches:
            values = [batch.column(batch.schema.names.index(c)).to_numpy() for c in sums]
            upto = [np.cumsum(v) + t for v, t in zip(values, total, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(u - v) for u, v in zip(upto, values, strict=True)), *(pa.array(u) for u in upto), pa.array(np.full(batch.num_rows, part))], names=[*names, *(f"before_{c}" for c in sums), *(f"upto_{c}" for c in sums), "part"])
            if batch.num_rows:
                total = np.array([u[-1] for u in upto])

    kinds = ", ".join(f"{c} long" for c in [*names, *(f"before_{c}" for c in sums), *(f"upto_{c}" for c in sums), "part"])
    dealt = written(df.select(*(F.col(c).cast("long").alias(c) for c in names)).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, kinds), table)
    # One row for each task: what earlier tasks hold.
    totals = sorted((tuple(r) for r in dealt.groupBy("part").agg(*(F.max(f"upto_{c}") for c in sums)).collect()), key=lambda r: r[0])
    shift, at = [], [0] * m
    for part, *t in totals:
        shift.append((part, *at))
        at = [a + b for a, b in zip(at, t, strict=True)]
    added = df.sparkSession.createDataFrame(shift or [(0, *at)], "part long, " + ", ".join(f"shift_{c} long" for c in sums))
    out = dealt.join(F.broadcast(added), "part").select(*names, *((F.col(f"before_{c}") + F.col(f"shift_{c}")).alias(f"before_{c}") for c in sums))
    out.written_path = dealt.written_path
    return out


def ranked(keys: DataFrame, names: list[str], table: str) -> DataFrame:
    """The columns `names` of distinct keys with rank: how many suffixes (column n of keys) have a lesser key."""
    out = running(keys.select(*names, "n"), names, ["n"], table)
    ranks = out.select(*names, F.col("before_n").alias("rank"))
    ranks.written_path = out.written_path
    return ranks


def refined(rows: DataFrame, depth: int) -> DataFrame:
    """pos, rank, depth, many (whether other rows have its key), more (many, and not closed) of rows (own, next, closed, pos): the keys (own, next) ranked within each own, whose rows keep their places as a whole.

    One range-partitioned sort of the rows, in which a key may spread over several tasks. Each task reads its rows once, in
    order; the driver holds a row for each task, which says how its first and last keys go on in its neighbours. is_open of the result: whether any row has more.
    """
    names = ["own", "next", "closed", "pos"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, at, start = TaskContext.get().partitionId(), 0, [0, 0]  # place of the first row not yet given out; first places of its own and its key
        before, held = None, None

        def given(cols: list[np.ndarray], n: int):
            """The first n rows; a row after them, if any, is only looked at."""
            nonlocal at, start, before
            own, key = cols[0], cols[1]
            new_own, new_key = np.ones(len(own), dtype=bool), np.ones(len(own), dtype=bool)
            new_own[1:] = own[1:] != own[:-1]
            new_key[1:] = new_own[1:] | (key[1:] != key[:-1])
            if before is not None:
                new_own[0] = own[0] != before[0]
                new_key[0] = new_own[0] or key[0] != before[1]
            place = at + np.arange(n)
            firsts = [np.maximum.accumulate(np.where(new[:n], place, s)) for new, s in zip((new_own, new_key), start, strict=True)]
            twin = ~new_key[:n]
            follows = np.append(~new_key[1:], False)[:n]
            out = [*(c[:n] for c in cols), np.full(n, part), *firsts, twin | follows]
            before, at, start = (own[n - 1], key[n - 1]), at + n, [int(f[-1]) for f in firsts]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[*names, "part", "own_at", "key_at", "twin"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            if len(cols[0]) > 1:
                yield given(cols, len(cols[0]) - 1)
            held = [c[-1:] for c in cols] if len(cols[0]) else held
        if held is not None and len(held[0]):
            yield given(held, 1)

    order = ["own", "next", "pos"]
    dealt = rows.select(*(F.col(c).cast("long").alias(c) for c in names)).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "part", "own_at", "key_at"]) + ", twin boolean"), "dealt")
    key = F.struct("own", "next", "own_at", "key_at", "closed")
    open_ = F.count_if(F.col("twin") & (F.col("closed") == 0)).alias("open")
    tasks = sorted(dealt.groupBy("part").agg(F.count("*").alias("n"), open_, F.min(key).alias("first"), F.max(key).alias("last")).collect(), key=lambda r: r["part"])
    same = lambda a, b: (a["own"], a["next"]) == (b["own"], b["next"])
    shift, edges = 0, []
    for i, r in enumerate(tasks):
        old = tasks[i - 1]["last"] if i else None
        goes_on = old is not None and old["own"] == r["first"]["own"], old is not None and same(old, r["first"])
        # Where the first own and the first key of this task begin in the whole table.
        heads = [begins[j] if goes_on[j] else shift for j in (0, 1)] if i else [0, 0]
        further = i + 1 < len(tasks) and same(r["last"], tasks[i + 1]["first"])
        edges.append((r["part"], shift, *heads, goes_on[1], r["last"]["key_at"] if further else -1))
        begins = [heads[j] if r["last"][c] == 0 else shift + r["last"][c] for j, c in enumerate(("own_at", "key_at"))]
        shift += r["n"]
    edges = rows.sparkSession.createDataFrame(edges, "part long, shift long, own_head long, key_head long, from_before boolean, tail long")
    whole = lambda c, head: F.when(F.col(c) == 0, F.col(head)).otherwise(F.col(c) + F.col("shift"))
    many = F.col("twin") | ((F.col("key_at") == 0) & F.col("from_before")) | (F.col("key_at") == F.col("tail"))
    out = dealt.join(F.broadcast(edges), "part").select("pos", (F.col("own") + whole("key_at", "key_head") - whole("own_at", "own_head")).alias("rank"), F.lit(depth).alias("depth"), many.alias("many"), (many & (F.col("closed") == 0)).alias("more"))
    out = written(out, "found")
    discard(dealt)
    out.is_open = any(r["open"] for r in tasks) or any(same(a["last"], b["first"]) and not b["first"]["closed"] for a, b in itertools.pairwise(tasks))
    return out


class SuffixArray:
    """The suffixes whose first line occurs at several places.

    documents: number, doc_id, th of the documents that have any, numbered in corpus order. suffixes: pos (document
    number and line in one), long, place (its place in the suffix array; equal suffixes share one), depth (the last one at which it was shared). depths: pos and rank
    of the suffixes whose first k lines occur at several places, for k = 1, 2, 4 ... as far as there are any.
    """

    def __init__(self, lines: DataFrame):
        keys = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
        first = ranked(keys, ["h1", "h2"], "ranks")
        shared = written(lines.join(first, ["h1", "h2"]).select(*PLACE, "rank", "long"), "shared")
        docs = shared.select("doc_id", "th").distinct().withColumn("one", F.lit(1))
        last = F.col("doc_id").isNull().cast("long").alias("last")
        order = running(docs.select(last, F.coalesce("doc_id", F.lit(0)).alias("own"), "th", "one"), ["last", "own", "th"], ["one"], "documents")
        self.documents = order.select(F.col("before_one").alias("number"), F.when(F.col("last") == 0, F.col("own")).alias("doc_id"), "th")
        same = F.col("s.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("s.th") == F.col("d.th"))
        pos = (F.shiftleft(F.col("d.number"), LINE_BITS) + F.col("s.line")).alias("pos")
        suffixes = written(shared.alias("s").join(self.documents.alias("d"), same).select(pos, "s.rank", "s.long"), "suffixes")
        discard(first, shared)
        self._tables, self.depths = [order, suffixes], [(1, suffixes.select("pos", "rank"))]
        depth, now = 1, suffixes.select("pos", "rank")
        paths, placed = [], None
        while True:
            # The ranks of all suffixes; whoever has left stands by its place. closed: others have the same place, but share no more than they are known to.
            ranks = now.select("pos", F.col("rank").alias("next"), F.lit(False).alias("closed"))
            if placed is not None:
                ranks = ranks.unionByName(placed.select("pos", F.col("rank").alias("next"), F.col("many").alias("closed")))
            ahead = ranks.select((F.col("pos") - depth).alias("pos"), "next", "closed")
            # -1: what follows occurs nowhere else, or the document ends.
            pairs = now.join(ahead.hint("merge"), "pos", "left").select(F.col("rank").alias("own"), F.coalesce("next", F.lit(-1)).alias("next"), F.coalesce("closed", F.lit(True)).alias("closed"), "pos")
            found = refined(pairs, depth)
            self._tables.append(found)
            # One read of all rounds' tables, so that the plan doesn't grow with them.
            paths.append(found.written_path)
            placed = lines.sparkSession.read.schema(found.schema).parquet(*paths).where("not more")
            now = found.where("more").select("pos", "rank")
            if not found.is_open:
                break
            depth *= 2
            self.depths.append((depth, now))
        self.suffixes = written(placed.select("pos", F.col("rank").alias("place"), "depth").join(suffixes.select("pos", "long").hint("merge"), "pos"), "placed")

    def neighbours(self, upto: int | None = None) -> DataFrame:
        """n (from 0 in the order of the suffix array), pos, long, common (how many first lines it shares with the suffix before it) of every suffix. upto: common prefixes are told apart up to so many lines only; beyond, common may be less than it is, but not less than upto."""
        depths = [d for d in self.depths if upto is None or d[0] <= upto]
        rows = running(self.suffixes.select("place", "pos", F.col("long").cast("long").alias("long"), "depth", F.lit(1).alias("one")), ["place", "pos"], ["one"], "array")
        ordered = rows.select(F.col("before_one").alias("n"), "pos", "long", "depth")
        before = ordered.select((F.col("n") + 1).alias("n"), F.col("pos").alias("other"), F.col("depth").alias("other_depth"))
        # Two suffixes share a rank at most up to the depth at which the first of them leaves.
        pairs = ordered.join(before.hint("merge"), "n", "left").select("n", "pos", "long", "other", F.least("depth", F.coalesce("other_depth", F.lit(0)), F.lit(depths[-1][0])).alias("depth"))
        pairs = written(pairs.withColumn("common", F.lit(0).cast("long")), "pairs")
        discard(rows)
        done = pairs.limit(0)
        for depth, ranks in reversed(depths):
            here = pairs.where(F.col("depth") == depth).unionByName(done)
            one = ranks.select(F.col("pos").alias("at_one"), F.col("rank").alias("rank_one")).hint("merge")
            two = ranks.select(F.col("pos").alias("at_two"), F.col("rank").alias("rank_two")).hint("merge")
            here = here.join(one, F.col("pos") + F.col("common") == F.col("at_one"), "left").join(two, F.col("other") + F.col("common") == F.col("at_two"), "left")
            equal = F.coalesce(F.col("rank_one") == F.col("rank_two"), F.lit(False))
            here = here.select("n", "pos", "long", "other", "depth", F.when(equal, F.col("common") + depth).otherwise(F.col("common")).alias("common"))
            old, done = done, written(here, "common")
            if hasattr(old, "written_path"):
                discard(old)
        first = pairs.where(F.col("depth") == 0)
        out = written(first.unionByName(done).select("n", "pos", "long", "common"), "neighbours")
        discard(pairs, done, self.suffixes, *self._tables[1:])
        return out

    def drop(self) -> None:
        discard(self._tables[0])


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, th, runs (struct of line and n): for each document, which lines begin a later copy, and of how many lines."""
    lines = written(line_table(docs, min_bytes), "lines")
    # Rows with equal id and text are one document.
    if lines.where("line = 0").groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        lines = written(lines.dropDuplicates(PLACE), "lines")
    array = SuffixArray(lines)
    discard(lines)
    rows = array.neighbours(min_lines)
    # An interval ends where the common prefix is too short: of min_lines lines, and of one line where that is long.
    ends = rows.select("n", "pos", "long", (F.col("common") < min_lines).cast("long").alias("many"), (F.col("common") < 1).cast("long").alias("one"))
    cut = running(ends, ["n"], ["many", "one"], "intervals")
    cut = cut.select("pos", "long", (F.col("before_many") + F.col("many")).alias("many"), (F.col("before_one") + F.col("one")).alias("one"))

    def later(of: DataFrame, key: str, n: int) -> DataFrame:
        first = of.groupBy(key).agg(F.min("pos").alias("first"), F.count("*").alias("k")).where("k > 1").select(key, "first")
        return of.join(first, key).where("pos > first").select("pos", F.lit(n).cast("long").alias("n"))

    found = later(cut, "many", min_lines)
    if min_lines > 1:
        found = found.unionByName(later(cut.where("long = 1"), "one", 1))
    line = F.col("pos").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).alias("line")
    by = found.groupBy(F.shiftright("pos", LINE_BITS).alias("number")).agg(F.collect_list(F.struct(line, "n")).alias("runs"))
    out = written(by.join(array.documents, "number").select("doc_id", "th", "runs"), "copies")
    discard(rows)
    array.drop()
    return out


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """All columns of docs with kept (the text without later copies), n_lines, n_removed and n_runs; such columns of docs are replaced.

    A line is what line feeds separate; every text has at least one, also an empty or null
    one. A line goes if it lies in min_lines consecutive lines of its document that
    also start earlier: at a smaller doc_id (null last, equal ids by hash of the text), or
    further up in the same document; a line of min_bytes UTF-8 bytes or more also by itself. All is judged on the input. Rows with equal doc_id and text are one
    document and fare alike. kept is null if no line is left; else the lines kept,
    joined by line feeds. An empty table gives no rows.
    """
    prepared(docs.sparkSession)
    keep = besides(docs.columns, "kept", "n_lines", "n_removed", "n_runs")
    docs = docs.select(*keep)
    cut = later_copies(docs, min_lines, min_bytes)
    # The row as one column, so that no name of its columns meets another.
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), th.alias("th")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.th") == F.col("c.th"))
    # Texts are merged with the marks at every size, so that what is shuffled stays in proportion to the input.
    both = rows.join(cut.hint("merge").alias("c"), same, "left").select("row.*", F.col("c.runs").alias(fresh("runs", keep)))
    at = keep.index("text")
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    new = [StructField("kept", StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType()), StructField("n_runs", LongType())]
    schema = StructType([*docs.schema.fields, *new])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kept, counts = [], []
            for text, runs in zip(batch.column(at).to_pylist(), batch.column(len(keep)).to_pylist(), strict=True):
                if not runs:
                    kept.append(text or "")
                    counts.append((kept[-1].count("\n") + 1, 0, 0))
                    continue
                lines = (text or "").split("\n")
                gone = np.zeros(len(lines) + 1, dtype=np.int64)
                first, n = (np.array([r[c] for r in runs]) for c in ("line", "n"))
                np.add.at(gone, first, 1)
                np.add.at(gone, first + n, -1)
                mask = np.cumsum(gone)[: len(lines)] > 0
                left = [x for x, g in zip(lines, mask.tolist(), strict=True) if not g]
                kept.append("\n".join(left) if left else None)
                counts.append((len(lines), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.view(np.int8)])) == 1).sum())))
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(kept, pa.string()), *cols], names=[*keep, *(f.name for f in new)])
        released()

    return both.mapInArrow(run, schema)
