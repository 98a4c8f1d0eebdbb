"""Where intermediate tables go, and global row numbers."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is named and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="isthmus-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark's tables lie in."""
    jvm, context = spark._jvm, spark.sparkContext  # no public call deletes files
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables in the shared folder. Written and read again they cut the lineage, so that a lost executor costs one table's tasks; they are deleted together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def path(self, name: str) -> str:
        self.folders.append(f"{shared_root(self.spark)}/{name}-{uuid.uuid4().hex}")
        return self.folders[-1]

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self) -> None:
        while self.folders:
            deleted(self.spark, self.folders.pop())


def numbered(df: DataFrame, order: list[str], name: str = "n", scratch: Scratch | None = None) -> DataFrame:
    """The rows with their place, from 0, in the order of some columns that tell all rows apart.

    A range-partitioned sort; each task's rows are numbered by itself and shifted by what
    earlier tasks hold, so that no task takes the whole table. The sorted table belongs to the scratch given.
    """
    low = (1 << 33) - 1
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = (scratch or Scratch(df.sparkSession)).written(dealt, "numbered")
    part = F.shiftright("__at", 33).alias("part")
    sizes = sorted((r["part"], r["k"]) for r in dealt.groupBy(part).agg(F.count("*").alias("k")).collect())
    shift, total = [], 0
    for p, k in sizes:
        shift.append((p, total))
        total += k
    added = df.sparkSession.createDataFrame(shift or [(0, 0)], "part long, shift long")
    out = dealt.withColumn("part", F.shiftright("__at", 33)).join(F.broadcast(added), "part")
    return out.withColumn(name, F.col("__at").bitwiseAND(F.lit(low)) + F.col("shift")).drop("__at", "part", "shift")


#: Rows from which on quantiles are selected by counting between splitters instead of from one buffer of distinct values; both are exact. Values that the driver takes in the end; splitters of a bracket.
SORTED_QUANTILES, FETCHED, SPLITTERS = 1_000_000, 200_000, 63


def quantiles(values: DataFrame, probs: list[float], rows: int | None = None) -> dict:
    """Exact, linearly interpolated quantiles of column v for each value of column g; values: g, v."""
    if rows is None:
        rows = values.count()
    if rows < SORTED_QUANTILES:
        got = values.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()
        return {r["g"]: list(r["q"]) for r in got}
    # Written once: rounds read plain numbers, instead of working out the values again each time.
    scratch = Scratch(values.sparkSession)
    values = scratch.written(values.select("g", F.col("v").cast("double").alias("v")), "values")
    sizes = {r["g"]: r["k"] for r in values.groupBy("g").agg(F.count("*").alias("k")).collect()}
    ends = {g: [(math.floor(p * (k - 1)), math.ceil(p * (k - 1)), p * (k - 1)) for p in probs] for g, k in sizes.items()}
    found = selected(values, {g: {r for lo, hi, _ in e for r in (lo, hi)} for g, e in ends.items()}, sizes)
    scratch.discard()
    out: dict = {}
    for g, e in ends.items():
        out[g] = []
        for lo, hi, x in e:
            a, b = found[g, lo], found[g, hi]
            out[g].append(a if lo == hi or a == b else (hi - x) * a + (x - lo) * b)
    return out


def selected(values: DataFrame, ranks: dict, sizes: dict) -> dict:
    """(g, rank) to the value at that place, from 0, in the order of v among the rows of g; ranks: the places wanted of each g, sizes: its rows.

    A bracket is an open interval of values in which wanted places lie. Splitters taken from a sketch of
    a bracket's values cut it; counts between and at them tell in which part each place lies, and only that part is a
    bracket of the next round. Rounds read the table without shuffling it, and go on until few values are left in all brackets.
    """
    names = {g: i for i, g in enumerate(sizes)}
    found: dict = {}
    # Group number to brackets in order: low, high, rows before it, rows in it, wanted places.
    brackets = {names[g]: [(-math.inf, math.inf, 0, sizes[g], sorted(r))] for g, r in ranks.items() if r}
    back = {i: g for g, i in names.items()}
    while brackets:
        left = sum(n for bs in brackets.values() for _, _, _, n, _ in bs)
        inside = values.select("g", F.col("v").cast("double").alias("v")).mapInArrow(_inside(names, {i: ([b[0] for b in bs], [b[1] for b in bs]) for i, bs in brackets.items()}), "i int, k int, v double")
        if left <= FETCHED:
            table = inside.toArrow()
            i, k, v = (table.column(c).to_numpy() for c in range(3))
            order = np.lexsort((v, k, i))
            i, k, v = i[order], k[order], v[order]
            for g, bs in brackets.items():
                for at, (_, _, base, _, wanted) in enumerate(bs):
                    mine = v[(i == g) & (k == at)]
                    found |= {(back[g], r): float(mine[r - base]) for r in wanted}
            break
        marks = [(j + 1) / (SPLITTERS + 1) for j in range(SPLITTERS)]
        sketch = inside.groupBy("i", "k").agg(F.percentile_approx("v", F.array(*map(F.lit, marks)), F.lit(1000)).alias("s")).collect()
        cuts: dict[int, list] = {}
        for r in sketch:
            cuts.setdefault(r["i"], []).extend(r["s"])
        # A bracket's ends cut too: a place behind its last splitter would else fall into all that lies up to the next bracket's first one.
        for i, bs in brackets.items():
            cuts[i] += [end for b in bs for end in b[:2] if math.isfinite(end)]
        cuts_of = {i: np.unique(np.array(c)) for i, c in cuts.items()}
        counted = values.select("g", F.col("v").cast("double").alias("v")).mapInArrow(_cells(names, cuts_of), "i int, cell int, n long").groupBy("i", "cell").agg(F.sum("n").alias("n")).collect()
        counts = {i: np.zeros(2 * len(c) + 1, np.int64) for i, c in cuts_of.items()}
        for r in counted:
            counts[r["i"]][r["cell"]] = r["n"]
        following: dict[int, list] = {}
        for i, bs in brackets.items():
            edge = np.concatenate([[-math.inf], cuts_of[i], [math.inf]])
            upto = np.concatenate([[0], np.cumsum(counts[i])])
            cells: dict[int, list] = {}
            for *_, wanted in bs:
                for r in wanted:
                    cell = int(np.searchsorted(upto, r, "right")) - 1
                    if cell % 2:  # at a splitter
                        found[back[i], r] = float(cuts_of[i][cell // 2])
                    else:
                        cells.setdefault(cell, []).append(r)
            following[i] = [(float(edge[c // 2]), float(edge[c // 2 + 1]), int(upto[c]), int(counts[i][c]), r) for c, r in sorted(cells.items())]
        brackets = {i: bs for i, bs in following.items() if bs}
    return found


def _by_group(batch, names: dict):
    """Group number and values of the rows of each group in a batch."""
    coded = batch.column(0).dictionary_encode()
    at, v = coded.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    for j, g in enumerate(coded.dictionary.to_pylist()):
        if g in names:
            yield names[g], v[at == j]


def _inside(names: dict, bounds: dict[int, tuple[list, list]]):
    """The values within the brackets of their groups, with the bracket's number."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, v in _by_group(batch, names):
                if i in bounds:
                    low, high = (np.array(b) for b in bounds[i])
                    k = np.searchsorted(low, v, "left") - 1  # the last bracket that begins below the value
                    some = (k >= 0) & (v < high[np.maximum(k, 0)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), i, np.int32)), pa.array(k[some].astype(np.int32)), pa.array(v[some])], names=["i", "k", "v"])

    return run


def _cells(names: dict, cuts: dict[int, np.ndarray]):
    """How many values lie between the cuts of their group (even cells) and at them (odd ones)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in _by_group(batch, names):
                if i in cuts:
                    at = np.searchsorted(cuts[i], v, "left")
                    here = np.minimum(at, len(cuts[i]) - 1)
                    cell = 2 * at + (cuts[i][here] == v)
                    total[i] = total.get(i, 0) + np.bincount(cell, minlength=2 * len(cuts[i]) + 1)
        for i, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["i", "cell", "n"])

    return run
