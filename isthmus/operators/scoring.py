"""Scores of samples against prototypes.

Prototypes are few (classes times k): they are gathered on the driver, their size is
checked, and every Arrow batch of samples is scored against them by one
matrix product. A batch leaves as what is asked for: best prototypes, the two best scores for each class, or
counts that are summed before they are shuffled. Prototypes beyond the bound are scored in
blocks of that size, each broadcast by itself and scored in a pass of its own; top-k and top-2 results of blocks merge exactly.
The plan behind the prototypes runs once for each result: what takes prototypes also takes held() ones.
"""

from __future__ import annotations

import copy
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of prototype centres that are held in one block.
BLOCK_BYTES = 64 << 20
#: Scores are sums in any order: where a sample is given to a prototype, those that differ by less than this many digits are ties.
TIE_DIGITS = 12
PROTOTYPES = "pid int, class string, center array<double>, radius double, norm2 double"


@dataclass
class Block:
    """Prototypes in memory, ordered by class and id."""

    pid: np.ndarray
    classes: list[str]
    of: np.ndarray
    center: np.ndarray
    radius2: np.ndarray | None

    @classmethod
    def of_blocks(cls, parts: list[Block]) -> Block:
        """Several blocks in one."""
        classes = sorted({c for b in parts for c in b.classes})
        at = {c: i for i, c in enumerate(classes)}
        radius2 = None if parts[0].radius2 is None else np.concatenate([b.radius2 for b in parts])
        return cls(np.concatenate([b.pid for b in parts]), classes, np.concatenate([np.array([at[b.classes[i]] for i in b.of], dtype=np.int64) for b in parts]), np.concatenate([b.center for b in parts]), radius2)

    def only(self, classes: list[str]) -> Block:
        """The prototypes of some classes."""
        left = [i for i, c in enumerate(self.classes) if c in set(classes)]
        mine = np.isin(self.of, left)
        return Block(self.pid[mine], [self.classes[i] for i in left], np.searchsorted(left, self.of[mine]), self.center[mine], None if self.radius2 is None else self.radius2[mine])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """-d^2 to centres; 1 - d^2 / r^2 where prototypes are balls."""
        d2 = np.maximum((x**2).sum(axis=1)[:, None] + (self.center**2).sum(axis=1)[None, :] - 2 * x @ self.center.T, 0.0)
        return -d2 if self.radius2 is None else 1 - d2 / self.radius2[None, :]


def gathered(prototypes: DataFrame, block_bytes: int | None = None) -> Iterator[Block]:
    """The prototypes in blocks of whole classes, as far as block_bytes allows (a class is never split); the driver holds one block at a time."""
    limit = BLOCK_BYTES if block_bytes is None else block_bytes
    part: list = []
    size = 0
    for r in prototypes.select("pid", "class", "center", "radius").orderBy("pid").toLocalIterator():
        if size > limit and part[-1]["class"] != r["class"]:
            yield _block(part)
            part, size = [], 0
        part.append(r)
        size += 8 * len(r["center"])
    if part:
        yield _block(part)


def _block(part: list) -> Block:
    names = sorted({r["class"] for r in part})
    at = {c: i for i, c in enumerate(names)}
    radius = np.array([np.nan if r["radius"] is None else r["radius"] for r in part], dtype=float)
    return Block(np.array([r["pid"] for r in part]), names, np.array([at[r["class"]] for r in part]), np.array([r["center"] for r in part], dtype=float), None if np.isnan(radius).any() else radius**2)


class Held:
    """Prototypes as broadcast blocks."""

    def __init__(self, prototypes: DataFrame, block_bytes: int | None = None):
        context = prototypes.sparkSession.sparkContext
        self.blocks = [context.broadcast(b) for b in gathered(prototypes, block_bytes)]

    def only(self, classes: list[str]) -> Held:
        """The prototypes of some classes."""
        out = copy.copy(self)
        out.blocks = [SparkContext.getOrCreate().broadcast(b) for b in (x.value.only(classes) for x in self.blocks) if b.classes]
        return out

    def __len__(self) -> int:
        return len(self.blocks)


def held(prototypes: DataFrame | Held) -> Held:
    return prototypes if isinstance(prototypes, Held) else Held(prototypes)


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long arrays as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def by_batch(samples: DataFrame, prototypes: DataFrame | Held, columns: list[str], schema: str, emit: Callable) -> DataFrame:
    """emit(batch columns by name, features, block) -> dict of arrays, for every batch and every block."""

    def scorer(block):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                out = emit(dict(zip(columns, batch.columns[1:], strict=True)), matrix(batch.column(0)), block.value)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], names=list(out))

        return run

    parts = [samples.select("features", *columns).mapInArrow(scorer(b), schema) for b in held(prototypes).blocks]
    if not parts:
        return samples.sparkSession.createDataFrame([], schema)
    return functools.reduce(DataFrame.unionByName, parts)


def score_table(samples: DataFrame, prototypes: DataFrame) -> DataFrame:
    """row_id, pid, class, score of every sample against every prototype."""

    def emit(named, x, block):
        s = block.scores(x)
        n, p = s.shape
        return {"row_id": np.repeat(named["row_id"].to_numpy(), p), "pid": np.tile(block.pid, n).astype(np.int32), "class": np.tile(np.array(block.classes, dtype=object)[block.of], n), "score": s.ravel()}

    return by_batch(samples, prototypes, ["row_id"], "row_id long, pid int, class string, score double", emit)


def topk(samples: DataFrame, prototypes: DataFrame | Held, k: int, classes: list[str] | None = None) -> DataFrame:
    """row_id, rank (from 1), pid, score: the k best prototypes of each sample, of some classes only if given; ties go to the lower pid. k <= 0 gives no rows."""
    if classes is not None:
        prototypes = prototypes.only(classes) if isinstance(prototypes, Held) else prototypes.where(F.col("class").isin(*classes)) if classes else prototypes.limit(0)
    spark = samples.sparkSession
    if k <= 0:
        return spark.createDataFrame([], "row_id long, rank int, pid int, score double")
    prototypes = held(prototypes)

    def emit(named, x, block):
        s = block.scores(x)
        m = min(k, s.shape[1])
        best = np.lexsort((np.broadcast_to(block.pid, s.shape), -s), axis=1)[:, :m]
        return {"row_id": np.repeat(named["row_id"].to_numpy(), m), "rank": np.tile(np.arange(1, m + 1, dtype=np.int32), len(s)), "pid": block.pid[best].astype(np.int32).ravel(), "score": np.take_along_axis(s, best, axis=1).ravel()}

    out = by_batch(samples, prototypes, ["row_id"], "row_id long, rank int, pid int, score double", emit)
    if len(prototypes) < 2:
        return out
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "pid"))), 1, k)
    merged = out.groupBy("row_id").agg(best.alias("b")).select("row_id", F.posexplode("b").alias("i", "e"))
    return merged.select("row_id", (F.col("i") + 1).alias("rank"), F.col("e.pid").alias("pid"), (-F.col("e.s")).alias("score"))


def class_top2(samples: DataFrame, prototypes: DataFrame) -> DataFrame:
    """row_id, class, s1, p1, s2, p2: the two best prototypes of each class for each sample; s2 and p2 null where a class owns one only."""

    def emit(named, x, block):
        s = block.scores(x)
        n = len(s)
        cols = {k: [] for k in ("class", "s1", "p1", "s2", "p2")}
        for c, name in enumerate(block.classes):
            own = np.flatnonzero(block.of == c)
            best = np.lexsort((np.broadcast_to(block.pid[own], (n, len(own))), -s[:, own]), axis=1)
            cols["class"].append(np.full(n, name, dtype=object))
            for j in (0, 1):
                there = len(own) > j
                cols[f"s{j + 1}"].append(s[np.arange(n), own[best[:, j]]] if there else np.full(n, np.nan))
                cols[f"p{j + 1}"].append(block.pid[own[best[:, j]]].astype(float) if there else np.full(n, np.nan))
        import pyarrow as pa

        two = {k: np.stack(v, axis=1).ravel() for k, v in cols.items()}
        out = {"row_id": np.repeat(named["row_id"].to_numpy(), len(block.classes)), "class": two["class"]}
        for k in ("s1", "p1", "s2", "p2"):
            out[k] = pa.array(two[k], mask=np.isnan(two[k])).cast(pa.int32() if k[0] == "p" else pa.float64())
        return out

    return by_batch(samples, prototypes, ["row_id"], "row_id long, class string, s1 double, p1 int, s2 double, p2 int", emit)


def own_best(samples: DataFrame, prototypes: DataFrame | Held) -> DataFrame:
    """row_id, label, pid, score: each sample's best prototype of its own class; a label without prototypes raises."""
    prototypes = held(prototypes)
    known = [c for b in prototypes.blocks for c in b.value.classes]
    check_labels(samples, known)

    def emit(named, x, block):
        at = {c: i for i, c in enumerate(block.classes)}
        y = np.array([at.get(v, -1) for v in named["label"].to_pylist()])
        s = block.scores(x)
        own = np.where(block.of[None, :] == y[:, None], np.round(s, TIE_DIGITS), -np.inf)
        best = np.lexsort((np.broadcast_to(block.pid, s.shape), -own), axis=1)[:, 0]
        rows = np.flatnonzero(y >= 0)
        return {"row_id": named["row_id"].to_numpy()[rows], "label": np.array(named["label"].to_pylist(), dtype=object)[rows], "pid": block.pid[best[rows]].astype(np.int32), "score": s[rows, best[rows]]}

    return by_batch(samples, prototypes, ["row_id", "label"], "row_id long, label string, pid int, score double", emit)


def check_labels(samples: DataFrame, classes: list[str]) -> None:
    """ValueError if a sample's label owns no prototype."""
    have = {r["label"] for r in samples.select("label").distinct().collect()}
    missing = sorted(str(c) for c in have - set(classes))
    if missing:
        raise ValueError(f"class {missing[0]} has no prototypes")
