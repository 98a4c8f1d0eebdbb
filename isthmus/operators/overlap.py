"""The discrete separability index: how often a class's samples score better for another class than for their own second prototype.

A sample of class y overlaps with class b if b's best score exceeds the second-best score of y's
prototypes, or y owns one prototype only. Equal scores are no overlap.
Counters are integers and additive; ratios come last.
"""

from __future__ import annotations

import bisect
import functools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scoring import Block, Held, by_batch, class_top2, held, matrix

COUNTS = "y string, b string, adj long, cardinality long"


def support(samples: DataFrame) -> DataFrame:
    """label, support, first_ord."""
    return samples.groupBy("label").agg(F.count("*").alias("support"), F.min("ord").alias("first_ord"))


def best_two(block: Block, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best and second-best score of each class for each row; -inf where a class has no second."""
    one, two = np.full((len(s), len(block.classes)), -np.inf), np.full((len(s), len(block.classes)), -np.inf)
    for c in range(len(block.classes)):
        own = s[:, block.of == c]
        if own.shape[1] > 1:
            top = np.partition(own, -2, axis=1)[:, -2:]
            one[:, c], two[:, c] = top[:, 1], top[:, 0]
        else:
            one[:, c] = own[:, 0]
    return one, two


def _pairs(classes: list[str], adj: np.ndarray, n: np.ndarray) -> dict:
    y, b = np.nonzero(n > 0)
    keep = y != b
    y, b = y[keep], b[keep]
    names = np.array(classes, dtype=object)
    return {"y": names[y], "b": names[b], "adj": adj[y, b].astype(np.int64), "cardinality": n[y, b].astype(np.int64)}


def summed(counts: DataFrame) -> DataFrame:
    """y, b, adj, cardinality, pairwise_index of any number of counter tables put together."""
    out = counts.groupBy("y", "b").agg(F.sum("adj").alias("adj"), F.sum("cardinality").alias("cardinality"))
    return out.withColumn("pairwise_index", 1 - F.col("adj") / F.col("cardinality"))


def pairwise(samples: DataFrame, prototypes: DataFrame | Held) -> DataFrame:
    """Directed pairwise indices of samples with one label each. With all prototypes in one block a batch of samples leaves as C x C counters; else the two best scores by class are joined."""
    prototypes = held(prototypes)
    if len(prototypes) <= 1:

        def emit(named, x, block):
            c = len(block.classes)
            at = {v: i for i, v in enumerate(block.classes)}
            y = np.array([at.get(v, -1) for v in named["label"].to_pylist()])
            x, y = x[y >= 0], y[y >= 0]
            one, two = best_two(block, block.scores(x))
            over = one > two[np.arange(len(y)), y][:, None]
            adj, n = np.zeros((c, c)), np.zeros((c, c))
            np.add.at(adj, y, over)
            np.add.at(n, y, 1)
            return _pairs(block.classes, adj, n)

        return summed(by_batch(samples, prototypes, ["label"], COUNTS, emit))
    top = class_top2(samples, prototypes)
    own = samples.select("row_id", F.col("label").alias("y")).join(top.select("row_id", F.col("class").alias("y"), F.col("s2")), ["row_id", "y"])
    other = top.select("row_id", F.col("class").alias("b"), "s1")
    both = own.join(other, "row_id").where("y <> b")
    hit = F.col("s2").isNull() | (F.col("s1") > F.col("s2"))
    return summed(both.groupBy("y", "b").agg(F.count_if(hit).alias("adj"), F.count("*").alias("cardinality")))


#: Scores that are worked on at once.
AT_ONCE = 1 << 22


def _bounds(block: Block, x: np.ndarray, row: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Second-best score of class own[i] for row row[i]; -inf where the class has no second prototype."""
    out = np.full(len(row), -np.inf)
    starts = np.searchsorted(block.of, np.arange(len(block.classes) + 1))
    for c in np.unique(own).tolist():
        a, b = starts[c], starts[c + 1]
        if b - a > 1:
            mine = np.flatnonzero(own == c)
            part = Block(block.pid[a:b], [block.classes[c]], block.of[a:b] - c, block.center[a:b], None if block.radius2 is None else block.radius2[a:b])
            out[mine] = np.partition(part.scores(x[row[mine]]), -2, axis=1)[:, -2]
    return out


def multilabel_overlaps(samples: DataFrame, prototypes: DataFrame | Held) -> DataFrame:
    """y, b, adj: of the rows with y and without b those in which b's best score exceeds y's second best, for the pairs that have any and for classes y of two prototypes or more. samples: row_id, features, labels.

    A row carries its labels as a list with their bounds. A class is looked at again only where it scores above the
    least of them, and a row not at all if none of its classes has a bound, so that work and memory follow the labels
    that rows have, not the classes there are. With several blocks of prototypes the bounds come first, from the
    blocks that hold the row's classes.
    """
    prototypes = held(prototypes)
    spark = samples.sparkSession

    def listed(labels: list, at: dict) -> tuple[np.ndarray, np.ndarray]:
        """Row and class of every label that the block knows."""
        pairs = [(i, at[v]) for i, row in enumerate(labels) for v in dict.fromkeys(row) if v in at]
        return tuple(np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2

    def bounds(named, x, block):
        at = {c: i for i, c in enumerate(block.classes)}
        row, own = listed(named["labels"].to_pylist(), at)
        bound = _bounds(block, x, row, own)
        some = np.isfinite(bound)
        if not some.any():
            return None
        return {"row_id": named["row_id"].to_numpy()[row[some]], "y": np.array(block.classes, dtype=object)[own[some]], "bound": bound[some]}

    def counted(held_block, one: bool):
        def run(batches):
            import pyarrow as pa

            block = held_block.value
            at = {c: i for i, c in enumerate(block.classes)}
            starts = np.searchsorted(block.of, np.arange(len(block.classes)))
            total: dict[tuple[str, int], int] = {}
            for batch in batches:
                x, labels = matrix(batch.column(0)), batch.column(1).to_pylist()
                if one:
                    row, own = listed(labels, at)
                    bound, names = _bounds(block, x, row, own), [block.classes[i] for i in own.tolist()]
                else:
                    lists = batch.column(2).to_pylist()
                    row = np.array([i for i, r in enumerate(lists) for _ in r], dtype=np.int64)
                    bound, names = np.array([e["bound"] for r in lists for e in r], dtype=float), [e["y"] for r in lists for e in r]
                some = np.flatnonzero(np.isfinite(bound))
                row, bound, names = row[some], bound[some], np.array(names, dtype=object)[some]
                rows, place = np.unique(row, return_inverse=True)
                step = max(1, AT_ONCE // len(block.pid))
                for a in range(0, len(rows), step):
                    here = rows[a : a + step]
                    best = np.maximum.reduceat(block.scores(x[here]), starts, axis=1)
                    for k, i in enumerate(here.tolist()):  # a class that the row carries is no other
                        best[k, [at[v] for v in labels[i] if v in at]] = -np.inf
                    mine = np.flatnonzero((place >= a) & (place < a + step))
                    least = np.full(len(here), np.inf)
                    np.minimum.at(least, place[mine] - a, bound[mine])
                    r, b = np.nonzero(best > least[:, None])
                    # Every class above a row's least bound, against each of the row's bounds.
                    order = mine[np.argsort(place[mine], kind="stable")]
                    first = np.searchsorted(place[order], a + np.arange(len(here) + 1))
                    n = np.diff(first)[r]
                    e = order[np.repeat(first[r] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    b, score = np.repeat(b, n), np.repeat(best[r, b], n)
                    over = score > bound[e]
                    for y, c in zip(names[e[over]].tolist(), b[over].tolist(), strict=True):
                        total[y, c] = total.get((y, c), 0) + 1
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in keys], pa.string()), pa.array([block.classes[c] for _, c in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["y", "b", "adj"])

        return run

    if not len(prototypes):
        return spark.createDataFrame([], "y string, b string, adj long")
    rows, one = samples.select("features", "labels"), len(prototypes) == 1
    if not one:
        found = by_batch(samples, prototypes, ["row_id", "labels"], "row_id long, y string, bound double", bounds)
        lists = found.groupBy("row_id").agg(F.collect_list(F.struct("y", "bound")).alias("bounds"))
        rows = samples.join(lists, "row_id").select("features", "labels", "bounds")
    parts = [rows.mapInArrow(counted(b, one), "y string, b string, adj long") for b in prototypes.blocks]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("y", "b").agg(F.sum("adj").alias("adj"))


def label_supports(samples: DataFrame, prototypes: DataFrame | Held) -> tuple[DataFrame, DataFrame]:
    """y, n, few (whether y owns one prototype only) of the classes that own prototypes; and y, b, both: rows that carry two of them. samples: row_id, labels. Pairs are those within rows."""
    prototypes = held(prototypes)
    spark = samples.sparkSession
    size = [(c, bool(n == 1)) for block in prototypes.blocks for c, n in zip(block.value.classes, np.bincount(block.value.of).tolist(), strict=True)]
    owned = spark.createDataFrame(size, "y string, few boolean")
    # Sets, as a label counts once.
    rows = samples.select(F.array_distinct("labels").alias("labels"))
    support = rows.select(F.explode("labels").alias("y")).groupBy("y").agg(F.count("*").alias("n")).join(owned, "y")
    pairs = rows.where(F.size("labels") > 1).select("labels", F.explode("labels").alias("y")).select("y", F.explode("labels").alias("b")).where("y <> b")
    return support, pairs.groupBy("y", "b").agg(F.count("*").alias("both"))


def multilabel_counts(samples: DataFrame, prototypes: DataFrame | Held) -> DataFrame:
    """y, b, adj, cardinality, pairwise_index over the rows that carry y and not b, for all pairs of classes that have such rows; samples: row_id, features, labels. The cardinality is y's support less the rows with both."""
    prototypes = held(prototypes)
    support, both = label_supports(samples, prototypes)
    classes = sorted(c for b in prototypes.blocks for c in b.value.classes)
    if not classes:
        return samples.sparkSession.createDataFrame([], f"{COUNTS}, pairwise_index double")
    pairs = support.select("y", "n", "few", F.explode(F.array(*map(F.lit, classes))).alias("b")).where("y <> b")
    full = pairs.join(both, ["y", "b"], "left").join(multilabel_overlaps(samples, prototypes), ["y", "b"], "left")
    n = F.col("n") - F.coalesce("both", F.lit(0))
    return summed(full.select("y", "b", F.when(F.col("few"), n).otherwise(F.coalesce("adj", F.lit(0))).alias("adj"), n.alias("cardinality")).where("cardinality > 0"))


def multilabel_singletons(samples: DataFrame, prototypes: DataFrame | Held) -> DataFrame:
    """y, support, singleton_index as singleton() gives from all pairs, without the table of all pairs of classes: a pair without overlap has index 1, and the least index is over those with one."""
    prototypes = held(prototypes)
    support, both = label_supports(samples, prototypes)
    over = multilabel_overlaps(samples, prototypes).join(support.select("y", "n"), "y").join(both, ["y", "b"], "left")
    low = over.groupBy("y").agg(F.min(1 - F.col("adj") / (F.col("n") - F.coalesce("both", F.lit(0)))).alias("m"))
    # With one prototype all rows overlap with any class that they don't all carry.
    classes = sum(len(b.value.classes) for b in prototypes.blocks)
    always = both.join(support, "y").where(F.col("both") == F.col("n")).groupBy("y").agg(F.count("*").alias("same"))
    out = support.join(low, "y", "left").join(always, "y", "left")
    value = F.when(F.col("few"), F.when(F.coalesce("same", F.lit(0)) < classes - 1, 0.0).otherwise(1.0)).otherwise(F.coalesce("m", F.lit(1.0)))
    return out.select("y", F.col("n").alias("support"), value.alias("singleton_index"))


def replayed(samples: DataFrame, prototypes: DataFrame | Held, first_seen: dict[int, int]) -> DataFrame:
    """pairwise() where a sample sees only the prototypes first assigned up to its own place in the order; the cardinality is the class's whole support. Samples whose label owns no prototype are left out."""
    prototypes = held(prototypes)
    seen = samples.sparkSession.sparkContext.broadcast(first_seen)

    def visible(named, x, block):
        first = np.array([seen.value[int(p)] for p in block.pid])
        return best_two(block, np.where(first[None, :] <= named["ord"].to_numpy()[:, None], block.scores(x), -np.inf))

    if len(prototypes) <= 1:

        def emit(named, x, block):
            c = len(block.classes)
            at = {v: i for i, v in enumerate(block.classes)}
            y = np.array([at.get(v, -1) for v in named["label"].to_pylist()])
            one, two = visible(named, x, block)
            known = y >= 0
            y, one, two = y[known], one[known], two[known]
            over = (one > two[np.arange(len(y)), y][:, None]) & np.isfinite(one)
            adj, n = np.zeros((c, c)), np.zeros((c, c))
            np.add.at(adj, y, over)
            np.add.at(n, y, 1)
            return _pairs(block.classes, adj, n)

        return summed(by_batch(samples, prototypes, ["label", "ord"], COUNTS, emit))

    def emit_two(named, x, block):
        import pyarrow as pa

        one, two = visible(named, x, block)
        c = len(block.classes)
        out = {"row_id": np.repeat(named["row_id"].to_numpy(), c), "label": np.repeat(np.array(named["label"].to_pylist(), dtype=object), c), "class": np.tile(np.array(block.classes, dtype=object), len(one))}
        return out | {n: pa.array(v.ravel(), mask=~np.isfinite(v.ravel())) for n, v in (("s1", one), ("s2", two))}

    top = by_batch(samples, prototypes, ["row_id", "label", "ord"], "row_id long, label string, class string, s1 double, s2 double", emit_two)
    own = top.where("label = class").select("row_id", F.col("class").alias("y"), "s2")
    both = own.join(top.select("row_id", F.col("class").alias("b"), "s1"), "row_id").where("y <> b")
    hit = F.col("s1").isNotNull() & (F.col("s2").isNull() | (F.col("s1") > F.col("s2")))
    return summed(both.groupBy("y", "b").agg(F.count_if(hit).alias("adj"), F.count("*").alias("cardinality")))


def accumulated(pairs: DataFrame, support_of: DataFrame, before: tuple[DataFrame, DataFrame, DataFrame] | None = None, by_pair: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, support and singletons after one more batch of counts on top of `before` (what this returned for the batch before).

    Overlaps and supports add up. A pair of this batch gets its index anew, over the support of its class in all batches
    (by_pair: over its own rows in all batches); other pairs keep theirs. A class of this batch gets its least index
    among this batch's pairs; other classes keep theirs.
    """
    pairs, support_of = pairs.select("y", "b", "adj", "cardinality"), support_of.select("label", "support")
    if before is None:
        found = summed(pairs)
        return found, support_of, singleton(found, support_of)
    old_pairs, old_support, old_single = before
    support_all = old_support.unionByName(support_of).groupBy("label").agg(F.sum("support").alias("support"))
    old = old_pairs.select("y", "b", F.col("adj").alias("old_adj"), F.col("cardinality").alias("old_n"), F.col("pairwise_index").alias("old_index"))
    both = pairs.join(old, ["y", "b"], "full").join(support_all.select(F.col("label").alias("y"), "support"), "y")
    here, zero = F.col("adj").isNotNull(), F.lit(0)
    adj = F.coalesce("adj", zero) + F.coalesce("old_adj", zero)
    n = F.coalesce("cardinality", zero) + F.coalesce("old_n", zero) if by_pair else F.col("support")
    found = both.select("y", "b", adj.alias("adj"), F.when(here, n).otherwise(F.col("old_n")).alias("cardinality"), F.when(here, 1 - adj / n).otherwise(F.col("old_index")).alias("pairwise_index"), here.alias("here"))
    low = found.where("here").groupBy("y").agg(F.min("pairwise_index").alias("m"))
    now = support_of.select(F.col("label").alias("y"), F.lit(True).alias("here"))
    single = support_all.withColumnRenamed("label", "y").join(low, "y", "left").join(now, "y", "left").join(old_single.select("y", F.col("singleton_index").alias("old_index")), "y", "left")
    value = F.when(F.col("here"), F.coalesce("m", F.lit(1.0))).otherwise(F.coalesce("old_index", F.lit(1.0)))
    return found.drop("here"), support_all, single.select("y", "support", value.alias("singleton_index"))


#: Prototypes in a leaf of a class's tree.
LEAF = 16


@dataclass
class Forest:
    """The prototypes of each class as leaves of neighbours, with a ball around each leaf and each class."""

    classes: list[str]
    points: np.ndarray  # by class and leaf
    leaf: np.ndarray  # where each leaf begins, and the end of all
    first: np.ndarray  # the first leaf of each class, and the end of all
    center: np.ndarray  # of leaves
    radius: np.ndarray
    class_center: np.ndarray
    class_radius: np.ndarray

    @classmethod
    def of(cls, blocks: list[Block], leaf: int = LEAF) -> Forest:
        names, points, starts, first = [], [], [], []

        def split(x: np.ndarray) -> None:
            """Halves at the median of the widest feature, down to leaves."""
            if len(x) <= leaf:
                starts.append(sum(map(len, points)))
                points.append(x)
                return
            order = np.argsort(x[:, np.ptp(x, axis=0).argmax()], kind="stable")
            split(x[order[: len(x) // 2]])
            split(x[order[len(x) // 2 :]])

        for b in blocks:
            for i, c in enumerate(b.classes):
                names.append(c)
                first.append(len(starts))
                split(b.center[b.of == i])
        x = np.concatenate(points)
        ends = np.array([*starts, len(x)])

        def balls(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            center = np.add.reduceat(x, cuts[:-1], axis=0) / np.diff(cuts)[:, None]
            far = np.sqrt(((x - np.repeat(center, np.diff(cuts), axis=0)) ** 2).sum(axis=1))
            return center, np.maximum.reduceat(far, cuts[:-1])

        first = np.array([*first, len(starts)])
        return cls(names, x, ends, first, *balls(ends), *balls(ends[first]))

    def nearest(self, a: int, m: int | None = None) -> tuple[list[tuple[str, float]], int]:
        """Classes with their distance to class a (the least between prototypes): all others, or at least the m nearest and whatever ties with the last of them; and how many distances between prototypes that took.

        Classes are taken by the bound that their balls set, until that exceeds the m-th distance found; within a pair of classes,
        pairs of leaves by theirs, until that exceeds the least distance found.
        """
        bound = self._apart(self.class_center[a], self.class_radius[a], self.class_center, self.class_radius)
        bound[a] = np.inf
        found: list[tuple[str, float]] = []
        best: list[float] = []  # of the m nearest so far, in order
        taken = 0
        for b in np.argsort(bound, kind="stable")[: len(self.classes) - 1].tolist():
            if m is not None and len(best) >= m and bound[b] > best[m - 1]:
                break
            d, n = self._between(a, b)
            taken += n
            found.append((self.classes[b], d))
            bisect.insort(best, d)
        return found, taken

    @staticmethod
    def _apart(center, radius, centers, radii) -> np.ndarray:
        """The least distance that points of two balls can have, rounded down."""
        return np.maximum(np.sqrt(((centers - center) ** 2).sum(axis=-1)) - radius - radii, 0.0) * (1 - 1e-9)

    def _between(self, a: int, b: int) -> tuple[float, int]:
        mine, other = (np.arange(self.first[c], self.first[c + 1]) for c in (a, b))
        bound = self._apart(self.center[mine][:, None], self.radius[mine][:, None], self.center[other][None], self.radius[other][None])
        least, taken = np.inf, 0
        for at in np.argsort(bound, axis=None, kind="stable").tolist():
            i, j = divmod(at, len(other))
            if bound[i, j] > least:
                break
            x, y = (self.points[self.leaf[k] : self.leaf[k + 1]] for k in (mine[i], other[j]))
            d2 = ((x[:, None] - y[None]) ** 2).sum(axis=2)  # differences, so that equal centres are 0 apart
            least, taken = min(least, math.sqrt(d2.min())), taken + d2.size
        return least, taken


def class_distances(prototypes: DataFrame | Held, nearest: int | None = None) -> DataFrame:
    """a, b, distance, computed: least distance between prototypes of two classes, of every class to all others or to the `nearest` ones (and ties); computed: distances between prototypes that a's rows took together.

    A task takes some classes, each by itself against the trees of all (Forest). These are of the prototypes' size and
    go to the tasks as one broadcast; what they save is the distances, which without them are all prototypes against all.
    """
    spark = SparkSession.active()
    blocks = [b.value for b in held(prototypes).blocks]
    if not blocks:
        return spark.createDataFrame([], "a string, b string, distance double, computed long")
    forest = spark.sparkContext.broadcast(Forest.of(blocks))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in batch.column(0).to_pylist():
                some, n = forest.value.nearest(i, nearest)
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([forest.value.classes[i]] * len(some)), pa.array([c for c, _ in some]), pa.array([v for _, v in some]), pa.array([n] * len(some))], names=["a", "b", "distance", "computed"])

    return spark.range(sum(len(b.classes) for b in blocks)).mapInArrow(run, "a string, b string, distance double, computed long")


def competitors(prototypes: DataFrame | Held, order: DataFrame, mode: str = "all", top_m: int | None = None) -> DataFrame:
    """y, b, rank, distance: all other classes, or the top_m nearest; ties go to the class that comes first (order: label, idx)."""
    if mode not in ("all", "top_m"):
        raise ValueError("multilabel_pair_mode must be 'all' or 'top_m'")
    if mode == "top_m" and (top_m is None or top_m <= 0):
        raise ValueError("top_m must be a positive integer with multilabel_pair_mode='top_m'")
    d = class_distances(prototypes, top_m if mode == "top_m" else None).join(order.select(F.col("label").alias("b"), "idx"), "b")
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("distance", "idx")))
    if mode == "top_m":
        ranked = ranked.where(F.col("rank") <= top_m)
    return ranked.select(F.col("a").alias("y"), "b", "rank", "distance")


def singleton(pairs: DataFrame, support_of: DataFrame) -> DataFrame:
    """y, support, singleton_index: the least pairwise index of each class; 1 where no pair was counted."""
    low = pairs.groupBy("y").agg(F.min("pairwise_index").alias("m"))
    return support_of.select(F.col("label").alias("y"), "support").join(low, "y", "left").select("y", "support", F.coalesce("m", F.lit(1.0)).alias("singleton_index"))


def summary(singletons: DataFrame, exclude: list | None = None) -> DataFrame:
    """One row: index (macro mean), weighted_index, n_classes, over classes not excluded; 1 where none is left."""
    kept = singletons if not exclude else singletons.where(~F.col("y").isin(*[str(x) for x in exclude]))
    macro = F.coalesce(F.avg("singleton_index"), F.lit(1.0))
    weighted = F.coalesce(F.sum(F.col("singleton_index") * F.col("support")) / F.sum("support"), macro)
    return kept.agg(macro.alias("index"), weighted.alias("weighted_index"), F.count("*").alias("n_classes"))
