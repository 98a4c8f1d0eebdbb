"""The continuous separability index: do prototypes that overlap in feature space have incompatible target distributions?

Targets are scaled and cut into cells; prototypes are fitted by cell; each sample
votes for the best prototype other than its own; Wasserstein distances between the
targets of prototypes, weighted by these votes, are the loss; a permutation of targets gives
the loss of chance. Distances are integrated range by range of the target, for the pairs that occur.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isthmus.functions.session import Scratch, numbered, quantiles
from isthmus.functions.vectors import EPS, total

from . import prototypes as proto
from . import scoring
from .scoring import TIE_DIGITS, Block, Held, by_batch, gathered, held, matrix, own_best, topk

SCALINGS = ("none", "standard", "minmax", "robust")


def scaled_targets(samples: DataFrame, how: str = "standard", digits: int | None = None) -> DataFrame:
    """target scaled by dimension over the table; a scale of about zero counts as 1. digits: rounds, so that equal values stay equal on any engine."""
    if how not in SCALINGS:
        raise ValueError(f"target_scaling must be one of {SCALINGS}")
    head = samples.select(F.size("target").alias("d")).first()
    d = head["d"] if head else 0
    if how != "none" and d:
        aggs = []
        for j in range(d):
            y = F.col("target")[j]
            if how == "standard":
                aggs += [F.avg(y).alias(f"c{j}"), F.stddev_pop(y).alias(f"s{j}")]
            else:
                aggs += [F.min(y).alias(f"c{j}"), (F.max(y) - F.min(y)).alias(f"s{j}")]
        if how == "robust":
            values = samples.select("row_id", F.posexplode("target").alias("g", "v"))
            q = quantiles(values, [0.25, 0.5, 0.75])
            center, scale = [q[j][1] for j in range(d)], [q[j][2] - q[j][0] for j in range(d)]
        else:
            r = samples.agg(*aggs).first()
            center, scale = ([r[f"{n}{j}"] for j in range(d)] for n in "cs")
        scale = [v if abs(v) > EPS else 1.0 for v in scale]
        scaled = [(F.col("target")[j] - F.lit(center[j])) / F.lit(scale[j]) for j in range(d)]
        return samples.withColumn("target", F.array(*(scaled if digits is None else (F.round(v, digits) for v in scaled))))
    if digits is not None:
        samples = samples.withColumn("target", F.transform("target", lambda v: F.round(v, digits)))
    return samples


def cell_count(n: int, wanted="auto") -> int:
    """max(8, floor(sqrt n)) up to 64, or what is wanted; never more than samples."""
    if wanted == "auto":
        return min(max(8, math.isqrt(n)), 64, n)
    if int(wanted) <= 0:
        raise ValueError("n_target_cells must be positive")
    return min(int(wanted), n)


def resolved_cover(cover: str, d: int) -> str:
    if cover not in ("auto", "quantile", "kmeans"):
        raise ValueError("target_cover must be 'auto', 'quantile' or 'kmeans'")
    if cover == "quantile" and d > 1:
        raise ValueError("target_cover='quantile' needs a univariate target")
    return cover if cover != "auto" else "quantile" if d == 1 else "kmeans"


def resolved_distance(distance: str, d: int) -> str:
    if distance not in ("auto", "wasserstein", "sliced_wasserstein"):
        raise ValueError("target_distance must be 'auto', 'wasserstein' or 'sliced_wasserstein'")
    if distance == "wasserstein" and d > 1:
        raise ValueError("target_distance='wasserstein' needs a univariate target")
    return "wasserstein" if d == 1 else "sliced_wasserstein"


def quantile_edges(samples: DataFrame, cells: int, digits: int | None = None) -> list[float]:
    """Distinct inner quantiles of a univariate target, linearly interpolated."""
    if cells < 2:
        return []
    values = samples.select("row_id", F.lit(0).alias("g"), F.col("target")[0].alias("v"))
    q = quantiles(values, [i / cells for i in range(1, cells)]).get(0, [])
    return sorted({round(v, digits) if digits is not None else v for v in q})


def quantile_cells(samples: DataFrame, cells: int, digits: int | None = None) -> DataFrame:
    """cell: how many edges the target has reached; edges are few and go into the plan as literals."""
    edges = quantile_edges(samples, cells, digits)
    cell = F.lit(0)
    for e in edges:
        cell = cell + (F.col("target")[0] >= F.lit(e)).cast("int")
    return samples.withColumn("cell", cell)


#: Keywords of the k-means cover of targets: those that steer it, and those that change nothing in its result.
COVER_KEYWORDS, WITHOUT_EFFECT = ("n_init", "max_iter", "tol", "init", "random_state"), ("algorithm", "copy_x", "verbose")


def cover_options(options: dict | None, seed: int = 0) -> dict:
    """target_cover_kwargs as arguments of kmeans(); TypeError for a keyword that isn't known."""
    options = dict(options or {})
    for n in options:
        if n not in COVER_KEYWORDS + WITHOUT_EFFECT:
            raise TypeError(f"unexpected keyword {n!r} in target_cover_kwargs")
    out = {k: v for k, v in options.items() if k in COVER_KEYWORDS and k != "random_state"}
    if out.get("n_init", "auto") == "auto":
        out["n_init"] = 1
    return out | {"seed": seed if options.get("random_state") is None else options["random_state"]}


def kmeans_cells(samples: DataFrame, cells: int, seed: int = 0, options: dict | None = None) -> DataFrame:
    """cell: nearest of k-means centres of the targets."""
    targets = samples.select("row_id", F.col("target").alias("features"), F.lit("t").alias("label"))
    centers = proto.kmeans(targets, cells, **cover_options(options, seed))
    near = topk(targets, centers, 1).select("row_id", F.col("pid").alias("cell"))
    return samples.join(near, "row_id")


def cells_of(samples: DataFrame, cover: str, cells: int, seed: int = 0, digits: int | None = None, options: dict | None = None) -> DataFrame:
    out = quantile_cells(samples, cells, digits) if cover == "quantile" else kmeans_cells(samples, cells, seed, options)
    return out.withColumn("label", F.format_string("%06d", F.col("cell").cast("int")))


def adjacency(samples: DataFrame, prototypes: DataFrame | Held, own: DataFrame) -> DataFrame:
    """p, q, n, alpha: samples of prototype p whose best prototype other than p is q (of any cell), and their share among p's; ties go to the lower q."""
    prototypes = held(prototypes)
    one = len(prototypes) <= 1

    def emit(named, x, block: Block):
        mine = named["pid"].to_numpy()
        s = np.round(block.scores(x), TIE_DIGITS)
        s[block.pid[None, :] == mine[:, None]] = -np.inf
        best = np.lexsort((np.broadcast_to(block.pid, s.shape), -s), axis=1)[:, 0]
        score, q = s[np.arange(len(s)), best], block.pid[best]
        there = np.isfinite(score)
        if not one:
            return {"row_id": named["row_id"].to_numpy()[there], "p": mine[there].astype(np.int32), "q": q[there].astype(np.int32), "far": -score[there]}
        pair, n = np.unique(mine[there].astype(np.int64) << 32 | q[there], return_counts=True)
        return {"p": (pair >> 32).astype(np.int32), "q": (pair & 0xFFFFFFFF).astype(np.int32), "n": n.astype(np.int64)}

    mine = samples.join(own.select("row_id", "pid"), "row_id")
    if one:
        votes = by_batch(mine, prototypes, ["pid"], "p int, q int, n long", emit)
    else:
        each = by_batch(mine, prototypes, ["row_id", "pid"], "row_id long, p int, q int, far double", emit)
        votes = each.groupBy("row_id", "p").agg(F.min(F.struct("far", "q")).alias("b")).select("p", F.col("b.q").alias("q"), F.lit(1).cast("long").alias("n"))
    counted = votes.groupBy("p", "q").agg(F.sum("n").alias("n"))
    return counted.withColumn("alpha", F.col("n") / F.sum("n").over(Window.partitionBy("p")))


def prototype_stats(targets: DataFrame) -> DataFrame:
    """pid, support, mean, covariance (ddof 1, rows of a matrix; 0 for one sample), radius (longest distance to the mean); targets: pid, target."""
    head = targets.select(F.size("target").alias("d")).first()
    d = head["d"] if head else 1
    means = targets.groupBy("pid").agg(
        F.count("*").alias("support"), F.array(*(F.avg(F.col("target")[j]) for j in range(d))).alias("mean"),
        F.array(*(F.array(*(F.coalesce(F.covar_samp(F.col("target")[i], F.col("target")[j]), F.lit(0.0)) for j in range(d))) for i in range(d))).alias("covariance"),
    )
    far = targets.join(F.broadcast(means.select("pid", "mean")), "pid").groupBy("pid").agg(F.max(F.sqrt(total(F.zip_with("target", "mean", lambda a, b: (a - b) * (a - b))))).alias("radius"))
    return means.join(far, "pid")


def projected(targets: DataFrame, directions: list[list[float]] | None) -> DataFrame:
    """pid, dir, v: a univariate target as it is, or the target along each direction."""
    if directions is None:
        return targets.select("pid", F.lit(0).alias("dir"), F.col("target")[0].alias("v"))
    return targets.select("pid", F.posexplode(_dots(directions)).alias("dir", "v"))


def _dots(directions: list[list[float]]):
    """The target along each direction."""
    return F.array(*(total(F.zip_with("target", F.array(*map(F.lit, w)), lambda a, b: a * b)) for w in directions))


def random_directions(n: int, d: int, seed: int | None = None) -> list[list[float]]:
    w = np.random.default_rng(seed).normal(size=(n, d))
    return (w / np.maximum(np.sqrt((w**2).sum(axis=1, keepdims=True)), EPS)).tolist()


def wasserstein(values: DataFrame, pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """p, q, distance: mean over directions of the area between the distribution functions of v in p and in q. values: pid, dir, v; pairs without values on a side don't come back."""
    found = wasserstein_by_group(values.withColumn("g", F.lit(0)), pairs.select(F.lit(0).alias("g"), "p", "q"), scratch)
    return found.select("p", "q", "distance")


#: Numbers that areas of pairs are worked out on at once.
AT_ONCE = 1 << 21


def areas(v: np.ndarray, c: np.ndarray, pid: np.ndarray, low: float, end: float, known: dict, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The area between the distribution functions of p and q, for every pair, from low to end. v (in order), c, pid: how often each prototype has each value there; known: pid to (size, mass before low).

    Pairs are worked out together: each brings the values of its two prototypes with signed weights, one
    sort puts them in order within their pairs, and one running sum gives the differences of the functions.
    """
    ids = np.array(sorted(known), dtype=np.int64)
    size, before = (np.array([known[k][x] for k in ids.tolist()], dtype=float) for x in (0, 1))
    at = np.searchsorted(ids, pid)
    order = np.argsort(at, kind="stable")
    start = np.searchsorted(at[order], np.arange(len(ids) + 1))
    n = np.diff(start)
    base = before / size
    weight = c / size[at]
    left, right = np.searchsorted(ids, p), np.searchsorted(ids, q)
    out = np.zeros(len(p))
    many = n[left] + n[right] + 1
    upto = np.cumsum(many)
    a = 0
    while a < len(p):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + AT_ONCE, side="right")))
        l, r, k = left[a:b], right[a:b], many[a:b]  # noqa: E741
        # A place for the range's start, then the values of both; the last gap ends with the range.
        take = np.concatenate([start[l], start[r]])
        lens = np.concatenate([n[l], n[r]])
        pair = np.repeat(np.concatenate([np.arange(b - a)] * 2), lens)
        row = order[np.repeat(take - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
        sign = np.repeat(np.concatenate([np.ones(b - a), -np.ones(b - a)]), lens)
        by = np.argsort(pair * len(v) + row, kind="stable")  # rows are in the order of values
        head = np.cumsum(k) - k
        inner = np.ones(int(k.sum()), dtype=bool)
        inner[head] = False
        step, place = np.empty(len(inner)), np.empty(len(inner))
        step[inner], place[inner] = (sign * weight[row])[by], v[row[by]]
        step[head], place[head] = base[l] - base[r], low
        total = np.cumsum(step)
        gap = total - np.repeat(total[head] - step[head], k)
        following = np.append(place[1:], end)
        following[head[1:] - 1] = end
        out[a:b] = np.add.reduceat(np.abs(gap) * (following - place), head)
        a = b
    return out


def wasserstein_by_group(values: DataFrame, pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """g, p, q, distance for values (g, pid, dir, v) and pairs (g, p, q) within groups.

    Distinct values with their counts are cut into ranges of (g, dir, v). A range knows the mass that each prototype
    has before it and the pairs of its group, and adds up its own part of every pair's area, up to where the next
    range starts; no task takes all values of a prototype or a pair. The values dealt into ranges belong to the scratch given.
    """
    counts = values.groupBy("g", "dir", "v", "pid").agg(F.count("*").alias("c"))
    dealt = counts.repartitionByRange("g", "dir", "v").withColumn("part", F.spark_partition_id())
    dealt = (scratch or Scratch(values.sparkSession)).written(dealt, "ranges")
    mass = dealt.groupBy("g", "dir", "pid", "part").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g", "dir", "pid").orderBy("part"))
    size = F.sum("c").over(Window.partitionBy("g", "dir", "pid"))
    # For every range of a direction the mass before it, also of prototypes without values in it.
    ranges = dealt.groupBy("g", "dir", "part").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    ranges = ranges.withColumn("end", F.coalesce(F.lead("low").over(Window.partitionBy("g", "dir").orderBy("part")), "high"))
    before = mass.select("g", "dir", "pid", F.col("part").alias("at"), upto.alias("upto"), size.alias("size"))
    known = ranges.join(before, ["g", "dir"]).groupBy("g", "dir", "part", "low", "end", "pid", "size").agg(F.max(F.when(F.col("at") < F.col("part"), F.col("upto"))).alias("before"))
    edges = known.groupBy("g", "dir", "part", "low", "end").agg(F.collect_list(F.struct("pid", "size", F.coalesce("before", F.lit(0)).alias("before"))).alias("known"))
    edges = edges.join(pairs.groupBy("g").agg(F.collect_set(F.struct("p", "q")).alias("pairs")), "g")

    def run(left, right):
        import pyarrow as pa

        out: list[list] = [[] for _ in range(5)]
        key = left.column("g").to_numpy().astype(np.int64) << 32 | left.column("dir").to_numpy()
        v, c, pid = left.column("v").to_numpy(), left.column("c").to_numpy().astype(float), left.column("pid").to_numpy()
        order = np.lexsort((v, key))
        key, v, c, pid = key[order], v[order], c[order], pid[order]
        for i in range(right.num_rows):
            e = {n: right.column(n)[i] for n in ("g", "dir", "low", "end", "known", "pairs")}
            g, d = e["g"].as_py(), e["dir"].as_py()
            rows = slice(*np.searchsorted(key, [g << 32 | d, (g << 32 | d) + 1]))
            held = {k["pid"]: (k["size"], k["before"]) for k in e["known"].as_py()}
            both = e["pairs"].values
            p, q = (both.field(n).to_numpy().astype(np.int64) for n in "pq")
            there = np.isin(p, list(held)) & np.isin(q, list(held))
            p, q = p[there], q[there]
            if len(p):
                found = areas(v[rows], c[rows], pid[rows], e["low"].as_py(), e["end"].as_py(), held, p, q)
                for col, x in zip(out, (np.full(len(p), g), np.full(len(p), d), p, q, found), strict=True):
                    col.append(x)
        cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        return pa.table({n: pa.array(x).cast(t) for n, x, t in zip(("g", "dir", "p", "q", "a"), cols, kinds, strict=True)})

    # New names for the ranges' columns: both sides come from one table.
    edges = edges.select(F.col("part").alias("range"), *(F.col(c).alias(c) for c in ("g", "dir", "low", "end", "known", "pairs")))
    parts = dealt.groupBy("part").cogroup(edges.groupBy("range")).applyInArrow(run, "g int, dir int, p int, q int, a double")
    one = parts.groupBy("g", "p", "q", "dir").agg(F.sum("a").alias("d"))
    return one.groupBy("g", "p", "q").agg(F.avg("d").alias("distance"))


def local_losses(adj: DataFrame, distances: DataFrame, support: DataFrame) -> DataFrame:
    """pid, support, loss: the distances of a prototype to those its samples vote for, weighted by votes; 0 without votes."""
    d = F.col("distance")
    distances = distances.withColumn("distance", F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.raise_error("the distance of two target distributions is not finite").cast("double")).otherwise(d))
    sums = adj.join(distances, ["p", "q"]).groupBy(F.col("p").alias("pid")).agg(F.sum(F.col("alpha") * F.col("distance")).alias("loss"))
    return support.select("pid", "support").join(sums, "pid", "left").select("pid", "support", F.coalesce("loss", F.lit(0.0)).alias("loss"))


def check_distances(distances: DataFrame) -> None:
    """ValueError if a distance is not finite, as between targets near the ends of what doubles hold."""
    d = F.col("distance")
    if distances.where(F.isnan(d) | (F.abs(d) == float("inf"))).limit(1).count():
        raise ValueError("the distance of two target distributions is not finite")


def overall_loss(losses: DataFrame) -> DataFrame:
    """One row: loss weighted by support."""
    return losses.agg(F.coalesce(F.sum(F.col("support") * F.col("loss")) / F.sum("support"), F.lit(0.0)).alias("loss"))


def raw_index(actual: float, null: float) -> float:
    if null > EPS:
        return 1 - 0.5 * actual / null
    return 1.0 if actual <= EPS else float("-inf")


def index_column(loss, null: float):
    """The index of a loss against the null loss."""
    if null > EPS:
        return F.lit(1.0) - F.lit(0.5) * loss / F.lit(null)
    return F.when(loss <= EPS, 1.0).otherwise(float("-inf"))


def clipped(column, on: bool = True):
    return F.least(F.greatest(column, F.lit(0.0)), F.lit(1.0)) if on else column


#: Multipliers of the 32-bit mixer in a round.
MIX = (739982445, 695872825)
CIPHER_ROUNDS = 4


def round_keys(key: str, perm: int) -> list[int]:
    """A 32-bit key for each round of a permutation's cipher: the first 8 hex digits of md5(key + perm-round)."""
    return [int(hashlib.md5(f"{key}{perm}-{r}".encode()).hexdigest()[:8], 16) for r in range(CIPHER_ROUNDS)]


def ciphered(n: np.ndarray, size: int, keys: list[int]) -> np.ndarray:
    """A permutation of 0 .. size - 1 by arithmetic: a Feistel cipher on the least even number of bits that hold size, applied again to what falls outside (cycle walking)."""
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask, out, left = np.int64((1 << half) - 1), n.astype(np.int64), np.arange(len(n))
    low = np.int64(0xFFFFFFFF)
    while len(left):
        a, b = out[left] >> half, out[left] & mask
        for k in keys:
            x = (b + k) & low
            x = ((x ^ (x >> 15)) * MIX[0]) & low
            x = ((x ^ (x >> 12)) * MIX[1]) & low
            a, b = b, a ^ ((x ^ (x >> 15)) & mask)
        out[left] = a << half | b
        left = left[out[left] >= size]
    return out


def permuted(samples: DataFrame, permutations: int, columns: list[str], key: str = "", scratch: Scratch | None = None) -> DataFrame:
    """perm, and every sample with the given columns of another: a permutation of the table for each perm, jointly for all columns.

    Rows are numbered by row_id once; a permutation's place of a number is arithmetic (ciphered), so that nothing is
    sorted for it. A sample gets its columns of all permutations at once, in one join by
    number: other columns, features among them, are moved once, and repeated only while the result is read.
    """
    scratch = scratch or Scratch(samples.sparkSession)
    rows = numbered(samples, ["row_id"], "n", scratch)
    size = rows.count()
    keys = [round_keys(key, p) for p in range(permutations)]

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.column(0).to_numpy()
            for perm, k in enumerate(keys):
                yield pa.RecordBatch.from_arrays([pa.array(ciphered(n, size, k)), pa.array(np.full(len(n), perm, np.int32)), *batch.columns[1:]], names=["at", "perm", *columns])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*columns).schema)
    moved = rows.select("n", *columns).mapInArrow(places, f"at long, perm int, {kinds}")
    moved = moved.groupBy("at").agg(F.collect_list(F.struct("perm", *columns)).alias("moved"))
    both = scratch.written(rows.drop(*columns).join(moved, F.col("n") == F.col("at")).drop("n", "at"), "permuted")
    return both.select("*", F.explode("moved").alias("m")).select(*(c for c in samples.columns if c not in columns), "m.*")


def _by_permutation(blocks: Iterator[Block]) -> Iterator[dict[int, Block]]:
    """Prototypes of a few permutations at once (classes begin with six digits of their number), about BLOCK_BYTES of them."""
    held: dict[int, list] = {}

    def merged() -> dict[int, Block]:
        return {g: Block.of_blocks(parts) for g, parts in held.items()}

    for block in blocks:
        of = np.array([int(c[:6]) for c in block.classes])
        for g in sorted(set(of.tolist())):
            if g not in held and sum(b.center.nbytes for parts in held.values() for b in parts) > scoring.BLOCK_BYTES:
                yield merged()
                held = {}
            held.setdefault(g, []).append(block.only([c for c in block.classes if int(c[:6]) == g]))
    if held:
        yield merged()


def null_losses(samples: DataFrame, fit: Callable[[DataFrame], DataFrame], permutations: int, directions: list[list[float]] | None = None, key: str = "", scratch: Scratch | None = None) -> DataFrame:
    """perm, loss: the loss of each permutation of the targets, with prototypes fitted anew; all permutations at once. samples: row_id, features, target, label (the cell). fit: prototypes by label.

    Cells follow from the targets as a set, so a target takes its cell along. A cell of a permutation is a class
    of its own to the fit; a sample is scored against the prototypes of its permutation only, which are broadcast a few permutations at a time.
    """
    scratch = scratch or Scratch(samples.sparkSession)
    shuffled = permuted(samples.select("row_id", "features", "target", "label"), permutations, ["target", "label"], key, scratch)
    shuffled = shuffled.withColumn("label", F.concat(F.format_string("%06d|", F.col("perm")), F.col("label")))

    def voter(every):
        def vote(batches):
            """The sample's own prototype and the best other one."""
            import pyarrow as pa

            for batch in batches:
                perm, y = batch.column(1).to_numpy(), np.array(batch.column(2).to_pylist(), dtype=object)
                for g in np.unique(perm).tolist():
                    rows = np.flatnonzero(perm == g)
                    b, x = every.value[g], matrix(batch.column(0).take(pa.array(rows)))
                    at = {c: i for i, c in enumerate(b.classes)}
                    s = np.round(b.scores(x), TIE_DIGITS)
                    own = np.where(b.of[None, :] == np.array([at[c] for c in y[rows]])[:, None], s, -np.inf).argmax(axis=1)
                    s[np.arange(len(s)), own] = -np.inf
                    best = s.argmax(axis=1)
                    q = pa.array(b.pid[best].astype(np.int32), mask=~np.isfinite(s[np.arange(len(s)), best]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), g, np.int32)), pa.array(b.pid[own].astype(np.int32)), q, batch.column(3).take(pa.array(rows))], names=["g", "pid", "q", "target"])

        return vote

    parts = []
    for few in _by_permutation(gathered(fit(shuffled))):
        every = samples.sparkSession.sparkContext.broadcast(few)
        mine = shuffled.where(F.col("perm").isin(*few)).select("features", "perm", "label", "target")
        parts.append(scratch.written(mine.mapInArrow(voter(every), "g int, pid int, q int, target array<double>"), "votes"))
        every.destroy()
    votes = functools.reduce(DataFrame.unionByName, parts) if parts else samples.sparkSession.createDataFrame([], "g int, pid int, q int, target array<double>")
    adj = votes.where("q is not null").groupBy("g", F.col("pid").alias("p"), "q").agg(F.count("*").alias("n"))
    values = votes.select("g", "pid", "target")
    values = values.select("g", "pid", F.lit(0).alias("dir"), F.col("target")[0].alias("v")) if directions is None else values.select("g", "pid", F.posexplode(_dots(directions)).alias("dir", "v"))
    distances = wasserstein_by_group(values, adj, scratch)
    total = votes.groupBy("g").agg(F.count("*").alias("total"))
    sums = adj.join(distances, ["g", "p", "q"]).groupBy("g").agg(F.sum(F.col("n") * F.col("distance")).alias("s"))
    return total.join(sums, "g", "left").select(F.col("g").alias("perm"), (F.coalesce("s", F.lit(0.0)) / F.col("total")).alias("loss"))


def null_losses_of_means(samples: DataFrame, distances: DataFrame, permutations: int, d: int) -> DataFrame:
    """perm, loss: the loss of each permutation with one prototype, the mean, for each cell; all permutations at once.

    A cell keeps its targets under any permutation, so the distances between cells
    are those of the data, and only means and votes change. samples: row_id, features, label, pid (of the label).
    """
    shuffled = permuted(samples.select("row_id", "features", "label", "pid"), permutations, ["label", "pid"])
    means = shuffled.groupBy("perm", "pid").agg(F.count("*").alias("support"), *(F.avg(F.col("features")[j]).alias(f"m{j}") for j in range(d))).collect()
    ids = sorted({r["pid"] for r in means})
    at = {p: i for i, p in enumerate(ids)}
    center = np.full((permutations, len(ids), d), np.inf)
    for r in means:
        center[r["perm"], at[r["pid"]]] = [r[f"m{j}"] for j in range(d)]
    means_of = samples.sparkSession.sparkContext.broadcast((center, np.array(ids)))

    def votes(batches):
        import pyarrow as pa

        c, names = means_of.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, perm, own = matrix(batch.column(0)), batch.column(1).to_numpy(), np.searchsorted(names, batch.column(2).to_numpy())
            d2 = np.round(((c[perm] - x[:, None, :]) ** 2).sum(axis=2), 12)
            d2[np.arange(len(x)), own] = np.inf
            key, n = np.unique((perm.astype(np.int64) * len(names) + own) * len(names) + d2.argmin(axis=1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((key // len(names) ** 2).astype(np.int32)), pa.array(names[key // len(names) % len(names)].astype(np.int32)), pa.array(names[key % len(names)].astype(np.int32)), pa.array(n.astype(np.int64))], names=["perm", "p", "q", "n"])

    counted = shuffled.select("features", "perm", "pid").mapInArrow(votes, "perm int, p int, q int, n long").groupBy("perm", "p", "q").agg(F.sum("n").alias("n"))
    # support_p / total * n / support_p: the vote's weight is its share of all samples.
    share = counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("perm")))
    return share.join(F.broadcast(distances), ["p", "q"]).groupBy("perm").agg(F.sum(F.col("share") * F.col("distance")).alias("loss"))


__all__ = ["adjacency", "cells_of", "local_losses", "own_best", "wasserstein"]
