"""Prototypes owned by classes: pid, class, center, radius, norm2.

Classes may be of any size. Sums over a class are taken in Arrow batches and added up;
only centres, which are few, meet on the driver. A class goes to one task as a whole only if it has no
more than SMALL entries; larger ones are fitted by rounds over the distributed table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isthmus.functions.session import Scratch, deleted, quantiles, shared_root
from isthmus.functions.vectors import l2_normalized, total

from .scoring import PROTOTYPES, Block, by_batch, matrix

#: Numbers (rows times features) of a class that one task takes.
SMALL = 20_000_000
EPS32 = 1.1920929e-07


def finished(df: DataFrame, radius=None) -> DataFrame:
    """Adds pid, by class and local id, and norm2 to rows (class, local, center). The window runs over prototypes, which are few."""
    pid = (F.row_number().over(Window.orderBy("class", "local")) - 1).cast("int").alias("pid")
    r = F.lit(None).cast("double") if radius is None else F.col(radius)
    return df.select(pid, "class", "center", r.alias("radius"), total(F.transform("center", lambda v: v * v)).alias("norm2"))


def per_class(value, label, what: str):
    """A parameter that is one value or a mapping by class; a class missing from a mapping is an error."""
    if isinstance(value, dict):
        named = {str(k): v for k, v in value.items()}
        plain = str(label).lstrip("0") or "0"  # cells have leading zeros
        if str(label) not in named and plain not in named:
            raise ValueError(f"{what} has no value for class {label}")
        return named.get(str(label), named.get(plain))
    return value


def landmarks(samples: DataFrame, m: int) -> DataFrame:
    """The m samples of lowest row_id of each class (a grouped limit, taken in every task before the shuffle)."""
    w = Window.partitionBy("label").orderBy("row_id")
    rows = samples.select(F.col("label").alias("class"), F.col("features").alias("center"), "row_id", F.row_number().over(w).alias("local")).where(F.col("local") <= m)
    return finished(rows)


def class_means(samples: DataFrame, d: int) -> DataFrame:
    """One prototype for each class, its mean: one aggregate of d averages, no explosion of rows."""
    means = samples.groupBy(F.col("label").alias("class")).agg(*(F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(d)))
    return finished(means.select("class", F.lit(1).alias("local"), F.array(*(f"m{i}" for i in range(d))).alias("center")))


def _assigned_sums(samples: DataFrame, prototypes: DataFrame) -> DataFrame:
    """pid, i, s: sums of the features of the samples assigned to each prototype of their class (i = -1: their number, -2: their squared distances)."""

    def emit(named, x, block: Block):
        at = {c: i for i, c in enumerate(block.classes)}
        y = np.array([at.get(v, -1) for v in named["label"].to_pylist()])
        x, y = x[y >= 0], y[y >= 0]
        if not len(x):
            return None
        s = np.where(block.of[None, :] == y[:, None], block.scores(x), -np.inf)
        best = s.argmax(axis=1)
        u, back = np.unique(best, return_inverse=True)
        sums = np.stack([np.bincount(back, x[:, j]) for j in range(x.shape[1])] + [np.bincount(back).astype(float), np.bincount(back, -s[np.arange(len(x)), best])], axis=1)
        d = x.shape[1]
        i = np.array([*range(d), -1, -2], dtype=np.int32)
        return {"pid": np.repeat(block.pid[u], d + 2).astype(np.int32), "i": np.tile(i, len(u)), "s": sums.ravel()}

    return by_batch(samples, prototypes, ["label"], "pid int, i int, s double", emit).groupBy("pid", "i").agg(F.sum("s").alias("s"))


def lloyd(samples: DataFrame, start: DataFrame, iterations: int, tolerance: float | None = None) -> DataFrame:
    """Rounds of assignment within the class and new means; a prototype without samples stays. Stops early when centres move less than tolerance."""
    spark = samples.sparkSession
    rows = {r["pid"]: (r["class"], np.array(r["center"], dtype=float)) for r in start.collect()}
    current = start
    for _ in range(iterations):
        sums: dict[int, dict[int, float]] = {}
        for r in _assigned_sums(samples, current).toLocalIterator():
            sums.setdefault(r["pid"], {})[r["i"]] = r["s"]
        moved = 0.0
        for pid, s in sums.items():
            c, old = rows[pid]
            new = np.array([s[i] for i in range(len(old))]) / s[-1]
            moved = max(moved, float(((new - old) ** 2).sum()))
            rows[pid] = (c, new)
        current = spark.createDataFrame([(p, c, [float(v) for v in x], None, float((x**2).sum())) for p, (c, x) in rows.items()], PROTOTYPES)
        if tolerance is not None and moved <= tolerance:
            break
    return current


#: The uniform numbers of a step are those of the rows, turned by this much (the golden section).
TURN = 0.6180339887498949


def drawn(samples: DataFrame, seed: int, starts: int = 1) -> DataFrame:
    """Adds u: for each of several starts a number in [0, 1) from the row's id alone, so that what is drawn depends neither on the order nor on the split of the table."""
    one = [F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-{s}-"), F.col("row_id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52)) for s in range(starts)]
    return samples.withColumn("u", F.array(*one))


def turned(u: np.ndarray, step: int) -> np.ndarray:
    return (u + step * TURN) % 1.0


def race(u: np.ndarray, near: np.ndarray, step: int) -> np.ndarray:
    """Keys of which the least is a row drawn with a chance in proportion to its squared distance; rows at distance 0 come after all others, in random order."""
    r = turned(u, step)
    with np.errstate(divide="ignore"):
        return np.where(near > 0, -np.log(np.maximum(r, 1e-300)) / np.where(near > 0, near, 1.0), 1e300 * (1 + r))


def nearest2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row to its nearest centre, by differences."""
    near = np.full(len(x), np.inf)
    for v in c:
        near = np.minimum(near, ((x - v) ** 2).sum(axis=1))
    return near


#: k-means||: rounds of drawing, and how many rows a round draws on average, in multiples of k.
DRAWS, OVERSAMPLED = 5, 2.0


def oversampled(u: np.ndarray, near: np.ndarray, step: int, k: int, total: float) -> np.ndarray:
    """Which rows a round of k-means|| draws, each by itself, with a chance in proportion to its squared distance; total: the sum of these over the class."""
    return (near > 0) & (turned(u, step) * total < OVERSAMPLED * k * near)


def reduced(x: np.ndarray, u: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Which k of the drawn rows, each weighted by the rows nearest to it, start the clusters: one after another by k-means++. Where there are no more than k all do."""
    if len(x) <= k:
        return np.arange(len(x))
    rows = [int(race(u, weight, DRAWS + 1).argmin())]
    near = ((x - x[rows[0]]) ** 2).sum(axis=1)
    for t in range(1, k):
        rows.append(int(race(u, near * weight, DRAWS + 1 + t).argmin()))
        near = np.minimum(near, ((x - x[rows[-1]]) ** 2).sum(axis=1))
    return np.array(rows)


def carried(x: np.ndarray, near: np.ndarray, owner: np.ndarray, new: np.ndarray, first: int) -> None:
    """Brings nearest distances and owners up to date with new centres, numbered from `first` on; of equally near ones the first stays."""
    for k, v in enumerate(new):
        d = ((x - v) ** 2).sum(axis=1)
        closer = d < near
        near[closer], owner[closer] = d[closer], first + k


def scalable_rows(x: np.ndarray, u: np.ndarray, k: int) -> np.ndarray:
    """Rows that start k clusters by k-means||: a few rounds draw some k rows each at once. Too few drawn (of few distinct rows) are filled up by the farthest."""
    rows = [int(u.argmin())]
    near, owner = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    carried(x, near, owner, x[rows], 0)
    for t in range(1, DRAWS + 1):
        new = np.flatnonzero(oversampled(u, near, t, k, float(near.sum()))).tolist()
        carried(x, near, owner, x[new], len(rows))
        rows += new
    picked = np.array(rows)[reduced(x[rows], u[rows], np.bincount(owner, minlength=len(rows)).astype(float), k)]
    while len(picked) < k:
        picked = np.append(picked, nearest2(x, x[picked]).argmax())
    return picked


def start_rows(x: np.ndarray, u: np.ndarray, k: int, init: str) -> np.ndarray:
    """Rows that start k clusters: those with the least numbers, one after another by k-means++, or by k-means||."""
    if init == "random":
        return np.argsort(u, kind="stable")[:k]
    if init == "k-means||":
        return scalable_rows(x, u, k)
    rows = [int(u.argmin())]
    near = ((x - x[rows[0]]) ** 2).sum(axis=1)
    for t in range(1, k):
        rows.append(int(race(u, near, t).argmin()))
        near = np.minimum(near, ((x - x[rows[-1]]) ** 2).sum(axis=1))
    return np.array(rows)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * x @ c.T, 0)


def kmeans_matrix(x: np.ndarray, u: np.ndarray, k: int, init: str = "k-means++", max_iter: int = 300, tol: float = 1e-4) -> np.ndarray:
    """Lloyd's algorithm on a matrix: the best of as many starts as u has columns."""
    best, least = None, np.inf
    tolerance = tol * x.var(axis=0).mean()
    for start in range(u.shape[1]):
        c = x[start_rows(x, u[:, start], k, init)]
        for _ in range(max_iter):
            d2 = squared(x, c)
            own = d2.argmin(axis=1)
            n = np.bincount(own, minlength=k)
            new = np.stack([np.bincount(own, x[:, j], minlength=k) for j in range(x.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
            if (n == 0).any():  # an empty cluster starts anew at the farthest sample
                new[n == 0] = x[np.argsort(-d2.min(axis=1), kind="stable")[: int((n == 0).sum())]]
            moved = ((new - c) ** 2).sum()
            c = new
            if moved <= tolerance:
                break
        inertia = squared(x, c).min(axis=1).sum()
        if inertia < least:
            best, least = c, inertia
    return best


def batch_rows(u: np.ndarray, step: int, batch_size: int, n: int) -> np.ndarray:
    """Which rows are in the mini-batch of a step: of all n rows of the class each with the chance batch_size / n."""
    return turned(u, step) < batch_size / n


class Running:
    """Centres that are the means of all the samples they were ever given."""

    def __init__(self, centers: np.ndarray):
        self.c, self.seen = centers.astype(float).copy(), np.zeros(len(centers))

    def step(self, sums: np.ndarray, n: np.ndarray) -> float:
        """Takes the sums and numbers of a mini-batch's samples by centre; returns how far the centres moved, squared."""
        some = n > 0
        self.seen += n
        move = (sums[some] - n[some, None] * self.c[some]) / self.seen[some, None]
        self.c[some] += move
        return float((move**2).sum())


#: A mini-batch that moves the centres less than this, squared, is the last one.
STILL = 1e-9


def minibatch_matrix(x: np.ndarray, u: np.ndarray, k: int, batch_size: int = 8192, max_iter: int = 100, init: str = "random") -> np.ndarray:
    """Mini-batch k-means on a matrix; of several starts the best on the first batch."""
    first = x[batch_rows(u[:, 0], 0, batch_size, len(x))]
    starts = [x[start_rows(x, u[:, s], k, init)] for s in range(u.shape[1])]
    state = Running(min(starts, key=lambda c: squared(first, c).min(axis=1).sum()) if len(starts) > 1 else starts[0])
    for t in range(max_iter):
        part = x[batch_rows(u[:, 0], t, batch_size, len(x))]
        if not len(part):
            continue
        own = squared(part, state.c).argmin(axis=1)
        if state.step(np.stack([np.bincount(own, part[:, j], minlength=k) for j in range(x.shape[1])], axis=1), np.bincount(own, minlength=k)) < STILL:
            break
    return state.c


def by_class(samples: DataFrame, fit: Callable[[str, np.ndarray, np.ndarray], list[tuple]], kinds: str) -> DataFrame:
    """fit(class, row ids or numbers of drawn(), features) -> rows, for classes of bounded size; samples come in the order of row_id."""
    numbers = "u" if "u" in samples.columns else "row_id"

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by("row_id")
        ids = matrix(table.column("u").combine_chunks()) if numbers == "u" else table.column("row_id").to_numpy()
        rows = fit(key[0].as_py(), ids, matrix(table.column("features").combine_chunks()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * (kinds.count(",") + 1)
        names = [k.strip().split(" ")[0] for k in kinds.split(",")]
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_()}
        return pa.table({n: pa.array(c, types[k.strip().split(" ")[1]]) for n, c, k in zip(names, cols, kinds.split(","), strict=True)})

    return samples.select("label", "row_id", "features", *(["u"] if numbers == "u" else [])).groupBy("label").applyInArrow(run, kinds)


def class_sizes(samples: DataFrame) -> dict[str, int]:
    return {r["label"]: r["n"] for r in samples.groupBy("label").agg(F.count("*").alias("n")).collect()}


def _checked_k(k, label, n: int) -> int:
    k = int(per_class(k, label, "kmeans_k"))
    return max(1, min(k, n))


CENTERS = "class string, local int, center array<double>"


def kmeans(samples: DataFrame, k=8, seed: int = 0, n_init: int = 1, max_iter: int = 300, tol: float = 1e-4, init: str = "k-means++") -> DataFrame:
    """k-means within each class; k: a number or one by class, cut to 1 .. class size. Classes that one task can take and those fitted in rounds have the same starts and steps."""
    check_init(init)
    sizes = class_sizes(samples)
    ks = {c: _checked_k(k, c, n) for c, n in sizes.items()}
    d = len(samples.select("features").first()["features"]) if sizes else 0
    samples = drawn(samples, seed, n_init)
    if max(sizes.values(), default=0) * d <= SMALL:
        return finished(by_class(samples, lambda c, u, x: [(c, i, v.tolist()) for i, v in enumerate(kmeans_matrix(x, u, ks[c], init, max_iter, tol))], CENTERS))
    return kmeans_in_rounds(samples, sizes, ks, d, n_init, max_iter, tol, init)


def check_init(init: str) -> None:
    if init not in ("k-means++", "k-means||", "random"):
        raise ValueError("init must be 'k-means++', 'k-means||' or 'random'")


def scanned(samples: DataFrame, state: dict, emit: Callable, schema: str) -> DataFrame:
    """emit(class, state of the class, features, row ids, u) -> dicts, for the rows of each class in every batch."""
    held = samples.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y, ids, u = matrix(batch.column(0)), np.array(batch.column(1).to_pylist(), dtype=object), batch.column(2).to_numpy(), matrix(batch.column(3))
            out = []
            for c in sorted(set(y.tolist()) & held.value.keys()):
                rows = np.flatnonzero(y == c)
                out += [{"class": c, **r} for r in emit(c, held.value[c], x[rows], ids[rows], u[rows])]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    import pyarrow as pa

    names = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    kind = pa.schema([(f.split()[0], names[f.split()[1]]) for f in ("class string, " + schema).split(", ")])
    return samples.select("features", "label", "row_id", "u").mapInArrow(run, "class string, " + schema)


def least_row(found: DataFrame, *keys: str) -> dict[tuple, np.ndarray]:
    """The x with the least (key, row_id) for each class and further keys."""
    got = found.groupBy("class", *keys).agg(F.min(F.struct("key", "row_id", "x")).alias("b")).collect()
    return {(r["class"], *(r[k] for k in keys)): np.array(r["b"]["x"]) for r in got}


def starts_in_rounds(samples: DataFrame, ks: dict[str, int], n_init: int, init: str) -> dict[tuple[str, int], list[np.ndarray]]:
    """The rows start_rows() would take for each class and start: a pass for each further centre, or few for any number of centres by k-means||."""
    if init == "k-means||":
        return {key: v for s in range(n_init) for key, v in scalable_starts(samples, ks, s).items()}
    kind = "start int, key double, row_id long, x array<double>"
    if init == "random":
        most = max(ks.values())

        def least(c, _, x, ids, u):
            for s in range(n_init):
                for i in np.lexsort((ids, u[:, s]))[:most].tolist():
                    yield {"start": s, "key": u[i, s], "row_id": ids[i], "x": x[i]}

        w = Window.partitionBy("class", "start").orderBy("key", "row_id")
        got = scanned(samples, ks, least, kind).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).collect()
        out: dict = {}
        for r in sorted(got, key=lambda r: r["r"]):
            if r["r"] <= ks[r["class"]]:
                out.setdefault((r["class"], r["start"]), []).append(np.array(r["x"]))
        return out

    def lead(c, have, x, ids, u):
        for s in range(n_init):
            key = u[:, s] if have is None else race(u[:, s], nearest2(x, np.array(have[s])), len(have[s]))
            i = np.lexsort((ids, key))[0]
            yield {"start": s, "key": key[i], "row_id": ids[i], "x": x[i]}

    out = {k: [v] for k, v in least_row(scanned(samples, dict.fromkeys(ks), lead, kind), "start").items()}
    for t in range(1, max(ks.values())):
        live = {c: [out[c, s] for s in range(n_init)] for c, k in ks.items() if k > t}
        for key, v in least_row(scanned(samples, live, lead, kind), "start").items():
            out[key].append(v)
    return out


def scalable_starts(samples: DataFrame, ks: dict[str, int], start: int) -> dict[tuple[str, int], list[np.ndarray]]:
    """scalable_rows() of every class, for classes that no single task can take. Rows carry their nearest distance and owner from round to round; the drawn rows, about OVERSAMPLED k a round, come to the driver."""
    spark, scratch = samples.sparkSession, Scratch(samples.sparkSession)
    kind = "key double, row_id long, x array<double>"

    def lead(c, _, x, ids, u):
        i = np.lexsort((ids, u[:, start]))[0]
        yield {"key": u[i, start], "row_id": ids[i], "x": x[i]}

    w = scanned(samples, ks, lead, kind).groupBy("class").agg(F.min(F.struct("key", "row_id", "x")).alias("b")).collect()
    drawn_of = {r["class"]: [(r["b"]["row_id"], np.array(r["b"]["x"]), r["b"]["key"])] for r in w}
    state, known, columns = samples.select("row_id", "label", "features", F.col("u")[start].alias("u")), dict.fromkeys(ks, 0), "row_id long, label string, features array<double>, u double, near double, owner long"

    def advanced(state: DataFrame, fresh: bool) -> DataFrame:
        held = spark.sparkContext.broadcast({c: (np.array([x for _, x, _ in d[known[c] :]]), known[c]) for c, d in drawn_of.items()})

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                y, x = np.array(b.column(1).to_pylist(), dtype=object), matrix(b.column(2))
                near, owner = (np.full(len(y), np.inf), np.zeros(len(y), np.int64)) if fresh else (b.column(i).to_numpy().copy() for i in (4, 5))
                for c in set(y.tolist()):
                    rows = np.flatnonzero(y == c)
                    d, o = near[rows], owner[rows]
                    carried(x[rows], d, o, *held.value[c])
                    near[rows], owner[rows] = d, o
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(near), pa.array(owner)], names=["row_id", "label", "features", "u", "near", "owner"])

        return state.mapInArrow(run, columns)

    def draw(step: int, totals: dict[str, float]):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                y, u, near = np.array(b.column(1).to_pylist(), dtype=object), b.column(3).to_numpy(), b.column(4).to_numpy()
                some = [rows[oversampled(u[rows], near[rows], step, ks[c], totals[c])] for c in set(y.tolist()) for rows in [np.flatnonzero(y == c)]]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(np.concatenate(some))) for c in b.columns[:4]] if some else [c.slice(0, 0) for c in b.columns[:4]], names=["row_id", "label", "features", "u"])

        return run

    for t in range(1, DRAWS + 2):
        old, scratch = scratch, Scratch(spark)
        state = scratch.written(advanced(state, t == 1), "drawn")
        old.discard()
        known = {c: len(d) for c, d in drawn_of.items()}
        if t > DRAWS:
            break
        totals = {r["label"]: r["s"] for r in state.groupBy("label").agg(F.sum("near").alias("s")).collect()}
        for r in state.mapInArrow(draw(t, totals), "row_id long, label string, features array<double>, u double").orderBy("row_id").collect():
            drawn_of[r["label"]].append((r["row_id"], np.array(r["features"]), r["u"]))
    weights = {c: np.zeros(len(d)) for c, d in drawn_of.items()}
    for r in state.groupBy("label", "owner").count().collect():
        weights[r["label"]][r["owner"]] = r["count"]
    scratch.discard()
    out = {}
    for c, d in drawn_of.items():
        x = np.array([v for _, v, _ in d])
        out[c, start] = [x[i] for i in reduced(x, np.array([u for _, _, u in d]), weights[c], ks[c])]

    def far(c, have, x, ids, u):
        near = nearest2(x, have)
        i = np.lexsort((ids, -near))[0]
        yield {"key": -near[i], "row_id": ids[i], "x": x[i]}

    while few := {c: np.array(out[c, start]) for c, k in ks.items() if len(out[c, start]) < k}:
        for (c,), v in least_row(scanned(samples, few, far, kind)).items():
            out[c, start].append(v)
    return out


def kmeans_in_rounds(samples: DataFrame, sizes: dict[str, int], ks: dict[str, int], d: int, n_init: int, max_iter: int, tol: float, init: str) -> DataFrame:
    """kmeans_matrix() for classes that no single task can take: a pass over the table for each step, all classes and starts at once."""
    spark = samples.sparkSession
    spread = samples.groupBy("label").agg(*(F.var_pop(F.col("features")[j]).alias(f"v{j}") for j in range(d))).collect()
    tolerance = {r["label"]: tol * float(np.mean([r[f"v{j}"] for j in range(d)])) for r in spread}
    centers = {k: np.array(v) for k, v in starts_in_rounds(samples, ks, n_init, init).items()}

    def sums(c, have, x, ids, u):
        for s, m in have.items():
            d2 = squared(x, m)
            own = d2.argmin(axis=1)
            near = d2[np.arange(len(x)), own]
            for i in np.unique(own).tolist():
                mine = own == i
                yield {"start": s, "i": i, "n": int(mine.sum()), "far": float(near[mine].sum()), "x": x[mine].sum(axis=0)}

    def totals(live) -> dict:
        state: dict = {}
        for c, s in live:
            state.setdefault(c, {})[s] = centers[c, s]
        got = scanned(samples, state, sums, "start int, i int, n long, far double, x array<double>")
        cols = [F.sum(F.col("x")[j]).alias(f"x{j}") for j in range(d)]
        return {(r["class"], r["start"], r["i"]): r for r in got.groupBy("class", "start", "i").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), *cols).collect()}

    def farthest(live: dict[tuple[str, int], int]) -> dict:
        state: dict = {}
        for (c, s), k in live.items():
            state.setdefault(c, {})[s] = (centers[c, s], k)

        def emit(c, have, x, ids, u):
            for s, (m, k) in have.items():
                near = squared(x, m).min(axis=1)
                for i in np.lexsort((ids, -near))[:k].tolist():
                    yield {"start": s, "key": -near[i], "row_id": ids[i], "x": x[i]}

        w = Window.partitionBy("class", "start").orderBy("key", "row_id")
        got = scanned(samples, state, emit, "start int, key double, row_id long, x array<double>").withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(live.values())).collect()
        return {(r["class"], r["start"], r["r"] - 1): np.array(r["x"]) for r in got}

    live = set(centers)
    for _ in range(max_iter):
        if not live:
            break
        got, new, empty = totals(live), {}, {}
        for c, s in live:
            m = centers[c, s].copy()
            none = [i for i in range(len(m)) if (c, s, i) not in got]
            for i in set(range(len(m))) - set(none):
                m[i] = [got[c, s, i][f"x{j}"] / got[c, s, i]["n"] for j in range(d)]
            new[c, s] = m
            if none:
                empty[c, s] = none
        if empty:
            far = farthest({k: len(v) for k, v in empty.items()})
            for (c, s), none in empty.items():
                for at, i in enumerate(none):
                    new[c, s][i] = far[c, s, at]
        for key, m in new.items():
            if ((m - centers[key]) ** 2).sum() <= tolerance[key[0]]:
                live.discard(key)
            centers[key] = m
    inertia: dict = {}
    if n_init > 1:
        for (c, s, _), r in totals(set(centers)).items():
            inertia[c, s] = inertia.get((c, s), 0.0) + r["far"]
    best = {c: min(range(n_init), key=lambda s, c=c: inertia.get((c, s), 0.0)) for c in ks}
    return finished(spark.createDataFrame([(c, i, v.tolist()) for c, s in best.items() for i, v in enumerate(centers[c, s])], CENTERS))


def minibatch_kmeans(samples: DataFrame, k=8, seed: int = 0, batch_size: int = 8192, max_iter: int = 100, n_init: int = 1, init: str = "random") -> DataFrame:
    """Mini-batch k-means within each class: max_iter mini-batches, each of about batch_size rows drawn from all rows of the class (all of them if it has no more). Classes that one task can take and those fitted in rounds have the same starts and batches."""
    check_init(init)
    sizes = class_sizes(samples)
    ks = {c: _checked_k(k, c, n) for c, n in sizes.items()}
    d = len(samples.select("features").first()["features"]) if sizes else 0
    samples = drawn(samples, seed, n_init)
    if max(sizes.values(), default=0) * d <= SMALL:
        return finished(by_class(samples, lambda c, u, x: [(c, i, v.tolist()) for i, v in enumerate(minibatch_matrix(x, u, ks[c], batch_size, max_iter, init))], CENTERS))
    return minibatch_in_rounds(samples, sizes, ks, batch_size, max_iter, n_init, init)


def minibatch_in_rounds(samples: DataFrame, sizes: dict[str, int], ks: dict[str, int], batch_size: int, max_iter: int, n_init: int, init: str) -> DataFrame:
    """minibatch_matrix() for classes that no single task can take. One pass draws the rows of all batches into a table of max_iter times batch_size rows a class; a step reads its own batch from it."""
    spark = samples.sparkSession
    starts = starts_in_rounds(samples, ks, n_init, init)
    chance = F.create_map(*(F.lit(v) for c, n in sizes.items() for v in (c, batch_size / n)))[F.col("label")]
    steps = F.filter(F.sequence(F.lit(0), F.lit(max_iter - 1)), lambda t: (F.col("u")[0] + t * F.lit(TURN)) % F.lit(1.0) < chance)
    path = f"{shared_root(spark)}/batches-{uuid.uuid4().hex}"
    samples.select("label", "row_id", "features", "u", F.explode(steps).alias("t")).write.partitionBy("t").parquet(path)
    batches = spark.read.parquet(path)

    def sums(c, have, x, ids, u):
        for s, m in have.items():
            d2 = squared(x, m)
            own = d2.argmin(axis=1)
            for i in np.unique(own).tolist():
                mine = own == i
                yield {"start": s, "i": i, "n": int(mine.sum()), "far": float(d2[mine, i].sum()), "x": x[mine].sum(axis=0)}

    def totals(t: int, state: dict) -> list:
        d = len(next(iter(starts.values()))[0])
        got = scanned(batches.where(F.col("t") == t), state, sums, "start int, i int, n long, far double, x array<double>")
        return got.groupBy("class", "start", "i").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), *(F.sum(F.col("x")[j]).alias(f"x{j}") for j in range(d))).collect()

    best = dict.fromkeys(ks, 0)
    if n_init > 1:
        far: dict = {}
        for r in totals(0, {c: {s: np.array(starts[c, s]) for s in range(n_init)} for c in ks}):
            far[r["class"], r["start"]] = far.get((r["class"], r["start"]), 0.0) + r["far"]
        best = {c: min(range(n_init), key=lambda s, c=c: far.get((c, s), 0.0)) for c in ks}
    state = {c: Running(np.array(starts[c, s])) for c, s in best.items()}
    live = set(ks)
    for t in range(max_iter):
        if not live:
            break
        by: dict[str, list] = {}
        for r in totals(t, {c: {0: state[c].c} for c in live}):
            by.setdefault(r["class"], []).append(r)
        for c, rows in by.items():
            x, n = np.zeros_like(state[c].c), np.zeros(len(state[c].c), dtype=np.int64)
            for r in rows:
                x[r["i"]], n[r["i"]] = [r[f"x{j}"] for j in range(x.shape[1])], r["n"]
            if state[c].step(x, n) < STILL:
                live.discard(c)
    deleted(spark, path)
    return finished(spark.createDataFrame([(c, i, v.tolist()) for c, r in state.items() for i, v in enumerate(r.c)], CENTERS))


# Ball covers: farthest-first landmarks of each class.


def resolved_metric(metric: str, d: int, threshold: int = 128) -> str:
    if metric not in ("auto", "euclidean", "cosine"):
        raise ValueError("metric must be 'auto', 'euclidean' or 'cosine'")
    if threshold <= 0:
        raise ValueError("high_dim_threshold must be positive")
    return metric if metric != "auto" else "cosine" if d >= threshold else "euclidean"


def check_cover(k, radius, cover_fraction: float, max_balls: int | None, selection: str) -> None:
    if selection not in ("greedy_uncovered", "farthest"):
        raise ValueError("selection must be 'greedy_uncovered' or 'farthest'")
    if not 0 < cover_fraction <= 1:
        raise ValueError("cover_fraction must lie in (0, 1]")
    if k == "auto" and radius == "auto":
        raise ValueError("k and radius can't both be 'auto'")
    for v in k.values() if isinstance(k, dict) else [k]:
        if v != "auto" and v <= 0:
            raise ValueError("k must be positive")
    for v in radius.values() if isinstance(radius, dict) else [radius]:
        if v != "auto" and v <= 0:
            raise ValueError("radius must be positive")
    if max_balls is not None and max_balls <= 0:
        raise ValueError("max_balls must be positive")


def cover_matrix(ids: np.ndarray, x: np.ndarray, k, radius, cover_fraction: float, max_balls: int | None) -> tuple[np.ndarray, float, np.ndarray, bool]:
    """Rows taken as centres, radius, squared distance of each row to the nearest, and whether max_balls stopped it; ties go to the first row."""
    mean = x.mean(axis=0)
    first = int(((x - mean) ** 2).sum(axis=1).argmin())
    centers, near = [first], ((x - x[first]) ** 2).sum(axis=1)
    stopped = False
    if k == "auto":
        r2 = float(radius) ** 2
        while (near <= r2).mean() < cover_fraction and len(centers) < len(x):
            if max_balls is not None and len(centers) >= max_balls:
                stopped = True
                break
            nxt = int(near.argmax())
            centers.append(nxt)
            near = np.minimum(near, ((x - x[nxt]) ** 2).sum(axis=1))
        return np.array(centers), float(radius), near, stopped
    for _ in range(min(int(k), len(x)) - 1):
        nxt = int(near.argmax())
        centers.append(nxt)
        near = np.minimum(near, ((x - x[nxt]) ** 2).sum(axis=1))
    r = float(np.sqrt(max(np.quantile(near, cover_fraction), EPS32))) if radius == "auto" else float(radius)
    return np.array(centers), r, near, False


def ball_cover(samples: DataFrame, k="auto", radius=0.25, metric: str = "auto", cover_fraction: float = 1.0, max_balls: int | None = None, selection: str = "greedy_uncovered", high_dim_threshold: int = 128) -> tuple[DataFrame, DataFrame, str]:
    """Prototypes with radii, class diagnostics, and the metric in force (cosine: features are scaled to length 1 first, prototypes too)."""
    check_cover(k, radius, cover_fraction, max_balls, selection)
    head = samples.select(F.size("features").alias("d")).first()
    d = head["d"] if head else 0
    metric = resolved_metric(metric, d, high_dim_threshold)
    if metric == "cosine":
        samples = samples.withColumn("features", l2_normalized(F.col("features")))
    sizes = class_sizes(samples)
    for c in sizes:
        per_class(k, c, "k"), per_class(radius, c, "radius")
    kinds = "class string, local int, center array<double>, row_id long, r double, n int, covered double, mean_d double, max_d double, stopped boolean"

    def fit(c, ids, x):
        kc, rc = per_class(k, c, "k"), per_class(radius, c, "radius")
        centers, r, near, stopped = cover_matrix(ids, x, kc, rc, cover_fraction, max_balls)
        dist = np.sqrt(near)
        return [(c, i, x[p].tolist(), int(ids[p]), r, len(x), float((near <= r * r).mean()), float(dist.mean()), float(dist.max()), stopped) for i, p in enumerate(centers.tolist())]

    if max(sizes.values(), default=0) * d <= SMALL:
        rows = by_class(samples, fit, kinds)
    else:
        rows = cover_in_rounds(samples, sizes, k, radius, cover_fraction, max_balls, kinds)
    rows = rows.withColumnRenamed("r", "own_radius")
    prototypes = finished(rows, "own_radius")
    ids = prototypes.groupBy("class").agg(F.sort_array(F.collect_list("pid")).alias("ball_ids"))
    mode = F.create_map(*(F.lit(v) for c in sizes for v in (c, cover_mode(per_class(k, c, "k"), per_class(radius, c, "radius")))))[F.col("class")] if sizes else F.lit("")
    diagnostics = rows.groupBy("class").agg(
        F.first("n").alias("n_samples"), F.count("*").alias("n_balls"), F.first("own_radius").alias("radius"), F.first("covered").alias("covered_fraction"),
        F.first("mean_d").alias("mean_nearest_distance"), F.first("max_d").alias("max_nearest_distance"), F.first("stopped").alias("stopped_by_max_balls"),
    ).join(ids, "class").select(F.lit(metric).alias("metric"), mode.alias("mode"), F.lit(float(cover_fraction)).alias("target_fraction"), "*")
    return prototypes, diagnostics, metric


def cover_mode(k, radius) -> str:
    """What a class's cover was asked for."""
    if k == "auto":
        return "auto_k_fixed_radius"
    return "fixed_k_auto_radius" if radius == "auto" else "fixed_k_fixed_radius"


def fit_diagnostics(diagnostics: DataFrame, d: int, high_dim_threshold: int = 128, stored: bool = False) -> DataFrame:
    """One row on the whole fit, from the diagnostics by class."""
    return diagnostics.agg(
        F.sum("n_samples").cast("long").alias("n_samples"), F.lit(d).cast("long").alias("n_features"), F.count("*").alias("n_classes"), F.sum("n_balls").alias("n_balls"),
        F.max("metric").alias("metric"), F.lit(high_dim_threshold).alias("high_dim_threshold"), F.max("target_fraction").alias("cover_fraction"), F.lit(stored).alias("stored_memberships"),
    )


#: Farthest rows of all classes that come to the driver in a pass, in numbers, and of one class at most; numbers that are worked on at once.
FAR_NUMBERS, FAR_ROWS, AT_ONCE = 1 << 22, 1024, 1 << 21
_STATE = "row_id long, label string, features array<double>, near double, owner int, covered_at int"


class _Growing:
    """A class's cover while it grows: rows and places of its centres in order, how many of them the table knows of, and the farthest rows found."""

    def __init__(self, size: int, k, radius, cover_fraction: float, max_balls: int | None):
        self.size, self.cover_fraction, self.max_balls = size, cover_fraction, max_balls
        self.k = None if k == "auto" else min(int(k), size)
        self.r2 = None if radius == "auto" else float(radius) ** 2
        self.rows: list[int] = []
        self.x: list[np.ndarray] = []
        self.known, self.stopped, self.done = 0, False, False

    def add(self, row: int, x: np.ndarray) -> None:
        self.rows.append(int(row))
        self.x.append(x)

    def judge(self, covered: dict[int, int]) -> None:
        """Ends the cover if the centres the table knows of are enough; covered: rows first covered by each centre. Centres beyond the number that is enough are taken back."""
        if self.k is not None:
            self.done = len(self.rows) >= self.k
            return
        have = 0
        for m in range(1, self.known + 1):
            have += covered.get(m - 1, 0)
            enough = have / self.size >= self.cover_fraction or m >= self.size
            if enough or self.max_balls is not None and m >= self.max_balls:
                self.stopped, self.done = not enough, True
                del self.rows[m:], self.x[m:]
                return

    def reach(self, ids: np.ndarray, x: np.ndarray, near: np.ndarray) -> None:
        """Adds the next centres whose order is certain. The rows given are the farthest of the class, the farthest first, lower ids first among equals: no other row stands before the last of them, and distances only shrink, so a row that still stands before it is the farthest of all."""
        near = near.copy()
        whole = len(ids) == self.size
        bound = (-near[-1], ids[-1])
        most = self.k if self.k is not None else min(self.size, self.max_balls or self.size)
        while len(self.rows) < most:
            at = int(np.lexsort((ids, -near))[0])
            if not whole and (-near[at], ids[at]) > bound:
                break
            if self.k is None and self.r2 is not None and near[at] <= self.r2:
                break  # all rows are covered
            self.add(ids[at], x[at])
            near = np.minimum(near, ((x - x[at]) ** 2).sum(axis=1))


def _advanced(state: DataFrame, growing: dict[str, _Growing], fresh: bool) -> DataFrame:
    """The rows with their nearest distance after the centres the table does not know of yet. A row whose centre is at least twice as far from a new one as the row is from it keeps it, without a distance to the new one."""
    sets = {c: (np.array(g.x), g.known, -1.0 if g.r2 is None else g.r2) for c, g in growing.items() if not g.done}
    held = state.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        apart: dict[str, np.ndarray] = {}

        def between(c: str) -> np.ndarray:
            """Squared distances from every centre to every new one, a little too small, as float32."""
            if c not in apart:
                x, known, _ = held.value[c]
                out = np.empty((len(x), len(x) - known), np.float32)
                for i in range(known, len(x)):
                    out[:, i - known] = ((x - x[i]) ** 2).sum(axis=1)
                apart[c] = out * np.float32(0.9999)
            return apart[c]

        for batch in batches:
            ids, y, x = batch.column(0), np.array(batch.column(1).to_pylist(), dtype=object), matrix(batch.column(2))
            if fresh:
                near, owner, covered = np.full(len(y), np.inf), np.zeros(len(y), np.int32), np.full(len(y), -1, np.int32)
            else:
                near, owner, covered = (batch.column(i).to_numpy().copy() for i in (3, 4, 5))
            for c in set(y.tolist()) & held.value.keys():
                rows = np.flatnonzero(y == c)
                centers, known, r2 = held.value[c]
                far, mine, d, own = between(c), x[rows], near[rows], owner[rows]
                cov = covered[rows]
                for k in range(known, len(centers)):
                    some = np.flatnonzero(far[own, k - known] <= 4 * d)
                    if len(some):
                        new = ((mine[some] - centers[k]) ** 2).sum(axis=1)
                        closer = new < d[some]
                        some, new = some[closer], new[closer]
                        d[some], own[some] = new, k
                        hit = some[(cov[some] < 0) & (new <= r2)]
                        cov[hit] = k
                near[rows], owner[rows], covered[rows] = d, own, cov
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), batch.column(2), pa.array(near), pa.array(owner), pa.array(covered)], names=["row_id", "label", "features", "near", "owner", "covered_at"])

    return state.mapInArrow(run, _STATE)


def _farthest(state: DataFrame, classes: list[str], most: int) -> dict[str, tuple]:
    """For each class its `most` farthest rows, the farthest first: ids, features, squared distances."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best: dict[str, tuple] = {}
        for batch in batches:
            ids, y, x, near = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=object), matrix(batch.column(2)), batch.column(3).to_numpy()
            for c in set(y.tolist()):
                rows = np.flatnonzero(y == c)
                parts = [(ids[rows], x[rows], near[rows]), *([best[c]] if c in best else [])]
                i, v, d = (np.concatenate(p) for p in zip(*parts, strict=True))
                top = np.lexsort((i, -d))[:most]
                best[c] = i[top], v[top], d[top]
        for c, (i, v, d) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(i)), pa.array(i), pa.array(v.tolist(), pa.list_(pa.float64())), pa.array(d)], names=["label", "row_id", "features", "near"])

    mine = state.where(F.col("label").isin(*classes)).select("row_id", "label", "features", "near")
    found = mine.mapInArrow(run, "label string, row_id long, features array<double>, near double")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("near"), "row_id"))
    out: dict[str, list] = {}
    for r in found.withColumn("place", place).where(F.col("place") <= most).orderBy("label", "place").toLocalIterator():
        out.setdefault(r["label"], []).append(r)
    return {c: (np.array([r["row_id"] for r in rs]), np.array([r["features"] for r in rs], dtype=float), np.array([r["near"] for r in rs])) for c, rs in out.items()}


def cover_in_rounds(samples: DataFrame, sizes: dict[str, int], k, radius, cover_fraction: float, max_balls: int | None, kinds: str) -> DataFrame:
    """The same covers for classes that no single task can take.

    Every row carries its nearest distance and the centre it belongs to from pass to pass, so that a pass works out
    distances to the new centres only, and few of them (_advanced). A pass brings as many centres as
    its farthest rows leave no doubt about (reach), many of them where there are many to come.
    """
    spark = samples.sparkSession
    d = len(samples.select("features").first()["features"])
    growing = {c: _Growing(n, per_class(k, c, "k"), per_class(radius, c, "radius"), cover_fraction, max_balls) for c, n in sizes.items()}
    most = max(2, min(FAR_ROWS, FAR_NUMBERS // (d * len(sizes))))
    state, scratch = samples.select(F.col("row_id").cast("long").alias("row_id"), "label", F.col("features").cast("array<double>").alias("features")), Scratch(spark)
    for c, (row, x) in _nearest_to(state, {r["class"]: np.array(r["center"]) for r in class_means(samples, d).collect()}).items():
        growing[c].add(row, x)
    while any(not g.done for g in growing.values()):
        old = scratch
        scratch = Scratch(spark)
        left = [c for c, g in growing.items() if not g.done]
        state = scratch.written(_advanced(state.where(F.col("label").isin(*left)) if len(left) < len(growing) else state, growing, len(state.columns) == 3), "cover")
        old.discard()
        covered: dict[str, dict[int, int]] = {}
        for r in state.groupBy("label", "covered_at").count().collect():
            covered.setdefault(r["label"], {})[r["covered_at"]] = r["count"]
        for c, g in growing.items():
            if not g.done:
                g.known = len(g.rows)
                g.judge(covered[c])
        live = [c for c, g in growing.items() if not g.done]
        for c, (ids, x, near) in (_farthest(state, live, most) if live else {}).items():
            growing[c].reach(ids, x, near)
            growing[c].done = growing[c].k is not None and len(growing[c].rows) >= growing[c].k
    scratch.discard()
    near = _nearest_distances(samples, {c: np.array(g.x) for c, g in growing.items()})
    radii = {c: math.sqrt(g.r2) for c, g in growing.items() if g.r2 is not None}
    auto = [c for c in sizes if c not in radii]
    if auto:  # radii from the distribution of nearest distances
        of_auto = near.where(F.col("g").isin(*auto))
        for c, q in quantiles(of_auto, [cover_fraction], sum(sizes[c] for c in auto)).items():
            radii[c] = float(np.sqrt(max(q[0], EPS32)))
    bound = F.create_map(*(F.lit(v) for c in sizes for v in (c, radii[c] ** 2)))[F.col("g")]
    final = {r["g"]: r for r in near.groupBy("g").agg(F.avg((F.col("v") <= bound).cast("int")).alias("covered"), F.avg(F.sqrt("v")).alias("mean"), F.max(F.sqrt("v")).alias("most")).collect()}
    rows = [(c, i, x.tolist(), row, radii[c], sizes[c], *(float(final[c][f]) for f in ("covered", "mean", "most")), g.stopped) for c, g in growing.items() for i, (row, x) in enumerate(zip(g.rows, g.x, strict=True))]
    return spark.createDataFrame(rows, kinds)


def _nearest_to(samples: DataFrame, points: dict[str, np.ndarray]) -> dict[str, tuple]:
    """row_id and features of the row of each class nearest to a point, of equally near ones the lower id. samples: row_id, label, features."""
    held = samples.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best: dict[str, tuple] = {}
        for batch in batches:
            ids, y, x = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=object), matrix(batch.column(2))
            for c in set(y.tolist()):
                rows = np.flatnonzero(y == c)
                near = ((x[rows] - held.value[c]) ** 2).sum(axis=1)
                at = np.lexsort((ids[rows], near))[0]
                found = float(near[at]), int(ids[rows[at]]), x[rows[at]].tolist()
                best[c] = min(found, best.get(c, found))
        if best:
            yield pa.RecordBatch.from_pylist([{"class": c, "v": v, "row_id": i, "x": x} for c, (v, i, x) in best.items()])

    got = samples.mapInArrow(run, "class string, v double, row_id long, x array<double>").groupBy("class").agg(F.min(F.struct("v", "row_id", "x")).alias("b"))
    return {r["class"]: (r["b"]["row_id"], np.array(r["b"]["x"])) for r in got.collect()}


def _nearest_distances(samples: DataFrame, centers: dict[str, np.ndarray]) -> DataFrame:
    """g (the label), v (squared distance to the nearest centre of the label), row_id."""
    held = samples.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            y, x = np.array(batch.column(1).to_pylist(), dtype=object), matrix(batch.column(2))
            near = np.full(len(y), np.inf)
            for c in set(y.tolist()):
                rows = np.flatnonzero(y == c)
                for a in range(0, len(rows), step := max(1, AT_ONCE // held.value[c].size)):
                    some = rows[a : a + step]
                    near[some] = ((x[some][:, None, :] - held.value[c]) ** 2).sum(axis=2).min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(near), batch.column(0)], names=["g", "v", "row_id"])

    return samples.select(F.col("row_id").cast("long").alias("row_id"), "label", "features").mapInArrow(run, "g string, v double, row_id long")


def memberships(samples: DataFrame, prototypes: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """pid, row_id: the rows of a ball's own class within its radius; a row may lie in several balls."""

    def emit(named, x, block: Block):
        at = {c: i for i, c in enumerate(block.classes)}
        y, ids = np.array([at.get(v, -1) for v in named["label"].to_pylist()]), named["row_id"].to_numpy()
        pids, rows = [block.pid[:0]], [ids[:0]]
        for c in np.unique(y[y >= 0]).tolist():
            mine, own = np.flatnonzero(y == c), np.flatnonzero(block.of == c)
            for a in range(0, len(mine), step := max(1, at_once // (len(own) * x.shape[1]))):
                some = mine[a : a + step]
                i, p = np.nonzero(((x[some][:, None, :] - block.center[own]) ** 2).sum(axis=2) <= block.radius2[own])
                pids.append(block.pid[own[p]])
                rows.append(ids[some[i]])
        return {"pid": np.concatenate(pids).astype(np.int32), "row_id": np.concatenate(rows)}

    return by_batch(samples, prototypes, ["label", "row_id"], "pid int, row_id long", emit)


__all__ = ["ball_cover", "class_means", "kmeans", "landmarks", "lloyd", "memberships", "minibatch_kmeans"]
