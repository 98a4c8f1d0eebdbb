"""Queries of the continuous index, with SQL twins. Prototypes are cell means, which SQL can rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isthmus.estimators import ContinuousSeparability
from isthmus.functions.session import Scratch
from isthmus.operators import backends, validation
from isthmus.operators import continuous as co
from isthmus.operators import prototypes as proto
from isthmus.operators.scoring import held, own_best
from isthmus.sources import tables

CELLS, DIGITS, PERMUTATIONS = 4, 9, 5
DIRECTIONS = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8], [0.8, -0.6]]


def r6(column: str):
    return (F.round(F.col(column), 6) + F.lit(0.0)).alias(column)


def _part(spark: SparkSession, d: str, target=("p_retailprice",), how: str = "standard") -> DataFrame:
    s = tables.samples(tables.read(spark, d, "part").withColumn("u", F.col("p_size") / 50.0), "p_partkey", ["u"], None, list(target))
    return co.scaled_targets(s, how, DIGITS)


def _scaled(how):
    def query(spark, d):
        return _part(spark, d, how=how).select("row_id", F.round(F.col("target")[0], 6).alias("y"))

    return query


def target_scale_robust_orders(spark, d):
    return co.scaled_targets(tables.orders(spark, d), "robust").select("row_id", F.round(F.col("target")[0], 6).alias("y"))


def quantile_cells(spark, d):
    s = co.scaled_targets(tables.orders(spark, d), "standard", DIGITS)
    return co.quantile_cells(s, 8, DIGITS).groupBy("cell").agg(F.count("*").alias("n"), F.min(F.col("target")[0]).alias("lo"), F.max(F.col("target")[0]).alias("hi")).select(F.col("cell").cast("long").alias("cell"), "n", r6("lo"), r6("hi"))


def kmeans_cells(spark, d):
    s = co.scaled_targets(tables.parts(spark, d, ("p_retailprice", "p_size")))
    return co.kmeans_cells(s, 6).groupBy(F.col("cell").cast("long").alias("cell")).agg(F.count("*").alias("n"))


def _fit(spark, d, target=("p_retailprice",)):
    """Samples with cells, prototypes, own prototypes and their targets; each part is worked out once."""
    scratch = Scratch(spark)
    s = scratch.written(co.cells_of(_part(spark, d, target), "quantile", CELLS, digits=DIGITS), "cells")
    p = held(proto.class_means(s, 1))
    own = scratch.written(own_best(s, p).select("row_id", "pid"), "own")
    return s, p, own, s.join(own, "row_id").select("pid", "target")


def _all_pairs(targets, both: bool = False):
    """Every pair of prototypes, which are few: from their ids on the driver."""
    ids = sorted(r["pid"] for r in targets.select("pid").distinct().collect())
    return targets.sparkSession.createDataFrame([(p, q) for p in ids for q in ids if p < q or both and p > q], "p int, q int")


def w1_between_cells(spark, d):
    *_, t = _fit(spark, d)
    return co.wasserstein(co.projected(t, None), _all_pairs(t)).select(*(F.col(c).cast("long").alias(c) for c in "pq"), r6("distance"))


def sliced_w1(spark, d):
    s = _part(spark, d, ("p_retailprice", "p_size"))
    one = co.cells_of(s, "quantile", CELLS, digits=DIGITS)
    t = one.select(F.col("cell").alias("pid"), "target")
    return co.wasserstein(co.projected(t, DIRECTIONS), _all_pairs(t)).select(*(F.col(c).cast("long").alias(c) for c in "pq"), r6("distance"))


def coi_adjacency(spark, d):
    s, p, own, _ = _fit(spark, d)
    return co.adjacency(s, p, own).select(*(F.col(c).cast("long").alias(c) for c in "pq"), "n", r6("alpha"))


def coi_prototype_stats(spark, d):
    *_, t = _fit(spark, d)
    st = co.prototype_stats(t)
    return st.select(F.col("pid").cast("long").alias("pid"), "support", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.col("covariance")[0][0], 6).alias("variance"), r6("radius"))


def _losses(spark, d):
    s, p, own, t = _fit(spark, d)
    adj = co.adjacency(s, p, own)
    dist = co.wasserstein(co.projected(t, None), adj)
    return s, p, own, t, co.local_losses(adj, dist, t.groupBy("pid").agg(F.count("*").alias("support")))


def coi_actual_loss(spark, d):
    return co.overall_loss(_losses(spark, d)[-1]).select(r6("loss"))


def _null(spark, d, fitted=None):
    s, p, own, t = fitted or _fit(spark, d)
    dist = co.wasserstein(co.projected(t, None), _all_pairs(t, both=True))
    return co.null_losses_of_means(s.join(own, "row_id").select("row_id", "features", "label", "pid"), dist, PERMUTATIONS, 1)


def coi_null_loss(spark, d):
    return _null(spark, d).select(F.col("perm").cast("long").alias("perm"), r6("loss"))


def coi_index(spark, d):
    *fitted, losses = _losses(spark, d)
    losses = Scratch(spark).written(losses, "losses")
    actual = co.overall_loss(losses).first()["loss"]
    null = _null(spark, d, fitted).agg(F.avg("loss").alias("m")).first()["m"]
    own = losses.withColumn("i", co.clipped(co.index_column(F.col("loss"), null)))
    out = own.agg(co.clipped(F.avg("i")).alias("macro_index"), co.clipped(F.sum(F.col("i") * F.col("support")) / F.sum("support")).alias("weighted_index"))
    return out.select(r6("macro_index"), r6("weighted_index"), F.round(F.lit(co.raw_index(actual, null)), 6).alias("raw_index"), F.round(F.lit(actual), 6).alias("actual_loss"), F.round(F.lit(null), 6).alias("null_loss"), F.round(F.lit(actual / null), 6).alias("loss_ratio"))


def _cells(spark, d):
    return Scratch(spark).written(co.cells_of(_part(spark, d), "quantile", CELLS, digits=DIGITS), "cells")


def coi_null_refit(spark, d):
    """The losses of chance with prototypes fitted anew for every permutation: one mean a cell."""
    return co.null_losses(_cells(spark, d), lambda s: proto.class_means(s, 1), PERMUTATIONS).select(F.col("perm").cast("long").alias("perm"), r6("loss"))


def coi_null_refit_marks(spark, d):
    """The same with two prototypes a cell: the rows of least id that a permutation puts there."""
    return co.null_losses(_cells(spark, d), lambda s: proto.landmarks(s, 2), PERMUTATIONS).select(F.col("perm").cast("long").alias("perm"), r6("loss"))


class _Means(backends.Backend):
    """One prototype for each cell, its mean."""

    def fit(self, samples):
        return proto.class_means(samples, 1)


class _OfMeans(ContinuousSeparability):
    backend = property(_Means)


def est_continuous(spark, d):
    """The estimator with one mean a cell, raw targets and 5 permutations."""
    s = tables.samples(tables.read(spark, d, "part").withColumn("u", F.col("p_size") / 50.0), "p_partkey", ["u"], None, ["p_retailprice"])
    m = _OfMeans(n_target_cells=CELLS, n_null_permutations=PERMUTATIONS, target_scaling="none").fit(s)
    row = (m.index, m.macro_index_, m.weighted_index, m.raw_index_, m.actual_loss_, m.null_loss_)
    m.reset()
    return spark.createDataFrame([(*(round(v, 6) for v in row), m.index)], "index double, macro_index double, weighted_index double, raw_index double, actual_loss double, null_loss double, after_reset double")


def coi_cell_prototypes(spark, d):
    """Which prototypes a cell owns, with two a cell."""
    p = proto.landmarks(_cells(spark, d), 2)
    return p.groupBy(F.col("class").cast("long").alias("cell")).agg(F.count("*").alias("n"), F.min("pid").cast("long").alias("first"), F.max("pid").cast("long").alias("last"))


def kmeans_cells_fixed(spark, d):
    """Target cells by k-means, with starts drawn by row id and a fixed number of rounds."""
    s = _part(spark, d, ("p_retailprice", "p_size"))
    cells = co.kmeans_cells(s, 4, options={"init": "random", "max_iter": 2, "tol": 0.0, "random_state": 7})
    return cells.groupBy(F.col("cell").cast("long").alias("cell")).agg(F.count("*").alias("n"), F.round(F.min(F.col("target")[0]), 6).alias("lo"), F.round(F.max(F.col("target")[1]), 6).alias("hi"))


def target_scale_flat(spark, d):
    """Constant targets: a scale of zero counts as one, so all become 0."""
    s = tables.samples(tables.read(spark, d, "part").withColumn("y", F.lit(5.0)), "p_partkey", ["p_size"], None, ["y"])
    one = lambda how: co.scaled_targets(s, how).groupBy(F.col("target")[0].alias("y")).agg(F.count("*").alias("n")).select(F.lit(how).alias("how"), "y", "n")
    return one("standard").unionByName(one("minmax")).unionByName(one("robust"))


def validate_targets(spark, d):
    """Targets as arrays, single numbers or columns, checked."""
    s = validation.targets(tables.read(spark, d, "part").select(F.col("p_retailprice").alias("target")))
    return validation.feature_report(s, "target")


def w1_missing_side(spark, d):
    """A prototype that its samples vote for but that owns no sample adds no distance."""
    s, p, own, t = _fit(spark, d)
    adj = co.adjacency(s, p, own)
    gone = t.where("pid <> 1")
    dist = co.wasserstein(co.projected(gone, None), adj)
    return co.local_losses(adj, dist, gone.groupBy("pid").agg(F.count("*").alias("support"))).select(F.col("pid").cast("long").alias("pid"), "support", r6("loss"))


def degenerate_single_cell(spark, d):
    """One cell: no prototype has another to vote for, so the loss is 0 and the index 1."""
    s = co.cells_of(_part(spark, d), "quantile", 1, digits=DIGITS)
    p = proto.class_means(s, 1)
    own = own_best(s, p).select("row_id", "pid")
    t = s.join(own, "row_id").select("pid", "target")
    adj = co.adjacency(s, p, own)
    loss = co.local_losses(adj, co.wasserstein(co.projected(t, None), adj), t.groupBy("pid").agg(F.count("*").alias("support")))
    actual = co.overall_loss(loss).first()["loss"]
    return spark.createDataFrame([(co.raw_index(actual, 0.0), float(actual))], "index double, loss double")


STAT = """y AS (SELECT p_partkey AS row_id, p_size / 50.0::DOUBLE AS x, p_retailprice AS y, p_size::DOUBLE AS y2 FROM part),
st AS (SELECT avg(y) AS m, CASE WHEN stddev_pop(y) <= 2.220446049250313e-16 THEN 1 ELSE stddev_pop(y) END AS sd, avg(y2) AS m2, CASE WHEN stddev_pop(y2) <= 2.220446049250313e-16 THEN 1 ELSE stddev_pop(y2) END AS sd2 FROM y),
s AS (SELECT row_id, x, round((y - m) / sd, 9) AS y, round((y2 - m2) / sd2, 9) AS y2 FROM y, st),
ed AS (SELECT list_transform(quantile_cont(y, [0.25, 0.5, 0.75]), lambda q: round(q, 9)) AS e FROM s),
c AS (SELECT s.*, len(list_filter(list_distinct(e), lambda v: v <= y)) AS cell FROM s, ed),
p AS (SELECT row_number() OVER (ORDER BY cell) - 1 AS pid, cell, avg(x) AS c, count(*) AS support FROM c GROUP BY cell),
o AS (SELECT c.*, p.pid, p.support FROM c JOIN p USING (cell))"""


def w1_sql(values: str, pairs: str) -> str:
    """CTEs w1(p, q, distance) from CTEs with pid, dir, v and with p, q."""
    return f"""ms AS (SELECT pid, dir, v, count(*) / sum(count(*)) OVER (PARTITION BY pid, dir) AS w FROM {values} GROUP BY pid, dir, v),
sp AS (SELECT q.p, q.q, dir, v, w FROM {pairs} q JOIN ms ON ms.pid = q.p UNION ALL SELECT q.p, q.q, dir, v, -w FROM {pairs} q JOIN ms ON ms.pid = q.q),
sg AS (SELECT p, q, dir, v, sum(w) AS w FROM sp GROUP BY 1, 2, 3, 4),
ar AS (SELECT p, q, dir, abs(sum(w) OVER (PARTITION BY p, q, dir ORDER BY v)) * (lead(v) OVER (PARTITION BY p, q, dir ORDER BY v) - v) AS a FROM sg),
w1 AS (SELECT p, q, avg(d) AS distance FROM (SELECT p, q, dir, coalesce(sum(a), 0) AS d FROM ar GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


VOTES = """vt AS (SELECT o.row_id, o.pid AS p, o.support, arg_min(p.pid, (round(power(o.x - p.c, 2), 12), p.pid)) AS q FROM o JOIN p ON p.pid <> o.pid GROUP BY 1, 2, 3),
ad AS (SELECT p, q, count(*) AS n, count(*) / any_value(support) AS alpha FROM vt GROUP BY p, q)"""
VALUES = "vv AS (SELECT pid, 0 AS dir, y AS v FROM o), pq AS (SELECT a.pid AS p, b.pid AS q FROM p a JOIN p b ON a.pid <> b.pid)"
LOSS = "lo AS (SELECT p.pid, p.support, coalesce(sum(alpha * distance), 0) AS loss FROM p LEFT JOIN (ad JOIN w1 USING (p, q)) z ON z.p = p.pid GROUP BY 1, 2), ac AS (SELECT sum(support * loss) / sum(support) AS loss FROM lo)"


def permutation_sql(rows: str, key: str = "") -> str:
    """CTEs sz(size, half, mask) and pl(perm, i, at): the place of each number of a table with a column k (from 1), in every permutation. The cipher of operators.continuous.ciphered; the recursion is its cycle walk."""

    def cipher(source: str) -> str:
        out = f"SELECT perm, i, v >> half AS a, v & mask AS b, half, mask FROM ({source}) z, sz"
        for r in range(co.CIPHER_ROUNDS):
            k = f"('0x' || substr(md5('{key}' || perm || '-{r}'), 1, 8))::BIGINT"
            out = f"""SELECT perm, i, b AS a, xor(a, xor(x2, x2 >> 15) & mask) AS b, half, mask FROM (SELECT *, xor(x1, x1 >> 12) * {co.MIX[1]} % 4294967296 AS x2
FROM (SELECT *, xor(x0, x0 >> 15) * {co.MIX[0]} % 4294967296 AS x1 FROM (SELECT *, (b + {k}) % 4294967296 AS x0 FROM ({out}))))"""
        return f"SELECT perm, i, (a << half) | b AS v FROM ({out})"

    return f"""sz AS (SELECT size, h AS half, (1::BIGINT << h) - 1 AS mask FROM (SELECT count(*) AS size FROM {rows}), range(1, 31) t(h) WHERE (1::BIGINT << (2 * h)) >= size ORDER BY h LIMIT 1),
wk AS ({cipher(f"SELECT perm, k - 1 AS i, k - 1 AS v FROM {rows}, range({PERMUTATIONS}) r(perm)")} UNION ALL {cipher("SELECT perm, i, v FROM wk WHERE v >= (SELECT size FROM sz)")}),
pl AS (SELECT perm, i + 1 AS k, v + 1 AS at FROM wk WHERE v < (SELECT size FROM sz))"""


def moved_sql(key: str = "") -> str:
    """CTEs ry(row_id, x, k) and pl."""
    return f"ry AS (SELECT row_id, x, row_number() OVER (ORDER BY row_id) AS k FROM c), {permutation_sql('ry', key)}"


def means_sql(key: str = "") -> str:
    return f"""{moved_sql(key)},
py AS (SELECT perm, o.pid, pl.at AS k FROM o JOIN ry USING (row_id) JOIN pl USING (k)),
sh AS (SELECT perm, ry.row_id, ry.x, pid FROM ry JOIN py USING (k)),
pm AS (SELECT perm, pid, avg(x) AS c FROM sh GROUP BY perm, pid),
pv AS (SELECT sh.perm, sh.row_id, sh.pid AS p, arg_min(pm.pid, (round(power(sh.x - pm.c, 2), 12), pm.pid)) AS q FROM sh JOIN pm ON pm.perm = sh.perm AND pm.pid <> sh.pid GROUP BY 1, 2, 3),
nl AS (SELECT perm, sum(distance) / (SELECT count(*) FROM o) AS loss FROM pv JOIN w1 USING (p, q) GROUP BY perm)"""


def null_sql(marks: int | None = None) -> str:
    """Losses of permutations with prototypes of their own: the first `marks` rows of each cell, with distances between the targets that each prototype's rows have."""
    return f"""{moved_sql()},
py AS (SELECT perm, c.cell, c.y, pl.at AS k FROM c JOIN ry USING (row_id) JOIN pl USING (k)),
sh AS (SELECT perm, ry.row_id, ry.x, cell, y FROM ry JOIN py USING (k)),
pm AS (SELECT perm, cell, x AS c, row_number() OVER (ORDER BY perm, cell, l) - 1 AS pid FROM (SELECT *, row_number() OVER (PARTITION BY perm, cell ORDER BY row_id) AS l FROM sh) WHERE l <= {marks}),
po AS (SELECT sh.perm, sh.row_id, sh.x, sh.y, arg_min(pm.pid, (round(power(sh.x - pm.c, 2), 12), pm.pid)) AS p FROM sh JOIN pm ON pm.perm = sh.perm AND pm.cell = sh.cell GROUP BY 1, 2, 3, 4),
pv AS (SELECT po.perm, po.row_id, po.p, arg_min(pm.pid, (round(power(po.x - pm.c, 2), 12), pm.pid)) AS q FROM po JOIN pm ON pm.perm = po.perm AND pm.pid <> po.p GROUP BY 1, 2, 3),
vv AS (SELECT p AS pid, 0 AS dir, y AS v FROM po), pq AS (SELECT DISTINCT p, q FROM pv WHERE q IN (SELECT pid FROM vv)),
{w1_sql('vv', 'pq')},
nl AS (SELECT perm, sum(distance) / (SELECT count(*) FROM c) AS loss FROM pv JOIN w1 USING (p, q) GROUP BY perm)"""


def sql() -> dict[str, str]:
    raw = STAT.replace("round((y - m) / sd, 9) AS y", "y").replace("list_transform(quantile_cont(y, [0.25, 0.5, 0.75]), lambda q: round(q, 9))", "quantile_cont(y, [0.25, 0.5, 0.75])")
    of_raw = f"WITH RECURSIVE {raw}, {VALUES}, {w1_sql('vv', 'pq')}, {VOTES}, {LOSS}, {means_sql('0:')}"
    base = f"WITH RECURSIVE {STAT}"
    full = f"{base}, {VALUES}, {w1_sql('vv', 'pq')}, {VOTES}, {LOSS}"
    dirs = " UNION ALL ".join(f"SELECT cell AS pid, {i} AS dir, {w[0]!r} * y + {w[1]!r} * y2 AS v FROM c" for i, w in enumerate(DIRECTIONS))
    step = """a{n} AS (SELECT row_id, y, y2, arg_min(l, (power(y - a, 2) + power(y2 - b, 2), l)) AS l FROM s, q{m} GROUP BY row_id, y, y2),
q{n} AS (SELECT l, avg(y) AS a, avg(y2) AS b FROM a{n} GROUP BY l)"""
    part = "WITH y AS (SELECT p_partkey AS row_id, p_retailprice AS y FROM part) SELECT row_id, round({}, 6) AS y FROM y"
    from .discrete import converged_sql

    targets = """s AS (SELECT p_partkey AS row_id, [(p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER ()] AS x, 't' AS label FROM part)"""
    return {
        "kmeans_cells": f"{converged_sql(False, 2, 6, targets)} SELECT cell, count(*) AS n FROM (SELECT arg_min(p.pid, (power(list_distance(s.x, p.c), 2), p.pid)) AS cell FROM s, p GROUP BY s.row_id) GROUP BY cell",
        "target_scale_none": part.format("y"),
        "target_scale_standard": part.format("round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 9)"),
        "target_scale_minmax": part.format("(y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ())"),
        "target_scale_robust": part.format("(y - (SELECT median(y) FROM y)) / (SELECT quantile_cont(y, 0.75) - quantile_cont(y, 0.25) FROM y)"),
        "target_scale_robust_orders": "WITH y AS (SELECT o_orderkey AS row_id, o_totalprice AS y FROM orders) SELECT row_id, round((y - (SELECT median(y) FROM y)) / (SELECT quantile_cont(y, 0.75) - quantile_cont(y, 0.25) FROM y), 6) AS y FROM y",
        "quantile_cells": """WITH y AS (SELECT round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 9) AS y FROM orders),
ed AS (SELECT list_distinct(list_transform(quantile_cont(y, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]), lambda q: round(q, 9))) AS e FROM y),
c AS (SELECT y, len(list_filter(e, lambda v: v <= y)) AS cell FROM y, ed)
SELECT cell, count(*) AS n, round(min(y), 6) AS lo, round(max(y), 6) AS hi FROM c GROUP BY cell""",
        "w1_between_cells": f"{base}, {VALUES}, {w1_sql('vv', 'pq')} SELECT p, q, round(distance, 6) AS distance FROM w1 WHERE p < q",
        "sliced_w1": f"{base}, vv AS ({dirs}), pq AS (SELECT a.cell AS p, b.cell AS q FROM p a JOIN p b ON a.cell < b.cell), {w1_sql('vv', 'pq')} SELECT p, q, round(distance, 6) AS distance FROM w1",
        "coi_adjacency": f"{base}, {VOTES} SELECT p, q, n, round(alpha, 6) AS alpha FROM ad",
        "coi_prototype_stats": f"{base} SELECT pid, count(*) AS support, round(avg(y), 6) AS mean, round(coalesce(var_samp(y), 0), 6) AS variance, round(max(abs(y - m)), 6) AS radius FROM o JOIN (SELECT pid, avg(y) AS m FROM o GROUP BY pid) USING (pid) GROUP BY pid",
        "coi_actual_loss": f"{full} SELECT round(loss, 6) AS loss FROM ac",
        "coi_null_loss": f"{full}, {means_sql()} SELECT perm, round(loss, 6) AS loss FROM nl",
        "coi_index": f"""{full}, {means_sql()}, nn AS (SELECT avg(loss) AS m FROM nl), pi AS (SELECT support, least(greatest(1 - 0.5 * loss / m, 0), 1) AS i FROM lo, nn)
SELECT round(avg(i), 6) AS macro_index, round(sum(i * support) / sum(support), 6) AS weighted_index, round(1 - 0.5 * any_value(ac.loss) / any_value(m), 6) AS raw_index,
  round(any_value(ac.loss), 6) AS actual_loss, round(any_value(m), 6) AS null_loss, round(any_value(ac.loss) / any_value(m), 6) AS loss_ratio FROM pi, ac, nn""",
        "coi_null_refit": f"{full}, {means_sql()} SELECT perm, round(loss, 6) AS loss FROM nl",
        "coi_null_refit_marks": f"{base}, {null_sql(2)} SELECT perm, round(loss, 6) AS loss FROM nl",
        "est_continuous": f"""{of_raw}, nn AS (SELECT avg(loss) AS m FROM nl), pi AS (SELECT support, least(greatest(1 - 0.5 * loss / m, 0), 1) AS i FROM lo, nn)
SELECT round(sum(i * support) / sum(support), 6) AS index, round(avg(i), 6) AS macro_index, round(sum(i * support) / sum(support), 6) AS weighted_index,
  round(1 - 0.5 * any_value(ac.loss) / any_value(m), 6) AS raw_index, round(any_value(ac.loss), 6) AS actual_loss, round(any_value(m), 6) AS null_loss, 1.0::DOUBLE AS after_reset FROM pi, ac, nn""",
        "coi_cell_prototypes": f"{base}, m AS (SELECT cell, row_number() OVER (PARTITION BY cell ORDER BY row_id) AS l FROM c QUALIFY l <= 2), i AS (SELECT cell, row_number() OVER (ORDER BY cell, l) - 1 AS pid FROM m) SELECT cell, count(*) AS n, min(pid) AS first, max(pid) AS last FROM i GROUP BY cell",
        "kmeans_cells_fixed": f"""{base}, u AS (SELECT *, ('0x' || substr(md5('7-0-' || row_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM s),
q0 AS (SELECT row_number() OVER (ORDER BY u, row_id) - 1 AS l, y AS a, y2 AS b FROM u QUALIFY l < 4),
{step.format(n=1, m=0)}, {step.format(n=2, m=1)}, e AS (SELECT row_id, y, y2, arg_min(l, (power(y - a, 2) + power(y2 - b, 2), l)) AS cell FROM s, q2 GROUP BY row_id, y, y2)
SELECT cell, count(*) AS n, round(min(y), 6) AS lo, round(max(y2), 6) AS hi FROM e GROUP BY cell""",
        "target_scale_flat": " UNION ALL ".join(f"SELECT '{h}' AS how, 0.0::DOUBLE AS y, count(*) AS n FROM part" for h in ("standard", "minmax", "robust")),
        "validate_targets": "SELECT count(*) AS n_rows, 1::INT AS min_size, 1::INT AS max_size, count_if(p_retailprice IS NULL OR NOT isfinite(p_retailprice))::BIGINT AS non_finite FROM part",
        "w1_missing_side": f"{full} SELECT p.pid, p.support, round(coalesce(sum(alpha * distance) FILTER (WHERE z.q <> 1), 0), 6) AS loss FROM p LEFT JOIN (ad JOIN w1 USING (p, q)) z ON z.p = p.pid WHERE p.pid <> 1 GROUP BY 1, 2",
        "degenerate_single_cell": "SELECT 1.0::DOUBLE AS index, 0.0::DOUBLE AS loss",
    }


def queries() -> dict:
    out = {f"target_scale_{h}": _scaled(h) for h in co.SCALINGS}
    return out | {n: globals()[n] for n in sql() if n not in out}
