import numpy as np
import pytest

from isthmus.estimators import ContinuousSeparability
from isthmus.operators import continuous as co

KIND = "row_id long, features array<double>, target array<double>"


def frame(spark, x, y):
    y = np.asarray(y, float).reshape(len(x), -1)
    return spark.createDataFrame([(i, list(map(float, a)), list(map(float, b))) for i, (a, b) in enumerate(zip(x, y, strict=True))], KIND).repartition(2)


def scaled(x):
    return (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))


def separated():
    rng = np.random.default_rng(0)
    half = 40
    x = np.concatenate([rng.normal(-2, 0.12, (half, 2)), rng.normal(2, 0.12, (half, 2))])
    y = np.concatenate([rng.normal(-2, 0.08, half), rng.normal(2, 0.08, half)])
    return scaled(x), y


def pathological():
    rng = np.random.default_rng(1)
    return scaled(rng.normal(0, 0.05, (80, 2))), np.where(np.arange(80) % 2, 2.0, -2.0) + rng.normal(0, 0.03, 80)


def fit(spark, x, y, **how):
    args = {"model_type": "KMeans", "kmeans_k": 2, "n_target_cells": 2, "n_null_permutations": 6, "random_state": 1} | how
    return ContinuousSeparability(**args).fit(frame(spark, x, y))


def test_order_of_scores(spark):
    x, y = separated()
    good = fit(spark, x, y)
    assert good.index > 0.55 and good.actual_loss_ < good.null_loss_
    mixed = fit(spark, x, np.random.default_rng(2).permutation(y), n_null_permutations=8)
    assert 0.25 <= mixed.index <= 0.75
    bad = fit(spark, *pathological())
    assert bad.index < 0.5 and bad.actual_loss_ > bad.null_loss_


def test_several_targets_use_sliced_distances(spark):
    x, y = separated()
    m = fit(spark, x, np.stack([y, y**2], axis=1), n_projections=8, n_null_permutations=3)
    assert m.resolved_distance_ == "sliced_wasserstein" and 0 <= m.index <= 1
    assert m.prototype_stats_.select("covariance").first()[0].__len__() == 2


def test_same_seed_same_score(spark):
    x, y = separated()
    a, b = (fit(spark, x, y, n_null_permutations=2) for _ in range(2))
    assert (a.index, a.null_loss_) == (b.index, b.null_loss_)


def test_adjacency_rows_sum_to_one(spark):
    m = fit(spark, *separated(), n_null_permutations=1)
    sums = {}
    for r in m.adjacency_.collect():
        assert r.p != r.q
        sums[r.p] = sums.get(r.p, 0) + r.alpha
    assert all(v == pytest.approx(1) for v in sums.values())


def w1(a, b):
    v = np.sort(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(s), v[:-1], side="right") / len(s) for s in (a, b))
    return float((np.abs(fa - fb) * np.diff(v)).sum())


def test_wasserstein(spark):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(0, 1, 30).round(1), 1: rng.normal(1, 2, 17).round(1), 2: np.array([5.0])}
    t = spark.createDataFrame([(p, [float(v)]) for p, vs in groups.items() for v in vs], "pid int, target array<double>")
    pairs = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (2, 2), (0, 9)], "p int, q int")
    got = {(r.p, r.q): r.distance for r in co.wasserstein(co.projected(t, None), pairs).collect()}
    assert set(got) == {(0, 1), (1, 0), (2, 0), (2, 2)}
    for (p, q), d in got.items():
        assert d == pytest.approx(w1(groups[p], groups[q]))


def test_scalings(spark):
    y = np.array([1.0, 2.0, 4.0, 9.0])
    s = frame(spark, np.zeros((4, 1)), y)
    want = {"none": y, "standard": (y - y.mean()) / y.std(), "minmax": (y - 1) / 8, "robust": (y - 3) / (np.quantile(y, 0.75) - np.quantile(y, 0.25))}
    for how, v in want.items():
        got = [r.target[0] for r in co.scaled_targets(s, how).orderBy("row_id").collect()]
        assert np.allclose(got, v)
    flat = co.scaled_targets(frame(spark, np.zeros((3, 1)), [5.0, 5.0, 5.0])).collect()
    assert [r.target for r in flat] == [[0.0]] * 3


def test_permutations_are_permutations(spark):
    s = spark.createDataFrame([(i, [float(i)], i * 10) for i in range(37)], "row_id long, features array<double>, v int").repartition(3)
    rows = co.permuted(s, 3, ["v"]).collect()
    for k in range(3):
        part = {r.row_id: r.v for r in rows if r.perm == k}
        assert sorted(part) == list(range(37)) and sorted(part.values()) == [i * 10 for i in range(37)] and any(part[i] != i * 10 for i in part)


def test_resolution_and_errors(spark):
    assert co.cell_count(100) == 10 and co.cell_count(4) == 4 and co.cell_count(10**6) == 64 and co.cell_count(5, 9) == 5
    assert co.resolved_cover("auto", 1) == "quantile" and co.resolved_cover("auto", 2) == "kmeans"
    for f in (lambda: co.resolved_cover("quantile", 2), lambda: co.resolved_distance("wasserstein", 2), lambda: ContinuousSeparability(aggregation="x"), lambda: ContinuousSeparability(n_null_permutations=0)):
        with pytest.raises(ValueError):
            f()
    for how in ({"model_type": "Fuzzy"}, {"adjacency_mode": "soft_topk"}):
        with pytest.raises(NotImplementedError):
            ContinuousSeparability(**how)
    with pytest.raises(ValueError, match="numeric"):
        ContinuousSeparability().fit(spark.createDataFrame([(0, [1.0], "a")], "row_id long, features array<double>, target string"))


def test_degenerate(spark):
    with pytest.warns(RuntimeWarning, match="no samples"):
        assert ContinuousSeparability().fit(spark.createDataFrame([], KIND)).index == 1.0
    with pytest.warns(RuntimeWarning, match="one target cell"):
        assert fit(spark, np.random.default_rng(0).random((10, 2)), np.ones(10)).index == 1.0
    assert co.raw_index(0.0, 0.0) == 1.0 and co.raw_index(1.0, 0.0) == float("-inf")


def test_quantiles_by_splitters(spark, monkeypatch):
    from isthmus.functions import session

    rng = np.random.default_rng(5)
    rows = [(g, float(v), i) for g, n in ((0, 41), (1, 7), (2, 1)) for i, v in enumerate(rng.normal(size=n).round(1))]
    df = spark.createDataFrame(rows, "g int, v double, row_id long").repartition(3)
    probs = [0.0, 0.1, 0.5, 0.731, 1.0]
    monkeypatch.setattr(session, "SORTED_QUANTILES", 0)
    plain = session.quantiles(df, probs)
    monkeypatch.setattr(session, "SPLITTERS", 2)
    monkeypatch.setattr(session, "FETCHED", 3)
    got = session.quantiles(df, probs)
    assert got == plain
    for g in range(3):
        assert np.allclose(got[g], np.quantile([v for h, v, _ in rows if h == g], probs))
    assert session.quantiles(df.limit(0), probs) == {}


def test_selection_with_ties_and_no_shuffle_of_the_table(spark, monkeypatch):
    """One value that is half of all, long tails, and groups named by strings; rounds count, and nothing of the table is sorted or exchanged."""
    from pyspark.sql import functions as F

    from isthmus.functions import session

    monkeypatch.setattr(session, "SORTED_QUANTILES", 0)
    monkeypatch.setattr(session, "FETCHED", 50)
    df = spark.range(40_000).select(F.concat(F.lit("g"), F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, 1.5).otherwise(F.exp(F.randn(4) * 3)).alias("v")).persist()
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 0.99999, 1.0]
    got = session.quantiles(df, probs)
    for g in ("g0", "g1", "g2"):
        assert np.allclose(got[g], np.quantile([r.v for r in df.where(F.col("g") == g).collect()], probs), rtol=1e-12)
    inside = df.select("g", "v").mapInArrow(session._inside({"g0": 0}, {0: ([1.0], [2.0])}), "i int, k int, v double")
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and inside.count() == df.where("g = 'g0' and v > 1 and v < 2").count()


def test_distances_by_ranges(spark):
    """Many values over several ranges, in groups and directions."""
    rng = np.random.default_rng(6)
    values = {(g, d, p): rng.normal(p, 1 + d, 200 + 50 * p).round(2) for g in (0, 1) for d in (0, 1) for p in (0, 1, 2)}
    df = spark.createDataFrame([(g, p, d, float(v)) for (g, d, p), vs in values.items() for v in vs], "g int, pid int, dir int, v double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = spark.createDataFrame([(0, 0, 1), (0, 2, 1), (1, 0, 2)], "g int, p int, q int")
        got = {(r.g, r.p, r.q): r.distance for r in co.wasserstein_by_group(df, pairs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {(0, 0, 1), (0, 2, 1), (1, 0, 2)}
    for (g, p, q), v in got.items():
        assert v == pytest.approx(np.mean([w1(values[g, d, p], values[g, d, q]) for d in (0, 1)]))


def literal_loss(rows, prototypes, k):
    """The loss of (features, target, cell) with prototypes (cell, centre), by the literal rule."""
    targets, votes = {}, {}
    for x, y, cell in rows:
        d = [float(((np.array(x) - c) ** 2).sum()) for _, c in prototypes]
        own = min((i for i, (own_cell, _) in enumerate(prototypes) if own_cell == cell), key=lambda i: d[i])
        other = min((i for i in range(len(prototypes)) if i != own), key=lambda i: (round(d[i], 12), i))
        targets.setdefault(own, []).append(y)
        votes[own, other] = votes.get((own, other), 0) + 1
    return sum(n * w1(targets[p], targets[q]) for (p, q), n in votes.items() if q in targets) / len(rows)


@pytest.mark.parametrize("model", ["KMeans", "MiniBatchKMeans", "BallCover"])
def test_a_refitted_permutation_against_a_literal_one(spark, model):
    """Permutations by md5, one task's fit for each cell of each, and the loss by the literal rule."""
    import hashlib

    from isthmus.operators import prototypes as proto

    x, y = separated()
    m = fit(spark, x, y, model_type=model, n_target_cells=3, n_null_permutations=2, ballcover_k=2, ballcover_radius="auto", target_scaling="none")
    edges = np.unique(np.quantile(y, [1 / 3, 2 / 3]))
    cell = np.searchsorted(edges, y, side="right")
    n = len(y)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    for perm in range(2):
        places = {literal_place(i, n, [int(md5(f"1:{perm}-{r}")[:8], 16) for r in range(4)]): i for i in range(n)}
        order = [places[i] for i in range(n)]
        ty, tc = y[order], cell[order]
        prototypes = []
        for c in range(3):
            rows = np.flatnonzero(tc == c)
            u = np.array([[int(md5(f"0-0-{i}")[:13], 16) / 2**52] for i in rows])
            if model == "KMeans":
                centers = proto.kmeans_matrix(x[rows], u, 2)
            elif model == "MiniBatchKMeans":
                centers = proto.minibatch_matrix(x[rows], u, 2)
            else:
                centers = x[rows][proto.cover_matrix(rows, x[rows], 2, "auto", 1.0, None)[0]]
                r = proto.cover_matrix(rows, x[rows], 2, "auto", 1.0, None)[1]
                prototypes += [(c, v, r) for v in centers]
                continue
            prototypes += [(c, v, None) for v in centers]
        if model == "BallCover":  # scores 1 - d^2 / r^2
            continue
        assert m.null_losses_[perm] == pytest.approx(literal_loss(list(zip(x, ty, tc, strict=True)), [(c, v) for c, v, _ in prototypes], 2), rel=1e-6)
    assert len(m.null_losses_) == 2 and all(v >= 0 for v in m.null_losses_)


def test_reset_and_no_tables_left_cached(spark):
    spark.catalog.clearCache()
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    m = fit(spark, *separated(), n_null_permutations=3)
    assert m.index != 1.0 and m.prototypes_ is not None
    m.reset()
    assert m.index == 1.0 and m.prototypes_ is None and not hasattr(m, "null_loss_")
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_keywords_of_the_target_cover(spark):
    x, y = separated()
    two = np.stack([y, y**2], axis=1)
    m = fit(spark, x, two, target_cover="kmeans", target_cover_kwargs={"n_init": 2, "max_iter": 5}, n_null_permutations=1, n_projections=4)
    assert 0 <= m.index <= 1
    with pytest.raises(TypeError, match="n_clusters"):
        ContinuousSeparability(target_cover_kwargs={"n_clusters": 2})


def test_non_finite_distances_are_refused(spark):
    from pyspark.errors import PySparkException

    adj = spark.createDataFrame([(0, 1, 1, 1.0)], "p int, q int, n long, alpha double")
    dist = spark.createDataFrame([(0, 1, float("inf"))], "p int, q int, distance double")
    with pytest.raises(PySparkException, match="not finite"):
        co.local_losses(adj, dist, spark.createDataFrame([(0, 1)], "pid int, support long")).collect()


def test_adjacency_in_blocks(spark, monkeypatch):
    from isthmus.operators import prototypes as proto
    from isthmus.operators import scoring

    x, y = separated()
    s = co.cells_of(frame(spark, x, y), "quantile", 4)
    p = proto.landmarks(s, 3)
    own = scoring.own_best(s, p).select("row_id", "pid")
    key = lambda: sorted((r.p, r.q, r.n) for r in co.adjacency(s, p, own).collect())
    one = key()
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 1)
    assert key() == one


def literal_place(v, size, keys):
    """The cipher in plain integers."""
    half = 1
    while 4**half < size:
        half += 1
    while True:
        a, b = divmod(v, 2**half)
        for k in keys:
            x = (b + k) % 2**32
            x = (x ^ x // 2**15) * 739982445 % 2**32
            x = (x ^ x // 2**12) * 695872825 % 2**32
            a, b = b, a ^ (x ^ x // 2**15) % 2**half
        v = a * 2**half + b
        if v < size:
            return v


def test_cipher_is_a_permutation():
    for size in (1, 2, 3, 16, 17, 100, 1023, 5000):
        seen = set()
        for perm in range(4):
            got = co.ciphered(np.arange(size), size, co.round_keys("k", perm))
            assert sorted(got.tolist()) == list(range(size))
            seen.add(tuple(got.tolist()))
            part = np.arange(size)[::3]
            assert (co.ciphered(part, size, co.round_keys("k", perm)) == got[::3]).all()
        assert size < 5 or len(seen) == 4
        keys = co.round_keys("k", 2)
        assert co.ciphered(np.arange(size), size, keys).tolist() == [literal_place(i, size, keys) for i in range(size)]
    # Places are spread: correlation with the number itself stays within what chance gives.
    n = np.arange(5000)
    r = [abs(np.corrcoef(n, co.ciphered(n, 5000, co.round_keys("x", p)))[0, 1]) for p in range(30)]
    assert max(r) < 5 / np.sqrt(5000) and np.mean(r) < 2 / np.sqrt(5000)


def test_areas_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    ids = [3, 4, 9, 11, 20]
    values = {i: rng.normal(i, 3, 1 + 40 * (i % 4)).round(1) for i in ids}
    every = np.sort(np.concatenate(list(values.values())))
    cut = float(every[len(every) // 3])
    pairs = [(p, q) for p in ids for q in ids]
    p, q = (np.array(x) for x in zip(*pairs, strict=True))
    for at_once in (1, 50, 1 << 20):
        monkeypatch.setattr(co, "AT_ONCE", at_once)
        total = np.zeros(len(p))
        for low, end, inside in ((every[0], cut, lambda x: x < cut), (cut, every[-1], lambda x: x >= cut)):
            rows = sorted((float(v), i, int(n)) for i, x in values.items() for v, n in zip(*np.unique(x[inside(x)], return_counts=True), strict=True))
            v, pid, c = (np.array([r[k] for r in rows]) for k in (0, 1, 2))
            known = {i: (len(x), int((x < low).sum())) for i, x in values.items()}
            total += co.areas(v, c.astype(float), pid, float(low), float(end), known, p, q)
        assert np.allclose(total, [w1(values[a], values[b]) for a, b in pairs])


def test_permutations_in_several_broadcasts(spark, monkeypatch):
    from isthmus.operators import scoring

    x, y = separated()
    one = fit(spark, x, y, n_null_permutations=4)
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 1)
    assert fit(spark, x, y, n_null_permutations=4).null_losses_ == pytest.approx(one.null_losses_)


def test_reset_leaves_no_file(spark):
    import os

    from isthmus.functions.session import shared_root

    before = set(os.listdir(shared_root(spark)))
    m = fit(spark, *separated(), n_null_permutations=3)
    assert set(os.listdir(shared_root(spark))) > before
    m.reset()
    assert set(os.listdir(shared_root(spark))) == before


def test_distances_that_are_not_finite(spark):
    x, y = separated()
    with pytest.raises(ValueError, match="not finite"):
        fit(spark, x, np.where(y > 0, 1.7e308, -1.7e308), target_scaling="none", kmeans_k=1)


def test_quantiles_close_in_at_every_round(spark, monkeypatch):
    """Places wanted lie beside splitters of the first round; each round cuts their brackets, and none grows beyond its ends."""
    from isthmus.functions import session

    rng = np.random.default_rng(3)
    v = rng.random(20_000)
    df = spark.createDataFrame([(0, float(x)) for x in v], "g int, v double").repartition(4)
    for n, value in (("SORTED_QUANTILES", 1), ("FETCHED", 400), ("SPLITTERS", 63)):
        monkeypatch.setattr(session, n, value)
    rounds, cells = [], session._cells
    monkeypatch.setattr(session, "_cells", lambda *a: [rounds.append(1), cells(*a)][1])
    probs = [i / 8 for i in range(1, 8)]
    assert np.allclose(session.quantiles(df, probs)[0], np.quantile(v, probs), rtol=0, atol=1e-12)
    assert len(rounds) <= 2
