import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from isthmus.estimators import DiscreteSeparability
from isthmus.operators import labels as lab
from isthmus.operators import overlap as ov
from isthmus.operators import prototypes as proto
from isthmus.operators import scoring, validation

KIND = "row_id long, ord long, features array<double>, label string"


def cloud(spark, seed=0, n=60, classes=3, d=3, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, i, (rng.normal(0, 1, d) + spread * (i % classes)).tolist(), f"c{i % classes}") for i in range(n)]
    return spark.createDataFrame(rows, KIND), rows


def literal_pairs(rows, prototypes):
    """Overlaps by the literal rule: of own and other prototypes, the best two; without the own best, whose is it?"""
    out = {}
    for y, b in itertools.permutations({r[3] for r in rows}, 2):
        adj = n = 0
        for _, _, x, label in rows:
            if label != y:
                continue
            score = {p["pid"]: (-((np.array(x) - np.array(p["center"])) ** 2).sum(), p["class"]) for p in prototypes}
            own = max((p for p in score if score[p][1] == y), key=lambda p: score[p][0])
            two = sorted((p for p in score if score[p][1] in (y, b)), key=lambda p: -score[p][0])[:2]
            rest = [p for p in two if p != own] if two[0] == own else two[:1]
            n += 1
            adj += bool(rest) and score[rest[0]][1] == b
        out[y, b] = (adj, n)
    return out


@pytest.mark.parametrize("spread", [0.0, 1.0, 8.0])
def test_pairs_follow_the_literal_rule(spark, spread):
    df, rows = cloud(spark, 1, spread=spread)
    p = proto.landmarks(df, 4)
    got = {(r.y, r.b): (r.adj, r.cardinality) for r in ov.pairwise(df, p).collect()}
    assert got == literal_pairs(rows, [r.asDict() for r in p.collect()])


def test_blocks_of_prototypes_agree(spark, monkeypatch):
    df, _ = cloud(spark, 2)
    p = proto.landmarks(df, 4)
    whole = sorted(map(tuple, ov.pairwise(df, p).collect()))
    best = sorted(map(tuple, scoring.topk(df, p, 3).collect()))
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 100)
    assert len(scoring.held(p)) > 1
    assert sorted(map(tuple, ov.pairwise(df, p).collect())) == whole
    assert sorted(map(tuple, scoring.topk(df, p, 3).collect())) == best
    some = [r["class"] for r in p.select("class").distinct().orderBy("class").collect()][1:]
    for classes in (some, some[:1], []):
        want = sorted(map(tuple, scoring.topk(df, p, 2, classes).collect()))
        assert sorted(map(tuple, scoring.topk(df, scoring.held(p), 2, classes).collect())) == want and bool(want) == bool(classes)


@pytest.mark.parametrize("model", ["KMeans", "MiniBatchKMeans", "BallCover"])
def test_separated_and_mixed(spark, model):
    for spread, low, high in ((9.0, 0.95, 1.0), (0.0, 0.0, 0.6)):
        df, _ = cloud(spark, 3, 150, spread=spread)
        m = DiscreteSeparability(model_type=model, kmeans_k=5, ballcover_k=8, ballcover_radius="auto").fit(df)
        assert low <= m.index <= high and low <= m.weighted_index <= high
        assert m.predict(df).count() == 150 and m.score() == m.index


def test_exclusions_touch_only_global_scores(spark):
    df, _ = cloud(spark, 4)
    a, b = DiscreteSeparability(kmeans_k=4).fit(df), DiscreteSeparability(kmeans_k=4, exclude_classes=["c0", "c0"]).fit(df)
    assert sorted(map(tuple, a.singleton_.collect())) == sorted(map(tuple, b.singleton_.collect()))
    kept = [r.singleton_index for r in b.singleton_.collect() if r.y != "c0"]
    assert b.index == pytest.approx(np.mean(kept))
    with pytest.warns(RuntimeWarning, match="excluded"):
        assert DiscreteSeparability(kmeans_k=4, exclude_classes=["c0", "c1", "c2"]).fit(df).index == 1.0


def test_order_and_names_do_not_matter(spark):
    df, rows = cloud(spark, 5)
    base = ov.summary(ov.singleton(ov.pairwise(df, proto.landmarks(df, 4)), ov.support(df))).first()
    shuffled = list(rows)
    random.Random(1).shuffle(shuffled)
    other = spark.createDataFrame([(i, o, x, {"c0": "z", "c1": "a", "c2": "m"}[y]) for i, o, x, y in shuffled], KIND)
    again = ov.summary(ov.singleton(ov.pairwise(other, proto.landmarks(other, 4)), ov.support(other))).first()
    assert base["index"] == pytest.approx(again["index"])


def test_weighted_formula(spark):
    s = spark.createDataFrame([("minority", 1, 0.0), ("majority", 9, 1.0)], "y string, support long, singleton_index double")
    row = ov.summary(s).first()
    assert (row["index"], row["weighted_index"]) == (0.5, 0.9)


def test_multilabel_denominators(spark):
    x = [[0.0, 0.0], [0.2, 0.0], [1.0, 0.0], [1.2, 0.0]]
    y = [["A", "B"], ["A", "C"], ["B", "C"], ["A", "B"]]
    df = spark.createDataFrame([(i, i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, ord long, features array<double>, labels array<string>")
    n = {(r.y, r.b): r.n for r in lab.pair_rows(df).collect()}
    assert n["A", "B"] == 1 and n["A", "C"] == 2
    m = DiscreteSeparability(model_type="KMeans", kmeans_k=2).fit(df)
    got = {(r.y, r.b): r.cardinality for r in m.pairwise_.collect()}
    assert got["A", "B"] == 1 and got["A", "C"] == 2 and {r.y: r.support for r in m.singleton_.collect()}["A"] == 3
    z = [[1, 1, 0], [1, 0, 1], [0, 1, 1], [1, 1, 0]]
    df = spark.createDataFrame([(i, i, a, b) for i, (a, b) in enumerate(zip(x, z, strict=True))], "row_id long, ord long, features array<double>, indicator array<int>")
    m = DiscreteSeparability(model_type="KMeans", kmeans_k=2).fit(df)
    assert {(r.y, r.b): r.cardinality for r in m.pairwise_.collect()}["0", "2"] == 2
    with pytest.raises(NotImplementedError):
        DiscreteSeparability(model_type="BallCover").fit(df)


def test_top_m(spark):
    x = [[v] for v in (0.0, 0.1, 1.0, 1.1, 2.0, 2.1)]
    y = [["A", "B"], ["A"], ["B"], ["B", "C"], ["C"], ["A", "C"]]
    df = spark.createDataFrame([(i, i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, ord long, features array<double>, labels array<string>")
    m = DiscreteSeparability(model_type="KMeans", kmeans_k=2, multilabel_pair_mode="top_m", top_m=1).fit(df)
    assert m.competitors_.groupBy("y").count().where("count <> 1").count() == 0


def test_degenerate_inputs(spark):
    with pytest.warns(RuntimeWarning, match="no samples"):
        assert DiscreteSeparability().fit(spark.createDataFrame([], KIND)).index == 1.0
    one = spark.createDataFrame([(i, i, [float(i), 0.0], "a") for i in range(3)], KIND)
    with pytest.warns(RuntimeWarning, match="one class"):
        m = DiscreteSeparability(kmeans_k=2).fit(one)
    assert m.index == 1.0 and m.prototypes_.count() == 2


def test_errors(spark):
    bad = spark.createDataFrame([(0, 0, [float("nan"), 1.0], "a"), (1, 1, [0.0, 1.0], "b")], KIND)
    with pytest.raises(ValueError, match="finite"):
        DiscreteSeparability().fit(bad)
    with pytest.raises(ValueError, match="finite"):
        validation.check_features(spark.createDataFrame([(0, 0, None, "a")], KIND))
    ragged = spark.createDataFrame([(0, 0, [1.0], "a"), (1, 1, [0.0, 1.0], "b")], KIND)
    with pytest.raises(ValueError, match="2D"):
        DiscreteSeparability().fit(ragged)
    for how in ({"model_type": "x"}, {"multilabel_pair_mode": "top_m"}, {"offline_chunk_size": 0}):
        with pytest.raises(ValueError):
            DiscreteSeparability(**how)
    with pytest.raises(ValueError):
        DiscreteSeparability().predict(bad)
    with pytest.raises(NotImplementedError):
        DiscreteSeparability().add_sample([0.0], "a")


def test_params(spark):
    m = DiscreteSeparability(kmeans_k=3)
    assert m.get_params()["kmeans_k"] == 3 and m.set_params(kmeans_k=4).get_params()["kmeans_k"] == 4
    with pytest.raises(ValueError):
        m.set_params(nothing=1)
    df, _ = cloud(spark, 6)
    assert m.fit_predict(df).columns == ["row_id", "pid"]
    assert DiscreteSeparability(kmeans_k={"c0": 2, "c1": 3, "c2": 1}).fit(df).prototypes_.count() == 6
    with pytest.raises(ValueError, match="c2"):
        DiscreteSeparability(kmeans_k={"c0": 2, "c1": 3}).fit(df)


def test_accumulating_fit(spark):
    df, _ = cloud(spark, 7)
    m = DiscreteSeparability(kmeans_k=3).fit(df)
    one = {(r.y, r.b): r.adj for r in m.pairwise_.collect()}
    m.fit(df, reset_state=False)
    assert {r.cardinality for r in m.pairwise_.collect()} == {40}
    assert {(r.y, r.b): r.adj for r in m.pairwise_.collect()} == {k: 2 * v for k, v in one.items()}


def test_accumulating_fit_keeps_earlier_classes(spark):
    df, _ = cloud(spark, 7, 80, classes=4, spread=0.5)
    m = DiscreteSeparability(model_type="BallCover", ballcover_k=3, ballcover_radius="auto")
    first = {r.y: r.singleton_index for r in m.fit(df.where("label in ('c0', 'c1')")).singleton_.collect()}
    m.fit(df.where("label in ('c2', 'c3')"), reset_state=False)
    got = {r.y: (r.support, r.singleton_index) for r in m.singleton_.collect()}
    assert set(got) == {"c0", "c1", "c2", "c3"} and all(got[y] == (20, v) for y, v in first.items())
    assert m.index == pytest.approx(np.mean([v for _, v in got.values()]))
    # One class in common: its pairs are taken over both supports, and only this batch's pairs set its index.
    m.fit(df.where("label in ('c0', 'c2')"), reset_state=False)
    got = {r.y: r.support for r in m.singleton_.collect()}
    pairs = {(r.y, r.b): r for r in m.pairwise_.collect()}
    assert got == {"c0": 40, "c1": 20, "c2": 40, "c3": 20} and pairs["c0", "c2"].cardinality == 40 and pairs["c0", "c1"].cardinality == 20
    assert {r.y: r.singleton_index for r in m.singleton_.collect()}["c0"] == pytest.approx(1 - pairs["c0", "c2"].adj / 40)


def test_prototypes_are_worked_out_once(spark):
    df, _ = cloud(spark, 11)
    seen = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    p = proto.landmarks(df.where("row_id < 60"), 20)
    assert p.count() == 60
    ov.pairwise(df, p.mapInArrow(tick, p.schema)).collect()
    assert seen.value == 60


def test_a_class_without_prototypes_is_refused(spark):
    df, _ = cloud(spark, 12)
    with pytest.raises(ValueError, match="c2"):
        scoring.own_best(df, proto.landmarks(df.where("label <> 'c2'"), 2))


def test_keywords(spark):
    df, _ = cloud(spark, 13)
    a = DiscreteSeparability(model_type="KMeans", kmeans_k=3, kmeans_kwargs={"init": "random", "n_init": 3, "max_iter": 4, "algorithm": "lloyd", "random_state": 3}).fit(df)
    assert a.prototypes_.count() == 9
    with pytest.raises(TypeError, match="n_jobs"):
        DiscreteSeparability(kmeans_kwargs={"n_jobs": 3}).fit(df)


def test_a_backend_of_ones_own(spark, monkeypatch):
    from isthmus.operators import backends

    class Marks(backends.Backend):
        def fit(self, samples):
            return proto.landmarks(samples, 2)

    monkeypatch.setitem(backends.BACKENDS, "Marks", Marks)
    df, _ = cloud(spark, 14)
    assert DiscreteSeparability(model_type="Marks").fit(df).prototypes_.count() == 6


def test_covers_in_rounds_equal_covers_in_one_task(spark, monkeypatch):
    df, _ = cloud(spark, 8, 90, d=2)
    for how in ({"k": "auto", "radius": 0.8}, {"k": 5, "radius": 0.5}, {"k": "auto", "radius": 0.3, "max_balls": 4}):
        a, da, _ = proto.ball_cover(df, metric="euclidean", **how)
        monkeypatch.setattr(proto, "SMALL", 0)
        b, db, _ = proto.ball_cover(df, metric="euclidean", **how)
        monkeypatch.undo()
        key = lambda x: [(r["pid"], r["class"], [round(v, 9) for v in r["center"]], round(r["radius"], 9)) for r in x.orderBy("pid").collect()]
        assert key(a) == key(b)
        diag = lambda x: sorted((r["class"], r["n_balls"], round(r["covered_fraction"], 9), r["stopped_by_max_balls"]) for r in x.collect())
        assert diag(da) == diag(db)


@pytest.mark.parametrize("far", [3, 40])
@pytest.mark.parametrize("how", [{"k": "auto", "radius": 0.4}, {"k": "auto", "radius": 0.3, "cover_fraction": 0.7}, {"k": {"c0": 60, "c1": 7, "c2": "auto"}, "radius": 0.3}, {"k": "auto", "radius": 0.01, "max_balls": 12}, {"k": 12, "radius": "auto", "cover_fraction": 0.6}])
def test_covers_bring_many_centres_a_pass(spark, monkeypatch, far, how):
    """Equal to covers in one task, with few farthest rows a pass, repeated rows (ties) and a class that is all one point."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(70, 2)), rng.normal(size=(40, 2)).round(1), np.ones((10, 2))])
    rows = [(i, i, v.tolist(), ["c0"] * 70 + ["c1"] * 40 + ["c2"] * 10) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, o, v, y[i]) for i, o, v, y in rows], "row_id long, ord long, features array<double>, label string").repartition(4)
    key = lambda found: ([(r["pid"], r["class"], [round(v, 9) for v in r["center"]], round(r["radius"], 9)) for r in found[0].orderBy("pid").collect()], sorted((r["class"], r["n_balls"], round(r["covered_fraction"], 9), round(r["mean_nearest_distance"], 9), round(r["max_nearest_distance"], 9), r["stopped_by_max_balls"]) for r in found[1].collect()))
    want = key(proto.ball_cover(df, metric="euclidean", **how))
    passes = []
    real = proto._advanced
    monkeypatch.setattr(proto, "_advanced", lambda *a: passes.append(1) or real(*a))
    monkeypatch.setattr(proto, "SMALL", 0)
    monkeypatch.setattr(proto, "FAR_ROWS", far)
    assert key(proto.ball_cover(df, metric="euclidean", **how)) == want
    balls = max(n for _, n, *_ in want[1])
    assert len(passes) < balls if far == 40 and balls > 8 else len(passes) <= balls + 1


def test_memberships_in_pieces(spark):
    df, _ = cloud(spark, 8, 90, d=2)
    p, *_ = proto.ball_cover(df, 5, 0.7, metric="euclidean")
    want = sorted(map(tuple, proto.memberships(df, p).collect()))
    assert sorted(map(tuple, proto.memberships(df, p, 30).collect())) == want and len(want) > 20


@pytest.mark.parametrize("how", [{"init": "k-means||", "n_init": 2}, {}, {"init": "random", "n_init": 3}, {"n_init": 2, "max_iter": 3}])
def test_kmeans_in_rounds_equals_kmeans_in_one_task(spark, monkeypatch, how):
    df, _ = cloud(spark, 9, 120, d=2, spread=3.0)
    df = df.repartition(3)
    key = lambda p: [(r["pid"], r["class"], [round(v, 9) for v in r["center"]]) for r in p.orderBy("pid").collect()]
    a = key(proto.kmeans(df, 3, seed=1, **how))
    monkeypatch.setattr(proto, "SMALL", 0)
    assert key(proto.kmeans(df, {"c0": 3, "c1": 3, "c2": 3}, seed=1, **how)) == a


def test_empty_clusters_start_anew_alike(spark, monkeypatch):
    rows = [(i, i, [float(v)], "a") for i, v in enumerate([0, 0, 0, 0, 5, 9])]
    df = spark.createDataFrame(rows, KIND)
    monkeypatch.setattr(proto, "start_rows", lambda x, u, k, init: np.array([0, 1, 2]))
    monkeypatch.setattr(proto, "starts_in_rounds", lambda s, ks, n, init: {("a", 0): [np.zeros(1)] * 3})
    a = proto.kmeans_matrix(np.array([r[2] for r in rows]), np.zeros((6, 1)), 3)
    b = proto.kmeans_in_rounds(proto.drawn(df, 0), {"a": 6}, {"a": 3}, 1, 1, 300, 1e-4, "random")
    assert [r["center"] for r in b.orderBy("pid").collect()] == a.tolist() and sorted(a.ravel()) == [0, 5, 9]


@pytest.mark.parametrize("n_init", [1, 2])
def test_minibatches_in_rounds_equal_those_in_one_task(spark, monkeypatch, n_init):
    df, _ = cloud(spark, 15, 240, d=2, spread=3.0)
    key = lambda p: [(r["pid"], r["class"], [round(v, 9) for v in r["center"]]) for r in p.orderBy("pid").collect()]
    how = {"seed": 2, "batch_size": 20, "max_iter": 7, "n_init": n_init}
    a = key(proto.minibatch_kmeans(df, 3, **how))
    monkeypatch.setattr(proto, "SMALL", 0)
    assert key(proto.minibatch_kmeans(df, 3, **how)) == a


def test_automatic_radius_in_rounds_is_exact(spark, monkeypatch):
    from isthmus.functions import session

    df, _ = cloud(spark, 16, 90, d=2)
    how = {"k": 4, "radius": "auto", "cover_fraction": 0.83, "metric": "euclidean"}
    key = lambda d: sorted((r["class"], round(r["radius"], 9), round(r["covered_fraction"], 9), r["mode"], r["ball_ids"]) for r in d.collect())
    a = key(proto.ball_cover(df, **how)[1])
    monkeypatch.setattr(proto, "SMALL", 0)
    assert key(proto.ball_cover(df, **how)[1]) == a
    monkeypatch.setattr(session, "SORTED_QUANTILES", 0)
    assert key(proto.ball_cover(df, **how)[1]) == a


def test_cosine_covers(spark):
    df, _ = cloud(spark, 10)
    m = DiscreteSeparability(model_type="BallCover", ballcover_k=4, ballcover_radius="auto", ballcover_kwargs={"metric": "cosine", "store_memberships": True}).fit(df)
    assert m.resolved_metric_ == "cosine" and m.ball_members_.count() >= 60
    assert all(abs(r.norm2 - 1) < 1e-9 for r in m.prototypes_.collect())
    for how in ({"selection": "x"}, {"cover_fraction": 0}, {"max_balls": 0}):
        with pytest.raises(ValueError):
            proto.check_cover("auto", 0.2, how.get("cover_fraction", 1), how.get("max_balls"), how.get("selection", "farthest"))
    with pytest.raises(ValueError):
        proto.check_cover("auto", "auto", 1, None, "farthest")


def literal_multilabel(rows, prototypes):
    """adj and cardinality of every pair of classes, row by row."""
    out, classes = {}, sorted({c for c, _ in prototypes})
    for x, labels in rows:
        s = {c: sorted((-((x - p) ** 2).sum() for k, p in prototypes if k == c), reverse=True) for c in classes}
        for y in set(labels) & set(classes):
            for b in classes:
                if b not in labels:
                    n = out.setdefault((y, b), [0, 0])
                    n[0] += len(s[y]) < 2 or s[b][0] > s[y][1]
                    n[1] += 1
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("block_bytes", [1, 1 << 26])
def test_sparse_multilabel_counts(spark, monkeypatch, block_bytes):
    rng = np.random.default_rng(4)
    names = [f"l{i}" for i in range(9)]
    rows = [(rng.normal(size=2), sorted({names[j] for j in rng.integers(0, 8, rng.integers(0, 4))}) + ["unknown"] * (i % 5 == 0)) for i in range(150)]
    rows += [(rng.normal(size=2), [names[8], names[0]]), (rng.normal(size=2), [names[8], names[0]])]
    marks = [(names[j % 9], rng.normal(size=2)) for j in range(9 * 3) if j < 18 or j % 9 > 4]
    marks = [m for i, m in enumerate(marks) if m[0] != "l3" or i == 3]  # one class with one prototype
    df = spark.createDataFrame([(i, x.tolist(), y) for i, (x, y) in enumerate(rows)], "row_id long, features array<double>, labels array<string>").repartition(3)
    marks.sort(key=lambda m: m[0])
    p = spark.createDataFrame([(i, c, v.tolist(), None, float((v**2).sum())) for i, (c, v) in enumerate(marks)], scoring.PROTOTYPES)
    monkeypatch.setattr(scoring, "BLOCK_BYTES", block_bytes)
    assert (len(scoring.held(p)) > 1) == (block_bytes == 1)
    want = literal_multilabel(rows, marks)
    assert {(r.y, r.b): (r.adj, r.cardinality) for r in ov.multilabel_counts(df, p).collect()} == want
    support = {y: sum(y in labels for _, labels in rows) for y in names}
    low = {y: min((1 - a / n for (k, _), (a, n) in want.items() if k == y), default=1.0) for y in names}
    assert {r.y: (r.support, pytest.approx(r.singleton_index)) for r in ov.multilabel_singletons(df, p).collect()} == {y: (support[y], low[y]) for y in names if support[y]}


def test_fifty_thousand_labels(spark):
    """A row for each label, and a few labels with many rows: what is worked on are these few."""
    few, rng = 40, np.random.default_rng(5)
    wide = spark.range(50_000).select(F.col("id").alias("row_id"), F.array(F.rand(1), F.rand(2)).alias("features"), F.array(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("labels"))
    near = [(100_000 + i, rng.random(2).tolist(), [f"n{i % few}", f"n{(i + 1) % few}"]) for i in range(400)]
    df = wide.unionByName(spark.createDataFrame(near, wide.schema))
    single = df.select("row_id", "features", F.explode("labels").alias("label"))
    p = scoring.held(proto.landmarks(single, 3))
    got = ov.multilabel_singletons(df, p)
    assert got.count() == 50_000 + few
    rows = {r.y: r for r in got.where("y like 'n%' or y = 'k7'").collect()}
    assert rows["k7"].singleton_index == 0.0 and rows["k7"].support == 1
    assert rows["n3"].support == 20 and 0 <= rows["n3"].singleton_index <= 1


def test_parallel_starts_take_few_passes_and_fit_as_well(spark, sf, monkeypatch):
    """For any k as many passes; the inertia after Lloyd within 2 % of that from k-means++, on average over seeds."""
    from isthmus.sources import tables

    df = tables.embeddings(spark, "/root/testdata/sf0.01").withColumn("label", F.lit("all")).persist()
    x = np.array([r.features for r in df.orderBy("row_id").collect()])
    total = {}
    for init in ("k-means++", "k-means||"):
        for seed in range(6):
            c = np.array([r.center for r in proto.kmeans(df, 12, seed=seed, init=init).collect()])
            total[init] = total.get(init, 0.0) + proto.squared(x, c).min(axis=1).sum()
    assert total["k-means||"] < 1.02 * total["k-means++"]
    passes = []
    real = proto.Scratch.written
    monkeypatch.setattr(proto.Scratch, "written", lambda self, *a: passes.append(1) or real(self, *a))
    for k in (5, 60):
        passes.clear()
        starts = proto.scalable_starts(proto.drawn(df, 1), {"all": k}, 0)
        assert len(starts["all", 0]) == k and len(passes) == proto.DRAWS + 1
    same = df.limit(30).withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))
    monkeypatch.setattr(proto, "SMALL", 0)
    assert proto.kmeans(same, 4, init="k-means||").count() == 4


@pytest.mark.parametrize("m", [None, 1, 3])
def test_nearest_classes_against_all_distances(spark, m):
    """Clusters of classes, ties, equal prototypes and a class of one; with few asked for, few distances are computed."""
    rng = np.random.default_rng(6)
    groups = rng.normal(size=(60, 3)) * 20
    rows = [(f"c{i:02d}", groups[i] + rng.normal(size=3)) for i in range(60) for _ in range(50 if i else 1)]
    rows += [("d0", groups[5] * 0 + 1), ("d1", groups[5] * 0 + 1), ("d2", groups[5] * 0 + 2), ("d3", groups[5] * 0)]
    p = spark.createDataFrame([(i, c, v.tolist(), None, float((v**2).sum())) for i, (c, v) in enumerate(rows)], scoring.PROTOTYPES)
    found = {}
    for r in ov.class_distances(p, m).collect():
        found.setdefault(r.a, ({}, r.computed))[0][r.b] = r.distance
    names = sorted({c for c, _ in rows})
    of = {c: np.array([v for k, v in rows if k == c]) for c in names}
    taken = 0
    for a in names:
        want = {b: float(np.sqrt(((of[a][:, None] - of[b][None]) ** 2).sum(axis=2)).min()) for b in names if b != a}
        near, n = found[a]
        taken += n
        assert all(near[b] == pytest.approx(want[b], abs=1e-12) for b in near)
        if m is None:
            assert near.keys() == want.keys()
        else:
            last = sorted(want.values())[m - 1]
            assert {b for b, v in want.items() if v < last * (1 - 1e-9) or v == last} <= near.keys()
    share = taken / (len(rows) ** 2)
    assert share < (0.5 if m is None else 0.1), share
