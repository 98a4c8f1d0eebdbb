import numpy as np
import pytest

from isthmus.estimators import DiscreteSeparability
from isthmus.operators.art import ArtLearner
from isthmus.sources import tables
from isthmus.streaming import online

KIND = "stream_id string, ord long, features array<double>, label string"


def samples(seed=0, n=80, gap=0.6):
    rng = np.random.default_rng(seed)
    x = np.clip(rng.normal(0.2, 0.05, (n, 2)) + gap * (np.arange(n) % 2)[:, None], 0, 1)
    return x.tolist(), [f"c{i % 2}" for i in range(n)]


@pytest.mark.parametrize("kind", ["Fuzzy", "Hypersphere"])
def test_learner(kind):
    x, y = samples()
    a, b = ArtLearner(kind, 0.85), ArtLearner(kind, 0.85)
    for u, v in zip(x, y, strict=True):
        a.add_sample(u, v)
    assert b.add_batch(x, y) == b.index()
    for m in (a, b):
        assert 0 <= m.index() <= 1 and len(set(m.owner)) == 2 and m.support == {"c0": 40, "c1": 40}
        assert all(m.owner[m.predict(u)] == v for u, v in zip(x, y, strict=True))
    again = ArtLearner.restore(b.dump())
    assert again.add_sample(x[0], y[0]) == b.add_sample(x[0], y[0])


def test_fuzzy_boxes_hold_their_samples():
    m, (x, y) = ArtLearner("Fuzzy", 0.7), samples(1)
    for u, v in zip(x, y, strict=True):
        j = m.learn(u, v)
        assert (m.w[j] <= m.coded(u) + 1e-12).all() and m.owner[j] == v


def test_balls_hold_their_samples():
    m, (x, y) = ArtLearner("Hypersphere", 0.7), samples(2)
    for u, v in zip(x, y, strict=True):
        j = m.learn(u, v)
        assert np.linalg.norm(m.w[j] - m.coded(u)) <= m.radius[j] + 1e-9


class Plain:
    """The published rules, one category after another, without arrays."""

    def __init__(self, kind, rho, r_hat, dim):
        self.kind, self.rho, self.full = kind, rho, r_hat if np.isfinite(r_hat) else np.sqrt(2 * dim) / 2
        self.cats, self.rev, self.card, self.adj, self.pair, self.single = [], {}, {}, {}, {}, {}

    def judge(self, i, cat):
        w, r, _ = cat
        if self.kind == "Fuzzy":
            both = np.minimum(i, w).sum()
            return both / (1e-10 + w.sum()), both / i.sum()
        far = max(r, np.sqrt(((i - w) ** 2).sum()))
        return (self.full - far) / (self.full - r + 1e-10), 1 - far / self.full

    def learn(self, i, y):
        rho = self.rho
        for j in sorted(range(len(self.cats)), key=lambda j: (-self.judge(i, self.cats[j])[0], j)):
            match = self.judge(i, self.cats[j])[1]
            if match < rho:
                continue
            w, r, owner = self.cats[j]
            if owner != y:
                rho = max(rho, match + 1e-9)
                continue
            if self.kind == "Fuzzy":
                self.cats[j] = (np.minimum(i, w), 0.0, y)
            else:
                d = np.sqrt(((i - w) ** 2).sum())
                if d > r:
                    self.cats[j] = (w + 0.5 * (1 - r / d) * (i - w), r + 0.5 * (d - r), y)
            return j
        self.cats.append((i, 0.0, y))
        return len(self.cats) - 1

    def count(self, i, y, mine):
        self.card[y] = self.card.get(y, 0) + 1
        score = [self.judge(i, c)[0] for c in self.cats]
        for b in self.rev:
            if b == y:
                continue
            two = sorted(self.rev[y] | self.rev[b], key=lambda j: (-score[j], j))[:2]
            chosen = mine if len(two) < 2 else two[1] if two[0] == mine else two[0]
            self.adj[y, b] = self.adj.get((y, b), 0) + (chosen in self.rev[b])
            self.pair[y, b] = 1 - self.adj[y, b] / self.card[y]

    def settle(self, ys):
        for y in ys:
            self.single[y] = min((v for (a, _), v in self.pair.items() if a == y), default=1.0)
        return float(np.mean(list(self.single.values())))

    def batch(self, rows):
        mine = [self.learn(i, y) for i, y in rows]
        for (i, y), j in zip(rows, mine, strict=True):
            self.rev.setdefault(y, set()).add(j)
            self.count(i, y, j)
        return self.settle({y for _, y in rows})

    def fit(self, rows):
        self.card, self.adj, self.pair, self.single = {}, {}, {}, {}
        for i, y in rows:
            self.learn(i, y)
        self.rev = {}
        for j, (_, _, y) in enumerate(self.cats):
            self.rev.setdefault(y, set()).add(j)
        for i, y in rows:
            score = [self.judge(i, c)[0] for c in self.cats]
            self.count(i, y, min(self.rev[y], key=lambda j: (-score[j], j)))
        return self.settle({y for _, y in rows})

    def one(self, i, y):
        j = self.learn(i, y)
        self.rev.setdefault(y, set()).add(j)
        self.count(i, y, j)
        return self.settle({y})


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize(("kind", "r_hat"), [("Fuzzy", np.inf), ("Hypersphere", 0.1), ("Hypersphere", 0.5), ("Hypersphere", np.inf)])
def test_against_a_plain_loop(kind, r_hat):
    rng = np.random.default_rng(7)
    x = rng.random((150, 3))
    y = [f"c{i}" for i in rng.integers(0, 3, 150)]
    rows = [(np.concatenate([a, 1 - a]), b) for a, b in zip(x, y, strict=True)]
    fast, slow = ArtLearner(kind, 0.7, r_hat), Plain(kind, 0.7, r_hat, 3)
    assert fast.fit_batch(x[:100], y[:100]) == pytest.approx(slow.fit(rows[:100]))
    assert fast.owner == [c[2] for c in slow.cats] and np.allclose(fast.w, [c[0] for c in slow.cats]) and np.allclose(fast.radius, [c[1] for c in slow.cats])
    assert fast.add_batch(x[100:130], y[100:130]) == pytest.approx(slow.batch(rows[100:130]))
    for a, b, (i, _) in zip(x[130:], y[130:], rows[130:], strict=True):
        assert fast.add_sample(a, b) == pytest.approx(slow.one(i, b))
    assert fast.adj == slow.adj
    fresh, plain = ArtLearner(kind, 0.7, r_hat), Plain(kind, 0.7, r_hat, 3)
    assert fresh.add_batch(x, y) == pytest.approx(plain.batch(rows)) and fresh.support == plain.card


def test_vigilance_makes_categories():
    x, y = samples(3)
    few, many = ArtLearner("Fuzzy", 0.3), ArtLearner("Fuzzy", 0.99)
    few.add_batch(x, y), many.add_batch(x, y)
    assert len(few.owner) < len(many.owner)


def test_errors():
    with pytest.raises(ValueError, match="unit interval"):
        ArtLearner("Hypersphere").add_sample([2.0, 0.0], "a")
    with pytest.raises(ValueError, match="1D"):
        ArtLearner("Hypersphere").add_sample([[0.0]], "a")


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_estimator(spark):
    x, y = samples(4, 40)
    df = spark.createDataFrame([(i, i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, ord long, features array<double>, label string")
    m = DiscreteSeparability(model_type="Hypersphere", rho=0.8)
    assert m.add_batch(df) == m.index and m.module_a is m.learner_ and len(m.map) == m.prototypes_.count()
    before = m.learner_.support["c0"]
    m.add_sample(x[0], y[0])
    assert m.learner_.support["c0"] == before + 1
    assert m.predict(df).count() == 40
    assert {r.y: r.support for r in m.singleton_.collect()}["c0"] == before + 1
    one = DiscreteSeparability(model_type="Fuzzy", rho=0.8)
    one.add_sample(x[0], y[0]), one.add_sample(x[1], y[1])
    assert one.predict(df).count() == 40 and one.weights_.count() == len(one.map) == 2
    learner = ArtLearner("Fuzzy", 0.8)
    assert DiscreteSeparability(model_type="Fuzzy", rho=0.8).fit(df).index == pytest.approx(learner.fit_batch(x, y))
    with pytest.raises(AttributeError):
        _ = DiscreteSeparability().module_a


@pytest.mark.parametrize("mode", ["batch", "sample"])
def test_streams_equal_the_learner(spark, tmp_path, mode):
    x, y = samples(5, 60)
    rows = [(f"s{i % 2}", i, u, v) for i, (u, v) in enumerate(zip(x, y, strict=True))]
    rows = [(s, i, u, y[(i * 7) % 60]) for s, i, u, _ in rows]
    for part in range(2):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p={part}")
    stream = spark.readStream.schema(KIND + ", p int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = online.run_to_end(online.learn_stream(stream, mode, kind="Fuzzy", rho=0.8), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {(r.stream_id, r.samples): r["index"] for r in out.collect()}
    for s in ("s0", "s1"):
        m = ArtLearner("Fuzzy", 0.8)
        for part in range(2):
            mine = [r for r in rows[part * 30 : part * 30 + 30] if r[0] == s]
            if mode == "batch":
                m.add_batch([r[2] for r in mine], [r[3] for r in mine])
            else:
                for r in mine:
                    m.add_sample(r[2], r[3])
        assert got[s, 30] == pytest.approx(m.index())


def test_whitespace_text(spark, tmp_path):
    (tmp_path / "y.data").write_text("A_1  0.1  0.2 CYT\nB_2  0.3 0.4  NUC\n\n")
    rows = tables.whitespace_text(spark, str(tmp_path / "y.data")).orderBy("row_id").collect()
    assert [(r.features, r.label) for r in rows] == [([0.1, 0.2], "CYT"), ([0.3, 0.4], "NUC")]


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize("block_bytes", [1 << 30, 1])
@pytest.mark.parametrize(("kind", "r_hat"), [("Fuzzy", np.inf), ("Hypersphere", 0.5)])
def test_counting_as_a_pass_over_the_table(spark, monkeypatch, kind, r_hat, block_bytes):
    """Vigilance 0.7, repeated samples (ties), one block of categories or one a class, against a plain loop; a fit, two batches and single samples on top of each other."""
    from isthmus.operators import replay

    monkeypatch.setattr(replay.counts, "__defaults__", (None, block_bytes))
    monkeypatch.setattr(replay, "AT_ONCE", 500)
    monkeypatch.setattr(DiscreteSeparability, "LEARNT_AT_ONCE", 7)
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.random((60, 2)).round(1), rng.random((60, 2))])
    y = [f"c{i}" for i in rng.integers(0, 3, 100)] + ["c1"] * 10 + ["new"] * 10
    rows = [(np.concatenate([a, 1 - a]), b) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([(i, 1000 - i, a.tolist(), b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, ord long, features array<double>, label string").repartition(5)
    part = lambda a, b: df.where(f"ord between {1000 - b + 1} and {1000 - a}")
    backwards = lambda a, b: rows[a:b][::-1]
    m, slow = DiscreteSeparability(model_type=kind, rho=0.7, r_hat=r_hat), Plain(kind, 0.7, r_hat, 2)
    assert m.fit(part(0, 50)).index == pytest.approx(slow.fit(backwards(0, 50)))
    for a, b in ((50, 90), (90, 120)):
        assert m.add_batch(part(a, b)) == pytest.approx(slow.batch(backwards(a, b)))
        assert m.learner_.adj == slow.adj and m.learner_.support == slow.card and m.learner_.pairwise == pytest.approx(slow.pair)
    assert m.add_sample(x[3], y[3]) == pytest.approx(slow.one(*rows[3]))
    assert m.learner_.adj == slow.adj
    fresh, plain = DiscreteSeparability(model_type=kind, rho=0.7, r_hat=r_hat), Plain(kind, 0.7, r_hat, 2)
    assert fresh.add_batch(part(0, 120)) == pytest.approx(plain.batch(backwards(0, 120))) and fresh.learner_.adj == plain.adj


def test_no_file_is_left_behind(spark):
    import os

    from isthmus.functions.session import shared_root

    x, y = samples(4, 40)
    df = spark.createDataFrame([(i, i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, ord long, features array<double>, label string")
    before = set(os.listdir(shared_root(spark)))
    m = DiscreteSeparability(model_type="Fuzzy", rho=0.8).fit(df)
    m.add_batch(df)
    assert set(os.listdir(shared_root(spark))) == before


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize("kind", ["Fuzzy", "Hypersphere"])
def test_restart_from_a_checkpoint(spark, tmp_path, monkeypatch, kind):
    """Three runs of one query, each ended before the next file comes, over several pages of categories; state grows by what a run touches."""
    monkeypatch.setattr(online, "PAGE", 4)
    rng = np.random.default_rng(9)
    rows = [(f"s{i % 2}", i, rng.random(2).tolist(), f"c{i % 3}") for i in range(120)]
    rows += [("lonely", 200, [0.5, 0.5], "c0")]
    cuts = [(0, 50), (50, 51), (51, 121)]
    got = []
    for a, b in cuts:
        spark.createDataFrame(rows[a:b], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got.append({r.stream_id: r for r in online.run_to_end(online.learn_stream(stream, "batch", kind=kind, rho=0.8), f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect() if r.last_ord >= a})
    for s in ("s0", "s1"):
        m = ArtLearner(kind, 0.8)
        for (a, b), found in zip(cuts, got, strict=True):
            mine = [r for r in rows[a:b] if r[0] == s]
            if not mine:
                assert s not in found
                continue
            m.add_batch([r[2] for r in mine], [r[3] for r in mine])
            assert (found[s].samples, found[s].categories, found[s]["index"], found[s].warning) == (sum(m.support.values()), m.n, pytest.approx(m.index()), None)
        assert m.n > 8
    assert got[2]["lonely"].warning.startswith("one class only")


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize("rho", [0.3, 0.8, 1.0])
@pytest.mark.parametrize(("kind", "r_hat"), [("Fuzzy", np.inf), ("Hypersphere", 0.5)])
def test_leaves_give_what_all_categories_give(spark, monkeypatch, kind, r_hat, rho):
    """Small leaves against a plain loop: learning, counting by batch and by sample, prediction; with repeated samples of other labels."""
    from isthmus.operators import art, leaves, replay

    monkeypatch.setattr(art, "FEW", 4)
    monkeypatch.setattr(leaves, "LEAF", 3)
    monkeypatch.setattr(replay, "LEAF", 3)
    monkeypatch.setattr(replay, "NEAR", 4)
    rng = np.random.default_rng(13)
    x = rng.random((140, 2)).round(2)
    x[100:] = x[:40]
    y = [f"c{i}" for i in rng.integers(0, 3, 140)]
    rows = [(np.concatenate([a, 1 - a]), b) for a, b in zip(x, y, strict=True)]
    fast, slow = ArtLearner(kind, rho, r_hat), Plain(kind, rho, r_hat, 2)
    assert fast.fit_batch(x[:50], y[:50]) == pytest.approx(slow.fit(rows[:50]))
    assert fast.add_batch(x[50:90], y[50:90]) == pytest.approx(slow.batch(rows[50:90]))
    for a, b, (i, _) in zip(x[90:], y[90:], rows[90:], strict=True):
        assert fast.add_sample(a, b) == pytest.approx(slow.one(i, b))
    assert fast.adj == slow.adj and np.allclose(fast.w, [c[0] for c in slow.cats])
    m = DiscreteSeparability(model_type=kind, rho=rho, r_hat=r_hat)
    m.learner_ = fast
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "row_id long, features array<double>")
    assert [r.pid for r in m.predict(df).orderBy("row_id").collect()] == [fast.predict(a) for a in x] == [int(fast.scores(a).argmax()) for a in x]


def test_a_sample_meets_few_categories(monkeypatch):
    """Of 4,000 categories a sample is compared with a small part when it is learnt, counted and placed."""
    from isthmus.operators import replay

    met = [0]
    judge, score = ArtLearner._choice_match, replay.choices
    monkeypatch.setattr(ArtLearner, "_choice_match", lambda m, x, some=None: [met.__setitem__(0, met[0] + (m.n if some is None else len(some))), judge(m, x, some)][1])
    monkeypatch.setattr(replay, "choices", lambda kind, w, radius, alpha, full, x: [met.__setitem__(0, met[0] + len(w) * len(x)), score(kind, w, radius, alpha, full, x)][1])
    rng = np.random.default_rng(14)
    x, y = rng.random((4000, 2)), [f"c{i}" for i in rng.integers(0, 4, 4000)]
    m = ArtLearner("Fuzzy", 1.0)
    m.fit_batch(x, y)
    assert m.n == 4000 and met[0] < 0.25 * 4000 * 4000
    met[0] = 0
    for u, v in zip(x[:200], y[:200], strict=True):
        m.add_sample(u, v), m.predict(u)
    assert met[0] < 0.25 * 3 * 200 * 4000


def test_vigilance_1_looks_categories_up(monkeypatch):
    """Learning 3,000 samples, each twice, compares them with hardly any category."""
    met = [0]
    judge = ArtLearner._choice_match
    monkeypatch.setattr(ArtLearner, "_choice_match", lambda m, x, some=None: [met.__setitem__(0, met[0] + (m.n if some is None else len(some))), judge(m, x, some)][1])
    rng = np.random.default_rng(15)
    x, y = rng.random((3000, 2)), [f"c{i}" for i in rng.integers(0, 4, 3000)]
    for kind in ("Fuzzy", "Hypersphere"):
        m = ArtLearner(kind, 1.0)
        first = list(m.learn_all(zip(x, y, strict=True)))
        assert first == list(range(3000)) and list(m.learn_all(zip(x, y, strict=True))) == first
    assert met[0] < 3000


@pytest.mark.parametrize("rho", [1.0, 1 - 1e-15, 1 - 1e-12, 1 - 1e-7])
@pytest.mark.parametrize(("kind", "r_hat"), [("Fuzzy", np.inf), ("Hypersphere", 0.5), ("Hypersphere", np.inf)])
def test_looked_up_categories_are_those_of_a_plain_loop(kind, r_hat, rho):
    """Equal samples of one and of several labels, samples that differ in the last digits, and samples at the edges of cells; in bulk, one by one, and after a restart."""
    from isthmus.operators import cells

    rng = np.random.default_rng(16)
    x = rng.random((60, 3)).round(1)
    edge = (np.floor(x[:20] / cells.SIDE) * cells.SIDE - cells.OFF).clip(0, 1)
    close = np.concatenate([x[:30], edge]) + rng.choice([0, 1e-16, 2e-15, 1e-13, 1e-12], (50, 3))
    x = np.concatenate([x, edge, close.clip(0, 1), x[:40], edge, rng.random((20, 3))])
    y = [f"c{i}" for i in rng.integers(0, 3, len(x))]
    for i in range(0, len(x), 3):
        y[i] = "c0"
    slow = Plain(kind, rho, r_hat, 3)
    want = [slow.learn(np.concatenate([a, 1 - a]), b) for a, b in zip(x, y, strict=True)]
    bulk, single = ArtLearner(kind, rho, r_hat), ArtLearner(kind, rho, r_hat)
    assert [single.learn(a, b) for a, b in zip(x, y, strict=True)] == want
    got = bulk.learn_rows(x[:70], y[:70]).tolist()
    bulk = ArtLearner.restore(bulk.dump())
    assert got + bulk.learn_rows(x[70:], y[70:]).tolist() == want
    for m in (bulk, single):
        assert m.owner == [c[2] for c in slow.cats] and (m.w == [c[0] for c in slow.cats]).all() and (m.radius == [c[1] for c in slow.cats]).all()
    with pytest.raises(ValueError, match="unit interval"):
        bulk.learn_rows(np.array([[0.05, 0.05, 0.05], [2.0, 0, 0]]), ["c0", "c1"])


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_categories_of_stream_state_are_looked_up(monkeypatch):
    """Batches at vigilance 1 on categories read from state give what one learner gives, and learning them meets hardly any category."""
    rng = np.random.default_rng(17)
    x, y = rng.random((900, 2)).round(2), [f"c{i}" for i in rng.integers(0, 3, 900)]
    whole, parts = ArtLearner("Fuzzy", 1.0), ArtLearner("Fuzzy", 1.0)
    met = [0]
    judge = ArtLearner._choice_match
    for a in range(0, 900, 300):
        whole.add_batch(x[a : a + 300], y[a : a + 300])
        kept = ArtLearner("Fuzzy", 1.0)
        if parts.n:
            kept.put_categories(parts.w.copy(), parts.radius.copy(), parts.owner)
            kept.support, kept.adj, kept.pairwise, kept.singleton = parts.support, parts.adj, parts.pairwise, parts.singleton
        parts = kept
        monkeypatch.setattr(ArtLearner, "_choice_match", lambda m, x, some=None: [met.__setitem__(0, met[0] + (m.n if some is None else len(some))), judge(m, x, some)][1])
        parts.add_batch(x[a : a + 300], y[a : a + 300])
        monkeypatch.setattr(ArtLearner, "_choice_match", judge)
    assert (parts.adj, parts.support, parts.owner) == (whole.adj, whole.support, whole.owner) and met[0] < 900


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize(("rho", "block_bytes", "at_once"), [(0.5, 1 << 30, 1 << 20), (0.7, 1, 40), (0.9, 1 << 30, 40), (1.0, 1, 1 << 20)])
@pytest.mark.parametrize(("kind", "r_hat"), [("Fuzzy", np.inf), ("Hypersphere", 0.5)])
def test_samples_counted_in_one_pass(spark, monkeypatch, kind, r_hat, rho, block_bytes, at_once):
    """add_samples of a table and of a list against a plain loop of single samples, on top of a batch; categories move between the samples, labels come up late."""
    from isthmus.operators import leaves, replay

    monkeypatch.setattr(replay.counts, "__defaults__", (None, block_bytes))
    monkeypatch.setattr(replay, "AT_ONCE", 500)
    monkeypatch.setattr(replay, "LEAF", 3)
    monkeypatch.setattr(leaves, "LEAF", 3)
    monkeypatch.setattr(replay, "NEAR", 4)
    monkeypatch.setattr(DiscreteSeparability, "LEARNT_AT_ONCE", at_once)
    monkeypatch.setattr(DiscreteSeparability, "_stream", _few_at_a_time(DiscreteSeparability._stream))
    rng = np.random.default_rng(18)
    x = np.concatenate([rng.random((60, 2)).round(1), rng.random((60, 2))])
    x = x[rng.permutation(120)]
    y = [f"c{i}" for i in rng.integers(0, 3, 100)] + ["c1"] * 10 + ["new"] * 10
    rows = [(np.concatenate([a, 1 - a]), b) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([(i, i, a.tolist(), b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, ord long, features array<double>, label string").repartition(5)
    for start in (0, 30):
        m, local, slow = DiscreteSeparability(model_type=kind, rho=rho, r_hat=r_hat), ArtLearner(kind, rho, r_hat), Plain(kind, rho, r_hat, 2)
        if start:
            m.add_batch(df.where(f"ord < {start}")), local.add_batch(x[:start], y[:start]), slow.batch(rows[:start])
        index = [slow.one(*r) for r in rows[start:]][-1]
        assert m.add_samples(df.where(f"ord >= {start}")) == pytest.approx(index) and local.add_samples(x[start:], y[start:]) == pytest.approx(index)
        for got in (m.learner_, local):
            assert got.adj == slow.adj and got.support == slow.card and got.pairwise == pytest.approx(slow.pair) and got.singleton == pytest.approx(slow.single)
            assert np.allclose(got.w, [c[0] for c in slow.cats])
        assert m.add_sample(x[3], y[3]) == pytest.approx(slow.one(*rows[3])) and m.learner_.adj == slow.adj


def _few_at_a_time(stream):
    def run(s, *order):
        for x, y in stream(s, *order):
            for i in range(0, len(y), 3):
                yield x[i : i + 3], y[i : i + 3]

    return staticmethod(run)


def test_single_samples_warn_of_one_class():
    m, (x, y) = ArtLearner("Fuzzy", 0.8), samples(6, 40)
    with pytest.warns(RuntimeWarning, match="one class"):
        m.add_samples(x, y)
    one = DiscreteSeparability(model_type="Fuzzy")
    with pytest.raises(NotImplementedError):
        DiscreteSeparability().add_samples(None)
    assert one.learner_.add_samples([], []) == 1.0


def test_state_has_no_more_partitions_than_keys(spark, tmp_path):
    """State partitions are opened in every micro-batch; the session keeps its own number of partitions."""
    x, y = samples(3, 20)
    spark.createDataFrame([(f"s{i % 2}", i, u, v) for i, (u, v) in enumerate(zip(x, y, strict=True))], KIND).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = online.run_to_end(online.learn_stream(stream, "batch", kind="Fuzzy", rho=1.0), f"{tmp_path}/out", f"{tmp_path}/checkpoint", keys=2)
    assert out.count() == 2 and spark.conf.get("spark.sql.shuffle.partitions") == before != "2"
    assert sorted(p.name for p in (tmp_path / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()) == ["0", "1"]


@pytest.mark.parametrize("width", [1, 4, 7, 8, 10])
def test_choices_by_columns_are_those_of_row_sums(width):
    """Bit for bit, as ties decide."""
    from isthmus.operators.art import choices

    rng = np.random.default_rng(width)
    x, w, radius = rng.random((5, width)), rng.random((9, width)), rng.random(9) / 4
    both, d = np.minimum(w, x[:, None, :]).sum(axis=-1), np.sqrt(((w - x[:, None, :]) ** 2).sum(axis=-1))
    assert (choices("Fuzzy", w, radius, 1e-10, 1.0, x) == both / (1e-10 + w.sum(axis=1))).all()
    assert (choices("Hypersphere", w, radius, 1e-10, 1.0, x) == (1.0 - np.maximum(radius, d)) / (1.0 - radius + 1e-10)).all()
    assert (choices("Fuzzy", w, radius, 1e-10, 1.0, x[0]) == both[0] / (1e-10 + w.sum(axis=1))).all()


def test_best_categories_are_taken_in_the_order_of_score_and_number():
    """Equal scores go to the lower number, whichever leaf it lies in; categories that aren't visible are none."""
    from isthmus.operators.replay import _NONE, Categories

    rng = np.random.default_rng(4)
    n = 400
    w = rng.integers(0, 3, (n, 2)) / 4 + 0.25
    w = np.concatenate([w, 1 - w], axis=1)
    block = Categories("Fuzzy", 1e-10, 1.0, ["a"], rng.permutation(n) * 2, np.zeros(n, np.int64), w, np.zeros(n), rng.integers(0, 50, n), np.full(n, _NONE))
    x, place = w[rng.integers(0, n, 30)], rng.integers(0, 60, 30)
    s, names = block._top(x, place, block._reach(x, place), 2)
    for i in range(30):
        all_of = block._scores(x[i : i + 1], place[i : i + 1], np.arange(n))[0]
        order = [j for j in np.lexsort((block.number, -all_of)) if all_of[j] > -np.inf][:2]
        assert names[i].tolist() == [*block.number[order], _NONE, _NONE][:2] and s[i].tolist() == [*all_of[order], -np.inf, -np.inf][:2]


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize("rho", [0.3, 0.7, 0.9, 1.0])
@pytest.mark.parametrize(("kind", "r_hat"), [("Fuzzy", np.inf), ("Hypersphere", np.inf), ("Hypersphere", 0.6)])
@pytest.mark.parametrize("few", [256, 4])
def test_samples_that_come_again(monkeypatch, kind, r_hat, rho, few):
    """Samples in several copies, some with other labels, new ones among them, in short stretches: what a plain loop over all of them gives, by batch and by sample."""
    from isthmus.operators import again, art, leaves, replay

    monkeypatch.setattr(art, "FEW", few)
    monkeypatch.setattr(leaves, "LEAF", 3)
    monkeypatch.setattr(replay, "LEAF", 3)
    monkeypatch.setattr(replay, "LATE", (4, 16))
    monkeypatch.setattr(again, "STRETCH", 17)
    monkeypatch.setattr(again, "MANY", 40)
    rng = np.random.default_rng(17)
    pool = rng.random((40, 2)).round(2)
    which = np.concatenate([np.concatenate([rng.permutation(40), rng.integers(0, 40, 10)]) for _ in range(5)])
    x = np.where((rng.random(len(which)) < 0.03)[:, None], rng.random((len(which), 2)), pool[which])
    y = [f"c{(i * 7) % 3 if u < 0.97 else 3}" for i, u in zip(which.tolist(), rng.random(len(which)), strict=True)]
    rows = [(np.concatenate([a, 1 - a]), b) for a, b in zip(x, y, strict=True)]
    fast, slow = ArtLearner(kind, rho, r_hat), Plain(kind, rho, r_hat, 2)
    for a, b in ((0, 180), (180, 250)):
        assert fast.add_batch(x[a:b], y[a:b]) == pytest.approx(slow.batch(rows[a:b]))
        assert fast.adj == slow.adj and fast.support == slow.card and np.array_equal(fast.w, [c[0] for c in slow.cats])
    fast, slow = ArtLearner(kind, rho, r_hat), Plain(kind, rho, r_hat, 2)
    fast.add_samples(x, y)
    for r in rows:
        last = slow.one(*r)
    assert fast.adj == slow.adj and fast.support == slow.card and fast.index() == pytest.approx(last)


@pytest.mark.parametrize("kind", ["Fuzzy", "Hypersphere"])
def test_samples_that_come_again_are_not_looked_for_anew(monkeypatch, kind):
    """1,000 samples in 20 copies: from the third copy on few are compared with the map again."""
    asked = [0]
    resonant = ArtLearner._resonant
    monkeypatch.setattr(ArtLearner, "_resonant", lambda m, *a: [asked.__setitem__(0, asked[0] + 1), resonant(m, *a)][1])
    rng = np.random.default_rng(18)
    x, y = np.tile(rng.random((1000, 2)), (20, 1)), [f"c{i}" for i in rng.integers(0, 4, 1000)] * 20
    ArtLearner(kind, 0.7).add_batch(x, y)
    assert asked[0] < 5000


@pytest.mark.parametrize("mode", ["batch", "sample"])
def test_samples_that_come_again_are_counted_once(monkeypatch, mode):
    """1,000 samples in 20 copies at vigilance 1: all are counted, few are scored."""
    from isthmus.operators import replay

    looked = [0]
    bounds = replay.Categories.bounds
    monkeypatch.setattr(replay.Categories, "bounds", lambda b, x, *a: [looked.__setitem__(0, looked[0] + len(x)), bounds(b, x, *a)][1])
    rng = np.random.default_rng(19)
    x, y = np.tile(rng.random((1000, 2)), (20, 1)), [f"c{i}" for i in rng.integers(0, 4, 1000)] * 20
    m = ArtLearner("Fuzzy", 1.0)
    (m.add_batch if mode == "batch" else m.add_samples)(x, y)
    assert sum(m.support.values()) == 20000 and looked[0] < 6000


@pytest.mark.parametrize("query", ["stream_counts", "stream_batch_refit"])
def test_a_stream_may_take_its_time(spark, sf, monkeypatch, query):
    """No wait for a stream ends before the stream does."""
    from pyspark.sql.streaming import StreamingQuery

    from isthmus.plans import online as plans

    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda q, timeout=None: wait(q) if timeout is None else False)
    found = plans.queries()[query](spark, sf)
    if query == "stream_counts":
        assert sum(r.n for r in found.groupBy("stream_id").agg({"samples": "max"}).toDF("s", "n").collect()) == tables.read(spark, sf, "events").count()
    else:
        assert found.count() == 4


def test_samples_travel_in_packs():
    """Two keys in an Arrow batch, of different widths, without key, ord or label: each comes back as it was, in the order of ord."""
    import pandas as pd
    import pyarrow as pa

    rows = [("s", 3, [0.1, 0.2], "a"), (None, 1, [0.5], "b"), ("s", 1, [0.3, 0.4], None), ("s", None, [0.7, 0.8], "b"), ("s", 2, [0.5, 0.6], "b"), (None, 0, [0.25], "b")]
    kind = pa.schema([("stream_id", pa.string()), ("ord", pa.int64()), ("features", pa.list_(pa.float64())), ("label", pa.string())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in part], schema=kind) for part in (rows[:3], [], rows[1:])]
    packs = pd.concat([b.to_pandas() for b in online._packs(iter(batches))])
    assert len(packs) == 4
    place, x, y = online._unpacked(iter([packs[packs.stream_id == "s"]]))
    assert place.tolist()[:-1] == [1, 1, 2, 3] and x.tolist() == [[0.3, 0.4], [0.3, 0.4], [0.5, 0.6], [0.1, 0.2], [0.7, 0.8]] and y == ["None", "None", "b", "a", "b"]
    place, x, y = online._unpacked(iter([packs[packs.stream_id.isna()]]))
    assert place.tolist() == [0, 1, 1] and x.tolist() == [[0.25], [0.5], [0.5]] and y == ["b"] * 3
    with pytest.raises(ValueError, match="equally many"):
        list(online._packs(iter([pa.RecordBatch.from_pylist([dict(zip(kind.names, ("s", i, [0.5] * i, "a"), strict=True)) for i in (1, 2)], schema=kind)])))
