"""Estimators over sample DataFrames, with the parameters and methods of scikit-learn style.

Samples: row_id, features, and label (a string, number or array of them), indicator (0/1
array) or target; ord orders them where order matters and defaults to row_id. Results
are DataFrames (pairwise_, singleton_, prototypes_) and, for the few that are single numbers, floats.
"""

from __future__ import annotations

import inspect
import math
import warnings
from array import array

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isthmus.functions.session import Scratch, numbered
from isthmus.operators import backends
from isthmus.operators import continuous as co
from isthmus.operators import labels as lab
from isthmus.operators import overlap as ov
from isthmus.operators import replay, scoring, validation
from isthmus.operators.art import ArtLearner, states

ONLINE = ("Fuzzy", "Hypersphere")


def models() -> tuple[str, ...]:
    """The model types known: the online ones and every registered backend."""
    return (*ONLINE, *backends.BACKENDS)


def _reached(first: dict[int, int], categories: np.ndarray, place: int) -> None:
    """Adds categories of samples from a place on to those reached before, with the place of each one's first sample."""
    for j, at in zip(*(a.tolist() for a in np.unique(categories, return_index=True)), strict=True):
        first.setdefault(j, place + at)


class _Params:
    @classmethod
    def _names(cls) -> list[str]:
        return [p for p in inspect.signature(cls.__init__).parameters if p != "self"]

    def get_params(self, deep: bool = True) -> dict:
        return {n: getattr(self, n) for n in self._names()}

    def set_params(self, **params):
        for n in params:
            if n not in self._names():
                raise ValueError(f"invalid parameter {n}")
        self.__init__(**(self.get_params() | params))
        return self

    def _fitted(self) -> None:
        if getattr(self, "prototypes_", None) is None:
            raise ValueError("the estimator has not been fitted")

    def _kept(self, df: DataFrame) -> DataFrame:
        """The table, held until the next fit."""
        self._cached = [*getattr(self, "_cached", ()), df]
        return df.persist()

    def _drop_cached(self) -> None:
        for df in getattr(self, "_cached", ()):
            df.unpersist()
        self._cached = []
        if getattr(self, "_scratch", None):
            self._scratch.discard()
        self._scratch = None

    @property
    def backend(self):
        """The backend of this estimator with its parameters."""
        return backends.BACKENDS[self.model_type](self)

    def _prepared(self, samples: DataFrame) -> DataFrame:
        """Features as the prototypes see them."""
        return self.backend.prepared(samples)

    def predict(self, samples: DataFrame) -> DataFrame:
        """row_id, pid: the best prototype of each sample, whatever its class."""
        self._fitted()
        return scoring.topk(self._prepared(samples), self.prototypes_, 1).select("row_id", "pid")

    def fit_predict(self, samples: DataFrame) -> DataFrame:
        return self.fit(samples).predict(samples)

    def score(self, samples: DataFrame | None = None) -> float:
        """The current index, or that of a fit on the samples."""
        if samples is not None:
            self.fit(samples)
        return self.index

    def add_batch(self, samples: DataFrame) -> float:
        self.partial_fit(samples)
        return self.index


class DiscreteSeparability(_Params):
    """How separable labelled classes are: 1 without overlap, 0.5 for complete overlap.

    model_type Fuzzy and Hypersphere learn online; the others fit each batch anew. A label column of
    arrays, or an indicator, makes the index multi-label: a pair (y, b) then counts the rows with y and
    without b, and multilabel_pair_mode limits which b a class is held against.
    """

    def __init__(self, rho=0.9, r_hat=math.inf, model_type="MiniBatchKMeans", match_tracking="MT+", kmeans_k=8, kmeans_kwargs=None, ballcover_k="auto", ballcover_radius=0.25, ballcover_kwargs=None, offline_chunk_size=10_000, multilabel_pair_mode="all", top_m=None, exclude_classes=None):
        if model_type not in models():
            raise ValueError(f"model_type must be one of {models()}")
        if offline_chunk_size is not None and offline_chunk_size <= 0:
            raise ValueError("offline_chunk_size must be positive or None")
        if multilabel_pair_mode not in ("all", "top_m"):
            raise ValueError("multilabel_pair_mode must be 'all' or 'top_m'")
        if multilabel_pair_mode == "top_m" and (not isinstance(top_m, int) or top_m <= 0):
            raise ValueError("top_m must be a positive integer with multilabel_pair_mode='top_m'")
        self.rho, self.r_hat, self.model_type, self.match_tracking = rho, r_hat, model_type, match_tracking
        self.kmeans_k, self.kmeans_kwargs = kmeans_k, kmeans_kwargs
        self.ballcover_k, self.ballcover_radius, self.ballcover_kwargs = ballcover_k, ballcover_radius, ballcover_kwargs
        self.offline_chunk_size, self.multilabel_pair_mode, self.top_m = offline_chunk_size, multilabel_pair_mode, top_m
        self.exclude_classes = exclude_classes
        self._excluded()
        self.reset()

    def reset(self) -> None:
        self._drop_cached()
        self.prototypes_ = self.pairwise_ = self.singleton_ = self.competitors_ = None
        self._state = self._scorer = None
        self.index = self._weighted = 1.0
        if self.model_type in ONLINE:
            self.learner_ = ArtLearner(self.model_type, self.rho, self.r_hat, match_tracking=self.match_tracking)
            self._stale = False

    def _excluded(self) -> list[str]:
        """Labels are strings in every table, so that 1 and "1" name the same class."""
        x = self.exclude_classes
        if x is None:
            return []
        items = [x] if isinstance(x, (str, bytes)) or not hasattr(x, "__iter__") else list(x)
        for v in items:
            try:
                hash(v)
            except TypeError as e:
                raise TypeError("exclude_classes entries must be hashable") from e
        return list(dict.fromkeys(str(v) for v in items))

    @property
    def is_online(self) -> bool:
        return self.model_type in ONLINE

    @property
    def module_a(self) -> ArtLearner:
        if not self.is_online:
            raise AttributeError("only online models have a map")
        return self.learner_

    @property
    def map(self) -> list[str] | None:
        """Label of each category of an online model."""
        return self.learner_.owner if self.is_online else None

    @property
    def weighted_index(self) -> float:
        return self._weighted

    def _labelled(self, samples: DataFrame) -> tuple[DataFrame, bool]:
        validation.check_features(samples)
        if "ord" not in samples.columns:
            samples = samples.withColumn("ord", F.col("row_id"))
        if "indicator" in samples.columns:
            samples = lab.from_indicator(samples)
        s = lab.normalized(samples, "labels" if "labels" in samples.columns else "label").select("row_id", "ord", F.col("features").cast("array<double>").alias("features"), "labels")
        return s, (s.agg(F.max(F.size("labels"))).first()[0] or 0) > 1

    def fit(self, samples: DataFrame, reset_state: bool = True) -> DiscreteSeparability:
        """Fits the samples as one batch. reset_state=False: overlaps and supports add up with those of earlier fits, and classes that are not in this batch stay."""
        if self.is_online:
            return self._fit_online(samples, reset_state)
        s, many = self._labelled(samples)
        before = None if reset_state else self._state
        index = self.index, self._weighted
        written, self._scratch = (None, self._scratch) if reset_state else (self._scratch, None)
        self.reset()
        self._state, self._scratch = before, written
        s = self._kept(self._prepared(s))
        order = lab.dimension(s)
        classes = order.count()
        if not classes:
            warnings.warn("no samples: the index stays as it was" if before else "no samples: the index stays at 1.0", RuntimeWarning, stacklevel=2)
            if before:
                self.index, self._weighted = index
                self.pairwise_, _, self.singleton_ = before
            return self
        single = lab.exploded(s)
        if many and not self.backend.multilabel:
            raise NotImplementedError("multi-label indices need a centroid backend")
        self.prototypes_ = self._kept(self.backend.fit(single))
        self.label_order_ = order
        support = single.groupBy("label").agg(F.count("*").alias("support"))
        if classes == 1:
            warnings.warn("one class only: the index stays at 1.0", RuntimeWarning, stacklevel=2)
            counts = s.sparkSession.createDataFrame([], ov.COUNTS)
        else:
            self._scorer = scoring.held(self.prototypes_)
            counts = ov.multilabel_counts(s, self._scorer) if many else ov.pairwise(single, self._scorer)
            if many:
                self.competitors_ = ov.competitors(self._scorer, order, self.multilabel_pair_mode, self.top_m)
                counts = counts.join(self.competitors_.select("y", "b"), ["y", "b"])
        # Written down, so that many fits on top of each other don't grow one plan.
        scratch = Scratch(s.sparkSession)
        self._state = tuple(scratch.written(t, "state") for t in ov.accumulated(counts, support, before, by_pair=many))
        old, self._scratch = self._scratch, scratch
        if old:
            old.discard()
        self.pairwise_, _, self.singleton_ = self._state
        if classes == 1 and before is not None:
            self.index, self._weighted = index
        else:
            self._summarise()
        return self

    def _summarise(self) -> None:
        row = ov.summary(self.singleton_, self._excluded()).first()
        if not row["n_classes"]:
            warnings.warn("all observed classes are excluded: the index stays at 1.0", RuntimeWarning, stacklevel=3)
        self.index, self._weighted = row["index"], row["weighted_index"]

    def _ordered(self, samples: DataFrame) -> DataFrame | None:
        """The samples of an online model with one label each, or None without any. A single stream is one key's state: the driver learns its rows one after another, in order; counting them is a pass over the table. Many streams at once: isthmus.streaming."""
        s, many = self._labelled(samples)
        if many:
            raise NotImplementedError("online models take one label for each sample")
        s = s.select("ord", "row_id", "features", F.col("labels")[0].alias("label"))
        s = s.repartition(s.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.DISK_ONLY)
        if s.count():
            return s
        s.unpersist()
        warnings.warn("no samples: the index stays as it was", RuntimeWarning, stacklevel=3)
        return None

    #: Samples whose categories the driver holds before it writes them down.
    LEARNT_AT_ONCE = 1 << 20
    #: Weights of categories as they were before they moved that the driver holds before it counts the samples so far.
    LEFT_AT_ONCE = 1 << 22

    @staticmethod
    def _stream(s: DataFrame, *order: str):
        """Features, as matrices, and labels of the samples in order, an Arrow batch at a time."""
        import pyarrow as pa

        def packed(batches):
            for b in batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as out:
                    out.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

        for r in s.orderBy(*order).select("features", "label").mapInArrow(packed, "rows binary").toLocalIterator():
            with pa.ipc.open_stream(r["rows"]) as rows:
                for b in rows:
                    if b.num_rows:
                        yield scoring.matrix(b.column(0)), b.column(1).to_pylist()

    def _fit_online(self, samples: DataFrame, reset_state: bool) -> DiscreteSeparability:
        """Trains on the samples, then counts each with every category visible, by the best category of its label."""
        s = self._ordered(samples)
        if reset_state:
            self.learner_.reset_counters()
        if s is not None:
            for x, y in self._stream(s, "ord", "row_id"):
                self.learner_.learn_rows(x, y)
            self.learner_.counted(replay.counts(s, self.learner_))
            s.unpersist()
        self._from_learner()
        return self

    @staticmethod
    def _noted(spark: SparkSession, got: array, upto: int, path: str) -> None:
        """Writes down categories (place, category) of samples before a place."""
        import pyarrow as pa

        rows = pa.table({"place": pa.array(range(upto - len(got), upto), pa.int64()), "category": pa.array(got, pa.int64())})
        spark.createDataFrame(rows).coalesce(1).write.mode("append").parquet(path)

    def _learnt(self, placed: DataFrame, path: str) -> dict[int, int]:
        """Trains on samples in the order of their places and writes down their categories (place, category); the categories reached so far, and from which place on (-1: before this batch)."""
        spark, learner = placed.sparkSession, self.learner_
        first = dict.fromkeys(learner.seen, -1)
        got, place = array("q"), 0
        for x, y in self._stream(placed, "place"):
            categories = learner.learn_rows(x, y)
            _reached(first, categories, place)
            got.extend(categories.tolist())
            place += len(categories)
            if len(got) >= self.LEARNT_AT_ONCE:
                self._noted(spark, got, place, path)
                del got[:]
        self._noted(spark, got, place, path)
        return first

    def partial_fit(self, samples: DataFrame) -> DiscreteSeparability:
        """Online models learn on, and count the batch with the categories visible that it has reached so far; offline models fit anew."""
        if not self.is_online:
            return self.fit(samples)
        s = self._ordered(samples)
        if s is not None:
            scratch = Scratch(s.sparkSession)
            placed = numbered(s.select("ord", "row_id", "features", "label"), ["ord", "row_id"], "place", scratch)
            path = scratch.path("categories")
            first = self._learnt(placed, path)
            categories = s.sparkSession.read.schema("place long, category long").parquet(path)
            self.learner_.counted(replay.counts(placed.join(categories, "place"), self.learner_, first), first)
            scratch.discard()
            s.unpersist()
            self._from_learner()
        return self

    def add_samples(self, samples: DataFrame) -> float:
        """What add_sample gives for the samples one after another, in order; online models only. The driver learns them, and each LEARNT_AT_ONCE of them (or fewer, if categories move a lot) are counted by a pass over these, against the categories as they stood after each sample."""
        if not self.is_online:
            raise NotImplementedError("offline models are fitted on whole batches")
        s = self._ordered(samples)
        if s is None:
            return self.index
        spark, learner, scratch = s.sparkSession, self.learner_, Scratch(s.sparkSession)
        placed = numbered(s.select("ord", "row_id", "features", "label"), ["ord", "row_id"], "place", scratch)
        first, got, left, place = dict.fromkeys(learner.seen, -1), array("q"), [], 0

        def count() -> None:
            path = scratch.path("categories")
            self._noted(spark, got, place, path)
            categories = spark.read.schema("place long, category long").parquet(path)
            now, earlier = states(first, left)
            learner.counted(replay.counts(placed.join(categories, "place"), learner, now, earlier=earlier), first)
            del got[:], left[:]

        for x, y in self._stream(placed, "place"):
            if not place:
                learner.warn_of(y[0])
            moved: list = []
            categories = learner.learn_rows(x, y, moved)
            left += [(place + i, *was) for i, *was in moved]
            _reached(first, categories, place)
            got.extend(categories.tolist())
            place += len(categories)
            if len(got) >= self.LEARNT_AT_ONCE or len(left) * 2 * x.shape[1] >= self.LEFT_AT_ONCE:
                count()
        if got:
            count()
        scratch.discard()
        s.unpersist()
        self._from_learner()
        return self.index

    def add_sample(self, x, y) -> float:
        """Learns one sample; online models only."""
        if not self.is_online:
            raise NotImplementedError("offline models are fitted on whole batches")
        self.learner_.add_sample(x, str(y))
        self._from_learner()
        return self.index

    def _from_learner(self) -> None:
        self.index, self._weighted = (f(tuple(self._excluded())) for f in (self.learner_.index, self.learner_.weighted_index))
        self._stale = True

    def __getattribute__(self, name: str):
        # The tables of an online model are made when they are asked for.
        if name in ("pairwise_", "singleton_", "prototypes_") and self.__dict__.get("_stale"):
            self._tables()
        return super().__getattribute__(name)

    def _tables(self) -> None:
        spark, learner = SparkSession.active(), self.learner_
        self._stale = False
        self.pairwise_ = spark.createDataFrame([(y, b, n, learner.support[y], learner.pairwise[y, b]) for (y, b), n in learner.adj.items()], "y string, b string, adj long, cardinality long, pairwise_index double")
        self.singleton_ = spark.createDataFrame([(y, learner.support[y], v) for y, v in learner.singleton.items()], "y string, support long, singleton_index double")
        self.prototypes_ = spark.createDataFrame([(i, c, learner.w[i].tolist(), float(learner.radius[i]), float((learner.w[i] ** 2).sum())) for i, c in enumerate(learner.owner)], scoring.PROTOTYPES)

    @property
    def weights_(self) -> DataFrame:
        """pid, class, center, radius, norm2 of an online model's categories, over coded features; for offline models their prototypes."""
        self._fitted()
        return self.prototypes_

    def predict(self, samples: DataFrame) -> DataFrame:
        if not self.is_online:
            return super().predict(samples)
        if not self.learner_.n:
            raise ValueError("the estimator has not been fitted")
        context = samples.sparkSession.sparkContext
        (block,) = replay.blocks_of(self.learner_, None, self.learner_.w.nbytes + 1)
        held = context.broadcast(block)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                x = scoring.matrix(b.column(1))
                if not len(x):
                    continue
                if not ((x >= 0) & (x <= 1)).all():
                    raise ValueError("features must be finite and lie in the unit interval [0, 1]")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.best(x).astype("int32"))], names=["row_id", "pid"])

        rows = samples.select(F.col("row_id").cast("long"), F.col("features").cast("array<double>"))
        return rows.repartition(context.defaultParallelism).mapInArrow(run, "row_id long, pid int")

    def top2(self, samples: DataFrame) -> DataFrame:
        """row_id, rank, pid, score of the two best prototypes of each sample."""
        self._fitted()
        return scoring.topk(self._prepared(samples), self._scorer or self.prototypes_, 2)

    def top2_by_class(self, samples: DataFrame) -> DataFrame:
        self._fitted()
        return scoring.class_top2(self._prepared(samples), self._scorer or self.prototypes_)


class ContinuousSeparability(_Params):
    """How far overlap in feature space is harmless for a continuous target: 1 without harmful overlap, 0.5 as under a permuted target."""

    def __init__(self, rho=0.9, r_hat=math.inf, model_type="MiniBatchKMeans", match_tracking="MT+", kmeans_k=8, kmeans_kwargs=None, ballcover_k="auto", ballcover_radius=0.25, ballcover_kwargs=None, offline_chunk_size=10_000, target_cover="auto", n_target_cells="auto", target_cover_kwargs=None, target_distance="auto", adjacency_mode="hard_top1", top_k=5, feature_temperature=1.0, normalization="permutation", n_null_permutations=20, aggregation="support_weighted", target_scaling="standard", n_projections=64, random_state=None, clip=True):
        for n, v in list(locals().items()):
            if n not in ("self", "__class__"):
                setattr(self, n, v)
        self._validate()
        self.reset()

    def reset(self) -> None:
        """Back to the state before any fit."""
        self._drop_cached()
        for n in [n for n in self.__dict__ if n.endswith("_") and not n.startswith("_")]:
            delattr(self, n)
        self.prototypes_ = None
        self.index, self._weighted = 1.0, 1.0

    def _validate(self) -> None:
        if self.model_type in ONLINE:
            raise NotImplementedError("online models don't take continuous targets")
        if self.model_type not in backends.BACKENDS:
            raise ValueError(f"model_type must be one of {tuple(backends.BACKENDS)}")
        co.cover_options(self.target_cover_kwargs)
        if self.adjacency_mode == "soft_topk":
            raise NotImplementedError("adjacency_mode='soft_topk' is not available")
        if self.adjacency_mode != "hard_top1":
            raise ValueError("adjacency_mode must be 'hard_top1'")
        if self.normalization != "permutation":
            raise ValueError("normalization must be 'permutation'")
        if self.aggregation not in ("macro", "support_weighted"):
            raise ValueError("aggregation must be 'macro' or 'support_weighted'")
        if self.target_scaling not in co.SCALINGS:
            raise ValueError(f"target_scaling must be one of {co.SCALINGS}")
        for n in ("n_null_permutations", "n_projections", "top_k", "feature_temperature"):
            if getattr(self, n) <= 0:
                raise ValueError(f"{n} must be positive")
        if self.n_target_cells != "auto" and self.n_target_cells <= 0:
            raise ValueError("n_target_cells must be positive")
        co.resolved_cover(self.target_cover, 1)
        co.resolved_distance(self.target_distance, 1)

    @property
    def weighted_index(self) -> float:
        return self._weighted

    def partial_fit(self, samples: DataFrame) -> ContinuousSeparability:
        return self.fit(samples)

    def fit(self, samples: DataFrame) -> ContinuousSeparability:
        n, _ = validation.check_features(samples)
        s = validation.targets(samples)
        _, d = validation.check_features(s, "target")
        self.reset()
        if not n:
            warnings.warn("no samples: the index stays at 1.0", RuntimeWarning, stacklevel=2)
            return self
        self._scratch = scratch = Scratch(samples.sparkSession)
        cover, seed = co.resolved_cover(self.target_cover, d), self.random_state or 0
        self.resolved_distance_ = co.resolved_distance(self.target_distance, d)
        directions = None if d == 1 else co.random_directions(self.n_projections, d, self.random_state)
        cells = co.cell_count(n, self.n_target_cells)
        scaled = co.scaled_targets(self._prepared(s.select("row_id", F.col("features").cast("array<double>").alias("features"), "target")), self.target_scaling)
        s = self._kept(co.cells_of(scaled, cover, cells, seed, options=self.target_cover_kwargs))
        if s.select("cell").distinct().count() < 2:
            warnings.warn("one target cell only: the index stays at 1.0", RuntimeWarning, stacklevel=2)
            return self
        backend = self.backend
        self.prototypes_ = self._kept(backend.fit(s))
        if self.prototypes_.count() < 2:
            warnings.warn("one prototype only: the index stays at 1.0", RuntimeWarning, stacklevel=2)
            return self
        scorer = scoring.held(self.prototypes_)
        self.own_prototype_ = self._kept(scoring.own_best(s, scorer).select("row_id", "pid"))
        self.prototype_targets_ = self._kept(s.select("row_id", "target").join(self.own_prototype_, "row_id").select("pid", "target"))
        self.prototype_stats_ = co.prototype_stats(self.prototype_targets_)
        self.adjacency_ = self._kept(co.adjacency(s.select("row_id", "features"), scorer, self.own_prototype_))
        support = self.prototype_targets_.groupBy("pid").agg(F.count("*").alias("support"))
        distances = self._kept(co.wasserstein(co.projected(self.prototype_targets_, directions), self.adjacency_, scratch))
        co.check_distances(distances)
        losses = self._kept(co.local_losses(self.adjacency_, distances, support))
        self.actual_loss_ = co.overall_loss(losses).first()["loss"]
        # Targets move as a whole; prototypes are fitted anew for every permutation, all in one go.
        by_cell = backend.by_permutation(self.n_null_permutations)
        found = co.null_losses(s.select("row_id", "features", "target", "label"), by_cell.fit, self.n_null_permutations, directions, f"{seed}:", scratch)
        null = [r["loss"] for r in sorted(found.collect(), key=lambda r: r["perm"])]
        self.null_losses_, self.null_loss_ = null, sum(null) / len(null)
        self.loss_ratio_ = self.actual_loss_ / self.null_loss_ if self.null_loss_ > co.EPS else 0.0 if self.actual_loss_ <= co.EPS else math.inf
        self.raw_index_ = co.raw_index(self.actual_loss_, self.null_loss_)
        self.prototype_index_ = losses.withColumn("prototype_index", co.clipped(co.index_column(F.col("loss"), self.null_loss_), self.clip))
        i = F.col("prototype_index")
        row = self.prototype_index_.agg(F.avg(i).alias("m"), (F.sum(i * F.col("support")) / F.sum("support")).alias("w")).first()
        bound = lambda v: min(max(v, 0.0), 1.0) if self.clip else v
        self.macro_index_, self._weighted = bound(row["m"]), bound(row["w"])
        self.index = self._weighted if self.aggregation == "support_weighted" else self.macro_index_
        return self
