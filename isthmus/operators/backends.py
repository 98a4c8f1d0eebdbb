"""Backends: how class-owned prototypes are fitted. An estimator's model_type names one.

A backend of one's own takes the same three steps as those here and is put into BACKENDS:

    class Grid(Backend):
        def fit(self, samples): ...

    BACKENDS["Grid"] = Grid
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isthmus.functions.vectors import l2_normalized

from . import prototypes as proto


class Backend:
    """A way to fit prototypes, made from an estimator's parameters."""

    #: Whether prototypes may be fitted on rows that stand for one label of several.
    multilabel = True
    #: The parameters that may be mappings by class.
    by_class: tuple[str, ...] = ()

    def __init__(self, estimator):
        self.estimator = estimator

    def prepared(self, samples: DataFrame) -> DataFrame:
        """The samples with features as the prototypes see them."""
        return samples

    def fit(self, samples: DataFrame) -> DataFrame:
        """pid, class, center, radius, norm2 for prepared samples (row_id, features, label)."""
        raise NotImplementedError

    def by_permutation(self, permutations: int) -> Backend:
        """The same backend for labels "perm|label": mappings by class hold for every permutation's class."""
        out, inner = copy.copy(self), copy.copy(self.estimator)
        for name in self.by_class:
            value = getattr(inner, name)
            if isinstance(value, dict):
                setattr(inner, name, {f"{p:06d}|{self._cell(c)}": v for p in range(permutations) for c, v in value.items()})
        inner._cached = []
        out.estimator = inner
        return out

    @staticmethod
    def _cell(c) -> str:
        return f"{c:06d}" if isinstance(c, int) else str(c)


class _Centroids(Backend):
    by_class = ("kmeans_k",)
    known: tuple[str, ...] = ()
    #: Keywords that change nothing in the result.
    without_effect = ("algorithm", "copy_x", "verbose", "compute_labels")

    def options(self) -> dict:
        """kmeans_kwargs as arguments; TypeError for a keyword that isn't known."""
        given = dict(self.estimator.kmeans_kwargs or {})
        for n in given:
            if n not in self.known + self.without_effect + ("random_state",):
                raise TypeError(f"unexpected keyword {n!r} in kmeans_kwargs of {self.estimator.model_type}")
        out = {k: v for k, v in given.items() if k in self.known}
        if out.get("n_init", "auto") == "auto":
            out["n_init"] = 1
        return out | {"seed": given.get("random_state") or 0}


class KMeans(_Centroids):
    known = ("n_init", "max_iter", "tol", "init")

    def fit(self, samples: DataFrame) -> DataFrame:
        return proto.kmeans(samples, self.estimator.kmeans_k, **self.options())


class MiniBatchKMeans(_Centroids):
    known = ("n_init", "max_iter", "batch_size", "init")

    def fit(self, samples: DataFrame) -> DataFrame:
        return proto.minibatch_kmeans(samples, self.estimator.kmeans_k, **self.options())


class BallCover(Backend):
    """Leaves class_diagnostics_, diagnostics_, resolved_metric_ and ball_members_ (None unless they are to be stored) with the estimator."""

    multilabel = False
    by_class = ("ballcover_k", "ballcover_radius")
    without_effect = ("chunk_size", "dtype", "random_state")

    def options(self) -> dict:
        return {k: v for k, v in (self.estimator.ballcover_kwargs or {}).items() if k not in (*self.without_effect, "store_memberships")}

    def prepared(self, samples: DataFrame) -> DataFrame:
        """Of length 1 where the cover works with cosines."""
        options = self.options()
        head = samples.select(F.size("features").alias("d")).first()
        if proto.resolved_metric(options.get("metric", "auto"), head["d"] if head else 0, options.get("high_dim_threshold", 128)) == "cosine":
            return samples.withColumn("features", l2_normalized(F.col("features")))
        return samples

    def fit(self, samples: DataFrame) -> DataFrame:
        e, options = self.estimator, self.options()
        store = (e.ballcover_kwargs or {}).get("store_memberships", False)
        found, e.class_diagnostics_, e.resolved_metric_ = proto.ball_cover(samples, e.ballcover_k, e.ballcover_radius, **options)
        head = samples.select(F.size("features").alias("d")).first()
        e.diagnostics_ = proto.fit_diagnostics(e.class_diagnostics_, head["d"] if head else 0, options.get("high_dim_threshold", 128), store)
        e.ball_members_ = proto.memberships(samples, found) if store else None
        return found


BACKENDS: dict[str, type[Backend]] = {"KMeans": KMeans, "MiniBatchKMeans": MiniBatchKMeans, "BallCover": BallCover}
