"""Rules and refusals that need no table."""

import math

import pytest
from pyspark.sql import functions as F

from isthmus.estimators import ContinuousSeparability, DiscreteSeparability
from isthmus.operators import continuous as co
from isthmus.operators import prototypes as proto
from isthmus.operators import scoring
from isthmus.sources import tables


def test_metric_by_number_of_features():
    for n in range(1, 257):
        for t in (16, 128):
            assert proto.resolved_metric("auto", n, t) == ("cosine" if n >= t else "euclidean")


def test_numbers_of_cells():
    for n in range(1, 6000, 7):
        assert co.cell_count(n) == min(max(8, math.floor(math.sqrt(n))), 64, n) and co.cell_count(n, 20) == min(20, n)


def test_cover_and_distance_by_number_of_targets():
    for k in range(1, 9):
        assert (co.resolved_cover("auto", k), co.resolved_distance("auto", k)) == (("quantile", "wasserstein") if k == 1 else ("kmeans", "sliced_wasserstein"))


def test_directions_have_length_one():
    assert all(abs(sum(v * v for v in x) - 1) < 1e-12 for x in co.random_directions(32, 3, 5))


WITHOUT_DATA = {
    ValueError: [
        lambda: DiscreteSeparability(model_type="Grid"), lambda: DiscreteSeparability(multilabel_pair_mode="some"), lambda: DiscreteSeparability(multilabel_pair_mode="top_m", top_m=0), lambda: DiscreteSeparability(offline_chunk_size=0),
        lambda: DiscreteSeparability().set_params(nothing=1), lambda: DiscreteSeparability(model_type="Fuzzy").add_sample([[0.5]], "a"), lambda: DiscreteSeparability(model_type="Hypersphere").add_sample([2.0], "a"),
        lambda: proto.check_cover("auto", "auto", 1.0, None, "farthest"), lambda: proto.check_cover(-1, "auto", 1.0, None, "farthest"), lambda: proto.check_cover(3, -1.0, 1.0, None, "farthest"),
        lambda: proto.check_cover(3, "auto", 0.0, None, "farthest"), lambda: proto.check_cover(3, "auto", 1.0, 0, "farthest"), lambda: proto.check_cover(3, "auto", 1.0, None, "nearest"), lambda: proto.resolved_metric("cityblock", 3),
        lambda: proto.per_class({"a": 1}, "b", "k"), lambda: ContinuousSeparability(aggregation="median"), lambda: ContinuousSeparability(n_null_permutations=0), lambda: co.resolved_cover("quantile", 2), lambda: co.resolved_distance("wasserstein", 2),
    ],
    TypeError: [lambda: DiscreteSeparability(exclude_classes=[["a"]]), lambda: ContinuousSeparability(target_cover_kwargs={"clusters": 3})],
    NotImplementedError: [lambda: DiscreteSeparability().add_sample([0.5], "a"), lambda: ContinuousSeparability(model_type="Fuzzy"), lambda: ContinuousSeparability(adjacency_mode="soft_topk")],
    AttributeError: [lambda: DiscreteSeparability().module_a],
}


@pytest.mark.parametrize("error", WITHOUT_DATA)
def test_refused(error):
    for f in WITHOUT_DATA[error]:
        with pytest.raises(error):
            f()


def test_refused_with_data(spark, sf):
    s = tables.embeddings(spark, sf)
    for error, f in (
        (ValueError, lambda: DiscreteSeparability().predict(s)), (ValueError, lambda: DiscreteSeparability().fit(s.limit(1).withColumn("features", F.array(F.lit(float("nan")))))),
        (TypeError, lambda: DiscreteSeparability(kmeans_kwargs={"n_clusters_": 3}).fit(s)), (ValueError, lambda: scoring.own_best(s, proto.landmarks(s.where("label <> '1'"), 2))),
    ):
        with pytest.raises(error):
            f()
