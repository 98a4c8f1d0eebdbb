"""Queries of the discrete and multi-label index, with SQL twins over the same tables.

Prototypes that SQL can rebuild (landmarks, means, farthest-first covers) make the scoring comparable
row by row; ratios are rounded to 6 digits on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isthmus import ml
from isthmus.estimators import ContinuousSeparability, DiscreteSeparability
from isthmus.functions.session import shared_root
from isthmus.functions.vectors import complement_coded, l2_normalized
from isthmus.operators import continuous as co
from isthmus.operators import labels as lab
from isthmus.operators import overlap as ov
from isthmus.operators import prototypes as proto
from isthmus.operators import scoring, validation
from isthmus.sources import tables

M, RADIUS, COVER_K, COVER_FRACTION = 8, 1.1, 4, 0.8731  # a fraction that falls between samples, so that no distance equals the radius
EXCLUDED = ["0", "3"]


def r6(column: str):
    return (F.round(F.col(column), 6) + F.lit(0.0)).alias(column)  # no negative zero


def _marks(spark: SparkSession, d: str, m: int = M) -> tuple[DataFrame, DataFrame]:
    s = tables.embeddings(spark, d)
    return s, proto.landmarks(s, m)


def _pairs(spark, d):
    s, p = _marks(spark, d)
    return s, p, ov.pairwise(s, p)


def oi_landmark_summary(spark, d):
    s, _, pairs = _pairs(spark, d)
    return ov.summary(ov.singleton(pairs, ov.support(s))).select(r6("index"), r6("weighted_index"), "n_classes")


def oi_pairwise(spark, d):
    return _pairs(spark, d)[2].select("y", "b", "adj", "cardinality", r6("pairwise_index"))


def oi_singleton(spark, d):
    s, _, pairs = _pairs(spark, d)
    return ov.singleton(pairs, ov.support(s)).select("y", "support", r6("singleton_index"))


def oi_support(spark, d):
    return ov.support(tables.embeddings(spark, d))


def oi_exclude(spark, d):
    s, _, pairs = _pairs(spark, d)
    return ov.summary(ov.singleton(pairs, ov.support(s)), EXCLUDED).select(r6("index"), r6("weighted_index"), "n_classes")


def oi_exclude_all(spark, d):
    s, _, pairs = _pairs(spark, d)
    return ov.summary(ov.singleton(pairs, ov.support(s)), [str(i) for i in range(10)]).select(r6("index"), r6("weighted_index"), "n_classes")


def minmax_scale_orders(spark, d):
    s = validation.minmax_scaled(tables.orders(spark, d))
    return s.select("row_id", F.round(F.col("features")[0], 6).alias("x0"), F.round(F.col("features")[1], 6).alias("x1"))


def minmax_scale_part(spark, d):
    s = validation.minmax_scaled(tables.samples(tables.read(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"]))
    return s.select("row_id", F.round(F.col("features")[0], 6).alias("x0"), F.round(F.col("features")[1], 6).alias("x1"))


def complement_code(spark, d):
    s = tables.samples(tables.read(spark, d, "part").withColumn("u", F.col("p_size") / 50.0), "p_partkey", ["u"])
    x = complement_coded(F.col("features"))
    return s.select("row_id", F.round(x[0], 6).alias("x0"), F.round(x[1], 6).alias("x1"))


def l2_normalize(spark, d):
    s = tables.embeddings(spark, d).withColumn("x", l2_normalized(F.col("features")))
    return s.select("row_id", *(F.round(F.col("x")[i], 6).alias(f"x{i}") for i in (0, 1, 63)))


def validate_features(spark, d):
    return validation.feature_report(tables.embeddings(spark, d))


def _flags(spark, d):
    return tables.read(spark, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("ord"), F.array("quality", "toxic").alias("indicator"))


def indicator_to_labels(spark, d):
    return lab.from_indicator(_flags(spark, d)).select("row_id", F.array_join("labels", ",").alias("labels"))


def explode_labels(spark, d):
    s = lab.normalized(tables.document_labels(spark, d))
    return lab.exploded(s.select("row_id", "labels")).select("row_id", "label")


def labels_dimension(spark, d):
    return lab.dimension(lab.normalized(tables.document_labels(spark, d))).select("label", F.col("idx").cast("long").alias("idx"), "first_ord", "support")


def class_bmu(spark, d):
    s, p = _marks(spark, d)
    return scoring.own_best(s, p).select("row_id", "label", F.col("pid").cast("long").alias("pid"), r6("score"))


def predict_bmu(spark, d):
    s, p = _marks(spark, d)
    return scoring.topk(s, p, 1).select("row_id", F.col("pid").cast("long").alias("pid"))


def scores_all(spark, d):
    s, p = _marks(spark, d, 2)
    return scoring.score_table(s, p).select("row_id", F.col("pid").cast("long").alias("pid"), "class", r6("score"))


def topk_prototypes(spark, d):
    s, p = _marks(spark, d)
    return scoring.topk(s, p, 3).select("row_id", F.col("rank").cast("long").alias("rank"), F.col("pid").cast("long").alias("pid"), r6("score"))


def topk_candidates(spark, d):
    s, p = _marks(spark, d)
    return scoring.topk(s, p, 3, ["1", "2"]).select("row_id", F.col("rank").cast("long").alias("rank"), F.col("pid").cast("long").alias("pid"), r6("score"))


def top2_bmu(spark, d):
    s, p = _marks(spark, d)
    two = scoring.topk(s, p, 2).groupBy("row_id").agg(*(F.max(F.when(F.col("rank") == i, F.col("pid"))).cast("long").alias(f"b{i}") for i in (1, 2)))
    return two


def top2_vs_each_class(spark, d):
    s, p = _marks(spark, d)
    return scoring.class_top2(s, p).select("row_id", "class", r6("s1"), F.col("p1").cast("long").alias("p1"), r6("s2"), F.col("p2").cast("long").alias("p2"))


def top2_class_pair(spark, d):
    s, p = _marks(spark, d)
    return scoring.topk(s, p, 2, ["0", "1"]).select("row_id", F.col("rank").cast("long").alias("rank"), F.col("pid").cast("long").alias("pid"))


def _balls(spark, d, k=COVER_K, radius="auto", fraction=COVER_FRACTION):
    s = tables.embeddings(spark, d)
    return s, *proto.ball_cover(s, k, radius, "euclidean", fraction)


def ballcover_fixed_k(spark, d):
    _, p, _, _ = _balls(spark, d)
    return p.select(F.col("pid").cast("long").alias("pid"), "class", *(F.round(F.col("center")[i], 6).alias(f"c{i}") for i in (0, 1)), r6("radius"))


def ball_scores(spark, d):
    s, p, _, _ = _balls(spark, d)
    return scoring.topk(s, p, 1).select("row_id", F.col("pid").cast("long").alias("pid"), F.round("score", 5).alias("score"))


def ballcover_fixed_radius(spark, d):
    _, p, diag, _ = _balls(spark, d, "auto", RADIUS, 0.5)
    return diag.select("class", "n_samples", "n_balls", r6("radius"), r6("covered_fraction"), "stopped_by_max_balls", "metric")


def ballcover_membership(spark, d):
    s, p, _, _ = _balls(spark, d)
    return proto.memberships(s, p).groupBy(F.col("pid").cast("long").alias("pid")).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def ballcover_diag(spark, d):
    _, _, diag, _ = _balls(spark, d)
    return diag.select("class", F.col("n_samples").cast("long").alias("n_samples"), "n_balls", r6("radius"), r6("covered_fraction"), r6("mean_nearest_distance"), r6("max_nearest_distance"))


def ballcover_fit_diag(spark, d):
    _, _, diag, _ = _balls(spark, d)
    return proto.fit_diagnostics(diag, 64).select("n_samples", "n_features", "n_classes", "n_balls", "metric", F.col("high_dim_threshold").cast("long").alias("high_dim_threshold"), "stored_memberships")


def ballcover_class_diag(spark, d):
    """What each class was asked for, and the ids of its balls."""
    _, _, diag, _ = _balls(spark, d)
    return diag.select("class", "mode", "metric", F.array_join(F.transform("ball_ids", lambda v: v.cast("string")), ",").alias("ball_ids"))


def ballcover_fixed_k_radius(spark, d):
    _, _, diag, _ = _balls(spark, d, COVER_K, RADIUS, 1.0)
    return diag.select("class", "mode", "n_balls", r6("radius"), r6("covered_fraction"), r6("mean_nearest_distance"))


def ballcover_per_class(spark, d):
    """Numbers of balls by class: 1 to 4."""
    _, _, diag, _ = _balls(spark, d, {str(c): 1 + c % COVER_K for c in range(10)}, {str(c): 0.9 + 0.05 * c for c in range(10)}, 1.0)
    return diag.select("class", "n_balls", r6("radius"), r6("covered_fraction"), r6("max_nearest_distance"))


def oi_ballcover(spark, d):
    s, p, _, _ = _balls(spark, d)
    return ov.pairwise(s, p).select("y", "b", "adj", "cardinality", r6("pairwise_index"))


def kmeans_k1_centers(spark, d):
    p = proto.class_means(tables.embeddings(spark, d), 64)
    return p.select(F.col("pid").cast("long").alias("pid"), "class", *(F.round(F.col("center")[i], 6).alias(f"c{i}") for i in (0, 1, 63)), r6("norm2"))


def lloyd_fixed_iter(spark, d):
    s = validation.minmax_scaled(tables.orders(spark, d))
    p = proto.lloyd(s, proto.landmarks(s, 3), 2)
    return p.select(F.col("pid").cast("long").alias("pid"), "class", *(F.round(F.col("center")[i], 5).alias(f"c{i}") for i in (0, 1)))


DEFAULT_K = 8


def oi_kmeans(spark, d):
    s = tables.embeddings(spark, d)
    pairs = ov.pairwise(s, proto.kmeans(s, DEFAULT_K, seed=0))
    return ov.summary(ov.singleton(pairs, ov.support(s))).select(r6("index"), r6("weighted_index"), "n_classes")


def oi_minibatch(spark, d):
    s = tables.embeddings(spark, d)
    pairs = ov.pairwise(s, proto.minibatch_kmeans(s, DEFAULT_K, seed=0))
    return ov.summary(ov.singleton(pairs, ov.support(s))).select(r6("index"), r6("weighted_index"), "n_classes")


ROUNDS, ROUND_K = 2, 3


def _fixed(spark, d, fit):
    s = tables.embeddings(spark, d)
    return s, fit(s)


def kmeans_fixed_rounds(spark, d):
    """k-means from starts drawn by row id, after a fixed number of rounds: centres of every class."""
    _, p = _fixed(spark, d, lambda s: proto.kmeans(s, ROUND_K, seed=7, max_iter=ROUNDS, tol=0.0, init="random"))
    return p.select(F.col("pid").cast("long").alias("pid"), "class", *(F.round(F.col("center")[i], 6).alias(f"c{i}") for i in (0, 1, 63)))


def minibatch_fixed_rounds(spark, d):
    """Mini-batch k-means on classes smaller than a batch: running means over two batches of all rows."""
    _, p = _fixed(spark, d, lambda s: proto.minibatch_kmeans(s, ROUND_K, seed=7, max_iter=ROUNDS))
    return p.select(F.col("pid").cast("long").alias("pid"), "class", *(F.round(F.col("center")[i], 6).alias(f"c{i}") for i in (0, 1, 63)))


def kmeans_plus_plus(spark, d):
    """The rows that k-means++ starts from, drawn by their squared distance."""
    _, p = _fixed(spark, d, lambda s: proto.kmeans(s, ROUND_K, seed=7, max_iter=0))
    s = tables.embeddings(spark, d).select("row_id", F.col("label").alias("class"), F.round(F.col("features")[0], 6).alias("c0"), F.round(F.col("features")[1], 6).alias("c1"))
    q = p.select(F.col("pid").cast("long").alias("pid"), "class", F.round(F.col("center")[0], 6).alias("c0"), F.round(F.col("center")[1], 6).alias("c1"))
    return q.join(s, ["class", "c0", "c1"]).select("pid", "class", "row_id")


def kmeans_parallel(spark, d):
    """The rows that k-means|| starts from, drawn in a few rounds for any number of centres; as a class's rows that no task takes whole."""
    s = proto.drawn(tables.embeddings(spark, d), 7)
    ks = dict.fromkeys(proto.class_sizes(s), ROUND_K)
    rows = [(c, i, v[:2].tolist()) for (c, _), vs in proto.scalable_starts(s, ks, 0).items() for i, v in enumerate(vs)]
    q = spark.createDataFrame(rows, "class string, place long, c array<double>").select("class", "place", F.round(F.col("c")[0], 6).alias("c0"), F.round(F.col("c")[1], 6).alias("c1"))
    own = s.select("row_id", F.col("label").alias("class"), F.round(F.col("features")[0], 6).alias("c0"), F.round(F.col("features")[1], 6).alias("c1"))
    return q.join(own, ["class", "c0", "c1"]).select("class", "place", "row_id")


def oi_kmeans_fixed(spark, d):
    s, p = _fixed(spark, d, lambda s: proto.kmeans(s, ROUND_K, seed=7, max_iter=ROUNDS, tol=0.0, init="random"))
    return ov.summary(ov.singleton(ov.pairwise(s, p), ov.support(s))).select(r6("index"), r6("weighted_index"), "n_classes")


def _estimator(spark, d, **how):
    s = tables.embeddings(spark, d)
    options = {"metric": "euclidean", "cover_fraction": COVER_FRACTION}
    return DiscreteSeparability(model_type="BallCover", ballcover_k=COVER_K, ballcover_radius="auto", ballcover_kwargs=options, **how), s


def _scores(spark, m):
    return spark.createDataFrame([(round(m.index, 6), round(m.weighted_index, 6), m.singleton_.count())], "index double, weighted_index double, n_classes long")


def est_fit(spark, d):
    """The estimator's attributes after a fit."""
    m, s = _estimator(spark, d)
    return _scores(spark, m.fit(s))


def est_exclude(spark, d):
    """Excluded classes given twice, as strings and as numbers; the classes themselves stay in the tables."""
    m, s = _estimator(spark, d, exclude_classes=["0", "0", 3, "3"])
    return _scores(spark, m.fit(s))


def est_partial_fit(spark, d):
    """An offline model is fitted anew by each batch: the last one counts."""
    m, s = _estimator(spark, d)
    m.partial_fit(s.where("row_id % 2 = 1"))
    return _scores(spark, m.partial_fit(s))


def est_score(spark, d):
    m, s = _estimator(spark, d)
    first = m.score(s)
    again = m.score()
    m.set_params(**m.get_params())
    return spark.createDataFrame([(round(first, 6), round(again, 6), m.score())], "fitted double, current double, after_reset double")


def est_fit_predict(spark, d):
    m, s = _estimator(spark, d)
    return m.fit_predict(s).select("row_id", F.col("pid").cast("long").alias("pid"))


def est_pipeline(spark, d):
    """The same predictions from a pipeline that is fitted, saved, read again and applied to the table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    renamed = SQLTransformer(statement="SELECT vec_id AS row_id, embedding AS features, CAST(label AS STRING) AS label FROM __THIS__")
    options = {"metric": "euclidean", "cover_fraction": COVER_FRACTION}
    stage = ml.Separability(modelType="BallCover", ballcoverK=COVER_K, ballcoverRadius="auto", ballcoverKwargs=options)
    t = tables.read(spark, d, "embeddings")
    model = ml.saved(Pipeline(stages=[renamed, stage]).fit(t), spark)
    return model.transform(t).select("row_id", F.col("prediction").cast("long").alias("pid"))


def est_classes(spark, d):
    """Which prototypes a class owns, from the estimator's table."""
    m, s = _estimator(spark, d)
    return m.fit(s).weights_.groupBy("class").agg(F.count("*").alias("n"), F.min("pid").cast("long").alias("first"), F.max("pid").cast("long").alias("last"))


def label_kinds(spark, d):
    """Strings are one label however long; arrays are sets of labels."""
    one = lab.normalized(tables.read(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("label")), "label")
    many = lab.normalized(tables.document_labels(spark, d).select("row_id", F.concat("labels", "labels").alias("labels")))
    kind = lambda s, name: s.groupBy(F.size("labels").alias("size")).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), F.col("size").cast("long").alias("size"), "n")
    return kind(one, "string").unionByName(kind(many, "array"))


def text_source(spark, d):
    """Parts written as lines of white-space separated fields and read back."""
    path = f"{shared_root(spark)}/text-{uuid.uuid4().hex}"
    cols = [F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.col("p_brand")]
    tables.read(spark, d, "part").select(F.concat_ws("  ", *cols)).write.text(path)
    return tables.whitespace_text(spark, path).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("features")[0]).alias("s0"), F.sum(F.col("features")[1]).alias("s1"))


def ml_pair_rows(spark, d):
    return lab.pair_rows(lab.normalized(tables.document_labels(spark, d)))


def _multi(spark, d):
    s = lab.normalized(tables.document_labels(spark, d))
    p = proto.landmarks(lab.exploded(s), 6)
    return s, p


def ml_pairwise(spark, d):
    s, p = _multi(spark, d)
    return ov.multilabel_counts(s, p).select("y", "b", "adj", "cardinality", r6("pairwise_index"))


def ml_singleton(spark, d):
    s, p = _multi(spark, d)
    sup = lab.exploded(s).groupBy("label").agg(F.count("*").alias("support"))
    return ov.singleton(ov.multilabel_counts(s, p), sup).select("y", "support", r6("singleton_index"))


def ml_singleton_sparse(spark, d):
    """The same indices without the table of all pairs of classes."""
    s, p = _multi(spark, d)
    return ov.multilabel_singletons(s, p).select("y", "support", r6("singleton_index"))


def ml_summary(spark, d):
    s, p = _multi(spark, d)
    sup = lab.exploded(s).groupBy("label").agg(F.count("*").alias("support"))
    return ov.summary(ov.singleton(ov.multilabel_counts(s, p), sup)).select(r6("index"), r6("weighted_index"), "n_classes")


def ml_top_m(spark, d):
    s, p = _multi(spark, d)
    rivals = ov.competitors(p, lab.dimension(s), "top_m", 2)
    pairs = ov.multilabel_counts(s, p).join(rivals, ["y", "b"])
    return pairs.select("y", "b", F.col("rank").cast("long").alias("rank"), r6("distance"), "adj", "cardinality", r6("pairwise_index"))


def visible_replay(spark, d):
    s, p = _marks(spark, d)
    first = {r["pid"]: r["row_id"] for r in p.join(s.select("row_id", F.col("label").alias("class"), F.col("features").alias("center")), ["class", "center"]).select("pid", "row_id").collect()}
    return ov.replayed(s, p, first).select("y", "b", "adj", "cardinality", r6("pairwise_index"))


def visible_replay_blocks(spark, d):
    """The same with a block of prototypes for each class, and rows of a class that owns none."""
    s, p = _marks(spark, d)
    first = {r["pid"]: r["row_id"] for r in p.join(s.select("row_id", F.col("label").alias("class"), F.col("features").alias("center")), ["class", "center"]).select("pid", "row_id").collect()}
    s = s.unionByName(s.where("label = '1'").withColumn("label", F.lit("stray")).withColumn("row_id", -F.col("row_id") - 1))
    return ov.replayed(s, scoring.Held(p, 1), first).select("y", "b", "adj", "cardinality", r6("pairwise_index"))


def accumulate_summary(spark, d):
    """Classes 0 to 5, then 4 to 9: what the first batch said of 0 to 3 stays, and what the second says of 4 and 5 is taken over both supports."""
    s = tables.embeddings(spark, d)
    state = None
    for part in (s.where("cast(label as int) <= 5"), s.where("cast(label as int) >= 4")):
        state = ov.accumulated(ov.pairwise(part, proto.landmarks(part, 4)), ov.support(part), state)
    return state[2].select("y", "support", r6("singleton_index"))


def accumulate_two_batches(spark, d):
    """Counters of two batches, each scored against prototypes of its own, added up."""
    s = tables.embeddings(spark, d)
    half = [s.where("row_id % 2 = 0"), s.where("row_id % 2 = 1")]
    counts = [ov.pairwise(h, proto.landmarks(h, 4)) for h in half]
    return ov.summed(counts[0].unionByName(counts[1])).select("y", "b", "adj", "cardinality", r6("pairwise_index"))


def degenerate_empty(spark, d):
    s = tables.embeddings(spark, d).where("label = 'none such'")
    pairs = ov.pairwise(s, proto.landmarks(s, M))
    return ov.summary(ov.singleton(pairs, ov.support(s)))


def degenerate_single_class(spark, d):
    s = tables.embeddings(spark, d).where("label = '1'")
    pairs = ov.pairwise(s, proto.landmarks(s, M))
    return ov.summary(ov.singleton(pairs, ov.support(s)))


# SQL twins.

SAMPLES = "s AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS x, label::VARCHAR AS label FROM embeddings)"


def marks_sql(m: int = M) -> str:
    return f"""WITH {SAMPLES},
p0 AS (SELECT label AS class, x AS c, row_id, row_number() OVER (PARTITION BY label ORDER BY row_id) AS l FROM s),
p AS (SELECT row_number() OVER (ORDER BY class, l) - 1 AS pid, class, c, row_id AS first_ord, NULL::DOUBLE AS r2 FROM p0 WHERE l <= {m}),
{SCORES}"""


SCORES = """sc AS (SELECT s.row_id, s.label, p.pid, p.class, p.first_ord,
  CASE WHEN p.r2 IS NULL THEN -power(list_distance(s.x, p.c), 2) ELSE 1 - power(list_distance(s.x, p.c), 2) / p.r2 END AS score FROM s, p),
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id, class ORDER BY score DESC, pid) AS k FROM sc),
t AS (SELECT row_id, any_value(label) AS label, class, max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 1 THEN pid END) AS p1,
  max(CASE WHEN k = 2 THEN score END) AS s2, max(CASE WHEN k = 2 THEN pid END) AS p2 FROM rk WHERE k <= 2 GROUP BY row_id, class)"""
PAIRS = """pw AS (SELECT o.label AS y, b.class AS b, count_if(o.s2 IS NULL OR b.s1 > o.s2) AS adj, count(*) AS cardinality
  FROM t o JOIN t b ON o.row_id = b.row_id AND o.class = o.label AND b.class <> o.label GROUP BY 1, 2)"""
SINGLE = """su AS (SELECT label, count(*) AS support FROM s GROUP BY label),
si AS (SELECT label AS y, support, coalesce((SELECT min(1 - adj / cardinality) FROM pw WHERE pw.y = su.label), 1.0) AS singleton_index FROM su)"""
PAIR_OUT = "SELECT y, b, adj::BIGINT AS adj, cardinality, round(1 - adj / cardinality, 6) AS pairwise_index FROM pw"
SINGLE_OUT = "SELECT y, support, round(singleton_index, 6) AS singleton_index FROM si"


def summary_out(where: str = "true") -> str:
    return f"""SELECT round(coalesce(avg(singleton_index), 1.0), 6) AS index, round(coalesce(sum(singleton_index * support) / sum(support), 1.0), 6) AS weighted_index, count(*) AS n_classes FROM si WHERE {where}"""


def topk_sql(k: int, where: str = "true", score: str = ", round(score, 6) + 0.0 AS score") -> str:
    return f"SELECT row_id, rank, pid{score} FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, pid) AS rank FROM sc WHERE {where}) WHERE rank <= {k}"


def cover_steps(k: int) -> str:
    """Farthest-first landmarks of each class, a step for each further one."""
    out = [
        "mean AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM s) GROUP BY label, i) GROUP BY label)",
        "c1 AS (SELECT label, arg_min(row_id, (power(list_distance(x, m), 2), row_id)) AS row_id FROM s JOIN mean USING (label) GROUP BY label)",
        "n1 AS (SELECT s.label, s.row_id, s.x, power(list_distance(s.x, q.x), 2) AS near FROM s JOIN c1 ON s.label = c1.label JOIN s q ON q.row_id = c1.row_id)",
    ]
    for i in range(2, k + 1):
        out += [
            f"c{i} AS (SELECT label, arg_min(row_id, (-near, row_id)) AS row_id FROM n{i - 1} GROUP BY label)",
            f"n{i} AS (SELECT n.label, n.row_id, n.x, least(near, power(list_distance(n.x, q.x), 2)) AS near FROM n{i - 1} n JOIN c{i} c ON n.label = c.label JOIN s q ON q.row_id = c.row_id)",
        ]
    return ",\n".join(out)


def cover_sql() -> str:
    every = " UNION ALL ".join(f"SELECT label, row_id, {i} AS l FROM c{i}" for i in range(1, COVER_K + 1))
    return f"""WITH {SAMPLES}, {cover_steps(COVER_K)},
rad AS (SELECT label, sqrt(greatest(quantile_cont(near, {COVER_FRACTION}), 1.1920929e-07)) AS r FROM n{COVER_K} GROUP BY label),
p AS (SELECT row_number() OVER (ORDER BY e.label, l) - 1 AS pid, e.label AS class, s.x AS c, NULL AS first_ord, r * r AS r2, r FROM ({every}) e JOIN s ON s.row_id = e.row_id JOIN rad ON rad.label = e.label)"""


def greedy_sql() -> str:
    """A cover of a given radius as a recursion: all classes add a landmark a step until half of their rows are covered."""
    return f"""WITH RECURSIVE {SAMPLES},
mean AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM s) GROUP BY label, i) GROUP BY label),
c1 AS (SELECT label, arg_min(row_id, (power(list_distance(x, m), 2), row_id)) AS row_id FROM s JOIN mean USING (label) GROUP BY label),
g AS (
  SELECT s.label, s.row_id, s.x, 1 AS k, power(list_distance(s.x, q.x), 2) AS near FROM s JOIN c1 ON s.label = c1.label JOIN s q ON q.row_id = c1.row_id
  UNION ALL
  SELECT g.label, g.row_id, g.x, k + 1, least(near, power(list_distance(g.x, f.fx), 2)) FROM g JOIN (
    SELECT label, arg_min(x, (-near, row_id)) AS fx, avg((near <= {RADIUS * RADIUS!r})::INT) AS cov, count(*) AS n, max(k) AS mk FROM g GROUP BY label) f
    ON f.label = g.label WHERE f.cov < 0.5 AND f.mk < f.n
), st AS (SELECT label, k, avg((near <= {RADIUS * RADIUS!r})::INT) AS cov, count(*) AS n FROM g GROUP BY label, k)
SELECT label AS class, max(n)::INT AS n_samples, max(k)::BIGINT AS n_balls, {RADIUS!r} AS radius, round(arg_max(cov, k), 6) AS covered_fraction, false AS stopped_by_max_balls, 'euclidean' AS metric FROM st GROUP BY label"""


ORDERS = "o AS (SELECT o_orderkey AS row_id, o_totalprice AS a, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS b, o_orderstatus AS label FROM orders)"
SCALED = "sx AS (SELECT row_id, label, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS b FROM o)"


def lloyd_sql() -> str:
    step = """a{n} AS (SELECT x.label, x.a, x.b, arg_min(p.pid, (power(x.a - p.a, 2) + power(x.b - p.b, 2), p.pid)) AS pid FROM sx x JOIN p{m} p ON p.label = x.label GROUP BY x.row_id, x.label, x.a, x.b),
u{n} AS (SELECT pid, avg(a) AS a, avg(b) AS b FROM a{n} GROUP BY pid),
p{n} AS (SELECT p.pid, p.label, coalesce(u.a, p.a) AS a, coalesce(u.b, p.b) AS b FROM p{m} p LEFT JOIN u{n} u USING (pid))"""
    return f"""WITH {ORDERS}, {SCALED},
l AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS l FROM sx),
p0 AS (SELECT row_number() OVER (ORDER BY label, l) - 1 AS pid, label, a, b FROM l WHERE l <= 3),
{step.format(n=1, m=0)}, {step.format(n=2, m=1)}
SELECT pid, label AS class, round(a, 5) AS c0, round(b, 5) AS c1 FROM p2"""


DOC_LABELS = r"""d AS (SELECT d.doc_id AS row_id, [round(ln(d.n_chars + 1), 9), round(ln(length(regexp_replace(d.text, '[^\n]', '', 'g')) + 1), 9)] AS x,
  list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, 'lang_' || lang], lambda v: v IS NOT NULL) AS labels FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
e AS (SELECT row_id, x, labels, unnest(labels) AS label FROM d)"""
MULTI = f"""WITH {DOC_LABELS},
su AS (SELECT label, count(*) AS support, min(row_id) AS first_ord FROM e GROUP BY label),
p0 AS (SELECT label AS class, x AS c, row_number() OVER (PARTITION BY label ORDER BY row_id) AS l FROM e),
p AS (SELECT row_number() OVER (ORDER BY class, l) - 1 AS pid, class, c FROM p0 WHERE l <= 6),
rk AS (SELECT d.row_id, d.labels, p.class, -power(list_distance(d.x, p.c), 2) AS score, row_number() OVER (PARTITION BY d.row_id, p.class ORDER BY list_distance(d.x, p.c)) AS k FROM d, p),
t AS (SELECT row_id, any_value(labels) AS labels, class, max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 2 THEN score END) AS s2 FROM rk WHERE k <= 2 GROUP BY row_id, class),
pw AS (SELECT o.class AS y, b.class AS b, count_if(o.s2 IS NULL OR b.s1 > o.s2) AS adj, count(*) AS cardinality FROM t o JOIN t b ON o.row_id = b.row_id
  WHERE list_contains(o.labels, o.class) AND NOT list_contains(o.labels, b.class) GROUP BY 1, 2),
si AS (SELECT label AS y, support, coalesce((SELECT min(1 - adj / cardinality) FROM pw WHERE pw.y = su.label), 1.0) AS singleton_index FROM su)"""

TOP_M = f"""{MULTI}, dist AS (SELECT a.class AS y, q.class AS b, min(list_distance(a.c, q.c)) AS distance FROM p a JOIN p q ON a.class <> q.class GROUP BY 1, 2),
ix AS (SELECT label, row_number() OVER (ORDER BY first_ord, label) AS idx FROM su),
rv AS (SELECT y, b, distance, row_number() OVER (PARTITION BY y ORDER BY distance, idx) AS rank FROM dist JOIN ix ON ix.label = dist.b)
SELECT y, b, rank, round(distance, 6) AS distance, adj::BIGINT AS adj, cardinality, round(1 - adj / cardinality, 6) AS pairwise_index FROM rv JOIN pw USING (y, b) WHERE rank <= 2"""

REPLAY = """vt AS (SELECT row_id, any_value(label) AS label, class, max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 2 THEN score END) AS s2 FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id, class ORDER BY score DESC, pid) AS k FROM sc WHERE first_ord <= row_id) WHERE k <= 2 GROUP BY row_id, class),
cl AS (SELECT DISTINCT class AS b FROM p),
pw AS (SELECT s.label AS y, cl.b, count_if(q.s1 IS NOT NULL AND (o.s2 IS NULL OR q.s1 > o.s2)) AS adj, count(*) AS cardinality FROM s JOIN cl ON cl.b <> s.label
  LEFT JOIN vt o ON o.row_id = s.row_id AND o.class = s.label LEFT JOIN vt q ON q.row_id = s.row_id AND q.class = cl.b GROUP BY 1, 2)"""


def drawn_sql(seed: int = 7) -> str:
    """u: the numbers of proto.drawn()."""
    return f"u AS (SELECT *, ('0x' || substr(md5('{seed}-0-' || row_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM s)"


def rounds_sql(running: bool = False) -> str:
    """Starts by least u, then rounds of nearest centre and mean (running: the mean of all samples given in all rounds)."""
    out = [f"WITH {SAMPLES}, {drawn_sql()}", f"q0 AS (SELECT label AS class, x AS c, row_number() OVER (PARTITION BY label ORDER BY u, row_id) AS l, 0::BIGINT AS seen FROM u QUALIFY l <= {ROUND_K})"]
    for i in range(1, ROUNDS + 1):
        out += [
            f"a{i} AS (SELECT s.label AS class, s.x, arg_min(l, (power(list_distance(s.x, c), 2), l)) AS l FROM s JOIN q{i - 1} q ON q.class = s.label GROUP BY s.row_id, s.label, s.x)",
            f"m{i} AS (SELECT class, l, list(m ORDER BY i) AS m, any_value(n) AS n FROM (SELECT class, l, i, sum(v) AS m, count(*) AS n FROM (SELECT class, l, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY class, l, i) GROUP BY class, l)",
        ]
        if running:
            new = "CASE WHEN m IS NULL THEN c ELSE list_transform(list_zip(c, m), lambda z: z[1] + (z[2] - n * z[1]) / (seen + n)) END"
        else:
            new = "CASE WHEN m IS NULL THEN c ELSE list_transform(m, lambda z: z / n) END"
        out.append(f"q{i} AS (SELECT q.class, q.l, {new} AS c, seen + coalesce(n, 0) AS seen FROM q{i - 1} q LEFT JOIN m{i} m ON m.class = q.class AND m.l = q.l)")
    out.append(f"p AS (SELECT row_number() OVER (ORDER BY class, l) - 1 AS pid, class, c, NULL AS first_ord, NULL::DOUBLE AS r2 FROM q{ROUNDS})")
    return ",\n".join(out)


def plus_plus_steps(k: int) -> list[str]:
    """CTEs z1 .. zk(label, row_id), the starts of k-means++: each further one wins a race whose times are exponential with the squared distance as rate."""
    out = ["z1 AS (SELECT label, arg_min(row_id, (u, row_id)) AS row_id FROM u GROUP BY label)", "n1 AS (SELECT u.label, u.row_id, u.x, u.u, power(list_distance(u.x, q.x), 2) AS near FROM u JOIN z1 ON z1.label = u.label JOIN u q ON q.row_id = z1.row_id)"]
    for i in range(2, k + 1):
        turn = f"((u + {i - 1} * {proto.TURN!r}::DOUBLE) % 1.0)"
        out += [
            f"z{i} AS (SELECT label, arg_min(row_id, (CASE WHEN near > 0 THEN -ln({turn}) / near ELSE 1e300 * (1 + {turn}) END, row_id)) AS row_id FROM n{i - 1} GROUP BY label)",
            f"n{i} AS MATERIALIZED (SELECT n.label, n.row_id, n.x, n.u, least(near, power(list_distance(n.x, q.x), 2)) AS near FROM n{i - 1} n JOIN z{i} z ON z.label = n.label JOIN s q ON q.row_id = z.row_id)",
        ]
    return out


def plus_plus_sql() -> str:
    every = " UNION ALL ".join(f"SELECT label, row_id, {i} AS l FROM z{i}" for i in range(1, ROUND_K + 1))
    return ",\n".join([f"WITH {SAMPLES}, {drawn_sql()}", *plus_plus_steps(ROUND_K)]) + f" SELECT row_number() OVER (ORDER BY label, l) - 1 AS pid, label AS class, row_id FROM ({every})"


def converged_sql(running: bool, width: int = 64, k: int = DEFAULT_K, samples: str = SAMPLES) -> str:
    """CTEs up to p: prototypes of the default models, fitted until they stand still. The recursion's state is a class's list of centres; running: mini-batches that hold all rows of a class, as here, and means of all samples ever given; else k-means++ and Lloyd's algorithm."""
    if running:
        start = [f"q AS (SELECT label AS class, x AS c, row_number() OVER (PARTITION BY label ORDER BY u, row_id) AS l FROM u QUALIFY l <= {k})"]
        go_on = f"moved >= {proto.STILL!r} AND t < 100"
        new = "{'l': e.l, 'c': list_transform(list_zip(e.c, m.s), lambda z: z[1] + (z[2] - m.n * z[1]) / (e.seen + m.n)), 'seen': e.seen + m.n}"
    else:
        every = " UNION ALL ".join(f"SELECT label, row_id, {i} AS l FROM z{i}" for i in range(1, k + 1))
        start = [*plus_plus_steps(k), f"q AS (SELECT e.label AS class, s.x AS c, l FROM ({every}) e JOIN s ON s.row_id = e.row_id JOIN (SELECT label, count(*) AS n FROM s GROUP BY label) n ON n.label = e.label WHERE l <= n)"]
        go_on = "moved > tol AND t < 300"
        new = "{'l': e.l, 'c': list_transform(m.s, lambda z: z / m.n), 'seen': 0}"
    sums = ", ".join(f"sum(x[{i}])" for i in range(1, width + 1))
    spread = " + ".join(f"var_pop(x[{i}])" for i in range(1, width + 1))
    return ",\n".join([f"WITH RECURSIVE {samples}, {drawn_sql(0)}", *start, f"tl AS (SELECT label, 1e-4::DOUBLE * ({spread}) / {width} AS tol FROM s GROUP BY label)",
        f"""km AS (SELECT class, 0 AS t, list({{'l': l, 'c': c, 'seen': 0::BIGINT}} ORDER BY l) AS cs, 1e300::DOUBLE AS moved FROM q GROUP BY class
UNION ALL SELECT class, t + 1, cs, list_sum(list_transform(cs, lambda e: power(list_distance(e.c, old[e.l].c), 2))) FROM (
SELECT class, t, old, list_transform(old, lambda e: coalesce(list_transform(list_filter(ms, lambda m: m.l = e.l), lambda m: {new})[1], e)) AS cs FROM (
SELECT class, t, any_value(cs) AS old, list({{'l': own, 's': sums, 'n': n}}) AS ms FROM (
SELECT class, t, own, any_value(cs) AS cs, [{sums}] AS sums, count(*) AS n FROM (
SELECT class, t, cs, s.x, list_sort(list_transform(cs, lambda e: {{'d': power(list_distance(s.x, e.c), 2), 'l': e.l}}))[1].l AS own FROM km JOIN s ON s.label = km.class JOIN tl ON tl.label = km.class WHERE {go_on}
) GROUP BY class, t, own) GROUP BY class, t)))""",
        "p AS (SELECT row_number() OVER (ORDER BY class, e.l) - 1 AS pid, class, e.c AS c, NULL AS first_ord, NULL::DOUBLE AS r2 FROM (SELECT class, unnest(cs) AS e FROM km QUALIFY t = max(t) OVER (PARTITION BY class)))"])


def parallel_sql() -> str:
    """Starts of k-means||: rounds that draw every row by itself, then k-means++ among the drawn rows, weighted by the rows nearest to them."""
    turn = lambda t: f"((u + {t} * {proto.TURN!r}::DOUBLE) % 1.0)"
    out = [f"WITH {SAMPLES}, {drawn_sql()}", "c0 AS (SELECT label, arg_min(row_id, (u, row_id)) AS row_id, 0 AS t FROM u GROUP BY label)",
           "n0 AS (SELECT u.label, u.row_id, u.x, u.u, power(list_distance(u.x, q.x), 2) AS near FROM u JOIN c0 ON c0.label = u.label JOIN u q ON q.row_id = c0.row_id)"]
    for t in range(1, proto.DRAWS + 1):
        out += [
            f"c{t} AS MATERIALIZED (SELECT n.label, n.row_id, {t} AS t FROM n{t - 1} n JOIN (SELECT label, sum(near) AS total FROM n{t - 1} GROUP BY label) USING (label) WHERE near > 0 AND {turn(t)} * total < {proto.OVERSAMPLED * ROUND_K} * near)",
            f"n{t} AS MATERIALIZED (SELECT n.label, n.row_id, any_value(n.x) AS x, any_value(n.u) AS u, least(any_value(near), coalesce(min(power(list_distance(n.x, q.x), 2)), any_value(near))) AS near FROM n{t - 1} n LEFT JOIN (c{t} c JOIN s q ON q.row_id = c.row_id) ON c.label = n.label GROUP BY n.label, n.row_id)",
        ]
    cs = " UNION ALL ".join(f"SELECT * FROM c{t}" for t in range(proto.DRAWS + 1))
    out += [
        f"ca AS MATERIALIZED (SELECT c.label, c.row_id, c.t, u.x, u.u FROM ({cs}) c JOIN u ON u.row_id = c.row_id)",
        "ow AS (SELECT u.row_id, arg_min(c.row_id, (power(list_distance(u.x, c.x), 2), c.t, c.row_id)) AS own FROM u JOIN ca c ON c.label = u.label GROUP BY u.row_id)",
        "m0 AS (SELECT ca.*, w, 1.0::DOUBLE AS near FROM ca JOIN (SELECT own, count(*) AS w FROM ow GROUP BY own) o ON o.own = ca.row_id)",
    ]
    for i in range(1, ROUND_K + 1):
        key = f"(CASE WHEN near > 0 THEN -ln({turn(proto.DRAWS + i)}) / (near * w) ELSE 1e300 * (1 + {turn(proto.DRAWS + i)}) END, t, row_id)"
        near = "power(list_distance(m.x, q.x), 2)" if i == 1 else "least(near, power(list_distance(m.x, q.x), 2))"
        out += [f"z{i} AS (SELECT label, arg_min(row_id, {key}) AS row_id FROM m{i - 1} GROUP BY label)", f"m{i} AS (SELECT m.* EXCLUDE near, {near} AS near FROM m{i - 1} m JOIN z{i} z ON z.label = m.label JOIN s q ON q.row_id = z.row_id)"]
    every = " UNION ALL ".join(f"SELECT label AS class, {i - 1}::BIGINT AS place, row_id FROM z{i}" for i in range(1, ROUND_K + 1))
    return ",\n".join(out) + f" {every}"


CENTER_OUT = "SELECT pid, class, round(c[1], 6) AS c0, round(c[2], 6) AS c1, round(c[64], 6) AS c63 FROM p"


def fixed_cover_sql() -> tuple[str, str]:
    """Covers of COVER_K balls of one radius; and with numbers and radii by class."""
    near = " UNION ALL ".join(f"SELECT label, row_id, near, {i} AS k FROM n{i}" for i in range(1, COVER_K + 1))
    base = f"WITH {SAMPLES}, {cover_steps(COVER_K)}, every AS ({near})"
    one = f"{base} SELECT label AS class, 'fixed_k_fixed_radius' AS mode, {COVER_K}::BIGINT AS n_balls, {RADIUS!r}::DOUBLE AS radius, round(avg((near <= {RADIUS * RADIUS!r})::INT), 6) AS covered_fraction, round(avg(sqrt(near)), 6) AS mean_nearest_distance FROM every WHERE k = {COVER_K} GROUP BY label"
    r = "(0.9::DOUBLE + 0.05::DOUBLE * label::INT)"
    by = f"{base} SELECT label AS class, k::BIGINT AS n_balls, round({r}, 6) AS radius, round(avg((near <= {r} * {r})::INT), 6) AS covered_fraction, round(max(sqrt(near)), 6) AS max_nearest_distance FROM every WHERE k = 1 + label::INT % {COVER_K} GROUP BY label, k"
    return one, by


def accumulate_sql() -> str:
    def part(cond: str, i: int) -> str:
        body = marks_sql(4) + ",\n" + PAIRS + ", su AS (SELECT label, count(*) AS support FROM s GROUP BY label) SELECT y, b, adj, support FROM pw JOIN su ON su.label = pw.y"
        return f"b{i} AS (" + body.replace("FROM embeddings", f"FROM embeddings WHERE {cond}") + ")"

    return f"""WITH {part("label <= 5", 1)}, {part("label >= 4", 2)}, w AS (SELECT label::VARCHAR AS label, count(*) * (CASE WHEN label BETWEEN 4 AND 5 THEN 2 ELSE 1 END) AS support FROM embeddings GROUP BY embeddings.label),
i2 AS (SELECT c.y, min(1 - (c.adj + coalesce(o.adj, 0)) / w.support) AS v FROM b2 c LEFT JOIN b1 o ON o.y = c.y AND o.b = c.b JOIN w ON w.label = c.y GROUP BY c.y),
i1 AS (SELECT y, min(1 - adj / support) AS v FROM b1 GROUP BY y)
SELECT w.label AS y, w.support, round(coalesce(i2.v, i1.v), 6) AS singleton_index FROM w LEFT JOIN i2 ON i2.y = w.label LEFT JOIN i1 ON i1.y = w.label"""


def _two_batches() -> str:
    def part(i: int) -> str:
        body = marks_sql(4) + ",\n" + PAIRS + " SELECT y, b, adj, cardinality FROM pw"
        return "(" + body.replace("FROM embeddings", f"FROM embeddings WHERE vec_id % 2 = {i}") + ")"

    return f"SELECT y, b, sum(adj)::BIGINT AS adj, sum(cardinality)::BIGINT AS cardinality, round(1 - sum(adj) / sum(cardinality), 6) AS pairwise_index FROM ({part(0)} UNION ALL {part(1)}) GROUP BY y, b"


def sql() -> dict[str, str]:
    m, pairs = marks_sql(), marks_sql() + ",\n" + PAIRS
    single = pairs + ",\n" + SINGLE
    cover = cover_sql()
    fixed, by_class = fixed_cover_sql()
    est = f"{cover}, {SCORES}, {PAIRS}, {SINGLE} {summary_out()}"
    near = f"SELECT label AS class, count(*) AS n_samples, {COVER_K}::BIGINT AS n_balls, round(any_value(r), 6) AS radius, round(avg((near <= r * r)::INT), 6) AS covered_fraction, round(avg(sqrt(near)), 6) AS mean_nearest_distance, round(max(sqrt(near)), 6) AS max_nearest_distance FROM n{COVER_K} JOIN rad USING (label) GROUP BY label"
    return {
        "oi_landmark_summary": f"{single} {summary_out()}",
        "oi_pairwise": f"{pairs} {PAIR_OUT}",
        "oi_singleton": f"{single} {SINGLE_OUT}",
        "oi_support": "SELECT label::VARCHAR AS label, count(*) AS support, min(vec_id) AS first_ord FROM embeddings GROUP BY label",
        "oi_exclude": f"{single} {summary_out('y NOT IN (' + ', '.join(repr(x) for x in EXCLUDED) + ')')}",
        "oi_exclude_all": f"{single} {summary_out('false')}",
        "minmax_scale_orders": f"WITH {ORDERS}, {SCALED} SELECT row_id, round(a, 6) AS x0, round(b, 6) AS x1 FROM sx",
        "minmax_scale_part": "SELECT p_partkey AS row_id, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS x0, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS x1 FROM part",
        "complement_code": "SELECT p_partkey AS row_id, round(p_size / 50.0::DOUBLE, 6) AS x0, round(1 - p_size / 50.0::DOUBLE, 6) AS x1 FROM part",
        "l2_normalize": f"WITH {SAMPLES}, n AS (SELECT row_id, x, greatest(sqrt(list_dot_product(x, x)), 2.220446049250313e-16) AS n FROM s) SELECT row_id, round(x[1] / n, 6) AS x0, round(x[2] / n, 6) AS x1, round(x[64] / n, 6) AS x63 FROM n",
        "validate_features": "SELECT count(*) AS n_rows, min(len(embedding))::INT AS min_size, max(len(embedding))::INT AS max_size, count_if(embedding IS NULL OR len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) > 0)::BIGINT AS non_finite FROM embeddings",
        "indicator_to_labels": "SELECT doc_id AS row_id, array_to_string(list_filter([CASE WHEN quality = 1 THEN '0' END, CASE WHEN toxic = 1 THEN '1' END], lambda v: v IS NOT NULL), ',') AS labels FROM labels",
        "explode_labels": f"WITH {DOC_LABELS} SELECT row_id, label FROM e",
        "labels_dimension": f"WITH {DOC_LABELS} SELECT label, row_number() OVER (ORDER BY min(row_id), label) - 1 AS idx, min(row_id) AS first_ord, count(*) AS support FROM e GROUP BY label",
        "class_bmu": f"{m} SELECT row_id, label, p1 AS pid, round(s1, 6) + 0.0 AS score FROM t WHERE class = label",
        "predict_bmu": f"{m} {topk_sql(1, score='').replace('row_id, rank, pid', 'row_id, pid')}",
        "scores_all": f"{marks_sql(2)} SELECT row_id, pid, class, round(score, 6) + 0.0 AS score FROM sc",
        "topk_prototypes": f"{m} {topk_sql(3)}",
        "topk_candidates": m + " " + topk_sql(3, "class IN ('1', '2')"),
        "top2_bmu": f"{m}, k AS ({topk_sql(2)}) SELECT row_id, max(CASE WHEN rank = 1 THEN pid END) AS b1, max(CASE WHEN rank = 2 THEN pid END) AS b2 FROM k GROUP BY row_id",
        "top2_vs_each_class": f"{m} SELECT row_id, class, round(s1, 6) + 0.0 AS s1, p1, round(s2, 6) + 0.0 AS s2, p2 FROM t",
        "top2_class_pair": m + " " + topk_sql(2, "class IN ('0', '1')", ""),
        "ballcover_fixed_k": f"{cover} SELECT pid, class, round(c[1], 6) AS c0, round(c[2], 6) AS c1, round(r, 6) AS radius FROM p",
        "ball_scores": f"{cover}, {SCORES} {topk_sql(1, score=', round(score, 5) AS score').replace('row_id, rank, pid', 'row_id, pid')}",
        "ballcover_fixed_radius": greedy_sql(),
        "ballcover_membership": f"{cover} SELECT pid, count(*) AS n, min(row_id) AS first_row FROM p JOIN s ON s.label = p.class WHERE power(list_distance(s.x, p.c), 2) <= r2 GROUP BY pid",
        "ballcover_diag": f"{cover} {near}",
        "ballcover_fit_diag": f"SELECT count(*) AS n_samples, count(DISTINCT label) AS n_classes, count(DISTINCT label) * {COVER_K} AS n_balls, any_value(len(embedding)) AS n_features, 'euclidean' AS metric, 128::BIGINT AS high_dim_threshold, false AS stored_memberships FROM embeddings",
        "ballcover_class_diag": f"{cover} SELECT class, 'fixed_k_auto_radius' AS mode, 'euclidean' AS metric, string_agg(pid::VARCHAR, ',' ORDER BY pid) AS ball_ids FROM p GROUP BY class",
        "ballcover_fixed_k_radius": fixed,
        "ballcover_per_class": by_class,
        "kmeans_fixed_rounds": f"{rounds_sql()} {CENTER_OUT}",
        "minibatch_fixed_rounds": f"{rounds_sql(True)} {CENTER_OUT}",
        "kmeans_plus_plus": plus_plus_sql(),
        "oi_kmeans": f"{converged_sql(False)}, {SCORES}, {PAIRS}, {SINGLE} {summary_out()}",
        "oi_minibatch": f"{converged_sql(True)}, {SCORES}, {PAIRS}, {SINGLE} {summary_out()}",
        "kmeans_parallel": parallel_sql(),
        "oi_kmeans_fixed": f"{rounds_sql()}, {SCORES}, {PAIRS}, {SINGLE} {summary_out()}",
        "est_fit": est,
        "est_exclude": f"{cover}, {SCORES}, {PAIRS}, {SINGLE}, k AS ({summary_out('y NOT IN ' + repr(tuple(EXCLUDED)))}) SELECT index, weighted_index, (SELECT count(*) FROM si) AS n_classes FROM k",
        "est_partial_fit": est,
        "est_score": f"{cover}, {SCORES}, {PAIRS}, {SINGLE}, k AS ({summary_out()}) SELECT index AS fitted, index AS current, 1.0::DOUBLE AS after_reset FROM k",
        "est_fit_predict": f"{cover}, {SCORES} {topk_sql(1, score='').replace('row_id, rank, pid', 'row_id, pid')}",
        "est_pipeline": f"{cover}, {SCORES} {topk_sql(1, score='').replace('row_id, rank, pid', 'row_id, pid')}",
        "est_classes": f"{cover} SELECT class, count(*) AS n, min(pid) AS first, max(pid) AS last FROM p GROUP BY class",
        "label_kinds": f"WITH {DOC_LABELS} SELECT 'string' AS kind, 1::BIGINT AS size, count(*) AS n FROM part UNION ALL SELECT 'array', len(labels), count(*) FROM d GROUP BY len(labels)",
        "text_source": "SELECT p_brand AS label, count(*) AS n, sum(p_size)::DOUBLE AS s0, sum(p_partkey)::DOUBLE AS s1 FROM part GROUP BY p_brand",
        "visible_replay_blocks": f"{m}, {REPLAY} {PAIR_OUT}",
        "accumulate_summary": accumulate_sql(),
        "oi_ballcover": f"{cover}, {SCORES}, {PAIRS} {PAIR_OUT}",
        "kmeans_k1_centers": f"WITH {SAMPLES}, v AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM s) GROUP BY label, i) SELECT row_number() OVER (ORDER BY label) - 1 AS pid, label AS class, round(max(CASE WHEN i = 1 THEN m END), 6) AS c0, round(max(CASE WHEN i = 2 THEN m END), 6) AS c1, round(max(CASE WHEN i = 64 THEN m END), 6) AS c63, round(sum(m * m), 6) AS norm2 FROM v GROUP BY label",
        "lloyd_fixed_iter": lloyd_sql(),
        "ml_pair_rows": f"WITH {DOC_LABELS}, c AS (SELECT DISTINCT label AS b FROM e) SELECT e.label AS y, c.b, count(*) AS n FROM e JOIN c ON NOT list_contains(e.labels, c.b) GROUP BY 1, 2",
        "ml_pairwise": f"{MULTI} {PAIR_OUT}",
        "ml_singleton": f"{MULTI} {SINGLE_OUT}",
        "ml_singleton_sparse": f"{MULTI} {SINGLE_OUT}",
        "ml_summary": f"{MULTI} {summary_out()}",
        "ml_top_m": TOP_M,
        "visible_replay": f"{m}, {REPLAY} {PAIR_OUT}",
        "accumulate_two_batches": _two_batches(),
        "degenerate_empty": "SELECT 1.0::DOUBLE AS index, 1.0::DOUBLE AS weighted_index, 0::BIGINT AS n_classes",
        "degenerate_single_class": "SELECT 1.0::DOUBLE AS index, 1.0::DOUBLE AS weighted_index, 1::BIGINT AS n_classes",
    }


def queries() -> dict:
    names = [*sql()]
    return {n: globals()[n] for n in names}


