import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from isthmus import ml
from isthmus.estimators import DiscreteSeparability
from isthmus.operators import scoring
from isthmus.sources import tables


def parts(spark, sf):
    t = tables.read(spark, sf, "part")
    return t.select(F.col("p_partkey").alias("row_id"), (F.col("p_size") / 64).alias("a"), (F.col("p_retailprice") / 3000).alias("b"), F.concat(F.lit("c"), F.col("p_partkey") % 3).alias("label"), "p_name")


@pytest.mark.parametrize("kind", ["KMeans", "MiniBatchKMeans", "BallCover", "Fuzzy", "Hypersphere"])
def test_pipeline_round_trip(spark, sf, tmp_path, kind):
    t = parts(spark, sf)
    stage = ml.Separability(featuresCol="v", modelType=kind, kmeansK=3, rho=0.8, excludeClasses=["c9"], predictionCol="pid")
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v"), stage])
    pipeline.write().save(f"{tmp_path}/pipeline")
    fitted = Pipeline.load(f"{tmp_path}/pipeline").fit(t)
    fitted.write().save(f"{tmp_path}/model")
    read = PipelineModel.load(f"{tmp_path}/model")
    plain = DiscreteSeparability(model_type=kind, kmeans_k=3, rho=0.8, exclude_classes=["c9"])
    s = t.select("row_id", F.array("a", "b").alias("features"), "label")
    want = {r.row_id: r.pid for r in plain.fit(s).predict(s).collect()}
    out = read.transform(t)
    assert out.columns == [*t.columns, "v", "pid", "predictedClass"]
    owner = {r.pid: r["class"] for r in plain.prototypes_.collect()}
    got = {r.row_id: (r.pid, r.predictedClass) for r in out.collect()}
    assert got == {i: (p, owner[p]) for i, p in want.items()}
    model = read.stages[-1]
    assert (model.index, model.weightedIndex) == (plain.index, plain.weighted_index) and model.uid == fitted.stages[-1].uid
    assert sorted(map(tuple, model.singleton.collect())) == sorted(map(tuple, plain.singleton_.collect())) and model.getOrDefault("excludeClasses") == ["c9"]


def test_several_blocks_and_labels_as_arrays(spark, sf, monkeypatch):
    t = parts(spark, sf).withColumn("features", F.array("a", "b"))
    whole = ml.Separability(modelType="KMeans", kmeansK=4).fit(t)
    want = sorted((r.row_id, r.prediction) for r in whole.transform(t).collect())
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 1)
    again = ml.saved(whole, spark)
    assert len(scoring.held(again.prototypes)) > 1 and sorted((r.row_id, r.prediction) for r in again.transform(t).collect()) == want
    many = t.withColumn("label", F.when(F.col("row_id") % 2 == 0, F.array("label", F.lit("even"))).otherwise(F.array("label")))
    assert 0 <= ml.Separability(modelType="KMeans", kmeansK=2, topM=2, multilabelPairMode="top_m").fit(many).index <= 1


def test_parameter_maps(spark, sf):
    t = parts(spark, sf).withColumn("features", F.array("a", "b"))
    stage = ml.Separability(modelType="KMeans")
    two, five = stage.fit(t, [{stage.kmeansK: 2}, {stage.kmeansK: 5}])
    assert two.prototypes.count() == 6 and five.prototypes.count() == 15 and two.transform(t.limit(0)).count() == 0
