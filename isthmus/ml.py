"""The discrete index as an Estimator and a Model of pyspark.ml: they stand in pipelines, are tuned by parameter maps, saved and read.

    Pipeline(stages=[VectorAssembler(...), Separability(modelType="KMeans", labelCol="class")]).fit(df).write().save(path)
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isthmus.estimators import DiscreteSeparability
from isthmus.functions.session import shared_root
from isthmus.operators import scoring
from isthmus.operators.art import choices

#: Parameters handed to the index as they are, by their names here and there.
PASSED = {
    "modelType": "model_type", "rho": "rho", "rHat": "r_hat", "matchTracking": "match_tracking", "kmeansK": "kmeans_k", "kmeansKwargs": "kmeans_kwargs", "ballcoverK": "ballcover_k", "ballcoverRadius": "ballcover_radius",
    "ballcoverKwargs": "ballcover_kwargs", "multilabelPairMode": "multilabel_pair_mode", "topM": "top_m", "excludeClasses": "exclude_classes",
}


class _Shared(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """featuresCol may hold arrays or vectors; labelCol a label, or an array of labels."""

    modelType = Param(Params._dummy(), "modelType", "online model or backend", TypeConverters.toString)
    rho = Param(Params._dummy(), "rho", "vigilance of online models", TypeConverters.toFloat)
    rHat = Param(Params._dummy(), "rHat", "largest radius of hypersphere categories; 0 for none", TypeConverters.toFloat)
    matchTracking = Param(Params._dummy(), "matchTracking", "match tracking of online models", TypeConverters.toString)
    kmeansK = Param(Params._dummy(), "kmeansK", "centres a class, or a mapping by class")
    kmeansKwargs = Param(Params._dummy(), "kmeansKwargs", "keywords of k-means")
    ballcoverK = Param(Params._dummy(), "ballcoverK", "balls a class, auto, or a mapping by class")
    ballcoverRadius = Param(Params._dummy(), "ballcoverRadius", "radius of balls, auto, or a mapping by class")
    ballcoverKwargs = Param(Params._dummy(), "ballcoverKwargs", "keywords of ball covers")
    multilabelPairMode = Param(Params._dummy(), "multilabelPairMode", "all or top_m", TypeConverters.toString)
    topM = Param(Params._dummy(), "topM", "competitors a class with top_m")
    excludeClasses = Param(Params._dummy(), "excludeClasses", "classes left out of the summary")
    idCol = Param(Params._dummy(), "idCol", "a number that tells rows apart; draws depend on it", TypeConverters.toString)
    orderCol = Param(Params._dummy(), "orderCol", "order of rows for online models; idCol if not set", TypeConverters.toString)
    classCol = Param(Params._dummy(), "classCol", "class that owns the predicted prototype", TypeConverters.toString)

    def _features(self, df: DataFrame):
        """The features as an array."""
        name = self.getOrDefault("featuresCol")
        if dict(df.dtypes)[name] == "vector":
            from pyspark.ml.functions import vector_to_array

            return vector_to_array(F.col(name))
        return F.col(name).cast("array<double>")

    def index_model(self) -> DiscreteSeparability:
        """An index with this stage's parameters."""
        given = {there: self.getOrDefault(here) for here, there in PASSED.items() if self.isDefined(here)}
        if not given.get("r_hat"):
            given["r_hat"] = math.inf
        return DiscreteSeparability(**given)


class Separability(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Fits prototypes and indices; see DiscreteSeparability for what the parameters mean."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", idCol="row_id", orderCol=None, classCol="predictedClass", modelType="MiniBatchKMeans", rho=0.9, rHat=0.0, matchTracking="MT+", kmeansK=8, kmeansKwargs=None, ballcoverK="auto", ballcoverRadius=0.25, ballcoverKwargs=None, multilabelPairMode="all", topM=None, excludeClasses=None):  # noqa: N803
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", idCol="row_id", classCol="predictedClass", modelType="MiniBatchKMeans", rho=0.9, rHat=0.0, matchTracking="MT+", kmeansK=8, ballcoverK="auto", ballcoverRadius=0.25, multilabelPairMode="all")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @keyword_only
    def setParams(self, **_):  # noqa: N802
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SeparabilityModel:
        order = F.col(self.getOrDefault("orderCol") if self.isSet("orderCol") else self.getOrDefault("idCol")).cast("long")
        samples = dataset.select(F.col(self.getOrDefault("idCol")).cast("long").alias("row_id"), order.alias("ord"), self._features(dataset).alias("features"), F.col(self.getOrDefault("labelCol")).alias("label"))
        m = self.index_model().fit(samples)
        model = SeparabilityModel(m.prototypes_, m.pairwise_, m.singleton_, {"index": m.index, "weighted_index": m.weighted_index, "metric": getattr(m, "resolved_metric_", None)})
        model.fitted_ = m  # keeps what the tables rest on
        return self._copyValues(model)


class SeparabilityModel(Model, _Shared, MLReadable, MLWritable):
    """prototypes, pairwise, singleton (DataFrames), index and weightedIndex of a fit. transform adds the best prototype of each row and the class that owns it.

    A row's features are scored block by block of the prototypes, each block in a step of its own, so that a worker holds one.
    """

    def __init__(self, prototypes: DataFrame | None = None, pairwise: DataFrame | None = None, singleton: DataFrame | None = None, facts: dict | None = None):
        super().__init__()
        self.prototypes, self.pairwise, self.singleton, self.facts = prototypes, pairwise, singleton, facts or {}

    @property
    def index(self) -> float:
        return self.facts["index"]

    @property
    def weightedIndex(self) -> float:  # noqa: N802
        return self.facts["weighted_index"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        online = self.getOrDefault("modelType") in ("Fuzzy", "Hypersphere")
        x = self._features(dataset)
        if online:
            x = F.concat(x, F.transform(x, lambda v: F.lit(1.0) - v))
        elif self.facts.get("metric") == "cosine":
            from isthmus.functions.vectors import l2_normalized

            x = l2_normalized(x)
        pid, name, work, best = self.getOrDefault("predictionCol"), self.getOrDefault("classCol"), "__features", "__score"
        kind, full = self.getOrDefault("modelType"), self.getOrDefault("rHat") or None
        rows = dataset.withColumns({work: x, best: F.lit(float("-inf")), pid: F.lit(None).cast("int"), name: F.lit(None).cast("string")})
        place = {c: rows.columns.index(c) for c in (work, best, pid, name)}

        def scored(held):
            def run(batches: Iterator) -> Iterator:
                import numpy as np
                import pyarrow as pa

                block = held.value
                for b in batches:
                    if not b.num_rows:
                        continue
                    m = scoring.matrix(b.column(place[work]))
                    if online:
                        radius = np.sqrt(block.radius2) if block.radius2 is not None else np.zeros(len(block.pid))
                        s = choices(kind, block.center, radius, 1e-10, full or math.sqrt(m.shape[1]) / 2, m)
                    else:
                        s = block.scores(m)
                    lead = np.lexsort((np.broadcast_to(block.pid, s.shape), -s), axis=1)[:, 0]
                    score, own = s[np.arange(len(s)), lead], block.pid[lead].astype(np.int32)
                    before, old = b.column(place[best]).to_numpy(), b.column(place[pid]).to_numpy(zero_copy_only=False)
                    better = (score > before) | (score == before) & (own < old)
                    names = np.array(block.classes, dtype=object)[block.of[lead]]
                    names = np.where(better, names, np.array(b.column(place[name]).to_pylist(), dtype=object))
                    columns = list(b.columns)
                    columns[place[best]] = pa.array(np.maximum(score, before))
                    columns[place[pid]] = pa.array(np.where(better, own, old).astype(np.int32))
                    columns[place[name]] = pa.array(names.tolist(), pa.string())
                    yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

            return run

        if not hasattr(self, "_held"):
            self._held = scoring.held(self.prototypes)
        for block in self._held.blocks:
            rows = rows.mapInArrow(scored(block), rows.schema)
        return rows.drop(work, best)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


_TABLES = ("prototypes", "pairwise", "singleton")


class _Writer(MLWriter):
    def __init__(self, model: SeparabilityModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"facts": json.dumps(self.model.facts)})
        for name in _TABLES:
            getattr(self.model, name).write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> SeparabilityModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(*(self.sparkSession.read.parquet(f"{path}/{name}") for name in _TABLES), json.loads(metadata["facts"]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def saved(model, spark: SparkSession):
    """A fitted stage or pipeline after a round trip through the shared folder."""
    import uuid

    path = f"{shared_root(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return type(model).load(path)
