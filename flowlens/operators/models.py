"""Classifiers behind one interface: fit(df, features, code, k, ...) gives a Model whose transform()
adds proba, array<double> in class-code order, 0 for classes absent when it was fitted."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml import classification as ml
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.local import local_table
from flowlens.functions.portable import key_hash
from flowlens.operators.trees import Ensemble, extra_trees, softmax_boosting
from flowlens.sources.stage import moved


def expanded(proba: Column, codes: Sequence[int], k: int) -> Column:
    """Probabilities of the classes `codes` as an array over all k classes."""
    at = {c: i for i, c in enumerate(codes)}
    return F.array(*(F.coalesce(F.get(proba, F.lit(at[c])), F.lit(0.0)) if c in at else F.lit(0.0) for c in range(k)))


@dataclass
class Model:
    """run adds proba to a table that has the features."""

    features: list[str]
    k: int
    run: Callable[[DataFrame], DataFrame]
    importance: list[float] | None = None
    stages: PipelineModel | None = None
    grown: Ensemble | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return self.run(df)

    def importances(self, spark) -> DataFrame:
        """(feature, importance), summing to 1; empty if the model has none."""
        total = sum(self.importance or []) or 1.0
        rows = [(f, w / total) for f, w in zip(self.features, self.importance or [], strict=False)]
        return local_table(spark, rows, "feature string, importance double")


#: Terms of all distances up to which centroids are scored in plain columns; beyond, in arrays.
PLAIN = 128


@dataclass(frozen=True)
class Centroids:
    """Nearest centroid with a softmax over negative distances; plain expressions, so SQL can repeat it."""

    features: list[str]
    means: dict[int, list[float]]
    k: int

    def transform(self, df: DataFrame) -> DataFrame:
        return self._plain(df) if self.k * len(self.features) <= PLAIN else self._arrays(df)

    def _plain(self, df: DataFrame) -> DataFrame:
        """A column a class: functions over arrays are interpreted, which took most of the time."""
        out = df.withColumns({f"_x{i}": F.col(f).cast("double") for i, f in enumerate(self.features)})
        square = lambda i, v: (F.col(f"_x{i}") - F.lit(v)) * (F.col(f"_x{i}") - F.lit(v))
        far = lambda m: F.sqrt(sum((square(i, v) for i, v in enumerate(m)), F.lit(0.0)))
        d, w = ([f"_{kind}{c}" for c in range(self.k)] for kind in "dw")
        out = out.withColumns({n: far(self.means[c]) if c in self.means else F.lit(float("inf")) for c, n in enumerate(d)})
        out = out.withColumn("_least", F.least(*d) if self.k > 1 else F.col(d[0]))
        out = out.withColumns({n: F.exp(F.col("_least") - F.col(x)) for n, x in zip(w, d, strict=True)})
        out = out.withColumn("_t", sum((F.col(n) for n in w), F.lit(0.0)))
        return out.withColumn("proba", F.array(*(F.col(n) / F.col("_t") for n in w))).drop(*(f"_x{i}" for i in range(len(self.features))), *d, *w, "_least", "_t")

    def _arrays(self, df: DataFrame) -> DataFrame:
        far = F.lit(float("inf"))
        out = df.withColumn("_x", F.array(*(F.col(f).cast("double") for f in self.features)))
        squares = lambda m: F.aggregate(F.zip_with("_x", F.array(*(F.lit(v) for v in m)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v)
        out = out.withColumn("_d", F.array(*(F.sqrt(squares(self.means[c])) if c in self.means else far for c in range(self.k))))
        weight = F.transform("_d", lambda d: F.exp(F.array_min("_d") - d))
        out = out.withColumn("_w", weight)
        total = F.aggregate("_w", F.lit(0.0), lambda a, w: a + w)
        return out.withColumn("_t", total).withColumn("proba", F.transform("_w", lambda w: w / F.col("_t"))).drop("_x", "_d", "_w", "_t")


def fit_centroids(df: DataFrame, features: Sequence[str], code: str, k: int) -> Centroids:
    rows = df.where(F.col(code).isNotNull()).groupBy(code).agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(features))).collect()
    return Centroids(list(features), {r[code]: [float(r[f"m{i}"]) for i in range(len(features))] for r in rows}, k)


def _estimator(kind: str, params: dict, weight: str | None, k: int, width: int):
    shared = {"featuresCol": "_x", "labelCol": "_y", **({"weightCol": weight} if weight else {})}
    if kind == "logistic":
        return ml.LogisticRegression(**shared, **{"maxIter": 50, "regParam": 1e-4, "family": "multinomial", **params})
    if kind == "bayes":
        return ml.NaiveBayes(**shared, **{"modelType": "gaussian", **params})
    if kind == "tree":
        return ml.DecisionTreeClassifier(**shared, **{"maxDepth": 18, "minInstancesPerNode": 2, **params})
    if kind == "forest":
        return ml.RandomForestClassifier(**shared, **{"numTrees": 300, "maxDepth": 14, "featureSubsetStrategy": "sqrt", "seed": 7, **params})
    if kind == "mlp":  # takes no weights
        layers = [width, *params.pop("hidden", [128, 64]), k]
        return ml.MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", layers=layers, **{"maxIter": 100, "seed": 7, **params})
    raise ValueError(f"unknown model {kind}")


#: Rows of a partition of Spark ML's trees, about: they keep their rows in memory, some 200 bytes each.
FIT_ROWS = 500_000


def dealt(rows: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """rows in partitions of some `most`, however their files are cut; few rows stay as they are."""
    n = -(-rows.count() // most)
    return rows if n <= 1 else rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism))


KINDS = ("logistic", "bayes", "tree", "forest", "extra", "mlp", "boosted")


def fit(kind: str, df: DataFrame, features: Sequence[str], code: str, k: int, weight: str | None = None, held: str | None = None, **params) -> Model:
    """Fits a classifier: of Spark ML, or for `extra` and `boosted` of trees.py. held: a boolean column of
    validation rows for early stopping of `boosted`; other kinds leave them out."""
    features = list(features)
    if kind in ("extra", "boosted"):
        named = {"numTrees": "trees", "maxDepth": "depth", "maxIter": "rounds", "stepSize": "rate", "maxBins": "bins", "minInstancesPerNode": "least"}
        own = {named.get(p, p): v for p, v in params.items()}
        if kind == "boosted":
            grown = softmax_boosting(df, features, code, k, weight, held, **own)
        else:
            grown = extra_trees(df.where(~F.coalesce(F.col(held), F.lit(False))) if held else df, features, code, k, weight, **{"trees": 300, **own})
        return Model(features, k, grown.transform, grown.importance(), grown=grown)
    rows = df.where(F.col(code).isNotNull()).withColumn("_y", F.col(code).cast("double"))
    assembler = VectorAssembler(inputCols=features, outputCol="_x")
    if held:
        rows = rows.where(~F.col(held))
    rows = rows.select(*features, "_y", *([weight] if weight else []))
    if kind in ("tree", "forest"):
        rows = dealt(rows)
    fitted = _estimator(kind, dict(params), weight, k, len(features)).fit(assembler.transform(rows))
    stages = PipelineModel([assembler, fitted])
    importance = None
    if hasattr(fitted, "featureImportances"):
        importance = fitted.featureImportances.toArray().tolist()
    elif hasattr(fitted, "coefficientMatrix"):
        importance = abs(fitted.coefficientMatrix.toArray()).mean(axis=0).tolist()
    return Model(features, k, _one(stages, k), importance, stages)


def _one(stages: PipelineModel, k: int) -> Callable[[DataFrame], DataFrame]:
    """Probabilities of a single classifier over all k classes."""

    def run(table: DataFrame) -> DataFrame:
        n = stages.stages[-1].numClasses
        return stages.transform(table).withColumn("proba", expanded(vector_to_array("probability"), range(n), k)).drop("_x", "rawPrediction", "probability", "prediction")

    return run


def foreign(features: Sequence[str], k: int, predict: Callable[[pd.DataFrame], list]) -> Model:
    """Any Python model: predict() takes a pandas table of the features and gives rows of k probabilities."""
    features = list(features)

    def run(table: DataFrame) -> DataFrame:
        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield pdf.assign(proba=[[float(p) for p in row] for row in predict(pdf[features])])

        return table.mapInPandas(batches, T.StructType([*table.schema.fields, T.StructField("proba", T.ArrayType(T.DoubleType()))]))

    return Model(features, k, run)


def _digest(spark: SparkSession, folder: str) -> str:
    """A digest of all files below a folder, whatever the folder's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"/stages/(.*)$", 1)
    rows = files.select(F.concat_ws(" ", name, F.sha2("content", 256)).alias("line")).collect()  # a model has few files
    return hashlib.sha256("\n".join(sorted(r["line"] for r in rows)).encode()).hexdigest()


def save(model: Model | Centroids, path: str, df: DataFrame, key: Sequence[str], classes: Sequence[str] = (), metrics: dict[str, float] | None = None, drift: float = 1e-5, rows: int = 64) -> dict:
    """Writes an artifact and returns its manifest: features in order, classes, metrics, provenance, digest.

    It is written beside `path`, loaded again, compared on the first `rows` rows of df by hash, and
    only then moved into place; an artifact that differs by more than `drift` leaves `path` as it was.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    manifest = {"format": 1, "features": model.features, "k": model.k, "classes": list(classes), "metrics": metrics or {}, "spark": spark.version, "session": spark.sparkContext.applicationId}
    if isinstance(model, Centroids):
        means = {str(c): m for c, m in sorted(model.means.items())}
        manifest |= {"kind": "centroids", "means": means, "digest": hashlib.sha256(json.dumps(means).encode()).hexdigest()}
    elif model.grown is not None:
        grown = json.dumps(model.grown.as_dict())
        local_table(spark, [(grown,)], "value string").coalesce(1).write.text(f"{staging}/trees")
        manifest |= {"kind": "grown", "digest": hashlib.sha256(grown.encode()).hexdigest()}
    elif model.stages is None:
        raise ValueError("a foreign model has nothing to write")
    else:
        model.stages.write().save(f"{staging}/stages")
        manifest |= {"kind": "single", "digest": _digest(spark, f"{staging}/stages")}
    local_table(spark, [(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staging}/manifest")
    sample = df.orderBy(key_hash("save", key), *key).limit(rows)
    a, b = (m.transform(sample).select(*key, F.col("proba").alias(name)) for m, name in ((model, "_a"), (load(spark, staging), "_b")))
    gap = a.join(b, list(key)).agg(F.max(F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))).alias("g")).first()["g"]
    if gap is None or not gap <= drift:
        raise ValueError(f"the reloaded model differs by {gap}")
    moved(spark, staging, path)
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path.rstrip('/')}/manifest").collect()))


def load(spark: SparkSession, path: str) -> Model | Centroids:
    """The model of an artifact; an error if its files are not those of the manifest."""
    path, told = path.rstrip("/"), manifest_of(spark, path)
    features, k = told["features"], told["k"]
    if told["kind"] == "centroids":
        found = hashlib.sha256(json.dumps(told["means"]).encode()).hexdigest()
    elif told["kind"] == "grown":
        trees = "".join(r["value"] for r in spark.read.text(f"{path}/trees", wholetext=True).collect()).rstrip("\n")
        found = hashlib.sha256(trees.encode()).hexdigest()
    else:
        found = _digest(spark, f"{path}/stages")
    if found != told["digest"]:
        raise ValueError(f"{path} is not as it was written")
    if told["kind"] == "centroids":
        return Centroids(features, {int(c): m for c, m in told["means"].items()}, k)
    if told["kind"] == "grown":
        grown = Ensemble.of_dict(json.loads(trees))
        return Model(features, k, grown.transform, grown.importance(), grown=grown)
    stages = PipelineModel.load(f"{path}/stages")
    return Model(features, k, _one(stages, k), None, stages)
