"""Training and scoring with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.trees import BoostedTrees, boosted_scores
from cohortloom.session import materialise

ROWS_A_TASK = 100_000  # of a fit, times the trees grown at once; a level is a job, in which a task with less costs more than it does
NOT_FEATURES = ("label", "long_covid", "person_id", "window", "hold_for_val", "random", "patient_group")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def rows_of_fit(data: DataFrame, trees: int) -> tuple[DataFrame, int]:
    """The rows of a fit that grows so many trees at once, worked out once and laid out over as many tasks as
    they can fill, and their number."""
    rows = materialise(data, "fit_rows")
    n = rows.count()
    return rows.repartition(max(1, min(-(-n * trees // ROWS_A_TASK), data.sparkSession.sparkContext.defaultParallelism))), n


def _fit(df: DataFrame, label: str, classifier) -> PipelineModel:
    """Numbers are taken as they are; a column of arrays of text becomes sparse 0/1 columns, one for
    each text found in the rows of the fit."""
    rows = df.withColumn("_y", F.col(label).cast("double"))
    kinds = dict(df.dtypes)
    inputs, stages = [], []
    for c in feature_columns(df):
        if kinds[c] != "array<string>":
            inputs.append(c)
            continue
        words = [r[0] for r in df.select(F.explode(c)).distinct().sort("col").collect()]  # the model's own columns
        if words:
            stages.append(CountVectorizerModel.from_vocabulary(words, inputCol=c, outputCol=f"_{c}", binary=True))
            inputs.append(f"_{c}")
    assembler = VectorAssembler(inputCols=inputs, outputCol="_x", handleInvalid="error")
    return Pipeline(stages=[*stages, assembler, classifier.setFeaturesCol("_x").setLabelCol("_y")]).fit(rows)


def train_boosted_trees(data: DataFrame, label: str = "label", colsample_bytree: float = 0.1, gamma: float = 0.4,
                        learning_rate: float = 0.09, max_depth: int = 12, min_child_weight: int = 0,
                        n_estimators: int = 400, subsample: float = 0.9, random_state: int = 42) -> PipelineModel:
    """Gradient-boosted trees; the settings keep their usual names and defaults.

    `gamma` is a loss reduction summed over rows, Spark's minimum gain one per row, so it is
    divided by the number of training rows."""
    rows, n = rows_of_fit(data, 1)
    return _fit(rows, label, BoostedTrees(
        maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate, subsamplingRate=subsample,
        featureSubsetStrategy=str(colsample_bytree), minInfoGain=gamma / max(n, 1),
        minInstancesPerNode=max(1, min_child_weight), seed=random_state))


def train_forest(data: DataFrame, label: str = "long_covid", n_estimators: int = 1000, max_depth: int = 15,
                 random_state: int = 42) -> PipelineModel:
    """Random forest with entropy splits.

    Each row keeps the node it has reached in every tree; else a level would walk it down all trees from
    their roots once more."""
    return _fit(rows_of_fit(data, n_estimators)[0], label, RandomForestClassifier(
        numTrees=n_estimators, impurity="entropy", maxDepth=max_depth, seed=random_state, cacheNodeIds=True))


def model_scores(data: DataFrame, model: PipelineModel, keys: tuple[str, ...] = ("person_id", "window")) -> DataFrame:
    """Probability of the positive class for every row, by the columns the model was fitted on."""
    if isinstance(model.stages[-1], GBTClassificationModel):
        return boosted_scores(PipelineModel(model.stages[:-1]).transform(data), model.stages[-1], keys)
    return model.transform(data).select(*keys, vector_to_array("probability")[1].alias("model_score"))


def best_window(scores: DataFrame) -> DataFrame:
    """Highest score of each person and the first window that reaches it."""
    return (scores.groupBy("person_id")
            .agg(F.max(F.struct("model_score", (-F.col("window")).alias("w"))).alias("top"))
            .select("person_id", F.col("top.model_score").alias("max_score"), (-F.col("top.w")).alias("window")))


def feature_importance(model: PipelineModel, top: int | None = None) -> DataFrame:
    """(feature, importance) in descending order; one row per model column."""
    words = {s.getOutputCol(): s.vocabulary for s in model.stages[:-2]}
    names = [n for c in model.stages[-2].getInputCols() for n in words.get(c, [c])]
    weights = model.stages[-1].featureImportances.toArray()
    out = SparkSession.builder.getOrCreate().createDataFrame([(n, float(w)) for n, w in zip(names, weights)], "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature")
    return out if top is None else out.limit(top)

