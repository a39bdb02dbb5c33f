"""Training with grouped folds, out-of-fold scores, calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import crc_fold

MISSING = -1.0


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with a vector of columns; a missing value is MISSING and sets an indicator of its own."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(f"_f_{c}") for c in columns]
    known = [F.col(c).isNotNull().cast("double").alias(f"_k_{c}") for c in columns]
    out = df.select("*", *filled, *known)
    names = [f"_f_{c}" for c in columns] + [f"_k_{c}" for c in columns]
    return VectorAssembler(inputCols=names, outputCol="_x").transform(out).drop(*names)


def fold_of(ident: str) -> F.Column:
    return crc_fold(F.col(ident).cast("string"))


def train_folds(x: DataFrame, label: str, folds: tuple[int, ...], cfg: Config) -> dict[int, Model]:
    """A model for each fold, trained on the other folds of the list."""
    models = {}
    for f in folds:
        rows = x.where(F.col("fold").isin([g for g in folds if g != f]))
        if rows.select(label).distinct().count() < 2:
            continue
        gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=cfg.rounds, stepSize=cfg.learning_rate, maxDepth=cfg.tree_depth, minInstancesPerNode=cfg.min_leaf, subsamplingRate=0.75, featureSubsetStrategy="0.8", seed=cfg.seed)
        models[f] = gbt.fit(rows)
    return models


def predict_folds(x: DataFrame, models: dict[int, Model], name: str) -> DataFrame:
    """Own-fold model on its fold's rows, the mean of all elsewhere."""
    if not models:
        return x.withColumn(name, F.lit(0.0))
    cols = []
    for f, m in models.items():
        x = m.transform(x).withColumn(f"_p{f}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        cols.append(f"_p{f}")
    own = F.coalesce(*[F.when(F.col("fold") == f, F.col(f"_p{f}")) for f in models])
    mean = reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / len(cols)
    return x.withColumn(name, F.coalesce(own, mean)).drop(*cols)


def calibrate(x: DataFrame, p: str, label: str) -> Model:
    return IsotonicRegression(featuresCol=p, labelCol=label).fit(x.select(F.col(p), F.col(label).cast("double").alias(label)))


def apply_calibration(x: DataFrame, model: Model, p: str, name: str) -> DataFrame:
    out = model.transform(x).withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))))
    return out.drop("prediction")


def save_run(spark: SparkSession, model: dict, path: str) -> None:
    """Keep what training made: a folder a model, and a report naming folds, decision and configuration."""
    from ..sources.stages import save_report

    for part in ("stage1", "stage2"):
        for f, m in model[part].items():
            m.write().overwrite().save(f"{path}/{part}/{f}")
    model["calibration"].write().overwrite().save(f"{path}/calibration")
    save_report(spark, f"{path}/meta", {"stage1": sorted(model["stage1"]), "stage2": sorted(model["stage2"]), **{k: model[k] for k in ("decision", "config", "holdout_f05")}})


def load_run(spark: SparkSession, path: str) -> dict:
    from ..sources.stages import load_report

    meta = load_report(spark, f"{path}/meta")
    parts = {part: {f: GBTClassificationModel.load(f"{path}/{part}/{f}") for f in meta[part]} for part in ("stage1", "stage2")}
    return meta | parts | {"calibration": IsotonicRegressionModel.load(f"{path}/calibration")}


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    y = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("y"))
    words = F.split("text", r"\s+")
    feats = docs.select("doc_id", F.length("text").cast("double").alias("chars"), F.size(words).cast("double").alias("words"), (F.size(F.array_distinct(words)) / F.size(words)).alias("variety"), (F.length(F.regexp_replace("text", r"\p{L}", "")) / F.length("text")).alias("other"))
    cols = ["chars", "words", "variety", "other"]
    return assembled(feats.join(y, "doc_id").withColumn("fold", fold_of("doc_id")), cols), cols


def oof_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fold, y, p): out-of-fold scores of document quality."""
    x, _ = _labelled(spark, sf_dir)
    x = x.cache()
    cfg = Config(rounds=5, tree_depth=3, min_leaf=5)
    folds = cfg.stage1_folds
    return predict_folds(x, train_folds(x, "y", folds, cfg), "p").select("doc_id", "fold", "y", "p")


def calibrated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = oof_labels(spark, sf_dir)
    return apply_calibration(x, calibrate(x, "p", "y"), "p", "calibrated").select("doc_id", "y", "p", "calibrated")
