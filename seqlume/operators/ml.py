"""Splits, boosted trees and predictions."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.sources.staging import staged


def split_of(key: str, validation: float = 0.1, test: float = 0.1, seed: int = 11) -> Column:
    """train, validation or test, by hash of the key, so that a row's split never changes."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000)) / F.lit(10_000.0)
    return F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train")


def class_weight(df: DataFrame, label: str = "label") -> float:
    """Negative rows for each positive one; 1 without positives."""
    r = df.agg(F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    return r["n"] / r["p"] if r["p"] else 1.0


def train_and_predict(df: DataFrame, key: str, features: list[str], label: str = "label", rounds: int = 20, depth: int = 4, rate: float = 0.1) -> DataFrame:
    """Rows (key, label, split, probability) for all rows; trees learn from the training split, weighted by class.
    The features are worked out once and written, as learning reads them several times."""
    rows = staged(df.select(key, label, *(F.col(f"`{c}`") for c in features)).withColumn("split", split_of(key)), "features")
    train = rows.where("split = 'train'")
    weight = F.when(F.col(label) == 1, F.lit(class_weight(train, label))).otherwise(F.lit(1.0))
    vectors = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=11)
    model = trees.fit(vectors.transform(train.withColumn("_w", weight)))
    return model.transform(vectors.transform(rows)).select(key, label, "split", vector_to_array("probability")[1].alias("probability"))


def quality(predictions: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """Rows (split, n, error, logloss, auc); the area is that of the ROC curve, ties count half."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    by = predictions.groupBy("split", score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    from pyspark.sql import Window

    below = F.coalesce(F.sum("n").over(Window.partitionBy("split").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = by.withColumn("a", F.col("p") * (below + F.col("n") / 2)).groupBy("split").agg((F.sum("a") / (F.sum("p") * F.sum("n"))).alias("auc"))
    rest = predictions.groupBy("split").agg(F.count("*").alias("n"), F.avg(((F.col(score) >= 0.5).cast("int") != F.col(label)).cast("double")).alias("error"), F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("logloss"))
    return rest.join(area, "split")
