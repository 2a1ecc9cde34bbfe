"""Boosted trees on labelled documents: curves of the training and Shapley values of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlume.operators import boosting, ml

from .base import query, read

FEATURES = ["letters", "words", "lines", "digits", "capitals", "signs", "blanks"]
PARAMS = boosting.Params(rounds=12, early_stop=3, eta=0.3, depth=3, gamma=0.1, block=4, bins=32)


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document with shares of its characters as features, some of them missing, and its split."""
    t = F.coalesce("text", F.lit(""))
    of = lambda pattern: F.regexp_count(t, F.lit(pattern))
    share = lambda pattern: F.try_divide(of(pattern), F.length(t))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", F.length(t).alias("letters"), of(r"\S+").alias("words"), of("\n").alias("lines"), share("[0-9]").alias("digits"), share("[A-Z]").alias("capitals"), share(r"[^A-Za-z0-9\s]").alias("signs"), share(" ").alias("blanks")
    )
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id").withColumn("split", ml.split_of("doc_id", validation=0.2))


@query()
def boosted_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error, areas and loss of every round, and the round at which the validation loss is least."""
    model = boosting.fit(_examples(spark, sf_dir), FEATURES, params=PARAMS)
    return model.curve_frame(spark)


@query()
def tree_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature adds to the margin of every labelled document."""
    examples = _examples(spark, sf_dir)
    return boosting.shapley_values(boosting.fit(examples, FEATURES, params=PARAMS), examples, "doc_id")
