"""The corpus pipeline: quality rules, toxicity, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. doc_id is the key of documents, but no stage relies on it: rows are told apart by where they
stand in their files, so a row without an id, or one that repeats another's id, is judged by its own text.

Edge cases, the same for every stage unless its docstring adds to them: nulls in any column stay as they are; a null
text is an empty one; very long texts are judged whole; equal rows are judged alike (and only one of them outlives the
third stage); an empty table gives an empty table; further columns of documents, whatever their names, go through to
the fourth stage's result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlume.llm import common, decontaminate, jaccard_join, packing, quality_rules, toxicity

BROADCAST_ROWS = 1_000_000  # row digests of 8 bytes
ROW = "_pipeline_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ROW, a 64-bit digest of a row's file and its place there, and nothing else but documents' columns.

    A table that isn't read from files is written first. Two of 1e8 rows share a digest with a chance of 3e-4.
    """
    row = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(ROW)
    try:
        return docs.select("*", row)
    except AnalysisException:
        return common.staged(docs, "pipeline-rows").select("*", row)


def _without(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """keyed without these rows and without ROW. Few enough rows are broadcast, more are joined by shuffle."""
    rows = common.staged(rows.select(ROW).distinct(), "dropped")
    left = keyed.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, ROW, "left_anti")
    return left.drop(ROW)


def _row(docs: DataFrame) -> Column:
    """All columns as one, whatever signs their names hold."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go; its measures and the text come from the same scan."""
    rows = docs.select(_row(docs), "text")
    return quality_rules.apply_rules(rows, id_col="_row").where("passed").select("doc_id.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated score of 0.5 or more go. The model learns from labelled documents that are left."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    rows = docs.select(_row(docs), "text")
    return model.score(rows, id_col="_row").where("score < 0.5").select("doc_id.*")


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that with the smallest id, of several the one with the
    smallest row digest; rows without an id only stay where no row of their group has one. Documents without words
    are near no other."""
    keyed = _keyed(docs)
    groups = jaccard_join.near_duplicates(keyed, id_col=ROW)
    more = common.staged(groups.where("doc_id != component_id").select(F.col("doc_id").alias(ROW), "component_id"), "duplicates")
    members = more.union(more.select(F.col("component_id").alias(ROW), "component_id")).distinct()
    named = keyed.select(ROW, "doc_id").join(members, ROW)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("stays"))
    stays = common.staged(first.select(F.col(f"stays.{ROW}").alias(ROW)), "stays")
    return _without(keyed, members.join(stays, ROW, "left_anti"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items all stay."""
    keyed = _keyed(docs)
    found = decontaminate.find_leaks(keyed.select(F.col(ROW).alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    return _without(keyed, found.select(F.col("doc_id").alias(ROW)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, packed into sequences of 2048 tokens."""
    return packing.with_digest(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxic),
    ("n-gram Jaccard join", duplicates),
    ("benchmark decontamination", leaks),
    ("best-fit packing", packed),
]

#: The trained and latent stages have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
