"""Token counts with a digest cache.

A text's digest and the digest of the tokenizer's file are looked up in a stored table of counts. Only texts that
are not there are encoded, each distinct one once, and their counts are appended to the table.

Edge cases: a null text counts as the empty text (0 tokens); very long texts are counted whole; equal texts share one
digest, so it makes no difference which of them is encoded; repeated rows and null ids stay; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BROADCAST_ROWS = 1_000_000  # digests of 32 bytes
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda column: np.array([len(x) for x in model.encode([x or "" for x in column.to_pylist()], num_threads=1)], np.int64)
    encoder = common.encoder(path)
    return lambda column: encoder.encode(column)[1]


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in (part for whole in batches for part in common.sliced(whole)):
            count = count or _counter(path)
            n = count(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table where nothing has been stored yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens) for every row of docs; appends counts of texts not in the cache to it.

    The digest is SHA-256 over the text as it is counted (null: empty), so a cache hit is exact.
    """
    spark = docs.sparkSession
    common.ship(spark)
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest")
    # equal texts fall together in the task that reads them, so a text of many rows is sent once by each task
    distinct = lambda rows: rows.groupBy("digest").agg(F.first("text").alias("text"))
    if known.isEmpty():
        misses = distinct(keyed)
    else:  # texts are sent only where their digests aren't known
        missing = common.staged(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "missing-digests")
        few = missing.count() <= BROADCAST_ROWS
        misses = distinct(keyed.join(F.broadcast(missing), "digest", "left_semi")) if few else distinct(keyed).join(missing, "digest", "left_semi")
    misses.select("digest", "text").mapInArrow(_encode(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # written, so that the join reads exchanges alone and Spark can split a digest that many rows share
    counts = common.staged(read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"]), "token-counts")
    ids = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return ids.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
