"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, common, decontaminate, divergence, jaccard_join, ngram_lm, packing, quality_rules, quote_links, token_counts, token_shards, toxicity, url_filter
from .oracles import ORACLE_SQL  # noqa: F401

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_folder(spark, "token-shards")
    token_shards.write_shards(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_shards.document_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(common.table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("passed")).alias("kept")
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(common.table(spark, sf_dir, "pages"), URL_RULES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packing.with_digest(packed)


def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.link_quotes(common.table(spark, sf_dir, "conversations"))


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = common.crc_mod("doc_id", 7) == 2
    model = ngram_lm.fit(docs.withColumn("train", ~held), order=3)
    scores = ngram_lm.score(docs, model)
    return scores.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = common.crc_mod("doc_id", 5) == 0
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels").where(~held))
    scores = model.score(docs)
    return scores.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(common.table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    counts = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), common.new_folder(spark, "token-count-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(common.table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(common.table(spark, sf_dir, "documents"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_shards, op2_decontaminate, op3_quality_rules, op4_url_filter, op5_packing, op6_quote_links, op7_ngram_lm, op8_toxicity, op9_jaccard_join, op10_token_counts, op11_source_divergence, op12_centroids, op13_byte_bpe)
}
