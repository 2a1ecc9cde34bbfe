"""Tables side by side, heat maps of several regions and pooled outputs, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlume.operators import features, groups

from .base import query, read
from .sequences import _LETTERS, _bases


@query(
    """WITH a AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS row_id, c_custkey FROM customer), b AS (SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS row_id, s_suppkey FROM supplier)
SELECT coalesce(a.row_id, b.row_id) AS row_id, c_custkey, s_suppkey FROM a FULL JOIN b ON a.row_id = b.row_id"""
)
def pasted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers side by side by their balances; there are more customers."""
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    rows = groups.pasted(c.select("c_custkey", "c_acctbal"), s.select("s_suppkey", "s_acctbal"), [F.desc("c_acctbal"), "c_custkey"], [F.desc("s_acctbal"), "s_suppkey"])
    return rows.select("row_id", "c_custkey", "s_suppkey")


_BINS = {"up": [0, 1], "ex": [0], "dn": [0, 1]}
_CELLS = [(f"{r}_{b}", f"region = '{r}' AND bin = {b}") for r, bs in _BINS.items() for b in bs]


@query(
    f"""WITH w AS (SELECT doc_id, substr(s, i, 2) AS kmer, i - 1 AS pos FROM (SELECT doc_id, {_LETTERS} AS s FROM documents), LATERAL unnest(generate_series(1, length(s) - 1)) AS t(i)),
h AS (SELECT ['up', 'ex', 'dn'][doc_id % 3 + 1] AS region, kmer, pos // 200 AS bin, avg((doc_id % 7) + (pos + 0.5) * 0.25) AS effect FROM w GROUP BY 1, 2, 3)
SELECT kmer, {", ".join(f"round(avg(effect) FILTER ({c}), 6) AS {n}" for n, c in _CELLS)}, round(avg(effect) FILTER ({" OR ".join(c for _, c in _CELLS)}), 6) AS mean FROM h GROUP BY 1 HAVING count(*) FILTER (region = 'up') > 0"""
)
def region_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat maps of pairs of letters, of documents that stand for three regions, side by side."""
    region = F.element_at(F.array(F.lit("up"), F.lit("ex"), F.lit("dn")), (F.col("doc_id") % 3 + 1).cast("int"))
    s = _bases(spark, sf_dir, some=True).select(F.col("doc_id").alias("event"), region.alias("region"), F.col("s").alias("seq"), F.lit(0).alias("first_pos"))
    effects = s.select("event", "region", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("rel_pos")).withColumn("delta", F.col("event") % 7 + F.col("rel_pos") * 0.25)
    heat = features.motif_heatmap(effects, s, 2, F.floor(F.col("pos") / 200), by_region=True)
    wide = features.region_heatmap(heat, _BINS)
    return wide.select("kmer", *(F.round(c, 6).alias(c) for c in wide.columns if c != "kmer"))


@query(
    "SELECT l_orderkey, " + ", ".join(f"round(greatest(coalesce(max({x}) FILTER (l_linenumber % 3 = {k}), 0), 0), 6) AS {n}_{r}" for k, r in enumerate(_BINS) for n, x in (("gain", "CAST(l_tax - l_discount AS DOUBLE)"), ("tax", "CAST(l_tax AS DOUBLE)"))) + " FROM lineitem GROUP BY 1"
)
def pooled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest outputs of each region's windows, at least 0; regions without windows have 0."""
    region = F.element_at(F.array(*map(F.lit, _BINS)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", region.alias("region"), (F.col("l_tax") - F.col("l_discount")).alias("gain"), F.col("l_tax").alias("tax"))
    wide = features.pooled_regions(rows, ["l_orderkey"], ["gain", "tax"], list(_BINS))
    return wide.select("l_orderkey", *(F.round(c, 6).alias(c) for c in wide.columns if c != "l_orderkey"))
