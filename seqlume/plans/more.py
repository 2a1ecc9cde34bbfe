"""Queries of scores, identifiers, genotypes and event checks on stand-ins from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlume.functions import scores, sequence
from seqlume.operators import cohort, features, genome, mutagenesis

from .base import query, read, seconds
from .sequences import _LETTERS, _bases


@query("SELECT l_orderkey, l_linenumber, round(l_discount - l_tax, 6) AS dpsi, CASE WHEN l_discount > 0 AND l_tax > 0 THEN round(log2(l_discount) - log2(l_tax), 6) END AS fold_change FROM lineitem")
def inclusion_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of inclusion and its log2 fold change."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scores.dpsi("l_discount", "l_tax"), 6).alias("dpsi"), F.round(scores.log2_fold_change("l_discount", "l_tax"), 6).alias("fold_change"))


_MUTATION = "'E' || user_id || '_' || substr('exupdn', CAST(1 + 2 * (event_id % 3) AS INT), 2) || (event_id % 41 - 20) || '_' || substr('ACGT', CAST(1 + event_id % 4 AS INT), 1) || (CASE WHEN event_id % 11 = 0 THEN '' ELSE ':T' END)"


@query(
    f"SELECT event_id, CASE WHEN event_id % 11 > 0 THEN 'E' || user_id END AS event, CASE WHEN event_id % 11 > 0 THEN substr('exupdn', CAST(1 + 2 * (event_id % 3) AS INT), 2) END AS region, CASE WHEN event_id % 11 > 0 THEN CAST(event_id % 41 - 20 AS INTEGER) END AS rel_pos, CASE WHEN event_id % 11 > 0 THEN substr('ACGT', CAST(1 + event_id % 4 AS INT), 1) END AS ref, CASE WHEN event_id % 11 > 0 THEN 'T' END AS alt FROM events"
)
def mutation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the names of mutants; nulls for names of another form."""
    names = read(spark, sf_dir, "events").select("event_id", F.expr(_MUTATION).alias("name"))
    return names.select("event_id", sequence.mutation_id("name").alias("m")).select("event_id", "m.*")


@query(
    """WITH g AS (SELECT event_id, event_id % 40 AS dp, (event_id * 7) % 100 AS gq, (event_id * 3) % 41 AS ad, CASE WHEN event_id % 3 = 0 THEN 'hom' WHEN event_id % 3 = 1 THEN 'het' ELSE 'ref' END AS gt, event_id % 4 = 0 AS indel, event_id % 9 > 0 AS pass FROM events)
SELECT event_id, pass AND dp >= 10 AND ((gt = 'het' AND gq >= CASE WHEN indel THEN 90 ELSE 99 END AND ad >= 0.3 * dp AND ad < 0.8 * dp) OR (gt = 'hom' AND gq >= 25 AND ad >= 0.8 * dp)) AS good FROM g"""
)
def genotype_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good genotypes of VCF-shaped rows."""
    n = F.col("event_id")
    gt = F.when(n % 3 == 0, "1/1").when(n % 3 == 1, "0|1").otherwise("0/0")
    sample = F.concat_ws(":", gt, F.concat(F.lit("5,"), (n * 3) % 41), n % 40, (n * 7) % 100)
    rows = read(spark, sf_dir, "events").select("event_id", F.when(n % 9 > 0, "PASS").otherwise("q10").alias("filter"), F.lit("A").alias("ref"), F.when(n % 4 == 0, "AT").otherwise("G").alias("alt"), F.lit("GT:AD:DP:GQ").alias("format"), sample.alias("sample"))
    return rows.select("event_id", sequence.good_genotype("filter", "ref", "alt", "format", "sample").alias("good"))


@query(
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'invalid event' WHEN s_suppkey % 3 = 0 THEN 'equal to reference' END AS reason FROM supplier"
)
def rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a personal genome with the reason for which they are skipped."""
    k = F.col("s_suppkey")
    plus = k % 2 == 0
    pick = lambda a, b: F.when(plus, F.lit(a)).otherwise(F.lit(b))
    end = F.when(k % 5 == 0, F.lit(20)).otherwise(pick(100, 400))
    moved = read(spark, sf_dir, "supplier").select(
        k.alias("id"), pick("+", "-").alias("strand"), pick(50, 300).alias("upIntStart"), end.alias("upIntEnd"), pick(110, 50).alias("dnIntStart"), pick(200, 290).alias("dnIntEnd"),
        F.lit("acgt").alias("wt_c1"), F.when(k % 3 == 0, "ACGT").otherwise("ACGA").alias("mt_c1"), F.lit(None).cast("string").alias("wt_a"), F.lit(None).cast("string").alias("mt_a"),
    )
    return genome.checked_events(moved).select("id", "reason")


@query(
    f"""WITH k AS (SELECT a.x || b.x || c.x AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('T')) a(x), (VALUES ('A'), ('C'), ('G'), ('T')) b(x), (VALUES ('A'), ('C'), ('G'), ('T')) c(x)),
s AS (SELECT lang, {_LETTERS} AS s FROM documents), n AS (SELECT lang, substr(s, i, 3) AS kmer, count(*) AS n FROM s, LATERAL unnest(generate_series(1, length(s) - 2)) AS t(i) GROUP BY 1, 2)
SELECT l.lang, k.kmer, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN k LEFT JOIN n ON n.lang IS NOT DISTINCT FROM l.lang AND n.kmer = k.kmer"""
)
def all_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each language's sequences have every word of three letters, those that never occur included."""
    docs = read(spark, sf_dir, "documents")
    s = docs.join(_bases(spark, sf_dir), "doc_id")
    counts = s.select("lang", F.explode(sequence.kmers("s", 3)).alias("kmer")).groupBy("lang", "kmer").agg(F.count("*").alias("n"))
    words = F.array(*(F.lit(w) for w in mutagenesis.kmer_words(3)))
    every = docs.select("lang").distinct().select("lang", F.explode(words).alias("kmer"))
    return every.join(counts.withColumnsRenamed({"lang": "_lang", "kmer": "_kmer"}), F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("kmer") == F.col("_kmer")), "left").select("lang", "kmer", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    """WITH v AS (SELECT event_id, user_id, 1 + (event_id * 31) % 3000 AS pos, event_id % 97 AS k, event_id % 6 AS form FROM events),
i AS (SELECT *, 'E' || k AS event, 'E' || k || CASE form WHEN 0 THEN '' WHEN 1 THEN '_up' WHEN 2 THEN '_c1' WHEN 3 THEN '_c2_dn' WHEN 4 THEN '_ex' ELSE '_c1_up' END AS interval, CASE form WHEN 2 THEN 'c1' WHEN 3 THEN 'c2' WHEN 5 THEN 'c1' ELSE 'mic' END AS exon, CASE form WHEN 1 THEN 'up' WHEN 3 THEN 'dn' WHEN 5 THEN 'up' ELSE 'ex' END AS region FROM v
  UNION ALL SELECT *, 'putative_microexon_' || k, 'putative_x_' || k || '_dn', 'mic', 'dn' FROM v WHERE form < 3),
e AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'E' || s_suppkey ELSE 'putative_microexon_' || s_suppkey END AS event, s_suppkey % 3 = 0 AS plus, 1000 + s_suppkey AS a, 1020 + s_suppkey AS b FROM supplier)
SELECT i.event_id, i.interval, i.exon AS affected_exon, i.region AS affected_region, CASE i.user_id % 3 WHEN 0 THEN 'non-ASD' WHEN 1 THEN 'control' ELSE 'ASD' END AS affection,
CASE WHEN plus THEN 1 ELSE -1 END * CASE WHEN pos <= a THEN pos - a WHEN pos - 1 >= b THEN pos - 1 - b WHEN pos - 1 > a AND pos <= b THEN CASE WHEN pos - 1 - a < b - pos THEN pos - 1 - a ELSE pos - b END ELSE 0 END AS distance FROM i JOIN e USING (event)"""
)
def annotated_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with the events of all intervals in their annotation, and the distance to each."""
    n, k = F.col("event_id"), F.col("event_id") % 97
    tails = F.array(*map(F.lit, ("", "_up", "_c1", "_c2_dn", "_ex", "_c1_up")))
    own = F.concat(F.lit("E"), k, F.get(tails, (n % 6).cast("int")))
    both = F.concat_ws(",", own, F.when(n % 6 < 3, F.concat(F.lit("putative_x_"), k, F.lit("_dn"))))
    e = read(spark, sf_dir, "events")
    v = e.select(F.col("user_id").cast("string").alias("sample"), n.cast("string").alias("chrom"), (1 + (n * 31) % 3000).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), both.alias("intervals"))
    s = F.col("s_suppkey")
    plus, a, b = s % 3 == 0, 1000 + s, 1020 + s
    events = read(spark, sf_dir, "supplier").select(
        F.when(s % 2 == 0, F.concat(F.lit("E"), s)).otherwise(F.concat(F.lit("putative_microexon_"), s)).alias("event"), F.when(plus, "+").otherwise("-").alias("strand"),
        F.lit(0).alias("upIntStart"), F.when(plus, a).otherwise(b).alias("upIntEnd"), F.when(plus, b).otherwise(0).alias("dnIntStart"), F.when(plus, 0).otherwise(a).alias("dnIntEnd"),
    ).withColumn("upIntStart", F.when(F.col("strand") == "+", 0).otherwise(F.col("upIntEnd")))
    samples = e.select(F.col("user_id").alias("u")).distinct().select(F.col("u").cast("string").alias("sample"), (F.col("u") % 3).alias("affection"))
    rows = cohort.annotated_variants(v, events, samples)
    return rows.select(F.substring_index("variant", ":", 1).cast("long").alias("event_id"), "interval", "affected_exon", "affected_region", "affection", F.col("mic_var_distance").alias("distance"))


@query(
    "SELECT user_id, " + ", ".join(f"greatest(coalesce(max(CASE WHEN h >= {a} AND h < {b} THEN value - 400 END), 0), 0) AS x_{r}" for r, (a, b) in {"up": (0, 8), "dn": (8, 20)}.items()) + " FROM (SELECT *, date_diff('second', TIMESTAMP '2024-01-01', ts) // 3600 % 24 AS h FROM events) GROUP BY 1"
)
def floored_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest values over ranges of positions, at least 0."""
    e = read(spark, sf_dir, "events").select("user_id", (F.floor(seconds() / 3600) % 24).alias("h"), (F.col("value") - 400).alias("x"))
    return features.floored_maxima(e, ["user_id"], "h", {"up": (0, 8), "dn": (8, 20)}, ["x"])


@query(
    "SELECT l_orderkey, l_linenumber, round((l_discount + l_tax + l_quantity) / 3, 6) AS mean, least(l_discount, l_tax, l_quantity) AS low FROM lineitem ORDER BY mean, low, l_orderkey, l_linenumber"
)
def row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of the mean and the least of their columns."""
    columns = ["l_discount", "l_tax", "l_quantity"]
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scores.row_mean(columns), 6).alias("mean"), scores.row_min(columns).alias("low"))
    return rows.orderBy("mean", "low", "l_orderkey", "l_linenumber")
