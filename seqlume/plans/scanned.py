"""Consensus sequences, motif hits by p-value, nested JSON and counts over sets of regions, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlume.operators import cohort, motifs, scan, scans
from seqlume.sources import readers
from seqlume.sources.staging import staged

from .base import query, read
from .sequences import _LETTERS, _bases

_STEP = 100


@query(
    f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, {_LETTERS} AS s FROM documents), v AS (SELECT chrom, s, i * 97 + 95 AS p FROM d, LATERAL unnest(generate_series(0, length(s) // 97)) AS t(i) WHERE i * 97 + 102 <= length(s)),
w AS (SELECT chrom, s, p, lag(p + 7, 1, 0) OVER (PARTITION BY chrom ORDER BY p) AS before FROM v),
m AS (SELECT chrom, s, string_agg(substr(s, before + 1, p - before) || 'TT', '' ORDER BY p) || substr(s, max(p) + 8) AS whole, list(p) AS ps FROM w GROUP BY 1, 2),
c AS (SELECT *, k * {_STEP} AS a, least((k + 1) * {_STEP}, length(s)) AS b FROM m, LATERAL unnest(generate_series(0, (length(s) - 1) // {_STEP})) AS t(k)),
o AS (SELECT *, a - list_sum(list_transform(ps, lambda p: least(greatest(a - p, 0), 7) - CASE WHEN p < a THEN 2 ELSE 0 END)) AS x, b - list_sum(list_transform(ps, lambda p: least(greatest(b - p, 0), 7) - CASE WHEN p < b THEN 2 ELSE 0 END)) AS y FROM c)
SELECT 'one' AS sample, chrom, CAST(a AS BIGINT) AS chunk_start, CAST(x AS BIGINT) AS out_start, substr(whole, CAST(x AS BIGINT) + 1, CAST(y - x AS BIGINT)) AS mutated FROM o"""
)
def consensus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 100 letters with deletions of five letters, some of which reach over the borders of chunks; variants
    within kept ones are left out."""
    s = staged(_bases(spark, sf_dir, some=True).select(F.col("doc_id").cast("string").alias("name"), F.col("s").alias("seq")), "letters")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.length("seq") / 97)))
    v = s.select("name", "seq", at.alias("i")).select("name", "seq", (F.col("i") * 97 + 95).alias("p")).where("p + 7 <= length(seq)")
    cut = lambda p, n: F.substring(F.col("seq"), (p + 1).cast("int"), F.lit(n))
    some = v.select(F.col("name").alias("chrom"), F.explode(F.array(F.struct(F.col("p").alias("pos"), cut(F.col("p"), 7).alias("ref"), F.lit("TT,A").alias("alt")), F.struct((F.col("p") + 3).alias("pos"), cut(F.col("p") + 3, 1).alias("ref"), F.lit("GG").alias("alt")))).alias("v"))
    return scans.consensus(readers.chunks(s, _STEP, 0), some.select(F.lit("one").alias("sample"), "chrom", "v.*"))


_MATRIX = [[0.6, 0.2, 0.1, 0.1], [0.05, 0.05, 0.1, 0.8], [0.1, 0.1, 0.7, 0.1], [0.4, 0.3, 0.2, 0.1]]
_ODDS = ", ".join(f"({i}, '{c}', log2({p} / 0.25))" for i, row in enumerate(_MATRIX) for c, p in zip("ACGT", row))


@query(
    f"""WITH o(i, c, odds) AS (VALUES {_ODDS}), r AS (SELECT min(odds) AS lo, max(odds) AS hi FROM o), w AS (SELECT i, c, CAST(round((odds - lo) * (1000 / (hi - lo))) AS BIGINT) AS x FROM o, r),
k AS (SELECT w0.c || w1.c || w2.c || w3.c AS word, w0.x + w1.x + w2.x + w3.x AS x FROM w w0, w w1, w w2, w w3 WHERE w0.i = 0 AND w1.i = 1 AND w2.i = 2 AND w3.i = 3),
p AS (SELECT word, x, (SELECT count(*) FROM k b WHERE b.x >= a.x) / 256 AS p FROM k a),
s AS (SELECT doc_id, substr(s, i, 4) AS word, CAST(i - 1 AS INTEGER) AS start FROM (SELECT doc_id, {_LETTERS} AS s FROM documents), LATERAL unnest(generate_series(1, length(s) - 3)) AS t(i))
SELECT doc_id, start, round(x / (SELECT 1000 / (hi - lo) FROM r) + 4 * (SELECT lo FROM r), 6) AS score, round(p, 9) AS p_value FROM s JOIN p USING (word) WHERE p <= 0.02"""
)
def motif_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of whole sequences whose score under a matrix has a p-value of at most 0.02."""
    s = _bases(spark, sf_dir).select("doc_id", F.col("s").alias("seq"))
    hits = motifs.motif_hits(s, {"m": _MATRIX}, 0.02, name="doc_id")
    return hits.select(F.col("name").alias("doc_id"), "start", F.round("score", 6).alias("score"), F.round("p_value", 9).alias("p_value"))


@query(
    """WITH e AS (SELECT event_id, '{"a": {"b": ["' || event_type || '", {"image/png": "no", "c d": [[' || props || ', 7, null]]}]}, "u": "' || user_id || '"}' AS t FROM events)
SELECT event_id, CASE p.k WHEN 1 THEN '$.a.b[0]' WHEN 2 THEN '$.u' ELSE '$.a.b[1]."c d"[0][0].' || p.name END AS path, p.value FROM (
SELECT event_id, 1 AS k, '' AS name, event_type AS value FROM events UNION ALL SELECT event_id, 2, '', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT e.event_id, 3, j.key, json_extract_string(e.props, '$.' || j.key) FROM events e, json_each(CAST(e.props AS JSON)) j WHERE j.type = 'VARCHAR') p"""
)
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of JSON texts that hold the events' properties five levels down."""
    text = F.concat(F.lit('{"a": {"b": ["'), "event_type", F.lit('", {"image/png": "no", "c d": [['), "props", F.lit(', 7, null]]}]}, "u": "'), F.col("user_id").cast("string"), F.lit('"}'))
    return scan.json_strings(read(spark, sf_dir, "events").select("event_id", text.alias("t")), "event_id", "t")


@query(
    """WITH sets AS (SELECT DISTINCT 'by' || lpad(CAST(k AS VARCHAR), 2, '0') AS region_set, p_partkey % 200 AS region FROM part, generate_series(1, 70) g(k) WHERE p_partkey % 200 % k = 0),
v AS (SELECT event_id, user_id, event_id % 211 AS region, event_id % 3 > 0 AS snv FROM events), j AS (SELECT s.region_set, v.snv, v.user_id % 3 AS a FROM v JOIN sets s USING (region))
SELECT s.region_set, count(a) FILTER (a = 2) AS affected_variants, count(a) FILTER (a = 2 AND snv) AS affected_snvs, count(a) FILTER (a = 1) AS unaffected_variants, count(a) FILTER (a = 1 AND snv) AS unaffected_snvs FROM (SELECT DISTINCT region_set FROM sets) s LEFT JOIN j USING (region_set) GROUP BY 1"""
)
def region_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants by affection in seventy overlapping sets of regions."""
    k = F.explode(F.sequence(F.lit(1), F.lit(70)))
    sets = read(spark, sf_dir, "part").select((F.col("p_partkey") % 200).alias("region"), k.alias("k")).where("region % k = 0").select(F.concat(F.lit("by"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("region_set"), "region")
    e = read(spark, sf_dir, "events")
    v = e.select(F.col("user_id").alias("sample"), (F.col("event_id") % 211).alias("region"), (F.col("event_id") % 3 > 0).alias("snv"))
    samples = e.select(F.col("user_id").alias("sample")).distinct().withColumn("affection", F.col("sample") % 3)
    return cohort.region_set_counts(v, sets, samples, {"variants": F.lit(True), "snvs": F.col("snv")})
