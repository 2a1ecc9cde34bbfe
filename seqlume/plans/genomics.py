"""Genomic operators on stand-ins from the driver's tables: letters of documents as sequences, suppliers as events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlume.functions import sequence
from seqlume.operators import enrichment, features, genome, intervals, mutagenesis, scans, variants

from .base import query, read, seconds
from .flagship import ANNOTATE_SQL, annotate_windows
from .sequences import _LETTERS, _bases, _tiles, _tiles_sql

#: Suppliers as events: a microexon of 3 to 9 bases between introns of 400 and 300 bases, every second one reversed.
_EVENTS_SQL = """ev AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 10000 * s_suppkey + 1000 AS ms, 3 + s_suppkey % 7 AS n FROM supplier)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"), (10000 * F.col("s_suppkey") + 1000).alias("ms"), (3 + F.col("s_suppkey") % 7).alias("n"))
    plus = F.col("strand") == "+"
    me = F.col("ms") + F.col("n")
    pick = lambda a, b: F.when(plus, a).otherwise(b)
    return s.select("id", "strand", "ms", "n", pick(F.col("ms") - 400, me).alias("upIntStart"), pick(F.col("ms"), me + 300).alias("upIntEnd"), pick(me, F.col("ms") - 400).alias("dnIntStart"), pick(me + 300, F.col("ms")).alias("dnIntEnd"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, date_diff('second', TIMESTAMP '2024-01-01', ts) // 86400 AS day, date_diff('second', TIMESTAMP '2024-01-01', ts) AS pos, CAST(floor(value) AS BIGINT) * 60 % 20000 + 1 AS n, event_id FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY pos, n) AS r FROM (SELECT DISTINCT user_id, day, pos, n FROM e)),
k AS (SELECT user_id, day, r, pos, pos + n AS stop, true AS kept FROM o WHERE r = 1 UNION ALL
SELECT o.user_id, o.day, o.r, o.pos, CASE WHEN o.pos >= k.stop THEN o.pos + o.n ELSE k.stop END, o.pos >= k.stop FROM k JOIN o ON o.user_id = k.user_id AND o.day = k.day AND o.r = k.r + 1)
SELECT user_id, day, pos FROM k WHERE kept"""
)
def non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice of variants that don't begin before the end of the last one kept, for each user and day."""
    t = seconds()
    e = read(spark, sf_dir, "events").select("user_id", F.floor(t / 86400).alias("day"), t.alias("pos"), (t + F.floor("value") * 60 % 20000 + 1).cast("long").alias("stop")).distinct()
    return scans.greedy_without_overlaps(e, ["user_id", "day"], "pos", "stop", ["stop"]).select("user_id", "day", "pos")


@query(
    "SELECT event_id, t + shift AS lifted FROM (SELECT event_id, date_diff('second', TIMESTAMP '2024-01-01', ts) AS t FROM events) LEFT JOIN (SELECT d * 86400 AS a, d * 86400 + 43199 AS b, d * 10 - 7 AS shift FROM generate_series(0, 30) g(d)) ON t BETWEEN a AND b"
)
def liftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions moved with the block of a chain that holds them; null between blocks."""
    points = read(spark, sf_dir, "events").select("event_id", F.lit("c").alias("chrom"), seconds().alias("pos"))
    d = F.col("id")
    blocks = spark.range(31).select(F.lit("c").alias("chrom"), (d * 86400).alias("block_start"), (d * 86400 + 43199).alias("block_end"), (d * 10 - 7).alias("shift"))
    return intervals.lift(points, blocks).select("event_id", "lifted")


@query(
    f"""WITH w AS ({_tiles_sql(50)}), s AS (SELECT *, CAST(doc_id % 20 AS INTEGER) AS p, CAST(25 + doc_id % 20 AS INTEGER) AS q FROM w),
m AS (SELECT doc_id, win, q, s, concat(substr(s, 1, p), 'GG', substr(s, p + 2)) AS one, concat(substr(s, 1, p), 'GG', substr(s, p + 2, q - p), substr(s, q + 4)) AS two FROM s WHERE length(s) > p)
SELECT doc_id, win, 'a' AS sample, one AS mutated, 1 AS shift FROM m
UNION ALL SELECT doc_id, win, 'b', CASE WHEN length(s) >= q + 3 THEN two ELSE one END, CASE WHEN length(s) >= q + 3 THEN -1 ELSE 1 END FROM m"""
)
def personal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the whole sequences with all variants of each sample: an insertion, and in one sample a deletion of
    two bases as well, in each window that is long enough."""
    s = _tiles(spark, sf_dir, 50).withColumnRenamed("s", "seq")
    w = s.select(F.struct("doc_id", "win").alias("event"), F.col("doc_id").cast("string").alias("chrom"), (F.col("win") + 100).alias("start"), "seq")
    p, q = F.col("doc_id") % 20, 25 + F.col("doc_id") % 20
    base = lambda at, n: F.col("seq").substr((at + 1).cast("int"), F.lit(n))
    record = lambda sample, at, ref, alt: F.struct(F.lit(sample).alias("sample"), (F.col("win") + at + 100).alias("pos"), ref.alias("ref"), alt.alias("alt"), (at + F.length(ref) <= F.length("seq")).alias("there"))
    records = F.array(record("a", p, base(p, 1), F.lit("GG")), record("b", p, base(p, 1), F.lit("GG")), record("b", q, base(q, 3), base(q, 1)))
    v = s.select(F.col("doc_id").cast("string").alias("chrom"), F.explode(records).alias("x")).select("chrom", "x.*").where("there and (alt = 'GG' or length(ref) = 3) and ref <> ''").drop("there")
    return genome.personal_windows(w, v).select("event.doc_id", "event.win", "sample", "mutated", "shift")


@query(
    f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS start, round(3 * log2(2.8), 6) AS score FROM (SELECT doc_id, {_LETTERS} AS s FROM documents), LATERAL unnest(generate_series(1, length(s) - 2)) AS t(i) WHERE substr(s, i, 3) = 'ATG'"
)
def matrix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a letter-probability matrix above a score."""
    s = _bases(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), F.col("s").alias("seq"))
    matrix = np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7], [0.1, 0.1, 0.7, 0.1]])
    hits = features.matrix_scan(s, {"atg": matrix}, 2.0)
    return hits.select(F.col("name").cast("long").alias("doc_id"), "start", F.round("score", 6).alias("score"))


@query(
    f"""WITH w AS (SELECT doc_id, substr(s, i, 2) AS kmer, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT doc_id, {_LETTERS} AS s FROM documents), LATERAL unnest(generate_series(1, length(s) - 1)) AS t(i))
SELECT kmer, CAST(pos // 5 AS BIGINT) AS bin, round(avg((doc_id % 7) + (pos + 0.5) * 0.25), 6) AS effect FROM w GROUP BY 1, 2"""
)
def motif_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean effect of a k-mer's positions, then of its occurrences, by bin of position."""
    s = _bases(spark, sf_dir, some=True).select(F.col("doc_id").alias("event"), F.lit("up").alias("region"), F.col("s").alias("seq"), F.lit(0).alias("first_pos"))
    effects = s.select("event", "region", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("rel_pos")).withColumn("delta", F.col("event") % 7 + F.col("rel_pos") * 0.25)
    heat = features.motif_heatmap(effects, s, 2, F.floor(F.col("pos") / 5))
    return heat.select("kmer", "bin", F.round("effect", 6).alias("effect"))


@query(
    f"""WITH w AS ({_tiles_sql(40)}), p AS (SELECT doc_id, win, s, CAST(i - 1 AS INTEGER) AS pos FROM w, LATERAL unnest(generate_series(1, length(s) - 1)) AS t(i))
SELECT a.doc_id, a.win, a.pos AS pos1, b.pos AS pos2, row_number() OVER (PARTITION BY a.doc_id, a.win ORDER BY a.pos, b.pos) - 1 AS j FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.win = b.win AND substr(a.s, a.pos + 1, 2) = 'AT' AND substr(b.s, b.pos + 1, 2) = 'CA' AND (a.pos + 2 <= b.pos OR b.pos + 2 <= a.pos)"""
)
def double_mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of changes within windows of 40 letters, which bound the pairs, of the whole sequences."""
    s = _tiles(spark, sf_dir, 40).select(F.struct("doc_id", "win").alias("window"), F.col("s").alias("seq"))
    return mutagenesis.double_changes(s, "window", "seq", ["AT", "CA"]).select("window.doc_id", "window.win", "pos1", "pos2", F.col("j").cast("long").alias("j"))


@query(
    f"""WITH {_EVENTS_SQL}, x AS (
SELECT id, 'up' AS region, CASE WHEN strand = '+' THEN ms - 20 + i ELSE ms + n + 19 - i END AS pos, 'up' || (i - 20) AS label FROM ev, generate_series(0, 19) g(i) UNION ALL
SELECT id, 'dn', CASE WHEN strand = '+' THEN ms + n + i ELSE ms - 1 - i END, 'dn+' || (i + 1) FROM ev, generate_series(0, 19) g(i) UNION ALL
SELECT id, 'ex', CASE WHEN strand = '+' THEN ms + i ELSE ms + n - 1 - i END, 'ex' || (i + 1) FROM ev, generate_series(0, 8) g(i) WHERE i < n UNION ALL
SELECT id, 'c1', CASE WHEN strand = '+' THEN ms - 400 - 20 + i ELSE ms + n + 300 + 19 - i END, 'c1' || CASE WHEN i < 20 THEN CAST(i - 20 AS VARCHAR) ELSE '+' || (i - 19) END FROM ev, generate_series(0, 39) g(i) UNION ALL
SELECT id, 'c2', CASE WHEN strand = '+' THEN ms + n + 300 - 20 + i ELSE ms - 400 + 19 - i END, 'c2' || CASE WHEN i < 20 THEN CAST(i - 20 AS VARCHAR) ELSE '+' || (i - 19) END FROM ev, generate_series(0, 39) g(i))
SELECT id, region, pos, label FROM x"""
)
def saturation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all windows of an event with labels in transcript order."""
    e = _events(spark, sf_dir)
    plus = F.col("strand") == "+"
    shaped = e.select(F.col("id").alias("event"), "strand", F.when(plus, F.col("upIntStart")).otherwise(F.col("upIntEnd")).alias("c1"), F.col("ms").alias("me_start"), (F.col("ms") + F.col("n")).alias("me_end"), F.when(plus, F.col("dnIntEnd")).otherwise(F.col("dnIntStart")).alias("c2"), F.lit(20).cast("long").alias("window"))
    return mutagenesis.region_labels(shaped).select(F.col("event").alias("id"), "region", "pos", "label")


@query(
    f"""WITH {_EVENTS_SQL}, p AS (SELECT *, ms - 4 + i AS pos FROM ev, generate_series(0, 16) g(i))
SELECT id, pos, CASE WHEN strand = '+' THEN CASE WHEN pos < ms THEN pos - ms WHEN pos >= ms + n THEN pos - ms - n WHEN pos - ms < ms + n - pos THEN pos - ms ELSE pos - ms - n END
ELSE CASE WHEN pos < ms THEN ms - pos - 1 WHEN pos >= ms + n THEN ms + n - pos - 1 WHEN ms + n - pos < pos - ms THEN ms + n - pos - 1 ELSE ms - pos - 1 END END AS distance,
CASE WHEN pos >= ms AND pos < ms + n THEN 'ex' WHEN (pos < ms) = (strand = '+') THEN 'up' ELSE 'dn' END AS region FROM p"""
)
def event_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("pos", F.explode(F.sequence(F.col("ms") - 4, F.col("ms") + 12)))
    return e.select("id", "pos", variants.event_distance(F.col("pos")).alias("d")).select("id", "pos", "d.distance", "d.region")


@query(f"WITH {_EVENTS_SQL} SELECT id, round((log10(CASE WHEN strand = '+' THEN 400 ELSE 300 END) - 2) / 0.5, 6) AS up_length, round(log10(CASE WHEN strand = '+' THEN 300 ELSE 400 END), 6) AS dn_length, round(log10(n), 6) AS exon_length FROM ev")
def length_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumnRenamed("id", "event")
    return features.lengths(e, {"up_length": (2.0, 0.5)}).select(F.col("event").alias("id"), *(F.round(c, 6).alias(c) for c in ("up_length", "dn_length", "exon_length")))


@query(f"WITH w AS ({_tiles_sql(30)}) SELECT doc_id, win, repeat('N', 5) || rpad(substr(s, 1, 15), 15, 'N') AS first, rpad(substr(s, 21, 20), 20, 'N') AS last FROM w")
def padded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that reach past the ends of the pieces of 30 letters that sequences are held in."""
    s = _tiles(spark, sf_dir, 30)
    cut = lambda a, b: sequence.padded_window("s", F.col("win"), F.col("win") + a, F.col("win") + b)
    return s.select("doc_id", "win", cut(-5, 15).alias("first"), cut(20, 40).alias("last"))


@query(
    f"WITH w AS (SELECT doc_id, win, rpad(s, 60, 'N') AS s FROM ({_tiles_sql(60)})) SELECT doc_id, win, CAST(b AS BIGINT) AS bin, max(CASE WHEN substr(s, 3 * b + j, 4) IN ('TATA', 'ATAT', 'ACAT') THEN 1 ELSE 0 END) AS present FROM w, generate_series(0, 18) g(b), generate_series(1, 3) h(j) WHERE 3 * b <= 54 GROUP BY 1, 2, 3"
)
def sliding_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding bins of windows of 60 letters, the last one filled up, of the whole sequences."""
    s = _tiles(spark, sf_dir, 60).withColumn("s", F.rpad("s", 60, "N"))
    bins = s.select("doc_id", "win", F.posexplode(enrichment.sliding_profile("s", ["TATA", "ATAT", "ACAT"], 60, 3)).alias("bin", "hit"))
    return bins.select("doc_id", "win", F.col("bin").cast("long").alias("bin"), F.col("hit").cast("int").alias("present"))


@query(
    f"WITH a AS ({ANNOTATE_SQL}) SELECT count(*) AS n_rows, count(*) FILTER (prediction_status = 'FOUND') AS found, count(*) FILTER (prediction_status LIKE 'NA%') AS missing, count(*) FILTER (prediction_status LIKE 'ERROR%') AS errors, count(DISTINCT window_id) AS windows FROM a"
)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run in one aggregate."""
    s = F.col("prediction_status")
    counts = [F.count("*").alias("n_rows"), F.count_if(s == "FOUND").alias("found"), F.count_if(s.startswith("NA")).alias("missing"), F.count_if(s.startswith("ERROR")).alias("errors"), F.countDistinct("window_id").alias("windows")]
    return annotate_windows(spark, sf_dir).agg(*counts)
