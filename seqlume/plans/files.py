"""Block-compressed files written from the driver's tables and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlume.operators import liftover, scan
from seqlume.sources import archives, blocks, staging, writers

from .base import query, read

_ROWS = "SELECT 'chr' || CAST(1 + event_id % 4 AS VARCHAR(9)) AS chrom, 1 + (event_id * 7919) % 1000000 AS pos, 'e' || CAST(event_id AS VARCHAR(20)) AS id, substr('ACGTACGTACGT', CAST(1 + event_id % 4 AS INT), CAST(1 + event_id % 9 AS INT)) AS ref, 'T' AS alt, CASE WHEN event_id % 5 = 0 THEN 'q10' ELSE 'PASS' END AS filter, user_id FROM events"


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder of block-compressed, indexed parts with a record for each event."""
    rows = spark.sql(_ROWS.replace("FROM events", "FROM {events}"), events=read(spark, sf_dir, "events")).withColumn("qual", F.lit("."))
    path = staging.new_folder(spark, "events-vcf")
    info = {"U": ("1", "Integer", "User"), "L": ("1", "Integer", "Letters of REF")}
    blocks.write_vcf_blocks(rows, path, {"U": F.col("user_id"), "L": F.length("ref")}, writers.vcf_header([f"chr{i}" for i in range(1, 5)], info))
    return path


@query(f"SELECT chrom, pos, id, ref, alt, filter, 'U=' || user_id || ';L=' || length(ref) AS info FROM ({_ROWS}) v")
def blocked_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the events' files, read in stretches that begin and end inside blocks and lines."""
    rows = blocks.read_vcf_blocks(spark, _written(spark, sf_dir), split_bytes=50_000)
    return rows.select("chrom", "pos", "id", "ref", "alt", "filter", "info")


@query(f"SELECT chrom, pos, id, ref FROM ({_ROWS}) v WHERE chrom = 'chr3' AND pos <= 600000 AND pos + length(ref) > 250000")
def vcf_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that reach into a region, by the files' indexes."""
    return blocks.read_vcf_blocks(spark, _written(spark, sf_dir), region="chr3:250,000-600,000").select("chrom", "pos", "id", "ref")


#: Chains from suppliers, every second one reversed; every seventh is there twice, and on every fourth another follows at once.
_CHAINS = """SELECT s_suppkey AS k, 3 * s_suppkey + v AS chain, 'chr' || CAST(s_suppkey % 5 AS VARCHAR(9)) AS chrom, 10000 * s_suppkey + CASE WHEN v = 2 THEN 6100 + s_suppkey % 50 ELSE 0 END AS t, 2000 + s_suppkey % 50 AS second,
'new' || CAST((s_suppkey + v) % 3 AS VARCHAR(9)) AS to_chrom, (s_suppkey + v) % 2 = 1 AS rev, 20000 * s_suppkey + 7 + 7000 * v AS q FROM supplier, (VALUES (0), (1), (2)) x(v) WHERE v = 0 OR (v = 1 AND s_suppkey % 7 = 0) OR (v = 2 AND s_suppkey % 4 = 1)"""
_ASKED = "SELECT event_id, 'chr' || CAST((1 + event_id % 90) % 5 AS VARCHAR(9)) AS chrom, 10000 * (1 + event_id % 90) + (event_id * 37) % 7000 AS a, 1 + (event_id * 11) % 900 AS n FROM events"
_SIZE = 100_000_000


@query(
    f"""WITH c AS ({_CHAINS}), b AS (SELECT chain, chrom, to_chrom, rev, t + dt AS s, q + dq AS w, size FROM (
  SELECT *, 0 AS dt, 0 AS dq, 3000 AS size FROM c UNION ALL SELECT *, 3100, 3050, second FROM c UNION ALL SELECT *, 3100 + second, 3050 + second + 30, 1000 FROM c)),
m AS (SELECT event_id, n, b.*, greatest(a, s) AS low, least(a + n, s + size) - 1 AS high FROM ({_ASKED}) e JOIN b ON b.chrom = e.chrom AND a < s + size AND a + n > s),
p AS (SELECT *, CASE WHEN rev THEN {_SIZE} - 1 - (w + high - s) ELSE w + low - s END AS x, CASE WHEN rev THEN {_SIZE} - 1 - (w + low - s) ELSE w + high - s END AS y FROM m),
h AS (SELECT event_id, n, chain, to_chrom, sum(high - low + 1) AS bases, min(x) AS x, max(y) AS y FROM p GROUP BY 1, 2, 3, 4),
o AS (SELECT event_id, count(*) FILTER (bases >= 0.95 * n) AS fits, sum(bases) >= 0.95 * any_value(n) AS together, max(to_chrom) FILTER (bases >= 0.95 * n) AS to_chrom, max(x) FILTER (bases >= 0.95 * n) AS x, max(y) FILTER (bases >= 0.95 * n) AS y FROM h GROUP BY 1),
r AS (SELECT e.event_id, CASE WHEN fits = 1 THEN 'mapped' WHEN fits > 1 THEN 'duplicated' WHEN together THEN 'split' WHEN o.event_id IS NOT NULL THEN 'partial' ELSE 'deleted' END AS outcome, o.to_chrom, x, y FROM ({_ASKED}) e LEFT JOIN o USING (event_id))
SELECT event_id, outcome, CASE WHEN outcome = 'mapped' THEN to_chrom END AS to_chrom, CASE WHEN outcome = 'mapped' THEN x END AS to_start, CASE WHEN outcome = 'mapped' THEN y + 1 END AS to_end FROM r"""
)
def lift_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals lifted with a chain file that is written from suppliers and read again."""
    c = spark.sql(_CHAINS.replace("FROM supplier", "FROM {supplier}"), supplier=read(spark, sf_dir, "supplier"))
    end = F.col("t") + 4100 + F.col("second")
    head = F.concat_ws(" ", F.lit("chain"), F.lit(1000), "chrom", F.lit(_SIZE), F.lit("+"), "t", end, "to_chrom", F.lit(_SIZE), F.when(F.col("rev"), "-").otherwise("+"), "q", F.col("q") + 4080 + F.col("second"), "chain")
    lines = F.concat_ws("\n", F.lit("## chains"), head, F.lit("3000\t100\t50"), F.concat("second", F.lit("\t0\t30")), F.lit("1000"), F.lit(""))
    path = staging.new_folder(spark, "chains")
    c.select(lines.alias("value")).write.text(path)
    asked = spark.sql(_ASKED.replace("FROM events", "FROM {events}"), events=read(spark, sf_dir, "events")).select("event_id", "chrom", F.col("a").alias("start"), (F.col("a") + F.col("n")).alias("end"))
    return liftover.lift_intervals(asked, liftover.chains(spark, path), "event_id", width=2000).drop("reversed")


_LINES = "SELECT doc_id % 7 AS pile, replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ') AS line FROM documents"


@query("SELECT pile, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, " + ", ".join(f"bool_or(regexp_matches(line, '{p}')) AS {n}" for n, p in scan.PATTERNS.items()) + f" FROM ({_LINES}) d GROUP BY 1")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What gzip files hold that are written from the documents, in piles, found in overlapping chunks of 64 KB."""
    path = staging.new_folder(spark, "piles")
    lines = spark.sql(_LINES.replace("FROM documents", "FROM {documents}").replace("chr(10)", "char(10)").replace("chr(13)", "char(13)"), documents=read(spark, sf_dir, "documents"))
    lines.select("pile", F.col("line").alias("value")).write.partitionBy("pile").option("compression", "gzip").text(path)
    texts = archives.archive_texts(spark, path, chunk=65_536).where("path like '%.gz'")
    found = scan.archive_findings(texts).withColumn("pile", F.regexp_extract("path", "pile=([0-9]+)", 1).cast("long"))
    return found.groupBy("pile").agg(F.sum("n_bytes").alias("n_bytes"), *(F.bool_or(n).alias(n) for n in scan.PATTERNS))
