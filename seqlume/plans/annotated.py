"""The annotation of variants as a registered query: VCF-shaped rows from events, microexons from suppliers.

Suppliers give events on five chromosomes, half of them reversed, with wild types, scales and substitution scores,
some of which are missing; the driver's events give variants around them: substitutions, several alleles, insertions,
symbolic and missing alleles, with and without the contigs' prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlume.operators import variants

from .base import query, read, tasks

#: Fixed expressions of the stand-in tables, which Spark and DuckDB read alike.
_VCF = """SELECT event_id AS rec_ord, k, (CASE WHEN event_id % 2 = 0 THEN '' ELSE 'chr' END) || CAST(1 + k % 5 AS VARCHAR(9)) AS chrom, 10000 * k + 501 + (event_id * 37) % 1000 AS pos,
CASE WHEN event_id % 3 > 0 THEN 'rs' || CAST(event_id AS VARCHAR(20)) END AS id, ref,
CASE event_id % 7 WHEN 0 THEN one || ',' || two WHEN 1 THEN '<DEL>' WHEN 2 THEN ref || 'T' WHEN 3 THEN '.' ELSE one END AS alt
FROM (SELECT event_id, 1 + event_id % 100 AS k, substr('ACGT', CAST(1 + event_id % 4 AS INT), 1) AS ref, substr('CGTA', CAST(1 + event_id % 4 AS INT), 1) AS one, substr('GTAC', CAST(1 + event_id % 4 AS INT), 1) AS two FROM events) x"""
_INDELS = f"""SELECT DISTINCT 'chr' || CAST(1 + k % 5 AS VARCHAR(9)) || ':' || CAST(pos AS VARCHAR(20)) || ':' || ref || ':' || alt AS variant, 'E' || CAST(k AS VARCHAR(20)) AS event, CASE WHEN rec_ord % 4 < 2 THEN 'up' ELSE 'dn' END AS var_MIC_region,
CAST(rec_ord % 50 AS VARCHAR(9)) AS MIC_dist, '0.6' AS mt_code_score, '0.8' AS wt_code_score, '2' AS logit_scaling_factor, '-0.5' AS delta_code_model, '4' AS logit_scaling_factor_all_vars, '-0.25' AS delta_code_model_all_vars FROM ({_VCF}) v WHERE rec_ord % 21 = 9"""

ANNOTATE_VARIANTS_SQL = f"""
WITH ev AS (SELECT s_suppkey AS k, 'E' || s_suppkey AS event, 'chr' || (1 + s_suppkey % 5) AS chrom, s_suppkey % 2 = 0 AS plus, 10000 * s_suppkey + 1000 AS ms, 3 + s_suppkey % 7 AS n, 10000 * s_suppkey + 1002 + s_suppkey % 7 AS me FROM supplier),
g AS (SELECT *, CASE WHEN plus THEN ms - 400 ELSE me + 301 END AS c1, CASE WHEN plus THEN me + 301 ELSE ms - 400 END AS c2 FROM ev),
w AS (SELECT *, 'c1' AS region, c1 - 300 AS a, c1 + 299 AS b FROM g UNION ALL SELECT *, 'c2', c2 - 300, c2 + 299 FROM g UNION ALL SELECT *, 'ex', ms, me FROM g
  UNION ALL SELECT *, CASE WHEN plus THEN 'up' ELSE 'dn' END, ms - 300, ms - 1 FROM g UNION ALL SELECT *, CASE WHEN plus THEN 'dn' ELSE 'up' END, me + 1, me + 300 FROM g),
vcf AS ({_VCF}), raw AS (SELECT rec_ord, 'chr' || replace(chrom, 'chr', '') AS chrom, pos, id, ref, unnest(string_split(alt, ',')) AS alt, generate_subscripts(string_split(alt, ','), 1) - 1 AS alt_ord FROM vcf WHERE alt <> '.'),
q AS (SELECT *, chrom || ':' || pos || ':' || ref || ':' || alt AS variant, CASE WHEN length(alt) = 1 THEN 'SNV' WHEN alt = '<DEL>' THEN 'Unsupported' ELSE 'Indel' END AS var_type, pos - 1 AS p FROM raw),
ind AS ({_INDELS}),
h AS (SELECT q.*, w.* EXCLUDE (chrom) FROM q JOIN w ON w.chrom = q.chrom AND p BETWEEN a AND b),
x AS (SELECT q.*, w.* EXCLUDE (chrom) FROM q JOIN ind USING (variant) JOIN w ON w.event = ind.event AND w.region = ind.var_MIC_region WHERE var_type = 'Indel' AND NOT p BETWEEN a AND b),
r AS (SELECT *, CASE region WHEN 'c1' THEN CASE WHEN plus THEN p - c1 ELSE c1 - p END WHEN 'c2' THEN CASE WHEN plus THEN p - c2 ELSE c2 - p END WHEN 'up' THEN CASE WHEN plus THEN p - ms ELSE me - p END
    WHEN 'ex' THEN CASE WHEN plus THEN p - ms + 1 ELSE me - p + 1 END ELSE CASE WHEN plus THEN p - me ELSE ms - p END END AS rel_pos,
  CASE region WHEN 'c1' THEN p - c1 WHEN 'c2' THEN p - c2 WHEN 'up' THEN CASE WHEN plus THEN p - ms ELSE me - p END
    WHEN 'ex' THEN CASE WHEN plus THEN p - ms + 2 ELSE me - p + 2 END ELSE CASE WHEN plus THEN p - me - 1 ELSE ms - p - 1 END END AS shown FROM (SELECT * FROM h UNION ALL SELECT * FROM x)),
s AS (SELECT r.*, i.MIC_dist AS i_dist, i.mt_code_score AS i_mt, i.wt_code_score AS i_wt, CASE WHEN k % 10 <> 3 THEN '0.' || lpad(CAST(1 + k % 97 AS VARCHAR), 2, '0') END AS wt, CASE WHEN k % 10 <> 4 THEN 3.0 + k % 4 END AS scale,
  CASE WHEN abs(rel_pos) <= 60 AND alt = translate(ref, 'ACGT', 'CGTA') THEN '0.' || lpad(CAST(1 + (k * 7 + abs(rel_pos) * 3) % 97 AS VARCHAR), 2, '0') END AS mt
  FROM r LEFT JOIN ind i ON i.variant = r.variant AND i.event = r.event AND i.var_MIC_region = r.region),
t AS (SELECT *, CASE WHEN var_type = 'Unsupported' THEN 'ERROR_UNSUPPORTED_ALLELE' WHEN var_type = 'SNV' AND mt IS NOT NULL AND wt IS NOT NULL AND scale IS NOT NULL OR var_type = 'Indel' AND i_mt IS NOT NULL THEN 'FOUND' ELSE 'NA_NOT_PRECOMPUTED' END AS status FROM s),
u AS (SELECT *, status = 'FOUND' AS ok, var_type = 'SNV' AS snv, status LIKE 'ERROR%' AS failed FROM t)
SELECT rec_ord, alt_ord, variant, 'GENE' || k AS gene, event, region, var_type, chrom || '_' || (CASE WHEN plus THEN '+' ELSE '-' END) || '_' || ms || '_' || (me + 1) AS me_id, CASE WHEN k % 3 = 0 THEN 'new_mic' ELSE 'known_mic' END AS mic_group,
  CASE WHEN ok AND NOT snv THEN i_dist ELSE CAST(shown AS VARCHAR) END AS distance, CASE WHEN failed THEN 'ERROR' WHEN ok AND snv THEN mt WHEN ok THEN i_mt ELSE 'NA' END AS mt, CASE WHEN failed THEN 'ERROR' WHEN ok AND snv THEN wt WHEN ok THEN i_wt ELSE 'NA' END AS wt,
  CAST(CASE WHEN failed THEN NULL WHEN snv THEN scale WHEN ok THEN 4 END AS DOUBLE) AS scale, CAST(CASE WHEN ok AND snv THEN round((log2(CAST(mt AS DOUBLE) / (1 - CAST(mt AS DOUBLE))) - log2(CAST(wt AS DOUBLE) / (1 - CAST(wt AS DOUBLE)))) / scale, 6) WHEN ok THEN -0.25 END AS DOUBLE) AS delta,
  status, CASE WHEN var_type = 'Unsupported' THEN 'NOT_RUN' ELSE 'NA' END AS ref_ok, coalesce(id, '.') AS vcf_id FROM u
"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The stand-in tables in the shape that variants.annotate takes."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    plus, ms, me = k % 2 == 0, 10000 * k + 1000, 10000 * k + 1003 + k % 7
    pick = lambda a, b: F.when(plus, a).otherwise(b).cast("long")
    event = F.concat(F.lit("E"), k)
    events = s.select(
        event.alias("event"), F.concat(F.lit("chr"), 1 + k % 5).alias("chrom"), F.when(plus, "+").otherwise("-").alias("strand"),
        pick(ms - 400, me).alias("upIntStart"), pick(ms, me + 300).alias("upIntEnd"), pick(me, ms - 400).alias("dnIntStart"), pick(me + 300, ms).alias("dnIntEnd"),
        F.concat(F.lit("GENE"), k).alias("geneName"), (3 + k % 7).cast("int").alias("lengthDiff"), F.when(k % 3 == 0, "novel_mic").otherwise("known_mic").alias("group"),
    )
    hundredth = lambda n: F.concat(F.lit("0."), F.lpad(n.cast("string"), 2, "0"))
    at = s.repartition(tasks(spark), "s_suppkey").select(k, F.explode(F.array(*map(F.lit, ("c1", "up", "ex", "dn", "c2")))).alias("region")).withColumn("rel_pos", F.explode(F.sequence(F.lit(-60), F.lit(60))))
    ism = at.withColumn("ref", F.explode(F.array(*map(F.lit, "ACGT")))).select(
        event.alias("event"), F.when(k % 2 == 0, F.upper("region")).otherwise(F.col("region")).alias("region"), "rel_pos", F.when(k % 3 == 0, F.lower("ref")).otherwise(F.col("ref")).alias("ref"), F.translate("ref", "ACGT", "CGTA").alias("alt"), hundredth(1 + (k * 7 + F.abs("rel_pos") * 3) % 97).alias("mt_score")
    )
    wild_type = s.where(k % 10 != 3).select(event.alias("event"), hundredth(1 + k % 97).alias("wt_score"))
    scaling = s.where(k % 10 != 4).select(event.alias("event"), (2.0 + k % 3).alias("logit_scaling_factor"), (3.0 + k % 4).alias("logit_scaling_factor_all_vars"))
    source = read(spark, sf_dir, "events")
    vcf = spark.sql(_VCF.replace("FROM events", "FROM {events}"), events=source)
    indels = spark.sql(_INDELS.replace("FROM events", "FROM {events}"), events=source)
    return {"vcf": vcf.drop("k"), "events": events, "wild_type": wild_type, "ism": ism, "scaling": scaling, "indels": indels}


@query(ANNOTATE_VARIANTS_SQL)
def annotate_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant in every window of an event, and indels by their table, with scores and a status."""
    rows = variants.annotate(**tables(spark, sf_dir))
    number = lambda c: F.col(c).try_cast("double")
    return rows.select(
        "rec_ord", "alt_ord", "variant", F.col("geneName").alias("gene"), "event", F.col("var_MIC_region").alias("region"), "var_type", F.col("`ME-ID`").alias("me_id"), F.col("MIC_group").alias("mic_group"),
        F.col("MIC_dist").alias("distance"), F.col("mt_code_score").alias("mt"), F.col("wt_code_score").alias("wt"), number("logit_scaling_factor").alias("scale"), F.round(number("delta_code_model"), 6).alias("delta"),
        F.col("prediction_status").alias("status"), "ref_ok", F.col("VCF_ID").alias("vcf_id"),
    )
