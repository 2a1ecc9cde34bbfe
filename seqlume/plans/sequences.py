"""Sequence and text queries on the driver's documents, events and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlume.functions import sequence
from seqlume.operators import enrichment, mutagenesis
from seqlume.operators.anchored import apply_anchored as anchored
from seqlume.operators.ml import train_and_predict
from seqlume.operators.scan import PATTERNS, findings

from .base import query, read

_LETTERS = "regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGT]', '', 'g')"


def _bases(spark: SparkSession, sf_dir: str, some: bool = False) -> DataFrame:
    """The letters A, C, G and T of each document, as a stand-in for a genome; with some, of documents that have any,
    which a look at the text tells before its letters are taken out."""
    docs = read(spark, sf_dir, "documents")
    docs = docs.where(F.col("text").rlike("[ACGTacgt]")) if some else docs
    return docs.select("doc_id", F.upper(F.regexp_replace("text", "[^ACGTacgt]+", "")).alias("s"))


def _tiles_sql(n: int) -> str:
    return f"SELECT doc_id, CAST({n} * i AS BIGINT) AS win, substr(s, {n} * i + 1, {n}) AS s FROM (SELECT doc_id, {_LETTERS} AS s FROM documents), LATERAL unnest(generate_series(0, (length(s) - 1) // {n})) AS t(i) WHERE length(s) > 0"


def _tiles(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Each sequence in windows of n letters side by side, the last one shorter: (doc_id, win, s)."""
    pieces = F.regexp_extract_all("s", F.lit(f".{{1,{n}}}"), 0)
    return _bases(spark, sf_dir).select("doc_id", F.posexplode(pieces).alias("i", "s")).select("doc_id", (F.col("i") * F.lit(n)).cast("long").alias("win"), "s")


@query(f"SELECT doc_id, reverse(translate({_LETTERS}, 'ACGTN', 'TGCAN')) AS rc FROM documents")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bases(spark, sf_dir).select("doc_id", sequence.reverse_complement("s").alias("rc"))


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN round((length(text) - length(translate(text, 'GCgc', ''))) / length(text), 6) END AS gc FROM documents")
def gc_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.round(sequence.fraction_of("text", "GCgc"), 6).alias("gc"))


@query(
    f"SELECT k AS kmer, count(*) AS n FROM (SELECT substr(s, i, 4) AS k FROM (SELECT {_LETTERS} AS s FROM documents), LATERAL unnest(generate_series(1, length(s) - 3)) AS t(i)) GROUP BY 1"
)
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.kmer_counts(_bases(spark, sf_dir), "s", 4)


@query(
    f"SELECT doc_id, count(*) FILTER (substr(s, i, 3) IN ('TAC', 'TAT')) AS tay, count(*) FILTER (substr(s, i, 2) = 'AA') AS aa FROM (SELECT doc_id, {_LETTERS} AS s FROM documents), LATERAL unnest(generate_series(1, greatest(length(s), 1))) AS t(i) GROUP BY 1"
)
def motif_overlap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bases(spark, sf_dir).select("doc_id", sequence.motif_count("s", "TAY").cast("long").alias("tay"), sequence.motif_count("s", "AA").cast("long").alias("aa"))


@query(
    f"WITH w AS ({_tiles_sql(60)}) SELECT doc_id, CAST(win // 10 + i AS BIGINT) AS bin, max(CASE WHEN substr(s, 10 * i + j, 3) IN ('ATT', 'TTA', 'CAT') THEN 1 ELSE 0 END) AS present FROM w, LATERAL unnest(generate_series(0, length(s) // 10 - 1)) AS t(i), LATERAL unnest(generate_series(1, 8)) AS u(j) GROUP BY 1, 2"
)
def motif_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each full bin of ten letters of the whole sequence holds one of some 3-mers."""
    bins = _tiles(spark, sf_dir, 60).select("doc_id", "win", F.posexplode(enrichment.motif_profile("s", ["ATT", "TTA", "CAT"], 10)).alias("bin", "hit"))
    return bins.select("doc_id", (F.floor(F.col("win") / 10) + F.col("bin")).alias("bin"), F.col("hit").cast("int").alias("present"))


@query(
    f"""WITH k AS (SELECT substr(s, i, 3) AS kmer, quality FROM (SELECT {_LETTERS} AS s, quality FROM documents JOIN labels USING (doc_id)), LATERAL unnest(generate_series(1, length(s) - 2)) AS t(i)),
c AS (SELECT kmer, count(*) FILTER (quality = 1) AS fg_count, count(*) FILTER (quality = 0) AS bg_count FROM k GROUP BY 1)
SELECT kmer, fg_count, bg_count, CAST(sum(fg_count) OVER () AS BIGINT) AS fg_total, CAST(sum(bg_count) OVER () AS BIGINT) AS bg_total FROM c"""
)
def kmer_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bases(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").withColumn("fg", F.col("quality") == 1)
    return enrichment.contingency(rows, "s", 3, "fg")


@query()
def kmer_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided Fisher tests of every k-mer's counts; tests hold them against exact sums."""
    return enrichment.fisher(kmer_contingency(spark, sf_dir))


@query(
    f"SELECT doc_id, pos, ref, alt FROM (SELECT doc_id, CAST(i AS INTEGER) - 1 AS pos, substr(s, i, 1) AS ref FROM (SELECT doc_id, {_LETTERS} AS s FROM documents), LATERAL unnest(generate_series(1, length(s))) AS t(i)), (VALUES ('A'), ('C'), ('G'), ('T')) v(alt) WHERE alt <> ref"
)
def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every substitution of every sequence."""
    return mutagenesis.substitutions(_bases(spark, sf_dir), "s").select("doc_id", "pos", "ref", "alt")


@query(f"WITH w AS ({_tiles_sql(30)}) SELECT doc_id, win, concat(substr(s, 1, 5), 'TTT', substr(s, 7)) AS mutated FROM w WHERE length(s) >= 6")
def apply_single_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixth letter of every window that has one becomes TTT."""
    w = _tiles(spark, sf_dir, 30).where("length(s) >= 6")
    return w.select("doc_id", "win", sequence.splice("s", F.lit(5), F.substring("s", 6, 1), F.lit("TTT")).alias("mutated"))


@query()
def apply_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-changing variants on windows with a fixed position; tests hold it against a plain version.

    Windows of 60 letters every 30 letters, and one at the end, go over the whole sequence; each gives its letters 20 to 50.
    """
    s = _bases(spark, sf_dir).where("length(s) >= 60")
    last = F.length("s") - 60
    at = F.array_union(F.sequence(F.lit(0), last, F.lit(30)), F.array(last))
    s = s.select("doc_id", "s", F.explode(at).alias("at")).select("doc_id", F.col("at").cast("long").alias("at"), F.expr("substr(s, at + 1, 60)").alias("s"))
    first = F.col("at")
    change = F.array(F.struct((first + 25).alias("pos"), F.expr("substr(s, 26, 3)").alias("ref"), F.expr("substr(s, 26, 1)").alias("alt")), F.struct((first + 40).alias("pos"), F.expr("substr(s, 41, 1)").alias("ref"), F.concat(F.expr("substr(s, 41, 1)"), F.lit("AC")).alias("alt")))
    rows = s.select("doc_id", F.col("s").alias("seq"), first.alias("seq_start"), (first + 20).alias("start"), (first + 50).alias("end"), (first + 30).alias("anchor"), F.lit("+").alias("strand"), change.alias("variants"))
    return anchored(rows).select("doc_id", F.col("seq_start").alias("at"), "mutated")


@query(
    "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '/([a-z][a-z])/', 1) AS lang, try_cast(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER) AS number FROM pages"
)
def parse_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of composite names."""
    x = lambda p: F.regexp_extract("url", p, 1)
    return read(spark, sf_dir, "pages").select("page_id", x("^[a-z]+://([^/?#]+)").alias("host"), x("/([a-z][a-z])/").alias("lang"), x("/([0-9]+)").try_cast("int").alias("number"))


@query(
    "SELECT event_id, split_part(v, ':', 1) AS chrom, CAST(split_part(v, ':', 2) AS BIGINT) - 1 AS pos0, split_part(v, ':', 3) AS ref, split_part(v, ':', 4) AS alt FROM (SELECT event_id, 'chr' || user_id || ':' || (event_id + 1) || ':A:' || upper(substr(event_type, 1, 2)) AS v FROM events)"
)
def parse_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(":", F.concat(F.lit("chr"), F.col("user_id")), F.col("event_id") + 1, F.lit("A"), F.upper(F.substring("event_type", 1, 2)))
    return read(spark, sf_dir, "events").select("event_id", sequence.parse_variant(text).alias("v")).select("event_id", "v.*")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN CAST(event_id AS VARCHAR) WHEN user_id % 3 = 1 THEN CAST(user_id AS VARCHAR) ELSE '.' END AS af FROM events")
def info_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of an INFO text, with a second name to fall back on and one value per allele."""
    e = read(spark, sf_dir, "events")
    joint = F.concat(F.lit("AC=4,5;AF_joint=9,"), F.col("event_id"), F.lit(";DB"))
    info = F.when(F.col("user_id") % 3 == 0, joint).when(F.col("user_id") % 3 == 1, F.concat(F.lit("AF="), F.col("user_id"))).otherwise("AN=3")
    return e.select("event_id", sequence.info_value(info, ["AF_joint", "AF"], 2).alias("af"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query(
    "SELECT doc_id, CASE WHEN length(ref) = 1 AND length(alt) = 1 AND regexp_full_match(ref, '[ACGT]') AND regexp_full_match(alt, '[ACGT]') AND ref <> alt THEN 'SNV' WHEN regexp_full_match(ref, '[ACGTN]+') AND regexp_full_match(alt, '[ACGTN]+') AND length(ref) <> length(alt) THEN 'Indel' ELSE 'Unsupported' END AS var_type FROM (SELECT doc_id, upper(substr(regexp_replace(text, '[^A-Za-z]', '', 'g'), 1, 1)) AS ref, substr(upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')), 1, CAST(1 + doc_id % 2 AS INTEGER)) AS alt FROM documents)"
)
def classify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.upper(F.substring(F.regexp_replace("text", "[^A-Za-z]", ""), 1, 1))
    alt = F.substring(F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")), F.lit(1), (1 + F.col("doc_id") % 2).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", sequence.variant_type(ref, alt).alias("var_type"))


@query(
    """WITH s AS (SELECT lang, doc_id // 100 AS cut, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2),
n AS (SELECT lang, count(*) AS n_rows, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1)
SELECT lang, sha256(string_agg(h, '' ORDER BY cut)) AS sha256, any_value(n_rows) AS n_rows, any_value(n_sources) AS n_sources FROM s JOIN n USING (lang) GROUP BY 1"""
)
def manifest_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each part's rows in two levels, their number and that of their sources."""
    from seqlume.operators.bundle import manifest

    docs = read(spark, sf_dir, "documents").select("lang", "doc_id", "source", "text")
    return manifest(docs, "lang", "doc_id", "text", {"n_rows": F.count("*"), "n_sources": F.countDistinct("source")}, stretch=100)


@query(
    "SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in PATTERNS.items()) + " FROM documents"
)
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(read(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


@query()
def gbt_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on composition features of documents; tests check held-out quality."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    signs = {"bars": "|", "marks": "#*$%&", "vowels": "aeiou", "blanks": " ", "lines": "\n"}  # names with signs would not compile
    features = {f"share_{n}": F.coalesce(sequence.fraction_of("text", x), F.lit(0.0)) for n, x in signs.items()}
    rows = docs.withColumns(features).drop("text").join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return train_and_predict(rows, "doc_id", list(features))
