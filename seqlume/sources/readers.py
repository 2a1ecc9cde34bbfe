"""Readers of delimited tables, VCF, BED, FASTA, motif and matrix files; schemas are always declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlume.operators import groups

VCF = "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string"
BED6 = "chrom string, start long, end long, name string, score string, strand string"


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """The table; an error that names the missing columns. Further columns are tolerated."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")
    return df


def table(spark: SparkSession, path, columns: list[str] | None = None, separator: str = ",") -> DataFrame:
    """A delimited file with a header; all columns text, as they stand."""
    head = spark.read.option("header", True).option("sep", separator).option("inferSchema", False).option("nullValue", "\u0000").csv(path)
    return require_columns(head, columns or [], str(path))


def typed(df: DataFrame, schema: str) -> DataFrame:
    """Columns of the schema, cast where the text allows it; "", "NA" and "." become null."""
    out = []
    for f in T._parse_datatype_string(schema).fields:
        c = F.when(~F.trim(f"`{f.name}`").isin("", "NA", "."), F.trim(f"`{f.name}`"))
        out.append((c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name))
    return df.select(*out)


def vcf(spark: SparkSession, path, samples: list[str] = ()) -> DataFrame:
    """Records of VCF text (gz too), without header lines; samples: names of the columns after FORMAT."""
    schema = VCF + (", format string" + "".join(f", `{s}` string" for s in samples) if samples else "")
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)


def bed(spark: SparkSession, path, schema: str = BED6) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)


def id_list(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id != ''")


def lines(spark: SparkSession, paths) -> DataFrame:
    """(path, line, value): the lines of text files, numbered from 0 in each file.

    Files are split as Spark splits them. A line's place is its block's place in the file and its order within the
    block; where a stretch of lines begins is carried over the stretches, so no task holds a file.
    """
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value", F.lit(1).alias("_one"))
    return groups.carried_sums(text, ["path"], ["_block", "_at"], {"line": "_one"}).select("path", "line", "value")


def fasta(spark: SparkSession, path, lower: bool = False) -> DataFrame:
    """Rows (name, seq): the header up to its first blank, and the lines after it put together."""
    records = spark.read.option("lineSep", ">").text(path).where("trim(value) != ''")
    parts = F.split("value", "\r?\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")
    return records.select(F.regexp_extract(F.get(parts, F.lit(0)), r"^(\S*)", 1).alias("name"), (F.lower(seq) if lower else seq).alias("seq"))


def chunks(sequences: DataFrame, size: int = 100_000, overlap: int = 1_000) -> DataFrame:
    """(chrom, chunk_start, seq): pieces at every `size` bases that reach `overlap` bases further, for joins by place."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.length("seq") - 1, F.lit(0)).cast("long"), F.lit(size).cast("long"))
    return sequences.select(F.col("name").alias("chrom"), F.explode(starts).alias("chunk_start"), "seq").select("chrom", "chunk_start", F.col("seq").substr((F.col("chunk_start") + 1).cast("int"), F.lit(size + overlap)).alias("seq"))


def keyed_files(spark: SparkSession, paths, schema: str, pattern: str, key: str, separator: str = ",") -> DataFrame:
    """Several files as one table, with a key taken from each file's name."""
    rows = spark.read.schema(schema).option("header", True).option("sep", separator).csv(paths)
    return rows.withColumn(key, F.regexp_extract("_metadata.file_name", pattern, 1))


def file_names(spark: SparkSession, pattern: str, names: dict[str, str]) -> DataFrame:
    """Files that fit a glob as rows, with columns taken from their paths by patterns."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    return files.select("path", *(F.regexp_extract("path", p, 1).alias(n) for n, p in names.items()))


def markov_matrix(spark: SparkSession, path, positions: int = 9) -> dict[str, list[float]]:
    """word -> a probability for each position; a file of at most 4 + 16 + 64 words."""
    schema = "word string, " + ", ".join(f"p{i} double" for i in range(positions))
    rows = spark.read.schema(schema).option("sep", "\t").csv(path).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError(f"{path} has more words than a matrix of this kind")
    return {r[0].lower(): list(r[1:]) for r in rows if r[0]}


def motifs(spark: SparkSession, path) -> DataFrame:
    """(motif_id, motif_alt_id, row, probabilities) of a MEME text file; rows of a motif count from 0."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    w = Window.partitionBy("file").orderBy("n")
    marked = lines.withColumn("motif", F.last(F.when(F.col("line").startswith("MOTIF"), F.col("line")), True).over(w))
    rows = marked.where(F.col("motif").isNotNull() & F.col("line").rlike(r"^\s*[0-9.eE+-]+(\s+[0-9.eE+-]+){3}\s*$"))
    names = F.split("motif", r"\s+")
    number = F.row_number().over(Window.partitionBy("file", "motif").orderBy("n")) - 1
    return rows.select(F.get(names, F.lit(1)).alias("motif_id"), F.coalesce(F.get(names, F.lit(2)), F.lit("")).alias("motif_alt_id"), number.alias("row"), F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double")).alias("probabilities"))


def two_bit(spark: SparkSession, path, size: int = 100_000, overlap: int = 1_000, bases: int = 50_000_000) -> DataFrame:
    """(chrom, chunk_start, seq) of .2bit files, N where bases are masked out; a task reads about `bases` of them."""
    from .twobit import TwoBit

    spark.dataSource.register(TwoBit)
    return spark.read.format("two_bit").option("size", size).option("overlap", overlap).option("bases", bases).load(path)
