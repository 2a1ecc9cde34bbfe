"""Writers: one ordered text file, VCF, FASTA, manifests, row ranges.

Files that have to be one and in order are small results (reports, examples); everything large goes through Spark's
own writers, one file for each partition.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.operators.groups import numbered


def write_ordered(df: DataFrame, path: str, order: list, separator: str = "\t") -> int:
    """Rows in order as one delimited file with a header and line feeds, streamed through the driver; returns rows.

    For reports that somebody reads: rows come partition by partition, so the driver holds one of them at a time.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(separator.join(df.columns) + "\n")
        for r in df.orderBy(*order).toLocalIterator():
            f.write(separator.join("" if v is None else str(v) for v in r) + "\n")
            n += 1
    return n


def vcf_lines(df: DataFrame, info: dict[str, Column], samples: dict[str, Column] | None = None) -> DataFrame:
    """A column line for each record of (chrom, pos, id, ref, alt, qual, filter), INFO packed from columns; null ones left out."""
    packed = F.concat_ws(";", *(F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in info.items()))
    fields = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("chrom", "pos", "id", "ref", "alt", "qual", "filter")]
    extra = [F.lit("GT"), *samples.values()] if samples else []
    return df.withColumn("line", F.concat_ws("\t", *fields, F.when(packed == "", ".").otherwise(packed), *extra))


def vcf_header(contigs: list[str], info: dict[str, tuple[str, str, str]], samples: list[str] = ()) -> list[str]:
    """Header lines; contigs in order of their numbers; info: name -> (Number, Type, Description)."""
    rank = lambda c: (int(c.removeprefix("chr")) if c.removeprefix("chr").isdigit() else 99, c)
    lines = ["##fileformat=VCFv4.2", *(f"##contig=<ID={c}>" for c in sorted(contigs, key=rank))]
    lines += [f'##INFO=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in info.items()]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])]


def write_sample_vcfs(df: DataFrame, path: str) -> None:
    """A folder sample=<name> of VCF lines for each sample of rows (sample, chrom, pos, ref, alt, filter), PASS only,
    sorted by text of the chromosome and position."""
    rows = df.where("filter = 'PASS'").withColumns({"id": F.lit("."), "qual": F.lit(".")})
    lines = vcf_lines(rows, {}, {"GT": F.lit("1/1")}).select("sample", "chrom", "pos", "line")
    lines.repartition("sample", "chrom").sortWithinPartitions("sample", "chrom", "pos").select("sample", "line").write.partitionBy("sample").text(path)


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def write_ranges(df: DataFrame, path: str, order: str, files: int) -> None:
    """Rows in order, dealt out into folders part=<n> of equal size but for the last, each file with the header."""
    rows = numbered(df, order)
    size = max(-(-rows.count() // files), 1)
    rows.withColumn("part", F.floor(F.col("row_id") / size)).drop("row_id").repartition("part").sortWithinPartitions("part", order).write.partitionBy("part").option("header", True).option("sep", "\t").csv(path)


def write_json(value: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, indent=2)
        f.write("\n")


def html_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as HTML; an error if it has more rows than a page should hold."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows.to_html(index=False)


def write_gzip(df: DataFrame, path: str, order: list, separator: str = ",") -> str:
    """Rows in order as one gzip file that has no time and no name in it; returns its SHA-256. For bundles."""
    import gzip
    import hashlib

    with open(path, "wb") as raw, gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0) as f:
        f.write((separator.join(df.columns) + "\n").encode())
        for r in df.orderBy(*order).toLocalIterator():
            f.write((separator.join("" if v is None else str(v) for v in r) + "\n").encode())
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()
