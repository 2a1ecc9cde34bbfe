"""Streams of variants against static windows, and windowed counts of events; an extension beyond batch use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlume.functions import sequence


def annotate_stream(variants: DataFrame, windows: DataFrame, width: int = 1000) -> DataFrame:
    """Rows of a stream (chrom, pos, ref, alt) with the static windows (chrom, start0, end0, ...) that they meet.

    The static side is cut into bins, so the join is an equi-join without state.
    """
    static = windows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start0") / width), F.floor(F.col("end0") / width)))).withColumnRenamed("chrom", "_c")
    rows = variants.withColumns({"chrom": sequence.chromosome("chrom"), "qstart": F.col("pos") - 1})
    rows = rows.withColumn("qend", F.col("qstart") + F.greatest(F.length("ref"), F.lit(1)) - 1).withColumn("_at", F.explode(F.sequence(F.floor(F.col("qstart") / width), F.floor(F.col("qend") / width))))
    meets = (F.col("chrom") == F.col("_c")) & (F.col("_at") == F.col("_bin")) & (F.col("qstart") <= F.col("end0")) & (F.col("qend") >= F.col("start0"))
    once = F.col("_bin") == F.floor(F.greatest("qstart", "start0") / width)
    return rows.join(static, meets & once).drop("_bin", "_at", "_c")


def counts_by_window(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling windows; events that come later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
