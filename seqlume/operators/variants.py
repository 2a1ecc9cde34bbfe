"""Annotation of variants with precomputed scores: windows of events, exact indels, a status for every row.

Tables (see the schemas below): events, wild type, ISM substitutions, scaling, indels. Coordinates of events are
0-based and half open; windows and distances follow the transcript.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlume.functions import scores, sequence

from seqlume.sources.staging import staged

from .groups import coverage_difference
from .intervals import overlap_join

EVENTS = "event string, chrom string, strand string, upIntStart long, upIntEnd long, dnIntStart long, dnIntEnd long, geneName string, lengthDiff int, group string"
ISM = "event string, region string, rel_pos int, ref string, alt string, mt_score string, delta_logit_score double, transformed_delta_scores double"
WILD_TYPE = "event string, wt_score string"
SCALING = "event string, logit_scaling_factor double, logit_scaling_factor_all_vars double"
INDELS = "variant string, event string, var_MIC_region string, MIC_dist string, mt_code_score string, wt_code_score string, logit_scaling_factor string, delta_code_model string, logit_scaling_factor_all_vars string, delta_code_model_all_vars string"

#: The result's columns.
OUTPUT = ["variant", "geneName", "var_type", "event", "ME-ID", "MIC_group", "MIC_dist", "var_MIC_region", "mt_code_score", "wt_code_score", "logit_scaling_factor", "delta_code_model", "assembly", "VCF_ID", "prediction_status", "ref_ok"]
#: Scale and indel delta of each way of scaling.
SCALINGS = {"all-variants": ("logit_scaling_factor_all_vars", "delta_code_model_all_vars"), "main-analysis": ("logit_scaling_factor", "delta_code_model")}


def with_geometry(events: DataFrame) -> DataFrame:
    """Adds c1, c2, me_start, me_end (last base) and me_id; an error for a strand other than + and -."""
    plus = F.col("strand") == "+"
    known = events.withColumn("chrom", sequence.chromosome("chrom")).withColumn("strand", scores.require(F.col("strand").isin("+", "-"), F.col("strand"), "strand must be + or -"))
    pick = lambda a, b: F.when(plus, F.col(a)).otherwise(F.col(b))
    out = known.withColumns({"c1": pick("upIntStart", "upIntEnd"), "c2": pick("dnIntEnd", "dnIntStart"), "me_start": pick("upIntEnd", "dnIntEnd"), "me_end": pick("dnIntStart", "upIntStart") - 1})
    return out.withColumn("me_id", F.concat_ws("_", "chrom", "strand", F.col("me_start").cast("string"), (F.col("me_end") + 1).cast("string")))


def windows(events: DataFrame) -> DataFrame:
    """(event columns..., region, start0, end0): closed 0-based windows, cut at 0; events as with_geometry gives them."""
    plus, ms, me, n = F.col("strand") == "+", F.col("me_start"), F.col("me_end"), F.col("lengthDiff")
    span = lambda region, a, b: F.struct(F.lit(region).alias("region"), F.greatest(a, F.lit(0)).cast("long").alias("start0"), b.cast("long").alias("end0"))
    way = lambda p, m: F.when(plus, p).otherwise(m)
    spans = F.array(
        span("c1", F.col("c1") - 300, F.col("c1") + 299),
        span("up", way(ms - 300, me + 1), way(ms - 1, me + 300)),
        span("ex", way(ms, me - n + 1), way(ms + n - 1, me)),
        span("dn", way(me + 1, ms - 300), way(me + 300, ms - 1)),
        span("c2", F.col("c2") - 300, F.col("c2") + 299),
    )
    return events.withColumn("_w", F.explode(spans)).select(*events.columns, "_w.*").where("end0 >= 0")


def model_position(pos0: Column) -> Column:
    """Position within a region as the substitution table counts it."""
    plus, ms, me, region = F.col("strand") == "+", F.col("me_start"), F.col("me_end"), F.col("region")
    signed = lambda p, m: F.when(plus, p).otherwise(m)
    return (
        F.when(region == "c1", signed(pos0 - F.col("c1"), F.col("c1") - pos0))
        .when(region == "c2", signed(pos0 - F.col("c2"), F.col("c2") - pos0))
        .when(region == "up", signed(pos0 - ms, me - pos0))
        .when(region == "ex", signed(pos0 - ms + 1, me - pos0 + 1))
        .otherwise(signed(pos0 - me, ms - pos0))
    )


def shown_distance(pos0: Column) -> Column:
    """Distance as it is shown: in transcript order, from 0 at a region's first base beside or in the microexon."""
    plus, ms, me, region = F.col("strand") == "+", F.col("me_start"), F.col("me_end"), F.col("region")
    signed = lambda p, m: F.when(plus, p).otherwise(m)
    return (
        F.when(region == "c1", pos0 - F.col("c1"))
        .when(region == "c2", pos0 - F.col("c2"))
        .when(region == "up", signed(pos0 - ms, me - pos0))
        .when(region == "ex", signed(pos0 - ms + 2, me - pos0 + 2))
        .otherwise(signed(pos0 - me - 1, ms - pos0 - 1))
    )


def alleles(vcf: DataFrame) -> DataFrame:
    """A row for each alternative allele of (chrom, pos, id, ref, alt); rows without one are left out. Keeps the order."""
    rows = vcf if "rec_ord" in vcf.columns else vcf.withColumn("rec_ord", F.monotonically_increasing_id())
    some = rows.where("alt is not null and alt not in ('.', '')").select("rec_ord", sequence.chromosome("chrom").alias("chrom"), "pos", F.col("id").alias("VCF_ID"), F.upper("ref").alias("ref"), F.posexplode(F.split(F.upper("alt"), ",")).alias("alt_ord", "alt"))
    named = some.withColumn("variant", sequence.variant_id("chrom", "pos", "ref", "alt")).withColumn("var_type", sequence.variant_type("ref", "alt"))
    return named.withColumns({"qstart": F.col("pos").cast("long") - 1, "qend": F.col("pos").cast("long") - 1 + F.greatest(F.length("ref"), F.lit(1)) - 1})


def reference_check(rows: DataFrame, reference: DataFrame | None) -> DataFrame:
    """Adds ref_check: NOT_RUN without a reference, else True, False or ERROR (no such place).

    reference: (chrom, chunk_start, seq), pieces of equal length that overlap by the longest REF to be checked.
    """
    if reference is None:
        return rows.withColumn("ref_check", F.lit("NOT_RUN"))
    size = reference.agg(F.max(F.length("seq")).alias("n"), F.min(F.when(F.col("chunk_start") > 0, F.col("chunk_start"))).alias("step")).first()
    step = size["step"] or size["n"] or 1
    pieces = reference.select(F.col("chrom").alias("_c"), F.col("chunk_start").alias("_s"), "seq")
    at = F.floor(F.col("qstart") / step) * step
    joined = rows.join(pieces, (F.col("chrom") == F.col("_c")) & (at == F.col("_s")), "left")
    there = F.upper(F.col("seq").substr((F.col("qstart") - F.col("_s") + 1).cast("int"), F.length("ref")))
    state = F.when(F.col("seq").isNull() | (F.length(there) < F.length("ref")), "ERROR").when(there == F.col("ref"), "True").otherwise("False")
    return joined.withColumn("ref_check", state).drop("_c", "_s", "seq")


def _told(condition: Column, value: Column, message: str, name: Column) -> Column:
    """value; an error with the row's name where the condition doesn't hold."""
    return F.when(condition, value).otherwise(F.raise_error(F.concat(F.lit(f"{message} "), F.coalesce(name.cast("string"), F.lit("null")))))


def sole_wild_type(wild_type: DataFrame) -> DataFrame:
    """(event, wt_score), a row an event; an error where the scores of an event differ."""
    rows = wild_type.groupBy("event").agg(F.min("wt_score").alias("low"), F.max("wt_score").alias("high"))
    return rows.select("event", _told(F.col("low").eqNullSafe(F.col("high")), F.col("low"), "conflicting wild-type scores of", F.col("event")).alias("wt_score"))


def sole_scale(scaling: DataFrame, column: str) -> DataFrame:
    """(event, scale), a row an event; an error where an event has several rows, or a scale that isn't above 0 and finite."""
    rows = scaling.groupBy("event").agg(F.count("*").alias("n"), F.max(F.col(column).cast("double")).alias("x"))
    fine = F.coalesce((F.col("x") > 0) & (F.col("x") < float("inf")), F.lit(False))
    once = _told(F.col("n") == 1, F.col("x"), "several scale rows of", F.col("event"))
    return rows.select("event", _told((F.col("n") > 1) | fine, once, f"invalid {column} of", F.col("event")).alias("scale"))


def sole_events(events: DataFrame) -> DataFrame:
    """events; an error where an event has several rows."""
    rows = events.groupBy("event").agg(F.count("*").alias("n"), F.min(F.struct(*(F.col(f"`{c}`") for c in events.columns))).alias("row"))
    return rows.select(_told(F.col("n") == 1, F.col("row"), "several rows of event", F.col("event")).alias("row")).select("row.*")


def sole_indels(indels: DataFrame) -> DataFrame:
    """A row for each (variant, event, var_MIC_region): the last by row_ord; without that column, rows that differ are an error."""
    keys, others = ["variant", "event", "var_MIC_region"], [c for c in indels.columns if c not in ("variant", "event", "var_MIC_region")]
    row = F.struct(*(F.col(f"`{c}`") for c in others))
    if "row_ord" in others:
        return indels.groupBy(*keys).agg(F.max_by(row, "row_ord").alias("row")).select(*keys, "row.*")
    rows = indels.groupBy(*keys).agg(F.min(row).alias("low"), F.max(row).alias("high"))
    return rows.select(*keys, _told(F.col("low").eqNullSafe(F.col("high")), F.col("low"), "conflicting indel rows of", F.col("variant")).alias("row")).select(*keys, "row.*")


def check_coverage(events: DataFrame, wild_type: DataFrame, scaling: DataFrame) -> None:
    """An error that says how many events differ, if the three tables don't have the same events."""
    for name, table in (("wild type", wild_type), ("scaling", scaling)):
        sides = {r["side"]: r["count"] for r in coverage_difference(events, table, "event").groupBy("side").count().collect()}  # two rows at most
        if sides:
            raise ValueError(f"events and {name} differ: {sides.get('left', 0)} only in events, {sides.get('right', 0)} only in {name}")


def annotate(vcf: DataFrame, events: DataFrame, wild_type: DataFrame, ism: DataFrame, scaling: DataFrame, indels: DataFrame, reference: DataFrame | None = None, delta_scaling: str = "all-variants", assembly: str = "hg38", extra: list[str] | None = None) -> DataFrame:
    """The annotated rows, all text, in the order of OUTPUT plus rec_ord and alt_ord for sorting.

    The substitution table is the large one: it is reduced to the asked keys by the join, not the other way round.
    Its regions and alleles count in any case of letters. Alleles in windows are written once and read where they are
    needed. Repeated events or scales, conflicting wild types, substitutions or indels, and scales that are not above 0
    are errors that name the event or variant.
    """
    scale_col, delta_col = SCALINGS[delta_scaling]
    shaped = with_geometry(sole_events(events))
    asked = alleles(vcf)
    asked = asked if "rec_ord" in vcf.columns else staged(asked, "alleles")  # else each use could number rows anew
    hits = overlap_join(asked, windows(shaped).drop("upIntStart", "upIntEnd", "dnIntStart", "dnIntEnd"), "chrom", parts=int(vcf.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["rec_ord", "alt_ord", "event", "region"]
    info = ["chrom", "pos", "ref", "alt", "VCF_ID", "variant", "var_type", "qstart", "qend"]
    shape = ["strand", "c1", "c2", "me_start", "me_end", "me_id", "geneName", "lengthDiff", "group"]
    hits = hits.select(*keys, *info, *shape)
    table = sole_indels(indels)
    exact = asked.where("var_type = 'Indel'").join(table.select("variant", "event", F.col("var_MIC_region").alias("region")), "variant").join(shaped.select("event", *shape), "event").select(*keys, *info, *shape)
    hits = staged(hits, "allele-windows")
    rows = hits.unionByName(exact.join(hits.where("var_type = 'Indel'").select(*keys), keys, "left_anti"))
    rows = reference_check(rows, reference)
    pos0 = F.col("qstart")
    rows = rows.withColumns({"rel_pos": model_position(pos0).cast("int"), "shown": shown_distance(pos0)})

    wanted = ["event", "region", "rel_pos", "ref", "alt"]
    snv = F.col("var_type") == "SNV"
    needed = rows.where(snv).select(*wanted).distinct()
    known = ism.select("event", F.lower("region").alias("region"), "rel_pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), "mt_score").join(needed, wanted, "left_semi")
    scored = known.groupBy(*wanted).agg(F.min("mt_score").alias("low"), F.max("mt_score").alias("high"))
    found = scored.select(*wanted, _told(F.col("low").eqNullSafe(F.col("high")), F.col("low"), "conflicting substitution scores of", F.concat_ws(" ", *wanted)).alias("snv_mt"))
    rows = rows.join(found, wanted, "left")
    fields = table.select("variant", "event", F.col("var_MIC_region").alias("region"), F.col("MIC_dist").alias("i_dist"), F.col("mt_code_score").alias("i_mt"), F.col("wt_code_score").alias("i_wt"), F.col(scale_col).alias("i_scale"), F.col(delta_col).alias("i_delta"))
    rows = rows.join(fields, ["variant", "event", "region"], "left")
    rows = rows.join(sole_wild_type(wild_type), "event", "left").join(sole_scale(scaling, scale_col), "event", "left")

    has_snv = snv & F.col("snv_mt").isNotNull() & F.col("wt_score").isNotNull() & F.col("scale").isNotNull()
    has_indel = (F.col("var_type") == "Indel") & F.col("i_mt").isNotNull()
    status = (
        F.when(F.col("var_type") == "Unsupported", "ERROR_UNSUPPORTED_ALLELE")
        .when(F.col("ref_check") == "False", "ERROR_REF_MISMATCH")
        .when(F.col("ref_check") == "ERROR", "ERROR_REFERENCE_LOOKUP")
        .when(has_snv | has_indel, "FOUND")
        .otherwise("NA_NOT_PRECOMPUTED")
    )
    rows = rows.withColumn("prediction_status", status)
    failed = F.col("prediction_status").startswith("ERROR")
    ok = F.col("prediction_status") == "FOUND"
    text = lambda snv_value, indel_value: F.when(failed, "ERROR").when(ok & snv, snv_value).when(ok, indel_value).otherwise("NA")
    delta = scores.scaled_delta("snv_mt", "wt_score", F.col("scale"))
    scale = F.when(failed, "ERROR").when(snv, F.coalesce(F.col("scale").cast("string"), F.lit("NA"))).when(ok, F.col("i_scale")).otherwise("NA")
    return rows.select(
        "variant",
        "geneName",
        "var_type",
        "event",
        F.col("me_id").alias("ME-ID"),
        F.when(F.col("group") == "novel_mic", "new_mic").otherwise(F.col("group")).alias("MIC_group"),
        F.when(ok & ~snv, F.col("i_dist")).otherwise(F.col("shown").cast("string")).alias("MIC_dist"),
        F.col("region").alias("var_MIC_region"),
        text(F.col("snv_mt"), F.col("i_mt")).alias("mt_code_score"),
        text(F.col("wt_score"), F.col("i_wt")).alias("wt_code_score"),
        scale.alias("logit_scaling_factor"),
        text(delta.cast("string"), F.col("i_delta")).alias("delta_code_model"),
        F.lit(assembly).alias("assembly"),
        F.coalesce(F.col("VCF_ID"), F.lit(".")).alias("VCF_ID"),
        "prediction_status",
        F.when(F.col("prediction_status") == "ERROR_UNSUPPORTED_ALLELE", "NOT_RUN").when(F.col("ref_check") == "NOT_RUN", "NA").otherwise(F.col("ref_check")).alias("ref_ok"),
        "rec_ord",
        "alt_ord",
    )


def in_order(annotated: DataFrame) -> DataFrame:
    """Rows in the input's order, then by event and region; only the result's columns."""
    return annotated.orderBy("rec_ord", "alt_ord", "event", "var_MIC_region").select(*(f"`{c}`" for c in OUTPUT))


def summary(vcf: DataFrame, annotated: DataFrame) -> DataFrame:
    """One row of run counters."""
    asked = alleles(vcf)
    omitted = asked.join(annotated.select("variant").distinct(), "variant", "left_anti")
    counts = annotated.agg(F.count("*").alias("rows"), F.count_if(F.col("prediction_status") == "FOUND").alias("found"), F.count_if(F.col("prediction_status") == "NA_NOT_PRECOMPUTED").alias("missing"), F.count_if(F.col("prediction_status").startswith("ERROR")).alias("errors"), F.count_if(F.col("prediction_status") == "ERROR_REF_MISMATCH").alias("mismatches"))
    return counts.join(asked.agg(F.count("*").alias("alleles"))).join(omitted.agg(F.count("*").alias("omitted")))


def event_distance(pos0: Column) -> Column:
    """struct(distance, region) of a position to the nearest edge of the microexon; negative before it in the
    transcript. Half-open introns; events (strand, upIntStart, upIntEnd, dnIntStart, dnIntEnd). Of two equally near
    edges, the one towards the downstream intron counts on the plus strand, and likewise on the minus strand."""
    plus = F.col("strand") == "+"
    first = F.when(plus, F.col("upIntEnd")).otherwise(F.col("dnIntEnd"))
    last = F.when(plus, F.col("dnIntStart")).otherwise(F.col("upIntStart"))
    before, after = pos0 < first, pos0 >= last
    to_first, to_last = pos0 - first, pos0 - last
    near_up = F.when(plus, to_first < last - pos0).otherwise(last - pos0 < to_first)
    forward = F.when(before, to_first).when(after, to_last).when(near_up, to_first).otherwise(to_last)
    backward = F.when(before, -to_first - 1).when(after, -to_last - 1).when(near_up, -to_last - 1).otherwise(-to_first - 1)
    region = F.when(before, F.when(plus, "up").otherwise("dn")).when(after, F.when(plus, "dn").otherwise("up")).otherwise("ex")
    return F.struct(F.when(plus, forward).otherwise(backward).alias("distance"), region.alias("region"))


def span_distance(pos0: Column, ref: Column) -> Column:
    """Distance of a variant's span to the microexon's nearer edge, on the genome: 0 if it crosses one."""
    plus = F.col("strand") == "+"
    start = F.when(plus, F.col("upIntEnd")).otherwise(F.col("dnIntEnd"))
    end = F.when(plus, F.col("dnIntStart")).otherwise(F.col("upIntStart"))
    stop = pos0 + F.length(ref)
    inside = (pos0 > start) & (stop <= end)
    nearer = F.when(pos0 - start < end - stop, pos0 - start).otherwise(stop - end)
    return F.when(stop <= start, stop - start).when(pos0 >= end, pos0 - end).when(inside, nearer).otherwise(F.lit(0))
