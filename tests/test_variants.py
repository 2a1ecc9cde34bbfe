"""The annotation pipeline on the synthetic bundle: boundaries, scaling, statuses, reference checks."""

import pytest
from pyspark.sql import functions as F

from seqlume.functions import sequence
from seqlume.operators import bundle, variants

EVENTS = [("PLUS", "chr1", "+", 1000, 2000, 2003, 3000, "GENE_PLUS", 3, "known_mic"), ("MINUS", "1", "-", 6003, 1000, 7000, 6000, "GENE_MINUS", 3, "novel_mic")]
ISM = [("PLUS", "c1", 0, "A", "G", "0.4", 0.0, 0.0), ("PLUS", "ex", 1, "A", "G", "0.5", 0.0, 0.0), ("MINUS", "c1", 0, "A", "G", "0.6", 0.0, 0.0), ("MINUS", "ex", 1, "A", "G", "0.3", 0.0, 0.0)]
INDELS = [("chr1:1001:A:AT", "PLUS", "c1", "0", "0.6", "0.8", "2", "-0.5283208335737186", "4", "-0.2641604167868593"), ("chr1:1001:A:AT", "MINUS", "c1", "0", "0.5", "0.7", "2.5", "-0.4889082860886104", "5", "-0.2444541430443052")]
WINDOWS = {
    ("PLUS", "c1"): (700, 1299), ("PLUS", "up"): (1700, 1999), ("PLUS", "ex"): (2000, 2002), ("PLUS", "dn"): (2003, 2302), ("PLUS", "c2"): (2700, 3299),
    ("MINUS", "c1"): (700, 1299), ("MINUS", "up"): (6003, 6302), ("MINUS", "ex"): (6000, 6002), ("MINUS", "dn"): (5700, 5999), ("MINUS", "c2"): (6700, 7299),
}


@pytest.fixture(scope="module")
def tables(spark):
    return dict(
        events=spark.createDataFrame(EVENTS, variants.EVENTS),
        wild_type=spark.createDataFrame([("PLUS", "0.8"), ("MINUS", "0.7")], variants.WILD_TYPE),
        ism=spark.createDataFrame(ISM, variants.ISM),
        scaling=spark.createDataFrame([("PLUS", 2.0, 4.0), ("MINUS", 2.5, 5.0)], variants.SCALING),
        indels=spark.createDataFrame(INDELS, variants.INDELS),
    )


def vcf(spark, *rows):
    return spark.createDataFrame([(i, c, p, f"id{i}", r, a) for i, (c, p, r, a) in enumerate(rows)], "rec_ord long, chrom string, pos long, id string, ref string, alt string")


def run(spark, tables, *rows, **how):
    return variants.in_order(variants.annotate(vcf(spark, *rows), **tables, **how)).collect()


def test_windows(spark, tables):
    got = {(r["event"], r["region"]): (r["start0"], r["end0"]) for r in variants.windows(variants.with_geometry(tables["events"])).collect()}
    assert got == WINDOWS


def test_positions(spark, tables):
    w = variants.windows(variants.with_geometry(tables["events"]))
    at = lambda f, e, r, p: w.where((F.col("event") == e) & (F.col("region") == r)).select(f(F.lit(p)).alias("x")).first()["x"]
    model, shown = variants.model_position, variants.shown_distance
    assert [at(model, "PLUS", "ex", 2000), at(model, "MINUS", "ex", 6002), at(model, "PLUS", "c1", 1000), at(model, "MINUS", "c1", 1000)] == [1, 1, 0, 0]
    assert [at(shown, "PLUS", "dn", 2003), at(shown, "PLUS", "ex", 2000), at(shown, "MINUS", "c1", 999)] == [0, 2, -1]


@pytest.mark.parametrize("event,region", sorted(WINDOWS))
def test_boundaries(spark, tables, event, region):
    a, b = WINDOWS[event, region]
    rows = run(spark, tables, *(("chr1", p + 1, "A", "G") for p in (a - 1, a, b, b + 1)))
    inside = {r["VCF_ID"] for r in rows if (r["event"], r["var_MIC_region"]) == (event, region)}
    assert inside == {"id1", "id2"}


def test_scaling(spark, tables):
    rows = [r for r in run(spark, tables, ("chr1", 1001, "A", "G"), ("chr1", 1001, "A", "AT")) if r["event"] == "PLUS"]
    assert [r["logit_scaling_factor"] for r in rows] == ["4.0", "4"]
    assert float(rows[0]["delta_code_model"]) == pytest.approx(-0.6462406251802891, rel=1e-12) and rows[1]["delta_code_model"] == "-0.2641604167868593"
    rows = [r for r in run(spark, tables, ("chr1", 1001, "A", "G"), ("chr1", 1001, "A", "AT"), delta_scaling="main-analysis") if r["event"] == "PLUS"]
    assert [r["logit_scaling_factor"] for r in rows] == ["2.0", "2"]
    assert float(rows[0]["delta_code_model"]) == pytest.approx(-1.2924812503605782, rel=1e-12) and rows[1]["delta_code_model"] == "-0.5283208335737186"


def test_several_alleles_and_bare_contig(spark, tables):
    rows = run(spark, tables, ("1", 1001, "A", "G,C"))
    assert [r["prediction_status"] for r in rows] == ["FOUND", "FOUND", "NA_NOT_PRECOMPUTED", "NA_NOT_PRECOMPUTED"]
    assert [r["event"] for r in rows] == ["MINUS", "PLUS"] * 2 and all(r["variant"].startswith("chr1:") for r in rows)
    assert {r["MIC_group"] for r in rows} == {"known_mic", "new_mic"} and list(rows[0].asDict()) == variants.OUTPUT
    assert rows[2]["logit_scaling_factor"] == "5.0" and rows[2]["mt_code_score"] == "NA"


def test_statuses(spark, tables):
    rows = run(spark, tables, ("chr1", 1001, "A", "AT"), ("chr1", 1002, "A", "AT"), ("chr1", 1001, "A", "C"), ("chr1", 1001, "A", "<DEL>"), ("chr1", 9001, "A", "G"), ("chr1", 1001, "A", None))
    by = {}
    for r in rows:
        by.setdefault(r["VCF_ID"], []).append(r["prediction_status"])
    assert by == {"id0": ["FOUND"] * 2, "id1": ["NA_NOT_PRECOMPUTED"] * 2, "id2": ["NA_NOT_PRECOMPUTED"] * 2, "id3": ["ERROR_UNSUPPORTED_ALLELE"] * 2}
    bad = [r for r in rows if r["VCF_ID"] == "id3"][0]
    assert {bad["mt_code_score"], bad["wt_code_score"], bad["logit_scaling_factor"], bad["delta_code_model"]} == {"ERROR"} and bad["ref_ok"] == "NOT_RUN"
    asked = vcf(spark, ("chr1", 1001, "A", "G"), ("chr1", 9001, "A", "G"))
    s = variants.summary(asked, variants.annotate(asked, **tables)).first()
    assert (s["rows"], s["found"], s["alleles"], s["omitted"]) == (2, 2, 2, 1)


def test_reference(spark, tables):
    reference = spark.createDataFrame([("chr1", i * 1000, "A" * 1100) for i in range(9)], "chrom string, chunk_start long, seq string")
    rows = run(spark, tables, ("chr1", 1001, "A", "G"), ("chr1", 1001, "C", "G"), ("chr1", 1000, "AA", "A"), reference=reference)
    got = {r["VCF_ID"]: (r["ref_ok"], r["prediction_status"]) for r in rows if r["event"] == "PLUS"}
    assert got == {"id0": ("True", "FOUND"), "id1": ("False", "ERROR_REF_MISMATCH"), "id2": ("True", "NA_NOT_PRECOMPUTED")}
    nowhere = spark.createDataFrame([("chr2", 0, "A")], "chrom string, chunk_start long, seq string")
    assert {r["prediction_status"] for r in run(spark, tables, ("chr1", 1001, "A", "G"), reference=nowhere)} == {"ERROR_REFERENCE_LOOKUP"}


def test_exact_indel_outside_the_windows(spark, tables):
    far = spark.createDataFrame([("chr1:5001:A:AT", "PLUS", "dn", "17", "0.6", "0.8", "2", "-1", "4", "-0.5")], variants.INDELS)
    rows = run(spark, tables | {"indels": far}, ("chr1", 5001, "A", "AT"))
    assert [(r["event"], r["var_MIC_region"], r["MIC_dist"], r["delta_code_model"]) for r in rows] == [("PLUS", "dn", "17", "-0.5")]


def test_bad_strand(spark, tables):
    bad = spark.createDataFrame([("X", "chr1", "*", 1, 2, 3, 4, "G", 3, "g")], variants.EVENTS)
    with pytest.raises(Exception, match="strand"):
        variants.with_geometry(bad).collect()


@pytest.mark.parametrize("ref,alt,kind", [("A", "G", "SNV"), ("a", "g", "SNV"), ("A", "AT", "Indel"), ("AT", "A", "Indel"), ("AT", "GC", "Unsupported"), ("A", "<DEL>", "Unsupported"), ("A", "*", "Unsupported"), ("N", "A", "Unsupported"), ("AN", "A", "Indel")])
def test_variant_types(spark, ref, alt, kind):
    assert spark.range(1).select(sequence.variant_type(F.lit(ref), F.lit(alt)).alias("k")).first()["k"] == kind


def test_bundle(spark):
    ism = spark.createDataFrame([("ISM_A", "c1", 0, "A", "G", "0.1", -2.0, 0.0), ("ISM_A", "c1", 1, "A", "G", "0.1", 1.0, 0.0), ("ISM_B", "c1", 0, "A", "G", "0.1", -3.0, 0.0)], variants.ISM)
    wt = spark.createDataFrame([("ISM_A", ".8"), ("ISM_B", ".7"), ("WT_ONLY", ".6")], variants.WILD_TYPE)
    meta = spark.createDataFrame([(e, *EVENTS[0][1:]) for e in ("ISM_A", "ISM_B", "WT_ONLY", "ST12_ONLY")], variants.EVENTS)
    row = lambda e, a, b: (f"chr1:1:A:{e}", e, "c1", "0", ".1", ".2", a, "0", b, "0")
    table = spark.createDataFrame([row("ISM_A", "2", "4"), row("ST12_ONLY", "5", "6")], variants.INDELS)
    got = bundle.build(ism, wt, meta, table)
    assert sorted(tuple(r) for r in got["scaling"].collect()) == [("ISM_A", 2.0, 4.0), ("ISM_B", 3.0, 3.0)]
    assert got["indels"].count() == 1
    assert {r["event"] for r in got["events"].collect()} == {r["event"] for r in got["wild_type"].collect()} == {"ISM_A", "ISM_B"}
    with pytest.raises(ValueError, match="ISM_B"):
        bundle.build(ism, wt.where("event != 'ISM_B'"), meta, table)
    with pytest.raises(Exception, match="conflicting"):
        bundle.scales(ism, spark.createDataFrame([("ISM_A", 2.0, 4.0), ("ISM_A", 2.5, 4.0)], variants.SCALING)).collect()


def test_letters_of_substitutions_in_any_case(spark, tables):
    ism = tables["ism"].select("event", F.upper("region").alias("region"), "rel_pos", F.lower("ref").alias("ref"), F.lower("alt").alias("alt"), "mt_score", "delta_logit_score", "transformed_delta_scores")
    asked = ("chr1", 1001, "A", "G"), ("chr1", 2001, "a", "g")
    assert run(spark, tables | {"ism": ism}, *asked) == run(spark, tables, *asked) and {r["prediction_status"] for r in run(spark, tables | {"ism": ism}, *asked)} == {"FOUND"}


@pytest.mark.parametrize("name,rows,message", [
    ("scaling", [("PLUS", 2.0, 4.0)], "several scale rows of PLUS"),
    ("scaling", [("OTHER", 2.0, 0.0)], "invalid logit_scaling_factor_all_vars of OTHER"),
    ("scaling", [("OTHER", 2.0, float("nan"))], "invalid logit_scaling_factor_all_vars of OTHER"),
    ("scaling", [("OTHER", 2.0, None)], "invalid logit_scaling_factor_all_vars of OTHER"),
    ("wild_type", [("PLUS", "0.9")], "conflicting wild-type scores of PLUS"),
    ("events", [EVENTS[0]], "several rows of event PLUS"),
    ("ism", [("PLUS", "C1", 0, "a", "G", "0.9", 0.0, 0.0)], "conflicting substitution scores of PLUS c1 0 A G"),
    ("indels", [(*INDELS[0][:4], "0.7", *INDELS[0][5:])], "conflicting indel rows of chr1:1001:A:AT"),
])
def test_tables_are_checked(spark, tables, name, rows, message):
    table = tables[name]
    more = tables | {name: table.unionByName(spark.createDataFrame(rows, table.schema))}
    with pytest.raises(Exception, match=message):
        run(spark, more, ("chr1", 1001, "A", "G"), ("chr1", 1001, "A", "AT"))


def test_repeated_rows_that_agree(spark, tables):
    asked = ("chr1", 1001, "A", "G"), ("chr1", 1001, "A", "AT"), ("chr1", 1001, "A", "G")
    twice = {n: tables[n].unionByName(tables[n]) for n in ("wild_type", "ism", "indels")}
    assert run(spark, tables | twice, *asked) == run(spark, tables, *asked)
    last = tables["indels"].withColumn("row_ord", F.lit(1)).unionByName(tables["indels"].withColumns({"mt_code_score": F.lit("0.9"), "row_ord": F.lit(2)}))
    assert {r["mt_code_score"] for r in run(spark, tables | {"indels": last}, asked[1])} == {"0.9"}


def test_rows_are_numbered_once(spark, tables):
    unnumbered = spark.createDataFrame([("chr1", 1001, f"id{i}", "A", "G,AT") for i in range(40)], "chrom string, pos long, id string, ref string, alt string").repartition(5)
    rows = variants.in_order(variants.annotate(unnumbered, **tables)).collect()
    assert len(rows) == 160 and {r["prediction_status"] for r in rows} == {"FOUND"}


def test_coverage(spark, tables):
    variants.check_coverage(tables["events"], tables["wild_type"], tables["scaling"])
    with pytest.raises(ValueError, match="events and scaling differ: 1 only in events, 0 only in scaling"):
        variants.check_coverage(tables["events"], tables["wild_type"], tables["scaling"].where("event = 'PLUS'"))
