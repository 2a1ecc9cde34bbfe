"""Operators against plain versions and small tables."""

import itertools
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlume.functions import scores, sequence
from seqlume.operators import anchored, cohort, enrichment, features, genome, groups, intervals, ml, mutagenesis, scan
from seqlume.plans import registry
from seqlume.sources import readers, writers
from seqlume.streaming import annotate as streaming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_overlap_join(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("ab"), *sorted((rng.randint(0, 5000), rng.randint(0, 5000)))) for i in range(60)] + [(99, "a", 10, 5)]
    right = [(i, rng.choice("ab"), *sorted((rng.randint(0, 5000), rng.randint(0, 5000)))) for i in range(60)]
    a = spark.createDataFrame(left, "i int, chrom string, qstart long, qend long")
    b = spark.createDataFrame(right, "j int, chrom string, start0 long, end0 long")
    want = sorted((i, j) for i, c, s, e in left for j, d, u, v in right if c == d and s <= v and u <= e and s <= e)
    for width in (1, 100, 10_000):
        got = sorted((r["i"], r["j"]) for r in intervals.overlap_join(a, b, width=width).select("i", "j").collect())
        assert got == want
    outer = intervals.overlap_join(a, b, how="left").select("i", "j").collect()
    assert (99, None) in [tuple(r) for r in outer] and len(outer) == len(want) + len({r[0] for r in left} - {i for i, _ in want})
    assert intervals.overlap_join(a.limit(0), b).count() == 0


def test_sequence_functions(spark):
    assert one(spark, sequence.reverse_complement(F.lit("ACGTN"))) == "NACGT"
    with pytest.raises(Exception, match="not a sequence"):
        one(spark, sequence.reverse_complement(F.lit("AXG")))
    assert one(spark, sequence.motif_count(F.lit("TATATA"), "TATA")) == 2
    assert one(spark, sequence.motif_starts(F.lit("TATATATG"), "TATR")) == [0, 2, 4]
    assert one(spark, sequence.motif_starts(F.lit("TATATA"), "TA")) == [0, 2, 4]
    assert one(spark, sequence.motif_starts(F.lit("GGG"), "TA")) == []
    assert one(spark, sequence.kmers(F.lit("ACNGTA"), 2)) == ["AC", "GT", "TA"]
    assert [one(spark, sequence.chromosome(F.lit(x))) for x in ("1", "chr2", "MT", "chrM", "ChrX")] == ["chr1", "chr2", "chrM", "chrM", "chrX"]
    assert [one(spark, sequence.chromosome_rank(F.lit(x))) for x in ("chr7", "X")] == [7, 99]
    assert one(spark, sequence.parse_variant(F.lit("chr1:12:A:T"))).asDict() == {"chrom": "chr1", "pos0": 11, "ref": "A", "alt": "T"}
    assert one(spark, sequence.parse_variant(F.lit("chr1:x:A:T"))) is None and one(spark, sequence.parse_variant(F.lit("chr1:1:A"))) is None
    assert one(spark, sequence.variant_list(F.lit("['a:1:C:T', 'b', 'a:1:C:T']"))) == ["a:1:C:T"]
    assert one(spark, sequence.info_value(F.lit("AF=1,2;X"), ["AFJ", "AF"], 2)) == "2" and one(spark, sequence.info_value(F.lit("X"), ["AF"])) == "."
    assert one(spark, sequence.splice(F.lit("ACGT"), F.lit(1), F.lit("CG"), F.lit("T"))) == "ATT"
    with pytest.raises(Exception, match="mismatch"):
        one(spark, sequence.splice(F.lit("ACGT"), F.lit(1), F.lit("GG"), F.lit("T")))
    assert one(spark, sequence.padded_window(F.lit("ACGT"), F.lit(10), F.lit(8), F.lit(12))) == "NNAC"
    assert one(spark, sequence.padded_window(F.lit("ACGT"), F.lit(10), F.lit(12), F.lit(17))) == "GTNNN"


def test_scores(spark):
    assert one(spark, scores.right_closed_bin(F.lit(10.0), 10)) == 1 and one(spark, scores.right_closed_bin(F.lit(10.1), 10)) == 2
    assert one(spark, scores.norm_delta(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, scores.clamped(F.lit(-3.0))) == -1.0
    assert one(spark, scores.is_close(F.lit(1.0), F.lit(1.0 + 1e-13)))
    assert one(spark, scores.logit2(F.lit(1.0))) == pytest.approx(math.log2((1 - 1e-12) / 1e-12), rel=1e-4)


def test_groups(spark):
    df = spark.createDataFrame([(1, 1, "a", 5.0), (1, 2, "a", -7.0), (1, 3, "b", 5.0), (2, 1, None, None)], "k int, o int, v string, x double")
    runs = {(r["k"], r["o"]): r["run_id"] for r in groups.run_ids(df, ["k"], ["o"], "v").collect()}
    assert runs == {(1, 1): 1, (1, 2): 1, (1, 3): 2, (2, 1): 1}
    assert groups.first_max(df.where("k = 1"), ["k"], "x", "o").first()["o"] == 1
    got = df.groupBy("k").agg(groups.ordered_concat("v", "o").alias("p"), groups.ordered_concat("v", "o", unique=True).alias("u"), groups.max_abs("x").alias("m")).where("k = 1").first()
    assert (got["p"], got["u"], got["m"]) == ("a|a|b", "a|b", 7.0)
    rows = groups.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")), "id")
    assert rows.where("id != row_id").count() == 0
    assert groups.numbered(spark.range(0), "id").count() == 0


def test_cohort(spark):
    rng = random.Random(3)
    points = [(k, rng.randint(0, 100)) for k in (1, 2) for _ in range(20)]
    moves = [(k, rng.randint(0, 100), rng.randint(-3, 3)) for k in (1, 2) for _ in range(20)]
    got = cohort.lifted(spark.createDataFrame(points, "k int, coord long"), spark.createDataFrame(moves, "k int, pos long, change int"), "k").collect()
    assert sorted(map(tuple, got)) == sorted((k, c, c + sum(d for j, p, d in moves if j == k and p + 1 <= c)) for k, c in points)
    v = F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(r).alias("ref"), F.lit("A").alias("alt")) for p, r in ((5, "AAA"), (1, "A"), (7, "C"), (8, "G"))))
    assert [x["pos"] for x in one(spark, cohort.without_overlaps(v))] == [1, 5, 8]
    variants = spark.createDataFrame([("s1", "r", True), ("s2", "r", False), ("s3", "r", True)], "sample string, region_set string, rare boolean")
    samples = spark.createDataFrame([("s1", 2), ("s2", 1), ("s3", 0)], "sample string, affection int")
    r = cohort.counts_by_affection(variants, samples, {"all": F.lit(True), "rare": F.col("rare")}).first()
    assert (r["affected_all"], r["affected_rare"], r["unaffected_all"], r["unaffected_rare"]) == (1, 1, 1, 0)


def test_fisher(spark):
    from fractions import Fraction
    from math import comb

    for fg, bg, n, m in ((3, 1, 10, 12), (0, 5, 7, 9), (4, 0, 4, 9), (0, 0, 3, 3)):
        p = {k: Fraction(comb(n, k) * comb(m, fg + bg - k), comb(n + m, fg + bg)) for k in range(max(0, fg + bg - m), min(n, fg + bg) + 1)}
        want = float(sum(v for k, v in p.items() if k >= fg)), float(sum(v for k, v in p.items() if k <= fg))
        assert enrichment.hypergeometric_tails(fg, bg, n, m) == pytest.approx(want, rel=1e-9)
    table = spark.createDataFrame([("A", 5, 1, 20, 30), ("C", 2, 3, 20, 30)], "kmer string, fg_count long, bg_count long, fg_total long, bg_total long")
    top = enrichment.top_kmers(enrichment.fisher(table), 1).first()
    assert top["kmer"] == "A" and top["set"] == "enriched" and top["p_val_min"] < 0.05
    assert enrichment.top_kmers(enrichment.fisher(table), 5, p_cut=0.0).count() == 0


def test_sliding_profile(spark):
    bins = spark.createDataFrame([("A" * 10 + "TTTGCT" + "A" * 44,)], "s string").select(enrichment.sliding_profile("s", ["TTTGCT", "GTGCC"], 60, 3).alias("x")).first()["x"]
    assert [i for i, b in enumerate(bins) if b] == [3] and len(bins) == 18


def test_mutagenesis(spark):
    s = spark.createDataFrame([("e", "ANGTAC")], "event string, seq string")
    subs = mutagenesis.substitutions(s, "seq").collect()
    assert len(subs) == 15 and all(r["alt"] != r["ref"] for r in subs)
    changes = mutagenesis.motif_changes(s, "seq", "GTA").collect()
    assert len(changes) == 9 and {r["offset"] for r in changes} == {0, 1, 2}
    pairs = mutagenesis.double_changes(spark.createDataFrame([("e", "ACTTAC"), ("f", "AC")], "event string, seq string"), "event", "seq", ["AC", "TT"]).collect()
    assert sorted((r["pos1"], r["pos2"], r["j"]) for r in pairs) == [(0, 2, 0), (4, 2, 1)]
    events = spark.createDataFrame([("p", "+", 100, 500, 503, 900, 4), ("m", "-", 900, 500, 503, 100, 4)], "event string, strand string, c1 long, me_start long, me_end long, c2 long, window long")
    labels = {(r["event"], r["region"], r["label"]): r["pos"] for r in mutagenesis.region_labels(events).collect()}
    assert labels["p", "ex", "ex1"] == 500 and labels["m", "ex", "ex1"] == 502
    assert labels["p", "up", "up-1"] == 499 and labels["m", "up", "up-1"] == 503
    assert labels["p", "dn", "dn+1"] == 503 and labels["m", "dn", "dn+1"] == 499
    assert labels["p", "c1", "c1-1"] == 99 and labels["p", "c1", "c1+1"] == 100


def test_anchored(spark):
    rng = random.Random(8)
    seq = "".join(rng.choice("ACGT") for _ in range(200))
    m = lambda start, end, anchor, strand, *v: anchored.mutate(seq, 0, start, end, anchor, strand, [dict(pos=p, ref=r, alt=a) for p, r, a in v])
    assert m(50, 80, 60, "+") == seq[50:80]
    snv = (70, seq[70], "A" if seq[70] != "A" else "C")
    for anchor in (40, 50, 60, 80, 90, None):
        assert m(50, 80, anchor, "+", snv) == seq[50:70] + snv[2] + seq[71:80]
    insertion, deletion = (70, seq[70], seq[70] + "GG"), (70, seq[70:73], seq[70])
    assert m(50, 80, 50, "+", insertion) == (seq[50:71] + "GG" + seq[71:])[:30]
    assert m(50, 80, 80, "+", insertion) == (seq[:71] + "GG" + seq[71:80])[-30:]
    assert m(50, 80, 50, "+", deletion) == (seq[50:71] + seq[73:])[:30]
    assert m(50, 80, 80, "+", deletion) == (seq[:71] + seq[73:80])[-30:]
    assert m(50, 80, 60, "+", insertion) == seq[50:60] + (seq[60:71] + "GG" + seq[71:])[:20]
    assert m(50, 80, None, "+", insertion) == seq[50:71] + "GG" + seq[71:80]
    assert m(50, 80, 50, "-", insertion) == m(50, 80, 50, "+", insertion).translate(str.maketrans("ACGT", "TGCA"))[::-1]
    for v in itertools.product((insertion, deletion), (50, 60, 80)):
        assert len(m(50, 80, v[1], "+", v[0])) == 30
    rows = spark.createDataFrame([(1, seq, 0, 50, 80, 60, "+", [(70, seq[70], ".")]), (2, None, 0, 1, 2, None, "+", [])], "i int, seq string, seq_start long, start long, end long, anchor long, strand string, variants array<struct<pos: long, ref: string, alt: string>>")
    got = {r["i"]: r["mutated"] for r in anchored.apply_anchored(rows).collect()}
    assert got == {1: seq[50:70] + seq[71:81], 2: None}


def test_personal_windows(spark):
    w = spark.createDataFrame([("e", "chr1", 100, "ACGTACGTAC")], "event string, chrom string, start long, seq string")
    v = spark.createDataFrame([("s", "chr1", 102, "GT", "G"), ("s", "chr1", 103, "T", "C"), ("s", "chr1", 105, "C", "CTT,G"), ("t", "chr1", 109, "C", "G"), ("t", "chr1", 500, "A", "C")], "sample string, chrom string, pos long, ref string, alt string")
    got = {r["sample"]: (r["mutated"], r["shift"]) for r in genome.personal_windows(w, v).collect()}
    assert got == {"s": ("ACGACTTGTAC", 1), "t": ("ACGTACGTAG", 0)}
    bad = spark.createDataFrame([("s", "chr1", 102, "T", "G")], "sample string, chrom string, pos long, ref string, alt string")
    with pytest.raises(Exception, match="mismatch"):
        genome.personal_windows(w, bad).collect()
    assert one(spark, genome.site_candidates(F.lit(100).cast("long"), F.lit(-1))) == [97, 98, 99, 100, 101, 102] and one(spark, genome.site_candidates(F.lit(100).cast("long"), F.lit(-7))) == []


def test_features(spark):
    events = spark.createDataFrame([("p", "chr1", "+", 10, 40, 46, 80), ("m", "chr1", "-", 46, 80, 10, 40)], "event string, chrom string, strand string, upIntStart long, upIntEnd long, dnIntStart long, dnIntEnd long")
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(100))
    pieces = readers.chunks(spark.createDataFrame([("chr1", seq)], "name string, seq string"), size=30, overlap=60)
    rows = {(r["event"], r["region"]): r["seq"] for r in features.with_sequence(features.event_windows(events, 12), pieces, 30).collect()}
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert rows["p", "up"] == seq[28:40] and rows["p", "exon"] == seq[40:46] and rows["p", "dn"] == seq[46:58]
    assert rows["m", "up"] == rc(seq[46:58]) and rows["m", "exon"] == rc(seq[40:46]) and rows["m", "dn"] == rc(seq[28:40])
    lengths = {r["event"]: r["exon_length"] for r in features.lengths(events, {"exon_length": (0.0, 2.0)}).collect()}
    assert lengths["p"] == lengths["m"] == pytest.approx(math.log10(6) / 2)
    w = features.with_sequence(features.event_windows(events, 12), pieces, 30)
    gc = {r["event"]: r["up_gc"] for r in features.composition(w).collect()}
    assert gc["p"] == pytest.approx(sum(x in "GC" for x in seq[28:40]) / 12)
    assert features.rbp_counts(w).count() == 2
    hits = spark.createDataFrame([("a_b_up", "M", 1.5), ("a_b_up", "M", 2.5), ("a_b_dn", "M", 0.5)], "sequence_name string, motif string, score double")
    r = features.best_hits(hits, ["M_up", "M_dn"]).first()
    assert (r["event"], r["M_up"], r["M_dn"]) == ("a_b", 2.5, 0.5)
    matrix = np.array([[1, 0, 0, 0], [0, 1, 0, 0]])
    got = features.matrix_scan(spark.createDataFrame([("x", "ACNAC"), ("y", None), ("z", "A")], "name string, seq string"), {"AC": matrix}, 3.0).collect()
    assert [(r["name"], r["start"], r["score"]) for r in got] == [("x", 0, 4.0), ("x", 3, 4.0)]


def test_branch_points(spark):
    intron = "cagg" + "c" * 20 + "tactaac" + "cc" + "ttttctctttctcttt" + "gaagaagaagaag"
    model = {w: [0.5] * 9 for k in (1, 2, 3) for w in map("".join, itertools.product("acgt", repeat=k))}
    rows = features.branch_points(spark.createDataFrame([("i", intron), ("none", None)], "name string, seq string"), model, model, nearest=5).collect()
    assert [r["bp_seq"] for r in rows] == ["ctactaacc"] or all(r["bp_seq"][3] == "t" and r["bp_seq"][5] == "a" for r in rows)
    r = rows[0]
    assert r["bp_scr"] == pytest.approx(0.0) and r["ppt_len"] >= 9 and r["agez"] == features.exclusion_zone(intron) == 59
    assert features.exclusion_zone("acgtag" + "c" * 20) == 20
    assert features.pyrimidine_tract("aaccc") == (5, 0, 0) and features.pyrimidine_tract("attttt") == (2, 5, 15)
    best = features.best_branch_point(spark.createDataFrame(rows)).collect()
    assert len(best) == 1


def test_heatmap(spark):
    effects = spark.createDataFrame([("e", "up", p, float(p)) for p in range(4)] + [("e", "up", 0, 2.0)], "event string, region string, rel_pos int, delta double")
    seqs = spark.createDataFrame([("e", "up", "ACAC", 0)], "event string, region string, seq string, first_pos int")
    got = {(r["kmer"], r["bin"]): r["effect"] for r in features.motif_heatmap(effects, seqs, 2, F.lit(1)).collect()}
    assert got == {("AC", 1): pytest.approx(((1.0 + 1) / 2 + 2.5) / 2), ("CA", 1): 1.5}


def test_scan(spark):
    df = spark.createDataFrame([(1, "write to a.b@c.org"), (2, 'TOKEN = "0123456789abcdef"'), (3, None), (4, "10.0.0.1")], "i int, t string")
    got = {r["i"]: r for r in scan.findings(df, "t").collect()}
    assert got[1]["email"] and got[2]["credential"] and got[4]["ipv4"] and got[3]["email"] is None and not got[1]["ipv4"]
    assert one(spark, scan.redacted_path(F.lit("/home/me/x"))) == "/home/***/x"
    assert sorted(one(spark, scan.strings_of_json(F.lit('{"a": "x", "image/png": "zzz", "b": "y"}')))) == ["x", "y"]


def test_readers_and_writers(spark, tmp_path):
    p = lambda n, text: str((tmp_path / n).write_text(text) and tmp_path / n)
    vcf = readers.vcf(spark, p("a.vcf", "##x\n#CHROM\tPOS\nchr1\t5\t.\tA\tG\t.\tPASS\tAF=1\n"))
    assert vcf.first()["pos"] == 5 and vcf.count() == 1
    fasta = readers.fasta(spark, p("a.fa", ">one x\nACG\nT\n>two\nGG\n"))
    assert sorted(map(tuple, fasta.collect())) == [("one", "ACGT"), ("two", "GG")]
    assert readers.bed(spark, p("a.bed", "#h\nchr1\t1\t5\tn\t0\t+\n")).first()["end"] == 5
    assert [r["id"] for r in readers.id_list(spark, p("ids", " a \n\nb\n")).collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="missing columns b"):
        readers.table(spark, p("t.csv", "a,c\n1,2\n"), ["a", "b"])
    t = readers.typed(readers.table(spark, p("t2.csv", "a,n\nx,3\nNA,8swa.\n")), "a string, n int")
    assert list(map(tuple, t.collect())) == [("x", 3), (None, None)]
    (tmp_path / "k").mkdir()
    p("k/one.hg38.csv", "e,v\nx,1\n"), p("k/two.mm10.csv", "e,v\ny,2\n")
    k = readers.keyed_files(spark, str(tmp_path / "k"), "e string, v int", r"\.([^.]+)\.csv$", "species")
    assert sorted(map(tuple, k.collect())) == [("x", 1, "hg38"), ("y", 2, "mm10")]
    assert readers.file_names(spark, str(tmp_path / "k" / "*.csv"), {"task": r"/([^/.]+)\.[^/]*$"}).orderBy("task").first()["task"] == "one"
    meme = readers.motifs(spark, p("m.meme", "MEME version 4\n\nMOTIF M1 ABC\nletter-probability matrix:\n 0.1 0.2 0.3 0.4\n 1 0 0 0\n\nMOTIF M2\n0.25 0.25 0.25 0.25\n"))
    assert [(r["motif_id"], r["row"]) for r in meme.orderBy("motif_id", "row").collect()] == [("M1", 0), ("M1", 1), ("M2", 0)]
    assert readers.markov_matrix(spark, p("m.txt", "A\t" + "\t".join(["0.5"] * 9) + "\n"))["a"] == [0.5] * 9
    out = str(tmp_path / "o" / "x.tsv")
    assert writers.write_ordered(spark.createDataFrame([(2, None), (1, "b")], "i int, s string"), out, ["i"]) == 2
    assert open(out).read() == "i\ts\n1\tb\n2\t\n"
    records = spark.createDataFrame([("chr1", 5, ".", "A", "G", None, "PASS", "s1", 0.5)], "chrom string, pos long, id string, ref string, alt string, qual string, filter string, sample string, af double")
    assert writers.vcf_lines(records, {"AF": F.col("af"), "X": F.lit(None)}).first()["line"] == "chr1\t5\t.\tA\tG\t.\tPASS\tAF=0.5"
    assert writers.vcf_header(["chr10", "chrX", "chr2"], {"AF": ("A", "Float", "f")})[1:4] == ["##contig=<ID=chr2>", "##contig=<ID=chr10>", "##contig=<ID=chrX>"]
    writers.write_sample_vcfs(records.drop("af", "id", "qual"), str(tmp_path / "v"))
    assert os.listdir(tmp_path / "v" / "sample=s1")
    writers.write_fasta(spark.createDataFrame([("a", "ACGT")], "name string, seq string"), str(tmp_path / "f"))
    assert readers.fasta(spark, str(tmp_path / "f")).first()["seq"] == "ACGT"
    writers.write_ranges(spark.range(10).toDF("id"), str(tmp_path / "r"), "id", 3)
    assert sorted(os.listdir(tmp_path / "r"))[-3:] == ["part=0", "part=1", "part=2"]
    writers.write_json({"b": 1, "a": 2}, str(tmp_path / "j"))
    assert (tmp_path / "j").read_text() == '{\n  "a": 2,\n  "b": 1\n}\n'
    assert "<td>" in writers.html_table(spark.range(2))


def test_trees(spark):
    rng = random.Random(6)
    rows = [(i, float(rng.gauss(i % 2, 0.5)), rng.random(), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    got = ml.train_and_predict(df, "id", ["a", "b"], rounds=5, depth=2)
    assert got.count() == 600 and ml.quality(got).where("split = 'test'").first()["auc"] > 0.8
    assert ml.class_weight(df.where("label = 0")) == 1.0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("1", 150, "A", "G"), ("chr1", 9000, "AT", "A"), ("chr2", 150, "A", "C")], "chrom string, pos long, ref string, alt string")
    rows.write.parquet(str(tmp_path / "in"))
    windows = spark.createDataFrame([("chr1", 100, 199, "w1"), ("chr1", 8999, 9500, "w2"), ("chr1", 0, 20000, "w3")], "chrom string, start0 long, end0 long, name string")
    stream = streaming.annotate_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), windows)
    q = stream.writeStream.format("memory").queryName("hits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r["pos"], r["name"]) for r in spark.table("hits").collect()) == [(150, "w1"), (150, "w3"), (9000, "w2"), (9000, "w3")]
    e = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value, 7L user_id union all select timestamp'2024-01-01 00:50:00', 'a', 2.0D, 7L")
    assert streaming.counts_by_window(e).first()["total"] == 3.0
    assert streaming.sessions(e).count() == 2


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = oracle.execute(f"select {', '.join(chr(34) + c + chr(34) for c in df.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    plain = lambda r: tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(plain, rows), key=key) == sorted(map(plain, want), key=key)


def test_anchored_windows_of_whole_texts(spark, tmp_path):
    import random

    from seqlume.operators.anchored import mutate
    from seqlume.plans import sequences

    rng = random.Random(3)
    texts = {i: "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((59, 60, 61, 90, 437))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for i, s in texts.items():
        for at in {*range(0, len(s) - 59, 30), *([len(s) - 60] if len(s) >= 60 else [])}:
            changes = [{"pos": at + 25, "ref": s[at + 25 : at + 28], "alt": s[at + 25]}, {"pos": at + 40, "ref": s[at + 40], "alt": s[at + 40] + "AC"}]
            want.add((i, at, mutate(s[at : at + 60], at, at + 20, at + 50, at + 30, "+", changes)))
    got = [(r["doc_id"], r["at"], r["mutated"]) for r in sequences.apply_anchored(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
