"""Distances, liftover, scorers, byte-stable output and packed genomes."""

import struct

import numpy as np
from pyspark.sql import functions as F

from seqlume.operators import intervals, mutagenesis, scorers, variants
from seqlume.sources import readers, writers


def test_distances(spark):
    events = spark.createDataFrame([("+", 10, 20, 26, 40), ("-", 26, 40, 10, 20)], "strand string, upIntStart long, upIntEnd long, dnIntStart long, dnIntEnd long")
    rows = events.crossJoin(spark.range(17, 29)).select("strand", "id", variants.event_distance(F.col("id")).alias("d"), variants.span_distance(F.col("id"), F.lit("AC")).alias("s")).collect()
    got = {(r["strand"], r["id"]): (r["d"]["distance"], r["d"]["region"]) for r in rows}
    assert [got["+", p] for p in (19, 20, 22, 23, 25, 26)] == [(-1, "up"), (0, "ex"), (2, "ex"), (-3, "ex"), (-1, "ex"), (0, "dn")]
    assert [got["-", p] for p in (19, 20, 22, 23, 25, 26)] == [(0, "dn"), (-1, "ex"), (-3, "ex"), (-4, "ex"), (0, "ex"), (-1, "up")]
    span = {r["id"]: r["s"] for r in rows if r["strand"] == "+"}
    assert [span[p] for p in (17, 18, 19, 20, 21, 23, 24, 25, 26, 28)] == [-1, 0, 0, 0, 1, -1, 0, 0, 0, 2]


def test_lift(spark):
    points = spark.createDataFrame([("chr1", 5), ("chr1", 150), ("chr2", 5)], "chrom string, pos long")
    blocks = spark.createDataFrame([("chr1", 0, 99, 1000), ("chr1", 140, 160, -7)], "chrom string, block_start long, block_end long, shift long")
    got = {(r["chrom"], r["pos"]): r["lifted"] for r in intervals.lift(points, blocks).collect()}
    assert got == {("chr1", 5): 1005, ("chr1", 150): 143, ("chr2", 5): None}


def test_scorers(spark):
    df = spark.createDataFrame([(1, "AACG"), (2, "TTTT"), (3, "ANN")], "i int, seq string")
    shifted = lambda: lambda s: scorers.base_shares()(s) + 0.5
    got = {r["i"]: r for r in scorers.ensemble(df, [scorers.base_shares, shifted], ["a", "c", "g", "t"]).collect()}
    assert np.isclose(got[1]["a_mean"], 0.75) and np.isclose(got[1]["a_sd"], 0.25) and np.isclose(got[2]["t_mean"], 1.25) and np.isclose(got[3]["a_mean"], 1 / 3 + 0.25)


def test_scan_positions(spark):
    x = spark.range(1).select(mutagenesis.scan_positions(F.lit(100), 2, F.lit(3), True).alias("a"), mutagenesis.scan_positions(F.lit(100), 2, F.lit(3), False).alias("d")).first()
    assert x["a"] == list(range(98, 106)) and x["d"] == list(range(95, 103))


def test_gzip_is_stable(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "i int, s string")
    a, b = (writers.write_gzip(df, str(tmp_path / n), ["i"]) for n in ("x.gz", "other.gz"))
    assert a == b and spark.read.option("header", True).csv(str(tmp_path / "x.gz")).count() == 2


def test_two_bit(spark, tmp_path):
    seq = "ACGTTGCANNNACGTACCGGT"
    code = {"T": 0, "C": 1, "A": 2, "G": 3, "N": 0}
    bits = "".join(f"{code[x]:02b}" for x in seq) + "0" * 6
    packed = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits) // 8 * 8, 8))
    head = struct.pack("<4I", 0x1A412743, 0, 1, 0) + bytes([4]) + b"chr1" + struct.pack("<I", 25)
    body = struct.pack("<2I", len(seq), 1) + struct.pack("<2I", 8, 3) + struct.pack("<2I", 0, 0) + packed
    (tmp_path / "g.2bit").write_bytes(head + body)
    got = {r["chunk_start"]: r["seq"] for r in readers.two_bit(spark, str(tmp_path / "g.2bit"), size=6, overlap=3).collect()}
    assert got == {b: seq[b : b + 9] for b in range(0, len(seq), 6)}


def test_left_overlap_keeps_repeated_rows(spark):
    from seqlume.operators import intervals

    left = spark.createDataFrame([("1", 5, 9, "a"), ("1", 5, 9, "a"), ("1", 50, 60, None), ("2", None, 3, "b")], "chrom string, qstart long, qend long, name string")
    right = spark.createDataFrame([("1", 1, 6, "x"), ("1", 1, 6, "x"), ("1", 9, 3000, "y")], "chrom string, start0 long, end0 long, hit string")
    got = sorted(((r["chrom"], r["name"], r["hit"]) for r in intervals.overlap_join(left, right, width=4, how="left").collect()), key=str)
    assert got == sorted([("1", "a", "x")] * 4 + [("1", "a", "y")] * 2 + [("1", None, "y"), ("2", "b", None)], key=str)
    assert sorted(r["hit"] or "" for r in intervals.overlap_join(left, right.limit(0), how="left").collect()) == [""] * 4


def test_numbered_by_several_columns(spark):
    from pyspark.sql import functions as F

    from seqlume.operators import groups

    rows = [(i % 7, None if i % 5 == 0 else i % 3, i) for i in range(60)]
    got = groups.numbered(spark.createDataFrame(rows, "a int, b int, c int"), ["a", F.asc_nulls_last("b"), "c"], parts=3).collect()
    want = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
    assert [(r["a"], r["b"], r["c"]) for r in sorted(got, key=lambda r: r["row_id"])] == want


def test_manifest_of_stretches(spark):
    import hashlib

    from pyspark.sql import functions as F

    from seqlume.operators import bundle

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [("p" if i % 3 else None, i, f"text {i}") for i in range(40)]
    got = {r["part"]: (r["sha256"], r["n"]) for r in bundle.manifest(spark.createDataFrame(rows, "part string, i long, text string"), "part", "i", "text", {"n": F.count("*")}, stretch=8).collect()}
    for part in ("p", None):
        mine = [r for r in rows if r[0] == part]
        cuts = [sha("".join(sha(t) for _, i, t in mine if i // 8 == c)) for c in range(5)]
        assert got[part] == (sha("".join(cuts)), len(mine))


def test_motifs_of_several_files(spark, tmp_path):
    from seqlume.sources import readers

    for name, first in (("a", 0.1), ("b", 0.7)):
        (tmp_path / f"{name}.meme").write_text(f"MOTIF M1 {name}\n {first} 0.1 0.1 0.1\n 0.2 0.2 0.3 0.3\n")
    got = sorted((r["motif_alt_id"], r["row"], r["probabilities"][0]) for r in readers.motifs(spark, str(tmp_path)).collect())
    assert got == [("a", 0, 0.1), ("a", 1, 0.2), ("b", 0, 0.7), ("b", 1, 0.2)]


def test_padded_window_beyond_a_piece(spark):
    from pyspark.sql import functions as F

    from seqlume.functions import sequence

    df = spark.createDataFrame([("ACGT", 10)], "s string, at long")
    cut = lambda a, b: df.select(sequence.padded_window("s", "at", F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert [cut(8, 12), cut(12, 16), cut(20, 23), cut(1, 4), cut(9, 15)] == ["NNAC", "GTNN", "NNN", "NNN", "NACGTN"]


def test_small_helpers(spark):
    from pyspark.sql import functions as F

    from seqlume.functions import scores, sequence
    from seqlume.operators import genome, groups

    df = spark.createDataFrame([("PASS", 5, 9, 2), (".", 12, 9, 2), (None, 1, 9, -8), ("q10", 9, 9, 0)], "f string, site long, pos long, change int")
    got = df.select(sequence.passes_filter("f").alias("ok"), genome.moved_site("site", "pos", F.col("change")).alias("moved"), F.size(genome.site_candidates(F.col("site"), F.col("change"))).alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, 5, 9), (True, 14, 9), (True, 1, 0), (False, 9, 7)]
    assert df.select(genome.site_score(F.array(F.lit(1.0), F.lit(3.0))).alias("x")).first()["x"] == 3.0
    assert [r["before"] for r in groups.prefix_sums(df, [], ["site"], F.col("change"), "before").orderBy("site").collect()] == [0, -8, -6, -6]
    assert df.where("f = 'PASS'").select(scores.require(F.col("pos") > 1, F.col("pos"), "no").alias("x")).first()["x"] == 9


def test_identifiers_and_genotypes(spark):
    from seqlume.functions import scores, sequence

    names = spark.createDataFrame([("e1_up-12_A:G",), ("e1_ex3_A:G",), ("a_b_c",), (None,), ("",)], "x string").select(sequence.mutation_id("x").alias("m")).collect()
    assert [r["m"] and tuple(r["m"]) for r in names] == [("e1", "up", -12, "A", "G"), ("e1", "ex", 3, "A", "G"), None, None, None]
    two = spark.createDataFrame([("ev_1_dn",)], "x string").select(sequence.event_region("x").alias("m")).first()["m"]
    assert tuple(two) == ("ev_1", "dn")
    rows = [
        ("PASS", "A", "G", "GT:AD:DP:GQ", "0/1:7,3:10:99", True), ("PASS", "A", "G", "GT:AD:DP:GQ", "0/1:7,3:10:98", False), ("PASS", "A", "GT", "GT:AD:DP:GQ", "0/1:7,3:10:90", True),
        ("PASS", "A", "G", "GT:AD:DP:GQ", "0/1:2,8:10:99", False), ("PASS", "A", "G", "GT:AD:DP:GQ", "1|1:2,8:10:25", True), ("PASS", "A", "G", "GT:AD:DP:GQ", "0/0:2,8:10:99", False),
        ("q10", "A", "G", "GT:AD:DP:GQ", "0/1:7,3:10:99", False), ("PASS", "A", "G", "GT:AD:DP:GQ", "0/1:7,3", False), (None, None, None, None, None, False), ("PASS", "A", "G", "GT:AD:DP:GQ", "./.:.:.:.", False), ("PASS", "A", "G", "GT:AD:DP:GQ", "0/1:0,0:0:99", False),
    ]
    got = spark.createDataFrame(rows, "f string, r string, a string, fmt string, s string, want boolean").select("want", sequence.good_genotype("f", "r", "a", "fmt", "s").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    values = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double").select(scores.row_mean(["a", "b", "c"]).alias("m"), scores.row_min(["a", "b", "c"]).alias("l"), scores.log2_fold_change("c", "a").alias("f")).collect()
    assert [r["m"] for r in values] == [2.0, None] and [r["l"] for r in values] == [1.0, None] and values[1]["f"] is None
