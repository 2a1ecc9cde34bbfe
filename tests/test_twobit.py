"""2bit files by range, and functions of intervals, motifs and bases against plain versions."""

import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlume.functions import sequence
from seqlume.operators import cohort, mutagenesis, scorers
from seqlume.sources import readers


def two_bit(sequences, order):
    """A file of name -> (bases, N blocks, masks)."""
    word = lambda *x: struct.pack(f"{order}{len(x)}I", *x)
    head, bodies = word(0x1A412743, 0, len(sequences), 0), []
    for bases, blocks, masks in sequences.values():
        codes = ["TCAG".index(c) for c in bases] + [0] * (-len(bases) % 4)
        packed = bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, len(codes), 4))
        lists = b"".join(word(len(x), *(a for a, _ in x), *(n for _, n in x)) for x in (blocks, masks))
        bodies.append(word(len(bases)) + lists + word(0) + packed)
    at = len(head) + sum(5 + len(n) for n in sequences)
    for name, body in zip(sequences, bodies):
        head += bytes([len(name)]) + name.encode() + word(at)
        at += len(body)
    return head + b"".join(bodies)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("size,overlap,bases", [(7, 0, 7), (10, 3, 25), (1000, 5, 10_000)])
def test_two_bit_by_range(spark, tmp_path, order, size, overlap, bases):
    rng = random.Random(size)
    letters = {n: "".join(rng.choice("ACGT") for _ in range(k)) for n, k in (("chr1", 103), ("chr2", 8), ("none", 0), ("x", 61))}
    blocks = {"chr1": [(0, 4), (50, 13), (101, 2)], "chr2": [], "none": [], "x": [(20, 30)]}
    path = tmp_path / "g.2bit"
    path.write_bytes(two_bit({n: (s, blocks[n], [(1, 2)] if len(s) > 5 else []) for n, s in letters.items()}, order))
    want = set()
    for n, s in letters.items():
        for a, k in blocks[n]:
            s = s[:a] + "N" * k + s[a + k :]
        want |= {(n, i, s[i : i + size + overlap]) for i in range(0, max(len(s), 1), size)}
    got = readers.two_bit(spark, str(path), size, overlap, bases)
    assert {tuple(r) for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == sum(-(-max(len(s), 1) // (max(bases // size, 1) * size)) for s in letters.values())


def test_other_files_are_told(spark, tmp_path):
    (tmp_path / "x.2bit").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception, match="no .2bit file"):
        readers.two_bit(spark, str(tmp_path / "x.2bit")).count()


def test_spans_do_not_overlap(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("ACT") for _ in range(rng.randrange(30))),) for _ in range(100)] + [("",), (None,), ("CATCATCAT",)]
    for motif, pattern in (("YCAY", "[CT]CA[CT]"), ("AA", "AA"), ("CATCAT", "CATCAT")):
        got = spark.createDataFrame(rows, "s string").select("s", sequence.motif_spans("s", motif).alias("m")).collect()
        assert [r["m"] and [tuple(x) for x in r["m"]] for r in got] == [s if s is None else [m.span() for m in re.finditer(pattern, s)] for s, in rows]


def test_interval_names(spark):
    names = ["E1", "E1_up", "E1_c1", "E1_c2_dn", "E1_ex", "putative_x_7", "putative_x_7_up", "putative_x_7_c1_dn", "", None]
    got = [tuple(r["p"]) for r in spark.createDataFrame([(n,) for n in names], "n string").select(sequence.interval_parts("n").alias("p")).collect()]
    assert got[:8] == [("E1", "mic", "ex"), ("E1", "mic", "up"), ("E1", "c1", "ex"), ("E1", "c2", "dn"), ("E1", "mic", "ex"), ("putative_microexon_7", "mic", "ex"), ("putative_microexon_7", "mic", "up"), ("putative_microexon_7", "c1", "dn")]


def test_annotated_variants(spark):
    events = spark.createDataFrame([("E1", "+", 0, 100, 110, 300), ("E2", "-", 110, 300, 0, 100)], "event string, strand string, upIntStart long, upIntEnd long, dnIntStart long, dnIntEnd long")
    rows = [("s1", "1", 91, "A", "T", "E1_up,E2_dn,E9"), ("s2", "1", 121, "A", "T", "E2_c1"), ("s3", "1", 5, "A", "T", None), ("s4", "1", 101, "AC", "T", "E1,E1")]
    variants = spark.createDataFrame(rows, "sample string, chrom string, pos int, ref string, alt string, intervals string")
    samples = spark.createDataFrame([("s1", 2), ("s2", 1)], "sample string, affection int")
    got = sorted((r["sample_id"], r["variant"], r["event"], r["affected_exon"], r["affected_region"], r["affection"] or "", r["mic_var_distance"]) for r in cohort.annotated_variants(variants, events, samples).collect())
    assert got == [("s1", "1:91:A:T", "E1", "mic", "up", "ASD", -9), ("s1", "1:91:A:T", "E2", "mic", "dn", "ASD", 9), ("s2", "1:121:A:T", "E2", "c1", "ex", "control", -10), *[("s4", "1:101:AC:T", "E1", "mic", "ex", "", 0)] * 2]
    with pytest.raises(Exception, match="no affection code: 3"):
        spark.range(1).select(cohort.affection_name(F.lit(3))).collect()


def test_base_codes(spark):
    got = spark.createDataFrame([("ACtgN-",), ("",), (None,)], "s string").select(sequence.base_codes("s").alias("c")).collect()
    assert [r["c"] for r in got] == [[0, 1, 2, 3, 6, 6], [], None]
    swapped = scorers.one_hot(["ACGTN"], "AGCT", 0.25)
    assert swapped.argmax(2)[0, :4].tolist() == [0, 2, 1, 3] and (swapped[0, 4] == np.float32(0.25)).all() and swapped.dtype == np.float32
    assert mutagenesis.kmer_words(2)[:5] == ["AA", "AC", "AG", "AT", "CA"] and len(mutagenesis.kmer_words(3)) == 64
