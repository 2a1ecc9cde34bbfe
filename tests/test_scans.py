"""Greedy choices and consensus sequences against plain versions, with variants on every border."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlume.operators import scans


def plain_greedy(rows):
    out, last = [], {}
    for r in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (str(r[0]), r[1], r[3])):
        if r[1] >= last.get(r[0], -(10**18)):
            out.append(r)
            last[r[0]] = r[2]
    return sorted(out, key=str)


@pytest.mark.parametrize("stretch,span,longest", [(1, 50, 9), (7, 400, 30), (50, 3000, 200), (10_000, 100, 1)])
def test_greedy_choice(spark, stretch, span, longest):
    rng = random.Random(stretch)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), (s := rng.randrange(span)), s + rng.randrange(0, longest + 1), i) for i in range(400)]
    rows += [("a", None, 5, 900), ("a", 5, None, 901), ("c", 10, 10, 902), ("c", 10, 10, 903), ("c", 10, 12, 904), ("c", 11, 12, 905)]
    frame = spark.createDataFrame(rows, "k string, s long, e long, n long")
    got = scans.greedy_without_overlaps(frame, ["k"], "s", "e", ["n"], stretch)
    assert got.columns == frame.columns and sorted(map(tuple, got.collect()), key=str) == plain_greedy(rows)


def test_one_large_group_in_many_tasks(spark):
    frame = spark.range(200_000).select(F.lit("x").alias("k"), (F.col("id") * 3).alias("s"), (F.col("id") * 3 + 1 + F.col("id") % 11).alias("e"))
    last, want = -1, 0
    for i in range(200_000):
        if 3 * i >= last:
            want, last = want + 1, 3 * i + 1 + i % 11
    got = scans.greedy_without_overlaps(frame, ["k"], "s", "e", stretch=5_000)
    assert got.count() == want
    assert scans.greedy_without_overlaps(frame.where("false"), ["k"], "s", "e").count() == 0


def test_steps_are_short_where_choices_meet():
    rng = np.random.default_rng(1)
    start = np.sort(rng.integers(0, 10**6, 20_000))
    here = scans.Stretch(np.zeros(20_000, np.int64), start, start + rng.integers(1, 200, 20_000))
    upto, last = here.steps(0)
    assert len(upto) <= 3 and upto[-1] == start[-1] and last[-1] == here.end[here.kept(int(start[-1]))[-1]]


def plain_consensus(seq, variants):
    out, at, last = [], 0, 0
    for pos, ref, alt in sorted(set(variants)):
        if pos < last:
            continue
        assert seq[pos : pos + len(ref)] == ref
        out += [seq[at:pos], alt.split(",")[0]]
        at = last = pos + len(ref)
    return "".join(out) + seq[at:]


@pytest.mark.parametrize("step", [1, 4, 10, 33, 1000])
def test_consensus(spark, step):
    rng = random.Random(step)
    genome = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("c1", 100), ("c2", 41), ("c3", 10))}
    variants = []
    for sample in "xy":
        for c in ("c1", "c2"):
            s = genome[c]
            for p in [*rng.sample(range(len(s)), 12), *range(8, len(s), 10)]:  # also on every border of 10
                n = min(rng.randrange(1, 25 if p % 10 == 8 and sample == "y" else 4), len(s) - p)
                variants.append((sample, c, p, s[p : p + n], rng.choice(["", "A", "GGG,T", "ACGTACGT"])))
    pieces = [(c, i, s[i : i + step]) for c, s in genome.items() for i in range(0, len(s), step)]
    rows = scans.consensus(spark.createDataFrame(pieces, "chrom string, chunk_start long, seq string"), spark.createDataFrame(variants, "sample string, chrom string, pos int, ref string, alt string"), stretch=6).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["chunk_start"]):
        done = got.setdefault((r["sample"], r["chrom"]), "")
        assert r["out_start"] == len(done)
        got[r["sample"], r["chrom"]] += r["mutated"]
    assert got == {(s, c): plain_consensus(genome[c], [v[2:] for v in variants if v[:2] == (s, c)]) for s in "xy" for c in ("c1", "c2")}


def test_consensus_tells_of_other_alleles(spark):
    chunks = spark.createDataFrame([("c", 0, "ACGT"), ("c", 4, "ACG")], "chrom string, chunk_start long, seq string")
    wrong = lambda *v: spark.createDataFrame([("s", "c", *v)], "sample string, chrom string, pos int, ref string, alt string")
    for v in ((3, "TC", "G"), (0, "G", "A")):
        with pytest.raises(Exception, match="reference allele mismatch in s c at"):
            scans.consensus(chunks, wrong(*v)).collect()
    assert [r["mutated"] for r in scans.consensus(chunks, wrong(3, "TC", "G"), check=False).orderBy("chunk_start").collect()] == ["ACGG", "CG"]
    assert scans.consensus(chunks, wrong(0, "A", "T").where("false")).count() == 0
