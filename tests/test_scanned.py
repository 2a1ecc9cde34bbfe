"""Motif hits by p-value, strings of nested JSON, counts over sets of regions, against plain versions."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlume.operators import cohort, motifs, scan

BACKGROUND = (0.3, 0.2, 0.15, 0.35)


def matrix(width, seed):
    m = np.random.default_rng(seed).dirichlet([0.6] * 4, width)
    return m / m.sum(1, keepdims=True)


@pytest.mark.parametrize("width,pseudo", [(1, 0.0), (4, 0.1), (8, 0.0)])
def test_p_values_equal_the_enumeration_of_all_words(width, pseudo):
    t = motifs.score_table(matrix(width, width), BACKGROUND, pseudo, levels=50)
    words = np.array(list(itertools.product(range(4), repeat=width)))
    sums = t.weights[np.arange(width), words].sum(1)
    shares = np.prod(np.array(BACKGROUND)[words], axis=1)
    order = np.argsort(-sums, kind="stable")
    upto = np.cumsum(shares[order])
    for x in np.unique(sums):
        want = upto[np.searchsorted(-sums[order], -x, "right") - 1]
        assert t.survival[x] == pytest.approx(want, abs=1e-12)
    for p in (1e-4, 0.01, 0.3, 1.0):
        least = t.threshold(p)
        assert all((t.survival[x] <= p) == (x >= least) for x in np.unique(sums))


def plain_hits(rows, matrices, p_value, both):
    out = set()
    for name, seq in rows:
        for motif, m in matrices.items():
            t = motifs.score_table(m, BACKGROUND)
            for i in range(len(seq or "") - len(m) + 1):
                word = seq[i : i + len(m)].upper()
                if set(word) <= set("ACGT"):
                    for sign in "+-" if both else "+":
                        read = word if sign == "+" else word[::-1].translate(str.maketrans("ACGT", "TGCA"))
                        x = sum(int(t.weights[k]["ACGT".index(c)]) for k, c in enumerate(read))
                        if t.survival[x] <= p_value:
                            out.add((name, motif, i, sign, round(x / t.scale + t.least, 9), round(float(t.survival[x]), 12)))
    return out


@pytest.mark.parametrize("both", [False, True])
def test_hits(spark, both, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(motifs, "SLICE", 60)
    rows = [(f"s{i}", "".join(rng.choice("ACGTacgtN") for _ in range(rng.randrange(40)))) for i in range(60)] + [("none", None), ("empty", ""), ("odd", "ACéGTACGT漢ACGTAC"), ("long", "ACGT" * 100)]
    matrices = {"a": matrix(3, 1), "b": matrix(5, 2)}
    frame = spark.createDataFrame(rows, "name string, seq string").withColumn("motif", F.lit(1))
    for p in (0.02, 0.2, 1.0):
        got = motifs.motif_hits(frame, matrices, p, BACKGROUND, both_strands=both).collect()
        assert {(r["name"], r["motif"], r["start"], r["strand"], round(r["score"], 9), round(r["p_value"], 12)) for r in got} == plain_hits(rows, matrices, p, both)
        assert len(got) == len(set(got))
    assert motifs.motif_hits(frame.where("false"), matrices).count() == 0


def plain_strings(x, path="$"):
    if isinstance(x, str):
        yield path, x
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from plain_strings(v, f"{path}[{i}]")
    elif isinstance(x, dict):
        for k, v in x.items():
            if not (k.startswith(("image/", "audio/", "video/")) or k == "application/pdf"):
                yield from plain_strings(v, f"{path}.{k}" if k.isidentifier() and k.isascii() else f'{path}."{k}"')


def random_json(rng, depth):
    kind = rng.randrange(6 if depth else 3)
    if kind < 2:
        return rng.choice(["", "x", 'q"uote', "{not json}", "é"])
    if kind == 2:
        return rng.choice([1, 2.5, True, None])
    if kind == 3:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: random_json(rng, depth - 1) for k in rng.sample(["a", "b_1", "c d", "image/png", "application/pdf", "video/x", "é"], rng.randrange(4))}


def test_strings_of_nested_json(spark):
    rng = random.Random(6)
    values = [random_json(rng, 6) for _ in range(60)]
    deep = "bottom"
    for i in range(25):
        deep = [deep] if i % 2 else {"k": deep}
    values += ["top", deep, values[0]]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "no json"), (902, ""), (903, "{"), (904, "{}")]
    got = scan.json_strings(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    want = sorted((i, *p) for i, v in enumerate(values) for p in plain_strings(v))
    assert sorted(map(tuple, got)) == want and len(want) > 30
    assert scan.json_strings(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_region_sets(spark):
    rng = random.Random(8)
    sets = [(f"set{k:03d}", r) for k in range(130) for r in rng.sample(range(40), rng.randrange(1, 12))] + [("empty", 99), ("set000", 1), ("set000", 1), (None, 2), ("set001", None)]
    variants = [(rng.randrange(6), rng.randrange(45), rng.random() < 0.5) for _ in range(300)] + [(None, 1, True), (1, None, True)]
    samples = [(i, [1, 2, 2, 1, 9, None][i]) for i in range(6)]
    got = cohort.region_set_counts(spark.createDataFrame(variants, "sample long, region long, snv boolean"), spark.createDataFrame(sets, "region_set string, region long"), spark.createDataFrame(samples, "sample long, affection int"), {"variants": F.lit(True), "snvs": F.col("snv")})
    status = dict(samples)
    want = {}
    for name in {s for s, _ in sets if s}:
        regions = {r for s, r in sets if s == name and r is not None}
        inside = [v for v in variants if v[1] in regions]
        want[name] = tuple(sum(1 for v in inside if status.get(v[0]) == a and (v[2] or not only)) for a in (2, 1) for only in (False, True))
    assert got.columns == ["region_set", "affected_variants", "affected_snvs", "unaffected_variants", "unaffected_snvs"]
    assert {r["region_set"]: tuple(r)[1:] for r in got.collect()} == want
    with pytest.raises(ValueError, match="more than 5 region sets"):
        cohort.region_set_counts(spark.createDataFrame(variants, "sample long, region long, snv boolean"), spark.createDataFrame(sets, "region_set string, region long"), spark.createDataFrame(samples, "sample long, affection int"), {"n": F.lit(True)}, most=5)
