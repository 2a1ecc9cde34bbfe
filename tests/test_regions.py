"""Numbered lines, tables side by side, heat maps of regions and pooled outputs, against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqlume.operators import features, groups
from seqlume.sources import readers


def test_lines_of_files_in_many_splits(spark, tmp_path):
    rng = random.Random(2)
    files = {f"f{k}.txt": ["".join(rng.choice("abc é") for _ in range(rng.randrange(30))) for _ in range(n)] for k, n in enumerate((1, 90, 300, 7))}
    for name, text in files.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in text), encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "200b")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = readers.lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["path"].rsplit("/", 1)[1], r["line"], r["value"]) for r in got) == sorted((f, i, x) for f, text in files.items() for i, x in enumerate(text))


@pytest.mark.parametrize("n,m", [(0, 0), (5, 0), (0, 3), (40, 40), (70, 31)])
def test_pasted(spark, n, m):
    rng = random.Random(n)
    a, b = rng.sample(range(1000), n), rng.sample(range(1000), m)
    left = spark.createDataFrame([(x, None) for x in a], "x long, same string")
    right = spark.createDataFrame([(y,) for y in b], "y long")
    got = groups.pasted(left, right, "x", [F.desc("y")], parts=3).select("row_id", "x", "y").collect()
    a, b = sorted(a), sorted(b, reverse=True)
    assert sorted(map(tuple, got)) == [(i, a[i] if i < n else None, b[i] if i < m else None) for i in range(max(n, m))]


def test_pasted_refuses_equal_names(spark):
    one = spark.createDataFrame([(1,)], "x long")
    with pytest.raises(ValueError, match="rename x"):
        groups.pasted(one, spark.createDataFrame([(1,)], "X long"), "x", "X")
    with pytest.raises(ValueError, match="rename row_id"):
        groups.pasted(one, spark.createDataFrame([(1,)], "row_id long"), "x", "row_id")


def test_region_heatmap(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["AA", "AC", "GT", None]), rng.choice(["up", "ex", "dn"]), rng.randrange(4), rng.choice([None, rng.random()])) for _ in range(80)]
    rows += [("only", "dn", 0, 1.0), ("none", "up", 9, 2.0)]
    bins = {"up": [0, 1, 2], "ex": [0], "dn": [1, 3]}
    got = features.region_heatmap(spark.createDataFrame(rows, "kmer string, region string, bin int, effect double"), bins)
    assert got.columns == ["kmer", "up_0", "up_1", "up_2", "ex_0", "dn_1", "dn_3", "mean"]
    want = {}
    for k in {r[0] for r in rows if r[1] == "up"}:
        cells = []
        for r, bs in bins.items():
            for b in bs:
                x = [e for kk, rr, bb, e in rows if (kk, rr, bb) == (k, r, b) and e is not None]
                cells.append(sum(x) / len(x) if x else None)
        held = [c for c in cells if c is not None]
        want[k] = (*cells, sum(held) / len(held) if held else None)
    out = {r["kmer"]: tuple(r)[1:] for r in got.collect()}
    assert out.keys() == want.keys() and "only" not in out and out["none"] == (None,) * 7
    for k, v in want.items():
        assert out[k] == pytest.approx(v) if None not in v else [x is None for x in out[k]] == [x is None for x in v]


@pytest.mark.parametrize("floor", [0.0, None, -1.0])
def test_pooled_regions(spark, floor):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", "c"]), rng.choice([None, rng.uniform(-2, 1)]), rng.uniform(-3, -1)) for _ in range(40)] + [(9, "c", 0.5, -0.5)]
    got = features.pooled_regions(spark.createDataFrame(rows, "event long, region string, p double, `q.1` double"), ["event"], ["p", "q.1"], ["a", "b"], floor)
    best = defaultdict(list)
    for e, r, p, q in rows:
        best[e, r, 0] += [p] if p is not None else []
        best[e, r, 1].append(q)
    hold = lambda x: (max(x) if x else None) if floor is None else max([*x, floor])
    assert got.columns == ["event", "p_a", "q.1_a", "p_b", "q.1_b"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {e: tuple(hold(best[e, r, i]) for r in "ab" for i in (0, 1)) for e in {x[0] for x in rows}}
