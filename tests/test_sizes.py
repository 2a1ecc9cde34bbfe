"""Steps that a small table with many pairs or generated rows takes: dealt out over tasks, with unchanged results."""

import random

import pytest
from pyspark.sql import functions as F

from seqlume.functions import scores
from seqlume.operators import features, groups, intervals, mutagenesis, scan, scans
from seqlume.plans import annotated, registry, sequences
from seqlume.sources.staging import staged

SF = "/root/testdata/sf0.001"


def test_rounded_as_sql_does(spark):
    values = [0.0, -1e-9, 0.0000005, -0.0000015, 1.2345675, -1.2345674, 12.5, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(scores.rounded("x", 6)).collect()]
    assert got == [0.0, 0.0, 1e-06, -2e-06, 1.234568, -1.234567, 12.5, None] and str(got[1]) == "0.0"


def test_pairs_are_dealt_out(spark):
    left = spark.createDataFrame([("1", i, i % 50, i % 50) for i in range(200)], "chrom string, i long, qstart long, qend long").coalesce(1)
    right = spark.createDataFrame([("1", j, j, j + 30) for j in range(20)], "chrom string, j long, start0 long, end0 long").coalesce(1)
    plain = intervals.overlap_join(left, right, width=10)
    dealt = intervals.overlap_join(left, right, width=10, parts=7)
    assert dealt.rdd.getNumPartitions() == 7
    pairs = lambda df: sorted(map(tuple, df.select("i", "j").collect()))
    assert pairs(plain) == pairs(dealt) and len(pairs(plain)) > 100


def test_annotate_windows_is_dealt_out(spark):
    assert registry.QUERIES["annotate_windows"](spark, SF).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_annotate_windows_shuffles_each_side_once(spark):
    df = registry.QUERIES["annotate_windows"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 3 and plan.count("REPARTITION_BY_NUM") == 2  # the third is of the counts by type
    again = [line for line in plan.split("\n") if "Sort [" in line]
    assert len(again) == 2 and all(line.count(" ASC ") == 4 for line in again)  # none for the join alone


def test_pairs_meet_in_order(spark):
    rng = random.Random(6)
    left = spark.createDataFrame([(i, rng.choice([None, *range(-90, 90)])) for i in range(300)], "i long, t long")
    right = spark.createDataFrame([(j, a, a + rng.choice([-1, 0, 7, 30])) for j in range(80) for a in [rng.randrange(-90, 90)]], "j long, start0 long, end0 long")
    want = sorted((i, j) for i, t in left.collect() for j, a, b in right.collect() if t is not None and a <= t <= b)
    met = intervals.overlap_join(left, right, chrom=None, left_span=("t", "t"), width=10, parts=3, order=(["t", "i"], ["start0", "j"]))
    tasks = [[(r["t"] // 10, r["t"], r["i"], r["start0"], r["j"]) for r in rows] for rows in met.rdd.glom().collect()]
    assert len(tasks) == 3 and all(rows == sorted(rows) for rows in tasks)
    assert sorted((r[2], r[4]) for rows in tasks for r in rows) == want and len(want) > 300
    one = [df.withColumn("chrom", F.lit("1")) for df in (left, right)]
    for got in (intervals.overlap_join(left, right, chrom=None, left_span=("t", "t"), width=10), intervals.overlap_join(*one, left_span=("t", "t"), width=10, parts=3, order=(["t"], ["start0"]))):
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_neither_side_of_dealt_pairs_is_broadcast(spark):
    one = [spark.range(9).select(F.lit("1").alias("chrom"), F.col("id").alias(n), F.col("id").alias(a), F.col("id").alias(b)) for n, a, b in (("i", "qstart", "qend"), ("j", "start0", "end0"))]
    met = intervals.overlap_join(*one, width=2, parts=7)
    assert met.count() == 9 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def plain_heatmap(effects, sequences, k, size):
    """The means of a heat map, by event, region and position one after another."""
    deltas = {}
    for e, r, p, d in effects:
        deltas.setdefault((e, r, p), []).append(d)
    mean = lambda v: sum(v) / len(v) if v else None
    position = {key: mean([d for d in v if d is not None]) for key, v in deltas.items() if None not in key}
    each = {}
    for e, r, s, first in sequences:
        for i in range(len(s or "") - k + 1):
            covered = [(e, r, first + i + j) for j in range(k) if (e, r, first + i + j) in position]
            if covered:
                each[e, r, first + i, s[i : i + k]] = mean([position[c] for c in covered if position[c] is not None])
    out = {}
    for (_, r, p, w), d in each.items():
        out.setdefault((r, w, p // size), []).append(d)
    return {key: mean([d for d in v if d is not None]) for key, v in out.items()}


def test_heatmap_over_borders_gaps_and_repeats(spark):
    rng = random.Random(4)
    sequences = [(e, r, "".join(rng.choice("ACé") for _ in range(rng.choice([0, 1, 2, 9, 40]))), rng.randrange(-30, 30)) for e in range(12) for r in ("up", "dn")]
    sequences += [sequences[3], (3, "up", "ACACACAC", 2), (3, "up", "ACACCCAC", 2), (4, "up", None, 0), (None, "up", "ACAC", 0), (50, "up", "ACAC", 0)]
    effects = [(e, r, p, rng.choice([None, rng.random()])) for e in range(12) for r in ("up", "dn") for p in range(-35, 75) if rng.random() < 0.6 for _ in range(rng.randrange(1, 3))]
    effects += [(None, "up", 1, 1.0), (3, None, 1, 1.0), (3, "up", None, 1.0)]
    rng.shuffle(effects)
    df = spark.createDataFrame(effects, "event int, region string, rel_pos int, delta double"), spark.createDataFrame(sequences, "event int, region string, seq string, first_pos int")
    for k, stretch in ((1, 4), (2, 7), (3, 500), (5, 2)):
        each = features.occurrences(*df, k, stretch).withColumn("bin", F.floor(F.col("pos") / 6)).groupBy("region", "kmer", "bin").agg(F.avg("delta").alias("effect"))
        got = {(r["region"], r["kmer"], r["bin"]): r["effect"] for r in each.collect()}
        assert got == pytest.approx(plain_heatmap(effects, sequences, k, 6)) and len(got) > 10
    assert features.motif_heatmap(df[0].limit(0), df[1], 2, F.lit(0)).count() == features.motif_heatmap(df[0], df[1].limit(0), 2, F.lit(0)).count() == 0


def test_heatmap_shuffles_no_row_for_each_position(spark):
    s = spark.createDataFrame([(1, "up", "ACGT" * 2000, 0)], "event int, region string, seq string, first_pos int")
    effects = s.select("event", "region", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("rel_pos")).withColumn("delta", F.col("rel_pos") * 1.0)
    plan = features.motif_heatmap(effects, s, 2, F.lit(0))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "rel_pos" not in [line for line in plan.split("\n") if "Aggregate" in line][-1]


def test_region_heatmap_needs_no_join(spark):
    df = registry.QUERIES["region_heatmap"](spark, SF)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_generated_substitutions_are_dealt_out(spark):
    assert annotated.tables(spark, SF)["ism"].rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_json_texts_are_dealt_out_and_parsed_once(spark, monkeypatch):
    levels = []
    monkeypatch.setattr(scan, "staged", lambda df, name: levels.append(staged(df, name)) or levels[-1])
    df = spark.range(50).coalesce(1).select("id", F.concat(F.lit('{"a": ["x", {"b c": "'), "id", F.lit('"}]}')).alias("t"))
    got = scan.json_strings(df, "id", "t")
    assert sorted(map(tuple, got.collect()))[:2] == [(0, '$.a[0]', "x"), (0, '$.a[1]."b c"', "0")] and got.count() == 100
    assert levels[0].schema["inside"].dataType.typeName() == "variant"
    assert levels[0].select(F.input_file_name()).distinct().count() >= 3


def test_coverage_difference_by_one_aggregate(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    b = spark.createDataFrame([(2,), (3,), (3,), (None,)], "k long")
    got = groups.coverage_difference(a, b, "k")
    assert sorted(map(tuple, got.collect())) == [(1, "left"), (3, "right")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, groups.coverage_difference(a, b.limit(0), "k").na.fill(0).collect())) == [(0, "left"), (1, "left"), (2, "left")]


def test_pairs_of_changes_carry_no_sequence(spark):
    df = spark.createDataFrame([(1, "ATCA" + "G" * 30)], "n int, s string")
    got = mutagenesis.double_changes(df, "n", "s", ["AT", "CA"])
    assert [tuple(r) for r in got.select("pos1", "pos2", "ref1", "alt1", "ref2", "alt2", "j").collect()] == [(0, 2, "A", "T", "C", "G", 0)]
    join = got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "Project [n#" in join and not any("Project [n#" in line and ", s#" in line and "pos#" in line for line in join.split("\n"))


def test_features_have_names_that_compile(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(sequences, "train_and_predict", lambda rows, key, features: asked.append(features) or rows)
    rows = sequences.gbt_train_predict(spark, SF)
    assert len(asked[0]) == 5 and all(c.isidentifier() for c in asked[0]) and {"doc_id", "label"} < set(rows.columns)


def test_consensus_deals_out_written_tables_only(spark, monkeypatch):
    seen = []
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for name in ("numbered", "carried_sums"):
        monkeypatch.setattr(scans, name, lambda df, *args, f=getattr(scans, name): seen.append(plan(df)) or f(df, *args))
    consensus = scans.consensus
    monkeypatch.setattr(scans, "consensus", lambda chunks, variants: seen.extend([plan(chunks), plan(variants)]) or consensus(chunks, variants))
    assert registry.QUERIES["consensus_chunks"](spark, SF).count() > 10
    assert len(seen) == 4 and not any(w in p for p in seen for w in ("Join", "Aggregate", "regexp_replace"))
