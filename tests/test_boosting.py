"""Boosted trees, their curves and their Shapley values against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlume.operators import boosting, groups
from seqlume.operators.boosting import LOSS_UNIT, UNIT, Model, Params, Tree
from seqlume.plans import learned

NAMES = ["a", "b", "c"]


def examples(n, seed, signal=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(6) / 2, rng.choice([None, 0.0, 1.0, math.nan]), rng.gauss(0, 1) if i % 3 else 0.25
        y = int(rng.random() < (0.85 if signal and a > 1 and b != 1.0 else 0.2))
        rows.append((i, a, b, c, y, "validation" if i % 4 == 0 else "train"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int, split string")


def plain_gradients(margin, y, weight):
    p = 1.0 / (1.0 + float(np.exp(-margin)))
    w = weight if y == 1 else 1.0
    return round((p - y) * w * UNIT), round(max(p * (1 - p), 1e-16) * w * UNIT)


def plain_weight(g, h, p):
    g, h = g / UNIT, h / UNIT
    w = -math.copysign(max(abs(g) - p.l1, 0.0), g) / (h + p.l2)
    w = min(max(w, -p.max_delta_step), p.max_delta_step) if p.max_delta_step else w
    return w, -(2 * g * w + (h + p.l2) * w * w) - 2 * p.l1 * abs(w)


def plain_tree(rows, margins, cuts, weight, p):
    """A nested dict: leaf {w} or {f, t, missing, l, r, gain, w}."""
    missing = lambda x: x is None or math.isnan(x)
    known = {id(r): plain_gradients(m, r[4], weight) for r, m in zip(rows, margins)}

    def grow(inside, depth):
        g, h = (sum(known[id(r)][k] for r in inside) for k in (0, 1))
        w, below = plain_weight(g, h, p)
        node, best = {"w": p.eta * w, "cover": h / UNIT}, boosting.LEAST_GAIN
        if depth == p.depth:
            return node
        for f, t, side in ((f, t, side) for f in range(3) for t in cuts[f] for side in (False, True)):
            left = [r for r in inside if (side if missing(r[1 + f]) else r[1 + f] < t)]
            lg, lh = (sum(known[id(r)][k] for r in left) for k in (0, 1))
            if lh < UNIT * p.min_child_weight or h - lh < UNIT * p.min_child_weight:
                continue
            gain = plain_weight(lg, lh, p)[1] + plain_weight(g - lg, h - lh, p)[1] - below
            if gain > best:
                best, node["split"] = gain, (f, t, side)
        if "split" in node:
            f, t, side = node["split"]
            goes = lambda r: side if missing(r[1 + f]) else r[1 + f] < t
            node["kids"] = grow([r for r in inside if goes(r)], depth + 1), grow([r for r in inside if not goes(r)], depth + 1)
            if not any("kids" in k for k in node["kids"]) and best < p.gamma:
                del node["kids"]
        return node

    return grow(rows, 0)


def plain_value(node, r):
    while "kids" in node:
        f, t, side = node["split"]
        x = r[1 + f]
        node = node["kids"][0 if (side if x is None or math.isnan(x) else x < t) else 1]
    return node["w"]


def plain_scores(rows, margins):
    """error, logloss, auc by pairs, area under precision and recall by fine steps."""
    p = [1.0 / (1.0 + math.exp(-m)) for m in margins]
    y = [r[4] for r in rows]
    error = sum((q > 0.5) != (t == 1) for q, t in zip(p, y)) / len(y)
    loss = sum(round(-math.log(max(q if t else 1 - q, 1e-16)) * LOSS_UNIT) for q, t in zip(p, y)) / LOSS_UNIT / len(y)
    pos, neg = [m for m, t in zip(margins, y) if t], [m for m, t in zip(margins, y) if not t]
    if not pos or not neg:
        return error, loss, None, None
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    area, tp, fp, steps = 0.0, 0, 0, 4000
    for m in sorted(set(margins), reverse=True):
        dp, dn = pos.count(m), neg.count(m)
        for k in range(steps if dp else 0):
            s = (k + 0.5) / steps
            area += dp / steps / len(pos) * (tp + dp * s) / (tp + dp * s + fp + dn * s)
        tp, fp = tp + dp, fp + dn
    return error, loss, auc, area


def plain_fit(rows, cuts, p):
    train, held = [r for r in rows if r[5] == "train"], [r for r in rows if r[5] == "validation"]
    positive = sum(r[4] for r in train)
    weight = (len(train) - positive) / positive if p.balance and 0 < positive < len(train) else 1.0
    margins, curve, best, least = {id(r): 0.0 for r in rows}, [], 0, math.inf
    for i in range(p.rounds):
        tree = plain_tree(train, [margins[id(r)] for r in train], cuts, weight, p)
        for r in rows:
            margins[id(r)] += plain_value(tree, r)
        for name, part in (("train", train), ("validation", held)):
            if part:
                curve.append((i, name, len(part), *plain_scores(part, [margins[id(r)] for r in part])))
        loss = curve[-1][4]
        if loss < least:
            best, least = i, loss
        if i - best >= p.early_stop:
            break
    return curve, best


@pytest.mark.parametrize("seed,params", [
    (1, Params(rounds=7, early_stop=7, depth=3, gamma=0.0, l1=0.0, block=3, eta=0.5)),
    (2, Params(rounds=12, early_stop=2, depth=2, gamma=0.5, block=5, eta=1.0)),
    (3, Params(rounds=3, early_stop=1, depth=4, gamma=2.0, max_delta_step=0.3, balance=False, block=1)),
])
def test_fit_equals_plain_version(spark, seed, params):
    rows = examples(160, seed, signal=seed != 2)
    model = boosting.fit(frame(spark, rows).repartition(5), NAMES, params=params)
    cuts = boosting.cut_points(frame(spark, [r for r in rows if r[5] == "train"]), NAMES, params.bins)
    curve, best = plain_fit(rows, cuts, params)
    assert [(r["round"], r["split"], r["n"]) for r in model.curve] == [c[:3] for c in curve] and model.best_round == best
    for r, c in zip(model.curve, curve):
        assert (r["error"], r["logloss"]) == pytest.approx(c[3:5], rel=1e-11)
        assert r["auc"] == pytest.approx(c[5], rel=1e-12) and r["aucpr"] == pytest.approx(c[6], rel=1e-5)
    got = {r["id"]: r["margin"] for r in model.predict(frame(spark, rows), "id").collect()}
    assert len(got) == len(rows) and all(math.isfinite(m) for m in got.values())


def test_stop_is_the_same_for_any_block(spark):
    rows = frame(spark, examples(120, 9, signal=False))
    fits = [boosting.fit(rows, NAMES, params=Params(rounds=8, early_stop=2, depth=2, block=b, eta=1.0, gamma=0.0)) for b in (1, 8)]
    assert fits[0].curve == fits[1].curve and fits[0].best_round == fits[1].best_round and fits[0].trees == fits[1].trees


def test_degenerate_inputs(spark):
    few = Params(rounds=2, depth=2, block=2)
    empty = boosting.fit(frame(spark, []), NAMES, params=few)
    assert empty.trees == [] and empty.curve == []
    assert [tuple(r) for r in empty.predict(frame(spark, examples(2, 1)), "id").collect()] == [(0, 0.0, 0.5), (1, 0.0, 0.5)]
    one = boosting.fit(frame(spark, [(i, 1.0, None, None, 1, "train") for i in range(5)]), NAMES, params=few)
    assert all(t.left == [-1] for t in one.trees) and [r["auc"] for r in one.curve] == [None, None] and one.curve[1]["logloss"] < one.curve[0]["logloss"] < math.log(2)
    odd = boosting.fit(frame(spark, [(1, 1.0, 1.0, 1.0, 5, "train"), (2, 1.0, 1.0, 1.0, None, "train"), (3, 1.0, 1.0, 1.0, 1, "test")]), NAMES, params=few)
    assert odd.curve == []


def test_model_is_saved(spark, tmp_path):
    rows = frame(spark, examples(80, 4))
    model = boosting.fit(rows, NAMES, params=Params(rounds=3, depth=3, gamma=0.0, block=3))
    model.save(spark, str(tmp_path / "model"))
    assert Model.load(spark, str(tmp_path / "model")) == model


def brute_shapley(tree, x):
    """Shapley values over the features by definition: unknown features follow the covers."""

    def value(node, known):
        if tree.left[node] < 0:
            return tree.value[node]
        f = tree.feature[node]
        a, b = tree.left[node], tree.right[node]
        if f in known:
            left = tree.missing_left[node] if math.isnan(x[f]) else x[f] < tree.threshold[node]
            return value(a if left else b, known)
        return (tree.cover[a] * value(a, known) + tree.cover[b] * value(b, known)) / tree.cover[node]

    n = len(x)
    out = []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (value(0, {*s, i}) - value(0, set(s))) for k in range(n) for s in itertools.combinations(rest, k)))
    return out, value(0, set())


def random_tree(rng, depth, features):
    tree = Tree()

    def grow(level, cover):
        node = tree.add(rng.uniform(-1, 1), cover)
        if level and rng.random() < 0.85:
            tree.feature[node], tree.threshold[node], tree.missing_left[node] = rng.randrange(features), rng.choice([-1.0, 0.0, 1.0]), rng.random() < 0.5
            part = rng.uniform(0.1, 0.9)
            a = grow(level - 1, cover * part)
            tree.left[node], tree.right[node] = a, grow(level - 1, cover * (1 - part))
        return node

    grow(depth, 100.0)
    return tree


def test_shapley_values_equal_the_definition():
    rng = random.Random(2)
    for _ in range(25):
        trees = [random_tree(rng, 4, 4) for _ in range(2)]
        x = np.array([[rng.choice([-2.0, -1.0, 0.0, 0.5, 1.0, math.nan]) for _ in range(4)] for _ in range(6)])
        got = boosting.tree_shapley(trees, x)
        for row, phi in zip(x, got):
            want = [brute_shapley(t, row) for t in trees]
            assert phi == pytest.approx(np.sum([w[0] for w in want], axis=0), abs=1e-12)
        assert boosting.expected_margin(trees) == pytest.approx(sum(w[1] for w in want), abs=1e-12)


def test_shapley_values_add_up(spark):
    rows = frame(spark, examples(120, 6))
    model = boosting.fit(rows, NAMES, params=Params(rounds=4, depth=4, gamma=0.0, l1=0.0, block=4, eta=0.5))
    margin = {r["id"]: r["margin"] for r in model.predict(rows, "id").collect()}
    got = boosting.shapley_values(model, rows.drop("b").withColumn("b", F.col("c") * 0 + 1), "id").collect()
    assert len(got) == 120 and all(r["expected"] + r["phi_a"] + r["phi_b"] + r["phi_c"] == pytest.approx(r["margin"], abs=1e-9) for r in got)
    assert any(abs(r["phi_a"]) > 0.1 for r in got)
    full = boosting.shapley_values(model, rows, "id").collect()
    assert all(r["margin"] == margin[r["id"]] for r in full)
    gone = boosting.shapley_values(model, rows.select("id", "a"), "id").collect()
    assert all(r["expected"] + r["phi_a"] + r["phi_b"] + r["phi_c"] == pytest.approx(r["margin"], abs=1e-9) for r in gone)


def test_queries(spark):
    curve = learned.boosted_curve(spark, "/root/testdata/sf0.001").collect()
    assert {r["split"] for r in curve} == {"train", "validation"} and len({r["best_round"] for r in curve}) == 1
    rows = learned.tree_shapley(spark, "/root/testdata/sf0.001")
    phi = [c for c in rows.columns if c.startswith("phi_")]
    assert phi == [f"phi_{f}" for f in learned.FEATURES]
    assert all(sum(r[c] for c in phi) + r["expected"] == pytest.approx(r["margin"], abs=1e-9) for r in rows.collect())


def test_carried_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), i, rng.choice([None, 1, 2, 3])) for i in range(300)]
    got = groups.carried_sums(spark.createDataFrame(rows, "k string, n long, x long"), ["k"], [F.desc("n")], {"s": "x"}, parts=7)
    want = {(k, n): sum(x2 or 0 for k2, n2, x2 in rows if k2 == k and n2 > n) for k, n, _ in rows}
    assert {(r["k"], r["n"]): r["s"] for r in got.collect()} == want
    whole = groups.carried_sums(spark.createDataFrame(rows, "k string, n long, x long"), [], ["n"], {"s": "x"}, parts=3)
    assert {r["n"]: r["s"] for r in whole.collect()} == {n: sum(r[2] or 0 for r in rows[:n]) for n in range(300)}
    assert groups.carried_sums(spark.createDataFrame([], "k string, n long, x long"), ["k"], ["n"], {"s": "x"}).count() == 0
