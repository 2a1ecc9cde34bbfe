"""Boosted trees with second-order gains, early stop and evaluation curves, as Spark jobs; Shapley values of trees.

Features are cut at approximate quantiles of the training rows once, and rows are kept as bin numbers. A level of a
tree is one scan of the training rows: each task adds up gradients and hessians by (node, feature, bin), Spark adds up
the tasks' histograms, and the driver, which sees nodes x features x bins numbers and no rows, picks the splits.
Gradients are whole multiples of 2**-24, so sums are exact: trees depend neither on partitions nor on repeated tasks.

Trees are grown to the full depth and then pruned from below: a split above two leaves whose gain is under gamma goes.
Rows' margins are written every `block` rounds, and the curves of these rounds come from one job that counts labels by
(round, split, margin) and carries sums through ranges of margins, so no task has to hold a split. The stopping rule
looks at every single round; rounds trained beyond the stop are thrown away.

Edge cases: a null or NaN feature is missing and goes where a split learned to send it (right where that makes no
difference); rows whose label isn't 0 or 1, or whose split is neither training nor validation, are left out of the fit;
without training rows, or with rows of one class only, trees are leaves or steps of that class's weight; areas are
null where a split has one class. Repeated rows weigh as often as they stand there; of equal gains the first feature,
the lower cut, and missing values to the right are taken. Columns clash with nothing, as only named ones are read.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlume.sources.staging import discard, staged

from .groups import carried_sums

UNIT = float(1 << 24)
LOSS_UNIT = float(1 << 40)
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Params:
    """eta: step; l1, l2: penalties of leaf weights; gamma: least gain of a split; early_stop: rounds without gain."""

    rounds: int = 1000
    early_stop: int = 100
    eta: float = 0.1
    depth: int = 4
    l2: float = 0.1
    l1: float = 0.8
    gamma: float = 0.5
    max_delta_step: float = 7.0
    min_child_weight: float = 1.0
    balance: bool = True
    bins: int = 64
    block: int = 10


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root, left is -1 at leaves. Values below a threshold go left."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, x in (("feature", 0), ("cut", 0), ("threshold", 0.0), ("missing_left", False), ("left", -1), ("right", -1), ("value", value), ("cover", cover), ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.value) - 1

    def route(self, goes_left) -> np.ndarray:
        """The leaf of every row; goes_left(node, rows) tells of rows at a node which go left."""
        at = np.zeros(goes_left.rows, np.int64)
        for node in range(len(self.value)):
            if self.left[node] >= 0:
                here = np.flatnonzero(at == node)
                if len(here):
                    at[here] = np.where(goes_left(self, node, here), self.left[node], self.right[node])
        return at


class _Binned:
    """Rows as bin numbers; -1 is missing."""

    def __init__(self, bins: np.ndarray):
        self.bins, self.rows = bins, len(bins)

    def __call__(self, tree: Tree, node: int, rows: np.ndarray) -> np.ndarray:
        b = self.bins[rows, tree.feature[node]]
        return np.where(b < 0, tree.missing_left[node], b <= tree.cut[node])


class _Raw:
    """Rows as feature values; not a number is missing."""

    def __init__(self, x: np.ndarray):
        self.x, self.rows = x, len(x)

    def __call__(self, tree: Tree, node: int, rows: np.ndarray) -> np.ndarray:
        x = self.x[rows, tree.feature[node]]
        return np.where(np.isnan(x), tree.missing_left[node], x < tree.threshold[node])


def _sum_of(trees: list[Tree], rows: _Binned | _Raw, begin: np.ndarray) -> Iterator[np.ndarray]:
    """Margins after each of the trees."""
    margin = begin
    for tree in trees:
        margin = margin + np.array(tree.value)[tree.route(rows)]
        yield margin


def _double(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names], axis=1) if names else np.empty((batch.num_rows, 0))


def _features(df: DataFrame, features: list[str]) -> list:
    return [F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]


def cut_points(train: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Cuts of every feature, increasing: approximate quantiles of the values that are there, the least value left out."""
    probs = [i / bins for i in range(1, bins)]
    here = train.select(*_features(train, features))
    known = [F.when(~F.isnan(c), F.col(c)) for c in here.columns]
    row = here.agg(*(F.percentile_approx(c, probs, 10_000).alias(f"q{i}") for i, c in enumerate(known)), *(F.min(c).alias(f"m{i}") for i, c in enumerate(known))).first()
    return [sorted({x for x in row[f"q{i}"] or [] if x > row[f"m{i}"]}) for i in range(len(features))]


def binned(df: DataFrame, features: list[str], cuts: list[list[float]], label: str, split: str) -> DataFrame:
    """(y, train, b, m): label, whether the row trains, its bin numbers and its margin so far. Written."""
    wanted = F.col(label).isin(0, 1) & F.col(split).isin("train", "validation")
    rows = df.where(wanted).select(F.col(label).cast("int").alias("y"), (F.col(split) == "train").alias("train"), *_features(df, features))
    names = [f"_f{i}" for i in range(len(features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _double(batch, names)
            b = np.stack([np.searchsorted(cuts[i], x[:, i], "right") for i in range(len(names))], axis=1) if names else np.empty(x.shape)
            b = np.where(np.isnan(x), -1, b).astype(np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * len(names), pa.int32()), pa.array(b.reshape(-1), pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("train"), lists, pa.array(np.zeros(len(b)))], ["y", "train", "b", "m"])

    return staged(rows.mapInArrow(run, "y int, train boolean, b array<smallint>, m double"), "boosting-rows")


def _bins_of(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return batch.column("b").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def gradients(margin: np.ndarray, y: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the log loss by the margin, in units of 1 / UNIT, positives weighted."""
    p = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(y == 1, weight, 1.0)
    return np.rint((p - y) * w * UNIT).astype(np.int64), np.rint(np.maximum(p * (1.0 - p), 1e-16) * w * UNIT).astype(np.int64)


def _histograms(rows: DataFrame, n: int, width: int, since: list[Tree], tree: Tree, frontier: list[int], weight: float) -> np.ndarray:
    """Sums of gradients and hessians, [2, node of the frontier, feature, bin], missing values in the last bin."""
    slot = np.full(len(tree.value), -1, np.int64)
    slot[frontier] = np.arange(len(frontier))
    cells = len(frontier) * n * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, cells), np.int64)
        for batch in batches:
            b = _bins_of(batch, n)
            at = _Binned(b)
            margin = batch.column("m").to_numpy()
            for margin in _sum_of(since, at, margin):
                pass
            node = slot[tree.route(at)]
            here = np.flatnonzero(node >= 0)
            cell = ((node[here, None] * n + np.arange(n)) * width + np.where(b[here] < 0, width - 1, b[here])).reshape(-1)
            for i, x in enumerate(gradients(margin[here], batch.column("y").to_numpy()[here], weight)):
                sums[i] += np.rint(np.bincount(cell, np.repeat(x, n), cells)).astype(np.int64)
        used = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0, used]), pa.array(sums[1, used])], ["cell", "g", "h"])

    out = np.zeros((2, cells), np.int64)
    summed = rows.where("train").select("y", "b", "m").mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    for r in summed.collect():  # nodes x features x bins at most
        out[:, r["cell"]] = r["g"], r["h"]
    return out.reshape(2, len(frontier), n, width)


def leaf_weight(g, h, p: Params):
    """The best weight of a leaf, and the gain of having it; g and h in units of 1 / UNIT."""
    g, h = np.asarray(g) / UNIT, np.asarray(h) / UNIT
    over = np.sign(g) * np.maximum(np.abs(g) - p.l1, 0.0)
    w = -over / (h + p.l2)
    w = np.clip(w, -p.max_delta_step, p.max_delta_step) if p.max_delta_step else w
    w = np.where(h + p.l2 > 0, w, 0.0)
    return w, -(2.0 * g * w + (h + p.l2) * w * w) - 2.0 * p.l1 * np.abs(w)


def _best_split(g: np.ndarray, h: np.ndarray, cuts: list[list[float]], p: Params) -> tuple[float, int, int, bool] | None:
    """(gain, feature, cut, missing to the left) of one node's histogram [feature, bin]."""
    width = g.shape[1]
    all_g, all_h = int(g[0].sum()), int(h[0].sum())
    below = leaf_weight(all_g, all_h, p)[1]
    known_g, known_h = np.cumsum(g[:, :-1], 1)[:, : width - 2], np.cumsum(h[:, :-1], 1)[:, : width - 2]
    left_g = np.stack([known_g, known_g + g[:, -1:]], axis=2)
    left_h = np.stack([known_h, known_h + h[:, -1:]], axis=2)
    gain = leaf_weight(left_g, left_h, p)[1] + leaf_weight(all_g - left_g, all_h - left_h, p)[1] - below
    least = max(int(math.ceil(p.min_child_weight * UNIT)), 1)
    allowed = (left_h >= least) & (all_h - left_h >= least) & (np.arange(width - 2)[None, :, None] < np.array([len(c) for c in cuts])[:, None, None])
    gain = np.where(allowed, gain, -np.inf)
    if not gain.size or not gain.max() > LEAST_GAIN:
        return None
    f, c, left = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain.max()), int(f), int(c), bool(left)


def _grown(rows: DataFrame, cuts: list[list[float]], since: list[Tree], weight: float, p: Params) -> Tree:
    width = max((len(c) for c in cuts), default=0) + 2
    tree, frontier = Tree(), [0]
    tree.add(0.0, 0.0)
    for level in range(p.depth):
        g, h = _histograms(rows, len(cuts), width, since, tree, frontier, weight)
        following = []
        for i, node in enumerate(frontier):
            if level == 0:
                tree.value[0], tree.cover[0] = p.eta * float(leaf_weight(int(g[i, 0].sum()), int(h[i, 0].sum()), p)[0]), int(h[i, 0].sum()) / UNIT
            found = _best_split(g[i], h[i], cuts, p)
            if found is None:
                continue
            gain, f, c, missing_left = found
            left_g = int(g[i, f, : c + 1].sum()) + (int(g[i, f, -1]) if missing_left else 0)
            left_h = int(h[i, f, : c + 1].sum()) + (int(h[i, f, -1]) if missing_left else 0)
            children = [tree.add(p.eta * float(leaf_weight(a, b, p)[0]), b / UNIT) for a, b in ((left_g, left_h), (int(g[i, f].sum()) - left_g, int(h[i, f].sum()) - left_h))]
            tree.feature[node], tree.cut[node], tree.threshold[node], tree.missing_left[node], tree.gain[node] = f, c, cuts[f][c], missing_left, gain
            tree.left[node], tree.right[node] = children
            following += children
        frontier = following
        if not frontier:
            break
    return pruned(tree, p.gamma)


def pruned(tree: Tree, gamma: float) -> Tree:
    """Without splits above two leaves whose gain is under gamma, again and again from below; nodes renumbered."""
    for node in reversed(range(len(tree.value))):  # children have higher numbers
        left, right = tree.left[node], tree.right[node]
        if left >= 0 and tree.left[left] < 0 and tree.left[right] < 0 and tree.gain[node] < gamma:
            tree.left[node] = tree.right[node] = -1
    kept, new = [0], Tree()
    for node in kept:
        kept += [tree.left[node], tree.right[node]] if tree.left[node] >= 0 else []
    number = {node: i for i, node in enumerate(kept)}
    for node in kept:
        i = new.add(tree.value[node], tree.cover[node])
        if tree.left[node] >= 0:
            for name in ("feature", "cut", "threshold", "missing_left", "gain"):
                getattr(new, name)[i] = getattr(tree, name)[node]
            new.left[i], new.right[i] = number[tree.left[node]], number[tree.right[node]]
    return new


def curves(counted: DataFrame) -> DataFrame:
    """Rows (round, train, n, error, logloss, auc, aucpr) from rows (round, train, margin, pos, neg).

    The area under precision and recall takes false positives as growing evenly between two margins.
    """
    above = carried_sums(counted, ["round", "train"], [F.desc("margin")], {"tp0": "pos", "fp0": "neg"})
    p = 1 / (1 + F.exp(-F.col("margin")))
    loss = lambda x: F.rint(-F.log(F.greatest(x, F.lit(1e-16))) * LOSS_UNIT).cast("decimal(38,0)")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    totals = counted.groupBy("round", "train").agg(F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"))
    rows = above.join(totals, ["round", "train"]).withColumns({"tp": F.col("tp0") + F.col("pos"), "fp": F.col("fp0") + F.col("neg")})
    # precision over recall r between two margins is r / (a r + b)
    slope = F.try_divide("neg", "pos")
    a, b = 1 + slope, F.try_divide(F.col("fp0") - slope * F.col("tp0"), F.col("p_all"))
    r0, r1 = F.try_divide("tp0", "p_all"), F.try_divide("tp", "p_all")
    bent = (r1 - r0 - b / a * (F.log(a * r1 + b) - F.log(a * r0 + b))) / a
    area = F.when(F.col("pos") == 0, 0.0).when(F.abs(b) < 1e-300, (r1 - r0) / a).otherwise(bent)
    wrong = F.when(p > 0.5, F.col("neg")).otherwise(F.col("pos"))
    out = rows.groupBy("round", "train", "p_all", "n_all").agg(
        F.sum(wrong).alias("wrong"),
        F.sum(whole("pos") * loss(p) + whole("neg") * loss(1 - p)).alias("loss"),
        F.sum(whole("neg") * (whole("tp0") + whole("tp"))).alias("under"),
        F.sum(area).alias("area"),
    )
    n, both = F.col("p_all") + F.col("n_all"), (F.col("p_all") > 0) & (F.col("n_all") > 0)
    return out.select(
        "round", "train", n.alias("n"), (F.col("wrong") / n).alias("error"), (F.col("loss").cast("double") / LOSS_UNIT / n).alias("logloss"),
        F.when(both, F.col("under").cast("double") / (2.0 * F.col("p_all") * F.col("n_all"))).alias("auc"), F.when(both, F.col("area")).alias("aucpr"),
    )


def _counted(rows: DataFrame, n: int, trees: list[Tree], first: int) -> DataFrame:
    """(round, train, margin, pos, neg): labels by margin after each of the trees; trees are numbered from `first`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, train = batch.column("y").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            for i, margin in enumerate(_sum_of(trees, _Binned(_bins_of(batch, n)), batch.column("m").to_numpy())):
                value, at = np.unique(margin, return_inverse=True)
                for part in (True, False):
                    here = train == part
                    pos, neg = (np.bincount(at[here & (y == k)], minlength=len(value)) for k in (1, 0))
                    used = np.flatnonzero(pos + neg)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), first + i), pa.int32()), pa.array(np.full(len(used), part)), pa.array(value[used]), pa.array(pos[used], pa.int64()), pa.array(neg[used], pa.int64())], ["round", "train", "margin", "pos", "neg"])

    cells = rows.mapInArrow(run, "round int, train boolean, margin double, pos long, neg long")
    return cells.groupBy("round", "train", "margin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _moved(rows: DataFrame, n: int, trees: list[Tree]) -> DataFrame:
    """The rows with the trees added to their margins. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, margin = _sum_of(trees, _Binned(_bins_of(batch, n)), batch.column("m").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("train"), batch.column("b"), pa.array(margin)], ["y", "train", "b", "m"])

    return staged(rows.mapInArrow(run, rows.schema), "boosting-rows")


@dataclass
class Model:
    """features: names in order; curve: a dict for each round and split; best_round: that of least validation loss."""

    features: list[str]
    trees: list[Tree]
    curve: list[dict]
    best_round: int
    params: Params

    def used(self) -> list[Tree]:
        """The trees up to the best round."""
        return self.trees[: self.best_round + 1]

    def curve_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) + (self.best_round,) for r in self.curve], "round int, split string, n long, error double, logloss double, auc double, aucpr double, best_round int")

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """Rows (key, margin, probability) by the trees up to the best round."""
        trees, names = self.used(), [f"_f{i}" for i in range(len(self.features))]
        rows = df.select(F.col(key), *_features(df, self.features))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margin = np.zeros(batch.num_rows)
                for margin in _sum_of(trees, _Raw(_double(batch, names)), margin):
                    pass
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margin), pa.array(1.0 / (1.0 + np.exp(-margin)))], [key, "margin", "probability"])

        return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("margin", T.DoubleType()), T.StructField("probability", T.DoubleType())]))

    def save(self, spark: SparkSession, path: str) -> None:
        """A folder with the trees as a table of nodes, and one row of JSON with all else."""
        nodes = [(t, i, *(getattr(tree, f)[i] for f in asdict(tree))) for t, tree in enumerate(self.trees) for i in range(len(tree.value))]
        schema = "tree int, node int, feature int, cut int, threshold double, missing_left boolean, left int, right int, value double, cover double, gain double"
        spark.createDataFrame(nodes, schema).coalesce(1).write.parquet(f"{path}/nodes")
        rest = json.dumps({"features": self.features, "curve": self.curve, "best_round": self.best_round, "params": asdict(self.params)})
        spark.createDataFrame([(rest,)], "value string").coalesce(1).write.text(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        rest = json.loads(spark.read.text(f"{path}/model").first()["value"])
        trees: list[Tree] = []
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():  # a model's nodes
            if r["tree"] == len(trees):
                trees.append(Tree())
            for name in asdict(trees[-1]):
                getattr(trees[-1], name).append(r[name])
        return Model(rest["features"], trees, rest["curve"], rest["best_round"], Params(**rest["params"]))


def fit(df: DataFrame, features: list[str], label: str = "label", split: str = "split", params: Params = Params()) -> Model:
    """Trees that learn from the rows whose split is `train`; the loss of `validation` says when to stop.

    The best round is the first with the least validation loss (of training rows where there are no others); training
    ends when early_stop rounds have passed since.
    """
    spark = df.sparkSession
    train = df.where(F.col(label).isin(0, 1) & (F.col(split) == "train"))
    cuts = cut_points(train, features, params.bins)
    rows = binned(df, features, cuts, label, split)
    n = rows.groupBy("train", "y").count().collect()  # four rows at most
    count = {(r["train"], r["y"]): r["count"] for r in n}
    positive, negative = count.get((True, 1), 0), count.get((True, 0), 0)
    weight = negative / positive if params.balance and positive and negative else 1.0
    judged = any((False, y) in count for y in (0, 1))
    trees: list[Tree] = []
    curve: list[dict] = []
    best, best_loss, done = 0, math.inf, not count or not features
    while not done and len(trees) < params.rounds:
        since: list[Tree] = []
        for _ in range(min(params.block, params.rounds - len(trees))):
            since.append(_grown(rows, cuts, since, weight, params))
        told = curves(_counted(rows, len(features), since, len(trees))).collect()  # two rows a round
        for r in sorted(told, key=lambda r: (r["round"], not r["train"])):
            curve.append({"round": r["round"], "split": "train" if r["train"] else "validation"} | {k: r[k] for k in ("n", "error", "logloss", "auc", "aucpr")})
            if r["train"] != judged and r["logloss"] < best_loss:
                best, best_loss = r["round"], r["logloss"]
            if r["train"] != judged and r["round"] - best >= params.early_stop:
                done = True
                break
        trees += since
        if not done and len(trees) < params.rounds:
            before, rows = rows, _moved(rows, len(features), since)
            discard(before)
    discard(rows)
    last = curve[-1]["round"] if curve else -1
    return Model(features, trees[: last + 1], curve, best, params)


# --- Shapley values ----------------------------------------------------------------------------------------


def _paths(tree: Tree) -> list[tuple[float, dict[int, tuple[float, list[tuple[int, bool]]]]]]:
    """Each leaf's value with, by feature, the share of cover that follows its path there and the (node, left) steps."""
    out, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        if tree.left[node] < 0:
            out.append((tree.value[node], path))
            continue
        for child, left in ((tree.left[node], True), (tree.right[node], False)):
            share, steps = path.get(tree.feature[node], (1.0, []))
            part = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.5
            todo.append((child, path | {tree.feature[node]: (share * part, [*steps, (node, left)])}))
    return out


def expected_margin(trees: list[Tree]) -> float:
    """The trees' mean margin over the rows that they learned from, by cover."""
    return sum(value * math.prod(share for share, _ in path.values()) for tree in trees for value, path in _paths(tree))


def tree_shapley(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Shapley values [row, feature] of the margin, features that are not known following the cover of a split.

    A leaf counts for a set of known features with the product of 1 or 0 for each of them (whether the row follows the
    path there) and of the covers' shares for the others. Coefficients of the product of (share + follows t) over the
    other features are these sums by size of the set; sizes have Shapley's weights.
    """
    rows, out = _Raw(x), np.zeros(x.shape)
    for tree in trees:
        goes_left = {node: rows(tree, node, np.arange(len(x))) for node in range(len(tree.value)) if tree.left[node] >= 0}
        for value, path in _paths(tree):
            if not path:
                continue
            features = list(path)
            share = np.array([path[f][0] for f in features])
            follows = np.stack([np.logical_and.reduce([goes_left[node] == left for node, left in path[f][1]]) for f in features]).astype(np.float64)
            d = len(features)
            weight = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
            for i, f in enumerate(features):
                sums = np.zeros((d, len(x)))
                sums[0] = 1.0
                for j in itertools.chain(range(i), range(i + 1, d)):
                    sums[1:] = sums[1:] * share[j] + sums[:-1] * follows[j]
                    sums[0] *= share[j]
                out[:, f] += value * (follows[i] - share[i]) * np.tensordot(weight, sums, 1)
    return out


def shapley_values(model: Model, df: DataFrame, key: str) -> DataFrame:
    """Rows (key, expected, margin, one column phi_<feature> for each feature): what each feature adds to the margin.

    Missing columns count as missing values. expected plus all phi is the margin.
    """
    trees, names = model.used(), [f"_f{i}" for i in range(len(model.features))]
    there = [F.col(f) if f in df.columns else F.lit(None) for f in model.features]
    rows = df.select(F.col(key), *(c.cast("double").alias(n) for c, n in zip(there, names)))
    mean = expected_margin(trees)
    columns = ["expected", "margin", *(f"phi_{f}" for f in model.features)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _double(batch, names)
            margin = np.zeros(len(x))
            for margin in _sum_of(trees, _Raw(x), margin):
                pass
            phi = tree_shapley(trees, x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), mean)), pa.array(margin), *(pa.array(phi[:, i]) for i in range(len(names)))], [key, *columns])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], *(T.StructField(c, T.DoubleType()) for c in columns)]))
