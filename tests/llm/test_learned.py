"""Jaccard join, n-gram model, toxicity, decontamination and the pipeline against plain versions."""

import collections
import math
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from seqlume.llm import common, decontaminate, jaccard_join, ngram_lm, toxicity

VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "lo", "mi", "ka")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def plain_components(rows, percent=75):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(rows[i][0], len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def near_copies(rng):
    rows, n = [], 0
    passage = prose(rng, 60)
    for _ in range(25):
        base = prose(rng, rng.choice([4, 12, 40, 120])).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            text = " ".join(w)
            rows.append((n, text if rng.random() < 0.7 else f"{passage} {text}"))
            n += 1
    chain = prose(rng, 100).split()  # each links to the next, the ends don't
    for k in range(5):
        rows.append((n + k, " ".join(chain[8 * k : 8 * k + 68])))
    return rows


@pytest.mark.parametrize("seed,hot_level", [(1, 14), (2, 2)])
def test_jaccard_join(spark, seed, hot_level):
    rng = random.Random(seed)
    rows = near_copies(rng)
    rows += [(500, None), (501, ""), (502, "Only Four words HERE"), (503, "only four WORDS here"), (504, rows[0][1]), (505, "w " * 3000), (506, "w " * 2999)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, fp long, n int, label int").repartition(4)
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(docs, hot_level=hot_level).collect())
    assert got == sorted(plain_components(rows))
    assert len({r[2] for r in got}) < len(rows) - 10


def test_jaccard_join_of_nothing_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 0, None)], key=str)
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def plain_lm(train, rows):
    toks = {i: (t or "").encode().lower().split() + [b"</s> end"] for i, t in rows}
    uni, bi = collections.Counter(), collections.Counter()
    for i in train:
        uni.update(toks[i])
        bi.update(zip([None] + toks[i][:-1], toks[i]))
    ctx, follow = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (v, w), n in bi.items():
        ctx[v][0] += n
        ctx[v][min(n, 3)] += 1
        follow[w] += 1

    def cut(values):
        k = collections.Counter(values)
        return [0, *ngram_lm.discounts(k[1], k[2], k[3], k[4])]

    d2, d1, n, v_ = cut(bi.values()), cut(follow.values()), sum(uni.values()), len(uni)
    total = sum(follow.values())
    off = sum(d1[min(x, 3)] for x in follow.values()) / total if total else 1

    def p(v, w):
        low = (follow[w] - d1[min(follow[w], 3)]) / total + off / (v_ + 1) if total else 1 / (v_ + 1)
        if v not in ctx:
            return low
        s = ctx[v]
        return (bi[v, w] - d2[min(bi[v, w], 3)]) / s[0] + sum(d2[k] * s[k] for k in (1, 2, 3)) / s[0] * low

    return {i: (len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 1) / (n + v_ + 1)) for w in t), sum(math.log10(p(v, w)) for v, w in zip([None] + t[:-1], t))) for i, t in toks.items()}


def test_language_model(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 60)) + " the of and" * rng.randint(0, 20)) for i in range(80)] + [(80, None), (81, ""), (82, "unseenwordsonly"), (83, "the " * 4000)]
    train = [i for i, _ in rows if i % 3]
    docs = spark.createDataFrame([(i, t, i % 3 != 0, 1.0) for i, t in rows], "doc_id long, text string, train boolean, score double").repartition(3)
    want = plain_lm(train, rows)
    got = {r["doc_id"]: r for r in ngram_lm.score(docs, ngram_lm.fit(docs, order=2)).collect()}
    for i, w in want.items():
        g = got[i]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:3]
        assert g["base_score"] == pytest.approx(w[3], rel=1e-9) and g["score"] == pytest.approx(w[4], rel=1e-9)


def plain_trigrams(train, rows):
    """Scores of the trigram model."""
    toks = {i: (t or "").encode().lower().split() + [b"</s> end"] for i, t in rows}
    grams = {i: list(zip([None, None, *t][: len(t)], [None, *t][: len(t)], t)) for i, t in toks.items()}
    counts = [collections.Counter(), collections.Counter(), collections.Counter(g for i in train for g in grams[i])]
    for k in (1, 0):
        counts[k].update(g[1:] for g in counts[k + 1])
    words = len({w for i in train for w in toks[i]})
    cut = []
    for c in counts:
        k = collections.Counter(c.values())
        cut.append([0, *ngram_lm.discounts(k[1], k[2], k[3], k[4])])
    sums = [collections.defaultdict(lambda: [0, 0.0]) for _ in counts]
    for k, c in enumerate(counts):
        for g, n in c.items():
            sums[k][g[:-1]][0] += n
            sums[k][g[:-1]][1] += cut[k][min(n, 3)]

    def p(g):
        low = p(g[1:]) if len(g) > 1 else 1 / (words + 1)
        k = len(g) - 1
        if g[:-1] not in sums[k]:
            return low
        n, off = sums[k][g[:-1]]
        return (counts[k][g] - cut[k][min(counts[k][g], 3)] + off * low) / n

    return {i: sum(math.log10(p(g)) for g in grams[i]) for i in toks}


def test_trigram_model(spark):
    rng = random.Random(6)
    few = VOCABULARY[:12]
    rows = [(i, " ".join(rng.choice(few) for _ in range(rng.randint(0, 60))) + " the of and" * rng.randint(0, 20)) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "unseenwordsonly"), (83, "the " * 4000), (84, "of the and of the and"), (85, " ".join(few[:6]))]
    train = [i for i, _ in rows if i % 3]
    docs = spark.createDataFrame([(i, t, i % 3 != 0) for i, t in rows], "doc_id long, text string, train boolean").repartition(3)
    want = plain_trigrams(train, rows)
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs, ngram_lm.fit(docs, order=3)).collect()}
    assert got == {i: pytest.approx(w, rel=1e-9) for i, w in want.items()}
    none = docs.where("false")
    model = ngram_lm.fit(none, order=3)
    assert {r["score"] for r in ngram_lm.score(docs, model).collect()} == {0.0}
    with pytest.raises(ValueError):
        ngram_lm.fit(docs, order=4)


def test_language_model_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, False)], "doc_id long, text string, train boolean")
    model = ngram_lm.fit(docs)
    assert {r["doc_id"]: (r["n_tokens"], r["score"], r["train_tokens"]) for r in ngram_lm.score(docs, model).collect()} == {1: (3, 0.0, 0), 2: (1, 0.0, 0)}
    assert ngram_lm.score(docs.limit(0), ngram_lm.fit(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        ngram_lm.mounted("hdfs://somewhere/x")


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = prose(rng, rng.randint(30, 80)).split()
        for _ in range(5 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["you idiot", "stupid", "grobbler", "1d10t", "YOU LOSER"]))
        rows.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(toxic)))
    rows += [(1000, None, None, None), (1001, "", "", 0.0), (None, "you stupid idiot", "", 0.0), (1002, "You stupid, pathetic idiot! " * 2000, "", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lexicon string, score double")
    marks = spark.createDataFrame([*labels, (1000, None), (None, 1), (3, 0), (999999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where("doc_id % 5 != 0"))
    assert "grobbler" in model.learned
    got = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], t) for i, t in labels if i % 5 == 0]
    assert sum((s >= 0.5) == bool(t) for s, t in held) / len(held) > 0.97
    assert got[1002] > 0.5 > got[1000] == got[1001]


def test_toxicity_without_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.fit(docs, none).score(docs).collect()] == [0.0, 0.0]
    assert toxicity.fit(docs.limit(0), none).score(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.fit(docs, one).score(docs).collect()} == {1.0}


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 20))] for _ in range(2))
        assert decontaminate.lcs_length(a, b) == plain_lcs(a, b)


def test_lcs_of_many_spans():
    rng = random.Random(1)
    for _ in range(100):
        items = [np.array([rng.randrange(9) for _ in range(rng.choice([1, 5, 64, 65, 130, 600]))], np.uint64) for _ in range(3)]
        words = np.array([rng.randrange(11) for _ in range(300)], np.uint64)
        masks = decontaminate.Masks(items)
        o = np.array([rng.randrange(3) for _ in range(8)])
        lo = np.array([rng.randrange(200) for _ in range(8)])
        hi = lo + np.array([rng.randint(1, 100) for _ in range(8)])
        want = [decontaminate.lcs_length(items[i].tolist(), words[a:b].tolist()) for i, a, b in zip(o, lo, hi)]
        assert masks.lcs(o, lo, hi, words, masks.number(words), 0.0).tolist() == want


def test_leaks_and_recall(spark):
    """Planted items, whole and with changed words, are found; everything a full comparison finds, too."""
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(14, 60)) + ".\n" + prose(rng, 6) + ".") for i in range(30)]
    rows, planted = [], set()
    for d in range(300):
        words = prose(rng, rng.randint(5, 300)).split()
        if d % 5 == 0:
            i = rng.randrange(30)
            item = items[i][1].split()
            if d % 10 == 0:  # a paraphrase: one word in twelve differs
                for _ in range(max(len(item) // 12, 1)):
                    item[rng.randrange(len(item))] = rng.choice(VOCABULARY)
            at = rng.randint(0, len(words))
            words[at:at] = item
            planted.add((d, i))
        rows.append((d, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "short"), (903, items[0][1].upper()), (903, items[0][1].upper())]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, cosine double")
    bench = spark.createDataFrame([(*i, "x") for i in items] + [(77, None, ""), (78, "", ""), (79, "...", "")], "item_id long, text string, doc_id string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()]
    assert got.count((903, 0)) == 2
    found = set(got) - {(903, 0)}
    assert len(found & planted) >= 0.9 * len(planted)
    assert all(p in found for p in planted if p[0] % 10)  # exact ones, all of them
    assert found <= planted
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, block_items=7).collect()}
    assert blocks - {(903, 0)} == found


@pytest.mark.parametrize("share", [0.34, 0.36, 0.39])
@pytest.mark.parametrize("least,most", [(15, 22), (24, 60)])
def test_leaks_with_rare_words(spark, least, most, share):
    """Items with a share of the words, up to what LCS still takes for a match, replaced by rare ones, against the LCS of
    all windows of all documents."""
    rng = random.Random(21)
    common = lambda n: " ".join(rng.choice(VOCABULARY[:120]) for _ in range(n))
    items = [(i, f"{common(rng.randint(least, most) - 6)}. {common(6)}.") for i in range(20)]
    rows = []
    for d in range(400):
        words = common(rng.randint(60, 300)).split()
        if d % 4 == 0:
            item = items[d // 4 % 20][1].replace(".", "").split()
            for k in rng.sample(range(len(item)), int(len(item) * share)):
                item[k] = "rare" + "".join(rng.choice("abcdefghij") for _ in range(6))
            at = rng.randint(0, len(words))
            words[at:at] = item
        rows.append((d, " ".join(words)))
    truth = set()
    for d, text in rows[::4]:
        words = text.split()
        for i, item in items:
            w = item.replace(".", "").split()
            spans = (words[k : k + len(w)] for k in range(len(words) - len(w) + 1))
            if any(decontaminate.lcs_length(w, x) >= 0.6 * len(w) and decontaminate.lcs_length(w[-6:], x) >= 3 for x in spans):
                truth.add((d, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = lambda **how: {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, **how).collect()}
    assert len(truth) > 80
    assert len(find() & truth) >= 0.95 * len(truth)  # the rest has a cosine under 0.5
    assert find(cosine=0.3) >= truth


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6, 1.0])
def test_lcs_of_many_spans(share):
    """Items of one, some and too many lanes, with repeated words, against the LCS of each pair."""
    rng = np.random.default_rng(4)
    items = [rng.integers(0, 40, n).astype(np.uint64) for n in (1, 5, 30, 64, 65, 200, 600)]
    words = np.concatenate([rng.integers(0, 60, 900).astype(np.uint64), items[3], items[5], items[6]])
    masks = decontaminate.Masks(items)
    ids = masks.number(words)
    o = rng.integers(0, len(items), 400)
    lo = rng.integers(0, len(words), 400)
    hi = np.minimum(lo + rng.integers(0, 300, 400), len(words))
    got = masks.lcs(o, lo, hi, words, ids, share)
    for k in range(400):
        want = decontaminate.lcs_length(items[o[k]].tolist(), words[lo[k] : hi[k]].tolist())
        assert got[k] == want if want >= share * len(items[o[k]]) else got[k] in (0, want)


def test_leaks_of_short_documents(spark):
    """Trimmed and condensed copies that are documents of their own and shorter than the item's windows."""
    rng = random.Random(12)
    items = [(i, prose(rng, n - 8) + ". " + prose(rng, 8) + ".") for i, n in enumerate((60, 120, 120, 400, 400))]
    rows, planted = [(d, prose(rng, rng.randint(20, 400))) for d in range(200)], set()
    for i, text in items:
        words = text.split()
        for share in (0.65, 0.75, 0.87, 0.95):
            drop = len(words) - int(share * len(words))
            copies = [words[drop:]]  # the end, with the answer
            gone = set(rng.sample(range(len(words) - 8), drop))
            copies.append([w for k, w in enumerate(words) if k not in gone])
            for copy in copies:
                planted.add((len(rows), i))
                rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == planted


def test_leaks_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some words that nobody wrote")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == docs.columns
        left = spark.createDataFrame(left.collect(), docs.schema)
        kept.append({r["doc_id"] for r in left.select("doc_id").collect()})
    assert kept[0] > kept[3] and all(a >= b for a, b in zip(kept, kept[1:]))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = plain_components(sorted((d, rows[d]) for d in kept[1]))
    assert kept[2] == {d for d, _, c in groups if d == c}
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept[3]


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory):
    """A table with null and repeated ids, repeated rows, null, empty and very long texts, and clashing columns."""
    rng = random.Random(12)
    folder = str(tmp_path_factory.mktemp("odd"))
    prose_ = lambda n: "the of and " + prose(rng, n)
    base, item = prose_(120), prose(rng, 40) + ".\n" + prose(rng, 6) + "."
    rows = [(i, prose_(rng.randint(60, 90)), "en", "a", 1, 1, "x", 0.5) for i in range(30)]
    rows += [(40, base, "en", "a", 1, 1, "x", 0.5)] * 3 + [(None, base, None, None, None, None, None, None), (7, base + " end", "en", "b", 1, 1, None, 0.1)]
    rows += [(None, prose_(80), "en", "a", 1, 1, "x", 0.5), (41, f"{prose_(60)} {item}", "en", "a", 1, 1, "x", 0.5), (41, prose_(75), "en", "a", 1, 1, "x", 0.5), (None, f"{item} {prose_(70)}", "en", "a", 1, 1, "x", 0.5)]
    rows += [(50, None, None, None, None, 1, "x", 0.5), (51, "", "", "", 0, 1, "x", 0.5), (52, prose_(30_000), "en", "a", 1, 1, "x", 0.5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id long, part string, score double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, base, item


def test_pipeline_with_odd_documents(spark, odd_documents):
    folder, rows, base, item = odd_documents
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    count = lambda df: collections.Counter(r["text"] for r in df.collect())
    good = corpus_pipeline.quality(spark, docs, folder)
    assert good.columns == docs.columns
    assert count(good) == collections.Counter(r[1] for r in rows if r[1])  # empty texts have too few words
    assert count(corpus_pipeline.toxic(spark, docs, folder)) == collections.Counter(r[1] for r in rows)  # one class only: no score of 0.5
    one = corpus_pipeline.duplicates(spark, docs, folder)
    assert one.columns == docs.columns
    left = one.collect()
    texts = collections.Counter(r[1] for r in rows)
    near = {base, base + " end"}
    assert [(r["doc_id"], r["text"]) for r in left if r["text"] in near] == [(7, base + " end")]
    assert collections.Counter(r["text"] for r in left if r["text"] not in near) == collections.Counter({t: n for t, n in texts.items() if t not in near})
    clean = corpus_pipeline.leaks(spark, docs, folder)
    assert clean.columns == docs.columns
    assert count(clean) == collections.Counter(r[1] for r in rows if item not in (r[1] or ""))
    packed = corpus_pipeline.packed(spark, docs, folder)
    assert packed.where("piece = 0").count() == len(rows)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()
    assert corpus_pipeline.run(spark, folder).where("piece = 0").count() == len({t for t in texts if t and t not in near and item not in t}) + 1


def test_pipeline_of_rows_that_are_not_in_files(spark, odd_documents):
    folder, rows, base, item = odd_documents
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
    few = spark.createDataFrame([(1, "same text here", None, None, None, None, None, None)] * 2, docs.schema)
    assert corpus_pipeline.duplicates(spark, few, folder).count() == 1


def test_running_sums_bound_the_common_subsequence():
    """No span's LCS is above the bound of its blocks, and the bound leaves few spans of frequent words."""
    rng = np.random.default_rng(11)
    size = decontaminate.STEP
    frequent, vocabulary = np.arange(1, 40, dtype=np.uint64), np.arange(1, 4000, dtype=np.uint64)
    text = lambda n: np.where(rng.random(n) < 0.6, rng.choice(frequent, n), rng.choice(vocabulary, n))
    items = [text(int(n)) for n in rng.integers(1, 60, 2 * decontaminate.CHUNK + 3)]
    counts = np.array([3, 0, 900, 8, 1201])
    words = text(int(counts.sum()))
    words[500 : 500 + len(items[7])] = items[7]
    masks = decontaminate.Masks(items)
    ids = masks.number(words)
    starts, row = decontaminate._blocks(counts, size)
    place = decontaminate._by_block(counts, starts, row)
    assert (np.sort(place[place < len(words)]) == np.arange(len(words))).all()
    o, begin = rng.integers(0, len(items), 3000), rng.integers(0, len(starts) - 1, 3000)
    o[0], begin[0] = 7, int(np.searchsorted(starts, 500, "right")) - 1
    end = np.minimum(begin + rng.integers(1, 15, 3000), len(starts))
    end[0] = begin[0] + 10
    most = decontaminate.Shared(masks, ids).most(np.append(ids, np.int32(masks.NONE))[place], o, begin, end)
    stops = np.append(starts[1:], len(words))
    lcs = np.array([decontaminate.lcs_length(items[i].tolist(), words[starts[a] : stops[b - 1]].tolist()) for i, a, b in zip(o, begin, end)])
    assert (most >= lcs).all() and most[0] >= len(items[7])
    assert (most >= 0.6 * masks.n[o]).mean() < 0.5


def test_ngram_places_are_found_in_plain_arrays(tmp_path):
    """Stored keys are found, others are not, and look-ups work on plain arrays, as slices of mapped ones are slow."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 17, 3000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        ngram_lm._save_keys(str(tmp_path), f"trigram-{n}", keys)
        arrays = ngram_lm.Arrays(str(tmp_path))
        begin, low = (arrays.array(f"trigram-{x}", n) for x in ("begin", "low"))
        assert type(begin) is np.ndarray and type(low) is np.ndarray
        assert (ngram_lm.find_short(begin, low, keys) == np.arange(len(keys))).all()
        assert (ngram_lm.find_short(begin, low, rng.integers(0, 2**64, 500, dtype=np.uint64)) == -1).all()
    some = rng.integers(0, 40, 500, dtype=np.uint64)
    keys, place, number = ngram_lm.distinct(some)
    assert (keys == np.unique(some)).all() and (some[place] == keys).all() and (keys[number] == some).all()
    assert [len(x) for x in ngram_lm.distinct(some[:0])] == [0, 0, 0]


def test_a_set_is_shuffled_only_to_where_it_is_compared(spark):
    sets = spark.createDataFrame([(k, bytes(8 * [k])) for k in range(1, 9)], "fp long, tokens binary")
    pairs = common.staged(spark.createDataFrame([(1, k) for k in range(2, 9)] + [(2, 3)], "a long, b long"), "pairs")
    for most in (1_000_000, 3):
        jaccard_join.BROADCAST_ROWS, kept = most, jaccard_join.BROADCAST_ROWS
        got = jaccard_join.compared(pairs, sets, ["tokens"], "<u8", lambda row: row[0][0] != row[1][0], stretch=3)
        jaccard_join.BROADCAST_ROWS = kept
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("strategy=broadcast") == 2) == (most > 3)


def test_postings_of_many_slices_share_their_blobs(spark):
    rng = random.Random(8)
    texts = [prose(rng, 80) for _ in range(60)]
    texts += texts[:5]
    level = SimpleNamespace(value=np.ones(1 << jaccard_join.SKETCH_BITS, np.uint8).tobytes())
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 5])], ["text"]) for k in range(0, 65, 5)]
    blobs = list(jaccard_join._postings(level, 5, 75, 4, 14)(iter(batches)))
    assert sum(b.num_rows for b in blobs) == 4  # one for each partition, however many slices
    assert list(jaccard_join._shared(iter(blobs), 75)) == [] or sum(b.num_rows for b in jaccard_join._shared(iter(blobs), 75)) == 0
    both = [b for part in (batches, batches[:1] + [pa.RecordBatch.from_arrays([pa.array([texts[0] + " more"])], ["text"])]) for b in jaccard_join._postings(level, 5, 75, 4, 14)(iter(part))]
    shared = pa.Table.from_batches(list(jaccard_join._shared(iter(both), 75))).to_pydict()
    assert len(set(shared["fp"])) == 2 and set(shared["n"]) == {76, 77} and len(set(shared["token"])) >= 10
