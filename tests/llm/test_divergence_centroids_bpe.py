"""Source divergence, centroid clustering and byte-level BPE against plain versions, with their edge cases."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from seqlume.llm import byte_bpe, centroids, divergence

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- source divergence -------------------------------------------------------------------------------------


def plain_audit(docs, min_docs, top):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    docs = [(s or "", g or "", c or "") for s, g, c in docs]
    count, held, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in docs:
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        terms = [t.translate(low) for t in terms]
        for t in terms:
            count[lang, source, t] += 1
        for t in set(terms):
            held[lang, t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (g, t), n in held.items() if g == lang and n >= min_docs]
        total = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        share = lambda n, of: 1 + 1_000_000_000 * (n + 5) // (of + 5 * len(kept))
        p = {s: {t: share(count[lang, s, t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s})
            own = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s, t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, o.decode(), -v, i + 1) for part, rows in (("pair", pair), ("term", own)) for i, (v, o) in enumerate(rows)}
    return out


def words(rng, n, most):
    return " ".join(rng.choice(["Ab", "ab", "é", "straße", "x", "y1z", "漢字", "w%d" % rng.randrange(40)]) for _ in range(rng.randrange(n, most)))


@pytest.mark.parametrize("min_docs,top", [(1, 3), (4, 50), (1000, 50)])
def test_divergence_equals_plain_version(spark, min_docs, top):
    rng = random.Random(min_docs)
    docs = [(words(rng, 0, 30), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "ä", "z"])) for _ in range(120)]
    docs += [(None, "en", None), ("", None, "a"), ("only here", None, "b"), ("7 8 9", "fr", "lone"), (docs[0][0], *docs[0][1:]), ("Ab " * 5000, "en", "a")]
    frame = spark.createDataFrame([(i, *d, 1) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, term int")
    rows = divergence.audit(frame, min_docs, top).collect()
    assert {tuple(r) for r in rows} == plain_audit(docs, min_docs, top) and len(rows) == len(set(rows))


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_divergence_tallies_across_blocks(spark, monkeypatch):
    """Small blocks and batches: a term's rows may be cut by both."""
    rng = random.Random(5)
    docs = [(words(rng, 5, 40), "en", rng.choice("abcd")) for _ in range(60)]
    rows = [(lang, s, t) for text, lang, s in docs for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower())]
    counts = collections.Counter(rows)
    terms = sorted({t for _, _, t in counts})
    table = [(lang, s, t, n) for (lang, s, t), n in sorted(counts.items(), key=lambda x: (x[0][2], x[0][1]))]
    first = [i == 0 or table[i - 1][2] != r[2] for i, r in enumerate(table)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in table]), pa.array([r[2] for r in table]), pa.array([r[1] for r in table]), pa.array([r[3] for r in table]), pa.array(first)], ["lang", "term", "source", "n", "first"])
    monkeypatch.setattr(divergence, "BLOCK", 7)
    monkeypatch.setattr(divergence, "CELLS", 8)
    got = collections.Counter()
    for out in divergence._cells(batch.slice(i, 3) for i in range(0, len(table), 3)):
        for r in out.to_pylist():
            got[r["a"], r["b"], r["na"], r["nb"]] += r["m"]
    want = collections.Counter()
    for a, b in [(a, b) for a in "abcd" for b in "abcd" if a < b]:
        for t in terms:
            if (x := counts["en", a, t]) and (y := counts["en", b, t]):
                want[a, b, x, y] += 1
                want[a, b, x, 0] -= 1
                want[a, b, 0, y] -= 1
    assert {k: v for k, v in got.items() if v} == dict(want)


# --- centroid clustering -----------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in usable if i is not None)
    centres = [v for _, v in hashed[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in usable]
        for j in range(len(centres)):
            own = [v for (_, v), c in zip(usable, found) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(v)[::-1]) for i, v in usable]
    inertia = collections.Counter()
    for _, c, d in found:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found), key=str)


@pytest.mark.parametrize("dims,k,n", [(64, 16, 300), (5, 4, 60), (64, 16, 9)])
def test_clusters_equal_plain_version(spark, dims, k, n):
    rng = np.random.default_rng(dims + n)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, dims) / 4]) for i in range(n)]
    rows += [rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (n + 1, None), (n + 2, rows[0][1][:-1]), (n + 3, [None, *rows[0][1][1:]]), (n + 4, [math.nan, *rows[0][1][1:]]), (n + 5, [math.inf, *rows[0][1][1:]]), (n + 6, [])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    got = centroids.cluster(frame, clusters=k, rounds=3, dims=dims)
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, k, 3, dims)


def test_partial_distances_keep_ties():
    rng = np.random.default_rng(3)
    for trial in range(40):
        c = rng.integers(-1, 2, (9, 20))
        c[5] = c[2]
        v = rng.integers(-2, 3, (50, 20))
        model = centroids.Model(c.astype(np.int64), rng.permutation(20))
        full = ((v[:, None] - c[None]) ** 2).sum(2)
        number, distance = centroids.nearest(v.astype(np.int64), model)
        assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()
    number, distance = centroids.nearest(np.empty((0, 20), np.int64), model)
    assert not len(number) and not len(distance)


def test_clusters_of_nothing_and_of_too_much(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert centroids.cluster(frame([])).count() == 0
    assert centroids.cluster(frame([(1, [0.0] * 3)])).count() == 0
    with pytest.raises(Exception, match="vector 7 has a component beyond"):
        centroids.cluster(frame([(7, [1e30] * 64)])).count()


# --- byte-level BPE ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.encoder(RANKS, byte_bpe.classes())


def same(encoder, library, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [library.encode_ordinary(t or "") for t in texts]


def test_ids_of_odd_texts(encoder, library):
    rng = random.Random(7)
    letters = [*"ab'srvelmtd  \n\t\r.,!?1９é漢字　\xa0ñßſ́\x1c\x1d\x85​ 😀ᛮ\x00", "'s", "'re", "'ve", "'ll", "'m", "'d", "'T", "  ", "<|endoftext|>"]
    for _ in range(40):
        assert same(encoder, library, ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(250)] + [None, ""])


def test_ids_of_long_pieces(encoder, library):
    rng = random.Random(8)
    assert same(encoder, library, ["a" * 3000, "".join(rng.choice("ab") for _ in range(2000)), " " * 999, "é" * 700, "1" * 1500, "x" + "\n" * 300 + "y", "ab" * 50_000])


def test_classes_are_the_librarys():
    """For every code point: the letter, number or sign before it is in one token with it, or it is white space."""
    kinds = encoder_kinds()
    singles = [bytes([b]) for b in range(256)]
    ranks = {e: i for i, e in enumerate([*singles, *(k + b for k in (b"x", b"1", b"!") for b in singles)])}
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for c in [*range(0, 0xD800, 3), *range(0xE000, 0x40000, 7), *range(0x40000, 0x110000, 101), *range(0xE0000, 0xE01F0)]:
        whole = [len(probe.encode_ordinary(p + chr(c))) == len(chr(c).encode()) for p in "x1!"]
        assert sum(whole) <= 1 and kinds[c] == (whole.index(True) if any(whole) else 3), hex(c)


def encoder_kinds():
    return byte_bpe.encoder(RANKS, byte_bpe.classes()).kinds


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    keys = np.unique(keys)
    hashed = byte_bpe.PerfectHash(keys)
    assert sorted(hashed.find(keys).tolist()) == list(range(len(keys)))
    assert sum(map(len, hashed.bits)) < 6 * len(keys)
    assert not len(byte_bpe.PerfectHash(keys[:0]).find(keys[:0]))
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash(np.array([1, 1], np.uint64))


def test_both_tiers_give_the_same(encoder, library):
    """What the first tier answers is what the entry's bytes say; pieces that are no entries are never answered."""
    entries = [e for e in encoder.entries if len(e) > 1][::37]
    others = [e + b"\xff\xfe" for e in entries]
    raw = np.frombuffer(b"".join(entries + others), np.uint8)
    size = np.array([len(e) for e in entries + others])
    found = encoder._looked_up(raw, np.cumsum(size) - size, size)
    assert found[: len(entries)].tolist() == [encoder.ranks[e] for e in entries]
    assert [i for i, e in zip(found[len(entries) :].tolist(), others) if i >= 0 and encoder.entries[i] != e] == []


def test_encode_and_decode(spark, library):
    texts = ["It's  the\n\nstart, naïve 漢字 don't 12'34", "", None, "It's  the\n\nstart, naïve 漢字 don't 12'34", "x " * 40_000]
    docs = spark.createDataFrame([(i if i else None, t, [1], "z") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, decoded string")
    coded = byte_bpe.encode(docs, RANKS)
    rows = byte_bpe.decode(coded, RANKS).collect()
    assert coded.columns == ["doc_id", "ids"] and len(rows) == 5
    by = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts):
        r = by[i if i else None]
        assert r["ids"] == library.encode_ordinary(t or "") and bytes(r["decoded"]).decode() == (t or "")
    assert byte_bpe.encode(docs.where("false"), RANKS).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(odd, RANKS).collect()} == {1: None, 2: b""}
    with pytest.raises(Exception):
        byte_bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), RANKS).collect()


def test_rank_files_are_checked(tmp_path):
    bad = tmp_path / "bad.tiktoken"
    bad.write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(bad))


def test_memo_begins_anew(encoder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    assert same(encoder, library, ["qzxv qqzx", "wvvx qzxv", "qzxv qqzx"]) and same(encoder, library, ["qzxv qzxv wvvxx"])


def test_digests_of_the_query(spark, library):
    from seqlume.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op13_byte_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
