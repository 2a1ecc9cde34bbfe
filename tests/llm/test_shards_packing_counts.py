"""Token shards, packing, token counts: round trips against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqlume.llm import common, packing, token_counts, token_shards

TEXTS = [
    "", None, " ", "The cat sat. The cat sat, on the mat.\nNext line", "a  b\n\n c\t\td  ", "x<|endoftext|>y  z", "Éa ΑΣ. ß’s don't it's 12,3  45",
    "\x1c a\x1fb", "é ́x", "tr \n \n x", "word " * 3000, "nbsp here 　 wide", "emoji 😀 ok.", 'say "q". é. o,\n',
]


def frame(spark, texts=TEXTS, extra=True):
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(None, "no id", 1, None), (3, texts[3] if len(texts) > 3 else "", 2, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, part string")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(3)
    pieces = ["the", "Word", "it's", " ", "  ", "\n", ".", ",", "é", "ß", "’", " ", "x.y", "<|endoftext|>", "12", "\t", "ÀB", "Σ", "-", "́"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    encoder = common.Encoder(public_tokenizers.path(name), slots=1 << 10)
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        for t, e, c in zip(texts, ends, counts):
            assert ids[e - c : e].tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("change", ["normalizer", "pre_tokenizer", "prefix_space"])
def test_encoder_of_other_vocabularies(tmp_path, change):
    """Vocabularies whose cuts aren't known are encoded by the library, text by text."""
    from tokenizers import normalizers, pre_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    if change == "normalizer":
        tok.normalizer = normalizers.Sequence([normalizers.NFKC(), normalizers.Replace("a", "b. ")])
    elif change == "pre_tokenizer":
        tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Punctuation("merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    else:
        tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    tok.save(str(tmp_path / "other.json"))
    encoder = common.Encoder(str(tmp_path / "other.json"))
    assert not encoder.known and all(common.Encoder(public_tokenizers.path(n)).known for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    ids, counts = encoder.encode(pa.chunked_array([TEXTS[:3], TEXTS[3:]], pa.string()))
    assert len(counts) == len(TEXTS)
    for t, e, c in zip(TEXTS, np.cumsum(counts), counts):
        assert ids[e - c : e].tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()))] == [0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_shard_round_trip(ids, a, b):
    ids = np.array(ids * 3, np.uint32)
    shard = token_shards.Shard(token_shards.pack(ids, top=4, least=2))
    assert shard.decode().tolist() == ids.tolist()
    assert shard.decode(a, b).tolist() == ids[a:b].tolist()


def test_compression_replaces_frequent_pairs():
    ids = np.array([5, 6, 7, 8] * 1000, np.uint32)
    first, rules, length, seq = token_shards.compress(ids)
    assert len(seq) < 100 and first == 9 and length.max() > 4
    assert len(rules) == len(length)


def test_compression_leaves_no_pair_that_is_frequent_enough():
    rng = np.random.default_rng(3)
    for _ in range(100):
        ids = rng.integers(0, rng.integers(1, 8), rng.integers(0, 400)).astype(np.uint32)
        least = int(rng.integers(2, 5))
        _, _, _, seq = token_shards.compress(ids, least=least, top=int(rng.integers(1, 5)))
        times, last = {}, {}
        for i, pair in enumerate(zip(seq.tolist(), seq[1:].tolist())):
            if last.get(pair, -2) < i - 1:
                times[pair], last[pair] = times.get(pair, 0) + 1, i
        assert max(times.values(), default=0) < least


def test_bad_shard():
    with pytest.raises(ValueError):
        token_shards.Shard(b"abcd")


def test_shards_in_order(spark):
    docs = frame(spark)
    path = common.new_folder(spark, "shards")
    token_shards.write_shards(docs, path, public_tokenizers.path("word_bpe_49k.json"), 1, shard_tokens=50)
    rows = token_shards.document_digests(spark, path).collect()
    assert len(rows) == docs.count()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, *sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        ids = np.array(tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shards_of_nothing(spark):
    path = common.new_folder(spark, "shards")
    token_shards.write_shards(frame(spark).limit(0), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    assert token_shards.document_digests(spark, path).count() == 0


def check_packing(rows, texts, capacity):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bins = {}
    docs = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append(r)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(docs) == set(texts)
    for d, pieces in docs.items():
        ids = np.array(tok.encode(texts[d] or "", add_special_tokens=False).ids + [0], "<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in pieces) == ids.tobytes()
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert all(r["length"] == capacity for r in pieces[1:]) and pieces[0]["start"] == 0
    return len(bins)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    texts = {i: "word " * rng.randint(0, 90) for i in range(400)} | {1000: None, 1001: "long " * 700}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, capacity=128).collect()
    used = check_packing(rows, texts, 128)
    assert used <= -(-sum(r["length"] for r in rows) // 128) + 1


def test_packing_in_windows(spark):
    texts = {i: "word " * (i % 50) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    check_packing(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, capacity=64, window_tokens=500).collect(), texts, 64)


def test_packing_of_nothing_and_extra_columns(spark):
    assert packing.pack_documents(frame(spark).limit(0), public_tokenizers.path("byte_bpe_50k.json"), 0).count() == 0
    got = packing.with_digest(packing.pack_documents(frame(spark), public_tokenizers.path("byte_bpe_50k.json"), 0))
    assert got.where("piece = 0").count() == frame(spark).count()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_local_search_keeps_items_and_never_needs_more_bins(sizes):
    bins = packing.Bins(40)
    bins.add([(s, i) for i, s in enumerate(sizes)])
    before, squares = len(bins.fill), sum(f * f for f in bins.fill)
    bins.improve()
    assert sorted(i for b in bins.items for _, i in b) == list(range(len(sizes)))
    assert all(sum(s for s, _ in b) == f <= 40 for b, f in zip(bins.items, bins.fill))
    assert len(bins.fill) <= before and sum(f * f for f in bins.fill) >= squares


def test_local_search_empties_a_bin():
    bins = packing.Bins(10)
    bins.items, bins.fill = [[(6, 0), (3, 1)], [(4, 2), (3, 3)], [(4, 4)]], [9, 7, 4]
    assert bins.improve() > 0
    assert len(bins.fill) == 2


def test_local_search_packs_an_arrival_order_fill():
    """Bins empty until about as few are left as the sizes allow, and no change that raises squared fill is left."""
    rng = random.Random(7)
    sizes = [rng.randint(1, 91) for _ in range(400)]
    bins = packing.Bins(128)
    bins.add([(s, i) for i, s in enumerate(sizes)])
    before = len(bins.fill)
    bins.improve()
    assert len(bins.fill) <= -(-sum(sizes) // 128) + 1 < before
    open_bins = [b for b, f in enumerate(bins.fill) if f < 128]
    for b in open_bins:
        for x in open_bins:
            room = 128 - bins.fill[x]
            for size, _ in bins.items[b] if b != x else []:
                given = [0, *(s for s, _ in bins.items[x]), *(s + t for k, (s, _) in enumerate(bins.items[x]) for t, _ in bins.items[x][:k])]
                assert not any(0 < size - g <= room and bins.fill[x] + size - g > bins.fill[b] for g in given)


def changes_left(bins):
    """Exchanges of the dealt kinds between two underfull bins that would raise the sum of squared fills."""
    found = []
    sums = lambda items: [((), 0), *(((i,), s) for i, (s, _) in enumerate(items)), *(((i, j), s + t) for j, (t, _) in enumerate(items) for i, (s, _) in enumerate(items[:j]))]
    some = [b for b, f in enumerate(bins.fill) if f < bins.capacity]
    for b in some:
        for x in some:
            for given, out in sums(bins.items[b]) if b != x else []:
                for back, into in sums(bins.items[x]):
                    if (len(given), len(back)) in ((1, 0), (1, 1), (1, 2), (2, 1)):
                        new_b, new_x = bins.fill[b] - out + into, bins.fill[x] + out - into
                        if new_x <= bins.capacity and new_b <= bins.capacity and new_b**2 + new_x**2 > bins.fill[b] ** 2 + bins.fill[x] ** 2:
                            found.append((b, x, given, back))
    return found


def test_two_for_one_goes_both_ways():
    bins = packing.Bins(100)
    bins.items, bins.fill = [[(30, 0), (31, 1)], [(60, 2), (13, 3), (13, 4), (13, 5)]], [61, 99]
    assert bins.improve() > 0 and not changes_left(bins)


def test_no_change_of_any_kind_is_left():
    rng = random.Random(3)
    for _ in range(400):
        capacity = rng.choice([20, 100])
        bins = packing.Bins(capacity)
        bins.add([(rng.randint(1, capacity * 2 // 3), i) for i in range(rng.randint(2, 16))])
        bins.improve()
        assert not changes_left(bins), bins.items


def test_lengths_of_different_partitions_meet(spark):
    texts = {i: "word " * (68 if i < 300 else 56) for i in range(600)}  # 70 and 58 tokens, or nearly so
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartitionByRange(2, "doc_id")
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, capacity=128).collect()
    used = check_packing(rows, texts, 128)
    assert {r["length"] for r in rows} <= set(range(55, 74)) and used == 300
    small = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, capacity=128, window_tokens=3000).collect()
    assert check_packing(small, texts, 128) <= 330


def fewest(sizes, capacity):
    """Least number of bins, by trying everything."""
    best = len(sizes)

    def place(k, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if k == len(sizes):
            best = len(fills)
            return
        for j in {f: j for j, f in enumerate(fills)}.values():
            if fills[j] + sizes[k] <= capacity:
                place(k + 1, fills[:j] + (fills[j] + sizes[k],) + fills[j + 1 :])
        place(k + 1, (*fills, sizes[k]))

    place(0, ())
    return best


def test_local_search_against_all_packings():
    rng = random.Random(11)
    found = least = 0
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(3, 9))]
        bins = packing.Bins(40)
        bins.add([(s, i) for i, s in enumerate(sizes)])
        bins.improve()
        want = fewest(sorted(sizes, reverse=True), 40)
        assert len(bins.fill) <= want + 1
        found, least = found + len(bins.fill), least + want
    assert found <= 1.05 * least


def repeated_words(n):
    """Two words of n letters whose polynomial hashes are equal, whatever the factor, and a third one."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return [a, a.translate(str.maketrans("ab", "ba")), "a" * n]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_with_patterned_pieces(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    texts = [f"x {w} y" for n in (64, 512, 2048, 4096) for w in repeated_words(n)]
    encoder = common.Encoder(public_tokenizers.path(name))
    for _ in range(2):
        for t in texts:
            assert encoder.encode(pa.array([t]))[0].tolist() == tok.encode(t, add_special_tokens=False).ids
    hashes, counts = common.word_hashes(pa.array([w for n in (64, 2048, 4096) for w in repeated_words(n)]))
    assert len(set(hashes.tolist())) == len(counts) == 9


def test_encoder_when_pieces_share_a_hash(monkeypatch):
    """The memo compares bytes, so equal hashes change no id."""
    monkeypatch.setattr(common, "piece_hashes", lambda raw, first, size: (raw[first].astype(np.uint64) % np.uint64(3)) + np.uint64(1))
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, encoder = Tokenizer.from_file(path), common.Encoder(path)
    texts = [t or "" for t in TEXTS] + ["a long text of several words, some of which are extraordinarilylongandunlikely " * 3]
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts))
        ends = np.cumsum(counts)
        for t, e, c in zip(texts, ends, counts):
            assert ids[e - c : e].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_token_counts_and_cache(spark):
    docs, path = frame(spark), public_tokenizers.path("byte_bpe_50k.json")
    cache = common.new_folder(spark, "cache")
    tok = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for _ in range(2):
        got = token_counts.token_counts(docs, path, cache).collect()
        assert len(got) == docs.count()
        for r in got:
            assert r["n_tokens"] == len(tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
            assert r["n_bytes"] == len(texts[r["doc_id"]].encode())
    stored = token_counts.read_cache(spark, cache)
    assert stored.count() == len(set(texts.values()))  # each distinct text once, nothing new in the second round


def test_token_counts_read_the_cache(spark):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), common.new_folder(spark, "cache")
    docs = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    version = token_counts.tokenizer_digest(path)
    spark.sql(f"select unhex(sha2('hello there', 256)) digest, '{version}' tokenizer, 77L n_tokens").write.parquet(cache)
    assert token_counts.token_counts(docs, path, cache).first()["n_tokens"] == 77
    assert token_counts.token_counts(docs.limit(0), path, cache).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_token_counts_of_a_partly_filled_cache(spark, monkeypatch, most):
    """Half of the texts are stored, one of them twice, as a task that ran again might leave it, and other versions' counts."""
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", most)
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), common.new_folder(spark, "cache")
    docs = frame(spark, TEXTS * 2)
    want = sorted(map(str, token_counts.token_counts(docs, path, common.new_folder(spark, "cache")).collect()))
    token_counts.token_counts(frame(spark, TEXTS[::2]), path, cache)
    stored = token_counts.read_cache(spark, cache).collect()
    spark.createDataFrame([stored[0], (stored[1][0], "another", 99)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    for _ in range(2):
        assert sorted(map(str, token_counts.token_counts(docs, path, cache).collect())) == want
    texts = {t or "" for t in TEXTS} | {"no id"}
    assert token_counts.read_cache(spark, cache).count() == len(texts) + 2


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "hello there"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path, common.new_folder(spark, "cache")).collect()}
    assert got == {1: len(sentencepiece.SentencePieceProcessor(model_file=path).encode("hello there")), 2: 0, 3: 0}


def plain_rounds(ids, least):
    """Rounds of replacing pairs, one symbol after another: (rules, sequence)."""
    seq, rules, following = list(ids), [], max(ids) + 1
    while True:
        places, i = {}, 0
        overlaps = set()
        for i in range(1, len(seq) - 1):  # of a run of one symbol every second pair
            if seq[i - 1] == seq[i] == seq[i + 1] and i - 1 not in overlaps:
                overlaps.add(i)
        for i in range(len(seq) - 1):
            if i not in overlaps:
                places.setdefault((seq[i], seq[i + 1]), []).append(i)
        order = sorted((p for p in places if len(places[p]) >= least), key=lambda p: (-len(places[p]), p))
        rank = {i: r for r, p in enumerate(order) for i in places[p]}
        far = len(seq) + len(order)
        won = [[i for i in places[p] if r < rank.get(i - 1, far) and r < rank.get(i + 1, far)] for r, p in enumerate(order)]
        kept = [(p, w) for p, w in zip(order, won) if len(w) >= 2]
        if not kept:
            return rules, seq
        new = {i: following + k for k, (_, w) in enumerate(kept) for i in w}
        rules += [p for p, _ in kept]
        following += len(kept)
        seq = [new.get(i, s) for i, s in enumerate(seq) if i - 1 not in new]


@pytest.mark.parametrize("seed", range(6))
def test_rounds_as_plain_ones(seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(0, 3 + 2 * seed, rng.integers(1, 9)) for _ in range(20)] + [np.zeros(7, int)]
    ids = np.concatenate([words[i] for i in rng.integers(0, len(words), 400)]).astype(np.uint32)
    _, rules, _, seq = token_shards.compress(ids)
    assert (list(map(tuple, rules.tolist())), seq.tolist()) == plain_rounds(ids.tolist(), 4) and len(rules) > 5
    assert np.array_equal(token_shards.Shard(token_shards.pack(ids)).decode(), ids)


def test_later_rounds_look_at_changes_only(monkeypatch):
    looked, counted = [], token_shards._counted
    monkeypatch.setattr(token_shards, "_counted", lambda keys: looked.append(len(keys)) or counted(keys))
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 3000, 6) for _ in range(2000)]
    ids = np.concatenate([words[i] for i in rng.zipf(1.3, 30_000) % 2000] + [rng.integers(0, 3000, 60_000)]).astype(np.uint32)
    token_shards.compress(ids)
    assert len(looked) > 6 and sum(looked[-2:]) < len(ids) / 1000


def test_odd_white_space_is_found_by_its_first_byte():
    text = "a\x1cb cÂ  ​ 　﻿€ሴ\x85 \u0085⁠e "
    raw = text.encode()
    assert common._odd_places(np.frombuffer(raw, np.uint8), raw) == [m.start() for m in common._ODD_SPACE.finditer(raw)]


def test_texts_go_to_python_in_small_batches(spark):
    docs = spark.range(3000).coalesce(1).select(F.repeat(F.lit("some words "), 500).alias("text"))
    report = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    most = common.staged(docs.mapInArrow(report, "n long"), "batches").agg({"n": "max"}).first()[0]
    assert 1_000_000 < most < 5_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_no_packing_is_left_to_the_callers_batches(spark):
    texts = {k: "some words " * (k % 9 + 1) for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, capacity=64, window_tokens=500)
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    check_packing(got.collect(), texts, 64)
