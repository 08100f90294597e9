"""Operators on documents against brute force, on a corpus of hard cases and on no rows."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from odflux.llm import mixing, packing, quality_rules, sharding, simhash, suffix_dedup, token_store, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(corpus):
    return [(r["doc_id"], r["text"] or "", r["lang"], r["source"]) for r in corpus.collect()]


# --- Quality rules

def counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(again)


def test_counts(spark, corpus):
    got = quality_rules.text_counts(corpus.select("doc_id", "text")).collect()
    expected = collections.Counter((d, *counts(t)) for d, t, *_ in rows_of(corpus))
    assert collections.Counter((r["doc_id"], *r["counts"]) for r in got) == expected


def test_outliers_of_a_group_are_rejected(spark):
    rng = np.random.default_rng(1)
    rows = [("en", "a", int(n), int(5 * n + rng.integers(-n // 20, n // 20 + 1)), 0, 10, 0, 0) for n in rng.integers(50, 500, 200)]
    rows += [("en", "a", 200, 1000, 150, 10, 0, 0), ("en", "a", 200, 2400, 0, 10, 0, 0), ("de", None, 200, 1000, 0, 10, 0, 0)]
    rows += [("en", "a", 5, 25, 0, 1, 0, 0), ("en", "a", 100, 500, 0, 10, 0, 21)]
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    flat = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{n} long" for n in names))
    counted = flat.selectExpr("lang", "source", f"struct({', '.join(names)}) as counts")
    judged = quality_rules.judge(counted, quality_rules.fit(counted)).collect()
    bad = sorted(tuple(r["counts"])[:3] for r in judged if not r["quality"]["kept"])
    assert bad == [(5, 25, 0), (100, 500, 0), (200, 1000, 150), (200, 2400, 0)]


def test_repeated_lines_and_long_words_alone_are_rejected(spark):
    rng = np.random.default_rng(6)
    rows = [("en", "a", int(n), int(5 * n + rng.integers(-n // 20, n // 20 + 1)), 0, 20, 0, 0) for n in rng.integers(100, 500, 300)]
    rows += [("en", "a", 300, 1500, 0, 20, 12, 0), ("en", "a", 300, 1900, 0, 20, 0, 0), ("en", "a", 300, 1500, 0, 20, 0, 57)]
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    flat = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{n} long" for n in names))
    counted = flat.selectExpr("lang", "source", f"struct({', '.join(names)}) as counts")
    judged = quality_rules.judge(counted, quality_rules.fit(counted)).collect()
    bad = sorted(tuple(r["counts"]) for r in judged if not r["quality"]["kept"])
    assert bad == [(300, 1500, 0, 20, 0, 57), (300, 1500, 0, 20, 12, 0), (300, 1900, 0, 20, 0, 0)]


def test_quality_without_rows(nothing):
    counted = quality_rules.text_counts(nothing.select("doc_id", "text", "lang", "source"))
    assert quality_rules.judge(counted, quality_rules.fit(counted)).count() == 0


# --- Near-duplicates

def fingerprint(text, words=3):
    parts = text.encode().lower().split()
    if not parts:
        return 0
    runs = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [b" ".join(parts)]
    h = np.array([xxhash.xxh64_intdigest(r, 42) for r in runs], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def brute_components(prints, ids, near):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if label[i] != label[j] and near(prints[i], prints[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return [min((ids[k] for k in range(len(ids)) if label[k] == x and ids[k] is not None), default=None) for x in label]


@pytest.mark.parametrize("leaf", [2048, 3])
def test_simhash_components(corpus, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)  # 3: units are split again and again
    rows = rows_of(corpus)
    prints = [fingerprint(t) for _, t, *_ in rows]
    found = brute_components(prints, [d for d, *_ in rows], lambda a, b: (a ^ b).bit_count() <= 2)
    got = simhash.simhash_groups(corpus).collect()
    expected = collections.Counter((d, f"{p:016x}", c) for (d, *_), p, c in zip(rows, prints, found))
    assert collections.Counter((r["doc_id"], r["sig"].hex(), r["component_id"]) for r in got) == expected


def test_pipeline_stage_keeps_the_first_of_each_component(spark, corpus):
    rows = rows_of(corpus)
    prints = [fingerprint(t) for _, t, *_ in rows]
    found = brute_components(prints, [d for d, *_ in rows], lambda a, b: (a ^ b).bit_count() <= 2)
    kept = corpus_pipeline.near_duplicates(spark, corpus, "")
    assert kept.columns == corpus.columns
    got = collections.Counter((d, fingerprint(t)) for d, t, *_ in rows_of(kept))
    assert sorted((d for d, _ in got), key=str) == sorted(set(found), key=str) and set(got.values()) == {1}
    assert all(p in {q for (d, *_), q in zip(rows, prints) if d == i} for i, p in got)


def test_trie_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 12, 40).astype(np.uint64)
    v = np.unique(np.concatenate((base, base ^ (np.uint64(1) << rng.integers(0, 12, 40).astype(np.uint64))))) << np.uint64(52)
    n = len(v)
    i, j, w = simhash.trie_links(v, *(np.array([x]) for x in (0, n, 0, n, 0)), 2, 12)
    expected = {(a, b) for a in range(n) for b in range(a + 1, n) if int(v[a] ^ v[b]).bit_count() <= 2}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == expected
    assert all(int(v[a] ^ v[b]).bit_count() == e for a, b, e in zip(i, j, w))
    assert len(simhash.forest(n, i, j, w)) <= n - 1


def test_equal_table_words_are_all_judged():
    v = np.zeros(4, np.uint64)
    i, j, _ = simhash.trie_links(v, *(np.array([x]) for x in (0, 4, 0, 4, 0)), 2, 12, True)
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(4) for b in range(a + 1, 4)]
    i, j, _ = simhash.trie_links(v, *(np.array([x]) for x in (0, 2, 2, 4, 0)), 2, 12, True)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 2), (0, 3), (1, 2), (1, 3)]


def test_simhash_without_rows(nothing):
    assert simhash.simhash_groups(nothing).count() == 0


# --- Repeated passages

def brute_remove(rows):
    first = {}
    order = lambda d: (d is None, d or 0)
    for d, t, *_ in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            key = b[i : i + 50]
            first[key] = min(first.get(key, (2, 0)), order(d))
    out = []
    for d, t, *_ in rows:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < order(d):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), kept))
    return out


@pytest.mark.parametrize("part", [1 << 18, 200])
def test_repeats_are_removed(corpus, monkeypatch, part):
    monkeypatch.setattr(suffix_dedup, "_SLICE", part)  # 200: documents come in many parts
    got = suffix_dedup.remove_repeats(corpus, keep=("size",)).collect()
    found = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got)
    assert found == collections.Counter(brute_remove(rows_of(corpus)))


def test_window_classes():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 2, 600).astype(np.uint8)
    text[300:420] = text[7:127]
    text[501:590] = text[8:97]
    windows = np.arange(len(text) - 49)
    classes = suffix_dedup.window_classes(text, windows)
    seen = {}
    for w, c in zip(windows, classes):
        assert seen.setdefault(text[w : w + 50].tobytes(), c) == c
    assert len(set(seen.values())) == len(seen)


def test_repeats_without_rows(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0


# --- Mixing

def test_mix_meets_targets(corpus):
    rows = mixing.take(corpus).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows_of(corpus):
        sizes[s] += len(WORD.findall(t))
    assert len(rows) == corpus.count() and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
            free.discard(s)
    target.update({s: level * weight[s] for s in free})
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(target)
    largest = max(r["size"] for r in rows)
    for s in names:
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - target[s]) <= 2 * largest
    again = mixing.take(corpus.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert collections.Counter(map(key, rows)) == collections.Counter(map(key, again))


def test_flight_keeps_totals():
    rng = np.random.default_rng(8)
    p, size = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    q = mixing.flight(p, [np.ones(500), size], rng.random(501))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())


def test_mix_without_rows(nothing):
    assert mixing.take(nothing).count() == 0


# --- Tokens

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(library, text, end):
    return library.encode(text, add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cached_encoding_equals_the_library(library):
    tok = tokens.encoder()
    texts = ["a b", " a", "a ", "a  b", "a\nb\n", "a\n\nb", "a\n\n\nb", "a\n\n", "it's I'LL 'rest 12ab !?été", "a \nb", "a\n b",
             "x<|endoftext|>y", " b c", "日本 語", "a\t b", "- -- 's", "\n", " ", "Straße ÀÉ ǆ", "²³ ½", "a_b c_ 1_"]
    for text in texts:
        assert np.frombuffer(tok.encode(text), tok.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_store_gives_back_all_ids(spark, corpus, library):
    store, entries = token_store.write(corpus)
    read = store.read(store.lookup(entries.select("doc_id", "copy")), ids=True).collect()
    expected = collections.Counter((d, tuple(ids_of(library, t, 0))) for d, t, *_ in rows_of(corpus))
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u2").tolist())) for r in read) == expected
    assert all(r["ids_crc32"] == crc(np.frombuffer(r["ids"], "<u2")) for r in read)
    unknown = spark.createDataFrame([(10**9 + k, 0) for k in range(50)], "doc_id long, copy long")
    assert store.lookup(unknown).count() == 0
    order = sorted(entries.collect(), key=lambda r: (r["shard"], r["position"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)
    few = store.lookup(entries.select("doc_id", "copy").where("doc_id in (3, 7)"))
    known = {tuple(r) for r in entries.select("doc_id", "copy", "shard", "position", "n_tokens").collect()}
    assert few.count() == 4 and {tuple(r) for r in few.collect()} <= known


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(3).integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    found = token_store.PerfectHash(*keys)
    assert sorted(found.slots(*keys).tolist()) == list(range(5000))


def test_equal_hashes_get_slots_of_their_own():
    first = np.array([5, 5, 7, 9, 5, 9, 11, 2**64 - 1, 2**64 - 1], np.uint64)
    second = np.arange(9).astype(np.uint64)
    found = token_store.PerfectHash(first, second)
    slots = found.slots(first, second)
    assert sorted(slots.tolist()) == list(range(9))
    assert found.slots(np.array([5, 9], np.uint64), np.array([77, 0], np.uint64)).tolist() == [-1, -1]
    with pytest.raises(ValueError):
        token_store.PerfectHash(first[[0, 0]], second[[0, 0]])


@pytest.mark.parametrize("few", [0, 10**6])
def test_index_file_finds_its_keys_and_no_others(monkeypatch, few):
    monkeypatch.setattr(token_store, "FEW", few)
    rng = np.random.default_rng(4)
    first, second = rng.integers(0, 1 << 63, (2, 3000)).astype(np.uint64)
    first[:40] = first[40:80]  # clashes
    perfect = token_store.PerfectHash(first, second)
    slots = perfect.slots(first, second)
    entries = np.zeros(3000, token_store.ENTRY)
    entries["position"][slots] = np.arange(3000)
    entries["print"][slots] = token_store._fingerprint(second)
    data, reads = token_store.pack_index(perfect, entries), []

    def read(offset, n):
        reads.append(n)
        return data[offset : offset + n]

    index = token_store.IndexFile(read)
    there, found = index.find(first, second)
    assert there.all() and (found["position"] == np.arange(3000)).all()
    other = rng.integers(0, 1 << 63, (2, 3000)).astype(np.uint64)
    assert not index.find(*other)[0].any() and not index.find(first[:40], second[:40] + np.uint64(1))[0].any()
    if few:  # one entry is one read of its width
        reads.clear()
        index.find(first[100:101], second[100:101])
        assert reads == [token_store.ENTRY.itemsize]
    with pytest.raises(ValueError):
        token_store.IndexFile(lambda offset, n: bytes(n))


def test_store_without_rows(nothing):
    store, entries = token_store.write(nothing)
    assert store.lookup(entries.select("doc_id", "copy")).count() == 0
    assert store.lookup(nothing.sparkSession.sql("select 1L as doc_id, 0L as copy")).count() == 0


# --- Packing

def test_packing_holds_each_id_once(corpus, library):
    got = packing.pack(corpus, capacity=64).collect()
    documents = collections.defaultdict(list)
    for d, t, *_ in rows_of(corpus):
        documents[d].append(ids_of(library, t, 1))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == documents.keys()
    for d, found in pieces.items():
        copies = len(documents[d])
        ids = documents[d][0]
        cuts = [(k, len(ids[k : k + 64]), crc(ids[k : k + 64]), len(ids)) for k in range(0, len(ids), 64)]
        assert sorted(tuple(r[1:5]) for r in found) == sorted(cuts * copies)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert 64 * len(sequences) <= 1.1 * sum(r["length"] for r in got) + 64


def test_patterns_cover_the_demand_with_few_sequences():
    rng = np.random.default_rng(4)
    sizes, demand = np.arange(1, 101), rng.integers(0, 300, 100).astype(float)
    used = demand > 0
    patterns, times = packing.solve_patterns(sizes[used], demand[used], 100)
    assert (patterns @ sizes[used] <= 100).all() and ((patterns * times[:, None]).sum(axis=0) >= demand[used]).all()
    assert times.sum() <= 1.03 * (sizes * demand).sum() / 100 + 60


def test_packing_without_rows(nothing):
    assert packing.pack(nothing).count() == 0


# --- Sharding

def test_shards_are_even_and_keep_groups(corpus):
    rows = sharding.shards(corpus, levels=2).collect()
    texts = {(len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t, *_ in rows_of(corpus)}
    assert {(r["size"], r["text_crc32"]) for r in rows} == texts and len(rows) == corpus.count()
    where = collections.defaultdict(set)
    slots = collections.defaultdict(list)
    for r in rows:
        where[r["size"], r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_many_equal_sized_points(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "lpad(cast(id as string), 40, 'x') as text", "'en' as lang", "'s' as source", "40L as n_chars")
    sizes = collections.Counter(r["shard"] for r in sharding.shards(docs).collect())
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 4


def test_shards_without_rows(nothing):
    assert sharding.shards(nothing).count() == 0


def test_digest_is_that_of_spark(corpus):
    got = simhash.fingerprints(corpus).select("doc_id", "digest").collect()
    expected = corpus.selectExpr("doc_id", "xxhash64(coalesce(text, '')) as digest").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, expected))
