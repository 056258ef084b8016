"""Each operator against brute force on small fixtures, and on odd tables."""

import collections
import hashlib
import math
import pickle
import random
import re
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuscle.llm import (
    binary_codes,
    bpe,
    licences,
    mixing,
    naming,
    ngram_filter,
    ngram_lm,
    private_data,
    quality,
    queries,
    simhash,
    token_files,
)
from corpuscle.llm import components as components_module
from corpuscle.llm.components import components
from corpuscle.sources.tables import shared_dir, work_path

from .conftest import SF, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ── Components ────────────────────────────────────────────────────────────────


def test_components_of_random_links(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    links += [(500, k) for k in range(400, 460)] + [(7, 7), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({x for link in links for x in link}, links)
    assert got == {n: c for n, c in want.items() if n in got}
    assert set(want) - set(got) <= {n for n in want if list(want.values()).count(want[n]) == 1}


def test_components_of_stars_are_not_contracted_again(spark, monkeypatch):
    """Links are written once, and once for each round: none for stars, and none more when a round has left only stars."""
    written = []
    keep = components_module.stored
    monkeypatch.setattr(components_module, "stored", lambda *a: written.append(a[1]) or keep(*a))
    for links, rounds in (([(2, 1), (3, 1), (9, 7), (1, 3)], 0), ([(1, 2), (2, 3)], 1)):
        written.clear()
        found = components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(found) == len({r.node for r in found}) and len(written) == 1 + rounds


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ── 1 mixing ──────────────────────────────────────────────────────────────────


def poured(sizes, weights, share=1.5, cap=2.0):
    """Targets by pouring again and again."""
    full, total = set(), share * sum(sizes)
    while True:
        left = total - sum(cap * sizes[k] for k in full)
        open_ = sum(w for k, w in enumerate(weights) if k not in full)
        out = [cap * s if k in full else left * weights[k] / open_ for k, s in enumerate(sizes)]
        more = {k for k, s in enumerate(sizes) if k not in full and out[k] >= cap * s}
        if not more:
            return out
        full |= more
        if len(full) == len(sizes):
            return [cap * s for s in sizes]


def test_targets_are_poured_until_none_runs_over(spark, documents):
    rng = random.Random(6)
    rows = [(k, words(rng, rng.randint(0, 300)), rng.choice(["a", "b", "ä", "z", "Z", None])) for k in range(200)]
    rows = [(k, t, "big" if k % 3 == 0 else s) for k, t, s in rows]
    got = mixing.taken_words(documents(rows)).collect()
    size = {k: len(WORD.findall(t)) for k, t, _ in rows}
    of = {k: s for k, _, s in rows}
    names = sorted({s for s in of.values() if s is not None}) + [None]
    sizes = [sum(n for k, n in size.items() if of[k] == s) for s in names]
    want = dict(zip(names, poured(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    taken = collections.Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[names.index(of[r.doc_id])]
        assert r.target == pytest.approx(want[of[r.doc_id]])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[of[r.doc_id]] += r.taken
    for name, target in want.items():
        assert target * 0.95 - mixing.BLOCK <= taken[name] <= target


def test_mix_is_the_same_when_run_again(odd):
    runs = [sorted(map(str, mixing.taken_words(odd).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == odd.count()


def test_pieces_follow_the_schedule(documents):
    rng = random.Random(7)
    docs = documents([(k, words(rng, 100), f"s{k % 3}") for k in range(60)])
    rows, pieces = mixing.mix(docs, block=32)
    where = {r.row: r for r in rows.collect()}
    slots = collections.defaultdict(list)
    for p in pieces.collect():
        slots[p.slot].append((where[p.row]["source"], p.n_words))
    assert all(len({s for s, _ in v}) == 1 and sum(n for _, n in v) <= 32 for v in slots.values())
    first = [slots[k][0][0] for k in sorted(slots)][:160]
    shares = collections.Counter(first)
    targets = {r.source: r.target for r in where.values()}
    for name, target in targets.items():  # any stretch of the schedule is near the weights
        assert abs(shares[name] - 160 * target / sum(targets.values())) < 8


def test_small_sources_reach_their_targets(documents):
    rng = random.Random(25)
    rows = [(k, words(rng, 3000), "big") for k in range(40)]
    rows += [(100 + k, words(rng, rng.randint(10, 300)), f"s{k:03}") for k in range(150)]
    docs = documents(rows)
    taken, target = collections.Counter(), {}
    of = {k: s for k, _, s in rows}
    for r in mixing.taken_words(docs).collect():
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    assert {s: taken[s] for s in target} == {s: math.floor(t) for s, t in target.items()}
    _, pieces = mixing.mix(docs)
    filled = collections.Counter()
    for p in pieces.collect():
        filled[p.slot] += p.n_words
    assert max(filled.values()) <= mixing.BLOCK


def test_mixed_documents_hold_the_words_taken(odd, odd_rows):
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    taken = collections.Counter()
    for r in mixing.taken_words(odd).collect():
        taken[r.doc_id] += r.taken
    got = collections.Counter()
    texts = collections.defaultdict(set)
    for k, t, _ in odd_rows:
        texts[k].add(t or "")
    for r in mixed.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert any(t.startswith(r.text) for t in texts[r.doc_id]) and r.n_chars == len(r.text)
    assert got == +taken


def test_mix_of_nothing_and_of_no_words(nothing, documents):
    assert mixing.taken_words(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    rows = mixing.taken_words(documents([(1, None), (2, ""), (3, " ")])).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3


# ── 2 licences ────────────────────────────────────────────────────────────────


def test_spellings_case_and_copyright_lines_do_not_matter(spark, documents):
    mit = dict(licences.TEXTS)["MIT"]
    other = "Copyright (c) 1999 A. N. Other\n  (C) 2001 B\n© 2002 C\n" + mit.replace("Copyright (c) year holder\n", "").upper().replace("LICENSE", "Licence")
    docs = documents(
        [(1, mit), (2, other), (3, mit + " and more"), (4, None), (5, ""), (6, "x\nreleased under the mit licence\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0"), (6, "Released under the MIT License"), (None, mit)]
    )
    known = licences.known_licences(spark)
    got = {(r.doc_id, r.licence, r.n_notices, r.notices) for r in licences.scan_licences(docs, known).collect()}
    assert got == {
        (1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, ""),
        (6, None, 3, "CC-BY-NC-4.0,MIT"), (6, "MIT", 1, "MIT"), (None, "MIT", 0, ""),
    }


def test_notice_after_a_copyright_sentence_is_met(spark, documents):
    rows = [
        (1, "Copyright 2020 X. Licensed under the MIT License."),
        (2, "some prose\n(c) 2021 J. Doe Inc. Released under the ISC License\nmore"),
        (3, "Copyright 2020 X. All rights reserved."),
        (4, "Copyright licensed under something else"),
    ]
    found = licences.scan_licences(documents(rows), licences.known_licences(spark)).collect()
    assert {r.doc_id: (r.licence, r.notices) for r in found} == {1: ("MIT", "MIT"), 2: (None, "ISC"), 3: (None, ""), 4: (None, "")}


def test_licences_of_odd_tables(spark, odd, nothing):
    known = licences.known_licences(spark)
    assert licences.scan_licences(odd, known).count() == odd.count()
    assert licences.scan_licences(nothing, known).count() == 0


# ── 3 language model ──────────────────────────────────────────────────────────


def unigrams(rows, held):
    """Base scores by counting."""
    tokens = [(k, [*WORD.findall(lower(t)), ""]) for k, t, *_ in rows]
    counts = collections.Counter(w for k, ws in tokens if not held(k) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    return [(k, len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)) for k, ws in tokens]


def test_scores_of_odd_tables(odd, odd_rows):
    fold = ngram_lm.held_out_fold(F.col("doc_id"))
    held = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 7 == 2
    want = sorted(unigrams(odd_rows, held), key=str)
    for options in ({}, {"frequent_words": 20}, {"frequent_words": 0}):
        got = ngram_lm.score_documents(odd, learn=~fold, **options).collect()
        rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
        for a, b in zip(rows, want, strict=True):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("keys", [1 << 20, 300, 10])  # one segment, about 2^7, about 2^12
def test_routed_filter_gives_the_same_scores(spark, monkeypatch, keys):
    monkeypatch.setattr(ngram_lm, "SEGMENT_KEYS", keys)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = ngram_lm.held_out_fold(F.col("doc_id"))
    near, far = ({r.doc_id: r.score for r in ngram_lm.score_documents(docs, learn=~fold, filter_bytes=n).collect()} for n in (1 << 30, 0))
    assert near == far


def test_counting_ngrams_holds_a_bounded_number_and_hands_on_whole_counts(monkeypatch):
    """A task of 10 MB of text needs little besides the n-grams it may hold, and hands them on in pieces."""
    rng = np.random.default_rng(45)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 20_000))) for _ in range(40)]
    batches = [pa.record_batch([pa.array(texts)], ["text"])]
    tracemalloc.start()
    try:
        sent = sum(1 for _ in ngram_lm.gathered(4, iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120 << 20 and sent > 4
    monkeypatch.setattr(ngram_lm, "HELD_KEYS", 3_000)
    monkeypatch.setattr(ngram_lm, "SENT_KEYS", 100)
    batches = [pa.record_batch([pa.array(["a b a", None, "", *texts[:1], "a b a"])], ["text"])] * 2
    want = collections.Counter()
    for batch in batches:
        for keys in ngram_lm.ngram_keys(*ngram_lm.tokens(batch.column("text"))):
            want.update(keys.tolist())
    got = collections.Counter()
    for row in (r for b in ngram_lm.gathered(4, iter(batches)) for r in b.to_pylist()):
        rest = np.frombuffer(row["low"], "<u4").astype(np.uint64) | np.frombuffer(row["high"], np.uint8).astype(np.uint64) << np.uint64(32)
        for key, n in zip(rest.tolist(), np.frombuffer(row["counts"], "<u4").tolist(), strict=True):
            got[row["segment"], key] += n
    segment, rest = ngram_filter.split_key(np.array(list(want), np.uint64), 4)
    assert got == dict(zip(zip(segment.tolist(), rest.tolist(), strict=True), want.values(), strict=True))


def test_workers_map_the_filter_and_are_not_sent_it(spark, documents, monkeypatch):
    """A filter below its limit is a file of the machine: what is broadcast does not grow with it."""
    rng = random.Random(46)
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(len(pickle.dumps(value))), broadcast(self, value))[1])
    docs = documents([(k, words(rng, 400)) for k in range(60)])
    near, far = ({r.doc_id: r.score for r in ngram_lm.score_documents(docs, frequent_words=10, filter_bytes=n).collect()} for n in (1 << 30, 0))
    assert near == far and len(near) == 60
    assert max(sent) < 5_000


def test_scores_are_those_of_a_smoothed_bigram_model(documents):
    """Counts by dictionaries, quantised as the filter keeps them; what the filter answers wrongly moves few scores."""
    rng = random.Random(44)
    vocabulary = [words(rng, 1) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(vocabulary[: 5 + k % 50]) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    tokens = {k: [*lower(t).split(), None] for k, t in rows}
    single = collections.Counter(w for ts in tokens.values() for w in ts)
    pairs = collections.Counter(p for ts in tokens.values() for p in zip([None, *ts[:-1]], ts, strict=True))
    total, kinds = sum(single.values()), len(single)

    def score(ts):
        out = 0.0
        for before, word in zip([None, *ts[:-1]], ts, strict=True):
            base = (single[word] + 1) / (total + kinds + 1)
            kept = float(ngram_filter.count_of(ngram_filter.level_of(np.array([pairs[before, word]])))[0])
            kept = min(kept, single[before], single[word])
            out += math.log10((kept + ngram_lm.SMOOTHING * base) / (single[before] + ngram_lm.SMOOTHING))
        return out

    got = {r.doc_id: r.score for r in ngram_lm.score_documents(documents(rows)).collect()}
    away = sorted(abs(got[k] - score(ts)) for k, ts in tokens.items())
    assert away[len(away) * 9 // 10] < 1e-6 and away[-1] < 0.5


def test_bigrams_tell_more_than_unigrams(spark):
    rows = queries.op3_ngram_lm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)
    assert np.mean([r.score > r.base_score for r in rows]) > 0.8


def test_scores_of_nothing(nothing, documents):
    assert ngram_lm.score_documents(nothing).count() == 0
    none = ngram_lm.score_documents(documents([(1, "a b")]), learn=F.lit(False)).first()
    assert (none.n_known, none.train_tokens, none.base_score) == (0, 0, 0.0)


# ── 4 word BPE ────────────────────────────────────────────────────────────────

TRICKY = ["<|endoftext|> a<|startoftext|>", "don't WE'LL 'S", "Σας ΑΣ", "é 가 ﬁ", "½²3 x\x1cy\x85z", "İI ẞ", "a\0b", " 　x"]


def test_ids_and_texts_equal_the_library(documents, odd_rows):
    library = Tokenizer.from_file(WORD_FILE)
    rows = odd_rows + [(100 + k, t, "s") for k, t in enumerate(TRICKY)]
    for limit in (0, 50, bpe.LEXICON_WORDS):
        got = bpe.decode(bpe.encode(documents(rows), WORD_FILE, limit=limit), WORD_FILE).collect()
        found = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in got), key=str)
        want = []
        for k, t, _ in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((k, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
        assert found == sorted(want, key=str)
    both = bpe.encode(documents(rows), WORD_FILE, decoded=True).collect()
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in both), key=str) == found


def test_nothing_to_encode(nothing, odd):
    assert bpe.decode(bpe.encode(nothing, WORD_FILE), WORD_FILE).count() == 0
    assert bpe.encode(odd, WORD_FILE).count() == odd.count()


# ── 5 SimHash ─────────────────────────────────────────────────────────────────


def simhash_of(text, size=4):
    own = WORD.findall(lower(text))
    runs = [" ".join(own[k : k + size]) for k in range(max(1, len(own) - size + 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(rows, docs):
    marks = [(k, simhash_of(t)) for k, t, *_ in rows]
    kinds = sorted({m for _, m in marks})
    links = [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :] if (a ^ b).bit_count() <= 4]
    root = union_find(kinds, links)
    least = {}
    for k, m in marks:
        if k is not None:
            least[root[m]] = min(k, least.get(root[m], k))
    want = collections.Counter((k, f"{m:016x}", least.get(root[m])) for k, m in marks)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits("code").alias("f"), "component_id").collect()
    assert collections.Counter((r.doc_id, r.f, r.component_id) for r in got) == want
    return len(links)


def test_fingerprints_and_components_by_brute_force(spark, documents, odd, odd_rows):
    check_simhash(odd_rows, odd)
    rng = random.Random(8)
    rows = []
    for base in range(40):
        own = words(rng, 300).split()
        for copy in range(rng.randint(1, 6)):
            rows.append((len(rows), " ".join(w if rng.random() > 0.004 * copy else "new" for w in own)))
    assert check_simhash(rows, documents(rows)) > 20


def test_large_parts_meet_in_chunks(documents, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 2)
    check_simhash(odd_rows, odd)
    rng = random.Random(19)
    own = words(rng, 400).split()
    rows = [(k, " ".join([*own[:k], "new", *own[k + 1 :]])) for k in range(60)]
    assert check_simhash(rows, documents(rows)) > 200


@pytest.mark.parametrize("seed", range(3))
def test_trie_finds_every_link(seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 1 << 64, 900, dtype=np.uint64)
    for step in range(4):  # chains of near copies, and a dense ball
        codes[100 + 100 * step : 200 + 100 * step] = codes[100 * step : 100 + 100 * step] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    codes[600:850] = codes[0] ^ rng.integers(0, 1 << 9, 250).astype(np.uint64)
    codes = np.unique(codes)[:, None]
    a, b = simhash.trie_links(np.zeros(len(codes), np.int64), codes, 4)
    near = np.argwhere(np.triu(np.bitwise_count(codes ^ codes.T) <= 4, 1))
    assert union_find(range(len(codes)), near.tolist()) == union_find(range(len(codes)), list(zip(a.tolist(), b.tolist(), strict=True)))
    assert len(a) < len(codes)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_go_and_others_stay(documents):
    rng = random.Random(9)
    rows, groups = [], {}
    for base in range(30):
        own = words(rng, 400).split()
        for copy in range(3):
            groups[len(rows)] = base
            rows.append((len(rows), " ".join(w if rng.random() > 0.015 * copy else "other" for w in own)))
    kept = {r.doc_id for r in simhash.without_near_duplicates(documents(rows)).collect()}
    five = {k: {tuple(t.split()[i : i + 5]) for i in range(396)} for k, t in rows}
    close = [(a, b) for a in five for b in five if a < b and groups[a] == groups[b] and jaccard(five[a], five[b]) >= 0.8]
    root = union_find(five, close)
    assert len(close) > 20 and kept == set(root.values())


@pytest.mark.parametrize("split", [None, 4])
def test_similar_sets_by_brute_force(monkeypatch, split):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    rng = np.random.default_rng(17)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 25))).astype(np.uint64) for _ in range(10)]
    sets += [sets[0], sets[0][1:]]
    got = set(zip(*(x.tolist() for x in simhash.alike(sets, 0.5, split)), strict=True))
    want = {
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets)
        if i < j and (split is None or i < split <= j) and len(a) + len(b) and jaccard(set(a.tolist()), set(b.tolist())) >= 0.5
    }
    assert got == want


def test_a_large_group_is_compared_in_chunks(documents, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 6)
    rng = random.Random(18)
    own = words(rng, 200).split()
    rows = [(k, " ".join([*own[:k], f"new{k}", *own[k + 1 :]])) for k in range(0, 200, 5)] + [(1000, words(rng, 200))]
    kept = {r.doc_id for r in simhash.without_near_duplicates(documents(rows)).collect()}
    assert kept == {0, 1000}


def test_repeated_lines_do_not_keep_near_copies_apart(documents):
    rng = random.Random(20)
    rows = []
    for times in (5, 20, 100, 300):
        own, line = words(rng, 200), words(rng, 12)
        rows += [(len(rows), f"{own}\n{line}"), (len(rows) + 1, "\n".join([own, *[line] * times]))]
    sets = [{tuple(lower(t).split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    assert all(jaccard(sets[k], sets[k + 1]) >= 0.9 for k in range(0, len(rows), 2))
    kept = {r.doc_id for r in simhash.without_near_duplicates(documents(rows)).collect()}
    assert kept == {k for k, _ in rows if k % 2 == 0}


@pytest.mark.parametrize("common", [0, 40])
def test_pairs_by_rare_shingles_are_complete(common):
    rng = np.random.default_rng(21)
    sets = []
    for size in rng.integers(1, 60, 150):  # and each set again with some numbers more
        own = rng.choice(400, size, replace=False)
        sets += [own, np.union1d(own, rng.choice(400, max(1, size // 5)))]
    sets = [np.unique(x).astype(np.uint64) for x in sets]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    order = np.sort(rng.choice(400, common, replace=False)).astype(np.uint64)
    key, node, place, size, _ = simhash.rare_shingles(np.concatenate(sets), cuts, order, rng.integers(2, 9, common), 0.8)
    none = np.full(len(node), -1)
    got = {p for a, b in simhash.pairs_sharing(key, node, none, place, size, 0.8) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = set(zip(*(x.tolist() for x in simhash.alike(sets, 0.8)), strict=True))
    assert len(want) > 50 and want <= got


@pytest.mark.parametrize("hot", [20_000, 3])
def test_short_texts_at_the_threshold_are_linked(documents, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(22)
    shared = words(rng, 12)
    texts = [words(rng, 8) for _ in range(60)]  # 4 shingles against 5, and 12 against 15
    texts += [words(rng, 16) for _ in range(20)]
    rows = [(2 * k, t) for k, t in enumerate(texts)]
    rows += [(2 * k + 1, f"{t} {words(rng, 1 if k < 60 else 3)}") for k, t in enumerate(texts)]
    rows += [(1000 + k, f"{shared} {words(rng, 20)}") for k in range(20)]  # all share eight shingles, too few
    kept = {r.doc_id for r in simhash.without_near_duplicates(documents(rows)).collect()}
    assert kept == {2 * k for k in range(80)} | set(range(1000, 1020))


@pytest.mark.parametrize("most", [3, 10, 1000])
def test_large_groups_are_handed_back_and_small_ones_kept_whole(most):
    rng = random.Random(most)
    keys = sorted(rng.choice([1, 2, 3, 4, 5, 6, 6, 6, 6, 9, 9, 9]) for _ in range(300))
    table = pa.table({"key": pa.array(keys), "row": pa.array(range(300))})
    batches = [b for k in range(0, 300, 7) for b in table.slice(k, 7).to_batches()]
    small, large = [], []
    for part, over in simhash._groups_below(iter(batches), "key", most):
        (large if over else small).append(part)
    count = collections.Counter(keys)
    assert sorted(r for t in [*small, *large] for r in t.column("row").to_pylist()) == list(range(300))
    assert {k for t in large for k in t.column("key").to_pylist()} == {k for k, n in count.items() if n > most}
    seen = [k for t in small for k in set(t.column("key").to_pylist())]
    assert len(seen) == len(set(seen))  # no key is cut


def test_parity_sketches_never_say_too_little_is_shared():
    rng = np.random.default_rng(31)
    for size in (1, 5, 300, 9_000):
        a = rng.integers(0, 1 << 63, size=size, dtype=np.uint64)
        b = np.concatenate([a[: size * 9 // 10], rng.integers(0, 1 << 63, size=size // 5, dtype=np.uint64)])
        left, right = simhash.parity_sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        differ = int(np.bitwise_count(left ^ right).sum())
        wide = simhash.differing_bits(simhash.wide_sketch(a), simhash.wide_sketch(b))
        assert differ <= wide <= len(np.setxor1d(a, b)) and wide > 0.7 * len(np.setxor1d(a, b))
        assert simhash.differing_bits(simhash.wide_sketch(np.tile(a, 3)), simhash.wide_sketch(b)) <= len(np.setxor1d(a, b))
        assert differ <= len(np.setxor1d(a, b)) and (size < 100 or size > 1_000 or differ > 0.8 * len(np.setxor1d(a, b)))


def test_middle_sized_hot_shingles_are_found_without_the_sample(documents, monkeypatch):
    """A passage in many texts that the sample does not show: its shingles are counted and met in chunks."""
    monkeypatch.setattr(simhash, "HOT", 5)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    rng = random.Random(32)
    passage = words(rng, 60)
    rows = [(k, f"{passage} {words(rng, 2)}") for k in range(40)] + [(100 + k, words(rng, 40)) for k in range(40)]
    got = simhash.similar_documents(documents(rows), budget=0, parts=8).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, 0) for k in range(40)}


def test_a_dense_group_that_no_fingerprint_proposes_gives_few_pairs(documents, monkeypatch):
    """Near copies that all share most shingles are united by a forest; what is then apart is met pair by pair."""
    rng = random.Random(33)
    base = words(rng, 120).split()
    rows = [(k, " ".join([*base, *words(rng, 1 + k % 5).split()])) for k in range(150)] + [(500 + k, words(rng, 60)) for k in range(30)]
    given = []
    verify = simhash.verified_pairs

    def watched(texts, pairs, **limits):
        given.append(pairs.count())
        return verify(texts, pairs, **limits)

    monkeypatch.setattr(simhash, "verified_pairs", watched)
    got = simhash.similar_documents(documents(rows), budget=0, parts=8).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, 0) for k in range(150)}
    assert sum(given) < 1_500 and given[1] == 0


def test_work_folders_of_near_copies_go(spark, documents, tmp_path):
    rows = [(k, "one two three four five six seven " + "x " * (k % 2)) for k in range(4)]
    root = Path(shared_dir(spark).removeprefix("file:")) / "corpuscle" / spark.sparkContext.applicationId
    before = set(root.iterdir()) if root.exists() else set()
    assert simhash.similar_documents(documents(rows)).count() > 0
    assert {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before} == {"similar"}


def test_near_copies_in_odd_tables(odd, nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.without_near_duplicates(nothing).count() == 0
    kept = simhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    # texts without words are alike to none; of the rows without an id the one with prose goes
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([0, 1, 2, 3, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 30, 31, 32, 40, 41, 42, None], key=str)


# ── 6 personal data ───────────────────────────────────────────────────────────

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_of(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and private_data.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(10)
    alphabet = list("aZ09.@_%+-( )") + ["4111 1111 1111 1111", "+1 (555) 555-0100", "10.0.255.3", "a.b@c.de", "é", "\n", "999"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for text in texts + ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a@b@c.d", "@", "+", "0300.1.1.1", "1" * 20_000, "a" * 20_000 + "@"]:
        assert [(s, k, e) for k, s, e in private_data.base_spans(text)[0]] == base_of(text), text[:80]


def test_field_adds_what_runs_together(documents):
    rng = random.Random(11)

    def card():
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(digits + d for d in "0123456789" if private_data.luhn(digits + d))

    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = []
    for k in range(500):
        what = rng.choice([card(), phone(), f"x{k}@m.example.org", f"{k % 250}.2.3.4", f"v{k}", str(k)])
        rows.append((k, f"{words(rng, 12)} {what} {words(rng, 9)}\n{words(rng, 20)}"))
    joined = f"{words(rng, 8)} {phone()} {card()} {words(rng, 8)}"
    rows += [(1000, joined), (1001, None), (1002, ""), (1003, words(rng, 5000)), (None, joined)]
    docs = documents(rows)
    got = {r.doc_id: r for r in private_data.find_private(docs, private_data.train(docs)).collect()}
    for k, text in rows:
        assert [(s.start, s.end) for s in got[k].base] == [(a, b) for a, _, b in base_of(text)]
        assert k in (1000, None) or not got[k].added
    kinds = [(s.kind, joined[s.start : s.end]) for s in got[1000].added]
    assert [k for k, _ in kinds] == ["phone", "card"] and " ".join(t for _, t in kinds) in joined


def test_quiet_words_are_never_labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    field = private_data.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    import pyarrow as pa

    from corpuscle.llm import crf
    from corpuscle.llm.words import split_words, text_bytes

    texts = pa.array([r.text for r in docs.select("text").collect()])
    split = split_words(texts, lower=False)
    lines = private_data._lines(split, text_bytes(texts)[0])
    shape = crf.shapes(split)
    scores = field.emissions(shape, *crf.neighbours(shape, lines))
    starts = np.flatnonzero(np.concatenate([[True], lines[1:] != lines[:-1]]))
    labels = field.decode(scores, starts, np.diff(np.append(starts, len(lines))))
    quiet = field.quiet(shape)
    only = np.bincount(lines, ~quiet) == 0
    assert quiet.mean() > 0.5 and not labels[only[lines]].any()


def test_private_data_of_odd_tables(odd, nothing):
    assert private_data.train(nothing) is None and private_data.find_private(nothing, None).count() == 0
    got = private_data.find_private(odd, private_data.train(odd)).collect()
    assert len(got) == odd.count() and not any(r.added for r in got)


# ── 7 exact duplicates ────────────────────────────────────────────────────────


def check_naming(rows, docs, **options):
    groups = collections.defaultdict(list)
    for k, t, *_ in rows:
        groups["".join(WORD.findall(t or ""))].append((k, t or ""))
    want = collections.Counter()
    for text, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        order = sorted(members, key=lambda m: m is not best)
        want.update((k, best[0], len(members), n == 0, sha) for n, (k, _) in enumerate(order))
    got = naming.exact_duplicates(docs, **options).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_copies_by_brute_force(odd, odd_rows, documents):
    check_naming(odd_rows, odd)
    rng = random.Random(12)
    long = words(rng, 9000)
    rows = [(k, t) for k, t in enumerate([long, long + " ", long[:-1], long[:8192], "a" * 4096, "a" * 8192, "a" * 4095, long, "b" * 4097, "a" * 4096])]
    check_naming(rows, documents(rows))


def test_keys_that_meet_are_drawn_anew(documents, odd_rows):
    weak = lambda block, seed: F.struct((F.crc32(block) % (3 if seed < 2 else 1 << 40)).alias("x"), F.octet_length(block).alias("y"))
    check_naming(odd_rows, documents(odd_rows), key=weak)


def test_what_stays_of_copies(odd, odd_rows, nothing):
    kept = naming.without_exact_duplicates(odd)
    assert kept.columns == odd.columns
    texts = ["".join(WORD.findall(r.text or "")) for r in kept.collect()]
    assert sorted(texts) == sorted({"".join(WORD.findall(t or "")) for _, t, _ in odd_rows})
    assert naming.without_exact_duplicates(nothing).count() == 0 and naming.exact_duplicates(nothing).count() == 0


# ── 8 vectors ─────────────────────────────────────────────────────────────────


def check_vectors(spark, rows):
    sound = {}
    for n, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            sound[n] = np.array(v) / np.linalg.norm(v)
    links = [(a, b) for a in sound for b in sound if a < b and len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] >= 0.9]
    root = union_find(range(len(rows)), links)
    least = {}
    for n, (k, _) in enumerate(rows):
        if k is not None:
            least[root[n]] = min(k, least.get(root[n], k))
    degree = collections.Counter(x for link in links for x in link)
    want = collections.Counter((k, degree[n], least.get(root[n])) for n, (k, _) in enumerate(rows))
    frame = spark.createDataFrame([(k, v, 0, 1) for k, v in rows], "vec_id long, embedding array<double>, label int, node int")
    got = binary_codes.near_vectors(frame).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_links_of_vectors_by_brute_force(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(60, 16))
    rows = [(int(k), (base[k % 60] + rng.normal(size=16) * 0.1 * (k // 60)).tolist()) for k in range(240)]
    rows += [(300 + k, base[0].tolist()) for k in range(30)] + [(0, base[5].tolist()), (0, base[5].tolist())]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [float("inf")] + [1.0] * 15), (405, [None] + [1.0] * 15)]
    rows += [(406, [1.0] * 3), (407, [2.0] * 3), (408, [1.0, -1.0, 0.0]), (409, [1.0, -1.0, 0.1]), (410, [3.0]), (411, [1e-3])]
    rows += [(None, base[7].tolist()), (None, None)]
    check_vectors(spark, rows)


def test_vectors_of_empty_tables(spark):
    check_vectors(spark, [])
    check_vectors(spark, [(1, None), (2, [0.0, 0.0])])
    check_vectors(spark, [(5, [1.0, 2.0])])


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(14)
    base = rng.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(1000, 64))
    side -= (side * base[:1000]).sum(1, keepdims=True) * base[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    angle = rng.uniform(0.9, 0.96, 1000)[:, None]
    rows = np.concatenate([base, angle * base[:1000] + np.sqrt(1 - angle**2) * side])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    near = rows @ rows.T >= 0.9
    found = sum(r.n_links for r in binary_codes.near_vectors(frame).collect())
    assert 0.98 <= found / (near.sum() - len(rows)) <= 1


@pytest.mark.parametrize("spread", [0.02, 0.1, 1.0])
def test_vectors_visit_where_partners_live(spread):
    rng = np.random.default_rng(23)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(40, 16))[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16)) * spread)
    side = rng.normal(size=x.shape)
    side = unit(side - (side * x).sum(1, keepdims=True) * x)
    x = np.concatenate([x, 0.9001 * x + np.sqrt(1 - 0.9001**2) * side])
    middle = binary_codes.centres(x, 50)
    home, others = binary_codes.visits(x, middle, middle @ middle.T, 0.9)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    a, b = np.where(home[a] < home[b], a, b), np.where(home[a] < home[b], b, a)
    assert (others[b, home[a]] | (home[a] == home[b])).all() and (home[a] != home[b]).sum() > 100
    assert spread > 0.1 or others.mean() < 0.5


@pytest.mark.parametrize("copies", [0, 1000])
def test_every_pair_just_above_the_threshold_is_linked(spark, monkeypatch, copies):
    monkeypatch.setattr(binary_codes, "COPIES", copies)  # all vectors in one cell, or in many
    monkeypatch.setattr(binary_codes, "CHUNK", 1500)
    rng = np.random.default_rng(24)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.normal(size=(2500, 64)))
    side = rng.normal(size=base.shape)
    side = unit(side - (side * base).sum(1, keepdims=True) * base)
    rows = np.concatenate([base, 0.901 * base + np.sqrt(1 - 0.901**2) * side])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    near = (rows @ rows.T >= 0.9).sum(1) - 1
    assert {r.vec_id: r.n_links for r in binary_codes.near_vectors(frame).collect()} == dict(enumerate(near.tolist()))


def test_bounds_hold_for_estimates():
    rng = np.random.default_rng(15)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[200:] = x[:200] * 0.95 + rng.normal(size=(200, 64)) * 0.03
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[:20].mean(0)
    codes = binary_codes.Codes.of(x, centre, binary_codes.rotation(64))
    may = codes.reaches(slice(None), codes, slice(None), 0.9)
    assert may[x @ x.T >= 0.9].mean() > 0.999 and may[x @ x.T < 0.5].mean() < 0.02


# ── 9 quality ─────────────────────────────────────────────────────────────────


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op9_quality(spark, sf).collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [k for k in marks if rows[k].held_out]
    assert all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert np.mean([rows[k].predicted == marks[k] for k in held]) > 0.95


def test_quality_of_odd_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(0, 1), (0, 1), (2, 0), (None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, quality int")
    got = quality.scores(odd, labels)
    assert got.select("doc.*").columns == odd.columns and got.where("score BETWEEN 0 AND 1").count() == odd.count()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scores(odd, none).collect()} == {0.5}
    assert quality.scores(nothing, labels).count() == 0


def test_quality_of_one_id_in_many_rows(spark, documents):
    """Rows of one id are one row to learn from, so what is collected stays bounded."""
    rng = random.Random(42)
    rows = [(k, words(rng, 30)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    hot = next(k for k in range(1, 60, 2) if zlib.crc32(str(k).encode()) % 3 != 1)
    many = documents(rows).union(documents([(hot, f"copy {k % 100}") for k in range(5_000)]))
    texts = many.where("doc_id = 3").select("doc_id", "text")
    assert texts.count() >= 1
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda good, other, prior: seen.append((len(good), len(other))) or fit(good, other, prior)
        model = quality.train(many, labels)
    finally:
        quality.fit = fit
    assert model is not None and max(seen[0]) <= 60


def test_risk_that_is_kept_from_going_negative_learns_from_positives():
    rng = np.random.default_rng(16)
    good, bad = rng.normal(1, 1, (3000, 6)), rng.normal(-1, 1, (1000, 6))
    model = quality.fit(good[:1000], np.concatenate([good[1000:2500], bad[:500]]), 0.75)
    assert (model.score(good[2500:]) >= 0.5).mean() > 0.9 and (model.score(bad[500:]) < 0.5).mean() > 0.9


# ── 10 token files ────────────────────────────────────────────────────────────


def test_token_files_equal_the_library(spark, documents, odd_rows):
    library = Tokenizer.from_file(BYTE_FILE)
    rows = odd_rows + [(200 + k, t, "s") for k, t in enumerate(TRICKY)] + [(-5, "first  \n\n x ", "s")]
    out = work_path(spark, "test-token-files")
    token_files.write_ids(documents(rows), BYTE_FILE, out)
    got = sorted(token_files.read_ids(spark, out).collect(), key=lambda r: r.start)
    own = [(k, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t, _ in rows]
    narrow = {w: np.frombuffer(w, "<u4").astype("<u2").tobytes() for _, w in own}
    own.sort(key=lambda r: (r[0] is not None, r[0] or 0, narrow[r[1]]))
    assert [(r.doc_id, bytes(r.ids)) for r in got] == own
    assert [r.start for r in got] == [sum(len(w) // 4 for _, w in own[:k]) for k in range(len(own))]
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_token_files_of_one_id_in_many_rows(spark, documents, odd_rows):
    """An id, and rows without one, that fill several ranges: every row comes back, in order, with nothing between."""
    rng = random.Random(41)
    rows = [*odd_rows, *[(7, words(rng, 5)) for _ in range(400)], *[(None, words(rng, 4)) for _ in range(300)], (8, "x"), (6, "y")]
    out = work_path(spark, "token-files")
    token_files.write_ids(documents(rows), BYTE_FILE, out)
    got = token_files.read_ids(spark, out).collect()
    library = Tokenizer.from_file(BYTE_FILE)
    want = collections.Counter()
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[r[0], np.array(ids, "<u4").tobytes()] += 1
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    ranges = spark.read.parquet(out).select("range", F.explode("doc_ids").alias("d")).distinct().collect()
    assert sum(r.d == 7 for r in ranges) > 1 and sum(r.d is None for r in ranges) > 1


def test_token_files_of_nothing(spark, nothing):
    out = work_path(spark, "test-no-token-files")
    token_files.write_ids(nothing, BYTE_FILE, out)
    assert token_files.read_ids(spark, out).count() == 0
