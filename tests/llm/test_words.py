"""Words, hashes, codes and automata against one-at-a-time statements of their rules."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpuscle.llm.crf import SIZES, shapes
from corpuscle.llm.lexicon import Lexicon, compile_lexicon
from corpuscle.llm.ngram_filter import CountFilter, build_segment, level_of, split_key
from corpuscle.llm.simple8b import decode_block, encode_block
from corpuscle.llm.words import shingles, split_words, text_slices, xxh64

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "one", " Two  WORDS\n", "É x \x0b\x0c y", "a b c d e f", "last", "\t", "zzz" * 30 + " q"]


def test_words_are_runs_that_end_with_their_text():
    split = split_words(pa.array(TEXTS))
    for k, text in enumerate(TEXTS):
        own = range(split.first[k], split.first[k + 1])
        got = [bytes(split.data[split.start[i] : split.end[i]]).decode() for i in own]
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        assert got == WORD.findall(lower)


def test_words_of_no_texts():
    split = split_words(pa.array([], pa.string()))
    assert len(split.start) == 0 and split.first.tolist() == [0]


@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingles_slide_over_words(size):
    split = split_words(pa.array(TEXTS))
    start, end, doc = shingles(split, size)
    want = []
    for k, text in enumerate(TEXTS):
        own = WORD.findall((text or "").lower())
        want += [(k, " ".join(own[i : i + size])) for i in range(max(1, len(own) - size + 1))] if own else []
    got = [(int(d), bytes(split.data[a:b]).decode()) for a, b, d in zip(start, end, doc, strict=True)]
    assert [(k, t.replace("É", "É")) for k, t in got] == [(k, t.replace("é", "É")) for k, t in want]


def test_hash_equals_library():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in [*range(0, 80), 200, 1000, 4097]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    got = xxh64(data, ends - [len(p) for p in parts], ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_slices_keep_all_rows_in_order():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["text"])
    parts = list(text_slices(batch, size=50))
    assert [len(p) for p in parts] == [2, 1, 2]
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()


@pytest.mark.parametrize("top", [1, 2, 900, 50_257, 1 << 20, (1 << 32) - 1])
@pytest.mark.parametrize("count", [0, 1, 59, 60, 4095, 4096, 4097, 20_000])
def test_blocks_come_back_as_they_were(count, top):
    ids = np.random.default_rng(count).integers(0, top + 1, count, dtype=np.uint64).astype(np.uint32)
    assert (decode_block(encode_block(ids)) == ids).all()
    mixed = np.minimum(np.random.default_rng(top).zipf(1.4, count), top).astype(np.uint32)
    assert (decode_block(encode_block(mixed, escaped=6)) == mixed).all()


def test_block_words_hold_as_many_ids_as_fit():
    assert len(encode_block(np.zeros(60, np.uint32))) == 24 + 8 + 8  # head, one run offset, one word
    with pytest.raises(ValueError):
        decode_block(b"\0" * 24)


def test_lexicon_finds_its_words_and_no_others():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc\xc3") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    ids = {w: [rng.randrange(50_000) for _ in range(rng.randint(1, 3))] for w in words}
    lexicon = Lexicon(compile_lexicon(ids.items()))
    asked = words + [bytes(x) for x in itertools.product(b"abd", repeat=4)] + [b""]
    size = np.array([len(w) for w in asked])
    found = lexicon.find(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(size) - size, size)
    for word, at in zip(asked, found.tolist(), strict=True):
        if word in ids:
            assert lexicon.ids[lexicon.offsets[at] : lexicon.offsets[at + 1]].tolist() == ids[word]
        else:
            assert at == -1


def test_lexicon_shares_suffixes():
    many = [(p + b"ation", [1]) for p in (b"a", b"b", b"c", b"d")]
    assert len(Lexicon(compile_lexicon(many))._final) == 7  # five letters, their end, and the root
    empty = Lexicon(compile_lexicon([]))
    assert empty.find(np.zeros(1, np.uint8), np.array([0]), np.array([1])).tolist() == [-1]


@pytest.mark.parametrize("bits", [0, 3])
def test_filter_gives_levels_back(bits):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    counts = rng.integers(1, 2000, 5000)
    segment, rest = split_key(keys, bits)
    parts = {k: build_segment(rest[segment == k], counts[segment == k]) for k in range(1 << bits)}
    counted = CountFilter.joined(bits, parts)
    got = counted.levels(keys)
    assert (got >= level_of(counts)).all() and (got > level_of(counts)).mean() < 0.03
    assert (counted.levels(rng.integers(0, 1 << 64, 5000, dtype=np.uint64)) > 0).mean() < 0.03
    assert CountFilter.joined(bits, {}).levels(keys).max() == 0


def test_shapes_count_what_words_are_made_of():
    split = split_words(pa.array(["+1 (555) a.b@c.de 10.0.0.1 x"]), lower=False)
    got = shapes(split)
    assert got.shape == (5, len(SIZES))
    assert got[:, 1].tolist() == [1, 3, 0, 5, 0]  # digits, in steps
    assert got[:, 3].tolist() == [0, 0, 2, 3, 0]  # dots
