"""BPE encoding and decoding with a lexicon of the corpus's frequent words.

Words are counted over all documents; the frequent ones are encoded once and compiled into a transducer (`lexicon`), which is
published as a file and memory-mapped by the workers. Words it does not hold are merged exactly, rank by rank. Which words
the lexicon holds changes the speed and nothing else.
"""

import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from corpuscle.llm.counting import frequent, stored_counts
from corpuscle.llm.lexicon import Lexicon, compile_lexicon
from corpuscle.llm.words import text_slices, without_collector
from corpuscle.sources.tables import work_path

LEXICON_WORDS = 1 << 17  # bound on the words that are collected and compiled
MEMO_WORDS = 1 << 18  # merged words that a worker remembers
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# The same for lower-case Latin-1 text, in which these are all letters, digits and white space.
_LATIN = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")


def _is_latin(text: str) -> bool:
    """Whether all characters are Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    out: dict[int, str] = {}
    for code in (*range(128), *range(128, 2048, 32), *range(128, 192)):  # every byte that UTF-8 has up to two bytes
        out |= dict(zip(chr(code).encode(), shown.pre_tokenize_str(chr(code))[0][0], strict=True))
    for code in (0x800, *range(0x1000, 0xD001, 0x1000), 0xE000, 0xF000, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000):
        out |= dict(zip(chr(code).encode(), shown.pre_tokenize_str(chr(code))[0][0], strict=True))
    return out


class _Places(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        return at


class WordBPE:
    """A tokenizer file of words with ends: NFC, lower case, words by pattern, merges by rank.

    Special tokens are found in the raw text first, as the library does.
    """

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._model = tokenizer.model
        with open(path, encoding="utf-8") as file:
            added = [x["content"] for x in json.load(file)["added_tokens"]]
        self._special = {x: tokenizer.token_to_id(x) for x in added}
        self._split = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self._letter = byte_letters()
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = [(tokenizer.id_to_token(k) or "").encode() + b" " for k in range(size)]
        self._starts = np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def words(self, text: str) -> list[str]:
        """Words and special tokens in order; a special token is followed by a NUL, which no word has."""
        out: list[str] = []
        at = 0
        for found in self._split.finditer(text):
            out += self._plain(text[at : found.start()])
            out.append(found.group() + "\0")
            at = found.end()
        return out + self._plain(text[at:])

    @staticmethod
    def _plain(text: str) -> list[str]:
        if _is_latin(text):  # composed already
            return _LATIN.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final sigma
        return _WORDS.findall(text)

    def merge(self, word: str) -> list[int]:
        """Ids of one word by exact merging."""
        if word[-1] == "\0" and word[:-1] in self._special:
            return [self._special[word[:-1]]]
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin1").translate(self._letter)
        return [token.id for token in self._model.tokenize(word)]

    def texts(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """Decoded texts: the tokens of each document joined by a space. `first` has where documents begin."""
        ids = ids.astype(np.int64)
        lengths = self._starts[ids + 1] - self._starts[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        spots = np.arange(ends[-1]) + np.repeat(self._starts[ids] - ends[:-1], lengths)
        data = self._bytes[spots]
        at = ends[first]
        keep = np.ones(len(data), bool)
        keep[at[1:][at[1:] > at[:-1]] - 1] = False  # the space after a document's last token
        offsets = at - np.concatenate([[0], np.cumsum(at[1:] > at[:-1])])
        return pa.Array.from_buffers(
            pa.large_string(), len(at) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep])]
        )


# ── The lexicon of a corpus ───────────────────────────────────────────────────


def publish_lexicon(texts: DataFrame, path: str, limit: int = LEXICON_WORDS) -> str:
    """Compile the frequent words, write the file to the shared folder and give it to all workers; returns its name."""
    spark = texts.sparkSession
    bpe = WordBPE(path)
    chosen = frequent(stored_counts(texts), limit, "word").column("word").to_pylist()
    words = {piece for word in chosen for piece in bpe.words(word)}
    data = compile_lexicon((w.encode(), bpe.merge(w)) for w in words)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_path(spark, "lexicon"))
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    for first in range(0, len(data), 1 << 20):
        stream.write(bytearray(data[first : first + (1 << 20)]))
    stream.close()
    spark.sparkContext.addFile(place.toString())
    return place.getName()


# ── Encoding and decoding ─────────────────────────────────────────────────────


def _ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of an array, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class WordEncoder:
    """Encodes slices of texts: distinct words walk the lexicon together, the rest are merged and remembered."""

    def __init__(self, bpe: WordBPE, lexicon: Lexicon) -> None:
        self._bpe, self._lexicon, self._memo = bpe, lexicon, {}

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, where each word's begin and how many it has."""
        data = [w.encode() for w in words]
        length = np.fromiter(map(len, data), np.int64, len(data))
        number = self._lexicon.find(np.frombuffer(b"".join(data), np.uint8), np.cumsum(length) - length, length)
        counts = np.zeros(len(words), np.int64)
        held = np.flatnonzero(number >= 0)
        offsets = self._lexicon.offsets
        counts[held] = offsets[number[held] + 1] - offsets[number[held]]
        rest, merged = np.flatnonzero(number < 0), []
        for k in rest:
            ids = self._memo.get(words[k])
            if ids is None:
                if len(self._memo) >= MEMO_WORDS:
                    self._memo.clear()
                ids = self._memo[words[k]] = self._bpe.merge(words[k])
            merged.append(ids)
        counts[rest] = [len(x) for x in merged]
        extra = np.fromiter((i for x in merged for i in x), np.uint32, int(counts[rest].sum()))
        flat = np.concatenate([_ragged(self._lexicon.ids, offsets[number[held]], counts[held]), extra])
        both = np.concatenate([held, rest])
        starts = np.zeros(len(words), np.int64)
        starts[both] = np.cumsum(counts[both]) - counts[both]
        return flat, starts, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text begins (one more entry at the end)."""
        place = _Places()
        lists = [self._bpe.words(t) if t else [] for t in texts]
        spots = np.fromiter(map(place.__getitem__, itertools.chain.from_iterable(lists)), np.int64)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat, starts, counts = self._ids(list(place))
        lengths = counts[spots]
        ids = _ragged(flat, starts[spots], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.concatenate([[0], np.cumsum(sizes)])]


def encode(docs: DataFrame, path: str, *, limit: int = LEXICON_WORDS, decoded: bool = False) -> DataFrame:
    """`doc_id, n_tokens, ids` for every row of `docs(doc_id, text)`: ids as little-endian unsigned 32-bit integers.

    Equal to the library's ids without added tokens, truncation or padding. A null or empty text has no ids. Rows are
    kept as they are, repeated ids and null ids too; other columns are not read. With `decoded` the ids are decoded where they
    are made, as `decode` would, into `text`.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    name = publish_lexicon(texts.select("text"), path, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_collector():
            bpe = WordBPE(path)
            encoder = WordEncoder(bpe, Lexicon.mapped(SparkFiles.get(name)))
            for batch in batches:
                for part in text_slices(batch):
                    ids, first = encoder.encode(part.column("text").to_pylist())
                    blob = pa.Array.from_buffers(
                        pa.large_binary(), part.num_rows, [None, pa.py_buffer(first * 4), pa.py_buffer(ids.astype("<u4"))]
                    )
                    columns = [part.column("doc_id"), pa.array(np.diff(first)), blob.cast(pa.binary())]
                    if decoded:
                        columns.append(bpe.texts(ids, first).cast(pa.string()))
                    yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids", "text"][: len(columns)])

    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows of `encode` with `text`, the library's decoding with special tokens kept; no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(path)
        for batch in batches:
            for part in text_slices(batch, "ids"):
                ids = part.column("ids").cast(pa.large_binary())
                _, offsets, data = ids.buffers()
                at = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1]
                flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u4") if data else np.zeros(0, "<u4")
                text = bpe.texts(flat, (at - at[0]) // 4).cast(pa.string())
                yield pa.record_batch([*part.columns, text], [*part.schema.names, "text"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")
