"""Token ids of a corpus as files of Simple-8b blocks in the order of doc_id, and reading them back.

A file set is a Parquet folder, so any store that Spark writes will do: one folder per range of doc_id, rows in order, each
with a block of ids (`simple8b`), the documents it holds with their lengths, and how many ids of its range come before it.
"""

import itertools
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from corpuscle.llm.bpe import byte_letters
from corpuscle.llm.simple8b import decode_block, encode_block
from corpuscle.llm.words import text_slices, without_collector

END_ID = 2
BLOCK_IDS = 1 << 18  # a block is closed once it holds so many ids; documents are not split
MEMO_PIECES = 1 << 19
RANGES_PER_PARTITION = 4
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same for Latin-1 text, in which these are all letters, digits and white space.
_LATIN = re.compile(
    r" ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9²³¹¼-¾]+| ?[^\t-\r \x85\xa0A-Za-z0-9ªµºÀ-ÖØ-öø-ÿ²³¹¼-¾]+"
    r"|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
)


class _Memo(dict):
    """Pieces seen and their ids as bytes; forgets everything when full."""

    def __init__(self, model: BPE, special: dict[str, int], dtype: str) -> None:
        super().__init__()
        self._model, self._special, self._dtype = model, special, dtype
        self._letters = byte_letters()
        self._space = self._letters[32]
        self._code = "H" if dtype == "<u2" else "I"

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.clear()
        rest = piece[1:]
        if piece in self._special:
            ids = [self._special[piece]]
        elif piece[0] == " " and rest.isalnum() and rest.isascii():  # printable ASCII stands for itself
            ids = [t.id for t in self._model.tokenize(self._space + rest)]
        else:
            ids = [t.id for t in self._model.tokenize(piece.encode().decode("latin-1").translate(self._letters))]
        data = self[piece] = _little_endian(array(self._code, ids))
        return data


def _little_endian(ids: array) -> bytes:
    """The bytes of an array, least significant first on any machine."""
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


class ByteBPE:
    """A byte-level BPE file; texts are cut into pieces as the file's library does, and each piece is merged once.

    Special tokens are found in the raw text first, as the library does. Ids are little-endian unsigned integers of 16
    bits when the vocabulary allows, else of 32.
    """

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        added = {x.content: k for k, x in tokenizer.get_added_tokens_decoder().items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        self._marks = [x for x in added if x]
        self.dtype = "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self._memo = _Memo(tokenizer.model, added, self.dtype)

    def encode(self, text: str) -> bytes:
        """Ids of a text on end."""
        if any(mark in text for mark in self._marks):
            pieces: list[str] = []
            for k, part in enumerate(self._special.split(text)):
                pieces += [part] if k % 2 else self._pieces(part)
        else:
            pieces = self._pieces(text)
        return b"".join(map(self._memo.__getitem__, pieces))

    @staticmethod
    def _pieces(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _PIECES.findall(text)
        return _LATIN.findall(text)


def encode_ids(
    docs: DataFrame, path: str, end_id: int = END_ID, cuts: np.ndarray | None = None, null_ranges: int = 1
) -> DataFrame:
    """`range, doc_id, ids`: ids of every text with `end_id` after them, in the width of the vocabulary.

    The range counts the `cuts` up to the doc_id, from 1; null ids are in `null_ranges` ranges up to 0. An id that several cuts name has
    as many ranges, dealt by a checksum of the ids. A null or empty text has the end id only. Other columns are not read.
    """
    edges = np.zeros(0, np.int64) if cuts is None else cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_collector():
            yield from encoded(batches)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path)
        end = np.array([end_id], bpe.dtype).tobytes()
        for batch in batches:
            for part in text_slices(batch):
                ids = [bpe.encode(t or "") + end for t in part.column("text").to_pylist()]
                doc_id = part.column("doc_id")
                known = doc_id.is_valid().to_numpy(zero_copy_only=False)
                numbers = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
                ranges = np.searchsorted(edges, numbers, side="right") + 1
                many = np.where(known, ranges - 1 - np.searchsorted(edges, numbers), null_ranges)  # ranges of this very id
                ranges[~known] = 0
                for k in np.flatnonzero(many > 1):
                    ranges[k] -= zlib.crc32(ids[k]) * int(many[k]) >> 32
                ranges = ranges.astype(np.int32)
                yield pa.record_batch([pa.array(ranges), doc_id, pa.array(ids, pa.binary())], ["range", "doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "range int, doc_id long, ids binary")


# ── Files ─────────────────────────────────────────────────────────────────────

_BLOCKS = "range int, seq int, before long, n_ids long, doc_ids array<long>, lengths array<long>, block binary"


def _cuts(docs: DataFrame, ranges: int) -> tuple[np.ndarray, int]:
    """Values of doc_id that cut the rows into about equal ranges, one that many rows share as often as it fills a range; and how many
    ranges the rows without an id fill."""
    shares = [k / ranges for k in range(1, ranges)]
    doc_id = F.col("doc_id").cast("long")
    found, nulls, rows = docs.agg(
        F.percentile_approx(doc_id, shares, max(10_000, 20 * ranges)), F.count_if(doc_id.isNull()), F.count("*")
    ).first()
    return np.sort(np.array(found or [], np.int64)), max(1, nulls * ranges // max(1, rows))


def write_ids(docs: DataFrame, path: str, out: str, *, end_id: int = END_ID) -> None:
    """Encode `docs(doc_id, text)` and write its token files to `out`, in ascending doc_id order.

    Null ids come first; rows of one id are ordered by a checksum where they fill several ranges, and then by their ids' bytes, so
    repeated rows do not disturb the order.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, null_ranges = _cuts(docs, partitions * RANGES_PER_PARTITION)
    dtype = np.dtype(ByteBPE(path).dtype)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for key, group in itertools.groupby(rows, key=lambda r: r[0]):
            seq, before, docs_, held = 0, 0, [], 0
            for _, doc_id, ids in group:
                docs_.append((doc_id, ids))
                held += len(ids) // dtype.itemsize
                if held >= BLOCK_IDS:
                    yield block(key, seq, before, docs_)
                    seq, before, docs_, held = seq + 1, before + held, [], 0
            if docs_:
                yield block(key, seq, before, docs_)

    def block(key: int, seq: int, before: int, rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(x for _, x in rows), dtype)
        values = [key, seq, before, len(ids), [d for d, _ in rows], [len(x) // dtype.itemsize for _, x in rows], encode_block(ids)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        arrays = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
        return pa.record_batch(arrays, ["range", "seq", "before", "n_ids", "doc_ids", "lengths", "block"])

    dealt = encode_ids(docs, path, end_id, cuts, null_ranges).repartition(partitions, "range").sortWithinPartitions("range", "doc_id", "ids")
    dealt.mapInArrow(pack, _BLOCKS).write.partitionBy("range").parquet(out)


def read_ids(spark: SparkSession, out: str, *, checksums: bool = False) -> DataFrame:
    """`doc_id, start, n_tokens, ids` of every document of token files; `start` counts the ids of all documents before it.

    Ids are little-endian unsigned 32-bit integers; with `checksums` there is their unsigned CRC-32, `ids_crc32`, in their place.
    """
    last, kind = ("ids_crc32", pa.int64()) if checksums else ("ids", pa.binary())

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = memoryview(decode_block(row["block"]).astype("<u4")).cast("B")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                blobs = [ids[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True)]
                values = [zlib.crc32(b) for b in blobs] if checksums else [bytes(b) for b in blobs]
                yield pa.record_batch(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([row["range"]] * len(ends), pa.int32()),
                        pa.array(starts + row["before"]),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array(values, kind),
                    ],
                    ["doc_id", "range", "at", "n_tokens", last],
                )

    blocks = spark.read.schema(_BLOCKS).parquet(out)
    sizes = blocks.groupBy("range").agg(F.sum("n_ids").alias("n"))  # one row per range
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("range", F.coalesce(before, F.lit(0)).alias("first"))
    schema = f"doc_id long, range int, at long, n_tokens long, {last} {'long' if checksums else 'binary'}"
    docs = blocks.mapInArrow(unpack, schema)
    return docs.join(F.broadcast(firsts), "range").select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", last
    )
