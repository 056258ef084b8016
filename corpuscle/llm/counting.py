"""Word counts of a whole corpus: counted per task on hashes, then summed by word."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.words import split_words, text_slices, xxh64
from corpuscle.sources.tables import stored

HELD = 1 << 20  # distinct words a task holds before it hands on what it has


def _merged(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Counts of several slices as one; words are told apart by 64-bit hashes within a task only."""
    hashes, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    counts = np.bincount(back, np.concatenate([p[1] for p in parts]), len(hashes)).astype(np.int64)
    words = pa.chunked_array([p[2] for p in parts]).take(pa.array(first))
    return hashes, counts, words.combine_chunks()


def count_words(texts: DataFrame) -> DataFrame:
    """`word, n` for every distinct word of `texts(text)`, A-Z lower-cased; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                _, counts, words = _merged(held)
                held.clear()
                for first in range(0, len(words), 1 << 17):
                    some = slice(first, first + (1 << 17))
                    yield pa.record_batch([words[some].cast(pa.string()), pa.array(counts[some])], ["word", "n"])

        for batch in batches:
            for part in text_slices(batch):
                split = split_words(part.column("text"))
                hashes, first, counts = np.unique(
                    xxh64(split.data, split.start, split.end), return_index=True, return_counts=True
                )
                held.append((hashes, counts, split.strings(first)))
            if len(held) > 1 and sum(len(h) for h, *_ in held) > HELD:
                held[:] = [_merged(held)]
                if len(held[0][0]) > HELD:
                    yield from flush()
        yield from flush()

    words = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, limit: int, *keep: str) -> pa.Table:
    """Rows of a stored count table (`n`) with the highest counts, `limit` at most: all above the count that keeps within it."""
    step = F.floor(F.log2("n") * 8)
    bound, total = None, 0
    for at, n in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few hundred rows
        total += n
        if total > limit:
            break
        bound = at
    if bound is None:
        return counted.select(*keep).limit(0).toArrow()
    return counted.where(step >= bound).select(*keep).toArrow()


def stored_counts(texts: DataFrame) -> DataFrame:
    """`count_words`, written once."""
    return stored(count_words(texts), "words")
