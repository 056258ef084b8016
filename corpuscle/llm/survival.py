"""How document filters act together: truth tables of survival, counted by carry-save adders.

The five filters give each document a mask of those that it fails. Its survival word has 32 bits, one for each subset of the filters: set when
the document fails none of the subset. Positional popcounts of the words, by part and label, say how many documents survive
each subset, and from these 32 numbers follows what each filter does at each step of each order. Words are added by carry-save adders: three
words of one weight become a sum of that weight and a carry of twice the weight, so a column of bits costs a few operations on
whole words. Equal texts that share part and labels are one word that enters at the weights of their number.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.words import SLICE_BYTES, split_words, text_bytes, text_slices

# What the five filters ask.
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # percent of words
MOST_CAPITALS = 3  # percent of code points
SYMBOLS = b"#$%&*|"

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
SUBSETS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")

_MASKS = np.arange(SUBSETS)
# survival word of each mask of failed filters: bit T is set when the mask and the subset T have nothing in common
SURVIVES = (((_MASKS[:, None] & _MASKS) == 0).astype(np.uint64) << _MASKS.astype(np.uint64)).sum(1).astype(np.uint32)


# ── Filters of one text ───────────────────────────────────────────────────────


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def failed_filters(texts: pa.Array) -> np.ndarray:
    """The mask of the filters A to D that each text fails; null is empty."""
    words = split_words(texts, lower=False)
    total = words.count
    offsets = np.append(words.start, len(words.data) + 1) if len(words.start) else np.zeros(1, np.int64)
    data = np.append(words.data, np.uint8(32))  # each word with the blank after it
    strings = pa.Array.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    names = strings.dictionary_encode().indices.to_numpy().astype(np.int64)
    pairs = np.unique((words.doc() << 32) | names)
    distinct = np.bincount(pairs >> 32, minlength=len(texts))
    raw, at = text_bytes(texts)
    capitals = _per_text((raw >= 65) & (raw <= 90), at)
    points = _per_text((raw & 0xC0) != 0x80, at)
    fails = [
        total < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT * total,
        100 * capitals > MOST_CAPITALS * points,
        _per_text(_SYMBOL[raw], at) > 0,
    ]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


# ── Positional popcounts ──────────────────────────────────────────────────────


def positional_counts(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each of the 32 bits is set in the words, the k-th word counted `times[k]` times."""
    out = np.zeros(32, np.int64)
    carried = np.zeros(0, np.uint32)
    weight = 0
    while len(carried) or np.any(times >> weight):
        level = np.concatenate([carried, words[((times >> weight) & 1).astype(bool)]])
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c, rest = level[:third], level[third : 2 * third], level[2 * third : 3 * third], level[3 * third :]
            both = a ^ b
            carries.append((a & b) | (both & c))
            level = np.concatenate([both ^ c, rest])
        for word in level.tolist():
            out += ((word >> np.arange(32)) & 1) << weight
        carried = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
        weight += 1
    return out


# ── Tables ────────────────────────────────────────────────────────────────────


def failures(docs: DataFrame) -> DataFrame:
    """`doc_id, part, digest, fails` for every document: the filters A to D that its text fails, and the digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in text_slices(batch, size=SLICE_BYTES):
                fails = pa.array(failed_filters(some.column("text")), pa.int32())
                yield pa.record_batch([*(some.column(c) for c in ("doc_id", "part", "digest")), fails], ["doc_id", "part", "digest", "fails"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, fails int")


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`part, all, good, toxic`: for each part the numbers of documents that survive each subset of filters, as arrays of 32
    (bit k of an index stands for the k-th filter), of all documents and of those labelled quality 1 and toxic 1.

    A part is a value of `lang`, null as the empty string. A document fails E when a row with a smaller id has its whole
    text. Rows of one id and text do not make each other fail, and a row without id never fails E nor has labels. An id that is labelled more than once
    has a label when one of its rows has it. Nothing moves but ids, digests and counts, and equal rows are added up first.
    """
    found = failures(docs).groupBy("doc_id", "part", "digest", "fails").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    )
    marks = marks.where("good OR toxic").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    found = found.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    kinds = ["digest", "part", "fails", "good", "toxic"]
    numbered = F.col("doc_id").isNotNull()
    groups = found.groupBy(*kinds).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),
        F.coalesce(F.sum(F.when(~numbered, F.col("n"))), F.lit(0)).alias("n_null"),
    )
    # a text has as many rows here as it has parts and labels, however many copies there are
    groups = groups.withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    clear = F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0) + F.col("n_null")
    each = F.array(
        F.struct("fails", clear.alias("n")), F.struct((F.col("fails") + COPY).alias("fails"), (F.col("n") - clear).alias("n"))
    )
    words = groups.select("part", "good", "toxic", F.inline(each)).where("n > 0")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            named = batch.column("part").dictionary_encode()
            part = named.indices.to_numpy()
            word = SURVIVES[batch.column("fails").to_numpy()]
            times = batch.column("n").to_numpy()
            good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(len(named.dictionary) + 1))
            rows = []
            for first, last in itertools.pairwise(cuts):
                own = order[first:last]
                labelled = (own, own[good[own]], own[toxic[own]])
                rows.append(np.concatenate([positional_counts(word[x], times[x]) for x in labelled]))
            counts = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(rows)), 3 * SUBSETS).cast(pa.list_(pa.int64()))
            yield pa.record_batch([named.dictionary, counts], ["part", "counts"])

    counted = words.mapInArrow(add, "part string, counts array<long>")
    sums = [F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(3 * SUBSETS)]
    counted = counted.groupBy("part").agg(*sums)
    arrays = [F.array(*[f"c{k}" for k in range(j * SUBSETS, (j + 1) * SUBSETS)]).alias(name) for j, name in enumerate(LABELS)]
    return counted.select("part", *arrays)


def order_report(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step of `counts`, as `survivors` gives them.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. No parts give no rows.
    """
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    steps = [(order, k) for order in orders for k in range(len(FILTERS))]
    bit = np.array([1 << FILTERS.index(order[k]) for order, k in steps])
    before = np.array([sum(1 << FILTERS.index(x) for x in order[:k]) for order, k in steps])
    after = before | bit
    everything = SUBSETS - 1
    names = pa.array([order for order, _ in steps])
    step = pa.array([k + 1 for _, k in steps], pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *tables in zip(*(batch.column(c).to_pylist() for c in ("part", *LABELS)), strict=True):
                whole, good, toxic = (np.array(t, np.int64) for t in tables)
                removed = whole[before] - whole[after]
                failing = whole[0] - whole[bit]
                unique = whole[everything - bit] - whole[everything]
                total = np.bincount(bit, removed, SUBSETS).astype(np.int64)[bit]
                lost = [x[before] - x[after] for x in (good, toxic)]
                numbers = [whole[after], removed, failing - removed, unique, *lost, total]
                yield pa.record_batch([pa.array([part] * len(steps), pa.string()), names, step, *map(pa.array, numbers)], _REPORT)

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _REPORT[3:])
    return counts.mapInArrow(run, schema)


_REPORT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of all 120 orders, by part; `survivors` and `order_report` in one."""
    return order_report(survivors(docs, labels))
