"""A quality classifier from trusted positives and unlabelled texts, by non-negative positive-unlabelled risk.

Texts become a fixed number of shares and averages over the whole text: bytes, words, lines and how often they repeat. A network with one hidden
layer is fitted on a bounded sample: labelled good texts and texts taken as they come, of which a share (the class prior,
estimated from the labelled rows) is good. The risk of calling unlabelled texts bad, less the good ones' part of it, is kept
from going negative, so the network does not learn to call every unlabelled text bad.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.words import split_words, text_bytes, text_slices, xxh64

POSITIVES, UNLABELLED = 8_192, 16_384  # bounds on the rows the classifier is fitted on
HIDDEN, ROUNDS, BATCH, RATE, DECAY = 24, 60, 512, 3e-3, 1e-4
_SIGNS = [b for b in range(128) if not chr(b).isalpha()]


# ── Features ──────────────────────────────────────────────────────────────────


def _distinct(doc: np.ndarray, hashes: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and how often its most frequent one occurs."""
    if not len(doc):
        return np.zeros(docs), np.zeros(docs)
    order = np.lexsort([hashes, doc])
    d, h = doc[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))
    runs = np.diff(np.append(new, len(d)))
    most = np.zeros(docs)
    np.maximum.at(most, d[new], runs)
    return np.bincount(d[new], minlength=docs).astype(float), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text, all computed over the whole text; a null or empty text is a row of zeros."""
    data, at = text_bytes(texts)
    docs = len(at) - 1
    size = np.diff(at)
    doc = np.repeat(np.arange(docs), size)
    seen = np.bincount(doc * 256 + data, minlength=docs * 256).reshape(docs, 256).astype(float)
    per_byte = seen / np.maximum(size, 1)[:, None]
    words = split_words(texts, lower=False)
    count = words.count.astype(float)
    each = np.maximum(count, 1)
    owner = words.doc()
    length = words.end - words.start
    opens, closes = words.data[words.start], words.data[words.end - 1]
    upper = lambda x: (x >= 65) & (x <= 90)
    lower = lambda x: (x >= 97) & (x <= 122)
    sign = lambda x: (x < 128) & ~upper(x) & ~lower(x) & ~((x >= 48) & (x <= 57))
    rate = lambda flags: np.bincount(owner, flags, docs) / each
    after = words.data[np.minimum(words.start + 1, max(len(words.data) - 1, 0))] if len(owner) else opens
    before = words.data[np.maximum(words.end - 2, 0)] if len(owner) else closes
    hashes = xxh64(words.data, words.start, words.end)
    distinct, most = _distinct(owner, hashes, docs)
    again = np.zeros(len(owner), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([at[:-1][size > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    lines = np.searchsorted(at, starts, side="right") - 1
    n_lines = np.bincount(lines, minlength=docs).astype(float)
    own = np.maximum(ends - starts - (data[ends - 1] == 10), 0) if len(starts) else ends
    kept, common = _distinct(lines, xxh64(data, starts, starts + own), docs)
    columns = [
        np.log1p(count),
        np.bincount(owner, length, docs) / each,
        np.sqrt(np.bincount(owner, length.astype(float) ** 2, docs) / each),
        per_byte[:, 65:91].sum(1),
        per_byte[:, 97:123].sum(1),
        per_byte[:, 128:].sum(1),
        rate(upper(opens)),
        rate(upper(opens) & upper(after)),
        rate(sign(closes)),
        rate(sign(closes) & sign(before)),
        rate(sign(opens)),
        rate(length == 1),
        rate(length > 12),
        distinct / each,
        most / each,
        np.log1p(n_lines),
        kept / np.maximum(n_lines, 1),
        common / np.maximum(n_lines, 1),
        np.log1p(count / np.maximum(n_lines, 1)),
        np.log1p(most) * (count > 0),
        rate(again),
    ]
    dense = np.stack(columns, axis=1)
    dense[size == 0] = 0
    return np.concatenate([dense, np.sqrt(per_byte[:, _SIGNS])], axis=1).astype(np.float32)


# ── The classifier ────────────────────────────────────────────────────────────


@dataclass
class Classifier:
    """A standardised network; `score` is the chance of being good."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Scores between 0 and 1."""
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        hidden = np.tanh(x @ self.weights[0] + self.weights[1])
        return 1 / (1 + np.exp(-np.clip(hidden @ self.weights[2] + self.weights[3], -30, 30)[:, 0]))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> Classifier:
    """Minimise the non-negative risk with the sigmoid loss, in mini-batches."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    prepare = lambda rows: np.clip((rows - mean) / scale, -8, 8)
    good, some = prepare(positive), prepare(unlabelled)
    width = good.shape[1]
    weights = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for turn in range(ROUNDS):
        pull = RATE * (1 - turn / ROUNDS) + 1e-5
        order = rng.permutation(len(some))
        for begin in range(0, len(some), BATCH):
            u = some[order[begin : begin + BATCH]]
            p = good[rng.integers(0, len(good), min(BATCH, len(good)))]
            x = np.concatenate([p, u])
            hidden = np.tanh(x @ weights[0] + weights[1])
            out = (hidden @ weights[2] + weights[3])[:, 0]
            bad = 1 / (1 + np.exp(-np.clip(out, -30, 30)))  # loss of calling a text bad; calling it good is one less that
            slope = bad * (1 - bad)
            n = len(p)
            excess = bad[n:].mean() - prior * bad[:n].mean()
            grad = np.zeros(len(x))
            if excess >= 0:
                grad[:n] = -2 * prior * slope[:n] / n
                grad[n:] = slope[n:] / len(u)
            else:  # undo what drove the risk below zero
                grad[:n] = prior * slope[:n] / n
                grad[n:] = -slope[n:] / len(u)
            back = grad[:, None] * weights[2].T * (1 - hidden**2)
            grads = [x.T @ back, back.sum(0), hidden.T @ grad[:, None], grad.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                g = g + DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= pull * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Classifier(mean, scale, weights)


def held_out(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves `fold`. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _sample(ids: DataFrame, size: int) -> DataFrame:
    """At most `size` ids, the ones with the least hashes."""
    return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def train(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier | None:
    """Fit on at most `positives` rows labelled good and `unlabelled` rows, none of them held out; None without a good one.

    An id with several labels is good when all of them are; of a repeated id one text is learnt from. Null ids are not learnt from.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull())
    ids = ids.where(~held_out(F.col("doc_id")))
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.min("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    good, total = marks.agg(F.sum((F.col("quality") == 1).cast("int")), F.count("*")).first()
    if not good:
        return None
    trusted = _sample(ids.join(marks.where("quality = 1"), "doc_id", "left_semi"), positives).withColumn("kind", F.lit(1))
    chosen = trusted.union(_sample(ids, unlabelled).withColumn("kind", F.lit(0)))  # a bounded number of ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = [r.tobytes() for r in features(part.column("text"))]
                columns = [part.column("doc_id"), part.column("kind"), pa.array(rows, pa.binary())]
                yield pa.record_batch(columns, ["doc_id", "kind", "row"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    one = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))  # of a repeated id
    texts = one.join(F.broadcast(chosen), "doc_id")
    found = texts.mapInArrow(run, "doc_id long, kind int, row binary").toArrow().sort_by([("doc_id", "ascending"), ("row", "ascending")])
    kind = found.column("kind").to_numpy()
    if not (kind == 1).any():
        return None
    rows = np.frombuffer(b"".join(found.column("row").to_pylist()), np.float32).reshape(found.num_rows, -1)
    return fit(rows[kind == 1], rows[kind == 0], good / total)


def scores(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """`doc, score`: every row of `docs` as a struct, and the chance that its text is good.

    A null or empty text is scored as a row of zeros. Without a good label to learn from every score is 0.5.
    """
    model = train(docs, labels, **bounds)
    rows = docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found = model.score(features(part.column("text"))) if model else np.full(part.num_rows, 0.5)
                yield pa.record_batch([part.column("doc"), pa.array(found)], ["doc", "score"])

    return rows.mapInArrow(run, rows.select("doc").withColumn("score", F.lit(0.0)).schema)
