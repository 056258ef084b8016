"""Personal data in documents: fixed patterns, and what a trained field over word shapes finds besides.

The patterns decide the base spans. A conditional random field is fitted on a bounded sample of lines that the patterns label; a match that the
patterns reject is left out of it. Decoding all lines then finds what the patterns cannot take apart, such as a telephone
number that runs into a card number. What it adds must be possible for its kind and must not touch a base span.
"""

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import crf
from corpuscle.llm.words import Words, split_words, text_bytes, text_slices
from corpuscle.sources.tables import stored

TRAIN_DOCS, TRAIN_LINES, TRAIN_WORDS = 16_384, 1_200, 24  # bounds on what the field is fitted on
Span = tuple[int, int, int]  # kind, start, end

# The patterns, in the order of crf.KINDS; a match is checked and dropped when it fails.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_ANY = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def possible(kind: int, text: str) -> bool:
    """Whether a text can be of a kind: the checks of the patterns."""
    digits = "".join(_DIGIT.findall(text))
    if kind == 0:
        return bool(emails(text))
    if kind == 1:
        return _IP.fullmatch(text) is not None and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses from left to right: every @ takes what can stand before it, back to the last address."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans the patterns find, by start and then kind, and matches that failed their check."""
    if not _ANY.search(text):
        return [], []
    good: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    bad: list[Span] = []
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            for found in pattern.finditer(text):
                (good if possible(kind, found.group()) else bad).append((kind, *found.span()))
    return sorted(good, key=lambda s: (s[1], s[0])), bad


# ── Words, lines and spans ────────────────────────────────────────────────────


def _lines(words: Words, data: np.ndarray) -> np.ndarray:
    """The line each word is on, counted over all texts."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    breaks = np.cumsum(data == 10)[words.origin]
    doc = words.doc()
    new = np.concatenate([[True], (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])])
    return np.cumsum(new) - 1


def _labelled(text: str) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a text, their lines, their labels by the patterns, and which words may not be learnt from."""
    texts = pa.array([text])
    words = split_words(texts, lower=False)
    data, _ = text_bytes(texts)
    good, bad = base_spans(text)
    places = np.cumsum((data & 0xC0) != 0x80) - 1  # code point of each byte
    begin = places[words.origin] if len(data) else words.origin
    end = begin + 1
    if len(data):
        end = places[words.origin + (words.end - words.start) - 1] + 1
    labels, unclear = np.zeros(len(begin), np.int64), np.zeros(len(begin), bool)
    for kind, a, b in good:
        mine = np.flatnonzero((begin < b) & (end > a))
        labels[mine] = 2 + 2 * kind
        labels[mine[:1]] = 1 + 2 * kind
    taken = np.zeros(len(begin), bool)
    for kind, a, b in bad:
        touched = (begin < b) & (end > a) & (labels == 0)
        if kind == 3 or b - a > 13:  # short ones are just numbers
            taken |= touched
    unclear |= taken
    return words, _lines(words, data), labels, unclear


def _windows(words: Words, lines: np.ndarray, labels: np.ndarray, unclear: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """Stretches of lines to learn from: first word, word after the last, and whether there is something to find."""
    cuts = np.flatnonzero(np.concatenate([[True], lines[1:] != lines[:-1], [True]])) if len(lines) else [0]
    digits = crf.shapes(words)[:, 1] > 0
    for a, b in pairwise(cuts):
        for first in range(int(a), int(b), TRAIN_WORDS):
            last = min(first + TRAIN_WORDS, int(b))
            whole = labels[first] % 2 == 1 or labels[first] == 0
            if whole and not unclear[first:last].any():
                yield first, last, bool(labels[first:last].any() or digits[first:last].any())


def train(docs: DataFrame, *, docs_bound: int = TRAIN_DOCS, lines_bound: int = TRAIN_LINES) -> crf.Field | None:
    """Fit the field on at most `lines_bound` pieces of lines with something to find and a quarter as many without.

    They come from the `docs_bound` rows with the least hashes of text and id, labelled by the patterns. None when the patterns find
    nothing there.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = rows.select(F.xxhash64("doc_id", "text").alias("key")).orderBy("key").limit(docs_bound).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"key": [], "place": [], "found": [], "shape": [], "labels": []}
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words, lines, labels, unclear = _labelled(text)
                shape = crf.shapes(words)
                for first, last, found in _windows(words, lines, labels, unclear):
                    if found or (key + first) % 16 == 0:
                        out["key"].append(key)
                        out["place"].append(first)
                        out["found"].append(found)
                        out["shape"].append(shape[first:last].astype("<i4").tobytes())
                        out["labels"].append(labels[first:last].astype("<i4").tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=_WINDOWS)

    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text")).join(F.broadcast(keys), "key").select("key", "text")
    found = stored(keyed.mapInArrow(run, "key long, place long, found boolean, shape binary, labels binary"), "labelled-lines")
    order = F.xxhash64("key", "place"), F.col("key"), F.col("place"), F.col("shape")
    some = found.where("found").orderBy(*order).limit(lines_bound).toArrow().to_pylist()
    none = found.where("NOT found").orderBy(*order).limit(lines_bound // 4).toArrow().to_pylist()
    chosen = some + none
    labels = [np.frombuffer(r["labels"], "<i4") for r in chosen]
    if not any(x.any() for x in labels):
        return None
    shape = np.concatenate([np.frombuffer(r["shape"], "<i4").reshape(-1, len(crf.SIZES)) for r in chosen])
    sequence = np.repeat(np.arange(len(labels)), [len(x) for x in labels])
    return crf.fit(shape.astype(np.int64), sequence, np.concatenate(labels).astype(np.int64))


_WINDOWS = pa.schema(
    [("key", pa.int64()), ("place", pa.int64()), ("found", pa.bool_()), ("shape", pa.binary()), ("labels", pa.binary())]
)

# ── Finding ───────────────────────────────────────────────────────────────────

_EDGE = " \t\n\x0b\x0c\r.,;:!?\"'<>[]{}"


def _decoded(words: Words, data: np.ndarray, field: crf.Field) -> list[tuple[int, int, int, int]]:
    """Stretches of words the field labels: text, kind, first word and word after the last."""
    shape = crf.shapes(words)
    lines = _lines(words, data)
    if not len(lines):
        return []
    codes = np.ravel_multi_index(tuple(shape.T), crf.SIZES)
    kinds, back = np.unique(codes, return_inverse=True)
    quiet = field.quiet(np.stack(np.unravel_index(kinds, crf.SIZES), 1))[back]
    loud = np.bincount(lines, ~quiet) > 0  # the other lines have nothing but `out`, by proof
    chosen = np.flatnonzero(loud[lines])
    if not len(chosen):
        return []
    before, after = crf.neighbours(shape, lines)
    scores = field.emissions(shape[chosen], before[chosen], after[chosen])
    mine = lines[chosen]
    starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
    labels = field.decode(scores, starts, np.diff(np.append(starts, len(mine))))
    begins = np.flatnonzero(labels % 2 == 1)
    doc = words.doc()
    out = []
    for at in begins.tolist():
        end = at + 1
        while end < len(labels) and labels[end] == labels[at] + 1 and mine[end] == mine[at]:
            end += 1
        out.append((int(doc[chosen[at]]), int(labels[at]) // 2, int(chosen[at]), int(chosen[end - 1]) + 1))
    return out


def _trimmed(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    """A stretch without punctuation around it."""
    while start < end and (text[start] in _EDGE or (kind != 3 and text[start] in "()")):
        start += 1
    while end > start and (text[end - 1] in _EDGE or text[end - 1] in "()"):
        end -= 1
    return start, end


def find(texts: pa.Array, field: crf.Field | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base and added spans of every text, in code points, by start and then kind."""
    strings = [t or "" for t in texts.to_pylist()]
    base = [base_spans(t)[0] for t in strings]
    added: list[list[Span]] = [[] for _ in strings]
    if field is None:
        return base, added
    words = split_words(texts, lower=False)
    data, at = text_bytes(texts)
    for doc, kind, first, last in _decoded(words, data, field):
        start, end = int(words.origin[first]), int(words.origin[last - 1] + words.end[last - 1] - words.start[last - 1])
        begin = len(data[at[doc] : start].tobytes().decode())
        stretch = _trimmed(strings[doc], kind, begin, begin + len(data[start:end].tobytes().decode()))
        free = all(b <= stretch[0] or a >= stretch[1] for _, a, b in base[doc])
        if stretch[0] < stretch[1] and free and possible(kind, strings[doc][slice(*stretch)]):
            added[doc].append((kind, *stretch))
    return base, [sorted(spans, key=lambda s: (s[1], s[0])) for spans in added]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_private(docs: DataFrame, field: crf.Field | None) -> DataFrame:
    """`doc_id, base, added` for every row of `docs(doc_id, text)`: spans with kind, start and end in code points.

    A null or empty text has no spans; without a field nothing is added. Repeated rows and null ids are rows like
    others; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                both = find(part.column("text"), field)
                spans = [
                    pa.array([[{"kind": crf.KINDS[k], "start": a, "end": b} for k, a, b in row] for row in rows], _SPANS)
                    for rows in both
                ]
                yield pa.record_batch([part.column("doc_id"), *spans], ["doc_id", "base", "added"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id long, base {SPANS}, added {SPANS}")


def written(spans: Column) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def ordered(spans: Column) -> Column:
    """Spans by start and then kind, as the kinds are listed."""
    rank = F.array(*[F.lit(k) for k in crf.KINDS])
    keyed = F.transform(spans, lambda s: F.struct(s["start"], F.array_position(rank, s["kind"]), s["end"], s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"], s["start"], s["end"]))
