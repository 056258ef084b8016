"""Near-duplicate documents by SimHash fingerprints and a binary trie joined with itself.

Fingerprints of a document are majority votes over the hashes of its word shingles. Equal fingerprints are one class; classes
are linked when at most `budget` bits differ. Bits are cut into `parts`, and two fingerprints are compared where one part
agrees exactly; with more parts than budget that loses no link (a pair within the budget leaves one part untouched).
Inside a part's value the fingerprints form a binary trie, which is joined with itself from the root: node pairs carry the
bits they differ in so far and are dropped beyond the budget. A task emits a spanning forest of the links it finds, so
a thousand near copies give a thousand rows and not a million.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.components import components
from corpuscle.llm.words import mix64, shingles, split_words, text_slices, xxh64
from corpuscle.sources.tables import scratch, stored, work_path

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)  # little-endian bits of a byte
DIRECT = 64  # node pairs with at most so many pairs below them are compared outright
PIECE = 1 << 18  # node pairs or pairs handled at a time
LARGE = 20_000  # fingerprints that agree in a part; more than that meet in chunks of so many


# ── Fingerprints ──────────────────────────────────────────────────────────────


def fingerprint_words(texts: pa.Array, words: int, bits: int, *, once: bool = False) -> np.ndarray:
    """One row of `bits / 64` unsigned words per text: bit set when over half of the shingle hashes have it.

    A repeated shingle votes each time, or with `once` a single time.
    """
    split = split_words(texts)
    start, end, doc = shingles(split, words)
    base = xxh64(split.data, start, end)
    docs = len(split.first) - 1
    if once:
        order = np.lexsort([base, doc])
        base, doc = base[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (base[1:] != base[:-1]) | (doc[1:] != doc[:-1])
        base, doc = base[new], doc[new]
    total = np.bincount(doc, minlength=docs)[:, None]
    out = np.zeros((docs, bits // 64), np.uint64)
    for k in range(bits // 64):
        with np.errstate(over="ignore"):
            h = mix64(base + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) if k else base
        lanes = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            seen = np.bincount(doc * 256 + lanes[:, byte], minlength=docs * 256).reshape(docs, 256)
            ones = (2 * (seen @ _BITS) > total).astype(np.uint8)
            out[:, k] |= np.packbits(ones, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame, *, words: int = 4, bits: int = 64, once: bool = False) -> DataFrame:
    """`doc_id, mark, code` for every document: a hash of its text, and the fingerprint as bytes, least significant first.

    A text of fewer words is one shingle; a null or empty text has the fingerprint zero. `bits` is a multiple of 64. With `once`
    a shingle that a text repeats votes a single time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = fingerprint_words(part.column("text"), words, bits, once=once).astype("<u8")
                data = pa.py_buffer(np.ascontiguousarray(rows))
                codes = pa.Array.from_buffers(pa.binary(bits // 8), len(rows), [None, data]).cast(pa.binary())
                yield pa.record_batch([part.column("doc_id"), part.column("mark"), codes], ["doc_id", "mark", "code"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, code binary")


def hex_digits(code: str, size: int = 8) -> Column:
    """A fingerprint of `size` bytes as hex digits, most significant first."""
    return F.lower(F.concat(*[F.hex(F.substring(code, k, 1)) for k in range(size, 0, -1)]))


# ── The trie joined with itself ───────────────────────────────────────────────


class Forest:
    """Which fingerprints are connected already, and the links that connected them."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.root[a] != self.root[b]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect pairs; only links that connect something new are kept."""
        while len(a):
            ra, rb = self.root[a], self.root[b]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            away = high != low
            a, b, high, low = a[away], b[away], high[away], low[away]
            if not len(a):
                return
            high, first = np.unique(high, return_index=True)  # each root is hooked once a turn
            low = low[first]
            self.left.append(a[first])
            self.right.append(b[first])
            self.root[high] = low
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _pairs_below(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of entries of node ranges; of a node with itself each pair once."""
    wide = b1 - b0
    each = (a1 - a0) * wide
    pair = np.repeat(np.arange(len(each)), each)
    spot = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
    left, right = a0[pair] + spot // wide[pair], b0[pair] + spot % wide[pair]
    once = (a0[pair] != b0[pair]) | (left < right)
    return left[once], right[once]


def trie_links(group: np.ndarray, codes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints of equal group, as positions.

    `group` is sorted and `codes` (rows of unsigned words) are sorted within it. Each group is the root of a trie. Node pairs go
    down one bit at a time, adding one when the bits differ, and end beyond the budget.
    """
    forest = Forest(len(group))
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    lo, hi = cuts[:-1], cuts[1:]
    many = hi - lo > 1
    zeros = np.zeros(int(many.sum()), np.int16)
    bits, ones = codes.shape[1] * 64, {}

    def settle(a0, a1, b0, b1) -> None:
        sizes = np.cumsum((a1 - a0) * (b1 - b0))
        first = 0
        while first < len(sizes):
            before = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + PIECE, side="right")))
            left, right = _pairs_below(*(x[first:last] for x in (a0, a1, b0, b1)))
            new = forest.apart(left, right)
            left, right = left[new], right[new]
            close = np.bitwise_count(codes[left] ^ codes[right]).sum(1, dtype=np.int64) <= budget
            forest.join(left[close], right[close])
            first = last

    todo = [(0, lo[many], hi[many], lo[many], hi[many], zeros)]
    while todo:
        depth, a0, a1, b0, b1, diff = todo.pop()
        if len(a0) > PIECE:
            half = len(a0) // 2
            todo += [(depth, *(x[s] for x in (a0, a1, b0, b1, diff))) for s in (slice(half, None), slice(half))]
            continue
        small = ((a1 - a0) * (b1 - b0) <= DIRECT) | (depth >= bits)
        settle(a0[small], a1[small], b0[small], b1[small])
        a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        if depth not in ones:
            word, bit = divmod(depth, 64)
            ones[depth] = np.concatenate([[0], np.cumsum((codes[:, word] >> np.uint64(63 - bit)) & np.uint64(1))]).astype(
                np.int64
            )
        up = ones[depth]
        am, bm = a1 - (up[a1] - up[a0]), b1 - (up[b1] - up[b0])
        same = a0 == b0
        steps = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1), (am, a1, b0, bm, diff + 1)]
        joined = [np.concatenate(x) for x in zip(*steps, strict=True)]
        live = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= budget)
        live[len(same) * 3 :] &= ~same  # of a node with itself the two mixed pairs are one
        todo.append((depth + 1, *(x[live] for x in joined)))
    if not forest.left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(forest.left), np.concatenate(forest.right)


def _part_edges(bits: int, parts: int) -> list[tuple[int, int]]:
    """First bit and width of each part; widths differ by one at most and are at most 32."""
    cuts = [bits * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _bit_range(codes: np.ndarray, first: int, width: int) -> np.ndarray:
    """The value of some bits of each fingerprint."""
    word, shift = divmod(first, 64)
    value = codes[:, word] >> np.uint64(shift)
    if shift + width > 64:
        value = value | (codes[:, word + 1] << np.uint64(64 - shift))
    return value & np.uint64((1 << width) - 1)


def _codes(column: pa.Array, bits: int) -> np.ndarray:
    """Fingerprint bytes as rows of unsigned words."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<u8").reshape(-1, bits // 64)


FEW = 500_000  # rows of ids that are given to every task rather than shuffled with the texts


def _few(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers each, to be broadcast when there are no more than `FEW`."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by key as tables that hold all rows of each of their keys."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:  # everything before the last key's first row is complete
        held.append(batch)
        rows += batch.num_rows
        if rows < 50_000:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        values = table.column(key).to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield table.slice(0, cut)
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def fingerprint_links(classes: DataFrame, *, bits: int, budget: int, parts: int, partitions: int) -> DataFrame:
    """Links `a, b` that connect the distinct fingerprints `node long, code binary` as all pairs within the budget would.

    Exact when `parts > budget`. With fewer parts a pair is found when one of its parts agrees. Where more than `LARGE` fingerprints
    agree in a part, chunks of them meet pair by pair, in tasks of their own.
    """

    def keys(batch: pa.RecordBatch) -> Iterator[pa.Array]:
        codes = _codes(batch.column("code"), bits)
        for k, (first, width) in enumerate(_part_edges(bits, parts)):
            yield pa.array((np.int64(k) << np.int64(32)) | _bit_range(codes, first, width).astype(np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in keys(batch):
                yield pa.record_batch([key, batch.column("node"), batch.column("code")], ["part", "node", "code"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in keys(batch):
                part, n = np.unique(key.to_numpy(), return_counts=True)
                yield pa.record_batch([pa.array(part), pa.array(n)], ["part", "n"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "part"):
            yield found(table)

    def found(table: pa.Table) -> pa.RecordBatch:
        part = table.column("part").to_numpy()
        node = table.column("node").to_numpy()
        codes = _codes(table.column("code"), bits)
        order = np.lexsort([*(codes[:, k] for k in range(codes.shape[1] - 1, -1, -1)), part])
        a, b = trie_links(part[order], codes[order], budget)
        return pa.record_batch([pa.array(node[order][a]), pa.array(node[order][b])], ["a", "b"])

    sizes = classes.select("code").mapInArrow(count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))
    large = stored(sizes.where(F.col("n") > LARGE), "large-parts")
    placed = classes.select("node", "code").mapInArrow(place, "part long, node long, code binary")
    if not large.isEmpty():
        joined = placed.join(_few(large), "part", "left")
        chunks = F.coalesce(F.ceil(F.col("n") / LARGE), F.lit(1)).cast("int")
        joined = joined.withColumn("chunks", chunks)
        joined = joined.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        joined = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        # keys of two groups that happen to be equal make one group, which only compares more
        pair = F.xxhash64("part", F.least("chunk", "other"), F.greatest("chunk", "other"))
        placed = joined.select(F.when(F.col("chunks") == 1, F.col("part")).otherwise(pair).alias("part"), "node", "code")
    return (
        placed.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(link, "a long, b long").distinct()
    )


def near_duplicates(
    docs: DataFrame, *, words: int = 4, bits: int = 64, budget: int = 4, parts: int = 5, once: bool = False
) -> DataFrame:
    """`doc_id, mark, code, component, component_id` for every document.

    component_id is the smallest doc_id that links reach (null ids aside; null when all of them are). Rows of one
    fingerprint, whatever their ids, are one class; a repeated row gives a row each time. Other columns are not read. `once` as in
    `fingerprints`.
    """
    coded, named = _linked_classes(docs, words=words, bits=bits, budget=budget, parts=parts, once=once)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("code", "component", "component_id")
    return coded.join(named, "code").select("doc_id", "mark", "code", "component", "component_id")


def _linked_classes(
    docs: DataFrame, *, words: int, bits: int, budget: int, parts: int, once: bool
) -> tuple[DataFrame, DataFrame]:
    """`doc_id, mark, code` of every document, and `code, component, least` (the least doc_id) of every class of one fingerprint."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = stored(fingerprints(docs, words=words, bits=bits, once=once), "fingerprints")
    classes = coded.groupBy("code").agg(F.min("doc_id").alias("least"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    links = fingerprint_links(classes, bits=bits, budget=budget, parts=parts, partitions=partitions)
    named = classes.join(components(links), "node", "left")
    return coded, named.select("code", F.coalesce("component", "node").alias("component"), "least")


# ── Similarity by shingles ────────────────────────────────────────────────────

CHUNK = 512  # texts of a component that are compared with as many at a time
COLUMNS = 8_192  # shingles counted in one matrix product


def alike(sets: list[np.ndarray], least: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of numbers whose Jaccard similarity is `least` or more; with `split` only pairs across that position."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.flatnonzero(np.bincount(column) > 1)
    place = np.full(int(column.max(initial=-1)) + 1, -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    left = slice(None) if split is None else slice(0, split)
    right = slice(None) if split is None else slice(split, None)
    both = np.zeros((len(size[left]), len(size[right])), np.float32)
    for first in range(0, len(shared), COLUMNS):
        some = (column >= first) & (column < first + COLUMNS)
        has = np.zeros((len(sets), min(COLUMNS, len(shared) - first)), np.float32)
        has[owner[some], column[some] - first] = 1
        both += has[left] @ has[right].T
    union = size[left][:, None] + size[right] - both
    a, b = np.nonzero((both >= least * union) & (union > 0))
    if split is None:
        a, b = a[a < b], b[a < b]
        return a, b
    return a, b + split


SAMPLE = 8_192  # texts, about, whose shingles tell which ones are common
COMMON = 1 << 17  # common shingles that are kept, by count
HOT = 20_000  # texts that share a shingle; of more, chunks meet in tasks of their own


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, on end; and where each text's begin (one more entry at the end)."""
    split = split_words(texts)
    start, end, doc = shingles(split, words)
    hashes = xxh64(split.data, start, end)
    order = np.lexsort([hashes, doc])
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def rare_shingles(
    hashes: np.ndarray, cuts: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles of each text in one order of all shingles, rare ones first: so many that texts with a Jaccard
    similarity of `least` share one. Gives hash, text, place in the order, distinct shingles of the text, and count if common.

    Such texts share `least` times the larger set or more, so what they share is not all among what comes after. `common` is sorted
    and only sets the order.
    """
    size = np.diff(cuts)
    doc = np.repeat(np.arange(len(size)), size)
    count = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        count = np.where(common[at] == hashes, counts[at], 0)
    order = np.lexsort([hashes, count, doc])
    place = np.arange(len(hashes)) - cuts[:-1][doc]
    first = place < (size - np.ceil(least * size - 1e-6) + 1)[doc]
    order = order[first]
    return hashes[order], doc[first], place[first], size[doc[first]], count[order]


def pairs_sharing(
    key: np.ndarray, node: np.ndarray, group: np.ndarray, place: np.ndarray, size: np.ndarray, least: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of equal key that may have a Jaccard similarity of `least`, by sizes and places; none inside a group >= 0."""
    order = np.lexsort([node, size, key])
    key, node, group, place, size = (x[order] for x in (key, node, group, place, size))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])  # a repeated row is one
    key, node, group, place, size = (x[new] for x in (key, node, group, place, size))
    rank = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) << 32
    last = np.searchsorted(rank + size, rank + np.floor(size / least + 1e-6).astype(np.int64), side="right")
    each = last - np.arange(len(key)) - 1
    sums = np.cumsum(each)
    first = 0
    while first < len(each):
        before = sums[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sums, before + PIECE, side="right")))
        n = each[first:end]
        a = np.repeat(np.arange(first, end), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        most = np.minimum(place[a], place[b]) + np.minimum(size[a] - place[a], size[b] - place[b])
        may = (most >= least / (1 + least) * (size[a] + size[b]) - 1e-6) & (node[a] != node[b])
        may &= (group[a] != group[b]) | (group[a] < 0)
        x, y = node[a[may]], node[b[may]]
        if len(x):
            yield np.minimum(x, y), np.maximum(x, y)
        first = end


def _common_shingles(texts: DataFrame, count: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one text of a sample, sorted, and how many have them."""
    step = max(1, count // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                yield pa.record_batch([pa.array(shingle_sets(part.column("text"), words)[0].view(np.int64))], ["shingle"])

    sample = texts.where(F.pmod("mark", F.lit(step)) == 0).select("text").mapInArrow(run, "shingle long")
    found = sample.groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()
    hashes, counts = found.column("shingle").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _groups_below(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by key: tables of whole keys with at most `most` rows each, and (True) pieces of the keys that have more."""
    held: list[pa.RecordBatch] = []
    large = None  # the key whose rows go out in pieces
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        if large is not None:
            cut = int(np.searchsorted(values, large, side="right"))
            if cut:
                yield pa.Table.from_batches([batch.slice(0, cut)]), True
            if cut == batch.num_rows:
                continue
            batch, large = batch.slice(cut), None
        held.append(batch)
        if sum(b.num_rows for b in held) < 2 * most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        yield from _cut_groups(table, key, most, last=False)
        values = table.column(key).to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        held = []
        if table.num_rows - cut > most:
            large = values[-1]
            yield table.slice(cut), True
        else:
            held = table.slice(cut).to_batches()
    if held:
        yield from _cut_groups(pa.Table.from_batches(held).combine_chunks(), key, most, last=True)


def _cut_groups(table: pa.Table, key: str, most: int, *, last: bool) -> Iterator[tuple[pa.Table, bool]]:
    """The keys of a sorted table, small ones together; not the last key, whose rows may go on, unless it is said to be complete."""
    values = table.column(key).to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    if not last:
        cuts = cuts[:-1]
    size = np.diff(cuts)
    first = 0
    for k in np.flatnonzero(size > most).tolist():
        if cuts[k] > first:
            yield table.slice(first, cuts[k] - first), False
        yield table.slice(cuts[k], size[k]), True
        first = int(cuts[k + 1])
    if cuts[-1] > first:
        yield table.slice(first, cuts[-1] - first), False


_SHARED = "key long, node long, group long, spot long"


def shared_shingles(texts: DataFrame, grouped: DataFrame, count: int, *, words: int, similarity: float) -> DataFrame:
    """Rows `key, node, group, spot` of `texts(mark, text)` (node is the mark, spot its size and the place of the shingle): the rarest
    shingles of each text, but for those that no two texts have, or only texts of one group in `grouped(mark, group)`.

    Texts with a Jaccard similarity of `similarity` or more that are not of one group have a row of the same key each. Most shingles are of one text,
    so few rows are left. A key with very many rows passes its task a batch at a time.
    """
    common = _common_shingles(texts, count, words)
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(part.column("text"), words)
                hashes, doc, at, size, _ = rare_shingles(*sets, *shared.value, similarity)
                mark, group = (part.column(c).to_numpy()[doc] for c in ("mark", "group"))
                rows = [pa.array(hashes.view(np.int64)), pa.array(mark), pa.array(group), pa.array((size << 32) | at)]
                yield pa.record_batch(rows, ["key", "node", "group", "spot"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, large in _groups_below(batches, "key", HOT):
            if not large:
                key, node, group = (table.column(c).to_numpy() for c in ("key", "node", "group"))
                cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                ends = np.append(cuts, len(key))[1:] - 1
                several = np.minimum.reduceat(node, cuts) != np.maximum.reduceat(node, cuts)
                low, high = np.minimum.reduceat(group, cuts), np.maximum.reduceat(group, cuts)
                several &= (low != high) | (low < 0)
                table = table.filter(pa.array(np.repeat(several, ends - cuts + 1)))
            yield from table.to_batches()

    named = texts.join(_few(grouped.withColumnRenamed("mark", "_mark")), F.col("mark") == F.col("_mark"), "left")
    named = named.select("mark", F.coalesce("group", F.lit(-1)).cast("long").alias("group"), "text")
    rows = named.mapInArrow(place, _SHARED)
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(keep, _SHARED)


PARITIES = 1_024  # bits of the short parity sketches that travel with every shared shingle
WIDEST = 1 << 20  # bound on the bits of a wide one


def parity_sketch(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One row of bytes per set: bit k tells whether the set has an odd number of hashes with remainder k.

    Two sets that differ in d members differ in at most d bits, so the bits say how many members two sets can share at most.
    """
    size = np.diff(cuts)
    spot = np.repeat(np.arange(len(size)), size) * PARITIES + (hashes % np.uint64(PARITIES)).astype(np.int64)
    odd = np.bincount(spot, minlength=len(size) * PARITIES).reshape(len(size), PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def wide_sketch(hashes: np.ndarray) -> bytes:
    """A parity sketch of one set with about a bit for each member: a power of two from PARITIES to WIDEST."""
    bits = min(WIDEST, max(PARITIES, 1 << int(len(hashes)).bit_length()))
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the wider one is folded, as remainders fold."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _shingled(texts: DataFrame, marks: DataFrame, words: int, form: str) -> DataFrame:
    """`mark, size, shingles` of the texts with these marks, one row each; the shingles as bytes (form `whole`), or their parity sketch
    (`short`, `wide`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                for rows in (part.slice(k, 512) for k in range(0, part.num_rows, 512)):
                    hashes, cuts = shingle_sets(rows.column("text"), words)
                    if form == "short":
                        values = [x.tobytes() for x in parity_sketch(hashes, cuts)]
                    else:
                        as_bytes = wide_sketch if form == "wide" else np.ndarray.tobytes
                        values = [as_bytes(hashes[a:b]) for a, b in itertools.pairwise(cuts)]
                    columns = [rows.column("mark"), pa.array(np.diff(cuts)), pa.array(values, pa.binary())]
                    yield pa.record_batch(columns, ["mark", "size", "shingles"])

    chosen = texts.join(_few(marks.toDF("_mark")), F.col("mark") == F.col("_mark"), "left_semi").select("mark", "text")
    return chosen.mapInArrow(run, "mark long, size long, shingles binary").dropDuplicates(["mark"])


def _with_both(pairs: DataFrame, texts: DataFrame, words: int, form: str) -> DataFrame:
    """Pairs `a, b` with the sizes and shingles of either side, in a form of `_shingled`."""
    ends = stored(pairs.select(F.col("a").alias("mark")).union(pairs.select("b")).distinct(), "ends")
    sets = stored(_shingled(texts, ends, words, form), f"{form}-sets")
    left = sets.select(F.col("mark").alias("a"), F.col("size").alias("left_size"), F.col("shingles").alias("left"))
    right = sets.select(F.col("mark").alias("b"), F.col("size").alias("right_size"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left_size", "right_size", "left", "right")


def pairs_by_sketches(rows: DataFrame, sketches: DataFrame, *, similarity: float, forest: bool) -> DataFrame:
    """Pairs `a, b` of nodes that share a key in `rows` (`shared_shingles`), are not of one group, and may have a similarity of `similarity` by
    sizes, places and parity sketches (`mark, shingles`).

    With `forest` a task leaves out pairs that the pairs it has given connect already, so a dense group gives about as many pairs as it has
    members. A key of more than HOT rows meets in chunks, pair by pair, in tasks of their own.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "key"):
            key, node, group, spot = (table.column(c).to_numpy() for c in ("key", "node", "group", "spot"))
            names, first, local = np.unique(node, return_index=True, return_inverse=True)
            size = (spot >> 32)[first]
            sketch = np.frombuffer(b"".join(table.column("shingles").take(pa.array(first)).to_pylist()), np.uint8).reshape(len(names), -1)
            connected = Forest(len(names))
            own = group[first]
            _, chief, member = np.unique(np.where(own >= 0, own, -1 - np.arange(len(own))), return_index=True, return_inverse=True)
            connected.root = chief[member]  # members of a group are linked already
            out = []
            for a, b in pairs_sharing(key, local, group, spot & 0xFFFFFFFF, spot >> 32, similarity):
                if forest:
                    new = connected.apart(a, b)
                    a, b = a[new], b[new]
                if not len(a):
                    continue
                ends = np.unique(np.stack([a, b], axis=1), axis=0)
                a, b = ends[:, 0], ends[:, 1]
                differ = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64)
                both = size[a] + size[b]
                shared = (both - differ) / 2  # at most
                near = shared >= similarity * (both - shared) - 1e-9
                if forest:
                    connected.join(a[near], b[near])
                else:
                    out.append((a[near], b[near]))
            if forest:
                out = list(zip(connected.left, connected.right, strict=True))
            for a, b in out:
                yield pa.record_batch([pa.array(np.minimum(names[a], names[b])), pa.array(np.maximum(names[a], names[b]))], ["a", "b"])

    sizes = stored(rows.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("chunks")).where("chunks > 1"), "hot-shingles")
    if not sizes.isEmpty():
        chunks = F.coalesce("chunks", F.lit(1))
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")
        dealt = rows.join(_few(sizes), "key", "left").withColumn("chunks", chunks).select("*", chunk)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        both = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
        rows = dealt.select(F.when(F.col("chunks") == 1, F.col("key")).otherwise(both).alias("key"), "node", "group", "spot")
    met = rows.join(sketches, F.col("node") == F.col("mark")).select("key", "node", "group", "spot", "shingles")
    return met.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(pair, "a long, b long").distinct()


def verified_pairs(texts: DataFrame, pairs: DataFrame, *, words: int, similarity: float) -> DataFrame:
    """The pairs `a, b` of marks whose texts have a Jaccard similarity of `similarity` or more.

    Wide sketches, which are a sixty-fourth of the shingles, travel with the pairs first; the shingles follow for pairs that these leave.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = [differing_bits(x, y) for x, y in zip(*(batch.column(c).to_pylist() for c in ("left", "right")), strict=True)]
            both = batch.column("left_size").to_numpy() + batch.column("right_size").to_numpy()
            shared = (both - np.array(differ, np.int64)) / 2  # at most
            keep = pa.array(shared >= similarity * (both - shared) - 1e-9)
            yield pa.record_batch([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("left", "right"))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64) - both
            keep = pa.array(both >= similarity * union - 1e-9)
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    left = stored(_with_both(pairs, texts, words, "wide").mapInArrow(near, "a long, b long"), "near-pairs")
    return _with_both(left, texts, words, "whole").mapInArrow(check, "a long, b long")


def similar_documents(
    docs: DataFrame, *, words: int = 5, similarity: float = 0.8, bits: int = 256, budget: int = 46, parts: int = 20
) -> DataFrame:
    """`doc_id, mark, component_id` for documents linked with another: components of texts whose sets of word shingles have
    a Jaccard similarity of `similarity` or more.

    Fingerprints wide enough to tell similarities apart propose most of what is alike: 46 of 256 bits differ at a similarity of 0.77 on
    average. Inside each component of those, similarity is computed exactly, between chunks of texts; a task gives a spanning forest of the
    links it finds. Fingerprints miss some pairs, most of them short texts; so all texts are then joined on their rarest shingles, of which alike
    texts share one, and pairs that are not linked yet are computed exactly too. `mark` is a hash of the text; component_id is the least
    doc_id that links reach, null when none has one. Texts without words are alike to none. Only the result is kept in the shared folder.
    """
    path = work_path(docs.sparkSession, "similar")
    with scratch(docs.sparkSession):
        return _similar(docs, path, words=words, similarity=similarity, bits=bits, budget=budget, parts=parts)


def _similar(docs: DataFrame, path: str, *, words: int, similarity: float, bits: int, budget: int, parts: int) -> DataFrame:
    """`similar_documents`, stored under a path."""
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark, F.col("text").cast("string").alias("text"))
    coded, named = _linked_classes(texts, words=words, bits=bits, budget=budget, parts=parts, once=True)
    loose = coded.join(named, "code").select("doc_id", "mark", F.col("component").alias("group")).distinct()
    loose = stored(loose.withColumn("node", F.monotonically_increasing_id()), "loose")
    many = loose.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(loose.join(many, "group"), "members")
    pick = members.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "group", "n", "node")
    chosen = texts.join(_few(pick), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                hashes, cuts = shingle_sets(part.column("text"), words)
                sets = [hashes[a:b].tobytes() for a, b in itertools.pairwise(cuts)]
                columns = [part.column(c) for c in ("group", "n", "node")]
                yield pa.record_batch([*columns, pa.array(sets, pa.binary())], ["group", "n", "node", "shingles"])

    sets = chosen.select("group", "n", "node", "text").mapInArrow(shingled, "group long, n long, node long, shingles binary")
    sets = stored(sets.dropDuplicates(["node"]), "shingle-sets")
    chunked = sets.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    low, high = F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")
    pairs = chunked.withColumn("other", other).select("group", low, high, "chunk", "node", "shingles")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (_, low, high), group in itertools.groupby(rows, key=lambda r: r[:3]):
            found = sorted(group, key=lambda r: r[3])
            sets = [np.frombuffer(r[5], np.uint64) for r in found]
            node = np.array([r[4] for r in found])
            split = None if low == high else sum(r[3] == low for r in found)
            forest = Forest(len(sets))
            forest.join(*alike(sets, similarity, split))
            ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (forest.left, forest.right)]
            yield pa.record_batch([pa.array(node[x], pa.int64()) for x in ends], ["a", "b"])

    keys = ["group", "low", "high"]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(partitions, *keys).sortWithinPartitions(*keys)
    reached = components(dealt.mapInArrow(verified, "a long, b long"))

    links = reached.toDF("a", "b")
    one = loose.groupBy("mark").agg(F.min("node").alias("node"))
    marked = texts.select("mark", "text")
    limits = {"words": words, "similarity": similarity}

    def groups(reached: DataFrame) -> DataFrame:
        return stored(loose.join(reached, "node").groupBy("mark").agg(F.min("component").alias("group")), "groups")

    rows = stored(shared_shingles(marked, groups(reached), loose.count(), **limits), "shared-shingles")
    if not rows.isEmpty():
        sketches = stored(_shingled(marked, rows.select("node").distinct(), words, "short"), "sketches")
        # first what connects each task's rows, which unites dense groups; then every pair that is still apart
        for forest in (True, False):
            pairs = stored(pairs_by_sketches(rows, sketches, similarity=similarity, forest=forest), "pairs")
            if pairs.isEmpty():
                break  # of no pairs the first pass leaves the second none either
            found = stored(verified_pairs(marked, pairs, **limits), "more-links")
            if found.isEmpty():
                continue
            ends = found.join(one.toDF("a", "left"), "a").join(one.toDF("b", "right"), "b").select("left", "right").toDF("a", "b")
            links = links.union(ends)
            reached = components(links)
            if forest:
                now = groups(reached).toDF("_mark", "_group")
                known = rows.join(_few(now), F.col("node") == F.col("_mark"), "left")
                rows = known.select("key", "node", F.coalesce("_group", F.lit(-1)).cast("long").alias("group"), "spot")
    named = loose.select("doc_id", "mark", "node").join(reached, "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return stored(named.join(least, "component").select("doc_id", "mark", "component_id"), "similar", path)


def without_near_duplicates(docs: DataFrame, *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each component of similar documents the least doc_id.

    Rows of one text and id stay or go together. A row without an id stays unless it is linked to one with an id.
    """
    found = similar_documents(docs, words=words, similarity=similarity)
    gone = found.where("component_id IS NOT NULL AND (doc_id IS NULL OR doc_id != component_id)")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), mark.alias("mark"), F.struct("*").alias("doc"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    return rows.join(_few(gone), same, "left_anti").select("doc.*")
