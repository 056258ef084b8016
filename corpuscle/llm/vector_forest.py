"""Nearest vectors by a forest of random-projection trees with one priority queue.

Each tree halves the vectors again and again by random directions; directions and thresholds are fitted on a bounded sample, all vectors
are placed. Inner products become distances by one more coordinate (what a vector lacks of the greatest norm). A query
ranks the leaves of all trees together, by how far it is from them along the directions above them, and takes the first `probes`. How many that
are is measured: true neighbours of a few queries, found by brute force over all rows, must be in the leaves taken. Leaves
that lie together form a shard of bounded size; a query goes to each shard with its list of leaves, and candidates are computed exactly.
Where the probes would read as much as one whole tree has, all leaves of one tree are taken and the search is exact.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.topk import BestRows
from corpuscle.sources.tables import stored

SAMPLE = 65_536  # vectors, about, that directions and thresholds are fitted on (twice as many at most)
TREES = 2
LEAF = 512  # vectors of a leaf, while the sample has at least eight for each leaf
SHARD = 16_384  # vectors that a task holds at a time
MEASURED = 64  # queries, about, whose true neighbours tell how many leaves are needed
RECALL = 0.95  # part of true neighbours that the leaves taken must hold
CELLS = 1 << 22  # scores or leaf costs computed at a time
SPARE = 4  # rows kept beyond the wanted ones until scores are added in one order


@dataclass
class Forest:
    """Random directions and thresholds of complete binary trees, level by level."""

    directions: np.ndarray  # tree, inner node, coordinate
    thresholds: np.ndarray  # tree, inner node
    depth: int
    longest: float  # greatest norm of all vectors

    @classmethod
    def of(cls, sample: np.ndarray, longest: float, *, trees: int, depth: int, seed: int = 5) -> "Forest":
        """Trees whose nodes halve the sample."""
        rng = np.random.default_rng(seed)
        points = lifted(sample, longest)
        inner = (1 << depth) - 1
        directions = rng.normal(size=(trees, inner, points.shape[1]))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        thresholds = np.zeros((trees, inner))
        for tree in range(trees):
            node = np.zeros(len(points), np.int64)
            for _ in range(depth):
                along = np.einsum("ij,ij->i", points, directions[tree, node])
                order = np.lexsort([along, node])
                names, first, count = np.unique(node[order], return_index=True, return_counts=True)
                low, high = along[order][first + (count - 1) // 2], along[order][first + count // 2]
                thresholds[tree, names] = (low + high) / 2
                node = 2 * node + 1 + (along > thresholds[tree, node])
        return cls(directions, thresholds, depth, longest)

    @property
    def leaves(self) -> int:
        """Leaves of one tree."""
        return 1 << self.depth

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Row by tree: the leaf of each vector, numbered through all trees."""
        points = lifted(vectors, self.longest)
        out = np.zeros((len(points), len(self.directions)), np.int32)
        for tree in range(len(self.directions)):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", points, self.directions[tree, node])
                node = 2 * node + 1 + (along > self.thresholds[tree, node])
            out[:, tree] = node - (self.leaves - 1) + tree * self.leaves
        return out

    def costs(self, queries: np.ndarray) -> np.ndarray:
        """Query by leaf of all trees: squared distances to the far sides of the directions above each leaf, added up."""
        points = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        out = []
        for tree in range(len(self.directions)):
            cost = np.zeros((len(points), 1))
            for level in range(self.depth):
                nodes = slice((1 << level) - 1, (2 << level) - 1)
                over = points @ self.directions[tree, nodes].T - self.thresholds[tree, nodes]
                sides = np.stack([np.maximum(over, 0) ** 2, np.minimum(over, 0) ** 2], axis=2)
                cost = (cost[:, :, None] + sides).reshape(len(points), -1)
            out.append(cost)
        return np.concatenate(out, axis=1)

    def first_leaves(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """Query by place: the leaves that the shared queue gives first, nearest first."""
        cost = self.costs(queries)
        return np.argsort(cost, axis=1, kind="stable")[:, :probes].astype(np.int32)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the norm `longest`."""
    lack = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.concatenate([vectors, lack[:, None]], axis=1)


@dataclass
class Shards:
    """Which shards hold each leaf: `first` and the next ones, more than one where a leaf is larger than a shard."""

    first: np.ndarray
    chunks: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, leaves: int) -> "Shards":
        """Neighbouring leaves of one tree together as long as their vectors fit in a shard."""
        first, chunks = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // SHARD))
        shard, held = -1, SHARD
        for leaf, n in enumerate(counts.tolist()):
            if leaf % leaves == 0 or held + n > SHARD:
                shard, held = shard + 1, 0
            first[leaf] = shard
            held += n
            shard += int(chunks[leaf]) - 1
        return cls(first, chunks)


# ── Tables ────────────────────────────────────────────────────────────────────


def _matrix(column: pa.Array | pa.ChunkedArray, size: int, kind: str) -> np.ndarray:
    """Vectors kept as bytes, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size).astype(np.float64)


def _as_bytes(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """`vec_id, asked, vector`: vectors as bytes, so that equal ones are equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.asarray(batch.column("embedding").flatten(), kind).reshape(-1, size) + np.zeros(1, kind)  # no minus zero
            data = pa.py_buffer(np.ascontiguousarray(numbers))
            vectors = pa.Array.from_buffers(pa.binary(size * numbers.itemsize), len(numbers), [None, data]).cast(pa.binary())
            yield pa.record_batch([batch.column("vec_id"), batch.column("asked"), vectors], ["vec_id", "asked", "vector"])

    return rows.select("vec_id", "asked", "embedding").mapInArrow(run, "vec_id long, asked boolean, vector binary")


def nearest_vectors(
    vectors: DataFrame,
    asked: Column,
    *,
    k: int = 20,
    trees: int = TREES,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    recall: float = RECALL,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: for each row of `vectors(vec_id, embedding)` where `asked` holds, the `k` rows with the
    greatest inner products that the forest finds, ties to the smaller id; the row itself is left out.

    Rows without id, and vectors that are null, empty, zero or hold null or non-finite parts, take no part. A query meets vectors of its
    own length. A repeated row is a row each time, so an id may come back more than once, and a repeated query has a list
    for each of its rows. Fewer than `k` other rows give all of them. `asked` may use all columns of `vectors`; the others are
    not returned.
    """
    spark = vectors.sparkSession
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, number = ("<f4", "float") if narrow else ("<f8", "double")
    embedding = F.transform(F.col("embedding"), lambda x: x.cast(number)).alias("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(asked, F.lit(False)).alias("asked"), embedding)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & some)
    found = None
    widths = rows.groupBy(F.size("embedding").alias("d")).agg(F.max(F.col("asked")).alias("any")).where("any").orderBy("d")
    for width in widths.toLocalIterator():
        one = rows.where(F.size("embedding") == width.d)
        part = _search(one, width.d, kind, k=k, trees=trees, leaf=leaf, sample=sample, recall=recall)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """`digest, vector, least, ids`: each distinct vector with its `k + 1` smallest ids; no list shows more."""
    named = rows.withColumn("digest", F.unhex(F.md5("vector")))
    order = Window.partitionBy("digest").orderBy("vec_id")
    first = named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    grouped = first.groupBy("digest").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return grouped.select("digest", "vector", F.col("ids")[0].alias("least"), "ids")


def _search(rows: DataFrame, size: int, kind: str, *, k: int, trees: int, leaf: int, sample: int, recall: float) -> DataFrame:
    """Lists of the queries among vectors of one length."""
    spark = rows.sparkSession
    coded = _as_bytes(rows, size, kind)
    classes = stored(_classes(coded, k), "vector-classes")
    queries = coded.where("asked").select(F.col("vec_id").alias("query_id"), F.unhex(F.md5("vector")).alias("q"), "vector")
    queries = stored(queries, "vector-queries")
    wanted = queries.select("q", "vector").dropDuplicates(["q"])

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                most = np.linalg.norm(_matrix(batch.column(0), size, kind), axis=1).max()
                yield pa.record_batch([pa.array([batch.num_rows]), pa.array([most])], ["n", "norm"])

    total = classes.select("vector").mapInArrow(norms, "n long, norm double").agg(F.sum("n"), F.max("norm")).first()
    step = max(1, total[0] // sample)
    drawn = classes.where(F.pmod(F.xxhash64("digest"), F.lit(step)) == 0).select("vector")
    known = _matrix(drawn.toArrow().sort_by("vector").column("vector"), size, kind)
    depth = max(0, int(np.ceil(np.log2(min(total[0] / leaf, max(1, len(known) / 8))))))
    forest = Forest.of(known, total[1], trees=trees, depth=depth)
    probes = _probes(classes, wanted, forest, size, kind, k, recall)
    if probes >= forest.leaves:  # one tree holds all rows once
        forest, probes = Forest(forest.directions[:1], forest.thresholds[:1], depth, total[1]), forest.leaves
    lists = _scored(classes, wanted, forest, probes, size, kind, k)

    best = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    lists = lists.groupBy("q", "digest").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    lists = lists.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n", "least")
    spots = classes.select("digest", "ids", F.posexplode("ids").alias("spot", "vec_id"))
    first = (F.array_position("ids", F.col("vec_id")) == F.col("spot") + 1).alias("first")
    each = lists.join(spots.select("digest", "vec_id", first), "digest")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    asked = queries.groupBy("query_id", "q").agg(F.count("*").cast("int").alias("times"))
    itself = (F.col("q") == F.col("digest")) & (F.col("vec_id") == F.col("query_id")) & F.col("first")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    ranked = asked.join(each, "q").where(~itself).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked = ranked.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return ranked.select("query_id", "rank", "vec_id", "score")


def _probes(classes: DataFrame, wanted: DataFrame, forest: Forest, size: int, kind: str, k: int, recall: float) -> int:
    """How many leaves hold the part `recall` of the true neighbours of some queries, which are found by brute force over all rows."""
    if forest.depth == 0:
        return 1
    step = max(1, wanted.count() // MEASURED)
    drawn = wanted.where(F.pmod(F.xxhash64("q", F.lit(3)), F.lit(step)) == 0).toArrow().sort_by("q")
    if not drawn.num_rows:
        return forest.leaves
    points = _matrix(drawn.column("vector"), size, kind)
    names = np.array(drawn.column("q").to_pylist(), object)
    shared = classes.sparkSession.sparkContext.broadcast((forest, points, names))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, points, names = shared.value
        best = BestRows(k)
        for batch in batches:
            for first in range(0, batch.num_rows, 4_096):
                part = batch.slice(first, 4_096)
                matrix = _matrix(part.column("vector"), size, kind)
                scores = points @ matrix.T
                scores[names[:, None] == np.array(part.column("digest").to_pylist(), object)[None]] = -np.inf
                leaves = forest.place(matrix)
                rows = np.empty(len(leaves), object)
                rows[:] = list(leaves)
                best.add_scores(np.arange(len(points)), scores, part.column("least").to_numpy(), rows)
        question, _, score, note = best.best()
        columns = [pa.array(question, pa.int64()), pa.array(score, pa.float64()), pa.array(note.tolist(), pa.list_(pa.int32()))]
        yield pa.record_batch(columns, ["query", "score", "leaves"])

    found = classes.select("digest", "vector", "least").mapInArrow(scan, "query long, score double, leaves array<int>")
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("query", "leaves").toArrow()
    if not found.num_rows:
        return 1
    turn = np.argsort(np.argsort(forest.costs(points), axis=1, kind="stable"), axis=1)
    at = np.stack(found.column("leaves").to_numpy(zero_copy_only=False))
    places = np.sort(turn[found.column("query").to_numpy()[:, None], at].min(axis=1))
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1


_ROW = "shard long, kind int, leaf int, digest binary, least long, vector binary, leaves array<int>"
_NAMES = ["shard", "kind", "leaf", "digest", "least", "vector", "leaves"]


def _scored(
    classes: DataFrame, wanted: DataFrame, forest: Forest, probes: int, size: int, kind: str, k: int
) -> DataFrame:
    """`q, digest, least, score`: the best candidates of each query in each shard that it visits."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(forest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4_096):
                part = _matrix(batch.column(0).slice(first, 4_096), size, kind)
                leaf, n = np.unique(shared.value.place(part), return_counts=True)
                yield pa.record_batch([pa.array(leaf, pa.int32()), pa.array(n, pa.int64())], ["leaf", "n"])

    sizes = classes.select("vector").mapInArrow(count, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(forest.leaves * len(forest.directions), np.int64)
    counts[sizes.column("leaf").to_numpy()] = sizes.column("n").to_numpy()
    dealt = spark.sparkContext.broadcast(Shards.of(counts, forest.leaves))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = dealt.value
        for batch in batches:
            for first in range(0, batch.num_rows, 4_096):
                part = batch.slice(first, 4_096)
                leaves = shared.value.place(_matrix(part.column("vector"), size, kind))
                spread = part.column("spread").to_numpy()
                for leaf in leaves.T:
                    shard = shards.first[leaf] + spread % shards.chunks[leaf]
                    none = pa.nulls(len(leaf), pa.list_(pa.int32()))
                    kinds = pa.array(np.zeros(len(leaf)), pa.int32())
                    columns = [pa.array(shard), kinds, pa.array(leaf), *(part.column(c) for c in ("digest", "least", "vector")), none]
                    yield pa.record_batch(columns, _NAMES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, shards = shared.value, dealt.value
        slice_rows = max(1, CELLS // len(shards.first))
        for batch in batches:
            for first in range(0, batch.num_rows, slice_rows):
                part = batch.slice(first, slice_rows)
                leaves = forest.first_leaves(_matrix(part.column("vector"), size, kind), probes)
                query = np.repeat(np.arange(len(leaves)), leaves.shape[1])
                leaf = leaves.ravel()
                many = shards.chunks[leaf]
                again = np.repeat(np.arange(len(leaf)), many)
                shard = shards.first[leaf][again] + np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
                query, leaf = query[again], leaf[again]
                order = np.lexsort([leaf, shard, query])
                query, leaf, shard = query[order], leaf[order], shard[order]
                cuts = np.flatnonzero(np.concatenate([[True], (query[1:] != query[:-1]) | (shard[1:] != shard[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(leaf)), pa.int32()), pa.array(leaf, pa.int32()))
                for k0 in range(0, len(cuts), 4_096):
                    some = slice(k0, k0 + 4_096)
                    rows = part.take(pa.array(query[cuts[some]]))
                    ones = pa.array(np.ones(rows.num_rows), pa.int32())
                    none = pa.nulls(rows.num_rows, pa.int64())
                    columns = [pa.array(shard[cuts[some]]), ones, ones, rows.column("q"), none, rows.column("vector"), lists[some]]
                    yield pa.record_batch(columns, _NAMES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = ready = None
        for batch in batches:
            keys = np.stack([batch.column("shard").to_numpy(), batch.column("kind").to_numpy()], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]])) if len(keys) else [0]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.slice(first, last - first)
                if keys[first, 0] != shard:
                    shard, held, ready = keys[first, 0], [], None
                if keys[first, 1] == 0:
                    held.append(rows)
                elif held:
                    ready = ready or _Held.of(held, size, kind)
                    yield from ready.answer(rows, k)

    index = classes.select("digest", "least", "vector", F.pmod(F.xxhash64("digest"), F.lit(1 << 20)).alias("spread"))
    both = index.mapInArrow(place, _ROW).union(wanted.select("q", "vector").mapInArrow(ask, _ROW))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = both.repartition(partitions, "shard").sortWithinPartitions("shard", "kind", "leaf")
    return sorted_rows.mapInArrow(score, "q binary, digest binary, least long, score double")


class _Held:
    """The vectors of one shard, by leaf."""

    def __init__(self, rows: pa.Table, size: int, kind: str) -> None:
        self.size, self.kind = size, kind
        self.vectors = _matrix(rows.column("vector"), size, kind)
        self.least = rows.column("least").to_numpy()
        self.digest = rows.column("digest").combine_chunks()
        leaf = rows.column("leaf").to_numpy()
        self.names, first = np.unique(leaf, return_index=True)
        self.cuts = np.append(first, len(leaf))

    @classmethod
    def of(cls, held: list[pa.RecordBatch], size: int, kind: str) -> "_Held":
        return cls(pa.Table.from_batches(held), size, kind)

    def answer(self, rows: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        """The best candidates of each query in the leaves that it lists."""
        step = max(1, CELLS // len(self.vectors))
        for first in range(0, rows.num_rows, step):
            part = rows.slice(first, step)
            points = _matrix(part.column("vector"), self.size, self.kind)
            lists = part.column("leaves")
            query = np.repeat(np.arange(len(points)), lists.value_lengths().to_numpy())
            leaf = lists.flatten().to_numpy()
            scores = np.full((len(points), len(self.vectors)), -np.inf)
            for name, a, b in zip(self.names, self.cuts[:-1], self.cuts[1:], strict=True):
                asks = query[leaf == name]
                scores[asks, a:b] = points[asks] @ self.vectors[a:b].T
            best = BestRows(k + 1 + SPARE)
            best.add_scores(np.arange(len(points)), scores, self.least, np.arange(len(self.vectors)))
            question, least, _, note = best.best()
            note = note.astype(np.int64)
            exact = np.cumsum(points[question] * self.vectors[note], axis=1)[:, -1]  # added up in order, whatever the machine
            columns = [part.column("digest").take(pa.array(question)), self.digest.take(pa.array(note)), pa.array(least), pa.array(exact)]
            yield pa.record_batch(columns, ["q", "digest", "least", "score"])
