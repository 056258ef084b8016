"""Vector search: exact nearest chunks, and an approximate search over an index of cells."""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.topk import TILE_CELLS, BestRows, question_blocks
from corpuscle.sources.tables import read_table, stored, write_partitioned

VECTOR_LIMIT = 20  # fixed value: vector hits per query
QUESTIONS = 4_000  # query vectors that go to the tasks at a time
PROBING = 2_000  # query vectors with their lists of cells that go to the tasks at a time
SAMPLE = 16_384  # vectors, about, that cells are fitted on (twice as many at most)
DIGITS = 9  # scores are compared after rounding, so the order of a sum never decides a rank


def first_chunks(chunks: DataFrame, k: int) -> DataFrame:
    """The first `k` chunks of each content hash: no search for `k` hits can show more copies."""
    copies = Window.partitionBy("snapshot_id", "content_hash").orderBy("chunk_id")
    return (
        chunks.select("snapshot_id", "content_hash", "chunk_id")
        .withColumn("n", F.row_number().over(copies))
        .filter(F.col("n") <= k)
    )


def hash_vectors(first: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """One vector per snapshot and hash, with its lowest chunk; copies are scored once."""
    vectors = embeddings.filter(F.col("model") == model).select("content_hash", "embedding")
    return first.filter("n = 1").drop("n").join(vectors, "content_hash")


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as unit rows of a float64 matrix (a zero vector stays zero)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0.0, 1.0, norms)


_SCORES = "query_id bigint, snapshot_id bigint, content_hash string, chunk_id bigint, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best `k` hashes of each query among the vectors that each task reads.

    Queries (query_id, snapshot_id, embedding, and cell when the vectors have one) go to the vectors in blocks of bounded size; the
    vectors stay where they are. A query meets the vectors of its snapshot and cell.
    """
    context = vectors.sparkSession.sparkContext
    found = None
    for block in question_blocks(queries, QUESTIONS):
        shared = context.broadcast(
            (
                _matrix(block.column("embedding").combine_chunks()),
                block.column("query_id").to_numpy(),
                block.column("snapshot_id").to_numpy(),
                block.column("cell").to_numpy(),
            )
        )
        part = vectors.mapInArrow(partial(_score, shared, k), _SCORES)
        found = part if found is None else found.unionByName(part)
    return vectors.sparkSession.createDataFrame([], _SCORES) if found is None else found


def _score(shared, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Score the vectors of a task against a block of queries."""
    wanted, query_ids, snapshots, cells = shared.value
    best: dict[int, BestRows] = {}
    for rows in batches:
        if not rows.num_rows:
            continue
        matrix = _matrix(rows.column("embedding"))
        own, cell = rows.column("snapshot_id").to_numpy(), rows.column("cell").to_numpy()
        chunk_ids = rows.column("chunk_id").to_numpy()
        hashes = rows.column("content_hash").to_numpy(zero_copy_only=False)
        for snapshot, at_cell in np.unique(np.stack([own, cell], 1), axis=0).tolist():
            asked = np.flatnonzero((snapshots == snapshot) & (cells == at_cell))
            if not len(asked):
                continue
            mine = np.flatnonzero((own == snapshot) & (cell == at_cell))
            step = max(1, TILE_CELLS // len(asked))
            for first in range(0, len(mine), step):
                some = mine[first : first + step]
                scores = np.round(wanted[asked] @ matrix[some].T, DIGITS)
                best.setdefault(snapshot, BestRows(k)).add_scores(query_ids[asked], scores, chunk_ids[some], hashes[some])
    yield from _kept(best)


def _kept(best: dict[int, BestRows]) -> Iterator[pa.RecordBatch]:
    """The rows kept for each snapshot."""
    for snapshot, kept in best.items():
        query_id, chunk_id, score, content_hash = kept.best()
        columns = [
            pa.array(query_id, pa.int64()),
            pa.array([snapshot] * len(query_id), pa.int64()),
            pa.array(content_hash.tolist(), pa.string()),
            pa.array(chunk_id, pa.int64()),
            pa.array(score, pa.float64()),
        ]
        yield pa.record_batch(columns, ["query_id", "snapshot_id", "content_hash", "chunk_id", "score"])


def chunk_hits(scores: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Scored hashes as the best `k` chunks per query, copies included, ties by chunk id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    hashes = (
        scores.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")
    )
    return (
        hashes.drop("chunk_id")
        .join(first.drop("n"), ["snapshot_id", "content_hash"])
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.lit("vector").alias("leg"), "rank", "chunk_id", "score")
    )


def _asked_chunks(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """The chunks of snapshots that a query asks; they stay where they are, so no task gets a whole snapshot."""
    return chunks.join(F.broadcast(queries.select("snapshot_id").distinct()), "snapshot_id", "left_semi")


def vector_topk(
    queries: DataFrame,
    chunks: DataFrame,
    embeddings: DataFrame,
    model: str,
    *,
    k: int = VECTOR_LIMIT,
) -> DataFrame:
    """The `k` chunks of its snapshot nearest each query vector (query_id, snapshot_id,
    embedding), by cosine; exact."""
    first = first_chunks(_asked_chunks(chunks, queries), k)
    one_cell = F.lit(0).cast("int").alias("cell")
    vectors = hash_vectors(first, embeddings, model).select("*", one_cell)
    scores = nearest(vectors, queries.select("query_id", "snapshot_id", "embedding", one_cell), k)
    return chunk_hits(scores, first, k)


@dataclass(frozen=True)
class VectorIndex:
    """Unit vectors of chunks by cell, the cells' centres, and what each snapshot has in each cell."""

    vectors: DataFrame  # snapshot_id, content_hash, chunk_id, embedding, cell
    reach: DataFrame  # snapshot_id, cell, n, angles: how far from the centre its vectors lie, at TAILS of them
    centres: np.ndarray


CELLS = 1_024  # bound on cells
TAILS = (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)  # parts of a cell's vectors whose greatest angle to its centre is kept
TAIL = 0.9  # the part that a search takes as all of a cell


def cell_centres(sample: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of a sample of unit vectors: spread-out rows, moved to the middle of what is nearest to them."""
    centres = sample[np.unique(np.linspace(0, len(sample) - 1, count).astype(np.int64))].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[k : k + 4096] @ centres.T).argmax(1) for k in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


_PLACED = "snapshot_id bigint, content_hash string, chunk_id bigint, embedding array<float>, cell int, angle double"


def index_vectors(vectors: DataFrame, path: str) -> VectorIndex:
    """Place vectors (snapshot_id, content_hash, chunk_id, embedding) in cells and store them under `path`, by cell.

    As many cells as the root of the number of vectors, CELLS at most; their centres are fitted on about SAMPLE vectors, every vector is
    placed. Angles to the centre are kept for each snapshot and cell, so a search can tell what a cell may hold before it reads any.
    """
    spark = vectors.sparkSession
    rows = vectors.select("snapshot_id", "content_hash", "chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
    count = rows.count()
    step = max(1, count // SAMPLE)
    drawn = rows.where(F.pmod(F.xxhash64("content_hash"), F.lit(step)) == 0).select("embedding", "content_hash")
    sample = drawn.toArrow().sort_by("content_hash").column("embedding").combine_chunks()
    centres = cell_centres(_matrix(sample), max(1, min(CELLS, int(count**0.5)))) if len(sample) else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            along = _matrix(batch.column("embedding")) @ shared.value.T
            cell = along.argmax(1)
            angle = np.arccos(np.clip(along[np.arange(len(cell)), cell], -1, 1))
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    write_partitioned(rows.mapInArrow(place, _PLACED), f"{path}/vectors", "cell")
    placed = spark.read.schema(_PLACED).parquet(f"{path}/vectors")
    angles = F.concat(F.percentile_approx("angle", list(TAILS[:-1]), 1_000), F.array(F.max("angle"))).alias("angles")
    reach = placed.groupBy("snapshot_id", "cell").agg(F.count("*").alias("n"), angles)
    reach.write.mode("overwrite").parquet(f"{path}/reach")
    spark.createDataFrame([(c.tolist(),) for c in centres], "centre array<double>").withColumn(
        "cell", F.monotonically_increasing_id()
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return open_vectors(spark, path)


def open_vectors(spark, path: str) -> VectorIndex:
    """The index that `index_vectors` stored under a path."""
    centres = read_table(spark, f"{path}/centres").orderBy("cell").select("centre").toArrow().column("centre").to_pylist()
    vectors = spark.read.schema(_PLACED).parquet(f"{path}/vectors").drop("angle")
    reach = read_table(spark, f"{path}/reach")
    return VectorIndex(vectors, reach, np.array(centres))


_PROBES = "query_id bigint, snapshot_id bigint, embedding array<float>, cells array<int>, bounds array<double>, firsts int"


def probe_order(queries: DataFrame, index: VectorIndex, *, k: int = VECTOR_LIMIT, tail: float = TAIL) -> DataFrame:
    """The cells of its snapshot that each query could visit, best bound first: `query_id, snapshot_id, embedding, cells, bounds, firsts`.

    A bound is the cosine that a vector of the cell can have at most: that of the angle to the centre less the angle within which the part `tail` of
    the snapshot's vectors in the cell lie (1.0: all of them, so that no hit can be missed). The first `firsts` cells hold `k` vectors of
    the snapshot, or all it has.
    """
    shared = queries.sparkSession.sparkContext.broadcast(index.centres)
    at = next(i for i, t in enumerate(TAILS) if t >= tail)
    here = index.reach.join(queries.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    own = here.groupBy("snapshot_id").agg(F.sort_array(F.collect_list(F.struct("cell", "n", F.col("angles")[at].alias("angle")))).alias("held"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            away = np.arccos(np.clip(_matrix(batch.column("embedding")) @ centres.T, -1, 1))
            held = batch.column("held")
            cell, n, angle = (held.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("cell", "n", "angle"))
            cuts = held.offsets.to_numpy() - held.offsets[0].as_py()
            cells, bounds, firsts = [], [], []
            for row, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                bound = np.cos(np.maximum(away[row, cell[a:b]] - angle[a:b] - 1e-9, 0))
                best = np.lexsort((cell[a:b], away[row, cell[a:b]], -bound))
                cells.append(cell[a:b][best])
                bounds.append(bound[best])
                firsts.append(min(len(best), int(np.searchsorted(np.cumsum(n[a:b][best]), k)) + 1))
            lists = pa.array(cells, pa.list_(pa.int32())), pa.array(bounds, pa.list_(pa.float64()))
            columns = [*(batch.column(c) for c in ("query_id", "snapshot_id", "embedding")), *lists, pa.array(firsts, pa.int32())]
            yield pa.record_batch(columns, ["query_id", "snapshot_id", "embedding", "cells", "bounds", "firsts"])

    asked = queries.select("query_id", "snapshot_id", F.col("embedding").cast("array<float>").alias("embedding"))
    return asked.join(own, "snapshot_id").select("query_id", "snapshot_id", "embedding", "held").mapInArrow(order, _PROBES)


def nearest_in_cells(vectors: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """The best `k` hashes of each query (query_id, snapshot_id, embedding, cells) in the cells it lists.

    Queries go to the vectors in blocks, each once with its list. Only the folders of cells that some query of the block lists are read.
    """
    context = vectors.sparkSession.sparkContext
    found = None
    for block in question_blocks(probes, PROBING):
        cells = block.column("cells").combine_chunks()
        wanted = np.unique(cells.flatten().to_numpy()).tolist()
        shared = context.broadcast(
            (
                _matrix(block.column("embedding").combine_chunks()),
                block.column("query_id").to_numpy(),
                block.column("snapshot_id").to_numpy(),
                np.repeat(np.arange(block.num_rows), cells.value_lengths().to_numpy()),
                cells.flatten().to_numpy(),
            )
        )
        part = vectors.filter(F.col("cell").isin(wanted)).mapInArrow(partial(_score_cells, shared, k), _SCORES)
        found = part if found is None else found.unionByName(part)
    return vectors.sparkSession.createDataFrame([], _SCORES) if found is None else found


def _score_cells(shared, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Score the vectors of a task against the queries that list their cells."""
    points, query_ids, snapshots, row, cell = shared.value
    order = np.argsort(cell, kind="stable")
    row, cell = row[order], cell[order]
    best: dict[int, BestRows] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        matrix = _matrix(batch.column("embedding"))
        own, at = batch.column("snapshot_id").to_numpy(), batch.column("cell").to_numpy()
        chunk_ids = batch.column("chunk_id").to_numpy()
        hashes = batch.column("content_hash").to_numpy(zero_copy_only=False)
        for here in np.unique(at).tolist():
            asked = row[slice(*np.searchsorted(cell, [here, here + 1]))]
            rows = np.flatnonzero(at == here)
            for snapshot in np.unique(own[rows]).tolist():
                some = asked[snapshots[asked] == snapshot]
                mine = rows[own[rows] == snapshot]
                step = max(1, TILE_CELLS // max(1, len(some)))
                for first in range(0, len(mine) if len(some) else 0, step):
                    part = mine[first : first + step]
                    scores = np.round(points[some] @ matrix[part].T, DIGITS)
                    best.setdefault(snapshot, BestRows(k)).add_scores(query_ids[some], scores, chunk_ids[part], hashes[part])
    yield from _kept(best)


def indexed_topk(queries: DataFrame, copies: DataFrame, index: VectorIndex, *, k: int = VECTOR_LIMIT) -> DataFrame:
    """Like `vector_topk`, over stored vectors, which need not meet their chunks first; `copies` are stored `first_chunks`."""
    one_cell = F.lit(0).cast("int").alias("cell")
    here = index.vectors.join(queries.select("snapshot_id").distinct(), "snapshot_id", "left_semi").withColumn("cell", one_cell)
    scores = nearest(here, queries.select("query_id", "snapshot_id", "embedding", one_cell), k)
    return chunk_hits(scores, copies, k)


def vector_topk_approx(
    queries: DataFrame, copies: DataFrame, index: VectorIndex, *, k: int = VECTOR_LIMIT, tail: float = TAIL
) -> DataFrame:
    """Like `vector_topk` over an index; scores are exact, a near chunk far out in its cell may be missed (none with `tail` 1.0).

    A query reads the cells of best bound until they hold `k` vectors of its snapshot, and then every cell whose bound its k-th hit
    does not beat. Only cells with vectors of its snapshot count, so a small snapshot among many is searched as well as a large one.
    `copies` are the first `k` chunks of each hash (`first_chunks`), stored or not.
    """
    found, _ = probed_topk(queries, copies, index, k=k, tail=tail)
    return found


def probed_topk(
    queries: DataFrame, copies: DataFrame, index: VectorIndex, *, k: int = VECTOR_LIMIT, tail: float = TAIL
) -> tuple[DataFrame, DataFrame]:
    """(hits, probes) of `vector_topk_approx`; probes are `query_id, cells, cells_read`: cells of its snapshot, and cells read."""
    order = stored(probe_order(queries, index, k=k, tail=tail), "probe-order")
    near = order.withColumn("cells", F.slice("cells", F.lit(1), F.col("firsts")))
    first = stored(nearest_in_cells(index.vectors, near, k), "first-cells")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    kth = first.withColumn("place", F.row_number().over(best)).filter(F.col("place") == k).select("query_id", F.col("score").alias("kth"))
    beaten = F.filter(
        F.arrays_zip("cells", "bounds"), lambda c, i: (i >= F.col("firsts")) & (c["bounds"] >= F.coalesce("kth", F.lit(-2.0)))
    )
    more = stored(order.join(kth, "query_id", "left").withColumn("more", F.transform(beaten, lambda c: c["cells"])), "more-cells")
    rest = more.filter(F.size("more") > 0).select("query_id", "snapshot_id", "embedding", F.col("more").alias("cells"))
    scores = first.unionByName(nearest_in_cells(index.vectors, rest, k))
    hits = chunk_hits(scores, copies, k)
    return hits, more.select("query_id", F.size("cells").alias("cells"), (F.col("firsts") + F.size("more")).alias("cells_read"))
