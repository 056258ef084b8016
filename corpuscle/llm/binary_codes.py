"""Near-duplicate vectors by randomly rotated binary codes with correction factors.

Equal vectors are one class. Classes live in the cell of the nearest of some centres, fitted on a bounded sample, and visit every other
cell in which a vector near enough to link may live; where that would be too many, all vectors are one cell. Within a
cell a vector less its centre is rotated at random and kept as signs, with its norm and its agreement with its signs. From
these the inner product of two vectors is estimated without bias; only pairs whose confidence bound reaches the
threshold are computed exactly, in double precision. A pair is settled in the first of the two cells it lives in, so links are counted
once; tasks give counts and a spanning forest of the links, never the pairs of a dense group.
"""

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.components import components
from corpuscle.llm.simhash import Forest
from corpuscle.sources.tables import stored

SAMPLE = 16_384  # bound on the vectors the centres are fitted on
COPIES = 4  # cells a vector may be in on average, or as many as all vectors have chunks; with more, all vectors are one cell
TILE = 1_024  # vectors compared with as many at a time
CHUNK = 8_192  # vectors of a cell that go to one task; larger cells go chunk by chunk
BOUND = 4.0  # half-width of the confidence bound, in standard deviations
ROUNDING = 2e-5  # more than sums of single precision are off by
CELLS = 4_096  # bound on cells


def rotation(size: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of a sample of unit vectors, by spherical k-means from spread-out rows."""
    rng = np.random.default_rng(11)
    found = sample[np.sort(rng.choice(len(sample), min(count, len(sample)), replace=False))].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[k : k + 4096] @ found.T).argmax(1) for k in range(0, len(sample), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 0, sums / np.where(size > 0, size, 1), found)
    return found


@dataclass
class Codes:
    """Signs of rotated residuals with their norms and correction factors, laid out so that one product of two rows is the most
    that an inner product may be."""

    full: np.ndarray  # rotated residual, then inner product with the centre, one, norm
    coded: np.ndarray  # signs with norm and correction, then one, inner product with the centre less its square, norm times the bound

    @classmethod
    def of(cls, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> "Codes":
        """Codes of unit vectors around a centre.

        A residual agrees with its own signs by a factor that is stored; another residual's product with the signs, divided by
        that factor, estimates the product of the two without bias, and the factor also says how far off it may be.
        """
        size = vectors.shape[1]
        rest = vectors - centre
        norm = np.linalg.norm(rest, axis=1)
        rotated = (rest / np.where(norm > 0, norm, 1)[:, None]) @ turn
        signs = np.where(rotated >= 0, 1.0, -1.0) / np.sqrt(size)
        agree = np.maximum((rotated * signs).sum(1), 1e-6)
        spread = BOUND * np.sqrt((1 - np.minimum(agree**2, 1)) / (agree**2 * max(size - 1, 1)))
        along, one = vectors @ centre, np.ones(len(vectors))
        full = np.column_stack([rotated * norm[:, None], along, one, norm])
        coded = np.column_stack([signs * (norm / agree)[:, None], one, along - centre @ centre, norm * (spread + 1e-4)])
        return cls(full.astype(np.float32), coded.astype(np.float32))

    def reaches(self, rows: slice, other: "Codes", columns: slice, least: float) -> np.ndarray:
        """Pairs whose inner product may be `least` or more, as the estimate and its bound tell."""
        return self.full[rows] @ other.coded[columns].T >= np.float32(least - ROUNDING)


def visits(vectors: np.ndarray, middle: np.ndarray, inner: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell each unit vector lives in, and (row by cell) the earlier cells in which one lives that it may link with.

    A vector that lives in a cell is nearer to its centre than to any other; among vectors within `least` of a given one, the greatest
    inner product with the difference of two centres tells whether one can be nearer to the first than to the second. `inner` are the
    products of all centres with each other.
    """
    along = vectors @ middle.T
    home = along.argmax(1)
    own = along[np.arange(len(home)), home][:, None]
    norms = np.diag(inner)
    apart = norms[home][:, None] + norms[None] - 2 * inner[home]  # squared distance from the own centre to each
    ahead = along - own
    reach = least * ahead + np.sqrt(1 - least**2) * np.sqrt(np.maximum(apart - ahead**2, 0))
    return home, (reach >= -1e-6) & (np.arange(len(middle)) < home[:, None])


def links_between(a: np.ndarray, b: np.ndarray, centre: np.ndarray, turn: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs of two sets of vectors of a cell; each pair once when both are the same set."""
    same = a is b
    ca = Codes.of(a, centre, turn)
    cb = ca if same else Codes.of(b, centre, turn)
    found = []
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            x, y = np.nonzero(ca.reaches(slice(i, i + TILE), cb, slice(j, j + TILE), least))
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            for k in range(0, len(x), 1 << 18):
                p, q = x[k : k + (1 << 18)], y[k : k + (1 << 18)]
                exact = np.einsum("ij,ij->i", a[p], b[q])
                found.append((p[exact >= least], q[exact >= least]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


# ── Tables ────────────────────────────────────────────────────────────────────


def _unit(column: pa.Array, size: int) -> np.ndarray:
    """Vectors kept as bytes, in unit length and double precision."""
    rows = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, size)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _as_bytes(vectors: DataFrame, size: int) -> DataFrame:
    """`vec_id, vector`: sound vectors as the bytes of doubles, so that equal ones are equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column("embedding").flatten(), "<f8").reshape(-1, size) + 0.0  # no minus zero
            yield pa.record_batch([batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "vector"])

    return vectors.mapInArrow(run, "vec_id long, vector binary")


def near_vectors(vectors: DataFrame, *, least: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """`vec_id, n_links, component_id, kept` for every row of `vectors(vec_id, embedding)`.

    Linked are pairs found with a cosine of `least` or more. Null or empty vectors, ones of zeros and ones with null or non-finite parts link with
    nothing, and vectors of different lengths do not link with each other. component_id is the least id that links reach; null ids do not
    count, and a row without id that reaches none has none. Other columns are not read.
    """
    numbers = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce((F.size("embedding") > 0) & finite & some, F.lit(False)))
    found = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    sizes = rows.where("sound").select(F.size("embedding").alias("d")).distinct().orderBy("d")
    for size in sizes.toLocalIterator():  # as many jobs as there are lengths
        one = rows.where(F.col("sound") & (F.size("embedding") == size.d)).select("vec_id", "embedding")
        found = found.union(_near(one, size.d, least, sample))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _near(rows: DataFrame, size: int, least: float, sample: int) -> DataFrame:
    """`vec_id, n_links, component_id` of sound vectors of one length."""
    able = stored(_as_bytes(rows, size), "vectors")
    classes = able.groupBy("vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = _linked(classes, classes.count(), size, least, sample)
    links, counts = found.where("b IS NOT NULL").select("a", "b"), found.where("b IS NULL")
    named = classes.join(components(links), "node", "left")
    counts = counts.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = named.join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    reached = named.groupBy("component").agg(F.min("least").alias("component_id"))
    total = (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    named = named.join(reached, "component").select("vector", total, "component_id")
    return able.join(named, "vector").select("vec_id", "n_links", "component_id")


def _linked(classes: DataFrame, count: int, size: int, least: float, sample: int) -> DataFrame:
    """Rows `a, b, n`: links of a spanning forest (b given), and how many rows a class links to (b null)."""
    spark = classes.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = classes.select("vector").orderBy(F.xxhash64("vector")).limit(sample).toArrow().sort_by("vector")
    known = _unit(drawn.column("vector").combine_chunks(), size)
    middle = centres(known, max(1, min(CELLS, int(count**0.5))))
    inner = middle @ middle.T
    copies = 1 + np.mean([visits(known[k : k + 2048], middle, inner, least)[1].sum(1).mean() for k in range(0, len(known), 2048)])
    if copies > max(COPIES, -(-count // CHUNK)):
        middle = centres(known, 1)
        inner = middle @ middle.T
    # codes are taken around the mean of a cell's sampled vectors, from which residuals and so bounds are least
    home = np.concatenate([(known[k : k + 4096] @ middle.T).argmax(1) for k in range(0, len(known), 4096)])
    held = np.bincount(home, minlength=len(middle))[:, None]
    means = np.zeros_like(middle)
    np.add.at(means, home, known)
    means = np.where(held > 0, means / np.maximum(held, 1), middle)
    turn = rotation(size)
    shared = spark.sparkContext.broadcast((middle, inner, means, turn))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, inner, _, _ = shared.value
        names = ["cell", "node", "vector", "weight", "lives"]
        for batch in batches:
            for first in range(0, batch.num_rows, 2_000):
                part = batch.slice(first, 2_000)
                home, others = visits(_unit(part.column("vector"), size), middle, inner, least)
                yield pa.record_batch([pa.array(home), *part.columns, pa.array(np.ones(len(home), bool))], names)
                rows, cell = np.nonzero(others)
                for k in range(0, len(rows), 8_192):
                    some = part.take(pa.array(rows[k : k + 8_192]))
                    yield pa.record_batch([pa.array(cell[k : k + 8_192]), *some.columns, pa.array(np.zeros(some.num_rows, bool))], names)

    schema = "cell long, node long, vector binary, weight long, lives boolean"
    placed = stored(classes.select("node", "vector", "weight").mapInArrow(place, schema), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunked = placed.join(sizes, "cell").withColumn("chunk", (F.pmod(F.xxhash64("node"), F.col("chunks"))).cast("int"))
    # chunk i meets chunk j in the task of (i, j), so a cell of k chunks goes to k tasks' worth of pairs of chunks
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    pairs = chunked.withColumn("other", F.explode(others))
    pairs = pairs.select(
        "cell",
        F.least("chunk", "other").alias("low"),
        F.greatest("chunk", "other").alias("high"),
        "chunk",
        "node",
        "vector",
        "weight",
        "lives",
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, means, turn = shared.value
        for key, group in _groups(batches):
            vectors = _unit(group.column("vector").combine_chunks(), size)
            node, weight = group.column("node").to_numpy(), group.column("weight").to_numpy()
            chunk, lives = group.column("chunk").to_numpy(), group.column("lives").to_numpy()
            cell, low, high = key
            own, guests = ([np.flatnonzero((chunk == c) & x) for c in (low, high)] for x in (lives, ~lives))
            if low == high:
                met = [(own[0], own[0]), (own[0], guests[0])]
            else:
                met = [(own[0], own[1]), (own[0], guests[1]), (own[1], guests[0])]
            ends = []
            for first, second in met:  # two guests meet where one of them lives
                left = vectors[first]
                right = left if second is first else vectors[second]
                p, q = links_between(left, right, means[cell], turn, least)
                ends.append((first[p], second[q]))
            a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
            forest = Forest(len(vectors))
            forest.join(a, b)
            n = np.bincount(a, weight[b], len(vectors)) + np.bincount(b, weight[a], len(vectors))
            some = np.flatnonzero(n)
            ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (forest.left, forest.right)]
            yield pa.record_batch(
                [
                    pa.array(np.concatenate([node[ends[0]], node[some]])),
                    pa.concat_arrays([pa.array(node[ends[1]]), pa.nulls(len(some), pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(ends[0]), pa.int64()), pa.array(n[some].astype(np.int64))]),
                ],
                ["a", "b", "n"],
            )

    keys = ["cell", "low", "high"]
    dealt = pairs.repartition(partitions, *keys).sortWithinPartitions(*keys)
    return stored(dealt.mapInArrow(link, "a long, b long, n long"), "vector-links")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """Rows of each cell and pair of chunks, which arrive sorted."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in ("cell", "low", "high")], 1)
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]]))
        for first, last in itertools.pairwise(cuts):
            key = tuple(int(x) for x in keys[first])
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(first, last - first))
    if held:
        yield held_key, pa.Table.from_batches(held)
