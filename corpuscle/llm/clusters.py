"""Centroid clustering of integer vectors, with centroids ruled out in a rotated space.

Vectors are stored with their leading coordinates along principal axes and the norm of the rest. The squared distance of the leading
coordinates plus the squared difference of the two rests is never more than the squared distance, so most centroids are ruled out on a few
numbers; those that are left are verified in integers, which alone decide. Axes are fitted on a bounded sample and change the
work only, not the result.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.sources.tables import stored

WIDTH = 64  # components of a vector
SCALE = 64  # a component x becomes floor(SCALE * x)
MOST = 1 << 27  # components below this keep squared distances within 64 bits
CENTROIDS = 16
ROUNDS = 3
LEADING = 16  # principal coordinates that are stored
SAMPLE = 16_384  # vectors, about, that the axes are fitted on (twice as many at most)
SLACK = 1e-9  # relative slack of the bound, well above rounding errors


def principal_axes(sample: np.ndarray, count: int) -> np.ndarray:
    """The first axes, as columns, along which a sample spreads."""
    if not len(sample):
        return np.eye(sample.shape[1])[:, :count]
    centred = sample - sample.mean(0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(axes[:, ::-1][:, :count])


def rotated(vectors: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates, and the norm of the rest."""
    points = vectors.astype(np.float64)
    leading = points @ axes
    rest = np.einsum("ij,ij->i", points, points) - np.einsum("ij,ij->i", leading, leading)
    return leading, np.sqrt(np.maximum(rest, 0))


def nearest_centroids(
    vectors: np.ndarray, leading: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each integer vector (ties: the smaller number), its squared distance, and how many were verified."""
    lead_c, rest_c = rotated(centroids, axes)
    size = np.einsum("ij,ij->i", leading, leading) + rest**2
    size_c = np.einsum("ij,ij->i", lead_c, lead_c) + rest_c**2
    # the bound: |a - c|^2 along the axes plus (|rest of a| - |rest of c|)^2, multiplied out
    bound = size[:, None] + size_c - 2 * (leading @ lead_c.T + rest[:, None] * rest_c)
    bound -= SLACK * (size[:, None] + size_c + 1)
    cluster = bound.argmin(1)
    distance = ((vectors - centroids[cluster]) ** 2).sum(1)
    first = cluster.copy()
    verified = len(vectors)
    for number in range(len(centroids)):
        left = np.flatnonzero((bound[:, number] <= distance) & (first != number))
        verified += len(left)
        away = ((vectors[left] - centroids[number]) ** 2).sum(1)
        better = (away < distance[left]) | ((away == distance[left]) & (number < cluster[left]))
        cluster[left[better]], distance[left[better]] = number, away[better]
    return cluster, distance, verified


# ── Tables ────────────────────────────────────────────────────────────────────


def _bytes(numbers: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    data = np.ascontiguousarray(numbers)
    return pa.Array.from_buffers(pa.binary(data.shape[1] * data.itemsize), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def _rows(column: pa.Array | pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    """Binary values as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _integers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _rows(column, "<i4", WIDTH).astype(np.int64)


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """`vec_id, vector`: kept vectors as the bytes of 64 integers of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(-1, WIDTH)
            yield pa.record_batch([batch.column("vec_id"), _bytes(np.floor(SCALE * numbers).astype("<i4"))], ["vec_id", "vector"])

    embedding = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST / SCALE))
    return rows.where((F.size("embedding") == WIDTH) & sound).mapInArrow(run, "vec_id long, vector binary")


def clusters(
    vectors: DataFrame, *, count: int = CENTROIDS, rounds: int = ROUNDS, leading: int = LEADING, sample: int = SAMPLE
) -> DataFrame:
    """`vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256` for every kept row of `vectors(vec_id, embedding)`.

    Kept are vectors of 64 parts, none null or non-finite (nor of 2^21 or more in size, whose squared distances do not fit in 64 bits); all
    other rows give no row. Centroids start as the `count` kept rows with the smallest sha256 of `1:<vec_id>`, equal ids by their vectors; a row
    without id starts none but belongs to a cluster. Fewer kept rows with ids give fewer centroids, none give no rows.
    Each round reads every vector once and moves only sums, one row per task and cluster.
    """
    spark = vectors.sparkSession
    whole = stored(integer_vectors(vectors), "integer-vectors")
    number = whole.where("vec_id IS NOT NULL").withColumn("hash", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    start = number.orderBy("hash", "vector").limit(count).toArrow()
    centroids = _integers(start.column("vector"))
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    step = max(1, whole.count() // sample)
    drawn = whole.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(step)) == 0).select("vector").toArrow().sort_by("vector")
    axes = spark.sparkContext.broadcast(principal_axes(_integers(drawn.column("vector")), leading))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotated(_integers(batch.column("vector")), axes.value)
            yield pa.record_batch([*batch.columns, _bytes(lead), pa.array(rest)], ["vec_id", "vector", "leading", "rest"])

    held = stored(whole.mapInArrow(turn, "vec_id long, vector binary, leading binary, rest double"), "rotated-vectors")
    for _ in range(rounds):
        sums = _sums(held, centroids, axes)
        for r in sums.collect():  # one row per cluster
            centroids[r.cluster] = [r[f"s{k}"] // r.n for k in range(WIDTH)]

    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = _assigned(batch, shared.value, axes.value)
            yield pa.record_batch([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = stored(held.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # `count` rows at most
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.create_map(*[F.lit(x) for k, d in inertia.items() for x in (k, d)])
    names = F.array(*[F.lit(x) for x in digest])
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        own[F.col("cluster")].cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        names[F.col("cluster")].alias("centroid_sha256"),
    )


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of the rows of a batch."""
    lead = _rows(batch.column("leading"), "<f8", axes.shape[1])
    return nearest_centroids(_integers(batch.column("vector")), lead, batch.column("rest").to_numpy(), centroids, axes)[:2]


def _sums(held: DataFrame, centroids: np.ndarray, axes) -> DataFrame:
    """`cluster, n, s0..s63`: how many vectors are nearest to each centroid, and their sums."""
    shared = held.sparkSession.sparkContext.broadcast(centroids.copy())
    names = [f"s{k}" for k in range(WIDTH)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        total = np.zeros((len(centroids), WIDTH), np.int64)
        count = np.zeros(len(centroids), np.int64)
        for batch in batches:
            vectors = _integers(batch.column("vector"))
            cluster, _ = _assigned(batch, centroids, axes.value)
            order = np.argsort(cluster, kind="stable")
            n = np.bincount(cluster, minlength=len(centroids))
            some = np.flatnonzero(n)
            if len(some):
                total[some] += np.add.reduceat(vectors[order], (np.cumsum(n) - n)[some], axis=0)
            count += n
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(count[some]), *(pa.array(total[some, k]) for k in range(WIDTH))], ["cluster", "n", *names])

    schema = "cluster int, n long, " + ", ".join(f"{c} long" for c in names)
    parts = held.mapInArrow(add, schema)
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
