"""Nearest vectors, the filter audit and centroid clustering against brute force, and on odd tables."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm import clusters, queries, survival, vector_forest

from .conftest import CLASHES, SF, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VECTORS = "vec_id long, embedding array<float>, label int"


# ── 11 nearest vectors ────────────────────────────────────────────────────────


def dot(a, b):
    """The inner product, added up in order."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def brute_lists(rows, asked, k):
    """Sorted lists of every query row."""
    sound = [
        (i, v)
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    ]
    out = []
    for n, (i, v) in enumerate(sound):
        if asked(i):
            others = [(-dot(v, w), j) for m, (j, w) in enumerate(sound) if m != n and len(w) == len(v)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(others)[:k])]
    return sorted(out)


def lists(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


def floats(rng, size):
    return [float(np.float32(rng.gauss(0, 1))) for _ in range(size)]


@pytest.fixture(scope="module")
def odd_vectors():
    """Copies, ties, repeated rows and ids, two widths, nulls, zeros, infinities, and norms far apart."""
    rng = random.Random(9)
    rows = [(k, floats(rng, 6)) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(40)] + [(20, rows[5][1]), (20, rows[20][1]), (40, rows[40][1])]
    rows += [(200 + k, floats(rng, 3)) for k in range(45)]
    rows += [(300, None), (320, []), (340, [0.0] * 6), (360, [1.0, None, 2.0, 1.0, 1.0, 1.0]), (380, [math.inf] * 6)]
    rows += [(400, [math.nan] * 6), (None, rows[1][1]), (420, [100.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (440, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    return rows


def test_nearest_of_odd_tables_by_brute_force(spark, odd_vectors):
    frame = spark.createDataFrame([(i, v, 1) for i, v in odd_vectors], VECTORS)
    for name in CLASHES:
        frame = frame.withColumn(name, F.col("label"))
    got = vector_forest.nearest_vectors(frame, F.col("vec_id") % 20 == 0, k=5)
    assert lists(got) == brute_lists(odd_vectors, lambda i: i % 20 == 0, 5)


def test_nearest_in_leaves_of_many_trees_by_brute_force(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(vector_forest, "SHARD", 8)
    frame = spark.createDataFrame([(i, v, 1) for i, v in odd_vectors], VECTORS)
    got = vector_forest.nearest_vectors(frame, F.col("vec_id") % 20 == 0, k=5, leaf=4, trees=3, recall=1.0)
    assert lists(got) == brute_lists(odd_vectors, lambda i: i % 20 == 0, 5)


def test_nearest_of_doubles_and_of_nothing(spark):
    rows = [(0, [1.0, 1e-9]), (1, [1.0, 2e-9]), (2, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lists(vector_forest.nearest_vectors(frame, F.col("vec_id") == 0, k=20))
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2)]
    assert vector_forest.nearest_vectors(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert vector_forest.nearest_vectors(frame, F.lit(False)).count() == 0
    alone = frame.where("vec_id = 0")
    assert vector_forest.nearest_vectors(alone, F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("spread", [0.15, 1.0])
def test_recall_of_the_forest(spark, spread, monkeypatch):
    """Clustered vectors need few leaves, vectors without clusters many; nine tenths of the neighbours are found either way."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(60, 32))
    points = (middle[rng.integers(60, size=6_000)] * (1 - spread) + spread * rng.normal(size=(6_000, 32))).astype(np.float32)
    taken = []
    search = vector_forest._scored

    def watched(*args):
        taken.append(args[3] / args[2].leaves)
        return search(*args)

    monkeypatch.setattr(vector_forest, "_scored", watched)
    frame = spark.createDataFrame([(k, p.tolist(), 0) for k, p in enumerate(points)], VECTORS)
    got = {(r.query_id, r.vec_id): r.score for r in vector_forest.nearest_vectors(frame, F.col("vec_id") % 20 == 0, leaf=64).collect()}
    exact = points[::20].astype(float) @ points.T.astype(float)
    exact[np.arange(300), np.arange(300) * 20] = -np.inf
    want = {(20 * q, int(v)) for q, row in enumerate(np.argsort(-exact, axis=1)[:, :20]) for v in row}
    assert len(got) == 6_000 and len(want & set(got)) >= 0.9 * len(want)
    assert all(s == pytest.approx(exact[q // 20, v], abs=1e-12) for (q, v), s in got.items())
    if spread < 1:
        assert taken[0] < 0.5


def test_shards_hold_whole_leaves(monkeypatch):
    monkeypatch.setattr(vector_forest, "SHARD", 10)
    shards = vector_forest.Shards.of(np.array([4, 4, 4, 25, 0, 3, 9, 2]), 4)
    assert shards.first.tolist() == [0, 0, 1, 2, 5, 5, 6, 7] and shards.chunks.tolist() == [1, 1, 1, 3, 1, 1, 1, 1]


# ── 12 filter audit ───────────────────────────────────────────────────────────


def test_positional_counts_of_random_words():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 3, 7, 1000):
        found = rng.integers(0, 1 << 32, size=size, dtype=np.uint64).astype(np.uint32)
        times = rng.integers(0, 1 << int(rng.integers(1, 20)), size=size)
        want = [int((times * ((found >> np.uint32(b)) & 1)).sum()) for b in range(32)]
        assert survival.positional_counts(found, times).tolist() == want


def audit(rows, labels):
    """The report, document by document and order by order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, lang in rows:
        text = text or ""
        found = WORD.findall(text)
        bad = set()
        if len(found) < 200:
            bad.add("A")
        if 100 * len(set(found)) < 50 * len(found):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            bad.add("C")
        if any(c in "#$%&*|" for c in text):
            bad.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            bad.add("E")
        fails.append((lang or "", bad, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [f for f in fails if f[0] == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                total[x] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left),
                    len(gone),
                    sum(x in f[1] for f in own) - len(gone),
                    sum(f[1] == {x} for f in own),
                    sum(f[2] for f in gone),
                    sum(f[3] for f in gone),
                    x,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def report(frame):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in frame.collect()}


def test_audit_of_odd_tables_by_brute_force(spark, odd_rows):
    rng = random.Random(8)
    long_text = words(rng, 260)
    rows = [(i, t, s) for i, t, s in odd_rows]
    rows += [(500 + k, long_text, rng.choice(["en", "de", None, ""])) for k in range(70)]
    rows += [(600 + k, (long_text + rng.choice(["", " #", " AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA BBBBBB", " x" * 400])), "en") for k in range(30)]
    rows += [(500, long_text, "en"), (500, long_text, "en"), (None, long_text, "en"), (None, long_text, "en"), (None, "", None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [*range(0, 660, 2), 500, 500, None, 9_999]]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    frame = spark.createDataFrame(rows, schema)
    for name in (*CLASHES, "digest", "fails", "good", "toxic", "first", "least"):
        frame = frame.withColumn(name, F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("y"))
    got = report(survival.filter_audit(frame, marks))
    assert got == audit(rows, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})


def test_audit_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert survival.filter_audit(nothing, labels).count() == 0


# ── 13 clusters ───────────────────────────────────────────────────────────────


def brute_clusters(rows, count=16, rounds=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**21 for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), n) for n, (i, _) in enumerate(kept) if i is not None)
    centroids = [kept[n][1] for _, n in named[:count]]

    def assign():
        away = lambda v: [sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in centroids]
        return [min((d, k) for k, d in enumerate(away(v))) for _, v in kept]

    if not centroids:
        return []
    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    total = collections.Counter()
    for d, c in found:
        total[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted(((i, c, d, total[c], sum(total.values()), names[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=key)


def clustered(frame):
    rows = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_clusters_of_odd_tables_by_brute_force(spark):
    rng = random.Random(12)
    middle = [floats(rng, 64) for _ in range(5)]
    rows = [(k, [x + float(np.float32(0.3 * rng.gauss(0, 1))) for x in rng.choice(middle)]) for k in range(150)]
    rows += [(200 + k, rows[7][1]) for k in range(60)]  # copies: ties between centroids
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [math.nan] * 64), (305, [None] * 64)]
    rows += [(306, [math.inf] * 64), (307, [float(2**20)] * 64), (308, [-float(2**22)] * 64), (309, [0.0] * 64), (None, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in (*CLASHES, "cluster", "distance", "vector", "hash", "leading", "rest"):
        frame = frame.withColumn(name, F.lit("x"))
    assert clustered(clusters.clusters(frame)) == brute_clusters(rows)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [-0.5] * 64), (3, [0.25] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clustered(clusters.clusters(frame)) == brute_clusters(rows)
    assert clustered(clusters.clusters(frame, count=2)) == brute_clusters(rows, count=2)
    assert clusters.clusters(frame.limit(0)).count() == 0
    assert clusters.clusters(frame.withColumn("vec_id", F.lit(None).cast("long"))).count() == 0


def test_bounds_rule_out_most_centroids(spark):
    """Among clustered vectors few centroids are left to verify, and those that are ruled out are never nearest."""
    rng = np.random.default_rng(4)
    middle = rng.integers(-60, 60, size=(16, 64))
    found = middle[rng.integers(16, size=4_000)] + rng.integers(-9, 10, size=(4_000, 64))
    axes = clusters.principal_axes(found, 16)
    cluster, distance, verified = clusters.nearest_centroids(found, *clusters.rotated(found, axes), middle, axes)
    away = ((found[:, None] - middle) ** 2).sum(2)
    assert (cluster == away.argmin(1)).all() and (distance == away.min(1)).all()
    assert verified < 1.5 * len(found)


def test_equal_rows_of_the_query(spark):
    """The registered query gives what the operator gives with its production parameters."""
    got = clustered(queries.op13_clusters(spark, SF))
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got == brute_clusters(table)
