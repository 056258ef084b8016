"""Stored search tables against the searches that read chunks, and what they leave unread."""

import random
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.operators import embeddings as em
from corpuscle.operators import fts_leg as fts
from corpuscle.operators import postings as po
from corpuscle.operators import vector_leg as vl
from corpuscle.plans import answer as an
from corpuscle.plans import retrieve as rt
from corpuscle.plans import search_index as si
from corpuscle.sources import tables
from corpuscle.sources.tables import read_bucketed, write_bucketed

CHUNK = (
    "snapshot_id bigint, chunk_id bigint, path string, kind string, name string, qualname string, "
    "part int, start_line int, end_line int, signature string, text string, content_hash string"
)
NAMES = ["get", "get_item", "set", "run", "reset", "target", None]


def corpus(spark, seed, count=400):
    """Random chunks of two snapshots; a third of them share a name and a text."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        name = "get" if rng.random() < 0.35 else rng.choice(NAMES)
        words = [rng.choice("abcdefghijklm") for _ in range(rng.randint(0, 30))]
        text = "a b common" if rng.random() < 0.3 else " ".join(words)
        snapshot = 1 if i % 7 else 2
        qualname = f"m{i % 3}.{name}" if name else None
        rows.append((snapshot, i, f"f{rng.randint(0, 40)}.py", "function", name, qualname, 0, rng.randint(1, 99), 200, None, text, f"h-{text}"))
    return (
        spark.createDataFrame(rows, CHUNK)
        .withColumn("search_a", tx.search_text(F.col("name"), F.col("qualname")))
        .withColumn("search_b", F.lit(""))
        .withColumn("search_c", tx.split_identifiers(F.col("text")))
    )


def plans(spark):
    """Questions with identifiers, of both snapshots and of one that has no chunks."""
    rows = [
        (1, 1, "a b c", ["get"]), (2, 1, "common", ["m1.set", "se"]), (3, 2, "a common", ["get"]), (4, 1, "d zzz", ["t"]),
        (5, 1, "?? --", []), (6, 9, "a b", ["get"]), (7, 2, "k l m nowhere", ["reset", "get", "run"]), (8, 1, "a", []),
    ]
    given = spark.createDataFrame(rows, "query_id bigint, snapshot_id bigint, query string, identifiers array<string>")
    return given.withColumn("intent", F.lit("explain"))


def vectors(spark):
    """A vector for each text, and one for each question."""
    rng = np.random.default_rng(1)
    texts = [f"h-{t}" for t in ("a b common",)]
    rows = [(t, "m", [float(x) for x in rng.normal(size=8)]) for t in texts]
    asked = [(q, [float(x) for x in rng.normal(size=8)]) for q in range(1, 9)]
    return (
        spark.createDataFrame(rows, "content_hash string, model string, embedding array<float>"),
        spark.createDataFrame(asked, "query_id bigint, embedding array<float>"),
    )


def ranked(hits):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in hits.collect())


@pytest.mark.parametrize("size", [7, 60, 10_000])
def test_postings_give_the_hits_of_a_scan(spark, size, monkeypatch):
    monkeypatch.setattr(po, "QUESTIONS", 3)  # several blocks
    monkeypatch.setattr(po, "FIRST", 1)
    chunks, asked = corpus(spark, size), plans(spark)
    search = fts.search_rows(chunks)
    stored = po.index_postings(search, size=size).cache()
    for k in (3, 50) if size == 60 else (50,):
        want = fts.fts_and(asked, search, k=k)
        got = po.search_all(asked, stored, k=k)
        assert ranked(got) == ranked(want)
        assert ranked(po.search_any(asked, want, stored, k=k)) == ranked(fts.fts_or(asked, want, search, k=k))


def test_all_words_scores_are_cover_densities(spark):
    chunks, asked = corpus(spark, 3), plans(spark)
    search = fts.search_rows(chunks)
    want = fts.ranked(fts.cover_density(fts.all_words(asked, search)), 50)
    assert ranked(fts.fts_and(asked, search)) == ranked(want)


def test_postings_keep_every_place_and_the_greatest_weight(spark):
    chunks = corpus(spark, 5)
    rows = po.index_postings(fts.search_rows(chunks), size=50)
    spread = rows.select("snapshot_id", "term", "range", "top", F.explode(F.arrays_zip("chunks", "weights", "places")).alias("p"))
    spread = spread.select("snapshot_id", "term", "top", "p.chunks", "p.weights", F.explode("p.places").alias("place"))
    got = sorted((r.snapshot_id, r.term, r.chunks, r.place // po.PACK, r.place % po.PACK) for r in spread.collect())
    want = sorted((r.snapshot_id, r.term, r.chunk_id, r.pos, r.weight) for r in fts.build_postings(chunks).collect())
    assert got == want
    assert all(r.top == max(r.weights) and list(r.chunks) == sorted(r.chunks) for r in rows.collect())


def test_ranges_that_cannot_reach_the_last_hit_are_not_read(spark, monkeypatch):
    """One range has chunks full of the word; the others cannot reach the third of them."""
    rows = [(1, i, ["w"] * (9 if i < 40 else 1), [1] * (9 if i < 40 else 1)) for i in range(400)]
    search = spark.createDataFrame(rows, "snapshot_id bigint, chunk_id bigint, terms array<string>, weights array<int>")
    by_hand = search.withColumn("range", F.floor(F.col("chunk_id") / 40).cast("bigint"))
    stored = by_hand.groupBy("snapshot_id", "range").applyInArrow(po._post, po.POSTINGS).withColumn("bucket", po.term_bucket())
    asked = spark.createDataFrame([(1, 1, "w")], "query_id bigint, snapshot_id bigint, query string")
    read = []
    meet = po._Search.meet

    def watched(self, pairs, *rest):
        read.append(sorted(r.range for r in pairs.collect()))
        return meet(self, pairs, *rest)

    monkeypatch.setattr(po._Search, "meet", watched)
    monkeypatch.setattr(po, "FIRST", 1)
    none = spark.createDataFrame([], "query_id bigint")
    hits = po.search_any(asked, none, stored.cache(), k=3).collect()
    assert sorted(r.chunk_id for r in hits) == [0, 1, 2]
    assert read == [[0], []]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    given, _ = vectors(spark)
    return si.store_search_index(corpus(spark, 11), given, "m", path, buckets=4), path


def test_stored_index_gives_what_reading_the_chunks_gives(spark, index):
    chunks, asked = corpus(spark, 11), plans(spark)
    given, questions = vectors(spark)
    want = rt.hybrid_retrieve(asked, chunks, given, questions, "m")
    got = rt.hybrid_retrieve(asked, chunks, None, questions, "m", index[0])
    shown = lambda found: sorted((r.query_id, r["rank"], r.chunk_id, r.score, r.tier) for r in found.hits.collect())
    assert shown(got) == shown(want) and len(shown(got)) > 100
    for part in ("trace", "floor"):
        assert sorted(map(tuple, getattr(got, part).collect())) == sorted(map(tuple, getattr(want, part).collect()))


def test_index_opens_in_a_session_that_does_not_know_it(spark, index):
    found, path = index
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("corpuscle_")]
    before = {name: getattr(found, name).count() for name in si.LAID_OUT}
    for name in tables:
        spark.sql(f"DROP TABLE {name}")
    again = si.open_search_index(spark, path, buckets=4)
    assert {name: getattr(again, name).count() for name in si.LAID_OUT} == before
    asked = plans(spark)
    want = rt.search_symbols(asked, corpus(spark, 11))[1]
    assert ranked(rt.search_symbols(asked, None, again)[1]) == ranked(want)


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_questions_move_and_the_stored_tables_do_not(spark, tmp_path):
    """A join on the keys of a bucketed table shuffles the other side alone, even where nothing is small enough to broadcast."""
    rows = spark.range(1_000).select((F.col("id") % 5).alias("snapshot_id"), F.col("id").cast("string").alias("alias"))
    write_bucketed(rows, str(tmp_path / "t"), ("snapshot_id", "alias"), 4)
    table = read_bucketed(spark, str(tmp_path / "t"), ("snapshot_id", "alias"), 4)
    asked = spark.range(50).select((F.col("id") % 5).alias("snapshot_id"), F.col("id").cast("string").alias("alias"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(table.join(asked, ["snapshot_id", "alias"], "left_semi"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1
    assert table.join(asked, ["snapshot_id", "alias"], "left_semi").count() == 50


def test_only_folders_of_asked_terms_are_read(spark, index):
    terms = spark.createDataFrame([("common",)], "term string")
    plan = executed(po.asked_postings(index[0].postings, terms))
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = po.asked_postings(index[0].postings, terms).select(F.input_file_name()).distinct().count()
    assert files < len(index[0].postings.inputFiles())


# ── Vectors in cells ──────────────────────────────────────────────────────────


def clustered(spark, path, spread):
    """(index, copies, queries, unit vectors): vectors around thirty centres in a large and a small snapshot."""
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(30, 16))
    points = middle[rng.integers(30, size=3_000)] * (1 - spread) + spread * rng.normal(size=(3_000, 16))
    points = points.astype(np.float32)
    chunks = spark.createDataFrame(
        [(2 if i % 100 == 0 else 1, i, f"h{i}", p.tolist()) for i, p in enumerate(points)],
        "snapshot_id bigint, chunk_id bigint, content_hash string, embedding array<float>",
    )
    queries = spark.createDataFrame(
        [(q, 1 + q % 2, points[q].tolist()) for q in range(40)], "query_id bigint, snapshot_id bigint, embedding array<float>"
    )
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    return vl.index_vectors(chunks, str(path)), vl.first_chunks(chunks, 20), queries, unit


def brute(unit, q):
    own = np.flatnonzero((np.arange(len(unit)) % 100 == 0) == (q % 2 == 1))
    scores = np.round(unit[own] @ unit[q], 9)
    return own[np.lexsort((own, -scores))[:20]].tolist()


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_bounded_search_is_exact_and_reads_few_cells_of_clusters(spark, tmp_path, spread, monkeypatch):
    monkeypatch.setattr(vl, "PROBING", 15)  # many blocks
    index, copies, queries, unit = clustered(spark, tmp_path, spread)
    hits, probes = vl.probed_topk(queries, copies, index, tail=1.0)
    found = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.chunk_id)
    assert found == {q: brute(unit, q) for q in range(40)}
    read = {r.query_id: r.cells_read / r.cells for r in probes.collect()}
    assert len(read) == 40 and max(read.values()) <= 1
    if spread < 1:
        assert np.mean([read[q] for q in range(0, 40, 2)]) < 0.3
    loose = {(r.query_id, r.chunk_id) for r in vl.vector_topk_approx(queries, copies, index).collect()}
    want = {(q, c) for q in range(40) for c in brute(unit, q)}
    assert len(loose & want) >= 0.9 * len(want)


def test_cells_of_no_vectors_and_of_unknown_snapshots(spark, tmp_path):
    empty = spark.createDataFrame([], "snapshot_id bigint, content_hash string, chunk_id bigint, embedding array<float>")
    index = vl.index_vectors(empty, str(tmp_path / "e"))
    asked = spark.createDataFrame([(1, 1, [1.0, 0.0])], "query_id bigint, snapshot_id bigint, embedding array<float>")
    assert vl.vector_topk_approx(asked, vl.first_chunks(empty, 20), index).count() == 0
    one = spark.createDataFrame([(1, "h", 5, [0.0, 2.0])], empty.schema)
    index = vl.index_vectors(one, str(tmp_path / "o"))
    rows = vl.vector_topk_approx(asked.union(asked.selectExpr("2L", "7L", "embedding")), vl.first_chunks(one, 20), index).collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in rows] == [(1, 5, 0.0)]


# ── One snapshot, many tasks ──────────────────────────────────────────────────


def test_no_task_gets_all_of_a_snapshot(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {name: spark.conf.get(name) for name in names}
    for name, value in zip(names, ("8", "-1", "false"), strict=True):  # as when no side of a join is small enough to be sent
        spark.conf.set(name, value)
    try:
        rows = spark.range(400).select(F.expr("id div 1000 + 1").alias("snapshot_id"), F.col("id").alias("chunk_id"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
        search = rows.select("snapshot_id", "chunk_id", F.array(F.lit("a")).alias("terms"), F.array(F.lit(1)).alias("weights"))
        asked = spark.createDataFrame([(1, 1)], "query_id bigint, snapshot_id bigint")
        pending = rows.select("snapshot_id", "content_hash", F.lit(2_000_000).alias("tokens"))
        parts = [
            po.index_postings(search, size=10),
            vl.first_chunks(vl._asked_chunks(rows, asked), 20),
            em.token_batches(pending),
        ]
        for part in parts:
            assert part.select(F.spark_partition_id().alias("task")).distinct().count() > 4
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_lists_of_terms_that_nobody_asks_do_not_move(spark):
    words = [f"w{n}" for n in range(500)]  # several in each folder
    search = spark.createDataFrame([(1, n, words, [1] * 500) for n in range(3)], "snapshot_id bigint, chunk_id bigint, terms array<string>, weights array<int>")
    asked = spark.createDataFrame([(7, 1, "w1"), (7, 1, "w2"), (8, 1, "w2"), (8, 2, "w3")], "query_id bigint, snapshot_id bigint, term string")
    lists = po._Search(asked, po.index_postings(search), "terms").postings
    assert {r.term for r in lists.collect()} == {"w1", "w2"}


# ── What lies on the disks meanwhile ──────────────────────────────────────────


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {files.apply(k).getPath() for k in range(files.size()) if "shuffle" in files.apply(k).getName()}


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    """Also when writes run side by side; the session's setting is as before."""
    before, setting = shuffle_files(spark), spark.conf.get(tables.REMOVED)
    rows = spark.range(3_000).select((F.col("id") % 9).alias("a"), F.col("id").alias("b"))
    writes = [
        lambda: tables.stored(rows.groupBy("b").count().repartition(3, "count"), "t", str(tmp_path / "t")),
        lambda: tables.write_partitioned(rows, str(tmp_path / "p"), "a"),
        lambda: write_bucketed(rows, str(tmp_path / "b"), ("a",), 3),
    ]
    with ThreadPoolExecutor(3) as pool:
        for job in [pool.submit(w) for w in writes]:
            job.result()
    for _ in range(50):  # files go in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(tables.REMOVED) == setting
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 3_000


def posted(rows):
    return sorted((r.snapshot_id, r.range, r.term, r.top, r.chunks, r.weights, r.places, r.bucket) for r in rows.collect())


@pytest.mark.parametrize("held", [po.HELD, 1])
def test_postings_move_packed_and_arrive_whole(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(po, "HELD", held)
    chunks = corpus(spark, 6).unionByName(corpus(spark, 7).filter("chunk_id < 30"))  # some ids come twice
    rows = po.index_postings(chunks, size=50)
    po.write_postings(rows, str(tmp_path / "p"))
    back = spark.read.schema(f"{po.POSTINGS}, bucket int").parquet(str(tmp_path / "p"))
    assert posted(back) == posted(rows)
    po.write_postings(rows.limit(0), str(tmp_path / "none"))


def test_search_fields_move_to_their_range_and_are_split_there(spark):
    """Chunks give the postings of their search vectors; the words do not move, and nothing moves twice."""
    chunks = corpus(spark, 8)
    rows = po.index_postings(chunks, size=50)
    assert posted(rows) == posted(po.index_postings(fts.search_rows(chunks), size=50))
    above, _, below = executed(rows).partition("REPARTITION_BY_COL")
    assert "Exchange hashpartitioning" not in above.rpartition("Exchange")[0] and "search_c" in below.split("\n")[1]


def test_search_tables_keep_no_texts(spark, tmp_path, monkeypatch):
    kept = []
    store = si.stored
    monkeypatch.setattr(si, "stored", lambda rows, name: (kept.append(rows.columns), store(rows, name))[1])
    si.store_search_index(corpus(spark, 9), None, "m", str(tmp_path / "index"), buckets=4)
    assert kept and not {"text", "terms", "search_c"} & {c for columns in kept for c in columns}


def test_only_shown_texts_move(spark, monkeypatch):
    """Sources of few blocks read the texts of their chunks; those of many move all."""
    chunks = corpus(spark, 12).withColumn("tokens", F.lit(5))
    rank = F.expr("CASE chunk_id WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 3 END").alias("rank")
    hits = chunks.filter("chunk_id IN (3, 5, 8)").select(F.lit(1).alias("query_id"), "snapshot_id", rank, "chunk_id", F.lit("fts").alias("tier"))
    commits = chunks.select("snapshot_id").distinct().withColumn("commit_sha", F.lit("c"))
    few = an.full_sources(hits, chunks, commits)
    assert "LeftSemi" in executed(few) and few.count() == 3
    monkeypatch.setattr(an, "SENT_BLOCKS", 0)
    moved = an.full_sources(hits, chunks, commits)
    assert "LeftSemi" not in executed(moved) and sorted(map(str, moved.collect())) == sorted(map(str, few.collect()))
