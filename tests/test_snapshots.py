"""Incremental embedding, budgets, and the life of snapshots."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import embeddings as em
from corpuscle.operators import snapshots as sn
from corpuscle.registry import snapshots as queries


def chunk_table(spark, rows):
    """(snapshot_id, chunk_id, content_hash, tokens, text) rows."""
    return spark.createDataFrame(
        rows, "snapshot_id bigint, chunk_id bigint, content_hash string, tokens int, text string"
    )


def vectors(spark, rows):
    """(content_hash, model, embedding) rows."""
    return spark.createDataFrame(rows, "content_hash string, model string, embedding array<float>")


def test_pending_and_reused(spark):
    chunks = chunk_table(
        spark, [(1, 1, "a", 3, "A"), (1, 2, "a", 3, "A"), (1, 3, "b", 4, "B"), (2, 4, "b", 4, "B")]
    )
    known = vectors(spark, [("b", "m", [1.0]), ("a", "other", [1.0])])
    pending, reused = em.pending_embeddings(chunks, known, "m")
    assert [tuple(r) for r in pending.collect()] == [(1, "a", 3)]
    assert sorted(tuple(r) for r in reused.collect()) == [(1, 1, 1), (2, 0, 1)]
    assert [tuple(r) for r in em.hash_texts(chunks, pending).collect()] == [("a", "A")]


def batches_by_rule(tokens, most, items):
    """Batch number of each item, one at a time."""
    out, batch, total, count = [], 0, 0, 0
    for t in tokens:
        if count and (total + t > most or count == items):
            batch, total, count = batch + 1, 0, 0
        total, count = total + t, count + 1
        out.append(batch)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_token_batches(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for snapshot in range(5):
        tokens = [rng.choice([1, 30, 60, 100, 150]) for _ in range(rng.randint(0, 40))]
        names = [f"{i:04}" for i in range(len(tokens))]
        rows += [(snapshot, n, t) for n, t in zip(names, tokens)]
        expected |= {(snapshot, n): b for n, b in zip(names, batches_by_rule(tokens, 100, 5))}
    rng.shuffle(rows)
    pending = spark.createDataFrame(rows, "snapshot_id bigint, content_hash string, tokens int")
    found = em.token_batches(pending, max_tokens=100, max_items=5).collect()
    assert {(r.snapshot_id, r.content_hash): r.batch_id for r in found} == expected


def test_every_snapshot_gets_batches_whatever_its_size(spark):
    pending = spark.createDataFrame(
        [(1, "a", 6), (1, "b", 5), (2, "a", 10)],
        "snapshot_id bigint, content_hash string, tokens int",
    )
    verdict = {r.snapshot_id: (r.tokens, r.refused) for r in em.embed_budget(pending, cap=10).collect()}
    assert verdict == {1: (11, True), 2: (10, False)}
    assert em.token_batches(pending, max_tokens=10).count() == 3


def test_large_snapshots_start_batches_anew_with_each_range_of_hashes(spark):
    rng = random.Random(3)
    rows = [(s, f"{rng.getrandbits(64):016x}", rng.choice([5, 20, 90])) for s in (1, 2) for _ in range(400 * s)]
    pending = spark.createDataFrame(rows, "snapshot_id bigint, content_hash string, tokens int")
    found = em.token_batches(pending, max_tokens=100, max_items=4, range_tokens=2_000).collect()
    expected = {}
    for snapshot in (1, 2):
        own = sorted((h, t) for s, h, t in rows if s == snapshot)
        total = sum(t for _, t in own)
        digits = next(d for d in range(9) if 2_000 * 16**d >= total)
        first = 0
        for prefix in sorted({h[:digits] for h, _ in own}):
            part = [(h, t) for h, t in own if h[:digits] == prefix]
            local = batches_by_rule([t for _, t in part], 100, 4)
            expected |= {(snapshot, h): first + b for (h, _), b in zip(part, local, strict=True)}
            first += max(local) + 1
    assert {(r.snapshot_id, r.content_hash): r.batch_id for r in found} == expected


@pytest.mark.parametrize(("rows", "most", "items"), [(1, 100, 4), (7, 100, 4), (60, 1_000, 50), (60, 90, 1_000)])
def test_batches_run_on_over_the_ranges_of_a_large_snapshot(spark, monkeypatch, rows, most, items):
    monkeypatch.setattr(em, "RANGE_ROWS", rows)  # up to hundreds of ranges, some smaller than a batch
    rng = random.Random(rows)
    given = [(s, f"{rng.getrandbits(64):016x}", rng.choice([0, 1, 5, 20, 90, 150])) for s in (1, 2) for _ in range(500 * s)]
    pending = spark.createDataFrame(given, "snapshot_id bigint, content_hash string, tokens int")
    expected = {}
    for snapshot in (1, 2):
        own = sorted((h, t) for s, h, t in given if s == snapshot)
        numbers = batches_by_rule([t for _, t in own], most, items)
        expected |= {(snapshot, h): b for (h, _), b in zip(own, numbers, strict=True)}
    found = em.token_batches(pending, max_tokens=most, max_items=items).collect()
    assert {(r.snapshot_id, r.content_hash): r.batch_id for r in found} == expected and len(found) == len(given)


def test_a_snapshot_of_more_than_five_million_tokens_is_batched_as_one(spark):
    given = [(1, f"{k * 2654435761 % 2**32:08x}", 1_000) for k in range(6_000)]
    pending = spark.createDataFrame(given, "snapshot_id bigint, content_hash string, tokens int")
    found = sorted((r.content_hash, r.batch_id) for r in em.token_batches(pending, max_tokens=7_000, max_items=100).collect())
    assert [b for _, b in found] == [k // 7 for k in range(6_000)]


def test_the_batch_that_goes_over_budget_is_kept(spark):
    usage = spark.createDataFrame(
        [(1, 0, 6), (1, 1, 5), (1, 2, 1), (2, 0, 10)], "snapshot_id int, batch_id int, tokens int"
    )
    kept = em.stored_batches(usage, cap=10).collect()
    assert sorted((r.snapshot_id, r.batch_id, r.used, r.over) for r in kept) == [
        (1, 0, 6, False), (1, 1, 11, True), (2, 0, 10, False),
    ]


def test_embedding_is_deterministic_and_of_unit_length(spark):
    texts = spark.createDataFrame(
        [("a", "red fox"), ("b", "red fox"), ("c", ""), ("d", "blue")],
        "content_hash string, text string",
    )
    rows = em.embed_documents(texts, em.hashed_token_vectors(8), "h").collect()
    found = {r.content_hash: np.array(r.embedding) for r in rows}
    assert np.array_equal(found["a"], found["b"]) and not np.array_equal(found["a"], found["d"])
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in found.values())


def test_the_query_of_vectors_equals_its_sql_where_texts_have_no_words_or_cancel_out(spark, tmp_path):
    signs = {}
    for k in range(5_000):  # two words of one dimension and opposite signs
        code = hashlib.md5(f"w{k}".encode()).hexdigest()
        signs.setdefault(int(code[:7], 16) % 64, {})[code[7] < "8"] = f"w{k}"
    pair = signs[9][True] + " " + signs[9][False]
    rows = [(k, t, "en", "src1") for k, t in enumerate(["", " .,- ", pair, pair + " fox", "red fox", "red fox", None, None])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    relation = con.sql(queries.ORACLES["embed_documents"])
    found = queries.embed_documents(spark, str(tmp_path)).select(*relation.columns)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, relation.fetchall()))
    assert found.count() == 6


def test_existing_vectors_are_kept(spark):
    old = vectors(spark, [("a", "m", [1.0])])
    new = vectors(spark, [("a", "m", [2.0]), ("b", "m", [3.0]), ("b", "m", [3.0]), ("a", "n", [4.0])])
    rows = em.insert_missing(old, new).collect()
    assert sorted(tuple(r) for r in rows) == [("a", "m", [1.0]), ("a", "n", [4.0]), ("b", "m", [3.0])]


def test_index_stats(spark):
    files = spark.createDataFrame(
        [
            (1, "a.py", "python", "symbols", None, 1),
            (1, "b.txt", None, "windows", None, 0),
            (1, "c.lock", None, "skipped", "ignored", 0),
        ],
        "snapshot_id int, path string, language string, mode string, skip_reason string, parse_errors int",
    )
    chunks = spark.createDataFrame([(1, "a.py"), (1, "a.py"), (1, "b.txt")], "snapshot_id int, path string")
    symbols = spark.createDataFrame(
        [(1, "a.py", "module"), (1, "a.py", "class")], "snapshot_id int, path string, kind string"
    )
    (row,) = sn.index_stats(files, chunks, symbols).collect()
    assert (row.files, row.chunks, row.files_with_parse_errors) == (3, 3, 1)
    assert row.by_mode == {"symbols": 1, "windows": 1, "skipped": 1}
    assert row.skipped == {"ignored": 1}
    assert {k: tuple(v) for k, v in row.by_language.items()} == {"python": (1, 1, 2), "text": (1, 0, 1)}


def snapshot_table(spark, rows):
    """(id, repo_id, status) rows with empty stats."""
    given = spark.createDataFrame(rows, "id bigint, repo_id bigint, status string")
    return given.withColumn("stats", F.lit("{}")).withColumn("indexed_at", F.lit(None).cast("string"))


def statuses(rows):
    """Status by id."""
    return {r.id: r.status for r in rows.collect()}


def test_activation_retires_the_active_snapshot(spark):
    rows = snapshot_table(spark, [(1, 1, "active"), (2, 1, "building"), (3, 2, "active"), (4, 2, "failed")])
    wanted = spark.createDataFrame([(2, "s", "t"), (4, "s", "t")], "id bigint, stats string, indexed_at string")
    after = sn.activate_snapshot(rows, wanted)
    assert statuses(after) == {1: "retired", 2: "active", 3: "active", 4: "failed"}
    assert after.filter("id = 2").first().stats == "s" and after.filter("id = 4").first().stats == "{}"


def test_only_building_snapshots_fail(spark):
    rows = snapshot_table(spark, [(1, 1, "active"), (2, 1, "building"), (3, 1, "building")])
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id bigint")
    assert statuses(sn.fail_snapshots(rows, ids)) == {1: "active", 2: "failed", 3: "building"}
    assert statuses(sn.fail_snapshots(rows)) == {1: "active", 2: "failed", 3: "failed"}


def test_sweep_keeps_the_newest_two_and_what_is_building(spark):
    rows = snapshot_table(
        spark,
        [(1, 1, "failed"), (2, 1, "active"), (3, 1, "retired"), (4, 1, "failed"), (5, 1, "building"),
         (6, 2, "retired")],
    )
    owned = spark.createDataFrame([(i,) for i in range(1, 7)], "snapshot_id bigint")
    kept, files, _ = sn.sweep_snapshots(rows, owned, owned)
    assert sorted(statuses(kept)) == [2, 3, 4, 5, 6]
    assert sorted(r.snapshot_id for r in files.collect()) == [2, 3, 4, 5, 6]


def test_upsert_repos(spark):
    columns = "owner string, name string, url string, summary string, suggested_questions array<string>"
    repos = spark.createDataFrame([(7, "o", "n", "u", "s", ["q"])], f"id bigint, {columns}")
    new = spark.createDataFrame(
        [("o", "n", "v", None, None, 1), ("o", "m", "w", None, None, 1), ("o", "m", "x", "t", ["r"], 2)],
        f"{columns}, requested_at int",
    )
    found = {r.name: r for r in sn.upsert_repos(repos, new).collect()}
    assert tuple(found["n"]) == (7, "o", "n", "v", "s", ["q"])
    assert (found["m"].url, found["m"].summary, found["m"].suggested_questions) == ("x", "t", ["r"])
    assert found["m"].id not in (None, 7)


def test_unchanged_requests_are_skipped(spark):
    rows = snapshot_table(spark, [(1, 1, "active"), (2, 2, "active"), (3, 3, "retired")])
    rows = rows.withColumns({"commit_sha": F.lit("abc"), "model": F.lit("m")})
    requests = spark.createDataFrame(
        [(1, "abc", "m", False), (1, "abc", "m", True), (1, "abc", "n", False), (2, "abd", "m", False),
         (3, "abc", "m", False)],
        "repo_id bigint, commit_sha string, model string, force boolean",
    )
    left = sorted(tuple(r) for r in sn.skip_unchanged(requests, rows).collect())
    assert left == [(1, "abc", "m", True), (1, "abc", "n", False), (2, "abd", "m", False), (3, "abc", "m", False)]


def test_snapshot_diff(spark):
    chunks = chunk_table(
        spark, [(1, 1, "a", 1, ""), (1, 2, "b", 1, ""), (2, 3, "b", 1, ""), (2, 4, "c", 1, ""), (3, 5, "d", 1, "")]
    )
    found = {r.content_hash: r.change for r in sn.snapshot_diff(chunks, 1, 2).collect()}
    assert found == {"a": "removed", "b": "kept", "c": "added"}


def test_a_sweep_sorts_no_files(spark):
    known = spark.range(50).selectExpr("id", "id % 5 AS repo_id", "CASE WHEN id % 3 = 0 THEN 'active' ELSE 'retired' END AS status")
    items = spark.range(500).selectExpr("id % 60 AS snapshot_id", "id AS no")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more swept ids than can be sent
    try:
        _, files, chunks = sn.sweep_snapshots(known, items, items)
        left = sorted(r.no for r in files.collect())
        plan = files._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    swept = {r.id for r in sn.swept_snapshots(known).collect()}
    assert swept and left == [k for k in range(500) if k % 60 not in swept] and chunks.count() == len(left)
    assert "SortMergeJoin" not in plan.split("Initial Plan")[0] and "ShuffledHashJoin" in plan
