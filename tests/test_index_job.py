"""The manifest, the ledger, the index job from end to end, digests of hash ranges, and keyed state of the stream."""

import os
import threading
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import snapshots as sn
from corpuscle.plans import index_job as ij
from corpuscle.registry import evaluation, snapshots
from corpuscle.sources import manifest as mf
from corpuscle.sources.tables import write_partitioned
from corpuscle.streaming import indexer

ROWS = "id bigint, repo_id bigint, repo string, status string, stats string, indexed_at string"


def rows(spark, *given):
    return spark.createDataFrame([(i, r, f"r{r}", s, None, None) for i, r, s in given], ROWS)


def status(frame):
    return {r.id: r.status for r in frame.collect()}


def turn(spark, *ids):
    acts = spark.createDataFrame([(i, "{}", "now") for i in ids], "id bigint, stats string, indexed_at string")
    return lambda known: sn.activate_snapshot(known, acts)


# ── Manifest ──────────────────────────────────────────────────────────────────


def test_of_two_writers_of_one_version_one_wins(spark, tmp_path):
    path = str(tmp_path)
    assert mf.manifest_version(spark, path) == 0
    assert mf.commit_manifest(spark, path, rows(spark, (1, 1, "active"), (2, 1, "building"), (3, 1, "building")), 0) == 1
    first = mf.read_manifest(spark, path)
    mf.commit_manifest(spark, path, turn(spark, 2)(first), 1)
    with pytest.raises(mf.Conflict):
        mf.commit_manifest(spark, path, turn(spark, 3)(first), 1)
    assert status(mf.read_manifest(spark, path)) == {1: "retired", 2: "active", 3: "building"}
    assert status(mf.read_manifest(spark, path, 1)) == {1: "active", 2: "building", 3: "building"}  # readers keep what they have
    assert len(list((tmp_path / "_manifest/versions").iterdir())) == 2  # the loser's rows are gone
    assert mf.update_manifest(spark, path, turn(spark, 3)) == 3
    assert status(mf.read_manifest(spark, path)) == {1: "retired", 2: "retired", 3: "active"}
    assert mf.expire_versions(spark, path, keep=1) == 2 and mf.manifest_version(spark, path) == 3


def test_writers_at_once_all_get_in_and_readers_see_one_active_snapshot(spark, tmp_path):
    path = str(tmp_path)
    mf.commit_manifest(spark, path, rows(spark, (0, 1, "active"), *[(i, 1, "building") for i in range(1, 5)]), 0)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append([i for i, s in status(mf.read_manifest(spark, path)).items() if s == "active"])

    reader = threading.Thread(target=read)
    reader.start()
    writers = [threading.Thread(target=mf.update_manifest, args=(spark, path, turn(spark, i))) for i in range(1, 5)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    stop.set()
    reader.join()
    assert mf.manifest_version(spark, path) == 5
    assert sorted(status(mf.read_manifest(spark, path)).values()).count("active") == 1
    assert all(len(a) == 1 for a in seen)


def test_sweep_touches_the_folders_of_swept_snapshots_only(spark, tmp_path):
    path = str(tmp_path)
    names = ["a b", "x/y", "ü=1"]
    known = [(10 * r + s, r, names[r], ("retired", "failed", "retired", "active")[s], None, None) for r in range(3) for s in range(4)]
    mf.commit_manifest(spark, path, spark.createDataFrame(known, ROWS), 0)
    chunks = spark.createDataFrame([(r, i, f"t{i}") for i, _, r, *_ in known for _ in range(3)], "repo string, snapshot_id bigint, text string")
    for table in ("files", "chunks"):
        write_partitioned(chunks, f"{path}/{table}", "repo", "snapshot_id")
    before = {f: os.stat(f).st_mtime_ns for f in Path(path, "chunks").rglob("*.parquet")}
    assert mf.sweep_index(spark, path) == 6
    after = {f: os.stat(f).st_mtime_ns for f in Path(path, "chunks").rglob("*.parquet")}
    assert set(after) < set(before) and all(before[f] == t for f, t in after.items())
    left = spark.read.parquet(f"{path}/chunks").select("snapshot_id").distinct().collect()
    assert sorted(r.snapshot_id for r in left) == [2, 3, 12, 13, 22, 23]
    assert sorted(status(mf.read_manifest(spark, path))) == [2, 3, 12, 13, 22, 23]
    active = mf.read_active(spark, path, "chunks")
    assert {r.snapshot_id for r in active.collect()} == {3, 13, 23}
    write_partitioned(chunks.filter("snapshot_id = 0"), f"{path}/chunks", "repo", "snapshot_id")  # left by a lost job
    assert mf.sweep_orphans(spark, path) == 1 and mf.sweep_orphans(spark, path) == 0


# ── The job ───────────────────────────────────────────────────────────────────


def source_files(spark, snapshot, edit=""):
    given = [(f"r{r}", snapshot + r, f"m{k}.py", f"def f{k}():\n    return {k}{edit if k == 3 else ''}\n") for r in range(2) for k in range(12)]
    given += [("big", snapshot + 2, f"f{k}.txt", "word " * k) for k in range(30)]
    frame = spark.createDataFrame(given, "repo string, snapshot_id bigint, path string, text string")
    return frame.select("repo", "snapshot_id", "path", F.octet_length("text").cast("bigint").alias("size_bytes"), F.encode("text", "utf-8").alias("content"))


def chunk_rows(spark, path):
    found = spark.read.parquet(f"{path}/chunks").select("snapshot_id", "path", "chunk_id", "content_hash", "batch").collect()
    return sorted(tuple(r) for r in found)


def test_interrupted_job_goes_on_after_the_last_batch(spark, tmp_path, monkeypatch):
    files = source_files(spark, 100)
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    report = ij.run_index_job(spark, files, whole, "j", batches=4, max_files=25)
    assert report.written == [0, 1, 2, 3] and [r.repo for r in report.refused_repos.collect()] == ["big"]
    build, calls = ij.build_index, []

    def dies(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return build(*args)

    monkeypatch.setattr(ij, "build_index", dies)
    with pytest.raises(RuntimeError):
        ij.run_index_job(spark, files, broken, "j", batches=4, max_files=25)
    assert set(status(mf.read_manifest(spark, broken)).values()) == {"building"}
    assert mf.read_active(spark, broken, "chunks").count() == 0
    monkeypatch.setattr(ij, "build_index", build)
    assert ij.run_index_job(spark, files, broken, "j", batches=4, max_files=25).written == [2, 3]
    assert chunk_rows(spark, broken) == chunk_rows(spark, whole)
    assert status(mf.read_manifest(spark, broken)) == {100: "active", 101: "active"}
    again = ij.run_index_job(spark, files, broken, "j", batches=4, max_files=25)
    assert again.written == [] and chunk_rows(spark, broken) == chunk_rows(spark, whole)
    vectors = lambda p: sorted(r.content_hash for r in spark.read.parquet(f"{p}/embeddings").collect())
    assert vectors(broken) == vectors(whole) and len(set(vectors(whole))) == len(vectors(whole))


def test_next_job_embeds_what_is_new_retires_sweeps_and_keeps_to_the_budget(spark, tmp_path):
    path = str(tmp_path)
    for number in range(3):
        report = ij.run_index_job(spark, source_files(spark, 100 + 10 * number, "0" * number), path, f"j{number}", batches=2, max_files=25)
    assert status(mf.read_manifest(spark, path)) == {110: "retired", 111: "retired", 120: "active", 121: "active"}
    assert report.swept == 2
    assert {r.snapshot_id for r in spark.read.parquet(f"{path}/files").select("snapshot_id").distinct().collect()} == {110, 111, 120, 121}
    per_job = {r.job: r["count"] for r in spark.read.parquet(f"{path}/embeddings").groupBy("job").count().collect()}
    assert per_job["j1"] == per_job["j2"] < per_job["j0"]
    poor = ij.run_index_job(spark, source_files(spark, 130, "999"), path, "poor", batches=2, max_files=25, budget=3)
    assert all(r.refused for r in poor.over_budget.collect())
    assert status(mf.read_manifest(spark, path))[130] == "failed" and status(mf.read_manifest(spark, path))[120] == "active"
    stats = {r.id: r.stats for r in mf.read_manifest(spark, path).collect()}
    assert '"files":12' in stats[120]
    assert ij.run_index_job(spark, source_files(spark, 1).limit(0), path, "none").written == []


# ── Digests ───────────────────────────────────────────────────────────────────


def test_digests_find_every_change_and_read_no_other_range(spark, tmp_path):
    texts = spark.range(3_000).select(F.col("id").cast("string").alias("t"))
    old = texts.select(F.lit(1).alias("snapshot_id"), F.sha2("t", 256).alias("content_hash"))
    new = texts.filter("t <> '17'").union(spark.createDataFrame([("new",), ("5",)], "t string"))
    chunks = old.union(new.select(F.lit(2).alias("snapshot_id"), F.sha2("t", 256)))
    chunks = chunks.union(old.withColumn("snapshot_id", F.lit(3)))
    out = str(tmp_path / "hashes")
    write_partitioned(sn.distinct_hashes(chunks), out, "snapshot_id", "folder")
    hashes = spark.read.schema("range string, content_hash string, snapshot_id int, folder string").parquet(out)
    digests = sn.range_digests(hashes).cache()
    want = sorted(tuple(r) for r in sn.snapshot_diff(chunks, 1, 2).filter("change <> 'kept'").collect())
    found = sn.digest_diff(hashes, digests, 1, 2)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) == 2
    assert sn.changed_ranges(digests, 1, 2).count() == 2
    here = hashes.filter(F.col("folder").isin([h[:2] for h, _ in want]))
    assert here.select(F.input_file_name()).distinct().count() <= 6
    assert sn.digest_diff(hashes, digests, 1, 3).count() == 0
    assert sn.digest_diff(hashes, digests, 1, 9).count() == 3_000


# ── The stream ────────────────────────────────────────────────────────────────


def land(spark, folder, number):
    given = [("r", 1, f"d{number}/f{k}.txt", f"text {number} {k}\nshared line {k}\n") for k in range(4)]
    given += [("r", 1, f"d{number}/copy.txt", "one text in every batch\n")]
    frame = spark.createDataFrame(given, "repo string, snapshot_id bigint, path string, text string")
    frame = frame.select("repo", "snapshot_id", "path", F.octet_length("text").cast("bigint").alias("size_bytes"), F.encode("text", "utf-8").alias("content"))
    frame.coalesce(1).write.mode("append").parquet(folder)


def test_stream_embeds_each_text_once_and_a_replayed_batch_leaves_equal_rows(spark, tmp_path):
    landed, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for number in range(4):
        land(spark, landed, number)
    indexer.stream_index(spark, landed, out, state, files_per_batch=1)
    rows = lambda: sorted((r.content_hash, r.batch) for r in spark.read.parquet(f"{out}/embeddings").collect())
    first = rows()
    assert len(first) == len({h for h, _ in first})
    assert {h for h, _ in first} == {r.content_hash for r in spark.read.parquet(f"{out}/chunks").collect()}
    commits = sorted(Path(state, "vectors/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for f in Path(state, "vectors/commits").glob(f"*{commits[-1].name}*"):
        f.unlink()  # the last batch was written but not committed
    indexer.stream_vectors(spark, out, f"{state}/vectors", files_per_batch=1).awaitTermination()
    assert rows() == first
    for number in range(4, 6):
        land(spark, landed, number)
    _, vectors = indexer.stream_index(spark, landed, out, state, files_per_batch=1)
    later = rows()
    assert len(later) == len({h for h, _ in later}) and set(first) < set(later)
    assert {h for h, _ in later} == {r.content_hash for r in spark.read.parquet(f"{out}/chunks").collect()}
    state = vectors.lastProgress["stateOperators"][0] if isinstance(vectors.lastProgress, dict) else vectors.lastProgress.stateOperators[0]
    assert "rocksdb" in str(state).lower()


# ── Whole corpora ─────────────────────────────────────────────────────────────


def test_a_job_that_refuses_every_repository_leaves_a_manifest_to_read(spark, tmp_path):
    path = str(tmp_path)
    report = ij.run_index_job(spark, source_files(spark, 100), path, "j", max_files=1)
    assert report.written == [] and report.refused_repos.count() == 3
    assert mf.read_manifest(spark, path).count() == 0 and report.version == 1


def test_limits_of_none_refuse_nothing(spark, tmp_path):
    path = str(tmp_path)
    report = ij.run_index_job(spark, source_files(spark, 100), path, "j", batches=1, max_files=None, max_mb=None, budget=None)
    assert report.refused_repos.isEmpty() and not any(r.refused for r in report.over_budget.collect())
    assert status(mf.read_manifest(spark, path)) == {100: "active", 101: "active", 102: "active"}


def test_the_query_of_the_job_takes_repositories_of_more_files_than_the_guard_lets_in(spark, tmp_path):
    text = F.concat(F.lit("line "), F.col("id").cast("string"))
    rows = spark.range(20_001).select((F.col("id") * 20).alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"))
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.sql(snapshots.ORACLES["index_job"]).fetchall()
    assert sorted(map(tuple, snapshots.index_job(spark, str(tmp_path)).collect())) == sorted(wanted) and len(wanted) == 2


def test_the_stream_of_the_query_lands_a_file_for_every_core_and_takes_them_in_two_batches(spark, monkeypatch):
    seen = {}

    def start(session, landed, out, state, *, files_per_batch):
        seen["files"], seen["batch"] = len(session.read.parquet(landed).inputFiles()), files_per_batch
        raise RuntimeError("seen")

    monkeypatch.setattr(evaluation, "start_index", start)
    with pytest.raises(RuntimeError, match="seen"):
        evaluation.stream_index(spark, "/root/testdata/sf0.001")
    assert spark.sparkContext.defaultParallelism <= seen["files"] <= 2 * seen["batch"]
