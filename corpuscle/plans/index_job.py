"""The whole index job over a table of files: guards, batches, vectors, budget, statistics, activation, sweep.

Everything a job writes is named by the job or by a snapshot of it. A job that was interrupted is run again with the same name: batches in its
ledger are skipped, the others are written over. Readers see a snapshot when the manifest has it as active, and before that nothing of it.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import embeddings as em
from corpuscle.operators import snapshots as sn
from corpuscle.operators.lines import file_key
from corpuscle.plans.index import build_index, searchable
from corpuscle.sources import manifest
from corpuscle.sources.files import MAX_REPO_FILES, MAX_REPO_MB, admitted, corpus_guards
from corpuscle.sources.tables import read_table, write_partitioned

BATCHES = 16
SNAPSHOT = "id bigint, repo_id bigint, repo string, status string, stats string, indexed_at string"
SYMBOLS = "repo string, snapshot_id bigint, path string, kind string, batch string"
ENTERED = -1  # the ledger's entry for snapshots that are in the manifest
VECTORS = "content_hash string, model string, embedding array<float>, job string"


@dataclass(frozen=True)
class JobReport:
    """What a job did: refused repositories, batches written this time, refused snapshots, the manifest's version."""

    refused_repos: DataFrame  # repo, files, bytes, refusal
    written: list[int]
    over_budget: DataFrame  # snapshot_id, tokens, refused
    swept: int
    version: int


def enter_building(spark: SparkSession, path: str, files: DataFrame) -> int:
    """Enter the snapshots (repo, snapshot_id) of some files as building, unless the manifest has them."""
    new = files.select("repo", F.col("snapshot_id").alias("id")).distinct()

    def change(known: DataFrame) -> DataFrame:
        fresh = new.join(known, "id", "left_anti").select(
            "id", F.xxhash64("repo").alias("repo_id"), "repo", F.lit("building").alias("status"),
            F.lit(None).cast("string").alias("stats"), F.lit(None).cast("string").alias("indexed_at"),
        )
        return known.select(*fresh.columns).unionByName(fresh)

    if manifest.manifest_version(spark, path) == 0:
        try:
            return manifest.commit_manifest(spark, path, change(spark.createDataFrame([], SNAPSHOT)), 0)
        except manifest.Conflict:  # another job was first
            pass
    return manifest.update_manifest(spark, path, change)


def write_batches(
    spark: SparkSession, files: DataFrame, path: str, job: str, *, parsed: DataFrame | None = None, batches: int = BATCHES
) -> list[int]:
    """Chunk files in batches by hash of their key, each entered in the job's ledger when it is written; gives the batches written now.

    A batch has its own folder in each snapshot, so writing it again replaces it and leaves the others.
    """
    key = file_key(files)
    own = lambda rows, b: rows.filter(F.pmod(F.xxhash64(*key), F.lit(batches)) == b)
    done = manifest.committed_batches(spark, path, job)
    written = []
    for batch in range(batches):
        if batch in done:
            continue
        index = build_index(own(files, batch), None if parsed is None else own(parsed, batch))
        stamp = F.lit(f"{job}-{batch}").alias("batch")
        write_partitioned(index.files.select("*", stamp), f"{path}/files", "repo", "snapshot_id", "batch")
        write_partitioned(searchable(index.chunks).select("*", stamp), f"{path}/chunks", "repo", "snapshot_id", "batch")
        symbols = index.symbols.filter("kind <> 'module'").select(*key, "kind", stamp)
        write_partitioned(symbols, f"{path}/symbols", "repo", "snapshot_id", "batch")
        manifest.commit_batch(spark, path, job, batch)
        written.append(batch)
    return written


def embed_job(
    spark: SparkSession, chunks: DataFrame, path: str, job: str, embedder: em.Embedder, model: str, budget: int | None
) -> DataFrame:
    """Embed what no other job has embedded, snapshots over the budget aside; gives `snapshot_id, tokens, refused`."""
    known = spark.createDataFrame([], VECTORS)
    if _exists(spark, f"{path}/embeddings"):
        known = spark.read.schema(VECTORS).parquet(f"{path}/embeddings").filter(F.col("job") != job)
    pending, _ = em.pending_embeddings(chunks, known, model)
    verdict = em.embed_budget(pending, cap=budget)
    allowed = pending.join(verdict.filter("refused"), "snapshot_id", "left_anti")
    fresh = em.embed_documents(em.hash_texts(chunks, allowed), embedder, model)
    write_partitioned(fresh.withColumn("job", F.lit(job)), f"{path}/embeddings", "job")
    return verdict


def _exists(spark: SparkSession, path: str) -> bool:
    place, files = manifest.file_system(spark, path)
    return files.exists(place)


def run_index_job(
    spark: SparkSession,
    files: DataFrame,
    path: str,
    job: str,
    *,
    parsed: DataFrame | None = None,
    batches: int = BATCHES,
    embedder: em.Embedder | None = None,
    model: str = "hashed-64",
    budget: int | None = em.SNAPSHOT_TOKENS,
    max_files: int | None = MAX_REPO_FILES,
    max_mb: float | None = MAX_REPO_MB,
    indexed_at: str = "now",
    keep: int = sn.KEEP_SNAPSHOTS,
) -> JobReport:
    """Index files (repo, snapshot_id, path, size_bytes, content) under `path`, from guards to sweep.

    Snapshot ids are unique over all repositories and grow. Repositories that a guard refuses are left out; snapshots whose new texts are over the
    token budget fail and nothing of theirs is embedded; the others are activated together, by one swap of the manifest, and what they
    push out is swept. A limit that is None refuses nothing. When every repository is refused, the manifest stays as it is, or is committed empty.
    """
    guards = corpus_guards(files, max_files=max_files, max_mb=max_mb)
    refused = guards.filter("refusal IS NOT NULL")
    wanted = admitted(files, guards)
    if wanted.isEmpty():
        none = spark.createDataFrame([], "snapshot_id bigint, tokens bigint, refused boolean")
        if manifest.manifest_version(spark, path) == 0:
            enter_building(spark, path, wanted)
        return JobReport(refused, [], none, 0, manifest.manifest_version(spark, path))
    if ENTERED not in manifest.committed_batches(spark, path, job):
        enter_building(spark, path, wanted)
        manifest.commit_batch(spark, path, job, ENTERED)
    written = write_batches(spark, wanted, path, job, parsed=parsed, batches=batches)
    ours = F.col("batch").startswith(f"{job}-")
    stored_files, chunks = (read_table(spark, f"{path}/{t}").filter(ours) for t in ("files", "chunks"))
    symbols = spark.read.schema(SYMBOLS).parquet(f"{path}/symbols").filter(ours)
    verdict = embed_job(spark, chunks, path, job, embedder or em.hashed_token_vectors(), model, budget)
    over = verdict.filter("refused")
    stats = sn.index_stats(stored_files, chunks, symbols)
    numbers = F.to_json(F.struct(*[c for c in stats.columns if c != "snapshot_id"])).alias("stats")
    ready = stats.select(F.col("snapshot_id").alias("id"), numbers, F.lit(indexed_at).alias("indexed_at"))
    ready = ready.join(over.select(F.col("snapshot_id").alias("id")), "id", "left_anti")

    def change(snapshots: DataFrame) -> DataFrame:
        failed = sn.fail_snapshots(snapshots, over.select(F.col("snapshot_id").alias("id")))
        return sn.activate_snapshot(failed, ready)

    manifest.update_manifest(spark, path, change)
    swept = manifest.sweep_index(spark, path, keep=keep, tables=("files", "chunks", "symbols"))
    return JobReport(refused, written, verdict, swept, manifest.manifest_version(spark, path))
