"""Snapshot operators: statistics, activation, failure, sweeping, diffs, and the repo catalog.

Each takes the current tables and returns the new ones; the caller swaps them in atomically.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.lines import file_key

KEEP_SNAPSHOTS = 2  # fixed value: newest non-building snapshots that are never swept
WINDOWED_LANGUAGE = "text"  # fixed value: the language key of files that are not parsed


def index_stats(files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per snapshot: files, chunks, tallies by mode, skip reason and language, and files with
    parse errors.

    Chunks and symbols are counted per file first (both keyed as files are, so the join
    reuses that shuffle); everything else comes out of one pass with grouping sets.
    """
    key = file_key(files)
    per_file = (
        files.join(chunks.groupBy(*key).agg(F.count("*").alias("chunks")), key, "left")
        .join(
            symbols.filter("kind <> 'module'").groupBy(*key).agg(F.count("*").alias("symbols")),
            key,
            "left",
        )
        .withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("long")))
        .withColumn("symbols", F.coalesce("symbols", F.lit(0).cast("long")))
        .withColumn("reason", F.when(F.col("mode") == "skipped", F.col("skip_reason")))
        .withColumn(
            "language",
            F.when(F.col("mode") != "skipped", F.coalesce("language", F.lit(WINDOWED_LANGUAGE))),
        )
    )
    snapshot, mode, reason, language = map(F.col, ("snapshot_id", "mode", "reason", "language"))
    tallies = per_file.groupingSets(
        [[snapshot], [snapshot, mode], [snapshot, reason], [snapshot, language]],
        snapshot, mode, reason, language,
    ).agg(
        F.grouping_id().alias("set"),
        F.count("*").alias("files"),
        F.sum("chunks").alias("chunks"),
        F.sum("symbols").alias("symbols"),
        F.count_if((F.col("mode") != "skipped") & (F.col("parse_errors") > 0)).alias("errors"),
    )
    # grouping_id has one bit per key, 1 when the key is aggregated away.
    by_mode, by_reason, by_language, total = 0b011, 0b101, 0b110, 0b111
    count = F.col("files")
    counts = F.struct("files", "symbols", "chunks")
    return (
        tallies.groupBy("snapshot_id")
        .agg(
            F.max(F.when(F.col("set") == total, count)).alias("files"),
            F.max(F.when(F.col("set") == total, F.col("chunks"))).alias("chunks"),
            _tally("mode", by_mode, count).alias("by_mode"),
            _tally("reason", by_reason, count).alias("skipped"),
            _tally("language", by_language, counts).alias("by_language"),
            F.max(F.when(F.col("set") == total, F.col("errors"))).alias("files_with_parse_errors"),
        )
    )


def _tally(key: str, grouping: int, value: Column) -> Column:
    """A map from a key's values to a tally, from the rows of one grouping set."""
    entry = F.when(
        (F.col("set") == grouping) & F.col(key).isNotNull(), F.struct(F.col(key), value)
    )
    return F.map_from_entries(F.array_sort(F.collect_list(entry)))


# ── Lifecycle ─────────────────────────────────────────────────────────────────


def activate_snapshot(snapshots: DataFrame, activations: DataFrame) -> DataFrame:
    """Activate `building` snapshots (id, stats, indexed_at) and retire what was active.

    Ids that are not building change nothing. Several of one repo take effect in id order, so the
    newest stays active. The activated ids are the small side of both joins.
    """
    building = snapshots.filter("status = 'building'").select("id", "repo_id")
    turned = building.join(activations.withColumnRenamed("stats", "new_stats"), "id").select(
        "id", "repo_id", "new_stats", F.col("indexed_at").alias("new_at")
    )
    newest = turned.groupBy("repo_id").agg(F.max("id").alias("newest"))
    changed = snapshots.join(turned.drop("repo_id"), "id", "left").join(newest, "repo_id", "left")
    is_turned = F.col("new_at").isNotNull()
    status = (
        F.when(is_turned & (F.col("id") == F.col("newest")), "active")
        .when(is_turned, "retired")
        .when((F.col("status") == "active") & F.col("newest").isNotNull(), "retired")
        .otherwise(F.col("status"))
    )
    return (
        changed.withColumn("status", status)
        .withColumn("stats", F.when(is_turned, F.col("new_stats")).otherwise(F.col("stats")))
        .withColumn("indexed_at", F.coalesce("new_at", "indexed_at"))
        .select(*snapshots.columns)
    )


def fail_snapshots(snapshots: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Mark building snapshots failed: the given ids, or all of them (the restart sweep)."""
    if ids is None:
        failing = F.col("status") == "building"
        return snapshots.withColumn("status", F.when(failing, "failed").otherwise(F.col("status")))
    marked = snapshots.join(ids.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    failing = (F.col("status") == "building") & F.col("hit").isNotNull()
    return marked.withColumn(
        "status", F.when(failing, "failed").otherwise(F.col("status"))
    ).select(*snapshots.columns)


def active_snapshots(repos: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Repos with an active snapshot: id, owner, name, url, commit_sha, indexed_at."""
    active = snapshots.filter("status = 'active'").select(
        F.col("repo_id").alias("id"), F.col("id").alias("snapshot_id"), "commit_sha", "indexed_at"
    )
    return repos.select("id", "owner", "name", "url").join(active, "id")


def swept_snapshots(snapshots: DataFrame, *, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """The ids of retired and failed snapshots outside a repo's newest `keep` that are not building.

    The newest `keep` per repo are found with a limited row_number, which Spark applies before
    the shuffle, so a repo with very many snapshots stays cheap.
    """
    newest = Window.partitionBy("repo_id").orderBy(F.desc("id"))
    kept = (
        snapshots.filter("status <> 'building'")
        .withColumn("n", F.row_number().over(newest))
        .filter(F.col("n") <= keep)
        .select("id")
    )
    return snapshots.filter("status IN ('retired', 'failed')").select("id").join(kept.hint("shuffle_hash"), "id", "left_anti")


def sweep_snapshots(
    snapshots: DataFrame, files: DataFrame, chunks: DataFrame, *, keep: int = KEEP_SNAPSHOTS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of snapshots, files and chunks when the swept ones are dropped; `manifest.sweep_index` drops them from disk.

    A task holds its part of the swept ids and lets files and chunks pass; it does not sort them.
    """
    swept = swept_snapshots(snapshots, keep=keep).hint("shuffle_hash")
    gone = swept.withColumnRenamed("id", "snapshot_id").hint("shuffle_hash")
    return (
        snapshots.join(swept, "id", "left_anti"),
        files.join(gone, "snapshot_id", "left_anti"),
        chunks.join(gone, "snapshot_id", "left_anti"),
    )


# ── Catalog ───────────────────────────────────────────────────────────────────


def repo_id(owner: Column, name: Column) -> Column:
    """A stable id for a repo, from its owner and name; no counter to coordinate."""
    digest = F.sha2(F.concat_ws("/", owner, name), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def upsert_repos(repos: DataFrame, new: DataFrame) -> DataFrame:
    """Repos with the new rows merged in by (owner, name): url is refreshed, summary and
    suggested_questions only when given, the id of a known repo is kept."""
    key = ["owner", "name"]
    given = new.groupBy(*key).agg(
        F.max_by("url", "requested_at").alias("new_url"),
        F.max_by("summary", F.when(F.col("summary").isNotNull(), F.col("requested_at"))).alias(
            "new_summary"
        ),
        F.max_by(
            "suggested_questions",
            F.when(F.col("suggested_questions").isNotNull(), F.col("requested_at")),
        ).alias("new_questions"),
    )
    return repos.join(given, key, "full").select(
        F.coalesce("id", repo_id(F.col("owner"), F.col("name"))).alias("id"),
        *key,
        F.coalesce("new_url", "url").alias("url"),
        F.coalesce("new_summary", "summary").alias("summary"),
        F.coalesce("new_questions", "suggested_questions").alias("suggested_questions"),
    )


def skip_unchanged(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Index requests (repo_id, commit_sha, model, force) that need work: forced ones, and those
    whose repo is not active at that commit with vectors from that model."""
    active = snapshots.filter("status = 'active'").select(
        "repo_id",
        F.col("commit_sha").alias("active_sha"),
        F.col("model").alias("active_model"),
    )
    same = F.col("commit_sha").eqNullSafe(F.col("active_sha")) & F.col("model").eqNullSafe(
        F.col("active_model")
    )
    return requests.join(active, "repo_id", "left").filter(F.col("force") | ~same).select(
        *requests.columns
    )


def snapshot_diff(chunks: DataFrame, old_id: int, new_id: int) -> DataFrame:
    """What re-indexing changes: each distinct hash of two snapshots as added, kept or removed.

    One aggregation over both snapshots, combining copies before the shuffle; no join.
    """
    old, new = F.col("snapshot_id") == old_id, F.col("snapshot_id") == new_id
    return (
        chunks.filter(old | new)
        .groupBy("content_hash")
        .agg(F.max(old).alias("in_old"), F.max(new).alias("in_new"))
        .select(
            "content_hash",
            F.when(F.col("in_old") & F.col("in_new"), "kept")
            .when(F.col("in_new"), "added")
            .otherwise("removed")
            .alias("change"),
        )
    )


# ── Digests of hash ranges ────────────────────────────────────────────────────

FOLDER, RANGE = 2, 4  # hex digits of a content hash that name its folder and its range


def distinct_hashes(chunks: DataFrame) -> DataFrame:
    """`snapshot_id, folder, range, content_hash`: the distinct hashes of each snapshot, by their first hex digits."""
    digits = lambda n: F.substring("content_hash", 1, n)
    return chunks.select("snapshot_id", digits(FOLDER).alias("folder"), digits(RANGE).alias("range"), "content_hash").distinct()


def range_digests(hashes: DataFrame) -> DataFrame:
    """`snapshot_id, folder, range, n, digest` of `distinct_hashes`: ranges of equal content have equal digests.

    A digest adds up two independent 64-bit hashes of what is in the range, so order and batches do not matter.
    """
    total = lambda seed: F.sum(F.xxhash64("content_hash", F.lit(seed)).cast("decimal(38,0)")).cast("string")
    return hashes.groupBy("snapshot_id", "folder", "range").agg(
        F.count("*").alias("n"), F.concat_ws(":", total(1), total(2)).alias("digest")
    )


def changed_ranges(digests: DataFrame, old_id: int, new_id: int) -> DataFrame:
    """`folder, range` in which two snapshots differ."""
    side = lambda i: digests.filter(F.col("snapshot_id") == i).select("folder", "range", "n", "digest")
    old, new = side(old_id), side(new_id)
    same = old.join(new, ["folder", "range", "n", "digest"], "left_semi").select("folder", "range")
    return old.union(new).select("folder", "range").distinct().join(same, ["folder", "range"], "left_anti")


def digest_diff(hashes: DataFrame, digests: DataFrame, old_id: int, new_id: int) -> DataFrame:
    """The distinct hashes that one of two snapshots has and the other has not: `content_hash, change` (added or removed).

    Digests of ranges are compared first. Folders without a changed range are not listed, and of the others only the rows of
    changed ranges pass the scan, so the work follows the change and not the size of the snapshots. `hashes` is stored by snapshot and folder.
    """
    ranges = changed_ranges(digests, old_id, new_id)
    folders = [r.folder for r in ranges.select("folder").distinct().collect()]  # 256 at most
    here = hashes.filter(F.col("folder").isin(folders) & F.col("snapshot_id").isin(old_id, new_id))
    changed = here.join(ranges, ["folder", "range"], "left_semi")
    return snapshot_diff(changed, old_id, new_id).filter("change <> 'kept'")
