"""Parquet tables: the index of a snapshot, the query log, and intermediate results.

Rewriting a batch is idempotent, and everything is written where every executor can read it.
"""

import hashlib
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000  # target size of one written file
REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when their query has ended

_REMOVING: dict[str, tuple[int, str]] = {}  # by application: writes under way, and what the setting was before them
_LOCK = Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files, which otherwise stay until the driver happens to collect its garbage.

    Nothing reads them again: a write plans its query anew. Writes may run side by side.
    """
    key = spark.sparkContext.applicationId
    with _LOCK:
        count, before = _REMOVING.get(key, (0, ""))
        if not count:
            before = spark.conf.get(REMOVED, "false")
            spark.conf.set(REMOVED, "true")
        _REMOVING[key] = count + 1, before
    try:
        yield
    finally:
        with _LOCK:
            count, before = _REMOVING.pop(key)
            if count > 1:
                _REMOVING[key] = count - 1, before
            else:
                spark.conf.set(REMOVED, before)


def write_partitioned(
    rows: DataFrame, path: str, *keys: str, mode: str = "overwrite", spread: bool = True, compression: str | None = None
) -> None:
    """Write rows under `path`, partitioned by `keys`; only the partitions present are replaced.

    The rebalance hint lets Spark split a partition that is far larger than the others, so one
    giant repository is written by many tasks and a thousand small ones do not make small files. Rows that are dealt out
    already are written where they are (`spread` False).
    """
    dealt = rows.hint("rebalance", *[F.col(k) for k in keys]) if spread else rows
    out = dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
    with shuffles_removed(rows.sparkSession):
        (out.option("compression", compression) if compression else out).partitionBy(*keys).parquet(path)


def write_index(files: DataFrame, chunks: DataFrame, path: str) -> None:
    """Store files and chunks of snapshots under `path`, by repo and snapshot.

    A failed or repeated run replaces the same partitions, so nothing is stored twice.
    """
    write_partitioned(files, f"{path}/files", "repo", "snapshot_id")
    write_partitioned(chunks, f"{path}/chunks", "repo", "snapshot_id")


def log_queries(rows: DataFrame, path: str, run: str) -> None:
    """Log one row per request, by run and repo; a failed request has a null answer.

    A run that is repeated replaces what it wrote, so no request is logged twice.
    """
    write_partitioned(rows.withColumn("run", F.lit(run)), path, "run", "repo_id")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table."""
    return spark.read.parquet(path)


def write_bucketed(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write rows under `path` in buckets by hash of `keys`, sorted by them, so that joins on these keys need not move them."""
    name = _bucketed_name(path)
    rows.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = rows.repartition(buckets, *keys)  # one file for each bucket
    with shuffles_removed(rows.sparkSession):
        dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)


def read_bucketed(spark: SparkSession, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table that `write_bucketed` stored, in whatever session: its files are made known again with their buckets."""
    name = _bucketed_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        by = ", ".join(keys)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def _bucketed_name(path: str) -> str:
    """The table's name in the session's catalog."""
    return f"corpuscle_{hashlib.md5(path.encode()).hexdigest()}"


# ── Intermediate results ──────────────────────────────────────────────────────


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, which the cluster sets.

    A session that names none (tests, a notebook) uses its warehouse folder, which is shared as tables are.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/work").rstrip("/")


def file_system(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, if it is there."""
    place, files = file_system(spark, path)
    files.delete(place, True)


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this run's part of the shared folder, which goes with the `scratch` it was made in, or else when the
    session's JVM ends."""
    folder = f"{shared_dir(spark)}/corpuscle/{spark.sparkContext.applicationId}"
    place, files = file_system(spark, folder)
    files.deleteOnExit(place)
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    made = _SCRATCH.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Work folders made inside go at the end; what is needed of them must be stored outside by then.

    For steps that give a small result after many large ones, so that a long job does not keep them all.
    """
    made: list[str] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in made:
            delete_folder(spark, path)


def stored(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Rows written once to the shared folder and read back; under `path` when one was taken before.

    For results that several later steps read: it cuts their lineage, survives lost executors, and
    lets the planner see how large they are.
    """
    path = path or work_path(rows.sparkSession, name)
    with shuffles_removed(rows.sparkSession):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def published(spark: SparkSession, name: str, parts: Iterable[bytes]) -> str:
    """Write a file to the shared folder, part by part, and give it to all workers; returns the name by which `SparkFiles` knows it."""
    place, files = file_system(spark, work_path(spark, name))
    stream = files.create(place)
    for part in parts:
        for first in range(0, len(part), 1 << 20):
            stream.write(bytearray(part[first : first + (1 << 20)]))
    stream.close()
    spark.sparkContext.addFile(place.toString())
    return place.getName()
