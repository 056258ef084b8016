"""Streaming index: new files become chunks, new texts become vectors, a micro-batch of files at a time.

Two streams follow each other. The first cuts files into chunks; the second reads those chunks as they are committed and keeps each
content hash as keyed state (RocksDB under the checkpoint), so a batch touches the keys that it holds and nothing that was
stored before: batches cost the same however long the stream has run.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle.operators import embeddings as em
from corpuscle.plans.index import build_index
from corpuscle.sources.tables import write_partitioned

BATCH_FILES = 50  # Parquet files, each a table of source files, per commit
FILE_SCHEMA = "repo string, snapshot_id bigint, path string, size_bytes bigint, content binary"
TEXT_SCHEMA = "content_hash string, text string, batch int"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch uploads its changes, not its state
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time in which a stream is started; a stream keeps those it started with."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stream_chunks(
    spark: SparkSession, in_path: str, out_path: str, checkpoint: str, *, files_per_batch: int = BATCH_FILES
) -> StreamingQuery:
    """Index file tables that land under `in_path` (Parquet with FILE_SCHEMA) as one stream: files and chunks.

    Each micro-batch overwrites its own `batch` partition, so one that is replayed after a lost driver or executor leaves the same rows.
    """

    def commit(files: DataFrame, batch_id: int) -> None:
        stamp = F.lit(batch_id).alias("batch")
        index = build_index(files)
        write_partitioned(index.files.select("*", stamp), f"{out_path}/files", "batch")
        write_partitioned(index.chunks.select("*", stamp), f"{out_path}/chunks", "batch")

    return (
        spark.readStream.schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(in_path)
        .writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_vectors(
    spark: SparkSession,
    out_path: str,
    checkpoint: str,
    *,
    embedder: em.Embedder | None = None,
    model: str = "hashed-64",
    files_per_batch: int = BATCH_FILES,
) -> StreamingQuery:
    """Embed the texts of chunks that `stream_chunks` has written under `out_path`, each content hash once.

    Hashes are the keys of a stateful deduplication: a batch gives the texts that no batch before it had, and a replayed batch the same
    ones, because state is kept by batch. Earlier chunks and vectors are not read.
    """
    embed = embedder or em.hashed_token_vectors()

    def commit(texts: DataFrame, batch_id: int) -> None:
        fresh = em.embed_documents(texts, embed, model)
        write_partitioned(fresh.withColumn("batch", F.lit(batch_id)), f"{out_path}/embeddings", "batch")

    with _settings(spark, STATE):
        return (
            spark.readStream.schema(TEXT_SCHEMA)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(f"{out_path}/chunks")
            .select("content_hash", "text")
            .dropDuplicates(["content_hash"])
            .writeStream.foreachBatch(commit)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def stream_index(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    checkpoint: str,
    *,
    embedder: em.Embedder | None = None,
    model: str = "hashed-64",
    files_per_batch: int = BATCH_FILES,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Both streams over what has landed so far, to the end; gives them for their progress."""
    chunks = stream_chunks(spark, in_path, out_path, f"{checkpoint}/chunks", files_per_batch=files_per_batch)
    chunks.awaitTermination()
    vectors = stream_vectors(
        spark, out_path, f"{checkpoint}/vectors", embedder=embedder, model=model, files_per_batch=files_per_batch
    )
    vectors.awaitTermination()
    return chunks, vectors
