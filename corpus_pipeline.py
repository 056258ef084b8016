"""The training-data pipeline: documents in, token ids out.

Each stage takes what the one before it kept, is written as Parquet in the shared folder and read again, so a lost executor costs at
most a stage. All stages but the last return the columns of `documents`.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import bpe, mixing, naming, quality, simhash
from corpuscle.llm.queries import tokenizer_file
from corpuscle.llm.words import small_batches
from corpuscle.sources.tables import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scores(docs, labels).where("score >= 0.5").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return naming.without_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id in each group linked by a similarity of 0.8 or more of its sets of five-word shingles."""
    small_batches(spark)
    return simhash.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents once for each epoch that their source's target reaches."""
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every document, and digests of them and of their decoding."""
    small_batches(spark)
    path = tokenizer_file("word_bpe_49k.json")
    found = bpe.encode(docs, path, decoded=True)
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    return found.select("doc_id", "n_tokens", "ids", *digests)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]
ORACLE_SQL = None  # no SQL states the classifier, the fingerprints or the merges


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
