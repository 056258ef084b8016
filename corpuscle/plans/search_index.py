"""The tables that searches read, written once by the index job.

| Table | Rows | Laid out by |
|---|---|---|
| `aliases` | what a chunk answers to, the first fifty chunks of each alias | buckets of (snapshot_id, alias) |
| `grams` | the character runs of each distinct name | buckets of (snapshot_id, gram) |
| `names` | the first chunks of each name | buckets of (snapshot_id, name) |
| `postings` | the chunks that have a term, by range of chunks | folders by hash of the term |
| `places` | path, lines and part of each chunk | buckets of chunk_id |
| `copies` | the first chunks of each content hash | buckets of (snapshot_id, content_hash) |
| `vectors` | unit vectors of distinct texts in cells, and how far the cells reach | folders by cell |

Joins on the keys of a bucketed table move the questions only.
"""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpuscle.operators import postings, symbol_leg, vector_leg
from corpuscle.operators.fusion import PLACE
from corpuscle.sources.tables import read_bucketed, stored, write_bucketed

BUCKETS = 32  # of the bucketed tables, unless the caller says otherwise; a bucket of a large corpus holds its share of it
LAID_OUT = {
    "aliases": ("snapshot_id", "alias"),
    "grams": ("snapshot_id", "gram"),
    "names": ("snapshot_id", "name"),
    "places": ("chunk_id",),
    "copies": ("snapshot_id", "content_hash"),
}
NAME_CHUNKS = symbol_leg.CONTAINS_LIMIT + symbol_leg.SYMBOL_LIMIT  # chunks of a name: more are never shown


@dataclass(frozen=True)
class SearchIndex:
    """The stored tables of an index; `vectors` is None when no vectors were stored."""

    aliases: DataFrame
    grams: DataFrame
    names: DataFrame
    places: DataFrame
    copies: DataFrame
    postings: DataFrame
    vectors: vector_leg.VectorIndex | None


def store_search_index(
    chunks: DataFrame, embeddings: DataFrame | None, model: str, path: str, *, buckets: int = BUCKETS
) -> SearchIndex:
    """Write the search tables of some chunks (and the vectors of a model, if any) under `path`; what is there is replaced.

    A chunk that is written again has the same rows, so a failed job is run again. Only the postings read the chunks' texts and search fields,
    once; the other tables read names, places and hashes, which are stored for them.
    """
    spark = chunks.sparkSession
    texts, chunks = chunks, stored(chunks.select("snapshot_id", "chunk_id", "content_hash", *PLACE), "named")
    tables = {
        "aliases": symbol_leg.top_aliases(symbol_leg.symbol_aliases(chunks)),
        "grams": symbol_leg.name_grams(chunks),
        "names": symbol_leg.name_chunks(chunks.filter("name <> ''"), k=NAME_CHUNKS),
        "places": chunks.select("snapshot_id", "chunk_id", *PLACE),
        "copies": vector_leg.first_chunks(chunks, vector_leg.VECTOR_LIMIT),
    }

    def vectors() -> None:
        first = vector_leg.first_chunks(chunks, 1)
        vector_leg.index_vectors(vector_leg.hash_vectors(first, embeddings, model), f"{path}/vectors")

    def terms() -> None:
        postings.write_postings(postings.index_postings(texts), f"{path}/postings")

    with ThreadPoolExecutor(len(tables) + 2) as pool:  # jobs of one session side by side
        jobs = [pool.submit(write_bucketed, rows, f"{path}/{name}", LAID_OUT[name], buckets) for name, rows in tables.items()]
        jobs.append(pool.submit(terms))
        if embeddings is not None:
            jobs.append(pool.submit(vectors))
        for job in jobs:
            job.result()
    return open_search_index(spark, path, vectors=embeddings is not None, buckets=buckets)


def open_search_index(spark: SparkSession, path: str, *, vectors: bool = True, buckets: int = BUCKETS) -> SearchIndex:
    """The search tables under a path."""
    tables = {name: read_bucketed(spark, f"{path}/{name}", keys, buckets) for name, keys in LAID_OUT.items()}
    cells = vector_leg.open_vectors(spark, f"{path}/vectors") if vectors else None
    terms = spark.read.schema(f"{postings.POSTINGS}, bucket int").parquet(f"{path}/postings")
    return SearchIndex(**tables, postings=terms, vectors=cells)
