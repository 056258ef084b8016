"""The index job: a file table to chunks, vectors, statistics."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import embeddings as em
from corpuscle.operators.chunks import chunk_files
from corpuscle.operators.fts_leg import search_vector
from corpuscle.operators.lines import file_key
from corpuscle.operators.symbols import python_symbols
from corpuscle.sources.files import classify_files, route_files, utf8_gate
from corpuscle.sources.tables import write_index


@dataclass(frozen=True)
class Index:
    """The tables one index run produces."""

    files: DataFrame
    symbols: DataFrame
    chunks: DataFrame


def build_index(files: DataFrame, parsed: DataFrame | None = None) -> Index:
    """Triage, outline and chunk a file table (repo, snapshot_id, path, size_bytes, content).

    `parsed` holds the symbols that parsers found elsewhere (the files' key, `operators.symbols.SYMBOL_COLUMNS`). Python files are
    outlined here when it is not given; other files without symbols become one module each. Files of any size are indexed.
    """
    routed = route_files(utf8_gate(classify_files(files, max_kb=None)))
    symbols = parsed
    if symbols is None:
        symbols = python_symbols(routed.filter("mode = 'symbols' AND language = 'python'"))
    if "parse_errors" not in symbols.columns:
        symbols = symbols.withColumn("parse_errors", F.lit(0))
    key = [c for c in file_key(files) if c in symbols.columns]
    errors = symbols.filter("ord = 0").select(*key, "parse_errors")
    recorded = (
        routed.drop("content", "text")
        .join(errors, key, "left")
        .withColumn("parse_errors", F.coalesce("parse_errors", F.lit(0)))
    )
    chunks = chunk_files(routed.drop("content"), symbols.drop("parse_errors"))
    return Index(recorded, symbols, chunks)


def searchable(chunks: DataFrame) -> DataFrame:
    """Chunks with their search vectors (`terms`, `weights`), so that searches need not split texts again."""
    search = search_vector()
    return chunks.withColumns({"terms": search[0], "weights": search[1]})


def store_index(index: Index, path: str) -> None:
    """Write an index's files and searchable chunks under `path`, by repo and snapshot."""
    write_index(index.files, searchable(index.chunks), path)


def embed_pending(
    chunks: DataFrame, embeddings: DataFrame, embedder: em.Embedder, model: str
) -> DataFrame:
    """The vector table with every hash of the chunks embedded, whatever a snapshot holds.

    A budget is the caller's: `embed_budget` says which snapshots are over one, as a row each.
    """
    pending, _ = em.pending_embeddings(chunks, embeddings, model)
    texts = em.hash_texts(chunks, pending)
    return em.insert_missing(embeddings, em.embed_documents(texts, embedder, model))
