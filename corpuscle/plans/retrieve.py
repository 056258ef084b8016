"""Hybrid retrieval for a table of plans: three legs, fusion, one hit per symbol, the floor.

Each leg's hits, at most fifty per query, are written once and read by fusion, trace and floor.
"""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame

from corpuscle.operators import fts_leg, fusion, postings, symbol_leg, vector_leg
from corpuscle.plans.search_index import NAME_CHUNKS, SearchIndex
from corpuscle.sources.tables import stored


@dataclass(frozen=True)
class Legs:
    """Hits of each leg, and what the trace and the floor need to know."""

    symbol: DataFrame
    fts_and: DataFrame
    fts_or: DataFrame
    vector: DataFrame | None
    identifiers: DataFrame

    @property
    def fts(self) -> DataFrame:
        """Full-text hits: all-words ones, or the fallback's for queries without."""
        return self.fts_and.unionByName(self.fts_or)

    def hits(self) -> DataFrame:
        """All legs' hits in one table: query_id, leg, rank, chunk_id, score."""
        both = self.symbol.unionByName(self.fts)
        return both if self.vector is None else both.unionByName(self.vector)


@dataclass(frozen=True)
class Retrieval:
    """Ranked hits that are shown, the leg trace, and the floor verdict per query."""

    hits: DataFrame
    trace: DataFrame
    floor: DataFrame


def search_symbols(plans: DataFrame, chunks: DataFrame, index: SearchIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """(identifiers, hits) of the symbol leg; a stored index has the aliases, names and places that are made from the chunks otherwise."""
    candidates = symbol_leg.candidate_identifiers(plans)
    if index is None:
        asked = symbol_leg.asked_aliases(symbol_leg.symbol_aliases(chunks), candidates)
        aliases = stored(symbol_leg.top_aliases(asked), "aliases")
        grams, names, places = symbol_leg.name_grams(chunks), symbol_leg.name_chunks(chunks, k=NAME_CHUNKS), chunks
    else:
        candidates = stored(candidates, "candidates")
        aliases = stored(symbol_leg.asked_aliases(index.aliases, candidates), "aliases")
        grams, names, places = index.grams, index.names, index.places
    identifiers = stored(symbol_leg.resolve_identifiers(candidates, aliases), "identifiers")
    exact = stored(symbol_leg.ladder_exact(identifiers, aliases), "exact")
    # more than fifty exact hits fill the leg alone, so seventy chunks of an identifier are enough
    found = symbol_leg.containing_chunks(symbol_leg.containing_names(identifiers, grams), names, k=NAME_CHUNKS)
    contains = symbol_leg.first_containing(identifiers, found, exact)
    hits = symbol_leg.symbol_search(exact, contains, places)
    return identifiers, stored(hits, "symbol")


def search_texts(plans: DataFrame, chunks: DataFrame, index: SearchIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """(all-words hits, any-word hits) of the full-text leg: from stored postings, or else from the chunks' search vectors (stored ones
    when the chunks have them as `terms` and `weights`, else made once here)."""
    if index is not None:
        and_hits = stored(postings.search_all(plans, index.postings), "fts-and")
        return and_hits, stored(postings.search_any(plans, and_hits, index.postings), "fts-or")
    search = fts_leg.search_rows(chunks)
    if "terms" not in chunks.columns:
        search = stored(search, "search-rows")
    and_hits = stored(fts_leg.fts_and(plans, search), "fts-and")
    return and_hits, stored(fts_leg.fts_or(plans, and_hits, search), "fts-or")


def search_vectors(
    plans: DataFrame,
    chunks: DataFrame,
    embeddings: DataFrame | None,
    query_vectors: DataFrame | None,
    model: str,
    index: SearchIndex | None = None,
) -> DataFrame | None:
    """Hits of the vector leg; None when there are no vectors."""
    stored_vectors = index.vectors if index is not None else None
    if query_vectors is None or (embeddings is None and stored_vectors is None):
        return None
    asked = plans.select("query_id", "snapshot_id").join(query_vectors, "query_id")
    if stored_vectors is not None:
        return stored(vector_leg.indexed_topk(asked, index.copies, stored_vectors), "vector")
    return stored(vector_leg.vector_topk(asked, chunks, embeddings, model), "vector")


def search_legs(
    plans: DataFrame,
    chunks: DataFrame,
    embeddings: DataFrame | None,
    query_vectors: DataFrame | None,
    model: str,
    index: SearchIndex | None = None,
) -> Legs:
    """Run the three legs side by side; without vectors the vector leg is unavailable and the others go on."""
    with ThreadPoolExecutor(3) as pool:
        symbols = pool.submit(search_symbols, plans, chunks, index)
        texts = pool.submit(search_texts, plans, chunks, index)
        vectors = pool.submit(search_vectors, plans, chunks, embeddings, query_vectors, model, index)
        identifiers, symbol = symbols.result()
        and_hits, or_hits = texts.result()
        return Legs(symbol, and_hits, or_hits, vectors.result(), identifiers)


def hybrid_retrieve(
    plans: DataFrame,
    chunks: DataFrame,
    embeddings: DataFrame | None,
    query_vectors: DataFrame | None,
    model: str,
    index: SearchIndex | None = None,
) -> Retrieval:
    """Retrieve for every plan at once: query_id, snapshot_id, query, identifiers, intent.

    With a stored index no chunk is read but its place.
    """
    legs = search_legs(plans, chunks, embeddings, query_vectors, model, index)
    fused = fusion.collapse_parts(fusion.rrf_fuse(legs.hits(), chunks if index is None else index.places))
    traced = {"symbol": legs.symbol, "fts": legs.fts, "vector": legs.vector}
    vector = legs.symbol.limit(0) if legs.vector is None else legs.vector
    return Retrieval(
        hits=fusion.split_hits(fused, plans),
        trace=fusion.leg_trace(plans, legs.identifiers, traced, legs.fts_and),
        floor=fusion.relevance_floor(plans, legs.symbol, legs.fts_and, vector),
    )
