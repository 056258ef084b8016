"""The three legs and their fusion: benchmark texts as questions over the documents."""

from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.operators import fts_leg as fts
from corpuscle.operators import fusion as fu
from corpuscle.operators import postings
from corpuscle.operators import symbol_leg as sl
from corpuscle.operators import vector_leg as vl
from corpuscle.plans import retrieve as rt
from corpuscle.plans.index import searchable
from corpuscle.plans.search_index import SearchIndex, store_search_index
from corpuscle.registry import adapters as ad
from corpuscle.registry.adapters import MODEL, split_sql, terms_sql
from corpuscle.registry.sql import select, view
from corpuscle.sources.tables import stored, work_path, write_partitioned

# ── The stored index ──────────────────────────────────────────────────────────

_STORED: dict[tuple[str, str], SearchIndex] = {}
_STORING = Lock()


def search_index(spark: SparkSession, sf: str) -> SearchIndex:
    """The search tables of the corpus, which the index job writes once for all searches of a session."""
    key = (spark.sparkContext.applicationId, sf)
    with _STORING:
        if key not in _STORED:
            path = work_path(spark, "search-index")
            _STORED[key] = store_search_index(ad.corpus(spark, sf), ad.vectors(spark, sf), MODEL, path)
        return _STORED[key]


# ── Symbol leg ────────────────────────────────────────────────────────────────


def candidate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of the plans, and of every page address with its path given as identifiers."""
    pages = ad.table(spark, sf, "pages").select(
        F.col("page_id").alias("query_id"),
        F.lit(2).cast("bigint").alias("snapshot_id"),
        F.col("url").alias("query"),
        F.array(F.concat(F.lit("`"), F.substring_index("url", "/", -2), F.lit("()`,"))).alias("identifiers"),
    )
    rows = ad.plans(spark, sf).drop("intent").unionByName(pages)
    return sl.candidate_identifiers(rows).select(
        "query_id", "snapshot_id", F.col("ord").cast("int").alias("ord"), "identifier"
    )


def or_terms(spark: SparkSession, sf: str) -> DataFrame:
    texts = ad.table(spark, sf, "documents").select("doc_id", "text")
    return texts.select("doc_id", F.array_join(tx.or_terms(F.col("text")), " ").alias("terms"))


def symbol_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return sl.symbol_aliases(ad.corpus(spark, sf)).select("chunk_id", "alias", "rung")


def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """The plans' identifiers that name something in the corpus."""
    aliases = sl.symbol_aliases(ad.corpus(spark, sf))
    return sl.resolve_identifiers(sl.candidate_identifiers(ad.plans(spark, sf)), aliases)


def resolve_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return identifiers(spark, sf).select("query_id", "ord", "identifier")


def exact(spark: SparkSession, sf: str) -> DataFrame:
    """Exact hits of the plans, all of them."""
    return sl.ladder_exact(identifiers(spark, sf), sl.symbol_aliases(ad.corpus(spark, sf)))


def ladder_exact(spark: SparkSession, sf: str) -> DataFrame:
    return exact(spark, sf).select("query_id", "chunk_id", "ord", "rung")


def ladder_contains(spark: SparkSession, sf: str) -> DataFrame:
    found = sl.ladder_contains(identifiers(spark, sf), ad.corpus(spark, sf), exact(spark, sf))
    return found.select("query_id", "chunk_id", "ord", "rung")


def hit_rows(hits: DataFrame) -> DataFrame:
    """Hits with rounded scores."""
    return hits.select("query_id", "leg", "rank", "chunk_id", F.round("score", 6).alias("score"))


def symbol_search(spark: SparkSession, sf: str) -> DataFrame:
    """The symbol leg over stored aliases and names."""
    _, hits = rt.search_symbols(ad.plans(spark, sf), ad.corpus(spark, sf), search_index(spark, sf))
    return hit_rows(hits)


def symbol_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The symbol leg over chunks that no index job has seen."""
    _, hits = rt.search_symbols(ad.plans(spark, sf), ad.corpus(spark, sf))
    return hit_rows(hits)


# ── Full-text leg ─────────────────────────────────────────────────────────────


def build_postings(spark: SparkSession, sf: str) -> DataFrame:
    return fts.build_postings(ad.corpus(spark, sf)).drop("snapshot_id")


def search_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The search vectors of the corpus."""
    return fts.search_rows(ad.corpus(spark, sf))


def cover_density(spark: SparkSession, sf: str) -> DataFrame:
    matches = fts.all_words(ad.plans(spark, sf), search_rows(spark, sf))
    return fts.cover_density(matches).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score")
    )


def fts_and(spark: SparkSession, sf: str) -> DataFrame:
    """All-words hits from stored postings."""
    return hit_rows(postings.search_all(ad.plans(spark, sf), search_index(spark, sf).postings))


def fts_or(spark: SparkSession, sf: str) -> DataFrame:
    """Any-word hits from stored postings."""
    _, hits = rt.search_texts(ad.plans(spark, sf), ad.corpus(spark, sf), search_index(spark, sf))
    return hit_rows(hits)


def fts_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Both kinds of full-text hits over chunks that no index job has seen."""
    and_hits, or_hits = rt.search_texts(ad.plans(spark, sf), ad.corpus(spark, sf))
    return hit_rows(and_hits.unionByName(or_hits))


def stored_postings(spark: SparkSession, sf: str) -> DataFrame:
    """How many chunks and places each term has in the stored postings, and the most it weighs in one."""
    rows = search_index(spark, sf).postings
    return rows.groupBy("term").agg(
        F.sum(F.size("chunks")).alias("chunks"), F.sum(F.size(F.flatten("places"))).alias("places"), F.max("top").alias("top")
    )


# ── Vector leg ────────────────────────────────────────────────────────────────


def asked_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The plans' vectors with their snapshot."""
    return ad.query_vectors(spark, sf).withColumn("snapshot_id", F.col("embedding").isNotNull().cast("bigint"))


def vector_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest chunks of each plan's vector."""
    chunks = ad.corpus(spark, sf).select("snapshot_id", "content_hash", "chunk_id")
    return stored(vl.vector_topk(asked_vectors(spark, sf), chunks, ad.vectors(spark, sf), MODEL), "vector")


def probed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The nearest chunks of each plan's vector by the stored cells, and how many cells it read."""
    index = search_index(spark, sf)
    return vl.probed_topk(asked_vectors(spark, sf), index.copies, index.vectors)


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return hit_rows(vector_hits(spark, sf))


def vector_topk_approx(spark: SparkSession, sf: str) -> DataFrame:
    return hit_rows(probed(spark, sf)[0])


def vector_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """The stored cells searched with whole cells as bounds: as exact as reading all vectors."""
    index = search_index(spark, sf)
    return hit_rows(vl.vector_topk_approx(asked_vectors(spark, sf), index.copies, index.vectors, tail=1.0))


def vector_probes(spark: SparkSession, sf: str) -> DataFrame:
    """How many cells each question read, of how many."""
    return probed(spark, sf)[1]


def vector_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many questions the index was asked, and whether it found at least nine of ten exact hits."""
    key = ["query_id", "chunk_id"]
    exact = vector_hits(spark, sf).select(*key)
    found = exact.join(probed(spark, sf)[0].select(*key, F.lit(1).alias("found")), key, "left")
    return found.agg(F.count_distinct("query_id").alias("questions"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


# ── Fusion ────────────────────────────────────────────────────────────────────


def legs(spark: SparkSession, sf: str) -> rt.Legs:
    """All legs of the plans."""
    return rt.search_legs(
        ad.plans(spark, sf), ad.corpus(spark, sf), ad.vectors(spark, sf),
        ad.query_vectors(spark, sf), MODEL, search_index(spark, sf),
    )


def light_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of the symbol and vector legs."""
    _, symbol = rt.search_symbols(ad.plans(spark, sf), ad.corpus(spark, sf))
    return symbol.unionByName(vector_hits(spark, sf))


def leg_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The trace with the vector leg missing."""
    found = legs(spark, sf)
    traced = {"symbol": found.symbol, "fts": found.fts, "vector": None}
    return fu.leg_trace(ad.plans(spark, sf), found.identifiers, traced, found.fts_and)


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    fused = fu.rrf_fuse(light_legs(spark, sf), ad.corpus(spark, sf))
    return fused.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "tier")


def collapse_parts(spark: SparkSession, sf: str) -> DataFrame:
    fused = fu.rrf_fuse(light_legs(spark, sf), ad.corpus(spark, sf))
    return fu.collapse_parts(fused).select("query_id", "rank", "chunk_id", "tier")


def split_hits(spark: SparkSession, sf: str) -> DataFrame:
    fused = fu.collapse_parts(fu.rrf_fuse(light_legs(spark, sf), ad.corpus(spark, sf)))
    return fu.split_hits(fused, ad.plans(spark, sf)).select("query_id", "rank", "chunk_id", "shown")


def relevance_floor(spark: SparkSession, sf: str) -> DataFrame:
    """The floor set high, so that it fires."""
    plans = ad.plans(spark, sf)
    _, symbol = rt.search_symbols(plans, ad.corpus(spark, sf))
    and_hits = fts.fts_and(plans, search_rows(spark, sf))
    verdict = fu.relevance_floor(plans, symbol, and_hits, vector_hits(spark, sf), floor=0.5)
    return verdict.withColumn("best_cosine", F.round("best_cosine", 6))


def symbol_parts(spark: SparkSession, sf: str) -> DataFrame:
    """All parts of the nearest symbols."""
    chunks = ad.corpus(spark, sf)
    hits = vector_hits(spark, sf).join(chunks, "chunk_id")
    return fu.symbol_parts(hits, chunks).select("query_id", "hit_chunk_id", "chunk_id", "part")


def stored_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship over chunks that an index job stored with their search vectors, by snapshot, but without search tables."""
    out = work_path(spark, "searchable")
    write_partitioned(searchable(ad.corpus(spark, sf)), out, "snapshot_id")
    chunks = spark.read.parquet(out).withColumn("snapshot_id", F.col("snapshot_id").cast("bigint"))
    return shown_hits(spark, sf, chunks)


def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: every plan through the three legs over the stored index to its shown hits and verdict."""
    return shown_hits(spark, sf, ad.corpus(spark, sf), search_index(spark, sf))


def shown_hits(spark: SparkSession, sf: str, chunks: DataFrame, index: SearchIndex | None = None) -> DataFrame:
    """Hits and verdicts of all plans on some chunks."""
    found = rt.hybrid_retrieve(
        ad.plans(spark, sf), chunks, ad.vectors(spark, sf), ad.query_vectors(spark, sf), MODEL, index
    )
    return found.hits.join(found.floor, "query_id").select(
        "query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "tier", "shown",
        "no_relevant_sources",
    )


QUERIES = {
    "candidate_tokens": candidate_tokens,
    "or_terms": or_terms,
    "symbol_aliases": symbol_aliases,
    "resolve_identifiers": resolve_identifiers,
    "ladder_exact": ladder_exact,
    "ladder_contains": ladder_contains,
    "symbol_search": symbol_search,
    "symbol_scan": symbol_scan,
    "build_postings": build_postings,
    "fts_and": fts_and,
    "fts_or": fts_or,
    "fts_scan": fts_scan,
    "stored_postings": stored_postings,
    "cover_density": cover_density,
    "vector_topk": vector_topk,
    "vector_topk_approx": vector_topk_approx,
    "vector_recall": vector_recall,
    "vector_bounded": vector_bounded,
    "vector_probes": vector_probes,
    "leg_trace": leg_trace,
    "rrf_fuse": rrf_fuse,
    "collapse_parts": collapse_parts,
    "split_hits": split_hits,
    "relevance_floor": relevance_floor,
    "symbol_parts": symbol_parts,
    "hybrid_retrieve": hybrid_retrieve,
    "stored_retrieve": stored_retrieve,
}

# ── Reference SQL ─────────────────────────────────────────────────────────────

_WORDS = "list_filter(regexp_split_to_array({0}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda t: t <> '')"
_SPACED = "t"
for _boundary in ("(\\p{Lu})(\\p{Lu}\\p{Ll})", "(\\p{Ll})(\\p{Lu})", "(\\p{L})(\\p{N})", "(\\p{N})(\\p{L})"):
    _SPACED = f"regexp_replace({_SPACED}, '{_boundary}', '\\1 \\2', 'g')"


def first_seen(lists: str, key: str) -> str:
    """SQL for the distinct members of a list column `l` per key, with their first position."""
    return f"""
SELECT {key}, x, min(i) AS i FROM (SELECT {key}, unnest(l) AS x,
    unnest(range(1, len(l) + 1)) AS i FROM ({lists})) GROUP BY {key}, x
"""


def candidates_sql(rows: str) -> str:
    """SQL for the identifier candidates of plans."""
    trimmed = "regexp_replace(t, '^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$', '', 'g')"
    parts = "regexp_split_to_array(c, '[^\\p{L}\\p{N}_]+')"
    expanded = f"""
SELECT query_id, snapshot_id, flatten(list_transform(list_filter(list_transform(
  list_concat(identifiers, {_WORDS.format("query")}), lambda t: {trimmed}), lambda t: t <> ''),
  lambda c: CASE WHEN len({parts}) > 1 THEN list_concat([c], {parts}) ELSE [c] END)) AS l FROM {rows}
"""
    return f"""
SELECT query_id, snapshot_id, CAST(n AS INTEGER) AS ord, x AS identifier FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, snapshot_id ORDER BY i) AS n
  FROM ({first_seen(expanded, "query_id, snapshot_id")})) WHERE n <= 32
"""


view("v_candidates", candidates_sql("v_plans"))
view(
    "v_aliases",
    """
SELECT chunk_id, alias, CAST(min(rung) AS INTEGER) AS rung FROM (
  SELECT chunk_id, qualname AS alias, 1 AS rung FROM v_corpus WHERE qualname IS NOT NULL
  UNION ALL SELECT chunk_id, name, 2 FROM v_corpus WHERE name IS NOT NULL
  UNION ALL SELECT chunk_id, array_to_string(s[i:], '.'), 3 FROM (SELECT chunk_id, s,
    unnest(range(2, len(s) + 1)) AS i FROM (SELECT chunk_id, string_split(qualname, '.') AS s
    FROM v_corpus WHERE qualname IS NOT NULL)))
GROUP BY chunk_id, alias
""",
)
view(
    "v_identifiers",
    "SELECT * FROM v_candidates WHERE identifier IN (SELECT alias FROM v_aliases)",
)
view(
    "v_exact",
    """
SELECT query_id, chunk_id, CAST(min(ord) AS INTEGER) AS ord, arg_min(rung, ord) AS rung FROM (
  SELECT query_id, ord, chunk_id, rung, min(rung) OVER (PARTITION BY query_id, ord) AS top
  FROM v_identifiers JOIN v_aliases ON alias = identifier) WHERE rung = top
GROUP BY query_id, chunk_id
""",
)
view(
    "v_contains",
    """
SELECT query_id, chunk_id, CAST(ord AS INTEGER) AS ord, CAST(4 AS INTEGER) AS rung FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, size, chunk_id) AS n FROM (
    SELECT i.query_id, c.chunk_id, min(i.ord) AS ord, length(c.name) AS size
    FROM v_identifiers i JOIN v_corpus c ON contains(c.name, i.identifier) AND c.name <> i.identifier
    WHERE NOT EXISTS (SELECT 1 FROM v_exact e WHERE e.query_id = i.query_id AND e.chunk_id = c.chunk_id)
    GROUP BY i.query_id, c.chunk_id, c.name)
)
WHERE n <= 20
""",
)
view(
    "v_symbol_hits",
    """
SELECT query_id, 'symbol' AS leg, CAST(n AS INTEGER) AS rank, chunk_id, 1.0::DOUBLE / rung AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rung = 4, ord, rung, path,
    start_line, part, chunk_id) AS n
  FROM (SELECT * FROM v_exact UNION ALL SELECT * FROM v_contains) JOIN v_corpus USING (chunk_id))
WHERE n <= 50
""",
)

_A, _B, _C = (terms_sql(f"search_{f}") for f in "abc")
view(
    "v_postings",
    f"""
SELECT chunk_id, unnest(l) AS term, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS pos,
  CAST(unnest(w) AS INTEGER) AS weight
FROM (SELECT chunk_id, list_concat(a, b, c) AS l, list_concat(list_transform(a, lambda x: 5),
    list_transform(b, lambda x: 2), list_transform(c, lambda x: 1)) AS w
  FROM (SELECT chunk_id, {_A} AS a, {_B} AS b, {_C} AS c FROM v_corpus))
""",
)
view(
    "v_and_terms",
    f"""
SELECT *, count(*) OVER (PARTITION BY query_id) AS terms FROM (SELECT DISTINCT query_id,
  unnest({terms_sql(split_sql("query"))}) AS term FROM v_plans)
""",
)
view(
    "v_any_words",
    f"""
SELECT query_id, flatten(list_transform({_WORDS.format("query")}, lambda t: list_concat(
  CASE WHEN regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+') THEN [lower(t)] ELSE [] END,
  list_transform(list_filter(regexp_split_to_array({_SPACED}, '[^\\p{{L}}\\p{{N}}]+'),
    lambda p: p <> ''), lambda p: lower(p))))) AS l FROM v_plans
""",
)
view("v_any_terms", "SELECT DISTINCT query_id, unnest(l) AS term FROM v_any_words")
view(
    "v_places",
    """
SELECT * FROM (SELECT query_id, chunk_id, term, pos, weight, terms,
    count(DISTINCT term) OVER (PARTITION BY query_id, chunk_id) AS found
  FROM v_and_terms JOIN v_postings USING (term)) WHERE found = terms
""",
)
view(
    "v_covers",
    """
SELECT query_id, chunk_id, s, min(p) AS e FROM (
  SELECT query_id, chunk_id, p, min(last) AS s FROM (
    SELECT w.query_id, w.chunk_id, w.p, w.term, w.terms, o.pos AS last
    FROM (SELECT a.query_id, a.chunk_id, a.pos AS p, a.terms, t.term FROM v_places a
      JOIN v_and_terms t ON t.query_id = a.query_id) w
    ASOF JOIN v_places o ON o.query_id = w.query_id AND o.chunk_id = w.chunk_id
      AND o.term = w.term AND w.p >= o.pos)
  GROUP BY query_id, chunk_id, p, terms HAVING count(*) = terms)
GROUP BY query_id, chunk_id, s
""",
)
view(
    "v_density",
    """
SELECT query_id, chunk_id, round(sum((n * 2.0::DOUBLE / inverse) / (e - s + 1 - n + 1)), 9) AS score
FROM (SELECT c.query_id, c.chunk_id, c.s, c.e, count(*) AS n, sum(10.0::DOUBLE / o.weight) AS inverse
  FROM v_covers c JOIN v_places o ON o.query_id = c.query_id AND o.chunk_id = c.chunk_id
    AND o.pos BETWEEN c.s AND c.e GROUP BY c.query_id, c.chunk_id, c.s, c.e)
GROUP BY query_id, chunk_id
""",
)


def ranked_sql(scored: str, leg: str, k: int) -> str:
    """SQL for the best `k` chunks per query."""
    return f"""
SELECT query_id, '{leg}' AS leg, CAST(n AS INTEGER) AS rank, chunk_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n
  FROM {scored}) WHERE n <= {k}
"""


view("v_and_hits", ranked_sql("v_density", "fts", 50))
view(
    "v_any_scores",
    """
SELECT query_id, chunk_id, round(sum(weight) * 0.2::DOUBLE, 9) AS score
FROM v_any_terms JOIN v_postings USING (term)
WHERE query_id NOT IN (SELECT query_id FROM v_and_hits) GROUP BY query_id, chunk_id
""",
)
view("v_or_hits", ranked_sql("v_any_scores", "fts", 50))
view(
    "v_cosines",
    """
SELECT query_id, chunk_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a))
  * sqrt(list_dot_product(b, b))), 9) AS score
FROM (SELECT query_id, CAST(embedding AS DOUBLE[]) AS a FROM v_query_vectors)
CROSS JOIN (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS b FROM v_corpus JOIN v_vectors USING (content_hash))
""",
)
view("v_vector_hits", ranked_sql("v_cosines", "vector", 20))
view(
    "v_light", "SELECT * FROM v_symbol_hits UNION ALL SELECT * FROM v_vector_hits"
)
view(
    "v_full",
    """
SELECT * FROM v_symbol_hits UNION ALL SELECT * FROM v_vector_hits
UNION ALL SELECT * FROM v_and_hits UNION ALL SELECT * FROM v_or_hits
""",
)


def fused_sql(hits: str) -> str:
    """SQL for reciprocal rank fusion of hits."""
    return f"""
SELECT query_id, chunk_id, score, tier, path, kind, name, qualname, part, start_line, end_line,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, priority, path, start_line, part,
    chunk_id) AS INTEGER) AS rank
FROM (SELECT query_id, chunk_id, coalesce(1.0::DOUBLE / (s + 60), 0) + coalesce(1.0::DOUBLE / (f + 60), 0)
    + coalesce(1.0::DOUBLE / (v + 60), 0) AS score,
    CASE WHEN s <= least(coalesce(f, 999), coalesce(v, 999)) THEN 0
      WHEN f <= coalesce(v, 999) THEN 1 ELSE 2 END AS priority,
    ['symbol', 'fts', 'vector'][priority + 1] AS tier
  FROM (SELECT query_id, chunk_id, min(CASE WHEN leg = 'symbol' THEN rank END) AS s,
      min(CASE WHEN leg = 'fts' THEN rank END) AS f, min(CASE WHEN leg = 'vector' THEN rank END) AS v
    FROM {hits} GROUP BY query_id, chunk_id))
JOIN v_corpus USING (chunk_id)
"""


def collapsed_sql(fused: str) -> str:
    """SQL for one hit per symbol."""
    return f"""
SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank)
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN qualname IS NOT NULL OR name
    IS NOT NULL THEN path || kind || coalesce(qualname, name) ELSE CAST(chunk_id AS VARCHAR) END
    ORDER BY rank) AS nth FROM {fused}) WHERE nth = 1
"""


def shown_sql(collapsed: str) -> str:
    """SQL for the hits that are shown."""
    return f"""
SELECT c.*, CASE WHEN rank <= 12 THEN 'full' ELSE 'index' END AS shown
FROM {collapsed} c JOIN v_plans USING (query_id)
WHERE rank <= 12 + CASE WHEN intent = 'enumerate' THEN 60 ELSE 30 END
"""


view("v_fused", fused_sql("v_light"))
view("v_collapsed", collapsed_sql("v_fused"))
view("v_fused_full", fused_sql("v_full"))
view("v_collapsed_full", collapsed_sql("v_fused_full"))


def floor_sql(floor: float) -> str:
    """SQL for the floor verdict."""
    return f"""
SELECT query_id, best_cosine, query_id NOT IN (SELECT query_id FROM v_symbol_hits)
  AND query_id NOT IN (SELECT query_id FROM v_and_hits) AND coalesce(best_cosine < {floor}, true)
  AS no_relevant_sources
FROM v_plans LEFT JOIN (SELECT query_id, max(score) AS best_cosine FROM v_vector_hits
  GROUP BY query_id) USING (query_id)
"""


def hits_sql(rows: str) -> str:
    """SQL for hits with rounded scores."""
    return select(
        f"SELECT query_id, leg, rank, chunk_id, round(score, 6) AS score FROM {rows}"
    )


ORACLES = {
    "vector_recall": select("SELECT count(*) AS questions, true AS enough FROM v_query_vectors"),
    "candidate_tokens": select(
        f"""
SELECT * FROM v_candidates UNION ALL SELECT * FROM ({candidates_sql('''(SELECT page_id AS query_id,
  CAST(2 AS BIGINT) AS snapshot_id, url AS query, ['`' || array_to_string(string_split(url, '/')[-2:], '/')
  || '()`,'] AS identifiers FROM pages)''')})
"""
    ),
    "or_terms": f"""
SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN (SELECT doc_id,
  string_agg(x, ' ' ORDER BY i) AS terms FROM ({first_seen(f'''
  SELECT doc_id, flatten(list_transform({_WORDS.format("text")}, lambda t: list_concat(
    CASE WHEN regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+') THEN [lower(t)] ELSE [] END,
    list_transform(list_filter(regexp_split_to_array({_SPACED}, '[^\\p{{L}}\\p{{N}}]+'),
      lambda p: p <> ''), lambda p: lower(p))))) AS l FROM documents''', "doc_id")})
  GROUP BY doc_id) USING (doc_id)
""",
    "symbol_aliases": select("SELECT * FROM v_aliases"),
    "resolve_identifiers": select("SELECT query_id, ord, identifier FROM v_identifiers"),
    "ladder_exact": select("SELECT * FROM v_exact"),
    "ladder_contains": select("SELECT * FROM v_contains"),
    "symbol_search": hits_sql("v_symbol_hits"),
    "build_postings": select("SELECT * FROM v_postings"),
    "fts_and": hits_sql("v_and_hits"),
    "fts_or": hits_sql("v_or_hits"),
    "cover_density": select("SELECT query_id, chunk_id, round(score, 6) AS score FROM v_density"),
    "vector_topk": hits_sql("v_vector_hits"),
    "leg_trace": select(
        """
SELECT query_id, 'symbol' AS leg, hits, CASE WHEN query_id NOT IN (SELECT query_id FROM v_identifiers)
  THEN 'skipped' WHEN hits > 0 THEN 'ok' ELSE 'empty' END AS status
FROM (SELECT p.query_id, count(h.query_id) AS hits FROM v_plans p LEFT JOIN v_symbol_hits h
  ON h.query_id = p.query_id GROUP BY 1)
UNION ALL
SELECT query_id, 'fts', hits, CASE WHEN hits = 0 THEN 'empty' WHEN query_id IN
  (SELECT query_id FROM v_and_hits) THEN 'ok' ELSE 'or_fallback' END
FROM (SELECT p.query_id, count(h.query_id) AS hits FROM v_plans p LEFT JOIN (SELECT * FROM v_and_hits
  UNION ALL SELECT * FROM v_or_hits) h ON h.query_id = p.query_id GROUP BY 1)
UNION ALL SELECT query_id, 'vector', 0, 'unavailable' FROM v_plans
"""
    ),
    "rrf_fuse": select(
        "SELECT query_id, rank, chunk_id, round(score, 6) AS score, tier FROM v_fused"
    ),
    "collapse_parts": select("SELECT query_id, rank, chunk_id, tier FROM v_collapsed"),
    "split_hits": select(
        f"SELECT query_id, rank, chunk_id, shown FROM ({shown_sql('v_collapsed')})"
    ),
    "relevance_floor": select(
        f"SELECT * REPLACE (round(best_cosine, 6) AS best_cosine) FROM ({floor_sql(0.5)})"
    ),
    "symbol_parts": select(
        """
SELECT h.query_id, h.chunk_id AS hit_chunk_id, p.chunk_id, p.part
FROM v_vector_hits h JOIN v_corpus c ON c.chunk_id = h.chunk_id
JOIN v_corpus p ON p.path = c.path AND p.kind = c.kind AND p.part > 0
  AND p.qualname IS NOT DISTINCT FROM c.qualname AND p.name IS NOT DISTINCT FROM c.name
"""
    ),
    "hybrid_retrieve": select(
        f"""
SELECT query_id, rank, chunk_id, round(score, 6) AS score, tier, shown, no_relevant_sources
FROM ({shown_sql('v_collapsed_full')}) JOIN ({floor_sql(0.25)}) USING (query_id)
"""
    ),
}
ORACLES["symbol_scan"] = ORACLES["symbol_search"]
ORACLES["vector_bounded"] = ORACLES["vector_topk"]
ORACLES["fts_scan"] = hits_sql("(SELECT * FROM v_and_hits UNION ALL SELECT * FROM v_or_hits)")
ORACLES["stored_postings"] = select(
    """
SELECT term, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS places, CAST(max(w) AS INTEGER) AS top
FROM (SELECT chunk_id, term, count(*) AS n, sum(weight) AS w FROM v_postings GROUP BY chunk_id, term) GROUP BY term
"""
)
ORACLES["stored_retrieve"] = ORACLES["hybrid_retrieve"]
