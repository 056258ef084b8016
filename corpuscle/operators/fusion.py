"""Fusion of the three legs: reciprocal ranks, one hit per symbol, tiers, trace and floor.

Hits travel as ids; text is joined back only for the ranks that are shown.
"""

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Leg priority, the rank constant, how many hits are shown and the cosine floor.
LEGS = ("symbol", "fts", "vector")
RRF_K = 60
FULL_HITS = 12
INDEX_LINES, INDEX_LINES_ENUMERATE = 30, 60
RELEVANCE_FLOOR = 0.25

PLACE = ("path", "kind", "name", "qualname", "part", "start_line", "end_line")


def leg_trace(
    plans: DataFrame, identifiers: DataFrame, legs: Mapping[str, DataFrame | None],
    and_hits: DataFrame,
) -> DataFrame:
    """Per query and leg: number of hits and status. A leg given as None is unavailable; symbol is
    skipped when the query names no identifier; fts says when it fell back to any word."""
    rows = []
    for leg in LEGS:
        hits = legs.get(leg)
        base = plans.select("query_id", F.lit(leg).alias("leg"))
        if hits is None:
            rows.append(
                base.withColumns(
                    {"hits": F.lit(0).cast("long"), "status": F.lit("unavailable")}
                )
            )
            continue
        counts = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
        joined = base.join(counts, "query_id", "left").withColumn(
            "hits", F.coalesce("hits", F.lit(0).cast("long"))
        )
        status = F.when(F.col("hits") > 0, "ok").otherwise("empty")
        if leg == "symbol":
            marked = identifiers.select("query_id").distinct().withColumn("mark", F.lit(1))
            status = F.when(F.col("mark").isNull(), "skipped").otherwise(status)
            joined = joined.join(marked, "query_id", "left")
        if leg == "fts":
            marked = and_hits.select("query_id").distinct().withColumn("mark", F.lit(1))
            fallback = (F.col("hits") > 0) & F.col("mark").isNull()
            status = F.when(fallback, "or_fallback").otherwise(status)
            joined = joined.join(marked, "query_id", "left")
        rows.append(
            joined.withColumn("status", status).select("query_id", "leg", "hits", "status")
        )
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def rrf_fuse(legs: DataFrame, chunks: DataFrame, *, k: int = RRF_K) -> DataFrame:
    """Chunks by summed reciprocal rank over the legs (query_id, leg, rank, chunk_id): adds the
    chunk's place, tier (the leg that ranked it best) and rank.

    Ranks become one column per leg and are added in leg order, so equal scores stay equal.
    """
    per_leg = [F.min(F.when(F.col("leg") == leg, F.col("rank"))).alias(leg) for leg in LEGS]
    terms = [F.coalesce(F.lit(1.0) / (F.col(leg) + k), F.lit(0.0)) for leg in LEGS]
    best = F.array_min(
        F.array(
            *[
                F.when(
                    F.col(leg).isNotNull(),
                    F.struct(F.col(leg).alias("rank"), F.lit(i).alias("priority")),
                )
                for i, leg in enumerate(LEGS)
            ]
        )
    )
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), "priority", "path", "start_line", "part", "chunk_id"
    )
    tiers = F.array(*map(F.lit, LEGS))
    return (
        legs.groupBy("query_id", "chunk_id")
        .agg(*per_leg)
        .withColumn("score", terms[0] + terms[1] + terms[2])
        .withColumn("priority", best["priority"])
        .join(chunks.select("chunk_id", *PLACE), "chunk_id")
        .withColumn("rank", F.row_number().over(order))
        .withColumn("tier", F.element_at(tiers, F.col("priority") + 1))
        .select("query_id", "rank", "chunk_id", "score", "tier", *PLACE)
    )


def collapse_parts(fused: DataFrame) -> DataFrame:
    """The best-ranked hit of each symbol or named section per query, ranked anew; chunks with
    neither name nor qualname stay apart."""
    qualname = F.nullif("qualname", F.lit(""))
    name = F.nullif("name", F.lit(""))
    group = (
        F.when(qualname.isNotNull(), F.struct("path", "kind", F.lit("q").alias("by"), qualname.alias("key")))
        .when(name.isNotNull(), F.struct("path", "kind", F.lit("n").alias("by"), name.alias("key")))
        .otherwise(
            F.struct(
                F.lit("").alias("path"),
                F.lit("").alias("kind"),
                F.lit("c").alias("by"),
                F.col("chunk_id").cast("string").alias("key"),
            )
        )
    )
    by_symbol = Window.partitionBy("query_id", "symbol").orderBy("rank")
    return (
        fused.withColumn("symbol", group)
        .withColumn("n", F.row_number().over(by_symbol))
        .filter("n = 1")
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        .drop("n", "symbol")
    )


def split_hits(
    fused: DataFrame,
    plans: DataFrame,
    *,
    full: int = FULL_HITS,
    index: int = INDEX_LINES,
    enumerate_: int = INDEX_LINES_ENUMERATE,
) -> DataFrame:
    """Hits that are shown: the first `full` in full, the next as one-line index entries (more of
    them for a question that asks to enumerate); adds `shown`."""
    lines = F.when(F.col("intent") == "enumerate", enumerate_).otherwise(index)
    return (
        fused.join(plans.select("query_id", "intent"), "query_id")
        .filter(F.col("rank") <= full + lines)
        .withColumn("shown", F.when(F.col("rank") <= full, "full").otherwise("index"))
        .drop("intent")
    )


def relevance_floor(
    plans: DataFrame,
    symbol_hits: DataFrame,
    and_hits: DataFrame,
    vector_hits: DataFrame,
    *,
    floor: float = RELEVANCE_FLOOR,
) -> DataFrame:
    """Per query the best cosine, and whether nothing relevant was found: no symbol hit, no
    all-words hit, and no vector at or above the floor."""
    marks = (
        symbol_hits.select("query_id", F.lit(None).cast("double").alias("cosine"))
        .unionByName(and_hits.select("query_id", F.lit(None).cast("double").alias("cosine")))
        .withColumn("exact", F.lit(True))
        .unionByName(
            vector_hits.select(
                "query_id", F.col("score").alias("cosine"), F.lit(False).alias("exact")
            )
        )
        .groupBy("query_id")
        .agg(F.max("cosine").alias("best_cosine"), F.max("exact").alias("exact"))
    )
    nothing = ~F.coalesce("exact", F.lit(False)) & (
        F.coalesce("best_cosine", F.lit(float("-inf"))) < floor
    )
    return plans.select("query_id").join(marks, "query_id", "left").select(
        "query_id", "best_cosine", nothing.alias("no_relevant_sources")
    )


def symbol_parts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every part of each hit's symbol: hits (query_id, snapshot_id, chunk_id and place) joined to
    the numbered parts with the same file, kind, qualname and name, nulls matching nulls.

    Parts are keyed by snapshot, path and kind; names are compared on top, null-safe.
    """
    hit = hits.select(
        "query_id", "snapshot_id", F.col("chunk_id").alias("hit_chunk_id"), "path", "kind",
        F.col("qualname").alias("hit_qualname"), F.col("name").alias("hit_name"),
    )
    parts = chunks.filter("part > 0")
    return hit.join(parts, ["snapshot_id", "path", "kind"]).filter(
        F.col("qualname").eqNullSafe(F.col("hit_qualname"))
        & F.col("name").eqNullSafe(F.col("hit_name"))
    ).drop("hit_qualname", "hit_name")
