"""Citation checks: which citations stand, what they cite, and what is said about the rest."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as tx

# Excerpt size, the not-found opening, the notes, sources listed when none is cited.
EXCERPT_LINES, EXCERPT_CHARS = 12, 800
NOT_FOUND = "Not found in the indexed code"
DROPPED_NOTE = "%d %s dropped: not a source that was provided."
NO_CITATIONS_NOTE = "The answer cites no sources."
TRUNCATED_NOTE = "The answer was cut off at the token limit."
UNCITED_SOURCES = 3


def resolve_citations(citations: DataFrame, briefed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, dropped) of each answer's citations (query_id, pos, search_result_index, source,
    start_block, end_block) against its briefed sources (query_id, index, source, blocks, ...).

    A citation stands when its index is that source and its block range is not empty. Standing
    ones merge per source and commit, in first-cited order, their blocks put together in line
    order; `dropped` counts the others per query.
    """
    count = F.size("blocks")
    end = F.when(F.col("end_block") < 0, count + F.col("end_block")).otherwise(F.col("end_block"))
    start = F.greatest(F.col("start_block"), F.lit(0))
    cited = F.slice("blocks", start + 1, F.greatest(F.least(end, count) - start, F.lit(0)))
    checked = citations.join(
        briefed.withColumnRenamed("index", "search_result_index"),
        ["query_id", "search_result_index", "source"],
        "left",
    ).withColumn("cited", F.coalesce(cited, F.expr("slice(blocks, 1, 0)")))
    stands = F.col("blocks").isNotNull() & (F.size("cited") > 0)
    fields = ["title", "path", "kind", "qualname", "tier"]
    in_lines = F.array_sort(
        F.transform(
            F.array_distinct(F.flatten(F.collect_list("cited"))),
            lambda b: F.struct(
                b["start_line"].alias("start_line"),
                b["end_line"].alias("end_line"),
                b["text"].alias("text"),
            ),
        )
    )
    sources = (
        checked.filter(stands)
        .groupBy("query_id", "source", "commit_sha")
        .agg(
            F.min("pos").alias("pos"),
            *[F.min_by(f, "pos").alias(f) for f in fields],
            in_lines.alias("blocks"),
        )
    )
    dropped = checked.groupBy("query_id").agg(
        F.count_if(~F.coalesce(stands, F.lit(False))).alias("dropped")
    )
    return sources, dropped


def cited_spans(sources: DataFrame) -> DataFrame:
    """Add start_line and end_line of a source's blocks, which are put in line order."""
    in_order = F.array_sort(
        "blocks",
        lambda a, b: F.when(
            a["start_line"] != b["start_line"], a["start_line"] - b["start_line"]
        ).otherwise(a["end_line"] - b["end_line"]),
    )
    return (
        sources.withColumn("blocks", in_order)
        .withColumn("start_line", F.element_at("blocks", 1)["start_line"])
        .withColumn("end_line", F.array_max(F.transform("blocks", lambda b: b["end_line"])))
    )


def excerpts(
    sources: DataFrame, *, lines: int = EXCERPT_LINES, chars: int = EXCERPT_CHARS
) -> DataFrame:
    """Add excerpt: the first lines of a source's blocks, without each block's header line."""
    bodies = F.flatten(
        F.transform(
            "blocks",
            lambda b: tx.let(
                tx.split_lines(b["text"]),
                lambda rows: F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))),
            ),
        )
    )
    return sources.withColumn(
        "excerpt", F.substring(F.array_join(F.slice(bodies, 1, lines), "\n"), 1, chars)
    )


def permalinks(sources: DataFrame, repos: DataFrame) -> DataFrame:
    """Add url: the file at its commit in its repo (repo_id, url), with a line anchor unless the
    source is a whole module; the path is percent-encoded, slashes kept."""
    encoded = F.array_join(
        F.transform(
            F.split("path", "/"),
            lambda p: F.replace(
                F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")),
                F.lit("%7E"),
                F.lit("~"),
            ),
        ),
        "/",
    )
    anchor = F.when(F.col("kind") == "module", F.lit("")).otherwise(
        F.format_string("#L%d-L%d", "start_line", "end_line")
    )
    homes = repos.select("repo_id", F.col("url").alias("repo_url"))
    return (
        sources.join(homes, "repo_id")
        .withColumn(
            "url",
            F.concat("repo_url", F.lit("/blob/"), "commit_sha", F.lit("/"), encoded, anchor),
        )
        .drop("repo_url")
    )


def not_found(answers: DataFrame) -> DataFrame:
    """Add not_found: nothing was retrieved, or the answer opens by saying so (any case, after
    spaces and markdown marks)."""
    opening = F.lower(F.regexp_replace("answer", r"\A[ \t\n*_#>]+", ""))
    says_so = F.startswith(opening, F.lit(NOT_FOUND.lower()))
    return answers.withColumn("not_found", ~F.col("retrieved") | F.coalesce(says_so, F.lit(False)))


def answer_notes(answers: DataFrame) -> DataFrame:
    """Add notes from dropped, sources (a count), not_found and truncated."""
    were = F.when(F.col("dropped") == 1, "citation was").otherwise("citations were")
    notes = F.array(
        F.when(F.col("dropped") > 0, F.format_string(DROPPED_NOTE, "dropped", were)),
        F.when((F.col("sources") == 0) & ~F.col("not_found"), NO_CITATIONS_NOTE),
        F.when(F.col("truncated"), TRUNCATED_NOTE),
    )
    return answers.withColumn("notes", F.array_compact(notes))


def uncited_fallback(
    answers: DataFrame, briefed: DataFrame, *, n: int = UNCITED_SOURCES
) -> DataFrame:
    """For answers that found something but cite nothing: the first `n` briefed sources of this
    turn (query_id, rank, ...), flagged as not cited."""
    bare = answers.filter((F.col("sources") == 0) & ~F.col("not_found")).select("query_id")
    return (
        briefed.filter(F.col("rank") <= n)
        .join(bare, "query_id", "left_semi")
        .withColumn("cited", F.lit(False))
    )
