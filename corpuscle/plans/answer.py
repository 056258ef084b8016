"""From retrieval to the answer: what a model is given for each question, and what is made of its reply."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import citations as ci
from corpuscle.operators import context as cx
from corpuscle.operators.fusion import symbol_parts
from corpuscle.sources.tables import stored

SENT_BLOCKS = 500_000  # blocks whose ids are sent to the chunks


def full_sources(hits: DataFrame, chunks: DataFrame, commits: DataFrame) -> DataFrame:
    """Sources of the hits shown in full (query_id, snapshot_id, rank, chunk_id, tier): the top
    one grown to the parts of its symbol that fit, every other one by itself.

    Only ids and token counts travel through the expansion; text is joined for the final blocks, and other chunks' texts do not move
    (below SENT_BLOCKS blocks, whose ids go to the chunks).
    """
    place = ["chunk_id", "path", "kind", "name", "qualname", "part"]
    top = hits.filter("rank = 1").join(chunks.select(*place), "chunk_id")
    parts = symbol_parts(
        top.filter("part > 0"),
        chunks.select(
            "snapshot_id", "path", "kind", "name", "qualname", "part", "start_line", "chunk_id",
            "tokens",
        ),
    )
    grown = cx.expand_top(top, cx.part_runs(parts)).join(
        top.select("query_id", "tier"), "query_id"
    )
    first = grown.select(
        "query_id", F.lit(1).alias("rank"), "block", "chunk_id",
        F.when(F.col("chunk_id") == F.col("hit_chunk_id"), F.col("tier")).alias("tier"),
    )
    rest = hits.filter("rank > 1").select(
        "query_id", "rank", F.lit(0).alias("block"), "chunk_id", "tier"
    )
    text = chunks.select(
        "snapshot_id", "chunk_id", "path", "kind", "name", "qualname", "start_line", "end_line",
        "text",
    )
    shown = stored(first.unionByName(rest), "blocks")
    if shown.count() <= SENT_BLOCKS:
        text = text.join(F.broadcast(shown.select("chunk_id").distinct()), "chunk_id", "left_semi")
    return cx.brief_sources(shown.join(text, "chunk_id").join(commits, "snapshot_id"))


@dataclass(frozen=True)
class Requests:
    """What is given for each question: sources in search-result order, earlier turns' first, and lines on the other hits."""

    briefed: DataFrame  # query_id, index, turn, pos, source, title, path, kind, qualname, tier, commit_sha, blocks
    lines: DataFrame  # query_id, text


def requests(hits: DataFrame, chunks: DataFrame, commits: DataFrame, history: DataFrame | None = None) -> Requests:
    """Requests from the shown hits (`fusion.split_hits` with snapshot_id): sources of the full ones, behind those that earlier turns cited
    (`history`: turn, and the columns of `briefed` but index), and one line for each hit of the index.
    """
    hits = hits.select("query_id", "snapshot_id", "rank", "chunk_id", "tier", "shown")  # places come from the chunks
    current = full_sources(hits.filter("shown = 'full'"), chunks, commits).withColumnRenamed("rank", "pos")
    if history is None:
        history = current.withColumn("turn", F.lit(None).cast("int")).limit(0)
    place = chunks.select("chunk_id", "path", "name", "qualname", "signature")
    others = hits.filter("shown = 'index'").select("query_id", "rank", "chunk_id").join(place, "chunk_id")
    return Requests(cx.replay_dedup(history, current), cx.index_lines(others))


@dataclass(frozen=True)
class Answers:
    """What is shown of the replies, and what is logged of them."""

    sources: DataFrame  # query_id, pos, source, title, path, kind, qualname, tier, start_line, end_line, excerpt, url, cited
    answers: DataFrame  # query_id, answer, retrieved, truncated, dropped, sources (a count), not_found, notes


def answers(replies: DataFrame, given: Requests, questions: DataFrame, repos: DataFrame) -> Answers:
    """Replies (query_id, answer, truncated, citations of `citations.resolve_citations`) checked against what was given.

    Cited sources get their lines, an excerpt and a link into their repository (`questions`: query_id, repo_id); an answer that found something and cites
    nothing lists the first sources of its turn, marked as not cited. A question without a reply has a null answer.
    """
    citations = replies.select("query_id", F.inline("citations"))
    standing, dropped = ci.resolve_citations(citations, given.briefed.drop("pos", "turn"))
    counted = standing.groupBy("query_id").agg(F.count("*").alias("sources"))
    offered = given.briefed.groupBy("query_id").agg(F.lit(True).alias("retrieved"))
    rows = questions.select("query_id").join(replies.select("query_id", "answer", "truncated"), "query_id", "left")
    for more in (dropped, counted, offered):
        rows = rows.join(more, "query_id", "left")
    rows = rows.fillna({"dropped": 0, "sources": 0, "retrieved": False, "truncated": False})
    rows = ci.answer_notes(ci.not_found(rows))
    bare = rows.filter("answer IS NOT NULL")
    now = given.briefed.filter("turn IS NULL").withColumnRenamed("pos", "rank")
    uncited = ci.uncited_fallback(bare, now).withColumnRenamed("rank", "pos").select(*standing.columns, "cited")
    shown = standing.withColumn("cited", F.lit(True)).unionByName(uncited)
    placed = ci.excerpts(ci.cited_spans(shown)).join(questions.select("query_id", "repo_id"), "query_id")
    return Answers(ci.permalinks(placed, repos).drop("blocks", "repo_id"), rows)


def log_rows(found: Answers, asked: DataFrame) -> DataFrame:
    """Rows for the query log: what was asked (query_id, request_id, repo_id, question, ...) with its answer, sources and verdict; a question
    whose request failed has a null answer."""
    fields = ("pos", "source", "path", "start_line", "end_line", "url", "cited")
    listed = found.sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("sources"))
    said = found.answers.select("query_id", "answer", "not_found", "notes")
    rows = asked.join(said, "query_id", "left").join(listed, "query_id", "left")
    return rows.withColumn("sources", F.coalesce("sources", F.array().cast(listed.schema["sources"].dataType)))
