"""Turns, replies, sources and citations over conversations, documents and retrieved hits."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.operators import citations as ci
from corpuscle.operators import context as cx
from corpuscle.operators import fusion as fu
from corpuscle.plans import answer as an
from corpuscle.plans.answer import full_sources
from corpuscle.registry import adapters as ad
from corpuscle.registry import retrieval as rr
from corpuscle.registry.adapters import table
from corpuscle.registry.sql import select, view
from corpuscle.sources.tables import stored

COMMIT = "cb74"

# ── Turns and replies ─────────────────────────────────────────────────────────


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a query log: each user turn is a question, an assistant turn directly
    after it the answer; without one the call failed."""
    said = table(spark, sf, "conversations")
    asked = said.filter("role = 'user'")
    answered = said.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(answered, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        (F.col("conv_id") % 7).alias("repo_id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conversation_id"),
        F.col("text").alias("question"),
        "answer",
    )


view(
    "v_turns",
    """
SELECT u.conv_id * 1000 + u.turn AS id, u.conv_id % 7 AS repo_id, 'c' || u.conv_id AS conversation_id,
  u.text AS question, a.text AS answer
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  AND a.role = 'assistant' WHERE u.role = 'user'
""",
)


def recent_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The last two answered turns, so that longer conversations are cut."""
    return cx.recent_turns(turns(spark, sf), n=2)


PLAN_TAILS = (
    ',"identifiers":["a.b"," ","c "],"intent":"lookup"}',
    ',"identifiers":["a.b"],"intent":',
    ',"identifiers":["a.b"],"intent":"lookup","query":1}',
    ',"identifiers":[1,"x"],"intent":"lookup"}',
    ',"identifiers":["a.b"],"intent":"guess"}',
    ',"intent":"explain"}',
    ',"identifiers":[],"intent":"enumerate"}',
    ',"identifiers":["a",null],"intent":"lookup"}',
)


def validate_plans(spark: SparkSession, sf: str) -> DataFrame:
    """A planner reply per document, well-formed for two in eight, else wrong in one way each."""
    tail = F.element_at(F.array(*map(F.lit, PLAN_TAILS)), (F.col("doc_id") % 8 + 1).cast("int"))
    member = F.when(F.expr("doc_id % 8 = 2"), F.lit("other")).otherwise(F.lit("query"))
    body = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("query"))), r"\}\z", "")
    body = F.when(member == "other", F.regexp_replace(body, r'\A\{"query"', '{"other"')).otherwise(body)
    replies = table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"),
        F.concat(F.lit("About "), "source").alias("question"),
        F.concat(body, tail).alias("reply"),
    )
    return cx.validate_plans(replies).withColumn("identifiers", F.array_join("identifiers", "|"))


SUMMARY_TAILS = (
    ',"questions":["a?"," b? ","","c?","d?","e?"]}',
    ',"questions":["a?","b?","c?"]}',
    ',"questions":["a?",1,"b?","c?","d?"]}',
    ',"questions":"a? b? c? d?"}',
    ',"questions":["a?","b?","c?","d?"]',
)


def validate_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """A summary reply per document, two in five with enough questions."""
    tail = F.element_at(F.array(*map(F.lit, SUMMARY_TAILS)), (F.col("doc_id") % 5 + 1).cast("int"))
    body = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("summary"))), r"\}\z", "")
    replies = table(spark, sf, "documents").select(
        F.col("doc_id").alias("repo_id"), F.concat(body, tail).alias("reply")
    )
    return cx.validate_summaries(replies).withColumn(
        "suggested_questions", F.array_join("suggested_questions", "|")
    )


# ── Parts and sources ─────────────────────────────────────────────────────────

PAIR = "CAST(floor(chunk_id / 6) AS STRING)"


def paired(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus with every two neighbouring symbols under one name, like getter and setter."""
    return ad.corpus(spark, sf).withColumns(
        {
            "part": F.expr("CAST(chunk_id % 3 + 1 AS INT)"),
            "kind": F.lit("method"),
            "name": F.expr(f"'p' || {PAIR}"),
            "qualname": F.expr(f"'src.p' || {PAIR}"),
        }
    )


def all_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs around every chunk taken as a hit."""
    chunks = paired(spark, sf)
    hits = chunks.withColumn("query_id", F.col("chunk_id"))
    return cx.part_runs(fu.symbol_parts(hits, chunks))


def part_runs(spark: SparkSession, sf: str) -> DataFrame:
    return all_runs(spark, sf).select("query_id", "chunk_id", "run")


def expand_top(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk taken as the top hit, with a budget that some runs exceed."""
    top = paired(spark, sf).select("chunk_id", F.col("chunk_id").alias("query_id"))
    return cx.expand_top(top, all_runs(spark, sf), budget=2_000).select(
        "query_id", "block", "chunk_id"
    )


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """The vector leg's hits as retrieved ones."""
    return rr.vector_hits(spark, sf).select(
        "query_id", F.col("score").isNotNull().cast("bigint").alias("snapshot_id"), "rank", "chunk_id",
        F.lit("vector").alias("tier"),
    )


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """The commit of each snapshot of the corpus."""
    snapshots = ad.corpus(spark, sf).select("snapshot_id").distinct()
    return snapshots.withColumn("commit_sha", F.lit(COMMIT))


def briefed(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of the first twelve hits of each query."""
    shown = hits(spark, sf).filter("rank <= 12")
    return full_sources(shown, ad.corpus(spark, sf), commits(spark, sf))


def brief_sources(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    return briefed(spark, sf).select(
        "query_id", "rank", "source", "title", F.size("blocks").alias("n"), "tier",
        tx.content_hash(texts).alias("text_hash"),
    )


def placed(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Hits with their chunk's place and key."""
    chunks = ad.corpus(spark, sf).select(
        "chunk_id", "path", "kind", "name", "qualname", "start_line", "end_line", "signature", "text",
        F.format_string("%s:%d-%d", "path", "start_line", "end_line").alias("source"),
    )
    return rows.join(chunks, "chunk_id")


def replay_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of this turn, after each hit of the symbol leg was cited in an earlier turn."""
    now = placed(spark, sf, hits(spark, sf)).select("query_id", F.col("rank").alias("pos"), "source")
    _, symbol = rr.rt.search_symbols(ad.plans(spark, sf), ad.corpus(spark, sf))
    before = placed(spark, sf, symbol).select(
        "query_id", F.col("rank").alias("turn"), F.lit(0).alias("pos"), "source"
    )
    return cx.replay_dedup(before, now).select("query_id", "turn", "source", "index")


def index_lines(spark: SparkSession, sf: str) -> DataFrame:
    return cx.index_lines(placed(spark, sf, hits(spark, sf)))


# ── Citations ─────────────────────────────────────────────────────────────────


def two_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The first twelve hits as sources of two blocks each, by search-result index."""
    def block(text: Column, start: int) -> Column:
        return F.struct(
            text.alias("text"),
            (F.col("start_line") + start).alias("start_line"),
            (F.col("start_line") + start + 19).alias("end_line"),
        )

    head, tail = F.substring("text", 1, 200), F.substring("text", F.lit(201), F.length("text"))
    rows = placed(spark, sf, hits(spark, sf).filter("rank <= 12"))
    return rows.select(
        "query_id", "rank", (F.col("rank") - 1).alias("index"), "source", F.lit(COMMIT).alias("commit_sha"),
        F.coalesce("name", "path").alias("title"), "path", "kind", "qualname", "tier",
        F.array(block(head, 0), block(tail, 20)).alias("blocks"),
    )


def cited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(sources, dropped): each source cited twice, some under a wrong index or an empty range."""
    given = two_blocks(spark, sf)
    citations = given.select(
        "query_id", "rank", "index", "source", F.explode(F.array(F.lit(0), F.lit(1))).alias("j")
    ).select(
        "query_id",
        (F.lit(30) - F.col("rank") * 2 + F.col("j")).alias("pos"),
        F.expr("index + CASE WHEN rank % 5 = 0 THEN 1 ELSE 0 END").alias("search_result_index"),
        "source",
        F.expr("CASE WHEN rank % 3 = 0 THEN -1 ELSE j END").alias("start_block"),
        F.expr("CASE WHEN rank % 4 = 0 THEN j WHEN rank % 4 = 1 THEN 9 ELSE j + 1 END").alias("end_block"),
    )
    return ci.resolve_citations(citations, given)


def resolve_citations(spark: SparkSession, sf: str) -> DataFrame:
    sources, dropped = cited(spark, sf)
    lines = F.transform("blocks", lambda b: b["start_line"]).cast("string")
    return sources.select("query_id", "source", "pos", lines.alias("lines")).join(dropped, "query_id")


def cited_spans(spark: SparkSession, sf: str) -> DataFrame:
    sources, _ = cited(spark, sf)
    return ci.cited_spans(sources).select("query_id", "source", "start_line", "end_line")


def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    sources, _ = cited(spark, sf)
    return ci.excerpts(sources).select("query_id", "source", "excerpt")


def permalinks(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the cited sources, under paths that need escaping."""
    sources, _ = cited(spark, sf)
    repos = ad.table(spark, sf, "region").select(
        F.col("r_regionkey").cast("bigint").alias("repo_id"),
        F.concat(F.lit("https://example.com/"), "r_name").alias("url"),
    )
    rows = ci.cited_spans(sources).withColumns(
        {
            "repo_id": F.col("query_id") % 5,
            "path": F.concat(F.lit("a b/#~*ü+/"), F.col("path")),
        }
    )
    return ci.permalinks(rows, repos).select("query_id", "source", "url")


ANSWER = """
CASE turn % 4 WHEN 1 THEN '**Not found in the Indexed Code.** ' || text
WHEN 2 THEN text || ' Not found in the indexed code.' WHEN 3 THEN '# > _not found in the indexed code'
ELSE text END
"""


def not_found(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.expr(ANSWER).alias("answer"), F.expr("conv_id % 5 <> 0").alias("retrieved")
    )
    return ci.not_found(answers).select("conv_id", "turn", "not_found")


def answer_notes(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "events").select(
        "event_id",
        F.expr("event_id % 3").alias("dropped"),
        F.expr("event_id % 2").alias("sources"),
        (F.col("event_type") == "error").alias("not_found"),
        (F.col("value") > 50).alias("truncated"),
    )
    return ci.answer_notes(answers).select("event_id", F.array_join("notes", "|").alias("notes"))


def uncited_fallback(spark: SparkSession, sf: str) -> DataFrame:
    answers = ad.plans(spark, sf).select(
        "query_id",
        F.expr("CASE WHEN intent = 'lookup' THEN 1 ELSE 0 END").alias("sources"),
        F.expr("query_id % 5 = 0").alias("not_found"),
    )
    return ci.uncited_fallback(answers, two_blocks(spark, sf)).select(
        "query_id", "rank", "source", "cited"
    )


# ── The answer path ───────────────────────────────────────────────────────────

REPLY = """
CASE WHEN query_id % 7 = 0 THEN 'Not found in the indexed code: ' || query ELSE 'It is so: ' || query END
"""


def given(spark: SparkSession, sf: str) -> an.Requests:
    """What every plan is given after hybrid retrieval over the stored index."""
    chunks, plans, index = ad.corpus(spark, sf), ad.plans(spark, sf), rr.search_index(spark, sf)
    found = rr.rt.hybrid_retrieve(plans, chunks, None, ad.query_vectors(spark, sf), ad.MODEL, index)
    hits = found.hits.join(plans.select("query_id", "snapshot_id"), "query_id")
    return an.requests(stored(hits, "shown"), chunks, commits(spark, sf))


def answered(spark: SparkSession, sf: str) -> tuple[an.Answers, DataFrame]:
    """Replies that cite the first block of each source, every third of them under a wrong index; every fifth question cites nothing."""
    requests = given(spark, sf)
    requests = an.Requests(stored(requests.briefed, "briefed"), requests.lines)
    plans = ad.plans(spark, sf)
    cited = requests.briefed.filter("query_id % 5 <> 1").groupBy("query_id").agg(
        F.collect_list(
            F.struct(
                F.col("pos").cast("int").alias("pos"),
                F.expr("CAST(index + CASE WHEN pos % 3 = 0 THEN 1000 ELSE 0 END AS INT)").alias("search_result_index"),
                "source", F.lit(0).alias("start_block"), F.lit(1).alias("end_block"),
            )
        ).alias("citations")
    )
    replies = plans.select("query_id", F.expr(REPLY).alias("answer"), F.expr("query_id % 4 = 0").alias("truncated"))
    none = F.array().cast(cited.schema["citations"].dataType)
    replies = replies.join(cited, "query_id", "left").withColumn("citations", F.coalesce("citations", none))
    repos = ad.table(spark, sf, "region").select(
        F.col("r_regionkey").cast("bigint").alias("repo_id"), F.concat(F.lit("https://example.com/"), "r_name").alias("url")
    )
    asked = plans.select("query_id", (F.col("query_id") % 5).alias("repo_id"), F.col("query").alias("question"))
    return an.answers(replies, requests, asked, repos), asked


def answer_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The sources that are shown with every answer, from question to link."""
    found, _ = answered(spark, sf)
    return found.sources.select("query_id", "pos", "source", "start_line", "end_line", "cited", "url")


def answer_log(spark: SparkSession, sf: str) -> DataFrame:
    """What is logged of every answer."""
    found, asked = answered(spark, sf)
    rows = an.log_rows(found, asked)
    return rows.select(
        "query_id", "repo_id", "answer", "not_found", F.array_join("notes", "|").alias("notes"), F.size("sources").alias("sources"),
        F.array_join(F.transform("sources", lambda s: s["source"]), " ").alias("listed"),
    )


def request_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines on hits that are not given in full."""
    return given(spark, sf).lines


QUERIES = {
    "answer_sources": answer_sources,
    "answer_log": answer_log,
    "request_lines": request_lines,
    "recent_turns": recent_turns,
    "validate_plans": validate_plans,
    "validate_summaries": validate_summaries,
    "part_runs": part_runs,
    "expand_top": expand_top,
    "brief_sources": brief_sources,
    "replay_dedup": replay_dedup,
    "index_lines": index_lines,
    "resolve_citations": resolve_citations,
    "cited_spans": cited_spans,
    "excerpts": excerpts,
    "permalinks": permalinks,
    "not_found": not_found,
    "answer_notes": answer_notes,
    "uncited_fallback": uncited_fallback,
}

# ── Reference SQL ─────────────────────────────────────────────────────────────

NL = "chr(10)"
view(
    "v_paired",
    """
SELECT chunk_id, CAST(chunk_id % 3 + 1 AS INTEGER) AS part, chunk_id // 6 AS pair, tokens, start_line
FROM v_corpus
""",
)
view(
    "v_runs",
    """
SELECT h.chunk_id AS query_id, c.chunk_id, c.tokens, CAST(sum(CAST(c.part = 1 AS INTEGER)) OVER (
  PARTITION BY h.chunk_id ORDER BY c.start_line, c.part, c.chunk_id) AS INTEGER) AS run
FROM v_paired h JOIN v_paired c ON c.pair = h.pair
""",
)


def grow_sql(runs: str, recursive: str, budget: int) -> str:
    """SQL that grows the hit of each run: one row per round, parts after first, then before."""
    view(
        f"v_start_{recursive}",
        f"""
SELECT query_id, list(chunk_id ORDER BY chunk_id) AS ids, list(tokens ORDER BY chunk_id) AS toks,
  list_position(ids, query_hit) AS lo, list_position(ids, query_hit) AS hi,
  CAST(toks[lo] AS BIGINT) AS used FROM {runs} GROUP BY query_id, query_hit, run
HAVING list_contains(ids, query_hit)
""",
    )
    view(
        f"r_{recursive}",
        f"""
SELECT *, 0 AS round FROM v_start_{recursive}
UNION ALL
SELECT query_id, ids, toks, CASE WHEN fits THEN lo - 1 ELSE lo END, hi,
  CASE WHEN fits THEN used + toks[lo - 1] ELSE used END, round + 1
FROM (SELECT *, lo > 1 AND used + coalesce(toks[lo - 1], 0) <= {budget} AS fits FROM (
  SELECT query_id, ids, toks, lo, CASE WHEN fits THEN hi + 1 ELSE hi END AS hi,
    CASE WHEN fits THEN used + toks[hi + 1] ELSE used END AS used, round
  FROM (SELECT *, hi < len(ids) AND used + coalesce(toks[hi + 1], 0) <= {budget} AS fits
    FROM r_{recursive} WHERE round < len(ids))))
""",
    )
    view(
        f"v_{recursive}",
        f"""
SELECT query_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS block, unnest(l) AS chunk_id
FROM (SELECT query_id, ids[lo:hi] AS l FROM r_{recursive} WHERE round = len(ids))
""",
    )
    return f"v_{recursive}"


view("v_all_runs", "SELECT *, query_id AS query_hit FROM v_runs")
GROWN_ALL = grow_sql("v_all_runs", "grown_all", 2000)
view(
    "v_top",
    """
SELECT h.query_id, h.chunk_id AS query_hit, c.* EXCLUDE (chunk_id) FROM v_vector_hits h
JOIN v_corpus c ON c.chunk_id = h.chunk_id WHERE rank = 1
""",
)
view(
    "v_top_runs",
    """
SELECT t.query_id, t.query_hit, c.chunk_id, c.tokens, 1 AS run FROM v_top t JOIN v_corpus c
  ON t.part > 0 AND c.part > 0 AND c.path = t.path AND c.kind = t.kind AND c.qualname = t.qualname
UNION ALL SELECT query_id, query_hit, query_hit, tokens, 1 FROM v_top WHERE part = 0
""",
)
GROWN_TOP = grow_sql("v_top_runs", "grown_top", 4000)
view(
    "v_blocks",
    f"""
SELECT query_id, 1 AS rank, block, chunk_id FROM {GROWN_TOP}
UNION ALL SELECT query_id, rank, 0, chunk_id FROM v_vector_hits WHERE rank BETWEEN 2 AND 12
""",
)
view(
    "v_placed",
    """
SELECT h.query_id, h.rank, h.chunk_id, c.path, c.kind, c.name, c.qualname, c.signature, c.text,
  c.start_line, c.path || ':' || c.start_line || '-' || c.end_line AS source
FROM v_vector_hits h JOIN v_corpus c ON c.chunk_id = h.chunk_id
""",
)
view(
    "v_history",
    """
SELECT h.query_id, h.rank AS turn, CAST(0 AS INTEGER) AS pos,
  c.path || ':' || c.start_line || '-' || c.end_line AS source
FROM v_symbol_hits h JOIN v_corpus c ON c.chunk_id = h.chunk_id 
""",
)
view(
    "v_citations",
    """
SELECT query_id, rank, source, j, 30 - rank * 2 + j AS pos, rank % 5 = 0 AS wrong,
  greatest(CASE WHEN rank % 3 = 0 THEN -1 ELSE j END, 0) AS first,
  least(CASE WHEN rank % 4 = 0 THEN j WHEN rank % 4 = 1 THEN 9 ELSE j + 1 END, 2) AS past,
  start_line, path, kind, text
FROM v_placed CROSS JOIN (VALUES (0), (1)) AS js(j) WHERE rank <= 12
""",
)
view(
    "v_cited_blocks",
    """
SELECT DISTINCT query_id, source, path, kind, start_line AS base, text, b,
  start_line + b * 20 AS top, start_line + b * 20 + 19 AS bottom
FROM (SELECT *, unnest(range(first, past)) AS b FROM v_citations WHERE NOT wrong)
""",
)
view(
    "v_spans",
    """
SELECT query_id, source, path, kind, CAST(min(top) AS INTEGER) AS start_line,
  CAST(max(bottom) AS INTEGER) AS end_line FROM v_cited_blocks GROUP BY ALL
""",
)

ORACLES = {
    "recent_turns": select(
        """
SELECT id, repo_id, conversation_id, question, answer, CAST(row_number() OVER (
  PARTITION BY repo_id, conversation_id ORDER BY id) AS INTEGER) AS turn
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, conversation_id ORDER BY id DESC) AS back
  FROM v_turns WHERE answer IS NOT NULL) WHERE back <= 2
"""
    ),
    "validate_plans": f"""
SELECT doc_id AS query_id, CASE WHEN ok THEN trimmed ELSE 'About ' || source END AS query,
  CASE WHEN ok AND doc_id % 8 = 0 THEN 'a.b|c' ELSE '' END AS identifiers,
  CASE WHEN NOT ok THEN 'explain' WHEN doc_id % 8 = 0 THEN 'lookup' ELSE 'enumerate' END AS intent,
  CASE WHEN ok THEN 'ok' ELSE 'fallback' END AS planner
FROM (SELECT *, doc_id % 8 IN (0, 6) AND trimmed <> '' AS ok FROM (SELECT *, regexp_replace(text,
  '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g') AS trimmed
  FROM documents))
""",
    "validate_summaries": f"""
SELECT doc_id AS repo_id, trimmed AS summary, 'a?|b?|c?|d?' AS suggested_questions
FROM (SELECT *, regexp_replace(text,
  '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g') AS trimmed
  FROM documents) WHERE doc_id % 5 IN (0, 2) AND trimmed <> ''
""",
    "part_runs": select("SELECT query_id, chunk_id, run FROM v_runs"),
    "expand_top": select(f"SELECT query_id, block, chunk_id FROM {GROWN_ALL}"),
    "brief_sources": select(
        f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, arg_min(path, block) || CASE WHEN arg_min(kind, block)
  = 'module' THEN '' ELSE ':' || arg_min(start_line, block) || '-' || arg_max(end_line, block) END
  AS source, coalesce(arg_min(qualname, block), arg_min(path, block)) AS title,
  CAST(count(*) AS INTEGER) AS n, 'vector' AS tier,
  sha256(string_agg(text, {NL} ORDER BY block)) AS text_hash
FROM v_blocks JOIN v_corpus USING (chunk_id) GROUP BY query_id, rank
"""
    ),
    "replay_dedup": select(
        """
SELECT * EXCLUDE (pos), CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn NULLS LAST, pos) - 1 AS INTEGER)
  AS index FROM (SELECT query_id, turn, source, pos FROM v_history
  UNION ALL SELECT query_id, NULL, source, rank FROM v_placed p WHERE NOT EXISTS (
    SELECT 1 FROM v_history h WHERE h.query_id = p.query_id AND h.source = p.source))
"""
    ),
    "index_lines": select(
        f"""
SELECT query_id, '{cx.INDEX_HEADER}' || {NL} || string_agg(path || coalesce(' :: ' || coalesce(qualname, name), '')
  || coalesce(' — ' || signature, ''), {NL} ORDER BY rank) AS text FROM v_placed GROUP BY query_id
"""
    ),
    "resolve_citations": select(
        """
SELECT query_id, source, CAST(min(pos) AS INTEGER) AS pos, any_value(l.lines) AS lines,
  any_value(dropped) AS dropped
FROM v_citations JOIN (SELECT query_id, source, CAST(list(top ORDER BY top) AS VARCHAR) AS lines
  FROM v_cited_blocks GROUP BY ALL) l USING (query_id, source)
JOIN (SELECT query_id, count(CASE WHEN wrong OR past <= first THEN 1 END) AS dropped FROM v_citations
  GROUP BY query_id) USING (query_id)
WHERE NOT wrong AND past > first GROUP BY query_id, source
"""
    ),
    "cited_spans": select("SELECT query_id, source, start_line, end_line FROM v_spans"),
    "excerpts": select(
        f"""
SELECT query_id, source, left(array_to_string(list_slice(flatten(list(
  list_slice(string_split(regexp_replace(CASE b WHEN 0 THEN left(text, 200) ELSE substr(text, 201) END,
    '\\n$', ''), {NL}), 2, 9999) ORDER BY b)), 1, 12), {NL}), 800) AS excerpt
FROM v_cited_blocks GROUP BY query_id, source
"""
    ),
    "permalinks": select(
        """
SELECT query_id, source, 'https://example.com/' || r_name || '/blob/cb74/a%20b/%23~%2A%C3%BC%2B/' || path
  || CASE WHEN kind = 'module' THEN '' ELSE '#L' || start_line || '-L' || end_line END AS url
FROM v_spans JOIN region ON r_regionkey = query_id % 5
"""
    ),
    "not_found": f"""
SELECT conv_id, turn, conv_id % 5 = 0 OR starts_with(lower(ltrim(answer, ' *_#>' || chr(9) || {NL})),
  'not found in the indexed code') AS not_found
FROM (SELECT *, {ANSWER} AS answer FROM conversations)
""",
    "answer_notes": """
SELECT event_id, concat_ws('|', CASE event_id % 3
  WHEN 1 THEN '1 citation was dropped: not a source that was provided.'
  WHEN 2 THEN '2 citations were dropped: not a source that was provided.' END,
  CASE WHEN event_id % 2 = 0 AND event_type <> 'error' THEN 'The answer cites no sources.' END,
  CASE WHEN value > 50 THEN 'The answer was cut off at the token limit.' END) AS notes FROM events
""",
    "uncited_fallback": select(
        """
SELECT query_id, rank, source, false AS cited FROM v_placed JOIN v_plans USING (query_id)
WHERE rank <= 3 AND intent <> 'lookup' AND query_id % 5 <> 0
"""
    ),
}

view("v_shown", f"SELECT * FROM ({rr.shown_sql('v_collapsed_full')})")
view(
    "v_full_top",
    """
SELECT h.query_id, h.chunk_id AS query_hit, c.* EXCLUDE (chunk_id) FROM v_shown h
JOIN v_corpus c ON c.chunk_id = h.chunk_id WHERE h.rank = 1
""",
)
view(
    "v_full_top_runs",
    """
SELECT t.query_id, t.query_hit, c.chunk_id, c.tokens, 1 AS run FROM v_full_top t JOIN v_corpus c
  ON t.part > 0 AND c.part > 0 AND c.path = t.path AND c.kind = t.kind AND c.qualname = t.qualname
UNION ALL SELECT query_id, query_hit, query_hit, tokens, 1 FROM v_full_top WHERE part = 0
""",
)
GROWN_FULL = grow_sql("v_full_top_runs", "grown_full", 4000)
view(
    "v_given",
    f"""
SELECT query_id, CAST(rank AS INTEGER) AS pos, arg_min(path, block) AS path, arg_min(kind, block) AS kind,
  arg_min(start_line, block) AS start_line, arg_min(end_line, block) AS end_line,
  arg_max(end_line, block) AS last_line, arg_min(path, block) || CASE WHEN arg_min(kind, block)
  = 'module' THEN '' ELSE ':' || arg_min(start_line, block) || '-' || arg_max(end_line, block) END AS source
FROM (SELECT query_id, 1 AS rank, block, chunk_id FROM {GROWN_FULL}
  UNION ALL SELECT query_id, rank, 0, chunk_id FROM v_shown WHERE shown = 'full' AND rank > 1)
JOIN v_corpus USING (chunk_id) GROUP BY query_id, rank
""",
)
view(
    "v_replies",
    f"""
SELECT query_id, query_id % 5 AS repo_id, {REPLY} AS answer, query_id % 7 = 0 AS not_found,
  query_id % 4 = 0 AS truncated, query_id % 5 <> 1 AS cites FROM v_plans
""",
)
view(
    "v_answer_sources",
    """
SELECT query_id, repo_id, min(pos) AS pos, source, any_value(path) AS path, any_value(kind) AS kind,
  min(start_line) AS start_line, max(CASE WHEN cited THEN end_line ELSE last_line END) AS end_line, cited
FROM (SELECT *, cites AS cited FROM v_given JOIN v_replies USING (query_id))
WHERE CASE WHEN cited THEN pos % 3 <> 0 ELSE pos <= 3 AND NOT not_found END
GROUP BY query_id, repo_id, source, cited, CASE WHEN cited THEN 0 ELSE pos END
""",
)
ORACLES["answer_sources"] = select(
    """
SELECT query_id, pos, source, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, cited,
  'https://example.com/' || r_name || '/blob/cb74/' || path
  || CASE WHEN kind = 'module' THEN '' ELSE '#L' || start_line || '-L' || end_line END AS url
FROM v_answer_sources JOIN region ON r_regionkey = repo_id
"""
)
ORACLES["answer_log"] = select(
    """
SELECT query_id, repo_id, answer, not_found, concat_ws('|',
  CASE WHEN dropped = 1 THEN '1 citation was dropped: not a source that was provided.'
    WHEN dropped > 1 THEN dropped || ' citations were dropped: not a source that was provided.' END,
  CASE WHEN standing = 0 AND NOT not_found THEN 'The answer cites no sources.' END,
  CASE WHEN truncated THEN 'The answer was cut off at the token limit.' END) AS notes,
  CAST(coalesce(n, 0) AS INTEGER) AS sources, coalesce(listed, '') AS listed
FROM v_replies LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(source, ' ' ORDER BY pos) AS listed
  FROM v_answer_sources GROUP BY query_id) USING (query_id)
LEFT JOIN (SELECT query_id, count(CASE WHEN cites AND pos % 3 = 0 THEN 1 END) AS dropped,
  count(CASE WHEN cites AND pos % 3 <> 0 THEN 1 END) AS standing FROM v_given JOIN v_replies USING (query_id) GROUP BY query_id)
  USING (query_id)
"""
)
ORACLES["request_lines"] = select(
    f"""
SELECT query_id, '{cx.INDEX_HEADER}' || {NL} || string_agg(s.path || coalesce(' :: ' || coalesce(s.qualname, s.name), '')
  || coalesce(' — ' || c.signature, ''), {NL} ORDER BY rank) AS text
FROM v_shown s JOIN v_corpus c ON c.chunk_id = s.chunk_id WHERE shown = 'index' GROUP BY query_id
"""
)
