"""The query log over events, evaluation over retrieved hits, and the streaming index."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import evaluation as ev
from corpuscle.operators import querylog as ql
from corpuscle.plans.evaluate import Evaluation, evaluate
from corpuscle.registry import adapters as ad
from corpuscle.registry import retrieval as rr
from corpuscle.registry.adapters import MODEL, table
from corpuscle.registry.sql import select, view
from corpuscle.sources import tables
from corpuscle.sources.tables import stored
from corpuscle.streaming.indexer import stream_index as start_index

# ── Events as a query log ─────────────────────────────────────────────────────


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as one request: sign-ups failed, purchases are thumbs up, errors down."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    ms = F.floor(F.col("value") * 10).cast("bigint")
    rows = table(spark, sf, "events").withColumn("k", k).withColumn("ms", ms)
    return rows.select(
        F.col("event_id").alias("id"),
        F.concat_ws("-", F.lit("eval"), "event_type", F.col("event_id").cast("string")).alias("request_id"),
        F.floor(F.col("user_id") / 10).alias("repo_id"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("conversation_id"),
        F.concat(F.lit("What about "), F.col("k").cast("string"), F.lit("?")).alias("question"),
        F.when(F.col("event_type") != "signup", F.lit("It is so.")).alias("answer"),
        F.struct(
            (F.col("ms") % 7).alias("plan_ms"),
            (F.col("ms") % 11).alias("embed_ms"),
            F.floor(F.col("ms") / 3).alias("retrieve_ms"),
            F.floor(F.col("ms") / 2).alias("llm_ms"),
            F.col("ms").alias("total_ms"),
        ).alias("timings"),
        F.struct(
            (F.col("k") * 100).alias("input"),
            F.col("k").alias("output"),
            (F.col("k") * (F.col("event_id") % 5)).alias("cache_read"),
            F.when(F.expr("event_id % 3 > 0"), F.col("k") * 2).alias("cache_write"),
            (F.col("k") % 13).alias("embed"),
        ).alias("tokens"),
        F.when(F.col("event_type") == "purchase", "up")
        .when(F.col("event_type") == "error", "down")
        .alias("feedback"),
    )


view(
    "v_log",
    """
SELECT event_id AS id, 'eval-' || event_type || '-' || event_id AS request_id, user_id // 10 AS repo_id,
  'c' || user_id AS conversation_id, 'What about ' || k || '?' AS question,
  CASE WHEN event_type <> 'signup' THEN 'It is so.' END AS answer, ms, ms % 7 AS plan_ms,
  ms % 11 AS embed_ms, ms // 3 AS retrieve_ms, ms // 2 AS llm_ms, k * 100 AS input, k AS output,
  k * (event_id % 5) AS cache_read, CASE WHEN event_id % 3 > 0 THEN k * 2 END AS cache_write,
  k % 13 AS embed, CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' END AS feedback,
  user_id
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CAST(floor(value * 10) AS BIGINT) AS ms FROM events)
""",
)
view(
    "v_costs",
    """
SELECT *, (input * 2.0::DOUBLE + output * 10.0::DOUBLE + cache_read * 0.2::DOUBLE
  + coalesce(cache_write, 0) * 2.5::DOUBLE + embed * 0.12::DOUBLE) / 1000000 AS usd FROM v_log
""",
)


def log_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The log written in two runs by outcome, the second one twice, and read back."""
    out = tables.work_path(spark, "log")
    rows = log(spark, sf)
    tables.log_queries(rows.filter("answer IS NOT NULL"), out, "answered")
    for _ in range(2):  # a retried run
        tables.log_queries(rows.filter("answer IS NULL"), out, "failed")
    stored = tables.read_table(spark, out)
    return stored.select(
        "id", "request_id", F.col("repo_id").cast("bigint"), "answer",
        F.col("timings.total_ms").alias("total_ms"),
    )


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as ratings of the request with their order's number, the last one counting."""
    items = table(spark, sf, "lineitem")
    value = F.when(F.col("l_returnflag") == "A", "up").when(F.col("l_returnflag") == "R", "down")
    return items.select(
        F.col("l_orderkey").alias("query_id"),
        value.alias("feedback"),
        (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey") * 10 + F.length("l_linestatus")).alias("rated_at"),
    )


view(
    "v_ratings",
    """
SELECT l_orderkey AS query_id, CASE l_returnflag WHEN 'A' THEN 'up' WHEN 'R' THEN 'down' END AS feedback,
  l_linenumber * 10000000 + l_partkey * 10 + length(l_linestatus) AS rated_at FROM lineitem
""",
)


def apply_feedback(spark: SparkSession, sf: str) -> DataFrame:
    rated, _ = ql.apply_feedback(log(spark, sf), ratings(spark, sf))
    return rated.select("id", "feedback")


def unmatched_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings of requests that are unknown or have no answer."""
    _, unmatched = ql.apply_feedback(log(spark, sf), ratings(spark, sf))
    return unmatched.groupBy("query_id").agg(F.count("*").alias("n"))


def feedback_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return ql.feedback_candidates(log(spark, sf))


def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ql.usage_totals(log(spark, sf), "conversation_id")


def cost_usd(spark: SparkSession, sf: str) -> DataFrame:
    return ql.cost_usd(log(spark, sf)).select("id", F.round("usd", 6).alias("usd"))


def index_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as repositories of a size in KB."""
    repos = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("repo_id"),
        F.floor(F.abs("c_acctbal") * 7).cast("bigint").alias("size_kb"),
    )
    rows = ql.index_estimate(repos)
    return rows.select(
        "repo_id", "tokens", F.round("embed_usd", 6).alias("embed_usd"),
        F.round("summary_usd", 6).alias("summary_usd"),
    )


def answer_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = ql.answer_stats(log(spark, sf), "repo_id")
    return stats.select(
        "repo_id", "n", "median_ms", F.round("median_usd", 6).alias("median_usd"),
        F.round("cache_read_share", 6).alias("cache_read_share"),
    )


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ql.run_rows(log(spark, sf), "eval-p").select("id", "request_id")


def repo_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ql.repo_rows(log(spark, sf), 2).select("id", "repo_id")


def latency_stages(spark: SparkSession, sf: str) -> DataFrame:
    rows = ql.latency_stages(log(spark, sf))
    return rows.withColumn("mean_ms", F.round("mean_ms", 6))


# ── Cases over the corpus ─────────────────────────────────────────────────────


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """One case per benchmark text: the chunk with its number, named in three ways, expects
    nothing, or something that is not there."""
    targets = ad.corpus(spark, sf).select(
        F.col("chunk_id").alias("case_id"), "path", "name", "qualname"
    )
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"))
    null = F.lit(None).cast("string")
    return asked.join(targets, "case_id").select(
        "case_id",
        F.when(F.expr("case_id % 8 = 5"), null)
        .when(F.expr("case_id % 8 = 6"), F.lit("gone.py"))
        .otherwise(F.col("path"))
        .alias("expect_path"),
        F.when(F.expr("case_id % 8 = 5"), null)
        .when(F.expr("case_id % 3 = 0"), F.col("name"))
        .when(F.expr("case_id % 3 = 1"), F.substring_index("qualname", ".", -2))
        .alias("expect_qualname"),
    )


view(
    "v_cases",
    """
SELECT item_id AS case_id, CASE WHEN item_id % 8 = 5 THEN NULL WHEN item_id % 8 = 6 THEN 'gone.py'
  ELSE path END AS expect_path, CASE WHEN item_id % 8 = 5 THEN NULL WHEN item_id % 3 = 0 THEN name
  WHEN item_id % 3 = 1 THEN array_to_string(string_split(qualname, '.')[-2:], '.') END AS expect_qualname
FROM benchmark JOIN v_corpus ON chunk_id = item_id
""",
)


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """The vector leg's hits with path and names."""
    chunks = ad.corpus(spark, sf).select("chunk_id", "path", "name", "qualname")
    hits = rr.vector_hits(spark, sf).select("query_id", "rank", "chunk_id", "score")
    return stored(hits.join(chunks, "chunk_id").withColumn("tier", F.lit("vector")), "placed")


def match_expected(spark: SparkSession, sf: str) -> DataFrame:
    return ev.match_expected(placed(spark, sf), cases(spark, sf)).select(
        "query_id", "rank", "chunk_id"
    )


def ranks(spark: SparkSession, sf: str, k: int = ev.TOP_K) -> DataFrame:
    """The first rank of each case's target."""
    return ev.rank_at_k(ev.match_expected(placed(spark, sf), cases(spark, sf)), k=k)


def rank_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return ranks(spark, sf)


def absent_targets(spark: SparkSession, sf: str) -> DataFrame:
    return ev.absent_targets(cases(spark, sf), ad.corpus(spark, sf))


def answers_of(given: DataFrame) -> DataFrame:
    """What became of each case's answer: some failed, some were skipped."""
    return given.select(
        "case_id",
        F.expr("case_id % 13 = 7").alias("failed"),
        F.expr("CASE WHEN expect_path IS NULL THEN case_id % 2 = 1 END").alias("not_found"),
        F.expr("case_id % 11 = 3").alias("skipped"),
    )


def outcomes(spark: SparkSession, sf: str, hits: DataFrame) -> DataFrame:
    """Outcomes of the cases by their hits."""
    given = cases(spark, sf)
    answers = answers_of(given)
    absent = ev.absent_targets(given, ad.corpus(spark, sf))
    ranked = ev.rank_at_k(ev.match_expected(hits, given))
    return ev.case_outcomes(given, ranked, absent, answers)


def case_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf, placed(spark, sf))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of two runs (odd and even cases) with each case's best cosine, time and price."""
    hits = placed(spark, sf)
    best = hits.groupBy(F.col("query_id").alias("case_id")).agg(
        F.max("score").alias("cosine")
    )
    spent = ql.cost_usd(log(spark, sf)).select(
        F.col("id").alias("case_id"), F.col("timings.total_ms").alias("ms"), "usd"
    )
    rows = (
        outcomes(spark, sf, hits)
        .join(best, "case_id", "left")
        .join(spent, "case_id", "left")
        .withColumn("run_id", F.expr("case_id % 2"))
    )
    return stored(rows, "results")


def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.eval_report(results(spark, sf)))


def hybrid_run(spark: SparkSession, sf: str) -> Evaluation:
    """The cases through hybrid retrieval, as two runs."""
    given = stored(cases(spark, sf), "cases")
    spent = ql.cost_usd(log(spark, sf)).select(
        F.expr("id % 2").alias("run_id"), F.col("id").alias("case_id"), F.col("timings.total_ms").alias("ms"), "usd"
    )
    return evaluate(
        given, ad.plans(spark, sf), ad.corpus(spark, sf), ad.vectors(spark, sf), ad.query_vectors(spark, sf), MODEL,
        answers_of(given), spent,
    )


def hybrid_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_run(spark, sf).outcomes


def hybrid_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(hybrid_run(spark, sf).report)


def rounded(rows: DataFrame) -> DataFrame:
    """A report with sums and means to six places."""
    for name in ("total_usd", "median_usd", "lowest_cosine"):
        rows = rows.withColumn(name, F.round(name, 6))
    return rows


THRESHOLDS = (0.0, 0.25, 0.35, 0.5, 0.65, 0.8, 1.0)


def floor_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return ev.floor_calibration(results(spark, sf), THRESHOLDS)


def paired_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks by the vector leg alone, and after fusion with the symbol leg."""
    fused = rr.fu.collapse_parts(rr.fu.rrf_fuse(rr.light_legs(spark, sf), ad.corpus(spark, sf)))
    after = ev.rank_at_k(ev.match_expected(fused, cases(spark, sf)), k=200)
    return ev.paired_compare(ranks(spark, sf, 20), after)


def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' files landed as Parquet, indexed as a stream until all are done; the batches follow the cores, not the corpus."""
    landed, out = tables.work_path(spark, "landed"), tables.work_path(spark, "stream")
    cores = spark.sparkContext.defaultParallelism
    (
        ad.files(spark, sf)
        .repartition(4 * cores, "path")
        .write.option("maxRecordsPerFile", 2_000_000)
        .parquet(landed)
    )
    start_index(spark, landed, out, tables.work_path(spark, "stream-state"), files_per_batch=2 * cores)
    chunks = tables.read_table(spark, f"{out}/chunks")
    vectors = tables.read_table(spark, f"{out}/embeddings").select("content_hash", "model")
    return chunks.join(vectors, "content_hash").select(
        "repo", "path", "kind", "qualname", "part", "start_line", "end_line", "content_hash", "model"
    )


QUERIES = {
    "log_queries": log_queries,
    "apply_feedback": apply_feedback,
    "unmatched_feedback": unmatched_feedback,
    "feedback_candidates": feedback_candidates,
    "usage_totals": usage_totals,
    "cost_usd": cost_usd,
    "index_estimate": index_estimate,
    "answer_stats": answer_stats,
    "run_rows": run_rows,
    "repo_rows": repo_rows,
    "latency_stages": latency_stages,
    "match_expected": match_expected,
    "rank_at_k": rank_at_k,
    "absent_targets": absent_targets,
    "case_outcomes": case_outcomes,
    "eval_report": eval_report,
    "hybrid_outcomes": hybrid_outcomes,
    "hybrid_report": hybrid_report,
    "floor_calibration": floor_calibration,
    "paired_compare": paired_compare,
    "stream_index": stream_index,
}

# ── Reference SQL ─────────────────────────────────────────────────────────────

_TARGET = """(expect_qualname IS NULL OR qualname = expect_qualname OR name = expect_qualname
  OR right(qualname, length(expect_qualname) + 1) = '.' || expect_qualname)"""


def matches_sql(hits: str) -> str:
    """SQL for the hits that are their case's target."""
    return f"""
SELECT query_id, rank, chunk_id FROM {hits} JOIN v_cases ON case_id = query_id AND expect_path = path
WHERE coalesce({_TARGET}, false)
"""


view("v_eval_hits", "SELECT h.*, path, name, qualname FROM v_vector_hits h JOIN v_corpus USING (chunk_id)")
view("v_matches", matches_sql("v_eval_hits"))
view("v_fused_matches", matches_sql("v_collapsed"))
view(
    "v_ranks",
    "SELECT query_id AS case_id, min(rank) AS rank FROM v_matches WHERE rank <= 5 GROUP BY 1",
)
view(
    "v_absent",
    f"""
SELECT case_id FROM v_cases WHERE expect_path IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM v_corpus WHERE path = expect_path AND coalesce({_TARGET}, false))
""",
)
view(
    "v_outcomes",
    """
SELECT case_id, expect_path, rank, CASE WHEN rank IS NOT NULL THEN 'vector' END AS tier,
  CASE WHEN case_id % 13 = 7 THEN 'error' WHEN case_id % 11 = 3 THEN 'skipped'
    WHEN expect_path IS NULL THEN CASE WHEN case_id % 2 = 1 THEN 'not_found' ELSE 'answered' END
    WHEN rank IS NOT NULL THEN 'hit' WHEN case_id IN (SELECT case_id FROM v_absent) THEN 'absent'
    ELSE 'miss' END AS outcome
FROM v_cases LEFT JOIN v_ranks USING (case_id)
""",
)
view(
    "v_results",
    """
SELECT o.*, cosine, ms, usd, case_id % 2 AS run_id FROM v_outcomes o
LEFT JOIN (SELECT query_id AS case_id, max(score) AS cosine FROM v_vector_hits GROUP BY 1) USING (case_id)
LEFT JOIN (SELECT id AS case_id, ms, usd FROM v_costs) USING (case_id)
""",
)

view(
    "v_hybrid_ranks",
    f"""
SELECT query_id AS case_id, min(rank) AS rank, arg_min(tier, rank) AS tier
FROM ({rr.shown_sql("v_collapsed_full")}) JOIN v_cases ON case_id = query_id AND expect_path = path
WHERE coalesce({_TARGET}, false) AND rank <= 5 GROUP BY 1
""",
)
view(
    "v_hybrid_outcomes",
    """
SELECT o.case_id, o.expect_path, h.rank, h.tier, CASE WHEN o.outcome NOT IN ('hit', 'miss', 'absent') THEN o.outcome
  WHEN h.rank IS NOT NULL THEN 'hit' WHEN o.case_id IN (SELECT case_id FROM v_absent) THEN 'absent' ELSE 'miss' END AS outcome
FROM v_outcomes o LEFT JOIN v_hybrid_ranks h USING (case_id)
""",
)
view(
    "v_hybrid_results",
    """
SELECT o.case_id, o.expect_path, o.outcome, r.cosine, r.ms, r.usd, r.run_id
FROM v_hybrid_outcomes o JOIN v_results r USING (case_id)
""",
)

_SCORED = "expect_path IS NOT NULL AND outcome <> 'skipped'"
_NULL = "expect_path IS NULL AND outcome <> 'skipped'"

def report_sql(results: str) -> str:
    """SQL for the report over results."""
    return f"""
SELECT run_id, count(*) FILTER ({_SCORED} AND outcome = 'hit') AS hits, count(*) FILTER ({_SCORED})
  AS scored, count(*) FILTER ({_SCORED} AND outcome = 'absent') AS absent,
  count(*) FILTER ({_NULL} AND outcome = 'not_found') AS not_found, count(*) FILTER ({_NULL})
  AS null_cases, round(sum(CASE WHEN ({_SCORED}) OR outcome = 'skipped' THEN usd ELSE 0 END), 6) AS total_usd,
  median(ms) FILTER ({_SCORED} AND outcome <> 'error') AS median_ms,
  round(median(usd) FILTER ({_SCORED} AND outcome <> 'error'), 6) AS median_usd,
  round(min(cosine) FILTER ({_SCORED} AND outcome = 'hit'), 6) AS lowest_cosine,
  (arg_min(case_id, (cosine, case_id)) FILTER ({_SCORED} AND outcome = 'hit')) AS lowest_case
FROM {results} GROUP BY run_id
"""


ORACLES = {
    "log_queries": select("SELECT id, request_id, repo_id, answer, ms AS total_ms FROM v_log"),
    "apply_feedback": select(
        """
SELECT id, CASE WHEN answer IS NOT NULL AND query_id IS NOT NULL THEN r.feedback ELSE v_log.feedback END
  AS feedback FROM v_log LEFT JOIN (SELECT query_id, feedback FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY rated_at DESC, feedback DESC NULLS LAST) AS n FROM v_ratings)
    WHERE n = 1) r ON r.query_id = id
"""
    ),
    "unmatched_feedback": select(
        """
SELECT query_id, count(*) AS n FROM v_ratings
WHERE query_id NOT IN (SELECT id FROM v_log WHERE answer IS NOT NULL) GROUP BY query_id
"""
    ),
    "feedback_candidates": select(
        """
SELECT repo_id, question, max(id) AS id, count(*) AS n FROM v_log
WHERE feedback = 'down' AND answer IS NOT NULL GROUP BY repo_id, question
"""
    ),
    "usage_totals": select(
        """
SELECT conversation_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
  CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(coalesce(cache_write, 0)) AS BIGINT)
  AS cache_write, CAST(sum(embed) AS BIGINT) AS embed FROM v_log GROUP BY conversation_id
"""
    ),
    "cost_usd": select("SELECT id, round(usd, 6) AS usd FROM v_costs"),
    "index_estimate": """
SELECT c_custkey AS repo_id, size_kb * 1024 // 3 AS tokens,
  round((size_kb * 1024 // 3) * 0.12::DOUBLE / 1000000, 6) AS embed_usd,
  round((8000 * 2.0::DOUBLE + 500 * 10.0::DOUBLE) / 1000000, 6) AS summary_usd
FROM (SELECT *, CAST(floor(abs(c_acctbal) * 7) AS BIGINT) AS size_kb FROM customer)
""",
    "answer_stats": select(
        """
SELECT repo_id, count(*) AS n, median(ms) AS median_ms, round(median(usd), 6) AS median_usd,
  round(CAST(sum(cache_read) AS DOUBLE) / CAST(sum(cache_read + input + coalesce(cache_write, 0)) AS DOUBLE), 6)
  AS cache_read_share
FROM v_costs WHERE answer IS NOT NULL GROUP BY repo_id
"""
    ),
    "run_rows": select(
        "SELECT id, request_id FROM v_log WHERE answer IS NOT NULL AND starts_with(request_id, 'eval-p')"
    ),
    "repo_rows": select("SELECT id, repo_id FROM v_log WHERE answer IS NOT NULL AND repo_id = 2"),
    "latency_stages": select(
        """
SELECT stage, count(*) AS n, round(avg(v), 6) AS mean_ms, max(v) AS max_ms, median(v) AS median_ms FROM (
  SELECT 'plan_ms' AS stage, plan_ms AS v FROM v_log WHERE answer IS NOT NULL
  UNION ALL SELECT 'embed_ms', embed_ms FROM v_log WHERE answer IS NOT NULL
  UNION ALL SELECT 'retrieve_ms', retrieve_ms FROM v_log WHERE answer IS NOT NULL
  UNION ALL SELECT 'llm_ms', llm_ms FROM v_log WHERE answer IS NOT NULL
  UNION ALL SELECT 'total_ms', ms FROM v_log WHERE answer IS NOT NULL) GROUP BY stage
"""
    ),
    "match_expected": select("SELECT query_id, rank, chunk_id FROM v_matches"),
    "rank_at_k": select("SELECT case_id, rank, 'vector' AS tier FROM v_ranks"),
    "absent_targets": select("SELECT case_id FROM v_absent"),
    "case_outcomes": select("SELECT * FROM v_outcomes"),
    "hybrid_outcomes": select("SELECT case_id, expect_path, outcome, rank, tier FROM v_hybrid_outcomes"),
    "eval_report": select(report_sql("v_results")),
    "hybrid_report": select(report_sql("v_hybrid_results")),
    "floor_calibration": select(
        f"""
SELECT threshold, count(*) FILTER (outcome = 'hit') AS hits,
  count(*) FILTER (outcome = 'hit' AND coalesce(cosine < threshold, true)) AS hits_below,
  count(*) FILTER (outcome <> 'hit') AS others,
  count(*) FILTER (outcome <> 'hit' AND coalesce(cosine < threshold, true)) AS others_below
FROM v_results CROSS JOIN (SELECT CAST(unnest([{', '.join(map(str, THRESHOLDS))}]) AS DOUBLE) AS threshold)
GROUP BY threshold
"""
    ),
    "paired_compare": select(
        """
SELECT coalesce(b.case_id, a.case_id) AS case_id, rank_before, rank_after,
  rank_after - rank_before AS change, coalesce(rank_before <= 5, false) AS hit_before,
  coalesce(rank_after <= 5, false) AS hit_after
FROM (SELECT query_id AS case_id, min(rank) AS rank_before FROM v_matches GROUP BY 1) b
FULL JOIN (SELECT query_id AS case_id, min(rank) AS rank_after FROM v_fused_matches GROUP BY 1) a
  ON a.case_id = b.case_id
"""
    ),
}
