"""The query log: feedback, token usage, cost and latency."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as tx

# Dollars per million tokens, by kind.
USD_PER_MTOK = {
    "input": 2.00,
    "output": 10.00,
    "cache_read": 0.20,
    "cache_write": 2.50,
    "embed": 0.12,
}
README_BYTES = 24_000
SUMMARY_MAX_TOKENS = 500
STAGES = ("plan_ms", "embed_ms", "retrieve_ms", "llm_ms", "total_ms")


def apply_feedback(query_log: DataFrame, ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_log, unmatched): the newest rating (query_id, feedback, rated_at) of each answered
    query set or cleared; ratings of unknown or unanswered queries are returned."""
    newest = ratings.groupBy("query_id").agg(
        F.max_by(F.struct("feedback"), F.struct("rated_at", "feedback")).alias("rating")
    )
    rated = query_log.join(
        newest.withColumnRenamed("query_id", "id"), "id", "left"
    ).withColumn(
        "feedback",
        F.when(
            F.col("rating").isNotNull() & F.col("answer").isNotNull(), F.col("rating.feedback")
        ).otherwise(F.col("feedback")),
    )
    answered = query_log.filter("answer IS NOT NULL").select(F.col("id").alias("query_id"))
    return (
        rated.select(*query_log.columns),
        ratings.join(answered, "query_id", "left_anti"),
    )


def feedback_candidates(query_log: DataFrame) -> DataFrame:
    """Thumbs-down answers as candidate evaluation cases: one per repo and question, the newest."""
    return (
        query_log.filter("feedback = 'down' AND answer IS NOT NULL")
        .groupBy("repo_id", "question")
        .agg(F.max("id").alias("id"), F.count("*").alias("n"))
    )


def usage_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Token counts by kind added up over the rows of each key."""
    kinds = [k for k in USD_PER_MTOK if k in rows.schema["tokens"].dataType.names]
    return rows.groupBy(*keys).agg(
        *[F.sum(F.coalesce(F.col(f"tokens.{k}"), F.lit(0))).cast("long").alias(k) for k in kinds]
    )


def usd(tokens: dict[str, Column]) -> Column:
    """Dollars for token counts by kind."""
    zero = F.lit(0.0)
    total = zero
    for kind, price in USD_PER_MTOK.items():
        if kind in tokens:
            total = total + F.coalesce(tokens[kind], zero) * price
    return total / 1_000_000


def cost_usd(rows: DataFrame) -> DataFrame:
    """Add usd, the price of each row's tokens struct; arithmetic on columns, no join."""
    kinds = rows.schema["tokens"].dataType.names
    return rows.withColumn("usd", usd({k: F.col(f"tokens.{k}") for k in kinds}))


def index_estimate(repos: DataFrame) -> DataFrame:
    """Upper bound on one index run of repos with size_kb: tokens, embed and summary dollars."""
    summary = usd(
        {
            "input": F.lit(README_BYTES // tx.BYTES_PER_TOKEN),
            "output": F.lit(SUMMARY_MAX_TOKENS),
        }
    )
    tokens = F.floor(F.col("size_kb") * 1024 / tx.BYTES_PER_TOKEN).cast("long")
    return repos.withColumn("tokens", tokens).withColumns(
        {
            "embed_usd": F.col("tokens") * USD_PER_MTOK["embed"] / 1_000_000,
            "summary_usd": summary,
        }
    )


def run_rows(query_log: DataFrame, prefix: str) -> DataFrame:
    """Answered rows whose request id starts with a prefix; pushed down to the scan."""
    return query_log.filter(
        F.col("answer").isNotNull() & F.col("request_id").startswith(prefix)
    )


def repo_rows(query_log: DataFrame, repo_id: int) -> DataFrame:
    """Answered rows of one repo."""
    return query_log.filter(F.col("answer").isNotNull() & (F.col("repo_id") == repo_id))


def medians(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The exact median of a column per key, as (*keys, name).

    Two passes: values are counted in buckets (by sign, exponent and eight more bits, a few thousand per key at most), which combine
    before the shuffle however hot the key; running counts tell the buckets that hold the two middle values, and only
    those buckets' distinct values are counted and ordered.
    """
    size = F.abs(F.col(value).cast("double"))
    scale = F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0))))
    step = F.floor((size / F.pow(F.lit(2.0), scale)) * 256)
    magnitude = F.when(size > 0, (scale + 1100) * 1024 + step).otherwise(F.lit(0))
    bucket = F.when(F.col(value) < 0, -magnitude).otherwise(magnitude).cast("bigint")
    given = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), bucket.alias("_b"))
    by_key = Window.partitionBy(*keys)
    upto = F.sum("_n").over(by_key.orderBy("_b"))
    buckets = given.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    buckets = buckets.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(by_key))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1  # places of the middle values
    before = F.col("_upto") - F.col("_n")
    middle = buckets.filter((before < high) & (F.col("_upto") >= low)).select(
        *keys, "_b", (low - before).alias("_low"), (high - before).alias("_high")
    )
    counted = given.join(middle, [*keys, "_b"]).groupBy(*keys, "_b", "_v").agg(
        F.count("*").alias("_n"), F.first("_low").alias("_low"), F.first("_high").alias("_high")
    )
    running = counted.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v")))

    def at(place: str) -> Column:
        here = (F.col(place) > F.col("_upto") - F.col("_n")) & (F.col(place) <= F.col("_upto"))
        return F.max(F.when(here, F.col("_v")))

    return running.groupBy(*keys).agg(((at("_low") + at("_high")) / 2.0).alias(name))


def medians_of(rows: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """The exact medians of several columns per key, as (*keys, one column for each name in `values`): all selected together, as one
    column of values with the name of their measure. A key whose values are all null has null."""
    measures = F.array(*[F.struct(F.lit(n).alias("_m"), F.col(c).cast("double").alias("_x")) for n, c in values.items()])
    stacked = rows.select(*keys, F.inline(measures))
    found = medians(stacked, [*keys, "_m"], "_x", "_median")
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == n, F.col("_median"))).alias(n) for n in values])


def answer_stats(query_log: DataFrame, *keys: str) -> DataFrame:
    """Per key over answered rows: n, median total ms, median dollars, and the share of prompt
    tokens read from cache (null without prompt tokens)."""
    answered = cost_usd(query_log.filter("answer IS NOT NULL")).withColumn(
        "ms", F.col("timings.total_ms")
    )
    read = F.sum(F.coalesce("tokens.cache_read", F.lit(0)))
    prompt = read + F.sum(
        F.coalesce("tokens.input", F.lit(0)) + F.coalesce("tokens.cache_write", F.lit(0))
    )
    totals = answered.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(prompt > 0, read / prompt).alias("cache_read_share")
    )
    return totals.join(medians_of(answered, keys, {"median_ms": "ms", "median_usd": "usd"}), list(keys), "left")


def latency_stages(query_log: DataFrame, *, stages: Sequence[str] = STAGES) -> DataFrame:
    """Per stage of the answered rows: n, mean, median and largest ms."""
    entries = F.array(
        *[
            F.struct(F.lit(s).alias("stage"), F.col(f"timings.{s}").cast("long").alias("ms"))
            for s in stages
            if s in query_log.schema["timings"].dataType.names
        ]
    )
    rows = query_log.filter("answer IS NOT NULL").select(F.inline(entries))
    totals = rows.groupBy("stage").agg(
        F.count("ms").alias("n"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms")
    )
    return totals.join(medians(rows, ["stage"], "ms", "median_ms"), "stage")
