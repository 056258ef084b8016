"""Evaluation: ranked hits against golden cases, the report, calibration and comparison."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.operators.querylog import medians_of

TOP_K = 5  # fixed value: how deep a case's target may rank


def is_target(name: Column, qualname: Column, expected: Column) -> Column:
    """Whether a chunk is the expected symbol: no symbol expected, its qualname or name, or a
    dotted suffix of its qualname."""
    same = (qualname == expected) | (name == expected) | tx.has_dotted_suffix(qualname, expected)
    return expected.isNull() | F.coalesce(same, F.lit(False))


def match_expected(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Hits (query_id, rank, path, name, qualname, tier) that are their case's target (case_id,
    expect_path, expect_qualname)."""
    targets = cases.filter("expect_path IS NOT NULL").select(
        F.col("case_id").alias("query_id"), F.col("expect_path").alias("path"), "expect_qualname"
    )
    return (
        hits.join(targets, ["query_id", "path"])
        .filter(is_target(F.col("name"), F.col("qualname"), F.col("expect_qualname")))
        .drop("expect_qualname")
    )


def rank_at_k(matches: DataFrame, *, k: int = TOP_K) -> DataFrame:
    """The first matching rank within the top `k` of each case, and its tier."""
    return (
        matches.filter(F.col("rank") <= k)
        .groupBy(F.col("query_id").alias("case_id"))
        .agg(F.min("rank").alias("rank"), F.min_by("tier", "rank").alias("tier"))
    )


def absent_targets(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids of cases whose target is no chunk of the index, or of the case's snapshot when cases name one."""
    targets = cases.filter("expect_path IS NOT NULL")
    scope = [c for c in ("snapshot_id",) if c in cases.columns and c in chunks.columns]
    known = chunks.select("path", "name", "qualname", *scope)
    same = (targets["expect_path"] == known["path"]) & is_target(
        known["name"], known["qualname"], targets["expect_qualname"]
    )
    for column in scope:
        same = same & (targets[column] == known[column])
    return targets.join(known, same, "left_anti").select("case_id")


def case_outcomes(
    cases: DataFrame, ranks: DataFrame, absent: DataFrame, answers: DataFrame
) -> DataFrame:
    """Outcome of each case: error; skipped (not run); hit, absent or miss when it expects a
    target; not_found or answered when it expects none.

    `answers` has case_id, failed, not_found (null when no answer was asked for) and skipped.
    """
    flags = answers.select("case_id", "failed", "not_found", "skipped")
    gone = absent.select("case_id").distinct().withColumn("gone", F.lit(True))
    no = F.lit(False)
    outcome = (
        F.when(F.coalesce("failed", no), "error")
        .when(F.coalesce("skipped", no), "skipped")
        .when(
            F.col("expect_path").isNull(),
            F.when(F.coalesce("not_found", no), "not_found").otherwise("answered"),
        )
        .when(F.col("rank").isNotNull(), "hit")
        .when(F.coalesce("gone", no), "absent")
        .otherwise("miss")
    )
    return (
        cases.join(ranks, "case_id", "left")
        .join(gone, "case_id", "left")
        .join(flags, "case_id", "left")
        .withColumn("outcome", outcome)
        .select("case_id", "expect_path", "outcome", "rank", "tier")
    )


def eval_report(results: DataFrame) -> DataFrame:
    """One row per run over its results (run_id, case_id, expect_path, outcome, cosine, ms, usd):
    hits of scored, absent, not-found of null cases, lowest cosine among hits with its case,
    medians over scored cases without error, and total dollars."""
    scored = F.col("expect_path").isNotNull() & (F.col("outcome") != "skipped")
    null = F.col("expect_path").isNull() & (F.col("outcome") != "skipped")
    hit = scored & (F.col("outcome") == "hit")
    with_cosine = hit & F.col("cosine").isNotNull() & (F.col("cosine") != 0)
    paid = scored | (F.col("outcome") == "skipped")
    totals = results.groupBy("run_id").agg(
        F.count_if(hit).alias("hits"),
        F.count_if(scored).alias("scored"),
        F.count_if(scored & (F.col("outcome") == "absent")).alias("absent"),
        F.count_if(null & (F.col("outcome") == "not_found")).alias("not_found"),
        F.count_if(null).alias("null_cases"),
        F.min(F.when(with_cosine, F.struct("cosine", "case_id"))).alias("low"),
        F.sum(F.when(paid, F.col("usd")).otherwise(0.0)).alias("total_usd"),
    )
    timed = results.filter(scored & (F.col("outcome") != "error"))
    return (
        totals.join(medians_of(timed, ["run_id"], {"median_ms": "ms", "median_usd": "usd"}), "run_id", "left")
        .withColumn("lowest_cosine", F.col("low.cosine"))
        .withColumn("lowest_case", F.col("low.case_id"))
        .drop("low")
    )


def floor_calibration(results: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """What each relevance floor would do: hits whose best cosine it is above (lost), and other
    cases it is above (kept out), of how many. Each result is compared with the few thresholds
    inside its row, and counts combine before the shuffle."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    hit = F.col("outcome") == "hit"
    below = F.coalesce(F.col("cosine") < F.col("threshold"), F.lit(True))
    return (
        results.select("outcome", "cosine", levels.alias("threshold"))
        .groupBy("threshold")
        .agg(
            F.count_if(hit).alias("hits"),
            F.count_if(hit & below).alias("hits_below"),
            F.count_if(~hit).alias("others"),
            F.count_if(~hit & below).alias("others_below"),
        )
    )


def paired_compare(before: DataFrame, after: DataFrame, *, k: int = TOP_K) -> DataFrame:
    """Two runs of the same cases (case_id, rank): rank each way, its change, and hit@k each way."""
    def ranks(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("case_id", F.col("rank").alias(name))

    def hit(name: str) -> Column:
        return F.coalesce(F.col(name) <= k, F.lit(False))

    return (
        ranks(before, "rank_before")
        .join(ranks(after, "rank_after"), "case_id", "full")
        .withColumn("change", F.col("rank_after") - F.col("rank_before"))
        .withColumn("hit_before", hit("rank_before"))
        .withColumn("hit_after", hit("rank_after"))
    )
