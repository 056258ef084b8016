"""An evaluation run: golden cases through hybrid retrieval to outcomes and a report."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import evaluation as ev
from corpuscle.plans.retrieve import hybrid_retrieve
from corpuscle.sources.tables import stored


@dataclass(frozen=True)
class Evaluation:
    """The outcome of each case, the results with what they cost, and one report per run."""

    outcomes: DataFrame
    results: DataFrame
    report: DataFrame


def evaluate(
    cases: DataFrame,
    plans: DataFrame,
    chunks: DataFrame,
    embeddings: DataFrame | None,
    query_vectors: DataFrame | None,
    model: str,
    answers: DataFrame,
    spent: DataFrame,
    *,
    k: int = ev.TOP_K,
) -> Evaluation:
    """Rank hybrid hits against the cases (case_id, expect_path, expect_qualname, as `golden_cases` gives them); a plan's
    query_id is its case.

    `answers` has case_id, failed, not_found and skipped; `spent` has run_id, case_id, ms and usd.
    """
    found = hybrid_retrieve(plans, chunks, embeddings, query_vectors, model)
    ranks = ev.rank_at_k(ev.match_expected(found.hits, cases), k=k)
    outcomes = stored(ev.case_outcomes(cases, ranks, ev.absent_targets(cases, chunks), answers), "outcomes")
    best = found.floor.select(F.col("query_id").alias("case_id"), F.col("best_cosine").alias("cosine"))
    results = stored(outcomes.join(best, "case_id", "left").join(spent, "case_id", "left"), "results")
    return Evaluation(outcomes, results, ev.eval_report(results))
