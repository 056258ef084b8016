"""The query log, evaluation, streaming, and plans that must hold at scale."""

import statistics

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import evaluation as ev
from corpuscle.operators import querylog as ql
from corpuscle.plans.index import build_index
from corpuscle.sources import tables
from corpuscle.streaming.indexer import stream_index


def log(spark, rows):
    """(id, answer, ms, input, cache_read) rows."""
    given = spark.createDataFrame(rows, "id bigint, answer string, ms bigint, input bigint, read bigint")
    return given.select(
        "id", "answer", F.lit(1).alias("repo_id"), F.struct(F.col("ms").alias("total_ms")).alias("timings"),
        F.struct("input", F.lit(0).alias("output"), F.col("read").alias("cache_read"), F.lit(None).cast("bigint").alias("cache_write"))
        .alias("tokens"), F.lit(None).cast("string").alias("feedback"),
    )


def test_feedback_sets_and_clears_answered_rows(spark):
    rows = log(spark, [(1, "a", 1, 1, 1), (2, None, 1, 1, 1), (3, "a", 1, 1, 1)])
    rows = rows.withColumn("feedback", F.when(F.col("id") == 3, "up"))
    ratings = spark.createDataFrame(
        [(1, "up", 1), (1, "down", 2), (2, "up", 1), (3, None, 1), (9, "up", 1)],
        "query_id bigint, feedback string, rated_at int",
    )
    rated, unmatched = ql.apply_feedback(rows, ratings)
    assert {r.id: r.feedback for r in rated.collect()} == {1: "down", 2: None, 3: None}
    assert sorted(r.query_id for r in unmatched.collect()) == [2, 9]


def test_each_kind_of_token_has_its_price(spark):
    kinds = ("input", "output", "cache_read", "cache_write", "embed")
    million = F.struct(*[F.lit(1_000_000).alias(k) for k in kinds])
    row = ql.cost_usd(spark.range(1).select(million.alias("tokens"))).first()
    assert row.usd == pytest.approx(2.0 + 10.0 + 0.2 + 2.5 + 0.12)


def test_index_estimate(spark):
    row = ql.index_estimate(spark.createDataFrame([(100,)], "size_kb bigint")).first()
    assert row.tokens == 34133 and row.embed_usd == pytest.approx(34133 * 0.12 / 1e6)
    assert row.summary_usd == pytest.approx((8000 * 2 + 500 * 10) / 1e6)


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 1, 2], [7, 7, 7, 1], [4, 1, 1, 9, 9, 9]])
def test_medians(spark, values):
    rows = spark.createDataFrame([("k", v) for v in values], "k string, v int")
    assert ql.medians(rows, ["k"], "v", "m").first().m == statistics.median(values)


def test_answer_stats(spark):
    rows = log(spark, [(1, "a", 10, 60, 20), (2, "a", 30, 20, 0), (3, None, 99, 99, 99)])
    row = ql.answer_stats(rows, "repo_id").first()
    assert (row.n, row.median_ms, row.cache_read_share) == (2, 20.0, 0.2)


CASES = "case_id int, expect_path string, expect_qualname string"


def test_targets(spark):
    hits = spark.createDataFrame(
        [(1, 1, "a.py", "g", "m.A.g", "fts"), (1, 2, "a.py", "f", "m.A.f", "vector"), (2, 6, "a.py", "f", "m.A.f", "fts"),
         (3, 1, "a.py", "f", None, "fts"), (4, 1, "b.py", "f", "m.f", "fts"), (5, 3, "a.py", None, None, "fts")],
        "query_id int, rank int, path string, name string, qualname string, tier string",
    )
    cases = spark.createDataFrame(
        [(1, "a.py", "A.f"), (2, "a.py", "f"), (3, "a.py", "f"), (4, "a.py", "f"), (5, "a.py", None), (6, None, None)],
        CASES,
    )
    matches = ev.match_expected(hits, cases)
    assert sorted((r.query_id, r.rank) for r in matches.collect()) == [(1, 2), (2, 6), (3, 1), (5, 3)]
    ranks = {r.case_id: (r.rank, r.tier) for r in ev.rank_at_k(matches).collect()}
    assert ranks == {1: (2, "vector"), 3: (1, "fts"), 5: (3, "fts")}
    chunks = spark.createDataFrame([("a.py", "f", "m.A.f")], "path string, name string, qualname string")
    wanted = spark.createDataFrame(
        [(1, "a.py", "f"), (2, "a.py", "A.f"), (3, "a.py", "m.A"), (4, "x.py", None), (5, "a.py", None), (6, None, None)],
        CASES,
    )
    assert sorted(r.case_id for r in ev.absent_targets(wanted, chunks).collect()) == [3, 4]


def test_report(spark):
    results = spark.createDataFrame(
        [
            ("r", 1, "a", "hit", 0.4, 10, 0.1), ("r", 2, "a", "hit", 0.3, 20, 0.2), ("r", 3, "a", "miss", 0.1, 30, 0.3),
            ("r", 4, "a", "error", None, 0, 0.0), ("r", 5, None, "not_found", None, 5, 9.0),
            ("r", 6, "a", "skipped", 0.2, 7, 0.5), ("r", 7, "a", "absent", 0.2, 40, 0.4),
        ],
        "run_id string, case_id int, expect_path string, outcome string, cosine double, ms int, usd double",
    )
    row = ev.eval_report(results).first()
    assert (row.hits, row.scored, row.absent, row.not_found, row.null_cases) == (2, 5, 1, 1, 1)
    assert (row.lowest_cosine, row.lowest_case, row.median_ms) == (0.3, 2, 25.0)
    assert row.total_usd == pytest.approx(1.5)
    sweep = {r.threshold: (r.hits_below, r.others_below) for r in ev.floor_calibration(results, [0.25, 0.35]).collect()}
    assert sweep == {0.25: (0, 5), 0.35: (1, 5)}


def test_paired_compare(spark):
    before = spark.createDataFrame([(1, 1), (2, 7)], "case_id int, rank int")
    after = spark.createDataFrame([(1, 2), (3, 5)], "case_id int, rank int")
    rows = {r.case_id: (r.change, r.hit_before, r.hit_after) for r in ev.paired_compare(before, after).collect()}
    assert rows == {1: (1, True, True), 2: (None, False, False), 3: (None, False, True)}


def test_stream_equals_batch_and_embeds_each_text_once(spark, tmp_path):
    files = spark.createDataFrame(
        [("r", 1, f"p{i}.txt", 6, bytearray(f"text {i % 3}", "utf-8")) for i in range(9)],
        "repo string, snapshot_id bigint, path string, size_bytes bigint, content binary",
    )
    files.repartition(3, "path").write.parquet(str(tmp_path / "in"))
    stream_index(
        spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=1
    )
    streamed = tables.read_table(spark, str(tmp_path / "out/chunks"))
    batch = build_index(files).chunks
    assert sorted((r.path, r.content_hash) for r in streamed.collect()) == sorted(
        (r.path, r.content_hash) for r in batch.collect()
    )
    assert streamed.select("batch").distinct().count() > 1
    vectors = tables.read_table(spark, str(tmp_path / "out/embeddings"))
    assert vectors.count() == vectors.select("content_hash").distinct().count() == 9
