"""Registered queries against their SQL, and the pipeline against a brute-force statement of its stages."""

import collections
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check  # noqa: E402
import corpus_pipeline  # noqa: E402
from corpuscle.llm import queries  # noqa: E402

from .conftest import SF  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_reference_sql(spark, name):
    assert check.compare(queries.QUERIES[name](spark, SF), check.duck(SF).sql(queries.ORACLES[name])) == ""


def test_stages_follow_from_one_another(spark):
    """Each stage by its own rule over what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    whole, good, single, apart, mixed, coded = ([r.asDict() for r in f.collect()] for f in frames)
    assert all(f.columns == docs.columns for f in frames[:-1])

    scored = {r.doc_id: r.score for r in queries.op9_quality(spark, SF).collect()}
    assert {r["doc_id"] for r in good} == {k for k, s in scored.items() if s >= 0.5}

    squeeze = lambda t: "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
    groups = collections.defaultdict(list)
    for r in good:
        groups[squeeze(r["text"])].append(r)
    want = {min(g, key=lambda r: (-len(r["text"]), r["doc_id"]))["doc_id"] for g in groups.values()}
    assert {r["doc_id"] for r in single} == want

    five = {r["doc_id"]: set(zip(*(r["text"].lower().split()[k:] for k in range(5)), strict=False)) for r in single}
    kept = {r["doc_id"] for r in apart}
    likeness = lambda a, b: len(five[a] & five[b]) / max(1, len(five[a] | five[b]))
    for a in kept:
        assert not any(a < b and likeness(a, b) >= 0.8 for b in kept)
    for gone in set(five) - kept:
        assert max(likeness(gone, b) for b in five if b != gone) >= 0.8

    texts = {r["doc_id"]: r["text"] for r in apart}
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in mixed)
    assert max(collections.Counter(r["doc_id"] for r in mixed).values()) <= 2
    assert collections.Counter(r["doc_id"] for r in coded) == collections.Counter(r["doc_id"] for r in mixed)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in coded)


def test_run_gives_what_the_stages_give(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and rows.count() > 100


def test_stages_on_no_documents(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
