"""Turns, replies, sources and citations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import citations as ci
from corpuscle.operators import context as cx


def test_recent_turns(spark):
    log = spark.createDataFrame(
        [(i, 1, "c", f"q{i}", None if i == 5 else "a") for i in range(1, 8)] + [(8, 1, "d", "x", "a"), (9, 2, "c", "y", "a")],
        "id bigint, repo_id bigint, conversation_id string, question string, answer string",
    )
    rows = cx.recent_turns(log).filter("repo_id = 1 AND conversation_id = 'c'").orderBy("turn")
    assert [(r.turn, r.id) for r in rows.collect()] == [(1, 3), (2, 4), (3, 6), (4, 7)]


GOOD = {"query": " auth flow ", "identifiers": [" login ", ""], "intent": "lookup"}


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        (GOOD, ("auth flow", ["login"], "lookup", "ok")),
        (GOOD | {"identifiers": []}, ("auth flow", [], "lookup", "ok")),
        (GOOD | {"query": "  "}, None),
        (GOOD | {"query": 3}, None),
        (GOOD | {"identifiers": "login"}, None),
        (GOOD | {"identifiers": ["a", 1]}, None),
        (GOOD | {"identifiers": ["a", None]}, None),
        (GOOD | {"identifiers": None}, None),
        (GOOD | {"intent": "guess"}, None),
        ({"query": "x"}, None),
        ("not json", None),
        (None, None),
    ],
)
def test_planner_replies(spark, reply, expected):
    text = reply if reply is None or isinstance(reply, str) else json.dumps(reply)
    rows = spark.createDataFrame([(1, "Why?", text)], "query_id int, question string, reply string")
    (row,) = cx.validate_plans(rows).collect()
    assert tuple(row)[1:] == (expected or ("Why?", [], "explain", "fallback"))


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ({"summary": " S ", "questions": ["a", "", " b", "c", "d", "e"]}, ("S", ["a", "b", "c", "d"])),
        ({"summary": "S", "questions": ["a", 1, "b", "c", "d"]}, ("S", ["a", "b", "c", "d"])),
        ({"summary": "S", "questions": ["a", "b", "c"]}, None),
        ({"summary": " ", "questions": ["a", "b", "c", "d"]}, None),
        ({"summary": "S", "questions": "abcd"}, None),
        ({"questions": ["a", "b", "c", "d"]}, None),
    ],
)
def test_summary_replies(spark, reply, expected):
    rows = spark.createDataFrame([(1, json.dumps(reply))], "repo_id int, reply string")
    found = [tuple(r)[1:] for r in cx.validate_summaries(rows).collect()]
    assert found == ([expected] if expected else [])


def expand_by_rule(tokens, at, budget):
    """Positions grown around `at`, one part at a time."""
    lo = hi = at
    used, before = tokens[at], None
    while before != (lo, hi):
        before = (lo, hi)
        if hi + 1 < len(tokens) and used + tokens[hi + 1] <= budget:
            hi += 1
            used += tokens[hi]
        if lo > 0 and used + tokens[lo - 1] <= budget:
            lo -= 1
            used += tokens[lo]
    return list(range(lo, hi + 1))


def test_expand_top_on_random_runs(spark):
    rng = random.Random(2)
    parts, tops, expected = [], [], {}
    for q in range(80):
        tokens = [rng.randint(1, 60) for _ in range(rng.randint(1, 9))]
        at = rng.randrange(len(tokens))
        other = [rng.randint(1, 9) for _ in range(2)]  # another run of the same name, further down
        ids = [q * 100 + i for i in range(len(tokens))]
        for i, t in enumerate(tokens):
            parts.append((q, ids[at], ids[i], i + 1, i * 10, t))
        for i, t in enumerate(other):
            parts.append((q, ids[at], q * 100 + 50 + i, i + 1, 1000 + i, t))
        tops.append((q, ids[at]))
        expected[q] = [ids[i] for i in expand_by_rule(tokens, at, 100)]
    runs = cx.part_runs(
        spark.createDataFrame(parts, "query_id int, hit_chunk_id int, chunk_id int, part int, start_line int, tokens int")
    )
    top = spark.createDataFrame([*tops, (999, 7)], "query_id int, chunk_id int")
    found = {}
    for r in cx.expand_top(top, runs, budget=100).orderBy("query_id", "block").collect():
        found.setdefault(r.query_id, []).append(r.chunk_id)
    assert found == expected | {999: [7]}


def test_sources_and_replay(spark):
    rows = spark.createDataFrame(
        [
            (1, 1, 0, "a.py", "function", "f", "m.f", None, "x", 1, 9),
            (1, 1, 1, "a.py", "function", "f", "m.f", "fts", "y", 8, 20),
            (1, 2, 0, "b.py", "module", "b", None, "vector", "z", 1, 99),
        ],
        "query_id int, rank int, block int, path string, kind string, name string, qualname string, "
        "tier string, text string, start_line int, end_line int",
    ).withColumn("commit_sha", F.lit("c"))
    found = [(r.source, r.title, [tuple(b) for b in r.blocks], r.tier) for r in cx.brief_sources(rows).orderBy("rank").collect()]
    assert found == [
        ("a.py:1-20", "m.f", [("x", 1, 9), ("y", 8, 20)], "fts"),
        ("b.py", "b", [("z", 1, 99)], "vector"),
    ]
    history = spark.createDataFrame(
        [(1, 1, 0, "b.py"), (1, 2, 0, "c.py"), (1, 2, 1, "b.py")], "query_id int, turn int, pos int, source string"
    )
    current = cx.brief_sources(rows).withColumnRenamed("rank", "pos").select("query_id", "pos", "source")
    merged = cx.replay_dedup(history, current).orderBy("index").collect()
    assert [(r["index"], r.source) for r in merged] == [(0, "b.py"), (1, "c.py"), (2, "b.py"), (3, "a.py:1-20")]


def test_index_lines(spark):
    rows = spark.createDataFrame(
        [(1, 2, "b.py", "g", None, None), (1, 1, "a.py", "f", "m.f", " def f()\nmore"), (1, 3, "c.txt", None, None, " ")],
        "query_id int, rank int, path string, name string, qualname string, signature string",
    )
    (row,) = cx.index_lines(rows, header="H").collect()
    assert row.text == "H\na.py :: m.f — def f()\nb.py :: g\nc.txt"


BLOCKS = "array<struct<text:string,start_line:int,end_line:int>>"


def cited(spark, citations):
    """(sources, dropped) of citations of two briefed sources."""
    briefed = spark.createDataFrame(
        [
            (1, 0, "a.py:1-30", [("h\na", 1, 10), ("h\nb", 9, 20), ("h\nc", 19, 30)], "a.py", "function"),
            (1, 1, "b c.py", [("h\nz", 1, 5)], "b c.py", "module"),
        ],
        f"query_id int, index int, source string, blocks {BLOCKS}, path string, kind string",
    ).withColumns({"title": F.lit("t"), "qualname": F.lit("q"), "tier": F.lit("fts"), "commit_sha": F.lit("sha")})
    rows = spark.createDataFrame(
        [(1, i, *c) for i, c in enumerate(citations)],
        "query_id int, pos int, search_result_index int, source string, start_block int, end_block int",
    )
    sources, dropped = ci.resolve_citations(rows, briefed)
    return ci.cited_spans(sources).orderBy("pos"), dropped.first().dropped


def test_citations_merge_and_narrow(spark):
    rows, dropped = cited(
        spark, [(1, "b c.py", 0, 1), (0, "a.py:1-30", 2, 3), (0, "a.py:1-30", -4, 1), (0, "a.py:1-30", 2, 9)]
    )
    assert dropped == 0
    assert [(r.source, r.start_line, r.end_line, len(r.blocks)) for r in rows.collect()] == [
        ("b c.py", 1, 5, 1), ("a.py:1-30", 1, 30, 2),
    ]


def test_bad_citations_are_dropped(spark):
    rows, dropped = cited(
        spark, [(2, "a.py:1-30", 0, 1), (-1, "a.py:1-30", 0, 1), (1, "a.py:1-30", 0, 1), (0, "a.py:1-30", 2, 2),
                (0, "a.py:1-30", 7, 9), (0, "a.py:1-30", 0, -2)]
    )
    assert dropped == 5
    assert [(r.start_line, r.end_line) for r in rows.collect()] == [(1, 10)]


def test_excerpts_and_links(spark):
    rows, _ = cited(spark, [(0, "a.py:1-30", 0, 2), (1, "b c.py", 0, 1)])
    assert [r.excerpt for r in ci.excerpts(rows).collect()] == ["a\nb", "z"]
    repos = spark.createDataFrame([(1, "https://x.org/o/n")], "repo_id int, url string")
    links = [r.url for r in ci.permalinks(rows.withColumn("repo_id", F.lit(1)), repos).orderBy("pos").collect()]
    assert links == ["https://x.org/o/n/blob/sha/a.py#L1-L20", "https://x.org/o/n/blob/sha/b%20c.py"]
    long = spark.createDataFrame([([("h\n" + "\n".join(["x" * 100] * 20), 1, 20)],)], f"blocks {BLOCKS}")
    excerpt = ci.excerpts(long).first().excerpt
    assert len(excerpt) == 800 and excerpt.count("\n") == 7
    short = spark.createDataFrame([([("h\n" + "\n".join("abcdefghijklmnop"), 1, 20)],)], f"blocks {BLOCKS}")
    assert ci.excerpts(short).first().excerpt == "\n".join("abcdefghijkl")


@pytest.mark.parametrize(
    ("answer", "retrieved", "expected"),
    [
        ("Not found in the indexed code. Maybe elsewhere.", True, True),
        ("**NOT found in the indexed code**", True, True),
        ("> # _not found in the indexed code", True, True),
        ("It is here. Not found in the indexed code: tests.", True, False),
        ("It is here.", False, True),
    ],
)
def test_not_found(spark, answer, retrieved, expected):
    rows = spark.createDataFrame([(answer, retrieved)], "answer string, retrieved boolean")
    assert ci.not_found(rows).first().not_found is expected


def test_notes(spark):
    rows = spark.createDataFrame(
        [(1, 1, False, False), (2, 0, False, True), (0, 0, True, False)],
        "dropped int, sources int, not_found boolean, truncated boolean",
    )
    assert [r.notes for r in ci.answer_notes(rows).collect()] == [
        ["1 citation was dropped: not a source that was provided."],
        ["2 citations were dropped: not a source that was provided.", ci.NO_CITATIONS_NOTE, ci.TRUNCATED_NOTE],
        [],
    ]


def test_uncited_answers_list_the_first_sources(spark):
    answers = spark.createDataFrame([(1, 0, False), (2, 1, False), (3, 0, True)], "query_id int, sources int, not_found boolean")
    briefed = spark.createDataFrame([(q, r) for q in (1, 2, 3) for r in range(1, 6)], "query_id int, rank int")
    rows = ci.uncited_fallback(answers, briefed).collect()
    assert sorted((r.query_id, r.rank, r.cited) for r in rows) == [(1, 1, False), (1, 2, False), (1, 3, False)]
