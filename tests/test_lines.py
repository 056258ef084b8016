"""Windows, blank lines, sections and caps against greedy statements of the rules."""

import random

from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.operators import chunks as ch
from corpuscle.operators import lines as ln


def texts(spark, pairs):
    """(path, text) rows."""
    return spark.createDataFrame(pairs, "path string, text string")


def test_number_lines(spark):
    rows = ln.number_lines(texts(spark, [("a", "x\r\ny\n"), ("b", ""), ("c", "\n"), ("d", "p\n\nq")]))
    assert sorted((r.path, r.line_no, r.line) for r in rows.collect()) == [
        ("a", 1, "x"), ("a", 2, "y"), ("c", 1, ""), ("d", 1, "p"), ("d", 2, ""), ("d", 3, "q"),
    ]


def windows(spark, pairs):
    """(start, end) of each file's line windows."""
    rows = ln.line_windows(texts(spark, pairs)).collect()
    return sorted((r.path, r.start_line, r.end_line) for r in rows)


def test_line_windows(spark):
    text = "\n".join(f"line {i}" for i in range(1, 201))
    assert windows(spark, [("a", text)]) == [("a", 1, 80), ("a", 66, 145), ("a", 131, 200)]
    assert windows(spark, [("a", ""), ("b", "\n \n\t\n")]) == []
    assert windows(spark, [("a", text.replace("\n", "\r\n"))]) == windows(spark, [("a", text)])


def greedy(weights, size, overlap):
    """Windows found one item at a time."""
    found, start = [], 0
    while True:
        end = start + 1
        while end < len(weights) and sum(weights[start : end + 1]) <= size:
            end += 1
        found.append((start, end))
        if end >= len(weights):
            return found
        back = 0
        while end - back > start + 1 and sum(weights[end - back : end]) < overlap:
            back += 1
        start = end - back


def test_greedy_windows_on_random_weights(spark):
    rng = random.Random(3)
    cases = []
    for i in range(300):
        top = rng.choice([3, 60, 400, 2000])
        cases.append((i, [rng.randint(1, top) for _ in range(rng.randint(1, 60))]))
    rows = spark.createDataFrame(cases, "i int, w array<int>")
    found = rows.select("i", ln.greedy_windows(F.col("w"), 1200, 150).alias("x")).collect()
    assert {r.i: [tuple(x) for x in r.x] for r in found} == {
        i: greedy(w, 1200, 150) for i, w in cases
    }


def bodies(spark, pairs):
    """Whole texts as function bodies."""
    empty = F.array().cast("array<string>")
    rows = ln.with_lines(texts(spark, pairs))
    return rows.select(
        "path", F.lit("function").alias("kind"), F.lit("f").alias("name"), F.lit("m.f").alias("qualname"),
        F.lit("def f()").alias("signature"), F.lit("Doc.").alias("doc"), F.array(F.lit("def f()")).alias("lead"),
        F.array(F.lit("Doc.")).alias("first_lead"), F.col("lines").alias("body"),
        F.lit(1).alias("start_line"), F.size("lines").alias("end_line"),
    )


def test_long_bodies_are_split_into_overlapping_parts(spark):
    text = "\n".join(f"value_{i} = compute({i})" for i in range(400))
    rows = ch.finish_chunks(ln.weighted_windows(bodies(spark, [("a.ts", text)]))).orderBy("part")
    parts = rows.collect()
    assert [p.part for p in parts] == list(range(1, len(parts) + 1)) and len(parts) > 2
    assert parts[0].text.startswith(f"a.ts :: m.f (function, part 1/{len(parts)})\ndef f()\nDoc.\n")
    assert "Doc." not in parts[1].text and "def f()" in parts[1].text
    for before, after in zip(parts, parts[1:]):
        shared = range(after.start_line, before.end_line + 1)
        weight = sum(-(-len(f"value_{i - 1} = compute({i - 1})\n") // 3) for i in shared)
        assert weight >= 150 and after.start_line > before.start_line
    assert parts[-1].end_line == 400


def test_short_and_blank_bodies(spark):
    rows = ln.weighted_windows(bodies(spark, [("a", "x"), ("b", " \n")]))
    assert [(r.path, r.part, r.parts) for r in rows.collect()] == [("a", 0, 0)]


def test_collapse_blanks(spark):
    rows = ln.collapse_blanks(bodies(spark, [("a", "\n\nx\n\n \ny\n\n"), ("b", "\n \n")]))
    found = {r.path: [(x.n, x.line) for x in r.body] for r in rows.collect()}
    assert found == {"a": [(3, "x"), (4, ""), (6, "y")], "b": []}


def test_markdown_sections(spark):
    text = "\n".join(
        ["intro", "", "# One ##", "text", "```", "# not a heading", "~~~", "```", "   ## Two", "x",
         "    # code", "#none", "####### seven", "#", "end", "~~~", "# still fenced"]
    )
    rows = ln.markdown_sections(texts(spark, [("README.md", text), ("b", " \n")]))
    assert sorted((r.start_line, r.end_line, r.name) for r in rows.collect()) == [
        (1, 1, None), (3, 8, "One"), (9, 13, "Two"), (14, 17, None),
    ]


def test_manifests(spark):
    rows = ch.manifest_chunks(
        texts(spark, [("a/Package.json", "{}\n"), ("requirements-dev.txt", "x\ny"), ("b.json", "1"),
                      ("pyproject.toml", " ")])
    )
    assert sorted((r.path, r.name, r.end_line) for r in rows.collect()) == [
        ("a/Package.json", "Package.json", 1), ("requirements-dev.txt", "requirements-dev.txt", 2),
    ]


def cap(spark, lines, budget):
    """(body, truncated) of lines under a budget."""
    body = tx.numbered(F.col("l"))
    rows = spark.createDataFrame([(lines,)], "l array<string>").withColumn("b", body)
    (row,) = rows.select(ch.cap_lines(F.col("b"), F.lit(budget)).alias("c")).collect()
    return [(x.n, x.line) for x in row.c.body], row.c.truncated


def test_cap_keeps_whole_lines_or_cuts_the_first(spark):
    assert cap(spark, ["aa", "bb"], 5) == ([(1, "aa"), (2, "bb")], False)
    assert cap(spark, ["aa", "bb"], 4) == ([(1, "aa")], True)
    assert cap(spark, ["éé", "b"], 3) == ([(1, "é")], True)
    assert cap(spark, ["aa"], -3) == ([(1, "")], True)


def test_huge_line_is_cut_and_ends_on_line_one(spark):
    huge = bodies(spark, [("a.ts", "x" * 30_000 + "\nrest")])
    (row,) = ch.finish_chunks(ln.weighted_windows(huge)).filter("part = 1").collect()
    assert row.truncated and row.tokens <= 4_000 and (row.start_line, row.end_line) == (1, 1)


def test_duplicate_chunk_keys(spark):
    rows = spark.createDataFrame(
        [("a", "window", None, 1, 0), ("a", "window", None, 1, 0), ("a", "window", "", 2, 0)],
        "path string, kind string, qualname string, start_line int, part int",
    )
    (row,) = ch.chunk_key_check(rows).collect()
    assert (row.path, row.qualname, row.n) == ("a", "", 2)
