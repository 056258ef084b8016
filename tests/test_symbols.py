"""Python definitions, nesting, and the text each symbol owns."""

from pyspark.sql import functions as F

from corpuscle.operators import chunks as ch
from corpuscle.operators import symbols as sy
from corpuscle.plans.index import build_index

SOURCE = '''# A queue for letters.
"""
    Letters on their way.

      Kept in order.
"""
import heapq
from collections import deque


class Tray(deque):
    limit = 12

    @classmethod
    @cached
    def empty(cls, *, limit: int = (3, 4)[0]) -> "Tray":
        r"""One without letters."""

        def grow(by):
            return by + 1
        return cls([], grow(limit))

    @property
    def weight(self):
        f"""Not documentation."""
        return sum(x.grams for x in self)

    async def send(
        self,
        to: str,
    ) -> None:
        '''    + '""""""' + '''
        await post(to)


async def main(): await Tray.empty().send("é")


RATE = 3
'''


def files(spark, pairs):
    """(path, text) rows."""
    return spark.createDataFrame(pairs, "path string, text string")


def test_python_symbols_and_nesting(spark):
    rows = sy.symbol_nesting(sy.python_symbols(files(spark, [("post/tray.py", SOURCE)])))
    found = [
        (r.kind, r.qualname, r.parent, r.start_line, r.end_line, r.signature, r.doc)
        for r in rows.orderBy("ord").collect()
    ]
    assert found == [
        ("module", "post.tray", None, 1, 39, None, "Letters on their way.\n\nKept in order."),
        ("class", "post.tray.Tray", 0, 11, 33, "class Tray(deque)", None),
        ("method", "post.tray.Tray.empty", 1, 14, 21, 'def empty(cls, *, limit: int = (3, 4)[0]) -> "Tray"', "One without letters."),
        ("function", "post.tray.Tray.empty.grow", 2, 19, 20, "def grow(by)", None),
        ("method", "post.tray.Tray.weight", 1, 23, 26, "def weight(self)", None),
        ("method", "post.tray.Tray.send", 1, 28, 33, "async def send( self, to: str, ) -> None", None),
        ("function", "post.tray.main", 0, 36, 36, "async def main()", None),
    ]


def test_a_header_that_never_closes_is_counted(spark):
    rows = sy.python_symbols(files(spark, [("m.py", "def f(:\n  pass\ndef g(): pass\n"), ("n.py", ""), ("o.py", "\n\n")])).collect()
    assert sorted((r.path, r.ord, r.name, r.parse_errors, r.end_line) for r in rows) == [
        ("m.py", 0, "m", 1, 3), ("m.py", 1, "g", 1, 3), ("n.py", 0, "n", 0, 0), ("o.py", 0, "o", 0, 2),
    ]


def test_a_definition_is_matched_once_for_its_signature_and_once_for_its_doc(spark):
    rows = sy.python_symbols(files(spark, [("m.py", SOURCE)]))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?:def|class)\s+") == 2
    assert plan.count("regexp_extract_all(") == 1


def test_lines_that_close_nothing_do_not_reach_the_pass_over_a_file(spark):
    text = (
        "class A:\n    x = 1\n\n    y = 2\n    def f(self):\n        \"\"\"One.\n\n  Two.\n        \"\"\"\n        a = 1\n        b = (\n"
        "  2)\n        c = 3\n        def g(): pass\n      # aside\n    z = 3\n\nw = 4\nv = 5\n\ndef h():\n    return \'\'\'\n\n\nend\n"
    )
    rows = sy.python_symbols(files(spark, [("m.py", text)])).orderBy("ord").collect()
    assert [(r.name, r.start_line, r.end_line, r.doc) for r in rows] == [
        ("m", 1, 25, None), ("A", 1, 16, None), ("f", 5, 15, "One.\n\nTwo."), ("g", 14, 14, None), ("h", 21, 25, None),
    ]
    lines = spark.range(1).select(F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(line).alias("line")) for n, line in enumerate(text.split("\n")[:-1], 1)
    ]).alias("lines"), F.split(sy.masked(F.lit(text)), "\n").alias("masks"))
    spoken = F.transform(F.filter("lines", lambda x: F.trim(x["line"]) != ""), lambda x: x["n"])
    coded = lines.withColumn("spoken", spoken).withColumn("code", sy.described(F.col("lines"), F.col("masks"), F.col("spoken")))
    kept = coded.select(F.size("spoken").alias("all"), F.transform(sy.decisive(F.col("code")), lambda x: x["n"]).alias("kept")).first()
    assert (kept["all"], kept["kept"]) == (19, [1, 5, 10, 11, 12, 13, 14, 15, 16, 18, 21])


def test_equal_paths_in_two_repositories_stay_apart(spark):
    rows = spark.createDataFrame(
        [("r1", 1, "setup.py", "def alpha():\n  pass\n"), ("r2", 1, "setup.py", "class Beta:\n  x = 1\n"), ("r2", 2, "setup.py", "y = 1\n")],
        "repo string, snapshot_id bigint, path string, text string",
    ).select("repo", "snapshot_id", "path", F.octet_length("text").cast("bigint").alias("size_bytes"), F.encode("text", "utf-8").alias("content"))
    index = build_index(rows)
    found = {(c.repo, c.snapshot_id, c.kind, c.qualname) for c in index.chunks.collect()}
    assert found == {
        ("r1", 1, "function", "setup.alpha"), ("r2", 1, "class", "setup.Beta"), ("r2", 2, "module", "setup"),
    }
    assert index.files.count() == 3
    ids = [c.chunk_id for c in index.chunks.collect()]
    assert len(set(ids)) == 3 and sorted(ids) == sorted(c.chunk_id for c in build_index(rows.repartition(3)).chunks.collect())


def test_definitions_on_one_line_are_siblings(spark):
    symbols = spark.createDataFrame(
        [("a.ts", 0, "module", "a", 1, 3), ("a.ts", 1, "function", "f", 1, 1), ("a.ts", 2, "function", "g", 1, 1), ("a.ts", 3, "class", "C", 2, 3), ("a.ts", 4, "function", "h", 3, 3)],
        "path string, ord int, kind string, name string, start_line int, end_line int",
    )
    found = {r.name: (r.parent, r.qualname) for r in sy.symbol_nesting(symbols).collect()}
    assert found == {"a": (None, "a"), "f": (0, "a.f"), "g": (0, "a.g"), "C": (0, "a.C"), "h": (3, "a.C.h")}


def chunks(spark, pairs):
    """Chunks by (qualname, start line) through the whole index job."""
    rows = files(spark, pairs).select(
        F.lit("r").alias("repo"), F.lit(1).cast("bigint").alias("snapshot_id"), "path",
        F.octet_length("text").cast("bigint").alias("size_bytes"), F.encode("text", "utf-8").alias("content"),
    )
    return {(c.qualname, c.start_line): c for c in build_index(rows).chunks.collect()}


def test_chunks_of_a_python_file(spark):
    found = chunks(spark, [("post/tray.py", SOURCE)])
    assert found["post.tray", 1].text.endswith("import heapq\nfrom collections import deque\n\nRATE = 3")
    assert found["post.tray.Tray", 11].text == (
        "post/tray.py :: post.tray.Tray (class)\nclass Tray(deque):\n    limit = 12\n\n"
        '    def empty(cls, *, limit: int = (3, 4)[0]) -> "Tray"\n\n    def weight(self)\n\n'
        "    async def send( self, to: str, ) -> None"
    )
    getter = found["post.tray.Tray.weight", 23]
    assert getter.text.startswith(
        "post/tray.py :: post.tray.Tray.weight (method)\ndef weight(self)\n    @property\n"
    )
    assert getter.search_a.split() == ["weight", "post.tray.Tray.weight", "post", "tray", "Tray", "weight"]


def test_crlf_makes_the_same_chunks(spark):
    unix, dos = (chunks(spark, [("a.py", t)]) for t in (SOURCE, SOURCE.replace("\n", "\r\n")))
    assert {k: c.content_hash for k, c in unix.items()} == {k: c.content_hash for k, c in dos.items()}


def test_editing_one_function_changes_only_its_hash(spark):
    before = chunks(spark, [("a.py", SOURCE)])
    after = chunks(spark, [("a.py", SOURCE.replace("await post(to)", "await post(to, 2)"))])
    changed = {k for k in before if before[k].content_hash != after[k].content_hash}
    assert changed == {("a.Tray.send", 28)}


def test_doc_comments_above_a_definition(spark):
    text = "/** Adds. */\nexport function add(a, b) {\n  return a + b;\n}\nconst x = 1;\n"
    symbols = spark.createDataFrame(
        [
            ("a.ts", 0, "module", "a", 1, 5, None, None, None),
            ("a.ts", 1, "function", "add", 2, 4, "function add(a, b)", "Adds.", 1),
        ],
        f"path string, {sy.SYMBOL_COLUMNS}",
    )
    routed = files(spark, [("a.ts", text), ("b.js", "y = 2\n")]).withColumn("mode", F.lit("symbols"))
    found = {c.qualname: c.text for c in ch.chunk_files(routed, symbols).collect()}
    assert found == {
        "a": "a.ts :: a (module)\nconst x = 1;",
        "a.add": "a.ts :: a.add (function)\nfunction add(a, b)\nAdds.\n"
        "export function add(a, b) {\n  return a + b;\n}",
        "b": "b.js :: b (module)\ny = 2",
    }
