"""Triage, routing, guards, listings, golden files and sinks."""

import json

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpuscle.registry import files as registry
from corpuscle.sources import files as fs
from corpuscle.sources import golden, tables


def file_table(spark, entries):
    """A file table from (path, bytes) pairs."""
    rows = [("r", 1, path, len(content), bytearray(content)) for path, content in entries]
    return spark.createDataFrame(
        rows, "repo string, snapshot_id bigint, path string, size_bytes bigint, content binary"
    )


def reasons(rows):
    """Skip reasons by path."""
    return {r.path: r.skip_reason for r in rows.collect()}


def test_classify_files(spark):
    entries = [
        ("src/a.py", b"x"), ("build", b"x"), (".env.example", b"x"), (".env", b"x"),
        (".env.local", b"x"), ("certs/a.PEM", b"x"), ("id_rsa.pub", b"x"), ("a.min.js", b"x"),
        ("sub/Cargo.lock", b"x"), ("go.sum", b"x"), ("go.mod", b"x"), ("app.js.map", b"x"),
        ("pic.png", b"\x89P\x00G"), ("late.bin", b"a" * 8192 + b"\x00"),
        ("model.bin", b"version https://git-lfs.github.com/spec/v1\noid"),
        ("big.txt", b"a" * 2049), ("node_modules/x.js", b"x"), ("a/dist/x.js", b"x"),
    ]
    found = reasons(fs.classify_files(file_table(spark, entries), max_kb=2))
    assert found == {
        "src/a.py": None, "build": None, ".env.example": None, ".env": "ignored",
        ".env.local": "ignored", "certs/a.PEM": "ignored", "id_rsa.pub": "ignored",
        "a.min.js": "ignored", "sub/Cargo.lock": "ignored", "go.sum": "ignored", "go.mod": None,
        "app.js.map": "ignored", "pic.png": "binary", "late.bin": "too_large",
        "model.bin": "lfs_pointer", "big.txt": "too_large",
    }


def test_only_the_first_bytes_are_sniffed(spark):
    rows = file_table(spark, [("late.bin", b"a" * 8192 + b"\x00")])
    assert reasons(fs.classify_files(rows)) == {"late.bin": None}


def test_links_come_first(spark):
    rows = file_table(spark, [("a.lock", b""), ("b.py", b""), ("c.py", b"")])
    rows = rows.withColumn("link_target", F.when(F.col("path") == "a.lock", "b.py"))
    rows = rows.withColumn(
        "resolved_path", F.when(F.col("path") == "b.py", "/etc/b").otherwise("/root/x/c.py")
    )
    found = reasons(fs.classify_files(rows, root="/root/x"))
    assert found == {"a.lock": "symlink", "b.py": "outside_root", "c.py": None}


def test_utf8_gate_and_routes(spark):
    rows = fs.classify_files(
        file_table(spark, [("a.py", "é".encode()), ("b.py", b"\xff"), ("c.txt", b""), (".env", b"x")])
    )
    routed = fs.route_files(fs.utf8_gate(rows)).collect()
    assert {r.path: (r.mode, r.skip_reason, r.text) for r in routed} == {
        "a.py": ("symbols", None, "é"),
        "b.py": ("skipped", "not_utf8", None),
        "c.txt": ("windows", None, ""),
        ".env": ("skipped", "ignored", None),
    }


def test_guards(spark):
    rows = file_table(spark, [("a", b"x"), ("b", b"x" * 2000)])
    (row,) = fs.corpus_guards(rows, max_files=1).collect()
    assert (row.files, row.bytes, row.refusal) == (2, 2001, "too_many_files")
    guards = fs.corpus_guards(rows, max_mb=0.001)
    assert guards.first().refusal == "too_large"
    assert fs.admitted(rows, guards).count() == 0
    assert fs.admitted(rows, fs.corpus_guards(rows)).count() == 2


def test_repo_tree(spark):
    rows = file_table(
        spark, [("src/a.py", b""), ("src/x/b.py", b""), ("Readme.md", "aé".encode()), ("zz", b"")]
    ).withColumn("skip_reason", F.lit(None).cast("string"))
    (row,) = fs.repo_tree(rows, readme_bytes=2).collect()
    assert row.tree == ["src/ (2 files)", "Readme.md", "zz"]
    assert row.readme == "a"  # the character cut in two is dropped
    (row,) = fs.repo_tree(rows.filter("path <> 'Readme.md'"), lines=1).collect()
    assert (row.tree, row.readme) == (["src/ (2 files)"], None)


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_text("x = 1")
    (tmp_path / "b.txt").write_text("b")
    found = {r.path: (r.size_bytes, bytes(r.content)) for r in fs.scan_files(spark, str(tmp_path)).collect()}
    assert found == {"sub/a.py": (5, b"x = 1"), "b.txt": (1, b"b")}
    assert fs.scan_files(spark, str(tmp_path), "*.py").count() == 1


GOOD = {
    "repo": "https://example.com/a/b",
    "branch": "main",
    "commit": "0" * 40,
    "entries": [
        {"id": 1, "question": "What?", "expect": {"path": "a.py", "qualname": "f"}, "proves": "x"},
        {"id": 2, "question": "Nothing?", "expect": None},
    ],
    "conversations": [{"id": 3, "turns": ["One?", "Two?"], "expect": {"path": "b.py"}}],
}


def read(spark, tmp_path, document):
    """(cases, problems) of one golden file."""
    (tmp_path / "golden.json").write_text(json.dumps(document, indent=1))
    cases, violations = golden.read_golden(spark, str(tmp_path / "golden.json"))
    rows = {r.case_id: (r.turns, r.expect_path, r.expect_qualname) for r in cases.collect()}
    return rows, sorted((r.case_id or 0, r.problem) for r in violations.collect())


def test_golden_file(spark, tmp_path):
    assert read(spark, tmp_path, GOOD) == (
        {
            1: (["What?"], "a.py", "f"),
            2: (["Nothing?"], None, None),
            3: (["One?", "Two?"], "b.py", None),
        },
        [],
    )


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({"repo": None}, (0, golden.BAD_HEADER)),
        ({"branch": ""}, (0, golden.BAD_HEADER)),
        ({"commit": "abc"}, (0, golden.BAD_COMMIT)),
        ({"entries": [{"id": "x", "question": "What?", "expect": None}]}, (0, golden.BAD_CASE)),
        ({"conversations": [{"id": 9, "turns": [], "expect": None}]}, (9, golden.BAD_CASE)),
        ({"entries": [{"id": 5, "question": " ", "expect": None}]}, (5, golden.BAD_QUESTION)),
        ({"entries": [{"id": 5, "question": 7, "expect": None}]}, (5, golden.BAD_QUESTION)),
        ({"entries": [{"id": 5, "question": "q", "expect": "a.py"}]}, (5, golden.BAD_EXPECT)),
        ({"entries": [{"id": 3, "question": "q", "expect": None}]}, (3, golden.BAD_IDS)),
    ],
)
def test_malformed_golden_files(spark, tmp_path, change, problem):
    cases, problems = read(spark, tmp_path, GOOD | change)
    assert problems == [problem] and cases == {}  # the file is rejected as a whole


def test_writing_an_index_again_replaces_it(spark, tmp_path):
    rows = file_table(spark, [("a", b"x"), ("b", b"y")]).drop("content")
    for _ in range(2):
        tables.write_index(rows, rows, str(tmp_path))
    other = rows.withColumn("snapshot_id", F.lit(2).cast("bigint"))
    tables.write_index(other, other, str(tmp_path))
    stored = tables.read_table(spark, f"{tmp_path}/files")
    assert sorted((r.snapshot_id, r.path) for r in stored.collect()) == [
        (1, "a"), (1, "b"), (2, "a"), (2, "b"),
    ]


def test_archives_hold_every_file(spark, tmp_path):
    files = {f"dir_{n % 3}/é{n}.txt": bytes([n, 0, 10, 255]) * n for n in range(200)} | {"a/" * 150 + "b": b"", "big": b"x" * 20_000}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    fs.write_archives(rows.repartition(3), str(tmp_path / "tree"), size=5_000)
    assert len(list((tmp_path / "tree").glob("*.txt"))) > 10
    found = fs.scan_archives(spark, str(tmp_path / "tree"), "*.txt").collect()
    assert len(found) == len(files) and all(r.size_bytes == len(r.content) for r in found)
    assert {r.path: bytes(r.content) for r in found} == files


def test_landed_documents_take_few_files_and_are_those_of_the_sql(spark, tmp_path, monkeypatch):
    rows = [(n, f"src{n % 7}", None if n % 11 == 0 else f"text\n{n}") for n in range(5_000)]
    rows += [(None, "src1", "no id"), (70_000, None, "no source"), (80_000, "a/b=c", "odd"), (90_000, "src2", None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(registry.tables, "work_path", lambda spark, name: str(tmp_path / "tree"))
    found = sorted(registry.scan_files(spark, str(tmp_path)).collect(), key=str)
    assert len([p for p in (tmp_path / "tree").rglob("*") if p.is_dir()]) == 0
    assert len(list((tmp_path / "tree").rglob("*.txt"))) < 20
    sql = registry.ORACLES["scan_files"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert [tuple(r) for r in found] == sorted(duckdb.sql(sql).fetchall(), key=lambda r: str(Row(path=r[0], size_bytes=r[1], content_hash=r[2])))
