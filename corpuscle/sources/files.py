"""File tables: scan a tree, triage each file, route it to a chunker, guard repository size."""

import io
import tarfile
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as tx

# Which files are pruned, ignored or kept, and the size limits.
PRUNED_DIRS = (
    ".git", "node_modules", "vendor", "dist", "build", ".venv", "venv", "__pycache__",
    ".mypy_cache", ".pytest_cache", ".tox", ".next", "target", "coverage",
)
IGNORED_FILES = (
    "*.min.js", "*.min.css", "*.map",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "cargo.lock",
    "bun.lock", "bun.lockb", "go.sum", "gemfile.lock", "composer.lock", "pipfile.lock", "pdm.lock",
    ".env", ".env.*", "*.pem", "*.key", "id_rsa*",
)
KEPT_FILES = (".env.example",)
LFS_POINTER = "version https://git-lfs.github.com/spec/v1"
README_NAMES = ("readme.md", "readme.markdown")
SNIFF_BYTES = 8192
MAX_FILE_KB = 512
MAX_REPO_FILES = 20_000
MAX_REPO_MB = 200
TREE_LINES = 100  # what a prompt may hold of a tree and a README; no limit unless asked for
README_BYTES = 24_000
ARCHIVE_BYTES = 16 << 20  # of files in one archive, about; a larger file has one of its own


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every file under a folder as (path, size_bytes, content), the path relative to the folder.

    Nothing is sorted here: order is a property of reports, not of a distributed scan. When only
    path and size are selected, Spark's scan reads no file content.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    root = path.rstrip("/") + "/"
    marker = root.split(":", 1)[-1].lstrip("/")
    return reader.load(path).select(
        F.element_at(F.split(F.col("path"), F.lit(f"\\Q{marker}\\E"), 2), 2).alias("path"),
        F.col("length").alias("size_bytes"),
        "content",
    )


_SCANNED = "path string, size_bytes bigint, content binary"


def _pack(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files of a task as tar archives."""
    buffer, held = io.BytesIO(), 0
    tar = tarfile.open(fileobj=buffer, mode="w")
    for batch in batches:
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            if held and held + len(content.as_buffer()) > size:
                tar.close()
                yield pa.record_batch([pa.array([buffer.getvalue()], pa.binary())], ["archive"])
                buffer, held = io.BytesIO(), 0
                tar = tarfile.open(fileobj=buffer, mode="w")
            entry = tarfile.TarInfo(name)
            entry.size = len(content.as_buffer())
            tar.addfile(entry, io.BytesIO(content.as_buffer()))
            held += tarfile.BLOCKSIZE + entry.size
    tar.close()
    if held:
        yield pa.record_batch([pa.array([buffer.getvalue()], pa.binary())], ["archive"])


def write_archives(files: DataFrame, path: str, *, size: int = ARCHIVE_BYTES) -> None:
    """Files (path, content) as tar archives under `path`, each task those it has.

    A million small files cost a folder, a listing and several calls of the store each; packed, they cost their bytes.
    """
    archives = files.select("path", "content").mapInArrow(partial(_pack, size), "archive binary")
    archives.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files in the archives of a task."""
    for batch in batches:
        for archive in batch.column("content"):
            with tarfile.open(fileobj=io.BytesIO(archive.as_buffer())) as tar:
                found = [(m.name, m.size, tar.extractfile(m).read()) for m in tar if m.isfile()]
            columns = zip(*found, strict=True) if found else ((), (), ())
            types = pa.string(), pa.int64(), pa.binary()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "size_bytes", "content"])


def scan_archives(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every file in the tar archives under a folder as (path, size_bytes, content), as `scan_files` gives those of a tree."""
    return scan_files(spark, path, glob).select("content").mapInArrow(_unpack, _SCANNED)


def glob_regex(patterns: Sequence[str]) -> str:
    """File-name globs (only `*` is special) as one anchored regular expression."""
    escaped = (".*".join(f"\\Q{piece}\\E" for piece in p.split("*")) for p in patterns)
    return rf"\A(?:{'|'.join(escaped)})\z"


def skip_reason(
    files: DataFrame, *, max_kb: int | None, ignore: Sequence[str], keep: Sequence[str], root: str
) -> Column:
    """Why a file is not indexed: the first check that fails, cheapest first; null when none."""
    name = F.lower(tx.basename(F.col("path")))
    head = F.substring(F.col("content"), 1, SNIFF_BYTES)
    never = F.lit(False)
    link = F.col("link_target").isNotNull() if "link_target" in files.columns else never
    outside = never
    if "resolved_path" in files.columns:
        outside = ~F.startswith(F.col("resolved_path"), F.lit(root.rstrip("/") + "/"))
    return (
        F.when(link, "symlink")
        .when(outside, "outside_root")
        .when(name.rlike(glob_regex(ignore)) & ~name.isin(*keep), "ignored")
        .when(never if max_kb is None else F.col("size_bytes") > max_kb * 1024, "too_large")
        .when(F.startswith(head, F.encode(F.lit(LFS_POINTER), "utf-8")), "lfs_pointer")
        .when(F.contains(head, F.unhex(F.lit("00"))), "binary")
    )


def classify_files(
    files: DataFrame,
    *,
    max_kb: int | None = MAX_FILE_KB,
    prune: Sequence[str] = PRUNED_DIRS,
    ignore: Sequence[str] = IGNORED_FILES,
    keep: Sequence[str] = KEPT_FILES,
    root: str = "",
) -> DataFrame:
    """Drop files under a pruned directory and add `skip_reason`; one scan, no shuffle. Without
    `max_kb` no file is too large."""
    parts = F.split("path", "/")
    directories = F.slice(parts, 1, F.size(parts) - 1)
    pruned = F.arrays_overlap(directories, F.array(*map(F.lit, prune)))
    reason = skip_reason(files, max_kb=max_kb, ignore=ignore, keep=keep, root=root)
    return files.filter(~pruned).withColumn("skip_reason", reason)


def utf8_gate(files: DataFrame) -> DataFrame:
    """Add `text`; a file that is not UTF-8 gets the skip reason `not_utf8`, skipped ones no text."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    reason = F.coalesce("skip_reason", F.when(~valid, F.lit("not_utf8")))
    return files.withColumn("skip_reason", reason).withColumn(
        "text", F.when(F.col("skip_reason").isNull(), F.col("content").cast("string"))
    )


def route_files(files: DataFrame) -> DataFrame:
    """Add `language` and `mode`: skipped files, parsed languages (symbols), the rest (windows)."""
    return files.withColumn("language", tx.language_of(F.col("path"))).withColumn(
        "mode",
        F.when(F.col("skip_reason").isNotNull(), "skipped")
        .when(F.col("language").isNotNull(), "symbols")
        .otherwise("windows"),
    )


def corpus_guards(
    files: DataFrame, *, max_files: int | None = MAX_REPO_FILES, max_mb: float | None = MAX_REPO_MB
) -> DataFrame:
    """Per repo: file count, bytes and why it is refused (null when it may be indexed); a limit of None refuses none.

    Counts and sums combine before the shuffle, so one giant repo costs one row per task.
    """
    return (
        files.groupBy("repo")
        .agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
        .withColumn(
            "refusal",
            F.when(F.lit(False) if max_files is None else F.col("files") > max_files, "too_many_files").when(
                F.lit(False) if max_mb is None else F.col("bytes") > F.lit(max_mb) * 1024 * 1024, "too_large"
            ),
        )
    )


def admitted(files: DataFrame, guards: DataFrame) -> DataFrame:
    """The files of the repos that no guard refused."""
    return files.join(guards.filter("refusal IS NULL"), "repo", "left_semi")


def repo_tree(
    files: DataFrame, *, lines: int | None = None, readme_bytes: int | None = None
) -> DataFrame:
    """Per repo: the top-level listing (directories with file counts, then files) and the README.

    Entries are counted before anything is collected per repo. `lines` and `readme_bytes` cut what a prompt has no room for
    (TREE_LINES, README_BYTES); by default nothing is cut.
    """
    nested = F.contains(F.col("path"), F.lit("/"))
    entries = (
        files.select("repo", nested.alias("nested"), F.substring_index("path", "/", 1).alias("head"))
        .groupBy("repo", "nested", "head")
        .agg(F.count("*").alias("n"))
    )
    listing = (
        entries.withColumn(
            "line",
            F.when(F.col("nested"), F.format_string("%s/ (%d files)", "head", "n")).otherwise(
                F.col("head")
            ),
        )
        .withColumn(
            "at",
            F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("nested"), "head")),
        )
        .filter(F.lit(True) if lines is None else F.col("at") <= lines)
        .groupBy("repo")
        .agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("ordered"))
        .select("repo", F.transform("ordered", lambda x: x["line"]).alias("tree"))
    )
    is_readme = (
        ~nested & F.col("skip_reason").isNull() & F.lower(F.col("path")).isin(*README_NAMES)
    )
    readmes = (
        files.filter(is_readme)
        .select("repo", "path", (F.col("content") if readme_bytes is None else F.substring("content", 1, readme_bytes)).alias("head"))
        .groupBy("repo")
        .agg(F.min_by("head", "path").alias("head"))
        .select("repo", utf8_prefix(F.col("head")).alias("readme"))
    )
    return listing.join(readmes, "repo", "left")


def utf8_prefix(cut: Column) -> Column:
    """Bytes cut anywhere as text: a character split by the cut is dropped."""
    def without(n: int) -> Column:
        return F.substring(cut, F.lit(1), F.length(cut) - n).cast("string")

    whole = cut.cast("string")
    options = [F.when(F.is_valid_utf8(x), x) for x in (whole, without(1), without(2), without(3))]
    return F.coalesce(*options, F.regexp_replace(F.make_valid_utf8(whole), "�", ""))
