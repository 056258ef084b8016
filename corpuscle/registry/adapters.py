"""The given tables in the shape the engine works on, as DataFrames and as SQL views.

Each shape is a projection or an equi join of whole tables, so it grows with them. Expressions
that both engines read alike are written once.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.registry.sql import view
from corpuscle.sources.files import LFS_POINTER

LONG_TEXTS = ("documents", "pages", "conversations")
MODEL = "given"  # the model name of the vectors in the embeddings table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables; those with long texts are dealt out when they come in fewer files than there are cores.

    A file of one row group is read by one task. Any large table comes in many files and nothing moves.
    """
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in LONG_TEXTS and len(rows.inputFiles()) < cores else rows


# Twenty repositories of three snapshots; documents of one twenty share their path's number, so several repositories
# have files of equal paths.
REPO = "'repo_' || CAST(doc_id % 20 AS STRING)"
SNAPSHOT = "CAST(1 + floor(doc_id / 20) % 3 AS BIGINT)"

# ── Documents as files ────────────────────────────────────────────────────────

FILE_PATH = """
lang || '/' || CASE WHEN doc_id % 19 = 4 THEN 'node_modules/' WHEN doc_id % 19 = 9 THEN 'build/'
ELSE '' END || 'doc_' || CAST(CAST(floor(doc_id / 20) AS BIGINT) AS STRING) || CASE
WHEN doc_id % 23 = 12 THEN '/.env.local' WHEN doc_id % 10 = 0 THEN '.py'
WHEN doc_id % 10 = 1 THEN '.TS' WHEN doc_id % 10 = 2 THEN '/bundle.min.js'
WHEN doc_id % 10 = 3 THEN '/Cargo.lock' WHEN doc_id % 10 = 4 THEN '/requirements-dev.txt'
WHEN doc_id % 10 = 5 THEN '/Package.json' WHEN doc_id % 10 = 6 THEN '/.env.example'
WHEN doc_id % 10 = 7 THEN '/README.md' WHEN doc_id % 10 = 8 THEN '/index.tsx'
ELSE '.tar.txt' END
"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files with names of every kind; some bytes make pointers, binaries, bad UTF-8."""
    raw = F.encode("text", "utf-8")
    pointer = F.encode(F.lit(LFS_POINTER + "\n"), "utf-8")
    content = (
        F.when(F.expr("doc_id % 17 = 3"), F.concat(pointer, raw))
        .when(F.expr("doc_id % 17 = 5"), F.concat(F.unhex(F.lit("00")), raw))
        .when(F.expr("doc_id % 17 = 7"), F.concat(F.unhex(F.lit("FF")), raw))
        .otherwise(raw)
    )
    return table(spark, sf, "documents").select(
        F.expr(REPO).alias("repo"),
        F.expr(SNAPSHOT).alias("snapshot_id"),
        F.expr(FILE_PATH).alias("path"),
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        content.alias("content"),
    )


view(
    "v_files",
    f"""
SELECT repo, snapshot_id, path, CAST(octet_length(content) AS BIGINT)
  AS size_bytes, content
FROM (SELECT {REPO} AS repo, {SNAPSHOT} AS snapshot_id, {FILE_PATH} AS path,
  CASE doc_id % 17 WHEN 3 THEN encode('{LFS_POINTER}' || chr(10)) || encode(text)
  WHEN 5 THEN '\\x00'::BLOB || encode(text) WHEN 7 THEN '\\xFF'::BLOB || encode(text)
  ELSE encode(text) END AS content FROM documents)
""",
)

# ── Documents as text files with every kind of line ───────────────────────────

LINED_TEXT = """
CASE doc_id % 5 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10))
WHEN 1 THEN chr(10) || replace(text, '. ', '.' || chr(10) || chr(10) || ' ' || chr(10)) || chr(10)
ELSE text END
"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as (repo, path, text); some with CRLF, some with runs of blank lines."""
    return table(spark, sf, "documents").select(
        F.expr(REPO).alias("repo"),
        F.expr("'doc_' || CAST(doc_id AS STRING)").alias("path"),
        F.expr(LINED_TEXT).alias("text"),
    )


view("v_texts", f"SELECT 'doc_' || doc_id AS path, {LINED_TEXT} AS text FROM documents")
view(
    "v_lists",
    """
SELECT path, CASE WHEN text = '' THEN [] ELSE string_split(
  regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) END AS lines
FROM v_texts
""",
)
view(
    "v_lines",
    """
SELECT path, CAST(unnest(range(1, len(lines) + 1)) AS INTEGER) AS line_no, unnest(lines) AS line,
  len(lines) AS total
FROM v_lists
""",
)


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as markdown (path, text): headings become ATX lines, lists become fenced blocks."""
    text = F.col("html")
    for level in range(1, 7):
        text = F.regexp_replace(text, f"<h{level}[^>]*>", "\n" + "#" * level + " ")
    text = F.regexp_replace(text, "</?(?:h[1-6]|p)>", "\n")
    text = F.regexp_replace(text, "</?ul[^>]*>", "\n```\n")
    return table(spark, sf, "pages").select(F.col("url").alias("path"), text.alias("text"))


_HEADINGS = "html"
for _level in range(1, 7):
    _HEADINGS = (
        f"regexp_replace({_HEADINGS}, '<h{_level}[^>]*>', chr(10) || '{'#' * _level} ', 'g')"
    )
view(
    "v_markdown",
    f"""
SELECT url AS path, regexp_replace(regexp_replace({_HEADINGS}, '</?(?:h[1-6]|p)>', chr(10), 'g'),
  '</?ul[^>]*>', chr(10) || '```' || chr(10), 'g') AS text FROM pages
""",
)

# ── Documents as outlined source files ────────────────────────────────────────
#
# In a file of n lines, lines 10c+2 .. 10c+9 are class c; in it, lines 10c+4 .. 10c+6 are function
# 2c and lines 10c+8 .. 10c+9 are function 2c+1; lines 10c+5 .. 10c+6 are a function inside 2c.

OUTLINE_PATH = """
'src/part_' || CAST(CAST(floor(doc_id / 20) AS BIGINT) AS STRING) ||
CASE WHEN floor(doc_id / 20) % 2 = 0 THEN '.py' ELSE '.ts' END
"""


def outlines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(files, symbols): documents as source files, and definitions at regular lines of them."""
    sources = table(spark, sf, "documents").select(
        F.expr(REPO).alias("repo"), F.expr(SNAPSHOT).alias("snapshot_id"), F.expr(OUTLINE_PATH).alias("path"), "text"
    )
    total = F.size(tx.line_array(F.col("text")))

    def definition(kind: str, name: str, start: int, end: int, order: int):
        return lambda c: F.struct(
            (c * 4 + order).alias("ord"),
            F.lit(kind).alias("kind"),
            F.concat(F.lit(name), c.cast("string")).alias("name"),
            (c * 10 + start).alias("start_line"),
            F.least(c * 10 + end, F.col("n")).alias("end_line"),
            F.concat(F.lit(f"{kind} {name}"), c.cast("string")).alias("signature"),
            F.concat(F.lit(f"About {name}"), c.cast("string")).alias("doc"),
            F.when(F.lit(order == 1), c * 10 + start - 1).alias("doc_start_line"),
        )

    kinds = (
        ("class", "Part", 2, 9, 1),
        ("function", "first", 4, 6, 2),
        ("function", "inner", 5, 6, 3),
        ("function", "last", 8, 9, 4),
    )
    blocks = F.sequence(F.lit(0), F.floor(F.col("n") / 10).cast("int"))
    made = F.flatten(F.array(*[F.transform(blocks, definition(*k)) for k in kinds]))
    module = F.array(
        F.struct(
            F.lit(0).alias("ord"),
            F.lit("module").alias("kind"),
            tx.stem(F.col("path")).alias("name"),
            F.lit(1).alias("start_line"),
            F.col("n").alias("end_line"),
            F.lit(None).cast("string").alias("signature"),
            F.lit(None).cast("string").alias("doc"),
            F.lit(None).cast("int").alias("doc_start_line"),
        )
    )
    symbols = (
        sources.select("repo", "snapshot_id", "path", total.alias("n"))
        .select("repo", "snapshot_id", "path", F.inline_outer(F.concat(module, F.filter(made, lambda s: s["start_line"] <= F.col("n")))))
    )
    return sources, symbols


# In the SQL of outlines a file is named by repository, snapshot and path in one string.
view("v_sources", f"SELECT {REPO} || '|' || {SNAPSHOT} || '|' || {OUTLINE_PATH} AS path, text FROM documents")
PLACE_SQL = (
    "split_part(path, '|', 1) AS repo, CAST(split_part(path, '|', 2) AS BIGINT) AS snapshot_id, split_part(path, '|', 3) AS path"
)
view(
    "v_source_lists",
    """
SELECT path, CASE WHEN text = '' THEN [] ELSE string_split(
  regexp_replace(text, '\\n$', ''), chr(10)) END AS lines FROM v_sources
""",
)
view(
    "v_source_lines",
    """
SELECT path, CAST(unnest(range(1, len(lines) + 1)) AS INTEGER) AS n, unnest(lines) AS line
FROM v_source_lists
""",
)
view(
    "v_symbols",
    """
SELECT path, CAST(0 AS INTEGER) AS ord, 'module' AS kind,
  regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]+$', '\\1') AS name, 1 AS start_line,
  CAST(len(lines) AS INTEGER) AS end_line, CAST(NULL AS VARCHAR) AS signature,
  CAST(NULL AS VARCHAR) AS doc, CAST(NULL AS INTEGER) AS doc_start_line
FROM v_source_lists
UNION ALL
SELECT path, CAST(c * 4 + o AS INTEGER), kind, label || c, CAST(c * 10 + s AS INTEGER),
  CAST(least(c * 10 + e, n) AS INTEGER), kind || ' ' || label || c, 'About ' || label || c,
  CAST(CASE WHEN o = 1 THEN c * 10 + s - 1 END AS INTEGER)
FROM (SELECT path, len(lines) AS n, unnest(range(0, len(lines) // 10 + 1)) AS c
  FROM v_source_lists),
  (VALUES ('class', 'Part', 2, 9, 1), ('function', 'first', 4, 6, 2),
    ('function', 'inner', 5, 6, 3), ('function', 'last', 8, 9, 4)) AS k(kind, label, s, e, o)
WHERE c * 10 + s <= n
""",
)

# ── Documents as chunks ───────────────────────────────────────────────────────


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk per document; its source is the snapshot."""
    text = F.col("text")
    return table(spark, sf, "documents").select(
        F.expr("CAST(substr(source, 4) AS BIGINT)").alias("snapshot_id"),
        F.col("doc_id").alias("chunk_id"),
        text,
        tx.content_hash(text).alias("content_hash"),
        tx.estimate_tokens(text).alias("tokens"),
    )


view(
    "v_chunks",
    """
SELECT CAST(substr(source, 4) AS BIGINT) AS snapshot_id, doc_id AS chunk_id, text,
  sha256(text) AS content_hash, CAST((strlen(text) + 2) // 3 AS INTEGER) AS tokens
FROM documents
""",
)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The given vectors as those of the documents with their ids, one per distinct text."""
    documents = table(spark, sf, "documents").select(
        F.col("doc_id").alias("vec_id"), tx.content_hash(F.col("text")).alias("content_hash")
    )
    return (
        table(spark, sf, "embeddings")
        .join(documents, "vec_id")
        .groupBy("content_hash")
        .agg(F.min_by("embedding", "vec_id").alias("embedding"))
        .select("content_hash", F.lit(MODEL).alias("model"), "embedding")
    )


view(
    "v_vectors",
    f"""
SELECT sha256(text) AS content_hash, '{MODEL}' AS model, arg_min(embedding, vec_id) AS embedding
FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY 1
""",
)

# ── Documents as a searchable corpus ──────────────────────────────────────────
#
# Three documents make one symbol in three parts, thirty make one file. Some symbols are modules
# or classes, some chunks are unnamed windows. Documents with a language are snapshot 1.

SYMBOL_NO = "CAST(floor(doc_id / 3) AS BIGINT)"
MODULE_NO = "CAST(floor(doc_id / 30) AS BIGINT)"
CORPUS = f"""
CAST(lang IS NOT NULL AS BIGINT) AS snapshot_id, doc_id AS chunk_id,
'src/m' || CAST({MODULE_NO} AS STRING) || '.py' AS path,
CASE WHEN {SYMBOL_NO} % 7 = 3 THEN 'window' WHEN {SYMBOL_NO} % 5 = 0 THEN 'module'
  WHEN {SYMBOL_NO} % 5 = 1 THEN 'class' ELSE 'function' END AS kind,
CASE WHEN {SYMBOL_NO} % 7 <> 3 THEN 'doc_' || CAST({SYMBOL_NO} AS STRING) END AS name,
CASE WHEN {SYMBOL_NO} % 7 <> 3 THEN 'src.m' || CAST({MODULE_NO} AS STRING) || '.doc_'
  || CAST({SYMBOL_NO} AS STRING) END AS qualname,
CAST(CASE WHEN {SYMBOL_NO} % 7 = 3 THEN 0 ELSE doc_id % 3 + 1 END AS INT) AS part,
CAST((doc_id % 30) * 40 + 1 AS INT) AS start_line, CAST((doc_id % 30) * 40 + 40 AS INT) AS end_line,
CASE WHEN {SYMBOL_NO} % 5 > 1 THEN 'def doc_' || CAST({SYMBOL_NO} AS STRING) || '(text)' END
  AS signature,
lang AS doc, text
"""


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks of one snapshot, with places, names and search fields."""
    text = F.col("text")
    return (
        table(spark, sf, "documents")
        .selectExpr(*_split_aliases(CORPUS))
        .withColumn("content_hash", tx.content_hash(text))
        .withColumn("tokens", tx.estimate_tokens(text))
        .withColumn("search_a", tx.search_text(F.col("name"), F.col("qualname")))
        .withColumn("search_b", tx.search_text(F.col("signature"), F.col("doc")))
        .withColumn("search_c", tx.split_identifiers(text))
    )


def _split_aliases(projection: str) -> list[str]:
    """A projection list cut at its top-level commas."""
    parts, depth, current = [], 0, ""
    for ch in projection:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [p.strip() for p in [*parts, current]]


def split_sql(text: str) -> str:
    """SQL for `split_identifiers`: the boundaries that need no look-around, one after another."""
    spaced = "t"
    for boundary in (
        "(\\p{Lu})(\\p{Lu}\\p{Ll})",
        "(\\p{Ll})(\\p{Lu})",
        "(\\p{L})(\\p{N})",
        "(\\p{N})(\\p{L})",
    ):
        spaced = f"regexp_replace({spaced}, '{boundary}', '\\1 \\2', 'g')"
    parts = f"list_filter(regexp_split_to_array({spaced}, '[^\\p{{L}}\\p{{N}}]+'), lambda p: p <> '')"
    words = f"list_filter(regexp_split_to_array({text}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda t: t <> '')"
    return (
        f"array_to_string(flatten(list_transform({words}, lambda t: CASE WHEN len({parts}) > 1 "
        f"THEN list_concat([t], {parts}) ELSE [t] END)), ' ')"
    )


def terms_sql(text: str) -> str:
    """SQL for `index_terms`."""
    return (
        f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda t: t <> '')"
    )


view(
    "v_corpus",
    f"""
SELECT *, sha256(text) AS content_hash, CAST((strlen(text) + 2) // 3 AS INTEGER) AS tokens,
  {split_sql("concat_ws(' ', name, qualname)")} AS search_a,
  {split_sql("concat_ws(' ', signature, doc)")} AS search_b, {split_sql("text")} AS search_c
FROM (SELECT {CORPUS} FROM documents)
""",
)


def plans(spark: SparkSession, sf: str) -> DataFrame:
    """One plan per benchmark text: identifiers that name a symbol of the corpus in three ways."""
    no = F.col("item_id").cast("string")
    module = F.floor(F.col("item_id") / 10).cast("string")
    dotted = F.concat(F.lit("m"), module, F.lit(".doc_"), no)
    none = F.array().cast("array<string>")
    identifiers = (
        F.when(F.expr("item_id % 4 = 0"), F.array(F.concat(F.lit("src."), dotted), F.lit("Unknown")))
        .when(F.expr("item_id % 4 = 1"), F.array(F.concat(F.lit("doc_"), no), dotted))
        .when(F.expr("item_id % 4 = 2"), F.array(dotted))
        .otherwise(none)
    )
    intent = F.element_at(
        F.array(F.lit("lookup"), F.lit("explain"), F.lit("enumerate")),
        (F.col("item_id") % 3 + 1).cast("int"),
    )
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").isNotNull().cast("bigint").alias("snapshot_id"),
        F.col("text").alias("query"),
        identifiers.alias("identifiers"),
        intent.alias("intent"),
    )


view(
    "v_plans",
    """
SELECT item_id AS query_id, CAST(1 AS BIGINT) AS snapshot_id, text AS query,
  CASE item_id % 4 WHEN 0 THEN ['src.' || dotted, 'Unknown'] WHEN 1 THEN ['doc_' || item_id, dotted]
    WHEN 2 THEN [dotted] ELSE [] END AS identifiers,
  CASE item_id % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'explain' ELSE 'enumerate' END AS intent
FROM (SELECT *, 'm' || (item_id // 10) || '.doc_' || item_id AS dotted FROM benchmark)
""",
)


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vector of each plan: the given one with its id, turned around for every fourth."""
    sign = F.when(F.expr("vec_id % 4 = 3"), F.lit(-1.0)).otherwise(F.lit(1.0))
    turned = F.transform("embedding", lambda x: (x * sign).cast("float"))
    return (
        table(spark, sf, "embeddings")
        .join(table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id")
        .select(F.col("vec_id").alias("query_id"), turned.alias("embedding"))
    )


view(
    "v_query_vectors",
    """
SELECT vec_id AS query_id, CASE WHEN vec_id % 4 = 3 THEN
  list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding
FROM embeddings JOIN benchmark ON item_id = vec_id
""",
)
