"""Lines, symbols and chunks over the documents."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.operators import chunks as ch
from corpuscle.operators import lines as ln
from corpuscle.operators import symbols as sy
from corpuscle.plans.index import build_index
from corpuscle.registry import adapters as ad
from corpuscle.registry import files as rf
from corpuscle.registry.adapters import split_sql, table
from corpuscle.registry.sql import select, view


KEY = ln.FILE_KEY


def body_hash() -> Column:
    """A body's text, hashed."""
    return tx.content_hash(tx.join_lines(F.col("body"))).alias("body_hash")


# ── Lines ─────────────────────────────────────────────────────────────────────


def number_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ln.number_lines(ad.texts(spark, sf))


def line_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = ln.line_windows(ad.texts(spark, sf))
    return rows.select("path", "start_line", "end_line", body_hash())


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as function bodies with a signature and a doc."""
    rows = ln.with_lines(ad.texts(spark, sf))
    return rows.select(
        "path",
        F.lit("function").alias("kind"),
        F.lit(None).cast("string").alias("name"),
        F.concat(F.lit("m."), "path").alias("qualname"),
        F.array(F.concat(F.lit("def "), "path", F.lit("()"))).alias("lead"),
        F.array(F.lit("What it does.")).alias("first_lead"),
        F.col("lines").alias("body"),
        F.lit(1).alias("start_line"),
        F.size("lines").alias("end_line"),
    )


def weighted_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ln.weighted_windows(bodies(spark, sf)).select(
        "path", "part", "parts", "start_line", "end_line", F.array_join("lead", "\n").alias("lead"),
        body_hash(),
    )


def collapse_blanks(spark: SparkSession, sf: str) -> DataFrame:
    kept = ln.collapse_blanks(bodies(spark, sf))
    return kept.select("path", F.inline("body")).withColumnRenamed("n", "line_no")


def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = ln.markdown_sections(ad.markdown(spark, sf))
    return rows.select("path", "name", "start_line", "end_line", body_hash())


def manifest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    files = rf.routed(spark, sf).filter("mode = 'windows'").select("path", "text")
    rows = ch.manifest_chunks(files)
    return rows.select("path", "name", "start_line", "end_line", body_hash())


# ── Symbols ───────────────────────────────────────────────────────────────────


PYTHON_PATH = "'pkg/doc_' || CAST(CAST(floor(doc_id / 20) AS BIGINT) AS STRING) || '.py'"


def python_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a Python file: a class with one method per line, which holds a function
    for every third line; one document in nine ends in a header that never closes."""
    def method(x: Column, i: Column) -> Column:
        word = F.trim(F.regexp_replace(x, r"[^a-z \p{L}\p{N}]+", ""))
        n = (i + 1).cast("string")
        doc = F.concat(F.lit('        """'), word, F.lit('\n\n            More.\n        """\n'))
        inner = F.when(
            (i + 1) % 3 == 0, F.concat(F.lit("        def inner_"), n, F.lit("():\n            pass\n"))
        ).otherwise(F.lit(""))
        return F.concat(
            F.lit("    @staticmethod\n    async def line_"), n, F.lit("(\n        text: str = 'é',\n    ):\n"),
            doc, inner, F.lit("        return text\n"),
        )

    methods = F.transform(F.col("lines"), method)
    broken = F.when(F.expr("doc_id % 9 = 4"), F.lit("def broken(\n")).otherwise(F.lit(""))
    return (
        table(spark, sf, "documents")
        .withColumn("lines", tx.line_array(F.col("text")))
        .select(
            F.expr(ad.REPO).alias("repo"),
            F.expr(PYTHON_PATH).alias("path"),
            F.concat(
                F.lit("class Doc:\n    size = 1\n\n"), F.array_join(methods, "\n"), broken
            ).alias("text"),
        )
    )


def python_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return sy.python_symbols(python_sources(spark, sf)).drop("doc_start_line")


def symbol_nesting(spark: SparkSession, sf: str) -> DataFrame:
    _, symbols = ad.outlines(spark, sf)
    return sy.symbol_nesting(symbols).select(*KEY, "ord", "kind", "name", "parent", "qualname")


def _outline_bodies(spark: SparkSession, sf: str, operator) -> DataFrame:
    files, symbols = ad.outlines(spark, sf)
    return operator(symbols, files).select(
        *KEY, "kind", "qualname", "start_line", "end_line",
        F.transform("body", lambda x: x["n"]).cast("string").alias("lines"), body_hash(),
    )


def span_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _outline_bodies(spark, sf, sy.span_chunks)


def class_skeletons(spark: SparkSession, sf: str) -> DataFrame:
    return _outline_bodies(spark, sf, sy.class_skeletons)


def module_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    return _outline_bodies(spark, sf, sy.module_uncovered)


def doc_prefix(spark: SparkSession, sf: str) -> DataFrame:
    _, symbols = ad.outlines(spark, sf)
    rows = sy.doc_prefix(symbols)
    return rows.select(
        *KEY, "ord", F.array_join("lead", "|").alias("lead"),
        F.array_join("first_lead", "|").alias("first_lead"),
    )


# ── Chunk text ────────────────────────────────────────────────────────────────


def clean_block_comment(spark: SparkSession, sf: str) -> DataFrame:
    comment = F.concat(F.lit("/**"), F.replace("text", F.lit("\n"), F.lit("\n  * ")), F.lit(" */"))
    return table(spark, sf, "documents").select(
        "doc_id", tx.clean_block_comment(comment).alias("comment")
    )


def chunk_header(spark: SparkSession, sf: str) -> DataFrame:
    columns = [F.col(c) for c in ("path", "kind", "name", "qualname", "part")]
    name = F.when(F.expr("chunk_id % 2 = 0"), F.col("name"))
    qualname = F.when(F.expr("chunk_id % 3 = 0"), F.col("qualname"))
    header = tx.chunk_header(columns[0], columns[1], name, qualname, columns[4], F.lit(3))
    return ad.corpus(spark, sf).select("chunk_id", header.alias("header"))


def estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", tx.estimate_tokens(F.col("text")).alias("tokens")
    )


def cap_chunk(spark: SparkSession, sf: str) -> DataFrame:
    whole = bodies(spark, sf).withColumns({"part": F.lit(0), "parts": F.lit(0)})
    rows = ch.cap_chunk(whole.filter(F.size("body") > 0))
    return rows.select("path", "end_line", "truncated", body_hash())


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", tx.content_hash(F.col("text")).alias("content_hash")
    )


def split_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    def rows(name: str, key: str, text: str) -> DataFrame:
        given = table(spark, sf, name)
        key_text = F.concat(F.lit(f"{name} "), F.col(key).cast("string"))
        return given.select(key_text.alias("key"), F.col(text).alias("text"))

    everything = (
        rows("documents", "doc_id", "text")
        .unionByName(rows("pages", "page_id", "html"))
        .unionByName(rows("customer", "c_custkey", "c_name"))
        .unionByName(rows("part", "p_partkey", "p_brand"))
    )
    return everything.select(
        "key", tx.content_hash(tx.split_identifiers(F.col("text"))).alias("split_hash")
    )


def search_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as symbols: qualified by region and nation, described by segment."""
    symbols = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("chunk_id"),
            F.col("c_name").alias("name"),
            F.concat_ws(".", "r_name", "n_name", "c_name").alias("qualname"),
            F.when(F.expr("c_acctbal > 0"), F.col("c_mktsegment")).alias("signature"),
            F.lit(None).cast("string").alias("doc"),
            F.concat(F.lit("balanceOf("), "c_name", F.lit(")")).alias("code"),
        )
    )
    return ch.search_fields(symbols).select("chunk_id", "search_a", "search_b", "search_c")


def chunk_key_check(spark: SparkSession, sf: str) -> DataFrame:
    """Events as chunks: those of one user, type and value range share a key."""
    chunks = table(spark, sf, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("path"),
        F.expr("event_id % 2").alias("snapshot_id"),
        F.col("event_type").alias("kind"),
        F.when(F.expr("event_type <> 'view'"), F.col("event_type")).alias("qualname"),
        F.floor("value").cast("int").alias("start_line"),
        F.lit(0).alias("part"),
    )
    return ch.chunk_key_check(chunks)


def chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    """The whole index job over the documents' files: triage, parsing, chunking, hashing."""
    index = build_index(ad.files(spark, sf))
    return index.chunks.select(
        "repo", "path", "kind", "name", "qualname", "part", "start_line", "end_line", "tokens",
        "truncated", "content_hash",
    )


QUERIES = {
    "number_lines": number_lines,
    "line_windows": line_windows,
    "weighted_windows": weighted_windows,
    "collapse_blanks": collapse_blanks,
    "markdown_sections": markdown_sections,
    "manifest_chunks": manifest_chunks,
    "python_symbols": python_symbols,
    "symbol_nesting": symbol_nesting,
    "span_chunks": span_chunks,
    "class_skeletons": class_skeletons,
    "module_uncovered": module_uncovered,
    "doc_prefix": doc_prefix,
    "clean_block_comment": clean_block_comment,
    "chunk_header": chunk_header,
    "estimate_tokens": estimate_tokens,
    "cap_chunk": cap_chunk,
    "content_hash": content_hash,
    "split_identifiers": split_identifiers,
    "search_fields": search_fields,
    "chunk_key_check": chunk_key_check,
    "chunk_files": chunk_files,
}

# ── Reference SQL ─────────────────────────────────────────────────────────────

NL = "chr(10)"
BLANK = "NOT regexp_matches({0}, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]')"

view(
    "v_weights",
    """
SELECT path, lines, [CAST(0 AS BIGINT)] || list_transform(range(1, len(lines) + 1),
  lambda i: CAST(list_sum(list_transform(lines[1:i], lambda l: (strlen(l) + 3) // 3)) AS BIGINT))
  AS p, (strlen('' || path || ' :: m.' || path || ' (function)' || chr(10) || 'def ' || path || '()'
  || chr(10) || 'What it does.' || chr(10) || array_to_string(lines, chr(10))) + 2) // 3 AS tokens
FROM v_lists WHERE len(lines) > 0
""",
)
view(
    "r_windows",
    """
SELECT path, lines, p, CAST(0 AS BIGINT) AS s, greatest(1, len(list_filter(p, lambda x: x <= 1200)) - 1)
  AS e, 1 AS part FROM v_weights WHERE tokens > 1200
UNION ALL
SELECT path, lines, p, ns, greatest(ns + 1, len(list_filter(p, lambda x: x <= p[ns + 1] + 1200)) - 1),
  part + 1
FROM (SELECT *, greatest(s + 1, len(list_filter(p, lambda x: x <= p[e + 1] - 150)) - 1) AS ns
  FROM r_windows WHERE e < len(lines))
""",
)
view(
    "v_nested",
    """
SELECT i.path, i.ord, i.kind, i.name, i.start_line, i.end_line, i.signature, i.doc_start_line,
  max(o.ord) AS parent_ord
FROM v_symbols i LEFT JOIN v_symbols o ON o.path = i.path AND o.ord < i.ord
  AND o.start_line <= i.start_line AND o.end_line >= i.end_line
GROUP BY ALL
""",
)
view(
    "v_positions",
    """
SELECT path, ord, CAST(row_number() OVER (PARTITION BY path ORDER BY ord) - 1 AS INTEGER) AS at
FROM v_symbols
""",
)
view(
    "v_qualified",
    """
SELECT c.path, c.ord, c.name, c.start_line, c.end_line, c.signature, c.doc_start_line, c.parent_ord,
  a.at AS parent,
  CASE WHEN c.kind = 'function' AND p.kind = 'class' THEN 'method' ELSE c.kind END AS kind,
  replace(regexp_replace(split_part(c.path, '|', 3), '([^/])\\.[^./]+$', '\\1'), '/', '.')
    || CASE WHEN g.name IS NOT NULL AND g.kind <> 'module' THEN '.' || g.name ELSE '' END
    || CASE WHEN p.name IS NOT NULL AND p.kind <> 'module' THEN '.' || p.name ELSE '' END
    || CASE WHEN c.kind <> 'module' THEN '.' || c.name ELSE '' END AS qualname
FROM v_nested c LEFT JOIN v_nested p ON p.path = c.path AND p.ord = c.parent_ord
LEFT JOIN v_nested g ON g.path = c.path AND g.ord = p.parent_ord
LEFT JOIN v_positions a ON a.path = c.path AND a.ord = c.parent_ord
""",
)
view(
    "v_children",
    """
SELECT path, parent_ord, least(coalesce(doc_start_line, start_line), start_line) AS first_line,
  start_line, end_line, signature FROM v_qualified WHERE kind <> 'module'
""",
)
view(
    "v_skeleton",
    """
SELECT s.path, s.kind, s.qualname, s.start_line, s.end_line, l.n, coalesce((
    SELECT max(regexp_extract(l.line, '^\\s*') || c.signature) FROM v_children c
    WHERE c.path = s.path AND c.parent_ord = s.ord AND c.first_line = l.n), l.line) AS line
FROM v_qualified s JOIN v_source_lines l ON l.path = s.path AND l.n BETWEEN s.start_line AND s.end_line
WHERE s.kind = 'class' AND NOT EXISTS (SELECT 1 FROM v_children c WHERE c.path = s.path
  AND c.parent_ord = s.ord AND l.n > c.first_line AND l.n <= c.end_line)
""",
)
view(
    "v_remainder",
    """
SELECT s.path, s.kind, s.qualname, s.start_line, s.end_line, l.n, l.line
FROM v_qualified s JOIN v_source_lines l ON l.path = s.path
WHERE s.kind = 'module' AND NOT EXISTS (SELECT 1 FROM v_children c WHERE c.path = s.path
  AND c.parent_ord = s.ord AND l.n BETWEEN c.first_line AND c.end_line)
""",
)


def collapsed(rows: str, key: str, n: str, keep: str) -> str:
    """SQL that collapses blank lines of `rows` per key."""
    blank = BLANK.format("line")
    return f"""
SELECT {keep}, {n}, line FROM (SELECT *, {blank} AS blank,
    lag({blank}) OVER (PARTITION BY {key} ORDER BY {n}) AS above,
    max(CASE WHEN NOT {blank} THEN {n} END) OVER (PARTITION BY {key}) AS last_text FROM {rows})
WHERE NOT blank OR (above = false AND {n} < last_text)
"""


def body_rows(rows: str) -> str:
    """SQL for one row per body from its lines."""
    return f"""
SELECT {ad.PLACE_SQL}, kind, qualname, start_line, end_line, CAST(list(n ORDER BY n) AS VARCHAR) AS lines,
  sha256(string_agg(line, {NL} ORDER BY n)) AS body_hash
FROM ({rows}) GROUP BY path, kind, qualname, start_line, end_line
"""


_PLACE = "path, kind, qualname, start_line, end_line"
_CUT = """list_max(list_filter(range(0, length(lines[1]) + 1),
    lambda n: strlen(left(lines[1], n)) <= budget))"""

view(
    "v_headings",
    """
SELECT path, n, line, total, marks % 2 = 1 OR mark AS fenced, CASE WHEN NOT mark AND marks % 2 = 0
  AND regexp_matches(line, '^ {0,3}#{1,6}([ \\t]|$)') THEN
  trim(regexp_replace(trim(regexp_replace(line, '^ {0,3}#{1,6}', ''), ' ' || chr(9)), '#+$', ''),
    ' ' || chr(9)) END AS title
FROM (SELECT *, CAST(sum(CAST(mark AS INTEGER)) OVER (PARTITION BY path ORDER BY n
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before,
    coalesce(before, 0) AS marks
  FROM (SELECT *, ltrim(line, ' ' || chr(9)) LIKE '```%' AS mark
    FROM (SELECT path, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS n, unnest(l) AS line,
        len(l) AS total
      FROM (SELECT path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l
        FROM v_markdown))))
""",
)
view(
    "v_sections",
    """
SELECT *, sum(CAST(title IS NOT NULL AS INTEGER)) OVER (PARTITION BY path ORDER BY n) AS section
FROM v_headings
""",
)
_DOC = "regexp_replace(line, '[^\\p{L}\\p{N} ]+', '', 'g')"
view(
    "v_python",
    f"""
SELECT repo, path, broken, i, n, 4 + 10 * (i - 1) + 2 * ((i - 1) // 3) AS top, i % 3 = 0 AS has_inner, word
FROM (SELECT repo, path, broken, unnest(range(1, len(l) + 1)) AS i, len(l) AS n,
    unnest(list_transform(l, lambda x: trim(regexp_replace(x, '[^\\p{{L}}\\p{{N}} ]+', '', 'g')))) AS word
  FROM (SELECT {ad.REPO} AS repo, {PYTHON_PATH} AS path, doc_id % 9 = 4 AS broken, CASE WHEN text = '' THEN [] ELSE
    string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS l FROM documents))
""",
)

ORACLES = {
    "number_lines": select(
        "SELECT 'repo_' || CAST(substr(path, 5) AS BIGINT) % 20 AS repo, path, line_no, line FROM v_lines"
    ),
    "line_windows": select(
        f"""
SELECT path, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 80, len(lines)) AS INTEGER)
  AS end_line, sha256(array_to_string(lines[s + 1:s + 80], {NL})) AS body_hash
FROM (SELECT path, lines, unnest(generate_series(0, CAST(greatest(ceil((len(lines) - 80) / 65.0), 0)
  AS BIGINT))) * 65 AS s FROM v_lists WHERE len(lines) > 0)
WHERE len(list_filter(lines[s + 1:s + 80], lambda l: NOT ({BLANK.format("l")}))) > 0
"""
    ),
    "weighted_windows": select(
        f"""
SELECT path, CAST(part AS INTEGER) AS part, CAST(max(part) OVER (PARTITION BY path) AS INTEGER)
  AS parts, CAST(s + 1 AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line,
  'def ' || path || '()' || CASE WHEN part = 1 THEN {NL} || 'What it does.' ELSE '' END AS lead,
  sha256(array_to_string(lines[s + 1:e], {NL})) AS body_hash FROM r_windows
UNION ALL
SELECT path, 0, 0, 1, CAST(len(lines) AS INTEGER), 'def ' || path || '()' || {NL} || 'What it does.',
  sha256(array_to_string(lines, {NL})) FROM v_weights
WHERE tokens <= 1200 AND NOT ({BLANK.format(f"array_to_string(lines, {NL})")})
"""
    ),
    "collapse_blanks": select(collapsed("v_lines", "path", "line_no", "path")),
    "markdown_sections": select(
        f"""
SELECT path, nullif(max(title), '') AS name, min(n) AS start_line, max(n) AS end_line,
  sha256(string_agg(line, {NL} ORDER BY n)) AS body_hash
FROM (SELECT k.path, k.section, k.n, k.line, t.title FROM (
    {collapsed("v_sections", "path, section", "n", "path, section")}) k
  LEFT JOIN v_sections t ON t.path = k.path AND t.section = k.section AND t.title IS NOT NULL)
GROUP BY path, section
"""
    ),
    "manifest_chunks": select(
        f"""
SELECT path, regexp_extract(path, '[^/]*$') AS name, CAST(1 AS INTEGER) AS start_line,
  CAST(len(l) AS INTEGER) AS end_line, sha256(array_to_string(l, {NL})) AS body_hash
FROM (SELECT path, string_split(regexp_replace(replace(text, chr(13) || {NL}, {NL}), '\\n$', ''), {NL})
  AS l FROM v_routed WHERE mode = 'windows'
  AND regexp_full_match(lower(regexp_extract(path, '[^/]*$')),
    'pyproject\\.toml|package\\.json|requirements.*\\.txt'))
"""
    ),
    "python_symbols": select(
        """
SELECT repo, path, CAST(broken AS INTEGER) AS parse_errors,
  CAST(0 AS INTEGER) AS ord, 'module' AS kind, regexp_extract(path, '(doc_[0-9]+)', 1) AS name,
  CAST(1 AS INTEGER) AS start_line, CAST(bottom + CAST(broken AS INTEGER) AS INTEGER) AS end_line,
  CAST(NULL AS VARCHAR) AS signature, CAST(NULL AS VARCHAR) AS doc
FROM (SELECT repo, path, broken, max(top + 8 + CASE WHEN has_inner THEN 2 ELSE 0 END) AS bottom
  FROM v_python GROUP BY ALL)
UNION ALL
SELECT repo, path, CAST(broken AS INTEGER), 1, 'class', 'Doc', 1,
  CAST(max(top + 8 + CASE WHEN has_inner THEN 2 ELSE 0 END) AS INTEGER), 'class Doc', NULL FROM v_python GROUP BY repo, path, broken
UNION ALL
SELECT repo, path, CAST(broken AS INTEGER), CAST(1 + i + (i - 1) // 3 AS INTEGER), 'function', 'line_' || i, CAST(top AS INTEGER),
  CAST(top + 8 + CASE WHEN has_inner THEN 2 ELSE 0 END AS INTEGER),
  'async def line_' || i || '( text: str = ''é'', )',
  CASE WHEN word = '' THEN 'More.' ELSE word || chr(10) || chr(10) || 'More.' END
FROM v_python
UNION ALL
SELECT repo, path, CAST(broken AS INTEGER), CAST(2 + i + (i - 1) // 3 AS INTEGER), 'function', 'inner_' || i,
  CAST(top + 8 AS INTEGER), CAST(top + 9 AS INTEGER), 'def inner_' || i || '()', NULL
FROM v_python WHERE has_inner
"""
    ),
    "symbol_nesting": select(
        f"SELECT {ad.PLACE_SQL}, ord, kind, name, parent, qualname FROM v_qualified"
    ),
    "span_chunks": select(
        body_rows(
            f"""
SELECT {', '.join('s.' + c for c in _PLACE.split(', '))}, n, line FROM v_qualified s
JOIN v_source_lines l ON l.path = s.path AND l.n BETWEEN s.start_line AND s.end_line
WHERE s.kind IN ('function', 'method')
"""
        )
    ),
    "class_skeletons": select(
        body_rows(collapsed("v_skeleton", "path, qualname", "n", _PLACE))
    ),
    "module_uncovered": select(
        body_rows(collapsed("v_remainder", "path, qualname", "n", _PLACE))
    ),
    "doc_prefix": select(
        f"""
SELECT {ad.PLACE_SQL}, ord, CASE WHEN kind = 'function' THEN signature ELSE '' END AS lead,
  CASE WHEN kind <> 'module' AND path NOT LIKE '%.py' THEN doc ELSE '' END AS first_lead
FROM v_symbols
"""
    ),
    "clean_block_comment": f"""
SELECT doc_id, nullif(trim(array_to_string(list_transform(string_split(
  regexp_replace(replace(text, {NL}, {NL} || '  * '), '$', ' '), {NL}),
  lambda l: trim(regexp_replace(trim(l), '^\\*', ''))), {NL}), ' ' || {NL}), '') AS comment
FROM documents
""",
    "chunk_header": select(
        """
SELECT chunk_id, path || CASE WHEN chunk_id % 3 = 0 AND qualname IS NOT NULL THEN ' :: ' || qualname
  WHEN chunk_id % 2 = 0 AND name IS NOT NULL THEN ' :: ' || name ELSE '' END || ' (' || kind ||
  CASE WHEN part > 0 THEN ', part ' || part || '/3' ELSE '' END || ')' AS header FROM v_corpus
"""
    ),
    "estimate_tokens": "SELECT doc_id, CAST(ceil(strlen(text) / 3) AS INTEGER) AS tokens FROM documents",
    "cap_chunk": select(
        f"""
SELECT path, CAST(CASE WHEN whole OR kept = 0 THEN CASE WHEN whole THEN len(lines) ELSE 1 END ELSE kept END
  AS INTEGER) AS end_line, NOT whole AS truncated, sha256(CASE WHEN whole THEN
  array_to_string(lines, {NL}) WHEN kept = 0 THEN left(lines[1], CAST({_CUT} AS BIGINT))
  ELSE array_to_string(lines[1:kept], {NL}) END) AS body_hash
FROM (SELECT *, strlen(array_to_string(lines, {NL})) <= budget AS whole,
    len(list_filter(range(1, len(lines) + 1),
      lambda i: strlen(array_to_string(lines[1:i], {NL})) <= budget)) AS kept
  FROM (SELECT path, lines, 12000 - strlen(path || ' :: m.' || path || ' (function)' || {NL} || 'def '
    || path || '()') - 1 AS budget FROM v_lists WHERE len(lines) > 0))
"""
    ),
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "split_identifiers": f"""
SELECT key, sha256({split_sql("text")}) AS split_hash FROM (
  SELECT 'documents ' || doc_id AS key, text FROM documents
  UNION ALL SELECT 'pages ' || page_id, html FROM pages
  UNION ALL SELECT 'customer ' || c_custkey, c_name FROM customer
  UNION ALL SELECT 'part ' || p_partkey, p_brand FROM part)
""",
    "search_fields": f"""
SELECT c_custkey AS chunk_id, {split_sql("c_name || ' ' || r_name || '.' || n_name || '.' || c_name")}
  AS search_a, {split_sql("CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END")} AS search_b,
  {split_sql("'balanceOf(' || c_name || ')'")} AS search_c
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "chunk_key_check": """
SELECT 'user_' || user_id AS path, event_id % 2 AS snapshot_id, event_type AS kind, CASE WHEN event_type <> 'view'
  THEN event_type ELSE '' END AS qualname, CAST(floor(value) AS INTEGER) AS start_line,
  CAST(0 AS INTEGER) AS part, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1
""",
}
