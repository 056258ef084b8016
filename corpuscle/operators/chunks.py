"""Chunk operators: bodies become capped, hashed, searchable chunks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.operators.lines import (
    file_key,
    line_windows,
    markdown_sections,
    weighted_windows,
    with_lines,
)
from corpuscle.operators.symbols import symbol_bodies
from corpuscle.sources.files import README_NAMES, glob_regex

# The chunk size limit in tokens and the manifests kept whole.
CAP_TOKENS = 4_000
MANIFESTS = ("pyproject.toml", "package.json", "requirements*.txt")


def is_manifest(path: Column) -> Column:
    """True for a dependency manifest, by its file name in any case."""
    return F.lower(tx.basename(path)).rlike(glob_regex(MANIFESTS))


def is_readme(path: Column) -> Column:
    """True for a markdown README, by its file name in any case."""
    return F.lower(tx.basename(path)).isin(*README_NAMES)


def manifest_chunks(files: DataFrame) -> DataFrame:
    """One body per manifest file, named by its file name; blank files give none."""
    rows = with_lines(files.filter(is_manifest(F.col("path"))))
    return (
        rows.withColumn("body", F.col("lines"))
        .filter(tx.any_text(F.col("body")))
        .withColumn("name", tx.basename(F.col("path")))
        .withColumn("start_line", F.lit(1))
        .withColumn("end_line", F.size("body"))
        .drop("lines", "text")
    )


# ── Cap, hash, search fields ──────────────────────────────────────────────────


def cap_lines(body: Column, budget: Column) -> Column:
    """(body, truncated): the longest run of first lines within `budget` bytes, joined by
    newlines; when even the first line is over, that line cut on a character boundary."""
    size = F.aggregate(
        body, F.lit(-1).cast("long"), lambda n, x: n + F.octet_length(x["line"]) + 1
    )
    state = F.struct(F.lit(0).alias("n"), F.lit(-1).cast("long").alias("used"))

    def take(acc: Column, x: Column) -> Column:
        used = acc["used"] + F.octet_length(x["line"]) + 1
        count = F.when(used <= budget, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(count.alias("n"), used.alias("used"))

    fit = F.aggregate(body, state, take, lambda acc: acc["n"])
    first = F.element_at(body, 1)
    cut = F.array(
        F.struct(first["n"].alias("n"), utf8_cut(first["line"], budget).alias("line"))
    )
    kept = tx.let(fit, lambda n: F.when(n > 0, F.slice(body, 1, n)).otherwise(cut))
    return F.when(
        size <= budget, F.struct(body.alias("body"), F.lit(False).alias("truncated"))
    ).otherwise(F.struct(kept.alias("body"), F.lit(True).alias("truncated")))


def utf8_cut(text: Column, budget: Column) -> Column:
    """The longest prefix of a string within `budget` UTF-8 bytes."""
    raw = F.encode(text, "utf-8")

    def prefix(less: int) -> Column:
        length = F.greatest(budget - less, F.lit(0)).cast("int")
        return F.substring(raw, F.lit(1), length).cast("string")

    options = [F.when(F.is_valid_utf8(p), p) for p in map(prefix, range(4))]
    return F.coalesce(*options, F.lit(""))


def cap_chunk(bodies: DataFrame, *, tokens: int = CAP_TOKENS) -> DataFrame:
    """Bodies cut to `tokens` with their header and lead lines; adds prefix and truncated, and
    moves end_line of a cut one to its last kept line."""
    header = tx.chunk_header(
        F.col("path"), F.col("kind"), F.col("name"), F.col("qualname"), F.col("part"),
        F.col("parts"),
    )
    budget = F.lit(tokens * tx.BYTES_PER_TOKEN) - F.octet_length("prefix") - 1
    return (
        bodies.withColumn("prefix", F.concat_ws("\n", F.array(header), "lead"))
        .withColumn("capped", cap_lines(F.col("body"), budget))
        .withColumn("body", F.col("capped.body"))
        .withColumn("truncated", F.col("capped.truncated"))
        .withColumn(
            "end_line",
            F.when(F.col("truncated"), F.element_at("body", -1)["n"]).otherwise(F.col("end_line")),
        )
        .drop("capped")
    )


def further_parts(bodies: DataFrame, *, tokens: int = CAP_TOKENS) -> DataFrame:
    """Bodies over `tokens` with their header and lead as further parts, so that `cap_chunk` cuts nothing; others as they are.

    Parts are runs of lines; a line that is over by itself is split between characters, each piece a part of its own. Piece k
    of part p of n becomes part p + k * n, so parts stay apart. A lead that leaves less than half of the
    room moves into the body.
    """
    part = F.greatest("part", F.lit(1))
    parts = F.greatest("parts", F.lit(1))
    widest = F.lit(2**31 - 1)  # room for any part number
    header = tx.chunk_header(
        F.col("path"), F.col("kind"), F.col("name"), F.col("qualname"), widest, widest
    )
    whole = tokens * tx.BYTES_PER_TOKEN

    def room(lead: Column) -> Column:
        return F.lit(whole) - F.octet_length(F.concat_ws("\n", F.array(header), lead)) - 1

    long_lead = room(F.col("lead")) < whole // 2
    moved = F.transform("lead", lambda x: F.struct(F.col("start_line").alias("n"), x.alias("line")))
    size = F.aggregate(
        "body", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["line"]) + 1
    )
    rows = bodies.withColumn("over", size > room(F.col("lead")))
    lead_moves = F.col("over") & long_lead
    rows = rows.withColumn(
        "body", F.when(lead_moves, F.concat(moved, "body")).otherwise(F.col("body"))
    ).withColumn("lead", F.when(lead_moves, F.slice("lead", 1, 0)).otherwise(F.col("lead")))
    rows = rows.withColumn("room", F.greatest(room(F.col("lead")), F.lit(64)))

    def pieces(x: Column) -> Column:
        ascii_only = F.octet_length(x["line"]) == F.char_length(x["line"])
        width = F.when(ascii_only, F.col("room")).otherwise(F.floor(F.col("room") / 4))
        pattern = F.concat(F.lit("(?s).{1,"), width.cast("string"), F.lit("}"))
        cut = F.regexp_extract_all(x["line"], pattern, F.lit(0))
        fits = F.octet_length(x["line"]) <= F.col("room")
        lines = F.when(fits, F.array(x["line"])).otherwise(cut)
        return F.transform(
            lines, lambda y: F.struct(x["n"].alias("n"), y.alias("line"), (~fits).alias("alone"))
        )

    def take(acc: Column, x: Column) -> Column:
        used = acc["used"] + F.octet_length(x["line"]) + 1
        new = (acc["at"] == 0) | x["alone"] | acc["alone"] | (used - 1 > F.col("room"))
        own = F.octet_length(x["line"]).cast("long") + 1
        return F.struct(
            F.when(new, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(new, own).otherwise(used).alias("used"),
            (acc["at"] + 1).alias("at"),
            x["alone"].alias("alone"),
        )

    state = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"),
        F.lit(False).alias("alone"),
    )
    rows = rows.withColumn("pieces", F.when(F.col("over"), F.flatten(F.transform("body", pieces))))
    rows = rows.withColumn("starts", F.when(F.col("over"), F.aggregate("pieces", state, take, lambda a: a["starts"])))
    rows = rows.select("*", F.posexplode(F.coalesce("starts", F.array(F.lit(0)))).alias("k", "s"))
    end = F.coalesce(F.get("starts", F.col("k") + 1), F.size("pieces"))
    some = F.slice("pieces", F.col("s") + 1, end - F.col("s"))
    lines = F.transform(some, lambda x: F.struct(x["n"].alias("n"), x["line"].alias("line")))
    over = F.col("over")
    many = over & (F.size("starts") > 1)
    return rows.withColumns(
        {
            "body": F.when(over, lines).otherwise(F.col("body")),
            "start_line": F.when(many, some[0]["n"]).otherwise(F.col("start_line")),
            "end_line": F.when(many, F.element_at(some, -1)["n"]).otherwise(F.col("end_line")),
            "part": F.when(many, part + F.col("k") * parts).otherwise(F.col("part")),
            "parts": F.when(many, parts * F.size("starts")).otherwise(F.col("parts")),
        }
    ).drop("over", "room", "pieces", "starts", "k", "s").select(*bodies.columns)


def search_fields(chunks: DataFrame) -> DataFrame:
    """Add search_a (name, qualname), search_b (signature, doc) and search_c (code)."""
    return (
        chunks.withColumn("search_a", tx.search_text(F.col("name"), F.col("qualname")))
        .withColumn("search_b", tx.search_text(F.col("signature"), F.col("doc")))
        .withColumn("search_c", tx.split_identifiers(F.col("code")))
    )


def finish_chunks(bodies: DataFrame) -> DataFrame:
    """Bodies with part numbers as finished chunks: capped text, hash, tokens, search fields."""
    capped = cap_chunk(bodies).withColumn("code", tx.join_lines(F.col("body")))
    texts = capped.withColumn("text", F.concat("prefix", F.lit("\n"), "code"))
    hashed = texts.withColumn("content_hash", tx.content_hash(F.col("text"))).withColumn(
        "tokens", tx.estimate_tokens(F.col("text"))
    )
    return with_ids(search_fields(hashed).drop("prefix", "lead", "parts", "code", "body"))


def with_ids(chunks: DataFrame) -> DataFrame:
    """Add `chunk_id`: 62 bits of a digest of the chunk's key, the same whenever the same file is indexed again.

    Keys are told apart by the digest's text, so names with separators in them do not meet; `chunk_key_check` over ids
    finds the two that would.
    """
    columns = [*file_key(chunks), "kind", "qualname", "start_line", "part"]
    key = F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]))
    digits = F.substring(F.sha2(key, 256), 1, 15)
    return chunks.withColumn("chunk_id", F.conv(digits, 16, 10).cast("bigint"))


def chunk_key_check(chunks: DataFrame) -> DataFrame:
    """Chunk keys that occur more than once: (file key, kind, qualname, start_line, part, n)."""
    return (
        chunks.withColumn("qualname", F.coalesce("qualname", F.lit("")))
        .groupBy(*file_key(chunks), "kind", "qualname", "start_line", "part")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )


# ── Files to chunks ───────────────────────────────────────────────────────────


def _plain(rows: DataFrame, kind: str) -> DataFrame:
    """Bodies of unparsed files with the columns symbol bodies have."""
    no_lines = F.array().cast("array<string>")
    null = F.lit(None).cast("string")
    with_name = rows if "name" in rows.columns else rows.withColumn("name", null)
    return (
        with_name.withColumn("kind", F.lit(kind))
        .withColumns({"qualname": null, "signature": null, "doc": null})
        .withColumns({"lead": no_lines, "first_lead": no_lines})
    )


def window_bodies(files: DataFrame) -> DataFrame:
    """Bodies of unparsed files with part and parts: manifests whole, READMEs by section,
    everything else in line windows."""
    path = F.col("path")
    whole = {"part": F.lit(0), "parts": F.lit(0)}
    manifests = _plain(manifest_chunks(files), "manifest").withColumns(whole).drop("first_lead")
    other = files.filter(~is_manifest(path))
    sections = weighted_windows(
        _plain(markdown_sections(other.filter(is_readme(path))), "window")
    )
    windows = _plain(line_windows(other.filter(~is_readme(path))), "window")
    windows = windows.withColumns(whole).drop("first_lead")
    return manifests.unionByName(sections).unionByName(windows)


def chunk_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks of routed files (path, text, mode): symbols for parsed ones, windows for others."""
    keep = [c for c in files.columns if c in ("repo", "snapshot_id", "path", "text")]
    parsed = files.filter("mode = 'symbols'").select(*keep)
    plain = files.filter("mode = 'windows'").select(*keep)
    extra = ("ord", "parent", "doc_start_line", "parse_errors")
    split = weighted_windows(symbol_bodies(parsed, symbols, every_file=True).drop(*extra))
    return finish_chunks(further_parts(split.unionByName(window_bodies(plain))))
