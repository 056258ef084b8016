"""Line operators: numbering, windows, blank collapsing, markdown sections.

A file is one row and its lines are an array in that row, so nothing here shuffles: the file
(at most 512 KB after triage) is the unit of work, however many files one repository has.

Arrays are exploded with the outer variants: the plain ones make the optimizer add a filter that
the array is not empty, and computing an array twice costs more than the filter saves.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as tx

# Window sizes, in lines and in estimated tokens, and their overlaps.
WINDOW_LINES, WINDOW_OVERLAP = 80, 15
PART_TOKENS, PART_OVERLAP = 1_200, 150
FENCES = ("```", "~~~")


# What tells files apart; a table of one repository may leave out the first two.
FILE_KEY = ("repo", "snapshot_id", "path")


def file_key(rows: DataFrame) -> list[str]:
    """The columns that tell the files of a table apart."""
    return [c for c in FILE_KEY if c in rows.columns]


def number_lines(files: DataFrame) -> DataFrame:
    """One row per line of each file: its key, line_no from 1, line."""
    lines = F.posexplode_outer(tx.line_array(F.col("text")))
    key = file_key(files)
    rows = files.select(*key, lines.alias("pos", "line")).filter("pos IS NOT NULL")
    return rows.select(*key, (F.col("pos") + 1).alias("line_no"), "line")


def with_lines(files: DataFrame) -> DataFrame:
    """Add `lines`, the file's numbered lines as an array."""
    return files.withColumn("lines", tx.numbered(tx.line_array(F.col("text"))))


def line_windows(
    files: DataFrame, *, size: int = WINDOW_LINES, overlap: int = WINDOW_OVERLAP
) -> DataFrame:
    """Overlapping windows of `size` lines per file, the last one ending at the file's end.

    Window i starts at line i * (size - overlap) + 1, so starts need no running state. Windows
    with only blank lines are dropped.
    """
    step = size - overlap
    total = F.size("lines")
    count = F.when(total <= size, F.lit(1)).otherwise(
        F.ceil((total - size) / F.lit(step)).cast("int") + 1
    )
    starts = F.explode_outer(F.sequence(F.lit(0), count - 1))
    body = F.slice("lines", F.col("window") * step + 1, size)
    return (
        with_lines(files)
        .filter(total > 0)
        .withColumn("window", starts)
        .withColumn("body", body)
        .filter(tx.any_text(F.col("body")))
        .withColumn("start_line", F.element_at("body", 1)["n"])
        .withColumn("end_line", F.element_at("body", -1)["n"])
        .drop("lines", "window", "text")
    )


def collapse_blanks(bodies: DataFrame) -> DataFrame:
    """Bodies (numbered lines) without outer blank lines and with single inner ones."""
    return bodies.withColumn("body", tx.collapse(F.col("body")))


# ── Weighted windows ──────────────────────────────────────────────────────────


def fitting(weights: Column, size: int) -> Column:
    """How many leading items stay within `size` in total; never less than one."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(True).alias("on"))

    def take(acc: Column, weight: Column) -> Column:
        on = acc["on"] & ((acc["n"] == 0) | (acc["sum"] + weight <= size))
        return F.when(
            on,
            F.struct(
                (acc["n"] + 1).alias("n"),
                (acc["sum"] + weight).alias("sum"),
                F.lit(True).alias("on"),
            ),
        ).otherwise(
            F.struct(acc["n"].alias("n"), acc["sum"].alias("sum"), F.lit(False).alias("on"))
        )

    return F.aggregate(weights, state, take, lambda acc: acc["n"])


def trailing(weights: Column, least: int) -> Column:
    """How many trailing items it takes to weigh at least `least`; all of them if they do not."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"))

    def take(acc: Column, weight: Column) -> Column:
        return F.when(
            acc["sum"] < least,
            F.struct((acc["n"] + 1).alias("n"), (acc["sum"] + weight).alias("sum")),
        ).otherwise(acc)

    return F.aggregate(F.reverse(weights), state, take, lambda acc: acc["n"])


def greedy_windows(weights: Column, size: int, overlap: int) -> Column:
    """Windows [s, e) over integer weights >= 1: each as long as `size` allows (one item at
    least), the next starting as late as it can while sharing `overlap` weight with it.

    Each window looks at no more than `size` items, because every item weighs at least one; so
    the cost is linear in the items plus `size` per window.
    """
    return tx.let(weights, lambda w: _greedy_windows(w, size, overlap))


def _greedy_windows(weights: Column, size: int, overlap: int) -> Column:
    """`greedy_windows` over weights that are at hand."""
    total = F.size(weights)
    windows = "array<struct<s:int,e:int>>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(windows).alias("done"))

    def advance(acc: Column, start: Column, end: Column) -> Column:
        shared = trailing(F.slice(weights, start + 2, end - start - 1), overlap)
        following = F.when(end >= total, F.lit(-1)).otherwise(end - shared)
        window = F.struct(start.alias("s"), end.alias("e"))
        return F.struct(
            following.alias("at"), F.concat(acc["done"], F.array(window)).alias("done")
        )

    def step(acc: Column, _: Column) -> Column:
        start = acc["at"]
        return F.when(start < 0, acc).otherwise(
            tx.let(
                start + fitting(F.slice(weights, start + 1, size), size),
                lambda end: advance(acc, start, end),
            )
        )

    chained = F.aggregate(F.sequence(F.lit(1), total), state, step, lambda acc: acc["done"])
    return F.when(total > 0, chained).otherwise(F.array().cast(windows))


def weighted_windows(
    bodies: DataFrame, *, size: int = PART_TOKENS, overlap: int = PART_OVERLAP
) -> DataFrame:
    """Bodies over `size` tokens split into overlapping parts; the others stay whole, as part 0.

    Needs path, kind, name, qualname, lead and first_lead (arrays of lines), body, start_line,
    end_line. `lead` is repeated on every part, `first_lead` only comes with the first. Blank
    bodies are dropped. Adds part and parts; splits and lines stay within the row.
    """
    header = tx.chunk_header(
        F.col("path"), F.col("kind"), F.col("name"), F.col("qualname"), F.lit(0), F.lit(0)
    )
    whole = F.concat_ws(
        "\n", F.array(header), "lead", "first_lead", F.transform("body", lambda x: x["line"])
    )
    weights = F.transform("body", lambda x: tx.estimate_tokens(F.concat(x["line"], F.lit("\n"))))
    one_window = F.array(F.struct(F.lit(0).alias("s"), F.size("body").alias("e")))
    split = tx.estimate_tokens(whole) > size
    piece = F.slice("body", F.col("w.s") + 1, F.col("w.e") - F.col("w.s"))
    no_lines = F.array().cast("array<string>")
    return (
        bodies.filter(tx.any_text(F.col("body")))
        .withColumn("split", split)
        .withColumn("weights", F.when(F.col("split"), weights))
        .withColumn(
            "windows",
            F.when(F.col("split"), greedy_windows(F.col("weights"), size, overlap)).otherwise(
                one_window
            ),
        )
        .withColumn("parts", F.when(F.col("split"), F.size("windows")).otherwise(0))
        .drop("weights")
        .select("*", F.posexplode_outer("windows").alias("at", "w"))
        .withColumn("part", F.when(F.col("split"), F.col("at") + 1).otherwise(0))
        .withColumn("body", piece)
        .withColumn(
            "lead",
            F.concat("lead", F.when(F.col("at") == 0, F.col("first_lead")).otherwise(no_lines)),
        )
        .withColumn(
            "start_line",
            F.when(F.col("split"), F.element_at("body", 1)["n"]).otherwise(F.col("start_line")),
        )
        .withColumn(
            "end_line",
            F.when(F.col("split"), F.element_at("body", -1)["n"]).otherwise(F.col("end_line")),
        )
        .drop("split", "windows", "at", "w", "first_lead")
    )


# ── Markdown ──────────────────────────────────────────────────────────────────


def heading_title(line: Column) -> Column:
    """The title of an ATX heading line ('' when it has none); null when it is no heading."""
    rest = F.regexp_replace(line, r"\A {0,3}#{1,6}", "")
    is_heading = line.rlike(r"\A {0,3}#{1,6}(?!#)(?:[ \t]|\z)")
    title = tx.strip(F.regexp_replace(tx.strip(rest), r"#+\z", ""))
    return F.when(is_heading, title)


def section_starts(lines: Column) -> Column:
    """(n, title) of each heading outside code fences; a fence closes only on its own marker."""
    sparse = F.filter(
        F.transform(
            lines,
            lambda x: F.struct(
                x["n"].alias("n"),
                F.substring(F.regexp_replace(x["line"], rf"\A{tx.SPACE}+", ""), 1, 3).alias("mark"),
                heading_title(x["line"]).alias("title"),
            ),
        ),
        lambda x: x["mark"].isin(*FENCES) | x["title"].isNotNull(),
    )
    found = "array<struct<n:int,title:string>>"
    state = F.struct(F.lit("").alias("fence"), F.array().cast(found).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        is_mark = x["mark"].isin(*FENCES)
        fence = (
            F.when(is_mark & (acc["fence"] == ""), x["mark"])
            .when(is_mark & (acc["fence"] == x["mark"]), F.lit(""))
            .otherwise(acc["fence"])
        )
        opens = ~is_mark & (acc["fence"] == "")
        section = F.struct(x["n"].alias("n"), x["title"].alias("title"))
        return F.struct(
            fence.alias("fence"),
            F.when(opens, F.concat(acc["found"], F.array(section)))
            .otherwise(acc["found"])
            .alias("found"),
        )

    return F.aggregate(sparse, state, step, lambda acc: acc["found"])


def markdown_sections(files: DataFrame) -> DataFrame:
    """Markdown files split at headings: name (null before the first or without title), body,
    start_line, end_line; outer blank lines are dropped and empty sections with them."""
    preamble = F.array(F.struct(F.lit(1).alias("n"), F.lit("").alias("title")))
    bounds = F.concat(preamble, section_starts(F.col("lines")))
    total = F.size("lines")

    def section(start: Column, i: Column) -> Column:
        following = F.coalesce(F.get(F.col("bounds"), i + 1)["n"], total + 1)
        body = F.slice("lines", start["n"], F.greatest(following - start["n"], F.lit(0)))
        return F.struct(
            F.nullif(start["title"], F.lit("")).alias("name"), tx.collapse(body).alias("body")
        )

    return (
        with_lines(files)
        .filter(total > 0)
        .withColumn("bounds", bounds)
        .withColumn("section", F.explode_outer(F.transform("bounds", section)))
        .withColumn("name", F.col("section.name"))
        .withColumn("body", F.col("section.body"))
        .filter(F.size("body") > 0)
        .withColumn("start_line", F.element_at("body", 1)["n"])
        .withColumn("end_line", F.element_at("body", -1)["n"])
        .drop("lines", "bounds", "section", "text")
    )
