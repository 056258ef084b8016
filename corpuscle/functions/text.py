"""Column expressions over text: lines, identifiers, headers, token estimates. All run in the JVM."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide chunk boundaries, hashes and rankings, so they must not drift.
BYTES_PER_TOKEN = 3
MAX_CANDIDATES = 32
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".ts": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
}
MODULE_SUFFIXES = ("__init__", "index")

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"  # what Unicode calls white space, plus the C0 separators
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ALNUM = r"[\p{L}\p{N}]"
NOT_ALNUM = r"[^\p{L}\p{N}]"
NOT_IDENTIFIER = r"[^\p{L}\p{N}_]"
# Between two alphanumerics: letter/digit changes, lower to upper, and before the last capital of
# an acronym that runs into a lower-case word.
IDENTIFIER_BOUNDARY = (
    r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})"
)

# The same, and alphanumerics with something else between them, as a plain search.
SEVERAL_PARTS = (
    r"\p{Ll}\p{Lu}|\p{Lu}\p{Lu}\p{Ll}|\p{L}\p{N}|\p{N}\p{L}|"
    r"[\p{L}\p{N}][^\p{L}\p{N}]+[\p{L}\p{N}]"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_blank(text: Column) -> Column:
    """True when a string has nothing but white space."""
    return ~text.rlike(NOT_SPACE)


def strip(text: Column) -> Column:
    """The string without leading and trailing white space (any Unicode space)."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    """The white-space separated tokens of a string."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


# ── Lines ─────────────────────────────────────────────────────────────────────


def line_array(text: Column) -> Column:
    """Lines of a file: CRLF read as LF, one trailing newline opens no line, '' has none."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(unix, r"\n\z", ""), "\n", -1)
    )


def numbered(lines: Column) -> Column:
    """Lines as (n, line) structs, n counted from 1."""
    return F.transform(
        lines, lambda line, i: F.struct((i + 1).cast("int").alias("n"), line.alias("line"))
    )


def split_lines(text: Column) -> Column:
    """Lines of a text at any Unicode line break; a final break opens no line, '' has none."""
    closed = F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(closed, LINE_BREAK, -1)
    )


def join_lines(body: Column) -> Column:
    """The text of numbered lines, joined by newlines."""
    return F.array_join(F.transform(body, lambda x: x["line"]), "\n")


def any_text(body: Column) -> Column:
    """True when some numbered line is not blank."""
    return F.exists(body, lambda x: ~is_blank(x["line"]))


def collapse(body: Column) -> Column:
    """Numbered lines without outer blank lines, each inner run of blanks cut to its first.

    A blank line stays when the line above it has text and some line below has text too, so the
    rule looks at neighbours only and needs no running state.
    """
    def keep(body: Column, end: Column) -> Column:
        return F.filter(
            body,
            lambda x, i: ~is_blank(x["line"])
            | ((i > 0) & (x["n"] < end) & ~is_blank(F.get(body, i - 1)["line"])),
        )

    def outer(body: Column) -> Column:
        texts = F.filter(body, lambda x: ~is_blank(x["line"]))
        return let(
            F.when(F.size(texts) > 0, F.element_at(texts, -1)["n"]).otherwise(-1),
            lambda end: keep(body, end),
        )

    return let(body, outer)


# ── Paths ─────────────────────────────────────────────────────────────────────


def basename(path: Column) -> Column:
    """The last component of a path."""
    return F.substring_index(path, "/", -1)


def language_of(path: Column) -> Column:
    """The parsed language of a path by its extension, in any case; null when none."""
    extension = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))
    pairs = [F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair]
    return F.element_at(F.create_map(*pairs), extension)


def stem(path: Column) -> Column:
    """The last component of a path without its extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+\z", "")


def module_qualname(path: Column) -> Column:
    """A path as a dotted module name; a trailing package marker is dropped."""
    dotted = F.translate(F.regexp_replace(path, r"(?<=[^/])\.[^./]+\z", ""), "/", ".")
    return F.regexp_replace(dotted, rf"\.({'|'.join(MODULE_SUFFIXES)})\z", "")


# ── Identifiers ───────────────────────────────────────────────────────────────


def identifier_parts(token: Column) -> Column:
    """The words inside one token: `getHTTPUrl2` has get, HTTP, Url, 2."""
    spaced = F.regexp_replace(token, IDENTIFIER_BOUNDARY, " ")
    return F.array_remove(F.split(spaced, f"{NOT_ALNUM}+"), "")


def split_identifiers(text: Column) -> Column:
    """The words of a text joined by spaces, each followed by its parts when it has several.

    Most words have one part, which one plain test shows; only the others are taken apart.
    """
    expanded = F.transform(
        words(text),
        lambda w: F.when(
            w.rlike(SEVERAL_PARTS), F.concat_ws(" ", w, identifier_parts(w))
        ).otherwise(w),
    )
    return F.array_join(expanded, " ")


def index_terms(text: Column) -> Column:
    """Lower-cased alphanumeric runs of a string, in order; no stop words are dropped."""
    return F.array_remove(F.split(F.lower(text), f"{NOT_ALNUM}+"), "")


def candidate_tokens(query: Column, identifiers: Column, cap: int = MAX_CANDIDATES) -> Column:
    """Identifier candidates of a plan: its identifiers, then the query's words, trimmed of
    punctuation, each followed by its punctuation-separated parts; distinct, the first `cap`."""
    given = F.coalesce(identifiers, F.array().cast("array<string>"))
    trimmed = F.transform(
        F.concat(given, words(query)),
        lambda t: F.regexp_replace(t, rf"\A{NOT_IDENTIFIER}+|{NOT_IDENTIFIER}+\z", ""),
    )
    expanded = F.transform(
        F.filter(trimmed, lambda t: t != ""),
        lambda t: let(
            F.split(t, f"{NOT_IDENTIFIER}+"),
            lambda parts: F.when(F.size(parts) > 1, F.concat(F.array(t), parts)).otherwise(
                F.array(t)
            ),
        ),
    )
    return F.slice(F.array_distinct(F.flatten(expanded)), 1, cap)


def or_terms(query: Column) -> Column:
    """Distinct lower-case terms of a query for an any-word search: whole words and their parts."""
    per_word = F.transform(
        words(query),
        lambda t: F.concat(
            F.when(t.rlike(rf"\A{ALNUM}+\z"), F.array(F.lower(t))).otherwise(
                F.array().cast("array<string>")
            ),
            F.transform(identifier_parts(t), F.lower),
        ),
    )
    return F.array_distinct(F.flatten(per_word))


# ── Chunk text ────────────────────────────────────────────────────────────────


def estimate_tokens(text: Column) -> Column:
    """Token estimate: UTF-8 bytes over three, rounded up."""
    return ((F.octet_length(text) + (BYTES_PER_TOKEN - 1)) / BYTES_PER_TOKEN).cast("int")


def content_hash(text: Column) -> Column:
    """SHA-256 of the text, in hex."""
    return F.sha2(text, 256)


def clean_block_comment(comment: Column) -> Column:
    """The prose of a `/** */` comment; null when it has none."""
    inner = F.regexp_replace(F.regexp_replace(comment, r"\A/\*\*", ""), r"\*/\z", "")
    lines = F.transform(
        split_lines(inner), lambda line: strip(F.regexp_replace(strip(line), r"\A\*", ""))
    )
    return F.nullif(strip(F.array_join(lines, "\n")), F.lit(""))


def label(name: Column, qualname: Column) -> Column:
    """What a chunk is called: its qualified name, else its name, else null."""
    return F.coalesce(F.nullif(qualname, F.lit("")), F.nullif(name, F.lit("")))


def chunk_header(
    path: Column, kind: Column, name: Column, qualname: Column, part: Column, parts: Column
) -> Column:
    """First line of a chunk: `path :: label (kind, part i/n)`, or `path (kind)` without a label."""
    tail = F.when(
        part > 0, F.format_string(" (%s, part %d/%d)", kind, part, parts)
    ).otherwise(F.format_string(" (%s)", kind))
    return F.concat(path, F.coalesce(F.concat(F.lit(" :: "), label(name, qualname)), F.lit("")), tail)


def search_text(*columns: Column) -> Column:
    """Columns joined by spaces, empty ones left out, with identifiers split for the word index."""
    return split_identifiers(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns]))


def has_dotted_suffix(qualname: Column, suffix: Column) -> Column:
    """True when `suffix` is a run of whole trailing segments of a dotted name (case-sensitive)."""
    return F.endswith(qualname, F.concat(F.lit("."), suffix))
