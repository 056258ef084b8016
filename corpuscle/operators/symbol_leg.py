"""Symbol search: identifiers against names, exact rungs first, then names that contain one.

Matching on a dotted suffix becomes an equi join by listing every suffix of a qualified name as an
alias; matching a substring becomes one by listing the short character runs of every name.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as tx

SYMBOL_LIMIT = 50  # fixed value: symbol hits per query
CONTAINS_LIMIT = 20  # fixed value: of which by containment, at most
GRAM = 3  # longest character run in the containment index

# Rungs of the ladder, best first.
QUALNAME, NAME, SUFFIX, CONTAINS = 1, 2, 3, 4
RUNGS = 8  # more than any rung
LONGEST = 1 << 32  # more than the length of any name


def candidate_identifiers(plans: DataFrame, *, cap: int = tx.MAX_CANDIDATES) -> DataFrame:
    """Identifier candidates of each plan in order: query_id, snapshot_id, ord from 1, identifier."""
    tokens = tx.candidate_tokens(F.col("query"), F.col("identifiers"), cap)
    rows = plans.select(
        "query_id", "snapshot_id", F.posexplode_outer(tokens).alias("ord", "identifier")
    )
    return rows.filter("ord IS NOT NULL").withColumn("ord", F.col("ord") + 1)


def symbol_aliases(chunks: DataFrame) -> DataFrame:
    """Every string a chunk answers to and its rung: qualname, name, dotted suffixes of qualname.

    Each alias of a chunk appears once, at its best rung.
    """
    segments = F.split("qualname", r"\.")
    suffixes = F.when(
        F.size(segments) > 1,
        F.transform(
            F.sequence(F.lit(2), F.size(segments)),
            lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "."),
        ),
    )
    missing = F.array().cast("array<string>")
    given = F.array_compact(F.array(F.col("name")))
    others = F.array_except(F.coalesce(suffixes, missing), F.array("name", "qualname"))

    def at(aliases: Column, rung: int) -> Column:
        return F.transform(
            aliases, lambda a: F.struct(a.alias("alias"), F.lit(rung).alias("rung"))
        )

    rungs = F.concat(
        at(F.array_compact(F.array("qualname")), QUALNAME),
        at(F.array_except(given, F.array("qualname")), NAME),
        at(others, SUFFIX),
    )
    return chunks.select(
        "snapshot_id", "chunk_id", "path", "start_line", "part", F.inline_outer(rungs)
    ).filter("alias <> ''")


def resolve_identifiers(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """The candidates that are an alias of some chunk of their snapshot; case-sensitive."""
    known = aliases.select("snapshot_id", F.col("alias").alias("identifier"))
    return candidates.join(known, ["snapshot_id", "identifier"], "left_semi")


def ladder_exact(identifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Chunks each query's identifiers match, each identifier at its best rung only; a chunk
    matched by several keeps the first: query_id, snapshot_id, chunk_id, ord, rung."""
    key = ["snapshot_id", "alias", "rung"]
    best = aliases.groupBy("snapshot_id", "alias").agg(F.min("rung").alias("rung"))
    matches = aliases.join(best, key, "left_semi").withColumnRenamed("alias", "identifier")
    return first_match(identifiers, matches)


def first_match(identifiers: DataFrame, matches: DataFrame) -> DataFrame:
    """Identifiers joined to their matches, one row per query and chunk at the lowest ord.

    Ord and rung are packed into one number, which a hash aggregate can take the least of.
    """
    packed = F.min(F.col("ord") * RUNGS + F.col("rung"))
    return (
        identifiers.join(matches, ["snapshot_id", "identifier"])
        .groupBy("query_id", "snapshot_id", "chunk_id")
        .agg(packed.alias("m"))
        .select(
            "query_id",
            "snapshot_id",
            "chunk_id",
            F.floor(F.col("m") / RUNGS).cast("int").alias("ord"),
            (F.col("m") % RUNGS).alias("rung"),
        )
    )


def top_aliases(aliases: DataFrame, *, k: int = SYMBOL_LIMIT) -> DataFrame:
    """The alias rows a search can use: per alias its best rung, its first `k` chunks in hit order.

    Exact for a search of `k` hits: an alias with more chunks than that fills the search alone
    from any position it is reached at. The limit applies before the shuffle, so an alias that
    a third of all chunks share costs `k` rows per task.
    """
    by_alias = Window.partitionBy("snapshot_id", "alias")
    order = by_alias.orderBy("rung", "path", "start_line", "part", "chunk_id")
    return (
        aliases.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= k)
        .withColumn("best", F.min("rung").over(by_alias))
        .filter("rung = best")
        .drop("n", "best")
    )


def asked_aliases(aliases: DataFrame, candidates: DataFrame) -> DataFrame:
    """The aliases that some candidate names; all that a search has to rank."""
    wanted = candidates.select("snapshot_id", F.col("identifier").alias("alias"))
    return aliases.join(wanted, ["snapshot_id", "alias"], "left_semi")


# ── Containment ───────────────────────────────────────────────────────────────


def grams(text: Column, least: int = 1, most: int = GRAM) -> Column:
    """The distinct character runs of a string, `least` to `most` characters long."""
    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.when(
            F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(least, most + 1)]))


def name_grams(chunks: DataFrame) -> DataFrame:
    """`snapshot_id, gram, name`: the character runs of every distinct name."""
    names = chunks.filter("name <> ''").select("snapshot_id", "name").distinct()
    return names.select("snapshot_id", F.explode_outer(grams(F.col("name"))).alias("gram"), "name")


def name_chunks(chunks: DataFrame, *, k: int) -> DataFrame:
    """`snapshot_id, name, chunk_id`: the first `k` chunks of each name."""
    by_name = Window.partitionBy("snapshot_id", "name").orderBy("chunk_id")
    numbered = chunks.select("snapshot_id", "name", "chunk_id").withColumn("n", F.row_number().over(by_name))
    return numbered.filter(F.col("n") <= k).drop("n")


def containing_names(identifiers: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (snapshot_id, identifier, name) where name contains identifier and differs; `index` is `name_grams`.

    Each identifier meets only the names that share its rarest character run, so neither side is
    crossed with the other; names are made distinct before their runs are listed.
    """
    wanted = identifiers.select("snapshot_id", "identifier").distinct()
    short = F.least(F.length("identifier"), F.lit(GRAM))
    own = F.filter(grams(F.col("identifier")), lambda g: F.length(g) == short)
    probes = wanted.withColumn("gram", F.explode(own))
    probed = index.join(
        probes.select("snapshot_id", "gram").distinct(), ["snapshot_id", "gram"], "left_semi"
    )
    frequency = probed.groupBy("snapshot_id", "gram").agg(F.count("*").alias("n"))
    rarest = (
        probes.join(frequency, ["snapshot_id", "gram"], "left")
        .groupBy("snapshot_id", "identifier")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
        .filter("m.n > 0")
        .select("snapshot_id", "identifier", "m.gram")
    )
    return (
        rarest.join(index, ["snapshot_id", "gram"])
        .filter(F.contains("name", F.col("identifier")) & (F.col("name") != F.col("identifier")))
        .select("snapshot_id", "identifier", "name")
    )


def containing_chunks(names: DataFrame, first: DataFrame, *, k: int) -> DataFrame:
    """Per identifier the first `k` chunks, shorter names first, whose name contains it: `names` is `containing_names`,
    `first` has `k` chunks of each name at least (`name_chunks`)."""
    by_identifier = Window.partitionBy("snapshot_id", "identifier")
    return (
        names.join(first, ["snapshot_id", "name"])
        .withColumn("length", F.length("name"))
        .withColumn("n", F.row_number().over(by_identifier.orderBy("length", "chunk_id")))
        .filter(F.col("n") <= k)
        .select("snapshot_id", "identifier", "chunk_id", "length")
    )


def ladder_contains(
    identifiers: DataFrame, chunks: DataFrame, exact: DataFrame, *, k: int = CONTAINS_LIMIT
) -> DataFrame:
    """Rung 4: chunks whose name contains an identifier, that no exact rung found; the first `k`
    per query by identifier order, name length and id, however many exact hits it has.

    Exact hits can push out at most as many chunks as there are of them, so each identifier is cut at `k` and the largest number of
    exact hits of a query before the join.
    """
    most = exact.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    names = containing_names(identifiers, name_grams(chunks))
    found = containing_chunks(names, name_chunks(chunks, k=k + most), k=k + most)
    return first_containing(identifiers, found, exact, k=k)


def first_containing(identifiers: DataFrame, found: DataFrame, exact: DataFrame, *, k: int = CONTAINS_LIMIT) -> DataFrame:
    """The first `k` chunks per query of `containing_chunks` that are not exact hits."""
    order = Window.partitionBy("query_id").orderBy("ord", "length", "chunk_id")
    return (
        identifiers.join(found, ["snapshot_id", "identifier"])
        .groupBy("query_id", "snapshot_id", "chunk_id")
        .agg(F.min(F.col("ord").cast("bigint") * LONGEST + F.col("length")).alias("m"))
        .select(
            "query_id",
            "snapshot_id",
            "chunk_id",
            F.floor(F.col("m") / LONGEST).cast("int").alias("ord"),
            (F.col("m") % LONGEST).alias("length"),
        )
        .join(exact.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= k)
        .withColumn("rung", F.lit(CONTAINS))
        .select("query_id", "snapshot_id", "chunk_id", "ord", "rung")
    )


def symbol_search(
    exact: DataFrame, contains: DataFrame, chunks: DataFrame, *, k: int = SYMBOL_LIMIT
) -> DataFrame:
    """Symbol hits per query: exact rungs by identifier and rung, then containment; `k` in all."""
    order = Window.partitionBy("query_id").orderBy(
        F.col("rung") == CONTAINS, "ord", "rung", "path", "start_line", "part", "chunk_id"
    )
    place = chunks.select("chunk_id", "path", "start_line", "part")
    return (
        exact.unionByName(contains)
        .join(place, "chunk_id")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(
            "query_id",
            F.lit("symbol").alias("leg"),
            "rank",
            "chunk_id",
            (F.lit(1.0) / F.col("rung")).alias("score"),
        )
    )
