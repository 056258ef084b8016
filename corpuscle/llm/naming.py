"""Exact duplicate documents by deterministic block naming.

A text without its white space is cut into blocks of fixed size. Distinct blocks are sorted and numbered; then adjacent names of a
document are paired, distinct pairs are sorted and numbered, and so on until each document has one name. Together
with its number of blocks that name is the same for two documents exactly when their texts are equal.

Contents travel once: the name of a block is looked up by a 128-bit key, which is checked to belong to one content only (and
drawn anew when it does not), so no two contents share a name. Copies meet in partial aggregates before each shuffle.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.sources.tables import stored

BLOCK = 4096  # bytes
WHITE = " \t\n\x0b\x0c\r"


def squeezed(text: Column) -> Column:
    """A text without white space; a null text is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for char in WHITE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def _key(block: Column, seed: int) -> Column:
    """128 bits of a block."""
    return F.struct(F.xxhash64(F.lit(seed), block).alias("x"), F.xxhash64(F.lit(~seed), block).alias("y"))


def _blocks(text: Column) -> Column:
    """The blocks of a text as bytes; an empty one has one empty block."""

    def cut(data: Column) -> Column:
        last = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / BLOCK)).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(data, k * BLOCK + 1, F.lit(BLOCK)))

    return F.element_at(F.transform(F.array(text.cast("binary")), cut), 1)  # bound once, not per block


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Distinct rows with a number, counted over sorted partitions; written once so that it never changes."""
    return stored(
        rows.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id()).drop("block"), "names"
    )


def _block_names(texts: DataFrame, key: Callable[[Column, int], Column]) -> tuple[DataFrame, int]:
    """`key, name` of every distinct block, and the seed whose keys tell all contents apart."""
    seed = 0
    while True:
        blocks = texts.select(F.explode(_blocks(F.col("squeezed"))).alias("block"))
        distinct = blocks.select(key(F.col("block"), seed).alias("key"), "block").distinct()
        names = _numbered(distinct, "block")
        keys = names.groupBy("key").count()
        if keys.where("count > 1").isEmpty():
            return names, seed
        seed += 1


def _paired(rows: DataFrame) -> DataFrame:
    """One round: `row, names` with half as many names; a last name without a partner is paired with -1."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")),
        lambda k: F.struct(
            F.get("names", 2 * k).alias("a"), F.coalesce(F.get("names", 2 * k + 1), F.lit(-1)).alias("b")
        ),
    )
    spots = rows.select("row", F.posexplode(pairs).alias("pos", "pair")).select("row", "pos", "pair.a", "pair.b")
    named = _numbered(spots.select("a", "b").distinct(), "a", "b")
    return _gathered(spots.join(named, ["a", "b"]))


def _gathered(spots: DataFrame) -> DataFrame:
    """Names of each document in order."""
    names = F.sort_array(F.collect_list(F.struct("pos", "name"))).getField("name")
    return spots.groupBy("row").agg(names.alias("names"))


def exact_duplicates(docs: DataFrame, *, key: Callable[[Column, int], Column] = _key) -> DataFrame:
    """`doc_id, keep_id, group_size, kept, text_sha256, n_chars` for every row of `docs(doc_id, text)`.

    Rows are equal when their texts without white space are. The one with the most code points stays, then the smallest
    doc_id; null ids come last, and of rows that agree in both, one. Null texts are empty and equal one another.
    Other columns are not read.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).alias("n_chars"),
        squeezed(F.col("text")).alias("squeezed"),
    )
    names, seed = _block_names(texts, key)
    rows = stored(
        texts.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "n_chars",
            F.sha2("squeezed", 256).alias("text_sha256"),
            F.transform(_blocks(F.col("squeezed")), lambda b: key(b, seed)).alias("keys"),
        ),
        "rows",
    )
    spots = rows.select("row", F.posexplode("keys").alias("pos", "key"))
    open_, done = stored(_gathered(spots.join(names, "key")), "round"), []
    while True:
        done.append(open_.where(F.size("names") == 1))
        left = open_.where(F.size("names") > 1)
        if left.isEmpty():
            break
        open_ = stored(_paired(left), "round")
    ended = done[0]
    for part in done[1:]:
        ended = ended.union(part)
    ended = ended.select("row", F.col("names")[0].alias("name"))
    ended = rows.withColumn("blocks", F.size("keys")).drop("keys").join(ended, "row")
    ended = stored(ended, "identities")
    known = F.col("doc_id").isNotNull().alias("known")
    rank = F.struct("n_chars", known, (-F.col("doc_id")).alias("low"), (-F.col("row")).alias("at"))
    groups = ended.groupBy("blocks", "name").agg(F.max(rank).alias("best"), F.count("*").alias("group_size"))
    return ended.join(groups, ["blocks", "name"]).select(
        "doc_id",
        (-F.col("best.low")).alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.at")).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    keys = ["id", "none", "sha", "chars"]
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    sha, chars = F.sha2(squeezed(text), 256), F.coalesce(F.char_length(text), F.lit(0))
    identity = [F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none")]
    kept = exact_duplicates(docs).where("kept")
    kept = kept.select(*identity, F.col("text_sha256").alias("sha"), F.col("n_chars").alias("chars"))
    keyed = docs.select(*identity, sha.alias("sha"), chars.alias("chars"), F.struct("*").alias("doc"))
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select("doc.*")
