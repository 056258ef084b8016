"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a shuffled order and laid end to end, epoch after epoch; every `BLOCK` words are a block. Slots of the
mix are the points of the golden-ratio sequence: a slot goes to the source whose stretch of the cumulative weights
holds its point, and the k-th slot of a source takes the k-th block. A source that has too few points for its blocks, as small ones
may, gets the rest in slots after the schedule. Everything is built-in functions.

No window holds a source: documents are placed by sums over hash buckets and then within a bucket, slots are ranked by
counts over chunks of the schedule and then within a chunk.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.sources.tables import stored

BLOCK = 128  # words of a block
SHARE, CAP = 1.5, 2.0  # words of the mix over words there are; times a source may be used
WEIGHTS = (5, 2, 1)
_WORD = r"[^\x20\x09-\x0D]+"
_TURN = 1 << 31
_GOLDEN = 1327217885  # the golden ratio's fraction of a turn, odd, so that all points of a turn differ
_CELL = 1 << 19
_CHUNK = 1 << 16
_BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def repeating_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`source, weight, place` for a table with one row per source: weights repeat over sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    return sources.withColumn("place", place).withColumn("weight", choice)


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds `target` to `source_size, weight, place`: `share` of all words by weight, none above `cap` times its size.

    What a full source cannot take is shared again by weight among the others. In the order of size over weight the full sources come
    first, so one pass finds them. One row per source goes through each window.
    """
    full = F.col("source_size") * F.lit(float(cap))
    by = Window.orderBy(full / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sources.withColumns(
        {
            "_full": full,
            "_left": F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(full).over(by), F.lit(0.0)),
            "_open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by), F.lit(0.0)),
        }
    )
    out = out.withColumn("_is_full", F.col("_left") * F.col("weight") >= F.col("_full") * F.col("_open"))
    rate = F.min(F.when(~F.col("_is_full"), F.struct(F.col("_full") / F.col("weight"), "place", F.col("_left") / F.col("_open"))))
    out = out.withColumn("_rate", rate.over(every).getField("col3"))
    target = F.when(F.col("_is_full"), F.col("_full")).otherwise(F.col("_rate") * F.col("weight"))
    return out.withColumn("target", target).drop("_full", "_left", "_open", "_is_full", "_rate")


def _quota(cap: float) -> Column:
    """Words of a source that the mix takes."""
    return F.least(F.floor("target"), F.floor(F.col("source_size") * F.lit(float(cap))))


def _schedule(sources: DataFrame, block: int, cap: float) -> DataFrame:
    """`place, rank, slot`: the slots of the mix and which of its source's slots each is.

    Slots that a source's quota needs beyond those of the schedule come after it, source by source.
    """
    spark = sources.sparkSession
    total, count = sources.agg(F.sum("target"), F.count("*")).first()
    planned = int((total or 0) * 1.01 / block) + 8 * count + 1 if total else 0
    slots = spark.range(planned).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", F.col("slot") % _TURN * _GOLDEN % _TURN)
    order = Window.orderBy("place")
    ends = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    stretches = sources.withColumn("high", F.floor(ends / F.lit(total or 1.0) * _TURN))
    stretches = stretches.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0))).where("high > low")
    cells = F.sequence(F.floor(F.col("low") / _CELL), F.floor((F.col("high") - 1) / _CELL))
    cells = stretches.select("place", "low", "high", F.explode(cells).alias("cell"))  # 4,096 and one per source at most
    slots = slots.withColumn("cell", F.floor(F.col("point") / _CELL))
    placed = slots.join(cells, "cell").where("point >= low AND point < high")
    placed = placed.select("place", "slot", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    before = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(placed.groupBy("place", "chunk").agg(F.count("*").alias("n")), "slots")
    chunks = sums.select("place", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("passed"))
    within = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot"))
    ranked = placed.withColumn("nth", within).join(chunks, ["place", "chunk"])
    ranked = ranked.select("place", "slot", (F.col("passed") + F.col("nth") - 1).alias("rank"))
    has = sums.groupBy("place").agg(F.sum("n").alias("has"))
    needs = sources.select("place", F.ceil(_quota(cap) / block).alias("needs")).join(has, "place", "left")
    short = needs.withColumn("has", F.coalesce("has", F.lit(0))).where("needs > has")  # one row per source at most
    passed = F.coalesce(F.sum(F.col("needs") - F.col("has")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    short = short.withColumn("start", passed + F.lit(planned) - F.col("has"))
    more = short.select("place", "start", F.explode(F.sequence("has", F.col("needs") - 1)).alias("rank"))
    return ranked.unionByName(more.select("place", (F.col("start") + F.col("rank")).alias("slot"), "rank"))


def _laid_out(rows: DataFrame) -> DataFrame:
    """Adds `at`, the words of its source before each document in the shuffled order."""
    buckets = max(0, (max(1, rows.count()) // _BUCKET_ROWS).bit_length())
    bucket = F.shiftright(F.conv(F.substring("mixed", 1, 8), 16, 10).cast("long"), 32 - buckets)
    rows = rows.withColumn("bucket", bucket)
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("place", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("place", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("passed"))
    order = Window.partitionBy("place", "bucket").orderBy("mixed", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0)))
    return rows.join(sums, ["place", "bucket"]).withColumn("at", F.col("passed") + F.col("within"))


def _mixed() -> Column:
    """A digest of id and text."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), text))


def _sized(docs: DataFrame) -> DataFrame:
    """`doc_id, source, size, mixed`: the digest decides the shuffled order and depends on id and text alone."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    source = F.col("source").cast("string").alias("source")
    return docs.select(doc_id, source, word_count(F.col("text")).alias("size"), _mixed().alias("mixed"))


def mix(docs: DataFrame, *, weights=repeating_weights, share: float = SHARE, cap: float = CAP, block: int = BLOCK):
    """The mix of `docs(doc_id, text, source)`: its documents and its pieces.

    Documents: `row, doc_id, source, mixed, size, source_size, target` for every row. Pieces: `slot, row, epoch, n_words`, the words
    of a document (its next ones, from the first on in each epoch) that a slot takes. `weights` turns one row per source into rows with `weight`
    and `place`. A null source is a source; null and empty texts have no words and no pieces; repeated rows are
    documents of their own. Other columns are not read.
    """
    sized = stored(_sized(docs).withColumn("row", F.monotonically_increasing_id()), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(weights(sources), share, cap), "sources")
    named = sources.select(F.col("source").alias("_s"), "place", "source_size", "target")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = stored(_laid_out(rows).drop("bucket", "within", "passed"), "laid-out")

    epochs = F.sequence(F.lit(0), F.lit(max(0, -int(-cap // 1) - 1)))
    spans = rows.where("size > 0").select("place", "row", _quota(cap).alias("quota"), "at", "size", "source_size", F.explode(epochs).alias("epoch"))
    first = F.col("at") + F.col("epoch") * F.col("source_size")
    spans = spans.withColumn("first", first).withColumn("last", F.least(F.col("first") + F.col("size"), "quota")).where("last > first")
    ranks = F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block))
    spans = spans.select("place", "row", "epoch", "first", "last", F.explode(ranks).alias("rank"))
    joined = spans.join(_schedule(sources, block, cap), ["place", "rank"])
    n_words = F.least("last", (F.col("rank") + 1) * block) - F.greatest("first", F.col("rank") * block)
    return rows, joined.select("slot", "row", "epoch", n_words.alias("n_words"))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """`doc_id, size, source_size, target, taken` for every row: the words that the mix takes, repeats counted."""
    rows, pieces = mix(docs, **options)
    taken = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"))
    columns = ["doc_id", "size", "source_size", "target"]
    return rows.join(taken, "row", "left").select(*columns, F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns of `docs`: one row for each epoch of a document that the mix takes.

    Where a source's words run out inside a document, its text is cut after the last word taken, and `n_chars`, if there
    is such a column, counts what is left. Of rows alike in id and text it does not matter which is which.
    """
    rows, pieces = mix(docs, **options)
    takes = pieces.groupBy("row", "epoch").agg(F.sum("n_words").alias("n"))
    takes = takes.groupBy("row").agg(F.sort_array(F.collect_list("n")).alias("takes"))  # one entry per epoch
    twins = Window.partitionBy("id", "mixed").orderBy("id")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id")
    chosen = rows.join(takes, "row").select(key, "mixed", "size", "takes").withColumn("twin", F.row_number().over(twins))
    keyed = docs.select(key, _mixed().alias("mixed"), F.col("text").cast("string").alias("text"), F.struct("*").alias("doc"))
    keyed = keyed.withColumn("twin", F.row_number().over(twins))
    out = keyed.join(chosen, ["id", "mixed", "twin"]).withColumn("n", F.explode("takes"))
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    part = F.col("n") < F.col("size")
    cut = F.when(part, F.concat_ws("", F.slice(words, F.lit(1), F.col("n").cast("int")))).otherwise(F.col("text"))
    columns = []
    for field in docs.schema:
        column = F.col("doc").getField(field.name)
        if field.name == "text":
            column = F.when(part, F.col("cut")).otherwise(column)
        if field.name == "n_chars":
            column = F.when(part, F.char_length("cut").cast(field.dataType)).otherwise(column)
        columns.append(column.alias(field.name))
    return out.withColumn("cut", cut).select(*columns)
