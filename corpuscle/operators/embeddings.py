"""Incremental embedding: which hashes need a vector, request batches, budget, and the vectors."""

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.sources.tables import stored

# Provider request limits, the per-snapshot budget and the price per million tokens.
BATCH_TOKENS = 100_000
BATCH_ITEMS = 1_000
SNAPSHOT_TOKENS = 5_000_000
RANGE_ROWS = 65_536  # hashes of a range that one task gives batches, about
EMBED_USD_PER_MTOK = 0.12

Embedder = Callable[[DataFrame], DataFrame]  # (content_hash, text) to (content_hash, embedding)


def pending_embeddings(
    chunks: DataFrame, embeddings: DataFrame, model: str
) -> tuple[DataFrame, DataFrame]:
    """(pending, reused): the hashes per snapshot without a `model` vector, with their tokens;
    and per snapshot how many distinct hashes are pending and how many already have one.

    Copies of one text combine before the shuffle; the vectors themselves are never read.
    """
    known = embeddings.filter(F.col("model") == model).select("content_hash").distinct()
    hashes = chunks.groupBy("snapshot_id", "content_hash").agg(F.min("tokens").alias("tokens"))
    pending = hashes.join(known, "content_hash", "left_anti").select(
        "snapshot_id", "content_hash", "tokens"
    )
    flagged = hashes.join(known.withColumn("known", F.lit(1)), "content_hash", "left")
    reused = flagged.groupBy("snapshot_id").agg(
        F.count_if(F.col("known").isNull()).alias("pending"),
        F.count_if(F.col("known").isNotNull()).alias("reused"),
    )
    return pending, reused


def hash_texts(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    """One text per wanted hash: the lowest chunk's.

    The first aggregation moves ids only; texts move once, for the chosen chunks.
    """
    chosen = (
        chunks.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")
        .groupBy("content_hash")
        .agg(F.min("chunk_id").alias("chunk_id"))
    )
    return chunks.join(chosen, ["content_hash", "chunk_id"], "left_semi").select(
        "content_hash", "text"
    )


def token_batches(
    pending: DataFrame,
    *,
    max_tokens: int = BATCH_TOKENS,
    max_items: int = BATCH_ITEMS,
    range_tokens: int | None = None,
) -> DataFrame:
    """Pending hashes with the request batch (from 0, in hash order per snapshot) each goes in.

    A batch closes when the next hash would exceed either limit; an oversize hash goes alone. Whatever a snapshot holds gets
    batches. The rule depends on everything before, so a snapshot is cut into ranges of its hashes' first digits, which different
    tasks read. A range first says, for each of its rows that a batch may start with, how many batches follow and what the last of
    them holds; with that the ranges of a snapshot are put one after another, and batches run on over their borders.

    With `range_tokens` batches start anew with each range instead, and ranges are of that many tokens on average.
    """
    rows = F.lit(0.0) if range_tokens else F.col("n") / RANGE_ROWS
    sizes = pending.groupBy("snapshot_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    parts = F.greatest(F.lit(1.0), rows, F.col("tokens") / (range_tokens or SNAPSHOT_TOKENS))
    sizes = sizes.select("snapshot_id", F.ceil(F.log(16.0, parts)).cast("int").alias("digits"))
    keyed = pending.join(F.broadcast(sizes), "snapshot_id").select(  # moved by snapshot, its ranges would stay in one task
        "snapshot_id", F.expr("substring(content_hash, 1, digits)").alias("range"), "content_hash", F.col("tokens").cast("int").alias("tokens")
    )
    if range_tokens:
        return _batches_of_ranges(keyed, max_tokens, max_items)

    def limited(work) -> Callable[[pa.Table], pa.Table]:
        """`work` with the limits, as a function of one table."""

        def run(rows: pa.Table) -> pa.Table:
            return work(max_tokens, max_items, rows)

        return run

    ranges = keyed.groupBy("snapshot_id", "range").applyInArrow(limited(_entries), _ENTRIES)
    entered = ranges.groupBy("snapshot_id").applyInArrow(limited(_entered), _ENTERED)
    return (
        keyed.join(entered, ["snapshot_id", "range"])
        .groupBy("snapshot_id", "range")
        .applyInArrow(limited(_numbered), _BATCHES)
    )


_ENTRIES = "snapshot_id bigint, range string, rows bigint, entry bigint, upto bigint, batches bigint, total bigint, items bigint"
_ENTERED = "snapshot_id bigint, range string, entry bigint, first bigint"
_BATCHES = "snapshot_id bigint, content_hash string, tokens int, batch_id int"


def _next_batch(tokens: np.ndarray, max_tokens: int, max_items: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the tokens before each row and at the end; and the row after the batch that starts with each row."""
    upto = np.concatenate([[0], np.cumsum(tokens)])
    rows = np.arange(len(tokens))
    fits = np.searchsorted(upto, upto[:-1] + max_tokens, side="right") - 1
    return upto, np.maximum(rows + 1, np.minimum(fits, rows + max_items))


def _tokens(rows: pa.Table) -> np.ndarray:
    return rows.column("tokens").fill_null(0).to_numpy().astype(np.int64)


def _entries(max_tokens: int, max_items: int, rows: pa.Table) -> pa.Table:
    """For each row of a range that its first new batch may start with: batches from there, and the last one's tokens and items.

    No batch from before holds more than `max_items` rows of the range, so later rows need no entry.
    """
    rows = rows.sort_by("content_hash")
    count = rows.num_rows
    upto, after = _next_batch(_tokens(rows), max_tokens, max_items)
    batches, last = [0] * (count + 1), [count] * (count + 1)
    for row, stop in zip(range(count - 1, -1, -1), after[::-1].tolist(), strict=True):
        batches[row] = batches[stop] + 1
        last[row] = row if stop == count else last[stop]
    entry = np.arange(min(count, max_items) + 1)
    start = np.array(last)[entry]
    columns = {
        "snapshot_id": pa.array([rows.column("snapshot_id")[0].as_py()] * len(entry), pa.int64()),
        "range": pa.array([rows.column("range")[0].as_py()] * len(entry), pa.string()),
        "rows": pa.array(np.full(len(entry), count)),
        "entry": pa.array(entry),
        "upto": pa.array(upto[entry]),
        "batches": pa.array(np.array(batches)[entry]),
        "total": pa.array(upto[-1] - upto[start]),
        "items": pa.array(count - start),
    }
    return pa.table(columns)


def _entered(max_tokens: int, max_items: int, ranges: pa.Table) -> pa.Table:
    """The row that the first new batch of each range of a snapshot starts with, and its number."""
    ranges = ranges.sort_by([("range", "ascending"), ("entry", "ascending")])
    columns = (ranges.column(c).to_numpy() for c in ("rows", "entry", "upto", "batches", "total", "items"))
    count, entry, upto, batches, ends, held = columns
    found, number, total, items = [], 0, 0, 0
    for at in np.flatnonzero(entry == 0).tolist():
        here = upto[at : at + min(int(count[at]), max_items) + 1]
        fits = int(np.searchsorted(here, max_tokens - total, side="right")) - 1
        place = max(0, min(fits, max_items - items)) if items else 0
        found.append((place, number))
        if place == count[at]:  # the batch from before holds the whole range
            total, items = total + int(here[place]), items + place
        else:
            number += int(batches[at + place])
            total, items = int(ends[at + place]), int(held[at + place])
    first = ranges.filter(pa.array(entry == 0))
    places, numbers = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
    return pa.table([first.column("snapshot_id"), first.column("range"), places, numbers], ["snapshot_id", "range", "entry", "first"])


def _numbered(max_tokens: int, max_items: int, rows: pa.Table) -> pa.Table:
    """The batches of a range, given the row that the first new one starts with."""
    rows = rows.sort_by("content_hash")
    _, after = _next_batch(_tokens(rows), max_tokens, max_items)
    stops, row = after.tolist(), rows.column("entry")[0].as_py()
    starts = np.zeros(rows.num_rows, np.int64)
    while row < len(starts):
        starts[row] = 1
        row = stops[row]
    batch_id = np.cumsum(starts) + rows.column("first")[0].as_py() - 1
    return rows.select(["snapshot_id", "content_hash", "tokens"]).append_column("batch_id", pa.array(batch_id, pa.int32()))


def _batches_of_ranges(keyed: DataFrame, max_tokens: int, max_items: int) -> DataFrame:
    """Batches that start anew with each range of hashes, numbered over the snapshot."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, total, items = None, 0, 0, 0
        for rows in batches:
            if not rows.num_rows:
                continue
            keys = list(zip(rows.column("snapshot_id").to_pylist(), rows.column("range").to_pylist(), strict=True))
            tokens = rows.column("tokens").to_numpy().astype(np.int64)
            ids = np.zeros(len(tokens), np.int32)
            first = 0
            while first < len(tokens):
                last = bisect.bisect_right(keys, keys[first], first)  # rows are sorted by key
                if keys[first] != held:
                    held, at, total, items = keys[first], 0, 0, 0
                upto = np.cumsum(tokens[first:last])
                spot = 0
                while spot < len(upto):
                    before = int(upto[spot - 1]) if spot else 0
                    fits = int(np.searchsorted(upto, before + max_tokens - total, side="right"))
                    stop = min(fits, spot + max_items - items, len(upto))
                    if stop <= spot and items:
                        at, total, items = at + 1, 0, 0
                        continue
                    stop = max(stop, spot + 1)
                    ids[first + spot : first + stop] = at
                    total, items = total + int(upto[stop - 1]) - before, items + stop - spot
                    spot = stop
                first = last
            yield pa.record_batch([*rows.columns, pa.array(ids)], [*rows.schema.names, "at"])

    schema = "snapshot_id bigint, range string, content_hash string, tokens int, at int"
    order = ["snapshot_id", "range", "content_hash"]
    assigned = keyed.repartition("snapshot_id", "range").sortWithinPartitions(*order).mapInArrow(assign, schema)
    assigned = stored(assigned, "batches")
    earlier = Window.partitionBy("snapshot_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = assigned.groupBy("snapshot_id", "range").agg((F.max("at") + 1).alias("n"))
    firsts = counts.select("snapshot_id", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    batch_id = (F.col("first") + F.col("at")).cast("int").alias("batch_id")
    return assigned.join(firsts, ["snapshot_id", "range"]).select("snapshot_id", "content_hash", "tokens", batch_id)


def embed_budget(pending: DataFrame, *, cap: int | None = SNAPSHOT_TOKENS) -> DataFrame:
    """Per snapshot: its pending tokens and whether they are over the budget, if there is one (then none is sent)."""
    return (
        pending.groupBy("snapshot_id")
        .agg(F.sum("tokens").cast("long").alias("tokens"))
        .withColumn("refused", F.lit(False) if cap is None else F.col("tokens") > cap)
    )


def stored_batches(usage: DataFrame, *, cap: int = SNAPSHOT_TOKENS) -> DataFrame:
    """Batches (snapshot_id, batch_id, tokens used) that are sent before the budget stops the run:
    the one whose running usage first goes over is still stored. Adds used and over."""
    earlier = Window.partitionBy("snapshot_id").orderBy("batch_id")
    return (
        usage.withColumn("used", F.sum("tokens").over(earlier))
        .filter(F.col("used") - F.col("tokens") <= cap)
        .withColumn("over", F.col("used") > cap)
    )


def hashed_token_vectors(dims: int = 64, *, unit: bool = True) -> Embedder:
    """The built-in embedder: each word adds +-1 to a hashed dimension; unit norm.

    Equal texts have equal vectors and texts that share words are close; no model, no network, and no Python: words are
    counted per text and dimension before they move. A text whose words cancel out, or without any, is the first unit vector, or zero
    when not all vectors have to be of unit length.
    """

    def embed(texts: DataFrame) -> DataFrame:
        words = texts.select("content_hash", F.explode_outer(tx.index_terms(F.col("text"))).alias("word"))
        digest = F.md5(F.coalesce("word", F.lit("")))
        at = F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % dims
        sign = F.when(F.substring(digest, 8, 1) < "8", 1).otherwise(-1)
        counted = words.groupBy("content_hash", at.alias("at")).agg(
            F.sum(F.when(F.col("word").isNotNull(), sign).otherwise(0)).alias("n")
        )
        norm = F.sqrt(F.sum(F.col("n") * F.col("n")))
        entries = F.map_from_entries(F.collect_list(F.struct("at", "n")))  # at most one per dimension
        vectors = counted.groupBy("content_hash").agg(entries.alias("entries"), norm.alias("norm"))
        values = F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda d: F.when(F.col("norm") == 0, ((d == 0) & F.lit(unit)).cast("float")).otherwise(
                (F.coalesce(F.element_at("entries", d.cast("bigint")), F.lit(0)) / F.col("norm")).cast("float")
            ),
        )
        return vectors.select("content_hash", values.alias("embedding"))

    return embed


def embed_documents(texts: DataFrame, embedder: Embedder, model: str) -> DataFrame:
    """Vectors (content_hash, model, embedding) for (content_hash, text) rows; `embedder` turns one table into the
    other and may as well call a client on Arrow batches."""
    vectors = embedder(texts.select("content_hash", "text"))
    return vectors.select("content_hash", F.lit(model).alias("model"), F.col("embedding").cast("array<float>"))


def insert_missing(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """The vectors plus the new ones whose (hash, model) is not there yet, which are kept as is."""
    key = ["content_hash", "model"]
    fresh = new.join(embeddings.select(*key), key, "left_anti")
    once = fresh.groupBy(*key).agg(F.min("embedding").alias("embedding"))
    return embeddings.select(*key, "embedding").unionByName(once)


def embed_cost(
    batches: DataFrame, reused: DataFrame, *, usd_per_mtok: float = EMBED_USD_PER_MTOK
) -> DataFrame:
    """Per snapshot: hashes embedded and reused, tokens used, and their price in dollars."""
    used = batches.groupBy("snapshot_id").agg(
        F.count("*").alias("embedded"), F.sum("tokens").cast("long").alias("tokens")
    )
    zero = F.lit(0).cast("long")
    return (
        reused.select("snapshot_id", "reused")
        .join(used, "snapshot_id", "left")
        .withColumn("embedded", F.coalesce("embedded", zero))
        .withColumn("tokens", F.coalesce("tokens", zero))
        .withColumn("cost_usd", F.round(F.col("tokens") * usd_per_mtok / 1_000_000, 6))
    )
