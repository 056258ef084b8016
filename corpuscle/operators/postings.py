"""Full-text search over stored postings.

The index job deals the chunks of a snapshot into ranges and writes, for each term and range, one row: the chunks that have the
term, the weight it has in each, its places, and the greatest of those weights. Rows lie in folders by a hash of the term. A search reads
the folders of the terms that are asked. It first reads terms, ranges and greatest weights alone, which say in what ranges a question
can have a hit at all and how good it can be; lists are read for those ranges only, the most promising one of each question
first, the others when they can still reach its k-th hit.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.operators.fts_leg import DIGITS, FTS_LIMIT, UNIT, WEIGHTS, and_terms, any_terms, cover_scores, ranked, search_vector
from corpuscle.operators.topk import BestRows
from corpuscle.sources.tables import stored, write_partitioned

RANGE = 4_096  # chunks of a range, about
BUCKETS = 64  # folders of terms
QUESTIONS = 2_000  # questions that meet a range in one task
SENT_TERMS = 500_000  # asked terms that are sent to the stored lists, so that others do not move
FIRST = 4  # ranges of a question that are read before the others are judged
PACK = 8  # a place is its position times this plus its weight


# ── The index ─────────────────────────────────────────────────────────────────

POSTINGS = (
    "snapshot_id bigint, range bigint, term string, top int, chunks array<bigint>, weights array<int>, places array<array<int>>"
)


def term_bucket(term: str = "term"):
    """The folder of a term."""
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def _post(rows: pa.Table) -> pa.Table:
    """The postings of one range, from its chunks' search vectors, in memory a few times the numbers of its words."""
    ids = rows.column("chunk_id").to_numpy()
    if (ids[1:] < ids[:-1]).any():
        rows = rows.sort_by("chunk_id")
        ids = rows.column("chunk_id").to_numpy()
    lists = rows.column("terms")
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    named = pc.list_flatten(lists).dictionary_encode().unify_dictionaries()
    words = named.chunk(0).dictionary.to_pylist() if named.num_chunks else []
    rank = np.empty(len(words), np.int32)
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    rank[order] = np.arange(len(words), dtype=np.int32)
    term = np.concatenate([np.zeros(0, np.int32), *(rank[c.indices.to_numpy()] for c in named.chunks)])
    del named
    order_of = np.argsort(term, kind="stable")  # a term's rows and positions are in order
    term = term[order_of]
    row = np.repeat(np.arange(len(length), dtype=np.int32), length)[order_of]
    pos = (np.arange(len(term), dtype=np.int32) - np.repeat((np.cumsum(length) - length).astype(np.int32), length))[order_of] + np.int32(1)
    weight = pc.list_flatten(rows.column("weights")).to_numpy().astype(np.int32)[order_of]
    del order_of
    starts = np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])]) if len(term) else np.zeros(0, bool)
    pair = np.flatnonzero(starts)
    sums = np.add.reduceat(weight, pair) if len(pair) else np.zeros(0, np.int32)
    own = term[pair]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(pair) else np.zeros(0, np.int64)
    tops = np.maximum.reduceat(sums, first) if len(first) else np.zeros(0, np.int32)
    cuts = pa.array(np.append(first, len(pair)), pa.int32())
    places = pa.ListArray.from_arrays(pa.array(np.append(pair, len(pos)), pa.int32()), pa.array(pos * np.int32(PACK) + weight, pa.int32()))
    columns = {
        "snapshot_id": pa.array([rows.column("snapshot_id")[0].as_py()] * len(first), pa.int64()),
        "range": pa.array([rows.column("range")[0].as_py()] * len(first), pa.int64()),
        "term": pa.array([words[k] for k in order], pa.string()),
        "top": pa.array(tops, pa.int32()),
        "chunks": pa.ListArray.from_arrays(cuts, pa.array(ids[row[pair]], pa.int64())),
        "weights": pa.ListArray.from_arrays(cuts, pa.array(sums, pa.int32())),
        "places": pa.ListArray.from_arrays(cuts, places),
    }
    return pa.table(columns)


def index_postings(search: DataFrame, *, size: int = RANGE) -> DataFrame:
    """Postings of chunks: snapshot_id, range, term, top, chunks, weights, places, bucket.

    Of chunks with search fields the fields move to their range and are split into words there, which is less to move; search vectors
    (`fts_leg.search_rows`) move as they are. A range holds about `size` chunks of its snapshot, however large that is; weights are in fifths, `top` is the greatest of them. The
    counts (a row per snapshot) go to the chunks: a join that moved the chunks by snapshot would leave each snapshot's ranges to one task.
    """
    counts = search.groupBy("snapshot_id").agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).alias("ranges"))
    dealt = search.join(F.broadcast(counts), "snapshot_id").withColumn("range", F.pmod(F.xxhash64("chunk_id"), F.col("ranges")))
    key = ["snapshot_id", "range", "chunk_id"]
    if "terms" in search.columns:
        rows = dealt.select(*key, "terms", "weights")
    else:
        words, weights = search_vector()
        fields = dealt.select(*key, *WEIGHTS).repartition("snapshot_id", "range").sortWithinPartitions(*key)  # and not the words
        rows = fields.select(*key, words.alias("terms"), weights.alias("weights"))
    return rows.groupBy("snapshot_id", "range").applyInArrow(_post, POSTINGS).withColumn("bucket", term_bucket())


# Postings on their way to their folders: those of one bucket in one value, differences and lengths in place of ids and offsets.
_PACKED = pa.schema(
    [
        (name, pa.list_(kind))
        for name, kind in (
            ("snapshot_id", pa.int64()), ("range", pa.int64()), ("term", pa.string()), ("top", pa.int32()), ("size", pa.int32()),
            ("step", pa.int64()), ("weight", pa.int32()), ("count", pa.int32()), ("place", pa.int32()),
        )
    ]
)
HELD = 16 << 20  # bytes of postings that are packed together


def _pack(rows: pa.Table) -> bytes:
    """Some postings as one value."""
    chunks, weights, places = (rows.column(c).combine_chunks() for c in ("chunks", "weights", "places"))
    nested = places.flatten()
    ids = chunks.flatten().to_numpy()
    columns = [
        *(rows.column(c).combine_chunks().cast(_PACKED.field(c).type.value_type) for c in ("snapshot_id", "range", "term", "top")),
        pa.array(chunks.value_lengths(), pa.int32()),
        pa.array(np.diff(ids, prepend=0), pa.int64()),
        weights.flatten(),
        pa.array(nested.value_lengths(), pa.int32()),
        nested.flatten(),
    ]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch(lists, schema=_PACKED))
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes, bucket: int) -> pa.RecordBatch:
    """The postings of a value."""
    batch = pa.ipc.open_stream(data).read_next_batch()
    part = {name: batch.column(name).flatten() for name in _PACKED.names}
    offsets = lambda lengths: pa.array(np.append(0, np.cumsum(part[lengths].to_numpy(), dtype=np.int64)), pa.int32())
    cuts = offsets("size")
    columns = {
        **{c: part[c] for c in ("snapshot_id", "range", "term", "top")},
        "chunks": pa.ListArray.from_arrays(cuts, pa.array(np.cumsum(part["step"].to_numpy()), pa.int64())),
        "weights": pa.ListArray.from_arrays(cuts, part["weight"]),
        "places": pa.ListArray.from_arrays(cuts, pa.ListArray.from_arrays(offsets("count"), part["place"])),
        "bucket": pa.array(np.full(len(part["term"]), bucket), pa.int32()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`bucket, data`: the postings of a task by bucket, a bounded number together."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        bucket = rows.column("bucket").to_numpy()
        for k in np.unique(bucket).tolist():
            data = _pack(rows.take(pa.array(np.flatnonzero(bucket == k))))
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["bucket", "data"])
        held.clear()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) > HELD:
            yield from flush()
    if held:
        yield from flush()
    pa.default_memory_pool().release_unused()  # the worker stays


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of packed values."""
    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
            yield _unpack(data.as_py(), bucket)
    pa.default_memory_pool().release_unused()


def write_postings(rows: DataFrame, path: str) -> None:
    """Write postings (`index_postings`) under `path`, in folders by bucket; they move there packed, which is a quarter of what rows take."""
    packed = rows.mapInArrow(_packed, "bucket int, data binary").hint("rebalance", F.col("bucket"))
    unpacked = packed.mapInArrow(_unpacked, f"{POSTINGS}, bucket int")
    write_partitioned(unpacked, path, "bucket", spread=False, compression="zstd")


def asked_postings(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings in the folders of some terms; the folders are named in the plan, so no other is listed or read."""
    return _in_folders(postings, terms.agg(F.collect_set(term_bucket())).first()[0])


def _in_folders(postings: DataFrame, buckets: list[int]) -> DataFrame:
    return postings.filter(F.col("bucket").isin(sorted(buckets)))


# ── Searches ──────────────────────────────────────────────────────────────────

_HITS = "query_id bigint, chunk_id bigint, score double"
_KEY = ["snapshot_id", "range", "block"]


class _Search:
    """Terms of questions (query_id, snapshot_id, term), stored, and the postings in the folders of these terms."""

    def __init__(self, terms: DataFrame, postings: DataFrame, name: str) -> None:
        self.terms = stored(terms.withColumn("bucket", term_bucket()), name)
        totals = F.count_distinct("query_id"), F.count("*"), F.collect_set("bucket")  # at most BUCKETS
        count, rows, buckets = self.terms.agg(*totals).first()
        self.blocks = max(1, -(-count // QUESTIONS))
        self.postings = _in_folders(postings, buckets)
        if rows <= SENT_TERMS:  # a folder has many terms; the lists of those that nobody asks stay where they are read
            key = ["bucket", "snapshot_id", "term"]
            self.postings = self.postings.join(F.broadcast(self.terms.select(*key).distinct()), key, "left_semi")

    def reach(self) -> DataFrame:
        """`query_id, snapshot_id, range, n, most`: how many terms of a question a range has, and the most a chunk of it can weigh.

        Only terms, ranges and greatest weights are read.
        """
        heads = self.postings.select("bucket", "snapshot_id", "term", "range", "top")
        met = self.terms.join(heads, ["bucket", "snapshot_id", "term"])
        return met.groupBy("query_id", "snapshot_id", "range").agg(F.count("*").alias("n"), F.sum("top").alias("most"))

    def meet(self, pairs: DataFrame, columns: list[str], work) -> DataFrame:
        """`work` on the postings of each range with the terms of the questions that `pairs` (query_id, snapshot_id, range) sends there.

        Postings that no question wants stay behind; the others and the questions meet by range, in blocks of bounded size.
        """
        block = F.pmod(F.xxhash64("query_id"), F.lit(self.blocks)).alias("block")
        listed = self.terms.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
        questions = pairs.join(listed, "query_id").select("*", block)
        wanted = pairs.join(self.terms.select("query_id", "term", "bucket"), "query_id")
        wanted = wanted.select("bucket", "snapshot_id", "range", "term", block).distinct()
        key = ["bucket", "snapshot_id", "range", "term"]
        lists = wanted.join(self.postings.select(*key, *columns), key).drop("bucket")
        lists = lists.toDF(*lists.columns)  # columns of its own, though both sides come from `pairs`
        return lists.groupBy(*_KEY).cogroup(questions.groupBy(*_KEY)).applyInArrow(work, _HITS)


class _Lists:
    """The postings of a range by term, chunks numbered within the range."""

    def __init__(self, rows: pa.Table) -> None:
        words = rows.column("term").to_pylist()
        self.place = {w: k for k, w in enumerate(words)}
        lists = rows.column("chunks").combine_chunks()
        self.first = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten().to_numpy()
        self.first -= self.first[0] if len(self.first) else 0
        self.chunk_ids, self.chunk = np.unique(flat, return_inverse=True)
        self.rows = rows

    def spots(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of some terms are, one after another, and which of the terms each entry belongs to."""
        spans = [(self.first[k], self.first[k + 1]) for k in (self.place[t] for t in terms if t in self.place)]
        spots = [np.arange(a, b) for a, b in spans]
        which = [np.full(b - a, k) for k, (a, b) in enumerate(spans)]
        none = np.zeros(0, np.int64)
        return (np.concatenate(spots), np.concatenate(which)) if spans else (none, none)


def _score_any(k: int, lists: pa.Table, questions: pa.Table) -> pa.Table:
    """The best chunks of each question by the weight of its terms in them; `floor` is what a hit must reach."""
    best = BestRows(k)
    if lists.num_rows and questions.num_rows:
        held = _Lists(lists)
        weights = lists.column("weights").combine_chunks().flatten().to_numpy()
        asked = (questions.column(c).to_pylist() for c in ("query_id", "terms", "floor"))
        for query_id, terms, floor in zip(*asked, strict=True):
            spots, _ = held.spots(terms)
            sums = np.bincount(held.chunk[spots], weights[spots], len(held.chunk_ids))
            sums[(sums == 0) | (sums < floor)] = -np.inf
            best.add_scores(np.array([query_id]), sums[None], held.chunk_ids, held.chunk_ids)
    return _hits(best)


def _score_all(k: int, lists: pa.Table, questions: pa.Table) -> pa.Table:
    """The best chunks of each question that hold all of its terms, by cover density."""
    best = BestRows(k)
    if lists.num_rows and questions.num_rows:
        held = _Lists(lists)
        nested = lists.column("places").combine_chunks().flatten()
        offsets = nested.offsets.to_numpy().astype(np.int64)
        packed = nested.values.to_numpy()
        for query_id, terms in zip(*(questions.column(c).to_pylist() for c in ("query_id", "terms")), strict=True):
            spots, which = held.spots(terms)
            has = np.bincount(held.chunk[spots], minlength=len(held.chunk_ids)) == len(terms)
            keep = has[held.chunk[spots]]
            spots, which = spots[keep], which[keep]
            if not len(spots):
                continue
            count = offsets[spots + 1] - offsets[spots]
            at = np.arange(int(count.sum())) + np.repeat(offsets[spots] - (np.cumsum(count) - count), count)
            found = np.flatnonzero(has)
            match = np.searchsorted(found, np.repeat(held.chunk[spots], count))
            pos, weight = packed[at] // PACK, packed[at] % PACK
            scores = cover_scores(match, pos, np.repeat(which, count), weight, len(terms), len(found))
            best.add_scores(np.array([query_id]), np.round(scores, DIGITS)[None], held.chunk_ids[found], held.chunk_ids[found])
    return _hits(best)


def _hits(best: BestRows) -> pa.Table:
    query_id, chunk_id, score, _ = best.best()
    columns = [pa.array(query_id, pa.int64()), pa.array(chunk_id, pa.int64()), pa.array(score, pa.float64())]
    return pa.table(columns, names=["query_id", "chunk_id", "score"])


def search_all(plans: DataFrame, postings: DataFrame, *, k: int = FTS_LIMIT) -> DataFrame:
    """Hits that hold every term of the query, by cover density, as `fts_leg.fts_and` gives them.

    A range is read for a question only when it has all of its terms.
    """
    search = _Search(and_terms(plans), postings, "and-terms")
    needs = search.terms.groupBy("query_id").agg(F.count("*").alias("needs"))
    pairs = search.reach().join(needs, "query_id").filter("n = needs").select("query_id", "snapshot_id", "range")
    return ranked(search.meet(stored(pairs, "ranges"), ["chunks", "places"], _with(k, _score_all)), k)


def search_any(plans: DataFrame, and_hits: DataFrame, postings: DataFrame, *, k: int = FTS_LIMIT) -> DataFrame:
    """For queries without an all-words hit: chunks with any term by the weight of its words, as `fts_leg.fts_or` gives them.

    The ranges that promise most are read first; their k-th hit is what another range must be able to reach to be read at all.
    """
    search = _Search(any_terms(plans.join(and_hits.select("query_id"), "query_id", "left_anti")), postings, "any-terms")
    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "range")
    reach = stored(search.reach().withColumn("place", F.row_number().over(order)), "reach")
    columns, work = ["chunks", "weights"], _with(k, _score_any)
    near = reach.filter(F.col("place") <= FIRST).select("query_id", "snapshot_id", "range", F.lit(0.0).alias("floor"))
    found = search.meet(near, columns, work)
    others = reach.filter(F.col("place") > FIRST)
    if not others.isEmpty():
        found = stored(found, "first-ranges")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"))
        kth = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") == k)
        kth = kth.select("query_id", F.col("score").alias("floor"))
        more = others.select("query_id", "snapshot_id", "range", "most").join(kth, "query_id", "left").fillna(0.0, ["floor"])
        found = found.unionByName(search.meet(more.filter("most >= floor").drop("most"), columns, work))
    return ranked(found.withColumn("score", F.round(F.col("score") * UNIT, DIGITS)), k)


def _with(k: int, work):
    """`work` with its limit, as a function of two tables."""

    def run(lists: pa.Table, questions: pa.Table) -> pa.Table:
        return work(k, lists, questions)

    return run

