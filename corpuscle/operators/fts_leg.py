"""Full-text search: weighted postings, all-words matching by cover density, any-word fallback."""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.operators.topk import TILE_CELLS, BestRows, question_blocks

QUESTIONS = 4_000  # questions that go to the tasks at a time
TILE_WORDS = 1 << 18  # words, about, of the chunks that are scored at a time
SPREAD = 1 << 20  # pairs of a word and a question that asks it that are added up at a time
FTS_LIMIT = 50  # fixed value: full-text hits per query
# Field weights A 1.0, B 0.4, C 0.2, counted in fifths so that sums are exact.
WEIGHTS = {"search_a": 5, "search_b": 2, "search_c": 1}
UNIT = 0.2
DIGITS = 9  # scores are compared after rounding, so the order of a sum never decides a rank


def search_vector() -> tuple[Column, Column]:
    """A chunk's words in order, from field to field, and the weight of each in fifths."""
    def terms(field: str) -> Column:
        return tx.index_terms(F.coalesce(F.col(field), F.lit("")))

    def weights_of(field: str) -> Column:
        return F.array_repeat(F.lit(WEIGHTS[field]), F.size(terms(field)))

    words = F.concat(*[terms(field) for field in WEIGHTS])
    weights = F.concat(*[weights_of(field) for field in WEIGHTS])
    return words, weights


def search_rows(chunks: DataFrame) -> DataFrame:
    """One row per chunk, its search vector: snapshot_id, chunk_id, terms and weights; stored ones are read as they are."""
    if "terms" in chunks.columns:
        return chunks.select("snapshot_id", "chunk_id", "terms", "weights")
    words, weights = search_vector()
    return chunks.select("snapshot_id", "chunk_id", words.alias("terms"), weights.alias("weights"))


def build_postings(chunks: DataFrame) -> DataFrame:
    """One row per word occurrence: snapshot_id, chunk_id, term, pos from 1, weight in fifths.

    Positions run on from field to field. A chunk's words come out of its own row: no shuffle.
    """
    pairs = F.arrays_zip(F.col("terms").alias("term"), F.col("weights").alias("weight"))
    rows = search_rows(chunks).select("snapshot_id", "chunk_id", F.posexplode_outer(pairs).alias("at", "p"))
    return rows.filter("at IS NOT NULL").select(
        "snapshot_id", "chunk_id", "p.term", (F.col("at") + 1).alias("pos"), "p.weight"
    )


def and_terms(plans: DataFrame) -> DataFrame:
    """Distinct terms a chunk must all hold: query_id, snapshot_id, term."""
    terms = F.array_distinct(tx.index_terms(tx.split_identifiers(F.col("query"))))
    rows = plans.select("query_id", "snapshot_id", F.explode_outer(terms).alias("term"))
    return rows.filter("term IS NOT NULL")


def any_terms(plans: DataFrame) -> DataFrame:
    """Distinct terms of the any-word fallback: query_id, snapshot_id, term."""
    terms = tx.or_terms(F.col("query"))
    rows = plans.select("query_id", "snapshot_id", F.explode_outer(terms).alias("term"))
    return rows.filter("term IS NOT NULL")


# ── Chunks against blocks of questions ────────────────────────────────────────


class _Terms:
    """The wanted terms of a block's questions in one snapshot."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        words = sorted({term for _, term in rows})
        place = {w: k for k, w in enumerate(words)}
        self.words = pa.array(words, pa.string())
        self.questions = np.array(sorted({q for q, _ in rows}), np.int64)
        spot = {q: k for k, q in enumerate(self.questions.tolist())}
        pairs = sorted({(place[t], spot[q]) for q, t in rows})
        self.of_term = np.array([q for _, q in pairs], np.int64)  # questions of each term, one after the other
        self.first = np.searchsorted([t for t, _ in pairs], np.arange(len(words) + 1))
        self.need = np.bincount(self.of_term, minlength=len(self.questions))
        self.by_question: dict[int, list[int]] = {}
        for term, question in pairs:
            self.by_question.setdefault(question, []).append(term)

    def sums(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """For each question and row, the sum of a value over the question's terms that the row has; a bounded number of pairs at a time."""
        out = np.zeros((len(self.questions), rows))
        count = self.first[term + 1] - self.first[term]
        ends = np.cumsum(count)
        at = 0
        while at < len(term):
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + SPREAD, side="right")))
            some = slice(at, stop)
            spread = np.arange(int(ends[stop - 1]) - done) + np.repeat(self.first[term[some]] - (ends[some] - count[some] - done), count[some])
            low = int(row[some].min())
            wide = int(row[some].max()) + 1 - low
            key = self.of_term[spread] * wide + np.repeat(row[some] - low, count[some])
            sums = np.bincount(key, np.repeat(value[some], count[some]), len(self.questions) * wide)
            out[:, low : low + wide] += sums.reshape(len(self.questions), wide)
            at = stop
        return out


def _tiles(batch: pa.RecordBatch, asked: dict[int, _Terms]) -> Iterator[tuple]:
    """Rows of one snapshot at a time, with the occurrences of the terms that its questions want: the snapshot, its terms,
    chunk ids, and of each occurrence its row, term, position and weight. Rows come with a bounded number of words."""
    snapshots = batch.column("snapshot_id").to_numpy()
    for snapshot in np.unique(snapshots).tolist():
        wanted = asked.get(snapshot)
        if wanted is None:
            continue
        mine = np.flatnonzero(snapshots == snapshot)
        step = max(1, TILE_CELLS // len(wanted.questions))
        words = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False)[mine])
        stop = 0
        while stop < len(mine):
            first, before = stop, words[stop - 1] if stop else 0
            stop = min(first + step, max(first + 1, int(np.searchsorted(words, before + TILE_WORDS, side="right"))))
            some = batch.take(pa.array(mine[first:stop]))
            lists = some.column("terms")
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            term = pc.fill_null(pc.index_in(lists.flatten(), value_set=wanted.words), -1).to_numpy()
            row = np.repeat(np.arange(len(length)), length)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length) + 1
            keep = np.flatnonzero(term >= 0)
            weight = some.column("weights").flatten().to_numpy()[keep]
            yield snapshot, wanted, some.column("chunk_id").to_numpy(), row[keep], term[keep], pos[keep], weight


def _blocks(terms: DataFrame) -> Iterator[dict[int, _Terms]]:
    """Questions' terms (query_id, snapshot_id, term) by snapshot, in blocks of bounded size."""
    for block in question_blocks(terms, QUESTIONS):
        by_snapshot: dict[int, list[tuple[int, str]]] = {}
        columns = (block.column(c).to_pylist() for c in ("snapshot_id", "query_id", "term"))
        for snapshot, question, term in zip(*columns, strict=True):
            by_snapshot.setdefault(snapshot, []).append((question, term))
        yield {snapshot: _Terms(rows) for snapshot, rows in by_snapshot.items()}


def _over_chunks(search: DataFrame, terms: DataFrame, work, schema: str) -> DataFrame:
    """`work` over the chunks of the snapshots that are asked, once for each block of questions."""
    session = search.sparkSession
    here = search.join(terms.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    found = None
    for block in _blocks(terms):
        part = here.mapInArrow(partial(work, session.sparkContext.broadcast(block)), schema)
        found = part if found is None else found.unionByName(part)
    return session.createDataFrame([], schema) if found is None else found


_MATCHES = (
    "query_id bigint, snapshot_id bigint, chunk_id bigint, "
    "matches array<struct<term:string,places:array<struct<pos:int,weight:int>>>>"
)
_PLACES = pa.list_(
    pa.struct([("term", pa.string()), ("places", pa.list_(pa.struct([("pos", pa.int32()), ("weight", pa.int32())])))])
)


def _match_all(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that hold every term of a question, with the places of each."""
    for batch in batches:
        for snapshot, wanted, chunk_ids, row, term, pos, weight in _tiles(batch, shared.value):
            key, first = np.unique(row * len(wanted.words) + term, return_index=True)
            has = wanted.sums(key // len(wanted.words), key % len(wanted.words), np.ones(len(key)), len(chunk_ids))
            question, at = np.nonzero(has == wanted.need[:, None])
            order = np.lexsort((pos, term, row))
            keyed = (row * len(wanted.words) + term)[order]
            names = wanted.words.to_pylist()
            matches = []
            for q, r in zip(question.tolist(), at.tolist(), strict=True):
                found = []
                for t in wanted.by_question[q]:
                    a, b = np.searchsorted(keyed, [r * len(names) + t, r * len(names) + t + 1])
                    spots = order[a:b]
                    places = [{"pos": int(p), "weight": int(w)} for p, w in zip(pos[spots], weight[spots], strict=True)]
                    found.append({"term": names[t], "places": places})
                matches.append(found)
            columns = [
                pa.array(wanted.questions[question], pa.int64()),
                pa.array([snapshot] * len(question), pa.int64()),
                pa.array(chunk_ids[at], pa.int64()),
                pa.array(matches, _PLACES),
            ]
            yield pa.record_batch(columns, ["query_id", "snapshot_id", "chunk_id", "matches"])


def cover_scores(
    match: np.ndarray, pos: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, matches: int
) -> np.ndarray:
    """Cover density of each match, from the places of a question's terms (numbered from 0) in the chunks that hold all of them.

    Places are put in order; the last place of each term so far is carried along, and the earliest of those is where the span ending here
    starts. Sums over a span are differences of running sums, which are whole numbers.
    """
    order = np.lexsort((term, pos, match))
    match, pos, term, weight = (x[order] for x in (match, pos, term, weight))
    wide = int(pos.max(initial=0)) + 2
    keyed = match * wide + pos
    start = None
    for t in range(terms):
        last = np.maximum.accumulate(np.where(term == t, keyed, 0))
        start = last if start is None else np.minimum(start, last)
    before = np.concatenate([[-1], start[:-1]])
    ends = np.flatnonzero((start > match * wide) & (start > before))
    first = np.searchsorted(keyed, start[ends])
    running = np.concatenate([[0.0], np.cumsum(10.0 / weight)])
    count = ends + 1 - first
    inverse = running[ends + 1] - running[first]
    gap = keyed[ends] - start[ends] + 1 - count
    return np.bincount(match[ends], (count * 2.0 / inverse) / (gap + 1), matches)


_SCORED = "query_id bigint, chunk_id bigint, score double"


def _score_all(k: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best rows of each question among those that hold all of its terms, by cover density."""
    best = BestRows(k)
    for batch in batches:
        for _, wanted, chunk_ids, row, term, pos, weight in _tiles(batch, shared.value):
            names = len(wanted.words)
            key, count = np.unique(row * names + term, return_counts=True)
            has = wanted.sums(key // names, key % names, np.ones(len(key)), len(chunk_ids))
            question, at = np.nonzero(has == wanted.need[:, None])
            if not len(question):
                continue
            order = np.lexsort((pos, term, row))
            pos, weight = pos[order], weight[order]
            first = np.cumsum(count) - count
            for q in np.unique(question).tolist():
                rows = at[question == q]
                terms = np.array(wanted.by_question[q])
                spots = np.searchsorted(key, (rows[:, None] * names + terms).ravel())
                n = count[spots]
                places = np.arange(int(n.sum())) + np.repeat(first[spots] - (np.cumsum(n) - n), n)
                match = np.repeat(np.repeat(np.arange(len(rows)), len(terms)), n)
                own = np.repeat(np.tile(np.arange(len(terms)), len(rows)), n)
                scores = cover_scores(match, pos[places], own, weight[places], len(terms), len(rows))
                best.add_scores(wanted.questions[q : q + 1], np.round(scores, DIGITS)[None], chunk_ids[rows], chunk_ids[rows])
    query_id, chunk_id, score, _ = best.best()
    columns = [pa.array(query_id, pa.int64()), pa.array(chunk_id, pa.int64()), pa.array(score, pa.float64())]
    yield pa.record_batch(columns, ["query_id", "chunk_id", "score"])


def _score_any(k: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best rows of each question by the weight of its words in them."""
    best = BestRows(k)
    for batch in batches:
        for _, wanted, chunk_ids, row, term, _, weight in _tiles(batch, shared.value):
            scores = wanted.sums(row, term, weight.astype(np.float64), len(chunk_ids)).astype(np.float64)
            scores[scores == 0] = -np.inf
            best.add_scores(wanted.questions, scores, chunk_ids, chunk_ids)
    query_id, chunk_id, score, _ = best.best()
    yield pa.record_batch(
        [pa.array(query_id, pa.int64()), pa.array(chunk_id, pa.int64()), pa.array(score, pa.float64())],
        ["query_id", "chunk_id", "score"],
    )


def all_words(plans: DataFrame, search: DataFrame) -> DataFrame:
    """Chunks that hold every term of a query, with the places of each term:
    query_id, snapshot_id, chunk_id, matches array<(term, places)>.

    The questions go to the chunks' search vectors in blocks of bounded size; only matches come out, and nothing shuffles.
    """
    return _over_chunks(search, and_terms(plans), _match_all, _MATCHES)


# ── Scores ────────────────────────────────────────────────────────────────────


def cover_score(matches: Column) -> Column:
    """Cover density of a chunk: over the shortest spans that hold every term, the harmonic mean
    weight of the words in the span over one plus the other words in it.

    One pass over the occurrences in order, keeping where each term was last seen: the earliest of
    those is where the span ending here starts, and a start seen for the first time is a cover.
    """
    places = F.array_sort(
        F.flatten(
            F.transform(
                matches,
                lambda m, i: F.transform(
                    m["places"],
                    lambda p: F.struct(
                        p["pos"].alias("pos"), i.alias("term"), p["weight"].alias("weight")
                    ),
                ),
            )
        )
    )
    return tx.let(places, lambda at_hand: _cover_score(at_hand, matches))


def _cover_score(places: Column, matches: Column) -> Column:
    """`cover_score` from the sorted (pos, term, weight) places of all terms."""
    unseen = F.transform(matches, lambda _: F.lit(0))
    state = F.struct(
        unseen.alias("last"), F.lit(0).alias("start"), F.lit(0.0).cast("double").alias("score")
    )

    def step(acc: Column, p: Column) -> Column:
        last = F.transform(
            acc["last"], lambda at, i: F.when(i == p["term"], p["pos"]).otherwise(at)
        )
        return tx.let(last, lambda last: cover(acc, p, last))

    def cover(acc: Column, p: Column, last: Column) -> Column:
        start = F.array_min(last)
        score = acc["score"] + F.when(start > acc["start"], worth(start, p["pos"])).otherwise(0.0)
        return F.struct(
            last.alias("last"),
            F.greatest(start, acc["start"]).alias("start"),
            score.alias("score"),
        )

    def worth(start: Column, end: Column) -> Column:
        inside = F.filter(places, lambda p: p["pos"].between(start, end))
        count = F.size(inside)
        # 10 / fifths is twice the inverse weight: 2, 5 or 10, so the sum is exact.
        inverse = F.aggregate(
            inside, F.lit(0.0), lambda s, p: s + F.lit(10.0) / p["weight"]
        )
        gap = (end - start + 1) - count
        return (count * 2.0 / inverse) / (gap + 1)

    return F.aggregate(places, state, step, lambda acc: acc["score"])


def cover_density(matches: DataFrame) -> DataFrame:
    """Rows of `all_words` with their cover density as score."""
    return matches.withColumn("score", F.round(cover_score(F.col("matches")), DIGITS)).drop(
        "matches"
    )


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The best `k` chunks per query by score, then id, as hits of the fts leg."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.lit("fts").alias("leg"), "rank", "chunk_id", "score")
    )


def fts_and(plans: DataFrame, search: DataFrame, *, k: int = FTS_LIMIT) -> DataFrame:
    """Hits that hold every term of the query, by cover density.

    Matches are scored where the chunks are read, and a task keeps the best `k` of each query; no match is a row.
    """
    return ranked(_over_chunks(search, and_terms(plans), partial(_score_all, k), _SCORED), k)


def fts_or(
    plans: DataFrame, and_hits: DataFrame, search: DataFrame, *, k: int = FTS_LIMIT
) -> DataFrame:
    """For queries without an all-words hit: chunks with any term, by the weight of its words.

    A task adds weights up for the chunks it reads and keeps the best `k` for each query; pairs of queries and chunks
    are never rows.
    """
    terms = any_terms(plans.join(and_hits.select("query_id"), "query_id", "left_anti"))
    scored = _over_chunks(search, terms, partial(_score_any, k), "query_id bigint, chunk_id bigint, score double")
    return ranked(scored.withColumn("score", F.round(F.col("score") * UNIT, DIGITS)), k)
