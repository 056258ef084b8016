"""The legs and their fusion on small corpora, and against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as tx
from corpuscle.operators import fts_leg as fts
from corpuscle.operators import fusion as fu
from corpuscle.operators import symbol_leg as sl
from corpuscle.operators import vector_leg as vl
from corpuscle.plans import index
from corpuscle.plans import retrieve as rt

CHUNK = (
    "snapshot_id bigint, chunk_id bigint, path string, kind string, name string, qualname string, "
    "part int, start_line int, end_line int, signature string, text string, content_hash string"
)


def corpus(spark, rows):
    """Chunks from (snapshot, id, path, name, qualname, start_line, text)."""
    full = [
        (s, i, path, "function", name, qualname, 0, line, line + 5, None, text, f"h-{text}")
        for s, i, path, name, qualname, line, text in rows
    ]
    return (
        spark.createDataFrame(full, CHUNK)
        .withColumn("search_a", tx.search_text(F.col("name"), F.col("qualname")))
        .withColumn("search_b", F.lit(""))
        .withColumn("search_c", tx.split_identifiers(F.col("text")))
    )


def plans(spark, rows):
    """(query_id, snapshot, query, identifiers) with an intent."""
    given = spark.createDataFrame(
        rows, "query_id bigint, snapshot_id bigint, query string, identifiers array<string>"
    )
    return given.withColumn("intent", F.lit("explain"))


SHOP = [
    (1, 1, "shop.py", "Item", "shop.Item", 1, "class Item price"),
    (1, 2, "shop.py", "label", "shop.Item.label", 5, "def label getter"),
    (1, 3, "shop.py", "label", "shop.Item.label", 9, "def label setter"),
    (1, 4, "tests.py", "test_label", "tests.test_label", 1, "def test label works"),
    (1, 5, "tests.py", "label_test_all", "tests.label_test_all", 9, "def all"),
    (1, 6, "a.py", "aXb", "a.aXb", 1, "x"),
    (2, 7, "shop.py", "Item", "shop.Item", 1, "class Item price"),
]


def members(spark, identifiers, query=""):
    """Resolved identifiers of one plan on the shop."""
    asked = plans(spark, [(1, 1, query, identifiers)])
    aliases = sl.symbol_aliases(corpus(spark, SHOP))
    return sl.resolve_identifiers(sl.candidate_identifiers(asked), aliases)


def test_resolution_keeps_order_and_case(spark):
    rows = members(spark, ["Item.label", "nothing", "item"], "Item a_b shop.Item").orderBy("ord")
    assert [r.identifier for r in rows.collect()] == ["Item.label", "Item", "label", "shop.Item"]


def hits(spark, identifiers, query=""):
    """(chunk, score) of the symbol leg, in rank order."""
    _, found = rt.search_symbols(plans(spark, [(1, 1, query, identifiers)]), corpus(spark, SHOP))
    return [(r.chunk_id, r.score) for r in found.orderBy("rank").collect()]


def test_ladder(spark):
    assert hits(spark, ["shop.Item"])[0] == (1, 1.0)
    # `Item.label` also stands for `Item` and `label`, which come after it.
    assert hits(spark, ["Item.label"]) == [(2, 1 / 3), (3, 1 / 3), (1, 0.5), (4, 0.25), (5, 0.25)]
    assert hits(spark, ["test_label", "Item"]) == [(4, 0.5), (1, 0.5)]
    assert hits(spark, ["a_b"]) == []


def test_short_identifiers_are_found_inside_names(spark):
    found = sl.containing_names(
        spark.createDataFrame([(1, "X"), (1, "be"), (1, "zz"), (2, "te"), (2, "abel")], "snapshot_id bigint, identifier string"),
        sl.name_grams(corpus(spark, SHOP)),
    )
    assert sorted((r.identifier, r.name) for r in found.collect()) == [
        ("X", "aXb"), ("be", "label"), ("be", "label_test_all"), ("be", "test_label"), ("te", "Item"),
    ]


def ladder_by_rule(rows, identifiers):
    """Chunk ids of a symbol search, found by looking at every chunk."""
    def rung(i, row):
        if row[4] == i:
            return 1
        if row[3] == i:
            return 2
        return 3 if row[4].endswith(f".{i}") else None

    best = {}
    for order, i in enumerate(identifiers):
        found = {row[1]: rung(i, row) for row in rows if rung(i, row)}
        for chunk, r in found.items():
            if r == min(found.values()):
                best.setdefault(chunk, (order, r))
    loose = {}
    for order, i in enumerate(identifiers):
        for row in rows:
            if i in row[3] and row[3] != i and row[1] not in best:
                loose.setdefault(row[1], (order, len(row[3]), row[1]))
    kept = sorted(loose, key=loose.get)[:20]
    place = {row[1]: (row[2], row[5]) for row in rows}
    exact = sorted(best, key=lambda c: (*best[c], *place[c], c))
    rest = sorted(kept, key=lambda c: (loose[c][0], *place[c], c))
    return [*exact, *rest][:50]


@pytest.mark.parametrize("seed", range(3))
def test_symbol_search_is_whole_when_one_name_is_everywhere(spark, seed):
    rng = random.Random(seed)
    names = ["get", "get_item", "set", "run", "reset", "target"]
    rows = []
    for i in range(300):
        name = "get" if rng.random() < 0.35 else rng.choice(names) + rng.choice(["", "_x", "Y"])
        rows.append((1, i, f"f{rng.randint(0, 40)}.py", name, f"m{i % 3}.{name}", rng.randint(1, 99), "t"))
    wanted = (["get"], ["m1.set", "se"], ["reset", "get", "run"], ["targetY", "t"])
    asked = plans(spark, [(q, 1, "", ids) for q, ids in enumerate(wanted)])
    resolved, ranked = rt.search_symbols(asked, corpus(spark, rows))
    known, got = {}, {}
    for r in resolved.orderBy("query_id", "ord").collect():
        known.setdefault(r.query_id, []).append(r.identifier)
    for r in ranked.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {q: ladder_by_rule(rows, ids) for q, ids in known.items()}


# ── Full text ─────────────────────────────────────────────────────────────────


def text_hits(spark, rows, query):
    """({leg mode}, chunk ids in rank order) of one query."""
    asked = plans(spark, [(1, 1, query, [])])
    both = rt.search_texts(asked, corpus(spark, rows))
    found = {mode: [(r.chunk_id, r.score) for r in h.orderBy("rank").collect()] for mode, h in zip(("and", "or"), both)}
    return {mode: h for mode, h in found.items() if h}


def test_all_words_first_then_any_word(spark):
    assert [c for c, _ in text_hits(spark, SHOP, "Item price")["and"]] == [1]
    found = text_hits(spark, SHOP, "How does label works?")
    assert list(found) == ["or"] and found["or"][0][0] == 4
    assert text_hits(spark, SHOP, "nowhere") == {}
    assert text_hits(spark, SHOP, "?? --") == {}


def test_weights_by_field(spark):
    rows = fts.build_postings(corpus(spark, SHOP[:1]).withColumn("search_b", F.lit("Doc")))
    found = [(r.pos, r.term, r.weight) for r in rows.orderBy("pos").collect()]
    assert found == [
        (1, "item", 5), (2, "shop", 5), (3, "item", 5), (4, "shop", 5), (5, "item", 5), (6, "doc", 2),
        (7, "class", 1), (8, "item", 1), (9, "price", 1),
    ]


def density_by_rule(words, terms):
    """Cover density over words of equal weight 0.2, by trying every span."""
    spans = [
        (s, e)
        for s in range(len(words))
        for e in range(s, len(words))
        if terms <= set(words[s : e + 1])
    ]
    least = [(s, e) for s, e in spans if not any((a, b) != (s, e) and s <= a and b <= e for a, b in spans)]
    return sum(0.2 / (1 + sum(w not in terms for w in words[s : e + 1])) for s, e in least)


def test_cover_density_on_random_texts(spark):
    rng = random.Random(11)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randint(3, 25))] for _ in range(60)]
    rows = [(1, i, "p", None, None, 1, " ".join(t)) for i, t in enumerate(texts)]
    asked = plans(spark, [(1, 1, "a b c", [])])
    search = fts.search_rows(corpus(spark, rows))
    scored = fts.cover_density(fts.all_words(asked, search)).collect()
    expected = {i: density_by_rule(t, set("abc")) for i, t in enumerate(texts) if set("abc") <= set(t)}
    assert {r.chunk_id: r.score for r in scored} == pytest.approx(expected)


# ── Vectors ───────────────────────────────────────────────────────────────────


def test_chunks_are_scored_a_bounded_number_of_words_at_a_time():
    words = pa.array([["a", "b", "c", "d"] * 250] * 1_000, pa.list_(pa.string()))
    weights = pa.array([[1] * 1_000] * 1_000, pa.list_(pa.int32()))
    ids = pa.array(range(1_000), pa.int64())
    batch = pa.record_batch([pa.array([1] * 1_000, pa.int64()), ids, words, weights], ["snapshot_id", "chunk_id", "terms", "weights"])
    tiles = list(fts._tiles(batch, {1: fts._Terms([(1, "a"), (2, "b")])}))
    assert sum((tile[2].tolist() for tile in tiles), []) == list(range(1_000))
    assert max(len(tile[2]) for tile in tiles) * 1_000 <= 1 << 18 and sum(len(tile[3]) for tile in tiles) == 500_000


@pytest.mark.parametrize("spread", [1, 7, 1 << 20])
def test_sums_over_pairs_of_words_and_questions_in_parts(monkeypatch, spread):
    monkeypatch.setattr(fts, "SPREAD", spread, raising=False)
    rng = np.random.default_rng(spread)
    wanted = fts._Terms([(q, w) for q in range(9) for w in "abcdefg" if rng.random() < 0.5])
    row, term = np.sort(rng.integers(0, 20, 300)), rng.integers(0, len(wanted.words), 300)
    value = rng.integers(1, 9, 300).astype(float)
    want = np.zeros((len(wanted.questions), 20))
    for q, own in wanted.by_question.items():
        for r, t, v in zip(row, term, value, strict=True):
            want[q, r] += v * (t in own)
    assert np.array_equal(wanted.sums(row, term, value, 20), want)
    assert wanted.sums(row[:0], term[:0], value[:0], 3).tolist() == [[0.0] * 3] * len(wanted.questions)


def vector_world(spark, n, hot):
    """(chunks, vectors, queries, matrix): `hot` chunks share the first of `n` texts."""
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(n, 8)).astype(np.float32)
    owners = [0] * hot + list(range(1, n))
    chunks = spark.createDataFrame(
        [(1, i, f"h{o}") for i, o in enumerate(owners)] + [(2, 10_000, "h1")],
        "snapshot_id bigint, chunk_id bigint, content_hash string",
    )
    vectors = spark.createDataFrame(
        [(f"h{o}", "m", [float(x) for x in v]) for o, v in enumerate(matrix)] + [("h1", "other", [0.0] * 8)],
        "content_hash string, model string, embedding array<float>",
    )
    queries = spark.createDataFrame(
        [(q, 1, [float(x) for x in matrix[q]]) for q in range(6)] + [(99, 2, [float(x) for x in matrix[5]])],
        "query_id bigint, snapshot_id bigint, embedding array<float>",
    )
    return chunks, vectors, queries, matrix, owners


def test_vector_topk_is_exact_whole_and_stays_in_its_snapshot(spark, monkeypatch):
    monkeypatch.setattr(vl, "QUESTIONS", 2)  # many blocks
    chunks, vectors, queries, matrix, owners = vector_world(spark, 120, 60)
    rows = vl.vector_topk(queries, chunks, vectors, "m", k=10).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.chunk_id)
    unit = matrix.astype(float) / np.linalg.norm(matrix.astype(float), axis=1, keepdims=True)
    for q in range(6):
        scores = np.round(unit[owners] @ unit[q], 9)
        assert found[q] == list(np.lexsort((np.arange(len(owners)), -scores))[:10])
    assert found[99] == [10_000]
    best = {r.query_id: r.score for r in rows if r.rank == 1}
    assert best[3] == pytest.approx(1.0)


def test_approximate_search_recalls_most_and_tops_up(spark, tmp_path):
    chunks, vectors, queries, _, _ = vector_world(spark, 300, 3)

    def pairs(rows):
        return {(r.query_id, r.chunk_id) for r in rows.collect()}

    exact = pairs(vl.vector_topk(queries, chunks, vectors, "m"))
    index = vl.index_vectors(vl.hash_vectors(vl.first_chunks(chunks, 20), vectors, "m"), str(tmp_path / "index"))
    assert len(index.centres) > 10
    found = pairs(vl.vector_topk_approx(queries, vl.first_chunks(chunks, 20), index))
    assert len(found & exact) >= 0.9 * len(exact)
    assert {p for p in exact if p[0] == 99} <= found


# ── Fusion ────────────────────────────────────────────────────────────────────


def fused(spark, ranks, chunks=None):
    """Fusion of (leg, rank, chunk) rows."""
    rows = spark.createDataFrame(
        [(1, leg, r, c, 0.0) for leg, r, c in ranks],
        "query_id bigint, leg string, rank int, chunk_id bigint, score double",
    )
    chunks = chunks or corpus(spark, [(1, i, "a.py", f"f{i}", f"m.f{i}", 1, "t") for i in (1, 2, 3)])
    return fu.rrf_fuse(rows, chunks)


def test_ranks_add_up_and_the_best_leg_gives_the_tier(spark):
    ranks = [("symbol", 1, 1), ("symbol", 2, 2), ("fts", 1, 2), ("fts", 2, 3), ("vector", 1, 3), ("vector", 2, 2)]
    rows = fused(spark, ranks).orderBy("rank").collect()
    assert [(r.chunk_id, r.tier) for r in rows] == [(2, "fts"), (3, "vector"), (1, "symbol")]
    assert [r.score for r in rows] == pytest.approx([1 / 62 + 1 / 61 + 1 / 62, 1 / 62 + 1 / 61, 1 / 61])


def test_ties_go_to_the_symbol_leg(spark):
    rows = fused(spark, [("vector", 1, 2), ("symbol", 1, 1)]).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [1, 2]
    (row,) = fused(spark, [("vector", 1, 2), ("symbol", 1, 2)]).collect()
    assert row.tier == "symbol"


def test_parts_collapse_but_unnamed_windows_do_not(spark):
    rows = spark.createDataFrame(
        [(1, 1, 10, "a.py", "method", "f", "m.f"), (1, 2, 11, "a.py", "method", "f", "m.f"),
         (1, 3, 12, "b.py", "method", "f", "m.f"), (1, 4, 13, "n.txt", "window", None, None),
         (1, 5, 14, "n.txt", "window", None, None), (1, 6, 15, "R.md", "window", "Use", None),
         (1, 7, 16, "R.md", "window", "Use", "")],
        "query_id int, rank int, chunk_id int, path string, kind string, name string, qualname string",
    )
    kept = fu.collapse_parts(rows).orderBy("rank").collect()
    assert [(r.rank, r.chunk_id) for r in kept] == [(1, 10), (2, 12), (3, 13), (4, 14), (5, 15)]


@pytest.mark.parametrize(
    ("count", "intent", "sizes"),
    [(100, "lookup", (12, 30)), (100, "enumerate", (12, 60)), (50, "enumerate", (12, 38)), (5, "lookup", (5, 0))],
)
def test_split_hits(spark, count, intent, sizes):
    rows = spark.range(1, count + 1).select(F.lit(1).alias("query_id"), F.col("id").cast("int").alias("rank"))
    asked = spark.createDataFrame([(1, intent)], "query_id int, intent string")
    shown = [r.shown for r in fu.split_hits(rows, asked).collect()]
    assert (shown.count("full"), shown.count("index")) == sizes


def test_floor(spark):
    asked = spark.createDataFrame([(i,) for i in range(1, 6)], "query_id bigint")
    def legs(rows):
        return spark.createDataFrame(rows, "query_id bigint, score double")

    vector = legs([(1, 0.1), (3, 0.35), (4, 0.1), (5, 0.1)])
    rows = fu.relevance_floor(asked, legs([(4, 1.0)]), legs([(5, 1.0)]), vector, floor=0.35)
    verdict = {r.query_id: r.no_relevant_sources for r in rows.collect()}
    assert verdict == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_hybrid_retrieval_without_vectors(spark):
    asked = plans(spark, [(1, 1, "Item price", ["shop.Item"]), (2, 2, "nothing here", [])])
    found = rt.hybrid_retrieve(asked, corpus(spark, SHOP), None, None, "m")
    rows = found.hits.orderBy("query_id", "rank").collect()
    assert {(r.query_id, r.chunk_id) for r in rows if r.query_id == 1} >= {(1, 1)}
    assert all(r.chunk_id != 7 for r in rows)  # another snapshot
    trace = {(r.query_id, r.leg): r.status for r in found.trace.collect()}
    assert trace[1, "symbol"] == "ok" and trace[1, "fts"] == "ok" and trace[1, "vector"] == "unavailable"
    assert trace[2, "symbol"] == "skipped" and trace[2, "fts"] == "empty"
    assert {r.query_id: r.no_relevant_sources for r in found.floor.collect()} == {1: False, 2: True}


def test_what_the_index_job_stores_can_be_searched(spark, tmp_path):
    files = spark.createDataFrame(
        [("r", 1, "shop.py", "class Item:\n    def label(self):\n        return price\n"), ("r", 1, "tests.py", "def test_label():\n    pass\n"), ("s", 2, "shop.py", "class Item:\n    pass\n")],
        "repo string, snapshot_id bigint, path string, text string",
    ).select("repo", "snapshot_id", "path", F.octet_length("text").cast("bigint").alias("size_bytes"), F.encode("text", "utf-8").alias("content"))
    index.store_index(index.build_index(files), str(tmp_path))
    chunks = spark.read.parquet(str(tmp_path / "chunks")).withColumn("snapshot_id", F.col("snapshot_id").cast("bigint"))
    asked = plans(spark, [(1, 1, "label price", ["Item.label"]), (2, 2, "Item", ["Item"])])
    shown = rt.hybrid_retrieve(asked, chunks, None, None, "m").hits.join(chunks.select("chunk_id", "qualname", "repo"), "chunk_id")
    first = {r.query_id: (r.repo, r.qualname) for r in shown.filter("rank = 1").collect()}
    assert first == {1: ("r", "shop.Item.label"), 2: ("s", "shop.Item")}
    assert {r.repo for r in shown.filter("query_id = 2").collect()} == {"s"}


def test_symbol_parts_match_null_names(spark):
    rows = corpus(spark, [(1, i, "R.md", None if i < 3 else "Use", None, i, "t") for i in range(1, 5)])
    rows = rows.withColumn("part", F.lit(1))
    one = rows.filter("chunk_id = 1").withColumn("query_id", F.lit(1))
    assert sorted(r.chunk_id for r in fu.symbol_parts(one, rows).collect()) == [1, 2]
