"""One query per operator over the given tables, and the reference SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import (
    binary_codes,
    bpe,
    clusters,
    crf,
    licences,
    mixing,
    naming,
    ngram_lm,
    private_data,
    quality,
    simhash,
    survival,
    token_files,
    vector_forest,
)
from corpuscle.llm.words import small_batches
from corpuscle.sources.tables import work_path

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document in the mix."""
    return mixing.taken_words(_table(spark, sf, "documents"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS mixed FROM documents),
s0 AS (SELECT source, sum(size)::DOUBLE AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS w FROM s0),
fill(step, source, place, s, w, held) AS (
  SELECT 0, source, place, s, w, false FROM s1
  UNION ALL
  SELECT step + 1, source, place, s, w, held OR
    (1.5 * sum(s) OVER () - coalesce(sum(2 * s) FILTER (WHERE held) OVER (), 0)) * w
    >= 2 * s * sum(w) FILTER (WHERE NOT held) OVER ()
  FROM fill WHERE step < 60),
f AS (SELECT * FROM fill WHERE step = 60),
t AS (SELECT source, place, s, CASE WHEN held THEN 2 * s ELSE w *
    (1.5 * sum(s) OVER () - coalesce(sum(2 * s) FILTER (WHERE held) OVER (), 0)) / sum(w) FILTER (WHERE NOT held) OVER () END
    AS target FROM f),
q AS (SELECT t.*, least(floor(target), 2 * s) AS quota FROM t),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY mixed, doc_id ROWS UNBOUNDED PRECEDING) - size AS pos FROM d)
SELECT o.doc_id, o.size::BIGINT AS size, q.s::BIGINT AS source_size, q.target,
  (greatest(0, least(pos + size, quota) - pos) + greatest(0, least(pos + size + s, quota) - pos - s))::BIGINT AS taken
FROM o JOIN q ON o.source IS NOT DISTINCT FROM q.source
"""


def op2_licences(spark: SparkSession, sf: str) -> DataFrame:
    """Licences and notices of every document."""
    return licences.scan_licences(_table(spark, sf, "documents"), licences.known_licences(spark))


def _canonical_sql(text: str) -> str:
    """The canonical form of a text in SQL."""
    out = f"regexp_replace(lower(coalesce({text}, '')), '{licences.COPYRIGHT_SENTENCE}', '\\1\\2 ', 'g')"
    out = f"regexp_replace({out}, '{licences.COPYRIGHT_LINE}', ' ', 'g')"
    out = f"' ' || regexp_replace({out}, '{licences.NOT_WORD}', ' ', 'g') || ' '"
    for other, kept in licences.SPELLINGS:
        out = f"replace({out}, ' {other} ', ' {kept} ')"
    return f"trim({out})"


_KNOWN = ", ".join("('{}', '{}')".format(key, text.replace("'", "''")) for key, text in licences.known_texts())
OP2_SQL = f"""
WITH t(licence, text) AS (VALUES {_KNOWN}),
k AS (SELECT sha256({_canonical_sql("text")}) AS digest, min(licence) AS licence FROM t GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_canonical_sql("text")}) AS digest FROM documents),
l AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
n AS (SELECT r, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
      FROM (SELECT r, sha256({_canonical_sql("line")}) AS digest FROM l WHERE line != '') JOIN k USING (digest) GROUP BY r)
SELECT doc_id, digest, licence, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN k USING (digest) LEFT JOIN n USING (r)
"""


def op3_ngram_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Language-model scores of every document, learnt from six folds of seven."""
    held_out = ngram_lm.held_out_fold(F.col("doc_id"))
    found = ngram_lm.score_documents(_table(spark, sf, "documents"), learn=~held_out)
    return found.withColumn("held_out", held_out)


def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the ids of every document and of their decoding."""
    path = tokenizer_file("word_bpe_49k.json")
    found = bpe.encode(_table(spark, sf, "documents"), path, decoded=True)
    digests = F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    return found.select("doc_id", "n_tokens", *digests)


def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hex_digits("code").alias("fingerprint"), "component_id")


def op6_private_data(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every document."""
    docs = _table(spark, sf, "documents")
    found = private_data.find_private(docs, private_data.train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in crf.KINDS],
        F.sha2(private_data.written(F.col("base")), 256).alias("base_sha256"),
        private_data.written(private_data.ordered(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op7_block_naming(spark: SparkSession, sf: str) -> DataFrame:
    """What stays of equal documents."""
    return naming.exact_duplicates(_table(spark, sf, "documents")).drop("n_chars")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS squeezed FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY squeezed ORDER BY n_chars DESC, doc_id) AS rank,
        first_value(doc_id) OVER (PARTITION BY squeezed ORDER BY n_chars DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY squeezed) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, rank = 1 AS kept, sha256(squeezed) AS text_sha256 FROM r
"""

def op8_binary_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Links and component of every vector."""
    return binary_codes.near_vectors(_table(spark, sf, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id
      AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = quality.scores(docs, _table(spark, sf, "labels")).select("doc.doc_id", "score")
    return found.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Where each document's ids are in the token files, and their checksum as read back."""
    out = work_path(spark, "token-files")
    token_files.write_ids(_table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), out)
    return token_files.read_ids(spark, out, checksums=True)


def op11_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return vector_forest.nearest_vectors(_table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


# The exact answer. It is the forest's too where a tree has one leaf (up to 512 distinct vectors); beyond, tests measure its recall.
OP11_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x != 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id != v.vec_id
      AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What each of five filters removes at each step of all their orders, by language."""
    return survival.filter_audit(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT d.doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e,
         coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id),
m AS (SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
      FROM x a JOIN x b ON b.bit != a.bit JOIN x c ON c.bit NOT IN (a.bit, b.bit) JOIN x d ON d.bit NOT IN (a.bit, b.bit, c.bit)
      JOIN x e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step])::INT - bits[step] AS earlier FROM o, range(1, 6) r(step)),
p AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (earlier + bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit != 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & earlier != 0 AND mask & bit != 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit != 0 AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit != 0 AND toxic), 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM p
"""


def op13_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The cluster of every vector after three rounds."""
    return clusters.clusters(_table(spark, sf, "embeddings"))


def _clusters_sql() -> str:
    """The rounds of clustering one after another."""
    nearest = (
        "SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS d "
        "FROM v JOIN c{0} k USING (i) GROUP BY vec_id, c) GROUP BY vec_id"
    )
    steps = []
    for k in range(3):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(k)})")
        steps.append(
            f"c{k + 1} AS MATERIALIZED (SELECT c, i, coalesce(m, k.x) AS x FROM c{k} k LEFT JOIN (SELECT c, i, "
            f"floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM a{k} JOIN v USING (vec_id) GROUP BY c, i) USING (c, i))"
        )
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, unnest(range(1, 65)) AS i, unnest(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v) QUALIFY c < 16),
c0 AS MATERIALIZED (SELECT c, i, x FROM f JOIN v USING (vec_id)),
{", ".join(steps)},
a3 AS MATERIALIZED ({nearest.format(3)}),
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN h USING (c)
"""


OP13_SQL = _clusters_sql()


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_licences": op2_licences,
    "op3_ngram_lm": op3_ngram_lm,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_private_data": op6_private_data,
    "op7_block_naming": op7_block_naming,
    "op8_binary_codes": op8_binary_codes,
    "op9_quality": op9_quality,
    "op10_token_files": op10_token_files,
    "op11_forest": op11_forest,
    "op12_filter_audit": op12_filter_audit,
    "op13_clusters": op13_clusters,
}
ORACLES: dict[str, str] = {
    "op1_mixing": OP1_SQL,
    "op2_licences": OP2_SQL,
    "op7_block_naming": OP7_SQL,
    "op8_binary_codes": OP8_SQL,
    "op11_forest": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_clusters": OP13_SQL,
}
