"""Filters, candidates, refinement and the whole retrieval plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexolith.config import Retrieval
from lexolith.functions import predicates
from lexolith.functions.text import shingles, tokens
from lexolith.functions.vectors import is_valid_vector
from lexolith.operators import refine
from lexolith.operators.refine import diversified, without_contained, without_similar
from lexolith.operators.retrieval import best_texts, nearest, similar
from lexolith.operators.text_index import best_indexed, write_text_index
from lexolith.operators.vector_index import nearest_indexed, write_vector_index
from lexolith.plans.retrieval import candidates, retrieve
from lexolith.queries import query
from lexolith.sources.shared import new_place
from lexolith.sources.tables import chunks, metadata, table

#: The queries of these registered queries: every hundredth vector, and all benchmark texts.
DIMENSIONS, NEAREST, FINAL = 64, 50, 15


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    return asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def hybrid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector with the text of its own document."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    return vector_queries(spark, sf_dir).join(texts, "query_id")


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] * x[2])::double))"
TOKENS = "list_filter(string_split_regex(lower({t}), '[^a-z0-9]+'), lambda w: w <> '')"
SHINGLES = (
    "list_distinct(CASE WHEN len({w}) >= 3 THEN list_transform(range(1, len({w}) - 1), lambda i: array_to_string({w}[i:i+2], ' ')) "
    "WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END)"
)
META_SQL = """
meta AS (
    SELECT d.doc_id, d.source AS client_id, d.lang, d.source, coalesce(l.toxic = 1, false) AS toxic
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""
CHUNKS_SQL = """
chunks AS MATERIALIZED (
    SELECT e.vec_id AS doc_id, d.text AS chunk, e.embedding AS vector, coalesce(l.toxic = 1, false) AS toxic, d.source AS client_id
    FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""
NEAREST_SQL = f"""
pairs AS (
    SELECT q.vec_id AS query_id, c.doc_id, round({DOT.format(a="q.embedding", b="c.vector")}, 6) AS score
    FROM chunks c JOIN embeddings q ON q.vec_id % 100 = 0 WHERE NOT c.toxic
),
near AS MATERIALIZED (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs) WHERE rank <= {NEAREST}
)"""


def active_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).filter(predicates.is_active(F.col("custom_metadata"))).select("doc_id", "chunk", "vector")


@query(f"WITH {META_SQL} SELECT doc_id FROM meta WHERE lang = 'en' AND source = 'src1' AND NOT toxic")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = predicates.retrievable(F.col("custom_metadata"), F.col("client_id"), None, [("lang", "en"), ("source", "src1")])
    return metadata(spark, sf_dir).filter(wanted).select("doc_id")


@query(f"WITH {META_SQL} SELECT doc_id FROM meta WHERE NOT toxic")
def active_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(spark, sf_dir).filter(predicates.is_active(F.col("custom_metadata"))).select("doc_id")


@query(f"WITH {META_SQL} SELECT doc_id, lang FROM meta WHERE client_id = 'src3' AND lang = 'fr' AND NOT toxic")
def tenant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = predicates.retrievable(F.col("custom_metadata"), F.col("client_id"), "src3", [("lang", "fr")])
    return metadata(spark, sf_dir).filter(wanted).select("doc_id", F.col("custom_metadata")[0]["value"].alias("lang"))


@query("SELECT vec_id, len(embedding)::bigint AS dimensions FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64")
def valid_vector_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(is_valid_vector(F.col("embedding"), DIMENSIONS))
    return rows.select("vec_id", F.size("embedding").cast("bigint").alias("dimensions"))


@query(f"WITH {CHUNKS_SQL}, {NEAREST_SQL} SELECT query_id, doc_id, score, rank FROM near WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(vector_queries(spark, sf_dir), active_chunks(spark, sf_dir), 10)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest active chunks of each query, by a stored index of cells; its recall is measured in the tests."""
    place = new_place(spark, "vector-index")
    write_vector_index(active_chunks(spark, sf_dir), place)
    return nearest_indexed(vector_queries(spark, sf_dir), spark, place, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""
WITH {CHUNKS_SQL}, pairs AS (
    SELECT q.vec_id AS query_id, c.doc_id, round({DOT.format(a="q.embedding", b="c.vector")}, 6) AS score
    FROM chunks c JOIN documents d ON d.doc_id = c.doc_id JOIN embeddings q ON q.vec_id % 100 = 0
    JOIN documents o ON o.doc_id = q.vec_id AND o.lang = d.lang WHERE NOT c.toxic
)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs) WHERE rank <= 10
""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query among the chunks of its own language."""
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("tag"))
    asked = vector_queries(spark, sf_dir).join(langs, "query_id")
    rows = chunks(spark, sf_dir).filter(predicates.is_active(F.col("custom_metadata")))
    own = F.transform(F.filter("custom_metadata", lambda m: m["key"] == "lang"), lambda m: m["value"])
    return nearest(asked, rows, 10, own).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""
SELECT a.vec_id AS a, b.vec_id AS b, round({DOT.format(a="a.embedding", b="b.embedding")}, 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id WHERE round({DOT.format(a="a.embedding", b="b.embedding")}, 6) >= 0.3
""")
def cosine_pairs_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = vector_queries(spark, sf_dir)  # a hundredth of the rows
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = similar(asked, rows, 0.3, "vec_id").filter("query_id <> vec_id")
    return found.select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), F.col("score").alias("similarity"))


BM25_SQL = f"""
docs AS (SELECT doc_id, {TOKENS.format(t="chunk")} AS words FROM texts),
totals AS (SELECT count(*) AS n, avg(len(words)) AS mean_length FROM docs),
post AS (SELECT doc_id, len(words) AS length, unnest(words) AS term FROM docs),
tf AS (SELECT term, doc_id, length, count(*) AS tf FROM post GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wanted AS (SELECT DISTINCT query_id, unnest({TOKENS.format(t="query_text")}) AS term FROM asked),
scored AS MATERIALIZED (
    SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / mean_length)))), 6) AS score
    FROM wanted JOIN tf USING (term) JOIN df USING (term), totals GROUP BY query_id, doc_id
)"""


BM25_TOPK_SQL = f"""
WITH texts AS (SELECT doc_id, text AS chunk FROM documents), asked AS (SELECT item_id AS query_id, text AS query_text FROM benchmark), {BM25_SQL}
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10
"""


@query(BM25_TOPK_SQL)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chunk"))
    return best_texts(text_queries(spark, sf_dir), texts, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(BM25_TOPK_SQL)
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a written index, by bounds."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chunk"))
    place = new_place(spark, "text-index")
    write_text_index(texts, place)
    return best_indexed(text_queries(spark, sf_dir), spark, place, 10).withColumn("rank", F.col("rank").cast("bigint"))


POOL_SQL = f"""
texts AS (SELECT doc_id, chunk FROM chunks WHERE NOT toxic),
asked AS (SELECT e.vec_id AS query_id, d.text AS query_text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 100 = 0), {BM25_SQL},
lexical AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {NEAREST}),
fused AS MATERIALIZED (
    SELECT query_id, doc_id, round(coalesce(1::double / (60 + n.rank), 0) + coalesce(1::double / (60 + l.rank), 0), 9) AS score
    FROM (SELECT * FROM near WHERE query_id IN (SELECT query_id FROM asked)) n FULL JOIN lexical l USING (query_id, doc_id)
),
pool AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= {NEAREST})"""


@query(f"WITH {CHUNKS_SQL}, {NEAREST_SQL}, {POOL_SQL} SELECT query_id, doc_id, score, rank FROM pool")
def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = candidates(hybrid_queries(spark, sf_dir), active_chunks(spark, sf_dir), Retrieval(nearest=NEAREST, pool=NEAREST))
    return pool.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""
WITH w AS (SELECT doc_id, {TOKENS.format(t="text")} AS w FROM documents)
SELECT doc_id, len(w)::bigint AS n_tokens, len({SHINGLES.format(w="w")})::bigint AS n_shingles FROM w
""")
def shingle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(shingles(F.col("w"), 3)).cast("bigint").alias("n_shingles"))


def vector_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pools on which the refining queries run: each vector query's nearest active chunks."""
    rows, asked = active_chunks(spark, sf_dir), vector_queries(spark, sf_dir)
    return nearest(asked, rows, NEAREST).join(rows, "doc_id").join(asked, "query_id")


COVER_SQL = f"""
words AS MATERIALIZED (SELECT n.*, {TOKENS.format(t="c.chunk")} AS w, c.vector FROM near n JOIN chunks c USING (doc_id)),
sets AS MATERIALIZED (SELECT *, {SHINGLES.format(w="w")} AS s FROM words)"""


@query(f"""
WITH {CHUNKS_SQL}, {NEAREST_SQL}, {COVER_SQL}
SELECT a.query_id, a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.s, b.s))::double / len(a.s), 6) AS containment
FROM sets a JOIN sets b ON a.query_id = b.query_id AND b.rank < a.rank AND len(a.s) > 0 AND len(list_intersect(a.s, b.s)) > 0
""")
def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = refine.containment_pairs(vector_pool(spark, sf_dir), 3)
    return pairs.withColumn("containment", F.round("containment", 6)).filter("containment > 0")


KEPT_SQL = """
kept AS (
    SELECT query_id, 1 AS step, [1::bigint] AS ranks FROM sets WHERE rank = 1
    UNION ALL
    SELECT k.query_id, k.step + 1, CASE WHEN EXISTS (SELECT 1 FROM covers c WHERE c.query_id = k.query_id AND c.a = k.step + 1 AND list_contains(k.ranks, c.b)) THEN k.ranks ELSE list_append(k.ranks, (k.step + 1)::bigint) END
    FROM kept k JOIN sets s ON s.query_id = k.query_id AND s.rank = k.step + 1
),
final AS (SELECT query_id, unnest(arg_max(ranks, step)) AS rank FROM kept GROUP BY query_id)
SELECT query_id, rank, doc_id FROM final JOIN sets USING (query_id, rank)
"""


@query(f"""
WITH RECURSIVE {CHUNKS_SQL}, {NEAREST_SQL}, {COVER_SQL},
covers AS MATERIALIZED (
    SELECT a.query_id, a.rank AS a, b.rank AS b FROM sets a JOIN sets b ON a.query_id = b.query_id AND b.rank < a.rank AND len(a.s) > 0
    WHERE len(list_intersect(a.s, b.s))::double / len(a.s) >= 0.95
), {KEPT_SQL}""")
def containment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_contained(vector_pool(spark, sf_dir), 3, 0.95)
    return kept.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""
WITH RECURSIVE {CHUNKS_SQL}, {NEAREST_SQL}, sets AS MATERIALIZED (SELECT n.*, c.vector FROM near n JOIN chunks c USING (doc_id)),
covers AS MATERIALIZED (
    SELECT a.query_id, a.rank AS a, b.rank AS b FROM sets a JOIN sets b ON a.query_id = b.query_id AND b.rank < a.rank
    WHERE {DOT.format(a="a.vector", b="b.vector")} >= 0.35
), {KEPT_SQL}""")
def cosine_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a threshold that the synthetic vectors reach."""
    return without_similar(vector_pool(spark, sf_dir), 0.35).withColumn("rank", F.col("rank").cast("bigint"))


def _mmr_sql(weight: float, pool: str = "sets") -> str:
    return f"""
sims AS MATERIALIZED (SELECT a.query_id, a.rank AS a, b.rank AS b, {DOT.format(a="a.vector", b="b.vector")} AS sim FROM {pool} a JOIN {pool} b ON a.query_id = b.query_id AND a.rank <> b.rank),
rel AS MATERIALIZED (SELECT p.query_id, p.rank, p.doc_id, {DOT.format(a="q.embedding", b="p.vector")} AS rel FROM {pool} p JOIN embeddings q ON q.vec_id = p.query_id),
picks AS (
    SELECT query_id, 1 AS pick, arg_max(rank, (rel, -rank)) AS rank, [arg_max(rank, (rel, -rank))] AS picked FROM rel GROUP BY query_id
    UNION ALL
    SELECT query_id, pick, rank, list_append(picked, rank) FROM (
        SELECT p.query_id, p.pick + 1 AS pick, p.picked, r.rank, row_number() OVER (PARTITION BY p.query_id ORDER BY {weight}::double * r.rel - {1 - weight}::double * (
            SELECT max(s.sim) FROM sims s WHERE s.query_id = p.query_id AND s.a = r.rank AND list_contains(p.picked, s.b)
        ) DESC, r.rank) AS nth
        FROM picks p JOIN rel r ON r.query_id = p.query_id AND NOT list_contains(p.picked, r.rank) WHERE p.pick < {FINAL}
    ) WHERE nth = 1
)
SELECT p.query_id, p.pick::bigint AS pick, r.doc_id FROM picks p JOIN rel r USING (query_id, rank)"""


def _mmr(weight: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return diversified(vector_pool(spark, sf_dir), FINAL, weight).withColumn("pick", F.col("pick").cast("bigint"))

    return run


for _name, _weight in (("mmr_topk", 0.5), ("mmr_relevance_only", 1.0), ("mmr_mostly_diverse", 0.25)):
    _f = _mmr(_weight)
    _f.__name__ = _name
    query(f"WITH RECURSIVE {CHUNKS_SQL}, {NEAREST_SQL}, sets AS MATERIALIZED (SELECT n.*, c.vector FROM near n JOIN chunks c USING (doc_id)), {_mmr_sql(_weight)}")(_f)


@query(f"""
WITH RECURSIVE {CHUNKS_SQL}, {NEAREST_SQL}, {POOL_SQL},
words_in AS MATERIALIZED (SELECT p.query_id, p.rank, p.doc_id, {TOKENS.format(t="c.chunk")} AS w, c.vector FROM pool p JOIN chunks c USING (doc_id)),
sets AS MATERIALIZED (SELECT *, {SHINGLES.format(w="w")} AS s FROM words_in),
covers AS MATERIALIZED (
    SELECT a.query_id, a.rank AS a, b.rank AS b FROM sets a JOIN sets b ON a.query_id = b.query_id AND b.rank < a.rank AND len(a.s) > 0
    WHERE len(list_intersect(a.s, b.s))::double / len(a.s) >= 0.95
),
{KEPT_SQL.replace("SELECT query_id, rank, doc_id FROM final JOIN sets USING (query_id, rank)", ", left_over AS MATERIALIZED (SELECT s.* FROM final JOIN sets s USING (query_id, rank))")},
{_mmr_sql(0.5, "left_over")}
""")
def retrieval_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan with containment and diversity on."""
    config = Retrieval(nearest=NEAREST, pool=NEAREST, final=FINAL, containment=True, diversify=True)
    found = retrieve(hybrid_queries(spark, sf_dir), chunks(spark, sf_dir), config)
    return found.withColumn("pick", F.col("pick").cast("bigint"))
