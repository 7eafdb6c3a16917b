"""Queries over vectors and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.catalogue.registry import query, search_sql, tokens_sql
from mnemolake.catalogue.search import QUERY, WORDS, _index
from mnemolake.functions import vectors as V
from mnemolake.operators import fulltext, fusion, vectorsearch
from mnemolake.plans.hybrid import HybridSearch
from mnemolake.sources.projection import Store

DIM = 64
PROBE = [round(((7 * i) % 13 - 6) / 10, 1) or 0.05 for i in range(DIM)]
_NORM = sum(x * x for x in PROBE) ** 0.5
UNIT = [x / _NORM for x in PROBE]
_UNIT_SQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in UNIT) + "]"
_DOT = f"list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({_UNIT_SQL})[i]))"


def _scores(where: str = "true") -> str:
    return f"SELECT vec_id AS id, greatest(-1, least(1, {_DOT})) AS score FROM embeddings WHERE {where}"


def _top(where: str, k: int) -> str:
    return f"SELECT id, round(score, 6) AS score FROM (SELECT * FROM ({_scores(where)}) ORDER BY round(score, 9) DESC, id LIMIT {k})"


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.round("score", 6).alias("score"))


@query(_top("true", 20))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectorsearch.top_k(Store(spark, d).vectors, UNIT, 20))


@query(_top("label % 3 IN (0, 2)", 20))
def cosine_topk_by_scope(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectorsearch.top_k(Store(spark, d).vectors, UNIT, 20, F.col("scope").isin("s0", "s2")))


@query(_top("label = 4", 20))
def cosine_topk_tagged(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectorsearch.top_k(Store(spark, d).vectors, UNIT, 20, fulltext.text_filter(tags=["Label:4"])))


@query(_top("vec_id IN (SELECT p_partkey FROM part WHERE p_size < 10)", 20))
def graph_pruned_vector(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    allow = store.table("part").where("p_size < 10").select(F.col("p_partkey").alias("id"))
    return _rounded(vectorsearch.top_k(store.vectors, UNIT, 20, allow=allow))


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id < 20),
s AS (SELECT query_id, vec_id AS id, list_sum(list_transform(list_zip(e, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM q, embeddings)
SELECT query_id, id, round(greatest(-1, least(1, score)), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(-1, least(1, score)), 9) DESC, id) AS rank FROM s QUALIFY rank <= 5""")
def cosine_topk_many(spark: SparkSession, d: str) -> DataFrame:
    vectors = Store(spark, d).vectors
    queries = vectors.where("id < 20").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return vectorsearch.top_k_many(vectors, queries, 5).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, list_sum(list_transform(list_zip(e, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score FROM q, embeddings)
SELECT query_id, id, round(greatest(-1, least(1, score)), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(-1, least(1, score)), 9) DESC, id) AS rank FROM s QUALIFY rank <= 5""")
def cosine_topk_every_20th(spark: SparkSession, d: str) -> DataFrame:
    """As ``cosine_topk_many``, which keeps its SQL's 20 queries, for every id divisible by 20."""
    vectors = Store(spark, d).vectors
    queries = vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return vectorsearch.top_k_many(vectors, queries, 5).withColumn("score", F.round("score", 6))


_SQ8 = """q AS (SELECT vec_id, embedding, (list_max(list_transform(embedding, lambda x: abs(x))) / 127::FLOAT)::FLOAT AS scale FROM embeddings),
c AS (SELECT vec_id, embedding, scale, list_transform(embedding, lambda x: greatest(-127, least(127, round((x / scale)::FLOAT)))::INTEGER) AS codes FROM q)"""


@query(f"WITH {_SQ8} SELECT vec_id AS id, round(scale::DOUBLE, 8) AS scale, array_to_string(codes, ',') AS codes, round(list_max(list_transform(range(1, 65), lambda i: abs(embedding[i]::DOUBLE - codes[i] * scale::DOUBLE))), 6) < 0.01 AS close FROM c")
def sq8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = Store(spark, d).vectors
    coded = vectorsearch.quantize(rows).join(rows.select("id", "vector"), "id")
    apart = F.array_max(F.zip_with(V.sq8_decode("codes", "scale"), "vector", lambda a, b: F.abs(a - b)))
    return coded.select("id", F.round(F.col("scale").cast("double"), 8).alias("scale"), F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), (apart < 0.01).alias("close"))


_Q_SCALE = f"(SELECT (list_max(list_transform({_UNIT_SQL}, lambda x: abs(x::FLOAT))) / 127::FLOAT)::FLOAT)"


@query(f"""WITH {_SQ8}, p AS (SELECT {_Q_SCALE} AS qs), pc AS (SELECT qs, list_transform({_UNIT_SQL}, lambda x: greatest(-127, least(127, round((x::FLOAT / qs)::FLOAT)))::INTEGER) AS qc FROM p),
s AS (SELECT vec_id AS id, greatest(-1, least(1, qs::DOUBLE * scale::DOUBLE * list_sum(list_transform(range(1, 65), lambda i: codes[i] * qc[i])))) AS score FROM c, pc)
SELECT id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY round(score, 9) DESC, id LIMIT 20)""")
def sq8_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectorsearch.top_k_quantized(vectorsearch.quantize(Store(spark, d).vectors), UNIT, 20))


# Notes and vectors share ids through the document: vector i stands for note i.
def _note_vectors(store: Store) -> DataFrame:
    return store.vectors.withColumn("id", F.col("id") + 4 * 10**12)


_LISTS = search_sql(WORDS, WORDS, 100) + f""",
tr AS (SELECT id, row_number() OVER (ORDER BY strict DESC, round(score, 9) DESC, id) AS r FROM hits),
vr AS (SELECT id + 4000000000000 AS id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM (SELECT * FROM ({_scores()}) ORDER BY round(score, 9) DESC, id LIMIT 100)),
fused AS (SELECT coalesce(tr.id, vr.id) AS id, coalesce(1::DOUBLE / (60 + tr.r), 0) + coalesce(1::DOUBLE / (60 + vr.r), 0) AS score, tr.r AS text_rank, vr.r AS vector_rank FROM tr FULL OUTER JOIN vr ON vr.id = tr.id)"""


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    search = HybridSearch(_index(spark, d), _note_vectors(Store(spark, d)))
    text, vector, _ = search.candidates(QUERY, 10, vector=UNIT, candidate_limit=100)
    return text, vector


@query(_LISTS + " SELECT id, round(score, 9) AS score, text_rank, vector_rank FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(*_lists(spark, d)).withColumn("score", F.round("score", 9))


@query(_LISTS + ", pl AS (SELECT id, min(at_) AS at_ FROM (SELECT id, 2 * r AS at_ FROM tr UNION ALL SELECT id, 2 * r + 1 FROM vr) GROUP BY id) SELECT id, row_number() OVER (ORDER BY at_) AS position FROM pl")
def alternating_merge(spark: SparkSession, d: str) -> DataFrame:
    return fusion.alternate(*_lists(spark, d))


@query(_LISTS + " SELECT id, round(score, 9) AS score FROM fused WHERE id IN (SELECT id FROM notes) OR true ORDER BY fused.score DESC, id LIMIT 10")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    search = HybridSearch(_index(spark, d), _note_vectors(Store(spark, d)))
    rows, _ = search.search(QUERY, 10, vector=UNIT, candidate_limit=100)
    return rows.select("id", F.round("score", 9).alias("score"))


@query()
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    """A reranker over the candidates of a two-word query that its budgets let through, scoring whole texts, each cut to
    its token budget, by distinct words shared; ties by id. SQL lacks the token budgets."""
    import re

    def overlap(query: str, documents: list[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [float(len(wanted & set(re.findall(r"\w+", text.lower())))) for text in documents]

    store = Store(spark, d)
    documents = store.notes.select("id", F.col("content").alias("text"))
    rows, _ = HybridSearch(_index(spark, d), rerank=overlap).search("license version", 10, documents=documents)
    return rows.select("id", "score")


@query("SELECT item_id::BIGINT AS id FROM benchmark WHERE item_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT DISTINCT user_id + 1000000000 FROM events WHERE user_id + 1000000000 NOT IN (SELECT vec_id FROM embeddings)")
def vector_gap(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    return vectorsearch.gaps(store.memories, store.vectors)


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)")
def vector_orphans(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    return vectorsearch.orphans(store.memories, store.vectors)


@query("SELECT 'memory' AS target, (SELECT count(*) FROM benchmark WHERE item_id NOT IN (SELECT vec_id FROM embeddings)) + (SELECT count(DISTINCT user_id) FROM events) = 0 AS ready UNION ALL SELECT 'none', true")
def readiness_by_target(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    rows = [("memory", vectorsearch.is_ready(store.memories, store.vectors)), ("none", vectorsearch.is_ready(store.memories.limit(0), store.vectors))]
    return spark.createDataFrame(rows, "target string, ready boolean")
