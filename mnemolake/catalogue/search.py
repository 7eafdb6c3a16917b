"""Queries over full-text search, fusion and presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.catalogue.registry import clean_sql, query, search_sql, tokens_sql, with_parts
from mnemolake.functions import text as T
from mnemolake.operators import fulltext, fusion
from mnemolake.operators.fulltext import TextIndex
from mnemolake.plans import presets
from mnemolake.sources.projection import Store

QUERY = "licensed under the Apache license"
WORDS = ["licensed", "under", "the", "apache", "license"]


def _index(spark: SparkSession, d: str) -> TextIndex:
    return TextIndex.build(Store(spark, d).text_documents)


def _hits(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("strict").cast("int").alias("strict"), F.round("score", 6).alias("score"))


_SELECT = " SELECT id, strict::INTEGER AS strict, round(score, 6) AS score FROM hits"


@query(search_sql(WORDS, WORDS, 20) + _SELECT)
def text_search_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(fulltext.search(_index(spark, d), QUERY, 20))


@query(search_sql(WORDS, WORDS, 200, mode="strict") + _SELECT)
def text_search_strict_only(spark: SparkSession, d: str) -> DataFrame:
    return _hits(fulltext.search(_index(spark, d), QUERY, 200, mode="strict"))


@query(search_sql(["idiot", "moron", "clown"], ["idiot", "moron", "clown"], 200, mode="loose") + _SELECT)
def text_search_loose_only(spark: SparkSession, d: str) -> DataFrame:
    return _hits(fulltext.search(_index(spark, d), "Idiot moron CLOWN", 200, mode="loose"))


@query(search_sql(WORDS, WORDS, 30, where="scope = 'public' AND list_contains(tags, 'quality:1')") + _SELECT)
def text_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = fulltext.text_filter("library", ["public"], ["chunk"], [" QUALITY:1 "])
    return _hits(fulltext.search(_index(spark, d), QUERY, 30, where=where))


@query(search_sql(["license"], ["license"], 30, where="id IN (4000000000029, 4000000000062, 4000000000093)") + _SELECT)
def text_search_in_notes(spark: SparkSession, d: str) -> DataFrame:
    where = fulltext.text_filter(note_ids=[4000000000029, 4000000000062, 4000000000093])
    return _hits(fulltext.search(_index(spark, d), "license", 30, where=where))


@query("SELECT 'zzzunknownzzz' AS query, 0::BIGINT AS n UNION ALL SELECT 'license', count(*) FROM documents WHERE list_contains(" + tokens_sql(clean_sql("text")) + ", 'license')")
def text_gate_no_match(spark: SparkSession, d: str) -> DataFrame:
    index = fulltext.counted(_index(spark, d), ["zzzunknownzzz", "license"], ("text", "name"))
    count = lambda q: fulltext.matches(index, q, where=F.col("namespace") == "library").agg(F.count(F.lit(1)).alias("n")).select(F.lit(q).alias("query"), "n")
    return count("zzzunknownzzz").union(count("license"))


@query(search_sql(["doc_62"], ["doc_62"], 10, field="name") + _SELECT)
def match_field_name(spark: SparkSession, d: str) -> DataFrame:
    return _hits(fulltext.search(_index(spark, d), "doc_62", 10, "name"))


@query(search_sql(["fr", "src3"], ["fr", "src3"], 50, field="path") + _SELECT)
def match_field_path(spark: SparkSession, d: str) -> DataFrame:
    return _hits(fulltext.search(_index(spark, d), "fr src3", 50, "path"))


@query(search_sql(["doc_93", "license"], ["doc_93", "license"], 10) + _SELECT)
def name_boost_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _hits(fulltext.search(_index(spark, d), "license doc_93", 10))


def _turn_index(spark: SparkSession, d: str) -> TextIndex:
    rows = Store(spark, d).turns
    return TextIndex.build(rows.select("id", "namespace", "scope", F.lit("chunk").alias("kind"), F.array("role").alias("tags"), "note_id", F.col("content").alias("text"), F.lit("").alias("name"), F.lit("").alias("path")))


_TURNS = f"""WITH t AS (SELECT 5500000000000 + conv_id * 10000 + turn AS id, 4500000000000 + conv_id AS note_id, {tokens_sql('text')} AS toks FROM conversations),
h AS (SELECT id, note_id, len(list_filter(toks, lambda x: x = 'the')) AS tf, len(toks) AS dl FROM t WHERE list_contains(toks, 'the')),
s AS (SELECT id, note_id, ln(1 + ((SELECT count(*) FROM t) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(len(toks)) FROM t))) AS score
  FROM h, (SELECT count(*) AS df FROM h)),
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS pos FROM s ORDER BY pos LIMIT 500)"""


def _turn_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = fulltext.search(_turn_index(spark, d), "the", 500, "text")
    return fulltext.ranked(hits, F.desc(F.round("score", 9)), "id").withColumnRenamed("rank", "position")


@query(_TURNS + """, f AS (SELECT note_id, min(pos) AS position, count(*) AS n FROM r GROUP BY note_id),
k AS (SELECT note_id, string_agg(id::VARCHAR, ',' ORDER BY pos) AS top_chunks FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY pos) AS nth FROM r) WHERE nth <= 3 GROUP BY note_id)
SELECT r.id, f.note_id, f.position, k.top_chunks FROM f JOIN k ON k.note_id = f.note_id JOIN r ON r.pos = f.position""")
def fold_by_note(spark: SparkSession, d: str) -> DataFrame:
    folded = fusion.fold(_turn_hits(spark, d).select("id", "note_id", "position"))
    return folded.select("id", "note_id", "position", F.array_join(F.col("top_chunks").cast("array<string>"), ",").alias("top_chunks"))


@query(_TURNS + ", top AS (SELECT note_id FROM r GROUP BY note_id ORDER BY min(pos) LIMIT 10) SELECT note_id, count(*) AS chunks FROM h WHERE note_id IN (SELECT note_id FROM top) GROUP BY note_id")
def note_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    folded = fusion.fold(_turn_hits(spark, d).select("id", "note_id", "position")).orderBy("position").limit(10)
    return fulltext.note_counts(_turn_index(spark, d), "the", folded)


@query(_TURNS + """, c AS (SELECT r.id, pos, greatest(0, floor((48 * len(text) - 23 * len(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + 99) / 100))::BIGINT AS tokens
  FROM r JOIN conversations v ON 5500000000000 + v.conv_id * 10000 + v.turn = r.id),
u AS (SELECT *, sum(least(tokens, 64)) OVER (ORDER BY pos) + 1 AS upto, row_number() OVER (ORDER BY pos) AS nth FROM c)
SELECT id, pos AS position, tokens FROM u WHERE upto <= 1000 AND nth <= 50""")
def rerank_budget_cut(spark: SparkSession, d: str) -> DataFrame:
    texts = Store(spark, d).turns.select("id", T.count_tokens("content").alias("tokens"))
    rows = _turn_hits(spark, d).select("id", "position").join(texts, "id")
    return fusion.rerank_cut(rows, T.count_query_tokens("the"), total=1000, documents=50, per_document=64).select("id", "position", "tokens")


def _memory_index(spark: SparkSession, d: str) -> TextIndex:
    rows = Store(spark, d).memories
    return TextIndex.build(rows.select("id", "namespace", "scope", F.lit("memory").alias("kind"), "tags", F.lit(None).cast("long").alias("note_id"), F.col("judgment").alias("text"), F.lit("").alias("name"), F.lit("").alias("path")))


_MEMORIES = f"""WITH m AS (SELECT item_id::BIGINT AS id, text AS judgment FROM benchmark UNION ALL SELECT DISTINCT user_id + 1000000000, 'user ' || user_id FROM events),
t AS (SELECT id, judgment, {tokens_sql('judgment')} AS toks FROM m),
h AS (SELECT id, judgment, term, len(list_filter(toks, lambda x: x = term)) AS tf, len(toks) AS dl FROM t, (SELECT unnest(['the', 'of']) AS term)),
g AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY term),
s AS (SELECT id, judgment, count(*) = 2 AS strict, sum(ln(1 + ((SELECT count(*) FROM t) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(len(toks)) FROM t)))) AS score
  FROM h JOIN g ON g.term = h.term WHERE tf > 0 GROUP BY id, judgment),
r AS (SELECT id, judgment, row_number() OVER (ORDER BY strict DESC, round(score, 9) DESC, id) AS rank FROM s ORDER BY rank LIMIT 64)"""


@query(_MEMORIES + ", u AS (SELECT *, sum(len(judgment)) OVER (ORDER BY rank) AS upto FROM r) SELECT id, rank FROM u WHERE upto <= 2000 OR rank = 1")
def preset_memory(spark: SparkSession, d: str) -> DataFrame:
    bodies = Store(spark, d).memories.select("id", F.col("judgment").alias("text"))
    return presets.memory_route(_memory_index(spark, d), bodies, "the of").select("id", "rank")


def _steps(sql: str) -> str:
    """The steps of a search after the notes."""
    return "toks AS" + sql.split(",\ntoks AS", 1)[1]


_TITLES, _CONTENTS = (search_sql(["doc_62", "license"], ["doc_62", "license"], n, field=f) for n, f in ((5, "name"), (64, "text")))


@query(f"""{with_parts("notes")},
titles AS (WITH {_steps(_TITLES)} SELECT id, row_number() OVER (ORDER BY strict DESC, round(score, 9) DESC, id) AS rank FROM hits),
found AS (WITH {_steps(_CONTENTS)} SELECT id, row_number() OVER (ORDER BY strict DESC, round(score, 9) DESC, id) AS rank FROM hits),
c AS (SELECT found.id, rank, sum(len(text)) OVER (ORDER BY rank) AS upto, row_number() OVER (ORDER BY rank) AS nth FROM found JOIN notes ON notes.id = found.id WHERE found.id NOT IN (SELECT id FROM titles))
SELECT id, 'title' AS part, rank FROM titles UNION ALL SELECT id, 'content', rank FROM c WHERE upto <= 3000 OR nth = 1""")
def preset_notes(spark: SparkSession, d: str) -> DataFrame:
    bodies = Store(spark, d).notes.select("id", F.col("content").alias("text"))
    return presets.notes_route(_index(spark, d), bodies, "doc_62 license")
