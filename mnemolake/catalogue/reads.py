"""Queries over reads and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.catalogue.registry import query, with_parts
from mnemolake.operators import reads
from mnemolake.sources.projection import Store

_RECORDS = with_parts("ents", "rels") + """, recs AS (
  SELECT item_id::BIGINT AS id, 'memory' AS namespace, 'public' AS scope, 'memory' AS kind FROM benchmark
  UNION ALL SELECT DISTINCT user_id + 1000000000, 'memory', 'public', 'memory' FROM events
  UNION ALL SELECT id, 'commerce', 'public', 'entity' FROM ents
  UNION ALL SELECT id, 'commerce', 'public', 'relation' FROM rels
  UNION ALL SELECT 3000000000000 + o_orderkey, 'commerce', 'public', 'event' FROM orders
  UNION ALL SELECT 4000000000000 + doc_id, 'library', CASE WHEN lang = 'en' THEN 'public' ELSE 'foreign' END, 'note' FROM documents
  UNION ALL SELECT 5500000000000 + conv_id * 10000 + turn, 'dialogue', 'public', 'chunk' FROM conversations)"""


@query(_RECORDS + " SELECT kind, count(*) AS n FROM recs GROUP BY kind UNION ALL SELECT 'total', count(*) FROM recs")
def counts_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return reads.counts(Store(spark, d).records)


@query(_RECORDS + ", e AS (SELECT namespace, kind, count(*) AS n FROM recs GROUP BY namespace, kind) SELECT namespace, sum(n)::BIGINT AS n, count(*) AS kinds, string_agg(kind || '=' || n, ',' ORDER BY kind) AS by_kind FROM e GROUP BY namespace")
def namespace_summaries(spark: SparkSession, d: str) -> DataFrame:
    return reads.namespaces(Store(spark, d).records)


@query("SELECT 3000000000000 + o_orderkey AS id, 'order ' || o_orderkey AS name FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return reads.page(Store(spark, d).events, 100, after=3 * 10**12 + 500, columns=["id", "name"])


@query(_RECORDS + " SELECT id FROM recs WHERE kind = 'entity' AND scope = 'public' AND id > 1001000000005 ORDER BY id LIMIT 50")
def ids_page(spark: SparkSession, d: str) -> DataFrame:
    return reads.page(Store(spark, d).records, 50, after=1001 * 10**9 + 5, where=F.col("kind") == "entity", columns=["id"])


@query("SELECT 1002000000000 + c_custkey AS id, c_name AS name, 'customer ' || c_custkey AS alias FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def load_many(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    ids = store.table("orders").where("o_totalprice > 300000").select((F.col("o_custkey") + 1002 * 10**9).alias("id"))
    found = reads.load_many(store.entities, ids, F.col("namespace") == "commerce")
    return found.select("id", "name", F.element_at("aliases", -1).alias("alias"))


@query("SELECT 1000000000000 + r_regionkey AS id, r_name AS name, 'region' AS entity_type FROM region WHERE r_regionkey = 2")
def get_record(spark: SparkSession, d: str) -> DataFrame:
    return reads.get(Store(spark, d).entities, 10**12 + 2, F.col("scope") == "public").select("id", "name", "entity_type")


@query(with_parts("notes") + " SELECT scope, count(*) AS total FROM notes WHERE list_contains(tags, 'toxic:0') GROUP BY scope")
def total_with_filter(spark: SparkSession, d: str) -> DataFrame:
    from mnemolake.operators.fulltext import text_filter

    return Store(spark, d).notes.where(text_filter("library", ["public", "foreign"], tags=["Toxic:0"])).groupBy("scope").agg(F.count(F.lit(1)).alias("total"))


@query("SELECT DISTINCT namespace FROM (VALUES ('commerce'), ('dialogue'), ('library'), ('memory')) t(namespace)")
def namespaces_distinct(spark: SparkSession, d: str) -> DataFrame:
    return Store(spark, d).records.select("namespace").distinct()
