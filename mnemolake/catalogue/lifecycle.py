"""Queries over writes, feedback, decay, maintenance, importing and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.catalogue.registry import query, with_parts
from mnemolake.operators import lifecycle
from mnemolake.sources import importer
from mnemolake.sources.projection import Store
from mnemolake.streaming import feedback

_FOLD = """WITH f AS (SELECT user_id + 1000000000 AS memory_id, epoch_us(ts) AS at_us, event_id AS seq, event_type IN ('purchase', 'signup') AS useful FROM events WHERE event_type IN ('purchase', 'signup', 'click', 'view')),
u AS (SELECT *, sum(useful::INTEGER) OVER o AS uses FROM f WINDOW o AS (PARTITION BY memory_id ORDER BY at_us, seq)),
h AS (SELECT *, NOT useful AND uses IN (2, 3) AS hit FROM u),
w AS (SELECT *, 1 + sum(CASE WHEN useful THEN 1 WHEN hit THEN -1 ELSE 0 END) OVER (PARTITION BY memory_id ORDER BY at_us, seq) AS walk FROM h),
s AS (SELECT memory_id, (arg_max(walk, (at_us, seq)) - least(0, min(walk)))::BIGINT AS strength, sum(useful::INTEGER)::BIGINT AS useful_count, 2.5::DOUBLE * sum(useful::INTEGER) AS useful_score,
  max(CASE WHEN useful THEN at_us END) AS last_recalled_at_us, sum(useful::INTEGER)::BIGINT AS boosted, sum(hit::INTEGER)::BIGINT AS penalized, count(*) AS recalled FROM w GROUP BY memory_id)"""


def _state(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.feedback_fold(feedback.as_feedback(Store(spark, d).table("events")))


@query(_FOLD + " SELECT * FROM s")
def feedback_fold(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)


@query(_FOLD + " SELECT sum(recalled)::BIGINT AS recalled, sum(boosted)::BIGINT AS boosted, sum(penalized)::BIGINT AS penalized, count(*) AS memories FROM s")
def feedback_report(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).agg(F.sum("recalled").alias("recalled"), F.sum("boosted").alias("boosted"), F.sum("penalized").alias("penalized"), F.count(F.lit(1)).alias("memories"))


@query(_FOLD + """, m AS (SELECT memory_id AS id, strength, useful_score, last_recalled_at_us, (SELECT max(epoch_us(ts)) FROM events) + 864000000000 AS at_us, (SELECT min(epoch_us(ts)) FROM events) AS created, memory_id % 7 = 0 AS pinned FROM s),
d AS (SELECT *, greatest(created, coalesce(last_recalled_at_us, created)) AS since FROM m),
e AS (SELECT *, (at_us - since) // 259200000000 AS steps FROM d),
g AS (SELECT *, NOT pinned AND useful_score < 3 AND strength > 0 AND steps > 0 AS decayed FROM e),
z AS (SELECT id, CASE WHEN decayed THEN greatest(strength - steps, 0) ELSE strength END::BIGINT AS strength, decayed, CASE WHEN decayed THEN since + steps * 259200000000 END AS last_decay_at_us, pinned, useful_score FROM g)
SELECT id, strength, decayed, last_decay_at_us, NOT pinned AND strength = 0 AND useful_score < 10 AS candidate FROM z""")
def decay_report(spark: SparkSession, d: str) -> DataFrame:
    bounds = Store(spark, d).table("events").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    memories = _state(spark, d).select(
        F.col("memory_id").alias("id"), "strength", "useful_score", "last_recalled_at_us", F.lit(bounds[0]).alias("created_at_us"), F.lit(None).cast("long").alias("last_decay_at_us"), (F.col("memory_id") % 7 == 0).alias("pinned"),
    )
    return lifecycle.decay(memories, bounds[1] + 10 * 86_400_000_000).select("id", "strength", "decayed", "last_decay_at_us", "candidate")


@query("""WITH n AS (SELECT doc_id, lang AS namespace, 'public' AS scope, regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') AS k FROM documents),
c AS (SELECT namespace, scope, k, min(doc_id) AS known_id, count(*) AS known FROM n WHERE doc_id % 2 = 0 GROUP BY namespace, scope, k),
w AS (SELECT namespace, scope, k, min(doc_id) AS new_id, count(*) AS n FROM n WHERE doc_id % 2 = 1 GROUP BY namespace, scope, k)
SELECT w.namespace, w.scope, sha256(w.k) AS judgment_key, coalesce(known_id, new_id) AS id, n, CASE WHEN known > 1 THEN 'conflict' WHEN known = 1 THEN 'update' ELSE 'insert' END AS action
FROM w LEFT JOIN c ON c.namespace = w.namespace AND c.scope = w.scope AND c.k = w.k""")
def upsert_by_judgment(spark: SparkSession, d: str) -> DataFrame:
    rows = Store(spark, d).table("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("namespace"), F.lit("public").alias("scope"), F.col("text").alias("judgment"))
    # The stored half and the incoming half of one table.
    found = lifecycle.upsert_by_judgment(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))
    return found.withColumn("judgment_key", F.sha2("judgment_key", 256))


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN upper(c_name) ELSE c_name END AS name FROM customer")
def put_records_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = Store(spark, d).table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey")
    return lifecycle.put_records(rows.drop("c_nationkey"), rows.where("c_nationkey = 3").select("id", F.upper("name").alias("name")))


@query("SELECT 'note' AS kind, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id % 5 = 0 UNION ALL SELECT 'chunk', count(*) FROM conversations WHERE conv_id % 5 = 0")
def batch_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    chunks = Store(spark, d).turns
    notes = chunks.select(F.col("note_id").alias("id")).distinct()
    return lifecycle.delete_notes(notes, chunks, notes.where("id % 5 = 0"))[2]


@query(with_parts("ents", "rels", "parts") + """, r AS (SELECT id, count(*) AS n FROM (SELECT src AS id, id AS ref FROM rels UNION SELECT dst, id FROM rels) GROUP BY id), e AS (SELECT entity_id AS id, count(*) AS n FROM parts GROUP BY entity_id)
SELECT ents.id, coalesce(r.n, 0) AS relations, coalesce(e.n, 0) AS events FROM ents LEFT JOIN r ON r.id = ents.id LEFT JOIN e ON e.id = ents.id WHERE r.n > 0 OR e.n > 0""")
def delete_blocked_by_reference(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    return lifecycle.blocked_by_reference(store.entities, store.relations, store.participants)


@query(with_parts("rels", "parts") + """, i AS (SELECT 1003000000000 + s_suppkey AS id FROM supplier WHERE s_nationkey = 4)
SELECT DISTINCT id, 'relation' AS kind FROM rels WHERE src IN (SELECT id FROM i) OR dst IN (SELECT id FROM i) UNION ALL SELECT DISTINCT event_id, 'event' FROM parts WHERE entity_id IN (SELECT id FROM i)""")
def rename_propagation(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    renamed = store.table("supplier").where("s_nationkey = 4").select((F.col("s_suppkey") + 1003 * 10**9).alias("id"))
    return lifecycle.dependents(renamed, store.relations, store.participants)


@query(with_parts("ents", "rels", "parts") + """ SELECT 'relation.src' AS "check", count(*) AS broken FROM rels WHERE src NOT IN (SELECT id FROM ents) UNION ALL SELECT 'relation.dst', count(*) FROM rels WHERE dst NOT IN (SELECT id FROM ents)
UNION ALL SELECT 'participant.entity', count(*) FROM parts WHERE entity_id NOT IN (SELECT id FROM ents) UNION ALL SELECT 'chunk.note', count(*) FROM conversations WHERE conv_id % 5 = 0""")
def fk_audit(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    notes = store.turns.where("(note_id - 4500000000000) % 5 <> 0").select(F.col("note_id").alias("id")).distinct()
    return lifecycle.audit(store.relations, store.participants, store.entities, store.turns, notes)


@query("SELECT doc_id AS id, 'add' AS action FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT l.doc_id, 'remove' FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents)")
def index_reconcile_diff(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    return lifecycle.difference(store.table("labels").select(F.col("doc_id").alias("id")), store.table("documents").select(F.col("doc_id").alias("id")))


@query("SELECT 'library' AS namespace, 'memory,graph' AS enabled UNION ALL SELECT 'quiet', '' UNION ALL SELECT 'all', 'memory,graph,notes'")
def enabled_kinds_by_namespace(spark: SparkSession, d: str) -> DataFrame:
    switches = spark.createDataFrame([("library", True, None, None, None), ("quiet", False, True, True, True), ("all", True, None, None, True)], "namespace string, master boolean, memory boolean, graph boolean, notes boolean")
    return importer.enabled_targets(switches)


@query("""SELECT event_id, epoch_us(ts) AS a, (epoch_us(ts) // 1000000) * 1000000 AS b, (epoch_us(ts) // 1000000) * 1000000 AS c FROM events""")
def timestamp_coercion(spark: SparkSession, d: str) -> DataFrame:
    """RFC 3339 text, zoneless text and epoch seconds as text, all to microseconds."""
    ts = F.col("ts").cast("timestamp")
    rows = Store(spark, d).table("events").select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("x"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("y"), F.unix_seconds(ts).cast("string").alias("z"))
    return rows.select("event_id", importer.to_micros("x").alias("a"), importer.to_micros("y").alias("b"), importer.to_micros("z").alias("c"))


@query("""SELECT item_id::BIGINT AS id, 'ns/' || CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS namespace, 'public' AS scope, CASE item_id % 3 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'skill' ELSE 'knowledge' END AS memory_type, sha256(text) AS digest FROM benchmark""")
def import_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = Store(spark, d).table("benchmark").select(
        F.col("item_id").cast("long").alias("id"), F.lit("ns").alias("base"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("domain"), F.lit(None).cast("string").alias("scope"),
        F.when(F.col("item_id") % 3 == 1, "技能").when(F.col("item_id") % 3 == 2, "").otherwise("知识").alias("memory_type"), F.col("text").alias("judgment"),
    )
    return importer.map_memories(rows).select("id", "namespace", "scope", "memory_type", F.sha2("judgment", 256).alias("digest"))


@query("SELECT l_orderkey, l_linenumber, s_suppkey AS id, s_suppkey IS NULL AS unresolved FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey <> 4")
def import_unresolved(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    known = store.table("supplier").where("s_nationkey <> 4").select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").alias("id"))
    return importer.resolve_keys(store.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("key")), known).drop("key")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_rates(spark: SparkSession, d: str) -> DataFrame:
    return feedback.rates(Store(spark, d).table("events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def sync_embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Fills vector gaps of notes with a deterministic model: id, dimension, norm."""
    from mnemolake.operators.embedding import byte_model, fill_gaps

    notes = Store(spark, d).notes.select("id", F.col("content").alias("text"))
    filled = fill_gaps(notes, byte_model(16), batch=32, max_tokens=256)
    return filled.select("id", F.size("vector").alias("dimension"), F.lit(True).alias("filled"))
