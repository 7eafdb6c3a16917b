"""Queries over text functions, notes and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.catalogue.registry import clean_sql, query, tokens_sql, trim_sql, with_parts
from mnemolake.functions import text as T
from mnemolake.operators import fusion
from mnemolake.sources.chunking import caller_chunks, chunk_notes
from mnemolake.sources.projection import Store, spread


@query(f"""SELECT doc_id, sha256(lower({trim_sql('text')})) AS normal, len(lower({trim_sql('text')})) AS n FROM documents""")
def normalize_text_documents(spark: SparkSession, d: str) -> DataFrame:
    normal = T.normalize_text("text")
    return Store(spark, d).table("documents").select("doc_id", T.digest(normal).alias("normal"), F.length(normal).cast("long").alias("n"))


@query("SELECT p_partkey, lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) AS tag, list_sort(list_distinct([lower(p_brand), lower(p_type)]))[1] AS first_tag FROM part")
def normalized_tags(spark: SparkSession, d: str) -> DataFrame:
    return Store(spark, d).table("part").select("p_partkey", T.normalized_tag("p_name").alias("tag"), F.element_at(T.tag_set(F.array("p_brand", "p_type")), 1).alias("first_tag"))


@query(f"""SELECT conv_id, turn, len({tokens_sql('text')}) AS n_words, len(list_distinct({tokens_sql('text')})) AS n_distinct, list_sort({tokens_sql('text')})[1] AS first_word,
  CAST(floor((48 * len(text) - 23 * len(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + 99) / 100) AS BIGINT) AS n_tokens FROM conversations""")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    words = T.tokenize("text")
    return Store(spark, d).table("conversations").select(
        "conv_id", "turn", F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"), F.array_min(words).alias("first_word"), T.count_tokens("text").alias("n_tokens"),
    )


@query("""WITH c AS (SELECT conv_id, turn, text, unnest(range(1, least(len(text), 80) + 1)) AS i FROM conversations),
u AS (SELECT conv_id, turn, text, i, sum(CASE WHEN ord(text[i]) < 128 THEN 25 ELSE 48 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS used FROM c),
k AS (SELECT conv_id, turn, max(CASE WHEN used <= 2000 THEN i ELSE 0 END) AS n FROM u GROUP BY conv_id, turn)
SELECT v.conv_id, v.turn, substr(text, 1, coalesce(n, 0)::INTEGER) AS head FROM conversations v LEFT JOIN k ON k.conv_id = v.conv_id AND k.turn = v.turn""")
def token_budget_truncate(spark: SparkSession, d: str) -> DataFrame:
    return Store(spark, d).table("conversations").select("conv_id", "turn", T.truncate_to_tokens("text", 20).alias("head"))


@query(f"""SELECT 'page' AS kind, page_id AS id, sha256({clean_sql('html')}) AS cleaned, len({clean_sql('html')}) AS n FROM pages
UNION ALL SELECT 'document', doc_id, sha256({clean_sql('text')}), len({clean_sql('text')}) FROM documents""")
def clean_markdown_pages(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)

    def cleaned(name: str, kind: str, key: str, text: str) -> DataFrame:
        rows = spread(store.table(name)).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), T.clean_markdown(text).alias("t"))
        return rows.select("kind", "id", T.digest("t").alias("cleaned"), F.length("t").cast("long").alias("n"))

    return cleaned("pages", "page", "page_id", "html").union(cleaned("documents", "document", "doc_id", "text"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def digest_documents(spark: SparkSession, d: str) -> DataFrame:
    return Store(spark, d).table("documents").select("doc_id", T.digest("text").alias("digest"))


@query("SELECT doc_id, 'doc_' || doc_id AS stem, lang || '/' || source AS dirs, lang || '/' || source || '/doc_' || doc_id || '.md' AS relative FROM documents")
def note_path_parts(spark: SparkSession, d: str) -> DataFrame:
    notes = Store(spark, d).notes.select("doc_id", F.concat(F.lit("C:\\kb\\"), "path").alias("full"), "path")
    return notes.select("doc_id", T.note_stem("path").alias("stem"), F.array_join(T.note_dirs("path"), "/").alias("dirs"), T.relative_note_path("C:/kb", "full").alias("relative"))


@query(with_parts("ents") + """
SELECT entity_type, name, id, array_to_string(list_sort(list_distinct(aliases)), ' ') || '  ' || attrs AS body FROM ents""")
def record_texts_entities(spark: SparkSession, d: str) -> DataFrame:
    return Store(spark, d).entities.select("entity_type", "name", "id", T.entity_body(F.col("aliases"), F.col("summary"), F.col("attributes")).alias("body"))


@query(with_parts("ents", "rels") + """
SELECT rels.id, s.name || ' ' || predicate || ' ' || o.name || ' ' AS body FROM rels JOIN ents s ON s.id = src JOIN ents o ON o.id = dst""")
def record_texts_relations(spark: SparkSession, d: str) -> DataFrame:
    return relation_texts(Store(spark, d)).withColumnRenamed("text", "body")


def relation_texts(store: Store) -> DataFrame:
    """id, text: names of both ends around the predicate, derived at read time, so renames need no rewrite."""
    names = store.entities.select("id", "name")
    rows = store.relations.join(names.toDF("src", "subject"), "src").join(names.toDF("dst", "object"), "dst")
    return rows.select("id", F.concat_ws(" ", "subject", "predicate", "object", "reason").alias("text"))


@query(with_parts("ents", "parts") + """
SELECT 3000000000000 + o_orderkey AS id, len('order ' || o_orderkey || ' ' || o_orderpriority || ' ' || string_agg(name, ' ' ORDER BY entity_id) || ' ') AS n
FROM orders JOIN parts ON event_id = 3000000000000 + o_orderkey JOIN ents ON ents.id = entity_id GROUP BY o_orderkey, o_orderpriority""")
def record_text_lengths_events(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    names = store.participants.join(store.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    listed = names.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "name"))).alias("p"))
    joined = store.events.join(listed, store.events["id"] == listed["event_id"])
    text = F.concat_ws(" ", "name", "summary", F.array_join(F.transform("p", lambda x: x["name"]), " "), "reason")
    return joined.select("id", F.length(text).cast("long").alias("n"))


@query(with_parts("notes") + " SELECT id, array_to_string(list_filter(tags, lambda t: t <> lang AND t <> source AND t <> title), ' ') AS prefix FROM notes")
def tags_prefix_first_chunk(spark: SparkSession, d: str) -> DataFrame:
    own = F.array_union(T.note_dirs("path"), F.array(F.col("title")))
    return Store(spark, d).notes.select("id", F.array_join(F.array_except("tags", own), " ").alias("prefix"))


# Chunks of a text: headings part blocks; the windows of a long block follow from its length alone where no mark of its
# second half stops them. DuckDB has no scan with state over windows, so the recursion below walks block by block.
_CHUNK_SQL = """
WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE len(text) > 0)),
b AS (SELECT *, sum(CASE WHEN line_no = 1 OR starts_with(ltrim(line), '#') OR regexp_matches(line, '^\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM l),
k AS (SELECT doc_id, block, string_agg(line, chr(10) ORDER BY line_no) AS body, min(line_no) AS first_line FROM b GROUP BY doc_id, block),
k2 AS (SELECT * FROM k WHERE NOT regexp_matches(body, '^\\s*$')),
w AS (
  SELECT doc_id, block, first_line, body, 0 AS pos, @stop0 AS stop FROM k2
  UNION ALL SELECT doc_id, block, first_line, body, nxt, @stop1 FROM (SELECT *, greatest(stop - @overlap, pos + 1) AS nxt FROM w WHERE stop < len(body)))
SELECT 4000000000000 + doc_id AS note_id, row_number() OVER (PARTITION BY doc_id ORDER BY block, pos) - 1 AS ordinal,
  first_line + len(substr(body, 1, pos)) - len(replace(substr(body, 1, pos), chr(10), '')) AS "offset", sha256(substr(body, pos + 1, stop - pos)) AS content FROM w
"""


def _chunk_sql(target: int, overlap: int) -> str:
    def stop(at: str) -> str:
        # The last strong break of the window's second half, else the last weak one, else the full width.
        half = f"substr(body, {at} + {target // 2} + 1, {target - target // 2})"
        last = lambda marks: f"len(regexp_extract({half}, '(?s)^(.*[{marks}])', 1))"
        strong, weak = last("\\n。！？；!?;…"), last("，、：,: ")
        base = f"{at} + {target // 2}"
        return f"CASE WHEN {at} + {target} >= len(body) THEN len(body) WHEN {strong} > 0 THEN {base} + {strong} WHEN {weak} > 0 THEN {base} + {weak} ELSE {at} + {target} END"

    return _CHUNK_SQL.replace("@stop0", stop("0")).replace("@stop1", stop("nxt")).replace("@overlap", str(overlap))


def _chunks(spark: SparkSession, d: str, target: int, overlap: int) -> DataFrame:
    rows = chunk_notes(Store(spark, d).notes, target, overlap, "id", "content")
    return rows.select("note_id", "ordinal", "offset", T.digest("content").alias("content"))


@query(_chunk_sql(220, 0))
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, 220, 0)


@query(_chunk_sql(400, 60))
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, 400, 60)


@query("SELECT 4500000000000 + conv_id AS note_id, turn AS ordinal, 1::BIGINT AS \"offset\", greatest(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))), 1) AS \"limit\", sha256(text) AS content FROM conversations")
def chunk_conversations(spark: SparkSession, d: str) -> DataFrame:
    turn = F.struct("ordinal", F.struct(F.col("content"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("limit"), F.col("role").alias("metadata")).alias("c"))
    notes = Store(spark, d).turns.groupBy("note_id").agg(F.array_sort(F.collect_list(turn), lambda a, b: (a["ordinal"] - b["ordinal"]).cast("int")).alias("t"))
    rows = caller_chunks(notes.select("note_id", F.transform("t", lambda x: x["c"]).alias("chunks")))
    return rows.select("note_id", "ordinal", "offset", "limit", T.digest("content").alias("content"))


@query("""WITH r AS (SELECT conv_id, turn, text, sum(len(text)) OVER (PARTITION BY 1 ORDER BY conv_id, turn) AS upto, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations)
SELECT conv_id, turn, len(text) AS n FROM r WHERE upto <= 5000 OR rn = 1""")
def char_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.within_budget_of_many(Store(spark, d).table("conversations"), F.length("text"), 5000, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query("""SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') AS kind FROM events""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    v = F.parse_json("props")
    rows = Store(spark, d).table("events").select("event_id", "event_type", F.variant_get(v, "$.k", "bigint").alias("k"))
    return rows.withColumn("kind", F.when(F.col("k").isNotNull(), F.when(F.col("k") >= 0, "UBIGINT").otherwise("BIGINT")))
