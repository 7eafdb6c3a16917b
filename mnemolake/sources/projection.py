"""The knowledge store's tables as projections of a commerce star schema, a document corpus and an event log.

Every table is a lazy DataFrame with a fixed set of columns; ids follow kind * 10^12 + base + key.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions import text as T

KINDS = ("memory", "entity", "relation", "event", "note", "chunk")
KIND = 10**12
ENTITY_BASE = {t: KIND + i * 10**9 for i, t in enumerate(("region", "nation", "customer", "supplier", "part"))}
DEPICTS = 2 * KIND + 8 * 10**11
SAME_AS = "sys:same_as"


def entity_id(kind: str, key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("long") + ENTITY_BASE[kind]


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a table's few files would keep most of them idle; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Store:
    """Lazy tables over one data folder: entities, relations, events, notes, chunks, memories, vectors and records."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def entities(self) -> DataFrame:
        """id, namespace, scope, tags, name, entity_type, aliases, attributes, summary."""

        def rows(kind: str, key: str, name: str, attributes: dict[str, str], more_alias: str | None = None) -> DataFrame:
            alias = F.concat(F.lit(kind + " "), F.col(key).cast("string"))
            aliases = F.array(name, alias, *([more_alias] if more_alias else []))
            entries = [x for k, c in attributes.items() for x in (F.lit(k), F.array(F.col(c).cast("string")))]
            attrs = F.create_map(*entries) if entries else F.create_map().cast("map<string,array<string>>")
            return self.table(kind).select(
                entity_id(kind, key).alias("id"), F.lit("commerce").alias("namespace"), F.lit("public").alias("scope"), F.array(F.lit(kind)).alias("tags"),
                F.col(name).alias("name"), F.lit(kind).alias("entity_type"), F.array_sort(F.array_distinct(aliases)).alias("aliases"), attrs.alias("attributes"), F.lit("").alias("summary"),
            )

        return _union([
            rows("region", "r_regionkey", "r_name", {}), rows("nation", "n_nationkey", "n_name", {}),
            rows("customer", "c_custkey", "c_name", {"mktsegment": "c_mktsegment"}), rows("supplier", "s_suppkey", "s_name", {}),
            rows("part", "p_partkey", "p_name", {"brand": "p_brand", "type": "p_type"}, "p_brand"),
        ])

    @cached_property
    def relations(self) -> DataFrame:
        """id, namespace, scope, src, predicate, dst, confidence, reason."""

        def rows(df: DataFrame, rid: Column, src: Column, predicate: str, dst: Column, confidence: Column | None = None) -> DataFrame:
            return df.select(
                rid.cast("long").alias("id"), F.lit("commerce").alias("namespace"), F.lit("public").alias("scope"), src.alias("src"), F.lit(predicate).alias("predicate"),
                dst.alias("dst"), (F.lit(0.8) if confidence is None else confidence).alias("confidence"), F.lit("").alias("reason"),
            )

        base = 2 * KIND
        pairs = self.table("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.least(F.lit(1.0), F.avg("l_discount") * 10).alias("confidence"))
        part = self.table("part").select("p_partkey", "p_name", "p_brand")
        first = part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("first"))
        twins = part.join(first, ["p_name", "p_brand"]).where("p_partkey <> first")
        return _union([
            rows(self.table("nation"), F.col("n_nationkey") + base, entity_id("nation", "n_nationkey"), "located_in", entity_id("region", "n_regionkey")),
            rows(self.table("customer"), F.col("c_custkey") + base + 10**9, entity_id("customer", "c_custkey"), "based_in", entity_id("nation", "c_nationkey")),
            rows(self.table("supplier"), F.col("s_suppkey") + base + 2 * 10**9, entity_id("supplier", "s_suppkey"), "based_in", entity_id("nation", "s_nationkey")),
            rows(pairs, F.col("l_suppkey") * 10**6 + F.col("l_partkey") + base + 3 * 10**9, entity_id("supplier", "l_suppkey"), "supplies", entity_id("part", "l_partkey"), F.col("confidence")),
            rows(twins, F.col("p_partkey") + DEPICTS, entity_id("part", "p_partkey"), SAME_AS, entity_id("part", "first")),
        ])

    @cached_property
    def participants(self) -> DataFrame:
        """event_id, entity_id, distinct."""
        orders, lines = self.table("orders"), self.table("lineitem")
        buyers = orders.select((F.col("o_orderkey") + 3 * KIND).alias("event_id"), entity_id("customer", "o_custkey").alias("entity_id"))
        sellers = lines.select((F.col("l_orderkey") + 3 * KIND).alias("event_id"), entity_id("supplier", "l_suppkey").alias("entity_id"))
        return buyers.union(sellers.distinct())

    @cached_property
    def events(self) -> DataFrame:
        """id, namespace, scope, name, summary, reason, created_at_us."""
        return self.table("orders").select(
            (F.col("o_orderkey") + 3 * KIND).alias("id"), F.lit("commerce").alias("namespace"), F.lit("public").alias("scope"),
            F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("summary"), F.lit("").alias("reason"),
            F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at_us"),
        )

    @cached_property
    def notes(self) -> DataFrame:
        """id, namespace, scope, path, title, tags, content."""
        path = F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")))
        labels = self.table("labels").select("doc_id", "quality", "toxic")
        rows = spread(self.table("documents")).join(labels, "doc_id", "left")
        marks = F.array(
            F.when(F.col("quality").isNotNull(), F.concat(F.lit("quality:"), F.col("quality").cast("string"))),
            F.when(F.col("toxic").isNotNull(), F.concat(F.lit("toxic:"), F.col("toxic").cast("string"))),
        )
        return rows.select(
            (F.col("doc_id") + 4 * KIND).alias("id"), F.lit("library").alias("namespace"), F.when(F.col("lang") == "en", "public").otherwise("foreign").alias("scope"),
            path.alias("path"), T.note_stem(path).alias("title"), T.tag_set(F.concat(F.array("lang", "source"), F.array_compact(marks))).alias("tags"), F.col("text").alias("content"), "doc_id",
        )

    @cached_property
    def turns(self) -> DataFrame:
        """Conversations as chunks that the caller made: note_id, id, ordinal, role, content."""
        note = F.col("conv_id") + 4 * KIND + 5 * 10**11
        return self.table("conversations").select(
            note.alias("note_id"), (F.col("conv_id") * 10**4 + F.col("turn") + 5 * KIND + 5 * 10**11).alias("id"), F.lit("dialogue").alias("namespace"), F.lit("public").alias("scope"),
            F.col("turn").alias("ordinal"), "role", F.col("text").alias("content"),
        )

    @cached_property
    def memories(self) -> DataFrame:
        """id, namespace, scope, tags, memory_type, judgment."""
        facts = self.table("benchmark").select(F.col("item_id").cast("long").alias("id"), F.lit("knowledge").alias("memory_type"), F.col("text").alias("judgment"), F.lit("benchmark").alias("tag"))
        users = self.table("events").select("user_id").distinct().select((F.col("user_id") + 10**9).alias("id"), F.lit("skill").alias("memory_type"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("judgment"), F.lit("user").alias("tag"))
        both = facts.union(users)
        return both.select("id", F.lit("memory").alias("namespace"), F.lit("public").alias("scope"), F.array("tag").alias("tags"), "memory_type", "judgment")

    @cached_property
    def vectors(self) -> DataFrame:
        """id, namespace, scope, kind, tags, vector."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.lit("memory").alias("namespace"), F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("scope"), F.lit("memory").alias("kind"),
            F.array(F.concat(F.lit("label:"), F.col("label").cast("string"))).alias("tags"), F.col("embedding").alias("vector"),
        )

    @cached_property
    def records(self) -> DataFrame:
        """id, namespace, scope, kind: the common header of all kinds but chunks of files."""

        def head(df: DataFrame, kind: str) -> DataFrame:
            return df.select("id", "namespace", "scope", F.lit(kind).alias("kind"))

        return _union([head(self.memories, "memory"), head(self.entities, "entity"), head(self.relations, "relation"), head(self.events, "event"), head(self.notes, "note"), head(self.turns, "chunk")])

    @cached_property
    def text_documents(self) -> DataFrame:
        """id, namespace, scope, kind, tags, note_id, text, name, path: what a full-text index takes in, notes as one chunk."""
        return self.notes.select(
            "id", "namespace", "scope", F.lit("chunk").alias("kind"), "tags", F.col("id").alias("note_id"), T.clean_markdown("content").alias("text"), F.col("title").alias("name"),
            F.array_join(T.note_dirs("path"), " ").alias("path"),
        )
