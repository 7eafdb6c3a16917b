"""Importing foreign memory and graph tables: headers, types, times, keys and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Foreign memory types by their label.
MEMORY_TYPES = {"知识": "knowledge", "技能": "skill", "情感": "emotion", "事件": "event", "任务": "task"}


def to_micros(value: Column | str) -> Column:
    """Microseconds from RFC 3339 text, zoneless text (taken as UTC), or epoch seconds as number or text; else null."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    number = F.when(text.rlike(r"^\s*-?\d+(\.\d+)?\s*$"), F.round(text.cast("decimal(30,6)") * 1_000_000).cast("long"))
    return F.coalesce(number, F.unix_micros(F.try_to_timestamp(F.trim(text))))


def map_memories(rows: DataFrame) -> DataFrame:
    """id, namespace (base/domain), scope, memory_type, judgment; empty or unknown types are knowledge."""
    types = F.create_map(*[F.lit(x) for pair in MEMORY_TYPES.items() for x in pair])
    kind = F.coalesce(types[F.col("memory_type")], F.when(F.length("memory_type") > 0, F.col("memory_type")), F.lit("knowledge"))
    return rows.select("id", F.concat_ws("/", "base", F.when(F.col("domain") != "", F.col("domain"))).alias("namespace"), F.coalesce("scope", F.lit("public")).alias("scope"), kind.alias("memory_type"), "judgment")


def resolve_keys(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with the id their foreign ``key`` got; those without one are marked unresolved, not dropped."""
    return rows.join(known, "key", "left").withColumn("unresolved", F.col("id").isNull())


def unique_names(entities: DataFrame) -> DataFrame:
    """namespace, name, id of names that one entity alone has."""
    return entities.groupBy("namespace", "name").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def expand_extraction(rows: DataFrame, column: str = "extraction") -> tuple[DataFrame, DataFrame]:
    """(entities (name, type), relations (subject, predicate, object)) of JSON extractions; entities that only relations
    name are inferred as concepts."""
    schema = "entities array<struct<name:string,type:string>>, relations array<struct<subject:string,predicate:string,object:string>>"
    parsed = rows.select(F.from_json(column, schema).alias("x"))
    relations = parsed.select(F.inline("x.relations")).where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL").distinct()
    named = parsed.select(F.inline("x.entities")).where("name IS NOT NULL").groupBy("name").agg(F.min("type").alias("type"))
    ends = relations.select(F.col("subject").alias("name")).union(relations.select("object")).distinct()
    inferred = ends.join(named, "name", "left_anti").withColumn("type", F.lit("concept"))
    return named.withColumn("type", F.coalesce("type", F.lit("concept"))).unionByName(inferred), relations


def tag_map(tags: DataFrame, links: DataFrame) -> DataFrame:
    """record_id, tags from (tag_id, tag) and (record_id, tag_id)."""
    return links.join(tags, "tag_id").groupBy("record_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows in any order: their count and the sum of their hashes."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


def enabled_targets(switches: DataFrame) -> DataFrame:
    """namespace, enabled: which targets are vectorised; memory and graph unless switched off, notes if switched on."""
    on = lambda c, default: F.when(F.coalesce(c, F.lit(default)), F.lit(c))
    listed = F.array_join(F.array_compact(F.array(on("memory", True), on("graph", True), on("notes", False))), ",")
    return switches.select("namespace", F.when(F.col("master"), listed).otherwise("").alias("enabled"))


def missing_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that an import names and the directory lacks."""
    return wanted.select("path").distinct().join(files.select("path"), "path", "left_anti")
