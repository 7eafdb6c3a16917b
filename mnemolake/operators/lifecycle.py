"""Memory feedback and decay, and record writes, as transformations of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.memory import LifecyclePolicy, decay_steps, tier
from mnemolake.functions.text import normalized_tag


#: Bytes read, by the plan's own estimate, for which a partition of ids is made.
PART_BYTES = 4 << 20


def feedback_fold(feedback: DataFrame, policy: LifecyclePolicy = LifecyclePolicy(), pinned: Column | None = None, group: str = "memory_id") -> DataFrame:
    """memory_id, strength, useful_count, useful_score, last_recalled_at_us, boosted, penalized after a stream of feedback.

    ``feedback``: memory_id, at_us, seq, useful. Memories start at strength 1 and score 0. Whether a recall that did not
    help costs strength depends on the score so far, and strength stops at 0: running sums give the first, and the walk
    minus its running minimum below zero gives the second, so one window sorted by time does the whole fold.
    """
    order = Window.partitionBy(group).orderBy("at_us", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = feedback.withColumn("uses", F.sum(F.when(F.col("useful"), 1).otherwise(0)).over(so_far))
    middle = tier(F.col("uses") * policy.useful_gain, policy) == 1
    hit = ~F.col("useful") & middle & ~(F.lit(False) if pinned is None else pinned)
    rows = rows.withColumn("hit", hit).withColumn("delta", F.when(F.col("useful"), policy.strength_gain).when(F.col("hit"), -1).otherwise(0))
    rows = rows.withColumn("walk", F.lit(1) + F.sum("delta").over(so_far))
    whole = rows.groupBy(group).agg(
        F.max_by("walk", F.struct("at_us", "seq")).alias("end"), F.min("walk").alias("low"), F.count(F.when(F.col("useful"), 1)).alias("useful_count"),
        F.max(F.when(F.col("useful"), F.col("at_us"))).alias("last_recalled_at_us"), F.count(F.when(F.col("hit"), 1)).alias("penalized"), F.count(F.lit(1)).alias("recalled"),
    )
    strength = F.col("end") - F.least(F.lit(0), F.col("low"))
    return whole.select(group, strength.cast("long").alias("strength"), "useful_count", (F.col("useful_count") * policy.useful_gain).alias("useful_score"), "last_recalled_at_us", F.col("useful_count").alias("boosted"), "penalized", "recalled")


def feedback_once(memories: DataFrame, recalled: list[int], useful: list[int], at_us: int, policy: LifecyclePolicy = LifecyclePolicy()) -> DataFrame:
    """Memories after one request; useful ids must be among the recalled ones."""
    if not set(useful) <= set(recalled):
        raise ValueError("useful ids must be among the recalled ids")
    helped = F.col("id").isin(useful) if useful else F.lit(False)
    told = F.col("id").isin(recalled) if recalled else F.lit(False)
    hit = told & ~helped & ~F.col("pinned") & (tier(F.col("useful_score"), policy) == 1)
    return memories.withColumns({
        "strength": F.when(helped, F.col("strength") + policy.strength_gain).when(hit, F.greatest(F.col("strength") - 1, F.lit(0))).otherwise(F.col("strength")),
        "useful_count": F.col("useful_count") + helped.cast("long"),
        "useful_score": F.col("useful_score") + F.when(helped, policy.useful_gain).otherwise(0.0),
        "last_recalled_at_us": F.when(helped, F.lit(at_us)).otherwise(F.col("last_recalled_at_us")),
    })


def decay(memories: DataFrame, at_us: int, policy: LifecyclePolicy = LifecyclePolicy()) -> DataFrame:
    """Memories after a decay pass, with ``decayed`` and ``candidate`` (for retirement; nothing is deleted)."""
    since = F.greatest("created_at_us", "last_recalled_at_us", "last_decay_at_us")
    steps = decay_steps(F.lit(at_us), since, policy)
    weak = ~F.col("pinned") & (tier(F.col("useful_score"), policy) == 0) & (F.col("strength") > 0) & (steps > 0)
    rows = memories.withColumns({"decayed": weak, "__steps": steps, "__since": since})
    rows = rows.withColumns({
        "strength": F.when(F.col("decayed"), F.greatest(F.col("strength") - F.col("__steps"), F.lit(0))).otherwise(F.col("strength")),
        "last_decay_at_us": F.when(F.col("decayed"), F.col("__since") + F.col("__steps") * policy.cycle_us).otherwise(F.col("last_decay_at_us")),
    })
    candidate = ~F.col("pinned") & (F.col("strength") == 0) & (tier(F.col("useful_score"), policy) < 2)
    return rows.withColumn("candidate", candidate).drop("__steps", "__since")


def put_records(current: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """``current`` with the rows of ``incoming`` in place of those with the same key."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert_by_judgment(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (namespace, scope, normalised judgment): namespace, scope, judgment_key, id, n, action.

    A judgment that several stored memories share is a conflict; one updates; none inserts with the smallest new id.
    """
    key = normalized_tag("judgment").alias("judgment_key")
    known = current.select("namespace", "scope", key, F.col("id").alias("known_id")).groupBy("namespace", "scope", "judgment_key").agg(F.min("known_id").alias("known_id"), F.count(F.lit(1)).alias("known"))
    new = incoming.select("namespace", "scope", key, "id").groupBy("namespace", "scope", "judgment_key").agg(F.min("id").alias("new_id"), F.count(F.lit(1)).alias("n"))
    joined = new.join(known, ["namespace", "scope", "judgment_key"], "left")
    action = F.when(F.col("known") > 1, "conflict").when(F.col("known") == 1, "update").otherwise("insert")
    return joined.select("namespace", "scope", "judgment_key", F.coalesce("known_id", "new_id").alias("id"), "n", action.alias("action"))


def blocked_by_reference(entities: DataFrame, relations: DataFrame, participants: DataFrame) -> DataFrame:
    """id, relations, events of the entities that cannot be deleted because something refers to them."""
    of = lambda df, end, ref, kind: df.select(F.col(end).alias("id"), F.col(ref).alias("ref"), F.lit(kind).alias("kind"))
    refs = of(relations, "src", "id", 0).union(of(relations, "dst", "id", 0)).union(of(participants, "entity_id", "event_id", 1))
    # Hardly any repeat: moved before they are compared, they fill no table on the way, and parts are as many as the input asks for.
    refs = refs.repartition(_parts(refs), "id", "ref").dropDuplicates(["id", "ref", "kind"])
    counts = refs.groupBy("id").agg(F.count_if(F.col("kind") == 0).alias("relations"), F.count_if(F.col("kind") == 1).alias("events"))
    return counts.join(entities.select("id"), "id", "left_semi")


def _parts(df: DataFrame) -> int:
    """Partitions for narrow rows: one for ``PART_BYTES`` of what is read, for rows without a known size the session's number.
    Adaptive plans go by packed bytes and put many millions of such rows together."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-size // PART_BYTES)) if size < 1 << 50 else usual


def delete_notes(notes: DataFrame, chunks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(notes left, chunks left, removed: one row with what went, chunks of removed notes counted too)."""
    gone = notes.join(doomed.select("id"), "id", "left_semi").select("id")
    chunks_gone = chunks.join(gone.toDF("note_id"), "note_id", "left_semi")
    removed = gone.select(F.lit("note").alias("kind")).union(chunks_gone.select(F.lit("chunk"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return notes.join(gone, "id", "left_anti"), chunks.join(gone.toDF("note_id"), "note_id", "left_anti"), removed


def dependents(entity_ids: DataFrame, relations: DataFrame, participants: DataFrame) -> DataFrame:
    """id, kind of the relations and events whose text names one of the entities (and follows a rename)."""
    ids = entity_ids.select("id")
    src = relations.join(ids.toDF("src"), "src", "left_semi").select("id")
    dst = relations.join(ids.toDF("dst"), "dst", "left_semi").select("id")
    events = participants.join(ids.toDF("entity_id"), "entity_id", "left_semi").select(F.col("event_id").alias("id"))
    return src.union(dst).distinct().withColumn("kind", F.lit("relation")).union(events.distinct().withColumn("kind", F.lit("event")))


def audit(relations: DataFrame, participants: DataFrame, entities: DataFrame, chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """check, broken: rows that refer to nothing, by reference."""
    ids = entities.select("id")
    checks = {
        "relation.src": relations.join(ids.toDF("src"), "src", "left_anti"),
        "relation.dst": relations.join(ids.toDF("dst"), "dst", "left_anti"),
        "participant.entity": participants.join(ids.toDF("entity_id"), "entity_id", "left_anti"),
        "chunk.note": chunks.join(notes.select(F.col("id").alias("note_id")), "note_id", "left_anti"),
    }
    rows = None
    for name, broken in checks.items():
        one = broken.agg(F.count(F.lit(1)).alias("broken")).select(F.lit(name).alias("check"), "broken")
        rows = one if rows is None else rows.union(one)
    return rows


def difference(index: DataFrame, store: DataFrame) -> DataFrame:
    """id, action: what an index must add and remove to agree with the store."""
    extra = index.select("id").join(store.select("id"), "id", "left_anti").withColumn("action", F.lit("remove"))
    missing = store.select("id").join(index.select("id"), "id", "left_anti").withColumn("action", F.lit("add"))
    return missing.union(extra)
