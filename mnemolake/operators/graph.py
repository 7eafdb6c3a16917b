"""Graph operators over an edge table: augmentation, contraction, neighbourhoods, paths and components.

Iterative operators write each round to the shared folder (or cache it in a small local session) and stop on counts;
nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.operators.materialize import settle

SAME_AS = "sys:same_as"


def augmented(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges with those that ``rules`` (predicate, inverse, symmetric) add: a symmetric predicate also runs backwards, an
    inverse one adds the dual edge. The rules are a small dimension table; ``sys:same_as`` is symmetric by nature."""
    forward = edges.select("id", "src", "predicate", "dst")
    joined = forward.join(rules, "predicate")
    back = joined.where("symmetric").select("id", F.col("dst").alias("src"), "predicate", F.col("src").alias("dst"))
    dual = joined.where(F.col("inverse").isNotNull()).select("id", F.col("dst").alias("src"), F.col("inverse").alias("predicate"), F.col("src").alias("dst"))
    twins = forward.where(F.col("predicate") == SAME_AS).select("id", F.col("dst").alias("src"), "predicate", F.col("src").alias("dst"))
    return forward.unionByName(back).unionByName(dual).unionByName(twins)


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the smallest id of each weakly connected component.

    Smallest labels travel along edges and, by pointer jumping, along labels, so rounds are logarithmic in the diameter.
    """
    both = settle(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    labels = settle(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(labels, both["src"] == labels["id"]).groupBy("dst").agg(F.min("label").alias("low"))
        step = labels.join(near, labels["id"] == near["dst"], "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("low", "label")).alias("label"))
        jump = step.select(F.col("id").alias("of"), F.col("label").alias("beyond"))
        following = step.join(jump, F.col("label") == F.col("of"), "left").select("id", "was", F.least("label", F.coalesce("beyond", "label")).alias("label"))
        following = settle(following)
        if following.where("was <> label").isEmpty():
            return following.select("id", "label")
        labels = following.select("id", "label")


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical ids (id, canonical), edges between canonical ids without aliases).

    Aliases are connected by ``sys:same_as``; the smallest id stands for all. Parallel edges stay.
    """
    same = edges.where(F.col("predicate") == SAME_AS)
    members = same.select(F.col("src").alias("id")).union(same.select("dst")).distinct()
    canonical = component_labels(members, same).withColumnRenamed("label", "canonical")
    rest = edges.where(F.col("predicate") != SAME_AS)
    src = canonical.select(F.col("id").alias("src"), F.col("canonical").alias("new_src"))
    dst = canonical.select(F.col("id").alias("dst"), F.col("canonical").alias("new_dst"))
    mapped = rest.join(src, "src", "left").join(dst, "dst", "left")
    return canonical, mapped.select("id", F.coalesce("new_src", "src").alias("src"), "predicate", F.coalesce("new_dst", "dst").alias("dst"))


def ego(edges: DataFrame, root: int, depth: int, limit: int | None = None) -> DataFrame:
    """id, hop of the nodes within ``depth`` out-edges of ``root``, without it; by hop, then id."""
    out = edges.select("src", "dst")
    spark = edges.sparkSession
    seen = spark.range(1).select(F.lit(root).cast("long").alias("id"), F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = out.join(frontier, out["src"] == frontier["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = settle(reached.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    found = seen.where("hop > 0").orderBy("hop", "id")
    return found if limit is None else found.limit(limit)


def shortest_path(edges: DataFrame, start: int, end: int) -> DataFrame:
    """position, id along a path with fewest edges, smallest parents first; no rows if there is none."""
    spark, out = edges.sparkSession, edges.select("src", "dst")
    if start == end:
        return spark.createDataFrame([(0, start)], "position long, id long")
    seen = spark.range(1).select(F.lit(start).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("hop"))
    frontier, found, hop = seen, False, 0
    while not found:
        hop += 1
        step = out.join(frontier.select("id"), out["src"] == F.col("id")).groupBy("dst").agg(F.min("src").alias("parent"))
        step = step.select(F.col("dst").alias("id"), "parent", F.lit(hop).alias("hop")).join(seen.select("id"), "id", "left_anti")
        frontier = settle(step)
        if frontier.isEmpty():
            break
        # One table now and then in place of a union of every hop.
        seen = seen.unionByName(frontier) if hop % 16 else settle(seen.unionByName(frontier))
        found = not frontier.where(F.col("id") == end).isEmpty()
    if not found:
        return spark.createDataFrame([], "position long, id long")
    path, at = [end], end
    while at != start:  # one lookup per edge of the path
        at = seen.where(F.col("id") == at).select("parent").first()[0]
        path.append(at)
    return spark.createDataFrame(list(enumerate(reversed(path))), "position long, id long")


def component_count(nodes: DataFrame, edges: DataFrame) -> int:
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return component_labels(nodes.select("id").union(ends).distinct(), edges).select("label").distinct().count()


def strongly_connected(edges: DataFrame) -> DataFrame:
    """id, component (smallest member) of the strongly connected components with more than one node.

    Nodes without in- or out-edges are trimmed; then the smallest label that reaches a node going forward and the
    smallest going backward are spread: where both name the same node, the component is found and taken out.
    """
    left = settle(edges.select("src", "dst").where("src <> dst").distinct())
    done = None
    while True:
        while True:  # trim
            before = left.count()
            left = settle(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if (after := left.count()) == before or not after:
                break
        if not after:
            return done if done is not None else edges.sparkSession.createDataFrame([], "id long, component long")
        nodes = left.select(F.col("src").alias("id")).distinct()
        colour = settle(_spread(nodes, left))
        owners = nodes.join(colour, "id").where("id = label").select("id")
        inside = left.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").where("a = b").select("src", "dst")
        back = _reach(owners, settle(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        members = settle(back.join(colour, "id").select("id", "label"))
        found = members.join(members.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "label").select("id", F.col("label").alias("component"))
        done = settle(found if done is None else done.union(found))
        gone = members.select("id")
        left = settle(left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"))


def _spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the smallest id from which each node is reached."""
    labels = settle(nodes.select("id", F.col("id").alias("label")))
    while True:
        low = edges.join(labels, edges["src"] == labels["id"]).groupBy("dst").agg(F.min("label").alias("low"))
        following = settle(labels.join(low, labels["id"] == low["dst"], "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("low", "label")).alias("label")))
        labels = following.select("id", "label")
        if following.where("was <> label").isEmpty():
            return labels


def _reach(roots: DataFrame, edges: DataFrame) -> DataFrame:
    seen = frontier = settle(roots)
    while not frontier.isEmpty():
        following = edges.join(frontier.toDF("src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = settle(following.join(seen, "id", "left_anti"))
        seen = seen.union(frontier)
    return seen


def incident(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Relations with either end among ``members`` (id): two equi-joins, never an OR."""
    ids = members.select("id")
    out = relations.join(ids.toDF("src"), "src", "left_semi").select(*relations.columns)
    into = relations.join(ids.toDF("dst"), "dst", "left_semi").select(*relations.columns)
    return out.union(into).dropDuplicates(["id"])


def between(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Relations with both ends among ``members``."""
    ids = members.select("id")
    return relations.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select(*relations.columns)


def events_between(events: DataFrame, participants: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """Events in which at least ``least`` of ``members`` take part."""
    held = participants.join(members.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    often = held.groupBy("event_id").agg(F.countDistinct("entity_id").alias("n")).where(F.col("n") >= least)
    return events.join(often.select(F.col("event_id").alias("id")), "id", "left_semi")


def events_of(events: DataFrame, participants: DataFrame, entity: int, limit: int) -> DataFrame:
    mine = participants.where(F.col("entity_id") == entity).select(F.col("event_id").alias("id")).distinct()
    return events.join(mine, "id", "left_semi").orderBy("id").limit(limit)


def resolve(entities: DataFrame, alias: str, limit: int) -> DataFrame:
    """Entities that carry the name, by id."""
    from mnemolake.functions.text import normalize_query, normalized_tag

    wanted = " ".join(normalize_query(alias).split())
    return entities.where(F.exists("aliases", lambda a: normalized_tag(a) == wanted)).orderBy("id").limit(limit)


def neighbors(relations: DataFrame, entities: DataFrame, root: int, limit: int) -> DataFrame:
    """relation_id, entity_id, predicate, outgoing: one hop both ways, by relation id."""
    out = relations.where(F.col("src") == root).select(F.col("id").alias("relation_id"), F.col("dst").alias("entity_id"), "predicate", F.lit(True).alias("outgoing"))
    into = relations.where((F.col("dst") == root) & (F.col("src") != root)).select(F.col("id").alias("relation_id"), F.col("src").alias("entity_id"), "predicate", F.lit(False).alias("outgoing"))
    return out.union(into).join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").orderBy("relation_id").limit(limit)


def mounted(tags: DataFrame, entities: DataFrame, relations: DataFrame, limit: int) -> DataFrame:
    """Neighbourhoods of records through their tags: record_id, root, relation_id, other.

    ``tags`` (record_id, tag) meet the entities of which the tag is an alias; each root gives its ``limit`` relations of
    smallest id.
    """
    from mnemolake.functions.text import normalized_tag

    aliases = entities.select(F.col("id").alias("root"), F.explode("aliases").alias("alias")).select("root", normalized_tag("alias").alias("tag")).distinct()
    roots = tags.select("record_id", normalized_tag("tag").alias("tag")).join(aliases, "tag").select("record_id", "root").distinct()
    wanted = roots.select(F.col("root").alias("id")).distinct()
    out = relations.join(wanted.toDF("src"), "src").select(F.col("src").alias("root"), F.col("id").alias("relation_id"), F.col("dst").alias("other"))
    into = relations.join(wanted.toDF("dst"), "dst").where("src <> dst").select(F.col("dst").alias("root"), F.col("id").alias("relation_id"), F.col("src").alias("other"))
    nth = F.row_number().over(Window.partitionBy("root").orderBy("relation_id"))
    near = out.union(into).withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")
    return roots.join(near, "root").select("record_id", "root", "relation_id", "other")


def expand_query(query: str, groups: dict[str, str], most: int = 64) -> str:
    """The query with the synonyms of every predicate it names; ``groups`` maps a predicate to its group."""
    from mnemolake.functions.text import normalize_query

    text = normalize_query(query)
    hit = {groups[p] for p in groups if normalize_query(p) and normalize_query(p) in text}
    more = sorted({p for p, g in groups.items() if g in hit} | hit)[:most]
    return " ".join([query, *[p for p in more if normalize_query(p) not in text]])
