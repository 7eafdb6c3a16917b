"""Preset retrieval: independent routes over memories, graph and notes, each with its own budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as T
from mnemolake.operators import fulltext, fusion, graph
from mnemolake.operators.materialize import settle


@dataclass(frozen=True)
class Budget:
    memory_chars: int = 2000
    note_chars: int = 3000
    seeds: int = 4
    relation_chars: int = 1000
    context_chars: int = 2000
    titles: int = 5
    candidates: int = 64


ROUTES = {"memory": ("memory",), "notes": ("notes",), "graph": ("graph",), "rag": ("memory", "notes"), "broad": ("memory", "graph", "notes")}


def memory_route(index: fulltext.TextIndex, bodies: DataFrame, query: str, budget: Budget = Budget()) -> DataFrame:
    """id, text of the best memories within the character budget; the first always."""
    hits = fulltext.ranked(fulltext.search(index, query, budget.candidates), F.desc("strict"), F.desc(F.round("score", 9)), "id")
    rows = hits.select("id", "rank").join(bodies.select("id", "text"), "id")
    return fusion.within_budget(rows, F.length("text"), budget.memory_chars, ["rank"])


def notes_route(index: fulltext.TextIndex, bodies: DataFrame, query: str, budget: Budget = Budget()) -> DataFrame:
    """id, part (title, content or path), rank.

    Titles that match; then contents, without those, within the budget; and where titles are too few, notes by path.
    """
    order = (F.desc("strict"), F.desc(F.round("score", 9)), "id")
    index = fulltext.counted(index, [query], fulltext.FIELDS)
    titles = settle(fulltext.ranked(fulltext.search(index, query, budget.titles, "name"), *order).select("id", "rank"))  # a handful
    found = fulltext.ranked(fulltext.search(index, query, budget.candidates, "text"), *order).select("id", "rank")
    fresh = found.join(titles.select("id"), "id", "left_anti").join(bodies.select("id", "text"), "id")
    # Settled, the texts are read once, and the budget leaves few.
    contents = settle(fusion.within_budget(fresh, F.length("text"), budget.note_chars, ["rank"]).select("id", "rank"))
    paths = fulltext.ranked(fulltext.search(index, query, budget.candidates, "path"), *order).select("id", "rank")
    others = paths.join(titles.select("id").union(contents.select("id")), "id", "left_anti")
    missing = budget.titles - titles.count()  # at most a handful of rows
    filled = others.orderBy("rank").limit(max(missing, 0))
    tag = lambda df, part: df.select("id", F.lit(part).alias("part"), F.col("rank").cast("long").alias("rank"))
    return tag(titles, "title").union(tag(contents, "content")).union(tag(filled, "path"))


def graph_route(seeds: DataFrame, relations: DataFrame, texts: DataFrame, events: DataFrame, participants: DataFrame, query: str, names: list[str], budget: Budget = Budget(), synonyms: dict[str, str] | None = None) -> DataFrame:
    """id, part (seed, relation, context or event).

    ``seeds`` (id), ``names`` their names and aliases. What the query says besides them ranks the relations at the seeds by
    the tokens they share; without such words all stay, by id. Relations and events among the seeds and the ends of what
    was kept follow, within what is left of the context budget.
    """
    rest = T.remaining_query(query, names)
    wanted = T.query_terms(graph.expand_query(rest, synonyms) if synonyms else rest, True)
    near = graph.incident(relations, seeds).join(texts.select("id", "text"), "id")
    if wanted:
        near = near.withColumn("weight", T.token_weight(T.tokenize("text"), wanted)).where("weight > 0")
    else:
        near = near.withColumn("weight", F.lit(0))
    # Budgets leave a handful of rows; settled, later steps do not repeat what led to them.
    kept = settle(fusion.within_budget(near, F.length("text"), budget.relation_chars, [F.desc("weight"), "id"]))
    members = seeds.select("id").union(kept.select("src")).union(kept.select("dst")).distinct()
    context = graph.between(relations, members).join(kept.select("id"), "id", "left_anti").join(texts.select("id", "text"), "id")
    context = settle(fusion.within_budget(context, F.length("text"), budget.context_chars, ["id"]))
    used = context.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    body = F.concat_ws(" ", "name", "summary", "reason")
    met = graph.events_between(events, participants, members).withColumn("text", body)
    met = fusion.within_budget(met, F.length("text"), budget.context_chars - used, ["id"])
    tag = lambda df, part: df.select("id", F.lit(part).alias("part"))
    return tag(seeds, "seed").union(tag(kept, "relation")).union(tag(context, "context")).union(tag(met, "event"))
