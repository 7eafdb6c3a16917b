"""Combining ranked lists: reciprocal ranks, alternation, folding by note, and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.operators.materialize import settle

RRF_K = 60


def rrf(text: DataFrame, vector: DataFrame, text_weight: float = 1.0) -> DataFrame:
    """id, score, text_rank, vector_rank from two lists (id, rank); best first, ties by id."""
    both = text.select("id", F.col("rank").alias("text_rank")).join(vector.select("id", F.col("rank").alias("vector_rank")), "id", "full_outer")
    part = lambda c, w: F.coalesce(F.lit(float(w)) / (RRF_K + F.col(c)), F.lit(0.0))
    return both.select("id", (part("text_rank", text_weight) + part("vector_rank", 1.0)).alias("score"), "text_rank", "vector_rank").orderBy(F.desc("score"), "id")


def alternate(text: DataFrame, vector: DataFrame) -> DataFrame:
    """id, position from 1: text 1, vector 1, text 2, vector 2 ...; a later repeat is dropped."""
    places = text.select("id", (2 * F.col("rank")).alias("at")).union(vector.select("id", (2 * F.col("rank") + 1).alias("at")))
    first = places.groupBy("id").agg(F.min("at").alias("at"))
    return first.select("id", F.row_number().over(Window.orderBy("at")).cast("long").alias("position"))


def fold(hits: DataFrame, most: int = 3) -> DataFrame:
    """The best hit of each note, with up to ``most`` of its hits as ``top_chunks``.

    ``hits``: id, note_id (null: stands alone), position. A note takes the place of its best hit.
    """
    group = F.coalesce(F.col("note_id"), -F.col("id") - 1)
    order = Window.partitionBy(group).orderBy("position")
    rows = hits.withColumn("nth", F.row_number().over(order))
    listed = F.array_sort(F.collect_list(F.when((F.col("nth") <= most) & F.col("note_id").isNotNull(), F.struct("position", "id"))))
    folded = rows.groupBy(group.alias("note_key")).agg(F.min(F.struct("position", "id", "note_id")).alias("best"), F.transform(listed, lambda x: x["id"]).alias("top_chunks"))
    return folded.select("best.id", "best.note_id", "best.position", "top_chunks")


def within_budget(items: DataFrame, length: Column | str, budget: int, order: list[Column | str], keep_first: bool = True) -> DataFrame:
    """Items in order up to the first that overflows ``budget``; the very first is always kept if ``keep_first``.

    Lengths are not negative, so a running sum decides. For ranked, already limited items.
    """
    if budget <= 0:
        return items.limit(0)
    window = Window.orderBy(*order)
    upto = F.sum(F.col(length) if isinstance(length, str) else length).over(window.rowsBetween(Window.unboundedPreceding, 0))
    rows = items.withColumn("__upto", upto).withColumn("__nth", F.row_number().over(window))
    fits = F.col("__upto") <= budget
    return rows.where(fits | (F.col("__nth") == 1) if keep_first else fits).drop("__upto", "__nth")


def within_budget_of_many(items: DataFrame, length: Column | str, budget: int, order: list[Column | str]) -> DataFrame:
    """As ``within_budget``, the very first item always kept, for items that no limit has made few.

    After a distributed sort, a sum per part tells which parts begin within the budget; only those are summed up row by row.
    """
    size = F.col(length) if isinstance(length, str) else length
    placed = settle(items.withColumn("__size", size).orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sums = placed.groupBy(part.alias("__part")).agg(F.sum("__size").alias("__sum"), F.min("__at").alias("__low"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    begun = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), F.min("__low").over(Window.partitionBy()).alias("__first")).where(F.col("__before") <= budget)
    rows = placed.withColumn("__part", part).join(F.broadcast(begun), "__part")
    upto = F.col("__before") + F.sum("__size").over(Window.partitionBy("__part").orderBy("__at"))
    rows = rows.withColumn("__upto", upto).where((F.col("__upto") <= budget) | (F.col("__at") == F.col("__first")))
    return rows.select(*items.columns)


def rerank_cut(candidates: DataFrame, query_tokens: int, total: int = 8192, documents: int = 50, per_document: int = 1024) -> DataFrame:
    """Candidates (position, tokens) that fit both limits: so many documents, and the query's and their tokens together."""
    window = Window.orderBy("position")
    used = F.least("tokens", F.lit(per_document))
    rows = candidates.withColumn("used", used)
    rows = rows.withColumn("upto", F.sum("used").over(window.rowsBetween(Window.unboundedPreceding, 0)) + query_tokens).withColumn("nth", F.row_number().over(window))
    return rows.where((F.col("upto") <= total) & (F.col("nth") <= documents)).drop("upto", "nth")
