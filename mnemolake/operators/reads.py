"""Point, batch and page reads, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 10_000


class NotFound(LookupError):
    """No visible record has the key."""


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must lie between 1 and {MOST}")
    return limit


def page(records: DataFrame, limit: int, after: int | None = None, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The next ``limit`` records by id behind the cursor; a keyset, so cost does not grow with the page's number."""
    rows = records if where is None else records.where(where)
    rows = rows if after is None else rows.where(F.col("id") > after)
    rows = rows.select(*columns) if columns else rows
    return rows.orderBy("id").limit(check_limit(limit))


def get(records: DataFrame, key: int, where: Column | None = None) -> DataFrame:
    """The record; one that the filter hides is not found."""
    rows = records.where(F.col("id") == key)
    rows = rows if where is None else rows.where(where)
    if rows.isEmpty():
        raise NotFound(key)
    return rows


def load_many(records: DataFrame, ids: DataFrame, where: Column | None = None) -> DataFrame:
    """Visible records among ``ids``; misses are skipped."""
    rows = records if where is None else records.where(where)
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def counts(records: DataFrame) -> DataFrame:
    """kind, n, and a row with kind ``total``."""
    return records.rollup("kind").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


def namespaces(records: DataFrame) -> DataFrame:
    """namespace, n, kinds (how many), with counts by kind as ``kind=n`` joined in order."""
    each = records.groupBy("namespace", "kind").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit("="), F.col("n").cast("string")))), ",")
    return each.groupBy("namespace").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), listed.alias("by_kind"))
