"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Each document gets a 48-bit hash of its id. Words are summed by source and top 12 hash bits; the bucket in which a
source's budget runs out is found from cumulative sums, and only that bucket is refined by the next 12 bits, four times
in all. What remains is one threshold per source, and taking documents is a filter: no sort of documents anywhere. Rows
that share the hash at which a budget runs out (repeated or null ids) are told apart by a hash of their texts in the same
way; of rows that are equal in both, so many are taken as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import WORD_PATTERN, cut, discard, document_key

LEVELS, BITS = 4, 12
#: A source may be repeated this many times at most.
MOST = 3
SALTS = 16
#: Tables of so many sources are broadcast, some 100 bytes each; longer ones are joined by source and salt.
BROADCAST_SOURCES = 100_000


def _hash(value: Column) -> Column:
    """48 bits of md5 over a value as text: the same on every engine and every rerun."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` (distinct) with ``nth``, its place by code point, null last: a distributed sort, and sums per part."""
    order = (F.col("source").isNull(), F.col("source"))
    sorted_ = cut(sources.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # A row per part: at most as many as the session's shuffle partitions.
    ends = sorted_.groupBy(part.alias("of")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return sorted_.join(F.broadcast(ends), part == F.col("of")).withColumn("nth", F.col("before") + place).drop("of", "before", "at")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, weigh ``weights`` in turn. Targets share the sum of all sizes by weight, stop at
    ``most`` times the source's size, and the excess is shared again by weight until none is above: each round sums what
    the sources that have not stopped have left to share, and three numbers reach the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    caps = cut(_numbered(sizes).select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap")), "mix-caps")
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731 - a product of sums outgrows a long
    left = weighing = None
    while True:
        # A source that stops at a level stops at all later, higher ones too.
        stops = F.lit(False) if left is None else wide("cap") * F.lit(weighing).cast("decimal(19,0)") <= wide("weight") * F.lit(left).cast("decimal(19,0)")
        size, full, w = caps.agg(F.sum("source_size"), F.sum(F.when(stops, F.col("cap"))), F.sum(F.when(~stops, F.col("weight")))).first()
        now = ((size or 0) - (full or 0), w or 0)
        if now == (left, weighing) or not w:
            break
        left, weighing = now
    if not w:  # every source stops
        shared = F.lit(0.0)
    else:
        shared = (F.col("weight") * F.lit(left)).cast("double") / F.lit(weighing).cast("double")
    return caps.select("source", "source_size", F.when(stops, F.col("cap").cast("double")).otherwise(shared).alias("target"))


def _by_source(rows: DataFrame, per_source: DataFrame, n_sources: int, how: str = "inner") -> DataFrame:
    """``rows`` (with salt) and ``per_source``'s columns; a source with a third of all rows spreads over the salts."""
    if n_sources <= BROADCAST_SOURCES:
        other = F.broadcast(per_source.withColumnRenamed("source", "of"))
        return rows.join(other, F.col("source").eqNullSafe(F.col("of")), how).drop("of")
    other = per_source.withColumn("its_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "of")
    return rows.join(other, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("its_salt")), how).drop("of", "its_salt")


def _boundary(state: DataFrame, histogram: DataFrame, shift: int) -> DataFrame:
    """(source, below, left) one level down: ``histogram`` (source, bucket, words) is of the bucket at ``below`` alone.

    The boundary is the first bucket that no longer fits; without one, all of the range fits, and nothing is refined.
    """
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    upto = histogram.withColumn("upto", running).withColumnRenamed("source", "of")
    joined = state.where(F.col("open")).join(upto, F.col("source").eqNullSafe(F.col("of")), "left")
    over = F.col("upto") > F.col("left")
    found = joined.groupBy("source", "below", "left").agg(F.min(F.when(over, F.col("bucket"))).alias("boundary"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("used"))
    end = F.shiftright("below", shift + BITS) + 1
    closed = F.col("boundary").isNull()
    found = found.select(
        "source", F.when(closed, F.shiftleft(end, shift + BITS)).otherwise(F.shiftleft("boundary", shift)).alias("below"),
        F.when(closed, F.lit(0)).otherwise(F.col("left") - F.col("used")).cast("long").alias("left"), (~closed).alias("open"),
    )
    return found.unionByName(state.where(~F.col("open")))


def _refined(rows: DataFrame, state: DataFrame, name: str, levels: range, n_sources: int) -> DataFrame:
    """The state (source, below, left, open) after the named hash's levels, each a histogram of the boundary bucket."""
    for level in levels:
        shift = BITS * (LEVELS - 1 - level)
        inside = rows
        if level:
            inside = _by_source(rows, state.where("open").select("source", F.shiftright("below", shift + BITS).alias("parent")), n_sources).where(F.shiftright(name, shift + BITS) == F.col("parent"))
        state = _boundary(state, inside.groupBy("source", F.shiftright(name, shift).alias("bucket")).agg(F.sum("size").alias("words")), shift)
    return state


def _whole_range(budgets: DataFrame) -> DataFrame:
    return budgets.select("source", F.lit(0).cast("long").alias("below"), F.col("budget").alias("left"), F.lit(True).alias("open"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_copies: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken; source, copies and key on request.

    A null text has size 0, a null source is a source of its own (last in order). A source whose target is k times its
    size and a rest takes every document floor(k) times, and once more those under the threshold for the rest, so taken
    words stay below the target by less than one document. Rows that share an id, and null ids, are told apart by their
    texts, and of rows equal in both so many are taken as fit. Empty tables give empty results; reruns agree, but for
    which of equal rows are taken.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col)
    sized = docs.select(
        doc_id.cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"),
        _hash(doc_id).alias("hash"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row"), document_key(id_col, text_col).alias("key"),
    )
    # The hash of the text is mixed with the id's, and of 48 bits like it.
    second = F.shiftrightunsigned(F.xxhash64("hash", "text_hash"), 16)
    sized = cut(sized.withColumn("second", second).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")), "mix-sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole)
    goal = cut(goal.withColumn("budget", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")), "mix-goals")
    n_sources = goal.count()

    state = cut(_refined(sized, _whole_range(goal), "hash", range(1), n_sources), "mix-level")
    # The boundary bucket of each source, about a row in 4096, and what further levels are about.
    at = F.shiftright("hash", BITS * (LEVELS - 1))
    edge = cut(_by_source(sized, state.where("open").select("source", F.shiftright("below", BITS * (LEVELS - 1)).alias("edge")), n_sources).where(at == F.col("edge")).drop("edge"), "mix-edge")
    state = cut(_refined(edge, state, "hash", range(1, LEVELS), n_sources), "mix-level")
    limits = state.select("source", "below", F.lit(0).cast("long").alias("second_below"))
    # Rows at the very threshold: as a rule one per source, and it does not fit.
    ties = _by_source(edge, state.where("open").select("source", "below", "left"), n_sources).where("hash = below")
    shared = cut(ties.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("budget")).where("n > 1 AND budget > 0"), "mix-ties")
    chosen = None
    if not shared.isEmpty():
        ties = cut(_by_source(ties.drop("below", "left"), shared.select("source"), n_sources), "mix-tied")
        again = cut(_refined(ties, _whole_range(shared), "second", range(LEVELS), n_sources), "mix-level")
        more = again.select(F.col("source").alias("of"), F.col("below").alias("more"))
        limits = limits.join(more, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "below", F.coalesce("more", "second_below").alias("second_below"))
        chosen = _chosen(ties, again, n_sources)
    limits = cut(limits.withColumnRenamed("source", "of").join(goal, F.col("of").eqNullSafe(F.col("source"))).select("source", "source_size", "target", "whole", "below", "second_below"), "mix-limits")
    discard(edge)
    rows = _by_source(sized, limits, n_sources)
    once = (F.col("hash") < F.col("below")) | ((F.col("hash") == F.col("below")) & (F.col("second") < F.col("second_below")))
    if chosen is not None:
        rows = rows.join(chosen, "row", "left")
        once |= F.col("chosen").isNotNull()
    copies = F.col("whole") + F.when(once & (F.col("whole") < most), 1).otherwise(0)
    columns = ["source", copies.cast("int").alias("copies"), "key"] if with_copies else []
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), *columns)


def _chosen(ties: DataFrame, state: DataFrame, n_sources: int) -> DataFrame:
    """(row, chosen) of equal rows that fit what is left: numbered within their task, and tasks by the counts before."""
    equal = _by_source(ties, state.where("open AND left > 0").select("source", "below", "left"), n_sources).where("second = below AND size > 0 AND size <= left")
    equal = equal.withColumn("task", F.shiftright("row", 33))
    counts = equal.groupBy("source", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("of"), F.col("task").alias("its_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("source", "task").orderBy("row"))
    placed = equal.withColumn("nth", nth).join(counts, F.col("source").eqNullSafe(F.col("of")) & (F.col("task") == F.col("its_task")))
    fits = (F.col("before") + F.col("nth")) * F.col("size") <= F.col("left")
    return cut(placed.where(fits).select("row", F.lit(True).alias("chosen")), "mix-chosen")


#: DuckDB's version: a prefix of each source in hash order.
ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS hash
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM src),
lv AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS remaining, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS ws
  FROM w WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT remaining, ws FROM lv WHERE cap * ws > weight * remaining ORDER BY ws DESC LIMIT 1),
goal AS (SELECT lv.source, lv.source_size,
    CASE WHEN cap * lv.ws <= weight * lv.remaining THEN cap::DOUBLE ELSE (weight * f.remaining)::DOUBLE / f.ws::DOUBLE END AS target
  FROM lv LEFT JOIN free f ON true),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM goal),
d AS (SELECT s.doc_id, s.size, g.source_size, g.target, g.whole, floor(g.target - g.whole * g.source_size)::BIGINT AS budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN upto <= budget AND whole < 3 THEN 1 ELSE 0 END))::BIGINT AS taken FROM d
"""
