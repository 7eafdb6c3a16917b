"""BM25 full-text search.

Over token arrays (``TextIndex``) a search makes tokens once, in a narrow scan that writes each document's lengths and the
counts of its few terms to the shared folder (``Counts``); statistics and scores are narrow scans of that. Over stored postings (``StoredIndex``) the terms' hash buckets prune the scan to a few files, and only matching postings meet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.functions import text as T
from mnemolake.operators.materialize import settle

K1, B = 1.2, 0.75
NAME_BOOST = 3.0
BUCKETS = 256
FIELDS = ("text", "name", "path")
HEADER = ("id", "namespace", "scope", "kind", "tags", "note_id")


@dataclass(frozen=True)
class TextIndex:
    """``tokens``: the header and an array of tokens per field."""

    tokens: DataFrame

    @classmethod
    def build(cls, documents: DataFrame) -> TextIndex:
        return cls(documents.select(*HEADER, *[T.tokenize(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS]))

    def counted(self, terms: list[str], fields: tuple[str, ...]) -> Counts:
        """dl_<field> and tf_<field>_<i> of every document, from one pass over the texts: searches that share it make no token
        again. Tokens that are no terms go first, and generators keep tokens from being made per term."""
        terms = list(dict.fromkeys(terms))
        held = [x for f in fields for x in (F.size(f).alias(f"dl_{f}"), F.filter(f, lambda t: t.isin(terms)).alias(f"held_{f}"))]
        times = lambda f, t: F.size(F.filter(f"held_{f}", lambda x: x == t))
        counts = [times(f, t).alias(f"tf_{f}_{i}") for f in fields for i, t in enumerate(terms)]
        rows = self.tokens.select(*HEADER, F.inline(F.array(F.struct(*held))))
        return Counts(settle(rows.select(*HEADER, *[f"dl_{f}" for f in fields], *counts)), terms)

    def postings(self) -> DataFrame:
        """bucket, term, field, id, tf, dl of the whole corpus, for storing."""
        fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("tokens")) for f in FIELDS])
        rows = self.tokens.select("id", F.inline(fields)).select("id", "field", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        return rows.groupBy("term", "field", "id", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf")).withColumn("bucket", _bucket("term"))

    def store(self, folder: str) -> StoredIndex:
        """Postings by bucket of the term, headers with lengths, and the statistics."""
        self.postings().repartition("bucket").sortWithinPartitions("bucket", "term", "field").write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/postings")
        self.tokens.select(*HEADER, *[F.size(f).alias(f"dl_{f}") for f in FIELDS]).write.mode("overwrite").parquet(f"{folder}/headers")
        return StoredIndex(self.tokens.sparkSession, folder)


@dataclass(frozen=True)
class Counts:
    """What searches for some terms read: ``rows`` has the header, dl_<field> and tf_<field>_<i> of every document."""

    rows: DataFrame
    terms: list[str]

    def counted(self, terms: list[str], fields: tuple[str, ...]) -> Counts:
        return self

    def _tf(self, field: str, term: str) -> str:
        return f"tf_{field}_{self.terms.index(term)}"

    def profile(self, terms: list[str], fields: tuple[str, ...]) -> Profile:
        """Statistics over all documents, whatever a search filters, and the terms' frequencies: one row."""
        sums = [F.avg(f"dl_{f}") for f in fields] + [F.count_if(F.col(self._tf(f, t)) > 0) for f in fields for t in terms]
        n, *rest = self.rows.agg(F.count(F.lit(1)), *sums).first()
        found = iter(rest[len(fields) :])
        return Profile(n, dict(zip(fields, rest)), {(f, t): next(found) for f in fields for t in terms})

    def frequencies(self, terms: list[str], fields: tuple[str, ...]) -> DataFrame:
        """The counts of the documents that hold any of the terms."""
        some = [F.col(self._tf(f, t)) > 0 for f in fields for t in terms]
        counts = [F.col(self._tf(f, t)).alias(f"tf_{f}_{i}") for f in fields for i, t in enumerate(terms)]
        return self.rows.where(reduce(lambda a, b: a | b, some)).select(*HEADER, *[f"dl_{f}" for f in fields], *counts)


class StoredIndex:
    """An index read from a folder that ``TextIndex.store`` wrote; searched like a ``TextIndex``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._postings, self.headers = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/headers")

    def _matching(self, terms: list[str], fields: tuple[str, ...]) -> DataFrame:
        spark = self.headers.sparkSession
        buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket("term")).distinct().collect()]
        return self._postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms) & F.col("field").isin(list(fields)))

    def counted(self, terms: list[str], fields: tuple[str, ...]) -> StoredIndex:
        return self

    def profile(self, terms: list[str], fields: tuple[str, ...]) -> Profile:
        n, *means = self.headers.agg(F.count(F.lit(1)), *[F.avg(f"dl_{f}") for f in fields]).first()
        df = {(r["field"], r["term"]): r["n"] for r in self._matching(terms, fields).groupBy("field", "term").agg(F.count(F.lit(1)).alias("n")).collect()}
        return Profile(n, dict(zip(fields, means)), {(f, t): df.get((f, t), 0) for f in fields for t in terms})

    def frequencies(self, terms: list[str], fields: tuple[str, ...]) -> DataFrame:
        tf = lambda f, t: F.coalesce(F.max(F.when((F.col("field") == f) & (F.col("term") == t), F.col("tf"))), F.lit(0))
        found = self._matching(terms, fields).groupBy("id").agg(*[tf(f, t).alias(f"tf_{f}_{i}") for f in fields for i, t in enumerate(terms)])
        return self.headers.join(found, "id").select(*HEADER, *[f"dl_{f}" for f in fields], *[f"tf_{f}_{i}" for f in fields for i in range(len(terms))])


@dataclass(frozen=True)
class Profile:
    """Documents, mean lengths by field, and documents that hold a term by (field, term)."""

    n: int
    mean: dict[str, float]
    df: dict[tuple[str, str], int]


def _bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def text_filter(namespace: str | None = None, scopes: list[str] | None = None, kinds: list[str] | None = None, tags: list[str] | None = None, note_ids: list[int] | None = None) -> Column:
    """Header conditions: namespace, any of the scopes and kinds, all of the tags, any of the notes (chunks only)."""
    keep = F.lit(True)
    if namespace is not None:
        keep &= F.col("namespace") == namespace
    if scopes is not None:
        keep &= F.col("scope").isin(scopes)
    if kinds is not None:
        keep &= F.col("kind").isin(kinds)
    for tag in tags or []:
        keep &= F.array_contains("tags", " ".join(T.normalize_query(tag).split()))
    if note_ids:
        keep &= (F.col("kind") == "chunk") & F.col("note_id").isin(note_ids)
    return keep


def bm25(tf: Column, dl: Column, df: int, n: int, mean: float) -> Column:
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))


def matches(index: TextIndex | Counts | StoredIndex, query: str, field: str = "all", where: Column | None = None, mode: str = "both") -> DataFrame:
    """id, note_id, strict, score of every document that matches, in no order.

    Documents that hold every strict term in text or name come first, scored by the strict terms; the rest need any loose
    term and are scored by those. Filters cannot make a document match. ``mode`` restricts to one pass.
    """
    strict, loose = T.query_terms(query, True), T.query_terms(query, False)
    fields = ("text", "name") if field == "all" else (field,)
    terms = list(dict.fromkeys([*strict, *loose]))
    if not terms:
        return index_session(index).createDataFrame([], "id long, note_id long, strict int, score double")
    index = index.counted(terms, fields)
    profile = index.profile(terms, fields)
    rows = index.frequencies(terms, fields)
    rows = rows if where is None else rows.where(where)
    tf = lambda f, t: F.col(f"tf_{f}_{terms.index(t)}")

    def score(of: list[str]) -> Column:
        parts = [F.lit(0.0)]
        for f in fields:
            boost = 1 + NAME_BOOST if field == "all" and f == "name" else 1.0
            parts += [bm25(tf(f, t), F.col(f"dl_{f}"), profile.df[f, t], profile.n, profile.mean[f] or 1.0) * boost for t in of if profile.df[f, t]]
        return reduce(lambda a, b: a + b, parts)

    has = lambda t: reduce(lambda a, b: a | b, [tf(f, t) > 0 for f in fields])
    everything = reduce(lambda a, b: a & b, [has(t) for t in strict], F.lit(bool(strict)))
    anything = reduce(lambda a, b: a | b, [has(t) for t in loose], F.lit(False))
    keep = {"strict": everything, "loose": anything, "both": everything | anything}[mode]
    first = F.lit(False) if mode == "loose" else everything
    return rows.where(keep).select("id", "note_id", first.cast("int").alias("strict"), F.when(first, score(strict)).otherwise(score(loose)).alias("score"))


def search(index: TextIndex | Counts | StoredIndex, query: str, limit: int, field: str = "all", where: Column | None = None, mode: str = "both") -> DataFrame:
    """The best ``limit`` of ``matches``: strict ones first, then by score, ties to smaller ids."""
    return matches(index, query, field, where, mode).orderBy(F.desc("strict"), F.desc(F.round("score", 9)), "id").limit(limit)


def index_session(index: TextIndex | Counts | StoredIndex) -> SparkSession:
    return {TextIndex: lambda: index.tokens, Counts: lambda: index.rows, StoredIndex: lambda: index.headers}[type(index)]().sparkSession


def counted(index: TextIndex, queries: list[str], fields: tuple[str, ...]) -> Counts:
    """The counts that searches for any of the queries in any of the fields need."""
    return index.counted([t for q in queries for t in T.query_terms(q, True) + T.query_terms(q, False)], fields)


def note_counts(index: TextIndex, query: str, notes: DataFrame, where: Column | None = None) -> DataFrame:
    """note_id, chunks: how many chunks of each given note hold any loose term of the unexpanded query."""
    terms = T.query_terms(query, False)
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    rows = index.tokens.where(F.arrays_overlap("text", wanted) | F.arrays_overlap("name", wanted))
    rows = rows if where is None else rows.where(where)
    return rows.join(notes.select("note_id"), "note_id", "left_semi").groupBy("note_id").agg(F.count(F.lit(1)).alias("chunks"))


def ranked(hits: DataFrame, *order: Column) -> DataFrame:
    """Adds rank from 1; for top-k results only, which are small."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
