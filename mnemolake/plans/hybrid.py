"""Hybrid search: full text and vectors, fused by reciprocal ranks, folded by note, optionally reranked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as T
from mnemolake.operators import fulltext, fusion, vectorsearch
from mnemolake.operators.materialize import settle
from mnemolake.operators.reads import check_limit


@dataclass
class Diagnostics:
    """What was used, and why something was not."""

    text_used: bool = False
    vector_used: bool = False
    rerank_used: bool = False
    degraded: list[str] = field(default_factory=list)


@dataclass
class HybridSearch:
    """Searches one index and one vector table.

    The query is a scalar, so it is analysed on the driver; everything per row is one plan, and records are joined only
    after the limit. ``allow`` (ids) restricts the vector side alone, ``match_field`` the text side alone.
    """

    index: fulltext.TextIndex
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    rerank: Callable[[str, list[str]], list[float]] | None = None
    synonyms: dict[str, str] = field(default_factory=dict)

    def candidates(self, query: str, limit: int, where: Column | None = None, vector: list[float] | None = None, candidate_limit: int | None = None, match_field: str = "all", text: bool = True, text_weight: float = 1.0, allow: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None, Diagnostics]:
        window = min(candidate_limit or max(5 * check_limit(limit), 1000), 10_000)
        if window < limit:
            raise ValueError("candidate_limit must not be below limit")
        notes = Diagnostics()
        text_hits = vector_hits = None
        if text:
            from mnemolake.operators.graph import expand_query

            expanded = expand_query(query, self.synonyms) if self.synonyms else query
            hits = fulltext.search(self.index, expanded, window, match_field, where)
            # At most 10,000 rows, read several times below.
            text_hits = settle(fulltext.ranked(hits, F.desc("strict"), F.desc(F.round("score", 9)), "id"))
            notes.text_used = True
        if vector is None and self.embed is not None:
            try:
                vector = self.embed(query)
            except Exception as error:  # noqa: BLE001 - a host model may fail in any way; the text side still answers
                notes.degraded.append(f"embedding failed: {error}")
        if vector is not None and self.vectors is not None:
            hits = vectorsearch.top_k(self.vectors, vector, window, where, allow)
            vector_hits = settle(fulltext.ranked(hits, F.desc(F.round("score", 9)), "id"))
            notes.vector_used = True
        return text_hits, vector_hits, notes

    def search(self, query: str, limit: int = 10, where: Column | None = None, vector: list[float] | None = None, text_weight: float = 1.0, top_chunks: int = 3, documents: DataFrame | None = None, **how) -> tuple[DataFrame, Diagnostics]:
        """(id, note_id, score, top_chunks, position) of the best ``limit``, and diagnostics.

        With a reranker, candidates alternate between the two sides, fold by note, are cut by its budgets and reordered by
        its scores; ``documents`` (id, text) gives what it reads. If it fails, the alternating order stays.
        """
        text_hits, vector_hits, notes = self.candidates(query, limit, where, vector, text_weight=text_weight, **how)
        spark = self.index.tokens.sparkSession
        empty = spark.createDataFrame([], "id long, rank long")
        left = text_hits.select("id", "rank") if text_hits is not None else empty
        right = vector_hits.select("id", "rank") if vector_hits is not None else empty
        fused = fusion.rrf(left, right, text_weight)
        if self.rerank is None or documents is None:
            order = fulltext.ranked(fused, F.desc("score"), "id").withColumnRenamed("rank", "position")
        else:
            order = fusion.alternate(left, right).join(fused, "id")
        headers = self.index.tokens.select("id", "note_id")
        placed = order.select("id", "position", "score").join(headers, "id", "left")
        placed = settle(placed)
        folded = fusion.fold(placed.select("id", "note_id", "position"), top_chunks).join(placed.select("id", "score"), "id")
        if self.rerank is not None and documents is not None:
            folded = self._reranked(query, folded, documents, notes)
        return folded.orderBy("position").limit(limit), notes

    def _reranked(self, query: str, folded: DataFrame, documents: DataFrame, notes: Diagnostics) -> DataFrame:
        priced = folded.join(documents.select("id", F.col("text").alias("__text")), "id").withColumn("tokens", T.count_tokens("__text"))
        cut = fusion.rerank_cut(priced, T.count_query_tokens(query))
        rows = cut.orderBy("position").select("id", T.truncate_to_tokens("__text", 1024).alias("text")).collect()  # at most 50
        try:
            scores = self.rerank(query, [r["text"] for r in rows])
            if len(scores) != len(rows):
                raise ValueError("a score per document is needed")
        except Exception as error:  # noqa: BLE001
            notes.degraded.append(f"rerank failed: {error}")
            return folded
        notes.rerank_used = True
        spark = folded.sparkSession
        ranked = sorted(zip(rows, scores), key=lambda x: (-x[1], x[0]["id"]))
        places = spark.createDataFrame([(r["id"], i + 1, float(s)) for i, (r, s) in enumerate(ranked)], "id long, position long, score double")
        return folded.drop("position", "score").join(places, "id")
