"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared folder and
reads again as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm import exact_dedup, mixing, packing, simhash, toxicity
from mnemolake.llm.common import cut, document_key, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores 0.5 or more for toxicity go; null and empty texts, which match nothing, and repeated
    rows are judged like any other. Without labels every document stays; an empty table stays empty."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with a key of id and text under a name of its own, and the columns to give back."""
    return docs.withColumn(KEY, document_key()), [docs[c] for c in docs.columns]


def _keep(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key ``found`` (key, copies) gives copies, so often; a key's rows share its copies.

    Only keys of several rows need their texts moved by key: there, one row stands for all.
    """
    keyed, columns = _keyed(docs)
    names = [f"{KEY}_{i}" for i in range(len(columns))]
    keyed = keyed.toDF(*names, KEY)
    found = found.toDF(KEY, f"{KEY}_copies")
    several = cut(keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias(f"{KEY}_n")).where(F.col(f"{KEY}_n") > 1).select(KEY), "keys-of-several")
    if not several.isEmpty():
        keyed = keyed.join(several, KEY, "left_anti").select(*names, KEY).union(keyed.join(several, KEY, "left_semi").dropDuplicates([KEY]).select(*names, KEY))
    kept = keyed.join(found, KEY)
    kept = kept.withColumn(f"{KEY}_copy", F.explode(F.when(F.col(f"{KEY}_copies") > 0, F.sequence(F.lit(1), f"{KEY}_copies")).otherwise(F.array().cast("array<int>"))))
    return kept.select(*names).toDF(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the one with the smallest doc_id stays (null ids last); null counts as empty.

    Repeated rows are copies like any other. An empty table gives an empty result.
    """
    found = exact_dedup.exact_dedup(docs.select("doc_id", "text"), with_key=True).where("kept").select("key", F.lit(1).alias("copies"))
    return _keep(docs, found)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (a Jaccard similarity of 0.8 of their five-word shingles) the document with the
    smallest doc_id stays. Null texts count as empty, repeated rows as copies. An empty table gives an empty result."""
    found = simhash.near_by_shingles(docs.select("doc_id", "text"), shingle=5, threshold=0.8)
    return _keep(docs, found.where("kept").select("key", F.lit(1).alias("copies")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from not at all to three times; rows equal in id and text share their
    copies. Null texts have no words and go where their source is not taken whole; an empty table gives an empty one."""
    bare = docs.select("doc_id", "text", "source")
    taken = mixing.mix(bare, with_copies=True).groupBy("key").agg(F.sum("copies").cast("int").alias("copies"))
    return _keep(docs, taken)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of at most 4096 tokens."""
    return packing.pack(docs)


#: Prefix of the columns that stages add for themselves and take away again; input columns may have any other name.
KEY = "pipeline_key_of_document"

STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot learn terms, hash shingles or tokenise; ``tests/llm`` compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
