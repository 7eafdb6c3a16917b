"""Stages of the corpus pipeline against plain Python, and all of them together."""

import collections
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemolake.llm import queries, simhash
from tests.llm import data
from tests.llm.test_documents import WORD, _components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    more = [(1000 + i, f"some words badword{i % 2} more{i} of{i * 3}", "en", "s0") for i in range(30)] + [(2000 + i, f"some words fine more{i} of{i * 3}", "en", "s1") for i in range(60)]
    data.documents(spark, more).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 2000)) for i in [*range(1000, 1030), *range(2000, 2060)]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _rows(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and _rows(clean) == collections.Counter({k: n for k, n in _rows(docs).items() if k[0] is None or not 1000 <= k[0] < 2000})
    clean = clean.cache()

    exact = stages["exact dedup"](spark, clean, folder)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    got, groups = _rows(exact), collections.defaultdict(set)
    for i, t in _rows(clean):
        groups[normal(t)].add((i is None, i or 0))
    assert sum(got.values()) == len(groups) == len({normal(t) for _, t in got})
    assert all((i is None, i or 0) == min(groups[normal(t)]) for i, t in got)
    exact = exact.cache()

    near = stages["simhash near-dedup"](spark, exact, folder)
    sets = {k: set(simhash.shingle_hashes((k[1] or "").encode(), 5).tolist()) for k in got}
    linked = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    groups = collections.defaultdict(list)
    for k, root in _components(set(got), linked=linked).items():
        groups[root].append(k)
    kept = _rows(near)
    assert set(kept) <= set(got) and near.schema == docs.schema
    assert all(min(g, key=lambda k: (k[0] is None, k[0] or 0)) in kept for g in groups.values()) and len(kept) - len(groups) <= 0.1 * len(got)
    near = near.cache()

    mixed = stages["mixing"](spark, near, folder)
    assert mixed.columns == docs.columns and set(_rows(mixed)) <= set(kept) and all(n <= 3 * kept[k] for k, n in _rows(mixed).items())
    words = sum(len(WORD.findall(t or "")) * n for (_, t), n in _rows(mixed).items())
    total = sum(len(WORD.findall(t or "")) * n for (_, t), n in kept.items())
    assert 0 < words <= total
    packed = stages["best-fit packing"](spark, mixed, folder)
    assert packed.where("piece = 0").count() == mixed.count()


def test_stages_on_empty_tables(spark, tmp_path):
    data.no_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    scored = queries.op5_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in scored) / len(scored)
    found = sum(r.predicted for r in scored if r.toxic) / max(1, sum(r.toxic for r in scored))
    assert right > 0.97 and found > 0.9


def test_stages_leave_clashing_columns_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ("copy", "copies", "its_id", "its_source", "key", "kept", "gone", "source_size", "mark", "pipeline_copies")
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, kept, folder)
        assert kept.schema.simpleString() == docs.schema.simpleString()
        kept = kept.cache()
    for r in kept.collect():
        assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in names)
