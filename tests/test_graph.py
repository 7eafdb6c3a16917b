"""Graph operators on small literal graphs."""

import random

import pytest

from mnemolake.operators import graph


@pytest.fixture
def edges(spark):
    return lambda pairs: spark.createDataFrame([(i, a, p, b) for i, (a, p, b) in enumerate(pairs)], "id long, src long, predicate string, dst long")


def _nodes(spark, n):
    return spark.range(1, n + 1)


def test_basics(spark, edges):
    chain = edges([(1, "r", 2), (2, "r", 3), (2, "r", 1)])
    assert [(r.id, r.hop) for r in graph.ego(chain, 1, 2).collect()] == [(2, 1), (3, 2)]
    assert [r.id for r in graph.ego(chain, 1, 2, 1).collect()] == [2]
    assert [r.id for r in graph.shortest_path(chain, 1, 3).orderBy("position").collect()] == [1, 2, 3]
    assert graph.shortest_path(chain, 3, 1).count() == 0 and [r.id for r in graph.shortest_path(chain, 2, 2).collect()] == [2]
    assert sorted((r.id, r.component) for r in graph.strongly_connected(chain).collect()) == [(1, 1), (2, 1)]
    assert graph.component_count(_nodes(spark, 3), chain) == 1 and graph.component_count(_nodes(spark, 4), chain) == 2
    assert graph.ego(chain, 99, 2).count() == 0


def test_path_of_many_hops(spark, edges):
    chain = edges([(i, "r", i + 1) for i in range(70)])
    assert [r.id for r in graph.shortest_path(chain, 0, 70).orderBy("position").collect()] == list(range(71))


def test_rules_open_reverse_traversal(spark, edges):
    family = edges([(1, "father", 2), (3, "colleague", 4)])
    assert graph.ego(family, 2, 1).count() == 0
    rules = spark.createDataFrame([("father", "child", False), ("colleague", None, True)], "predicate string, inverse string, symmetric boolean")
    full = graph.augmented(family, rules)
    assert [r.id for r in graph.ego(full, 2, 1).collect()] == [1] and [r.id for r in graph.ego(full, 4, 1).collect()] == [3]


def test_contraction_shares_a_neighbourhood(spark, edges):
    canon, rest = graph.contracted(edges([(2, graph.SAME_AS, 5), (5, "tutor", 9), (2, "knows", 7), (2, "knows", 7)]))
    assert {(r.id, r.canonical) for r in canon.collect()} == {(2, 2), (5, 2)}
    assert sorted((r.src, r.predicate, r.dst) for r in rest.collect()) == [(2, "knows", 7), (2, "knows", 7), (2, "tutor", 9)]


def _strong(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {}
    for n in nodes:
        seen, stack = set(), [n]
        while stack:
            for a, b in pairs:
                if a == stack[-1] and b not in seen:
                    seen.add(b)
                    stack.append(b)
                    break
            else:
                stack.pop()
        reach[n] = seen
    groups = {n: frozenset([n, *(m for m in reach[n] if n in reach[m])]) for n in nodes}
    return {(n, min(g)) for n, g in groups.items() if len(g) > 1}


def test_random_components(spark, edges):
    rng = random.Random(5)
    pairs = [(rng.randint(1, 25), rng.randint(1, 25)) for _ in range(32)]
    frame = edges([(a, "r", b) for a, b in pairs])
    assert {(r.id, r.component) for r in graph.strongly_connected(frame).collect()} == _strong([p for p in pairs if p[0] != p[1]])
    labels = {n: n for n in range(1, 26)}
    for _ in range(26):
        for a, b in pairs:
            labels[a] = labels[b] = min(labels[a], labels[b])
    assert {(r.id, r.label) for r in graph.component_labels(_nodes(spark, 25), frame).collect()} == set(labels.items())


def test_expand_query():
    groups = {"delta": "g", "epsilon": "g", "other": "h"}
    assert graph.expand_query("what is Epsilon", groups) == "what is Epsilon delta g" and graph.expand_query("none", groups) == "none"


def test_sums_of_edges_beyond_a_long(spark, monkeypatch):
    from mnemolake.catalogue import graphs

    edges = lambda *rows: monkeypatch.setattr(graphs, "_augmented", lambda *_: spark.createDataFrame(rows, "src long, predicate string, dst long"))
    edges((2**62, "a", 1), (2**62, "a", 2), (2**62, "a", 3), (5, "b", -6))
    assert sorted(map(tuple, graphs.rule_augmented_edges(spark, "").collect())) == [("a", 3, 3 * 2**62, 6), ("b", 1, 5, -6)]
    edges((5, "b", -6), (2**62, "b", 7))
    got = graphs.rule_augmented_edges(spark, "")
    assert dict(got.dtypes) == {"predicate": "string", "n": "bigint", "src_sum": "bigint", "dst_sum": "bigint"} and got.first()["src_sum"] == 2**62 + 5


def test_references_in_as_many_parts_as_they_need(spark, monkeypatch, tmp_path):
    from mnemolake.operators import lifecycle

    edges = [(i % 50, 1000 + i % 70, i % 7) for i in range(700)] + [(3, 5, 3), (3, 5, 3), (4, 1000, 99)]
    met = [(i, i % 9) for i in range(60)] + [(1, 1), (1, 98)]
    spark.createDataFrame(edges, "src long, id long, dst long").write.parquet(f"{tmp_path}/edges")
    spark.createDataFrame(met, "event_id long, entity_id long").write.parquet(f"{tmp_path}/met")
    relations, people = spark.read.parquet(f"{tmp_path}/edges"), spark.read.parquet(f"{tmp_path}/met")
    assert lifecycle._parts(relations) == 4
    monkeypatch.setattr(lifecycle, "PART_BYTES", 1 << 10)
    assert lifecycle._parts(relations) > 4 and lifecycle._parts(spark.createDataFrame(met, "a long, b long")) >= 4
    got = lifecycle.blocked_by_reference(spark.range(60), relations, people)
    refs, seen = {(e, r) for s, r, d in edges for e in (s, d)}, set(met)
    want = {(i, sum(e == i for e, _ in refs), sum(e == i for _, e in seen)) for i in range(60)}
    assert {(r.id, r.relations, r.events) for r in got.collect()} == {w for w in want if w[1] or w[2]}
