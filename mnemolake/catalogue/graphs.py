"""Queries over the graph of entities, relations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.catalogue import search
from mnemolake.catalogue.registry import ORACLE_SQL, query, with_parts
from mnemolake.catalogue.texts import relation_texts
from mnemolake.operators import graph
from mnemolake.operators.materialize import settle
from mnemolake.plans import presets
from mnemolake.sources.projection import Store

ROOT = 1001 * 10**9 + 7  # nation 7
SUPPLIER = 1003 * 10**9 + 3


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("based_in", "home_of", False), ("located_in", None, True)], "predicate string, inverse string, symmetric boolean")


_AUGMENTED = """aug AS (SELECT id, src, predicate, dst FROM rels
  UNION ALL SELECT id, dst, 'home_of', src FROM rels WHERE predicate = 'based_in'
  UNION ALL SELECT id, dst, predicate, src FROM rels WHERE predicate IN ('located_in', 'sys:same_as'))"""
_CANON = """canon AS (SELECT 1004000000000 + p_partkey AS id, 1004000000000 + min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS canonical FROM part)"""


def _augmented(spark: SparkSession, d: str) -> DataFrame:
    return graph.augmented(Store(spark, d).relations, _rules(spark))


@query(with_parts("rels") + f", {_AUGMENTED} SELECT predicate, count(*) AS n, sum(src)::BIGINT AS src_sum, sum(dst)::BIGINT AS dst_sum FROM aug GROUP BY predicate")
def rule_augmented_edges(spark: SparkSession, d: str) -> DataFrame:
    """Sums of ids pass a long's ends at some nine million edges, where SQL has no result but an error. They are summed exactly,
    and are longs, as in SQL, wherever all of them fit; else they stay decimals."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(19,0)"))
    rows = settle(_augmented(spark, d).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), wide("src").alias("src_sum"), wide("dst").alias("dst_sum")))  # one for a predicate
    if not rows.where("greatest(abs(src_sum), abs(dst_sum)) > 9223372036854775807").isEmpty():
        return rows
    return rows.withColumns({c: F.col(c).cast("long") for c in ("src_sum", "dst_sum")})


@query(with_parts("rels") + f""", {_CANON}
SELECT rels.id, coalesce(a.canonical, src) AS src, predicate, coalesce(b.canonical, dst) AS dst FROM rels LEFT JOIN canon a ON a.id = src LEFT JOIN canon b ON b.id = dst WHERE predicate <> 'sys:same_as'""")
def alias_contraction(spark: SparkSession, d: str) -> DataFrame:
    return graph.contracted(Store(spark, d).relations)[1]


@query("SELECT 1004000000000 + p_partkey AS id, p_name AS name FROM part WHERE p_brand = 'Brand#23' OR p_name = 'Brand#23' ORDER BY id LIMIT 200")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve(Store(spark, d).entities, " BRAND#23 ", 200).select("id", "name")


@query(with_parts("rels") + f""" SELECT id AS relation_id, CASE WHEN src = {ROOT} THEN dst ELSE src END AS entity_id, predicate, src = {ROOT} AS outgoing
FROM rels WHERE src = {ROOT} OR dst = {ROOT} ORDER BY id LIMIT 100""")
def neighbors_one_hop(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    return graph.neighbors(store.relations, store.entities, ROOT, 100)


@query(with_parts("parts") + f" SELECT 3000000000000 + o_orderkey AS id, 'order ' || o_orderkey AS name FROM orders WHERE 3000000000000 + o_orderkey IN (SELECT event_id FROM parts WHERE entity_id = {SUPPLIER}) ORDER BY id LIMIT 50")
def events_for_entity(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    return graph.events_of(store.events, store.participants, SUPPLIER, 50).select("id", "name")


def _members(store: Store) -> DataFrame:
    """Suppliers and nations with a small key, and their parts' ids below one thousand."""
    return store.entities.where("(entity_type IN ('supplier', 'nation') AND id % 1000000000 <= 5) OR (entity_type = 'part' AND id % 1000000000 < 1000)").select("id")


_MEMBERS = "mem AS (SELECT id FROM ents WHERE (entity_type IN ('supplier', 'nation') AND id % 1000000000 <= 5) OR (entity_type = 'part' AND id % 1000000000 < 1000))"


@query(with_parts("ents", "rels") + f", {_MEMBERS} SELECT id, src, predicate, dst FROM rels WHERE src IN (SELECT id FROM mem) OR dst IN (SELECT id FROM mem)")
def edges_incident_to_set(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    return graph.incident(store.relations.select("id", "src", "predicate", "dst"), _members(store))


@query(with_parts("ents", "rels") + f", {_MEMBERS} SELECT id, src, predicate, dst FROM rels WHERE src IN (SELECT id FROM mem) AND dst IN (SELECT id FROM mem)")
def edges_between_set(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    return graph.between(store.relations.select("id", "src", "predicate", "dst"), _members(store))


@query(with_parts("ents", "parts") + f", {_MEMBERS} SELECT event_id AS id FROM parts WHERE entity_id IN (SELECT id FROM mem) GROUP BY event_id HAVING count(DISTINCT entity_id) >= 2")
def events_between_set(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    return graph.events_between(store.events, store.participants, _members(store)).select("id")


@query(with_parts("ents", "rels") + """, tags AS (SELECT conv_id AS record_id, 'customer ' || (conv_id % 40 + 1) AS tag FROM conversations GROUP BY conv_id),
roots AS (SELECT DISTINCT record_id, id AS root FROM tags JOIN (SELECT id, lower(unnest(aliases)) AS alias FROM ents) ON alias = tag),
inc AS (SELECT src AS root, id AS relation_id, dst AS other FROM rels UNION ALL SELECT dst, id, src FROM rels WHERE src <> dst),
near AS (SELECT * FROM inc WHERE root IN (SELECT root FROM roots) QUALIFY row_number() OVER (PARTITION BY root ORDER BY relation_id) <= 3)
SELECT record_id, roots.root, relation_id, other FROM roots JOIN near ON near.root = roots.root""")
def tag_mounted_context(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    tags = store.table("conversations").select(F.col("conv_id").alias("record_id"), F.concat(F.lit(" Customer "), (F.col("conv_id") % 40 + 1).cast("string")).alias("tag")).distinct()
    return graph.mounted(tags, store.entities, store.relations, 3)


def _ego_sql(depth: int) -> str:
    return with_parts("rels").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_AUGMENTED},
walk AS (SELECT {ROOT} AS id, 0 AS hop UNION SELECT aug.dst, hop + 1 FROM walk JOIN aug ON aug.src = walk.id WHERE hop < {depth})
SELECT id, min(hop)::INTEGER AS hop FROM walk WHERE id <> {ROOT} GROUP BY id"""


@query(_ego_sql(1))
def ego_1hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.ego(_augmented(spark, d), ROOT, 1)


@query(_ego_sql(2))
def ego_2hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.ego(_augmented(spark, d), ROOT, 2)


# From a customer over its nation and region to the last other nation of that region.
_GOAL = "(SELECT 1001000000000 + max(n_nationkey) FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1) AND n_nationkey <> (SELECT c_nationkey FROM customer WHERE c_custkey = 1))"


@query(with_parts("rels").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_AUGMENTED},
walk AS (SELECT 1002000000001 AS id, 0 AS hop UNION SELECT aug.dst, hop + 1 FROM walk JOIN aug ON aug.src = walk.id WHERE hop < 4 AND predicate IN ('based_in', 'located_in')),
far AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id),
back AS (SELECT {_GOAL} AS id, (SELECT hop FROM far WHERE id = {_GOAL}) AS hop
  UNION ALL SELECT p, h FROM (SELECT min(aug.src) AS p, back.hop - 1 AS h, back.id FROM back JOIN aug ON aug.dst = back.id AND predicate IN ('based_in', 'located_in') JOIN far ON far.id = aug.src AND far.hop = back.hop - 1 WHERE back.hop > 0 GROUP BY back.id, back.hop))
SELECT hop::BIGINT AS position, id FROM back""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    edges = _augmented(spark, d).where(F.col("predicate").isin("based_in", "located_in"))
    store = Store(spark, d)
    home = store.table("customer").where("c_custkey = 1").first()["c_nationkey"]
    nation = store.table("nation")
    region = nation.where(F.col("n_nationkey") == home).first()["n_regionkey"]
    goal = nation.where((F.col("n_regionkey") == region) & (F.col("n_nationkey") != home)).agg(F.max("n_nationkey")).first()[0]
    return graph.shortest_path(edges, 1002 * 10**9 + 1, 1001 * 10**9 + goal)


# Places form a tree per region; suppliers and parts join them all where one supplies a part: labels of both graphs.
@query(with_parts("ents", "rels") + """, place AS (SELECT 1001000000000 + n_nationkey AS id, 1000000000000 + n_regionkey AS label FROM nation UNION ALL SELECT 1000000000000 + r_regionkey, 1000000000000 + r_regionkey FROM region
  UNION ALL SELECT 1002000000000 + c_custkey, 1000000000000 + n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 1003000000000 + s_suppkey, 1000000000000 + n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT label, count(*) AS n FROM place GROUP BY label""")
def component_labels(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    nodes = store.entities.where("entity_type <> 'part'").select("id")
    edges = store.relations.where(F.col("predicate").isin("based_in", "located_in"))
    return graph.component_labels(nodes, edges).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT (p_name, p_brand)) AS components FROM part")
def component_count(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    n = graph.component_count(store.entities.where("entity_type = 'part'"), store.relations.where(F.col("predicate") == graph.SAME_AS))
    return spark.createDataFrame([(n,)], "components long")


# With nations and regions joined both ways, each region and its nations are one strong component.
@query("SELECT 1000000000000 + n_regionkey AS component, count(*) + 1 AS n FROM nation GROUP BY n_regionkey")
def strongly_connected(spark: SparkSession, d: str) -> DataFrame:
    edges = _augmented(spark, d).where(F.col("predicate").isin("located_in", "based_in"))
    return graph.strongly_connected(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'who supplies it' AS query, 'who supplies it delivers provides' AS expanded UNION ALL SELECT 'nothing', 'nothing'")
def predicate_expand(spark: SparkSession, d: str) -> DataFrame:
    groups = {"supplies": "supplies", "delivers": "supplies", "provides": "supplies", "based_in": "place"}
    return spark.createDataFrame([(q, graph.expand_query(q, groups)) for q in ("who supplies it", "nothing")], "query string, expanded string")


@query(with_parts("ents", "rels", "parts") + f""", seeds AS (SELECT id FROM ents WHERE id IN (1003000000003, 1001000000007)),
txt AS (SELECT rels.id, src, dst, s.name || ' ' || predicate || ' ' || o.name || ' ' AS text FROM rels JOIN ents s ON s.id = src JOIN ents o ON o.id = dst),
near AS (SELECT *, sum(len(text)) OVER (ORDER BY id) AS upto, row_number() OVER (ORDER BY id) AS nth FROM txt WHERE (src IN (SELECT id FROM seeds) OR dst IN (SELECT id FROM seeds)) AND contains(text, 'based_in')),
kept AS (SELECT * FROM near WHERE upto <= 1000 OR nth = 1),
mem AS (SELECT id FROM seeds UNION SELECT src FROM kept UNION SELECT dst FROM kept),
ctx AS (SELECT *, sum(len(text)) OVER (ORDER BY id) AS upto, row_number() OVER (ORDER BY id) AS nth FROM txt WHERE src IN (SELECT id FROM mem) AND dst IN (SELECT id FROM mem) AND id NOT IN (SELECT id FROM kept)),
ctxk AS (SELECT * FROM ctx WHERE upto <= 2000 OR nth = 1),
met AS (SELECT event_id AS id, 'order ' || o_orderkey || ' ' || o_orderpriority || ' ' AS text FROM (SELECT event_id FROM parts WHERE entity_id IN (SELECT id FROM mem) GROUP BY event_id HAVING count(DISTINCT entity_id) >= 2) JOIN orders ON 3000000000000 + o_orderkey = event_id),
metk AS (SELECT id FROM (SELECT *, sum(len(text)) OVER (ORDER BY id) AS upto, row_number() OVER (ORDER BY id) AS nth FROM met) WHERE upto <= 2000 - (SELECT coalesce(sum(len(text)), 0) FROM ctxk) OR (nth = 1 AND (SELECT coalesce(sum(len(text)), 0) FROM ctxk) < 2000))
SELECT id, 'seed' AS part FROM seeds UNION ALL SELECT id, 'relation' FROM kept UNION ALL SELECT id, 'context' FROM ctxk UNION ALL SELECT id, 'event' FROM metk""")
def preset_graph(spark: SparkSession, d: str) -> DataFrame:
    store = Store(spark, d)
    seeds = store.entities.where(F.col("id").isin(SUPPLIER, ROOT)).select("id")
    return presets.graph_route(seeds, store.relations.select("id", "src", "predicate", "dst"), relation_texts(store), store.events, store.participants, "what is based_in", [])


def _routes(**named: DataFrame) -> DataFrame:
    out = None
    for route, rows in named.items():
        one = rows.select(F.lit(route).alias("route"), "id")
        out = one if out is None else out.union(one)
    return out


def _routes_sql(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS route, id FROM ({ORACLE_SQL['preset_' + name]})" for name in names)


@query(_routes_sql("memory", "notes"))
def preset_rag(spark: SparkSession, d: str) -> DataFrame:
    return _routes(memory=search.preset_memory(spark, d), notes=search.preset_notes(spark, d))


@query(_routes_sql("memory", "graph", "notes"))
def preset_broad(spark: SparkSession, d: str) -> DataFrame:
    return _routes(memory=search.preset_memory(spark, d), graph=preset_graph(spark, d), notes=search.preset_notes(spark, d))
