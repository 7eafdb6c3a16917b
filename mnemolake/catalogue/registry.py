"""Registration, and the SQL fragments that oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its DuckDB version."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def clean_sql(column: str) -> str:
    out = column
    for pattern, replacement in (
        ("<[^>]+>", ""), (r"#+\s?", ""), (r"(?:\*\*|__)(.*?)(?:\*\*|__)", r"\1"), (r"[*_](.*?)[*_]", r"\1"), (r"\[(.*?)\]\(.*?\)", r"\1"), (r"!\[.*?\]\(.*?\)", ""), (r"(?s)```.*?```", ""),
        ("`([^`]+)`", r"\1"), (r"(?m)^[-*+]\s+", ""), (r"(?m)^\d+\.\s+", ""), (r"(?m)^>\s+", ""), ("---+", ""), (r"\|", " "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return trim_sql(out)


def trim_sql(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def tokens_sql(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+')"


#: Common table expressions; each may use those above it.
PARTS = {
    "ents": """ents AS (
  SELECT 1000000000000 + r_regionkey AS id, r_name AS name, 'region' AS entity_type, [r_name, 'region ' || r_regionkey] AS aliases, '' AS attrs FROM region
  UNION ALL SELECT 1001000000000 + n_nationkey, n_name, 'nation', [n_name, 'nation ' || n_nationkey], '' FROM nation
  UNION ALL SELECT 1002000000000 + c_custkey, c_name, 'customer', [c_name, 'customer ' || c_custkey], 'mktsegment ' || c_mktsegment FROM customer
  UNION ALL SELECT 1003000000000 + s_suppkey, s_name, 'supplier', [s_name, 'supplier ' || s_suppkey], '' FROM supplier
  UNION ALL SELECT 1004000000000 + p_partkey, p_name, 'part', [p_name, 'part ' || p_partkey, p_brand], 'brand ' || p_brand || ' type ' || p_type FROM part)""",
    "rels": """rels AS (
  SELECT 2000000000000 + n_nationkey AS id, 1001000000000 + n_nationkey AS src, 'located_in' AS predicate, 1000000000000 + n_regionkey AS dst FROM nation
  UNION ALL SELECT 2001000000000 + c_custkey, 1002000000000 + c_custkey, 'based_in', 1001000000000 + c_nationkey FROM customer
  UNION ALL SELECT 2002000000000 + s_suppkey, 1003000000000 + s_suppkey, 'based_in', 1001000000000 + s_nationkey FROM supplier
  UNION ALL SELECT DISTINCT 2003000000000 + l_suppkey * 1000000 + l_partkey, 1003000000000 + l_suppkey, 'supplies', 1004000000000 + l_partkey FROM lineitem
  UNION ALL SELECT 2800000000000 + p_partkey, 1004000000000 + p_partkey, 'sys:same_as', 1004000000000 + first
    FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS first FROM part) WHERE p_partkey <> first)""",
    "parts": """parts AS (
  SELECT 3000000000000 + o_orderkey AS event_id, 1002000000000 + o_custkey AS entity_id FROM orders
  UNION ALL SELECT DISTINCT 3000000000000 + l_orderkey, 1003000000000 + l_suppkey FROM lineitem)""",
    "notes": """notes AS (
  SELECT d.doc_id, 4000000000000 + d.doc_id AS id, CASE WHEN lang = 'en' THEN 'public' ELSE 'foreign' END AS scope, lang, source, 'doc_' || d.doc_id AS title, text,
    list_sort(list_distinct(list_filter([lang, source, 'quality:' || quality, 'toxic:' || toxic], lambda x: x IS NOT NULL))) AS tags
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
}


def with_parts(*names: str) -> str:
    return "WITH " + ",\n".join(PARTS[n] for n in names)


def search_sql(strict: list[str], loose: list[str], limit: int, field: str = "all", where: str = "true", mode: str = "both") -> str:
    """Two-pass BM25 over notes as one chunk each."""
    fields = {"all": {"text": 1.0, "name": 4.0}}.get(field, {field: 1.0})
    quote = lambda terms: "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"
    columns = {"text": tokens_sql(clean_sql("text")), "name": tokens_sql("title"), "path": tokens_sql("lang || ' ' || source")}
    toks = " UNION ALL ".join(f"SELECT id, scope, tags, '{f}' AS f, {w}::DOUBLE AS w, {columns[f]} AS toks FROM notes" for f, w in fields.items())
    passes = []
    for flag, terms in (("1", strict), ("0", loose)):
        if mode == "both" or mode == {"1": "strict", "0": "loose"}[flag]:
            need = f"AND count(DISTINCT term) = {len(terms)}" if flag == "1" else ""
            passes.append(f"SELECT id, {flag} AS strict, sum(s) AS score FROM sc WHERE term IN (SELECT unnest({quote(terms)})) AND {where} GROUP BY id HAVING count(*) > 0 {need}")
    every = quote(list(dict.fromkeys([*strict, *loose])))
    return f"""{with_parts('notes')},
toks AS ({toks}),
st AS (SELECT f, count(*) AS n, avg(len(toks)) AS mean FROM toks GROUP BY f),
hit AS (SELECT id, scope, tags, f, w, term, len(list_filter(toks, lambda x: x = term)) AS tf, len(toks) AS dl FROM toks, (SELECT unnest({every}) AS term) q),
dfs AS (SELECT f, term, count(*) AS df FROM hit WHERE tf > 0 GROUP BY f, term),
sc AS (SELECT id, scope, tags, hit.term, w * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) AS s
  FROM hit JOIN dfs ON dfs.f = hit.f AND dfs.term = hit.term JOIN st ON st.f = hit.f WHERE tf > 0),
both_passes AS ({' UNION ALL '.join(passes)}),
hits AS (SELECT id, strict, score FROM both_passes QUALIFY row_number() OVER (PARTITION BY id ORDER BY strict DESC) = 1 ORDER BY strict DESC, round(score, 9) DESC, id LIMIT {limit})"""
