"""How queries are listed, and the roles that the given tables play in them.

A role is a SELECT that Spark and DuckDB both understand, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FILES = "SELECT source AS project, concat(source, '/', doc_id, '.', lang) AS path, lang AS ext, doc_id, text AS content FROM documents"
FINDINGS = """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id, l_orderkey AS session_id, concat('src/m', l_partkey % 50, '.ts') AS file, CAST(l_linenumber AS INT) AS line, concat('S', l_suppkey % 40) AS pattern_id,
 CASE l_returnflag WHEN 'A' THEN 'P0' WHEN 'R' THEN 'P1' ELSE 'P2' END AS severity, CASE l_linestatus WHEN 'F' THEN 'fixed' ELSE 'open' END AS status,
 CASE l_suppkey % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'code-quality' ELSE 'other' END AS category, concat('finding ', l_suppkey % 7) AS title, concat('part ', l_partkey) AS evidence, l_shipdate AS created_at FROM lineitem"""
SESSIONS = "SELECT o_orderkey AS session_id, concat('Project-', o_custkey % 30) AS project, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS status, o_orderdate AS started_at FROM orders"
RULES = """SELECT concat('R', p_partkey) AS id, CAST(p_partkey AS INT) AS pos, p_name AS name, concat(p_brand, '.*', p_size) AS scan_query, CASE p_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'bogus' END AS severity,
 CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'none' END AS confidence, CASE p_partkey % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' ELSE 'testing' END AS category,
 CASE WHEN p_partkey % 6 = 0 THEN 'CWE-x' WHEN p_partkey % 2 = 0 THEN '' ELSE concat('CWE-', p_size) END AS cwe, CASE p_size % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'typescript' END AS scan_language, CASE p_size % 4 WHEN 0 THEN '**/*.{ts,tsx}' WHEN 1 THEN '*.py' WHEN 2 THEN '' ELSE 'src/*.go' END AS scan_file_glob FROM part"""
DOCS = """SELECT d.doc_id AS id, substr(d.text, 1, 60) AS query, d.text AS summary, d.lang, d.source, CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'completed' ELSE 'partial' END AS status, d.doc_id % 5 + 1 AS depth,
 CAST(TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL '7' HOUR AS TIMESTAMP) AS saved_at FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
MESSAGES = "SELECT conv_id, CAST(turn AS INT) AS turn, role, text FROM conversations"
EVENTS = "SELECT event_id, ts, user_id, event_type, value FROM events"

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def role(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a role, or of any SELECT over the given tables."""
    used = [t for t in _TABLES if re.search(rf"(?i)\b(from|join)\s+{t}\b", sql)]
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"(?i)\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def query(name: str, sql: str | None = None) -> Callable:
    """Lists a function of (spark, sf_dir) as a query, with its SQL if there is one."""

    def listed(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is listed twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return listed


def values(rows: list[tuple], names: str) -> str:
    """Literal rows as `(VALUES ...) AS t(names)`, for DuckDB."""

    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "[" + ", ".join(map(one, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({names}))"
