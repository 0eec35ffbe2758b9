"""Derived inputs for the queries: a graph over the star schema, paths, snapshots, lines and traces.

Each is a DataFrame and the same thing as the text of SQL common table
expressions, so that a query and its SQL start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.session import table

_NODES = """
select concat('r', r_regionkey) as id, r_name as name, 'Module' as kind, 'region' as file_path, 'geo' as language, cast(null as {s}) as parent_id, cast(1 as bigint) as token_count from region
union all select concat('n', n_nationkey), n_name, 'Class', concat('region/', n_regionkey), 'geo', concat('r', n_regionkey), cast(1 as bigint) from nation
union all select concat('c', c_custkey), c_name, 'Function', concat('nation/', c_nationkey), c_mktsegment, concat('n', c_nationkey), cast(1 + c_custkey % 97 as bigint) from customer
union all select concat('s', s_suppkey), s_name, 'Trait', concat('nation/', s_nationkey), 'supply', concat('n', s_nationkey), cast(1 + s_suppkey % 31 as bigint) from supplier
union all select concat('p', p_partkey), p_name, p_type, concat('brand/', p_brand), 'part', cast(null as {s}), cast(p_size as bigint) from part
union all select concat('o', o_orderkey), concat('order', o_orderkey), 'Method', concat('cust/', o_custkey), o_orderstatus, concat('c', o_custkey), cast(1 + o_orderkey % 53 as bigint) from orders
"""
_EDGES = """
select distinct src, dst, edge_type from (
select concat('r', n_regionkey) as src, concat('n', n_nationkey) as dst, 'Contains' as edge_type from nation
union all select concat('n', c_nationkey), concat('c', c_custkey), 'Contains' from customer
union all select concat('n', s_nationkey), concat('s', s_suppkey), 'Contains' from supplier
union all select concat('o', o_orderkey), concat('c', o_custkey), 'References' from orders
union all select concat('o', l_orderkey), concat('p', l_partkey), 'Calls' from lineitem
union all select concat('p', l_partkey), concat('s', l_suppkey), 'Imports' from lineitem) e
"""
_NAME_EDGES = "select distinct concat('o', l_orderkey) as src, p_name as dst_name from lineitem join part on p_partkey = l_partkey"
_PATHS = "select doc_id, concat(source, '/', coalesce(lang, 'none'), '/', doc_id, '.txt') as path, text from documents"
_TRACES = "select user_id as trace_id, row_number() over (partition by user_id order by ts, event_id) as pos, event_type as node, event_id, ts from events"


def _spark(sql: str) -> str:
    return sql.replace("{s}", "string")


def _duck(sql: str) -> str:
    return sql.replace("{s}", "varchar")


def _with_tables(spark: SparkSession, d: str, sql: str, tables: list[str]) -> DataFrame:
    for t in tables:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, d, t) for t in tables})


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return _with_tables(spark, d, _spark(_NODES), ["region", "nation", "customer", "supplier", "part", "orders"])


def edges(spark: SparkSession, d: str) -> DataFrame:
    return _with_tables(spark, d, _EDGES, ["nation", "customer", "supplier", "orders", "lineitem"])


def name_edges(spark: SparkSession, d: str) -> DataFrame:
    return _with_tables(spark, d, _NAME_EDGES, ["lineitem", "part"])


def doc_paths(spark: SparkSession, d: str) -> DataFrame:
    return _with_tables(spark, d, _PATHS, ["documents"])


def traces(spark: SparkSession, d: str) -> DataFrame:
    return _with_tables(spark, d, _TRACES, ["events"]).withColumn("pos", F.col("pos").cast("long"))


def docs_v1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def docs_v2(spark: SparkSession, d: str) -> DataFrame:
    """The next snapshot: some documents gone, some edited, some new."""
    base = docs_v1(spark, d)
    kept = base.filter("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    return kept.unionByName(base.filter("doc_id % 29 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))


SQL = {
    "g_nodes": _duck(_NODES),
    "g_edges": _EDGES,
    "g_name_edges": _NAME_EDGES,
    "doc_paths": _PATHS,
    "traces": _TRACES,
    "docs_v1": "select doc_id, coalesce(text, '') as text from documents",
    "docs_v2": """select doc_id, case when doc_id % 13 = 0 then concat(text, ' edited') else text end as text from docs_v1 where doc_id % 17 <> 0
                  union all select doc_id + 1000000000, text from docs_v1 where doc_id % 29 = 0""",
}


def ctes(*names: str, recursive: bool = False) -> str:
    """The head of a SQL text that defines the named fixtures."""
    if "docs_v2" in names and "docs_v1" not in names:
        names = ("docs_v1", *names)
    body = ", ".join(f"{n} as ({SQL[n]})" for n in names)
    return f"with {'recursive ' if recursive else ''}{body}"
