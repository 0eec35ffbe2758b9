"""Queries of the general data problems over the code-index tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.paths import plain_ref
from graphmill.operators import hierarchy as H
from graphmill.operators import orphans as O
from graphmill.operators import snapshots as S
from graphmill.session import durable, table

# --- 3: parent-child links to full hierarchies -------------------------------------------


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = durable(H.current_rows(table(spark, d, "symbols"), "id", "ingested_at", ["parent_id", "children", "name"]))
    return durable(H.parent_links(rows)), rows.select(F.col("id").alias("node"), "name")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links, _ = _links(spark, d)
    return H.cycle_nodes(links).select(F.col("node").alias("symbol_id"), "cycle_id")


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    links, names = _links(spark, d)
    placed = H.heavy_paths(links, names=names)
    return placed.select(
        F.col("node").alias("symbol_id"),
        F.col("parent").alias("parent_symbol_id"),
        F.col("root").alias("root_id"),
        "depth",
        "path",
        "subtree_size",
        "cycle_id",
        "root_cycle_id",
    )


def p3_intervals(spark: SparkSession, d: str) -> DataFrame:
    """One row per symbol: its descendants are the symbols of its root with pre in (pre, last]; in place of the pairs, whose number is the sum of all depths."""
    links, _ = _links(spark, d)
    placed = H.heavy_paths(links)
    return placed.select(F.col("node").alias("symbol_id"), F.col("root").alias("root_id"), "pre", (F.col("pre") + F.col("subtree_size") - 1).alias("last"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    links, _ = _links(spark, d)
    pairs = H.descendants(H.heavy_paths(links))
    return pairs.select(F.col("node").alias("symbol_id"), F.col("descendant").alias("descendant_id"), "distance")


# --- 4: what changed between full snapshots ----------------------------------------------


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "symbol_snapshots").select("run_id", "id", "ast_hash", "signature", "loaded_at")
    pairs = durable(S.run_pairs(table(spark, d, "ingestion_stats"), rows))
    return S.snapshot_changes(rows, pairs).withColumnRenamed("id", "symbol_id")


def p4_changes_per_run(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("run_id", "change").agg(F.count("*").alias("symbols"))


# --- 7: references to records that do not exist ------------------------------------------


def _references(spark: SparkSession, d: str) -> DataFrame:
    """(edge_id, ref_side, path, part, observed_at): part is what follows ``#``, null for a bare path."""
    edges = table(spark, d, "edges").select("edge_id", "src", "dst", "observed_at")
    ends = edges.select(
        "edge_id",
        "observed_at",
        F.explode(F.array(F.struct(F.lit("src").alias("ref_side"), F.col("src").alias("r")), F.struct(F.lit("dst").alias("ref_side"), F.col("dst").alias("r")))).alias("e"),
    ).select("edge_id", "observed_at", "e.ref_side", plain_ref(F.col("e.r")).alias("ref"))
    ends = ends.filter((F.col("ref") != "") & (F.col("ref").contains("#") | (F.col("ref_side") == "src")))
    cut = F.instr("ref", "#")
    return ends.select(
        "edge_id",
        "ref_side",
        "observed_at",
        F.when(cut > 0, F.substring("ref", F.lit(1), cut - 1)).otherwise(F.col("ref")).alias("path"),
        F.when(cut > 0, F.substring(F.col("ref"), cut + 1, F.length("ref"))).alias("part"),
    )


def _targets(spark: SparkSession, d: str) -> dict:
    def split(df, *more):
        return df.filter("id is not null").select(
            F.substring_index("id", "#", 1).alias("path"), F.expr("substring(id, instr(id, '#') + 1)").alias("part"), *more
        )

    own = O.target_life(split(table(spark, d, "symbols"), "ingested_at", "deleted_at"), ["path", "part"], "ingested_at", "deleted_at")
    shared = O.target_life(split(table(spark, d, "shared_symbols")), ["path", "part"])
    own = own.join(F.broadcast(shared.select("k")), "k", "left_anti")  # a fixed table of 60 rows
    files = O.target_life(table(spark, d, "files").select("path"), ["path"])
    return {(True, True): own.unionByName(shared), (True, False): files}


def p7_orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_references(durable(_references(spark, d)), ["path", "part"], _targets(spark, d), "observed_at")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_orphans(spark, d).select("edge_id", "ref_side", "reason").distinct()


def p7_per_month(spark: SparkSession, d: str) -> DataFrame:
    one = p7_orphans(spark, d).dropDuplicates(["edge_id", "ref_side", "reason"])
    month = F.date_format("observed_at", "yyyy-MM").alias("month")
    return one.groupBy("ref_side", month, "reason").agg(F.count("*").alias("refs"))


# --- SQL ---------------------------------------------------------------------------------

def _plain_sql(col: str) -> str:
    """DuckDB text for plain_ref: outer blanks off, then '.', '' and one level of 'x/..' folded, three times over."""
    out = f"regexp_replace(replace({col}, chr(92), '/'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    for _ in range(4):
        out = f"regexp_replace(regexp_replace({out}, '(^|/)(\\./|/)+', '\\1', 'g'), '(^|/)[^/.#][^/#]*/\\.\\./', '\\1')"
    return out


_P3_LINKS = f"""cur as (
  select id, arg_max(struct_pack(p := parent_id, c := children, n := name), ingested_at) as s from symbols where id is not null group by id),
listed as (
  select {_plain_sql('c')} as id, min(id) as lister from (select id, unnest(s.c) as c from cur) group by 1),
named as (select id, nullif({_plain_sql('s.p')}, '') as p, coalesce(s.n, id) as name from cur),
links as (
  select n.id, n.name, coalesce(n.p, l.lister) as w from named n left join listed l on l.id = n.id),
linked as (select id, name, case when w in (select id from cur) then w end as p from links),
walk as (
  select id as start, p as node from linked where p is not null
  union
  select w.start, l.p from walk w join linked l on l.id = w.node where l.p is not null),
on_cycle as (select distinct start from walk where node = start),
rings as (select w.start as id, least(w.start, min(w.node)) as cycle_id from walk w join on_cycle o on o.start = w.start group by w.start)"""
P3_SQL = f"with recursive {_P3_LINKS} select id as symbol_id, cycle_id from rings"
_P3_TREE = f"""with recursive {_P3_LINKS},
forest as (select l.id, l.name, case when r.id is null then l.p end as p, r.cycle_id from linked l left join rings r on r.id = l.id),
down as (
  select id, p, id as root, 0 as depth, name as path, cycle_id, cycle_id as root_cycle_id from forest where p is null
  union all
  select f.id, f.p, d.root, d.depth + 1, concat(d.path, ' > ', f.name), f.cycle_id, d.root_cycle_id from down d join forest f on f.p = d.id),
above as (
  select id, id as node, 0 as distance from forest
  union all
  select a.id, f.p, a.distance + 1 from above a join forest f on f.id = a.node where f.p is not null)"""
P3_TREE_SQL = f"""{_P3_TREE}, sizes as (select node, count(*) as n from above group by node)
select d.id as symbol_id, d.p as parent_symbol_id, d.root as root_id, cast(d.depth as bigint) as depth, d.path, cast(s.n as bigint) as subtree_size, d.cycle_id, d.root_cycle_id
from down d join sizes s on s.node = d.id"""
P3_PAIRS_SQL = f"{_P3_TREE} select node as symbol_id, id as descendant_id, cast(distance as bigint) as distance from above where distance > 0"

_DIGEST = "nullif(regexp_replace(lower(regexp_replace({0}, '\\s+', '', 'g')), '^(.*:|0x)', ''), '')"

P4_SQL = f"""
with state as (
  select run_id, id, arg_max(struct_pack(d := {_DIGEST.format('ast_hash')}, t := regexp_replace(signature, '\\s+', '', 'g')), loaded_at) as s
  from symbol_snapshots group by run_id, id),
done as (
  select repo, run_id, started_at, {_DIGEST.format('merkle_root')} as root,
         run_id in (select run_id from symbol_snapshots) as has
  from ingestion_stats where status = 'completed'),
marked as (
  select *, case when has or root is null or root is distinct from lag(root) over w then 1 else 0 end as starts,
         row_number() over w as nth
  from done window w as (partition by repo order by started_at, run_id)),
segs as (select *, sum(starts) over (partition by repo order by started_at, run_id) as seg from marked),
conts as (select *, max(case when has then run_id end) over (partition by repo, seg) as cur_run from segs),
pairs as (
  select * from (select run_id, cur_run, nth, lag(cur_run) over (partition by repo order by started_at, run_id) as prev_run from conts)
  where nth > 1),
new as (select p.run_id, s.id, s.s from pairs p join state s on s.run_id = p.cur_run),
old as (select p.run_id, s.id, s.s from pairs p join state s on s.run_id = p.prev_run),
both_ as (
  select coalesce(n.run_id, o.run_id) as run_id, coalesce(n.id, o.id) as symbol_id, n.s as ns, o.s as os,
         n.id is null as gone, o.id is null as fresh
  from new n full join old o on n.run_id = o.run_id and n.id = o.id)
select run_id, symbol_id, case when fresh then 'added' when gone then 'removed' else 'changed' end as change from both_
where fresh or gone or case when ns.d is not null and os.d is not null then ns.d <> os.d
      else coalesce(ns.t, '') <> coalesce(os.t, '') end
"""

P7_SQL = f"""
with ends as (
  select edge_id, observed_at, 'src' as ref_side, {_plain_sql('src')} as ref from edges
  union all
  select edge_id, observed_at, 'dst', {_plain_sql('dst')} from edges),
refs as (select distinct * from ends where ref <> '' and (contains(ref, '#') or ref_side = 'src')),
life as (select id, min(ingested_at) as born, arg_max(struct_pack(g := deleted_at), ingested_at).g as gone from symbols group by id),
judged as (
  select r.edge_id, r.ref_side, case
    when not contains(r.ref, '#') then case when f.path is null then 'missing' end
    when s.id is not null then null
    when l.id is null then 'missing'
    when r.observed_at < l.born then 'late'
    when l.gone <= r.observed_at then 'deleted' end as reason
  from refs r
  left join life l on l.id = r.ref
  left join (select distinct id from shared_symbols) s on s.id = r.ref
  left join (select distinct path from files) f on f.path = r.ref and not contains(r.ref, '#'))
select distinct edge_id, ref_side, reason from judged where reason is not null
"""


def queries() -> dict:
    return {
        "p3_found": p3_found,
        "p3_hierarchy": p3_hierarchy,
        "p3_descendants": p3_descendants,
        "p3_intervals": p3_intervals,
        "p4_found": p4_found,
        "p4_changes_per_run": p4_changes_per_run,
        "p7_found": p7_found,
        "p7_per_month": p7_per_month,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": P3_SQL,
        "p3_hierarchy": P3_TREE_SQL,
        "p3_descendants": P3_PAIRS_SQL,
        "p4_found": P4_SQL,
        "p4_changes_per_run": f"select run_id, change, count(*) as symbols from ({P4_SQL}) group by run_id, change",
        "p7_found": P7_SQL,
        "p7_per_month": f"""select o.ref_side, strftime(e.observed_at, '%Y-%m') as month, o.reason, count(*) as refs
            from ({P7_SQL}) o join (select edge_id, any_value(observed_at) as observed_at from edges group by edge_id) e
            on e.edge_id = o.edge_id group by 1, 2, 3""",
    }
